import re
from datetime import date

import duckdb
from pyspark.sql import functions as F

from tessera.llm import queries, urlfilter


def keys(url):
    m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)(?:/([^/?#]*))?", url or "")
    if not m:
        return []
    host = re.sub(r":[0-9]*$", "", m[1].rpartition("@")[2]).rstrip(".").lower()
    labels = host.split(".")
    n = 3 if ".".join(labels[-2:]) in urlfilter.SUFFIXES else 2
    address = host.startswith("[") or len(labels) == 4 and all(re.fullmatch("[0-9]+", x) for x in labels)
    domain = "" if address or len(labels) < n else ".".join(labels[-n:])
    return ([f"d:{domain}"] if domain else []) + ([f"h:{host}"] if host else []) + ([f"s:{host}/{m[2]}"] if host and m[2] else [])


def plain(url, fetched, entries):
    """Of the most specific key with an active entry, what its last entry by then says."""
    for key in reversed(keys(url)):
        past = [(d, a) for k, a, d in entries if k == key and d is not None and fetched is not None and d <= fetched]
        if past and max(past)[1] != "clear":
            d, a = max(past)
            return a, key, str(d)
    return "unlisted", None, None


D = date
ENTRIES = [
    ("d:a.com", "block", D(2020, 1, 1)), ("d:a.com", "clear", D(2021, 1, 1)), ("d:a.com", "block", D(2022, 1, 1)),
    ("h:x.a.com", "allow", D(2020, 6, 1)), ("h:x.a.com", "clear", D(2020, 9, 1)), ("s:x.a.com/bad", "block", D(2020, 7, 1)),
    ("d:b.org", "allow", D(2020, 1, 1)), ("d:b.org", "block", D(2020, 1, 1)), ("d:b.org", "block", D(2020, 1, 1)),
    (None, "block", D(2020, 1, 1)), ("d:c.net", "block", None), ("d:co.uk", "block", D(2020, 1, 1)), ("d:a.co.uk", "allow", D(2020, 1, 1)),
    ("d:0.1", "block", D(2020, 1, 1)), ("h:192.168.0.1", "block", D(2021, 1, 1)), ("h:user", "block", D(2020, 1, 1)),
]
URLS = [
    "http://a.com/", "https://X.A.com/bad/page?q=1", "http://x.a.com:8080/good", "http://x.a.com/bad", "http://b.org", "http://c.net/x",
    "http://localhost/bad", "ftp://d.e.f/g", "not a url", "", None, "http://a.com/" + "y" * 50000,
    "http://user:pw@www.a.co.uk/x", "http://b.co.uk", "http://co.uk/", "http://192.168.0.1:8080/x", "https://[::1]:443/bad", "http://u@v@a.com.:80#f", "http:///x", "http://@/x", "s+3.-x://A.com/bad",
]
DAYS = [D(2019, 12, 31), D(2020, 1, 1), D(2020, 7, 15), D(2020, 12, 31), D(2021, 1, 1), D(2023, 3, 3), None]


def frames(spark, rows, entries):
    captures = spark.createDataFrame(rows, "capture_id long, url string, fetched date").withColumn("key", F.lit("x")).withColumn("action", F.lit("y")).withColumn("rank", F.lit(9))
    return captures, spark.createDataFrame(entries, "key string, action string, effective date").withColumn("capture_id", F.lit(1)).withColumn("valid_to", F.lit("z"))


def test_against_plain_version(spark):
    rows = [(i * len(DAYS) + j, u, d) for i, u in enumerate(URLS) for j, d in enumerate(DAYS)]
    for entries, share, least in ((ENTRIES, 10_000, 50_000), (ENTRIES, 10_000, 2), (ENTRIES, 10_000, 5), ([], 10_000, 2)):
        got = {r["capture_id"]: tuple(r)[1:] for r in urlfilter.judge_captures(*frames(spark, rows, entries), share, least).collect()}
        assert got == {i: plain(u, d, entries) for i, u, d in rows}
    assert urlfilter.judge_captures(*frames(spark, [], ENTRIES)).count() == 0


def test_hosts():
    assert keys("http://user:pw@www.a.co.uk/x") == ["d:a.co.uk", "h:www.a.co.uk", "s:www.a.co.uk/x"]
    assert keys("http://192.168.0.1/") == ["h:192.168.0.1"] and keys("http://co.uk") == ["h:co.uk"]


def test_repeated_captures_and_null_ids(spark):
    rows = [(1, "http://a.com/", D(2020, 2, 2)), (1, "http://a.com/", D(2020, 2, 2)), (None, "http://a.com/", D(2022, 2, 2)), (None, None, None)]
    got = {r["capture_id"]: r["verdict"] for r in urlfilter.judge_captures(*frames(spark, rows, ENTRIES)).collect()}
    assert got == {1: "block", None: "block"}


def test_query_against_sql(spark, sf):
    db = duckdb.connect()
    db.execute(f"create view pages as select * from '{sf}/pages.parquet'")
    got = queries.op10_temporal_url_filter(spark, sf)
    want = db.execute(f"select {', '.join(got.columns)} from ({urlfilter.ORACLE})").fetchall()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    odd = [(i, u) for i, u in enumerate(URLS)]
    mine = spark.createDataFrame(odd, "capture_id long, url string").select("capture_id", F.transform(urlfilter.keys_of(F.col("url")), lambda k: k["key"]).alias("k"))
    assert {r[0]: r[1] or [] for r in mine.collect()} == {i: keys(u) for i, u in odd}
