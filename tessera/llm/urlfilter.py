"""Temporal list join: dated list entries become validity intervals; an as-of join judges each capture.

An entry (key, action, effective) holds from its date until the next entry of the same key. Keys are a registrable domain, a
host or a host with its first path segment; the most specific active entry decides. 'clear' ends a key's listing. The as-of
join puts a key's intervals and captures in one order of time and carries the last interval on; captures of a key with more
than a ten-thousandth of all (at most 10,000 such keys, told to all tasks by hash) are dealt into parts, each with the key's intervals.
Hosts are what stands between user information and port; addresses have no domain, and neither has a public suffix itself.
Contract of `judge_captures`: one row per distinct capture_id, null too (repeated rows are one; of rows that differ the most
specific hit); a null url has no keys and is 'unlisted'; a null fetch time meets no interval; ties in a key's dates: the
later action by name wins; very long urls are read whole; an empty list or an empty table is fine; other columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACTIONS = ("block", "clear", "allow", "block")
DAYS = 1460
HOT_SHARE, HOT_LEAST = 10_000, 500
# Public suffixes of two labels, below which names are registered.
SUFFIXES = (
    "ac.at", "co.at", "or.at", "com.ar", "org.ar", "com.au", "edu.au", "gov.au", "net.au", "org.au", "com.bd", "com.br", "gov.br", "net.br", "org.br", "co.bw", "com.cn", "edu.cn",
    "gov.cn", "net.cn", "org.cn", "com.co", "com.cy", "com.ec", "com.eg", "com.es", "org.es", "com.gh", "com.gr", "com.gt", "com.hk", "edu.hk", "org.hk", "co.hu", "ac.id", "co.id",
    "go.id", "or.id", "ac.il", "co.il", "org.il", "ac.in", "co.in", "gov.in", "net.in", "org.in", "ac.jp", "co.jp", "go.jp", "ne.jp", "or.jp", "co.ke", "or.ke", "ac.kr", "co.kr",
    "go.kr", "or.kr", "com.lk", "com.mt", "com.mx", "gob.mx", "org.mx", "com.my", "com.na", "com.ng", "com.np", "ac.nz", "co.nz", "govt.nz", "net.nz", "org.nz", "com.om", "com.pe",
    "com.ph", "com.pk", "com.pl", "net.pl", "org.pl", "com.pt", "com.py", "com.qa", "com.ru", "com.sa", "com.sg", "edu.sg", "com.sv", "ac.th", "co.th", "go.th", "com.tr", "org.tr",
    "com.tw", "edu.tw", "org.tw", "com.ua", "co.ug", "ac.uk", "co.uk", "gov.uk", "ltd.uk", "me.uk", "net.uk", "nhs.uk", "org.uk", "plc.uk", "sch.uk", "com.uy", "co.ve", "com.ve",
    "com.vn", "edu.vn", "ac.za", "co.za", "gov.za", "org.za", "co.zm", "co.zw",
)
# Patterns for both engines: the authority, what stands before and behind the host in it, an address, the last labels, the path.
AUTHORITY, USER, PORT, ADDRESS = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", r"(?s)^.*@", r"[.]*(:[0-9]*)?\z", r"^(\[.*|[0-9]+([.][0-9]+){3})\z"
TWO, THREE, SEGMENT = r"([^.]+[.][^.]+)\z", r"([^.]+[.][^.]+[.][^.]+)\z", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)"


def host_of(url: Column) -> Column:
    """Lower-cased, without user information, port and closing dots; empty if there is none."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.regexp_extract(url, AUTHORITY, 1), USER, ""), PORT, ""))


def domain_of(host: Column) -> Column:
    """The registrable domain: two labels, three below a public suffix; empty for addresses, suffixes and single labels."""
    last = F.regexp_extract(host, TWO, 1)
    return F.when(host.rlike(ADDRESS), "").when(last.isin(*SUFFIXES), F.regexp_extract(host, THREE, 1)).otherwise(last)


def keys_of(url: Column) -> Column:
    """Structs of rank and key: 1 domain, 2 host, 3 host and first path segment."""
    host = host_of(url)
    segment = F.regexp_extract(url, SEGMENT, 1)
    domain = domain_of(host)
    found = lambda rank, key, there: F.when(there, F.struct(F.lit(rank).alias("rank"), key.alias("key")))
    return F.array_compact(
        F.array(
            found(1, F.concat(F.lit("d:"), domain), domain != ""),
            found(2, F.concat(F.lit("h:"), host), host != ""),
            found(3, F.concat(F.lit("s:"), host, F.lit("/"), segment), (host != "") & (segment != "")),
        )
    )


def intervals(entries: DataFrame) -> DataFrame:
    """key, action, valid_from, valid_to (null: open) of dated entries."""
    one = entries.select("key", "action", F.col("effective").cast("timestamp").alias("valid_from")).where("key is not null and valid_from is not null").groupBy("key", "valid_from").agg(F.max("action").alias("action"))
    return one.withColumn("valid_to", F.lead("valid_from").over(Window.partitionBy("key").orderBy("valid_from"))).where("action <> 'clear'")


def as_of(captures: DataFrame, listed: DataFrame, share: int = HOT_SHARE, least: int = HOT_LEAST) -> DataFrame:
    """Rows (capture_id, fetched, rank, key) with hit, the interval of their key that holds at fetch time, or null."""
    name = F.xxhash64("key").alias("name")  # a key may be long, its name isn't
    counts = captures.groupBy(name).agg(F.count("*").alias("n"))
    most = max(least, captures.count() // share)
    hot = [(r["name"], -(-r["n"] // most)) for r in counts.where(F.col("n") > most).collect()]  # at most `share`
    parts = F.broadcast(captures.sparkSession.createDataFrame(hot, "name long, parts long"))
    many = F.coalesce("parts", F.lit(1))
    c = captures.withColumn("name", name).join(parts, "name", "left").withColumn("part", F.pmod(F.xxhash64("capture_id"), many))
    e = listed.withColumn("name", name).join(parts, "name", "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), many - 1)))
    interval = F.struct("action", "valid_from", "valid_to")
    none = F.lit(None)
    both = c.select("key", "part", F.col("fetched").alias("at"), F.lit(1).alias("kind"), "capture_id", "rank", none.cast("struct<action:string,valid_from:timestamp,valid_to:timestamp>").alias("interval"))
    id_type, rank_type = (t for n, t in both.dtypes if n in ("capture_id", "rank"))
    both = both.unionByName(e.select("key", "part", F.col("valid_from").alias("at"), F.lit(0).alias("kind"), none.cast(id_type).alias("capture_id"), none.cast(rank_type).alias("rank"), interval.alias("interval")))
    order = Window.partitionBy("key", "part").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    carried = both.withColumn("last", F.last("interval", ignorenulls=True).over(order)).where("kind = 1")
    return carried.withColumn("hit", F.when(F.col("last.valid_to").isNull() | (F.col("at") < F.col("last.valid_to")), F.col("last")))


def judge_captures(captures: DataFrame, entries: DataFrame, share: int = HOT_SHARE, least: int = HOT_LEAST) -> DataFrame:
    """capture_id, verdict (unlisted, allow or block), matched_key, listed_on (date of the deciding entry)."""
    c = captures.select("capture_id", F.col("fetched").cast("timestamp").alias("fetched"), F.explode_outer(keys_of(F.col("url"))).alias("k"))
    c = c.select("capture_id", "fetched", "k.rank", "k.key")
    met = as_of(c.where("key is not null and fetched is not null"), intervals(entries), share, least)
    hits = met.select("capture_id", F.when(F.col("hit").isNotNull(), F.struct("rank", "hit.action", "key", "hit.valid_from")).alias("hit"))
    others = c.where("key is null or fetched is null").select("capture_id", F.lit(None).cast(dict(hits.dtypes)["hit"]).alias("hit"))
    best = hits.unionByName(others).groupBy("capture_id").agg(F.max("hit").alias("hit"))
    return best.select("capture_id", F.coalesce("hit.action", F.lit("unlisted")).alias("verdict"), F.col("hit.key").alias("matched_key"), F.date_format("hit.valid_from", "yyyy-MM-dd").alias("listed_on"))


def _number(c: Column) -> Column:
    return F.conv(F.substring(F.md5(c.cast("binary")), 1, 7), 16, 10).cast("long")


def dated_entries(pages: DataFrame) -> DataFrame:
    """The history of a filter list over the pages' own keys, by a fixed rule: four dated entries for every key."""
    keys = pages.select(F.explode(keys_of(F.col("url"))).alias("k")).select("k.key").distinct()
    places = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(a).alias("action")) for i, a in enumerate(ACTIONS)))
    n = keys.select("key", F.explode(places).alias("p")).select("key", "p.i", "p.action")
    day = _number(F.concat_ws("|", "key", F.col("i").cast("string"))) % DAYS
    return n.select("key", "action", F.date_add(F.lit("2020-01-01").cast("date"), day.cast("int")).alias("effective"))


def captures_of(pages: DataFrame) -> DataFrame:
    """Pages as captures; the table has no fetch time, so a fixed rule gives each page one."""
    day = _number(F.concat_ws("|", F.lit("fetch"), F.col("page_id").cast("string"))) % DAYS
    return pages.select(F.col("page_id").alias("capture_id"), "url", F.date_add(F.lit("2020-01-01").cast("date"), day.cast("int")).alias("fetched"))


ORACLE = f"""
WITH a AS (
  SELECT page_id, url, lower(regexp_replace(regexp_replace(regexp_extract(url, '{AUTHORITY}', 1), '{USER}', ''), '{PORT}', '')) AS host,
         regexp_extract(url, '{SEGMENT}', 1) AS segment,
         DATE '2020-01-01' + CAST(('0x' || substr(md5('fetch|' || page_id), 1, 7))::BIGINT % 1460 AS INTEGER) AS fetched
  FROM pages),
p AS (SELECT *, CASE WHEN regexp_matches(host, '{ADDRESS}') THEN '' WHEN regexp_extract(host, '{TWO}', 1) IN {SUFFIXES} THEN regexp_extract(host, '{THREE}', 1)
  ELSE regexp_extract(host, '{TWO}', 1) END AS domain FROM a),
k AS (
  SELECT page_id, fetched, 1 AS rank, 'd:' || domain AS key FROM p WHERE domain <> ''
  UNION ALL SELECT page_id, fetched, 2, 'h:' || host FROM p WHERE host <> ''
  UNION ALL SELECT page_id, fetched, 3, 's:' || host || '/' || segment FROM p WHERE host <> '' AND segment <> ''),
e AS (
  SELECT key, action, DATE '2020-01-01' + CAST(('0x' || substr(md5(key || '|' || i), 1, 7))::BIGINT % 1460 AS INTEGER) AS f
  FROM (SELECT DISTINCT key FROM k), (VALUES (0, 'block'), (1, 'clear'), (2, 'allow'), (3, 'block')) AS a(i, action)),
o AS (SELECT key, f, max(action) AS action FROM e GROUP BY key, f),
v AS (SELECT key, action, f, lead(f) OVER (PARTITION BY key ORDER BY f) AS t FROM o),
hit AS (
  SELECT k.page_id, v.action, k.key, v.f, row_number() OVER (PARTITION BY k.page_id ORDER BY k.rank DESC) AS n
  FROM k JOIN v ON v.key = k.key AND v.action <> 'clear' AND v.f <= k.fetched AND (v.t IS NULL OR k.fetched < v.t))
SELECT p.page_id, coalesce(h.action, 'unlisted') AS verdict, h.key AS matched_key, strftime(h.f, '%Y-%m-%d') AS listed_on
FROM p LEFT JOIN hit h ON h.page_id = p.page_id AND h.n = 1
"""
