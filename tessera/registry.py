"""Registered queries of the entity-resolution engine over the test tables, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import DEFAULT
from tessera.functions import kernels, similarity
from tessera.functions.normalize import clean_text, plain, sort_key
from tessera.operators import blocking, matching, pairs, scoring, training
from tessera.plans import programs
from tessera.sources import adapters, files
from tessera.storage import shared_dir, table, written

FLAGSHIP = "submission"
Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[name or f.__name__] = f
        if sql is not None:
            _sql[name or f.__name__] = sql
        return f

    return add


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _sides(spark: SparkSession, sf_dir: str, s: int) -> tuple[DataFrame, DataFrame]:
    d = _docs(spark, sf_dir)
    return adapters.source(d, 0), adapters.source(d, s)


def _labelled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    d = _docs(spark, sf_dir)
    return training.exploded_truth(adapters.truth(d)), adapters.originals(d), adapters.changed(d)


# The same steps in SQL, to be put together as common table expressions.
PLAIN = "trim(lower(regexp_replace(coalesce({}, ''), '[^a-zA-Z0-9 ]', '', 'g')))"
KEYS = {
    "name": PLAIN.format("business_name"),
    "token_sorted": f"array_to_string(list_sort(string_split({PLAIN.format('business_name')}, ' ')), ' ')",
    "address": PLAIN.format("business_address"),
}
SRC = """src AS (SELECT 'S' || (1 + doc_id % 3) || '-' || doc_id AS entity_id, substr(text, 1, 32) AS business_name,
  substr(text, 33, 48) AS business_address, lang AS country, doc_id % 3 AS s FROM documents)"""


def ranked_sql(kind: str, s: int, window: int) -> str:
    return f"""ranked_{kind}_{s} AS (SELECT entity_id, country, s, r, r // {window} AS bucket FROM (
  SELECT entity_id, country, s, row_number() OVER (PARTITION BY country ORDER BY {KEYS[kind]}, entity_id) - 1 AS r
  FROM src WHERE s IN (0, {s})))"""


def pass_sql(kind: str, s: int) -> str:
    return f"""{ranked_sql(kind, s, DEFAULT.windows[kind])}, pass_{kind}_{s} AS (SELECT s1_id, target_id FROM (
  SELECT a.entity_id AS s1_id, b.entity_id AS target_id, row_number() OVER (PARTITION BY a.entity_id ORDER BY abs(a.r - b.r), b.entity_id) AS k
  FROM ranked_{kind}_{s} a JOIN ranked_{kind}_{s} b ON a.country = b.country AND abs(a.bucket - b.bucket) <= 1 AND a.s = 0 AND b.s = {s})
  WHERE k <= {DEFAULT.cap_per_pass})"""


def candidates_sql(s: int) -> str:
    return ", ".join(pass_sql(k, s) for k in KEYS) + f", cand_{s} AS (" + " UNION ".join(f"SELECT s1_id, target_id FROM pass_{k}_{s}" for k in KEYS) + ")"


HYDRATED = """SELECT c.s1_id, c.target_id, a.business_name AS s1_name, a.business_address AS s1_addr, a.country AS s1_country,
  b.business_name AS s2_name, b.business_address AS s2_addr, b.country AS s2_country
  FROM cand_{s} c JOIN src a ON a.entity_id = c.s1_id JOIN src b ON b.entity_id = c.target_id"""


def _prep(c: str) -> str:
    return f"regexp_replace(lower(coalesce({c}, '')), '^\\s+|\\s+$', '', 'g')"


def _tok(c: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array({c}, '\\s+'), lambda x: x <> ''))"


def _jac(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    return f"CASE WHEN len({a}) + len({b}) > 0 THEN {both}::DOUBLE / (len({a}) + len({b}) - {both}) ELSE 0.0 END"


def _flag(c: str) -> str:
    return f"CASE WHEN {c} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"


POSTAL = r"\b\d{5}(?:-\d{4})?\b|\b[a-z]\d[a-z]\s?\d[a-z]\d\b"


def _found(pattern: str) -> str:
    return _flag(f"regexp_extract(a1, '{pattern}') <> '' AND regexp_extract(a1, '{pattern}') = regexp_extract(a2, '{pattern}')")


def features_sql(s: int) -> str:
    grams = "CASE WHEN length({0}) >= 3 THEN list_distinct(list_transform(range(1, length({0}) - 1), lambda i: substr({0}, i, 3))) ELSE [] END"
    return f"""prep_{s} AS (SELECT s1_id, target_id, {_prep('s1_name')} AS n1, {_prep('s2_name')} AS n2, {_prep('s1_addr')} AS a1, {_prep('s2_addr')} AS a2,
    {_prep('s1_country')} AS c1, {_prep('s2_country')} AS c2 FROM ({HYDRATED.format(s=s)})),
  toks_{s} AS (SELECT *, {_tok('n1')} AS tn1, {_tok('n2')} AS tn2, {_tok('a1')} AS ta1, {_tok('a2')} AS ta2, {grams.format('n1')} AS g1, {grams.format('n2')} AS g2 FROM prep_{s}),
  exact_{s} AS (SELECT s1_id, target_id, {_flag("n1 <> '' AND n1 = n2")} AS f1_n_exact, {_jac('tn1', 'tn2')} AS f4_n_jaccard,
    (CASE WHEN least(len(tn1), len(tn2)) > 0 THEN len(list_intersect(tn1, tn2))::DOUBLE / least(len(tn1), len(tn2)) ELSE 0.0 END) AS f5_n_overlap,
    (CASE WHEN len(g1) > 0 AND len(g2) > 0 THEN {_jac('g1', 'g2')} ELSE 0.0 END) AS f6_n_ngram, abs(length(n1) - length(n2))::DOUBLE AS f7_n_len_diff,
    {_flag('length(n1) >= 4 AND length(n2) >= 4 AND substr(n1, 1, 4) = substr(n2, 1, 4)')} AS f8_n_prefix, {_flag("a1 <> '' AND a1 = a2")} AS f9_a_exact,
    {_jac('ta1', 'ta2')} AS f10_a_jaccard, {_found(chr(92) + 'b' + chr(92) + 'd+' + chr(92) + 'b')} AS f12_a_house, {_found(POSTAL)} AS f13_a_postal, {_jac('ta1', 'ta2')} AS f14_a_city_overlap,
    abs(length(a1) - length(a2))::DOUBLE AS f15_a_len_diff, {_flag("c1 <> '' AND c1 = c2")} AS f16_country_match, {_flag("'s%d' = 's3'" % (s + 1))} AS f17_is_s3,
    {_flag("n1 = '' OR n2 = ''")} AS f18_n_missing, {_flag("a1 = '' OR a2 = ''")} AS f19_a_missing FROM toks_{s}),
  feat_{s} AS (SELECT s1_id, target_id, {', '.join(f"round({f}, 6) AS {f}" for f in similarity.NATIVE)} FROM exact_{s})"""


def ratio_sql(name: str, strings: str) -> str:
    """Table name(a, b, ratio): twice the longest common subsequence over both lengths, of the pairs (a, b) that `strings` selects; bit-parallel."""
    full = "((1::HUGEINT << length(s.a)::INTEGER) - 1)"
    return f"""{name}_pairs AS (SELECT DISTINCT a, b FROM ({strings})),
  {name}_masks AS (SELECT a, map_from_entries(list((ch, m))) AS masks FROM (SELECT a, ch, sum(1::HUGEINT << i)::HUGEINT AS m FROM (SELECT a, unnest(string_split(a, '')) AS ch,
    (generate_subscripts(string_split(a, ''), 1) - 1)::INTEGER AS i FROM (SELECT DISTINCT a FROM {name}_pairs WHERE a <> '')) GROUP BY a, ch) GROUP BY a),
  {name}_rows AS (SELECT s.a, s.b, {full} AS whole, list_transform(string_split(s.b, ''), lambda ch: coalesce(k.masks[ch], 0::HUGEINT)) AS row FROM {name}_pairs s JOIN {name}_masks k USING (a) WHERE s.b <> ''),
  {name} AS (SELECT a, b, 2.0::DOUBLE * (length(a) - bit_count({_subsequence('row', 'whole')})) / (length(a) + length(b)) AS ratio FROM {name}_rows
    UNION ALL SELECT a, b, CASE WHEN a = b THEN 1.0 ELSE 0.0 END FROM {name}_pairs WHERE a = '' OR b = '')"""


def _subsequence(masks: str, whole: str) -> str:
    return f"list_reduce({masks}, lambda v, m: ((v + (v & m)) | (v - (v & m))) & {whole}, {whole})"


# Of lower-cased strings each letter outside ASCII is put as one byte, as DuckDB's measure goes by bytes.
BYTEWISE = "translate({}, 'äöüßáéíóúàèìòùâêîôûëïçñœæ¿¡’', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ{{}}')"
DIGITS = "array_to_string(regexp_extract_all({}, '[0-9]+'), '')"


def token_set_sql(name: str, strings: str) -> str:
    """Table name(x, y, token_set) of the pairs (x, y) that `strings` selects."""
    tokens = "list_distinct(list_filter(regexp_split_to_array({}, '\\s+'), lambda t: t <> ''))"
    joined = "array_to_string(list_sort({}), ' ')"
    return f"""{name}_lists AS (SELECT x, y, {tokens.format('x')} AS tx, {tokens.format('y')} AS ty FROM (SELECT DISTINCT x, y FROM ({strings}))),
  {name}_parts AS (SELECT x, y, tx, ty, {joined.format('list_intersect(tx, ty)')} AS shared, {joined.format('list_filter(tx, lambda t: NOT list_contains(ty, t))')} AS l, {joined.format('list_filter(ty, lambda t: NOT list_contains(tx, t))')} AS r FROM {name}_lists),
  {name}_whole AS (SELECT *, trim(shared || ' ' || l) AS one, trim(shared || ' ' || r) AS other FROM {name}_parts),
  {ratio_sql(f'{name}_ratio', f"SELECT one AS a, other AS b FROM {name}_whole UNION SELECT shared, one FROM {name}_whole WHERE shared <> '' UNION SELECT shared, other FROM {name}_whole WHERE shared <> ''")},
  {name} AS (SELECT x, y, CASE WHEN len(tx) = 0 OR len(ty) = 0 THEN 0.0 WHEN shared <> '' AND (l = '' OR r = '') THEN 1.0 WHEN shared = '' THEN p.ratio ELSE greatest(p.ratio, q.ratio, o.ratio) END AS token_set
    FROM {name}_whole w JOIN {name}_ratio p ON p.a = w.one AND p.b = w.other LEFT JOIN {name}_ratio q ON q.a = w.shared AND q.b = w.one LEFT JOIN {name}_ratio o ON o.a = w.shared AND o.b = w.other)"""


def kernels_sql(s: int) -> str:
    """Table kern_{s}: the five measures of all candidate pairs."""
    p = f"prep_{s}"
    d1, d2 = DIGITS.format("n1 || a1"), DIGITS.format("n2 || a2")
    return f"""{ratio_sql('rn', f'SELECT n1 AS a, n2 AS b FROM {p}')}, {ratio_sql('ra', f'SELECT a1 AS a, a2 AS b FROM {p}')}, {ratio_sql('rd', f'SELECT {d1} AS a, {d2} AS b FROM {p}')},
  {token_set_sql('ts', f"SELECT n1 || ' ' || a1 AS x, n2 || ' ' || a2 AS y FROM {p}")},
  kern_{s} AS (SELECT s1_id, target_id, round(CASE WHEN n1 = n2 THEN 1.0 ELSE jaro_winkler_similarity({BYTEWISE.format('n1')}, {BYTEWISE.format('n2')}) END, 12) AS f2_n_jw, round(rn.ratio, 12) AS f3_n_lev, round(ra.ratio, 12) AS f11_a_lev, round(rd.ratio, 12) AS f20_digit_ratio, round(token_set, 12) AS f21_comb_token_set
    FROM {p} JOIN rn ON rn.a = n1 AND rn.b = n2 JOIN ra ON ra.a = a1 AND ra.b = a2 JOIN rd ON rd.a = {d1} AND rd.b = {d2} JOIN ts ON ts.x = n1 || ' ' || a1 AND ts.y = n2 || ' ' || a2)"""


def legacy_sql(s: int) -> str:
    """Table legacy_{s}: the older ten features."""
    def tokens(c: str) -> str:
        return f"array_to_string(list_sort(list_filter(regexp_split_to_array({c}, '\\s+'), lambda t: t <> '')), ' ')"

    numbers = "regexp_extract_all({}, '[0-9]+')"
    raw = f"""raw_{s} AS (SELECT *, {tokens('n1')} AS t1, {tokens('n2')} AS t2, CASE WHEN length(n1) <= length(n2) THEN n1 ELSE n2 END AS short, CASE WHEN length(n1) <= length(n2) THEN n2 ELSE n1 END AS long FROM (
    SELECT s1_id, target_id, coalesce(s1_name, '') AS n1, coalesce(s2_name, '') AS n2, coalesce(s1_addr, '') AS a1, coalesce(s2_addr, '') AS a2 FROM ({HYDRATED.format(s=s)})))"""
    stretch = "list_slice(row, greatest(0, i) + 1, i + length(a))"
    best = f"list_max(list_transform(range(1 - length(a), length(b)), lambda i: 2.0::DOUBLE * (length(a) - bit_count({_subsequence(stretch, 'whole')})) / (length(a) + len({stretch}))))"
    return f"""{raw}, {ratio_sql('rn', f'SELECT n1 AS a, n2 AS b FROM raw_{s}')}, {ratio_sql('rt', f'SELECT t1 AS a, t2 AS b FROM raw_{s}')}, {ratio_sql('ra', f'SELECT a1 AS a, a2 AS b FROM raw_{s}')},
  {ratio_sql('rp', f'SELECT short AS a, long AS b FROM raw_{s}')}, parts AS (SELECT a, b, {best} AS best FROM rp_rows UNION ALL SELECT a, b, CASE WHEN b = '' THEN 1.0 ELSE 0.0 END FROM rp_pairs WHERE a = '' OR b = ''),
  {token_set_sql('tn', f'SELECT n1 AS x, n2 AS y FROM raw_{s}')}, {token_set_sql('ta', f'SELECT a1 AS x, a2 AS y FROM raw_{s}')},
  legacy_{s} AS (SELECT s1_id, target_id, round(100 * rn.ratio, 6) AS name_ratio, round(100 * parts.best, 6) AS name_partial, round(100 * rt.ratio, 6) AS name_token_sort, round(100 * tn.token_set, 6) AS name_token_set,
    round(100 * ra.ratio, 6) AS addr_ratio, round(100 * ta.token_set, 6) AS addr_token_set, {_flag(f"list_has_any({numbers.format('a1')}, {numbers.format('a2')})")} AS num_match,
    abs(length(n1) - length(n2))::DOUBLE AS len_diff_name, abs(length(a1) - length(a2))::DOUBLE AS len_diff_addr, {_flag("a1 = '' OR a2 = ''")} AS missing_addr
    FROM raw_{s} JOIN rn ON rn.a = n1 AND rn.b = n2 JOIN rt ON rt.a = t1 AND rt.b = t2 JOIN ra ON ra.a = a1 AND ra.b = a2 JOIN parts ON parts.a = short AND parts.b = long JOIN tn ON tn.x = n1 AND tn.y = n2 JOIN ta ON ta.x = a1 AND ta.y = a2)"""


def scored_sql(s: int) -> str:
    return f"""scored_{s} AS (SELECT s1_id, target_id, prob FROM (SELECT s1_id, target_id, round(1 / (1 + exp(-(
      CASE WHEN f1_n_exact > 0.5 THEN 2.0 WHEN f4_n_jaccard > 0.5 THEN 1.0 ELSE -1.5 END
      + CASE WHEN f10_a_jaccard > 0.6 THEN 1.5 WHEN f6_n_ngram > 0.4 THEN 0.5 ELSE -0.8 END
      + CASE WHEN f8_n_prefix > 0.5 THEN 0.6 ELSE -0.4 END - CASE WHEN f7_n_len_diff > 8 THEN 0.5 ELSE 0.0 END
      + 0.5 * f5_n_overlap - 0.25)::DOUBLE)), 6) AS prob FROM feat_{s}) WHERE prob >= 0.5)"""


def capped_sql(s: int) -> str:
    most = DEFAULT.caps[f"s{s + 1}"]
    return f"""capped_{s} AS (SELECT s1_id, target_id, prob FROM scored_{s} QUALIFY row_number() OVER (PARTITION BY s1_id ORDER BY prob DESC, target_id) <= {most})"""


def chain(*parts: str) -> str:
    return "WITH " + ", ".join((SRC, *parts)) + " "


def upto(s: int, *makers: Callable[[int], str]) -> list[str]:
    return [m(s) for m in makers]


SCORED = (candidates_sql, features_sql, scored_sql)
BOTH = (*upto(1, *SCORED, capped_sql), *upto(2, *SCORED, capped_sql))
GLOBAL = """matches AS (SELECT s1_id, target_id, prob FROM (SELECT * FROM capped_1 UNION ALL SELECT * FROM capped_2)
  QUALIFY row_number() OVER (PARTITION BY s1_id ORDER BY prob DESC, target_id) <= 6)"""
LISTS = """lists AS (SELECT s1_id AS source1_entity_id, string_agg(target_id, ',' ORDER BY prob DESC, target_id) AS matched_entity_ids FROM matches GROUP BY s1_id)"""
SUBMISSION = """submission AS (SELECT entity_id AS source1_entity_id, coalesce(matched_entity_ids, '') AS matched_entity_ids
  FROM src LEFT JOIN lists ON source1_entity_id = entity_id WHERE s = 0)"""


def _register_keys_and_passes() -> None:
    for kind, expression in KEYS.items():

        @query(f"{chain()}SELECT entity_id, {expression} AS sort_key FROM src", f"key_{kind}")
        def key(spark: SparkSession, sf_dir: str, kind: str = kind) -> DataFrame:
            return adapters.sources(_docs(spark, sf_dir)).select("entity_id", sort_key(kind, F.col("business_name"), F.col("business_address")).alias("sort_key"))

        @query(f"{chain(ranked_sql(kind, 1, DEFAULT.windows[kind]))}SELECT entity_id, country, r AS rank, bucket FROM ranked_{kind}_1", f"snm_bucket_{kind}")
        def bucket(spark: SparkSession, sf_dir: str, kind: str = kind) -> DataFrame:
            return blocking.buckets(*_sides(spark, sf_dir, 1), kind, DEFAULT.windows[kind]).select("entity_id", "country", "rank", "bucket")

        @query(f"{chain(pass_sql(kind, 1))}SELECT s1_id, target_id FROM pass_{kind}_1", f"snm_pass_{kind}")
        def one_pass(spark: SparkSession, sf_dir: str, kind: str = kind) -> DataFrame:
            return blocking.neighbourhood_pass(*_sides(spark, sf_dir, 1), kind, DEFAULT.windows[kind])

    for s in (1, 2):

        @query(f"{chain(candidates_sql(s))}SELECT * FROM cand_{s}", f"snm_candidates_s{s + 1}")
        def found(spark: SparkSession, sf_dir: str, s: int = s) -> DataFrame:
            return blocking.candidates(*_sides(spark, sf_dir, s))

        @query(f"{chain(*upto(s, *SCORED, capped_sql))}SELECT * FROM capped_{s}", f"match_cap_s{s + 1}")
        def cap(spark: SparkSession, sf_dir: str, s: int = s) -> DataFrame:
            return matching.capped(_results(spark, sf_dir, s), DEFAULT.caps[f"s{s + 1}"])


def _hydrated(spark: SparkSession, sf_dir: str, s: int) -> DataFrame:
    base, target = _sides(spark, sf_dir, s)
    return pairs.hydrate(written(blocking.candidates(base, target), "candidates"), base, target)


def _described(spark: SparkSession, sf_dir: str, s: int) -> DataFrame:
    base, target = _sides(spark, sf_dir, s)
    return pairs.hydrate_described(written(blocking.candidates(base, target), "candidates"), base, target)


def _features(spark: SparkSession, sf_dir: str, s: int) -> DataFrame:
    f = pairs.native_features(_described(spark, sf_dir, s), f"s{s + 1}")
    return f.select("s1_id", "target_id", *(F.round(c, 6).alias(c) for c in similarity.NATIVE))


def _results(spark: SparkSession, sf_dir: str, s: int) -> DataFrame:
    return scoring.score(_features(spark, sf_dir, s))


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.combined({f"s{s + 1}": _results(spark, sf_dir, s) for s in (1, 2)}, DEFAULT.caps, DEFAULT.global_cap)


_register_keys_and_passes()


@query(f"{chain(candidates_sql(1))}{HYDRATED.format(s=1)}")
def candidate_hydrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hydrated(spark, sf_dir, 1)


@query(f"{chain(candidates_sql(1), candidates_sql(2))}SELECT s1_id AS source1_entity_id, target_id AS candidate_entity_id FROM (SELECT * FROM cand_1 UNION SELECT * FROM cand_2)")
def candidate_pairs_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.candidate_export(*(blocking.candidates(*_sides(spark, sf_dir, s)) for s in (1, 2)))


@query(f"{chain(*upto(1, candidates_sql, features_sql))}SELECT * FROM feat_1")
def features_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _features(spark, sf_dir, 1)


def _rounded(features: DataFrame, *names: str) -> DataFrame:
    return features.select("s1_id", "target_id", *(F.round(F.col(f).cast("double"), 6).alias(f) for f in names))


def _rounded_sql(*names: str) -> str:
    return ", ".join(f"round({f}::FLOAT::DOUBLE, 6) AS {f}" for f in names)


KERNELS_SQL = (candidates_sql, features_sql, kernels_sql)


@query(f"{chain(*upto(1, *KERNELS_SQL))}SELECT s1_id, target_id, {_rounded_sql(*pairs.FEATURES)} FROM exact_1 JOIN kern_1 USING (s1_id, target_id)")
def features_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(pairs.features(_described(spark, sf_dir, 1), "s2"), *pairs.FEATURES)


@query(f"{chain(*upto(1, *KERNELS_SQL))}SELECT s1_id, target_id, {_rounded_sql('f3_n_lev', 'f11_a_lev', 'f20_digit_ratio')} FROM kern_1")
def features_lcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(pairs.features(_described(spark, sf_dir, 1), "s2"), "f3_n_lev", "f11_a_lev", "f20_digit_ratio")


@query(f"{chain(*upto(1, *KERNELS_SQL))}SELECT s1_id, target_id, {_rounded_sql('f21_comb_token_set')} FROM kern_1")
def feature_token_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(pairs.features(_described(spark, sf_dir, 1), "s2"), "f21_comb_token_set")


@query(f"{chain(*upto(1, candidates_sql, legacy_sql))}SELECT * FROM legacy_1")
def features_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = pairs.legacy(_hydrated(spark, sf_dir, 1))
    return f.select("s1_id", "target_id", *(F.round(c, 6).alias(c) for c in f.columns[2:]))


@query(
    f"""{chain(candidates_sql(1))}SELECT s1_id, target_id, round(CASE WHEN k1 = k2 THEN 1.0 ELSE jaro_winkler_similarity(k1, k2) END, 6) AS similarity
  FROM (SELECT s1_id, target_id, {PLAIN.format('s1_name')} AS k1, {PLAIN.format('s2_name')} AS k2 FROM ({HYDRATED.format(s=1)}))"""
)
def feature_jaro_winkler(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _hydrated(spark, sf_dir, 1).select("s1_id", "target_id", plain(F.col("s1_name")).alias("k1"), plain(F.col("s2_name")).alias("k2"))
    none = F.lit("")
    return h.select("s1_id", "target_id", F.round(kernels.kernel_features("k1", "k2", none, none, none, none)["f2_n_jw"], 6).alias("similarity"))


@query(f"{chain(*upto(1, *SCORED))}SELECT * FROM scored_1")
def score_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _results(spark, sf_dir, 1)


@query(f"{chain(*upto(1, *SCORED))}SELECT * FROM scored_1 QUALIFY row_number() OVER (PARTITION BY s1_id ORDER BY prob DESC, target_id DESC) <= 5")
def match_cap_larger_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.capped(_results(spark, sf_dir, 1), 5, larger_id_first=True)


@query(f"{chain(*BOTH, GLOBAL)}SELECT * FROM matches")
def match_global_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matches(spark, sf_dir)


@query(f"{chain(*BOTH, GLOBAL, LISTS)}SELECT * FROM lists")
def match_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.match_lists(_matches(spark, sf_dir))


@query(f"{chain(*BOTH, GLOBAL, LISTS, SUBMISSION)}SELECT * FROM submission")
def submission(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.submission(adapters.source(_docs(spark, sf_dir), 0), _matches(spark, sf_dir))


@query(f"{chain(*BOTH, GLOBAL, LISTS, SUBMISSION)}SELECT count(*) AS records, count(*) FILTER (matched_entity_ids <> '') AS matched FROM submission")
def match_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.summary(submission(spark, sf_dir))


TRUTH = """truth AS (SELECT 'S1-' || doc_id AS source1_entity_id, CASE WHEN doc_id % 5 < 4 THEN 'S2-' || doc_id END AS matched_entity_ids FROM documents),
gt AS (SELECT source1_entity_id AS s1_id, unnest(string_split(matched_entity_ids, ',')) AS target_id FROM truth),
base AS (SELECT 'S1-' || doc_id AS entity_id, substr(text, 1, 32) AS business_name, substr(text, 33, 48) AS business_address, lang AS country FROM documents),
changed AS (SELECT 'S2-' || doc_id AS entity_id, CASE doc_id % 5 WHEN 0 THEN translate(name, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') WHEN 1 THEN array_to_string(list_reverse(string_split(name, ' ')), ' ')
  WHEN 2 THEN array_to_string(list_slice(string_split(name, ' '), 1, greatest(1, len(string_split(name, ' ')) - 1)), ' ') ELSE name END AS business_name,
  CASE WHEN doc_id % 5 = 3 THEN '' ELSE substr(text, 33, 48) END AS business_address, lang AS country
  FROM (SELECT *, substr(text, 1, 32) AS name FROM documents) WHERE doc_id % 5 < 4),
sides AS (SELECT a.entity_id AS s1_id, b.entity_id AS target_id, a.business_name AS name1, b.business_name AS name2, a.business_address AS addr1, b.business_address AS addr2, a.country AS c1, b.country AS c2
  FROM base a JOIN changed b ON a.country = b.country AND substr(a.business_name, 1, 3) = substr(b.business_name, 1, 3)),
pos AS (SELECT g.s1_id, g.target_id, a.business_name AS name1, b.business_name AS name2, a.business_address AS addr1, b.business_address AS addr2, a.country AS c1, b.country AS c2, 1 AS label
  FROM gt g JOIN base a ON a.entity_id = g.s1_id JOIN changed b ON b.entity_id = g.target_id),
neg AS (SELECT *, 0 AS label FROM sides s WHERE NOT EXISTS (SELECT 1 FROM gt g WHERE g.s1_id = s.s1_id AND g.target_id = s.target_id))"""
DRAWN = "md5(s1_id || '|' || target_id || '|42')"


@query(f"WITH {TRUTH} SELECT * FROM gt")
def gt_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(spark, sf_dir)[0]


@query(f"WITH {TRUTH} SELECT * FROM gt WHERE target_id LIKE 'S2-1%'")
def gt_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.exploded_truth(adapters.truth(_docs(spark, sf_dir)), "S2-1")


@query(f"WITH {TRUTH} SELECT * FROM pos")
def pos_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.positives(*_labelled(spark, sf_dir))


@query(f"WITH {TRUTH} SELECT * FROM neg")
def neg_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.negatives(*_labelled(spark, sf_dir))


@query(f"WITH {TRUTH} SELECT s1_id, target_id FROM neg ORDER BY {DRAWN}, s1_id, target_id LIMIT 5000")
def sample_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = _labelled(spark, sf_dir)
    return training.sampled(training.negatives(*sides), 5000, among=training.near_count(*sides[1:])).select("s1_id", "target_id")


@query(f"WITH {TRUTH}, d AS (SELECT s1_id, target_id FROM sides ORDER BY {DRAWN}, s1_id, target_id LIMIT 5000) SELECT s1_id, target_id FROM d ANTI JOIN gt USING (s1_id, target_id)")
def sample_then_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.negatives(*_labelled(spark, sf_dir), sample_first=5000).select("s1_id", "target_id")


@query(
    f"""WITH {TRUTH} SELECT s1_id, target_id, label, row_number() OVER (PARTITION BY label ORDER BY {DRAWN}, s1_id, target_id)
  <= round(0.2 * count(*) OVER (PARTITION BY label)) AS held_out FROM (SELECT s1_id, target_id, label FROM pos UNION ALL SELECT s1_id, target_id, label FROM neg)"""
)
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = _labelled(spark, sf_dir)
    both = training.positives(*sides).unionByName(training.negatives(*sides)).select("s1_id", "target_id", "label")
    return training.split(both, among=training.near_count(*sides[1:]))


@query(
    f"""WITH {TRUTH}, c AS (SELECT label, CASE WHEN upper(name1) = upper(name2) THEN 1 ELSE 0 END AS predicted FROM (SELECT * FROM pos UNION ALL SELECT * FROM neg)),
m AS (SELECT sum(label * predicted)::BIGINT AS tp, sum((1 - label) * predicted)::BIGINT AS fp, sum(label * (1 - predicted))::BIGINT AS fn FROM c),
r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END AS q FROM m)
SELECT tp, fp, fn, round(p, 6) AS precision, round(q, 6) AS recall, round(CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0 END, 6) AS f1,
  round(CASE WHEN 0.25 * p + q > 0 THEN 1.25 * p * q / (0.25 * p + q) ELSE 0 END, 6) AS f05 FROM r"""
)
def classification_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.metrics(training.name_agreement(*_labelled(spark, sf_dir)))


CLEAN = "regexp_replace(lower(coalesce({}, '')), '[^a-z0-9\\s]', ' ', 'g')"


def grams_sql(name: str, table_: str) -> str:
    return f"""{name} AS (SELECT country, entity_id, gram, count(*) AS tf FROM (SELECT country, entity_id, unnest(list_transform(range(1, length(w) + 1), lambda i: substr(' ' || w || ' ', i, 3))) AS gram
  FROM (SELECT country, entity_id, unnest(list_filter(regexp_split_to_array({CLEAN.format('business_name')}, '\\s+'), lambda x: x <> '')) AS w FROM {table_} WHERE country <> '')) GROUP BY ALL)"""


def tfidf_sql(src: str, kept: str = "") -> str:
    """From the records in `src` to the best 15 targets of each; kept: which document frequencies count."""
    return f"""{grams_sql('ga', f"(SELECT * FROM {src} WHERE s = 0)")}, {grams_sql('gb', f"(SELECT * FROM {src} WHERE s = 1)")},
big_n AS (SELECT country, count(DISTINCT entity_id) AS n FROM {src} WHERE s = 0 AND country <> '' GROUP BY country),
idf AS (SELECT country, gram, count(*) AS df, ln((1 + any_value(n)) / (1 + count(*))) + 1 AS idf FROM ga JOIN big_n USING (country) GROUP BY country, gram {kept}),
wa AS (SELECT country, entity_id, gram, tf * idf / sqrt(sum((tf * idf) * (tf * idf)) OVER (PARTITION BY country, entity_id)) AS w FROM ga JOIN idf USING (country, gram)),
wb AS (SELECT country, entity_id, gram, tf * idf / sqrt(sum((tf * idf) * (tf * idf)) OVER (PARTITION BY country, entity_id)) AS w FROM gb JOIN idf USING (country, gram)),
sim AS (SELECT wa.entity_id AS s1_id, wb.entity_id AS target_id, round(sum(wa.w * wb.w), 6) AS score FROM wa JOIN wb USING (country, gram) GROUP BY ALL),
top AS (SELECT s1_id, target_id, score FROM sim WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY s1_id ORDER BY score DESC, target_id) <= 15)"""


TFIDF = tfidf_sql("src")
EVERYWHERE = """everywhere AS (SELECT * REPLACE ('*' AS country) FROM src)"""


@query(f"{chain(TFIDF)}SELECT country, gram, df, round(idf, 6) AS idf FROM idf")
def tfidf_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocking.idf(adapters.source(_docs(spark, sf_dir), 0)).withColumn("idf", F.round("idf", 6))


@query(f"{chain(TFIDF)}SELECT * FROM top")
def tfidf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocking.tfidf_candidates(*_sides(spark, sf_dir, 1))


@query(f"{chain(EVERYWHERE, tfidf_sql('everywhere', 'HAVING count(*) >= 2 AND count(*) <= 0.8 * any_value(n)'))}SELECT * FROM top")
def tfidf_everywhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, target = _sides(spark, sf_dir, 1)
    return blocking.tfidf_candidates(blocking.everywhere(base), blocking.everywhere(target), min_df=2, max_df=0.8)


@query(
    f"""{chain(TFIDF, candidates_sql(1))}, t AS (SELECT DISTINCT a.entity_id AS s1_id, b.entity_id AS target_id FROM src a JOIN src b ON a.s = 0 AND b.s = 1 AND a.business_name = b.business_name AND a.country = b.country)
SELECT * EXCLUDE (records), round(CASE WHEN truth > 0 THEN 100.0 * hits / truth ELSE 0 END, 6)::DOUBLE AS recall, round(candidates::DOUBLE / records, 6) AS per_record FROM (SELECT
  (SELECT count(*) FROM t JOIN cand_1 USING (s1_id, target_id)) AS hits, (SELECT count(*) FROM t) AS truth, (SELECT count(*) FROM cand_1) AS candidates, (SELECT count(*) FROM src WHERE s = 0) AS records)"""
)
def blocking_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, target = _sides(spark, sf_dir, 1)
    other = target.select(F.col("entity_id").alias("target_id"), "business_name", "country")
    same = base.select(F.col("entity_id").alias("s1_id"), "business_name", "country").join(other, ["business_name", "country"]).select("s1_id", "target_id")
    return blocking.recall(written(blocking.candidates(base, target), "candidates"), same, base)


@query(f"""SELECT doc_id, array_to_string(list_filter(regexp_split_to_array({CLEAN.format('text')}, '\\s+'),
  lambda x: length(x) > 1 AND x NOT IN ('inc', 'llc', 'ltd', 'corp', 'gmbh', 'co', 'the', 'st', 'rd', 'ave', 'blvd', 'court')), ' ') AS cleaned FROM documents""", "clean_text")
def clean_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", clean_text(F.col("text")).alias("cleaned"))


def _trained(spark: SparkSession, sf_dir: str) -> tuple[PipelineModel, DataFrame]:
    d = _docs(spark, sf_dir)
    return programs.train(adapters.truth(d), adapters.originals(d), adapters.changed(d))


@query()
def gbt_train_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trained(spark, sf_dir)[1]


def _modelled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Submission and candidate export by a model that was trained, saved and loaded; S3 has none and takes that of S2."""
    folder = shared_dir(spark, "models")
    files.save_model(_trained(spark, sf_dir)[0], f"{folder}/s2")
    d = _docs(spark, sf_dir)
    models = {s: files.load_model(spark, f"{folder}/{s}", f"{folder}/s2") for s in ("s2", "s3")}
    return programs.infer(adapters.source(d, 0), {"s2": adapters.source(d, 1), "s3": adapters.source(d, 2)}, models=models)


@query()
def submission_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _modelled(spark, sf_dir)[0]


@query(
    f"""{chain(TFIDF, 'cand_1 AS (SELECT s1_id, target_id FROM top)', features_sql(1), scored_sql(1),
  "matches AS (SELECT * FROM scored_1 QUALIFY row_number() OVER (PARTITION BY s1_id ORDER BY prob DESC, target_id DESC) <= 5)", LISTS, SUBMISSION)}SELECT * FROM submission"""
)
def submission_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, target = _sides(spark, sf_dir, 1)
    found = programs.tfidf_results(base, target, "s2")[1]
    return matching.submission(base, matching.capped(found, 5, larger_id_first=True))


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
