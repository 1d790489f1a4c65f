"""The contract queries opN_<name> and their SQL."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import read, settled
from .quality import FENCE, MAX_REPEAT_PERCENT, METRICS, MIN_SOURCES, MIN_WORDS, PRIOR

#: The rules of the URL query: (verdict, host, path).
URL_RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def op1_pack_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return settled(spark, "op1", lambda: pack(read(spark, sf_dir, "documents"), length=2048, end_id=1))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import scan

    s = scan(read(spark, sf_dir, "documents"))
    return s.select("doc_id", "start", "end", F.sha2("match", 256).alias("match_sha256"), F.round("probability", 6).alias("probability"), "is_secret")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urlfilter import judge_urls

    rules = spark.createDataFrame(list(URL_RULES), "verdict string, host string, path string")
    return settled(spark, "op3", lambda: judge_urls(read(spark, sf_dir, "pages"), rules))


def op4_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    return settled(spark, "op4", lambda: near_duplicates(read(spark, sf_dir, "documents"), words=2, percent=80))


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    return settled(spark, "op5", lambda: top_k(read(spark, sf_dir, "embeddings"), k=5, every=50))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_report

    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return settled(spark, "op6", lambda: quality_report(read(spark, sf_dir, "documents")).select(columns))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffixdedup import repeated_bytes

    return settled(spark, "op7", lambda: repeated_bytes(read(spark, sf_dir, "documents"), length=50))


def op8_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import round_trip_digests

    return round_trip_digests(read(spark, sf_dir, "documents"))


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokenstore import write_and_verify

    return settled(spark, "op9", lambda: write_and_verify(read(spark, sf_dir, "documents"), end_id=0))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import license_report

    return license_report(read(spark, sf_dir, "documents"))


def op11_sequenced_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sequencer import apply_changes

    return settled(spark, "op11", lambda: apply_changes(read(spark, sf_dir, "client_changes")))


def op12_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whiten

    w = settled(spark, "op12", lambda: whiten(read(spark, sf_dir, "embeddings"), components=16))
    return w.withColumn("deviation", F.col("deviation").try_cast("long"))


def op13_markov_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .markov import language_scores

    return settled(spark, "op13", lambda: language_scores(read(spark, sf_dir, "documents")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_pipeline import run

    return run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_pack_curve, op2_secret_scan, op3_url_filter, op4_near_dup, op5_top_k, op6_quality_rules, op7_suffix_dedup, op8_bpe_trie, op9_token_store, op10_license_scan, op11_sequenced_changes, op12_whiten, op13_markov_scores, pipeline)}

OP3_SQL = """
WITH rules(verdict, host, path) AS (VALUES %s),
u AS (SELECT page_id, row_number() OVER () AS n, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
p AS (SELECT page_id, n, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
             coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
m AS (SELECT p.page_id, p.n, p.host, p.path, r.host || r.path AS rule, r.verdict,
             row_number() OVER (PARTITION BY p.n ORDER BY length(r.host || r.path) DESC NULLS LAST, length(r.host) DESC, r.verdict DESC) AS k
      FROM p LEFT JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
""" % ", ".join(str(r) for r in URL_RULES)

OP5_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 5
"""

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

OP4_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
l AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.y FROM r JOIN l ON r.b = l.x),
c AS (SELECT a, min(b) AS m FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.m AS component_id, d.doc_id = c.m AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.a = d.doc_id
"""

_RATIOS = {m: f"CASE WHEN {below} > 0 THEN floor(1000 * {top} / {below}) ELSE 0 END::BIGINT" for m, (top, below, _) in METRICS.items()}
_EACH = lambda f: ", ".join(f(m) for m in METRICS)
_DRAWN = lambda n, x, y: f"floor(({n} * {x} + {PRIOR} * {y}) / ({n} + {PRIOR}))"

OP6_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t, {_WORDS} AS w,
             list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM documents),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS k FROM (SELECT r, i, w[i : i + 2] AS x FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d))),
c AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM g WHERE k > 1) GROUP BY r),
n AS (SELECT d.r, doc_id, lang, source, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
        CASE WHEN len(w) = 0 THEN 0 ELSE length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) END AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
        length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(t, '[^!]', '', 'g')) AS n_shout, len(lines) AS n_lines FROM d LEFT JOIN c ON c.r = d.r),
v AS (SELECT *, {_EACH(lambda m: f"{_RATIOS[m]} AS v_{m}")} FROM n),
x AS ({" UNION ALL ".join(f"SELECT lang, source, '{m}' AS m, {METRICS[m][2]} AS slack, (v_{m} // (1 << greatest(length(bin(v_{m})) - 6, 0))::BIGINT) * (1 << greatest(length(bin(v_{m})) - 6, 0))::BIGINT AS b FROM v" for m in METRICS)}),
h AS (SELECT 0 AS level, lang, source, m, slack, b, count(*) AS k FROM x GROUP BY ALL UNION ALL SELECT 1, lang, NULL, m, slack, b, count(*) FROM x GROUP BY ALL UNION ALL SELECT 2, NULL, NULL, m, slack, b, count(*) FROM x GROUP BY ALL),
s AS (SELECT *, sum(k) OVER (PARTITION BY level, lang, source, m ORDER BY b) AS seen, sum(k) OVER (PARTITION BY level, lang, source, m) AS total FROM h),
q AS (SELECT level, lang, source, m, max(total) AS total, max(slack) AS slack, min(b) FILTER (WHERE 4 * seen >= total) AS q1, min(b) FILTER (WHERE 4 * seen >= 3 * total) AS q3 FROM s GROUP BY 1, 2, 3, 4),
f AS (SELECT level, lang, source, m, total, slack, q3 + {FENCE} * (q3 - q1) + slack AS top FROM q),
o AS (SELECT a.lang, a.source, a.m, a.slack, {_DRAWN("a.total", "a.top", _DRAWN("l.total", "l.top", "e.top"))} AS top FROM f a JOIN f l ON l.level = 1 AND l.m = a.m AND l.lang IS NOT DISTINCT FROM a.lang JOIN f e ON e.level = 2 AND e.m = a.m WHERE a.level = 0),
y AS (SELECT *, median(top) OVER (PARTITION BY lang, m) AS mid, median(top) OVER (PARTITION BY m) AS mid_all FROM o),
b1 AS (SELECT lang, m, count(*) AS groups, floor(max(mid) + greatest({2 * FENCE + 1} * median(abs(top - mid)), max(slack))) AS bound FROM y GROUP BY 1, 2),
b2 AS (SELECT m, floor(max(mid_all) + greatest({2 * FENCE + 1} * median(abs(top - mid_all)), max(slack))) AS bound FROM y GROUP BY 1),
z AS (SELECT o.lang, o.source, o.m, least(o.top, CASE WHEN b1.groups >= {MIN_SOURCES} THEN b1.bound ELSE b2.bound END) AS ceiling FROM o JOIN b1 ON b1.m = o.m AND b1.lang IS NOT DISTINCT FROM o.lang JOIN b2 ON b2.m = o.m),
p AS (SELECT lang, source, {_EACH(lambda m: f"max(ceiling) FILTER (WHERE m = '{m}') AS c_{m}")} FROM z GROUP BY 1, 2),
a AS (SELECT v.*, {" AND ".join(f"v_{m} <= c_{m}" for m in METRICS)} AS fits, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed
      FROM v JOIN p ON p.lang IS NOT DISTINCT FROM v.lang AND p.source IS NOT DISTINCT FROM v.source)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed, fits AND NOT base_failed AS kept FROM a
"""

ORACLE_SQL = {"op3_url_filter": OP3_SQL, "op4_near_dup": OP4_SQL, "op5_top_k": OP5_SQL, "op6_quality_rules": OP6_SQL}
