"""One query for each operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact, html_runs, jaccard, lengths, mixing, packing, quality, sharding, url_cascade, warc
from .common import read_table

#: Fixed values of the url rules' contract.
URL_RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}
#: Names of the domains that the labels table tells apart, by quality and toxic.
DOMAINS = {(1, 0): "clean", (1, 1): "toxic", (0, 0): "junk", (0, 1): "toxic_junk"}
#: Target shares of the corpus's tokens.
MIX_WEIGHTS = {"clean": 0.90, "toxic": 0.01, "junk": 0.08, "toxic_junk": 0.01}


def domain_labels(labels: DataFrame) -> DataFrame:
    domain = F.lit(None).cast("string")
    for (q, t), name in DOMAINS.items():
        domain = F.when((F.col("quality") == q) & (F.col("toxic") == t), F.lit(name)).otherwise(domain)
    return labels.select("doc_id", domain.alias("domain")).where("domain is not null")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_cascade.judge_urls(read_table(spark, sf_dir, "pages"), URL_RULES)


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_runs.extract(read_table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_repeated")


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_classes(read_table(spark, sf_dir, "documents"), words=3, percent=90)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return mixing.mix(docs, domain_labels(labels), weights=MIX_WEIGHTS)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read_table(spark, sf_dir, "documents")).withColumn("grown_shard", F.lit(None).cast("int"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths.context_totals(lengths.length_histogram(read_table(spark, sf_dir, "documents")))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(read_table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    bundles = warc.write_bundles(read_table(spark, sf_dir, "pages"))
    return warc.read_bundles(bundles).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_url_filters, op3_html_extraction, op4_ngram_jaccard_join, op5_mixing, op6_quality_rules, op7_sharding, op8_token_counts, op9_exact_dedup, op10_warc)}

_BLANK = "[ \\t\\n\\x0b\\x0c\\r]"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

ORACLES = {
    "op2_url_filters": r"""
        WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        s AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
        r(rule, rhost, rpath, verdict) AS (VALUES ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'),
             ('www.example.com/en/', 'www.example.com', '/en/', 'allow'), ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')),
        m AS (SELECT s.page_id, s.host, s.path, r.rule, r.verdict, row_number() OVER (PARTITION BY s.page_id ORDER BY length(r.rule) DESC) AS k
              FROM s LEFT JOIN r ON (s.host = r.rhost OR ends_with(s.host, '.' || r.rhost)) AND starts_with(s.path, r.rpath))
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1""",
    "op9_exact_dedup": rf"""
        WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '{_BLANK}', '', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
               count(*) OVER (PARTITION BY text_sha256) AS group_size,
               row_number() OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) = 1 AS kept, text_sha256 FROM t""",
    "op4_ngram_jaccard_join": rf"""
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '{_BLANK}+'), lambda x: x <> '') AS ws FROM documents),
        g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
        p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b FROM p JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id WHERE 100 * c >= 90 * (na.n + nb.n - c)),
        r(id, x) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.id, l.b FROM r JOIN l ON r.x = l.a)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT id, min(x) AS component_id FROM r GROUP BY 1) c ON c.id = d.doc_id""",
    "op6_quality_rules": rf"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '{_BLANK}+'), lambda x: x <> '') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0b\x0c\r]')) AS ls FROM t),
        win AS (SELECT doc_id, i, array_to_string(ws[i : i + 7], ' ') AS s FROM w, unnest(range(1, len(ws) - 6)) u(i)),
        again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win) WHERE c > 1),
        cover AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM again, range(0, 8) u(j) GROUP BY 1),
        f AS (SELECT w.doc_id, len(ws) AS n_words, length(regexp_replace(text, '{_BLANK}', '', 'g')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) AS n_lines,
                     len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(list_filter(ws, lambda x: regexp_matches(x, '\p{{L}}'))) AS lettered, len(list_distinct(ws)) AS different,
                     length(regexp_replace(text, '[^\p{{L}}]+', '', 'g')) AS letters, length(regexp_replace(text, '[^\p{{Ll}}]+', '', 'g')) AS small FROM w LEFT JOIN cover USING (doc_id)),
        b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 3 * n_words OR word_chars > 10 * n_words OR 10 * n_dup_lines > 3 * n_lines OR 10 * lettered < 8 * n_words OR 10 * (letters - small) > 5 * letters OR 100 * different < 25 * least(n_words, 400)) AS kept FROM b""",
    "op10_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS best FROM pages),
        d AS (SELECT *, sha1(html) AS h FROM p),
        b AS (SELECT *, list_transform(range(0, 8), lambda g: CAST('0x' || substr(h, 5 * g + 1, 5) AS BIGINT)) AS parts FROM d)
        SELECT page_id, octet_length(encode(html)) AS payload_bytes,
               array_to_string(list_transform(parts, lambda v: array_to_string(list_transform([15, 10, 5, 0], lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v >> k) & 31 AS INTEGER) + 1, 1)), '')), '') AS payload_digest,
               CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id < best THEN best END AS refers_to FROM b""",
}
