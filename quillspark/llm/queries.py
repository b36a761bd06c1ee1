"""The contract queries ``opN_<name>``: thin reads of the operators over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm._common import table


def op1_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.secrets import scan_versions

    return scan_versions(table(spark, sf_dir, "documents")).withColumnRenamed("path", "doc_id")


def op2_lstm_crf_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.pii import personal_data

    return personal_data(table(spark, sf_dir, "documents"))


def op3_boosted_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.toxicity import fit, score

    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


def op4_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), words_per_shingle=3)


def op5_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.sharding import shard

    return shard(table(spark, sf_dir, "documents"), 8)


def op6_broadcast_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.decontaminate import verdicts

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return verdicts(docs, table(spark, sf_dir, "benchmark")).drop("text")


def op7_digest_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.exact_dedup import deduplicate

    return deduplicate(table(spark, sf_dir, "documents"))


def op8_url_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.url_filter import judge

    return judge(table(spark, sf_dir, "pages"))


def op9_configuration_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op10_column_wise_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.suffix_dedup import without_repeats

    return without_repeats(table(spark, sf_dir, "documents"), with_bytes=False, with_passages=True)


def op11_line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.line_dedup import deduplicated

    made = deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.sha2(F.coalesce("kept_text", F.lit("")).cast("binary"), 256)
    return made.select("row.doc_id", "n_lines", "n_dropped", kept.alias("kept_sha256"))


def op12_incidence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.filter_audit import audit

    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_quantised_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.lexical_search import Index, search

    return search(Index.of(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_blob_ledger, op2_lstm_crf_pii, op3_boosted_toxicity, op4_simhash_pivots, op5_hypergeometric_shards, op6_broadcast_ngrams, op7_digest_index, op8_url_logistic, op9_configuration_packing, op10_column_wise_suffixes,
        op11_line_counts, op12_incidence_audit, op13_quantised_search,
    )
}

_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

ORACLES = {
    "op7_digest_index": """
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER g AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
""",
    "op11_line_counts": f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), {_LOWER}) AS key FROM l),
r AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, r.key IS NOT NULL AND k.doc_id <> r.keeper AS gone FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
""",
    "op12_incidence_audit": """
WITH letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order,
         [0, a.bit, a.bit + b.bit, a.bit + b.bit + c.bit, a.bit + b.bit + c.bit + d.bit] AS before, [a.bit, b.bit, c.bit, d.bit, e.bit] AS own
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (SELECT filter_order, s::INTEGER AS step, before[s] AS before, own[s] AS own FROM orders, range(1, 6) t(s)),
w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first
  FROM documents),
f AS (
  SELECT w.doc_id, part,
         (len(words) < 200)::INTEGER + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INTEGER
         + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text))::INTEGER
         + 8 * regexp_matches(text, '[#$%&*|]')::INTEGER + 16 * (first < w.doc_id)::INTEGER AS mask,
         coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic
  FROM w LEFT JOIN labels USING (doc_id)),
h AS (SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM f GROUP BY ALL),
r AS (
  SELECT part, filter_order, step, own,
         coalesce(sum(n) FILTER (WHERE mask & (before | own) = 0), 0) AS kept,
         coalesce(sum(n) FILTER (WHERE mask & own > 0 AND mask & before = 0), 0) AS removed,
         coalesce(sum(n) FILTER (WHERE mask & own > 0 AND mask & before > 0), 0) AS redundant,
         coalesce(sum(n) FILTER (WHERE mask = own), 0) AS unique_fails,
         coalesce(sum(good) FILTER (WHERE mask & own > 0 AND mask & before = 0), 0) AS good_lost,
         coalesce(sum(toxic) FILTER (WHERE mask & own > 0 AND mask & before = 0), 0) AS toxic_lost
  FROM h, steps GROUP BY ALL)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM r
""",
    "op13_quantised_search": f"""
WITH w AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, {_LOWER}), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY ALL),
d AS (SELECT doc_id, sum(tf) AS n FROM tf GROUP BY ALL),
t AS (SELECT count(*) AS docs, sum(n) AS terms FROM d),
q AS (
  SELECT item_id, term, count(*) AS q
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, {_LOWER}), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
  GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf WHERE term IN (SELECT term FROM q) GROUP BY term),
wt AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM df, t),
m AS (SELECT doc_id, 75 + (25 * n * docs) // terms AS m FROM d, t),
s AS (
  SELECT item_id, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM q JOIN wt USING (term) JOIN tf USING (term) JOIN m USING (doc_id) GROUP BY ALL),
r AS (SELECT *, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20
""",
}
