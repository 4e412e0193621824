"""One query per operator, over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_warc_boundary_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import scratch, warc

    path = scratch.new_path(spark, "op1")
    warc.write(table(spark, sf_dir, "pages"), path)
    return warc.read(spark, path)


@query
def op2_simhash_bk_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from . import simhash

    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), unnamed=True)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op3_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality_rules

    return quality_rules.judge(table(spark, sf_dir, "documents"))


@query
def op4_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import main_text

    return main_text.extract(table(spark, sf_dir, "pages"))


@query
def op5_rans_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import rans, scratch

    path = rans.write(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), scratch.new_path(spark, "op5"))
    return rans.read(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


@query
def op6_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import backoff

    return backoff.score(table(spark, sf_dir, "documents"))


@query
def op7_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import importance

    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op8_monoid_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import monoid_bpe

    encoded = monoid_bpe.encode_texts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)
    return encoded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query
def op9_pivot_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import topk

    return topk.search(table(spark, sf_dir, "embeddings"))


@query
def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import packing

    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


@query
def op11_permuterm_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import spelling

    return spelling.variants(table(spark, sf_dir, "documents"))


@query
def op12_threshold_join_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import negatives

    return negatives.mined(table(spark, sf_dir, "embeddings")).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


@query
def op13_suffix_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import repeats

    return repeats.removed(table(spark, sf_dir, "documents"))


ORACLE_SQL: dict[str, str] = {
    "op1_warc_boundary_chain": """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest FROM pages
), f AS (
  SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY digest) END AS first_id FROM p
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM f
""",
    "op3_quality_cascade": r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), m AS (
  SELECT doc_id, text, w, len(w) AS n_words, len(lines) AS n_lines,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper,
         length(regexp_replace(text, '[^a-z]', '', 'g')) AS n_lower,
         len(string_split(text, '!!')) - 1 AS n_exclaim
  FROM t
), u AS (
  SELECT row_number() OVER () AS r, * FROM m
), win AS (
  SELECT r, i, w[i:i + 4] AS g FROM (SELECT r, w, unnest(range(1, n_words - 3)) AS i FROM u WHERE n_words >= 5)
), again AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1
), covered AS (
  SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM again, range(0, 5) AS o(k) GROUP BY r
), stutter AS (
  SELECT r, count(*) FILTER (WHERE w[i] = w[i + 1]) AS n_stutter FROM (SELECT r, w, unnest(range(1, n_words)) AS i FROM u) GROUP BY r
), a AS (
  SELECT u.*, coalesce(c.n_repeat_words, 0) AS n_repeat_words, coalesce(s.n_stutter, 0) AS n_stutter,
         n_words < 10 OR 100 * coalesce(c.n_repeat_words, 0) > 20 * n_words AS base_failed
  FROM u LEFT JOIN covered c USING (r) LEFT JOIN stutter s USING (r)
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND NOT 4 * n_symbols > n_words AND NOT 2 * n_dup_lines > n_lines AND NOT n_upper > n_lower
       AND NOT 4 * n_exclaim > n_words AND word_chars BETWEEN 2 * n_words AND 20 * n_words AND NOT 10 * n_stutter > 3 * n_words AS kept
FROM a
""",
    "op9_pivot_top_k": """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.r, a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.r <> b.r
), k AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 5
""",
    "op12_threshold_join_negatives": """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE CAST(label AS BIGINT) END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.r AS anchor, a.vec_id AS anchor_id, b.r AS other, b.vec_id, a.label = b.label AS same,
         CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.r <> b.r
), p AS (
  SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, other) AS ord FROM s WHERE same
), n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.anchor, p.ord ORDER BY s.score DESC, s.vec_id, s.other) AS INTEGER) AS rank
  FROM p JOIN s ON p.ord <= 5 AND p.anchor = s.anchor AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
""",
}
