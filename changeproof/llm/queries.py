"""The registered queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from changeproof.llm import block_naming, entropy_secrets, importance_resampling, jaccard_join, katz_backoff, quality_crf, rendezvous, reservoir_mix, spectral_whitening, spot_signatures, toxicity, url_model, vector_packing

#: Rules of the URL query: (verdict, host and path).
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
SHARDS = 40
MIX_WEIGHTS, MIX_MOST = (5, 2, 1), 3.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(parts: int, held: int) -> Column:
    """Whether crc32 of the id's text leaves this remainder; a null id is held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == held, F.lit(True))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_crf.quality_scores(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), fold(3, 1))
    return scored.select("doc_id", fold(3, 1).alias("held_out"), "score", "predicted")


def op2_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_packing.best_fit(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op4_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spot_signatures.edited_fingerprints(table(spark, sf_dir, "documents"))


def op5_block_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_naming.exact_groups(table(spark, sf_dir, "documents"))


def op6_rendezvous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendezvous.shards(table(spark, sf_dir, "documents"), [1.0] * SHARDS, [1.0] * (SHARDS + 1))


def op7_url_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_model.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op8_reservoir_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reservoir_mix.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), MIX_WEIGHTS, MIX_MOST).select("doc_id", "size", "source_size", "target", "taken")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.toxicity_scores(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), fold(4, 2))
    return scored.select("doc_id", fold(4, 2).alias("held_out"), "score", "predicted")


def op10_entropy_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entropy_secrets.secret_spans(table(spark, sf_dir, "documents"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_spectral_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectral_whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz_backoff.katz_scores(table(spark, sf_dir, "documents"), fold(5, 1))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (
        op1_quality_crf, op2_vector_packing, op3_jaccard_join, op4_spot_signatures, op5_block_naming, op6_rendezvous, op7_url_model, op8_reservoir_mix, op9_toxicity, op10_entropy_secrets,
        op11_importance_resampling, op12_spectral_whitening, op13_katz_backoff,
    )
    return {f.__name__: f for f in made}


_BLANKS = r"[\x20\x09-\x0D]+"

OP5_SQL = rf"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '{_BLANKS}', '', 'g') AS norm FROM documents
), s AS (SELECT doc_id, n, sha256(norm) AS text_sha256, norm FROM d)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER w = 1 AS kept, text_sha256
FROM s WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""

OP8_SQL = rf"""
WITH w AS (
  SELECT doc_id, source, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents
), k AS (
  SELECT doc_id, source, len(words)::BIGINT AS size,
         -ln(u) / (0.1 + CASE WHEN len(words) = 0 THEN 0.0 ELSE 0.9 * len(list_distinct(words)) / len(words) END) AS key
  FROM w
), s AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
p AS (
  SELECT *, 3.0::DOUBLE * source_size AS stop,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight
  FROM s
), l AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(stop) OVER (ORDER BY stop / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(weight) OVER (ORDER BY stop / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM p
), v AS (SELECT arg_min(level, stop / weight) AS level FROM l WHERE stop >= level * weight),
t AS (SELECT source, source_size, least(stop, coalesce((SELECT level FROM v) * weight, stop)) AS target FROM p),
j AS (
  SELECT k.doc_id, k.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS epochs,
         coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (size * epochs + greatest(0, least(size, floor(target - epochs * source_size) - before)))::BIGINT AS taken
FROM j
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_block_naming": OP5_SQL, "op8_reservoir_mix": OP8_SQL}
