"""A training-data pipeline of five stages over the table documents.

Each stage takes all that its predecessor kept, and its decisions take effect: toxic documents go, one row of each group of equal texts
stays, one document of each group of near copies stays, sources are mixed to their targets (documents repeat by
epochs), and what is left is packed into sequences. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from changeproof.llm import block_naming, jaccard_join, reservoir_mix, toxicity, vector_packing
from changeproof.llm.common import forget, written
from changeproof.llm.queries import MIX_MOST, MIX_WEIGHTS, fold, table, tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the string-kernel machine does not reject."""
    scored = toxicity.toxicity_scores(docs.withColumn("kept_columns", F.struct(*docs.columns)), table(spark, sf_dir, "labels"), fold(4, 2))
    return scored.where("predicted = 0").select("kept_columns.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of each group of equal texts that stays."""
    return block_naming.kept_rows(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked rows the one with the smallest doc_id (null last), of equal ids the first as written; rows without words stay.

    Rows are told apart by doc_id where that names one row each. Where ids repeat or are null, the rows are written once with numbers, which then tell them apart.
    """
    id_ = F.col("doc_id").cast("long")
    if docs.groupBy(id_.alias("doc_id")).count().where("count > 1 OR doc_id IS NULL").isEmpty():
        linked = jaccard_join.jaccard_components(docs.select("doc_id", "text"))
        gone = linked.where("component_id <> doc_id").select("doc_id")
        return docs.withColumn("doc_id", id_).join(gone, "doc_id", "left_anti").select(*docs.columns)
    rows = written(docs.select(F.struct(*docs.columns).alias("row"), id_.alias("id"), F.monotonically_increasing_id().alias("number")))
    linked = jaccard_join.jaccard_components(rows.select(F.col("number").alias("doc_id"), F.col("row.text").alias("text")))
    of = written(linked.select(F.col("doc_id").alias("number"), "component_id").join(rows.select("id", "number"), "number"))
    stay = of.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "number"))["number"].alias("number")).select("number")
    return rows.join(stay, "number", "left_semi").select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it; of one in which a target ends, the first words."""
    # The other columns get plain names meanwhile, since the mix adds columns of its own.
    names = {c: c if c in ("doc_id", "text", "source") else f"column_{i}" for i, c in enumerate(docs.columns)}
    mixed = reservoir_mix.mix(docs.toDF(*names.values()), MIX_WEIGHTS, MIX_MOST)
    times = F.floor(F.col("taken") / F.greatest("size", F.lit(1))).cast("int")
    part = (F.col("taken") - times * F.col("size")).cast("int")
    cut = F.array_join(F.slice(reservoir_mix.words_of(F.col("text").cast("string")), F.lit(1), part), " ")
    rows = mixed.withColumn("copy", F.explode(F.concat(F.array_repeat(F.lit(False), times), F.array_repeat(F.lit(True), (part > 0).cast("int")))))
    text = F.when(F.col("copy"), cut).otherwise(F.col("text"))
    made = {"text": text}
    if "n_chars" in names:
        made[names["n_chars"]] = F.when(F.col("copy"), F.length(text)).otherwise(F.col(names["n_chars"])).cast(docs.schema["n_chars"].dataType)
    return rows.select(*(made.get(n, F.col(n)).alias(c) for c, n in names.items()))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequence and place."""
    return vector_packing.best_fit(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: Toxicity and packing cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each written as Parquet to the shared folder and read again; a stage's table goes when the next is there."""
    docs, first = table(spark, sf_dir, "documents"), True
    for _, stage in STAGES:
        made = written(stage(spark, docs, sf_dir))
        if not first:
            forget(docs)
        docs, first = made, False
    return docs
