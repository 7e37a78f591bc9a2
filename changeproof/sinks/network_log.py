"""Network logs as redacted JSON lines: at most MOST entries a page, then a line that says how many were left out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from changeproof.operators.privacy import redact_headers, redact_text, redact_url

# Fixed value: entries that a page's log may hold.
MOST = 2_000
ENTRY = "page string, seq long, method string, url string, status int, headers map<string,string>, body string, truncated long"


def log_lines(entries: DataFrame, secrets: tuple[str, ...] = (), most: int = MOST) -> DataFrame:
    """entries(page, seq, method, url, status, headers, body) to (page, place, line): the first ``most`` by seq, redacted, then the rest's number.

    Spark cuts each task's share of a page to ``most`` rows before it is shuffled, so a page with very many entries is not
    gathered; the number left out comes from counts.
    """
    ranked = entries.withColumn("place", F.row_number().over(Window.partitionBy("page").orderBy("seq"))).where(F.col("place") <= F.lit(most))
    clean = F.struct(
        "page", "seq", "method", redact_url(F.col("url"), secrets=secrets).alias("url"), "status", redact_headers(F.col("headers"), secrets).alias("headers"), redact_text(F.col("body"), list(secrets)).alias("body")
    )
    kept = ranked.select("page", F.col("place").cast("long").alias("place"), F.to_json(clean).alias("line"))
    over = entries.groupBy("page").agg((F.count("*") - most).alias("left_out")).where("left_out > 0")
    last = over.select("page", F.lit(most + 1).cast("long").alias("place"), F.to_json(F.struct("page", F.col("left_out").alias("truncated"))).alias("line"))
    return kept.unionByName(last)


def write_network_log(entries: DataFrame, path: str, secrets: tuple[str, ...] = (), most: int = MOST) -> None:
    """Write JSON lines, the lines of a page together and in order in one file."""
    lines = log_lines(entries, secrets, most)
    lines.repartition("page").sortWithinPartitions("page", "place").select("line").write.text(path)


def read_network_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(entries, truncated(page, truncated)) of written logs."""
    rows = spark.read.schema(ENTRY).json(path)
    cut = F.col("truncated").isNotNull()
    return rows.where(~cut).drop("truncated"), rows.where(cut).select("page", "truncated")
