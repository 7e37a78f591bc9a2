"""Fences: windows cut from a log by marker rows in the log, never by time."""

from pyspark.sql import Column, DataFrame, functions as F

from changeproof.functions.canonical import json_value
from changeproof.schema import MARKER_ENTITY

FENCE = ["run_id", "scenario_id", "nonce"]

# Bucket widths of the range join. A window joins at the narrowest width that holds it, so it
# meets few buckets; the widest bounds how many rows one bucket can hold.
WIDTHS = [1 << 6, 1 << 10, 1 << 14, 1 << 20]


def markers(log: DataFrame, source: list[str], entity: str = MARKER_ENTITY) -> DataFrame:
    """Marker rows with their identity; the row is the after image, else the key."""
    row = F.coalesce(F.col("after"), F.col("key"))

    def read(*names: str) -> Column:
        return F.coalesce(*[json_value(row, n) for n in names])

    return log.filter(F.col("entity") == entity).select(
        *source,
        "idx",
        "tx_id",
        read("run_id", "runId").alias("run_id"),
        read("scenario_id", "scenarioId").alias("scenario_id"),
        read("surface").alias("surface"),
        read("seq").cast("int").alias("window_seq"),
        read("nonce").alias("nonce"),
        read("kind", "marker", "boundary").alias("boundary"),
    )


def drop_markers(log: DataFrame, entity: str = MARKER_ENTITY) -> DataFrame:
    return log.filter(F.col("entity") != entity)


def marker_pairs(
    log: DataFrame, source: list[str], windows: DataFrame | None = None, entity: str = MARKER_ENTITY
) -> DataFrame:
    """First open and first close position per window, and why a window is not fenced.

    `windows[source + run_id, scenario_id, nonce]` adds windows that left no marker at all.
    """
    found = (
        markers(log, source, entity)
        .groupBy(*source, *FENCE)
        .agg(
            F.min("surface").alias("surface"),
            F.min("window_seq").alias("window_seq"),
            F.min(F.when(F.col("boundary") == "open", F.col("idx"))).alias("open_idx"),
            F.min(F.when(F.col("boundary") == "close", F.col("idx"))).alias("close_idx"),
        )
    )
    if windows is not None:
        found = windows.select(*source, *FENCE).distinct().join(found, [*source, *FENCE], "left")
    reason = (
        F.when(F.col("open_idx").isNull(), "missing_open")
        .when(F.col("close_idx").isNull(), "missing_close")
        .when(F.col("close_idx") <= F.col("open_idx"), "close_before_open")
    )
    return found.withColumn("reason", reason)


def harness_tx_ids(log: DataFrame, source: list[str], entity: str = MARKER_ENTITY) -> DataFrame:
    """Distinct transactions that wrote a window's markers, one row each."""
    rows = markers(log, source, entity)
    return rows.filter(F.col("tx_id").isNotNull()).select(*source, *FENCE, "tx_id").distinct()


def fence_slice(
    log: DataFrame, source: list[str], pairs: DataFrame, entity: str = MARKER_ENTITY
) -> DataFrame:
    """Rows strictly between the markers of each fenced window; all marker rows are dropped.

    A range join by position buckets: rows and windows meet on (source, width, bucket), so a
    log or a window of any length is spread over buckets of bounded size.
    """
    spans = pairs.filter(F.col("reason").isNull() & (F.col("close_idx") - F.col("open_idx") > 1))
    length = F.col("close_idx") - F.col("open_idx")
    width = F.lit(WIDTHS[-1])
    for w in reversed(WIDTHS[:-1]):
        width = F.when(length <= w, F.lit(w)).otherwise(width)
    spans = spans.withColumn("__width", width)
    present = [r[0] for r in spans.select("__width").distinct().collect()]  # at most len(WIDTHS) rows
    spans = spans.withColumn(
        "__bucket",
        F.explode(
            F.sequence(F.floor(F.col("open_idx") / F.col("__width")), F.floor(F.col("close_idx") / F.col("__width")))
        ),
    ).drop("reason", "tx_id")

    rows = drop_markers(log, entity)
    rows = rows.drop(*[c for c in rows.columns if c in (*FENCE, "surface", "window_seq", "nonce") and c not in source])
    rows = rows.withColumn("__width", F.explode(F.array(*[F.lit(w) for w in sorted(present)] or [F.lit(0)])))
    rows = rows.withColumn("__bucket", F.floor(F.col("idx") / F.greatest("__width", F.lit(1))))
    inside = (F.col("idx") > F.col("open_idx")) & (F.col("idx") < F.col("close_idx"))
    return (
        rows.join(spans, [*source, "__width", "__bucket"])
        .filter(inside)
        .drop("__width", "__bucket", "open_idx", "close_idx")
    )


def unfenced(log: DataFrame, source: list[str], pairs: DataFrame, entity: str = MARKER_ENTITY) -> DataFrame:
    """Rows that lie in no fenced window."""
    inside = fence_slice(log, source, pairs, entity).select(*source, "idx").distinct()
    return drop_markers(log, entity).join(inside, [*source, "idx"], "left_anti")


def tenant_scope(column: str, tenant: Column) -> Column:
    """True when any image carries the tenant; what cannot be told is outside."""
    hits = [F.coalesce(json_value(F.col(i), column) == tenant, F.lit(False)) for i in ("key", "before", "after")]
    return hits[0] | hits[1] | hits[2]
