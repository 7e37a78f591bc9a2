"""Building blocks that keep any one key, however hot, from landing in one task.

Order-dependent work inside a group (budgets, running totals, gaps) is done per
slice of the group's position range, with the state at each slice boundary
computed from a small per-slice summary.
"""

import tempfile
from functools import reduce
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from changeproof.errors import Refused

SLICE_WIDTH = 1_000_000
BROADCAST_ROWS = 100_000
SALTS = 16


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the session's shared folder; make a local one only on a local master without it."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        configured = tempfile.mkdtemp(prefix="changeproof-checkpoint-")
    context.setCheckpointDir(configured)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to the reliable checkpoint folder and read them from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def bounded(df: DataFrame, what: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A side that people write by hand (rules, sources): at most `limit` rows by contract, else refused."""
    if df.limit(limit + 1).count() > limit:
        raise Refused("E_TOO_MANY_ROWS", f"more than {limit} rows", what=what)
    return F.broadcast(df)


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add (or replace) columns that are worked out once a row, however often later expressions name them.

    They come out of a generator of one row. The optimiser copies a projected expression into every place that names it, filters
    above all, but takes what a generator made as it is.
    """
    made = F.struct(*(c.alias(n) for n, c in columns.items()))
    return df.select("*", F.explode(F.array(made)).alias("__once")).select(*(c for c in df.columns if c not in columns), "__once.*")


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """A join on keys in which null equals null; the keys of the left side stay."""
    other = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
    return left.join(other, on, how).drop(*[f"__r_{k}" for k in keys])


def number_rows(df: DataFrame, order: list, into: str = "idx") -> DataFrame:
    """Dense 0-based numbering of the whole table in `order`, with no single-task sort.

    `order` should be unique. Rows are range-partitioned and written out once, so the
    partition of a row cannot change between counting and numbering.
    """
    placed = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("__at", F.monotonically_increasing_id())
    )
    placed = cut_lineage(placed)
    # monotonically_increasing_id holds the partition above bit 33, the row below it.
    part = F.shiftright("__at", 33)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    # One row per partition of the table, so its size is bounded by the partition count.
    return (
        placed.withColumn("__part", part)
        .join(F.broadcast(starts), "__part")
        .withColumn(into, F.col("__start") + F.col("__at").bitwiseAND((1 << 33) - 1))
        .drop("__part", "__start", "__at")
    )


def event_order() -> list[Column]:
    """Sequence ascending, events without one last, then arrival."""
    return [F.col("seq").asc_nulls_last(), F.col("idx").asc()]


def event_slice(width: int = SLICE_WIDTH) -> Column:
    """Contiguous slices of event_order(); events without a sequence form the last ones."""
    last = F.lit(1 << 50)
    return F.when(F.col("seq").isNull(), last + F.floor(F.col("idx") / width)).otherwise(
        F.floor(F.col("seq") / width)
    )


@dataclass
class Running:
    """A running sum, min or max inside the group, optionally split further by columns.

    Exclusive totals leave the current row out: an exclusive max of the ordering column
    is the previous value.
    """

    value: Column
    by: list[str] = field(default_factory=list)
    fn: str = "sum"
    inclusive: bool = True


_FOLD = {"sum": F.sum, "min": F.min, "max": F.max}


def running_totals(
    df: DataFrame,
    keys: list[str],
    order: list,
    slice_: Column,
    totals: dict[str, Running],
    attach: DataFrame | None = None,
) -> DataFrame:
    """Add running totals per `keys` in `order` (unique per key).

    The rows are shuffled once, by (keys, slice). What earlier slices contribute comes from
    a summary with one row per (keys, slice, split), pre-aggregated before its shuffle.
    `attach` holds at most one row per `keys`; it rides on the summary, so a hot key does not
    meet it in one task.
    """
    at = [*keys, "__slice"]
    splits = list(dict.fromkeys(c for t in totals.values() for c in t.by))
    rows = df.withColumn("__slice", slice_).withColumns(
        {f"__v_{n}": t.value.cast("long") if t.fn == "sum" else t.value for n, t in totals.items()}
    )
    finest = rows.groupBy(*at, *splits).agg(
        *[_FOLD[t.fn](f"__v_{n}").alias(f"__v_{n}") for n, t in totals.items()]
    )

    summary = None
    for name, total in totals.items():
        fold = _FOLD[total.fn]
        per = finest.groupBy(*at, *total.by).agg(fold(f"__v_{name}").alias("__n"))
        earlier = (
            Window.partitionBy(*keys, *total.by)
            .orderBy("__slice")
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        per = per.withColumn("__start", fold("__n").over(earlier))
        if total.by:
            entry = F.struct(split_key(total.by).alias("key"), F.col("__start").alias("value"))
            per = per.groupBy(*at).agg(
                F.map_from_entries(F.collect_list(entry)).alias(f"__o_{name}")
            )
        else:
            per = per.select(*at, F.col("__start").alias(f"__o_{name}"))
        summary = per if summary is None else null_safe(summary, per, at, "inner")
    if attach is not None:
        summary = null_safe(summary, attach, keys)

    joined = null_safe(rows, summary, at)
    for name, total in totals.items():
        here = (
            Window.partitionBy(*at, *total.by)
            .orderBy(*order)
            .rowsBetween(
                Window.unboundedPreceding, Window.currentRow if total.inclusive else -1
            )
        )
        start = F.col(f"__o_{name}")
        if total.by:
            start = F.try_element_at(start, split_key(total.by))
        local = _FOLD[total.fn](f"__v_{name}").over(here)
        if total.fn == "sum":
            whole = F.coalesce(start, F.lit(0)) + F.coalesce(local, F.lit(0))
        else:
            whole = (F.greatest if total.fn == "max" else F.least)(start, local)
        joined = joined.withColumn(name, whole)
    return joined.drop("__slice", *[f"__v_{n}" for n in totals], *[f"__o_{n}" for n in totals])


def split_key(columns: list[str]) -> Column:
    return F.concat_ws("\u0001", *[F.col(c).cast("string") for c in columns])


def salted_flag(
    rows: DataFrame, keys_table: DataFrame, keys: list[str], into: str, spread: Column, salts: int = SALTS
) -> DataFrame:
    """Left semi membership as a boolean column, each key split over `salts` partitions.

    `keys_table` holds distinct keys; every copy of a key serves one share of its rows.
    """
    marked = keys_table.select(
        *keys, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("__salt"), F.lit(True).alias(into)
    )
    return (
        rows.withColumn("__salt", F.pmod(spread, F.lit(salts)).cast("int"))
        .join(marked, [*keys, "__salt"], "left")
        .withColumn(into, F.coalesce(F.col(into), F.lit(False)))
        .drop("__salt")
    )


def first_n(df: DataFrame, group: list[str], order: list, n: int, into: str = "rank") -> DataFrame:
    """The first n rows per group in `order`.

    The literal bound lets Spark cut every map task's share to n rows before the shuffle.
    """
    ranked = df.withColumn(into, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked.filter(F.col(into) <= F.lit(n))
