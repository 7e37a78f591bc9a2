"""The event row: validity, normal form and numbering of change logs."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from changeproof.functions.canonical import canonical_json, image_map
from changeproof.operators.scale import SLICE_WIDTH, Running, running_totals
from changeproof.schema import ACTOR_KINDS, FIDELITY_LEVELS, MAX_SAFE_INTEGER, OPS, WINDOW


@dataclass
class Split:
    """Rows that were understood, and rows that were refused with their reasons."""

    events: DataFrame
    rejects: DataFrame


def is_json_object(text: Column) -> Column:
    return F.coalesce(
        F.try_parse_json(text).isNotNull() & F.startswith(F.ltrim(text), F.lit("{")), F.lit(False)
    )


def reject_reasons(window: list[str] | tuple = ()) -> Column:
    """Fields of the event row that are not acceptable, in field order; the window's columns must not be null."""
    paths_bad = F.col("paths").isNull() | F.exists(
        "paths", lambda p: p.isNull() | (F.size(p) == 0) | F.exists(p, lambda s: s.isNull())
    )
    checks = [
        *[(name, F.col(name).isNull()) for name in window],
        ("entity", ~F.coalesce(F.contains(F.col("entity"), F.lit(".")), F.lit(False))),
        ("op", ~F.coalesce(F.col("op").isin(OPS), F.lit(False))),
        ("seq", F.coalesce(F.abs("seq") > MAX_SAFE_INTEGER, F.lit(False))),
        ("fidelity", ~F.coalesce(F.col("fidelity").isin(FIDELITY_LEVELS), F.lit(False))),
        ("paths", paths_bad),
        ("actor.kind", ~F.coalesce(F.col("actor.kind").isin(ACTOR_KINDS), F.lit(False))),
        ("key", ~is_json_object(F.col("key"))),
        ("before", F.col("before").isNotNull() & ~is_json_object(F.col("before"))),
        ("after", F.col("after").isNotNull() & ~is_json_object(F.col("after"))),
    ]
    return F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks]))


def read_change_events(df: DataFrame) -> Split:
    """Canonicalise the images of valid rows; set invalid rows aside, never drop them."""
    checked = df.withColumn("reasons", reject_reasons([c for c in WINDOW if c in df.columns]))
    good = (
        checked.filter(F.size("reasons") == 0)
        .drop("reasons")
        .withColumns({c: canonical_json(F.col(c)) for c in ("key", "before", "after")})
    )
    return Split(good, checked.filter(F.size("reasons") > 0))


def recompute_changed_paths() -> Column:
    """Insert: every column of the after image. Otherwise the declared paths that really differ."""

    def value(image: str, path: Column) -> Column:
        # Walk one level per segment through canonical JSON text.
        return F.aggregate(
            path,
            F.col(image),
            lambda text, segment: F.try_element_at(image_map(text), segment),
        )

    null = F.lit("null")
    columns = F.array_sort(F.map_keys(image_map(F.col("after"))))
    return F.when(
        F.col("op") == "insert",
        F.coalesce(F.transform(columns, lambda c: F.array(c)), F.array().cast("array<array<string>>")),
    ).otherwise(
        F.filter(
            "paths",
            lambda p: F.coalesce(value("before", p), null) != F.coalesce(value("after", p), null),
        )
    )


def number_events(
    df: DataFrame, log: list[str], position: str, into: str = "seq", width: int = SLICE_WIDTH
) -> DataFrame:
    """Dense 0-based sequence per log in `position` order (`position` is an integer column).

    The running count is taken per slice of the position range, so one log holding most
    rows is still spread over many tasks.
    """
    counted = running_totals(
        df, log, [F.col(position)], F.floor(F.col(position) / width), {into: Running(F.lit(1))}
    )
    return counted.withColumn(into, F.col(into) - 1)


def rebase_seq(
    events: DataFrame, source: list[str], drain: str, seq: str = "seq", width: int = SLICE_WIDTH
) -> DataFrame:
    """Continue the per-drain numbering over successive drains of a source."""
    sizes = events.groupBy(*source, drain).agg(F.count("*").alias("n_events"))
    total = running_totals(
        sizes, source, [F.col(drain)], F.floor(F.col(drain) / width), {"through": Running(F.col("n_events"))}
    )
    starts = total.select(*source, drain, (F.col("through") - F.col("n_events")).alias("seq_offset"))
    return (
        events.join(starts, [*source, drain])
        .withColumn(seq, F.col(seq) + F.col("seq_offset"))
        .drop("seq_offset")
    )


def tx_groups(events: DataFrame, boundaries: DataFrame, log: list[str]) -> DataFrame:
    """Membership of transactions in long form, with one null-seq row for an empty transaction.

    A list per transaction would pull a hot transaction into one row; position rows do not.
    """
    members = events.filter(F.col("tx_id").isNotNull()).select(*log, "tx_id", "seq")
    known = boundaries.filter(F.col("tx_id").isNotNull()).select(*log, "tx_id").distinct()
    used = members.select(*log, "tx_id").distinct()
    empty = known.join(used, [*log, "tx_id"], "left_anti")
    return members.unionByName(empty.withColumn("seq", F.lit(None).cast("long")))


def tx_summary(groups: DataFrame, log: list[str]) -> DataFrame:
    return groups.groupBy(*log, "tx_id").agg(
        F.count("seq").alias("n_events"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq")
    )


def actor_column(kind: Column | str = "unknown", lsn: Column | None = None, **fields: Column) -> Column:
    """The attribution seam: any column expressions of the log row can name the writer."""
    null = F.lit(None).cast("string")
    return F.struct(
        (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"),
        fields.get("id", null).alias("id"),
        fields.get("application_name", null).alias("application_name"),
        (null if lsn is None else lsn).alias("lsn"),
    )

