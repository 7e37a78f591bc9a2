"""Budgeted matching of events to declared mutations."""

from pyspark.sql import Column, DataFrame, functions as F

from changeproof.functions.canonical import (
    canonical_json, compared_image, first_segments, image_map, table_name,
)
from changeproof.operators.scale import (
    SLICE_WIDTH, Running, cut_lineage, event_order, event_slice, running_totals,
)
from changeproof.schema import WINDOW


def expectation_groups(expectations: DataFrame) -> DataFrame:
    """One row per (window, table, op) with its declarations in order.

    Declarations of different groups can never match the same event.
    """
    entry = F.struct(
        "exp_idx",
        "entity",
        F.greatest(F.coalesce(F.col("count"), F.lit(0)), F.lit(0)).cast("long").alias("count"),
        F.map_entries("where").alias("where"),
        "changed",
    )
    grouped = expectations.groupBy(
        *WINDOW, table_name(F.col("entity")).alias("table_name"), "op"
    ).agg(F.array_sort(F.collect_list(entry)).alias("declared"))
    return grouped.withColumn(
        "declared",
        F.transform(
            "declared",
            lambda e, i: F.struct(
                i.alias("pos"),
                e["exp_idx"].alias("exp_idx"),
                e["entity"].alias("entity"),
                e["count"].alias("count"),
                e["where"].alias("where"),
                e["changed"].alias("changed"),
            ),
        ),
    )


def _declaration_matches(e: Column, row: Column, changed: Column) -> Column:
    null = F.lit("null")
    entity = (e["entity"] == F.col("entity")) | (e["entity"] == F.col("table_name"))
    where = e["where"].isNull() | (
        F.col("__has_row")
        & F.forall(
            e["where"],
            lambda w: F.coalesce(F.try_element_at(row, w["key"]), null)
            == F.coalesce(canonical_json(w["value"]), w["value"], null),
        )
    )
    fields = e["changed"].isNull() | (F.size(F.array_except(e["changed"], changed)) == 0)
    return entity & where & fields


def match_expectations(events: DataFrame, expectations: DataFrame) -> DataFrame:
    """Events that match at least one declaration, with `candidates` in declared order."""
    groups = expectation_groups(expectations)
    joined = events.withColumn("table_name", table_name(F.col("entity"))).join(
        groups, [*WINDOW, "table_name", "op"]
    )
    image = compared_image(F.col("op"), F.col("key"), F.col("before"), F.col("after"))
    joined = joined.withColumn("__row", image_map(image))
    joined = joined.withColumn("__has_row", F.col("__row").isNotNull())
    joined = joined.withColumn("__changed", F.coalesce(first_segments(F.col("paths")), F.array().cast("array<string>")))
    chosen = F.filter("declared", lambda e: _declaration_matches(e, F.col("__row"), F.col("__changed")))
    candidates = F.transform(
        chosen,
        lambda e: F.struct(e["pos"].alias("pos"), e["exp_idx"].alias("exp_idx"), e["count"].alias("count")),
    )
    return (
        joined.withColumn("candidates", candidates)
        .filter(F.size("candidates") > 0)
        .drop("declared", "__row", "__has_row", "__changed")
    )


def allocation_rounds(expectations: DataFrame) -> int:
    """The most declarations any (window, table, op) has: one scalar read on the driver."""
    per_group = expectations.groupBy(*WINDOW, table_name(F.col("entity")).alias("t"), "op").count()
    return per_group.agg(F.max("count")).first()[0] or 0


def allocate_expected(
    events: DataFrame, expectations: DataFrame, width: int = SLICE_WIDTH, matched: DataFrame | None = None
) -> DataFrame:
    """Rows (window, idx, exp_idx): each event goes to its first declaration with budget left.

    Taking the declarations of a group one after another, each its first `count` matches that
    are still free, gives the same result as walking the events, and needs no sequential pass.
    The i-th declarations of all groups share round i. Events that are settled leave the pool.
    """
    matched = match_expectations(events, expectations) if matched is None else matched
    pool = matched.select(*WINDOW, "idx", "seq", "table_name", "op", "candidates")
    rounds = allocation_rounds(expectations)
    result = [*WINDOW, "idx", "exp_idx"]
    if rounds == 0:
        return pool.withColumn("exp_idx", F.lit(None).cast("int")).select(*result).limit(0)

    done = []
    for pos in range(rounds):
        mine = F.filter("candidates", lambda c: c["pos"] == pos)
        mine = F.when(F.size(mine) > 0, mine[0])
        eligible = F.coalesce(mine["count"] > 0, F.lit(False))
        ranked = running_totals(
            pool, [*WINDOW, "table_name", "op"], event_order(), event_slice(width), {"taken": Running(eligible)}
        )
        fits = eligible & (F.col("taken") <= mine["count"])
        ranked = ranked.withColumn("exp_idx", F.when(fits, mine["exp_idx"]))
        if pos + 1 < rounds:
            # Both the settled and the open rows are read from here.
            ranked = cut_lineage(ranked)
        done.append(ranked.filter(F.col("exp_idx").isNotNull()).select(*result))
        pool = ranked.filter(
            F.col("exp_idx").isNull() & F.exists("candidates", lambda c: c["pos"] > pos)
        ).drop("taken", "exp_idx")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def shortfalls(expectations: DataFrame, allocation: DataFrame) -> DataFrame:
    """Declarations whose budget was not used up."""
    used = allocation.groupBy(*WINDOW, "exp_idx").agg(F.count("*").alias("matched"))
    budget = F.greatest(F.coalesce(F.col("count"), F.lit(0)), F.lit(0)).cast("long")
    return (
        expectations.withColumn("expected", budget)
        .join(used, [*WINDOW, "exp_idx"], "left")
        .withColumn("matched", F.coalesce("matched", F.lit(0)))
        .withColumn("missing", F.col("expected") - F.col("matched"))
        .filter(F.col("missing") > 0)
        .select(*WINDOW, "exp_idx", "entity", "op", "expected", "matched", "missing", "changed")
    )


def time_to_converge(
    events: DataFrame,
    expectations: DataFrame,
    starts: DataFrame,
    timeout_ms: int = 10_000,
    width: int = SLICE_WIDTH,
    matched: DataFrame | None = None,
) -> DataFrame:
    """When every declaration of a window had its count of matching events, or a miss.

    `events` carry `at_ms`, `starts[window, start_ms]` the moment of the action.
    """
    matched = match_expectations(events, expectations) if matched is None else matched
    hits = matched.select(*WINDOW, "idx", "at_ms", F.explode("candidates").alias("c")).select(
        *WINDOW, "idx", "at_ms", F.col("c.exp_idx").alias("exp_idx"), F.col("c.count").alias("count")
    )
    ranked = running_totals(
        hits,
        [*WINDOW, "exp_idx"],
        [F.col("at_ms"), F.col("idx")],
        F.floor(F.col("at_ms") / width),
        {"seen": Running(F.lit(1))},
    )
    met = (
        ranked.filter(F.col("seen") == F.col("count"))
        .groupBy(*WINDOW, "exp_idx")
        .agg(F.min("at_ms").alias("met_ms"))
    )
    per_window = (
        expectations.filter(F.col("count") > 0)
        .select(*WINDOW, "exp_idx")
        .join(met, [*WINDOW, "exp_idx"], "left")
        .groupBy(*WINDOW)
        .agg(
            F.count("*").alias("declared"),
            F.count("met_ms").alias("met"),
            F.max("met_ms").alias("last_ms"),
        )
    )
    elapsed = F.greatest(F.lit(0), F.col("last_ms") - F.col("start_ms"))
    ok = (F.coalesce("met", F.lit(0)) == F.coalesce("declared", F.lit(0))) & (
        F.coalesce(elapsed, F.lit(0)) <= timeout_ms
    )
    return (
        starts.join(per_window, WINDOW, "left")
        .withColumn("ok", ok)
        .withColumn("elapsed_ms", F.when(ok, F.coalesce(elapsed, F.lit(0))).otherwise(F.lit(timeout_ms)).cast("long"))
        .select(*WINDOW, F.coalesce("declared", F.lit(0)).alias("declared"), F.coalesce("met", F.lit(0)).alias("met"), "ok", "elapsed_ms")
    )
