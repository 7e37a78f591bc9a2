"""Typed rules: candidates, budgets, precedence, statistics, caps and health."""

import datetime

from pyspark.sql import Column, DataFrame, functions as F

from changeproof.errors import Refused
from changeproof.functions.canonical import path_key, path_matches, table_name
from changeproof.operators.scale import (
    SLICE_WIDTH, Running, event_order, event_slice, bounded, running_totals, salted_flag,
)
from changeproof.schema import (
    DEAD_RULE_RUNS, DEFAULT_RULE_CAP, EXPIRING_SOON_DAYS, RULE_KINDS, WINDOW,
)

# Precedence of the explaining kinds.
KIND_RANK = {"derived": 0, "external_writer": 1, "ignore": 2}


def kind_rank(kind: Column) -> Column:
    out = F.lit(9)
    for name, rank in KIND_RANK.items():
        out = F.when(kind == name, F.lit(rank)).otherwise(out)
    return out


def refuse_expired(rules: DataFrame, as_of: datetime.date) -> None:
    """An expired ignore rule stops the run before any bucket is computed."""
    gone = rules.filter((F.col("kind") == "ignore") & (F.col("expires") < F.lit(as_of))).limit(1).collect()
    if gone:
        raise Refused("E_RULE_EXPIRED", f"{gone[0]['id']} was valid until {gone[0]['expires']}")


def rules_by_table(rules: DataFrame) -> DataFrame:
    """Explaining rules per (ruleset, table), in precedence order."""
    entry = F.struct(
        kind_rank(F.col("kind")).alias("kind_rank"), "rule_pos", "id", "kind", "entity",
        "identity_by", "identity_not_equals", "rule_op", "expires",
    )
    return (
        rules.filter(F.col("kind").isin(list(KIND_RANK)))
        .groupBy("ruleset_id", table_name(F.col("entity")).alias("table_name"))
        .agg(F.array_sort(F.collect_list(entry)).alias("rules"))
    )


def derived_budgets(events: DataFrame, rules: DataFrame) -> DataFrame:
    """Budget per window and derived rule: its sources times per_source."""
    sources = events.groupBy(*WINDOW, "ruleset_id", "entity", "op").agg(F.count("*").alias("n"))
    sources = sources.withColumn("source_table", table_name(F.col("entity"))).withColumnRenamed("entity", "source")
    derived = rules.filter(F.col("kind") == "derived").select(
        "ruleset_id",
        "rule_pos",
        table_name(F.col("entity")).alias("table_name"),
        table_name(F.col("caused_entity")).alias("source_table"),
        F.col("caused_entity"),
        F.col("caused_op").alias("op"),
        "per_source",
    )
    hits = sources.join(bounded(derived, "rules"), ["ruleset_id", "source_table", "op"]).filter(
        (F.col("caused_entity") == F.col("source")) | (F.col("caused_entity") == F.col("source_table"))
    )
    return hits.groupBy(*WINDOW, "table_name", "rule_pos").agg(
        F.sum("n").alias("sources"), F.sum(F.col("n") * F.col("per_source")).alias("budget")
    )


def scenario_transactions(events: DataFrame, matched: DataFrame) -> DataFrame:
    """Transactions of the scenario itself: the harness's, and those of declared mutations."""
    harness = events.filter(F.col("actor.kind") == "harness").select(*WINDOW, "tx_id")
    declared = matched.select(*WINDOW, "tx_id")
    return harness.unionByName(declared).filter(F.col("tx_id").isNotNull()).distinct()


def foreign_transaction(events: DataFrame, own: DataFrame) -> DataFrame:
    """Flag `own_tx`; a transaction holding most rows is split over several partitions."""
    return salted_flag(events, own, [*WINDOW, "tx_id"], "own_tx", F.col("idx"))


def foreign_application(actor: Column, declared: Column) -> Column:
    name = F.nullif(actor["application_name"], F.lit(""))
    return F.coalesce(name != declared, F.lit(False))


def rank_targets(events: DataFrame, budgets: DataFrame, width: int = SLICE_WIDTH) -> DataFrame:
    """Place of every event among those of its table and of its entity, and the budgets there."""
    per_table = budgets.groupBy(*WINDOW, "table_name").agg(
        F.map_from_entries(F.collect_list(F.struct("rule_pos", "budget"))).alias("budgets")
    )
    one = F.lit(1)
    return running_totals(
        events,
        [*WINDOW, "table_name"],
        event_order(),
        event_slice(width),
        {"rank_table": Running(one), "rank_entity": Running(one, by=["entity"])},
        attach=per_table,
    )


def apply_rules(events: DataFrame, rules: DataFrame, as_of: datetime.date) -> DataFrame:
    """Add `winner` (the first rule that explains the event) and `over` (derived rules out of budget).

    Needs own_tx, rank_table, rank_entity and budgets. Rules ride along as one array per
    table, so no event is multiplied and no shuffle by event is needed.
    """
    rows = events.join(bounded(rules_by_table(rules), "rules"), ["ruleset_id", "table_name"], "left")

    def targets(r: Column) -> Column:
        return (r["entity"] == F.col("entity")) | (r["entity"] == F.col("table_name"))

    def within_budget(r: Column) -> Column:
        rank = F.when(r["entity"] == F.col("entity"), F.col("rank_entity")).otherwise(F.col("rank_table"))
        return rank <= F.coalesce(F.try_element_at("budgets", r["rule_pos"]), F.lit(0))

    def explains(r: Column) -> Column:
        external = F.when(
            r["identity_by"] == "transaction", F.col("tx_id").isNotNull() & ~F.col("own_tx")
        ).when(
            r["identity_by"] == "application_name",
            foreign_application(F.col("actor"), r["identity_not_equals"]),
        ).otherwise(False)
        ignored = (r["rule_op"].isNull() | (r["rule_op"] == F.col("op"))) & (r["expires"] >= F.lit(as_of))
        decided = (
            F.when(r["kind"] == "derived", within_budget(r))
            .when(r["kind"] == "external_writer", external)
            .otherwise(ignored)
        )
        return F.coalesce(targets(r) & decided, F.lit(False))

    rows = rows.withColumn("__won", F.filter("rules", explains))
    rows = rows.withColumn("winner", F.when(F.size("__won") > 0, F.col("__won")[0]))
    over = F.filter(
        "rules",
        lambda r: (r["kind"] == "derived")
        & targets(r)
        & ~within_budget(r)
        & F.coalesce(
            (F.col("winner.kind_rank") > 0) | (r["rule_pos"] < F.col("winner.rule_pos")), F.lit(True)
        ),
    )
    return rows.withColumn("over", F.transform(over, lambda r: r["rule_pos"])).drop("__won", "rules")


def engine_rules(events: DataFrame, found: DataFrame, rules: DataFrame) -> DataFrame:
    """Add `winner` and an empty `over` from an engine's own answers: found(window, idx, rule_id, kind).

    Of several answers for an event the rule that stands first in the ruleset counts, rules that the ruleset does not hold last,
    by id. A null kind is the rule's own; an answer without a rule explains nothing.
    """
    listed = rules.select("ruleset_id", F.col("id").alias("rule_id"), "rule_pos", F.col("kind").alias("rule_kind"))
    answers = events.select(*WINDOW, "idx", "ruleset_id").join(found.where("rule_id IS NOT NULL").select(*WINDOW, "idx", "rule_id", F.col("kind").alias("told")), [*WINDOW, "idx"])
    placed = answers.join(bounded(listed, "rules"), ["ruleset_id", "rule_id"], "left")
    one = F.struct(F.col("rule_pos").isNull().alias("unlisted"), "rule_pos", F.col("rule_id").alias("id"), F.coalesce("told", "rule_kind").alias("kind"))
    first = placed.groupBy(*WINDOW, "idx").agg(F.min(one).alias("winner"))
    return events.join(first, [*WINDOW, "idx"], "left").withColumn("over", F.array().cast("array<int>"))


def strip_volatile(events: DataFrame, rules: DataFrame) -> DataFrame:
    """Take volatile paths out of updates; the events themselves are classified like any other.

    `stripped` says which rule took which path: the first matching rule in ruleset order.
    """
    volatile = (
        rules.filter(F.col("kind") == "volatile_columns")
        .groupBy("ruleset_id", table_name(F.col("entity")).alias("table_name"))
        .agg(F.array_sort(F.collect_list(F.struct("rule_pos", "entity", "paths"))).alias("volatile"))
    )
    rows = events.withColumn("table_name", table_name(F.col("entity"))).join(
        bounded(volatile, "rules"), ["ruleset_id", "table_name"], "left"
    )
    none = F.array().cast("array<struct<rule_pos:int,entity:string,paths:array<string>>>")
    applies = F.filter(
        F.when(F.col("op") == "update", F.coalesce("volatile", none)).otherwise(none),
        lambda r: (r["entity"] == F.col("entity")) | (r["entity"] == F.col("table_name")),
    )

    def taker(path: Column) -> Column:
        hits = F.filter(applies, lambda r: F.exists(r["paths"], lambda p: path_matches(path, p)))
        return F.when(F.size(hits) > 0, hits[0]["rule_pos"])

    marked = F.transform("paths", lambda p: F.struct(p.alias("path"), taker(p).alias("rule_pos")))
    rows = rows.withColumn("__marked", marked)
    kept = F.transform(F.filter("__marked", lambda m: m["rule_pos"].isNull()), lambda m: m["path"])
    stripped = F.transform(
        F.filter("__marked", lambda m: m["rule_pos"].isNotNull()),
        lambda m: F.struct(m["rule_pos"].alias("rule_pos"), path_key(m["path"]).alias("path")),
    )
    return rows.withColumns({"paths": kept, "stripped": stripped}).drop("__marked", "volatile")


def rule_stats(ruled: DataFrame, stripped: DataFrame | None, rules: DataFrame, windows: DataFrame) -> DataFrame:
    """Per window and rule: suppressed, over_budget and cap, rules that never fired included."""
    key = [*WINDOW, "ruleset_id", "rule_pos"]
    one, zero = F.lit(1), F.lit(0)
    marks = F.concat(
        F.when(F.col("winner").isNotNull(), F.array(F.struct(F.col("winner.rule_pos").alias("rule_pos"), one.alias("s"), zero.alias("o"))))
        .otherwise(F.array().cast("array<struct<rule_pos:int,s:int,o:int>>")),
        F.transform(F.coalesce("over", F.array().cast("array<int>")), lambda p: F.struct(p.alias("rule_pos"), zero.alias("s"), one.alias("o"))),
    )
    fired = ruled.select(*WINDOW, "ruleset_id", F.explode(marks).alias("m")).select(
        *WINDOW, "ruleset_id", "m.rule_pos", "m.s", "m.o"
    )
    if stripped is not None:
        paths = stripped.select(*WINDOW, "ruleset_id", F.explode("stripped").alias("m")).select(
            *WINDOW, "ruleset_id", "m.rule_pos", one.alias("s"), zero.alias("o")
        )
        fired = fired.unionByName(paths)
    counts = fired.groupBy(*key).agg(F.sum("s").alias("suppressed"), F.sum("o").alias("over_budget"))
    every = windows.select(*WINDOW, "ruleset_id").join(
        bounded(rules.select("ruleset_id", "rule_pos", "id", "kind", "entity", "cap"), "rules"), "ruleset_id"
    )
    return every.join(counts, key, "left").select(
        *key,
        "id",
        "kind",
        "entity",
        F.coalesce("suppressed", zero).cast("long").alias("suppressed"),
        F.coalesce("over_budget", zero).cast("long").alias("over_budget"),
        F.coalesce("cap", F.lit(DEFAULT_RULE_CAP)).cast("long").alias("cap"),
    )


def enforce_caps(stats: DataFrame) -> DataFrame:
    """Absolute cap and declared cardinality. Volatile rules suppress nothing and have no cap.

    `sources` and `per_source` are used when the statistics carry them.
    """
    cap = F.when(F.col("cap") > 0, F.col("cap")).otherwise(F.lit(DEFAULT_RULE_CAP)).cast("long")
    if {"sources", "per_source"} <= set(stats.columns):
        declared = F.when(
            (F.col("kind") == "derived") & (F.col("sources") > 0) & (F.col("per_source") > 0),
            F.col("sources") * F.col("per_source"),
        )
    else:
        declared = F.lit(None).cast("long")
    too_many = (F.col("over_budget") > 0) | F.coalesce(F.col("suppressed") > declared, F.lit(False))
    found = F.array_compact(
        F.array(
            F.when(
                too_many,
                F.struct(
                    F.lit("declared_cardinality").alias("reason"),
                    (F.col("suppressed") + F.col("over_budget")).alias("count"),
                    F.coalesce(declared, cap).alias("limit"),
                ),
            ),
            F.when(
                F.col("suppressed") > cap,
                F.struct(F.lit("absolute_cap").alias("reason"), F.col("suppressed").alias("count"), cap.alias("limit")),
            ),
        )
    )
    return (
        stats.filter(F.col("kind").isin(list(KIND_RANK)))
        .withColumn("v", F.explode(found))
        .select(
            *[c for c in stats.columns if c not in ("cap", "sources", "per_source")],
            "v.reason", "v.count", F.col("v.limit").alias("cap"),
        )
    )


def dead_rules(history: DataFrame, runs: int = DEAD_RULE_RUNS, width: int = SLICE_WIDTH) -> DataFrame:
    """Consecutive runs without a fire, per rule and rule hash, at every run.

    `history[rule_id, rule_hash, run_idx, suppressed, over_budget]`. An edited rule has a new
    hash and starts again.
    """
    key = ["rule_id", "rule_hash"]
    fired = F.coalesce("suppressed", F.lit(0)) + F.coalesce("over_budget", F.lit(0)) > 0
    at = F.floor(F.col("run_idx") / width)
    order = [F.col("run_idx")]
    rows = history.withColumn("fired", fired)
    rows = running_totals(rows, key, order, at, {"nth": Running(F.lit(1))})
    # The place of the last run that fired; the runs since then did not.
    fire = F.when(F.col("fired"), F.col("nth"))
    rows = running_totals(rows, key, order, at, {"last_fire": Running(fire, fn="max")})
    zero = F.col("nth") - F.coalesce("last_fire", F.lit(0))
    return rows.withColumn("zero_runs", zero.cast("long")).select(
        *key,
        "run_idx",
        "zero_runs",
        (F.col("zero_runs") >= runs).alias("dead"),
        F.when(F.col("zero_runs") >= runs, "delete_rule").alias("proposed_action"),
    )


def expiry(rules: DataFrame, as_of: datetime.date) -> DataFrame:
    """Ignore rules that expired, or do so within a week; the expiry day itself is valid."""
    days = F.datediff("expires", F.lit(as_of))
    state = F.when(days < 0, "expired").when(days <= EXPIRING_SOON_DAYS, "expiring_soon").otherwise("ok")
    return (
        rules.filter(F.col("kind") == "ignore")
        .select("ruleset_id", "id", "expires", days.cast("long").alias("days_until"), state.alias("state"))
    )


def ruleset_problems(rules: DataFrame, as_of: datetime.date) -> DataFrame:
    """What is wrong with a ruleset: ids, kinds, wildcards, expiry and missing parts."""
    ids = rules.groupBy("ruleset_id", "id").agg(F.count("*").alias("n")).filter("n > 1")
    twice = ids.select("ruleset_id", "id", F.lit("duplicate_id").alias("problem"))
    kind = F.col("kind")
    checks = {
        "invalid_id": ~F.coalesce(F.rlike("id", F.lit(r"^[a-z][a-z0-9_]*$")), F.lit(False)),
        "unknown_kind": ~F.coalesce(kind.isin(RULE_KINDS), F.lit(False)),
        "entity_missing": F.coalesce(F.col("entity") == "", F.lit(True)),
        "ignore_wildcard": (kind == "ignore") & F.coalesce(F.rlike("entity", F.lit(r"[*%]|_$")), F.lit(False)),
        "ignore_expired": (kind == "ignore") & F.coalesce(F.col("expires") < F.lit(as_of), F.lit(True)),
        "invalid_cap": F.coalesce(F.col("cap") <= 0, F.lit(False)),
        "paths_missing": (kind == "volatile_columns") & F.coalesce(F.size("paths") == 0, F.lit(True)),
        "cause_missing": (kind == "derived")
        & (F.col("caused_entity").isNull() | F.col("caused_op").isNull() | F.coalesce(F.col("per_source") <= 0, F.lit(True))),
        "identity_missing": (kind == "external_writer")
        & ~F.coalesce(F.col("identity_by").isin("transaction", "application_name"), F.lit(False)),
    }
    found = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks.items()]))
    each = rules.select("ruleset_id", "id", F.explode(found).alias("problem"))
    return each.unionByName(twice)


def unsupported_identity(rules: DataFrame, sources: DataFrame) -> DataFrame:
    """External-writer rules whose predicate a source cannot answer.

    `sources[driver, tx_attribution, application_name_attribution]`.
    """
    external = rules.filter(F.col("kind") == "external_writer").select("ruleset_id", "id", "identity_by")
    offered = sources.select(
        "driver",
        F.explode(
            F.array(
                F.struct(F.lit("transaction").alias("identity_by"), F.coalesce("tx_attribution", F.lit(False)).alias("offered")),
                F.struct(F.lit("application_name").alias("identity_by"), F.coalesce("application_name_attribution", F.lit(False)).alias("offered")),
            )
        ).alias("o"),
    ).select("driver", "o.identity_by", "o.offered")
    return external.join(bounded(offered.filter(~F.col("offered")), "sources"), "identity_by").select(
        "ruleset_id", "id", "driver", "identity_by"
    )
