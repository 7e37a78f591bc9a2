"""The classification of every change of every window, and what follows from it."""

import datetime
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from changeproof.functions.canonical import canonical_json, table_name
from changeproof.operators import allocate, rules as rule_ops
from changeproof.operators.scale import SLICE_WIDTH, bounded, first_n
from changeproof.schema import BUCKETS, DELTA_CODES, WINDOW


@dataclass
class Delta:
    """Lazy results of one classification."""

    classified: DataFrame
    allocation: DataFrame
    shortfalls: DataFrame
    rule_stats: DataFrame
    cap_violations: DataFrame
    windows: DataFrame


def _typed_rules(rows: DataFrame, events: DataFrame, matched: DataFrame, rules: DataFrame, kinds: set, as_of: datetime.date, width: int) -> DataFrame:
    """Each row's winner among the typed rules, and the derived rules that are out of budget there."""
    if ("external_writer", "transaction") in kinds:
        rows = rule_ops.foreign_transaction(rows, rule_ops.scenario_transactions(events, matched))
    else:
        rows = rows.withColumn("own_tx", F.lit(True))
    if any(kind == "derived" for kind, _ in kinds):
        rows = rule_ops.rank_targets(rows, rule_ops.derived_budgets(events, rules), width)
    else:
        none = F.lit(None)
        rows = rows.withColumns(
            {"rank_table": none.cast("long"), "rank_entity": none.cast("long"), "budgets": none.cast("map<int,long>")}
        )
    return rule_ops.apply_rules(rows, rules, as_of)


def classify(
    events: DataFrame,
    expectations: DataFrame,
    rules: DataFrame,
    as_of: datetime.date,
    ruleset_id: str | None = None,
    width: int = SLICE_WIDTH,
    windows: DataFrame | None = None,
    engine: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
) -> Delta:
    """Put every event in exactly one bucket.

    `events` carry `ruleset_id`, or all use the one given. Images are read only where events
    meet declarations; what is shuffled afterwards is the narrow row. `windows` (and ruleset_id, if
    events carry it) adds windows that may have no event: declared windows always count.

    `engine` explains events in place of the typed rules: a function from (events, rules) to rows (window, idx, rule_id, kind).
    What a declaration took stays expected. Counts and caps follow from all its answers, as they do from the rules'; nothing is out of budget.
    """
    rule_ops.refuse_expired(rules, as_of)
    if ruleset_id is not None:
        events = events.withColumn("ruleset_id", F.lit(ruleset_id))
    events = events.withColumn("table_name", table_name(F.col("entity")))
    matched = allocate.match_expectations(events, expectations)
    allocation = allocate.allocate_expected(events, expectations, width, matched)

    narrow = events.select(
        *WINDOW, "idx", "seq", "ruleset_id", "entity", "table_name", "op", "tx_id", "actor"
    )
    rows = narrow.join(allocation, [*WINDOW, "idx"], "left")

    kinds = {
        (r["kind"], r["identity_by"])
        for r in rules.select("kind", "identity_by").distinct().collect()  # closed vocabularies
    }
    if engine is not None:
        ruled = rule_ops.engine_rules(rows, engine(events, rules), rules)
    else:
        ruled = _typed_rules(rows, events, matched, rules, kinds, as_of, width)

    bucket = (
        F.when(F.col("exp_idx").isNotNull(), "expected")
        .when(F.col("winner").isNull(), "unexplained")
        .when(F.col("winner.kind") == "external_writer", "suppressed_external")
        .otherwise("explained")
    )
    classified = ruled.withColumn("bucket", bucket)
    unexpected = F.col("exp_idx").isNull()
    classified = classified.withColumns(
        {
            "rule_id": F.when(unexpected, F.col("winner.id")),
            "rule_kind": F.when(unexpected, F.col("winner.kind")),
        }
    )
    stripped = None
    if any(kind == "volatile_columns" for kind, _ in kinds):
        stripped = rule_ops.strip_volatile(events, rules)
    known = events.select(*WINDOW, "ruleset_id")
    if ruleset_id is not None:
        declared = expectations.select(*WINDOW)
        declared = declared if windows is None else declared.unionByName(windows.select(*WINDOW))
        known = known.unionByName(declared.withColumn("ruleset_id", F.lit(ruleset_id)))
    elif windows is not None:
        known = known.unionByName(windows.select(*WINDOW, "ruleset_id"))
    windows = known.distinct()
    stats = rule_ops.rule_stats(classified, stripped, rules, windows)
    return Delta(
        classified.select(
            *WINDOW, "idx", "seq", "ruleset_id", "entity", "op", "tx_id", "bucket", "exp_idx", "rule_id", "rule_kind"
        ),
        allocation,
        allocate.shortfalls(expectations, allocation),
        stats,
        rule_ops.enforce_caps(stats),
        windows,
    )


def bucket_counts(classified: DataFrame, by: list[str] = WINDOW) -> DataFrame:
    return classified.groupBy(*by).agg(
        F.count("*").alias("total"), *[F.count_if(F.col("bucket") == b).alias(b) for b in BUCKETS]
    )


def totality_problems(events: DataFrame, classified: DataFrame) -> DataFrame:
    """Windows whose events are not all in exactly one known bucket. Must be empty."""
    captured = events.groupBy(*WINDOW).agg(F.count("*").alias("captured"))
    counted = classified.groupBy(*WINDOW).agg(
        F.count("*").alias("classified"), F.count_if(F.col("bucket").isin(BUCKETS)).alias("known")
    )
    return (
        captured.join(counted, WINDOW, "full")
        .filter(~(F.col("captured").eqNullSafe(F.col("classified")) & F.col("captured").eqNullSafe(F.col("known"))))
    )


def failure_reasons(unexplained: Column, cap_violations: Column, expired: Column) -> Column:
    return F.array_compact(
        F.array(
            F.when(unexplained > 0, F.lit("unexplained_changes")),
            F.when(cap_violations > 0, F.lit("rule_too_broad")),
            F.when(expired > 0, F.lit("expired_rules")),
        )
    )


def window_verdicts(delta: Delta) -> DataFrame:
    """Counts and failure reasons per window. The captured count is always shown."""
    broken = delta.cap_violations.groupBy(*WINDOW).agg(F.count("*").alias("broken"))
    reasons = failure_reasons(F.col("unexplained"), F.coalesce("broken", F.lit(0)), F.lit(0))
    counts = delta.windows.select(*WINDOW).distinct().join(bucket_counts(delta.classified), WINDOW, "left")
    return (
        counts.fillna(0, ["total", *BUCKETS])
        .join(broken, WINDOW, "left")
        .withColumn("failure_reasons", reasons)
        .withColumn("failed", F.size("failure_reasons") > 0)
        .drop("broken")
    )


def group_unexplained(classified: DataFrame, events: DataFrame, per_group: int = 5) -> tuple[DataFrame, DataFrame]:
    """Unexplained changes by entity and op: the groups, and the first rows of each.

    Only the sampled rows are joined back to their images.
    """
    bad = classified.filter(F.col("bucket") == "unexplained")
    groups = (
        bad.groupBy(*WINDOW, "entity", "op")
        .agg(F.count("*").alias("count"))
        .withColumn("omitted", F.greatest(F.col("count") - per_group, F.lit(0)))
    )
    samples = first_n(bad.select(*WINDOW, "entity", "op", "idx"), [*WINDOW, "entity", "op"], ["idx"], per_group)
    detail = events.select(*WINDOW, "idx", "key", "before", "after", "paths")
    rows = detail.join(samples, [*WINDOW, "idx"])
    unavailable = F.col("key").isNull() | (F.col("key") == "{}")
    declared = F.array_sort(F.array_distinct(F.transform("paths", lambda p: F.array_join(p, "."))))
    own = F.json_object_keys(F.coalesce("after", "before"))
    columns = F.when(F.size("paths") > 0, declared).otherwise(F.array_sort(own))
    return groups, rows.select(
        *WINDOW,
        "entity",
        "op",
        F.col("rank").alias("sample"),
        "idx",
        F.when(unavailable, "key unavailable").otherwise(canonical_json(F.col("key"))).alias("key_text"),
        columns.alias("columns"),
        F.when(unavailable, "the capture carries no row identity").alias("note"),
    )


def order_groups(groups: DataFrame) -> DataFrame:
    return groups.orderBy(*WINDOW, F.col("count").desc(), "entity", "op")


def fidelity_gaps(
    events: DataFrame, expectations: DataFrame, before_images: str | None = None
) -> DataFrame:
    """Declarations on changed columns whose events, or whose source, lack full images."""
    wanted = expectations.filter(F.coalesce(F.size("changed"), F.lit(0)) > 0).withColumn(
        "table_name", table_name(F.col("entity"))
    )
    partial = (
        events.filter(F.col("fidelity").isin("key_only", "value_only"))
        .withColumn("event_table", table_name(F.col("entity")))
        .groupBy(*WINDOW, F.col("entity").alias("event_entity"), "event_table", F.col("op").alias("event_op"))
        .agg(F.min_by("fidelity", F.struct("idx")).alias("fidelity"), F.min("idx").alias("first_idx"))
    )
    on = [wanted[c] == partial[c] for c in WINDOW] + [
        wanted["table_name"] == partial["event_table"],
        wanted["op"] == partial["event_op"],
        (wanted["entity"] == partial["event_entity"]) | (wanted["entity"] == partial["event_table"]),
    ]
    joined = wanted.join(partial, on, "left").select(
        *[wanted[c] for c in WINDOW], wanted["exp_idx"], wanted["entity"], wanted["op"], "fidelity", "first_idx"
    )
    worst = joined.groupBy(*WINDOW, "exp_idx", "entity", "op").agg(
        F.min_by("fidelity", "first_idx").alias("fidelity")
    )
    source = before_images if before_images in ("key_only", "none") else None
    return worst.withColumn("fidelity", F.coalesce("fidelity", F.lit(source))).filter(
        F.col("fidelity").isNotNull()
    )


def assert_delta(
    delta: Delta,
    events: DataFrame,
    expectations: DataFrame,
    rules: DataFrame,
    as_of: datetime.date,
    require_no_unexplained: bool = True,
    before_images: str | None = None,
) -> DataFrame:
    """All violations of all windows, in code order; `rank` 0 is the code that fails the window."""
    null_s, null_l = F.lit(None).cast("string"), F.lit(None).cast("long")

    def shape(df, code, subject=null_s, op=null_s, expected=null_l, observed=null_l, detail=null_s):
        return df.select(
            *WINDOW,
            F.lit(code).alias("code"),
            subject.alias("subject"),
            op.alias("op"),
            expected.cast("long").alias("expected"),
            observed.cast("long").alias("observed"),
            detail.alias("detail"),
        )

    c = F.col
    parts = [
        shape(delta.shortfalls, DELTA_CODES[0], c("entity"), c("op"), c("expected"), c("matched"), c("exp_idx").cast("string")),
        shape(delta.cap_violations, DELTA_CODES[2], c("id"), null_s, c("cap"), c("count"), c("reason")),
        shape(fidelity_gaps(events, expectations, before_images), DELTA_CODES[4], c("entity"), c("op"), null_l, null_l, c("fidelity")),
    ]
    if require_no_unexplained:
        counts = bucket_counts(delta.classified).filter(c("unexplained") > 0)
        parts.append(shape(counts, DELTA_CODES[1], observed=c("unexplained")))
    expired = rule_ops.expiry(rules, as_of).filter(c("state") == "expired")
    used = delta.rule_stats.select(*WINDOW, "ruleset_id").distinct().join(bounded(expired, "rules"), "ruleset_id")
    parts.append(shape(used, DELTA_CODES[3], c("id"), detail=c("expires").cast("string")))

    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return rank_violations(found)


def code_rank(code: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in DELTA_CODES]), code) - 1


def rank_violations(violations: DataFrame) -> DataFrame:
    """Mark the primary code of each window: the first in code order."""
    ranked = violations.withColumn("code_rank", code_rank(F.col("code")).cast("long"))
    first = ranked.groupBy(*WINDOW).agg(F.min("code_rank").alias("first_rank"))
    return (
        ranked.join(first, WINDOW)
        .withColumn("is_primary", F.col("code_rank") == F.col("first_rank"))
        .drop("first_rank")
    )
