"""Run records as fact tables: raw facts are staged, what follows from them is worked out from what was read back, and only records
that agree with themselves are published."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from changeproof.errors import Refused
from changeproof.operators.suite import tally_results
from changeproof.schema import RESULTS
from changeproof.sinks.store import TableStore

SCENARIO = ["run_id", "scenario_id", "surface"]
#: The four places that a change can go to.
BUCKETS = ("expected", "explained", "suppressed_external", "unexplained")
#: What a record may state of itself and must then agree with its facts.
DERIVED = ("total", *RESULTS, "status", "exit_code", *BUCKETS)


def record_problems(scenarios: DataFrame, buckets: DataFrame, rules: DataFrame) -> DataFrame:
    """(run_id, scenario_id, surface, problem), one row for each thing that a record says and cannot mean.

    scenarios(SCENARIO, result, missing array, error_code, captured), buckets(SCENARIO, bucket, n), rules(SCENARIO, ...).
    """
    known = scenarios.select(*SCENARIO, F.lit(True).alias("known")).distinct()
    summed = buckets.groupBy(*SCENARIO).agg(F.sum("n").alias("n"))
    both = scenarios.join(summed, SCENARIO, "left")
    n_missing = F.coalesce(F.size("missing"), F.lit(0))
    skipped = F.col("result") == "skipped"
    checks: dict[str, Column] = {
        "unknown_result": ~F.coalesce(F.col("result").isin(*RESULTS), F.lit(False)),
        "skipped_names_nothing": skipped & (n_missing <= 0),
        "only_skipped_may_miss": ~skipped & (n_missing > 0),
        "infra_error_without_code": (F.col("result") == "infra_error") & F.col("error_code").isNull(),
        "buckets_differ_from_captured": F.col("captured").isNotNull() & (F.coalesce("n", F.lit(0)) != F.col("captured")),
    }
    told = F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in checks.items())))
    own = both.select(*SCENARIO, F.explode(told).alias("problem"))
    twice = scenarios.groupBy(*SCENARIO).count().where("count > 1").select(*SCENARIO, F.lit("scenario_twice").alias("problem"))
    facts = buckets.select(*SCENARIO, F.when(~F.coalesce(F.col("bucket").isin(*BUCKETS), F.lit(False)), F.lit("unknown_bucket")).alias("problem"))
    strange = facts.where("problem IS NOT NULL").distinct()
    lost = buckets.select(*SCENARIO).unionByName(rules.select(*SCENARIO)).distinct().join(known, SCENARIO, "left").where("known IS NULL")
    return own.unionByName(twice).unionByName(strange).unionByName(lost.select(*SCENARIO, F.lit("facts_without_scenario").alias("problem")))


def derive_runs(scenarios: DataFrame, buckets: DataFrame, fail_on_skip: bool = True) -> DataFrame:
    """One row a run: counts of results, status, exit code and counts of changes (null where the run has none)."""
    counts = tally_results(scenarios, ["run_id"], fail_on_skip)
    changes = buckets.groupBy("run_id").agg(*(F.sum(F.when(F.col("bucket") == b, F.col("n")).otherwise(0)).alias(b) for b in BUCKETS))
    return counts.join(changes, "run_id", "left").select("run_id", *DERIVED)


def derive_requirements(scenarios: DataFrame) -> DataFrame:
    """(run_id, requirement, scenarios): every requirement that a run covers, and by how many of its scenarios."""
    each = scenarios.select("run_id", "scenario_id", F.explode("requirements").alias("requirement")).distinct()
    return each.groupBy("run_id", "requirement").agg(F.count("*").alias("scenarios"))


def merge_rules(rules: DataFrame) -> DataFrame:
    """One row for each (run_id, rule_id, kind, entity): sums of suppressed and over_budget, the first scenario's cap, and
    whether any said dead or expired."""
    first = F.min_by("cap", F.struct("scenario_id", "surface"))
    said = lambda c: F.coalesce(F.bool_or(c), F.lit(False)).alias(c)
    return rules.groupBy("run_id", "rule_id", "kind", "entity").agg(
        F.sum(F.coalesce("suppressed", F.lit(0))).alias("suppressed"), F.sum(F.coalesce("over_budget", F.lit(0))).alias("over_budget"), first.alias("cap"), said("dead"), said("expired")
    )


def drift(stated: DataFrame, derived: DataFrame) -> DataFrame:
    """(run_id, field, stated, derived) where a run states something else than its facts say; a null states nothing."""
    fields = [c for c in DERIVED if c in stated.columns]
    both = stated.select("run_id", *(F.col(c).cast("string").alias(f"s_{c}") for c in fields)).join(derived.select("run_id", *(F.col(c).cast("string").alias(f"d_{c}") for c in fields)), "run_id", "left")
    each = F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"s_{c}").alias("stated"), F.col(f"d_{c}").alias("derived")) for c in fields))
    return both.select("run_id", F.explode(each).alias("x")).select("run_id", "x.*").where("stated IS NOT NULL AND NOT stated <=> derived")


def _refuse(rows: DataFrame, message: str) -> None:
    found = rows.limit(20).collect()
    if found:
        raise Refused("E_RUN_RECORD_INVALID", message, first=[r.asDict() for r in found])


def write_run_facts(store: TableStore, name: str, scenarios: DataFrame, buckets: DataFrame, rules: DataFrame, stated: DataFrame | None = None, fail_on_skip: bool = True) -> bool:
    """Publish the facts of some runs under a name, with what follows from them; False if the name was published before.

    The three fact tables are staged; problems, drift and derived tables come from what is read back. Refused records leave nothing
    that a reader sees. Tables: scenarios, buckets, rules, runs, run_requirements, run_rules.
    """
    attempt = store.attempt()
    own = {t: store.stage(attempt, t, df) for t, df in (("scenarios", scenarios), ("buckets", buckets), ("rules", rules))}
    _refuse(record_problems(own["scenarios"], own["buckets"], own["rules"]), "the record contradicts itself")
    runs = store.stage(attempt, "runs", derive_runs(own["scenarios"], own["buckets"], fail_on_skip))
    if stated is not None:
        _refuse(drift(stated, runs), "a derived field drifted")
    store.stage(attempt, "run_requirements", derive_requirements(own["scenarios"]))
    store.stage(attempt, "run_rules", merge_rules(own["rules"]))
    return store.publish(name, attempt)
