"""Health of rules over runs, kept in a table store: each run's counts are published once, whole, and read back in the order of the runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from changeproof.errors import Refused
from changeproof.operators.rules import dead_rules
from changeproof.schema import DEAD_RULE_RUNS
from changeproof.sinks.store import TableStore

COLUMNS = ["rule_id", "rule_hash", "run_idx", "suppressed", "over_budget"]


class HealthStore:
    """A place for rule counts. Runs that end at once do not lose each other's counts: each publishes tables of its own."""

    def __init__(self, store: TableStore):
        self.store = store

    def record(self, run: str, run_idx: int, counts: DataFrame) -> bool:
        """counts(rule_id, rule_hash, suppressed, over_budget) of one run; False, and nothing changes, if the run is recorded already.

        Null counts are 0. A rule that is counted twice, or has no id, is refused.
        """
        attempt = self.store.attempt()
        number = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias(c)
        back = self.store.stage(attempt, "rule_counts", counts.select(F.col("rule_id").cast("string"), F.col("rule_hash").cast("string"), F.lit(run_idx).cast("long").alias("run_idx"), number("suppressed"), number("over_budget")))
        bad = back.groupBy("rule_id", "rule_hash").count().where("count > 1 OR rule_id IS NULL").head()
        if bad is not None:
            raise Refused("E_RULE_COUNTS", "each rule is counted once and by its id", rule_id=bad.rule_id)
        return self.store.publish(run, attempt)

    def history(self) -> DataFrame:
        """All recorded counts; none before the first run."""
        held = any("rule_counts" in m["tables"] for m in self.store.manifests())
        if not held:
            return self.store.spark.createDataFrame([], "rule_id string, rule_hash string, run_idx long, suppressed long, over_budget long")
        return self.store.read("rule_counts").select(*COLUMNS)

    def health(self, runs: int = DEAD_RULE_RUNS) -> DataFrame:
        """Each rule as it stands after its last run: runs without a fire, and whether it should go."""
        last = F.max_by(F.struct("zero_runs", "dead", "proposed_action"), "run_idx").alias("x")
        return dead_rules(self.history(), runs).groupBy("rule_id", "rule_hash").agg(F.max("run_idx").alias("run_idx"), last).select("rule_id", "rule_hash", "run_idx", "x.*")
