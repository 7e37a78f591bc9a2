"""Suites: results, exit codes, steps, telemetry and timing."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from changeproof.schema import RESULTS

# Exit codes of a run.
EXIT_USAGE, EXIT_INFRA, EXIT_FAIL, EXIT_SKIPPED, EXIT_OK = 3, 2, 1, 4, 0


def tally_results(results: DataFrame, by: list[str], fail_on_skip: bool = False) -> DataFrame:
    """Counts of the five outcomes per run, its status and its exit code; infra_error beats fail."""
    counts = results.groupBy(*by).agg(F.count("*").alias("total"), *[F.count_if(F.col("result") == r).alias(r) for r in RESULTS])
    status = F.when(F.col("infra_error") > 0, "infra_error").when(F.col("fail") > 0, "fail").otherwise("pass")
    code = F.when(F.col("infra_error") > 0, EXIT_INFRA).when(F.col("fail") > 0, EXIT_FAIL).when(F.lit(fail_on_skip) & (F.col("skipped") > 0), EXIT_SKIPPED).otherwise(EXIT_OK)
    return counts.withColumns({"status": status, "exit_code": code})


def suite_by_surface(results: DataFrame, by: list[str]) -> DataFrame:
    """Tests, failures, errors, skipped and time of each surface; quarantined ones count as skipped."""
    return results.groupBy(*by, "surface").agg(
        F.count("*").alias("tests"), F.count_if(F.col("result") == "fail").alias("failures"), F.count_if(F.col("result") == "infra_error").alias("errors"),
        F.count_if(F.col("result").isin("skipped", "quarantined")).alias("skipped"), F.sum("duration_ms").alias("time_ms"),
    )


def first_failing_step(steps: DataFrame, by: list[str]) -> DataFrame:
    """The first failed or timed-out step of each scenario that has one, and its error."""
    bad = steps.filter(F.col("status").isin("failed", "timed_out"))
    return bad.groupBy(*by).agg(F.min("step").alias("step"), F.min_by("status", "step").alias("status"), F.min_by("error", "step").alias("error"))


def combine_steps(steps: DataFrame, by: list[str]) -> DataFrame:
    """The last known quiet time and ruleset hash of each scenario, and how many steps it had and timed out."""
    known = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("step")))
    return steps.groupBy(*by).agg(
        F.count("*").alias("steps"), F.count_if(F.col("status") == "timed_out").alias("timed_out"), known("quiet_ms").alias("last_quiet_ms"), known("ruleset_hash").alias("last_ruleset_hash")
    )


def escape_hatch_uses(steps: DataFrame, by: list[str]) -> DataFrame:
    """How often each scenario used raw operations, and which (sorted; the set of names is a closed vocabulary)."""
    return steps.filter(F.col("kind") == "raw").groupBy(*by).agg(F.count("*").alias("uses"), F.array_join(F.array_sort(F.collect_set("operation")), ",").alias("operations"))


def escape_use_reconcile(used: DataFrame, declared: DataFrame, by: list[str]) -> DataFrame:
    """Scenarios whose uses differ from the declared count, or that are not declared at all."""
    both = used.select(*by, "uses").join(declared.select(*by, F.col("uses").alias("declared")), by, "full")
    problem = F.when(F.col("declared").isNull(), "unknown_scenario").otherwise("count_mismatch")
    return both.filter(~F.coalesce("uses", F.lit(0)).eqNullSafe(F.col("declared"))).select(*by, F.coalesce("uses", F.lit(0)).alias("uses"), "declared", problem.alias("problem"))


def consensus(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """The one value if all rows of a group agree (nulls do not vote), else null. Minimum and maximum tell."""
    low, high = F.min(column), F.max(column)
    return df.groupBy(*by).agg(F.when(low == high, low).alias(column))


def run_invariants(records: DataFrame) -> DataFrame:
    """Records that contradict themselves: one row for each broken rule."""
    checks = {
        "buckets_do_not_sum": F.col("expected") + F.col("explained") + F.col("suppressed") + F.col("unexplained") != F.col("captured"),
        "skipped_without_capability": (F.col("result") == "skipped") & F.col("capability").isNull(),
        "infra_error_without_code": (F.col("result") == "infra_error") & F.col("error_code").isNull(),
        "infra_error_with_failed_step": (F.col("result") == "infra_error") & (F.col("failed_steps") > 0),
    }
    found = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks.items()]))
    return records.withColumn("problem", F.explode(found))


def finished(records: DataFrame) -> DataFrame:
    """Records that are verdicts: neither in progress nor interrupted."""
    return records.filter(~F.coalesce(F.col("state").isin("in_progress", "interrupted"), F.lit(False)))


def quiet_from(rows: DataFrame, by: list[str], at: str, tie: str, quiet_ms: int) -> DataFrame:
    """From when each stream is silent for quiet_ms: before its first gap of that length, else after its last row."""
    order = Window.partitionBy(*by).orderBy(at, tie)
    gap = F.col(at) - F.lag(at).over(order)
    seen = rows.withColumn("gap", gap).groupBy(*by).agg(
        F.count("*").alias("n"), F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.min(F.when(F.col("gap") >= quiet_ms, F.col(at) - F.col("gap"))).alias("quiet_at")
    )
    return seen.withColumns({"settled_ms": F.coalesce("quiet_at", "last_at") - F.col("first_at"), "quiet_at_end": F.col("quiet_at").isNull()})


def pair_next(rows: DataFrame, by: str, at: str, row_id: str, request: Column, failure: Column) -> DataFrame:
    """Each request with the next row of its stream, if that is not a request again."""
    order = Window.partitionBy(by).orderBy(at, row_id)
    marked = rows.select(by, at, row_id, request.alias("is_request"), failure.alias("is_failure"))
    ahead = marked.withColumns({"next_id": F.lead(row_id).over(order), "next_at": F.lead(at).over(order), "next_request": F.lead("is_request").over(order), "next_failure": F.lead("is_failure").over(order)})
    answered = F.coalesce(~F.col("next_request"), F.lit(False))
    return ahead.filter("is_request").select(
        by, F.col(row_id).alias("request_id"), F.when(answered, F.col("next_id")).alias("response_id"), F.when(answered, F.col("next_at") - F.col(at)).alias("duration_ms"),
        F.when(~answered, "pending").when(F.col("next_failure"), "failed").otherwise("ok").alias("outcome"),
    )


def pair_by_id(requests: DataFrame, replies: DataFrame, key: str = "request_id") -> DataFrame:
    """requests(key, at_ms, ...) to (key, request, reply): each request's other columns, and status, content_type, failure, duration_ms and outcome of what came of it.

    ``replies(key, at_ms, status, content_type, failure)`` are responses, or failed requests where failure is not null. Of several the last counts, of its
    kind; the duration ends with the last of any kind and is never negative. Replies to no request are left out, a null key is never answered.
    A request has no answer (pending), failed, or was answered with any status (ok); replies are reduced to one row a key before they meet requests.
    """
    failed = F.col("failure").isNotNull()
    last = lambda value, kind: F.max_by(value, F.when(kind, F.struct("at_ms", value)))
    came = replies.where(F.col(key).isNotNull()).groupBy(key).agg(
        last(F.struct("status", "content_type"), ~failed).alias("response"), last(F.col("failure"), failed).alias("failure"), F.max("at_ms").alias("ended_ms")
    )
    rows = requests.select(F.col(key), F.struct(*(c for c in requests.columns if c != key)).alias("request"))
    took = F.when(F.col("ended_ms").isNotNull(), F.greatest(F.col("ended_ms") - F.col("request.at_ms"), F.lit(0).cast("long")))
    outcome = F.when(F.col("failure").isNotNull(), "failed").when(F.col("ended_ms").isNotNull(), "ok").otherwise("pending")
    return rows.join(came, key, "left").select(key, "request", F.struct(F.col("response.status"), F.col("response.content_type"), "failure", took.alias("duration_ms"), outcome.alias("outcome")).alias("reply"))
