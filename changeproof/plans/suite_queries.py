"""Run reporting: orders stand in as scenario results, events as steps."""

from pyspark.sql import functions as F

from changeproof.operators import suite as S
from changeproof.plans import derive as D
from changeproof.plans.register import Register

REGISTER = Register()
query = REGISTER.query

RESULTS_SQL = """r AS (
  SELECT 'run-' || year(o_orderdate) AS run_id, o_orderkey AS scenario_id, CASE o_orderkey % 3 WHEN 0 THEN 'web' WHEN 1 THEN 'phone' ELSE 'api' END AS surface, o_orderkey % 1000 AS duration_ms,
    CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' THEN 'fail' WHEN o_orderstatus = 'P' AND o_orderpriority = '2-HIGH' AND o_totalprice > 490000 THEN 'infra_error'
         WHEN o_orderstatus = 'P' AND o_orderpriority = '3-MEDIUM' THEN 'skipped' WHEN o_orderstatus = 'P' AND o_orderpriority = '5-LOW' THEN 'quarantined' ELSE 'pass' END AS result, o_totalprice
  FROM orders)"""


def results(spark, sf_dir):
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    result = (
        F.when((status == "F") & (priority == "1-URGENT"), "fail").when((status == "P") & (priority == "2-HIGH") & (F.col("o_totalprice") > 490000), "infra_error")
        .when((status == "P") & (priority == "3-MEDIUM"), "skipped").when((status == "P") & (priority == "5-LOW"), "quarantined").otherwise("pass")
    )
    third = F.col("o_orderkey") % 3
    return D.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("run-"), F.year("o_orderdate")).alias("run_id"), F.col("o_orderkey").alias("scenario_id"), F.when(third == 0, "web").when(third == 1, "phone").otherwise("api").alias("surface"),
        (F.col("o_orderkey") % 1000).alias("duration_ms"), result.alias("result"), "o_totalprice",
    )


@query(
    f"""WITH {RESULTS_SQL}, c AS (SELECT run_id, count(*) AS total, count_if(result = 'pass') AS pass, count_if(result = 'fail') AS fail, count_if(result = 'infra_error') AS infra_error,
      count_if(result = 'skipped') AS skipped, count_if(result = 'quarantined') AS quarantined FROM r GROUP BY 1)
    SELECT *, CASE WHEN infra_error > 0 THEN 'infra_error' WHEN fail > 0 THEN 'fail' ELSE 'pass' END AS status,
      CASE WHEN infra_error > 0 THEN 2 WHEN fail > 0 THEN 1 WHEN skipped > 0 THEN 4 ELSE 0 END AS exit_code FROM c"""
)
def exit_codes(spark, sf_dir):
    return S.tally_results(results(spark, sf_dir), ["run_id"], fail_on_skip=True)


@query(
    f"""WITH {RESULTS_SQL} SELECT run_id, surface, count(*) AS tests, count_if(result = 'fail') AS failures, count_if(result = 'infra_error') AS errors,
    count_if(result IN ('skipped', 'quarantined')) AS skipped, sum(duration_ms)::BIGINT AS time_ms FROM r GROUP BY ALL"""
)
def suite_by_surface(spark, sf_dir):
    return S.suite_by_surface(results(spark, sf_dir), ["run_id"])


@query(f"WITH {RESULTS_SQL} SELECT result, count(*) AS n FROM r GROUP BY ALL")
def verdict_histogram(spark, sf_dir):
    return results(spark, sf_dir).groupBy("result").agg(F.count("*").alias("n"))


STEPS_SQL = """s AS (
  SELECT 'user-' || user_id AS scenario_id, event_id AS step, CASE WHEN event_type = 'error' THEN 'failed' WHEN value > 80 THEN 'timed_out' ELSE 'passed' END AS status,
    CASE WHEN event_type = 'error' THEN 'E_' || event_id END AS error, CASE WHEN event_type = 'signup' THEN 'raw' ELSE 'op' END AS kind,
    'op_' || (CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) % 10) AS operation, CASE WHEN event_type = 'view' THEN event_id % 751 END AS quiet_ms,
    CASE WHEN event_type = 'click' THEN 'h' || (event_id % 2 * (user_id % 5)) END AS ruleset_hash
  FROM events)"""


def steps(spark, sf_dir):
    kind = F.col("event_type")
    return D.table(spark, sf_dir, "events").select(
        F.concat(F.lit("user-"), F.col("user_id")).alias("scenario_id"), F.col("event_id").alias("step"), F.when(kind == "error", "failed").when(F.col("value") > 80, "timed_out").otherwise("passed").alias("status"),
        F.when(kind == "error", F.concat(F.lit("E_"), F.col("event_id"))).alias("error"), F.when(kind == "signup", "raw").otherwise("op").alias("kind"),
        F.concat(F.lit("op_"), F.regexp_extract("props", "([0-9]+)", 1).cast("int") % 10).alias("operation"), F.when(kind == "view", F.col("event_id") % 751).alias("quiet_ms"),
        F.when(kind == "click", F.concat(F.lit("h"), F.col("event_id") % 2 * (F.col("user_id") % 5))).alias("ruleset_hash"),
    )


@query(f"WITH {STEPS_SQL} SELECT scenario_id, min(step) AS step, arg_min(status, step) AS status, arg_min_null(error, step) AS error FROM s WHERE status <> 'passed' GROUP BY ALL")
def first_failing_step(spark, sf_dir):
    return S.first_failing_step(steps(spark, sf_dir), ["scenario_id"])


@query(
    f"""WITH {STEPS_SQL} SELECT scenario_id, count(*) AS steps, count_if(status = 'timed_out') AS timed_out, max_by(quiet_ms, step) FILTER (quiet_ms IS NOT NULL) AS last_quiet_ms,
    max_by(ruleset_hash, step) FILTER (ruleset_hash IS NOT NULL) AS last_ruleset_hash FROM s GROUP BY ALL"""
)
def combine_steps(spark, sf_dir):
    return S.combine_steps(steps(spark, sf_dir), ["scenario_id"])


@query(f"WITH {STEPS_SQL} SELECT scenario_id, CASE WHEN min(ruleset_hash) = max(ruleset_hash) THEN min(ruleset_hash) END AS ruleset_hash FROM s GROUP BY ALL")
def ruleset_consensus(spark, sf_dir):
    return S.consensus(steps(spark, sf_dir), ["scenario_id"], "ruleset_hash")


@query(f"WITH {STEPS_SQL} SELECT scenario_id, count(*) AS uses, string_agg(DISTINCT operation, ',' ORDER BY operation) AS operations FROM s WHERE kind = 'raw' GROUP BY ALL")
def escape_hatch_uses(spark, sf_dir):
    return S.escape_hatch_uses(steps(spark, sf_dir), ["scenario_id"])


@query(
    f"""WITH {STEPS_SQL}, u AS (SELECT scenario_id, count(*) AS uses FROM s WHERE kind = 'raw' GROUP BY ALL), d AS (SELECT 'user-' || c_custkey AS scenario_id, c_custkey % 20 AS declared FROM customer WHERE c_custkey < 140)
    SELECT scenario_id, coalesce(uses, 0) AS uses, declared, CASE WHEN declared IS NULL THEN 'unknown_scenario' ELSE 'count_mismatch' END AS problem
    FROM u FULL JOIN d USING (scenario_id) WHERE coalesce(uses, 0) IS DISTINCT FROM declared"""
)
def escape_use_reconcile(spark, sf_dir):
    """Uses against the counts that the first customers declare."""
    key = F.col("c_custkey")
    declared = D.table(spark, sf_dir, "customer").filter(key < 140).select(F.concat(F.lit("user-"), key).alias("scenario_id"), (key % 20).alias("uses"))
    return S.escape_use_reconcile(S.escape_hatch_uses(steps(spark, sf_dir), ["scenario_id"]), declared, ["scenario_id"])


@query(f"WITH {STEPS_SQL} SELECT scenario_id, count_if(status = 'timed_out') AS timed_out, count(quiet_ms) AS converged, max(quiet_ms) AS longest_ms FROM s GROUP BY ALL")
def run_telemetry(spark, sf_dir):
    return steps(spark, sf_dir).groupBy("scenario_id").agg(F.count_if(F.col("status") == "timed_out").alias("timed_out"), F.count("quiet_ms").alias("converged"), F.max("quiet_ms").alias("longest_ms"))


RECORDS_SQL = f"""WITH {RESULTS_SQL}, k AS (SELECT *, scenario_id % 7 AS expected, scenario_id % 5 AS explained, scenario_id % 2 AS suppressed, scenario_id % 3 AS unexplained,
  scenario_id % 7 + scenario_id % 5 + scenario_id % 2 + scenario_id % 3 + (scenario_id % 97 = 0)::INT AS captured, CASE WHEN scenario_id % 4 > 0 THEN 'db' END AS capability,
  CASE WHEN scenario_id % 3 > 0 THEN 'E_DB' END AS error_code, scenario_id % 2 AS failed_steps,
  CASE scenario_id % 10 WHEN 0 THEN 'in_progress' WHEN 1 THEN 'interrupted' WHEN 2 THEN NULL ELSE 'done' END AS state FROM r)"""


def records(spark, sf_dir):
    k = F.col("scenario_id")
    tenth = k % 10
    return results(spark, sf_dir).withColumns(
        {
            "expected": k % 7, "explained": k % 5, "suppressed": k % 2, "unexplained": k % 3, "captured": k % 7 + k % 5 + k % 2 + k % 3 + (k % 97 == 0).cast("int"),
            "capability": F.when(k % 4 > 0, "db"), "error_code": F.when(k % 3 > 0, "E_DB"), "failed_steps": k % 2,
            "state": F.when(tenth == 0, "in_progress").when(tenth == 1, "interrupted").when(tenth == 2, None).otherwise("done"),
        }
    )


@query(
    RECORDS_SQL
    + """ SELECT run_id, scenario_id, problem FROM k, unnest([CASE WHEN expected + explained + suppressed + unexplained <> captured THEN 'buckets_do_not_sum' END,
    CASE WHEN result = 'skipped' AND capability IS NULL THEN 'skipped_without_capability' END, CASE WHEN result = 'infra_error' AND error_code IS NULL THEN 'infra_error_without_code' END,
    CASE WHEN result = 'infra_error' AND failed_steps > 0 THEN 'infra_error_with_failed_step' END]) t(problem) WHERE problem IS NOT NULL"""
)
def run_invariants(spark, sf_dir):
    return S.run_invariants(records(spark, sf_dir)).select("run_id", "scenario_id", "problem")


@query(RECORDS_SQL + " SELECT run_id, count(*) AS verdicts FROM k WHERE state IS NULL OR state NOT IN ('in_progress', 'interrupted') GROUP BY ALL")
def finished_records(spark, sf_dir):
    return S.finished(records(spark, sf_dir)).groupBy("run_id").agg(F.count("*").alias("verdicts"))
