"""Sinks and readers of run records: orders as scenarios, events as network entries, written, read back and compared."""

import uuid

from pyspark.sql import functions as F

from changeproof.operators.scale import ensure_checkpoint_dir
from changeproof.plans import derive as D
from changeproof.plans.register import Register
from changeproof.plans.suite_queries import RESULTS_SQL, results
from changeproof.sinks import junit, network_log
from changeproof.sinks.run_facts import BUCKETS, write_run_facts
from changeproof.sinks.store import TableStore
from changeproof.sources.run_records import read_run_records

REGISTER = Register()
query = REGISTER.query


def _folder(spark, name):
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{name}-{uuid.uuid4().hex}"


def run_facts(spark, sf_dir):
    """The facts of all orders, published; the store."""
    key, skipped = F.col("scenario_id"), F.col("result") == "skipped"
    rows = results(spark, sf_dir)
    captured = sum((key % n for n in (5, 3, 2, 7)), F.lit(0))
    scenarios = rows.select(
        "run_id", key.cast("string").alias("scenario_id"), "surface", "result", "duration_ms", F.array_distinct(F.array(F.concat(F.lit("REQ-"), key % 9), F.concat(F.lit("REQ-"), key % 4))).alias("requirements"),
        F.when(skipped, F.array(F.lit("phone"))).otherwise(F.array().cast("array<string>")).alias("missing"), F.when(F.col("result") == "infra_error", "E_NETWORK").alias("error_code"), captured.alias("captured"),
    )
    each = F.array(*(F.struct(F.lit(b).alias("bucket"), (key % n).alias("n")) for b, n in zip(BUCKETS, (5, 3, 2, 7), strict=True)))
    buckets = rows.select("run_id", key.cast("string").alias("scenario_id"), "surface", F.explode(each).alias("x")).select("run_id", "scenario_id", "surface", "x.*")
    rules = rows.select(
        "run_id", key.cast("string").alias("scenario_id"), "surface", F.concat(F.lit("rule-"), key % 6).alias("rule_id"), F.when(key % 6 < 3, "ignore").otherwise("derived").alias("kind"),
        F.concat(F.lit("shop.t"), key % 2).alias("entity"), (key % 3).alias("suppressed"), F.when(key % 11 == 0, 1).alias("over_budget"), (key % 6 * 10).alias("cap"), (key % 101 == 0).alias("dead"), (key % 4999 == 7).alias("expired"),
    )
    store = TableStore(spark, _folder(spark, "facts"))
    stated = rows.groupBy("run_id").agg(F.count("*").alias("total"))
    write_run_facts(store, "orders", scenarios, buckets, rules, stated)
    return store


@query(
    f"""WITH {RESULTS_SQL} SELECT run_id, count(*) AS total, count_if(result = 'pass') AS pass, count_if(result = 'fail') AS fail, count_if(result = 'infra_error') AS infra_error, count_if(result = 'skipped') AS skipped,
      count_if(result = 'quarantined') AS quarantined, CASE WHEN count_if(result = 'infra_error') > 0 THEN 'infra_error' WHEN count_if(result = 'fail') > 0 THEN 'fail' ELSE 'pass' END AS status,
      CASE WHEN count_if(result = 'infra_error') > 0 THEN 2 WHEN count_if(result = 'fail') > 0 THEN 1 WHEN count_if(result = 'skipped') > 0 THEN 4 ELSE 0 END AS exit_code,
      sum(scenario_id % 5)::BIGINT AS expected, sum(scenario_id % 3)::BIGINT AS explained, sum(scenario_id % 2)::BIGINT AS suppressed_external, sum(scenario_id % 7)::BIGINT AS unexplained FROM r GROUP BY 1"""
)
def run_fact_runs(spark, sf_dir):
    """What follows from the facts, read from the published tables."""
    return run_facts(spark, sf_dir).read("runs")


@query(
    f"""WITH {RESULTS_SQL}, k AS (SELECT run_id, scenario_id, scenario_id % 6 AS m FROM r)
    SELECT run_id, 'rule-' || m AS rule_id, CASE WHEN m < 3 THEN 'ignore' ELSE 'derived' END AS kind, 'shop.t' || (scenario_id % 2) AS entity, sum(scenario_id % 3)::BIGINT AS suppressed, count_if(scenario_id % 11 = 0) AS over_budget,
      any_value(m * 10) AS cap, bool_or(scenario_id % 101 = 0) AS dead, bool_or(scenario_id % 4999 = 7) AS expired FROM k GROUP BY ALL"""
)
def run_fact_rules(spark, sf_dir):
    """Rule rows of all scenarios of a run, merged."""
    return run_facts(spark, sf_dir).read("run_rules")


@query(
    f"""WITH {RESULTS_SQL}, q AS (SELECT DISTINCT run_id, scenario_id, 'REQ-' || unnest([scenario_id % 9, scenario_id % 4]) AS requirement FROM r)
    SELECT run_id, requirement, count(*) AS scenarios FROM q GROUP BY ALL"""
)
def run_fact_requirements(spark, sf_dir):
    return run_facts(spark, sf_dir).read("run_requirements")


@query(
    f"""WITH {RESULTS_SQL} SELECT surface, scenario_id::VARCHAR AS scenario_id, duration_ms / 1000 AS seconds, CASE WHEN result = 'fail' THEN 'step ' || (scenario_id % 4) || ' ' || CASE WHEN scenario_id % 5 = 0 THEN 'E_SCENARIO_FAILED' ELSE 'E<&"' || (scenario_id % 5) END END AS failure,
      CASE WHEN result = 'infra_error' THEN 'step ' || (scenario_id % 4) || ' ' || CASE WHEN scenario_id % 5 = 0 THEN 'E_INFRA_ERROR' ELSE 'E<&"' || (scenario_id % 5) END END AS error, CASE WHEN result = 'skipped' THEN 'phone, database' END AS skipped FROM r"""
)
def junit_cases(spark, sf_dir):
    """Every result written as a test case and read back."""
    key = F.col("scenario_id")
    code = F.when(key % 5 > 0, F.concat(F.lit('E<&"'), key % 5))
    rows = results(spark, sf_dir).select("scenario_id", "surface", "result", "duration_ms", (key % 4).alias("step"), code.alias("code"), F.array(F.lit("phone"), F.lit("database")).alias("missing"))
    return junit.read_junit(spark, junit.write_junit(rows, _folder(spark, "junit")))


ENTRIES_SQL = """e AS (SELECT 'user-' || user_id AS page, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place, event_type, props, count(*) OVER (PARTITION BY user_id) AS n FROM events)"""
MOST = 8


def _written_log(spark, sf_dir):
    events = D.table(spark, sf_dir, "events")
    entries = events.select(
        F.concat(F.lit("user-"), "user_id").alias("page"), F.col("event_id").alias("seq"), F.upper("event_type").alias("method"),
        F.concat(F.lit("https://shop.example/"), "event_type", F.lit("?a="), "event_id", F.lit("&API%5Fkey=k"), "user_id", F.lit("#top")).alias("url"), (F.col("event_id") % 5 * 100).cast("int").alias("status"),
        F.create_map(F.lit("X-Auth-Token"), F.lit("abc"), F.lit("accept"), F.concat(F.lit("text "), "event_type")).alias("headers"), F.concat(F.lit("a Bearer of news, Bearer 0123456789abcd= for "), "event_type").alias("body"),
    )
    path = _folder(spark, "network")
    network_log.write_network_log(entries, path, (), MOST)
    return network_log.read_network_log(spark, path)


@query(
    f"""WITH {ENTRIES_SQL} SELECT page, seq, upper(event_type) AS method, 'https://shop.example/' || event_type || '?a=' || seq || '&API%5Fkey=[REDACTED]#top' AS url, (seq % 5 * 100)::INT AS status, '[REDACTED]' AS token, 'text ' || event_type AS accept,
      'a Bearer of news, [REDACTED] for ' || event_type AS body FROM e WHERE place <= {MOST}"""
)
def network_log_entries(spark, sf_dir):
    """The first requests of every page, redacted, written as JSON lines and read back."""
    entries, _ = _written_log(spark, sf_dir)
    return entries.select("page", "seq", "method", "url", "status", F.col("headers")["X-Auth-Token"].alias("token"), F.col("headers")["accept"].alias("accept"), "body")


@query(f"WITH {ENTRIES_SQL} SELECT page, any_value(n) - {MOST} AS truncated FROM e GROUP BY 1 HAVING any_value(n) > {MOST}")
def network_log_truncated(spark, sf_dir):
    """How many requests each page's log left out, from its last line."""
    return _written_log(spark, sf_dir)[1]


def _record_lines(spark, sf_dir):
    key = F.col("o_orderkey")
    scenario = F.struct(F.concat(F.lit("s-"), key).alias("id"), F.lit("web").alias("surface"), F.lit("pass").alias("result"), (key % 50).alias("duration_ms"), F.array(F.lit("REQ-1")).alias("requirements"))
    record = lambda version, delta: F.to_json(F.struct(
        F.lit(version).alias("run_record_version"), F.concat(F.lit("run-"), key).alias("run_id"), F.lit("2024-01-01T00:00:00Z").alias("started_at"), (key % 1000 - F.when(key % 97 == 0, 1000).otherwise(0)).alias("duration_ms"),
        F.lit("pass").alias("status"), F.lit(0).alias("exit_code"), F.array(scenario).alias("scenarios"), *([F.struct(F.create_map(F.lit("expected"), key % 3).alias("counts")).alias("delta")] if delta else []),
    ))
    tenth = key % 10
    line = F.when(tenth < 4, record(2, True)).when(tenth < 7, record(1, False)).when(tenth == 7, record(1, True)).when(tenth == 8, record(3, False)).otherwise(F.substring(record(2, True), 1, 60))
    return D.table(spark, sf_dir, "orders").select(line.alias("line"))


@query(
    """SELECT 'run-' || o_orderkey AS run_id, 2 AS run_record_version, o_orderkey % 10 >= 4 AS upgraded, o_orderkey % 1000 AS duration_ms, 's-' || o_orderkey AS scenario, CASE WHEN o_orderkey % 10 < 4 THEN o_orderkey % 3 END AS expected
    FROM orders WHERE o_orderkey % 10 < 7 AND NOT (o_orderkey % 97 = 0 AND o_orderkey % 1000 < 1000)"""
)
def run_records(spark, sf_dir):
    """Records of both versions, the old ones taken over."""
    records, _ = read_run_records(_record_lines(spark, sf_dir))
    return records.select("run_id", "run_record_version", "upgraded", "duration_ms", F.col("scenarios")[0]["id"].alias("scenario"), F.col("delta.counts")["expected"].alias("expected"))


@query(
    """SELECT CASE WHEN o_orderkey % 10 = 9 THEN 'unreadable' WHEN o_orderkey % 10 = 8 THEN 'unknown_version' WHEN o_orderkey % 10 = 7 THEN 'delta_in_old_version' ELSE 'duration_below_0' END AS problem, count(*) AS n
    FROM orders WHERE o_orderkey % 10 > 6 OR o_orderkey % 97 = 0 GROUP BY 1"""
)
def run_records_rejected(spark, sf_dir):
    return read_run_records(_record_lines(spark, sf_dir))[1].groupBy("problem").agg(F.count("*").alias("n"))
