"""Snapshot diffs and the classification of their changes."""

import datetime
import uuid

from pyspark.sql import functions as F

from changeproof.operators import classify as C, rules as rule_ops
from changeproof.operators.scale import ensure_checkpoint_dir
from changeproof.plans import derive as D
from changeproof.plans.register import Register
from changeproof.schema import WINDOW
from changeproof.sinks.health import HealthStore
from changeproof.sinks.store import TableStore
from changeproof.sources.snapshots import duplicate_keys

REGISTER = Register()
query = REGISTER.query
AS_OF = datetime.date.fromisoformat(D.AS_OF)
W = "run_id, scenario_id"


def _names(paths):
    return F.array_join(F.array_sort(F.transform(paths, lambda p: F.array_join(p, "."))), ",")


def shop_delta(spark, sf_dir):
    events = D.shop_events(spark, sf_dir)
    return events, C.classify(events, D.shop_expectations(spark, sf_dir), D.shop_rules(spark), AS_OF, "shop", windows=D.month_windows(spark, sf_dir))


# Every event with its place among those of its window, entity and op, and in its table; then the bucket.
CLASSIFIED_SQL = f"""
WITH {D.SHOP_EVENTS_SQL},
wins AS (SELECT DISTINCT 'run-' || year(o_orderdate) AS run_id, 'month-' || month(o_orderdate) AS scenario_id FROM orders),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY {W}, entity, op ORDER BY idx) AS r_op,
         row_number() OVER (PARTITION BY {W}, entity ORDER BY idx) AS r_table,
         row_number() OVER (PARTITION BY {W}, entity, op, changed = 'o_totalprice' ORDER BY idx) AS r_price,
         row_number() OVER (PARTITION BY {W}, entity, action ORDER BY idx) AS r_action,
         count_if(entity = 'shop.orders' AND op = 'delete') OVER (PARTITION BY {W}) AS b1,
         count_if(entity = 'shop.orders' AND op = 'insert') OVER (PARTITION BY {W}) AS b2
  FROM ev
), first AS (
  SELECT *, CASE WHEN op = 'insert' AND entity = 'shop.orders' AND r_op <= 3 THEN 0
                 WHEN op = 'delete' AND r_op <= 5 THEN 1
                 WHEN op = 'update' AND changed = 'o_totalprice' AND r_price <= 4 THEN 2
                 WHEN entity = 'shop.order_audit' AND action = 'deleted' AND r_action <= 2 THEN 4 END AS e1
  FROM ranked
), matched AS (
  SELECT *, CASE WHEN e1 IS NOT NULL THEN e1
                 WHEN op = 'update' AND row_number() OVER (PARTITION BY {W}, entity, op, e1 IS NULL ORDER BY idx) <= 6 THEN 3 END AS exp_idx
  FROM first
), c AS (
  SELECT *, CASE WHEN exp_idx IS NOT NULL THEN 'expected'
                 WHEN entity = 'shop.order_audit' AND (r_table <= b1 OR r_table <= b2) THEN 'explained'
                 WHEN entity = 'shop.orders' AND op = 'insert' THEN 'explained' ELSE 'unexplained' END AS bucket
  FROM matched
), counts AS (
  SELECT w.run_id, w.scenario_id, count(c.idx) AS total, coalesce(count_if(bucket = 'expected'), 0) AS expected, coalesce(count_if(bucket = 'explained'), 0) AS explained,
         coalesce(count_if(bucket = 'suppressed_external'), 0) AS suppressed_external, coalesce(count_if(bucket = 'unexplained'), 0) AS unexplained
  FROM wins w LEFT JOIN c USING (run_id, scenario_id) GROUP BY ALL
), declared AS (
  SELECT * FROM wins, (VALUES (0, 'shop.orders', 'insert', 3), (1, 'orders', 'delete', 5), (2, 'orders', 'update', 4), (3, 'shop.orders', 'update', 6),
                              (4, 'order_audit', 'insert', 2), (5, 'shop.customers', 'update', 1)) d(exp_idx, entity, op, expected)
), short AS (
  SELECT d.run_id, d.scenario_id, d.exp_idx, any_value(d.entity) AS entity, any_value(d.op) AS op, any_value(d.expected)::BIGINT AS expected, count(c.idx) AS matched
  FROM declared d LEFT JOIN c ON c.run_id = d.run_id AND c.scenario_id = d.scenario_id AND c.exp_idx = d.exp_idx GROUP BY 1, 2, 3
), stats AS (
  SELECT w.run_id, w.scenario_id, r.id, r.kind, r.cap, coalesce(count_if(CASE r.id WHEN 'volatile_order_status' THEN op = 'update' AND changed = 'o_orderstatus'
                  WHEN 'deletes_leave_audit' THEN entity = 'shop.order_audit' AND r_table <= b1
                  WHEN 'order_create_audit' THEN entity = 'shop.order_audit' AND r_table > b1 AND r_table <= b2
                  ELSE entity = 'shop.orders' AND op = 'insert' END), 0) AS suppressed,
         coalesce(count_if(CASE r.id WHEN 'deletes_leave_audit' THEN entity = 'shop.order_audit' AND r_table > b1
                  WHEN 'order_create_audit' THEN entity = 'shop.order_audit' AND r_table > b1 AND r_table > b2 ELSE false END), 0) AS over_budget
  FROM wins w CROSS JOIN (VALUES ('volatile_order_status', 'volatile_columns', 50), ('deletes_leave_audit', 'derived', 50), ('order_create_audit', 'derived', 5), ('reorder_backfill', 'ignore', 5)) r(id, kind, cap)
  LEFT JOIN c USING (run_id, scenario_id) GROUP BY ALL
), caps AS (
  SELECT run_id, scenario_id, id, 'declared_cardinality' AS reason, suppressed + over_budget AS count, cap FROM stats WHERE kind <> 'volatile_columns' AND over_budget > 0
  UNION ALL SELECT run_id, scenario_id, id, 'absolute_cap', suppressed, cap FROM stats WHERE kind <> 'volatile_columns' AND suppressed > cap
)"""


@query(f"WITH {D.SHOP_EVENTS_SQL} SELECT idx, entity, op, key, changed, {W} FROM ev")
def snapshot_diff_orders(spark, sf_dir):
    return D.shop_events(spark, sf_dir).select("idx", "entity", "op", "key", _names("paths").alias("changed"), "run_id", "scenario_id")


@query("SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys_lineitem(spark, sf_dir):
    return duplicate_keys(D.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(CLASSIFIED_SQL + f" SELECT {W}, total, expected, explained, suppressed_external, unexplained FROM counts")
def delta_buckets(spark, sf_dir):
    _, delta = shop_delta(spark, sf_dir)
    return C.window_verdicts(delta).select("run_id", "scenario_id", "total", *C.BUCKETS)


@query(
    CLASSIFIED_SQL
    + f""", v AS (SELECT *, (SELECT count(*) FROM caps k WHERE k.run_id = n.run_id AND k.scenario_id = n.scenario_id) AS broken FROM counts n)
    SELECT {W}, total, unexplained, concat_ws(',', CASE WHEN unexplained > 0 THEN 'unexplained_changes' END, CASE WHEN broken > 0 THEN 'rule_too_broad' END) AS reasons, unexplained > 0 OR broken > 0 AS failed FROM v"""
)
def window_verdicts(spark, sf_dir):
    _, delta = shop_delta(spark, sf_dir)
    return C.window_verdicts(delta).select("run_id", "scenario_id", "total", "unexplained", F.array_join("failure_reasons", ",").alias("reasons"), "failed")


@query(CLASSIFIED_SQL + f" SELECT {W}, idx, bucket, exp_idx FROM c")
def classified_changes(spark, sf_dir):
    _, delta = shop_delta(spark, sf_dir)
    return delta.classified.select("run_id", "scenario_id", "idx", "bucket", "exp_idx")


@query(CLASSIFIED_SQL + f" SELECT {W}, exp_idx, entity, op, expected, matched, expected - matched AS missing FROM short WHERE expected > matched")
def delta_shortfalls(spark, sf_dir):
    _, delta = shop_delta(spark, sf_dir)
    return delta.shortfalls.select("run_id", "scenario_id", "exp_idx", "entity", "op", "expected", "matched", "missing")


@query(CLASSIFIED_SQL + f" SELECT {W}, id, kind, suppressed, over_budget, cap::BIGINT AS cap FROM stats")
def rule_stats(spark, sf_dir):
    _, delta = shop_delta(spark, sf_dir)
    return delta.rule_stats.select("run_id", "scenario_id", "id", "kind", "suppressed", "over_budget", "cap")


@query(CLASSIFIED_SQL + f" SELECT {W}, id, reason, count, cap::BIGINT AS cap FROM caps")
def rule_cap_violations(spark, sf_dir):
    _, delta = shop_delta(spark, sf_dir)
    return delta.cap_violations.select("run_id", "scenario_id", "id", "reason", "count", "cap")


@query(
    CLASSIFIED_SQL
    + f""", all_codes AS (
      SELECT {W}, 0 AS code_rank, 'E_DELTA_MISSING_MUTATION' AS code, entity AS subject, expected, matched AS observed FROM short WHERE expected > matched
      UNION ALL SELECT {W}, 1, 'E_DELTA_UNEXPLAINED', NULL, NULL, unexplained FROM counts WHERE unexplained > 0
      UNION ALL SELECT {W}, 2, 'E_RULE_TOO_BROAD', id, cap, count FROM caps)
    SELECT {W}, code, subject, expected::BIGINT AS expected, observed, code_rank = min(code_rank) OVER (PARTITION BY {W}) AS is_primary FROM all_codes"""
)
def delta_violations(spark, sf_dir):
    events, delta = shop_delta(spark, sf_dir)
    found = C.assert_delta(delta, events, D.shop_expectations(spark, sf_dir), D.shop_rules(spark), AS_OF)
    return found.select("run_id", "scenario_id", "code", "subject", "expected", "observed", "is_primary")


@query(CLASSIFIED_SQL + f" SELECT {W}, entity, op, count(*) AS count, greatest(count(*) - 5, 0) AS omitted FROM c WHERE bucket = 'unexplained' GROUP BY ALL")
def unexplained_groups(spark, sf_dir):
    events, delta = shop_delta(spark, sf_dir)
    groups, _ = C.group_unexplained(delta.classified, events)
    return groups.select("run_id", "scenario_id", "entity", "op", "count", "omitted")


@query(
    CLASSIFIED_SQL
    + f""", s AS (SELECT *, row_number() OVER (PARTITION BY {W}, entity, op ORDER BY idx) AS sample FROM c WHERE bucket = 'unexplained')
    SELECT {W}, entity, op, sample::BIGINT AS sample, idx, key AS key_text FROM s WHERE sample <= 5"""
)
def unexplained_samples(spark, sf_dir):
    events, delta = shop_delta(spark, sf_dir)
    _, rows = C.group_unexplained(delta.classified, events)
    return rows.select("run_id", "scenario_id", "entity", "op", F.col("sample").cast("long").alias("sample"), "idx", "key_text")


@query(CLASSIFIED_SQL + " SELECT run_id, CASE WHEN grouping(scenario_id) = 0 THEN scenario_id END AS scenario_id, sum(total)::BIGINT AS total, sum(expected)::BIGINT AS expected, sum(explained)::BIGINT AS explained, sum(unexplained)::BIGINT AS unexplained FROM counts GROUP BY ROLLUP (run_id, scenario_id)")
def suite_rollup(spark, sf_dir):
    """Buckets of scenarios, of runs and of all runs."""
    _, delta = shop_delta(spark, sf_dir)
    sums = [F.sum(c).alias(c) for c in ("total", "expected", "explained", "unexplained")]
    return C.window_verdicts(delta).rollup("run_id", "scenario_id").agg(*sums)


@query(
    f"""WITH {D.FEED_SQL}, own AS (SELECT DISTINCT scenario_id, tx_id FROM feed WHERE actor_kind = 'harness' AND tx_id IS NOT NULL)
    SELECT f.scenario_id, count(*) AS total, count_if(f.tx_id IS NOT NULL AND o.tx_id IS NULL) AS foreign_tx, count_if(app <> 'app') AS foreign_app
    FROM feed f LEFT JOIN own o ON o.scenario_id = f.scenario_id AND o.tx_id = f.tx_id GROUP BY ALL"""
)
def external_writer_split(spark, sf_dir):
    """Changes of each window that other transactions, or another application, made."""
    events = D.feed(spark, sf_dir)
    own = events.filter(F.col("actor.kind") == "harness").filter("tx_id IS NOT NULL").select(*WINDOW, "tx_id").distinct()
    rows = rule_ops.foreign_transaction(events, own)
    foreign = F.col("tx_id").isNotNull() & ~F.col("own_tx")
    return rows.groupBy("scenario_id").agg(
        F.count("*").alias("total"), F.count_if(foreign).alias("foreign_tx"), F.count_if(rule_ops.foreign_application(F.col("actor"), F.lit("app"))).alias("foreign_app")
    )


@query(
    f"""WITH {D.FEED_SQL} SELECT idx, CASE WHEN op = 'update' AND event_type = 'view' THEN 'k' WHEN op = 'update' THEN 'k,meta.last_' || event_type ELSE 'id,k,type' END AS kept,
    CASE WHEN op = 'update' AND event_type = 'view' THEN 'meta.last_view' ELSE '' END AS stripped FROM feed"""
)
def volatile_strip(spark, sf_dir):
    rows = rule_ops.strip_volatile(D.feed(spark, sf_dir).withColumn("ruleset_id", F.lit("feed")), D.feed_rules(spark))
    return rows.select("idx", _names("paths").alias("kept"), F.array_join(F.transform("stripped", lambda s: s["path"]), ",").alias("stripped"))


@query("SELECT c_nationkey, count(*) AS inside FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY ALL")
def tenant_scope(spark, sf_dir):
    from changeproof.operators.fence import tenant_scope as scope

    rows = D.table(spark, sf_dir, "customer").withColumns(
        {"key": F.to_json(F.struct("c_custkey")), "before": F.lit(None).cast("string"), "after": F.to_json(F.struct("c_custkey", "c_mktsegment"))}
    )
    return rows.filter(scope("c_mktsegment", F.lit("BUILDING"))).groupBy("c_nationkey").agg(F.count("*").alias("inside"))


def _by_op(events, rules):
    """An engine of its own: deletes are the ruleset's first rule's, updates those of a writer that no rule names."""
    first = rules.agg(F.min_by("id", "rule_pos")).first()[0]
    told = F.when(F.col("op") == "delete", F.struct(F.lit(first).alias("rule_id"), F.lit("derived").alias("kind"))).when(
        F.col("op") == "update", F.struct(F.lit("batch_job").alias("rule_id"), F.lit("external_writer").alias("kind"))
    )
    return events.select(*WINDOW, "idx", told.alias("x")).where("x IS NOT NULL").select(*WINDOW, "idx", "x.*")


@query(
    CLASSIFIED_SQL
    + f""" SELECT {W}, count(*) AS total, count_if(c.exp_idx IS NOT NULL) AS expected, count_if(c.exp_idx IS NULL AND ev.op = 'delete') AS explained, count_if(c.exp_idx IS NULL AND ev.op = 'update') AS suppressed_external,
      count_if(c.exp_idx IS NULL AND ev.op = 'insert') AS unexplained FROM c JOIN ev USING (run_id, scenario_id, idx) GROUP BY ALL"""
)
def engine_buckets(spark, sf_dir):
    """The shop's changes under an engine in place of the typed rules."""
    events, rules = D.shop_events(spark, sf_dir), D.shop_rules(spark)
    delta = C.classify(events, D.shop_expectations(spark, sf_dir), rules, AS_OF, "shop", engine=_by_op)
    return C.bucket_counts(delta.classified, ["run_id", "scenario_id"])


@query(
    """WITH h AS (SELECT 'rule-' || (conv_id // 5 % 40) AS rule_id, role AS rule_hash, conv_id % 5 AS run_idx, count_if(length(text) % 13 = 0) AS fired FROM conversations GROUP BY ALL),
    n AS (SELECT *, row_number() OVER (PARTITION BY rule_id, rule_hash ORDER BY run_idx) AS nth FROM h),
    z AS (SELECT *, nth - coalesce(max(CASE WHEN fired > 0 THEN nth END) OVER (PARTITION BY rule_id, rule_hash ORDER BY run_idx), 0) AS zero_runs FROM n)
    SELECT rule_id, rule_hash, max(run_idx) AS run_idx, arg_max(zero_runs, run_idx) AS zero_runs, arg_max(zero_runs, run_idx) >= 3 AS dead FROM z GROUP BY ALL"""
)
def recorded_rule_health(spark, sf_dir):
    """Conversations as five runs, recorded one after the other, and what their rules are after the last."""
    ensure_checkpoint_dir(spark)
    store = HealthStore(TableStore(spark, f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/health-{uuid.uuid4().hex}"))
    rows = D.table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("rule-"), F.expr("conv_id div 5 % 40")).alias("rule_id"), F.col("role").alias("rule_hash"), (F.col("conv_id") % 5).alias("run"), F.length("text").alias("size")
    )
    for run in range(5):
        store.record(f"run-{run}", run, rows.where(F.col("run") == run).groupBy("rule_id", "rule_hash").agg(F.count_if(F.col("size") % 13 == 0).alias("suppressed"), F.lit(None).cast("long").alias("over_budget")))
    return store.health(3).drop("proposed_action")


@query(
    """WITH h AS (SELECT 'rule-' || (conv_id % 40) AS rule_id, role AS rule_hash, conv_id * 1000 + turn AS run_idx, (length(text) % 5 = 0)::INT AS fired FROM conversations),
    n AS (SELECT *, row_number() OVER (PARTITION BY rule_id, rule_hash ORDER BY run_idx) AS nth FROM h),
    z AS (SELECT *, nth - coalesce(max(CASE WHEN fired = 1 THEN nth END) OVER (PARTITION BY rule_id, rule_hash ORDER BY run_idx), 0) AS zero_runs FROM n)
    SELECT rule_id, rule_hash, run_idx, zero_runs, zero_runs >= 3 AS dead FROM z"""
)
def dead_rules(spark, sf_dir):
    """Consecutive runs without a fire; conversations stand in as the history of 40 rules."""
    return rule_ops.dead_rules(_history(spark, sf_dir)).select("rule_id", "rule_hash", "run_idx", "zero_runs", "dead")


def _history(spark, sf_dir):
    rows = D.table(spark, sf_dir, "conversations")
    return rows.select(
        F.concat(F.lit("rule-"), F.col("conv_id") % 40).alias("rule_id"), F.col("role").alias("rule_hash"), (F.col("conv_id") * 1000 + F.col("turn")).alias("run_idx"),
        (F.length("text") % 5 == 0).cast("int").alias("suppressed"), F.lit(0).alias("over_budget"),
    )


@query(
    """WITH h AS (SELECT 'rule-' || (conv_id % 40) AS rule_id, role AS rule_hash, conv_id * 1000 + turn AS run_idx, (length(text) % 5 = 0)::INT AS fired FROM conversations),
    n AS (SELECT *, row_number() OVER (PARTITION BY rule_id, rule_hash ORDER BY run_idx) AS nth FROM h),
    z AS (SELECT *, nth - coalesce(max(CASE WHEN fired = 1 THEN nth END) OVER (PARTITION BY rule_id, rule_hash ORDER BY run_idx), 0) AS zero_runs FROM n)
    SELECT rule_hash, string_agg(rule_id, ',' ORDER BY rule_id) AS dead_rules, count(*) AS n_dead FROM (SELECT rule_id, rule_hash, arg_max(zero_runs, run_idx) AS zero_runs FROM z GROUP BY ALL) WHERE zero_runs >= 3 GROUP BY ALL"""
)
def rule_health_rollup(spark, sf_dir):
    """Rules that are dead at their latest run, by ruleset."""
    latest = rule_ops.dead_rules(_history(spark, sf_dir)).groupBy("rule_id", "rule_hash").agg(F.max_by("zero_runs", "run_idx").alias("zero_runs"))
    dead = latest.filter(F.col("zero_runs") >= 3).groupBy("rule_hash")
    return dead.agg(F.array_join(F.array_sort(F.collect_set("rule_id")), ",").alias("dead_rules"), F.count("*").alias("n_dead"))
