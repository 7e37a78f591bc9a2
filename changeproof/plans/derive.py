"""Inputs of the registered queries, derived by Spark from the given tables.

Every derivation covers its whole table. Next to each stands the SQL text of the same rows.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from changeproof.schema import EXPECTATIONS, RULES, WINDOW
from changeproof.sources.snapshots import EntityPair, diff_snapshots

AS_OF = "2026-01-15"
KEY_SHIFT = 10_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- Two versions of the shop ---------------------------------------------------------------
# Deleted: pending low-priority orders. Updated: price of filled urgent orders, status of open
# high-priority ones. Inserted: re-orders of pending medium-priority ones.


def orders_before(spark, sf_dir):
    return table(spark, sf_dir, "orders")


def orders_after(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    kept = orders.filter(~((status == "P") & (priority == "5-LOW")))
    kept = kept.withColumns(
        {
            "o_totalprice": F.when((status == "F") & (priority == "1-URGENT"), F.col("o_totalprice") + 1).otherwise(
                F.col("o_totalprice")
            ),
            "o_orderstatus": F.when((status == "O") & (priority == "2-HIGH"), "F").otherwise(status),
        }
    )
    again = orders.filter((status == "P") & (priority == "3-MEDIUM"))
    return kept.unionByName(again.withColumn("o_orderkey", F.col("o_orderkey") + KEY_SHIFT))


def audit_after(spark, sf_dir):
    """One audit row per deleted order, a second one for expensive orders, one per re-order."""
    orders = table(spark, sf_dir, "orders")
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    deleted = orders.filter((status == "P") & (priority == "5-LOW"))
    created = orders.filter((status == "P") & (priority == "3-MEDIUM"))

    def rows(df, audit_id, action):
        return df.select(
            audit_id.alias("audit_id"), F.lit(action).alias("action"), F.col("o_orderkey").alias("order_id"), "o_orderdate"
        )

    key = F.col("o_orderkey")
    return (
        rows(deleted, key * 2, "deleted")
        .unionByName(rows(deleted.filter(F.col("o_totalprice") > 250000), key * 2 + 1, "deleted"))
        .unionByName(rows(created, (key + KEY_SHIFT) * 2, "created"))
    )


def month_window(read):
    date = read("o_orderdate")
    return {
        "run_id": F.concat(F.lit("run-"), F.year(date)),
        "scenario_id": F.concat(F.lit("month-"), F.month(date)),
        "surface": F.lit("db"),
        "window_seq": F.lit(0),
    }


def shop_events(spark, sf_dir) -> DataFrame:
    audit = audit_after(spark, sf_dir)
    return diff_snapshots(
        [
            EntityPair("shop.orders", ["o_orderkey"], orders_before(spark, sf_dir), orders_after(spark, sf_dir), month_window),
            EntityPair("shop.order_audit", ["audit_id"], audit.filter(F.lit(False)), audit, month_window),
        ]
    )


SHOP_EVENTS_SQL = f"""
deleted AS (SELECT * FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '5-LOW'),
created AS (SELECT * FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '3-MEDIUM'),
raw_events AS (
  SELECT 0 AS entity_pos, 'shop.orders' AS entity, 'delete' AS op, o_orderkey AS k, o_orderdate AS d,
         '{{"o_orderkey":' || o_orderkey || '}}' AS key,
         'o_custkey,o_orderdate,o_orderkey,o_orderpriority,o_orderstatus,o_totalprice' AS changed, CAST(NULL AS VARCHAR) AS action
  FROM deleted
  UNION ALL
  SELECT 0, 'shop.orders', 'update', o_orderkey, o_orderdate, '{{"o_orderkey":' || o_orderkey || '}}', 'o_totalprice', NULL
  FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'
  UNION ALL
  SELECT 0, 'shop.orders', 'update', o_orderkey, o_orderdate, '{{"o_orderkey":' || o_orderkey || '}}', 'o_orderstatus', NULL
  FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '2-HIGH'
  UNION ALL
  SELECT 0, 'shop.orders', 'insert', o_orderkey + {KEY_SHIFT}, o_orderdate, '{{"o_orderkey":' || (o_orderkey + {KEY_SHIFT}) || '}}',
         'o_custkey,o_orderdate,o_orderkey,o_orderpriority,o_orderstatus,o_totalprice', NULL
  FROM created
  UNION ALL
  SELECT 1, 'shop.order_audit', 'insert', a.id, a.d, '{{"audit_id":' || a.id || '}}', 'action,audit_id,o_orderdate,order_id', a.action
  FROM (
    SELECT o_orderkey * 2 AS id, o_orderdate AS d, 'deleted' AS action FROM deleted
    UNION ALL SELECT o_orderkey * 2 + 1, o_orderdate, 'deleted' FROM deleted WHERE o_totalprice > 250000
    UNION ALL SELECT (o_orderkey + {KEY_SHIFT}) * 2, o_orderdate, 'created' FROM created
  ) a
),
ev AS (
  SELECT *, 'run-' || year(d) AS run_id, 'month-' || month(d) AS scenario_id,
         row_number() OVER (ORDER BY entity_pos, key) - 1 AS idx
  FROM raw_events
)"""

# (exp_idx, entity, op, count, where, changed)
SHOP_EXPECTATIONS = [
    (0, "shop.orders", "insert", 3, None, None),
    (1, "orders", "delete", 5, None, None),
    (2, "orders", "update", 4, None, ["o_totalprice"]),
    (3, "shop.orders", "update", 6, None, None),
    (4, "order_audit", "insert", 2, {"action": '"deleted"'}, None),
    (5, "shop.customers", "update", 1, None, ["c_name"]),
]

# (rule_pos, id, kind, entity, cap, paths, caused_entity, caused_op, per_source, by, not_equals, rule_op, expires)
SHOP_RULES = [
    (0, "volatile_order_status", "volatile_columns", "shop.orders", 50, ["o_order*"], None, None, None, None, None, None, None),
    (1, "deletes_leave_audit", "derived", "order_audit", 50, None, "shop.orders", "delete", 1, None, None, None, None),
    (2, "order_create_audit", "derived", "shop.order_audit", 5, None, "orders", "insert", 1, None, None, None, None),
    (3, "reorder_backfill", "ignore", "orders", 5, None, None, None, None, None, None, "insert", "2099-12-31"),
]


def rules_frame(spark, rows, ruleset_id="shop") -> DataFrame:
    import datetime

    out = []
    for r in rows:
        expires = datetime.date.fromisoformat(r[12]) if r[12] else None
        out.append((ruleset_id, *r[:12], expires))
    return spark.createDataFrame(out, RULES)


def month_windows(spark, sf_dir) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    columns = month_window(lambda name: F.col(name))
    return orders.select(*[c.alias(n) for n, c in columns.items()]).distinct()


def shop_expectations(spark, sf_dir) -> DataFrame:
    declared = spark.createDataFrame(
        SHOP_EXPECTATIONS,
        "exp_idx int, entity string, op string, count long, where map<string,string>, changed array<string>",
    )
    # Six declarations, repeated for every window.
    each = month_windows(spark, sf_dir).withColumn("all", F.lit(1))
    joined = each.join(F.broadcast(declared.withColumn("all", F.lit(1))), "all")
    return joined.select(*[f.name for f in EXPECTATIONS])


def shop_rules(spark) -> DataFrame:
    return rules_frame(spark, SHOP_RULES)


# --- The event stream read as a change log ----------------------------------------------------
# One log per user. Position = event_id, so idx and seq are arrival order.


def feed(spark, sf_dir) -> DataFrame:
    events = table(spark, sf_dir, "events")
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    op = F.when(k < 50, "insert").when(k < 80, "update").otherwise("delete")
    image = F.to_json(F.struct(F.col("event_id").alias("id"), k.alias("k"), F.col("event_type").alias("type")))
    return events.select(
        F.lit("run-1").alias("run_id"),
        F.concat(F.lit("user-"), F.col("user_id")).alias("scenario_id"),
        F.lit("web").alias("surface"),
        F.lit(0).alias("window_seq"),
        F.col("event_id").alias("idx"),
        F.concat(F.lit("app."), F.col("event_type")).alias("entity"),
        op.alias("op"),
        F.to_json(F.struct(F.col("event_id").alias("id"))).alias("key"),
        F.when(op != "insert", image).alias("before"),
        F.when(op != "delete", image).alias("after"),
        F.when(op == "update", F.array(F.array(F.lit("k")), F.array(F.lit("meta"), F.concat(F.lit("last_"), F.col("event_type")))))
        .otherwise(F.array(F.array(F.lit("id")), F.array(F.lit("k")), F.array(F.lit("type"))))
        .alias("paths"),
        F.when(F.col("event_type") != "signup", F.concat_ws(":", "user_id", F.floor(F.col("event_id") / 1000))).alias("tx_id"),
        F.when(F.col("event_type") != "error", F.col("event_id")).alias("seq"),
        F.struct(
            F.when(F.col("event_type") == "click", "harness").otherwise("unknown").alias("kind"),
            F.col("user_id").cast("string").alias("id"),
            F.when(F.col("value") > 20, "worker").otherwise("app").alias("application_name"),
            F.lit(None).cast("string").alias("lsn"),
        ).alias("actor"),
        F.when(op == "update", "full").when(op == "insert", "value_only").otherwise("key_only").alias("fidelity"),
        F.col("ts"),
    )


FEED_SQL = """
feed AS (
  SELECT *, CASE WHEN k < 50 THEN 'insert' WHEN k < 80 THEN 'update' ELSE 'delete' END AS op,
         'user-' || user_id AS scenario_id, 'app.' || event_type AS entity, event_id AS idx,
         CASE WHEN event_type <> 'signup' THEN user_id || ':' || (event_id // 1000) END AS tx_id,
         CASE WHEN event_type <> 'error' THEN event_id END AS seq,
         CASE WHEN event_type = 'click' THEN 'harness' ELSE 'unknown' END AS actor_kind,
         CASE WHEN value > 20 THEN 'worker' ELSE 'app' END AS app
  FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events)
)"""


def marked_log(spark, sf_dir) -> DataFrame:
    """The feed with marker rows: open before a user's first event, close before the last.

    Users whose first event is an error have no open marker, those whose last is a view no
    close, and those whose last is a signup have them reversed.
    """
    events = table(spark, sf_dir, "events")
    rows = feed(spark, sf_dir).select(
        F.col("actor.id").alias("log_id"), (F.col("idx") * 2 + 1).alias("idx"), "entity", "op", "key", "after", "tx_id"
    )
    ends = events.groupBy(F.col("user_id").cast("string").alias("log_id")).agg(
        F.min("event_id").alias("first_id"),
        F.max("event_id").alias("last_id"),
        F.min_by("event_type", "event_id").alias("first_type"),
        F.max_by("event_type", "event_id").alias("last_type"),
    )
    reverse = F.col("last_type") == "signup"
    marks = ends.select(
        "log_id",
        F.explode(
            F.array_compact(
                F.array(
                    F.when(
                        F.col("first_type") != "error",
                        F.struct(
                            F.lit("open").alias("boundary"),
                            F.when(reverse, F.col("last_id")).otherwise(F.col("first_id")).alias("at"),
                        ),
                    ),
                    F.when(
                        F.col("last_type") != "view",
                        F.struct(
                            F.lit("close").alias("boundary"),
                            F.when(reverse, F.col("first_id")).otherwise(F.col("last_id")).alias("at"),
                        ),
                    ),
                )
            )
        ).alias("m"),
    )
    from changeproof.schema import MARKER_ENTITY

    image = F.to_json(
        F.struct(
            F.lit("run-1").alias("run_id"),
            F.concat(F.lit("user-"), F.col("log_id")).alias("scenario_id"),
            F.lit("web").alias("surface"),
            F.lit(0).alias("seq"),
            F.concat(F.lit("n"), F.col("log_id")).alias("nonce"),
            F.col("m.boundary").alias("boundary"),
        )
    )
    marks = marks.select(
        "log_id",
        (F.col("m.at") * 2).alias("idx"),
        F.lit(MARKER_ENTITY).alias("entity"),
        F.lit("insert").alias("op"),
        image.alias("key"),
        image.alias("after"),
        F.concat(F.lit("harness:"), F.col("log_id"), F.lit(":"), F.col("m.boundary")).alias("tx_id"),
    )
    return rows.unionByName(marks)


MARKS_SQL = """
ends AS (
  SELECT user_id, min(event_id) AS first_id, max(event_id) AS last_id,
         arg_min(event_type, event_id) AS first_type, arg_max(event_type, event_id) AS last_type
  FROM events GROUP BY user_id
),
pairs AS (
  SELECT CAST(user_id AS VARCHAR) AS log_id, 'user-' || user_id AS scenario_id, o, c,
         CASE WHEN o IS NULL THEN 'missing_open' WHEN c IS NULL THEN 'missing_close'
              WHEN c <= o THEN 'close_before_open' END AS reason
  FROM (
    SELECT user_id,
           CASE WHEN first_type <> 'error' THEN 2 * CASE WHEN last_type = 'signup' THEN last_id ELSE first_id END END AS o,
           CASE WHEN last_type <> 'view' THEN 2 * CASE WHEN last_type = 'signup' THEN first_id ELSE last_id END END AS c
    FROM ends
  )
)"""

# (exp_idx, entity, op, count, where, changed), repeated for every user.
FEED_EXPECTATIONS = [
    (0, "app.click", "insert", 2, None, None),
    (1, "purchase", "insert", 3, {"type": '"purchase"'}, None),
    (2, "app.purchase", "insert", 2, None, None),
    (3, "view", "update", 1, None, ["k"]),
    (4, "view", "update", 2, {"k": "60"}, None),
    (5, "app.signup", "delete", 40, None, None),
]

FEED_RULES = [
    (0, "volatile_meta", "volatile_columns", "view", 50, ["meta.last_*"], None, None, None, None, None, None, None),
    (1, "error_after_click", "derived", "error", 50, None, "app.click", "insert", 1, None, None, None, None),
    (2, "foreign_tx", "external_writer", "app.view", 10, None, None, None, None, "transaction", None, None, None),
    (3, "worker_writes", "external_writer", "signup", 25, None, None, None, None, "application_name", "app", None, None),
    (4, "purchase_backfill", "ignore", "purchase", 1, None, None, None, None, None, None, "delete", "2026-01-15"),
]


def feed_windows(spark, sf_dir) -> DataFrame:
    return feed(spark, sf_dir).select(*WINDOW).distinct()


def feed_expectations(spark, sf_dir) -> DataFrame:
    declared = spark.createDataFrame(
        FEED_EXPECTATIONS,
        "exp_idx int, entity string, op string, count long, where map<string,string>, changed array<string>",
    )
    each = feed_windows(spark, sf_dir).withColumn("all", F.lit(1))
    joined = each.join(F.broadcast(declared.withColumn("all", F.lit(1))), "all")
    return joined.select(*[f.name for f in EXPECTATIONS])


def feed_rules(spark) -> DataFrame:
    return rules_frame(spark, FEED_RULES, "feed")
