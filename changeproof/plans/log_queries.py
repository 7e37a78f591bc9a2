"""Change logs: fences, transactions, numbering, refusals and decoders, over the event stream."""

from pyspark.sql import functions as F

from changeproof.operators import allocate, fence
from changeproof.plans import derive as D
from changeproof.plans.register import Register
from changeproof.schema import WINDOW
from changeproof.sources import documents, events as E, row_log, slot_log

REGISTER = Register()
query = REGISTER.query


@query(f"WITH {D.MARKS_SQL} SELECT log_id, o AS open_idx, c AS close_idx, reason FROM pairs WHERE o IS NOT NULL OR c IS NOT NULL")
def fence_pairs(spark, sf_dir):
    return fence.marker_pairs(D.marked_log(spark, sf_dir), ["log_id"]).select("log_id", "open_idx", "close_idx", "reason")


@query(
    f"""WITH {D.MARKS_SQL} SELECT p.log_id, p.scenario_id, e.event_id * 2 + 1 AS idx FROM pairs p JOIN events e ON CAST(e.user_id AS VARCHAR) = p.log_id
    WHERE reason IS NULL AND e.event_id * 2 + 1 > o AND e.event_id * 2 + 1 < c"""
)
def fence_windows(spark, sf_dir):
    log = D.marked_log(spark, sf_dir)
    return fence.fence_slice(log, ["log_id"], fence.marker_pairs(log, ["log_id"])).select("log_id", "scenario_id", "idx")


@query(
    f"""WITH {D.MARKS_SQL} SELECT CAST(e.user_id AS VARCHAR) AS log_id, e.event_id * 2 + 1 AS idx FROM events e LEFT JOIN pairs p ON CAST(e.user_id AS VARCHAR) = p.log_id
    WHERE NOT coalesce(reason IS NULL AND e.event_id * 2 + 1 > o AND e.event_id * 2 + 1 < c, false)"""
)
def unfenced_windows(spark, sf_dir):
    log = D.marked_log(spark, sf_dir)
    return fence.unfenced(log, ["log_id"], fence.marker_pairs(log, ["log_id"])).select("log_id", "idx")


@query(f"WITH {D.FEED_SQL} SELECT scenario_id, tx_id, count(seq) AS n_events, min(seq) AS first_seq, max(seq) AS last_seq FROM feed WHERE tx_id IS NOT NULL GROUP BY ALL")
def tx_groups(spark, sf_dir):
    rows = D.feed(spark, sf_dir)
    return E.tx_summary(E.tx_groups(rows, rows.select("scenario_id", "tx_id"), ["scenario_id"]), ["scenario_id"])


@query("SELECT event_id AS idx, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq FROM events")
def rebase_seq(spark, sf_dir):
    """Numbers of each drain of a thousand positions, continued over the drains of a user."""
    rows = D.feed(spark, sf_dir).select("scenario_id", "idx", F.floor(F.col("idx") / 1000).alias("drain"))
    local = E.number_events(rows, ["scenario_id", "drain"], "idx")
    return E.rebase_seq(local, ["scenario_id"], "drain").select("idx", "seq")


@query(
    """SELECT event_id AS idx, concat_ws(',', CASE WHEN event_type = 'view' THEN 'entity' END, CASE WHEN k % 7 = 0 THEN 'op' END, CASE WHEN value > 90 THEN 'fidelity' END,
      CASE WHEN k % 11 = 0 THEN 'key' END) AS reasons
    FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events) WHERE event_type = 'view' OR k % 7 = 0 OR value > 90 OR k % 11 = 0"""
)
def change_event_rejects(spark, sf_dir):
    """The feed with faults written in: unqualified entities, unknown operations, fidelities and keys."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    raw = D.table(spark, sf_dir, "events").select(k.alias("k"), "value", "event_type", F.col("event_id").alias("idx"))
    rows = D.feed(spark, sf_dir).join(raw, "idx").withColumns(
        {
            "entity": F.when(F.col("event_type") == "view", "view").otherwise(F.col("entity")),
            "op": F.when(F.col("k") % 7 == 0, "upsert").otherwise(F.col("op")),
            "fidelity": F.when(F.col("value") > 90, "some").otherwise(F.col("fidelity")),
            "key": F.when(F.col("k") % 11 == 0, "[1]").otherwise(F.col("key")),
        }
    )
    return E.read_change_events(rows).rejects.select("idx", F.array_join("reasons", ",").alias("reasons"))


@query(
    f"""WITH {D.FEED_SQL}, d AS (SELECT * FROM (SELECT DISTINCT scenario_id FROM feed), (VALUES (0, 2), (1, 3), (2, 2), (3, 1), (4, 2), (5, 40)) v(exp_idx, n)),
    hits AS (
      SELECT d.scenario_id, d.exp_idx, d.n, f.ms, row_number() OVER (PARTITION BY d.scenario_id, d.exp_idx ORDER BY f.ms, f.idx) AS r
      FROM d JOIN (SELECT *, epoch_us(ts) // 1000 AS ms FROM feed) f ON f.scenario_id = d.scenario_id AND CASE d.exp_idx
        WHEN 0 THEN f.entity = 'app.click' AND f.op = 'insert' WHEN 1 THEN f.entity = 'app.purchase' AND f.op = 'insert' WHEN 2 THEN f.entity = 'app.purchase' AND f.op = 'insert'
        WHEN 3 THEN f.entity = 'app.view' AND f.op = 'update' WHEN 4 THEN f.entity = 'app.view' AND f.op = 'update' AND f.k = 60 ELSE f.entity = 'app.signup' AND f.op = 'delete' END
    ), met AS (SELECT scenario_id, exp_idx, ms FROM hits WHERE r = n)
    SELECT d.scenario_id, count(*) AS declared, count(met.ms) AS met, count(met.ms) = count(*) AS ok
    FROM d LEFT JOIN met USING (scenario_id, exp_idx) GROUP BY ALL"""
)
def time_to_converge(spark, sf_dir):
    rows = D.feed(spark, sf_dir).withColumn("at_ms", F.unix_millis(F.col("ts").cast("timestamp")))
    starts = rows.groupBy(*WINDOW).agg(F.min("at_ms").alias("start_ms"))
    found = allocate.time_to_converge(rows, D.feed_expectations(spark, sf_dir), starts, timeout_ms=10**12)
    return found.select("scenario_id", "declared", "met", "ok")


def _slot_lines(spark, sf_dir):
    events = D.table(spark, sf_dir, "events")
    k = F.regexp_extract("props", "([0-9]+)", 1)
    row = F.concat(F.lit("id[bigint]:"), F.col("event_id"), F.lit(" k[integer]:"), k, F.lit(" type[text]:'"), F.col("event_type"), F.lit("' note[text]:'it''s: a, b'"))
    line = F.when(F.col("event_type") == "error", F.lit("message: what is this")).when(
        F.col("event_type") == "signup", F.concat(F.lit("table app.signup: DELETE: id[bigint]:"), F.col("event_id"))
    ).otherwise(F.concat(F.lit("table app."), F.col("event_type"), F.lit(": INSERT: "), row))
    return events.select(F.lit("0/1").alias("lsn"), F.col("user_id").cast("string").alias("xid"), line.alias("data"), F.col("event_id").alias("position"))


@query(
    """SELECT event_id AS position, 'app.' || event_type AS entity, CASE WHEN event_type = 'signup' THEN 'delete' ELSE 'insert' END AS op,
    CASE WHEN event_type = 'signup' THEN 'key_only' ELSE 'value_only' END AS fidelity,
    CASE WHEN event_type <> 'signup' THEN '{"id":' || event_id || ',"k":' || CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) || ',"note":"it''s: a, b","type":"' || event_type || '"}' END AS after
    FROM events WHERE event_type <> 'error'"""
)
def slot_log_events(spark, sf_dir):
    split, _ = slot_log.decode_slot_log(_slot_lines(spark, sf_dir))
    return split.events.select("position", "entity", "op", "fidelity", "after")


@query("SELECT event_id AS position, 'unknown_line_kind' AS reason FROM events WHERE event_type = 'error'")
def slot_log_rejects(spark, sf_dir):
    split, _ = slot_log.decode_slot_log(_slot_lines(spark, sf_dir))
    return split.rejects.select("position", "reason")


@query(
    """SELECT user_id AS xid, event_id AS position, 'insert' AS op, 'app.' || event_type AS entity, '{"id":' || event_id || '}' AS key FROM events WHERE event_type <> 'error'"""
)
def row_log_events(spark, sf_dir):
    events = D.table(spark, sf_dir, "events")
    image = F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type")))
    rows = events.select(
        F.when(F.col("event_type") == "error", "query").otherwise("write_rows").alias("type"), F.lit("app").alias("schema"), F.col("event_type").alias("table"),
        F.col("user_id").alias("xid"), F.array(image).alias("rows"), F.col("event_id").alias("position"),
    )
    kinds = ("click", "view", "purchase", "signup", "error")
    return row_log.explode_row_log(rows, {f"app.{t}": ["id"] for t in kinds}).events.select(F.col("tx_id").cast("long").alias("xid"), "position", "op", "entity", "key")


@query(
    """SELECT event_id AS position, CASE WHEN event_type = 'view' THEN 'replace' WHEN event_type = 'signup' THEN 'delete' ELSE 'insert' END AS raw,
    CASE WHEN event_type = 'view' THEN 'update' WHEN event_type = 'signup' THEN 'delete' ELSE 'insert' END AS op, 'app.' || event_type AS entity FROM events WHERE event_type <> 'error'"""
)
def document_feed(spark, sf_dir):
    rows = _document_rows(spark, sf_dir)
    return documents.read_document_changes(rows).events.select("position", "raw", "op", "entity")


@query("SELECT event_id AS position, 'stream_lifecycle_event' AS reason FROM events WHERE event_type = 'error'")
def document_feed_rejects(spark, sf_dir):
    return documents.read_document_changes(_document_rows(spark, sf_dir)).rejects.select("position", "reason")


def _document_rows(spark, sf_dir):
    events = D.table(spark, sf_dir, "events")
    kind = F.col("event_type")
    operation = F.when(kind == "view", "replace").when(kind == "signup", "delete").when(kind == "error", "drop").otherwise("insert")
    image = F.to_json(F.struct(F.col("event_id").alias("_id"), kind.alias("type")))
    null = F.lit(None).cast("string")
    return events.select(
        operation.alias("operation_type"), operation.alias("raw"), F.lit("app").alias("db"), kind.alias("coll"), F.to_json(F.struct(F.col("event_id").alias("_id"))).alias("document_key"),
        F.when(kind != "signup", image).alias("full_document"), F.when(kind == "view", image).alias("full_document_before_change"), null.alias("updated_fields"),
        F.lit(None).cast("array<string>").alias("removed_fields"), null.alias("lsid"), F.lit(None).cast("long").alias("txn_number"), F.col("event_id").alias("position"),
    )


@query(
    """WITH r AS (SELECT *, epoch_us(ts) // 1000 AS ms, lag(epoch_us(ts) // 1000) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events),
    g AS (SELECT user_id, ms, ms - before AS gap FROM r),
    q AS (SELECT user_id, min(ms) AS first_at, max(ms) AS last_at, count(*) AS n, min(CASE WHEN gap >= 7200000 THEN ms - gap END) AS quiet_from FROM g GROUP BY 1)
    SELECT user_id, n, coalesce(quiet_from, last_at) - first_at AS settled_ms, quiet_from IS NULL AS quiet_at_end FROM q"""
)
def quiet_period(spark, sf_dir):
    """When each user's stream first falls silent for two hours, after its first event."""
    from changeproof.operators.suite import quiet_from

    rows = D.table(spark, sf_dir, "events").withColumn("at_ms", F.unix_millis(F.col("ts").cast("timestamp")))
    return quiet_from(rows, ["user_id"], "at_ms", "event_id", 7_200_000).select("user_id", "n", "settled_ms", "quiet_at_end")


@query(
    """WITH r AS (SELECT user_id, event_id, ts, event_type, lead(event_id) OVER w AS next_id, lead(event_type) OVER w AS next_type, epoch_us(lead(ts) OVER w) // 1000 - epoch_us(ts) // 1000 AS ms
      FROM events WHERE event_type IN ('view', 'click', 'error') WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT user_id, event_id AS request_id, CASE WHEN next_type <> 'view' THEN next_id END AS response_id, CASE WHEN next_type <> 'view' THEN ms END AS duration_ms,
      CASE WHEN next_type IS NULL OR next_type = 'view' THEN 'pending' WHEN next_type = 'error' THEN 'failed' ELSE 'ok' END AS outcome FROM r WHERE event_type = 'view'"""
)
def pair_requests(spark, sf_dir):
    """Views as requests, each with the click or error that follows before the next view."""
    from changeproof.operators.suite import pair_next

    rows = D.table(spark, sf_dir, "events").filter(F.col("event_type").isin("view", "click", "error")).withColumn("at_ms", F.unix_millis(F.col("ts").cast("timestamp")))
    return pair_next(rows, "user_id", "at_ms", "event_id", F.col("event_type") == "view", F.col("event_type") == "error")


@query(
    """SELECT event_id AS request_id, user_id, CASE WHEN event_id % 5 IN (0, 1) THEN (200 + event_id % 3)::INT WHEN event_id % 5 = 2 THEN 304 END AS status, CASE WHEN event_id % 5 IN (0, 1, 2) THEN event_type END AS content_type,
      CASE event_id % 5 WHEN 1 THEN 'late' WHEN 3 THEN 'reset' END AS failure, CASE event_id % 5 WHEN 0 THEN greatest(event_id % 100 - 20, 0) WHEN 1 THEN 150 WHEN 2 THEN 90 WHEN 3 THEN 70 END AS duration_ms,
      CASE WHEN event_id % 5 IN (1, 3) THEN 'failed' WHEN event_id % 5 = 4 THEN 'pending' ELSE 'ok' END AS outcome FROM events"""
)
def pair_requests_by_id(spark, sf_dir):
    """Events as requests by their ids: answered (some before they were asked), answered and then failed, answered twice, failed, or left alone."""
    from changeproof.operators.suite import pair_by_id

    requests = D.table(spark, sf_dir, "events").select(F.col("event_id").alias("request_id"), "user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"), "event_type")
    row = lambda wait, status, failure: F.struct((F.col("at_ms") + wait).alias("at_ms"), status.cast("int").alias("status"), F.lit(failure).cast("string").alias("failure"))
    key, none = F.col("request_id"), F.lit(None)
    kind, answer = key % 5, 200 + key % 3
    came = (
        F.when(kind == 0, F.array(row(key % 100 - 20, answer, None))).when(kind == 1, F.array(row(150, none, "late"), row(30, answer, None)))
        .when(kind == 2, F.array(row(90, F.lit(304), None), row(10, F.lit(500), None))).when(kind == 3, F.array(row(70, none, "reset"), row(60, none, "slow")))
    )
    replies = requests.select("request_id", F.when(kind < 3, F.col("event_type")).alias("content_type"), F.explode(came.alias("x")).alias("x")).select("request_id", "content_type", "x.*")
    strays = replies.withColumn("request_id", -F.col("request_id") - 1)
    return pair_by_id(requests, replies.unionByName(strays)).select("request_id", "request.user_id", "reply.*")


@query(
    """WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rank, count(*) OVER (PARTITION BY user_id) AS n FROM events)
    SELECT user_id, event_id, rank, greatest(n - 20, 0) AS truncated FROM r WHERE rank <= 20"""
)
def first_entries(spark, sf_dir):
    """The first twenty entries of each user and how many were left out."""
    from changeproof.operators.scale import first_n

    rows = D.table(spark, sf_dir, "events").select("user_id", "event_id")
    sizes = rows.groupBy("user_id").agg(F.greatest(F.count("*") - 20, F.lit(0)).alias("truncated"))
    return first_n(rows, ["user_id"], ["event_id"], 20).join(sizes, "user_id").select("user_id", "event_id", F.col("rank").cast("long").alias("rank"), "truncated")
