"""Streams over recorded rows, sweeps of pages, and page tags as the nodes of a screen."""

from pyspark.sql import functions as F

from changeproof.functions.canonical import json_value
from changeproof.operators import nodes as N, pages as G
from changeproof.plans import delta_queries, derive as D, log_queries
from changeproof.plans.register import Register
from changeproof.schema import MARKER_ENTITY
from changeproof.sources import events as E
from changeproof.streaming import windows as S
from changeproof.streaming.run import arriving, drained

REGISTER = Register()
query = REGISTER.query


@query(log_queries.REGISTER.oracle["fence_windows"])
def stream_fence_windows(spark, sf_dir):
    row, mark = F.coalesce("after", "key"), F.col("entity") == MARKER_ENTITY
    read = lambda *names: F.when(mark, F.coalesce(*[json_value(row, n) for n in names]))
    log = D.marked_log(spark, sf_dir).select(
        "log_id", "idx", read("kind", "marker", "boundary").alias("boundary"), read("run_id", "runId").alias("run_id"), read("scenario_id", "scenarioId").alias("scenario_id"), read("nonce").alias("nonce")
    )
    told = drained(S.stream_fence_windows(arriving(log), ["log_id"]))
    window = ["log_id", "run_id", "scenario_id", "nonce"]
    closed = told.filter("status = 'closed'").select(*window)
    return told.filter("status = 'inside'").join(closed, window).select("log_id", "scenario_id", "idx")


@query(f"WITH {D.FEED_SQL} SELECT scenario_id, idx // 1000 AS drain, row_number() OVER (PARTITION BY scenario_id ORDER BY idx) - 1 AS seq FROM feed")
def stream_rebase_seq(spark, sf_dir):
    rows = D.feed(spark, sf_dir).select("scenario_id", "idx", F.floor(F.col("idx") / 1000).alias("drain"))
    return drained(S.stream_rebase_seq(arriving(E.number_events(rows, ["scenario_id", "drain"], "idx").drop("idx")), ["scenario_id"], "drain"))


@query(delta_queries.REGISTER.oracle["dead_rules"])
def stream_rule_health(spark, sf_dir):
    runs = delta_queries._history(spark, sf_dir).select("rule_id", "rule_hash", "run_idx", (F.col("suppressed") + F.col("over_budget")).alias("fired"))
    return drained(S.stream_rule_health(arriving(runs)))


@query(
    """WITH g AS (SELECT user_id, ts, coalesce(ts >= lag(ts) OVER u + INTERVAL 900 SECOND, true)::INT AS fresh FROM events WINDOW u AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS nth FROM g),
    w AS (SELECT user_id, min(ts) AS began, max(ts) AS last, count(*) AS n_events FROM s GROUP BY user_id, nth)
    SELECT user_id, began, n_events, least((epoch_us(last + INTERVAL 900 SECOND) - epoch_us(began)) // 1000, 3600000) AS waited_ms, (epoch_us(last + INTERVAL 900 SECOND) - epoch_us(began)) // 1000 > 3600000 AS noisy
    FROM w WHERE date_trunc('milliseconds', last + INTERVAL 900 SECOND) <= (SELECT max(ts) - INTERVAL 10 SECOND FROM events)"""
)
def stream_quiet_period(spark, sf_dir):
    """Sessions of a user that a pause of fifteen minutes ended before the watermark; noisy beyond an hour."""
    rows = D.table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    told = drained(S.stream_quiet_period(arriving(rows), ["user_id"], "ts", 900_000, 3_600_000))
    return told.withColumn("began", F.col("began").cast("timestamp_ntz"))


LIMIT_MS = 5 * 86_400_000


@query(
    f"""WITH m AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 ELSE 2 END AS e FROM events WHERE event_type IN ('click', 'view', 'purchase')),
    n AS (SELECT *, row_number() OVER (PARTITION BY user_id, e ORDER BY ts) AS nth, min(ts) OVER (PARTITION BY user_id) AS began FROM m),
    w AS (SELECT user_id, any_value(began) AS began, count_if(nth = 4 - e) AS met, max(ts) FILTER (WHERE nth = 4 - e) AS last FROM n GROUP BY 1),
    t AS (SELECT *, (epoch_us(last) // 1000 - epoch_us(began) // 1000) AS took FROM w)
    SELECT user_id, CASE WHEN met = 3 AND took <= {LIMIT_MS} THEN 'ok' ELSE 'miss' END AS result, CASE WHEN met = 3 AND took <= {LIMIT_MS} THEN took ELSE {LIMIT_MS} END AS took_ms FROM t
    WHERE (met = 3 AND took <= {LIMIT_MS}) OR epoch_us(began) // 1000 + {LIMIT_MS} <= (SELECT epoch_us(max(ts)) // 1000 - 10000 FROM m) OR EXISTS (SELECT 1 FROM m WHERE m.user_id = t.user_id AND epoch_us(m.ts) // 1000 - epoch_us(began) // 1000 > {LIMIT_MS})"""
)
def stream_convergence(spark, sf_dir):
    """Users' first four clicks, three views and two purchases within five days of the first of them, in five batches."""
    kind = F.when(F.col("event_type") == "click", 0).when(F.col("event_type") == "view", 1).when(F.col("event_type") == "purchase", 2)
    matches = D.table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("at"), kind.alias("exp_idx"), (4 - kind).cast("long").alias("wanted"), F.lit(3).alias("n_expectations"))
    return drained(S.stream_convergence(arriving(matches.where("exp_idx IS NOT NULL"), "at", 5), ["user_id"], LIMIT_MS))


@query(
    """WITH o AS (SELECT o_orderkey, epoch_us(o_orderdate) // 1000 + o_orderkey % 3600 * 1000 AS began FROM orders),
    mark AS (SELECT max(began + CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 100 * 60000 ELSE 0 END) - 10000 AS ms FROM o)
    SELECT 'run-' || o_orderkey AS run_id, CASE WHEN o_orderkey % 5 > 0 AND o_orderkey % 100 <= 60 THEN CASE o_orderkey % 5 WHEN 1 THEN 'interrupted' ELSE 'pass' END ELSE 'stale' END AS status FROM o, mark
    WHERE (o_orderkey % 5 > 0) OR began + 3600000 <= mark.ms"""
)
def stream_run_status(spark, sf_dir):
    """Orders as runs: begun at a second of their day, four of five ended minutes later, those beyond an hour too late; in six batches."""
    key = F.col("o_orderkey")
    began = F.expr("timestampadd(SECOND, cast(o_orderkey % 3600 as int), cast(o_orderdate as timestamp))")
    ended = F.timestamp_add("MINUTE", (key % 100).cast("int"), began)
    row = lambda at, status: F.struct(at.alias("at"), status.alias("status"))
    both = F.array_compact(F.array(row(began, F.lit("in_progress")), F.when(key % 5 > 0, row(ended, F.when(key % 5 == 1, "interrupted").otherwise("pass")))))
    records = D.table(spark, sf_dir, "orders").select(F.concat(F.lit("run-"), key).alias("run_id"), F.explode(both).alias("x")).select("run_id", "x.*")
    return drained(S.stream_run_status(arriving(records, "at", 6)))


@query(
    """WITH q AS (SELECT event_id AS id, ts, event_id % 50 AS late FROM events WHERE event_type = 'click'), mark AS (SELECT least(max(ts), (SELECT max(ts + to_seconds(event_id % 50)) FROM events WHERE event_type = 'click' AND event_id % 3 > 0)) - INTERVAL 10 SECOND AS at FROM q)
    SELECT id, CASE WHEN id % 3 > 0 AND late <= 30 THEN (id % 5 * 100)::INT END AS status, CASE WHEN id % 3 > 0 AND late <= 30 THEN late * 1000 END AS duration_ms FROM q, mark
    WHERE (id % 3 > 0 AND late <= 30) OR ts + INTERVAL 30 SECOND < mark.at"""
)
def stream_pair_requests(spark, sf_dir):
    """Clicks as requests by their ids; two of three are answered, some of them too late. Both sides come in four batches."""
    clicks = D.table(spark, sf_dir, "events").where("event_type = 'click'").select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("at"))
    replies = clicks.where("id % 3 > 0").select("id", F.timestamp_add("SECOND", (F.col("id") % 50).cast("int"), F.col("at")).alias("at"), (F.col("id") % 5 * 100).cast("int").alias("status"))
    told = drained(S.stream_pair_requests(arriving(clicks, "at", 4), arriving(replies, "at", 4), "id", "at"))
    return told.select("id", "status", "duration_ms")


PROBES_SQL = r"""p AS (SELECT page_id, url, html, CASE page_id % 11 WHEN 0 THEN 0 WHEN 1 THEN 503 WHEN 2 THEN 404 ELSE 200 END AS status, regexp_extract(html, '<title[^>]*>([^<]*)', 1) AS title,
  CASE WHEN page_id % 11 = 3 THEN 'Sign in' WHEN page_id % 11 = 4 THEN 'Please log in to read on. This is the only thing that a visitor without a name may see of it.' ELSE regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '^\s+|\s+$', '', 'g') END AS text,
  page_id % 13 = 0 AS requires_auth, CASE WHEN page_id % 5 = 0 THEN 'script' ELSE 'image' END AS kind, CASE WHEN page_id % 10 = 0 THEN 'a/analytics.js' ELSE 'a/main.js' END AS asset FROM pages)"""


def probes(spark, sf_dir):
    nth = F.col("page_id") % 11
    text = F.when(nth == 3, "Sign in").when(nth == 4, "Please log in to read on. This is the only thing that a visitor without a name may see of it.").otherwise(F.regexp_replace("html", r"<[^>]*>", " "))
    kind, asset = F.when(F.col("page_id") % 5 == 0, "script").otherwise("image"), F.when(F.col("page_id") % 10 == 0, "a/analytics.js").otherwise("a/main.js")
    severity = G.request_severity(kind, F.lit(404), asset)
    return D.table(spark, sf_dir, "pages").select(
        "page_id", F.when(nth == 0, 0).when(nth == 1, 503).when(nth == 2, 404).otherwise(200).alias("status"), F.regexp_extract("html", r"<title[^>]*>([^<]*)", 1).alias("title"), text.alias("text"),
        (F.col("page_id") % 13 == 0).alias("requires_auth"), (severity == "fatal").cast("int").alias("fatal"), (severity == "needless").cast("int").alias("needless"),
        F.lit(0).alias("page_errors"), F.lit(False).alias("sw_broken"), (F.col("page_id") % 3 == 0).cast("int").alias("csp"),
    )


@query(
    f"""WITH {PROBES_SQL} SELECT page_id, CASE WHEN requires_auth THEN 'auth_wall' WHEN status = 0 THEN 'unreachable' WHEN status >= 500 THEN 'server_error' WHEN status = 404 THEN 'not_found'
      WHEN regexp_matches(text, '(?i)this deployment (cannot be found|has been deleted)|404: NOT_FOUND|DEPLOYMENT_NOT_FOUND|Application error: a client-side exception|Internal Server Error') THEN 'broken'
      WHEN kind = 'script' AND asset = 'a/main.js' THEN 'broken' WHEN length(text) < 60 THEN 'renders_nothing'
      WHEN regexp_matches(text, '(?i)\\b(sign in|log ?in|sign up|continue with|magic link|send sign-in link|email me a link|authenticate)\\b') AND length(text) < 900 THEN 'ok_login_wall'
      WHEN kind = 'script' THEN 'ok_analytics_404' WHEN page_id % 3 = 0 THEN 'ok_csp_warnings' ELSE 'ok' END AS verdict FROM p"""
)
def sweep_verdicts(spark, sf_dir):
    return G.sweep_verdict(probes(spark, sf_dir)).select("page_id", "verdict")


@query(
    """SELECT page_id, CASE WHEN page_id % 17 = 0 THEN 'request failed' WHEN page_id % 9 = 0 THEN 'off-origin' WHEN regexp_matches(left(html, 8000), 'DEPLOYMENT_NOT_FOUND|DEPLOYMENT_PAUSED|DEPLOYMENT_DISABLED|NOT_FOUND_ERROR')
      OR regexp_matches(trim(regexp_extract(left(html, 8000), '<title[^>]*>([^<]*)', 1)), '^(404|500|503):') THEN 'platform error' WHEN page_id % 5 = 0 THEN 'status' ELSE 'ok' END AS reached FROM pages"""
)
def reached_target(spark, sf_dir):
    nth = F.col("page_id")
    return G.reached_target(
        D.table(spark, sf_dir, "pages").select(
            "page_id", "url", F.when(nth % 9 == 0, "https://elsewhere.example.org/login").otherwise(F.col("url")).alias("landed"),
            F.when(nth % 17 == 0, None).when(nth % 5 == 0, 403).otherwise(200).alias("status"), F.col("html").alias("body"),
        )
    )


# --- Tags as nodes: class from the tag, id from its class, description from its target, text up to the next tag; lists and articles span 40 rows.
NODES_SQL = r"""t AS (SELECT page_id AS dump_id, unnest(regexp_extract_all(html, '<[a-z][a-z0-9]*[^<>]*>[^<]*')) AS raw, generate_subscripts(regexp_extract_all(html, '<[a-z][a-z0-9]*[^<>]*>[^<]*'), 1) - 1 AS index FROM pages),
n AS (SELECT dump_id, index::INT AS index, 'html.' || regexp_extract(raw, '^<([a-z][a-z0-9]*)', 1) AS class_name, CASE WHEN regexp_extract(raw, '\sclass="([^"]*)"', 1) = '' THEN '' ELSE 'page:id/' || regexp_extract(raw, '\sclass="([^"]*)"', 1) END AS resource_id,
  regexp_extract(raw, '\shref="([^"]*)"', 1) AS content_desc, regexp_extract(raw, '>([^<]*)$', 1) AS text, index AS top, index + CASE WHEN regexp_matches(raw, '^<(ul|article)') THEN 40 ELSE 1 END AS bottom FROM t),
s AS (SELECT * FROM (VALUES ('ad', NULL, 'ad', NULL, NULL, NULL, NULL::INT, NULL), ('the', NULL, NULL, '/the', NULL, NULL, NULL, NULL), ('list', NULL, NULL, NULL, 'html.ul', NULL, NULL, NULL), ('article', NULL, NULL, NULL, 'html.article', NULL, NULL, NULL),
  ('link', NULL, NULL, NULL, NULL, ['a'], NULL, 'list'), ('third', NULL, NULL, NULL, NULL, ['p', 'b'], 2, 'article'), ('none', 'page:id/none', NULL, NULL, NULL, NULL, NULL, NULL)) AS v(selector_id, resource_id, suffix, name_any, class_name, class_in, nth, container_id)),
m AS (SELECT n.*, s.selector_id, s.nth, s.container_id FROM n JOIN s ON (s.resource_id IS NULL OR s.resource_id = n.resource_id) AND (s.suffix IS NULL OR n.resource_id = s.suffix OR ends_with(n.resource_id, ':id/' || s.suffix))
  AND (s.name_any IS NULL OR s.name_any = n.text OR s.name_any = n.content_desc) AND (s.class_name IS NULL OR s.class_name = n.class_name) AND (s.class_in IS NULL OR list_contains(s.class_in, split_part(n.class_name, '.', 2)))),
b AS (SELECT dump_id, selector_id AS container_id, min(top) AS ctop, min(bottom) AS cbottom FROM m GROUP BY ALL HAVING count(*) = 1),
c AS (SELECT m.* FROM m LEFT JOIN b USING (dump_id, container_id) WHERE m.container_id IS NULL OR (top >= ctop AND bottom <= cbottom))"""
LOCATED_SQL = f"""{NODES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY dump_id, selector_id ORDER BY index) - 1 AS place FROM c),
f AS (SELECT dump_id, selector_id, count(*) AS matches, min(CASE WHEN place = coalesce(nth, 0) THEN index END) AS picked FROM r GROUP BY ALL),
l AS (SELECT p.page_id AS dump_id, s.selector_id, coalesce(matches, 0) AS matches, CASE WHEN coalesce(matches, 0) = 0 THEN 'not_found' WHEN s.nth >= matches THEN 'nth_out_of_range' WHEN s.nth IS NULL AND matches > 1 THEN 'ambiguous' ELSE 'found' END AS reason, picked
  FROM pages p CROSS JOIN s LEFT JOIN f ON f.dump_id = p.page_id AND f.selector_id = s.selector_id)"""
SELECTED = [
    ("ad", None, "ad", None, None, None, None, None, None, None), ("the", None, None, None, None, "/the", None, None, None, None), ("list", None, None, None, None, None, "html.ul", None, None, None),
    ("article", None, None, None, None, None, "html.article", None, None, None), ("link", None, None, None, None, None, None, ["a"], None, "list"),
    ("third", None, None, None, None, None, None, ["p", "b"], 2, "article"), ("none", "page:id/none", None, None, None, None, None, None, None, None),
]


def page_nodes(spark, sf_dir):
    """Each page's tags written as a dump, and that read as nodes."""

    def escaped(x):
        for character, entity in (("&", "&amp;"), ('"', "&quot;"), ("<", "&lt;"), (">", "&gt;")):
            x = F.replace(x, F.lit(character), F.lit(entity))
        return x

    def node(raw, index):
        part = lambda pattern: F.regexp_extract(raw, pattern, 1)
        bottom = index + F.when(F.rlike(raw, F.lit("^<(ul|article)")), 40).otherwise(1)
        marked = part(r'\sclass="([^"]*)"')
        values = {
            "class": F.concat(F.lit("html."), part("^<([a-z][a-z0-9]*)")), "resource-id": F.when(marked == "", "").otherwise(F.concat(F.lit("page:id/"), marked)),
            "content-desc": part(r'\shref="([^"]*)"'), "text": part(">([^<]*)$"), "bounds": F.format_string("[0,%d][100,%d]", index, bottom), "enabled": F.lit("true"),
        }
        return F.concat(F.lit("<node"), *[F.concat(F.lit(f' {k}="'), escaped(v), F.lit('"')) for k, v in values.items()], F.lit("/>"))

    tags = F.regexp_extract_all("html", F.lit("<[a-z][a-z0-9]*[^<>]*>[^<]*"), F.lit(0))
    return N.flatten_dumps(D.table(spark, sf_dir, "pages").select(F.col("page_id").alias("dump_id"), F.array_join(F.transform(tags, node), "\n").alias("dump")))


def page_matches(spark, sf_dir):
    return N.contained_in(N.match_nodes(page_nodes(spark, sf_dir), spark.createDataFrame(SELECTED, N.SELECTORS)))


def page_located(spark, sf_dir):
    asked = F.explode(F.array(*[F.struct(F.lit(s[0]).alias("selector_id"), F.lit(s[8]).cast("int").alias("nth")) for s in SELECTED])).alias("a")
    return N.locate_one(page_matches(spark, sf_dir), D.table(spark, sf_dir, "pages").select(F.col("page_id").alias("dump_id"), asked).select("dump_id", "a.*"))


@query(f"WITH {NODES_SQL} SELECT dump_id, index, class_name, resource_id, content_desc, text, top::INT AS top, bottom::INT AS bottom FROM n")
def ui_nodes(spark, sf_dir):
    return page_nodes(spark, sf_dir).select("dump_id", "index", "class_name", "resource_id", "content_desc", "text", "bounds.top", "bounds.bottom")


@query(f"WITH {NODES_SQL} SELECT dump_id, selector_id, index FROM c")
def node_matches(spark, sf_dir):
    return page_matches(spark, sf_dir).select("dump_id", "selector_id", "index")


@query(f"WITH {LOCATED_SQL} SELECT dump_id, selector_id, reason, matches, CASE WHEN reason = 'found' THEN picked END AS index FROM l")
def locate_one(spark, sf_dir):
    return page_located(spark, sf_dir).select("dump_id", "selector_id", "reason", "matches", "index")


@query(
    f"""WITH {LOCATED_SQL} SELECT dump_id, 'seen' AS assert_id, CASE WHEN reason = 'found' THEN 'visible' ELSE reason END AS observed, reason = 'found' AS ok FROM l WHERE selector_id = 'article'
    UNION ALL SELECT dump_id, 'gone', 'hidden', true FROM l WHERE selector_id = 'none' UNION ALL SELECT dump_id, 'six', matches::VARCHAR, matches = 6 FROM l WHERE selector_id = 'link'"""
)
def ui_assertions(spark, sf_dir):
    asserted = spark.createDataFrame([("seen", "article", "visible", None, None), ("gone", "none", "hidden", None, None), ("six", "link", "count", "6", None)], "assert_id string, selector_id string, kind string, equals string, state string")
    return N.ui_assertions(page_located(spark, sf_dir), page_nodes(spark, sf_dir), asserted).select("dump_id", "assert_id", "observed", "ok")
