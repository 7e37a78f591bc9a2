"""Streams against their batch forms over several batches, nodes of screens, and sweeps of pages."""

import datetime

import pytest
from pyspark.sql import functions as F

from changeproof.operators import nodes as N, pages as G
from changeproof.streaming import windows as S
from changeproof.streaming.run import drained

START = datetime.datetime(2024, 1, 1)


def at(seconds):
    return START + datetime.timedelta(seconds=seconds)


def batches(spark, folder, schema, *parts):
    """A stream that brings the parts one after another."""
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_windows_over_batches(spark, tmp_path):
    w, v = ("r", "w", "n"), ("r", "v", "n")
    log = batches(
        spark, tmp_path / "log", "log_id string, idx long, boundary string, run_id string, scenario_id string, nonce string",
        [("a", 0, None, None, None, None), ("a", 2, None, None, None, None), ("a", 1, "open", *w), ("b", 0, "close", *v)],
        [("a", 3, "open", *v), ("a", 4, None, None, None, None), ("b", 1, "open", *v), ("b", 2, None, None, None, None)],
        [("a", 5, "close", *w), ("a", 6, None, None, None, None), ("a", 5000, None, None, None, None)],
    )
    told = {(r.log_id, r.idx, r.scenario_id, r.status, r.n_rows) for r in drained(S.stream_fence_windows(log, ["log_id"], expiry=1000)).collect()}
    assert told == {
        ("a", 0, None, "unfenced", None), ("a", 2, "w", "inside", None), ("a", 4, "w", "inside", None), ("a", 4, "v", "inside", None), ("a", 5, "w", "closed", 2), ("a", 6, "v", "inside", None),
        ("a", 5000, "v", "inside", None), ("a", 5000, "v", "missing_close", 3), ("b", 0, "v", "close_before_open", 0), ("b", 2, None, "unfenced", None),
    }


def test_numbers_and_health_over_batches(spark, tmp_path):
    rows = batches(spark, tmp_path / "seq", "log_id string, drain long, seq long", [("a", 0, 1), ("a", 0, 0)], [("a", 0, 2), ("a", 1, 0)], [("a", 3, 0), ("b", 3, 0)])
    got = drained(S.stream_rebase_seq(rows, ["log_id"], "drain")).orderBy("log_id", "seq").collect()
    assert [(r.log_id, r.seq) for r in got] == [("a", 0), ("a", 1), ("a", 2), ("a", 3), ("a", 4), ("b", 0)]

    runs = batches(
        spark, tmp_path / "runs", "rule_id string, rule_hash string, run_idx long, fired int", [("x", "h", 0, 0), ("x", "h", 1, 0)], [("x", "h", 2, 0), ("x", "h", 3, 1), ("x", "h", 4, 0)], [("x", None, 5, 0), ("x", "h", 5, 0)]
    )
    got = drained(S.stream_rule_health(runs)).orderBy(F.col("rule_hash").desc_nulls_last(), "run_idx").collect()
    assert [(r.run_idx, r.zero_runs, r.dead) for r in got] == [(0, 1, False), (1, 2, False), (2, 3, True), (3, 0, False), (4, 1, False), (5, 2, False), (5, 1, False)]


def test_numbers_by_buckets(spark, tmp_path, monkeypatch):
    """Python is called for each bucket of a batch and not for each source; sources of equal letters in other columns stay apart, rows without a drain go."""
    sorted_rows, calls = S._all, tmp_path / "calls"

    def counted(frames, order):
        with open(calls, "a") as f:
            f.write("x")
        return sorted_rows(frames, order)

    monkeypatch.setattr(S, "_all", counted)
    keys = [(f"l{i}", i) for i in range(1500)] + [(None, 1), ("null", 1), ("a", None), (None, None)]
    first = [(*k, d, n) for k in keys for d in (0, 2) for n in range(2)] + [("a", None, None, 0), ("only", 1, None, 0)]
    then = [(*k, d, n) for k in keys for d, n in ((2, 2), (3, 0), (7, 0))]
    rows = batches(spark, tmp_path / "seq", "log string, part int, drain long, seq long", first, then)
    got = [tuple(r) for r in drained(S.stream_rebase_seq(rows, ["log", "part"], "drain")).collect()]
    assert sorted(got, key=str) == sorted([(*k, d, n) for k in keys for d, n in ((0, 0), (0, 1), (2, 2), (2, 3), (2, 4), (3, 5), (7, 6))], key=str)
    assert calls.stat().st_size <= 2 * S.BUCKETS


def test_requests_and_quiet(spark, tmp_path):
    request = batches(spark, tmp_path / "q", "id string, at timestamp", [("one", at(0)), ("two", at(1))], [("late", at(500))])
    reply = batches(spark, tmp_path / "r", "id string, at timestamp, status int", [("one", at(0.25), 200), ("two", at(40), 500)], [("x", at(500), 200)])
    got = {(r.id, r.status, r.duration_ms) for r in drained(S.stream_pair_requests(request, reply, "id", "at")).collect()}
    assert got == {("one", 200, 250), ("two", None, None)}

    events = batches(spark, tmp_path / "e", "k string, at timestamp", [("a", at(0)), ("a", at(0.5))], [("a", at(2)), ("a", at(60))])
    got = sorted((r.n_events, r.waited_ms, r.noisy) for r in drained(S.stream_quiet_period(events, ["k"], "at", cap_ms=1000)).collect())
    assert got == [(1, 750, False), (2, 1000, True)]


def test_convergence_and_status(spark, tmp_path):
    matches = batches(
        spark, tmp_path / "m", "w string, at timestamp, exp_idx int, wanted long, n_expectations int",
        [("met", at(0), 0, 2, 2), ("met", at(1), 1, 1, 2), ("late", at(0), 0, 2, 1)], [("met", at(3), 0, 2, 2), ("late", at(20), 0, 2, 1), ("never", at(1), 0, 2, 1)], [("clock", at(500), 0, 2, 1)], [("clock", at(501), 0, 9, 1)],
    )
    got = {(r.w, r.result, r.took_ms) for r in drained(S.stream_convergence(matches, ["w"])).collect()}
    assert {("met", "ok", 3000), ("late", "miss", 10_000), ("never", "miss", 10_000)} == {g for g in got if g[0] != "clock"}

    records = batches(
        spark, tmp_path / "s", "run_id string, at timestamp, status string", [("good", at(0), "in_progress"), ("lost", at(0), "in_progress")], [("good", at(5), "pass")], [("clock", at(9_000), "in_progress")], [("clock", at(9_001), "in_progress")]
    )
    got = {(r.run_id, r.status) for r in drained(S.stream_run_status(records)).collect()}
    assert got == {("good", "pass"), ("lost", "stale")}


def test_run_status_by_buckets(spark, tmp_path, monkeypatch):
    """Python is called for each bucket of a batch and not for each run, and the answers are those of the runs by themselves."""

    class Counted(S._RunStatus):
        def handleInputRows(self, key, rows, timerValues):
            with open(tmp_path / "calls", "a") as f:
                f.write("x")
            yield from super().handleInputRows(key, rows, timerValues)

    monkeypatch.setattr(S, "_RunStatus", Counted)
    many = [(f"r{i}", at(i % 60), "in_progress" if i % 2 else "pass") for i in range(2000)]
    edges = [("eq", at(0), "in_progress"), ("above", at(0.001), "in_progress"), (None, at(0), "in_progress"), ("null", at(0), "in_progress"), ("two", at(0), "in_progress"), ("two", at(1), "pass"), ("two", at(2), "fail"), ("beats", at(0), "in_progress")]
    again = [("r0", at(70), "fail"), ("r1", at(70), "interrupted"), ("null", at(3), None), ("beats", at(1800), "in_progress"), ("beats", at(3601), "in_progress"), ("beats", at(3602), "pass"), ("r3", at(3600), "fail")]
    records = batches(spark, tmp_path / "s", "run_id string, at timestamp, status string", many + edges, again, [("clock", at(3610), "in_progress")], [("clock", at(3610), "in_progress"), ("eq", at(3604), "pass"), ("two", at(3605), "fail")])
    got = [(r.run_id, r.status) for r in drained(S.stream_run_status(records)).collect()]
    # At the last watermark, 3600, the runs that began at 0 are over, that of 0.001 is not.
    want = [(f"r{i}", "pass") for i in range(0, 2000, 2)] + [("r1", "interrupted"), ("r3", "fail"), ("eq", "stale"), (None, "stale"), ("null", None), ("two", "pass"), ("beats", "stale")]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert (tmp_path / "calls").stat().st_size <= 2 * S.BUCKETS


DUMP = """<hierarchy><node index="0" text="" class="a.Frame" bounds="[0,0][100,100]" enabled="true"><node text="Save &amp;amp; &#8364;&lt;" resource-id="com.x:id/save" class="android.widget.Button"
 bounds="[0,0][11,21]" enabled="true" checkable="true"/><node text="" content-desc=" Save " class="android.widget.Button" bounds="[200,0][211,21]" enabled="false"/><node text="Save" class="x.TextView" bounds="none"/></node></hierarchy>"""


def test_nodes(spark):
    nodes = N.flatten_dumps(spark.createDataFrame([("d", DUMP), ("empty", ""), ("null", None)], "dump_id string, dump string"))
    rows = nodes.orderBy("index").collect()
    assert [r.text for r in rows] == ["", "Save &amp; €<", "", "Save"] and rows[1].bounds.center_x == 5 and rows[1].bounds.height == 21 and rows[3].bounds is None
    names = ["selector_id", "resource_id", "resource_id_suffix", "text", "content_desc", "name_any", "class_name", "class_in", "nth", "container_id"]
    made = lambda **k: tuple(k.get(n) for n in names)
    selectors = spark.createDataFrame(
        [
            made(selector_id="save", resource_id_suffix="save"), made(selector_id="frame", class_name="a.Frame"), made(selector_id="in", class_in=N.ROLE_CLASSES["button"], container_id="frame"),
            made(selector_id="all", class_in=N.ROLE_CLASSES["button"]), made(selector_id="far", class_in=["Button"], nth=2), made(selector_id="name", name_any=" Save "),
        ],
        N.SELECTORS,
    )
    located = N.locate_one(N.contained_in(N.match_nodes(nodes, selectors)), selectors.select(F.lit("d").alias("dump_id"), "selector_id", "nth"))
    got = {r.selector_id: (r.reason, r.matches, r["index"]) for r in located.collect()}
    assert got == {"save": ("found", 1, 1), "frame": ("found", 1, 0), "in": ("found", 1, 1), "all": ("ambiguous", 2, None), "far": ("nth_out_of_range", 2, None), "name": ("found", 1, 2)}

    asserted = [("1", "name", "text", "Save", None), ("2", "name", "state", None, "disabled"), ("3", "save", "state", None, "unchecked"), ("4", "all", "hidden", None, None), ("5", "far", "count", "2", None), ("6", "save", "state", None, "focused")]
    asserted = spark.createDataFrame(asserted, "assert_id string, selector_id string, kind string, equals string, state string")
    got = {r.assert_id: (r.observed, r.ok) for r in N.ui_assertions(located, nodes, asserted).collect()}
    assert got == {"1": ("Save", True), "2": ("disabled", True), "3": ("unchecked", True), "4": ("hidden", True), "5": ("2", True), "6": ("not_focused", False)}
    with pytest.raises(Exception, match="without any part"):
        N.match_nodes(nodes, spark.createDataFrame([made(selector_id="bare")], N.SELECTORS)).collect()


def test_sweep(spark):
    long = "words " * 20
    rows = [
        (0, 200, "T", long, True, 0, 0, False, 0, 0, "auth_wall"), (1, 200, "T", "Internal server error " + long, False, 1, 1, False, 0, 0, "broken"), (2, 200, "T", long, False, 2, 0, False, 0, 0, "broken"),
        (3, 200, "T", long, False, 0, 1, True, 0, 0, "js_exception"), (4, 200, "T", None, False, None, None, None, None, None, "renders_nothing"), (5, 200, None, long + "Log in", False, 0, 0, True, 0, 0, "ok_login_wall"),
        (6, 200, "T", long * 9 + "log in", False, 0, 0, True, 1, 1, "ok_sw_broken"), (7, 200, "", long, False, 0, 0, False, 0, 0, "ok"), (8, None, "", long, False, 0, 0, False, 0, 0, "unreachable"),
    ]
    probes = spark.createDataFrame(rows, "page_id int, status int, title string, text string, requires_auth boolean, fatal int, page_errors int, sw_broken boolean, needless int, csp int, want string")
    got = {r.page_id: r.verdict for r in G.sweep_verdict(probes).collect()}
    assert got == {r[0]: r[-1] for r in rows}
