"""Sinks and readers of run records, hash trees, seeds and nested redaction."""

import hashlib
import json
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from changeproof.errors import Refused
from changeproof.operators import coverage, privacy, seed, suite
from changeproof.sinks import junit, network_log, run_facts
from changeproof.sinks.health import HealthStore
from changeproof.sinks.store import TableStore
from changeproof.sources.run_records import read_run_records

SCENARIOS = "run_id string, scenario_id string, surface string, result string, duration_ms long, requirements array<string>, missing array<string>, error_code string, captured long"
BUCKETS = "run_id string, scenario_id string, surface string, bucket string, n long"
RULES = "run_id string, scenario_id string, surface string, rule_id string, kind string, entity string, suppressed long, over_budget long, cap int, dead boolean, expired boolean"


def facts(spark, **changed):
    scenarios = [("r", "a", "web", "pass", 5, ["R-1", "R-2"], [], None, 3), ("r", "b", "web", "fail", 7, ["R-2"], [], "E_X", None), ("r", "b", "api", "skipped", 0, [], ["phone"], None, None)]
    buckets = [("r", "a", "web", "expected", 2), ("r", "a", "web", "unexplained", 1)]
    rules = [("r", "b", "web", "x", "ignore", "t", None, 1, 9, None, True), ("r", "a", "web", "x", "ignore", "t", 4, None, 5, False, None), ("r", "a", "web", "x", "ignore", "u", 1, 1, None, True, False)]
    rows = {"scenarios": scenarios, "buckets": buckets, "rules": rules} | changed
    return [spark.createDataFrame(rows[t], schema) for t, schema in (("scenarios", SCENARIOS), ("buckets", BUCKETS), ("rules", RULES))]


def test_facts_are_published_whole_and_once(spark, tmp_path, monkeypatch):
    store = TableStore(spark, str(tmp_path / "facts"))
    stage, written = TableStore.stage, []

    def dies(self, attempt, table, df):
        if len(written) == 4:
            raise KeyboardInterrupt
        written.append(table)
        return stage(self, attempt, table, df)

    monkeypatch.setattr(TableStore, "stage", dies)
    with pytest.raises(KeyboardInterrupt):
        run_facts.write_run_facts(store, "one", *facts(spark))
    monkeypatch.setattr(TableStore, "stage", stage)
    # Four tables are on disk, and no reader sees any of them.
    assert len(written) == 4 and len(list((tmp_path / "facts" / "data").iterdir())) == 1 and store.manifests() == []
    with pytest.raises(Refused) as e:
        store.read("scenarios")
    assert e.value.code == "E_STORE_EMPTY"

    assert run_facts.write_run_facts(store, "one", *facts(spark))
    (run,) = store.read("runs").collect()
    assert (run.total, run["pass"], run["fail"], run.skipped, run.status, run.exit_code, run.expected, run.explained, run.unexplained) == (3, 1, 1, 1, "fail", 1, 2, 0, 1)
    assert {(r.requirement, r.scenarios) for r in store.read("run_requirements").collect()} == {("R-1", 1), ("R-2", 2)}
    rules = {(r.rule_id, r.entity): (r.suppressed, r.over_budget, r.cap, r.dead, r.expired) for r in store.read("run_rules").collect()}
    assert rules == {("x", "t"): (4, 1, 5, False, True), ("x", "u"): (1, 1, None, True, False)}

    # A second run under the name changes nothing; another name adds to what readers see.
    before = store.manifests()
    other = facts(spark, scenarios=[("q", "z", "web", "pass", 1, [], [], None, 0)], buckets=[], rules=[])
    assert not run_facts.write_run_facts(store, "one", *other) and store.manifests() == before
    assert run_facts.write_run_facts(store, "two", *other)
    assert {r.run_id for r in store.read("runs").collect()} == {"r", "q"} and {r.run_id for r in store.read("runs", ["two"]).collect()} == {"q"}
    assert [m["tables"]["scenarios"]["rows"] for m in store.manifests()] == [3, 1]


def test_the_second_of_two_attempts_loses(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "s"))
    first, second = store.attempt(), store.attempt()
    for attempt, n in ((first, 1), (second, 2)):
        store.stage(attempt, "t", spark.range(n))
    system = store._system()

    class Blind:
        """A store whose look at the name comes too early to see the other's manifest."""

        def __getattr__(self, name):
            return (lambda _: False) if name == "exists" else getattr(system, name)

    late = TableStore(spark, str(tmp_path / "s"))
    late._system = Blind
    assert store.publish("x", first) and not late.publish("x", second)
    assert store.read("t").count() == 1
    with pytest.raises(Refused):
        store.publish("../x", first)


@pytest.mark.parametrize(
    ("changed", "problem"),
    [
        ({"scenarios": [("r", "a", "web", "skipped", 5, [], [], None, None)], "rules": []}, "skipped_names_nothing"),
        ({"scenarios": [("r", "a", "web", "pass", 5, [], ["phone"], None, None)], "rules": []}, "only_skipped_may_miss"),
        ({"scenarios": [("r", "a", "web", "infra_error", 5, [], [], None, None)], "rules": []}, "infra_error_without_code"),
        ({"scenarios": [("r", "a", "web", "odd", 5, [], None, None, None)], "rules": []}, "unknown_result"),
        ({"scenarios": [("r", "a", "web", "pass", 5, [], [], None, 9)], "rules": []}, "buckets_differ_from_captured"),
        ({"scenarios": [("r", "a", "web", "pass", 5, [], [], None, None)] * 2, "rules": []}, "scenario_twice"),
        ({"buckets": [("r", "a", "web", "lost", 3)], "rules": []}, "unknown_bucket"),
        ({"rules": [("r", "c", "web", "x", "ignore", "t", 1, 1, 1, False, False)]}, "facts_without_scenario"),
    ],
)
def test_records_that_contradict_themselves_are_refused(spark, tmp_path, changed, problem):
    store = TableStore(spark, str(tmp_path / "f"))
    with pytest.raises(Refused, match=problem):
        run_facts.write_run_facts(store, "one", *facts(spark, **changed))
    assert store.manifests() == []


def test_drift_is_refused(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "f"))
    stated = lambda **x: spark.createDataFrame([("r", *x.values())], ", ".join(["run_id string", *(f"{k} {'string' if isinstance(v, str) else 'long'}" for k, v in x.items())]))
    for wrong in ({"status": "pass"}, {"total": 4}, {"unexplained": 0}):
        with pytest.raises(Refused, match="drifted"):
            run_facts.write_run_facts(store, "one", *facts(spark), stated(**wrong))
    assert store.manifests() == [] and run_facts.write_run_facts(store, "one", *facts(spark), stated(status="fail", total=3, unexplained=1))


def test_junit_round_trip(spark, tmp_path):
    rows = [("a<1>", "web", "fail", 1500, 2, 'E"&', []), ("b", "web", "infra_error", 0, None, None, []), ("c", "api&b", "skipped", 10, None, None, ["x", "y"]), ("d", "web", "quarantined", 1, None, None, []), ("e", "web", "pass", 1, None, None, None)]
    frame = spark.createDataFrame(rows, "scenario_id string, surface string, result string, duration_ms long, step int, code string, missing array<string>").repartition(3)
    folders = junit.write_junit(frame, str(tmp_path / "j"))
    got = {(r.surface, r.scenario_id, r.seconds, r.failure, r.error, r.skipped) for r in junit.read_junit(spark, folders).collect()}
    assert got == {
        ("web", "a<1>", 1.5, 'step 2 E"&', None, None), ("web", "b", 0.0, None, "step 0 E_INFRA_ERROR", None), ("api&b", "c", 0.01, None, None, "x, y"), ("web", "d", 0.001, None, None, None), ("web", "e", 0.001, None, None, None),
    }
    suites = [ElementTree.parse(f).getroot() for f in (tmp_path / "j" / "surface=1").glob("part-*")]
    assert suites and all((s.tag, s.attrib) == ("testsuite", {"name": "web", "tests": "4", "failures": "1", "errors": "1", "skipped": "1"}) for s in suites)


def test_network_log_round_trip(spark, tmp_path):
    entries = spark.createDataFrame(
        [("p", i, "GET", f"https://h/x?sig={i}", 200, {"Cookie": "c", "a": "hunter22hunter"}, "line\nbreak") for i in range(5)] + [("q", 1, "GET", None, None, None, None)],
        "page string, seq long, method string, url string, status int, headers map<string,string>, body string",
    )
    path = str(tmp_path / "n")
    network_log.write_network_log(entries, path, ("hunter22",), most=3)
    lines = [json.loads(x) for f in sorted((tmp_path / "n").glob("part-*")) for x in f.read_text().splitlines()]
    own = [x for x in lines if x["page"] == "p"]
    assert own[-1] == {"page": "p", "truncated": 2} and [x["seq"] for x in own[:-1]] == [0, 1, 2]
    kept, cut = network_log.read_network_log(spark, path)
    assert [(r.page, r.truncated) for r in cut.collect()] == [("p", 2)]
    got = {(r.page, r.seq): (r.url, r.headers, r.body) for r in kept.collect()}
    assert got["p", 1] == ("https://h/x?sig=[REDACTED]", {"Cookie": "[REDACTED]", "a": "[REDACTED]hunter"}, "line\nbreak") and got["q", 1] == (None, None, None) and len(got) == 4


def test_records_of_several_versions(spark):
    record = {"run_record_version": 2, "run_id": "r", "duration_ms": 1, "scenarios": [{"id": "s", "requirements": ["R"]}], "delta": {"counts": {"expected": 3}}}
    old = {"run_record_version": 1, "run_id": "o", "duration_ms": 0}
    bad = [({**old, "delta": None}, "delta_in_old_version"), ({**record, "run_record_version": 3}, "unknown_version"), ({"run_id": "x"}, "unknown_version"), ({**record, "run_id": ""}, "no_run_id"), ({**record, "duration_ms": -1}, "duration_below_0")]
    lines = [json.dumps(record), json.dumps(old), *(json.dumps(b) for b, _ in bad), "{", "", "[1]"]
    records, rejected = read_run_records(spark.createDataFrame([(x,) for x in lines], "line string"))
    got = {r.run_id: r for r in records.collect()}
    assert set(got) == {"r", "o"} and got["o"].upgraded and not got["r"].upgraded and got["o"].run_record_version == 2 and got["r"].delta.counts == {"expected": 3}
    told = {r.line: r.problem for r in rejected.collect()}
    assert told == {json.dumps(b): p for b, p in bad} | {"{": "unreadable", "": "unreadable", "[1]": told["[1]"]} and told["[1]"] in ("unreadable", "unknown_version")


def test_digests_of_different_rows_differ(spark):
    frame = lambda *rows: spark.createDataFrame([(1, *r) for r in rows], "g int, a string, b string")
    sets = [frame(("x|y", "z")), frame(("x", "y|z")), frame((None, "z")), frame(("\\N", "z")), frame(("-", "z")), frame(("", "z")), frame(("1:x", "")), frame(("", "1:x")), frame(("x", "z"), ("x", "z")), frame(("x", "z"))]
    digests = [coverage.table_digest(s, ["a", "b"], ["g"]).first().digest for s in sets]
    assert len(set(digests)) == len(sets)
    many = spark.range(3000).select((F.col("id") % 2).alias("g"), F.col("id").alias("a"))
    assert coverage.table_digest(many, ["a"], ["g"]).orderBy("g").collect() == coverage.table_digest(many.repartition(5, F.rand(1)), ["a"], ["g"]).orderBy("g").collect()


def test_trees_name_the_rows_that_differ(spark, tmp_path):
    rows = [(i % 3 if i % 3 else None, f"v{i}", i % 7) for i in range(3000)]
    other = [r for k, r in enumerate(rows) if k % 1000 != 5] + [(None, "new", 1), rows[8], rows[8], (9, "alone", None)]
    schema = "g int, a string, b int"
    a, b = (seed.keep_tree(spark.createDataFrame(x, schema), ["a", "b"], ["g"], str(tmp_path)) for x in (rows, other))
    got = {(r.g, r.a, r.b, r.a_rows, r.b_rows) for r in seed.differing_rows(a, b).collect()}
    expected = {(*rows[k], 1, 0) for k in (5, 1005, 2005)} | {(None, "new", 1, 0, 1), (*rows[8], 1, 3), (9, "alone", None, 0, 1)}
    assert got == expected
    # Work grows with the differences: only the leaves of six rows are looked into.
    leaves = seed.differing_leaves(a, b).collect()
    assert len(leaves) == len(expected)
    assert seed.differing_rows(a, a).count() == 0 and seed.differing_leaves(a, a).count() == 0


def test_walk_and_seed_problems(spark):
    doc = {"name": "s", "a": [{"Raw": 1}, [["$uuid", "uuid"]], None], "b": {"c": {"$NOW": {"query": []}}}, "d": "{{ crypto.randomUUID }}"}
    frame = spark.createDataFrame([(1, json.dumps(doc)), (2, "no json"), (3, None), (4, "7"), (5, "{}")], "id int, json string")
    nodes = seed.walk(frame, ["id"], "json")
    assert {(r.id, ".".join(r.path)) for r in nodes.where("kind = 'scalar'").collect()} == {(1, p) for p in ("name", "a.0.Raw", "a.1.0.0", "a.1.0.1", "a.2", "d")}
    found = {(r.id, r.path, r.code) for r in seed.seed_problems(frame, ["id"], "json").collect()}
    assert found == {(1, "a.0.Raw", "E_SEED_UNSAFE"), (1, "a.1.0.0", "E_SEED_NON_DETERMINISTIC"), (1, "b.c.$NOW", "E_SEED_NON_DETERMINISTIC"), (1, "b.c.$NOW.query", "E_SEED_UNSAFE"), (1, "d", "E_SEED_NON_DETERMINISTIC")}


def test_nested_redaction(spark):
    secret = 'pass"word\\12'
    values = [
        {"a": [secret, {"b": {f"k {secret}": [1, 2.5, True, None, "x\ny\té\U0001f600\\"]}}], "c": "Bearer 0123456789abcdef tail", "d": "bearer of news", "e": 'a "quoted" \\" one', "f": {}, "g": []},
        "only " + secret, [], 5, {"long": 'line "x"\n' * 30_000},
    ]

    def plain(v):
        if isinstance(v, str):
            return v.replace(secret, "[REDACTED]").replace("Bearer 0123456789abcdef", "[REDACTED]")
        if isinstance(v, list):
            return [plain(x) for x in v]
        return {plain(k): plain(x) for k, x in v.items()} if isinstance(v, dict) else v

    frame = spark.createDataFrame([(i, json.dumps(v, ensure_ascii=i % 2 == 0)) for i, v in enumerate(values)] + [(98, "{"), (99, None)], "id int, json string")
    got = {r.id: r.out for r in frame.select("id", privacy.redact_nested(F.col("json"), (secret,)).alias("out")).collect()}
    assert [json.loads(got[i]) for i in range(len(values))] == [plain(v) for v in values] and got[98] is None and got[99] is None


def test_redaction_lists(spark):
    jwt = "eyJabcdefgh.abcdefgh.abcdefgh"
    row = spark.createDataFrame([(f"a bearer of news {jwt} xeyJabcdefgh.abcdefgh.abcdefgh eyJshort.abcdefgh.abcdefgh Bearer abcdefghijkl==, bearer abcdefghijk", "https://h/p?a=1&SIGNATURE=x&%6Bey=y&id_token=z&apikey#f", "no url")], "t string, u string, v string")
    got = row.select(privacy.redact_text(F.col("t"), []).alias("t"), privacy.redact_url(F.col("u")).alias("u"), privacy.redact_url(F.col("v")).alias("v"), privacy.redact_url(F.lit(None).cast("string")).alias("n")).first()
    assert got.t == "a bearer of news [REDACTED] xeyJabcdefgh.abcdefgh.abcdefgh eyJshort.abcdefgh.abcdefgh [REDACTED], bearer abcdefghijk"
    assert got.u == "https://h/p?a=1&SIGNATURE=[REDACTED]&%6Bey=[REDACTED]&id_token=z&apikey=[REDACTED]#f" and got.v == "[UNPARSEABLE_URL]" and got.n is None


def test_requests_are_paired_by_id(spark):
    requests = spark.createDataFrame([(1, 100, "a"), (2, 100, "b"), (3, 100, "c"), (4, 100, "d"), (None, 100, "e"), (5, 100, "f"), (5, 300, "g")], "request_id long, at_ms long, status string")
    replies = spark.createDataFrame(
        [(1, 150, 500, "t", None), (1, 170, None, None, None), (1, 160, 200, "u", None), (2, 90, 204, None, None), (3, 110, 200, "t", None), (3, 130, None, None, "reset"), (None, 110, 200, "t", None), (9, 110, 200, "t", None), (5, 200, 201, "v", None)],
        "request_id long, at_ms long, status int, content_type string, failure string",
    )
    got = {(r.request_id, r.request.status): tuple(r.reply) for r in suite.pair_by_id(requests, replies).collect()}
    assert got == {
        (1, "a"): (None, None, None, 70, "ok"), (2, "b"): (204, None, None, 0, "ok"), (3, "c"): (200, "t", "reset", 30, "failed"), (4, "d"): (None, None, None, None, "pending"), (None, "e"): (None, None, None, None, "pending"),
        (5, "f"): (201, "v", None, 100, "ok"), (5, "g"): (201, "v", None, 0, "ok"),
    }
    assert suite.pair_by_id(requests.limit(0), replies).count() == 0 and suite.pair_by_id(requests, replies.limit(0)).where("reply.outcome = 'pending'").count() == 7


def test_rule_health_is_recorded_once_a_run(spark, tmp_path):
    health = HealthStore(TableStore(spark, str(tmp_path / "h")))
    assert health.history().count() == 0 and health.health().count() == 0
    counts = lambda *rows: spark.createDataFrame(rows, "rule_id string, rule_hash string, suppressed int, over_budget long")
    assert health.record("a", 0, counts(("x", "1", 3, None), ("y", "1", None, None)))
    assert health.record("b", 1, counts(("x", "1", 0, 0), ("y", "1", 0, 1)))
    # A run that is recorded again changes nothing, nor does one that cannot be.
    assert not health.record("b", 1, counts(("x", "1", 9, 9)))
    for bad in ([("x", "1", 1, 1), ("x", "1", 2, 2)], [(None, "1", 1, 1)]):
        with pytest.raises(Refused) as e:
            health.record("bad", 2, counts(*bad))
        assert e.value.code == "E_RULE_COUNTS"
    assert health.record("c", 2, counts(("x", "1", 0, 0), ("x", "2", 0, 0)))
    got = {(r.rule_id, r.rule_hash): (r.run_idx, r.zero_runs, r.dead, r.proposed_action) for r in health.health(2).collect()}
    assert got == {("x", "1"): (2, 2, True, "delete_rule"), ("x", "2"): (2, 1, False, None), ("y", "1"): (1, 0, False, None)}


def test_rows_are_redacted_by_qualified_columns(spark):
    rows = spark.createDataFrame([("a\"b", 7, None, "hunter2hunter2"), ("[REDACTED]", None, "sha256:0123456789ab", None)], "x string, n int, `y` string, free string")
    policy = ["s.t.x", "*.n", "*.y", "s.other.free"]
    hashed = privacy.redact_entity(rows, "s.t", policy, "hash", ("hunter2hunter2",))
    digest = lambda text: "sha256:" + hashlib.sha256(text.encode()).hexdigest()[:12]
    assert [tuple(r) for r in hashed.collect()] == [(digest('"a\\"b"'), digest("7"), digest("null"), "[REDACTED]"), ("[REDACTED]", digest("null"), "sha256:0123456789ab", None)]
    assert privacy.redact_entity(hashed, "s.t", policy).collect() == hashed.collect()
    assert [tuple(r) for r in privacy.redact_entity(rows, "s.t", policy, "mask").collect()] == [("[REDACTED]",) * 3 + ("hunter2hunter2",), ("[REDACTED]", "[REDACTED]", "sha256:0123456789ab", None)]
    for bad in (["x"], ["s.*"], ["t.x"], ["s..x"], ["*.t.x"]):
        with pytest.raises(ValueError):
            privacy.redact_entity(rows, "s.t", bad)
    with pytest.raises(ValueError):
        privacy.redact_entity(rows, "t", policy)
