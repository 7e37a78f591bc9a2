"""The core on small frames: windows without events, null keys, numbers, rules, health, logs and digests."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from changeproof.errors import Refused
from changeproof.functions import canonical
from changeproof.operators import classify as C, coverage, privacy, rules as R, scale, suite
from changeproof.plans import derive, registry
from changeproof.plans.derive import rules_frame
from changeproof.schema import CHANGE_EVENTS, EXPECTATIONS, WINDOW
from changeproof.sources import events as E, slot_log

AS_OF = datetime.date(2026, 1, 15)


def event(idx, entity, op, after=None, tx=None, kind="unknown", window="w", seq=None, paths=None):
    image = after or '{"id":%d}' % idx
    return ("r", window, "db", 0, idx, entity, op, '{"id":%d}' % idx, image if op != "insert" else None, image if op != "delete" else None, paths or [["id"]], tx, seq, (kind, None, None, None), "full")


def frames(spark, events, expectations, rules):
    return (
        spark.createDataFrame(events, CHANGE_EVENTS), spark.createDataFrame([("r", w, "db", 0, *rest) for w, *rest in expectations], EXPECTATIONS), rules_frame(spark, rules, "s"),
    )


DERIVED = (0, "audit", "derived", "audit", 50, None, "orders", "delete", 1, None, None, None, None)


@pytest.mark.parametrize(("deletes", "audits", "explained"), [(1, 47, 1), (3, 3, 3), (0, 2, 0)])
def test_derived_rule_explains_as_many_as_its_sources(spark, deletes, audits, explained):
    rows = [event(i, "app.orders", "delete") for i in range(deletes)] + [event(100 + i, "app.audit", "insert") for i in range(audits)]
    e, x, r = frames(spark, rows, [("w", 0, "app.orders", "delete", deletes, None, None)], [DERIVED])
    got = C.bucket_counts(C.classify(e, x, r, AS_OF, "s").classified).first()
    assert (got.expected, got.explained, got.unexplained) == (deletes, explained, audits - explained)


def test_an_engine_explains_in_place_of_the_rules(spark):
    rows = [event(0, "app.orders", "delete")] + [event(i, "app.audit", "insert") for i in (1, 2, 3, 4)]
    second = (1, "other", "derived", "audit", 1, None, "orders", "delete", 1, None, None, None, None)
    e, x, r = frames(spark, rows, [("w", 0, "app.orders", "delete", 1, None, None)], [DERIVED, second])
    seen = []

    def engine(events, rules):
        seen.append((events.count(), rules.count()))
        told = [(0, "audit", None), (1, "other", None), (1, "audit", None), (1, "zzz", None), (2, "someone", "external_writer"), (3, None, "derived"), (99, "audit", None)]
        window = events.select("run_id", "scenario_id", "surface", "window_seq").distinct()
        return window.join(spark.createDataFrame(told, "idx long, rule_id string, kind string"))

    delta = C.classify(e, x, r, AS_OF, "s", engine=engine)
    assert {(c.idx, c.bucket, c.rule_id, c.rule_kind) for c in delta.classified.collect()} == {
        (0, "expected", None, None), (1, "explained", "audit", "derived"), (2, "suppressed_external", "someone", "external_writer"), (3, "unexplained", None, None), (4, "unexplained", None, None),
    }
    assert seen == [(5, 2)] and {(s.id, s.suppressed, s.over_budget) for s in delta.rule_stats.collect()} == {("audit", 2, 0), ("other", 0, 0)}
    silent = C.classify(e, x, r, AS_OF, "s", engine=lambda events, rules: engine(events, rules).limit(0))
    assert C.bucket_counts(silent.classified).first().unexplained == 4


def test_declared_windows_without_events_get_a_verdict(spark):
    e, x, r = frames(spark, [event(1, "app.orders", "delete")], [("w", 0, "orders", "delete", 1, None, None), ("silent", 0, "orders", "insert", 2, None, None)], [DERIVED])
    delta = C.classify(e, x, r, AS_OF, "s")
    got = {v.scenario_id: (v.total, v.failed) for v in C.window_verdicts(delta).collect()}
    assert got == {"w": (1, False), "silent": (0, False)}
    assert [(s.scenario_id, s.missing) for s in delta.shortfalls.collect()] == [("silent", 2)]
    assert {(s.scenario_id, s.suppressed) for s in delta.rule_stats.collect()} == {("w", 0), ("silent", 0)}


def test_budgets_against_a_walk_over_the_events(spark):
    r = random.Random(4)
    rows = [event(i, r.choice(("app.a", "b.a")), r.choice(("insert", "update")), '{"id":%d,"k":%d}' % (i, r.randint(0, 2)), seq=r.choice((None, r.randint(0, 9)))) for i in range(60)]
    wants = [(0, "app.a", "insert", 4, {"k": "1"}), (1, "a", "insert", 9, None), (2, "a", "update", 3, {"k": "1e0"}), (3, "b.a", "update", 50, None)]
    e, x, rules = frames(spark, rows, [("w", *w, None) for w in wants], [DERIVED])
    import json

    left, expected = {w[0]: w[3] for w in wants}, {}
    for row in sorted(rows, key=lambda t: (t[12] is None, t[12] or 0, t[4])):
        for pos, entity, op, _, where in wants:
            if op == row[6] and entity in (row[5], row[5].split(".")[1]) and left[pos] and (not where or json.loads(row[9])["k"] == float(where["k"])):
                left[pos] -= 1
                expected[row[4]] = pos
                break
    got = C.classify(e, x, rules, AS_OF, "s", width=7).classified.collect()
    assert {c.idx: c.exp_idx for c in got if c.exp_idx is not None} == expected and len(got) == 60


def test_expired_ignore_rule_stops(spark):
    e, x, r = frames(spark, [event(1, "app.a", "insert")], [("w", 0, "a", "insert", 1, None, None)], [(0, "old", "ignore", "a", 5, None, None, None, None, None, None, None, "2026-01-14")])
    with pytest.raises(Refused):
        C.classify(e, x, r, AS_OF, "s")


def test_numbers_compare_by_value(spark):
    rows = spark.createDataFrame([("1e2", "100"), ("100.0", "100"), ("-3.50", "-3.5"), ('"1.0"', '"1.0"')], "a string, b string")
    got = rows.select(canonical.canonical_json(F.col("a")).alias("a"), canonical.canonical_json(F.col("b")).alias("b")).collect()
    assert all(r.a == r.b for r in got)


def test_patterns_are_literal_but_for_stars(spark):
    cases = [("a.b", "a.b", True), ("axb", "a.b", False), ("last_seen", "last_*", True), ("a\\Eb", "a\\E*", True), ("(x", "(*", True)]
    rows = spark.createDataFrame([(v, p) for v, p, _ in cases], "v string, p string")
    assert [r[0] for r in rows.select(F.rlike(F.col("v"), canonical.glob_regex(F.col("p")))).collect()] == [w for *_, w in cases]


def test_null_window_keys_are_refused(spark):
    bad = list(event(1, "app.a", "insert"))
    bad[2] = None
    split = E.read_change_events(spark.createDataFrame([tuple(bad), event(2, "app.a", "insert")], CHANGE_EVENTS))
    assert [r.reasons for r in split.rejects.collect()] == [["surface"]] and split.events.count() == 1


def test_ruleset_problems(spark):
    ignore = lambda i, entity: (0, i, "ignore", entity, 5, None, None, None, None, None, None, None, "2099-01-01")
    found = R.ruleset_problems(rules_frame(spark, [ignore("ok_", "t"), ignore("a__b", "t"), ignore("x", "audit%"), ignore("y", "audit_"), ignore("Z", "t")]), AS_OF)
    assert {(r.id, r.problem) for r in found.collect()} == {("x", "ignore_wildcard"), ("y", "ignore_wildcard"), ("Z", "invalid_id")}


def test_dead_rules_with_null_hash_and_hot_history(spark):
    fires = [0, 0, 0, 1, 0, 0, 0, 0]
    rows = [("r", None, i, f, 0) for i, f in enumerate(fires)]
    got = R.dead_rules(spark.createDataFrame(rows, "rule_id string, rule_hash string, run_idx long, suppressed long, over_budget long"), width=3)
    assert [r.zero_runs for r in got.orderBy("run_idx").collect()] == [1, 2, 3, 0, 1, 2, 3, 4]


def test_running_totals_null_keys(spark):
    rows = spark.createDataFrame([(None, i) for i in range(10)] + [("a", i) for i in range(5)], "k string, i long")
    got = scale.running_totals(rows, ["k"], [F.col("i")], F.floor(F.col("i") / 3), {"n": scale.Running(F.lit(1))})
    assert all(r.n == r.i + 1 for r in got.collect())


def test_bounded_refuses(spark):
    with pytest.raises(Refused):
        scale.bounded(spark.range(5), "rules", 4)


def test_slot_log_plan_parses_once(spark):
    split, _ = slot_log.decode_slot_log(spark.createDataFrame([("0/1", "1", "BEGIN 1")], "lsn string, xid string, data string"), {"a.b": ["id"]})
    for rows in (split.events, split.rejects):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        # One cut of the line into tokens, one of what is left over, three of each token, before and after.
        assert plan.count("regexp_extract(") <= 6 and plan.count("regexp_extract_all(") <= 1 and plan.count("try_parse_json") <= 20 and len(plan) < 40_000


def test_slot_log_lines(spark):
    lines = [
        ("0/1", "7", "BEGIN 7"), ("0/1", "7", "table public.t: INSERT: id[bigint]:1 note[text]:'a: ''b'', c' at[timestamp without time zone]:null"),
        ("0/1", "7", "table public.t: UPDATE: old-key: id[bigint]:1 note[text]:'x' new-tuple: id[bigint]:1 note[text]:'y'"), ("0/1", "7", "table public.t: DELETE: (no-tuple-data)"),
        ("0/1", "7", "table public.t: UPDATE: old-key: id[bigint]:1 id[bigint]:2 new-tuple: id[bigint]:1"), ("0/1", "7", "COMMIT 7"),
    ]
    split, bounds = slot_log.decode_slot_log(spark.createDataFrame(lines, "lsn string, xid string, data string"))
    got = {r.op: (r.fidelity, r.after, r.before) for r in split.events.collect()}
    assert got["insert"] == ("value_only", """{"at":null,"id":1,"note":"a: 'b', c"}""", None) and got["update"][0] == "full" and got["delete"][2] == "{}"
    assert [r.reason for r in split.rejects.collect()] == ["duplicate_column"] and bounds.count() == 2


def test_redaction(spark):
    row = spark.createDataFrame([("Bearer abc.def.ghi0123 and hunter2hunter2 hunter2hunter2x eyJaaaaaaaa.bbbbbbbb.cccccccc", "http://h/p?token=1&a=2#f", "no url")], "t string, u string, v string")
    got = row.select(privacy.redact_text(F.col("t"), ["hunter2hunter2", "hunter2hunter2x", "abc"]).alias("t"), privacy.redact_url(F.col("u")).alias("u"), privacy.redact_url(F.col("v")).alias("v")).first()
    assert tuple(got) == ("[REDACTED] and [REDACTED] [REDACTED] [REDACTED]", "http://h/p?token=[REDACTED]&a=2#f", "[UNPARSEABLE_URL]")


def test_suite_and_coverage(spark):
    results = spark.createDataFrame([("a", "pass"), ("a", "skipped"), ("b", "fail"), ("b", "infra_error")], "run string, result string")
    assert {r.run: (r.status, r.exit_code) for r in suite.tally_results(results, ["run"], True).collect()} == {"a": ("pass", 4), "b": ("infra_error", 2)}
    scored = spark.createDataFrame([("x", o) for o in ["killed"] * 10 + ["survived"]] + [("y", "error")], "run string, outcome string")
    assert {r.run: (r.rate_percent, r.confidence) for r in coverage.kill_rate(scored, ["run"]).collect()} == {"x": (90.91, "clean"), "y": (None, "degraded")}
    table = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "k int, v string")
    assert coverage.table_digest(table, ["k", "v"], []).first() == coverage.table_digest(table.orderBy(F.desc("k")).repartition(3), ["k", "v"], []).first()


def test_blocks_and_problems_of_specs(spark):
    text = "A-1: x\n```other\nA-1: again\n```s\n# requirement: A-1, B-2\n do\n# note\n```s\n```s\n```\n```s\nopen"
    files = spark.createDataFrame([("f", text), ("g", None), ("h", "")], "file string, text string")
    got = [tuple(r) for r in coverage.spec_blocks(files, "s").orderBy("line").collect()]
    assert got == [("f", 4, 8, ["A-1", "B-2"], "do\n# note"), ("f", 9, 10, [], ""), ("f", 11, None, [], "open")]
    problems = coverage.spec_problems(files, coverage.read_specs(files), "s")
    assert {tuple(r) for r in problems.collect()} == {("f", 3, "duplicate_requirement"), ("f", 11, "unterminated_block")}


def test_every_query_has_its_sql():
    assert set(registry.queries()) == set(registry.oracle_sql()) and "delta_buckets" in registry.queries()
    assert derive.AS_OF and WINDOW
