"""Requirements, gates, mutants, digests and tenants over the given tables."""

from pyspark.sql import functions as F

from changeproof.operators import coverage as V, seed as S
from changeproof.plans import derive as D
from changeproof.plans.register import Register

REGISTER = Register()
query = REGISTER.query

# A document's source is a scenario; its language and label claim requirements. REQ-9 is stated and never claimed, and a
# claim of REQ-4 to REQ-6 is unknown for it is not stated.
CLAIMS_SQL = """claims AS (SELECT DISTINCT source AS scenario_id, 'REQ-' || (doc_id % 7) AS requirement FROM documents),
stated AS (SELECT DISTINCT 'REQ-' || (doc_id % 4) AS requirement FROM documents UNION SELECT 'REQ-9'),
results AS (SELECT source AS scenario_id, CASE WHEN count_if(toxic = 1) > 4 THEN 'fail' ELSE 'pass' END AS result FROM documents JOIN labels USING (doc_id) GROUP BY 1)"""


def claims(spark, sf_dir):
    return D.table(spark, sf_dir, "documents").select(F.col("source").alias("scenario_id"), F.concat(F.lit("REQ-"), F.col("doc_id") % 7).alias("requirement")).distinct()


def stated(spark, sf_dir):
    docs = D.table(spark, sf_dir, "documents")
    return docs.select(F.explode(F.array(F.concat(F.lit("REQ-"), F.col("doc_id") % 4), F.lit("REQ-9"))).alias("requirement")).distinct()


def scenario_results(spark, sf_dir):
    labelled = D.table(spark, sf_dir, "documents").join(D.table(spark, sf_dir, "labels"), "doc_id")
    return labelled.groupBy(F.col("source").alias("scenario_id")).agg(F.when(F.count_if(F.col("toxic") == 1) > 4, "fail").otherwise("pass").alias("result"))


@query(
    f"""WITH {CLAIMS_SQL} SELECT requirement, CASE WHEN s.requirement IS NULL THEN 'unknown' WHEN any_value(scenario_id) IS NULL THEN 'uncovered' ELSE 'covered' END AS state,
    count(DISTINCT scenario_id) AS scenarios, min(scenario_id) AS first_scenario FROM stated s FULL JOIN claims c USING (requirement) GROUP BY requirement, s.requirement"""
)
def requirement_coverage(spark, sf_dir):
    return V.requirement_coverage(stated(spark, sf_dir), claims(spark, sf_dir))


@query(f"WITH {CLAIMS_SQL} SELECT scenario_id, string_agg(requirement, ',' ORDER BY requirement) AS requirements, count_if(requirement IN (SELECT requirement FROM stated)) AS n_stated FROM claims GROUP BY ALL")
def requirements_union(spark, sf_dir):
    """Sorted requirements of each scenario, and how many of them are stated."""
    known = claims(spark, sf_dir).join(stated(spark, sf_dir).withColumn("is_stated", F.lit(True)), "requirement", "left")
    return known.groupBy("scenario_id").agg(F.array_join(F.array_sort(F.collect_set("requirement")), ",").alias("requirements"), F.count_if("is_stated").alias("n_stated"))


PHASES_SQL = """phases AS (SELECT DISTINCT 'phase-' || (doc_id % 4) AS phase, 'REQ-' || (doc_id % 4) AS requirement FROM documents UNION SELECT 'phase-0', 'REQ-9' UNION SELECT 'phase-5', NULL)"""


@query(
    f"""WITH {CLAIMS_SQL}, {PHASES_SQL}, cov AS (SELECT requirement, count(*) AS scenarios, count_if(coalesce(result <> 'pass', true)) AS not_passed FROM claims LEFT JOIN results USING (scenario_id) GROUP BY 1),
    p AS (SELECT phase, count(requirement) AS requirements, count_if(requirement IS NOT NULL AND scenarios IS NULL) AS uncovered, coalesce(sum(not_passed), 0)::BIGINT AS not_passed FROM phases LEFT JOIN cov USING (requirement) GROUP BY 1)
    SELECT *, CASE WHEN requirements = 0 THEN 'no_requirements' WHEN uncovered > 0 THEN 'uncovered_requirements' WHEN not_passed > 0 THEN 'scenarios_not_passed' END AS reason,
      requirements > 0 AND uncovered = 0 AND not_passed = 0 AS verified FROM p"""
)
def phase_verdict(spark, sf_dir):
    docs = D.table(spark, sf_dir, "documents")
    pair = lambda phase, requirement: F.struct(phase.alias("phase"), requirement.alias("requirement"))
    null = F.lit(None).cast("string")
    own = pair(F.concat(F.lit("phase-"), F.col("doc_id") % 4), F.concat(F.lit("REQ-"), F.col("doc_id") % 4))
    phases = docs.select(F.explode(F.array(own, pair(F.lit("phase-0"), F.lit("REQ-9")), pair(F.lit("phase-5"), null))).alias("p")).select("p.*").distinct()
    return V.phase_verdict(phases, claims(spark, sf_dir), scenario_results(spark, sf_dir))


@query(
    """WITH refs AS (SELECT DISTINCT p_brand AS ref FROM part), wanted AS (SELECT ref, surface FROM refs, (VALUES ('web'), ('api')) s(surface)),
    bound AS (SELECT DISTINCT 'Brand#' || (s_suppkey % 30) AS ref, CASE WHEN s_nationkey < 10 THEN 'web' ELSE 'api' END AS surface FROM supplier)
    SELECT ref, surface, CASE WHEN w.ref IS NULL THEN 'unused' WHEN b.ref IS NULL THEN 'unbound' ELSE 'bound' END AS state FROM (SELECT *, ref AS r FROM wanted) w FULL JOIN bound b USING (ref, surface)"""
    .replace("w.ref IS NULL", "w.r IS NULL").replace("b.ref IS NULL", "b.q IS NULL").replace("FULL JOIN bound b", "FULL JOIN (SELECT *, ref AS q FROM bound) b")
)
def binding_coverage(spark, sf_dir):
    refs = D.table(spark, sf_dir, "part").select(F.col("p_brand").alias("ref"))
    bindings = D.table(spark, sf_dir, "supplier").select(F.concat(F.lit("Brand#"), F.col("s_suppkey") % 30).alias("ref"), F.when(F.col("s_nationkey") < 10, "web").otherwise("api").alias("surface"))
    return V.binding_coverage(refs, bindings, ["web", "api"])


@query(
    """SELECT o_orderkey AS scenario_id, CASE WHEN o_orderkey % 5 = 4 THEN 'unknown_capability' WHEN o_orderstatus = 'F' THEN 'compile_error' WHEN o_orderkey % 5 = 3 THEN 'skip' ELSE 'plan' END AS decision FROM orders"""
)
def capability_gate(spark, sf_dir):
    fifth = F.col("o_orderkey") % 5
    demands = D.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("scenario_id"),
        F.array_compact(F.array(F.lit("db"), F.when(F.col("o_orderstatus") == "F", "db_log"), F.when(fifth == 3, "phone"), F.when(fifth == 4, "telepathy"))).alias("capabilities"),
    )
    return V.capability_gate(demands, ["db", "web"], ["db", "db_log", "web", "phone"], ["web", "phone"]).select("scenario_id", "decision")


@query("SELECT o_orderkey AS scenario_id FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'")
def select_scenarios(spark, sf_dir):
    """Scenarios that carry both tags."""
    tagged = D.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("scenario_id"), F.array("o_orderstatus", "o_orderpriority").alias("tags"))
    return V.select_scenarios(tagged, tags=["O", "1-URGENT"]).select("scenario_id")


MUTANTS_SQL = """m AS (SELECT 'run-' || year(o_orderdate) AS run_id, o_orderkey AS mutant_id, o_orderkey % 3 AS need, o_orderkey % 4 AS got, o_orderstatus AS st, o_totalprice FROM orders),
scored AS (SELECT *, CASE WHEN st = 'F' AND need = got THEN 'killed' WHEN st = 'O' THEN 'survived' ELSE 'error' END AS outcome FROM m),
base AS (SELECT *, CASE WHEN outcome = 'error' OR mutant_id % 10 = 0 THEN 'killed' ELSE outcome END AS base_outcome FROM scored),
rates AS (SELECT run_id, count_if(outcome = 'killed') AS killed, count_if(outcome = 'survived') AS survived, count_if(outcome = 'error') AS error FROM scored WHERE mutant_id % 50 > 0 OR outcome <> 'error' GROUP BY 1)"""


def mutants(spark, sf_dir):
    key = F.col("o_orderkey")
    return D.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("run-"), F.year("o_orderdate")).alias("run_id"), key.alias("mutant_id"), F.when(F.col("o_orderstatus") == "F", "fail").when(F.col("o_orderstatus") == "O", "pass").otherwise("infra_error").alias("run_result"),
        F.concat(F.lit("R-"), key % 3).alias("caught_by"), F.array(F.concat(F.lit("R-"), key % 4)).alias("codes"), F.concat(F.lit("h"), key % 11).alias("hash"),
    )


@query(f"WITH {MUTANTS_SQL} SELECT mutant_id, outcome FROM scored")
def mutant_score(spark, sf_dir):
    return V.mutant_score(mutants(spark, sf_dir)).select("mutant_id", "outcome")


@query(
    f"""WITH {MUTANTS_SQL}, r AS (SELECT run_id, count_if(outcome = 'killed') AS killed, count_if(outcome = 'survived') AS survived, count_if(outcome = 'error') AS error FROM scored GROUP BY 1)
    SELECT *, round(killed / nullif(killed + survived, 0) * 100, 2) AS rate_percent, CASE WHEN error > 0 THEN 'degraded' ELSE 'clean' END AS confidence FROM r"""
)
def kill_rate(spark, sf_dir):
    return V.kill_rate(V.mutant_score(mutants(spark, sf_dir)), ["run_id"]).drop("rate")


def _baseline(scored):
    return scored.withColumns(
        {"outcome": F.when((F.col("outcome") == "error") | (F.col("mutant_id") % 10 == 0), "killed").otherwise(F.col("outcome")), "hash": F.when(F.col("mutant_id") % 1009 == 5, "old").otherwise(F.col("hash"))}
    )


@query(
    f"""WITH {MUTANTS_SQL} SELECT mutant_id, outcome = 'survived' AND base_outcome <> 'survived' AS newly_survived, outcome = 'survived' AS survived, mutant_id % 1009 = 5 AS hash_differs FROM base"""
)
def baseline_compare(spark, sf_dir):
    scored = V.mutant_score(mutants(spark, sf_dir))
    return V.baseline_compare(_baseline(scored), scored)


@query(
    f"""WITH {MUTANTS_SQL}, g AS (SELECT run_id || '-' || (mutant_id % 40) AS grp, * FROM base),
    r AS (SELECT grp, count_if(outcome = 'killed') / nullif(count_if(outcome IN ('killed', 'survived')), 0) AS rate, count_if(outcome = 'error') AS error,
      count_if(base_outcome = 'killed') / nullif(count_if(base_outcome IN ('killed', 'survived')), 0) AS base_rate, count_if(mutant_id % 1009 = 5) AS differing FROM g GROUP BY 1)
    SELECT grp, CASE WHEN differing > 0 THEN 'hash_mismatch' WHEN error > 0 THEN 'errored_mutants' WHEN coalesce(rate < base_rate, false) THEN 'rate_drop' ELSE 'passed' END AS status FROM r"""
)
def gate_status(spark, sf_dir):
    scored = V.mutant_score(mutants(spark, sf_dir)).withColumn("grp", F.concat_ws("-", "run_id", F.col("mutant_id") % 40))
    before = _baseline(scored)
    compared = V.baseline_compare(before, scored).join(scored.select("mutant_id", "grp"), "mutant_id")
    return V.gate_status(compared, V.kill_rate(before, ["grp"]), V.kill_rate(scored, ["grp"]), ["grp"])


def _digest_sql(table: str, by: str, columns: list[str], where: str = "true") -> str:
    """Each column as its length, a colon and its text (a dash for null); leaves of 4 hexadecimal digits, then four levels of nodes."""
    text = " || ".join(f"coalesce(length(({c})::VARCHAR) || ':' || ({c})::VARCHAR, '-')" for c in columns)
    sql = f"""SELECT {by}, substr(h, 1, 4) AS node, sha256(string_agg(h, '' ORDER BY h)) AS digest, count(*)::BIGINT AS n FROM (SELECT {by}, sha256({text}) AS h FROM {table} WHERE {where}) GROUP BY ALL"""
    for size in (3, 2, 1, 0):
        sql = f"SELECT {by}, left(node, {size}) AS node, sha256(string_agg(node || digest, '' ORDER BY node)) AS digest, sum(n)::BIGINT AS n FROM ({sql}) GROUP BY {by}, left(node, {size})"
    return f"SELECT {by}, digest, n AS n_rows FROM ({sql})"


_COLUMNS = ["c_custkey", "c_name", "c_mktsegment"]


@query(_digest_sql("customer", "c_nationkey", _COLUMNS))
def table_digest(spark, sf_dir):
    """Customers by nation as tenant, the tenant column left out."""
    return V.table_digest(D.table(spark, sf_dir, "customer"), _COLUMNS, ["c_nationkey"])


OBSERVED = ["c_custkey", "c_name", "CASE WHEN c_custkey % 97 = 0 THEN 'changed' ELSE c_mktsegment END"]


def _observed(spark, sf_dir):
    seed = D.table(spark, sf_dir, "customer")
    return seed, seed.filter("c_custkey % 211 > 0").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 97 == 0, "changed").otherwise(F.col("c_mktsegment")))


@query(
    f"""WITH s AS ({_digest_sql("customer", "c_nationkey", _COLUMNS)}), o AS ({_digest_sql("customer", "c_nationkey", OBSERVED, "c_custkey % 211 > 0")})
    SELECT c_nationkey, coalesce(s.n_rows, 0) AS seed_rows, coalesce(o.n_rows, 0) AS observed_rows, s.digest IS NOT DISTINCT FROM o.digest AS agree FROM s FULL JOIN o USING (c_nationkey)"""
)
def seed_vs_observed(spark, sf_dir):
    seed, observed = _observed(spark, sf_dir)
    return V.seed_vs_observed(seed, observed, _COLUMNS, ["c_nationkey"]).select("c_nationkey", "seed_rows", "observed_rows", "agree")


@query(
    """SELECT c_nationkey, c_custkey, c_name, c_mktsegment, 1 AS a_rows, 0 AS b_rows FROM customer WHERE c_custkey % 211 = 0 OR c_custkey % 97 = 0
    UNION ALL SELECT c_nationkey, c_custkey, c_name, 'changed', 0, 1 FROM customer WHERE c_custkey % 97 = 0 AND c_custkey % 211 > 0"""
)
def seed_difference_rows(spark, sf_dir):
    """The rows in which the observed table departs from the seed, found from the roots of both trees down."""
    seed, observed = _observed(spark, sf_dir)
    return S.differing_rows(S.keep_tree(seed, _COLUMNS, ["c_nationkey"]), S.keep_tree(observed, _COLUMNS, ["c_nationkey"]))


SEEDS_SQL = """x AS (SELECT p_partkey, p_partkey % 50 = 0 AS sql, p_partkey % 70 = 0 AS now, p_partkey % 90 = 0 AS uuid, p_partkey % 110 = 0 AS key FROM part)"""


@query(
    f"""WITH {SEEDS_SQL} SELECT p_partkey, 'tables.0.rows.1.SQL' AS path, 'E_SEED_UNSAFE' AS code FROM x WHERE sql UNION ALL SELECT p_partkey, 'tables.0.rows.0.at', 'E_SEED_NON_DETERMINISTIC' FROM x WHERE now
    UNION ALL SELECT p_partkey, 'tables.0.deep.a.b.0.1', 'E_SEED_NON_DETERMINISTIC' FROM x WHERE uuid UNION ALL SELECT p_partkey, 'tables.1.$Random', 'E_SEED_NON_DETERMINISTIC' FROM x WHERE key"""
)
def seed_problems(spark, sf_dir):
    """Parts as seeds: orders and markers planted at several depths are told with their paths."""
    key = F.col("p_partkey")
    text = lambda when, hit, other: F.when(when, F.lit(hit)).otherwise(F.lit(other))
    seed = F.concat(
        F.lit('{"name":"now it is","tables":[{"rows":[{"at":"'), text(key % 70 == 0, " $NOW ", "2024 now"), F.lit('","n":1},{"'), text(key % 50 == 0, "SQL", "sql_"), F.lit('":null}],"deep":{"a":{"b":[["x","'),
        text(key % 90 == 0, "{{ uuid }}", "{ uuid }"), F.lit('"]]}}},{"'), text(key % 110 == 0, "$Random", "random"), F.lit('":"a raw script"}]}'),
    )
    return S.seed_problems(D.table(spark, sf_dir, "part").select("p_partkey", seed.alias("json")), ["p_partkey"], "json")


@query(
    """WITH t AS (SELECT 'cust_' || o_custkey AS tenant, o_custkey, max(o_orderdate) AS last_used FROM orders GROUP BY 2)
    SELECT tenant FROM t WHERE last_used < TIMESTAMP '2000-06-01' AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')"""
)
def stale_tenants(spark, sf_dir):
    """Customers without a late order, but for those of one segment."""
    name = lambda c: F.concat(F.lit("cust_"), F.col(c)).alias("tenant")
    used = D.table(spark, sf_dir, "orders").groupBy(name("o_custkey")).agg(F.max("o_orderdate").alias("last_used"))
    keep = D.table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(name("c_custkey"))
    return V.stale_tenants(used, keep, F.lit("2000-06-01").cast("timestamp_ntz"), "cust_").select("tenant")


@query("SELECT o_orderkey, c_nationkey AS tenant, (o_orderkey % 25)::INT AS declared FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey <> o_orderkey % 25")
def tenant_mismatches(spark, sf_dir):
    """Rows whose declared tenant is not that of their owner."""
    declared = (F.col("o_orderkey") % 25).cast("int")
    both = D.table(spark, sf_dir, "orders").join(D.table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return both.filter(F.col("c_nationkey") != declared).select("o_orderkey", F.col("c_nationkey").alias("tenant"), declared.alias("declared"))


@query("SELECT p_type, sha256(string_agg(p_partkey || '=' || p_name, ';' ORDER BY p_partkey)) AS ruleset_hash FROM part GROUP BY ALL")
def ruleset_hash(spark, sf_dir):
    return V.ruleset_hash(D.table(spark, sf_dir, "part").select("p_type", F.col("p_partkey").alias("id"), F.col("p_name").alias("body")), ["p_type"])


SPECS_SQL = """s AS (SELECT doc_id AS file, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
spec AS (SELECT file, line, 'DOC-' || file AS requirement, content FROM s WHERE content <> '')"""


@query(f"WITH {SPECS_SQL} SELECT file, line::INT AS line, requirement, trim(content) AS statement FROM spec WHERE trim(content) <> '' AND NOT regexp_matches(content, '^\\s')")
def spec_requirements(spark, sf_dir):
    """Every line of a document, stated as that document's requirement and read back."""
    docs = D.table(spark, sf_dir, "documents")
    lines = F.transform(F.split("text", "\n"), lambda x: F.when(F.trim(x) == "", x).otherwise(F.concat(F.lit("- DOC-"), F.col("doc_id"), F.lit(": "), x)))
    specs = V.read_specs(docs.select(F.col("doc_id").alias("file"), F.array_join(lines, "\n").alias("text")))
    return specs.select("file", "line", "requirement", F.trim("statement").alias("statement"))


@query(
    """SELECT doc_id AS file, 3 AS line, CASE WHEN doc_id % 3 > 0 THEN (length(text) - length(replace(text, chr(10), '')) + 7)::INT END AS end_line, 'REQ-' || (doc_id % 7) || ',REQ-9' AS requirements,
      sha256(regexp_replace(text || chr(10) || 'end', '^\\s+|\\s+$', '', 'g')) AS body_sha256 FROM documents"""
)
def spec_blocks(spark, sf_dir):
    """Every document as the body of a block, after a fence that begins none; a third of the blocks have no end."""
    docs = D.table(spark, sf_dir, "documents")
    text = F.concat(F.lit("```\ntitle\n```scenario\n # requirement: REQ-"), F.col("doc_id") % 7, F.lit(" , REQ-9\n"), "text", F.lit("\nend"), F.when(F.col("doc_id") % 3 > 0, "\n```\nafter").otherwise(""))
    blocks = V.spec_blocks(docs.select(F.col("doc_id").alias("file"), text.alias("text")), "scenario")
    return blocks.select("file", "line", "end_line", F.array_join("requirements", ",").alias("requirements"), F.sha2("body", 256).alias("body_sha256"))


@query("SELECT doc_id AS file, 'REQ-' || (doc_id % 7) AS requirement FROM documents WHERE doc_id % 7 <> doc_id % 4")
def dangling_links(spark, sf_dir):
    """Claims of a requirement that the same document does not state."""
    docs = D.table(spark, sf_dir, "documents")
    name = lambda n: docs.select(F.col("doc_id").alias("file"), F.concat(F.lit("REQ-"), F.col("doc_id") % n).alias("requirement"))
    return V.dangling_links(name(7), name(4))
