"""Requirement coverage, gates, mutants, seeds, digests and tenants."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from changeproof.operators.seed import hash_nodes, row_hash

# Two dialects of requirement ids.
SPEC_ID, SCENARIO_ID = r"^[A-Z][A-Z0-9]*-[0-9]+$", r"^[A-Z][A-Z0-9]*(-[A-Z0-9]+)+$"


def is_requirement_id(text: Column, pattern: str = SPEC_ID) -> Column:
    return F.coalesce(F.rlike(text, F.lit(pattern)), F.lit(False))


def requirement_coverage(stated: DataFrame, claims: DataFrame) -> DataFrame:
    """stated(requirement), claims(scenario_id, requirement) to every requirement with its state and scenario count.

    covered: stated and claimed; uncovered: stated only; unknown: claimed only.
    """
    per = claims.groupBy("requirement").agg(F.count_distinct("scenario_id").alias("scenarios"), F.min("scenario_id").alias("first_scenario"))
    both = stated.select("requirement").distinct().withColumn("stated", F.lit(True)).join(per, "requirement", "full")
    state = F.when(F.col("stated").isNull(), "unknown").when(F.col("scenarios").isNull(), "uncovered").otherwise("covered")
    return both.select("requirement", state.alias("state"), F.coalesce("scenarios", F.lit(0)).alias("scenarios"), "first_scenario")


def phase_verdict(phases: DataFrame, claims: DataFrame, results: DataFrame) -> DataFrame:
    """phases(phase, requirement), claims, results(scenario_id, result): whether each phase is verified, and why not.

    Verified if every requirement is covered and no covering scenario has another result than pass. A phase whose only
    requirement is null has none, and is not verified.
    """
    covering = claims.join(results, "scenario_id", "left").groupBy("requirement").agg(F.count("*").alias("scenarios"), F.count_if(~F.coalesce(F.col("result") == "pass", F.lit(False))).alias("not_passed"))
    per = phases.join(covering, "requirement", "left").groupBy("phase").agg(
        F.count("requirement").alias("requirements"), F.count_if(F.col("requirement").isNotNull() & F.col("scenarios").isNull()).alias("uncovered"), F.coalesce(F.sum("not_passed"), F.lit(0)).alias("not_passed")
    )
    reason = F.when(F.col("requirements") == 0, "no_requirements").when(F.col("uncovered") > 0, "uncovered_requirements").when(F.col("not_passed") > 0, "scenarios_not_passed")
    return per.withColumns({"reason": reason, "verified": reason.isNull()})


def binding_coverage(refs: DataFrame, bindings: DataFrame, surfaces: list[str]) -> DataFrame:
    """Every (ref, surface) as bound, unbound or unused; surfaces are a short list, exploded."""
    wanted = refs.select("ref").distinct().withColumn("surface", F.explode(F.array(*map(F.lit, surfaces)))).withColumn("wanted", F.lit(True))
    both = wanted.join(bindings.select("ref", "surface").distinct().withColumn("bound", F.lit(True)), ["ref", "surface"], "full")
    return both.select("ref", "surface", F.when(F.col("wanted").isNull(), "unused").when(F.col("bound").isNull(), "unbound").otherwise("bound").alias("state"))


def capability_gate(demands: DataFrame, offered: list[str], known: list[str], surface: list[str]) -> DataFrame:
    """demands(scenario_id, capabilities array): the first of unknown, missing db, missing surface, else plan."""
    array = lambda xs: F.array(*map(F.lit, xs))
    missing = F.array_except("capabilities", array(offered))
    decision = (
        F.when(F.size(F.array_except("capabilities", array(known))) > 0, "unknown_capability").when(F.size(F.array_except(missing, array(surface))) > 0, "compile_error")
        .when(F.size(missing) > 0, "skip").otherwise("plan")
    )
    return demands.withColumn("decision", decision)


def select_scenarios(scenarios: DataFrame, ids: list[str] | None = None, tags: list[str] | None = None) -> DataFrame:
    """Any of the ids and all of the tags."""
    out = scenarios if ids is None else scenarios.filter(F.col("scenario_id").isin(ids))
    return out if not tags else out.filter(F.size(F.array_except(F.array(*map(F.lit, tags)), "tags")) == 0)


def mutant_score(mutants: DataFrame) -> DataFrame:
    """Outcome of each mutant: killed if its run failed with the named requirement's code, survived if it passed, else error."""
    killed = (F.col("run_result") == "fail") & F.array_contains("codes", F.col("caught_by"))
    return mutants.withColumn("outcome", F.when(F.coalesce(killed, F.lit(False)), "killed").when(F.col("run_result") == "pass", "survived").otherwise("error"))


def kill_rate(scored: DataFrame, by: list[str]) -> DataFrame:
    """killed / (killed + survived); errors do not count, and make the rate degraded. Null if nothing is scored."""
    counts = scored.groupBy(*by).agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in ("killed", "survived", "error")])
    rate = F.col("killed") / F.nullif(F.col("killed") + F.col("survived"), F.lit(0))
    return counts.withColumns({"rate": rate, "rate_percent": F.round(rate * 100, 2), "confidence": F.when(F.col("error") > 0, "degraded").otherwise("clean")})


def baseline_compare(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Both (mutant_id, outcome, hash): mutants that newly survive, survive, or whose hash differs."""
    b, c = (df.select("mutant_id", F.col("outcome").alias(f"{p}_outcome"), F.col("hash").alias(f"{p}_hash")) for p, df in (("base", baseline), ("now", current)))
    both = b.join(c, "mutant_id", "full")
    survives = F.coalesce(F.col("now_outcome") == "survived", F.lit(False))
    return both.select(
        "mutant_id", (survives & ~F.coalesce(F.col("base_outcome") == "survived", F.lit(False))).alias("newly_survived"), survives.alias("survived"), (~F.col("base_hash").eqNullSafe(F.col("now_hash"))).alias("hash_differs")
    )


def gate_status(compared: DataFrame, base: DataFrame, now: DataFrame, by: list[str]) -> DataFrame:
    """The first of hash_mismatch, errored_mutants, rate_drop, else passed. base and now come from kill_rate."""
    differs = compared.groupBy(*by).agg(F.count_if("hash_differs").alias("differing"))
    both = now.select(*by, "error", "rate").join(base.select(*by, F.col("rate").alias("base_rate")), by, "left").join(differs, by, "left")
    status = F.when(F.col("differing") > 0, "hash_mismatch").when(F.col("error") > 0, "errored_mutants").when(F.coalesce(F.col("rate") < F.col("base_rate"), F.lit(False)), "rate_drop").otherwise("passed")
    return both.select(*by, status.alias("status"))


def table_digest(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """A digest of each group's rows, the root of its hash tree, that does not depend on their order, and the row count."""
    hashed = df.select(*by, row_hash(columns).alias("h"))
    return hash_nodes(hashed, by).where("node = ''").select(*by, "digest", F.col("n").alias("n_rows"))


def seed_vs_observed(seed: DataFrame, observed: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """Groups with digest and row count on both sides, and whether they agree. ``seed.differing_rows`` names the rows."""
    s, o = (table_digest(df, columns, by).withColumnsRenamed({"digest": f"{p}_digest", "n_rows": f"{p}_rows"}) for p, df in (("seed", seed), ("observed", observed)))
    both = null_safe_full(s, o, by).fillna(0, ["seed_rows", "observed_rows"])
    return both.withColumn("agree", F.col("seed_digest").eqNullSafe(F.col("observed_digest")))


def null_safe_full(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """A full join in which null keys are equal; each key stands once."""
    l, r = left.withColumn("__l", F.lit(True)), right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    both = l.join(r, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys], "full")
    named = [F.when(F.col("__l"), F.col(k)).otherwise(F.col(f"__r_{k}")).alias(k) for k in keys]
    return both.select(*named, *(c for c in [*left.columns, *right.columns] if c not in keys))


def stale_tenants(tenants: DataFrame, keep: DataFrame, cutoff: Column, prefix: str) -> DataFrame:
    """tenants(tenant, last_used): those with the prefix, used before the cutoff and not to be kept."""
    old = tenants.filter(F.startswith(F.col("tenant"), F.lit(prefix)) & (F.col("last_used") < cutoff))
    return old.join(keep.select("tenant"), "tenant", "left_anti")


def ruleset_hash(rules: DataFrame, by: list[str]) -> DataFrame:
    """rules(by, id, body): sha256 over the rules of each set in the order of their ids. A set is written by hand, so short."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "body"))), lambda r: F.concat_ws("=", r["id"].cast("string"), r["body"])), ";")
    return rules.groupBy(*by).agg(F.sha2(text, 256).alias("ruleset_hash"))


def read_specs(files: DataFrame) -> DataFrame:
    """files(file, text) to stated requirements (file, line, requirement, statement): lines `ID: statement`, those in fences too."""
    lines = files.select("file", F.posexplode(F.split("text", "\n")).alias("at", "content"))
    found = lines.withColumns({"requirement": F.regexp_extract("content", r"^\s*[-*]?\s*([A-Z][A-Z0-9]*-[0-9]+):\s*(.+)$", 1), "statement": F.regexp_extract("content", r"^\s*[-*]?\s*([A-Z][A-Z0-9]*-[0-9]+):\s*(.+)$", 2)})
    return found.filter("requirement <> ''").select("file", (F.col("at") + 1).alias("line"), "requirement", "statement")


def spec_problems(files: DataFrame, stated: DataFrame, tag: str) -> DataFrame:
    """(file, line, problem): requirements that a file states again, and blocks that nothing ends."""
    first = F.min("line").over(Window.partitionBy("file", "requirement"))
    again = stated.select("file", "line", first.alias("first")).where("line > first").select("file", "line", F.lit("duplicate_requirement").alias("problem"))
    still = spec_blocks(files, tag).where("end_line IS NULL").select("file", F.col("line"), F.lit("unterminated_block").alias("problem"))
    return again.unionByName(still)


def spec_blocks(files: DataFrame, tag: str) -> DataFrame:
    """files(file, text) to fenced blocks of a tag (file, line, end_line, requirements, body); end_line is null where no fence ends the block.

    Inside a block any fence ends it, outside only the tag's begin one. Lines `# requirement: ID, ID` name the block's
    requirements and are no part of its body. A file is one row; null text has no blocks.
    """
    id_ = r"[A-Z][A-Z0-9]*-[0-9]+"
    directive = rf"^\s*#\s*requirement:\s*({id_}(?:\s*,\s*{id_})*)\s*$"
    lines = F.split("text", "\r?\n")
    numbered = F.transform(lines, lambda x, i: F.struct((i + 1).alias("at"), F.regexp_extract(x, r"^\s*```(\w*)\s*$", 1).alias("tag"), F.rlike(x, F.lit(r"^\s*```\w*\s*$")).alias("fence")))
    rows = files.select("file", lines.alias("lines"), F.filter(numbered, lambda f: f["fence"]).alias("fences"))
    pair = lambda start, end: F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))
    empty = F.struct(F.lit(0).alias("open"), F.array().cast("array<struct<start:int,end:int>>").alias("pairs"))

    def step(acc, f):
        ends, begins = acc["open"] > 0, f["tag"] == tag
        pairs = F.when(ends, F.concat(acc["pairs"], F.array(pair(acc["open"], f["at"])))).otherwise(acc["pairs"])
        return F.struct(F.when(~ends & begins, f["at"]).otherwise(F.lit(0)).alias("open"), pairs.alias("pairs"))

    last = lambda acc: F.concat(acc["pairs"], F.filter(F.array(pair(acc["open"], F.lit(None))), lambda x: x["start"] > 0))
    blocks = rows.select("file", "lines", F.explode(F.aggregate("fences", empty, step, last)).alias("b"))
    inside = F.slice("lines", F.col("b.start") + 1, F.coalesce(F.col("b.end") - 1, F.size("lines")) - F.col("b.start"))
    named = F.filter(F.transform(inside, lambda x: F.regexp_extract(x, directive, 1)), lambda x: x != "")
    body = F.array_join(F.filter(inside, lambda x: ~F.rlike(x, F.lit(directive))), "\n")
    return blocks.select(
        "file", F.col("b.start").alias("line"), F.col("b.end").alias("end_line"), F.flatten(F.transform(named, lambda x: F.split(x, r"\s*,\s*"))).alias("requirements"), F.regexp_replace(body, r"^\s+|\s+$", "").alias("body")
    )


def dangling_links(links: DataFrame, stated: DataFrame) -> DataFrame:
    """links(file, requirement) that the same file never states."""
    return links.join(stated.select("file", "requirement").distinct(), ["file", "requirement"], "left_anti")
