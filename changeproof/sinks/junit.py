"""Results as JUnit XML: a folder for each surface, whose files are suites of test cases."""

from __future__ import annotations

from xml.sax.saxutils import quoteattr

from pyspark.sql import DataFrame, SparkSession, functions as F

from changeproof.operators.suite import suite_by_surface

CASES = "_classname string, _name string, _time string, failure struct<_VALUE: string, _message: string, _type: string>, error struct<_VALUE: string, _message: string, _type: string>, skipped struct<_VALUE: string, _message: string>"


def test_cases(results: DataFrame) -> DataFrame:
    """results(scenario_id, surface, result, duration_ms, step, code, missing array) to one test case each.

    fail has a failure with its first failed step and code, infra_error an error, skipped what was missing; the others have no child.
    """
    step = F.coalesce(F.col("step").cast("string"), F.lit("0"))
    child = lambda code: F.struct(F.lit("").alias("_VALUE"), F.concat(F.lit("step "), step, F.lit(" "), code).alias("_message"), code.alias("_type"))
    code = F.col("code")
    return results.select(
        F.col("surface").alias("_classname"), F.col("scenario_id").cast("string").alias("_name"), F.format_string("%.3f", F.col("duration_ms") / 1000).alias("_time"),
        F.when(F.col("result") == "fail", child(F.coalesce(code, F.lit("E_SCENARIO_FAILED")))).alias("failure"),
        F.when(F.col("result") == "infra_error", child(F.coalesce(code, F.lit("E_INFRA_ERROR")))).alias("error"),
        F.when(F.col("result") == "skipped", F.struct(F.lit("").alias("_VALUE"), F.array_join("missing", ", ").alias("_message"))).alias("skipped"),
    )


def write_junit(results: DataFrame, path: str) -> list[str]:
    """Write the cases of each surface to path/surface=<n>, and the folders. Every file is a whole suite with the surface's counts.

    Surfaces are a short closed list, so their counts come to the driver; cases do not.
    """
    suites = suite_by_surface(results.withColumn("all", F.lit(0)), ["all"]).orderBy("surface").collect()
    cases, folders = test_cases(results), []
    for i, s in enumerate(suites):
        counts = f'tests="{s.tests}" failures="{s.failures}" errors="{s.errors}" skipped="{s.skipped}"'
        folders.append(f"{path.rstrip('/')}/surface={i}")
        own = cases.where(F.col("_classname").eqNullSafe(F.lit(s.surface)))
        own.write.format("xml").option("rootTag", f"testsuite name={quoteattr(s.surface or '')} {counts}").option("rowTag", "testcase").save(folders[-1])
    return folders


def read_junit(spark: SparkSession, folders: list[str]) -> DataFrame:
    """The test cases of written suites."""
    found = None
    for folder in folders:
        own = spark.read.schema(CASES).format("xml").option("rowTag", "testcase").load(folder)
        found = own if found is None else found.unionByName(own)
    if found is None:
        return spark.createDataFrame([], CASES)
    return found.select(
        F.col("_classname").alias("surface"), F.col("_name").alias("scenario_id"), F.col("_time").cast("double").alias("seconds"), F.col("failure._message").alias("failure"),
        F.col("error._message").alias("error"), F.col("skipped._message").alias("skipped"),
    )
