"""Run records as JSON lines of several versions: each line is read by its own version, and what no version can read is kept aside."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# The version that is written now, and the one that can be taken over.
CURRENT, OLD = 2, 1
_RECORD = (
    "run_record_version int, run_id string, started_at string, finished_at string, duration_ms long, status string, exit_code int, "
    "scenarios array<struct<id: string, surface: string, result: string, duration_ms: long, requirements array<string>>>, delta struct<counts: map<string, long>>, _corrupt string"
).replace("requirements array", "requirements: array")


def read_run_records(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """lines(line) to (records, rejected(line, problem)).

    A line of the current version is taken as it is. One of the old version is taken over if it has no delta, which that version did not know; its
    version is then the current one. Others are rejected: unreadable, unknown_version, delta_in_old_version, no_run_id, duration_below_0.
    """
    parsed = lines.select("line", F.from_json("line", _RECORD, {"columnNameOfCorruptRecord": "_corrupt"}).alias("r"), F.try_parse_json("line").alias("v"))
    version = F.col("r.run_record_version")
    has_delta = F.expr("try_variant_get(v, '$.delta', 'variant')").isNotNull()
    problem = (
        F.when(F.col("v").isNull() | F.col("r._corrupt").isNotNull(), "unreadable").when(version.isNull() | ~version.isin(CURRENT, OLD), "unknown_version")
        .when((version == OLD) & has_delta, "delta_in_old_version").when(F.col("r.run_id").isNull() | (F.col("r.run_id") == ""), "no_run_id").when(F.col("r.duration_ms") < 0, "duration_below_0")
    )
    told = parsed.withColumn("problem", problem)
    records = told.where("problem IS NULL").select("r.*").drop("_corrupt").withColumns({"upgraded": F.col("run_record_version") == OLD, "run_record_version": F.lit(CURRENT)})
    return records, told.where("problem IS NOT NULL").select("line", "problem")
