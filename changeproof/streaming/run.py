"""Running a stream to the end of what has arrived, and its rows."""

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from changeproof.operators.scale import ensure_checkpoint_dir


def _folder(spark: SparkSession) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/stream-{uuid.uuid4().hex}"


def arriving(rows: DataFrame, at: str | None = None, batches: int = 1, files: int = 4) -> DataFrame:
    """The rows, written to the shared folder, as a stream.

    With ``at``, a timestamp, they come in ``batches`` batches, one after the other by ranges of it: each is written by itself as ``files``
    files, and a batch of the stream takes no more files than that.
    """
    path = _folder(rows.sparkSession)
    reader = rows.sparkSession.readStream.schema(rows.schema)
    if at is None:
        rows.write.parquet(path)
        return reader.parquet(path)
    when = F.unix_micros(F.col(at))
    bounds = rows.select(when.alias("at")).approxQuantile("at", [k / batches for k in range(1, batches)], 0.01)
    for low, high in zip([None, *bounds], [*bounds, None], strict=True):
        part = rows.where(F.lit(True) if low is None else when >= low).where(F.lit(True) if high is None else when < high)
        part.repartition(files).write.mode("append").parquet(path)
    return reader.option("maxFilesPerTrigger", files).parquet(path)


def drained(stream: DataFrame) -> DataFrame:
    """All rows that a stream gives for what is there when it starts, read until none is left."""
    root = _folder(stream.sparkSession)
    writer = stream.writeStream.format("parquet").option("checkpointLocation", f"{root}/state").trigger(availableNow=True)
    writer.start(f"{root}/rows").awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{root}/rows")
