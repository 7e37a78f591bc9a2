"""Helpers shared by the operators: materialising between jobs and reading many texts as one array."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession

#: Rows up to which a side of known narrow width may be broadcast (32 bytes a row: 16 MB at most).
BROADCAST_ROWS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset (tests, one machine), a new local one."""
    set_to = spark.conf.get("spark.checkpoint.dir", None)
    if set_to:
        return set_to
    existing = spark.sparkContext._jsc.sc().getCheckpointDir()
    if existing.isDefined():
        return existing.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def small_batches(spark: SparkSession, rows: int = 2_000) -> None:
    """Send at most ``rows`` texts at once to Python: a batch of long texts must fit a worker's memory.

    The setting is the session's and stays, since plans read it when they run.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


def written(df: DataFrame, rows_a_file: int = 0) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: cuts the lineage, keeps columns prunable.

    rows_a_file bounds the rows of a file, for rows so large that a reader should not hold many at once; 0 sets no bound.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", rows_a_file).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Let Spark delete the shuffle files of each job inside as soon as it ends, and not when its collectors come to it.

    For jobs whose results are written: Spark would have to shuffle once more for one that is run again.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def forget(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made, once nothing reads them any more."""
    for df in tables:
        spark = df.sparkSession
        for place in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(place)
            if path.getName().startswith("table-"):
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def chunks(texts: Sequence[str | None], limit: int = 400_000) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yield (index of the first text, code points of some texts joined by newlines, start of each text and one end more).

    Each text is followed by one newline, so text i is codes[starts[i] : starts[i + 1] - 1]. A chunk holds about
    ``limit`` code points, or one longer text.
    """
    first, held, length = 0, [], 0
    for i, text in enumerate(texts):
        text = text or ""
        if held and length + len(text) > limit:
            yield _joined(first, held)
            first, held, length = i, [], 0
        held.append(text)
        length += len(text) + 1
    if held:
        yield _joined(first, held)


def _joined(first: int, texts: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    codes = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    starts = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    return first, codes, starts


def code_table(default: int, groups: dict[int, str]) -> np.ndarray:
    """A class for each code point: groups[c] lists the characters of class c."""
    table = np.full(0x110000, default, dtype=np.uint8)
    for value, characters in groups.items():
        table[[ord(c) for c in characters]] = value
    return table


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (multiply and shift rounds)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
