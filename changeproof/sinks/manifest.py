"""Manifests of evidence files: what each file is and the digest of its bytes, published once, and what has drifted from them since."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from changeproof.errors import Refused
from changeproof.sinks.store import TableStore


def artifact_kind(path: Column) -> Column:
    """The ending in lower case; artifact where a name has none."""
    ending = F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))
    return F.when(ending == "", "artifact").otherwise(ending)


def manifest(files: DataFrame) -> DataFrame:
    """files(path, content) to (kind, path, bytes, sha256); null content counts as empty."""
    content = F.coalesce("content", F.lit(b""))
    return files.select(artifact_kind(F.col("path")).alias("kind"), "path", F.length(content).cast("long").alias("bytes"), F.sha2(content, 256).alias("sha256"))


def publish_manifest(store: TableStore, name: str, files: DataFrame) -> bool:
    """Publish the files' manifest under a name; False if the name is published already.

    Absolute paths, those that lead out of the folder, empty ones and nulls are refused, and so are paths given twice.
    """
    path, attempt = F.col("path"), store.attempt()
    back = store.stage(attempt, "manifest", manifest(files))
    outside = path.isNull() | F.rlike(path, F.lit(r"^$|^/|^\\|^[A-Za-z]:[\\/]|(^|[\\/])\.\.([\\/]|$)"))
    bad = back.where(outside).select("path").head()
    if bad is not None:
        raise Refused("E_BAD_ARTIFACT_PATH", "a path must be relative and stay in the folder", path=bad.path)
    twice = back.groupBy("path").count().where("count > 1").select("path").head()
    if twice is not None:
        raise Refused("E_DUPLICATE_ARTIFACT", "a path is given twice", path=twice.path)
    return store.publish(name, attempt)


def manifest_drift(stated: DataFrame, files: DataFrame) -> DataFrame:
    """(path, drift) of files that are missing, changed or not in the manifest."""
    now = manifest(files).select("path", F.col("sha256").alias("now"))
    drift = F.when(F.col("now").isNull(), "missing").when(F.col("sha256").isNull(), "unlisted").when(F.col("sha256") != F.col("now"), "changed")
    return stated.select("path", "sha256").join(now, "path", "full").select("path", drift.alias("drift")).where("drift IS NOT NULL")
