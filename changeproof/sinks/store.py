"""Several tables published as one: staged writes, and a manifest that is written last and never replaced.

Layout: data/<attempt>/<table> holds what one attempt wrote, manifests/<name>.json says which attempt counts for a name. Readers go by
manifests alone, so the tables of an attempt that died are never seen, and a name that is published stays as it is.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, types as T

from changeproof.errors import Refused


@dataclass
class Staged:
    """What an attempt has written so far: its folder, and each table's schema and rows."""

    place: str
    tables: dict[str, dict]


class TableStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs

    def _system(self):
        return self._fs.Path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def attempt(self) -> Staged:
        return Staged(f"{self.path}/data/{uuid.uuid4().hex}", {})

    def stage(self, attempt: Staged, table: str, df: DataFrame) -> DataFrame:
        """Write one table of an attempt, and what can be read back of it."""
        df.write.parquet(f"{attempt.place}/{table}")
        back = self.spark.read.schema(df.schema).parquet(f"{attempt.place}/{table}")
        attempt.tables[table] = {"schema": df.schema.jsonValue(), "rows": back.count()}
        return back

    def publish(self, name: str, attempt: Staged) -> bool:
        """Let an attempt count for a name; False, and nothing changes, if the name is published already."""
        if not name or any(c in name for c in "/\\:"):
            raise Refused("E_STORE_NAME", "a name must be a plain file name", name=name)
        system, final = self._system(), self._fs.Path(f"{self.path}/manifests/{name}.json")
        if system.exists(final):
            return False
        draft = self._fs.Path(f"{self.path}/drafts/{uuid.uuid4().hex}")
        system.mkdirs(final.getParent())
        out = system.create(draft, False)
        try:
            out.write(bytearray(json.dumps({"name": name, "place": attempt.place, "tables": attempt.tables}).encode()))
        finally:
            out.close()
        rename = getattr(self._fs, "Options$Rename")
        context = self._fs.FileContext.getFileContext(self._fs.Path(self.path).toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            # Without the option to overwrite, the second of two attempts fails here.
            context.rename(draft, final, self.spark.sparkContext._gateway.new_array(rename, 0))
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" not in e.java_exception.getClass().getName():
                raise
            system.delete(draft, False)
            return False
        return True

    def manifests(self) -> list[dict]:
        """One for each published name, in the order of the names."""
        system, folder = self._system(), self._fs.Path(f"{self.path}/manifests")
        if not system.exists(folder):
            return []
        found = self.spark.read.text(f"{self.path}/manifests", wholetext=True).collect()
        return sorted((json.loads(r.value) for r in found), key=lambda m: m["name"])

    def read(self, table: str, names: list[str] | None = None) -> DataFrame:
        """A table over all published names, or over some. A table that nobody published is refused."""
        held = [m for m in self.manifests() if table in m["tables"] and (names is None or m["name"] in names)]
        if not held:
            raise Refused("E_STORE_EMPTY", "no published table of this name", table=table)
        schema = T.StructType.fromJson(held[-1]["tables"][table]["schema"])
        return self.spark.read.schema(schema).parquet(*(f"{m['place']}/{table}" for m in held))
