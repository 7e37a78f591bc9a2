"""Seeds: what makes one unsafe, and hash trees that find the rows in which a table departs from its seed."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from changeproof.operators.scale import cut_lineage, ensure_checkpoint_dir

# Keys that would make a seed run something, and markers that make it differ from run to run.
UNSAFE_KEYS = ("sql", "query", "script", "execute", "raw")
MARKER_KEY = r"(?i)^\$(now|random|uuid)$"
MARKER = r"(?i)^(?:\$(?:now|random|uuid)|\{\{\s*(?:now|random|uuid|date\.now|crypto\.randomuuid)\s*\}\})$"


def walk(df: DataFrame, ids: list[str], json: str) -> DataFrame:
    """df(ids, json) to (ids, path array<string>, key, kind, text): every member and element of a JSON text, at any depth.

    One round for each level of nesting, on the objects and arrays of the level before; positions stand as keys of elements (key is null).
    kind is object, array or scalar; text is that of a scalar. Text that is not JSON has no rows.
    """
    level = df.select(*ids, F.array().cast("array<string>").alias("path"), F.try_parse_json(F.col(json)).alias("node")).where("node IS NOT NULL")
    found = None
    while True:
        inside = level.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("node").outer()))
        shape = F.schema_of_variant("value")
        kind = F.when(F.startswith(shape, F.lit("OBJECT")), "object").when(F.startswith(shape, F.lit("ARRAY")), "array").otherwise("scalar")
        path = F.concat("path", F.array(F.coalesce("key", F.col("pos").cast("string"))))
        level = cut_lineage(inside.select(*ids, path.alias("path"), "key", kind.alias("kind"), F.col("value").alias("node")))
        here = level.select(*ids, "path", "key", "kind", F.when(F.col("kind") == "scalar", F.expr("try_variant_get(node, '$', 'string')")).alias("text"))
        found = here if found is None else found.unionByName(here)
        level = level.where("kind <> 'scalar'").select(*ids, "path", "node")
        if level.isEmpty():
            return found


def seed_problems(seeds: DataFrame, ids: list[str], json: str) -> DataFrame:
    """seeds(ids, json) to (ids, path, code): keys that are no rows but orders, and markers that differ from run to run, at any depth."""
    nodes = walk(seeds, ids, json)
    unsafe = F.lower("key").isin(*UNSAFE_KEYS)
    marked = F.rlike("key", F.lit(MARKER_KEY)) | F.rlike(F.trim("text"), F.lit(MARKER))
    code = F.when(unsafe, "E_SEED_UNSAFE").when(marked, "E_SEED_NON_DETERMINISTIC")
    return nodes.select(*ids, F.array_join("path", ".").alias("path"), code.alias("code")).where("code IS NOT NULL")


#: Hexadecimal digits of a row's hash that name its leaf, and those that name the folder it is kept in.
LEAF, FOLDER = 4, 2


def row_text(columns: list[str]) -> Column:
    """The values of a row as one text, each with its length before it, so that two rows share a text only if they are equal."""

    def part(c: str) -> Column:
        text = F.col(c).cast("string")
        return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.concat_ws("", *map(part, columns))


def row_hash(columns: list[str]) -> Column:
    return F.sha2(row_text(columns), 256)


def hash_nodes(hashed: DataFrame, by: list[str]) -> DataFrame:
    """hashed(by, h) to the nodes of each group's tree: (by, node, digest, n). Node "" is the root.

    A leaf is named by the first LEAF digits of its rows' hashes and is the hash of them in order; a node is the hash of its
    children's names and digests, of which there are at most 16. So no task holds the rows of a large group, and a digest does
    not depend on the rows' order.
    """
    leaf = hashed.groupBy(*by, F.substring("h", 1, LEAF).alias("node"))
    level = leaf.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("digest"), F.count("*").alias("n"))
    nodes = level
    for size in range(LEAF - 1, -1, -1):
        above = level.groupBy(*by, F.substring("node", 1, size).alias("up"))
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "digest"))), lambda x: F.concat(x["node"], x["digest"])), "")
        level = above.agg(F.sha2(text, 256).alias("digest"), F.sum("n").alias("n")).withColumnRenamed("up", "node")
        nodes = nodes.unionByName(level)
    return nodes


@dataclass
class HashTree:
    """A table kept for comparison: its nodes, and its rows in folders by the first FOLDER digits of their hashes."""

    nodes: DataFrame
    rows: DataFrame
    by: list[str]
    columns: list[str]

    def digests(self) -> DataFrame:
        return self.nodes.where("node = ''").select(*self.by, "digest", F.col("n").alias("n_rows"))


def keep_tree(df: DataFrame, columns: list[str], by: list[str], folder: str | None = None) -> HashTree:
    """Write df's rows and nodes to a new place in ``folder`` (the shared one by default). Columns named h and node are not allowed."""
    spark: SparkSession = df.sparkSession
    if folder is None:
        ensure_checkpoint_dir(spark)
        folder = spark.sparkContext.getCheckpointDir()
    place = f"{folder.rstrip('/')}/tree-{uuid.uuid4().hex}"
    own = list(dict.fromkeys([*by, *columns]))
    hashed = df.select(*own, row_hash(columns).alias("h")).withColumn("folder", F.substring("h", 1, FOLDER))
    hashed.repartition("folder", F.substring("h", 1, LEAF)).write.partitionBy("folder").parquet(f"{place}/rows")
    rows = spark.read.schema(hashed.schema).parquet(f"{place}/rows")
    hash_nodes(rows, by).write.parquet(f"{place}/nodes")
    return HashTree(spark.read.parquet(f"{place}/nodes"), rows, list(by), list(columns))


def _same(left: DataFrame, right: DataFrame, keys: list[str]):
    return [left[k].eqNullSafe(right[k]) for k in keys]


def differing_leaves(a: HashTree, b: HashTree) -> DataFrame:
    """(by, node) of the leaves that are not alike, found from the roots down: children are compared only below nodes that differ."""
    keys = [*a.by, "node"]
    # The roots: one for each group.
    open_ = None
    for size in range(LEAF + 1):
        left, right = (t.nodes.where(F.length("node") == size).select(*keys, F.col("digest").alias(f"digest_{side}")) for side, t in (("a", a), ("b", b)))
        if open_ is not None:
            up = open_.withColumnsRenamed({k: f"up_{k}" for k in keys})
            below = lambda t: t.join(up, [*(F.col(k).eqNullSafe(F.col(f"up_{k}")) for k in a.by), F.substring("node", 1, size - 1) == F.col("up_node")], "left_semi")  # noqa: B023, E731
            left, right = below(left), below(right)
        r = right.withColumnsRenamed({k: f"r_{k}" for k in keys})
        both = left.join(r, [F.col(k).eqNullSafe(F.col(f"r_{k}")) for k in keys], "full").where(~F.col("digest_a").eqNullSafe(F.col("digest_b")))
        # A group that one side does not have still has a node there, whose key is not null; groups may be null.
        there = F.col("node").isNotNull()
        open_ = both.select(*(F.when(there, F.col(k)).otherwise(F.col(f"r_{k}")).alias(k) for k in keys))
    return open_


def differing_rows(a: HashTree, b: HashTree) -> DataFrame:
    """The rows of leaves that differ: (by, columns, a_rows, b_rows) where the two sides hold a row a different number of times.

    Only folders of differing leaves are read; there are at most 16 ** FOLDER of them.
    """
    leaves = cut_lineage(differing_leaves(a, b))
    folders = [r.folder for r in leaves.select(F.substring("node", 1, FOLDER).alias("folder")).distinct().collect()]
    own = list(dict.fromkeys([*a.by, *a.columns]))
    at = leaves.withColumnsRenamed({k: f"at_{k}" for k in leaves.columns})

    def side(tree: HashTree, name: str) -> DataFrame:
        rows = tree.rows.where(F.col("folder").isin(folders))
        rows = rows.join(at, [*(F.col(k).eqNullSafe(F.col(f"at_{k}")) for k in a.by), F.substring("h", 1, LEAF) == F.col("at_node")], "left_semi")
        return rows.groupBy(*own, "h").agg(F.count("*").alias(f"{name}_rows"))

    left, right = side(a, "a"), side(b, "b")
    r = right.withColumnsRenamed({k: f"r_{k}" for k in [*own, "h"]})
    both = left.join(r, [F.col("h") == F.col("r_h"), *(F.col(k).eqNullSafe(F.col(f"r_{k}")) for k in a.by)], "full")
    there = F.col("h").isNotNull()
    counted = both.select(*(F.when(there, F.col(c)).otherwise(F.col(f"r_{c}")).alias(c) for c in own), *(F.coalesce(f"{s}_rows", F.lit(0)).alias(f"{s}_rows") for s in "ab"))
    return counted.where("a_rows <> b_rows")
