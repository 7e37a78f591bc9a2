"""Exact deduplication by deterministic block naming, in DataFrame operations only.

A normalised text is cut into blocks of a fixed size. The distinct blocks are sorted and numbered, so that two blocks have
the same integer exactly if they are the same string; then the pairs of neighbouring names are sorted and numbered in
the same way, until one name is left for each text. Nothing is hashed on the way to an identity, so two different
texts cannot meet in one. Numbers are dealt by sorted buckets, so no step passes through one task.

The first naming is that of (length, first block of 64): a text that is alone with its pair has its identity already. Only
the others are cut up and named to the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from changeproof.llm.common import BROADCAST_ROWS, written

#: Code points of a block, and of the block that the first naming uses.
BLOCK, HEAD = 4096, 64
BUCKETS = 1024
BLANKS = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """text without the characters of ``[\\x20\\x09-\\x0D]``; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, "")


def numbered(keys: DataFrame, by: list[str], name: str) -> DataFrame:
    """Distinct keys with an integer each: the bucket of the key, then its rank among the sorted keys of the bucket."""
    distinct = keys.select(*by).distinct().withColumn("bucket", F.pmod(F.xxhash64(*by), F.lit(BUCKETS)))
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy(*by))
    return distinct.withColumn(name, F.col("bucket") * F.lit(1 << 40) + rank).drop("bucket")


def block_names(texts: DataFrame) -> DataFrame:
    """texts(rid, norm) with rid unique to (rid, level, name): equal norms exactly where level and name are equal."""
    # The pattern takes each run of BLOCK code points; an empty text has one empty block.
    cut = F.when(F.col("norm") == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all("norm", F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)))
    blocks = texts.select("rid", F.posexplode(cut).alias("pos", "block"))
    names = written(blocks.join(numbered(blocks, ["block"], "name"), "block").select("rid", "pos", "name"))
    done, level = None, 0
    while True:
        many = names.where("pos > 0").select("rid").distinct()
        ready = names.join(many, "rid", "left_anti").select("rid", F.lit(level).alias("level"), "name")
        done = ready if done is None else done.unionByName(ready)
        rest = names.join(many, "rid", "left_semi")
        pairs = rest.groupBy("rid", F.floor(F.col("pos") / 2).cast("int").alias("pos")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left"), F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(0)).alias("right")
        )
        names = written(pairs.join(numbered(pairs, ["left", "right"], "name"), ["left", "right"]).select("rid", "pos", "name"))
        if names.isEmpty():
            return done
        level += 1


def _parts(docs: DataFrame, carried: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows alone with their length and head, the other rows with rid, level and name), both with carried columns and norm."""
    base = docs.withColumn("norm", normalised(F.col("text").cast("string"))).withColumns({"length": F.length("norm"), "head": F.substring("norm", 1, HEAD)})
    twice = written(base.groupBy("length", "head").count().where("count > 1").select("length", "head"))
    known = F.broadcast(twice) if twice.count() <= BROADCAST_ROWS else twice
    alone = base.join(known, ["length", "head"], "left_anti").select(*carried, "norm")
    open_ = written(base.join(known, ["length", "head"], "left_semi").select(*carried, "norm"))
    # Numbered as written, so the numbers stay when a task is run again.
    open_ = written(open_.withColumn("rid", F.monotonically_increasing_id()))
    return alone, open_.join(block_names(open_.select("rid", "norm")), "rid")


def _groups(named: DataFrame) -> DataFrame:
    """(level, name, group_size, best): the smallest of (- code points, no id, id, rid) stays; minima are aggregated map-side."""
    best = F.min(F.struct((-F.col("n")).alias("longest"), F.col("id").isNull().alias("no_id"), "id", "rid"))
    return named.groupBy("level", "name").agg(F.count("*").alias("group_size"), best.alias("best"))


def exact_groups(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) to (doc_id, keep_id, group_size, kept, text_sha256), one row for each row of docs.

    Rows are equal when their texts are identical after deleting blanks; null counts as empty. The row with the most code
    points in the original text stays, then the smallest doc_id (null last), then the first of repeated rows: exactly
    one row of a group is kept. keep_id is null only if all doc_ids of the group are. An empty table gives an empty one.
    Other columns are not read.
    """
    text = F.col("text").cast("string")
    alone, rest = _parts(docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.length(text), F.lit(0)).alias("n"), "text"), ["id", "n"])
    digest = F.sha2("norm", 256).alias("text_sha256")
    single = alone.select(F.col("id").alias("doc_id"), F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), digest)
    rows = written(rest.select("rid", "id", "n", "level", "name", digest))
    named = rows.join(_groups(rows), ["level", "name"])
    return single.unionByName(named.select(F.col("id").alias("doc_id"), F.col("best.id").alias("keep_id"), "group_size", (F.col("rid") == F.col("best.rid")).alias("kept"), "text_sha256"))


def kept_rows(docs: DataFrame) -> DataFrame:
    """The rows of docs that exact_groups keeps, with all their columns."""
    text = F.col("text").cast("string")
    whole = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"), F.coalesce(F.length(text), F.lit(0)).alias("n"), "text")
    alone, rest = _parts(whole, ["row", "id", "n"])
    rows = written(rest.select("rid", "row", "id", "n", "level", "name"))
    stay = _groups(rows).select(F.col("best.rid").alias("rid"))
    return alone.select("row.*").unionByName(rows.join(stay, "rid", "left_semi").select("row.*"))
