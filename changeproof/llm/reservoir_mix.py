"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets the key -ln(u) / w from a stable hash u of its id and its quality weight w; in each source the documents
with the smallest keys are an exact weighted sample without replacement. A target of q whole source sizes and a rest takes
every document q times first (the complete epochs) and then documents in key order until their summed sizes reach the rest.

Sums run over key ranges: a range's total is aggregated map-side, ranges are summed up in order, and only rows within a
range are sorted together. Ranges are equal steps of the key's logarithm. Whatever the weight w, the keys -ln(u) / w spread the same way
around 1 / w there, and a step of 1 / STEPS holds at most 1 / (e * STEPS) of them: a source that holds a third of all rows is spread over thousands of groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from changeproof.llm.common import written

STEPS = 2048
WORD_BREAK = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    """The runs of characters other than space and U+0009 to U+000D; null gives none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), "")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], most: float) -> DataFrame:
    """sizes(source, source_size) to (source, source_size, target), one row a source.

    Sources in code-point order, null last, weigh ``weights`` in turn and share the sum of all sizes; a target stops at
    most times its source's size and what is over is shared again by weight until no target is above its stop. That is
    target = min(stop, level * weight) for one common level, which a running sum in the order of stop / weight finds.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    table = F.array(*[F.lit(float(w)) for w in weights])
    sized = sizes.withColumn("weight", F.element_at(table, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))).withColumn("stop", F.col("source_size") * F.lit(float(most)))
    rising = Window.orderBy(F.col("stop") / F.col("weight"), F.col("source").isNull(), "source")
    every = Window.partitionBy(F.lit(0))
    summed = sized.withColumns({"before": F.coalesce(F.sum("stop").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)), "after": F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing)), "total": F.sum("source_size").over(every)})
    level = (F.col("total") - F.col("before")) / F.col("after")
    # With all sources before it at their stops, the first one whose stop is not below the level shows the level.
    found = summed.withColumn(
        "level", F.min(F.when(F.col("stop") >= level * F.col("weight"), F.struct((F.col("stop") / F.col("weight")).alias("ratio"), "before", level.alias("level")))).over(every)["level"]
    )
    return found.select("source", "source_size", F.least(F.col("stop"), F.coalesce(F.col("level") * F.col("weight"), F.col("stop"))).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: float = 3.0, seed: str = "mix") -> DataFrame:
    """docs(doc_id, text, source, ...) with size, source_size, target and taken added (words, repeats counted).

    The quality weight of a document is 0.1 + 0.9 * (distinct words / words), from its whole text. ``taken`` is
    floor(target / source_size) epochs of size, and what the fractional selection takes: all of the documents whose words fit the
    rest of the target, in key order, and of the one in which it ends the first words up to there. Rows of size 0 take
    0. A null source is a source of its own. Repeated rows have the same key and are ordered by the text's hash and size, so
    reruns agree. An empty table gives an empty one. Other columns are kept, whatever their names, but for columns named as the four that are added,
    which these replace: a caller that needs them packs them into a struct, as the pipeline does.
    """
    words = words_of(F.col("text").cast("string"))
    u = (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))
    # The caller's columns ride along as one, so that none of their names meets one of the names below.
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "source", F.xxhash64("text").alias("tie"), u.alias("u"), words.alias("words"))
    size, kinds = F.size("words"), F.size(F.array_distinct("words"))
    weight = F.lit(0.1) + F.when(size == 0, F.lit(0.0)).otherwise(0.9 * kinds / size)
    rows = rows.select("row", "doc_id", "source", "tie", size.cast("long").alias("size"), (-F.log("u") / weight).alias("key"))
    # The logarithm is monotone, so ranges follow one another. Keys are above 0; where a range can be null as far as Spark knows, the join
    # below would first filter by it, and that works it out, words and all, once more.
    taken = _taken(rows.withColumn("range", F.coalesce(F.floor(F.log("key") * STEPS).cast("int"), F.lit(0))), weights, most)
    made = ("size", "source_size", "target", "taken")
    return taken.select(*(F.col("row")[c].alias(c) for c in docs.columns if c.lower() not in made), *made)


def _taken(rows: DataFrame, weights: tuple[int, ...], most: float) -> DataFrame:
    # At most about 90,000 rows a source (keys are between 1e-16 and 400); written, as it is read three times.
    ranges = written(rows.groupBy("source", "range").agg(F.sum("size").alias("range_size")))
    targets = source_targets(ranges.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, most)
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each source and range.
    plan = ranges.withColumn("range_start", F.coalesce(F.sum("range_size").over(before), F.lit(0))).alias("r").join(targets.alias("t"), F.expr("r.source <=> t.source"))
    plan = plan.select(F.col("r.source").alias("plan_source"), F.col("range").alias("plan_range"), "source_size", "target", "range_start")
    within = Window.partitionBy("source", "range").orderBy("key", F.col("doc_id"), "tie", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum("size").over(within), F.lit(0)))
    joined = rows.join(plan, F.expr("source <=> plan_source AND range = plan_range"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.col("target") - epochs * F.col("source_size")
    room = F.floor(rest) - F.col("range_start") - F.col("start")
    taken = F.col("size") * epochs + F.greatest(F.lit(0), F.least(F.col("size"), room))
    return joined.select("row", "size", "source_size", "target", taken.cast("long").alias("taken"))
