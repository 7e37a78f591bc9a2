"""SpotSigs: document fingerprints of chains of content words that follow common words, in DataFrame operations only.

A spot is a common word (an anchor such as "the" or "der"). Its signature is the chain of the next content words after it:
stop words in between are passed over. Anchors are dense in prose and rare in lists, tables and navigation, so the
signatures stand for the running text. A fingerprint is the set of the signatures' checksums, written in order.

Likeness is the Jaccard similarity of two fingerprints. It cannot exceed min / max of the two set sizes, so a join is
partitioned by set length and compares each length only with those near enough; within that, sets meet through the
signatures of a prefix, which any two sets that are similar enough share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from changeproof.llm.common import written

#: Common words of English, German, French and Spanish: spots start at these and chains pass over them.
ANCHORS = (
    *("the", "a", "of", "and", "to", "in", "is", "it", "that", "was", "for", "with"),
    *("der", "die", "das", "und", "den", "von", "zu", "ist", "mit", "sich"),
    *("le", "la", "les", "des", "et", "un", "une", "du", "que", "est"),
    *("el", "los", "las", "de", "y", "en", "se", "por", "con", "no"),
)
#: Content words of a chain, and common words passed over before each.
CHAIN, PASSED = 2, 4


def signatures(text: Column, anchors: tuple[str, ...] = ANCHORS, chain: int = CHAIN) -> Column:
    """The sorted distinct signature checksums (long) of a text.

    Words are runs of letters and digits, in lower case. A text without a spot has one signature, of all its words, so that
    only texts with the same words are alike; null counts as empty.
    """
    plain = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
    stop = f"(?:{'|'.join(anchors)})"
    # A look-ahead takes the chain, so the next spot may start within it.
    link = f"(?: {stop}(?= )){{0,{PASSED}}} (?!{stop} )[^ ]+"
    spots = F.regexp_extract_all(plain, F.lit(f" (?={stop}((?:{link}){{{chain}}}) )"), F.lit(1))
    content = F.transform(spots, lambda x: F.crc32(F.regexp_replace(x, f" {stop}(?= )", "").cast("binary")))
    return F.when(F.size(spots) > 0, F.array_sort(F.array_distinct(content))).otherwise(F.array(F.crc32(plain.cast("binary"))))


def written_out(signature: Column) -> Column:
    """A fingerprint as text: 8 hexadecimal digits for each signature, in order."""
    return F.array_join(F.transform(signature, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two signature arrays (neither is ever empty)."""
    common = F.size(F.array_intersect(a, b))
    return common / (F.size(a) + F.size(b) - common)


def spot_pairs(docs: DataFrame, least: float = 0.75) -> DataFrame:
    """docs(doc_id, text) to the pairs (a, b, likeness) of distinct fingerprints alike by least or more, a < b.

    a and b are the smallest doc_ids of all documents with that fingerprint. The lists of signatures are ordered by how many
    fingerprints have them, and a pair meets in the first such signature that both have within their prefixes.
    """
    prints = docs.where("doc_id IS NOT NULL").select("doc_id", signatures(F.col("text")).alias("sigs"))
    classes = written(prints.groupBy("sigs").agg(F.min("doc_id").alias("doc_id")).withColumn("n", F.size("sigs")))
    single = classes.select("doc_id", "n", F.explode("sigs").alias("sig"))
    often = single.groupBy("sig").agg(F.count("*").alias("df")).where("df > 1")
    ranked = single.join(often, "sig").groupBy("doc_id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "sig"))).alias("sigs"))
    # Of n signatures, n - ceil(least * n) + 1 are in the prefix; those that nobody else has come first and are left out.
    prefix = F.col("n") - F.ceil(F.col("n") * least) + 1 - (F.col("n") - F.size("sigs"))
    keyed = ranked.where(prefix > 0).select("doc_id", "n", F.explode(F.slice("sigs", F.lit(1), prefix.cast("int"))).alias("x")).select("doc_id", "n", F.col("x.sig").alias("sig"))
    # Set lengths in steps by which similar sets differ at most one.
    step = F.floor(F.log("n") / F.lit(-1.0) / F.log(F.lit(least)))
    left = keyed.select(F.col("doc_id").alias("a"), F.col("n").alias("n_a"), "sig", step.alias("step"))
    right = keyed.select(F.col("doc_id").alias("b"), F.col("n").alias("n_b"), "sig", F.explode(F.array(step - 1, step, step + 1)).alias("step"))
    met = left.join(right, ["sig", "step"]).where((F.col("a") < F.col("b")) & (F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * least)).select("a", "b").distinct()
    at_a, at_b = (classes.select(F.col("doc_id").alias(c), F.col("sigs").alias(f"sigs_{c}")) for c in "ab")
    return met.join(at_a, "a").join(at_b, "b").select("a", "b", likeness(F.col("sigs_a"), F.col("sigs_b")).alias("likeness")).where(F.col("likeness") >= least)


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint each document, its edited text and its next document; one row for each row of docs.

    The next document is that with the next smaller doc_id (of repeated ids: the next text in order; null ids come last);
    after the last comes the first. In the edited text the last half of the code points, rounded down, is replaced by as
    many of the next document's first, or by all if it is shorter. Null text is empty; a single row is its own next. An empty
    table gives an empty one. Other columns are not read.
    """
    spark = docs.sparkSession
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    splits = ids.where("doc_id IS NOT NULL").approxQuantile("doc_id", [k / 256 for k in range(1, 256)], 0.001)
    bounds = sorted({int(x) for x in splits})
    # Ranges of ids, each of which one task sorts; larger ids in smaller ranges, null ids at the end.
    place = F.lit(0) if not bounds else F.size(F.filter(F.array(*map(F.lit, bounds)), lambda x: x >= F.col("doc_id")))
    ranges = F.when(F.col("doc_id").isNull(), F.lit(len(bounds) + 1)).otherwise(place)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("range", ranges)
    order = [F.col("doc_id").desc_nulls_last(), "text"]
    # The head of each range, for the last row of the range before it: one row a range.
    tops = rows.groupBy("range").agg(F.max("doc_id").alias("top"))
    heads = written(rows.join(F.broadcast(tops), "range").where("doc_id <=> top").groupBy("range").agg(F.min("text").alias("text")))
    follow = Window.partitionBy(F.lit(0)).orderBy("range")
    chain = heads.select("range", F.coalesce(F.lead("text").over(follow), F.first("text").over(follow.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("following"))
    within = Window.partitionBy("range").orderBy(*order)
    nexts = rows.withColumn("in_range", F.lead("text").over(within)).join(F.broadcast(chain) if heads.count() <= 300 else chain, "range")
    half = F.floor(F.length("text") / 2).cast("int")
    following = F.coalesce("in_range", "following")
    edited = F.concat(F.col("text").substr(F.lit(1), F.length("text") - half), following.substr(F.lit(1), half))
    made = nexts.select("doc_id", F.length("text").cast("long").alias("n_chars"), edited.alias("edited"), signatures(F.col("text")).alias("own"), signatures(following).alias("next"))
    made = made.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "own", "next", signatures(F.col("edited")).alias("changed"))
    return made.select(
        "doc_id", "n_chars", "edited_sha256", written_out(F.col("own")).alias("fingerprint"), written_out(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("next")).alias("near_next"),
    )
