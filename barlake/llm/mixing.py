"""Mixing sources to target weights with hash-threshold histograms.

Every document has a size in words and a 60-bit hash of its id and text.  A source with
target T and size S takes each document ``floor(T / S)`` times, and the
documents whose hash lies below a threshold once more, so that the sizes below
the threshold come as near as whole documents allow to the rest of the target.

The threshold is found without sorting: sizes are summed by source and the
leading 12 bits of the hash; only the bucket in which the budget is crossed is
summed again by the next 12 bits, and only that bucket's documents (one in 16
million) by the whole hash.  All three levels are group-bys over a narrow
written table; nothing but per-source figures is joined back.  Only DataFrame
functions are used.

Targets fill like water: sources, sorted by code point with null last, weigh
5, 2, 1, repeating, and share the sum of all sizes; a source stops at three
times its own size and the excess is shared again by weight.  With r = 3S/w in
ascending order the sources that stop are a prefix, so the level is found by
running sums over the small per-source table.

Null or word-less text has size 0 and is taken 0 words.  A source of size 0 has
target 0.  Rows without id are told apart by their texts.  Rows equal in id and
text have equal hashes and are taken alike: together they are one step, so a
source comes within half of its largest such group (usually one document) of its
target.  Further columns are not read.  Targets come from
windows over one row a source: a task's work for thousands of sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import stored

WEIGHTS = (5, 2, 1)
MOST = 3
#: Bits of the hash resolved by each histogram level.
BITS = 12


def hash60(doc_id: Column, text: Column) -> Column:
    """The leading 60 bits of the md5 of a row's id, a colon and its text, as a long."""
    whole = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(whole), 1, 15), 16, 10).cast("long")


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, h): words of each text and the hash of its id and text."""
    size = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")
    return docs.select("doc_id", "source", size.alias("size"), hash60(F.col("doc_id"), F.col("text")).alias("h"))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target): one row a source, by filling up to ``most`` times each size."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("weight", weight)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    by_stop = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, W.currentRow)
    filled = (
        per.withColumn("cap", F.col("source_size") * float(most))
        .withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("capped", F.sum("cap").over(by_stop) - F.col("cap"))
        .withColumn("stopped_weight", F.sum("weight").over(by_stop) - F.col("weight"))
        # the level if every source before this one stops and this one does not
        .withColumn("level", (F.col("total") - F.col("capped")) / (F.col("all_weight") - F.col("stopped_weight")))
        .withColumn("level", F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(everything))
    )
    share = F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))
    return filled.select("source", "source_size", F.least("cap", share).alias("target"))


def _crossing(sums: DataFrame, key: str) -> DataFrame:
    """(source, key, rest, size): the first bucket whose running sum exceeds what is left, and what is left there."""
    run = W.partitionBy("source").orderBy(key).rowsBetween(W.unboundedPreceding, W.currentRow)
    ran = sums.withColumn("ran", F.sum("size").over(run))
    return ran.where((F.col("ran") > F.col("rest")) & (F.col("ran") - F.col("size") <= F.col("rest"))).select("source", key, (F.col("rest") - F.col("ran") + F.col("size")).alias("rest"), "size")


def thresholds(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target, base, rest, threshold): one row a source.

    A document of the source is taken ``base`` times, and once more if its hash
    is below ``threshold``.
    """
    goal = targets(sized, weights, most).withColumn("base", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    goal = stored(goal.withColumn("rest", F.col("target") - F.col("base") * F.col("source_size")), "targets")
    left = goal.select("source", "rest")
    first, second = F.shiftright("h", 60 - BITS), F.shiftright("h", 60 - 2 * BITS)

    def below(df: DataFrame, at: DataFrame, key: str) -> DataFrame:
        d, a = df.alias("d"), at.alias("a")
        return d.join(a, F.col("d.source").eqNullSafe(F.col("a.source")) & (F.col(f"d.{key}") == F.col(f"a.{key}"))).select("d.*", "a.rest")

    def with_rest(df: DataFrame) -> DataFrame:
        d, a = df.alias("d"), left.alias("a")
        return d.join(a, F.col("d.source").eqNullSafe(F.col("a.source"))).select("d.*", "a.rest")

    keyed = sized.where("size > 0").withColumns({"k1": first, "k2": second})
    at1 = _crossing(with_rest(keyed.groupBy("source", "k1").agg(F.sum("size").alias("size"))), "k1")
    in1 = below(keyed.select("source", "k1", "k2", "h", "size"), at1.drop("size"), "k1")
    at2 = _crossing(in1.groupBy("source", "k2", "rest").agg(F.sum("size").alias("size")), "k2")
    in2 = below(in1.drop("rest"), at2.drop("size"), "k2")
    at3 = _crossing(in2.groupBy("source", "h", "rest").agg(F.sum("size").alias("size")), "h")
    # the document in which the budget is crossed goes in if that is nearer
    edge = at3.select("source", (F.col("h") + (2 * F.col("rest") >= F.col("size")).cast("long")).alias("threshold"))
    g, e = goal.alias("g"), edge.alias("e")
    return stored(g.join(e, F.col("g.source").eqNullSafe(F.col("e.source")), "left").select("g.*", "e.threshold"), "thresholds")


def with_copies(docs: DataFrame, plan: DataFrame, most: int = MOST) -> DataFrame:
    """``docs`` (with source and h, the row's hash) and columns source_size, target and copies.

    The plan has one row a source, so Spark sends it to the documents.
    """
    columns = ["source_size", "target", "base", "rest", "threshold"]
    p = plan.select(F.col("source").alias("_source"), *[F.col(c).alias(f"_{c}") for c in columns])
    more = F.when(F.col("_rest") > 0, F.coalesce(F.col("h") < F.col("_threshold"), F.lit(True)).cast("long")).otherwise(0)
    joined = docs.join(p, F.col("source").eqNullSafe(F.col("_source")))
    return joined.select(
        *[docs[c] for c in docs.columns if c not in ("source_size", "target", "copies")], F.col("_source_size").alias("source_size"), F.col("_target").alias("target"),
        F.least(F.col("_base") + more, F.lit(most)).cast("long").alias("copies"),
    )


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies) for every row of ``docs`` (doc_id, text, source)."""
    sized = stored(sizes(docs), "sizes")
    out = with_copies(sized, thresholds(sized, weights, most), most)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")
