"""Mixing sources to target weights: a time-varying curriculum.

Each source has a weight schedule over training time t in [0, 1].  Its
integral says how many of the source's words the mix has asked for by time t.
A document stands in its source's queue at the words before its middle; the
inverse of the integral at that place is its training position, and what is
asked for by t = 1 is taken, again and again around the queue.  A range sort
by position gives the order.

A source has two queues, of large documents (over half its mean) and of small
ones.  The large ones are asked for their share of the target; the small ones
for what these leave of it, so the taken words end within half a small
document of the target.  Queues are in the order of the MD5 of doc_id.

Defined cases: null text has size 0 and is never taken; null source is a
source of its own, last in order; repeated rows are documents of their own;
ties in the queue fall to doc_id, then to the text's hash; an empty table
gives an empty mix; extra columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Hot, bounded, clean_documents, hash_parts, mark, release, small, stored, tidy

WEIGHTS = (5.0, 2.0, 1.0)
MOST_PASSES = 3
#: Sources of a range: a prefix sum runs over the ranges' totals first, then inside each range.
SLICE = 200_000
#: Schedules by weight class: a source of slope s is asked for at the rate 1 + s*(2t - 1).  Heavy sources fade, light ones grow.
SLOPES = (-0.5, 0.25, 0.5)


def _sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n = pa.array([len(t.as_py().split()) for t in b.column(3)], pa.int64())  # splits on the six blanks
        yield pa.RecordBatch.from_arrays([*b.columns[:3], n], names=["doc_id", "source", "th", "size"])


def sizes(docs: DataFrame) -> DataFrame:
    """One row (doc_id, source, th, size) per input row; ``th`` tells texts of one doc_id apart."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select(F.col("doc_id").cast("bigint"), "source", F.xxhash64(text).alias("th"), text.cast("binary").alias("bytes"))
    return d.mapInArrow(tidy(_sized), "doc_id bigint, source string, th bigint, size bigint")


def running(d: DataFrame, n: int, order: list[Column], **values: Column) -> DataFrame:
    """``d`` (``n`` rows) with, by name, the sum of each value over the rows before in ``order``.

    Rows are dealt by range; a sum runs over the ranges' totals, one row each,
    and inside every range.  So no task holds more than a range.
    """
    parts = max(1, -(-n // SLICE))
    before = Window.unboundedPreceding, -1
    if parts == 1:  # one range
        return d.withColumns({k: F.coalesce(F.sum(v).over(Window.orderBy(*order).rowsBetween(*before)), F.lit(0)) for k, v in values.items()})
    d = d.withColumns({f"__o{i}": c for i, c in enumerate(order)} | {f"__v{k}": v for k, v in values.items()})
    by = [f"__o{i}" for i in range(len(order))]
    d = stored(d.repartitionByRange(parts, *by).withColumn("__part", F.spark_partition_id()))
    each = Window.partitionBy("__part").orderBy(*by).rowsBetween(*before)
    ranges = Window.orderBy("__part").rowsBetween(*before)  # as many rows as ranges
    totals = d.groupBy("__part").agg(*[F.sum(f"__v{k}").alias(f"__t{k}") for k in values])
    totals = totals.select(F.col("__part").alias("__p"), *[F.coalesce(F.sum(f"__t{k}").over(ranges), F.lit(0)).alias(f"__b{k}") for k in values])
    d = d.join(small(totals, parts), F.col("__part") == F.col("__p"))
    out = d.withColumns({k: F.col(f"__b{k}") + F.coalesce(F.sum(f"__v{k}").over(each), F.lit(0)) for k in values})
    return out.drop("__part", "__p", *by, *[f"__{x}{k}" for k in values for x in "vb"])


def targets(by_source: DataFrame) -> DataFrame:
    """Adds ``weight``, ``slope`` and ``target`` to (source, source_size, n).

    Targets share the total by weight under the ceiling MOST_PASSES * size.
    Sources sorted by ceiling per unit of weight fill up in that order, so the
    common level of the rest follows from running sums.
    """
    n, total = by_source.agg(F.count(F.lit(1)), F.coalesce(F.sum("source_size"), F.lit(0)).cast("double")).first()
    # nulls last; binary order of UTF-8 is the order of code points
    name = [F.col("source").isNull(), F.col("source")]
    cut = stored if n > SLICE else lambda d: d
    d = running(by_source, n, name, i=F.lit(1))
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("i") % len(WEIGHTS) + 1).cast("int"))
    d = cut(d.withColumn("weight", pick(WEIGHTS)).withColumn("slope", pick(SLOPES)).withColumn("cap", F.col("source_size") * F.lit(float(MOST_PASSES))))
    weights = d.agg(F.coalesce(F.sum("weight"), F.lit(0.0))).first()[0]
    d = running(d, n, [F.col("cap") / F.col("weight"), *name], caps=F.col("cap"), before=F.col("weight"))
    d = cut(d.withColumn("level", (F.lit(total) - F.col("caps")) / (F.lit(weights) - F.col("before"))))
    # full while the level of what is left still lies above the source's own ceiling
    full = F.col("level") * F.col("weight") >= F.col("cap")
    rest = d.agg(F.max(F.when(~full, F.col("level")))).first()[0]
    return d.withColumn("target", F.when(full, F.col("cap")).otherwise(F.lit(rest or 0.0) * F.col("weight"))).drop("cap", "level", "caps", "before", "i")


def _key(source: Column) -> Column:
    """A source as a bounded key that tells null from every name."""
    return F.coalesce(F.concat(F.lit("s"), bounded(source)), F.lit("n"))


def plan(sized: DataFrame, seed: int = 7) -> DataFrame:
    """(doc_id, source, th, size, source_size, target, slope, queue_size, asked, middle, copies) per row of ``sized``.

    ``middle`` is the row's place in its queue of ``queue_size`` words, and
    ``asked`` how many words the schedule asks of that queue by t = 1.
    """
    spark, since = sized.sparkSession, mark()
    sized = stored(sized.withColumn("key", _key(F.col("source"))))
    by_source = stored(sized.groupBy("source").agg(F.sum("size").cast("bigint").alias("source_size"), F.count(F.lit(1)).alias("n")))
    known = stored(targets(by_source).withColumn("key", _key(F.col("source"))))
    n_sources = known.count()
    of_source = Hot(sized, "key", n_sources)
    # a queue's prefix sum runs over its slices' totals first, then inside each; their number grows as its root
    per = known.select("key", "source_size", "target", "slope", (F.col("source_size") / F.col("n") / 2).alias("edge"), F.ceil(F.sqrt("n") / 4).alias("slices"))
    q = of_source.join(sized, per).withColumn("large", F.col("size") > F.col("edge"))
    q = q.withColumn("h", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    part = F.shiftright(F.conv(F.substring("h", 1, 8), 16, 10).cast("bigint") * F.col("slices"), 32)
    q = q.withColumn("part", part.cast("int")).drop("edge", "slices")
    parts = q.groupBy("key", "large", "part").agg(F.sum("size").alias("part_size"))
    queue = Window.partitionBy("key", "large")  # a row per slice
    ahead = F.coalesce(F.sum("part_size").over(queue.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    facts = stored(parts.withColumn("ahead", ahead).withColumn("queue_size", F.sum("part_size").over(queue)).drop("part_size"))
    inside = Window.partitionBy("key", "large", "part").orderBy("h", "doc_id", "th").rowsBetween(Window.unboundedPreceding, -1)
    d = q.repartition(hash_parts(spark), "key", "large", "part").withColumn("in_part", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    d = d.join(small(facts, facts.count()), ["key", "large", "part"])
    d = stored(d.withColumn("middle", F.col("ahead") + F.col("in_part") + F.col("size") / 2.0).drop("ahead", "in_part", "part", "h"))

    def taken(asked: Column) -> Column:
        """Passes around the queue in which the row's middle is asked for by t = 1; empty texts are not taken."""
        n = sum((F.when(p * F.col("queue_size") + F.col("middle") <= asked, 1).otherwise(0) for p in range(MOST_PASSES)), F.lit(0))
        return F.when(F.col("size") > 0, n).otherwise(0).cast("int")

    share = F.col("target") * F.col("queue_size") / F.col("source_size")
    large = d.where("large").withColumn("asked", share).withColumn("copies", taken(share))
    got = stored(large.groupBy("key").agg(F.sum(F.col("copies") * F.col("size")).alias("got")))
    few = d.where("NOT large")
    few = of_source.join(few, got, "left").withColumn("asked", F.col("target") - F.coalesce(F.col("got"), F.lit(0)))
    few = few.withColumn("copies", taken(F.col("asked"))).select(*large.columns)
    release(spark, since, d, got, *([of_source.hot] if of_source.hot else []))
    return large.unionByName(few).drop("key", "large")


def position(demand: Column, slope: Column) -> Column:
    """t in [0, 1] at which a source asked for the share ``demand`` of its target.

    The rate 1 + s*(2t-1) integrates to (1-s)*t + s*t^2.
    """
    x = F.least(F.greatest(demand, F.lit(0.0)), F.lit(1.0))
    b = 1.0 - slope
    root = (F.sqrt(b * b + 4.0 * slope * x) - b) / (2.0 * slope)
    return F.when(F.abs(slope) < 1e-9, x).otherwise(root)


def positions(planned: DataFrame) -> DataFrame:
    """One row per taken copy, with its training ``position``."""
    d = planned.where(F.col("copies") > 0).withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    return d.withColumn("position", position((F.col("pass") * F.col("queue_size") + F.col("middle")) / F.col("asked"), F.col("slope")))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns, how often each document is taken, and the training position of its first copy."""
    first = F.when(F.col("copies") > 0, position(F.col("middle") / F.col("asked"), F.col("slope")))
    return plan(sizes(docs)).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies", first.alias("position"))


def mix(docs: DataFrame) -> DataFrame:
    """Documents of the mix in training order, as often as each is taken.

    Rows that share doc_id, source and text have a place each in the plan, and
    come back as often as all of them are taken.
    """
    spark = docs.sparkSession
    docs = clean_documents(docs)
    sized = stored(sizes(docs))
    planned = stored(positions(plan(sized)).select("doc_id", "source", "th", "pass", "position"))
    keyed = docs.withColumn("__th", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    if not stored(sized.groupBy("doc_id", "source", "th").count().where("count > 1")).isEmpty():
        keyed = keyed.dropDuplicates(["doc_id", "source", "__th"])
    p = planned.select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("th").alias("__p_th"), "pass", "position")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__th") == F.col("__p_th")) & F.col("source").eqNullSafe(F.col("__source"))
    out = keyed.join(p.hint("shuffle_hash"), same).repartitionByRange(hash_parts(spark), "position", "doc_id").sortWithinPartitions("position", "doc_id", "pass")
    return out.select(*docs.columns)
