"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plume.llm.common import WORD, discard, stored, unit_hash, with_keys

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_COPIES = 2
#: Documents of a source that share a rank bucket, at most and about.
BUCKET_ROWS = 10_000
#: Square roots of sizes are whole numbers in units of 1 / UNIT.
UNIT = 1024
#: Times that a source is gone through for the words that are missing.
ROUNDS = 3
#: Tables of one row per source are broadcast up to so many sources; beyond, they are joined by shuffle.
BROADCAST_SOURCES = 100_000


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """One row per source: source, source_size, target.

    Sources in code-point order, null last, take the weights in turn and
    share ``share`` times all words. A target stops at ``most`` times its
    source's size; what it can't take is shared again by weight. The fixed
    point is found in closed form: in order of (limit / weight) the sources
    that stop come first, and what is left over divides by the weights of
    the rest. There is one row per source here, so the windows are small.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (turn + 1).cast("int"))
    per = per.withColumn("weight", weight.cast("long")).withColumn("limit", F.col("source_size") * F.lit(most))
    fill = Window.orderBy((F.col("limit") / F.col("weight")), F.col("source").asc_nulls_last())
    before, rest = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    every = fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) * F.lit(share) - F.coalesce(F.sum("limit").over(before), F.lit(0))) / F.sum("weight").over(rest)
    per = per.withColumn("level", level)
    # the first source in this order whose share stays within its limit sets the level for all after it
    held = F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.col("level"))
    per = per.withColumn("level", F.first(held, ignorenulls=True).over(fill.rowsBetween(Window.unboundedPreceding, 0)))
    target = F.when(F.col("level").isNull(), F.col("limit").cast("double")).otherwise(F.col("level") * F.col("weight"))
    return per.select("source", "source_size", F.least(target, F.col("limit").cast("double")).alias("target"))


def expected_copies(sized: DataFrame, targets: DataFrame, most: int = MOST_COPIES) -> DataFrame:
    """source, size, source_size, target, expected: the copies that a document of a size is to have on average.

    They are in proportion to the square root of the size (in units of 1 /
    ``UNIT``, so that sums are exact) up to ``most``, at the level at which
    they sum up to the source's target words. There is one row per source
    and size here; in order of falling size the documents that stop at
    ``most`` come first, as in :func:`source_targets`.
    """
    per = sized.groupBy("source", "size").agg(F.count("*").alias("n")).withColumnRenamed("source", "of_source")
    per = per.join(targets, F.col("source").eqNullSafe(F.col("of_source"))).drop("of_source")
    exact = "decimal(38,0)"
    per = per.withColumn("measure", F.floor(F.sqrt("size") * UNIT).cast("long"))
    per = per.withColumn("full", (F.col("size") * F.col("n") * most).cast(exact)).withColumn("part", F.col("size").cast("decimal(20,0)") * (F.col("n") * F.col("measure")).cast("decimal(18,0)"))
    fall = Window.partitionBy("source").orderBy(F.col("size").desc())
    before, rest = fall.rowsBetween(Window.unboundedPreceding, -1), fall.rowsBetween(0, Window.unboundedFollowing)
    held = F.coalesce(F.sum("full").over(before).cast("double"), F.lit(0.0))
    sum_of_rest = F.sum("part").over(rest).cast("double")
    level = F.when(sum_of_rest > 0, (F.col("target") - held) / sum_of_rest)
    per = per.withColumn("level", level)
    fits = F.when(F.col("level") * F.col("measure") <= most, F.col("level"))
    per = per.withColumn("level", F.first(fits, ignorenulls=True).over(fall.rowsBetween(Window.unboundedPreceding, 0)))
    expected = F.when(F.col("level").isNull(), F.lit(float(most))).otherwise(F.least(F.col("level") * F.col("measure"), F.lit(float(most))))
    expected = F.when(F.col("size") > 0, F.greatest(expected, F.lit(0.0))).otherwise(0.0)
    return per.select("source", "size", "source_size", "target", expected.alias("expected"))


def in_order(rest: DataFrame, gap: DataFrame, near: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``rest`` with its source's gap and ``in``: whether the documents of the least ranks that fit into the gap sum up to it.

    ``near`` marks a table of one row per source for broadcast if it is small.
    """
    gap = gap.withColumnRenamed("source", "of_source")
    rest = rest.join(near(gap), F.col("source").eqNullSafe(F.col("of_source"))).drop("of_source").withColumn("fits", F.col("size") <= F.col("gap"))
    in_bucket = Window.partitionBy("source", "bucket").orderBy("rank", "id_key", "text_key").rowsBetween(Window.unboundedPreceding, 0)
    own = F.when(F.col("fits"), F.col("size")).otherwise(0)
    ordered = rest.withColumn("before", F.sum(own).over(in_bucket))
    sums = rest.groupBy("source", "bucket").agg(F.sum(own).alias("words"))
    up_to = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.select(F.col("source").alias("of_source"), F.col("bucket").alias("of_bucket"), (F.sum("words").over(up_to) - F.col("words")).alias("start"))
    ordered = ordered.join(sums, F.col("source").eqNullSafe(F.col("of_source")) & (F.col("bucket") == F.col("of_bucket")))
    taken = F.col("fits") & (F.col("start") + F.col("before") <= F.col("gap"))
    return ordered.withColumn("in", taken).drop("of_source", "of_bucket", "start", "before", "fits")


def mix_sources(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_COPIES, seed: str = "mix") -> DataFrame:
    """Copies of each document that a mix with the sources' target words takes.

    ``docs`` has doc_id, text, source; the result has one row for each of
    its rows: doc_id, source, size, source_size, target, copies, taken, and
    the row's key columns (see :func:`plume.llm.common.with_keys`).

    A document's expected copies grow with the square root of its size (see
    :func:`expected_copies`). Its whole part are certain copies. What is left of
    it, l, is the inclusion probability of one more, drawn by Pareto order
    sampling: documents of a source are ranked by their random odds u / (1 -
    u) over their inclusion odds l / (1 - l), and those of lowest rank are
    taken; the sample's fixed size is the words that are missing, so it ends
    before the document that passes them. ``ROUNDS`` times in all the rest of the source is
    gone through like this for the words that are still missing, without
    documents that are too long for them, and then one document of the
    nearest size is added if it brings the source nearer to its target. u is a hash of doc_id and text, so that reruns agree.

    Ranks are summed by bucket first, then within buckets. The logarithm of
    a rank has a logistic density of at most 1/4 whatever the odds, so a
    bucket of fixed width holds about ``BUCKET_ROWS`` documents at most, and
    a source with a third of all rows is spread over many tasks. Tables of one row per source, source and
    size, or source and bucket are ordered as a whole.

    A null text has size 0 and is taken for 0 words. Equal rows are
    interchangeable. An empty table gives an empty result.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    u = unit_hash(F.lit(seed), F.col("doc_id"), F.md5(text))
    sized = with_keys(docs).select("doc_id", "source", "id_key", "text_key", F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), u.alias("u"))
    sized = stored(sized, "sized")
    width = 4 * BUCKET_ROWS / max(sized.count(), 4 * BUCKET_ROWS)
    targets = stored(source_targets(sized, weights, share, most), "targets")
    small = targets.count() <= BROADCAST_SOURCES
    near = lambda t: F.broadcast(t) if small else t
    expected = stored(expected_copies(sized, near(targets), most), "expected")

    of = expected.withColumnsRenamed({"source": "of_source", "size": "of_size"})
    ranked = sized.join(of, F.col("source").eqNullSafe(F.col("of_source")) & (F.col("size") == F.col("of_size"))).drop("of_source", "of_size")
    ranked = ranked.withColumn("whole", F.floor("expected").cast("long")).withColumn("part", F.col("expected") - F.col("whole"))
    odds = (F.col("u") / (1 - F.col("u"))) * ((1 - F.col("part")) / F.col("part"))
    ranked = ranked.withColumn("rank", F.when(F.col("part") > 0, odds)).withColumn("bucket", F.floor(F.log("rank") / width))
    ranked = stored(ranked, "ranked")
    discard(sized, targets, expected)
    gap = ranked.groupBy("source").agg((F.first("target") - F.sum(F.col("whole") * F.col("size"))).alias("gap"))
    rest, steps = ranked.filter("rank is not null"), [ranked]
    for _ in range(ROUNDS):
        rest = stored(in_order(rest, gap, near), "drawn")
        gap = rest.groupBy("source").agg((F.first("gap") - F.sum(F.when(F.col("in"), F.col("size")).otherwise(0))).alias("gap"))
        steps.append(rest)
        rest = rest.filter(~F.col("in")).drop("in", "gap")
    drawn = [t.filter("in").drop("in", "gap") for t in steps[1:]]

    gap = gap.withColumnRenamed("source", "of_source")
    open_ = rest.join(near(gap), F.col("source").eqNullSafe(F.col("of_source"))).filter((F.col("size") > 0) & (F.col("size") < 2 * F.col("gap")))
    best = F.min(F.struct(F.abs(F.col("gap") - F.col("size")).alias("off"), "rank", "id_key", "text_key"))
    best = open_.groupBy(F.col("source").alias("of_source")).agg(best.alias("best"))
    out = rest.join(near(best), F.col("source").eqNullSafe(F.col("of_source")), "left").drop("of_source")
    filled = F.coalesce((F.col("id_key") == F.col("best.id_key")) & (F.col("text_key") == F.col("best.text_key")), F.lit(False))
    # of equal rows one alone is filled up
    turn = Window.partitionBy("source", "id_key", "text_key").orderBy(F.monotonically_increasing_id())
    twins = out.filter(filled).withColumn("turn", F.row_number().over(turn)).withColumn("more", F.when(F.col("turn") == 1, 1).otherwise(0)).drop("turn")
    columns = ["doc_id", "source", "size", "source_size", "target", "whole", "id_key", "text_key"]
    out = out.filter(~filled).withColumn("more", F.lit(0)).unionByName(twins).select(*columns, "more")
    for part in drawn:
        out = out.union(part.select(*columns, F.lit(1)))
    out = out.union(ranked.filter("rank is null").select(*columns, F.lit(0)))
    copies = (F.col("whole") + F.col("more")).alias("copies")
    out = out.select("doc_id", "source", "size", "source_size", "target", copies, ((F.col("whole") + F.col("more")) * F.col("size")).alias("taken"), "id_key", "text_key")
    out = stored(out, "mix")
    discard(*steps)
    return out
