"""Intervals of any length that overlap: joined by the dyadic ranges that cover them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.sources.shared import materialise

#: Levels of ranges; level k's are 2**k long and begin at its multiples.
LEVELS = 62


def dyadic_cover(start: Column, end: Column) -> Column:
    """The fewest dyadic ranges (level, at) whose union is [start, end), of longs within 2**61 of 0; none if it is empty or null.

    Of each level at most two are needed, the first and the last of the whole ranges within, where those are no pair's
    second and first half.
    """

    def at_level(k: Column) -> Column:
        first, last = -F.call_function("shiftright", -start, k), F.call_function("shiftright", end, k)
        node = lambda at: F.struct(k.alias("level"), at.alias("at"))
        left = F.when((first < last) & (first % 2 != 0), F.array(node(first)))
        right = F.when((first < last) & (last % 2 != 0), F.array(node(last - 1)))
        none = F.array().cast("array<struct<level:int,at:bigint>>")
        return F.concat(F.coalesce(left, none), F.coalesce(right, none))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), at_level))


def stabbed(intervals: DataFrame, points: DataFrame, point: str) -> DataFrame:
    """Pairs of an interval [start, end) and a point within it, each once: a point lies in one range of an interval's cover.

    Columns of both sides differ. A point is sent once for each level that some interval uses, so those are looked up first
    (LEVELS numbers at most reach the driver).
    """
    nodes = intervals.withColumn("node", F.explode(dyadic_cover(F.col("start").cast("long"), F.col("end").cast("long"))))
    nodes = nodes.withColumns({"level": F.col("node.level"), "at": F.col("node.at")}).drop("node")
    levels = sorted(r[0] for r in nodes.select("level").distinct().collect())
    if not levels:
        return intervals.join(points, F.lit(False))
    sent = points.where(F.col(point).isNotNull()).withColumn("level", F.explode(F.array(*[F.lit(k) for k in levels])))
    return nodes.join(sent.withColumn("at", F.call_function("shiftright", F.col(point).cast("long"), F.col("level"))), ["level", "at"]).drop("level", "at")


def overlapping(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of a left interval [start, end) and a right one [r_start, r_end) that share a point, each once; other columns differ.

    Either the right one begins within the left one, or the left one begins within the right one and later than it. Empty,
    backward and null intervals share nothing; repeated rows pair as often as they occur.
    """
    real_left, real_right = left.where("start < end"), right.where("r_start < r_end")
    inside = stabbed(real_left, real_right, "r_start")
    swapped = stabbed(real_right.withColumnsRenamed({"r_start": "start", "r_end": "end"}), real_left.withColumnsRenamed({"start": "l_start", "end": "l_end"}), "l_start")
    after = swapped.where(F.col("l_start") > F.col("start")).withColumnsRenamed({"start": "r_start", "end": "r_end", "l_start": "start", "l_end": "end"})
    return inside.unionByName(after)


def overlap_totals(left: DataFrame, right: DataFrame) -> DataFrame:
    """The right rows [r_start, r_end) with n, how many left intervals [start, end) share a point with each, and shared, the sum of
    what they share; rows that none meets are left out.

    No pair is made. An interval meets those that start before its end, but for those that end by its start; what they share is
    what all cover before its end, less what they cover before its start. Both are running totals over the ends of all intervals:
    ends are dealt out by their order, summed part by part, and each part adds the totals of those before it (one row a part).
    Starts and ends are longs; sums are exact. Empty, backward and null intervals share nothing; right rows may repeat.
    """
    whole, zero = (lambda c: F.col(c).cast("decimal(38,0)")), F.lit(0).cast("long")
    real_left, real_right = left.where("start < end"), right.where("r_start < r_end")
    begun = real_left.select(F.col("start").cast("long").alias("at"), F.lit(1).cast("long").alias("begun"), zero.alias("ended"))
    ended = real_left.select(F.col("end").cast("long").alias("at"), zero.alias("begun"), F.lit(1).cast("long").alias("ended"))
    asked = real_right.select(F.explode(F.array(F.col("r_start").cast("long"), F.col("r_end").cast("long"))).alias("at"), zero.alias("begun"), zero.alias("ended"))
    marks = begun.unionByName(ended).unionByName(asked).groupBy("at").agg(F.sum("begun").alias("begun"), F.sum("ended").alias("ended"))
    dealt = materialise(marks.repartitionByRange("at").withColumn("part", F.spark_partition_id()), "marks")
    weight = (F.col("begun") - F.col("ended")).cast("decimal(38,0)") * whole("at")
    dealt = dealt.withColumn("weight", weight.cast("decimal(38,0)"))
    sums = ("begun", "ended", "weight")
    parts = dealt.groupBy("part").agg(*[F.sum(c).alias(f"{c}_part") for c in sums])
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select("part", *[F.coalesce(F.sum(f"{c}_part").over(earlier), F.lit(0)).alias(f"{c}_part") for c in sums])
    within = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = dealt.join(before, "part").select("at", *[(F.sum(c).over(within) + F.col(f"{c}_part")).alias(c) for c in sums])
    # Starts and ends at a place itself cover nothing before it; of the starts those before it count, of the ends those up to it.
    covered = whole("at") * (F.col("begun") - F.col("ended")).cast("decimal(20,0)") - F.col("weight")
    totals = materialise(run.join(dealt.select("at", F.col("begun").alias("here")), "at").select("at", (F.col("begun") - F.col("here")).alias("started"), "ended", covered.cast("decimal(38,0)").alias("covered")), "totals")
    of = lambda c: totals.select(F.col("at").alias(c), *[F.col(k).alias(f"{c}_{k}") for k in ("started", "ended", "covered")])
    keyed = real_right.withColumns({"at_start": F.col("r_start").cast("long"), "at_end": F.col("r_end").cast("long")})
    met = keyed.join(of("at_start"), "at_start").join(of("at_end"), "at_end")
    met = met.withColumns({"n": F.col("at_end_started") - F.col("at_start_ended"), "shared": F.col("at_end_covered") - F.col("at_start_covered")})
    return met.where("n > 0").select(*right.columns, "n", "shared")
