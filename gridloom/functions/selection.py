"""Exact quantiles, plain and weighted, of groups of any size.

Values of a group are put in order by their weights' running sum; a quantile is the mean of the values over
a short stretch of that sum. Of a group that is too large for one task, the values are counted in the
intervals between approximate quantiles (both by partial aggregation); intervals that the stretch covers
whole count as sums, and only the one or two that hold an end of it are looked into, again by intervals if they
are still too large. What is left then fits one task.

With q a level, W the sum of the weights and n = W^2 / sum(w^2) their effective number, the stretch goes from
q * (n - 1) * W / n on for W / n. Equal weights give linear interpolation between order statistics, as
Spark's percentile does.
"""

from __future__ import annotations

from functools import reduce as fold

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import written

#: Distinct values of a group that one task takes; intervals that a larger one is cut into.
MOST, CUTS = 1 << 20, 64


def _split(rows: DataFrame) -> DataFrame:
    """rows (i, v, w) with the number of the interval that v lies in."""
    levels = [k / CUTS for k in range(1, CUTS)]
    cuts = written(rows.groupBy("i").agg(F.array_distinct(F.percentile_approx("v", levels, 100 * CUTS)).alias("cuts")), "cuts")
    return rows.join(cuts, "i").select("i", "v", "w", F.size(F.filter("cuts", lambda c: c < F.col("v"))).alias("bucket"))


def _covered(low: Column, high: Column) -> Column:
    """Weight of a value within the stretch; before: the running sum ahead of it."""
    return F.greatest(F.lit(0.0), F.least(high, F.col("before") + F.col("w")) - F.greatest(low, F.col("before")))


def _looked_into(rows: DataFrame, asks: DataFrame, most: int) -> DataFrame:
    """(g, k, s) of rows (i, v, w) in intervals i and asks (i, g, k, low, high): sums of values times their
    weight within the stretch from low to high of the interval's running sum."""
    sizes = rows.groupBy("i").agg(F.count("*").alias("n"))
    large = written(sizes.filter(F.col("n") > most).select("i"), "large")
    if large.isEmpty():
        return _in_one_task(rows, asks)
    small = _in_one_task(rows.join(large, "i", "left_anti"), asks.join(large, "i", "left_anti"))
    split = written(_split(rows.join(large, "i", "left_semi")), "split")
    sums = split.groupBy("i", "bucket").agg(F.sum("w").alias("w"), F.sum(F.col("v") * F.col("w")).alias("vw"))
    running = Window.partitionBy("i").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # CUTS rows
    placed = sums.withColumn("before", F.coalesce(F.sum("w").over(running), F.lit(0.0)))
    met = written(asks.join(placed, "i").filter((F.col("before") <= F.col("high")) & (F.col("before") + F.col("w") >= F.col("low"))), "met")
    whole = (F.col("before") >= F.col("low")) & (F.col("before") + F.col("w") <= F.col("high"))
    inner = F.struct("i", "bucket")
    deeper = _looked_into(
        split.join(met.filter(~whole).select("i", "bucket").distinct(), ["i", "bucket"], "left_semi").select(inner.alias("i"), "v", "w"),
        met.filter(~whole).select(inner.alias("i"), "g", "k", (F.col("low") - F.col("before")).alias("low"), (F.col("high") - F.col("before")).alias("high")),
        most,
    )
    return fold(DataFrame.unionByName, [small, met.filter(whole).select("g", "k", F.col("vw").alias("s")), deeper])


def _in_one_task(rows: DataFrame, asks: DataFrame) -> DataFrame:
    running = Window.partitionBy("i").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("before", F.coalesce(F.sum("w").over(running), F.lit(0.0)))
    part = placed.join(asks, "i").withColumn("part", _covered(F.col("low"), F.col("high"))).filter("part > 0")
    return part.groupBy("g", "k").agg(F.sum(F.col("v") * F.col("part")).alias("s"))


def exact_quantiles(df: DataFrame, keys, value: Column, levels, name: str, weight: Column | None = None, most: int | None = None) -> DataFrame:
    """(keys..., name array<double>) with a quantile for each level in 0..1, null where a group has no
    valid value of positive weight. Values equal in a group are one row before anything else."""
    most = MOST if most is None else most
    w = F.lit(1.0) if weight is None else weight.cast("double")
    group = F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0).alias("all"))
    cells = df.select(group.alias("g"), value.cast("double").alias("v"), w.alias("w")).filter("v is not null and not isnan(v) and w > 0")
    rows = written(cells.groupBy("g", "v").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("w")).alias("w2")), "ordered")
    totals = rows.groupBy("g").agg(F.sum("w").alias("all"), (F.sum("w") / F.sum("w2") * F.sum("w")).alias("n"))
    one = F.posexplode(F.array(*[F.lit(float(q)) for q in levels])).alias("k", "q")
    low = F.col("q") * (F.col("n") - 1) * F.col("all") / F.col("n")
    asks = written(totals.select("g", "all", "n", one).select(F.struct("g").alias("i"), "g", "k", low.alias("low"), (low + F.col("all") / F.col("n")).alias("high")), "asks")
    found = _looked_into(rows.select(F.struct("g").alias("i"), "v", "w"), asks, most)
    stretch = asks.select(F.col("g").alias("ag"), F.col("k").alias("ak"), (F.col("high") - F.col("low")).alias("size"))
    each = found.groupBy("g", "k").agg(F.sum("s").alias("s"))
    each = each.join(stretch, F.col("g").eqNullSafe(F.col("ag")) & (F.col("k") == F.col("ak"))).select("g", "k", (F.col("s") / F.col("size")).alias("s"))
    arrays = each.groupBy("g").agg(F.array(*[F.max(F.when(F.col("k") == j, F.col("s"))) for j in range(len(levels))]).alias(name)).withColumnRenamed("g", "ag")
    empty = F.array(*[F.lit(None).cast("double")] * len(levels))
    if not keys:
        return df.sparkSession.range(1).join(arrays, F.lit(True), "left").select(F.coalesce(name, empty).alias(name))  # one row
    every = df.select(*keys).distinct().withColumn("g", F.struct(*keys))
    return every.join(arrays, F.col("g").eqNullSafe(F.col("ag")), "left").select(*keys, F.coalesce(name, empty).alias(name))
