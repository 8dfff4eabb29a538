"""Career curves and densities on grids: knots, shape metrics, kernel densities, quantile bins."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paceline.functions.scalars import natural_spline, rounded


def knots(cells: DataFrame, n: int) -> list[float]:
    """0, then n - 1 quantiles of positive career ages from the 5th to the 95th percentile, strictly increasing."""
    shares = [0.05 + 0.9 * i / (n - 2) for i in range(n - 1)]
    got = cells.filter("a_n > 0").agg(F.percentile("a_n", F.array(*map(F.lit, shares)))).first()[0]
    out = [0.0]
    for x in got:
        out.append(max(float(x), math.nextafter(out[-1], math.inf)))
    return out


def gram(cells: DataFrame, at: list[float]) -> DataFrame:
    """i, j, value: sums of products of the spline basis over cells."""
    basis = natural_spline(F.col("a_n"), at)
    named = cells.select(*(b.alias(f"b{i}") for i, b in enumerate(basis)))
    sums = named.agg(*(F.sum(F.col(f"b{i}") * F.col(f"b{j}")).alias(f"{i}_{j}") for i in range(len(basis)) for j in range(i, len(basis))))
    pairs = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"{i}_{j}").alias("value")) for i in range(len(basis)) for j in range(i, len(basis))]
    return sums.select(F.inline(F.array(*pairs)))


def grid(spark: SparkSession, lo: float, hi: float, n: int) -> DataFrame:
    """k and x: n points from lo to hi."""
    return spark.range(n).select(F.col("id").alias("k"), (lo + F.col("id") * ((hi - lo) / (n - 1))).alias("x"))


def shape_metrics(points: DataFrame, value: Column) -> DataFrame:
    """Peak (lowest value) and its place, value at the ends, first up-crossing of zero after it, slope sign changes."""
    walk = Window.orderBy("k")
    curve = points.withColumn("f", value)
    low = curve.agg(F.min_by("x", "f").alias("peak_x"), F.min("f").alias("peak_f"))
    steps = curve.select("k", "x", "f", F.lag("f").over(walk).alias("f0"), F.lag("x").over(walk).alias("x0"), F.lag("f", 2).over(walk).alias("f00"))
    cross = F.col("x0") - F.col("f0") * (F.col("x") - F.col("x0")) / (F.col("f") - F.col("f0"))
    turned = F.signum(F.col("f") - F.col("f0")) * F.signum(F.col("f0") - F.col("f00")) < 0
    return steps.crossJoin(F.broadcast(low)).agg(  # one row; a grid has a fixed number of points
        rounded(F.first("peak_x")).alias("peak_x"), rounded(F.first("peak_f")).alias("peak_f"),
        rounded(F.min(F.when((F.col("x0") >= F.col("peak_x")) & (F.col("f0") < 0) & (F.col("f") >= 0), cross))).alias("break_even"),
        F.count_if(turned).alias("turns"), rounded(F.max_by("f", "k")).alias("last_f"),
    )


def kernel_density(values: DataFrame, column: str, points: DataFrame) -> DataFrame:
    """Gaussian density with Scott's bandwidth at grid points; each point is an aggregate over all values."""
    moments = values.agg(F.count(column).alias("n"), F.stddev_samp(column).alias("s")).first()
    h = moments["s"] * moments["n"] ** -0.2
    at = [(r["k"], r["x"]) for r in points.collect()]  # a grid has a fixed number of points
    terms = [F.sum(F.exp(-0.5 * ((F.col(column) - float(x)) / h) ** 2)).alias(f"p{k}") for k, x in at]
    sums = values.agg(*terms)
    norm = moments["n"] * h * math.sqrt(2 * math.pi)
    rows = [F.struct(F.lit(k).cast("long").alias("k"), (F.col(f"p{k}") / norm).alias("density")) for k, _ in at]
    return sums.select(F.inline(F.array(*rows)))


def quantile_bins(values: DataFrame, column: str, n: int) -> DataFrame:
    """``bin`` by unique quantile edges, the last closed on the right; nulls have none."""
    shares = F.array(*(F.lit(i / n) for i in range(n + 1)))
    edges = values.agg(F.array_distinct(F.percentile(column, shares)).alias("edges"))
    below = F.size(F.filter("edges", lambda e: e <= F.col(column)))
    return values.crossJoin(F.broadcast(edges)).withColumn("bin", F.when(F.col(column).isNotNull(), F.least(below, F.size("edges") - 1) - 1).cast("long")).drop("edges")  # one row
