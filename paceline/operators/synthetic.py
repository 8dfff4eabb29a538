"""Synthetic tables of known truth, and how well a fit recovers them."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paceline.functions.scalars import hash_uniform, rounded
from paceline.operators import engine
from paceline.operators.slices import cut


@dataclass
class Truth:
    """cells (athlete_id, race_id, y, a_n, a_e, date), the true u, v and d, and the true scales."""

    cells: DataFrame
    athletes: DataFrame
    races: DataFrame
    sigma2: float
    omega2: float


def _normal(seed: int, *keys) -> F.Column:  # noqa: ANN002
    """A standard normal from two hashed uniforms."""
    return F.sqrt(-2 * F.log(hash_uniform(seed, *keys))) * F.cos(2 * math.pi * hash_uniform(seed + 1, *keys))


def generate(
    spark: SparkSession, athletes: int, races: int, fill: float, seed: int, nu: float = math.inf, staggered: bool = False, drift: float = 0.0, slope: float = 0.0,
    sigma2: float = 9e-4, sd_u: float = 0.2, sd_v: float = 0.02,
) -> Truth:
    """A design of hashed draws: every athlete runs a share ``fill`` of the races, or of a window of a third of them if staggered.

    Noise is normal, or normal over the root of a Gamma(nu / 2) draw with integer nu, made of exponentials; dates are spread evenly
    over ten years by day arithmetic.
    """
    a, r = F.col("athlete_id"), F.col("race_id")
    people = spark.range(athletes).select(F.col("id").alias("athlete_id")).withColumns(
        {"u": 9.6 + sd_u * _normal(seed, a), "d": drift * _normal(seed + 10, a), "a_e": 18 + 37 * hash_uniform(seed + 20, a), "start": F.floor(hash_uniform(seed + 30, a) * races * 2 / 3)}
    )
    editions = spark.range(races).select(F.col("id").alias("race_id")).withColumns(
        {"v0": sd_v * _normal(seed + 40, r), "date": F.date_add(F.lit("2015-01-01").cast("date"), F.floor(r * (3652 / max(1, races - 1))).cast("int"))}
    )
    mean = editions.agg(F.avg("v0").alias("m"))
    editions = cut(editions.crossJoin(F.broadcast(mean)).withColumn("v", F.col("v0") - F.col("m")).drop("v0", "m"))  # one row
    open_ = (r >= F.col("start")) & (r < F.col("start") + races / 3) if staggered else F.lit(True)
    drawn = people.withColumn("race_id", F.explode(F.sequence(F.lit(0), F.lit(races - 1)).cast("array<bigint>"))).filter(open_ & (hash_uniform(seed + 50, a, r) < fill))
    e = _normal(seed + 60, a, r)
    if not math.isinf(nu):
        # a chi-square of nu degrees over nu: half of them exponentials
        chi = sum((-2 * F.log(hash_uniform(seed + 70 + k, a, r)) for k in range(int(nu) // 2)), F.lit(0.0))
        e = e / F.sqrt(chi / (2 * (int(nu) // 2)))
    joined = drawn.join(editions, "race_id")
    a_n = F.datediff("date", F.min("date").over(Window.partitionBy("athlete_id"))) / 365.25
    cells = joined.withColumn("a_n", a_n).withColumn("til", F.col("a_n") - F.avg("a_n").over(Window.partitionBy("athlete_id")))
    y = F.col("u") + F.col("v") + slope * F.col("a_n") + F.col("d") * F.col("til") + math.sqrt(sigma2) * e
    cells = cut(cells.select("athlete_id", "race_id", y.alias("y"), "a_n", "a_e", "date"))
    return Truth(cells, cut(people.select("athlete_id", "u", "d")), editions.select("race_id", "v"), sigma2, drift**2)


def recovery(truth: Truth, fit: engine.Fits) -> DataFrame:
    """One row: correlations of fitted with true u and v, RMSE of centred v, ratio of the scales."""
    v = fit.races.select("race_id", F.col("v").alias("fv")).join(truth.races, "race_id")
    u = fit.athletes.select("athlete_id", F.col("u").alias("fu")).join(truth.athletes, "athlete_id")
    gap = F.col("fv") - F.col("v")
    races = v.agg(F.corr("fv", "v").alias("r_v"), F.stddev_pop(gap).alias("rmse_v"))
    return races.crossJoin(u.agg(F.corr("fu", "u").alias("r_u"))).crossJoin(fit.scales.select("sigma2")).select(  # one row each
        rounded(F.col("r_u"), 5).alias("r_u"), rounded(F.col("r_v"), 5).alias("r_v"), rounded(F.col("rmse_v")).alias("rmse_v"), rounded(F.col("sigma2") / truth.sigma2, 5).alias("sigma2_ratio")
    )
