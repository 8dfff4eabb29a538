"""Resampling and validation: folds, held-out scores, weighted replicates, leave-one-out and permutation statistics."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paceline.functions.scalars import hash_uniform, hash_uniform_arrays, log_density, rounded
from paceline.operators import engine
from paceline.operators.model import refits
from paceline.operators.runs import BITS, mask
from paceline.operators.slices import cut


def folds(cells: DataFrame, k: int, seed: int) -> DataFrame:
    """Stratified within athletes: a hashed order, dealt round robin from a hashed start."""
    order = Window.partitionBy("athlete_id").orderBy(hash_uniform(seed, F.col("athlete_id"), F.col("race_id")), "race_id")
    start = F.floor(hash_uniform(seed + 1, F.col("athlete_id")) * k)
    return cells.withColumn("fold", ((F.row_number().over(order) - 1 + start) % k).cast("long"))


def with_folds(marked: DataFrame, k: int, whole: bool = False) -> DataFrame:
    """``marked`` with the cells' weights in the run of each fold left out, and with ``whole`` in one of all cells after them: bits of a long, an eighth
    byte a run instead of eight, or an array ``g`` where there are more runs than bits."""
    here = [F.col("fold") != f for f in range(k)] + [F.lit(True)] * whole
    if len(here) > BITS:
        return marked.withColumn("g", F.array(*(c.cast("double") for c in here)))
    return marked.withColumn("bits", mask(list(enumerate(here))))


def fold_fits(marked: DataFrame, k: int, config: engine.EngineConfig, score: bool = False) -> engine.Fits:
    """For each fold a fit of the cells of the others (run_id is the fold left out), in the same jobs, as many as the driver holds at a time; with
    several candidate ``nu`` in the configuration, run_id is candidate * k + fold.  ``score`` asks for held-out scores."""
    candidates = config.nu if isinstance(config.nu, tuple) else (config.nu,)
    ready = with_folds(marked, k)
    races = marked.select("race_id").distinct().count()

    def some(runs: list[int]) -> engine.Fits:
        return engine.fit_runs(ready, runs, replace(config, nu=tuple(candidates[r // k] for r in runs)), slots=[r % k for r in runs], score=score)

    return engine.joined(list(engine.chunked(some, list(range(k * len(candidates))), races, config)))


def held_out_residuals(marked: DataFrame, fits: engine.Fits, k: int, candidates: int = 1) -> DataFrame:
    """run_id, fold, s2 and r (null for orphans) of every cell under the fits that did not see it."""
    runs = F.explode(F.array(*((F.col("fold") + c * k).cast("long") for c in range(candidates))))
    each = marked.select("athlete_id", "race_id", "y", "fold", runs.alias("run_id"))
    scored = each.join(fits.athletes.select("run_id", "athlete_id", "u"), ["run_id", "athlete_id"], "left").join(fits.races, ["run_id", "race_id"], "left")
    scales = fits.scales.select("run_id", F.col("sigma2").alias("s2"))
    return scored.join(F.broadcast(scales), "run_id").select("run_id", "fold", "s2", (F.col("y") - F.col("u") - F.col("v")).alias("r"))  # one row a run


def held_out(marked: DataFrame, fits: engine.Fits, nu: float, k: int = 5) -> DataFrame:
    """Log density and squared error of each fold; cells without a fitted athlete or race are counted apart."""
    return held_out_residuals(marked, fits, k).groupBy("fold").agg(
        F.count("r").alias("n_scored"), F.count_if(F.col("r").isNull()).alias("n_orphans"),
        rounded(F.sum(log_density(F.col("r"), F.col("s2"), nu)), 4).alias("logdensity"), rounded(F.sqrt(F.avg(F.col("r") ** 2))).alias("rmse"),
    )


def bootstrap_weights(athletes: DataFrame, runs: int, seed: int) -> DataFrame:
    """run_id, athlete_id, g: unit exponentials, normalised to mean one within each run."""
    raw = athletes.select("athlete_id", F.explode(F.sequence(F.lit(1), F.lit(runs)).cast("array<bigint>")).alias("run_id"))
    raw = raw.withColumn("e", -F.log(hash_uniform(seed, F.col("athlete_id"), F.col("run_id"))))
    means = raw.groupBy("run_id").agg(F.avg("e").alias("mean_e"))
    return raw.join(F.broadcast(means), "run_id").select("run_id", "athlete_id", (F.col("e") / F.col("mean_e")).alias("g"))  # one row a run


def with_weights(cells: DataFrame, runs: int, seed: int) -> DataFrame:
    """``cells`` with g: the array of their athlete's weight in each run."""
    per = bootstrap_weights(cells.select("athlete_id").distinct(), runs, seed).groupBy("athlete_id")
    weights = per.agg(F.array_sort(F.collect_list(F.struct("run_id", "g"))).alias("g"))  # one value a run
    return cells.join(weights.select("athlete_id", F.transform("g", lambda x: x["g"]).alias("g")), "athlete_id")


def weight_arrays(athletes: DataFrame, runs: list[int], seed: int) -> DataFrame:
    """athlete_id, g: the weights of the runs, as bootstrap_weights has them; one for run 0."""
    drawn = bootstrap_weights(athletes, max(runs), seed) if max(runs) else None
    every = athletes.select("athlete_id", F.lit(0).cast("long").alias("run_id"), F.lit(1.0).alias("g"))
    if drawn is not None:
        every = every.unionByName(drawn.select("athlete_id", "run_id", "g"))
    wanted = every.filter(F.col("run_id").isin(runs)).groupBy("athlete_id").agg(F.array_sort(F.collect_list(F.struct("run_id", "g"))).alias("g"))  # a value a run
    return wanted.select("athlete_id", F.transform("g", lambda x: x["g"]).alias("g"))


def replicate_fits(cells: DataFrame, runs: list[int], seed: int, config: engine.EngineConfig, start: DataFrame, sigma2: float) -> engine.Fits:
    """Fits under the weights of each run, warm from ``start``, as many at a time as the driver holds."""
    weights = cut(weight_arrays(cells.select("athlete_id").distinct(), runs, seed))

    def some(ids: list[int]) -> engine.Fits:
        own = weights if len(ids) == len(runs) else weights.select("athlete_id", F.array(*(F.get("g", F.lit(runs.index(r))) for r in ids)).alias("g"))
        return engine.fit_runs(cells, ids, config, start=start, weights=own, sigma2=sigma2)

    return engine.joined(list(engine.chunked(some, runs, start.count(), config)))


def bootstrap_races(cells: DataFrame, u: DataFrame, weights: DataFrame) -> DataFrame:
    """run_id, race_id, v: one weighted race update for all runs at once, centred within each run.

    Abilities stay at ``u``: a one-step update, without what ability varies between replicates; see ``bootstrap_refits``.
    """
    rest = cells.join(u, "athlete_id").select("athlete_id", "race_id", (F.col("y") - F.col("u")).alias("r"))
    raw = rest.join(weights, "athlete_id").groupBy("run_id", "race_id").agg((F.sum(F.col("g") * F.col("r")) / F.sum("g")).alias("v"))
    means = raw.groupBy("run_id").agg(F.avg("v").alias("m"))
    return raw.join(F.broadcast(means), "run_id").select("run_id", "race_id", (F.col("v") - F.col("m")).alias("v"))  # one row a run


def bootstrap_refits(cells: DataFrame, weights: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """run_id, race_id, v: abilities and races fitted anew to convergence under the weights of each run, centred within it."""
    return refits(cells.select("athlete_id", "race_id", "y").join(weights, "athlete_id"), start)


def replicate_summary(replicates: DataFrame) -> DataFrame:
    """Per race: median, standard deviation and 68, 90, 95 percent intervals over runs."""
    cuts = [("lo95", 0.025), ("lo90", 0.05), ("lo68", 0.16), ("hi68", 0.84), ("hi90", 0.95), ("hi95", 0.975)]
    return replicates.groupBy("race_id").agg(
        F.count("*").alias("n_boot"), rounded(F.median("v")).alias("median_v"), rounded(F.stddev_samp("v")).alias("sd_v"), *(rounded(F.percentile("v", q)).alias(n) for n, q in cuts)
    )


def regauge(replicates: DataFrame, dates: DataFrame) -> DataFrame:
    """Remove, run by run, the mean and the slope on the race date."""
    joined = replicates.join(dates, "race_id").withColumn("x", F.datediff("date", F.lit("2000-01-01").cast("date")) / 365.25)
    line = joined.groupBy("run_id").agg(F.regr_slope("v", "x").alias("slope"), F.regr_intercept("v", "x").alias("cut"))
    return joined.join(F.broadcast(line), "run_id").select(  # one row a run
        "run_id", "race_id", F.coalesce("slope", F.lit(0.0)).alias("slope"), (F.col("v") - F.coalesce("cut", F.lit(0.0)) - F.coalesce("slope", F.lit(0.0)) * F.col("x")).alias("v")
    )


def centred_age(cells: DataFrame) -> DataFrame:
    """a_til: career age less the athlete's mean."""
    return cells.withColumn("a_til", F.col("a_n") - F.avg("a_n").over(Window.partitionBy("athlete_id")))


def loo_delta(residuals: DataFrame) -> DataFrame:
    """Per race the mean of slope times centred age, each athlete's slope found without the cell itself.

    ``residuals`` has athlete_id, race_id, a_til and r; the slope less one cell is a difference of sums.
    """
    per = Window.partitionBy("athlete_id")
    xy, xx = F.col("a_til") * F.col("r"), F.col("a_til") * F.col("a_til")
    left = residuals.withColumn("sxy", F.sum(xy).over(per) - xy).withColumn("sxx", F.sum(xx).over(per) - xx)
    slope = F.when(F.col("sxx") > 1e-9, F.col("sxy") / F.col("sxx"))
    return left.groupBy("race_id").agg(rounded(F.avg(slope * F.col("a_til"))).alias("delta"), F.count(slope).alias("n_eligible"))


def permuted(residuals: DataFrame, draws: int, seed: int) -> DataFrame:
    """Residuals dealt anew within athletes, once for each draw k: positions in order meet positions in hashed order."""
    many = residuals.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(draws)).cast("array<bigint>")))
    inner = Window.partitionBy("k", "athlete_id")
    mixed = hash_uniform(seed, F.col("athlete_id"), F.col("k"), F.col("race_id"))
    placed = many.withColumn("pos", F.row_number().over(inner.orderBy("race_id"))).withColumn("to", F.row_number().over(inner.orderBy(mixed, "race_id")))
    moved = placed.select("k", "athlete_id", F.col("to").alias("pos"), F.col("r").alias("r_new"))
    return placed.drop("to").join(moved, ["k", "athlete_id", "pos"]).select("k", "athlete_id", "race_id", "a_til", F.col("r_new").alias("r"))


#: Cells that a task of the permutation null holds, and bytes of sums by race that wait in a shuffle at a time.
DEALT, WAITING = 1_000_000, 300_000_000
_PACKED = "athlete_id binary, race binary, x binary, r binary"


def _packed(ids: np.ndarray):  # noqa: ANN202
    """A task's cells in the order of (athlete, race), side by side in one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if b.num_rows]
        if batches:
            t = pa.Table.from_batches(batches)
            of = t["athlete_id"].to_numpy(), np.searchsorted(ids, t["race_id"].to_numpy()).astype(np.int32), t["a_til"].to_numpy(), t["r"].to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array([z.tobytes()], pa.binary()) for z in of], names=["athlete_id", "race", "x", "r"])

    return run


def _slope_sums(ids: np.ndarray, draws: list[int] | None, seed: int):  # noqa: ANN202
    """Sums by race of leave-one-out slopes times centred age, a row for each draw and block of races (0 is as observed); without draws how many cells have a slope."""
    n_blocks = -(-len(ids) // engine.BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in zip(*(b.column(c) for c in range(4)), strict=True):
                athlete, race, x, r = (np.frombuffer(z.as_buffer(), dtype=t) for z, t in zip(row, (np.int64, np.int32, float, float), strict=True))
                first = np.flatnonzero(np.r_[True, athlete[1:] != athlete[:-1]])
                who = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(athlete)]))
                sxx = np.add.reduceat(x * x, first)[who] - x * x
                good = sxx > 1e-9
                for k in [-1] if draws is None else draws:
                    if k < 0:
                        by = np.bincount(race, good, len(ids))
                    else:
                        dealt = r[np.lexsort((hash_uniform_arrays(seed, athlete, np.array(k), ids[race]), who))] if k else r
                        sxy = np.add.reduceat(x * dealt, first)[who] - x * dealt
                        by = np.bincount(race[good], (sxy[good] / sxx[good]) * x[good], len(ids))
                    keys = max(k, 0) * n_blocks + np.arange(n_blocks)
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([by[i * engine.BLOCK : (i + 1) * engine.BLOCK].tobytes() for i in range(n_blocks)], pa.binary())], names=["key", "s"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for key, s in zip(b["key"].to_pylist(), b["s"], strict=True):
            s = np.frombuffer(s.as_buffer())
            sums[key] = sums[key] + s if key in sums else s
    return sums


def _moments(shared, n_blocks: int):  # noqa: ANN001, ANN202  a broadcast (cells with a slope, v, year) by race, not a number where a race is not compared
    """k, n and sums of delta, its square and its products with v and year, by block of races."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, v, year = shared.value
        for key, s in _added(batches).items():
            of = slice(key % n_blocks * engine.BLOCK, (key % n_blocks + 1) * engine.BLOCK)
            delta, here = s / np.maximum(count[of], 1), np.isfinite(v[of]) & np.isfinite(year[of])
            delta, z, t = delta[here], v[of][here], year[of][here]
            values = [int(key // n_blocks), len(delta), float(delta.sum()), float(delta @ delta), float(delta @ z), float(delta @ t)]
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in values], names=["k", "n", "s", "ss", "sv", "st"])

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = _added(batches)
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["key", "s"])


def year_free_correlations(residuals: DataFrame, races: DataFrame, draws: int, seed: int) -> list[tuple[int, float | None]]:
    """(k, t): the correlation of leave-one-out drift prices with difficulty, both freed of a straight line in year, as observed (0) and for each draw
    of residuals dealt anew within athletes (``permuted``).

    Cells are dealt by athlete once and kept; a task deals its athletes' residuals anew itself and returns sums by race, for as many draws at a time as
    ``WAITING`` allows.  Which cells have a slope is the same in every draw.
    """
    spark = residuals.sparkSession
    ids = np.sort(residuals.select("race_id").distinct().toArrow()["race_id"].to_numpy())  # the fit's driver holds these too
    rows = races.select("race_id", F.col("v").cast("double").alias("v"), F.col("year").cast("double").alias("year")).dropna().toArrow()
    at = np.minimum(np.searchsorted(ids, rows["race_id"].to_numpy()), len(ids) - 1)
    mine = ids[at] == rows["race_id"].to_numpy()
    v, year = np.full(len(ids), np.nan), np.full(len(ids), np.nan)
    v[at[mine]], year[at[mine]] = rows["v"].to_numpy()[mine], rows["year"].to_numpy()[mine]
    v, year = v - np.nanmean(v), year - np.nanmean(year)
    parts = max(spark.sparkContext.defaultParallelism, -(-residuals.count() // DEALT))
    dealt = residuals.select("athlete_id", "race_id", "a_til", "r").repartition(parts, "athlete_id").sortWithinPartitions("athlete_id", "race_id")
    dealt = dealt.mapInArrow(_packed(ids), _PACKED).persist()
    n_blocks = -(-len(ids) // engine.BLOCK)
    count = np.zeros(len(ids))
    got = cut(dealt.mapInArrow(_slope_sums(ids, None, seed), "key long, s binary").repartition(min(parts, n_blocks), "key").mapInArrow(_summed, "key long, s binary")).toArrow()
    for key, s in zip(got["key"].to_pylist(), got["s"], strict=True):
        count[key * engine.BLOCK : (key + 1) * engine.BLOCK] = np.frombuffer(s.as_buffer())
    shared = spark.sparkContext.broadcast((count, v, year))
    size = max(1, WAITING // (8 * len(ids) * parts))
    sums: dict[int, np.ndarray] = {}
    for some in (list(range(a, min(a + size, draws + 1))) for a in range(0, draws + 1, size)):
        by_block = dealt.mapInArrow(_slope_sums(ids, some, seed), "key long, s binary").repartition(min(parts, n_blocks * len(some)), "key")
        for row in cut(by_block.mapInArrow(_moments(shared, n_blocks), "k long, n long, s double, ss double, sv double, st double")).collect():  # a row a draw and block
            sums[row["k"]] = sums.get(row["k"], 0.0) + np.array(row[1:], dtype=float)
    dealt.unpersist()
    shared.destroy()
    z, t = v[np.isfinite(v)], year[np.isfinite(v)]
    vv, vt, tt = z @ z, z @ t, t @ t
    out = []
    for k, (n, s, ss, sv, st) in sorted(sums.items()):
        xz, xx, zz = sv - st * vt / tt if tt else math.nan, ss - s * s / n - st * st / tt if tt else math.nan, vv - vt * vt / tt if tt else math.nan
        out.append((k, float(xz / math.sqrt(xx * zz)) if xx > 0 and zz > 0 else None))
    return out


def permutation_null(residuals: DataFrame, races: DataFrame, draws: int, seed: int) -> DataFrame:
    """One row: the observed correlation of leave-one-out drift prices with difficulty, freed of year, and mean, sd, z, one- and
    two-sided p (with the +1 correction) over permutations within athletes.  ``races`` has race_id, v and year."""
    t = residuals.sparkSession.createDataFrame(year_free_correlations(residuals, races, draws, seed), "k long, t double")  # a row a draw
    seen = t.filter("k = 0").select(F.col("t").alias("o"))
    both = t.filter("k > 0").crossJoin(F.broadcast(seen))  # one row
    n = F.count("*")
    return both.agg(
        n.alias("n_draws"), rounded(F.first("o"), 5).alias("t_obs"), rounded(F.avg("t"), 5).alias("null_mean"), rounded(F.stddev_samp("t"), 5).alias("null_sd"),
        rounded((F.first("o") - F.avg("t")) / F.stddev_samp("t"), 3).alias("z"), rounded((1 + F.count_if(F.col("t") >= F.col("o"))) / (n + 1)).alias("p_one"),
        rounded((1 + F.count_if(F.abs("t") >= F.abs("o"))) / (n + 1)).alias("p_two"),
    )


def partial_correlation(values: DataFrame) -> DataFrame:
    """Correlation of x and y before and after a straight line in year is taken from both."""
    line = values.agg(
        *(f("x", "year").alias(f"{n}x") for n, f in (("s", F.regr_slope), ("c", F.regr_intercept))),
        *(f("y", "year").alias(f"{n}y") for n, f in (("s", F.regr_slope), ("c", F.regr_intercept))),
    )
    joined = values.crossJoin(F.broadcast(line))  # one row
    rx, ry = (F.col(c) - F.col(f"c{c}") - F.col(f"s{c}") * F.col("year") for c in "xy")
    return joined.agg(F.count("*").alias("n"), rounded(F.corr("x", "y")).alias("r_raw"), rounded(F.corr(rx, ry)).alias("r_partial"))


def drift_slopes(residuals: DataFrame, omega2: float, sigma2: float) -> DataFrame:
    """Ridge slopes of residuals on centred age with their posterior variance."""
    precision = F.sum(F.col("a_til") * F.col("a_til")) / sigma2 + 1 / omega2
    return residuals.groupBy("athlete_id").agg(
        F.count("*").alias("n"), (F.sum(F.col("a_til") * F.col("r")) / sigma2 / precision).alias("d"), (1 / precision).alias("pv")
    )


def drift_descriptors(slopes: DataFrame) -> DataFrame:
    """Spread of slopes: raw and disattenuated sd, skewness, share below zero."""
    return slopes.agg(
        F.count("*").alias("n"), rounded(F.stddev_samp("d"), 8).alias("raw_sd"),
        rounded(F.sqrt(F.greatest(F.var_samp("d") - F.avg("pv"), F.lit(0.0))), 8).alias("disatt_sd"),
        rounded(F.skewness("d"), 4).alias("skew"), rounded(F.avg((F.col("d") < 0).cast("double"))).alias("frac_improver"),
    )


def omega_profile(residuals: DataFrame, omegas: list[float], sigma2: float) -> DataFrame:
    """omega2 and the Laplace marginal log likelihood of slopes with that prior variance, up to a constant."""
    sums = residuals.groupBy("athlete_id").agg(F.sum(F.col("a_til") * F.col("r")).alias("sxy"), F.sum(F.col("a_til") ** 2).alias("sxx"))
    each = sums.withColumn("omega2", F.explode(F.array(*map(F.lit, omegas))))
    information = F.col("sxx") / sigma2
    term = -0.5 * F.log1p(F.col("omega2") * information) + 0.5 * (F.col("sxy") / sigma2) ** 2 / (information + 1 / F.col("omega2"))
    return each.groupBy("omega2").agg(rounded(F.sum(term), 4).alias("loglik"))


def drift_with_ability(slopes: DataFrame, by: str, many: int) -> DataFrame:
    """By group: count, spread of drifts freed of their uncertainty, rank correlation with ability for all and for athletes of at
    least ``many`` races (null for fewer than three), and a verdict in words."""
    rank = lambda c, *keys: F.rank().over(Window.partitionBy(by, *keys).orderBy(c))
    high = F.col("n") >= many
    ranked = slopes.withColumn("_high", high).withColumns({"rd": rank("d"), "ru": rank("u"), "hd": F.when(high, rank("d", "_high")), "hu": F.when(high, rank("u", "_high"))})
    share = F.avg((F.col("d") < 0).cast("double"))
    return ranked.groupBy(by).agg(
        F.count("*").alias("n"), rounded(F.sqrt(F.greatest(F.var_samp("d") - F.avg("pv"), F.lit(0.0))), 8).alias("disatt_sd"), rounded(F.corr("rd", "ru"), 5).alias("spearman"),
        rounded(F.when(F.count_if("_high") >= 3, F.corr("hd", "hu")), 5).alias("spearman_high"),
        F.when(F.count("*") < 30, "too few").when(share > 0.5, "mostly improving").otherwise("mostly slowing").alias("verdict"),
    )
