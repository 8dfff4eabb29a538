"""The two-way latent-factor model: log time = ability + difficulty + career age + drift, by block updates.

``sweeps`` runs a fixed number of block updates as grouped sums, for checks against SQL.  ``fit``
iterates to convergence: the cells stay distributed, every sweep is two grouped aggregates and one row of sums,
and only per-race values and global coefficients come to the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceline.functions.scalars import irls_weight, log_density, natural_spline
from paceline.operators.slices import cut


@dataclass(frozen=True)
class ModelConfig:
    nu: float = math.inf
    knots: tuple[float, ...] = ()
    drift: bool = False
    drift_min_races: int = 5
    drift_min_span: float = 0.5
    omega2: float = 1e-4


@dataclass(frozen=True)
class FitConfig:
    max_iter: int = 200
    tol: float = 1e-9
    race_limit: int = 5_000_000


@dataclass
class Fit:
    """Outcome of a fit: athletes (athlete_id, u, d), races (race_id, v), coefficients and the trace."""

    athletes: DataFrame
    races: DataFrame
    theta: np.ndarray
    sigma2: float
    omega2: float
    loglik: float
    n_iter: int
    converged: bool
    trace: list[tuple[int, float, float]] = field(default_factory=list)


def mean_init(cells: DataFrame) -> DataFrame:
    """Ability as the athlete's mean response."""
    return cells.groupBy("athlete_id").agg(F.avg("y").alias("u"))


def race_update(cells: DataFrame, u: DataFrame, weight: Column | None = None) -> DataFrame:
    """race_id, v: (weighted) mean of what ability leaves, before the gauge."""
    w = weight if weight is not None else F.lit(1.0)
    left = cells.join(u, "athlete_id")
    return left.groupBy("race_id").agg((F.sum(w * (F.col("y") - F.col("u"))) / F.sum(w)).alias("v"))


def centred(races: DataFrame) -> DataFrame:
    """The mean-zero gauge over races."""
    mean = races.agg(F.avg("v").alias("mean_v"))
    return races.crossJoin(F.broadcast(mean)).select("race_id", (F.col("v") - F.col("mean_v")).alias("v"))  # one row


def athlete_update(cells: DataFrame, v: DataFrame) -> DataFrame:
    return cells.join(v, "race_id").groupBy("athlete_id").agg(F.avg(F.col("y") - F.col("v")).alias("u"))


def sweeps(cells: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """``n`` Gaussian sweeps from the mean start: (athletes with u, races with centred v).

    Beyond two sweeps the race table is cut, for each sweep names the one before it more than once.
    """
    u = mean_init(cells)
    for _ in range(n):
        v = centred(race_update(cells, u))
        v = cut(v) if n > 2 else v
        u = athlete_update(cells, v)
    return u, v


def refits(cells: DataFrame, start: DataFrame | None = None, tol: float = 1e-9, max_iter: int = 500) -> DataFrame:
    """run_id, race_id, v: Gaussian fits of many runs in one plan, each iterated until no race effect of any run moves by ``tol``.

    ``cells`` has run_id, athlete_id, race_id, y and g, an athlete's weight in its run.  All cells of an athlete have the
    same weight, so abilities are plain means and weights enter the race update.  ``start`` (race_id, v) warms all runs.
    """
    base = cut(cells.select("run_id", "athlete_id", "race_id", "y", "g"))
    v = base.select("run_id", "race_id").distinct()
    v = cut(v.withColumn("v", F.lit(0.0)) if start is None else v.join(start.select("race_id", "v"), "race_id", "left").select("run_id", "race_id", F.coalesce("v", F.lit(0.0)).alias("v")))
    per = Window.partitionBy("run_id", "athlete_id")
    for _ in range(max_iter):
        left = base.join(v, ["run_id", "race_id"])
        left = left.withColumn("r", F.col("y") - F.avg(F.col("y") - F.col("v")).over(per))
        raw = left.groupBy("run_id", "race_id").agg((F.sum(F.col("g") * F.col("r")) / F.sum("g")).alias("nv"), F.first("v").alias("old"))
        mean = F.avg("nv").over(Window.partitionBy("run_id"))  # race effects of one run
        v = cut(raw.select("run_id", "race_id", (F.col("nv") - mean).alias("v"), "old"))
        moved = v.agg(F.max(F.abs(F.col("v") - F.col("old")))).first()[0]
        v = v.select("run_id", "race_id", "v")
        if moved is None or moved < tol:
            return v
    raise ValueError(f"race effects still move by {moved} after {max_iter} sweeps")


def _gauge(races: list[tuple[int, float, float]]) -> tuple[float, float]:
    """Mean of v and its slope on the race date."""
    v, t = np.array([r[1] for r in races]), np.array([r[2] for r in races])
    t0 = t - t.mean()
    return float(v.mean()), float((v * t0).sum() / (t0 * t0).sum()) if (t0 * t0).sum() > 0 else 0.0


def fit(cells: DataFrame, config: ModelConfig = ModelConfig(), fitter: FitConfig = FitConfig()) -> Fit:
    """Block coordinate descent with IRLS weights; per-sweep order: weights, v, u, career curve, drift, scale."""
    basis = natural_spline(F.col("a_n"), list(config.knots)) if config.knots else []
    names = [f"b{k}" for k in range(len(basis))]
    cols = [b.alias(n) for b, n in zip(basis, names, strict=True)]
    mean_a, counts = F.avg("a_n").alias("a_mean"), F.count("*").alias("n_i")
    per = cells.groupBy("athlete_id").agg(mean_a, counts, (F.max("a_n") - F.min("a_n")).alias("span"), F.avg("y").alias("u"))
    eligible = (F.col("n_i") >= config.drift_min_races) & (F.col("span") >= config.drift_min_span) & F.lit(config.drift)
    state = cut(per.select("athlete_id", "a_mean", eligible.alias("eligible"), "u", F.lit(0.0).alias("d")))
    base = cut(cells.select("athlete_id", "race_id", "y", "a_n", *cols))
    n_races = base.select("race_id").distinct().count()
    if n_races > fitter.race_limit:
        raise ValueError(f"{n_races} races; at most {fitter.race_limit} race effects fit a broadcast table")
    theta, sigma2, omega2, last = np.zeros(len(basis)), None, config.omega2, -math.inf
    v = base.select("race_id").distinct().withColumn("v", F.lit(0.0))
    trace, converged, it = [], False, 0

    def curve(coefficients: np.ndarray) -> Column:
        return sum((F.col(n) * float(c) for n, c in zip(names, coefficients, strict=True)), F.lit(0.0))

    for it in range(1, fitter.max_iter + 1):
        full = base.join(state, "athlete_id").join(F.broadcast(v), "race_id")  # race_limit rows at most
        til = F.col("a_n") - F.col("a_mean")
        rest = F.col("y") - F.col("u") - F.col("d") * til - curve(theta)
        if sigma2 is None:
            sigma2 = full.agg(F.avg((rest - F.col("v")) ** 2)).first()[0]
        full = cut(full.withColumn("w", irls_weight(rest - F.col("v"), sigma2, config.nu)))
        new_v = full.groupBy("race_id").agg((F.sum(F.col("w") * rest) / F.sum("w")).alias("nv"))
        full = full.join(F.broadcast(new_v), "race_id").drop("v").withColumnRenamed("nv", "v")
        body = F.col("y") - F.col("v") - curve(theta)
        new_u = full.groupBy("athlete_id").agg((F.sum(F.col("w") * (body - F.col("d") * til)) / F.sum("w")).alias("nu_"))
        full = full.join(new_u, "athlete_id").drop("u").withColumnRenamed("nu_", "u")
        if names:
            left = F.col("y") - F.col("v") - F.col("u") - F.col("d") * til
            gram = [F.sum(F.col("w") * F.col(a) * F.col(b)) for a in names for b in names]
            got = full.agg(*gram, *(F.sum(F.col("w") * F.col(a) * left) for a in names)).first()
            k = len(names)
            theta = np.linalg.solve(np.array(got[: k * k]).reshape(k, k) + 1e-12 * np.eye(k), np.array(got[k * k :]))
        left = F.col("y") - F.col("v") - F.col("u") - curve(theta)
        precision = F.sum(F.col("w") * til * til) / sigma2 + 1 / omega2
        drift = full.groupBy("athlete_id").agg(
            F.first("a_mean").alias("a_mean"),
            F.first("eligible").alias("eligible"),
            F.first("u").alias("u"),
            F.when(F.first("eligible"), F.sum(F.col("w") * til * left) / sigma2 / precision).otherwise(0.0).alias("d"),
            (1 / precision).alias("pv"),
        )
        state = cut(drift)
        v = cut(full.groupBy("race_id").agg(F.first("v").alias("v")))
        if config.drift:
            moment = state.filter("eligible").agg(F.avg(F.col("d") ** 2 + F.col("pv"))).first()[0]
            omega2 = min(max(moment or omega2, 1e-10), 1.0)
        r = F.col("y") - F.col("v") - F.col("u") - F.col("d") * til - curve(theta)
        done = base.join(state, "athlete_id").join(F.broadcast(v), "race_id").withColumn("r", r)
        done = done.join(full.select("athlete_id", "race_id", "w"), ["athlete_id", "race_id"]) if not math.isinf(config.nu) else done.withColumn("w", F.lit(1.0))
        sigma2 = done.agg(F.avg(F.col("w") * F.col("r") ** 2)).first()[0]
        penalty = state.filter("eligible").agg(F.coalesce(F.sum(F.col("d") ** 2), F.lit(0.0))).first()[0] / (2 * omega2)
        loglik = done.agg(F.sum(log_density(F.col("r"), sigma2, config.nu))).first()[0] - penalty
        trace.append((it, loglik, sigma2))
        if abs(loglik - last) <= fitter.tol * (abs(loglik) + 1):
            converged = True
            break
        last = loglik
    mean = v.agg(F.avg("v")).first()[0]
    races = v.select("race_id", (F.col("v") - mean).alias("v"))
    athletes = state.select("athlete_id", (F.col("u") + mean).alias("u"), "d")
    return Fit(athletes, races, theta, sigma2, omega2, trace[-1][1], it, converged, trace)


def information_criteria(loglik: float, n: int, k: float) -> tuple[float, float]:
    """AIC and BIC."""
    return 2 * k - 2 * loglik, k * math.log(n) - 2 * loglik


def anderson(cells: DataFrame, memory: int = 5, start: int = 3, fitter: FitConfig = FitConfig()) -> tuple[DataFrame, int, float]:
    """Gaussian race effects by Anderson mixing of the sweep map: (races, sweeps, last change).

    Ability is a function of the race effects, so that the race vector is the whole state; it has one value a race.
    A mixed step is kept only if it does not raise the residual sum of squares.
    """
    base = cut(cells.select("athlete_id", "race_id", "y"))
    ids = [r[0] for r in base.select("race_id").distinct().orderBy("race_id").limit(fitter.race_limit + 1).collect()]
    if len(ids) > fitter.race_limit:
        raise ValueError(f"more than {fitter.race_limit} race effects")
    spark = base.sparkSession

    def frame(v: np.ndarray) -> DataFrame:
        return spark.createDataFrame(list(zip(ids, map(float, v), strict=True)), "race_id long, v double")

    def sweep(v: np.ndarray) -> tuple[np.ndarray, float]:
        """The next race effects, and the residual sum of squares of ``v`` with its best abilities."""
        at = F.broadcast(frame(v))  # race_limit rows at most
        rest = base.join(at, "race_id").withColumn("r", F.col("y") - F.col("v"))
        u = rest.groupBy("athlete_id").agg(F.avg("r").alias("u"))
        got = rest.join(u, "athlete_id").groupBy("race_id").agg(F.avg(F.col("y") - F.col("u")).alias("v"), F.sum((F.col("r") - F.col("u")) ** 2).alias("s"))
        rows = {r["race_id"]: (r["v"], r["s"]) for r in got.collect()}
        new = np.array([rows[i][0] for i in ids])
        return new - new.mean(), sum(r[1] for r in rows.values())

    x, best, change, xs, gs = np.zeros(len(ids)), math.inf, math.inf, [], []
    fallback = x
    for it in range(1, fitter.max_iter + 1):
        g, rss = sweep(x)
        if rss > best * (1 + 1e-12):  # the mixed point was worse than the last: go on from the plain sweep
            x, xs, gs = fallback, [], []
            best = math.inf
            continue
        best = rss
        change = float(np.abs(g - x).max())
        if change <= fitter.tol:
            return frame(g), it, change
        xs, gs = [*xs, x][-memory - 1 :], [*gs, g][-memory - 1 :]
        fallback = x = g
        if it >= start and len(xs) > 1:
            f = np.stack([b - a for a, b in zip(xs, gs, strict=True)])
            d = f[1:] - f[:-1]
            gamma = np.linalg.solve(d @ d.T + 1e-12 * np.trace(d @ d.T) * np.eye(len(d)), d @ f[-1])
            x = gs[-1] - (np.stack(gs)[1:] - np.stack(gs)[:-1]).T @ gamma
            x = x - x.mean()
    return frame(x), fitter.max_iter, change


def gauge_beta0(u: DataFrame, v: DataFrame, cells: DataFrame, dates: DataFrame) -> tuple[DataFrame, DataFrame, float]:
    """Move the slope of v on the race date to ability and career age: (u, v, slope).

    A race's date is the debut plus career age, so what v loses by date, u gains by debut and the career curve by age.
    """
    dated = v.join(dates, "race_id").withColumn("x", F.datediff("date", F.lit("2000-01-01").cast("date")) / 365.25)
    slope, mean_x, mean_v = dated.agg(F.regr_slope("v", "x"), F.avg("x"), F.avg("v")).first()
    slope = slope or 0.0
    debut = cells.groupBy("athlete_id").agg((F.datediff(F.min("date"), F.lit("2000-01-01").cast("date")) / 365.25).alias("x0"))
    new_v = dated.select("race_id", (F.col("v") - mean_v - slope * (F.col("x") - mean_x)).alias("v"))
    new_u = u.join(debut, "athlete_id").select("athlete_id", (F.col("u") + mean_v + slope * (F.col("x0") - mean_x)).alias("u"))
    return new_u, new_v, slope


def fit_races(cells: DataFrame, nu: float = math.inf, fitter: FitConfig = FitConfig(max_iter=60, tol=1e-8), inner: int = 6, per_partition: int = 2_000_000) -> Fit:
    """Ability and difficulty under Student-t noise, one job a sweep.

    Cells are dealt by athlete once and kept.  Given the race effects, an athlete's ability depends on its own cells alone:
    each task finds it by a few reweighted means and returns weighted sums by race, which are added up.  Nothing of the
    size of the athletes leaves the tasks until the last sweep; a task holds about ``per_partition`` cells.
    """
    spark = cells.sparkSession
    n_cells = cells.count()
    parts = max(spark.sparkContext.defaultParallelism, -(-n_cells // per_partition))
    dealt = cells.select("athlete_id", "race_id", "y").repartition(parts, "athlete_id").persist()
    rows = dealt.select("race_id").distinct().orderBy("race_id").limit(fitter.race_limit + 1).collect()
    if len(rows) > fitter.race_limit:
        raise ValueError(f"more than {fitter.race_limit} race effects")
    ids = np.array([r[0] for r in rows], dtype=np.int64)
    state = {"v": np.zeros(len(ids)), "s2": None}

    def local(batches, shared):  # noqa: ANN001, ANN202
        """(athlete ids, ability, race index, residual, weight) of all cells of a task."""
        import pyarrow as pa

        table = pa.Table.from_batches(list(batches))
        v, s2 = shared.value
        who, a = np.unique(table["athlete_id"].to_numpy(), return_inverse=True)
        r = np.searchsorted(ids, table["race_id"].to_numpy())
        rest = table["y"].to_numpy() - v[r]
        u = np.bincount(a, rest) / np.bincount(a)
        w = np.ones(len(a))
        if s2 is not None and not math.isinf(nu):
            for _ in range(inner):
                w = (nu + 1) / (nu + (rest - u[a]) ** 2 / s2)
                u = np.bincount(a, w * rest) / np.bincount(a, w)
            w = (nu + 1) / (nu + (rest - u[a]) ** 2 / s2)
        return who, u, r, rest - u[a], w

    def sums(batches):  # noqa: ANN001, ANN202
        import pyarrow as pa

        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        _, _, r, e, w = local(batches, shared)
        here = np.unique(r)
        top = np.bincount(r, w * e, len(ids))[here]
        low = np.bincount(r, w, len(ids))[here]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(here, -1)), pa.array(np.append(top, (w * e * e).sum())), pa.array(np.append(low, float(len(e))))], names=["k", "top", "low"]
        )

    def abilities(batches):  # noqa: ANN001, ANN202
        import pyarrow as pa

        batches = [b for b in batches if b.num_rows]
        if batches:
            who, u, *_ = local(batches, shared)
            yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(u)], names=["athlete_id", "u"])

    trace, converged, it = [], False, 0
    for it in range(1, fitter.max_iter + 1):
        shared = spark.sparkContext.broadcast((state["v"], state["s2"]))  # race_limit values at most
        got = dealt.mapInArrow(sums, "k long, top double, low double").groupBy("k").agg(F.sum("top"), F.sum("low")).collect()
        shared.unpersist()
        step = np.zeros(len(ids))
        for k, top, low in got:
            if k >= 0:
                step[k] = top / low
            else:
                state["s2"] = top / low
        new = state["v"] + step
        new -= new.mean()
        change = float(np.abs(new - state["v"]).max())
        state["v"] = new
        trace.append((it, -change, state["s2"]))
        if change <= fitter.tol:
            converged = True
            break
    shared = spark.sparkContext.broadcast((state["v"], state["s2"]))
    athletes = cut(dealt.mapInArrow(abilities, "athlete_id long, u double").withColumn("d", F.lit(0.0)))
    races = spark.createDataFrame([(int(i), float(x)) for i, x in zip(ids, state["v"], strict=True)], "race_id long, v double")
    e = F.col("y") - F.col("u") - F.col("v")
    at = F.broadcast(races)  # race_limit rows at most
    loglik = dealt.join(athletes, "athlete_id").join(at, "race_id").agg(F.sum(log_density(e, state["s2"], nu))).first()[0]
    dealt.unpersist()
    return Fit(athletes, races, np.zeros(0), state["s2"], 0.0, loglik, it, converged, trace)
