"""The whole model as a configuration of the engine: career curve, entry age, drift, reliability weights, gauges.

log time = u + v + sum of theta_k b_k(A_n) + entry-age terms + d * (A_n - mean A_n of the athlete) + Student-t noise, where A_n are
years since the first race and A_e is the age then, centred at the mean over athletes of known age (0 for the others).
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paceline.functions.scalars import hash_uniform, natural_spline, rounded
from paceline.operators import curves, engine, inference
from paceline.operators.slices import cut


@dataclass(frozen=True)
class FullConfig:
    nu: float = 8.0
    basis: str | None = None  # None, "spline" or "poly"
    n_knots: int = 4
    knots: tuple[float, ...] = ()
    degree: int = 2
    gamma: str | None = None  # None, "scalar" or "varying"
    drift: bool = False
    drift_min_races: int = 5
    drift_min_span: float = 24 / 52
    omega2: float = 1e-4
    omega2_fixed: bool = False
    reliability: float = 0.0  # n0 of the weight n / (n + n0) in global terms
    a_n_max: float | None = None  # the career terms are fitted up to it, and extrapolated
    gauge_slope: bool = True
    tol: float = 1e-10
    loglik_tol: float = 1e-10  # for forms with drift, whose prior variance closes in on its limit slowly
    max_iter: int = 300


def baseline(nu: float) -> FullConfig:
    return FullConfig(nu)


def aging(nu: float) -> FullConfig:
    """The production form: natural spline of four knots, entry-age terms of the same shape."""
    return FullConfig(nu, basis="spline", n_knots=4, gamma="varying")


def drift(nu: float, with_aging: bool = True) -> FullConfig:
    return replace(aging(nu) if with_aging else baseline(nu), drift=True, drift_min_span=1e-3)


def candidates(nus: tuple[float, ...] = (math.inf, 8.0)) -> dict[str, FullConfig]:
    """The forms compared: polynomials of degree 2 to 6 and splines of 3 to 6 knots, without, with scalar, with varying entry age."""
    bases = [(f"poly{d}", {"basis": "poly", "degree": d}) for d in range(2, 7)] + [(f"spline{k}", {"basis": "spline", "n_knots": k}) for k in range(3, 7)]
    return {
        f"{name}-g{gamma or 'off'}-{'inf' if math.isinf(nu) else f'{nu:g}'}": FullConfig(nu, gamma=gamma, **form)
        for name, form in bases for gamma in (None, "scalar", "varying") for nu in nus
    }


@dataclass
class FullFit:
    config: FullConfig
    knots: tuple[float, ...]
    mean_ae: float
    theta: np.ndarray  # career terms, then entry-age terms
    fits: engine.Fits

    @property
    def n_basis(self) -> int:
        return basis_size(self.config, self.knots)


def basis_size(config: FullConfig, knots: tuple[float, ...]) -> int:
    return {None: 0, "spline": len(knots) - 1, "poly": config.degree}[config.basis]


def basis_columns(x: Column, config: FullConfig, knots: tuple[float, ...]) -> list[Column]:
    """The career terms at x; the first is x itself."""
    if config.basis is None:
        return []
    return natural_spline(x, list(knots)) if config.basis == "spline" else [F.pow(x, k) for k in range(1, config.degree + 1)]


def design(cells: DataFrame, config: FullConfig) -> tuple[DataFrame, tuple[str, ...], tuple[float, ...], float]:
    """(cells with all terms, their names, knots, mean entry age)."""
    knots = config.knots or (tuple(curves.knots(cells, config.n_knots)) if config.basis == "spline" else ())
    mean_ae = cells.select("athlete_id", "a_e").distinct().agg(F.avg("a_e")).first()[0] or 0.0
    terms = basis_columns(F.col("a_n"), config, knots)
    centred = F.coalesce(F.col("a_e") - mean_ae, F.lit(0.0))
    if config.gamma == "scalar":
        terms = [*terms, centred * F.col("a_n")]
    elif config.gamma == "varying":
        terms = [*terms, *(centred * b for b in terms)]
    names = tuple(f"x{k}" for k in range(len(terms)))
    per = Window.partitionBy("athlete_id")
    n, span = F.count("*").over(per), F.max("a_n").over(per) - F.min("a_n").over(per)
    extra = {"til": F.col("a_n") - F.avg("a_n").over(per), "eligible": (n >= config.drift_min_races) & (span >= config.drift_min_span)} if config.drift else {}
    if config.reliability > 0:
        extra["rel"] = n / (n + config.reliability)
    if config.a_n_max is not None:
        extra["m"] = (F.col("a_n") <= config.a_n_max).cast("double")
    kept = [c for c in ("g", "run_id", "fold") if c in cells.columns]
    columns = [*(t.alias(x) for t, x in zip(terms, names, strict=True)), *(c.alias(x) for x, c in extra.items())]
    return cells.select("athlete_id", "race_id", "y", "a_n", "a_e", *kept, *columns), names, knots, mean_ae


def race_years(cells: DataFrame) -> DataFrame:
    """race_id and its date in Julian years."""
    return cells.groupBy("race_id").agg((F.datediff(F.min("date"), F.lit("2000-01-01").cast("date")) / 365.25).alias("x"))


def fit(cells: DataFrame, config: FullConfig, start: DataFrame | None = None) -> FullFit:
    """The fit of ``cells`` (athlete_id, race_id, y, a_n, a_e, date) to convergence."""
    ready, names, knots, mean_ae = design(cells, config)
    dates = race_years(cells) if config.gauge_slope and config.basis else None
    ends = config.loglik_tol if config.drift else 0.0
    settings = engine.EngineConfig(config.nu, config.drift, config.omega2, config.omega2_fixed, config.tol, ends, config.max_iter)
    fits = engine.fit_runs(ready, config=settings, covariates=names, dates=dates, start=start)
    return FullFit(config, knots, mean_ae, fits.theta[0], fits)


def predict(cells: DataFrame, fitted: FullFit) -> DataFrame:
    """``cells`` with each term (ability, race, career, entry, drift) and their sum yhat; null where athlete or race was not fitted."""
    k = fitted.n_basis
    terms = basis_columns(F.col("a_n"), fitted.config, fitted.knots)
    centred = F.coalesce(F.col("a_e") - fitted.mean_ae, F.lit(0.0))
    gamma = {None: [], "scalar": [centred * F.col("a_n")], "varying": [centred * b for b in terms]}[fitted.config.gamma]
    total = lambda parts, theta: sum((p * float(t) for p, t in zip(parts, theta, strict=True)), F.lit(0.0))
    joined = cells.join(fitted.fits.athletes.select("athlete_id", "u", "d"), "athlete_id", "left").join(fitted.fits.races.select("race_id", "v"), "race_id", "left")
    til = F.col("a_n") - F.avg("a_n").over(Window.partitionBy("athlete_id"))
    out = joined.withColumns({"career": total(terms, fitted.theta[:k]), "entry": total(gamma, fitted.theta[k:]), "drift": F.col("d") * til})
    return out.withColumnsRenamed({"u": "ability", "v": "race"}).drop("d").withColumn("yhat", F.expr("ability + race + career + entry + drift"))


def n_params(fitted: FullFit) -> int:
    """Parameters counted one by one: abilities and races under one gauge, drifts of eligible athletes, coefficients, scales."""
    athletes, races = fitted.fits.athletes, fitted.fits.races
    drifts = athletes.filter("pv > 0").count() if fitted.config.drift else 0
    return athletes.count() + races.count() - 1 + drifts + len(fitted.theta) + 1 + (fitted.config.drift and not fitted.config.omega2_fixed)


def effective_dof(fitted: FullFit) -> dict[str, float]:
    """Degrees of freedom by block; a drift counts by what its data say against the prior."""
    athletes, k = fitted.fits.athletes, fitted.n_basis
    out = {"u_v": float(athletes.count() + fitted.fits.races.count() - 1), "aging": float(k), "gamma": float(len(fitted.theta) - k)}
    if fitted.config.drift:
        ridge = 1 / fitted.fits.scales.first()["omega2"]
        signal = F.greatest(1 / F.col("pv") - ridge, F.lit(0.0))
        out["d"] = athletes.filter("pv > 0").agg(F.coalesce(F.sum(signal / (signal + ridge)), F.lit(0.0))).first()[0]
    return out


def curve_on_grid(spark: SparkSession, fitted: FullFit, hi: float, n: int = 200, offset: float = 10.0) -> DataFrame:
    """k, a_n, career (the curve at the mean entry age) and entry (what ``offset`` years of entry age add)."""
    k = fitted.n_basis
    points = curves.grid(spark, 0.0, hi, n)
    terms = basis_columns(F.col("x"), fitted.config, fitted.knots)
    gamma = {None: [], "scalar": [F.col("x")], "varying": terms}[fitted.config.gamma]
    total = lambda parts, theta: sum((p * float(t) for p, t in zip(parts, theta, strict=True)), F.lit(0.0))
    return points.select("k", F.col("x").alias("a_n"), total(terms, fitted.theta[:k]).alias("career"), (offset * total(gamma, fitted.theta[k:])).alias("entry"))


def curve_descriptors(points: DataFrame, value: str = "career") -> DataFrame:
    """Peak age and improvement, span until the start's level comes back (censored at the horizon), decline from peak to horizon."""
    low = points.agg(F.min_by("a_n", value).alias("at"), F.min(value).alias("low"), F.max_by(value, "a_n").alias("end"), F.max("a_n").alias("horizon"))
    walk = Window.orderBy("a_n")  # a grid has a fixed number of points
    steps = points.select("a_n", F.col(value).alias("f"), F.lag(value).over(walk).alias("f0"), F.lag("a_n").over(walk).alias("a0")).crossJoin(F.broadcast(low))  # one row
    back = F.col("a0") - F.col("f0") / (F.col("f") - F.col("f0")) * (F.col("a_n") - F.col("a0"))
    span = F.min(F.when((F.col("a0") >= F.col("at")) & (F.col("f0") < 0) & (F.col("f") >= 0), back))
    one = steps.agg(span.alias("back"), *(F.first(c).alias(c) for c in ("at", "low", "end", "horizon")))
    better = F.col("low") < -1e-6
    return one.select(
        rounded(F.when(better, F.col("at")).otherwise(0.0)).alias("peak_age"), rounded(F.when(better, 100 * (1 - F.exp("low"))).otherwise(0.0), 4).alias("improve_pct"),
        rounded(F.when(better, F.coalesce("back", "horizon")).otherwise(0.0), 4).alias("span"), (better & F.col("back").isNull()).alias("censored"),
        rounded(100 * F.expm1("end"), 4).alias("end_pct"), rounded(100 * (F.exp("end") - F.exp("low")), 4).alias("decline_pct"),
    )


def wide_design(cells: DataFrame, forms: dict[str, FullConfig]) -> tuple[DataFrame, tuple[str, ...], np.ndarray]:
    """(cells with the terms of all forms side by side, their names, which of them each form has); terms that forms share stand once.

    The linear term comes first.  Splines of as many knots share their knots; entry age is centred once for all.
    """
    mean_ae = cells.select("athlete_id", "a_e").distinct().agg(F.avg("a_e")).first()[0] or 0.0
    x, centred = F.col("a_n"), F.coalesce(F.col("a_e") - mean_ae, F.lit(0.0))
    known: dict[str, Column] = {"x": x}
    knots: dict[int, tuple[float, ...]] = {}
    wanted = []
    for c in forms.values():
        career = {}
        if c.basis == "poly":
            career = {"x": x} | {f"x{d}": F.pow(x, d) for d in range(2, c.degree + 1)}
        elif c.basis == "spline":
            at = c.knots or knots.setdefault(c.n_knots, tuple(curves.knots(cells, c.n_knots)))
            name = f"s{c.n_knots}" if not c.knots else "s" + "_".join(f"{q:g}" for q in at).replace(".", "p")
            career = {"x": x} | {f"{name}_{i}": b for i, b in enumerate(natural_spline(x, list(at))[1:], 1)}
        entry = {None: [], "scalar": ["x"], "varying": list(career)}[c.gamma]
        mine = career | {f"e_{n}": centred * career.get(n, x) for n in entry}
        known |= mine
        wanted.append(set(mine))
    names = tuple(known)
    kept = [c for c in ("g", "bits", "run_id", "fold") if c in cells.columns]
    return cells.select("athlete_id", "race_id", "y", *kept, *(v.alias(n) for n, v in known.items())), names, np.array([[n in w for n in names] for w in wanted])


def form_fits(marked: DataFrame, k: int, forms: dict[str, FullConfig]) -> DataFrame:
    """form, fold, n, n_orphans, logdensity, rmse (of held-out cells), loglik, n_params, n_iter, converged: every form fitted to the cells of all folds but
    one, and to all cells (fold null), as runs of one plan.

    Forms of one noise law are fitted together, Gaussian first, and the others warm from the law before where they have the same terms.  A run knows
    its columns of the wide design and its entry of k + 1 weights, so that cells are held once, however many the forms.  Cells are scored where
    their athlete was solved.
    """
    every = [n for n in forms]
    ready, names, masks = wide_design(inference.with_folds(marked, k, whole=True), forms)
    ready = cut(ready)
    n_athletes, n_races = marked.agg(F.count_distinct("athlete_id"), F.count_distinct("race_id")).first()
    dates = cut(race_years(marked)) if any(c.basis for c in forms.values()) else None
    rows, warm = [], {}
    for nu in sorted({c.nu for c in forms.values()}, reverse=True):
        same = [i for i, n in enumerate(every) if forms[n].nu == nu]
        size = max(1, engine.at_once(n_races, terms=int(masks[same].sum(axis=1).max())) // (k + 1))  # forms that the driver holds at once
        for chunk in (same[at : at + size] for at in range(0, len(same), size)):
            runs = list(range(len(chunk) * (k + 1)))
            of = lambda run: chunk[run // (k + 1)]  # noqa: E731, B023
            before = [warm.get((masks[of(r)].tobytes(), r % (k + 1))) for r in runs]
            first = forms[every[chunk[0]]]
            settings = engine.EngineConfig(nu, tol=first.tol, loglik_tol=1e-12, max_iter=first.max_iter)  # high powers move long after the fit stands
            theta = np.array([b[0] if b else np.zeros(len(names)) for b in before])
            start = sigma2 = None
            if all(b is not None for b in before):
                start = reduce(DataFrame.unionByName, [b[1].filter(F.col("run_id") == b[3]).withColumn("run_id", F.lit(r).cast("long")) for r, b in zip(runs, before, strict=True)])
                sigma2 = [b[2] for b in before]
            fits = engine.fit_runs(ready, runs, settings, names, dates, start, sigma2=sigma2, columns=masks[[of(r) for r in runs]], theta=theta, slots=[r % (k + 1) for r in runs], score=True)
            scores = {r["run_id"]: r for r in fits.held_out.collect()}  # a row a run, as the next two
            scales = {r["run_id"]: r for r in fits.scales.collect()}
            for r in runs:
                form, fold, s, scale = every[of(r)], r % (k + 1), scores.get(r), scales[r]
                warm[masks[of(r)].tobytes(), fold] = fits.theta[r], fits.races, scale["sigma2"], r
                n_params = n_athletes + n_races - 1 + int(masks[of(r)].sum()) + 1
                held = (s["n"], s["n_orphans"], s["logdensity"], math.sqrt(s["sq"] / max(1, s["n"]))) if fold < k else (None,) * 4
                rows.append((form, fold if fold < k else None, *held, scale["loglik"], n_params, scale["n_iter"], scale["converged"]))
    schema = "form string, fold long, n long, n_orphans long, logdensity double, rmse double, loglik double, n_params long, n_iter long, converged boolean"
    return ready.sparkSession.createDataFrame(rows, schema)


def form_scores(marked: DataFrame, k: int, forms: dict[str, FullConfig]) -> DataFrame:
    """form, fold, n, logdensity, rmse: held-out scores of ``form_fits``; drift takes no part in them, as it belongs to the athletes of the fit."""
    return form_fits(marked, k, forms).filter("fold is not null").select("form", "fold", "n", "logdensity", "rmse")


def omega_refits(cells: DataFrame, config: FullConfig, omegas: list[float], fixed: list[bool], warm: FullFit | None = None, max_iter: int = 1000) -> tuple[engine.Fits, list[str], tuple[float, ...], float]:
    """(fits, names, knots, mean entry age): a refit for each prior variance of drifts, held there or only begun there, as runs of one plan.

    ``warm`` begins them all at the races and coefficients of a fit.
    """
    ready, names, knots, mean_ae = design(cells, replace(config, drift=True, knots=warm.knots if warm else config.knots))
    dates = race_years(cells) if config.gauge_slope and config.basis else None
    settings = engine.EngineConfig(config.nu, True, tuple(omegas), tuple(fixed), config.tol, config.loglik_tol, max_iter)
    runs = list(range(len(omegas)))
    start = None if warm is None else warm.fits.races.select("race_id", "v")
    theta = None if warm is None else np.tile(warm.theta, (len(runs), 1))
    ready = cut(ready)
    n_races = ready.select("race_id").distinct().count()

    def some(ids: list[int]) -> engine.Fits:
        own = replace(settings, omega2=tuple(omegas[r] for r in ids), omega2_fixed=tuple(fixed[r] for r in ids))
        return engine.fit_runs(ready, ids, own, names, dates, start, theta=None if theta is None else theta[ids], sigma2=None if warm is None else warm.fits.sigma2)

    return engine.joined(list(engine.chunked(some, runs, n_races, settings, len(names)))), list(names), knots, mean_ae


def omega_metrics(fits: engine.Fits, n_params: int) -> DataFrame:
    """By run: log likelihoods (of the data, penalised, and marginal over drifts by Laplace), degrees of freedom, criteria, the spread of drifts, and
    how far abilities and races lie from run 0."""
    athletes, known = fits.athletes.join(F.broadcast(fits.scales.select("run_id", "omega2")), "run_id"), F.col("pv") > 0  # one row a run
    ridge, d = 1 / F.col("omega2"), F.when(known, F.col("d"))
    signal = F.greatest(1 / F.col("pv") - ridge, F.lit(0.0))
    base = fits.athletes.filter("run_id = 0").select("athlete_id", F.col("u").alias("u0"))
    drifts = athletes.join(base, "athlete_id").groupBy("run_id").agg(
        F.count_if(known).alias("n_eligible"), F.sum(d * d).alias("square"), F.sum(F.when(known, F.log("pv"))).alias("log_pv"), F.sum(F.when(known, signal / (signal + ridge))).alias("edf_d"),
        F.stddev_samp(d).alias("d_sd"), F.avg((d < 0).cast("double")).alias("frac_improver"), F.avg((F.abs(d) > 2 * F.sqrt("pv")).cast("double")).alias("frac_credible"),
        F.corr(d, F.when(known, F.col("u"))).alias("corr_du"), F.corr("u", "u0").alias("corr_u"),
    )
    v0 = fits.races.filter("run_id = 0").select("race_id", F.col("v").alias("v0"))
    gap = F.col("v") - F.col("v0")
    races = fits.races.join(v0, "race_id").groupBy("run_id").agg(F.corr("v", "v0").alias("corr_v"), F.max(F.abs(gap)).alias("max_dv"), F.sqrt(F.avg(gap * gap)).alias("rms_dv"))
    one = fits.scales.join(drifts, "run_id").join(races, "run_id")
    data = F.col("loglik") + F.col("square") / (2 * F.col("omega2"))
    total = F.lit(float(n_params)) + F.col("edf_d")
    return one.withColumn("data_loglik", data).withColumn("log_ml", F.col("loglik") - 0.5 * F.col("n_eligible") * F.log("omega2") + 0.5 * F.col("log_pv")).withColumns(
        {"aic": 2 * total - 2 * F.col("data_loglik"), "bic": F.log("n") * total - 2 * F.col("data_loglik")}
    )


def best_of_starts(cells: DataFrame, config: FullConfig, restarts: int = 2, spread: float = 0.05, seed: int = 7) -> tuple[FullFit, DataFrame]:
    """The fit of highest likelihood over the mean start and hashed normal restarts, and run, loglik, n_iter, max_shift of each."""
    found, rows = [], []
    for r in range(restarts + 1):
        u1, u2 = (hash_uniform(seed + 2 * r + i, F.col("race_id")) for i in (0, 1))
        start = cells.select("race_id").distinct().withColumn("v", spread * F.sqrt(-2 * F.log(u1)) * F.cos(2 * math.pi * u2)) if r else None
        found.append(fit(cells, config, start))
        rows.append(found[-1].fits.scales.first())
    best = max(range(len(found)), key=lambda r: rows[r]["loglik"])
    base = found[best].fits.races.select("race_id", F.col("v").alias("v0"))
    shifts = [f.fits.races.join(base, "race_id").agg(F.max(F.abs(F.col("v") - F.col("v0")))).first()[0] for f in found]
    spark = cells.sparkSession
    table = spark.createDataFrame([(r, x["loglik"], x["n_iter"], s) for r, (x, s) in enumerate(zip(rows, shifts, strict=True))], "run int, loglik double, n_iter long, max_shift double")
    return found[best], table


def traced_starts(cells: DataFrame, config: FullConfig, restarts: int = 4, spread: float = 0.1, stepping: float = 15.0, seed: int = 7) -> tuple[engine.Fits, dict[int, str]]:
    """Fits of one form without drift from many starts as runs of one plan, with their paths, and the name of each start.

    ``mean`` begins at nothing, ``random`` at hashed normal race effects, ``warm`` at the Gaussian fit, ``stepping`` at a fit of a law between that
    one began at the Gaussian fit.
    """
    ready, names, _, _ = design(cells, replace(config, drift=False))
    ready, dates = cut(ready), cut(race_years(cells)) if config.gauge_slope and config.basis else None
    before = {}
    for nu in (math.inf, stepping):
        last = before.get(math.inf)
        before[nu] = engine.fit_runs(ready, [0], engine.EngineConfig(nu, tol=config.tol, max_iter=config.max_iter), names, dates, last and last.races.select("race_id", "v"), theta=last and [last.theta[0]])
    kinds = {0: "mean", **{r: "random" for r in range(1, restarts + 1)}, restarts + 1: "warm", restarts + 2: "stepping"}
    races = cells.select("race_id").distinct()
    u1, u2 = (hash_uniform(seed + i, F.col("run_id"), F.col("race_id")) for i in (0, 1))
    drawn = spread * F.sqrt(-2 * F.log(u1)) * F.cos(2 * math.pi * u2)
    ids = F.explode(F.sequence(F.lit(0), F.lit(restarts)).cast("array<bigint>"))
    start = races.withColumn("run_id", ids).select("run_id", "race_id", F.when(F.col("run_id") == 0, 0.0).otherwise(drawn).alias("v"))
    for run, nu in ((restarts + 1, math.inf), (restarts + 2, stepping)):
        start = start.unionByName(before[nu].races.select(F.lit(run).cast("long").alias("run_id"), "race_id", "v"))
    theta = [np.zeros(len(names))] * (restarts + 1) + [before[math.inf].theta[0], before[stepping].theta[0]]
    settings = engine.EngineConfig(config.nu, tol=config.tol, max_iter=config.max_iter)
    return engine.fit_runs(ready, list(kinds), settings, names, dates, cut(start), theta=np.array(theta), keep_paths=True), kinds


def trace_table(fits: engine.Fits, kinds: dict[int, str]) -> DataFrame:
    """run_id, kind, sweep, loglik, sigma2, change: what every sweep of every run came to."""
    spark = fits.races.sparkSession
    return spark.createDataFrame([(r, kinds[r], it, ll, s2, moved) for r, it, ll, s2, _, moved in fits.history], "run_id long, kind string, sweep long, loglik double, sigma2 double, change double")


def path_agreement(fits: engine.Fits) -> DataFrame:
    """run_id, sweep, pearson, spearman, mae, max_gap: race effects after each sweep of each run against the end of the run of highest likelihood."""
    best = fits.scales.orderBy(F.desc("loglik"), "run_id").first()["run_id"]
    base = fits.races.filter(F.col("run_id") == best).select("race_id", F.col("v").alias("v0"))
    per = Window.partitionBy("run_id", "sweep")  # a row a race
    joined = fits.paths.join(base, "race_id").withColumns({"a": F.rank().over(per.orderBy("v")), "b": F.rank().over(per.orderBy("v0"))})
    gap = F.abs(F.col("v") - F.col("v0"))
    return joined.groupBy("run_id", "sweep").agg(F.corr("v", "v0").alias("pearson"), F.corr("a", "b").alias("spearman"), F.avg(gap).alias("mae"), F.max(gap).alias("max_gap"))


def coordinate_descent(gram: np.ndarray, b: np.ndarray, theta: np.ndarray, rounds: int) -> np.ndarray:
    """Rounds of one-coefficient updates of a weighted least squares problem, from its cross products alone."""
    theta = theta.astype(float).copy()
    for _ in range(rounds):
        for j in range(len(theta)):
            if gram[j, j] > 0:
                theta[j] += (b[j] - gram[j] @ theta) / gram[j, j]
    return theta


def orthonormal(gram: np.ndarray, n: int) -> np.ndarray:
    """The matrix that turns raw columns with these cross products into columns whose mean squares are one."""
    return np.linalg.inv(np.linalg.cholesky(gram).T) * math.sqrt(n)
