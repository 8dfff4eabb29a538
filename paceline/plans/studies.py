"""Registered queries of the uncertainty of the whole model, its selection and its sensitivity to wrong identities."""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.functions.scalars import hash_uniform_sql, rounded
from paceline.operators import fan, full, gauge, inference, mismatch, regression, selection, slices
from paceline.operators.slices import SliceSpec
from paceline.plans.extra import _full
from paceline.plans.more import _COV, _LEFT, _countries_out, _covariates, _weather
from paceline.plans.queries import _BOOT, _FITTED, _X, NU, SEED, SPEC, _boot, _fitted, _r, _sigma2, query
from paceline.sources import adapter, registry, tables
from paceline.sources.ledger import Ledger
from paceline.sources.scratch import shared_dir

REPLICATES = 100
ENTRY_AGES = [35.0, 45.0, 55.0, 65.0]
PRODUCTION = full.FullConfig(8.0, "spline", gamma="varying", drift=True)


def _replicates(spark: SparkSession, d: str, spec: SliceSpec, config: full.FullConfig) -> tuple[DataFrame, full.FullFit, fan.Replicates]:
    """(cells, the fit, its replicates), each saved once under its identity."""
    cells = tables.cached_slice(spark, d, spec)
    point = _full(spark, d, "replicated", config, spec)
    key = (tables.core_fingerprint(spark, d), registry.identity_key(spec, config), REPLICATES, SEED)
    made: list[fan.Replicates] = []

    def of(name: str) -> DataFrame:
        if not made:
            made.append(fan.replicates(cells, point, REPLICATES, SEED))
        return getattr(made[0], name)

    stored = {n: tables.cached(spark, f"replicates-{n}", key, lambda n=n: of(n)) for n in ("coefficients", "scales")}
    return cells, point, fan.Replicates(config, point.knots, point.mean_ae, stored["coefficients"], stored["scales"])


@query()
def rk_aging_fan(spark: SparkSession, d: str) -> DataFrame:
    """Career curves of athletes who began at 35, 45, 55 and 65, with bands over 100 weighted refits of the production form; compared
    with refits and curves in NumPy in the tests."""
    cells, _, made = _replicates(spark, d, SPEC, replace(PRODUCTION, drift=False))
    out = fan.fan(made, fan.grid(spark, fan.horizon(cells)), ENTRY_AGES)
    return out.select("entry_age", "point", *(rounded(F.col(c)).alias(c) for c in ("a_n", "curve", "lo", "hi")), "n_runs")


@query()
def rk_fan_identifiability(spark: SparkSession, d: str) -> DataFrame:
    """What of the difference between men's and women's fans is identified, and how robust it is; each sex has a slice, a fit with drift and 100
    replicates of its own."""
    sides = {}
    for sex in "MW":
        cells, point, made = _replicates(spark, d, replace(SPEC, sex=sex, min_race_count=10, min_field=20), PRODUCTION)
        sides[sex] = cells, point, made
    hi = min(fan.horizon(cells) for cells, _, _ in sides.values())
    parts = {s: fan.split(fan.curves_by_run(made, fan.grid(spark, hi))) for s, (_, _, made) in sides.items()}
    drifts = {s: fan.drift_inputs(cells, point) for s, (cells, point, _) in sides.items()}
    return fan.identifiability(parts["M"], parts["W"], drifts["M"], drifts["W"], REPLICATES, ENTRY_AGES)


@query()
def rk_career_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Descriptors of the career curve with intervals over the replicates of rk_aging_fan."""
    cells, _, made = _replicates(spark, d, SPEC, replace(PRODUCTION, drift=False))
    return fan.descriptors(fan.curves_by_run(made, fan.grid(spark, fan.horizon(cells), 400)))


# ---- selection of forms and of the spread of drifts


def _form_fits(spark: SparkSession, d: str) -> DataFrame:
    forms = {"none-8": full.baseline(8.0), "none-inf": full.baseline(math.inf)} | full.candidates()
    key = (tables.core_fingerprint(spark, d), SPEC.key, SEED, sorted(forms))
    marked = slices.cut(inference.folds(tables.cached_slice(spark, d, SPEC), 5, SEED))
    return tables.cached(spark, "form-fits", key, lambda: full.form_fits(marked, 5, forms))


@query()
def rs_form_selection(spark: SparkSession, d: str) -> DataFrame:
    """All 54 forms of the career curve, and none, by cross-validation: held-out scores over five folds, the fit to all cells, and the best form of
    each noise law; forms fitted alone give the same figures in the tests."""
    fits = _form_fits(spark, d)
    scores = selection.rollup(fits.filter("fold is not null").withColumnRenamed("form", "nu")).withColumnRenamed("nu", "form")
    whole = fits.filter("fold is null").select("form", "loglik", (2 * F.col("n_params") - 2 * F.col("loglik")).alias("aic"), "n_params", "n_iter", "converged")
    law = F.substring_index("form", "-", -1)
    best = scores.groupBy(law.alias("law")).agg(F.max_by("form", "mean").alias("best"))
    out = scores.drop("near_best").join(whole, "form").withColumn("law", law).join(F.broadcast(best), "law")  # two laws
    bic = rounded(F.col("n_params") * F.log("n") - 2 * F.col("loglik"), 2)
    return out.select("form", "n", "total", "mean", "se", "rmse", rounded(F.col("loglik"), 3).alias("loglik"), "n_params", rounded(F.col("aic"), 2).alias("aic"), bic.alias("bic"), "converged", (F.col("form") == F.col("best")).alias("best"))


@query()
def rs_form_folds(spark: SparkSession, d: str) -> DataFrame:
    """The held-out scores of rs_form_selection fold by fold."""
    return _form_fits(spark, d).filter("fold is not null").select("form", "fold", "n", "n_orphans", rounded(F.col("logdensity"), 3).alias("logdensity"), rounded(F.col("rmse")).alias("rmse"))


#: The laws walked from Gaussian to heavy tails.
NU_GRID = [math.inf, 30.0, 15.0, 10.0, 8.0, 6.0, 5.0, 4.0, 3.0]


@query()
def rs_nu_refined(spark: SparkSession, d: str) -> DataFrame:
    """Held-out log density a cell of each law walked, warm from the one before, and of those tried between the neighbours of the best; compared with
    cold fits in the tests."""
    marked = slices.cut(inference.folds(tables.cached_slice(spark, d, SPEC), 5, SEED))
    best, _, path = selection.refine_nu(marked, 5, NU_GRID)
    rows = [("inf" if math.isinf(nu) else f"{nu:.3f}", x, n, nu == best) for nu, x, n in path.scores]
    return spark.createDataFrame(rows, "nu string, score double, sweeps long, best boolean").select("nu", rounded(F.col("score")).alias("score"), "sweeps", "best")


#: Published multiples of the fitted prior variance and published starts of it; whole decades besides, for an estimate that is nearly nothing.
MULTIPLES = (1 / 100, 1 / 30, 1 / 10, 1 / 3, 1 / 2, 1.0, 2.0, 3.0, 10.0, 30.0, 100.0)
DECADES = (1e-7, 1e-6, 1e-5, 1e-4, 1e-3, 1e-2)
STARTS = (1e-8, 1e-7, 1e-6, 1e-5, 1e-4, 1e-3, 1e-2, 1e-1)


def _omega_rows(fits, names: list[str], knots: tuple[float, ...], mean_ae: float, cells: DataFrame, point: full.FullFit) -> DataFrame:  # noqa: ANN001
    """Metrics by run, with how far the curves lie from those of run 0."""
    spark, k = cells.sparkSession, point.n_basis
    n_params = full.n_params(point) - point.fits.athletes.filter("pv > 0").count()
    rows = [(run, "career" if j < k else "entry", j if j < k else j - k, float(x)) for run, t in fits.theta.items() for j, x in enumerate(t)]
    made = fan.Replicates(point.config, knots, mean_ae, spark.createDataFrame(rows, "run_id long, block string, k int, value double"), fits.scales)
    curves = fan.curves_by_run(made, fan.grid(spark, fan.horizon(cells)))
    base = curves.filter("run_id = 0").select("point", F.col("career").alias("c0"), F.col("fan").alias("f0"))
    gap = curves.join(F.broadcast(base), "point").groupBy("run_id").agg(F.max(F.abs(F.col("career") - F.col("c0"))).alias("career_dev"), F.max(10 * F.abs(F.col("fan") - F.col("f0"))).alias("entry_dev"))  # a grid
    return full.omega_metrics(fits, n_params).join(gap, "run_id")


_OMEGA_COLUMNS = {"data_loglik": 2, "log_ml": 2, "edf_d": 2, "aic": 2, "bic": 2, "d_sd": 7, "frac_improver": 4, "frac_credible": 4, "corr_du": 4, "sigma2": 8, "corr_u": 6, "corr_v": 6, "max_dv": 5, "rms_dv": 6, "career_dev": 5, "entry_dev": 5}


@query()
def rs_omega_refits(spark: SparkSession, d: str) -> DataFrame:
    """The spread of drifts held at published multiples of its estimate and at whole decades, everything else refitted to convergence each time, as runs of one plan beside
    the free fit (run 0); refits with the same values in NumPy agree in the tests."""
    cells, point = tables.cached_slice(spark, d, SPEC), _full(spark, d, "omega", PRODUCTION)
    free = float(point.fits.scales.first()["omega2"])
    multiples = (1.0, *MULTIPLES, *(x / free for x in DECADES))
    fits, *rest = full.omega_refits(cells, PRODUCTION, [free * m for m in multiples], [False] + [True] * (len(multiples) - 1), point)
    out = _omega_rows(fits, *rest, cells, point)
    multiple = F.get(F.array(*map(F.lit, multiples)), F.col("run_id").cast("int"))
    columns = (rounded(F.col(c), digits).alias(c) for c, digits in _OMEGA_COLUMNS.items())
    return out.select((F.col("run_id") == 0).alias("free"), rounded(F.log10(multiple), 4).alias("log10_multiple"), rounded(F.log10("omega2"), 4).alias("log10_omega2"), "n_eligible", *columns, "converged")


@query()
def rs_omega_starts(spark: SparkSession, d: str) -> DataFrame:
    """The free fit begun at published prior variances, and (run 0) at a ten-thousandth of the noise: all should end at one."""
    cells, point, aging = tables.cached_slice(spark, d, SPEC), _full(spark, d, "omega", PRODUCTION), _full(spark, d, "aging", full.aging(8.0))
    starts = (aging.fits.sigma2 / 1e4, *STARTS)
    fits, *rest = full.omega_refits(cells, replace(PRODUCTION, loglik_tol=1e-12), list(starts), [False] * len(starts), aging)
    out = _omega_rows(fits, *rest, cells, point)
    start = F.log10(F.get(F.array(*map(F.lit, starts)), F.col("run_id").cast("int")))
    base = out.filter("run_id = 0").select(F.col("log_ml").alias("log_ml0"))
    out = out.crossJoin(F.broadcast(base))  # one row
    return out.select((F.col("run_id") == 0).alias("reference"), rounded(start, 3).alias("log10_start"), rounded(F.log10("omega2"), 3).alias("log10_omega2"), (F.abs(F.col("log_ml") - F.col("log_ml0")) < 0.05).alias("same"), rounded(F.col("log_ml"), 2).alias("log_ml"), "converged")


# ---- wrong identities

#: Runs of each operation and rate in the registered queries; a parameter of the operator, 50 in the published study.
MISMATCH_RUNS = 2
RATES = [0.001, 0.002, 0.005, 0.01, 0.02, 0.05, 0.1]
OPERATIONS = ["break", "join", "both"]


def _sweep(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(races of all runs, the fit without errors); the runs stay in a ledger, to which a longer sweep adds."""
    people = adapter.athletes(spark, d)
    cells, _, v = _fitted(spark, d)
    cells = cells.join(people.select("athlete_id", slices.yob_mid().alias("yob")), "athlete_id")
    signature = {"core": tables.core_fingerprint(spark, d), "spec": SPEC.key, "nu": NU, "seed": SEED}
    ledger = Ledger(spark, f"{shared_dir(spark)}/paceline-mismatch-{signature['core']}-{SPEC.key}", signature, mismatch.KEYS)
    races = mismatch.sweep(ledger, cells, people, OPERATIONS, RATES, MISMATCH_RUNS, SEED, SPEC, v, NU, sigma2=_sigma2(spark, d))
    return races.filter(F.col("run_id") <= MISMATCH_RUNS), v


@query()
def sn_mismatch(spark: SparkSession, d: str) -> DataFrame:
    """Refits under broken, joined and both kinds of wrong identities, at the published rates, by chunks of runs kept in a ledger."""
    return mismatch.shifts(*_sweep(spark, d))


@query()
def sn_mismatch_summary(spark: SparkSession, d: str) -> DataFrame:
    """Rank agreement, bias, spread against the bootstrap's, realised rates and the rate at which they meet, from the runs of sn_mismatch; compared
    with NumPy in the tests."""
    races, v = _sweep(spark, d)
    spread = _boot(spark, d)[1].groupBy("race_id").agg(F.stddev_samp("v").alias("boot_sd"))
    out = mismatch.summary(races, v, spread)
    digits = {"record_frac": 5, "athlete_rate": 5, "p_star": 4}
    counts = ["op", "n_runs", "n_ratio"]
    return out.select(*counts, "p", *(rounded(F.col(c), digits.get(c, 5)).alias(c) for c in out.columns if c not in (*counts, "p")))


@query()
def sn_mismatch_races(spark: SparkSession, d: str) -> DataFrame:
    """Race by race the bias and the spread that wrong identities bring."""
    races, v = _sweep(spark, d)
    spread = _boot(spark, d)[1].groupBy("race_id").agg(F.stddev_samp("v").alias("boot_sd"))
    out = mismatch.by_race(races, v, spread)
    return out.select("op", "p", "race_id", *(rounded(F.col(c)).alias(c) for c in ("v_point", "dv_mean", "dv_sd", "boot_sd", "ratio")), "n_runs")


# ---- many starts, and regressions


def _starts(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """trace, agreement and scales of the Student-t fit from seven starts, made once."""
    made: dict[str, DataFrame] = {}

    def of(name: str) -> DataFrame:
        if not made:
            fits, kinds = full.traced_starts(tables.cached_slice(spark, d, SPEC), full.baseline(NU))
            made.update(trace=full.trace_table(fits, kinds), agreement=full.path_agreement(fits), scales=fits.scales)
        return made[name]

    key = (tables.core_fingerprint(spark, d), SPEC.key, NU)
    return {n: tables.cached(spark, f"starts-{n}", key, lambda n=n: of(n)) for n in ("trace", "agreement", "scales")}


@query()
def nm_start_traces(spark: SparkSession, d: str) -> DataFrame:
    """Log likelihood and scale after every sweep from the mean start, four random ones, a warm one and one through a law between."""
    trace = _starts(spark, d)["trace"]
    return trace.select("run_id", "kind", "sweep", rounded(F.col("loglik"), 3).alias("loglik"), rounded(F.col("sigma2"), 7).alias("sigma2"))


@query()
def nm_start_spread(spark: SparkSession, d: str) -> DataFrame:
    """How far the starts end from the best of them, in likelihood and in race effects, and after how many sweeps."""
    starts = _starts(spark, d)
    last = starts["agreement"].groupBy("run_id").agg(F.max_by("max_gap", "sweep").alias("max_gap"), F.max_by("pearson", "sweep").alias("pearson"))
    kinds = starts["trace"].groupBy("run_id").agg(F.first("kind").alias("kind"))
    top = starts["scales"].agg(F.max("loglik").alias("top"))
    out = starts["scales"].join(last, "run_id").join(kinds, "run_id").crossJoin(F.broadcast(top))  # one row
    return out.select("run_id", "kind", (F.col("top") - F.col("loglik") < 1e-3).alias("same_loglik"), (F.col("max_gap") < 1e-6).alias("same_effects"), rounded(F.col("pearson"), 9).alias("pearson"), "converged")


@query()
def rs_path_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Race effects after each sweep of each start against the end of the best: correlations, mean and largest gap."""
    return _starts(spark, d)["agreement"].select("run_id", "sweep", *(rounded(F.col(c), 5).alias(c) for c in ("pearson", "spearman", "mae", "max_gap")))


@query()
def rg_cluster_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Difficulty on weather with errors robust to series by CR0, CR1 and CR2 and t intervals; compared with whole matrices in the tests."""
    data = _weather(spark, d)
    out = regression.cluster_intervals(data, "v", ["temp", "gain"], "series_key")
    return out.select("kind", "term", *(rounded(F.col(c)).alias(c) for c in ("beta", "se", "lo", "hi")), "dof")


DRAWS = 2000
_U = hash_uniform_sql(SEED, "run", "race_id")
_TWO = "(pow(r1, 2) + pow(r2, 2) - 2 * r1 * r2 * r12) / (1 - pow(r12, 2))"
_CORR = lambda a, b: f"((sw * s{a}{b} - s{a} * s{b}) / sqrt((sw * s{a}{a} - s{a} * s{a}) * (sw * s{b}{b} - s{b} * s{b})))"


@query(
    f"""SELECT target, "set", any_value(n) n, {_r('any_value(x) FILTER (run = 0)')} r2, {_r('quantile_cont(x, 0.025) FILTER (run > 0)')} lo, {_r('quantile_cont(x, 0.975) FILTER (run > 0)')} hi
FROM (SELECT target, run, n, unnest(['temp', 'gain', 'both']) "set", unnest([pow(r1, 2), pow(r2, 2), {_TWO}]) x FROM (
  SELECT target, run, n, {_CORR('y', 't')} r1, {_CORR('y', 'g')} r2, {_CORR('t', 'g')} r12 FROM sums)) GROUP BY 1, 2""",
    f"""{_FITTED}, {_COV}, rows_ AS MATERIALIZED (SELECT race_id, v, m, temp t, gain g FROM v2 JOIN cov USING (race_id) JOIN (SELECT race_id, avg(y) m FROM cells GROUP BY 1) USING (race_id) WHERE gain IS NOT NULL),
drawn AS (SELECT *, CASE WHEN run = 0 THEN 1.0 ELSE {" + ".join(f"({_U} > {c!r})::INT" for c in regression.POISSON_STEPS)} END w FROM rows_, (SELECT unnest(range(0, {DRAWS + 1}))::BIGINT run)),
long AS (SELECT 'v' target, run, w, v y, t, g FROM drawn UNION ALL SELECT 'mean_y', run, w, m, t, g FROM drawn),
sums AS (SELECT target, run, (SELECT count(*) FROM rows_) n, sum(w) sw, sum(w * y) sy, sum(w * t) st, sum(w * g) sg, sum(w * y * y) syy, sum(w * t * t) stt, sum(w * g * g) sgg, sum(w * y * t) syt, sum(w * y * g) syg, sum(w * t * g) stg FROM long GROUP BY 1, 2)""",
)
def rg_r2_sets(spark: SparkSession, d: str) -> DataFrame:
    """R2 of difficulty and of mean log time on each set of covariates, with intervals over 2,000 resampled tables."""
    means = tables.cached_slice(spark, d, SPEC).groupBy("race_id").agg(F.avg("y").alias("mean_y"))
    rows = slices.cut(_fitted(spark, d)[2].join(_covariates(spark, d).select("race_id", "temp", "gain"), "race_id").join(means, "race_id"))
    out = regression.r2_intervals(rows, "race_id", ["v", "mean_y"], {"temp": ["temp"], "gain": ["gain"], "both": ["temp", "gain"]}, DRAWS, SEED)
    return out.select("target", "set", "n", *(rounded(F.col(c)).alias(c) for c in ("r2", "lo", "hi")))


# ---- left-out groups, freed of the gauge

#: What drifts are priced at, the prior spread of rs_drift_descriptors.
OMEGA = 0.01
_GAUGE = f"""{_BOOT}, runs AS{_LEFT.partition("runs AS")[2]},
g1 AS (SELECT left_out, race_id, kv.v - v2.v dv, {_X} x, coalesce(country = left_out, false) home FROM kv JOIN v2 USING (race_id) JOIN competitions USING (race_id)),
g2 AS (SELECT *, x - avg(x) OVER (PARTITION BY left_out) c FROM g1),
g3 AS (SELECT *, c * c - avg(c * c) OVER w - regr_slope(c * c, c) OVER w * c q FROM g2 WINDOW w AS (PARTITION BY left_out)),
g4 AS (SELECT *, avg(dv) OVER w m, regr_slope(dv, c) OVER w slope, regr_slope(dv, q) OVER w bend FROM g3 WINDOW w AS (PARTITION BY left_out)),
g5 AS MATERIALIZED (SELECT *, dv - m - slope * c - bend * q rest FROM g4),
b1 AS MATERIALIZED (SELECT left_out, run_id, race_id, home, boot.v - avg(boot.v) OVER w - regr_slope(boot.v, c) OVER w * c - regr_slope(boot.v, q) OVER w * q rest
  FROM g3 JOIN boot USING (race_id) WINDOW w AS (PARTITION BY left_out, run_id)),
sd AS (SELECT left_out, race_id, stddev_samp(rest) sd FROM b1 GROUP BY 1, 2),
hs AS (SELECT left_out, stddev_samp(h) sd_home FROM (SELECT left_out, run_id, avg(rest) h FROM b1 WHERE home GROUP BY 1, 2) GROUP BY 1),
debut AS (SELECT stddev_pop(x) s FROM (SELECT min({_X}) x FROM cells GROUP BY athlete_id)),
summed AS (SELECT left_out, count(*) n, count(*) FILTER (home) n_home, any_value(slope) slope, any_value(bend) bend, var_pop(m + slope * c) / var_pop(dv) share_affine, var_pop(bend * q) / var_pop(dv) share_quadratic,
  var_pop(rest) / var_pop(dv) share_rest, median(abs(dv)) median_shift, median(abs(rest)) median_rest, median(abs(rest) / sd) ratio_median, avg((abs(rest) / sd > 2)::INT) frac_above_two,
  avg(dv) FILTER (home) home_shift, avg(rest) FILTER (home) home_rest, avg(rest) FILTER (NOT home) away_rest, {OMEGA} / (2 * any_value(s)) * abs(avg(q) FILTER (home)) home_priced
  FROM g5 JOIN sd USING (left_out, race_id), debut GROUP BY left_out),
judged AS (SELECT *, home_rest / sd_home z_home FROM summed LEFT JOIN hs USING (left_out))"""
_GAUGE_COLUMNS = {"slope": 7, "bend": 8, "share_affine": 5, "share_quadratic": 5, "share_rest": 5, "median_shift": 6, "median_rest": 6, "ratio_median": 4, "frac_above_two": 4, "home_shift": 6, "home_rest": 6, "away_rest": 6, "z_home": 3, "home_priced": 5}


@query(
    f"""SELECT left_out, n, n_home, {", ".join(f"{_r(c, digits)} {c}" for c, digits in _GAUGE_COLUMNS.items())},
CASE WHEN n_home = 0 THEN 'no home' WHEN z_home IS NULL THEN 'point only' WHEN abs(z_home) <= 2 THEN 'noise' WHEN abs(home_rest) <= home_priced THEN 'signal*' ELSE 'signal' END verdict FROM judged""",
    _GAUGE,
)
def sn_country_gauge(spark: SparkSession, d: str) -> DataFrame:
    """What leaving a country's athletes out moves beyond what no fit can know, at races in that country and away, against the replicates."""
    cells, _, v = _fitted(spark, d)
    races = adapter.competitions(spark, d)
    x = F.datediff("date", F.lit("2000-01-01").cast("date")) / 365.25
    refits = _countries_out(spark, d)
    home = races.select(F.col("country").alias("left_out"), "race_id")
    moved = slices.cut(gauge.split_shifts(refits, v, races.select("race_id", x.alias("x")), home))
    rests = slices.cut(gauge.replicate_rests(moved, _boot(spark, d)[1]))
    debut = cells.groupBy("athlete_id").agg(F.min(x).alias("x")).agg(F.stddev_pop("x")).first()[0] or 0.0
    out = gauge.summary(moved, rests, OMEGA, float(debut))
    return out.select("left_out", "n", "n_home", *(rounded(F.col(c), digits).alias(c) for c, digits in _GAUGE_COLUMNS.items()), "verdict")
