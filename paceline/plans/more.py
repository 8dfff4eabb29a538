"""Further registered queries: selection, curves, covariates, sensitivity and set operations."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paceline.functions.scalars import horner, rounded
from paceline.functions.scalars import hash_uniform_sql as hashed
from paceline.operators import curves, inference, model, regression, selection, sensitivity, slices
from paceline.plans.queries import _BOOT, _FIN, _FITTED, _FOLDS, _RESIDUALS, _SLICE, _X, NU, SEED, SPEC, _boot, _fitted, _r, _residuals, _sigma2, fit_sql, query
from paceline.sources import adapter, tables

NUS = [math.inf, 15.0, 8.0, 4.0]


def _sql_density(nu: float, s2: float | str) -> str:
    if math.isinf(nu):
        return f"-0.5 * (ln(2 * pi()) + ln({s2}) + r * r / {s2})"
    const = math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(nu * math.pi)
    return f"{const!r} - 0.5 * ln({s2}) - {(nu + 1) / 2} * ln(1 + r * r / ({nu} * {s2}))"


_NU_OF = "CASE " + " ".join(f"WHEN run_id // 5 = {i} THEN {'1' if math.isinf(n) else f'{n + 1} / ({n} + r * r / s2)'}" for i, n in enumerate(NUS)) + " END"
_SCORED = f"""RECURSIVE {_SLICE}, f AS MATERIALIZED ({_FOLDS}),
tr AS MATERIALIZED (SELECT c * 5 + out_ run_id, athlete_id, race_id, y, 1.0::DOUBLE g FROM f, (SELECT unnest(range(5))::BIGINT out_), (SELECT unnest(range({len(NUS)}))::BIGINT c) WHERE fold <> out_),
{fit_sql("tr", "cv", _NU_OF, 40)},
s AS MATERIALIZED (SELECT s.run_id, f.fold, s2, y - u - v r FROM f JOIN (SELECT run_id, any_value(s2) s2 FROM cv GROUP BY 1) s ON s.run_id % 5 = fold
  JOIN (SELECT run_id, id athlete_id, x u FROM cv WHERE k = 'u') a ON a.run_id = s.run_id AND a.athlete_id = f.athlete_id
  JOIN (SELECT run_id, id race_id, x v FROM cv WHERE k = 'v') b ON b.run_id = s.run_id AND b.race_id = f.race_id),
per AS ({" UNION ALL ".join(f"SELECT '{'inf' if math.isinf(n) else f'{n:g}'}' nu, fold, count(*) n, sqrt(avg(r * r)) rmse, sum({_sql_density(n, 's2')}) l FROM s WHERE run_id // 5 = {i} GROUP BY fold" for i, n in enumerate(NUS))}),
roll AS (SELECT nu, sum(n)::BIGINT n, sum(l) total, avg(l / n) mean, stddev_samp(l / n) / sqrt(count(*)) se, sqrt(sum(rmse * rmse * n) / sum(n)) rmse FROM per GROUP BY nu)"""


def _scores(spark: SparkSession, d: str) -> DataFrame:
    marked = slices.cut(inference.folds(tables.cached_slice(spark, d, SPEC), 5, SEED))
    key = (tables.core_fingerprint(spark, d), SPEC.key, tuple(map(str, NUS)), SEED)
    return tables.cached(spark, "nu-scores", key, lambda: selection.cross_validate(marked, 5, NUS))


@query(
    f"""SELECT nu, n, {_r('total', 3)} total, {_r('mean')} mean, {_r('se')} se, {_r('rmse')} rmse, mean >= (SELECT max(mean) - arg_max(se, mean) FROM roll) near_best FROM roll""",
    _SCORED,
)
def rs_nu_selection(spark: SparkSession, d: str) -> DataFrame:
    return selection.rollup(_scores(spark, d))


@query(
    f"""SELECT {_r('avg(x)')} gain, {_r('avg(x) / (stddev_samp(x) / sqrt(count(*)))', 3)} z FROM (SELECT a.l / a.n - b.l / b.n x FROM per a JOIN per b USING (fold) WHERE a.nu = '8' AND b.nu = 'inf')""",
    _SCORED,
)
def rs_paired_z(spark: SparkSession, d: str) -> DataFrame:
    return selection.paired_z(_scores(spark, d), "8", "inf")


@query(
    f"""SELECT {", ".join(f"{_r(f'quantile_cont(a_n, {0.05 + 0.9 * i / 2!r})')} k{i + 1}" for i in range(3))} FROM cells WHERE a_n > 0""",
    _SLICE,
)
def nm_knots(spark: SparkSession, d: str) -> DataFrame:
    got = curves.knots(tables.cached_slice(spark, d, SPEC), 4)
    return spark.range(1).select(*(rounded(F.lit(x)).alias(f"k{i}") for i, x in enumerate(got) if i))


def _sql_spline(knots: list[float]) -> list[str]:
    cube = lambda k: f"pow(greatest(a_n - {k}, 0), 3)"
    last, before = knots[-1], knots[-2]
    part = lambda k: f"({cube(k)} - {cube(last)}) / {last - k}"
    return ["a_n", *(f"({part(k)} - {part(before)})" for k in knots[:-2])]


_KNOTS = [0.0, 1.5, 3.0, 5.0]
_B = _sql_spline(_KNOTS)


@query(" UNION ALL ".join(f"SELECT {i} i, {j} j, {_r(f'sum({_B[i]} * {_B[j]})', 2)} \"value\" FROM cells" for i in range(3) for j in range(i, 3)), _SLICE)
def nm_spline_gram(spark: SparkSession, d: str) -> DataFrame:
    return curves.gram(tables.cached_slice(spark, d, SPEC), _KNOTS).select("i", "j", rounded(F.col("value"), 2).alias("value"))


_CURVE = [0.02, -0.03, 0.006, -0.0002]


@query(
    f"""SELECT {_r('arg_min(x, f)')} peak_x, {_r('min(f)')} peak_f, {_r('(SELECT min(x0 - f0 * (x - x0) / (f - f0)) FROM s WHERE x0 >= (SELECT arg_min(x, f) FROM c) AND f0 < 0 AND f >= 0)')} break_even,
(SELECT count(*) FILTER (sign(f - f0) * sign(f0 - f00) < 0) FROM s) turns, {_r('arg_max(f, k)')} last_f FROM c""",
    f"""c AS (SELECT k, x, {_CURVE[0]} + x * ({_CURVE[1]} + x * ({_CURVE[2]} + x * {_CURVE[3]})) f FROM (SELECT k, k * (30.0 / 240) x FROM (SELECT unnest(range(241)) k))),
s AS (SELECT k, x, f, lag(f) OVER (ORDER BY k) f0, lag(x) OVER (ORDER BY k) x0, lag(f, 2) OVER (ORDER BY k) f00 FROM c)""",
)
def rk_curve_shape(spark: SparkSession, d: str) -> DataFrame:
    return curves.shape_metrics(curves.grid(spark, 0.0, 30.0, 241), horner(F.col("x"), _CURVE))


@query(
    f"""SELECT k, {_r("avg(exp(-0.5 * pow((v - x) / h, 2))) / (h * sqrt(2 * pi()))")} density FROM (SELECT v, stddev_samp(v) OVER () * pow(count(*) OVER (), -0.2) h FROM v2),
(SELECT k, -0.3 + k * (0.6 / 20) x FROM (SELECT unnest(range(21))::BIGINT k)) GROUP BY k, h""",
    _FITTED,
)
def rs_kde(spark: SparkSession, d: str) -> DataFrame:
    v = slices.cut(_fitted(spark, d)[2])
    return curves.kernel_density(v, "v", curves.grid(spark, -0.3, 0.3, 21)).select("k", rounded(F.col("density")).alias("density"))


_SLOPES = f"""{_RESIDUALS}, slopes AS (SELECT athlete_id, count(*) n, sum(a_til * r) / s2 / (sum(a_til * a_til) / s2 + 1 / 1e-4) d FROM res, scale GROUP BY athlete_id, s2),
aged AS (SELECT s.*, a_e FROM slopes s JOIN (SELECT DISTINCT athlete_id, a_e FROM cells) USING (athlete_id)),
edges AS (SELECT list_sort(list_distinct([{", ".join(f"quantile_cont(a_e, {i / 5})" for i in range(6))}])) e FROM aged),
binned AS (SELECT *, CASE WHEN a_e IS NOT NULL THEN least(len(list_filter(e, lambda q: q <= a_e)), len(e) - 1) - 1 END::BIGINT bin FROM aged, edges)"""


@query(f"SELECT bin, count(*) n, {_r('avg(d)', 9)} mean_d FROM binned GROUP BY bin", _SLOPES)
def rs_entry_age_bins(spark: SparkSession, d: str) -> DataFrame:
    slopes = inference.drift_slopes(_residuals(spark, d), 1e-4, _sigma2(spark, d))
    ages = tables.cached_slice(spark, d, SPEC).select("athlete_id", "a_e").distinct()
    binned = curves.quantile_bins(slices.cut(slopes.join(ages, "athlete_id")), "a_e", 5)
    return binned.groupBy("bin").agg(F.count("*").alias("n"), rounded(F.avg("d"), 9).alias("mean_d"))


@query(f"SELECT race_id, {_r('avg(d * a_til)', 9)} delta FROM res JOIN slopes USING (athlete_id) GROUP BY race_id", _SLOPES)
def rs_delta_eb(spark: SparkSession, d: str) -> DataFrame:
    rest = slices.cut(_residuals(spark, d))
    slopes = inference.drift_slopes(rest, 1e-4, _sigma2(spark, d))
    return rest.join(slopes, "athlete_id").groupBy("race_id").agg(rounded(F.avg(F.col("d") * F.col("a_til")), 9).alias("delta"))


@query(
    f"SELECT run_id, {_r('sum(g * d) / sum(g)', 9)} mean_d, {_r('sqrt(sum(g * d * d) / sum(g) - pow(sum(g * d) / sum(g), 2))', 7)} sd_d FROM slopes JOIN g USING (athlete_id) GROUP BY run_id",
    f"""{_BOOT}, res AS (SELECT athlete_id, race_id, a_n - avg(a_n) OVER (PARTITION BY athlete_id) a_til, y - u - v r FROM cells JOIN u2 USING (athlete_id) JOIN v2 USING (race_id)),
slopes AS (SELECT athlete_id, sum(a_til * r) / s2 / (sum(a_til * a_til) / s2 + 1 / 1e-4) d FROM res, scale GROUP BY athlete_id, s2)""",
)
def rs_drift_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    slopes = slices.cut(inference.drift_slopes(_residuals(spark, d), 1e-4, _sigma2(spark, d)))
    drawn = slopes.join(inference.bootstrap_weights(slopes, 12, SEED), "athlete_id")
    mean = F.sum(F.col("g") * F.col("d")) / F.sum("g")
    square = F.sum(F.col("g") * F.col("d") * F.col("d")) / F.sum("g")
    return drawn.groupBy("run_id").agg(rounded(mean, 9).alias("mean_d"), rounded(F.sqrt(square - mean * mean), 7).alias("sd_d"))


@query(
    f"""SELECT {_r('2 * k - 2 * l', 2)} aic, {_r('k * ln(n) - 2 * l', 2)} bic FROM (SELECT count(*) n, -0.5 * count(*) * (ln(2 * pi()) + ln(avg(r * r)) + 1) l,
count(DISTINCT athlete_id) + count(DISTINCT race_id) - 1 + 1 k FROM res)""",
    _RESIDUALS,
)
def nm_information(spark: SparkSession, d: str) -> DataFrame:
    got = _residuals(spark, d).agg(F.count("*").alias("n"), F.avg(F.col("r") ** 2).alias("s2"), F.count_distinct("athlete_id").alias("i"), F.count_distinct("race_id").alias("j")).first()
    loglik = -0.5 * got["n"] * (math.log(2 * math.pi) + math.log(got["s2"]) + 1)
    aic, bic = model.information_criteria(loglik, got["n"], got["i"] + got["j"] - 1 + 1)
    return spark.range(1).select(rounded(F.lit(aic), 2).alias("aic"), rounded(F.lit(bic), 2).alias("bic"))


@query(
    f"""SELECT race_id, {_r('v - avg(v) OVER () - regr_slope(v, x) OVER () * (x - avg(x) OVER ())')} v FROM (SELECT race_id, v, {_X} x FROM v2 JOIN competitions USING (race_id))""",
    _FITTED,
)
def nm_gauge(spark: SparkSession, d: str) -> DataFrame:
    cells, u, v = _fitted(spark, d)
    got = model.gauge_beta0(u, v, cells, adapter.competitions(spark, d).select("race_id", "date"))
    return got[1].select("race_id", rounded(F.col("v")).alias("v"))


@query()
def nm_anderson(spark: SparkSession, d: str) -> DataFrame:
    """Converged Gaussian race effects; checked against long plain iteration in the tests."""
    races, _, _ = model.anderson(tables.cached_slice(spark, d, SPEC), fitter=model.FitConfig(max_iter=12, tol=1e-8))
    return races.select("race_id", rounded(F.col("v")).alias("v"))


_COV = """cov AS (SELECT race_id, series_key, country, "year", (5 + (race_id * 37) % 211 / 10.0)::DOUBLE temp, CASE WHEN race_id % 11 <> 0 THEN ((race_id * 53) % 307)::DOUBLE END gain FROM competitions)"""


def _covariates(spark: SparkSession, d: str) -> DataFrame:
    gain = F.when(F.col("race_id") % 11 != 0, ((F.col("race_id") * 53) % 307).cast("double"))
    return adapter.competitions(spark, d).select(
        "race_id", "series_key", "country", "year", (5 + (F.col("race_id") * 37) % 211 / 10.0).cast("double").alias("temp"), gain.alias("gain")
    )


@query(
    f"""SELECT v2.race_id, coalesce(series_key, 'unknown') series_key, coalesce("year", 0)::INTEGER "year", {_r('temp', 3)} temp, {_r('gain', 3)} gain,
{_r('(gain - avg(gain) OVER ()) / stddev_pop(gain) OVER ()')} z_gain, series_key || '#' || coalesce((race_id % 4)::VARCHAR, '<NA>') course FROM v2 LEFT JOIN cov USING (race_id)""",
    f"{_FITTED}, {_COV}",
)
def jn_covariates(spark: SparkSession, d: str) -> DataFrame:
    joined = slices.cut(_fitted(spark, d)[2].join(_covariates(spark, d), "race_id", "left"))
    scale = joined.agg(F.avg("gain").alias("m"), F.stddev_pop("gain").alias("s"))
    return joined.crossJoin(F.broadcast(scale)).select(  # one row
        "race_id", F.coalesce("series_key", F.lit("unknown")).alias("series_key"), F.coalesce("year", F.lit(0)).cast("int").alias("year"), rounded(F.col("temp"), 3).alias("temp"),
        rounded(F.col("gain"), 3).alias("gain"), rounded((F.col("gain") - F.col("m")) / F.col("s")).alias("z_gain"),
        F.concat_ws("#", "series_key", F.coalesce((F.col("race_id") % 4).cast("string"), F.lit("<NA>"))).alias("course"),
    )


@query(
    f"SELECT race_id, {_r('v - b * (temp - avg(temp) OVER ())')} v_corr FROM (SELECT race_id, v, temp, regr_slope(v, temp) OVER () b FROM v2 JOIN cov USING (race_id))",
    f"{_FITTED}, {_COV}",
)
def rg_weather_corrected(spark: SparkSession, d: str) -> DataFrame:
    joined = slices.cut(_fitted(spark, d)[2].join(_covariates(spark, d).select("race_id", "temp"), "race_id"))
    line = joined.agg(F.regr_slope("v", "temp").alias("b"), F.avg("temp").alias("m"))
    return joined.crossJoin(F.broadcast(line)).select("race_id", rounded(F.col("v") - F.col("b") * (F.col("temp") - F.col("m"))).alias("v_corr"))  # one row


@query(
    f"""SELECT {_r("regr_slope(y, q)")} beta, {_r('regr_r2(y, q)')} r2_left FROM (SELECT v - regr_intercept(v, temp) OVER () - regr_slope(v, temp) OVER () * temp y,
gain - regr_intercept(gain, temp) OVER () - regr_slope(gain, temp) OVER () * temp q FROM v2 JOIN cov USING (race_id) WHERE gain IS NOT NULL)""",
    f"{_FITTED}, {_COV}",
)
def rg_two_covariates(spark: SparkSession, d: str) -> DataFrame:
    joined = slices.cut(_fitted(spark, d)[2].join(_covariates(spark, d).select("race_id", "temp", "gain"), "race_id"))
    both, one = regression.ols(joined, "v", ["temp", "gain"]), regression.ols(joined.dropna(), "v", ["temp"])
    return spark.range(1).select(rounded(F.lit(float(both["beta"][2]))).alias("beta"), rounded(F.lit(float((both["r2"] - one["r2"]) / (1 - one["r2"])))).alias("r2_left"))


@query(
    f"""SELECT race_id, {_r('avg(y - u) FILTER (sex = $$M$$)')} m, {_r('avg(y - u) FILTER (sex = $$W$$)')} w FROM cells JOIN u2 USING (athlete_id) JOIN athletes USING (athlete_id) GROUP BY race_id""",
    _FITTED,
)
def jn_wide_slices(spark: SparkSession, d: str) -> DataFrame:
    cells, u, _ = _fitted(spark, d)
    joined = cells.join(u, "athlete_id").join(adapter.athletes(spark, d).select("athlete_id", "sex"), "athlete_id").withColumn("r", F.col("y") - F.col("u"))
    men, women = (joined.filter(F.col("sex") == s).groupBy("race_id").agg(rounded(F.avg("r")).alias(s.lower())) for s in "MW")
    return men.join(women, "race_id", "full_outer")


@query(
    f"""SELECT race_id, country, (row_number() OVER (ORDER BY country, race_id) - 1 + 2 * (dense_rank() OVER (ORDER BY country) - 1))::BIGINT place, {_r('v')} v FROM v2 JOIN competitions USING (race_id)""",
    _FITTED,
)
def wn_axis(spark: SparkSession, d: str) -> DataFrame:
    joined = _fitted(spark, d)[2].join(adapter.competitions(spark, d).select("race_id", "country"), "race_id")
    place = F.row_number().over(Window.orderBy("country", "race_id")) - 1 + 2 * (F.dense_rank().over(Window.orderBy("country")) - 1)
    return joined.select("race_id", "country", place.cast("long").alias("place"), rounded(F.col("v")).alias("v"))


@query(
    """(SELECT athlete_id FROM results WHERE race_id % 10000 = 1996 INTERSECT SELECT athlete_id FROM results WHERE race_id % 10000 = 1999)
EXCEPT SELECT athlete_id FROM athletes WHERE sex = 'W'"""
)
def so_set_operations(spark: SparkSession, d: str) -> DataFrame:
    ids = lambda year: adapter.results(spark, d).filter(F.col("race_id") % 10000 == year).select("athlete_id")
    return ids(1996).intersect(ids(1999)).subtract(adapter.athletes(spark, d).filter("sex = 'W'").select("athlete_id"))


# ---- sensitivity

_CH, _AT = hashed(SEED, "athlete_id"), hashed(SEED + 1, "athlete_id")


@query(
    f"""SELECT CASE WHEN {_CH} < 0.2 AND n > 1 AND pos > 1 + floor({_AT} * (n - 1)) THEN -1 - athlete_id ELSE athlete_id END athlete_id, race_id FROM (
SELECT athlete_id, race_id, count(*) OVER (PARTITION BY athlete_id) n, row_number() OVER (PARTITION BY athlete_id ORDER BY "date", race_id) pos FROM cells)""",
    _SLICE,
)
def sn_break(spark: SparkSession, d: str) -> DataFrame:
    return sensitivity.break_labels(tables.cached_slice(spark, d, SPEC), 0.2, SEED).select("athlete_id", "race_id")


@query()
def sn_join(spark: SparkSession, d: str) -> DataFrame:
    """Greedy random matching has no SQL; its constraints are checked in the tests."""
    athletes, races, results = adapter.athletes(spark, d), adapter.competitions(spark, d), adapter.results(spark, d)
    cells = slices.finishes(athletes, races, results, SPEC).withColumn("y", F.ln("t"))
    return sensitivity.join_labels(cells, athletes, 0.05, SEED)


_LEFT_PASS = """k{n} AS (SELECT * FROM (SELECT * FROM k{m} QUALIFY count(*) OVER (PARTITION BY left_out, athlete_id) >= 25)
  QUALIFY count(*) OVER (PARTITION BY left_out, race_id) >= 60)"""
_LEFT = f"""{_FITTED}, runs AS (SELECT country left_out, row_number() OVER (ORDER BY country)::BIGINT run_id FROM (SELECT DISTINCT country FROM cells JOIN athletes USING (athlete_id) WHERE country IS NOT NULL)),
k0 AS (SELECT left_out, run_id, athlete_id, race_id, ln(t) y FROM p0 JOIN athletes USING (athlete_id), runs WHERE country IS DISTINCT FROM left_out),
{", ".join(_LEFT_PASS.format(n=n, m=n - 1) for n in range(1, 16))},
kept AS MATERIALIZED (SELECT run_id, athlete_id, race_id, y, 1.0::DOUBLE g FROM k15),
{fit_sql("kept", "left_fit")},
kv AS (SELECT left_out, id race_id, x v FROM left_fit JOIN runs USING (run_id) WHERE k = 'v')"""


@query(
    f"""SELECT left_out, count(*) n, {_r('avg(abs(kv.v - v2.v))')} mean_shift, {_r('max(abs(kv.v - v2.v))')} max_shift, {_r('corr(kv.v, v2.v)', 5)} r FROM kv JOIN v2 USING (race_id) GROUP BY left_out""",
    _LEFT,
)
def sn_leave_country_out(spark: SparkSession, d: str) -> DataFrame:
    """Every country of the slice's athletes in turn left out of the whole preparation and fit, against the fit with all."""
    return sensitivity.leave_out_summary(_countries_out(spark, d), _fitted(spark, d)[2])


def _countries_out(spark: SparkSession, d: str) -> DataFrame:
    """left_out, race_id, v: the refits without each country, made once."""
    cells, _, v = _fitted(spark, d)
    people = adapter.athletes(spark, d)

    def made() -> DataFrame:
        countries = slices.cut(cells.join(people, "athlete_id").select("country").dropna().distinct())
        timed = slices.finishes(people, adapter.competitions(spark, d), adapter.results(spark, d), SPEC).join(people.select("athlete_id", "country"), "athlete_id")
        return sensitivity.leave_out_refits(timed, "country", countries, SPEC, v, NU)

    return tables.cached(spark, "countries-out", (tables.core_fingerprint(spark, d), SPEC.key, NU), made)


_U = hashed(SEED, "athlete_id", "race_id")


@query(f"""SELECT athlete_id, race_id, {", ".join(f"{_r(f'{c} * exp(0.02 * (2 * {_U} - 1))', 3)} {c}" for c in ("chip_time_sec", "gun_time_sec"))} FROM results""")
def sn_twin(spark: SparkSession, d: str) -> DataFrame:
    return sensitivity.twin(adapter.results(spark, d), 0.02, SEED)


@query("""SELECT country, chr((65 + n // 676 % 26)::INT) || chr((65 + n // 26 % 26)::INT) || chr((65 + n % 26)::INT) code FROM (SELECT country, row_number() OVER (ORDER BY md5(country), country) - 1 n
FROM (SELECT DISTINCT country FROM competitions))""")
def fn_country_codes(spark: SparkSession, d: str) -> DataFrame:
    return sensitivity.country_codes(adapter.competitions(spark, d))


@query(
    """SELECT athlete_id, count(*) n, max(date_diff('day', first_, "date")) AS "days" FROM (SELECT athlete_id, "date", min("date") OVER (PARTITION BY athlete_id) first_ FROM p0) GROUP BY 1
HAVING count(*) >= 30 AND max(date_diff('day', first_, "date")) / 365.25 >= 4""",
    f"{adapter.CTES},\n{_FIN}",
)
def fl_drift_eligible(spark: SparkSession, d: str) -> DataFrame:
    cells = slices.finishes(adapter.athletes(spark, d), adapter.competitions(spark, d), adapter.results(spark, d), SPEC)
    days = F.datediff(F.max("date"), F.min("date"))
    return cells.groupBy("athlete_id").agg(F.count("*").alias("n"), days.cast("long").alias("days")).filter((F.col("n") >= 30) & (F.col("days") / 365.25 >= 4))


@query(
    f"""SELECT race_id, {_r('quantile_cont(a.v - b.v, 0.05)')} lo, {_r('quantile_cont(a.v - b.v, 0.95)')} hi FROM boot a JOIN boot b USING (race_id) WHERE b.run_id = (a.run_id * 5) % 12 + 1 GROUP BY race_id""",
    _BOOT,
)
def jn_paired_draws(spark: SparkSession, d: str) -> DataFrame:
    boot = _boot(spark, d)[1]
    b = boot.select(F.col("run_id").alias("other"), "race_id", F.col("v").alias("w"))
    pairs = boot.withColumn("other", (F.col("run_id") * 5) % 12 + 1).join(b, ["other", "race_id"])
    x = F.col("v") - F.col("w")
    return pairs.groupBy("race_id").agg(rounded(F.percentile(x, 0.05)).alias("lo"), rounded(F.percentile(x, 0.95)).alias("hi"))


_OMEGAS = [1e-6, 1e-5, 1e-4, 1e-3, 1e-2]


@query(
    f"""SELECT omega2, {_r('sum(-0.5 * ln(1 + omega2 * sxx / s2) + 0.5 * pow(sxy / s2, 2) / (sxx / s2 + 1 / omega2))', 4)} loglik
FROM scale, (SELECT sum(a_til * r) sxy, sum(a_til * a_til) sxx FROM res GROUP BY athlete_id), (SELECT unnest([{", ".join(f"{o!r}::DOUBLE" for o in _OMEGAS)}]) omega2) GROUP BY omega2""",
    _RESIDUALS,
)
def rs_omega_profile(spark: SparkSession, d: str) -> DataFrame:
    return inference.omega_profile(_residuals(spark, d), _OMEGAS, _sigma2(spark, d))


def _weather(spark: SparkSession, d: str) -> DataFrame:
    return slices.cut(_fitted(spark, d)[2].join(_covariates(spark, d).select("race_id", "series_key", "temp", "gain"), "race_id"))


@query()
def rg_cluster_cr2(spark: SparkSession, d: str) -> DataFrame:
    """CR2 needs a matrix root for each cluster; compared with a direct computation in the tests."""
    data = _weather(spark, d)
    return regression.as_table(data, regression.cluster_robust_cr2(data, "v", ["temp", "gain"], "series_key"), ["temp", "gain"])


@query()
def rg_random_intercept(spark: SparkSession, d: str) -> DataFrame:
    """Restricted likelihood; compared with a direct computation in the tests."""
    data = _weather(spark, d)
    return regression.as_table(data, regression.random_intercept(data, "v", ["temp", "gain"], "series_key"), ["temp", "gain"])
