"""Registered queries of the full model, persistence, and the remaining filters, windows, functions, regressions and rankings."""

from __future__ import annotations

import math
import statistics

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paceline.functions import scalars
from paceline.functions.scalars import rounded
from paceline.operators import describe, engine, full, inference, ranking, regression, selection, sensitivity, slices, synthetic
from paceline.operators.slices import SliceSpec
from paceline.plans.more import _COV, _covariates, _scores, _SCORED
from paceline.plans.queries import _BOOT, _FIN, _FITTED, _MEDIANS, _RESIDUALS, _SEX_FITS, _SLICE, _X, NU, SEED, SPEC, _boot, _core, _fitted, _point, _r, _residuals, _sex_fits, _sigma2, fit_sql, query
from paceline.sources import adapter, registry, report, tables
from paceline.sources.scratch import shared_dir

# ---- filters


@query(f"SELECT athlete_id, race_id, {_r('r')} r FROM res WHERE abs(r) <= 0.4", _RESIDUALS)
def fl_residual_trim(spark: SparkSession, d: str) -> DataFrame:
    rest = _residuals(spark, d)
    return rest.filter(F.abs("r") <= 0.4).select("athlete_id", "race_id", rounded(F.col("r")).alias("r"))


@query(f"SELECT athlete_id, any_value({_r('a_e', 4)}) a_e FROM cells WHERE a_e BETWEEN 10 AND 45 GROUP BY athlete_id", _SLICE)
def fl_entry_age(spark: SparkSession, d: str) -> DataFrame:
    """Entry ages within a sane band; the reference's upper end of 90 keeps everybody here."""
    cells = tables.cached_slice(spark, d, SPEC)
    return cells.filter(F.col("a_e").between(10, 45)).groupBy("athlete_id").agg(rounded(F.first("a_e"), 4).alias("a_e"))


_SLOPED = f"""{_RESIDUALS}, slopes AS (SELECT athlete_id, count(*) n, max(a_til) - min(a_til) span, sum(a_til * r) / s2 / (sum(a_til * a_til) / s2 + 1 / 1e-4) d,
1 / (sum(a_til * a_til) / s2 + 1 / 1e-4) pv FROM res, scale GROUP BY athlete_id, s2)"""


def _slopes(spark: SparkSession, d: str) -> DataFrame:
    return inference.drift_slopes(_residuals(spark, d), 1e-4, _sigma2(spark, d))


@query(f"SELECT athlete_id, n, {_r('d', 8)} d, {_r('pv', 9)} pv FROM slopes WHERE n >= 40 AND span >= 3", _SLOPED)
def fl_persistence(spark: SparkSession, d: str) -> DataFrame:
    """Drifts of athletes with enough races over enough years."""
    spans = _residuals(spark, d).groupBy("athlete_id").agg((F.max("a_til") - F.min("a_til")).alias("span"))
    kept = _slopes(spark, d).join(spans, "athlete_id").filter("n >= 40 and span >= 3")
    return kept.select("athlete_id", "n", rounded(F.col("d"), 8).alias("d"), rounded(F.col("pv"), 9).alias("pv"))


def _with_point(spark: SparkSession, d: str) -> DataFrame:
    """Replicates, and the point fit as run 0."""
    v, boot = _boot(spark, d)
    return boot.select("run_id", "race_id", "v").unionByName(v.select(F.lit(0).cast("long").alias("run_id"), "race_id", "v"))


@query(f"SELECT race_id, count(*) n, {_r('stddev_samp(v)')} sd FROM (SELECT * FROM boot UNION ALL SELECT 0, race_id, v FROM v2) WHERE run_id > 0 GROUP BY race_id", _BOOT)
def fl_replicates(spark: SparkSession, d: str) -> DataFrame:
    return _with_point(spark, d).filter("run_id > 0").groupBy("race_id").agg(F.count("*").alias("n"), rounded(F.stddev_samp("v")).alias("sd"))


@query(f"SELECT {_r('avg(chip_time_sec)', 3)} chip_time_sec, {_r('avg(gun_time_sec)', 3)} gun_time_sec FROM results")
def fl_suffix_columns(spark: SparkSession, d: str) -> DataFrame:
    """Means of every column that is named as a time."""
    results = adapter.results(spark, d)
    return results.agg(*(rounded(F.avg(c), 3).alias(c) for c in scalars.with_suffix(results.columns, "_sec", "_pct")))


@query(f"SELECT race_id, {_r('sum(CASE WHEN a_n <= 3 THEN y ELSE 0 END) / sum(CASE WHEN a_n <= 3 THEN 1 ELSE 0 END)')} mean_y, count(*) n FROM cells GROUP BY race_id HAVING sum((a_n <= 3)::INT) > 0", _SLICE)
def fl_domain_weight(spark: SparkSession, d: str) -> DataFrame:
    """A cap on career age as a weight of zero: rows stay, their say goes."""
    w = F.when(F.col("a_n") <= 3, 1.0).otherwise(0.0)
    out = tables.cached_slice(spark, d, SPEC).groupBy("race_id").agg(F.sum(w).alias("w"), F.sum(w * F.col("y")).alias("s"), F.count("*").alias("n"))
    return out.filter("w > 0").select("race_id", rounded(F.col("s") / F.col("w")).alias("mean_y"), "n")


@query(
    """SELECT series_key, race_id, distance_m FROM (SELECT series_key, race_id, CASE WHEN race_id % 5 = 0 THEN 21097 ELSE 42195 END distance_m FROM competitions)
WHERE distance_m = 42195 QUALIFY row_number() OVER (PARTITION BY series_key ORDER BY race_id) = 1"""
)
def fl_distance(spark: SparkSession, d: str) -> DataFrame:
    """The first edition over the full distance of each series."""
    races = adapter.competitions(spark, d).withColumn("distance_m", F.when(F.col("race_id") % 5 == 0, 21097).otherwise(42195)).filter("distance_m = 42195")
    return races.groupBy("series_key").agg(F.min(F.struct("race_id", "distance_m")).alias("one")).select("series_key", "one.race_id", "one.distance_m")


# ---- joins and graphs

@query("SELECT (SELECT count(DISTINCT comp) FROM comp) = 1 connected, (SELECT count(DISTINCT comp) FROM comp) n_components", "RECURSIVE " + adapter.CTES + """,
p0 AS (SELECT r.athlete_id, r.race_id FROM results r JOIN customer ON c_custkey = athlete_id JOIN supplier ON s_suppkey = race_id // 10000 WHERE c_nationkey % 2 = s_nationkey % 2),
hub AS (SELECT DISTINCT race_id, min(race_id) OVER (PARTITION BY athlete_id) h FROM p0),
link AS (SELECT race_id a, h b FROM hub UNION SELECT h, race_id FROM hub),
reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
comp AS (SELECT a race_id, min(b) comp FROM reach GROUP BY a)""")  # fmt: skip
def jn_connected(spark: SparkSession, d: str) -> DataFrame:
    people = adapter.read(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("athlete_id"), "c_nationkey")
    series = adapter.read(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("s"), "s_nationkey")
    cells = adapter.results(spark, d).join(people, "athlete_id").join(series, F.floor(F.col("race_id") / 10000) == F.col("s"))
    labels = slices.race_components(slices.cut(cells.filter("c_nationkey % 2 = s_nationkey % 2").select("athlete_id", "race_id")))
    n = F.count_distinct("comp")
    return labels.agg((n == 1).alias("connected"), n.alias("n_components"))


@query(f"SELECT race_id, {_r('v2.v')} start FROM (SELECT DISTINCT race_id FROM cells JOIN athletes USING (athlete_id) WHERE sex = 'W') LEFT JOIN v2 USING (race_id)", _FITTED)
def jn_warm_start(spark: SparkSession, d: str) -> DataFrame:
    """Race effects of the whole as the start of a fit of some athletes."""
    cells, _, v = _fitted(spark, d)
    women = cells.join(adapter.athletes(spark, d).filter("sex = 'W'").select("athlete_id"), "athlete_id", "left_semi")
    return women.select("race_id").distinct().join(v, "race_id", "left").select("race_id", rounded(F.col("v")).alias("start"))


_SEXES = f"""{_FITTED}, sx AS (SELECT series_key, {{m}} contrast, count(*) n FROM (SELECT series_key, race_id, avg(y - u) FILTER (sex = 'M') m, avg(y - u) FILTER (sex = 'W') w
FROM cells JOIN u2 USING (athlete_id) JOIN athletes USING (athlete_id) JOIN competitions USING (race_id) GROUP BY 1, 2) WHERE m IS NOT NULL AND w IS NOT NULL GROUP BY series_key)"""


def _sex_contrast(spark: SparkSession, d: str) -> DataFrame:
    """Per series: the mean difference of the races' residual levels of men and women, and over how many races."""
    cells, u, _ = _fitted(spark, d)
    named = cells.join(u, "athlete_id").join(adapter.athletes(spark, d).select("athlete_id", "sex"), "athlete_id").join(adapter.competitions(spark, d).select("race_id", "series_key"), "race_id")
    r = F.col("y") - F.col("u")
    per = named.groupBy("series_key", "race_id").agg(F.avg(F.when(F.col("sex") == "M", r)).alias("m"), F.avg(F.when(F.col("sex") == "W", r)).alias("w"))
    return per.filter("m is not null and w is not null").groupBy("series_key").agg(F.avg(F.col("m") - F.col("w")).alias("contrast"), F.count("*").alias("n"))


@query(f"SELECT series_key, {_r('contrast')} contrast, coalesce(n, 0) n FROM (SELECT DISTINCT series_key FROM competitions) LEFT JOIN sx USING (series_key)", _SEXES.format(m="avg(m - w)"))
def jn_sex_contrast(spark: SparkSession, d: str) -> DataFrame:
    series = adapter.competitions(spark, d).select("series_key").distinct()
    return series.join(_sex_contrast(spark, d), "series_key", "left").select("series_key", rounded(F.col("contrast")).alias("contrast"), F.coalesce("n", F.lit(0)).alias("n"))


# ---- aggregates

_GRID = ["All", "wmm", "po10", "wa", "nyrr"]
_GRID_PASS = """g{n} AS (SELECT * FROM (SELECT * FROM g{m} QUALIFY count(*) OVER (PARTITION BY cohort, gender, athlete_id) >= {mrc}) QUALIFY count(*) OVER (PARTITION BY cohort, gender, race_id) >= 20)"""


@query(
    "SELECT cohort, gender, count(*) n_cells, count(DISTINCT athlete_id) n_athletes, count(DISTINCT race_id) n_races FROM g12 GROUP BY 1, 2",
    f"""{adapter.CTES}, {_FIN}, g0 AS (SELECT athlete_id, race_id, cohort, gender FROM p0 JOIN athletes a USING (athlete_id), (SELECT unnest(['All', 'wmm', 'po10', 'wa', 'nyrr']) cohort), (SELECT unnest(['B', 'M', 'W']) gender)
  WHERE CASE cohort WHEN 'wmm' THEN has_wmm WHEN 'po10' THEN has_po10 WHEN 'wa' THEN has_wa WHEN 'nyrr' THEN has_nyrr ELSE true END AND (gender = 'B' OR gender = sex)),
{", ".join(_GRID_PASS.format(n=n, m=n - 1, mrc=10) for n in range(1, 13))}""",
)
def ag_slice_grid(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of the slices of all cohorts and sexes, pruned as keys of one plan."""
    people = adapter.athletes(spark, d)
    cohorts = F.array_compact(F.array(F.lit("All"), *(F.when(F.col(f"has_{c}"), F.lit(c)) for c in _GRID[1:])))
    groups = people.select("athlete_id", F.explode(cohorts).alias("cohort"), F.array(F.lit("B"), "sex").alias("genders"))
    groups = groups.select("athlete_id", "cohort", F.explode("genders").alias("gender")).select("athlete_id", F.struct("cohort", "gender").alias("key"))
    spec = SliceSpec(min_race_count=10, min_field=20)
    cells = slices.finishes(*_core(spark, d), spec).join(groups, "athlete_id")
    return describe.slice_sizes(slices.prune(slices.keyed(cells, "key"), spec), "key").select("key.cohort", "key.gender", "n_cells", "n_athletes", "n_races")


@query(
    f"""SELECT nu, votes FROM (SELECT g.nu, count(*) votes FROM (SELECT unnest([15, 8, 4]) nu) g JOIN iv ON g.nu BETWEEN lo AND hi GROUP BY 1)
ORDER BY votes DESC, abs(nu - (SELECT avg(best) FROM iv)) LIMIT 1""",
    f"""{_SCORED}, fin AS (SELECT nu::INT nu, fold, l / n x FROM per WHERE nu <> 'inf'), b AS (SELECT fold, arg_max(nu, x) best, max(x) top FROM fin GROUP BY fold),
iv AS (SELECT fold, any_value(best) best, min(nu) lo, max(nu) hi FROM fin JOIN b USING (fold) WHERE x >= top - 0.001 GROUP BY fold)""",
)
def ag_nu_votes(spark: SparkSession, d: str) -> DataFrame:
    """The candidate in most intervals of near-best candidates, ties to the one nearest to the mean best."""
    scores = _scores(spark, d).filter("nu <> 'inf'").select(F.col("nu").cast("int").alias("nu"), "fold", (F.col("logdensity") / F.col("n")).alias("x"))
    return selection.votes(scores, 0.001, [15, 8, 4])


@query(f"SELECT sex, floor(a_e / 10)::INT * 10 age_group, count(*) n, {_r('avg(t)', 3)} mean_t FROM cells JOIN athletes USING (athlete_id) WHERE a_e IS NOT NULL GROUP BY 1, 2", _SLICE)
def fn_age_groups(spark: SparkSession, d: str) -> DataFrame:
    cells = tables.cached_slice(spark, d, SPEC).join(adapter.athletes(spark, d).select("athlete_id", "sex"), "athlete_id")
    return cells.filter("a_e is not null").groupBy("sex", scalars.age_group(F.col("a_e")).alias("age_group")).agg(F.count("*").alias("n"), rounded(F.avg("t"), 3).alias("mean_t"))


# ---- windows and sorts

@query("SELECT race_id, (row_number() OVER (ORDER BY first_, race_id) - 1)::BIGINT idx FROM (SELECT race_id, min(athlete_id) first_ FROM cells GROUP BY race_id)", _SLICE)
def wn_first_seen(spark: SparkSession, d: str) -> DataFrame:
    return slices.first_seen_index(tables.cached_slice(spark, d, SPEC), "race_id", "athlete_id", "idx")


@query("SELECT athlete_id, (row_number() OVER (ORDER BY athlete_id) - 1)::BIGINT row_idx FROM (SELECT DISTINCT athlete_id FROM results)")
def wn_dense_athletes(spark: SparkSession, d: str) -> DataFrame:
    return slices.dense_index(adapter.results(spark, d), "athlete_id", "row_idx")


@query(f"SELECT race_id, run_id, {_r('(v - lag(v) OVER w) / abs(lag(v) OVER w)', 4)} change FROM boot WINDOW w AS (PARTITION BY race_id ORDER BY run_id) QUALIFY abs(lag(v) OVER w) > 1e-3", _BOOT)
def wn_relative_change(spark: SparkSession, d: str) -> DataFrame:
    before = F.lag("v").over(Window.partitionBy("race_id").orderBy("run_id"))
    out = _boot(spark, d)[1].withColumn("v0", before).filter(F.abs("v0") > 1e-3)
    return out.select("race_id", "run_id", rounded((F.col("v") - F.col("v0")) / F.abs("v0"), 4).alias("change"))


@query(f"SELECT race_id, run_id, {_r('v')} v FROM boot QUALIFY row_number() OVER (PARTITION BY race_id ORDER BY run_id DESC) = 1", _BOOT)
def wn_last_run(spark: SparkSession, d: str) -> DataFrame:
    last = _boot(spark, d)[1].groupBy("race_id").agg(F.max_by(F.struct("run_id", "v"), "run_id").alias("x"))
    return last.select("race_id", "x.run_id", rounded(F.col("x.v")).alias("v"))


_SHARES = (0.05, 0.25, 0.5, 0.75, 0.95)


@query(
    " UNION ALL ".join(f"(SELECT {p}::DOUBLE p, race_id, {_r('v')} v FROM v2, (SELECT quantile_cont(v, {p}) q FROM v2) ORDER BY abs(v - q), race_id LIMIT 1)" for p in _SHARES),
    _FITTED,
)
def wn_percentile_rows(spark: SparkSession, d: str) -> DataFrame:
    """The races that stand nearest to some percentiles, none twice."""
    return ranking.percentile_rows(_fitted(spark, d)[2], "v", "race_id", _SHARES)


@query(
    f"""SELECT race_id, {_r('gain', 3)} gain, row_number() OVER (ORDER BY gain DESC NULLS LAST, race_id) place FROM v2 JOIN cov USING (race_id)""", f"{_FITTED}, {_COV}"
)
def wn_nulls_last(spark: SparkSession, d: str) -> DataFrame:
    joined = _fitted(spark, d)[2].join(_covariates(spark, d).select("race_id", "gain"), "race_id")
    placed = slices.row_places(joined, [F.col("gain").desc_nulls_last(), F.col("race_id").asc()], "place")
    return placed.select("race_id", rounded(F.col("gain"), 3).alias("gain"), "place")


@query(
    f"SELECT country, athlete_id, race_id, {_r('w')} w FROM (SELECT country, athlete_id, race_id, 9 / (8 + r * r / s2) w FROM res JOIN athletes USING (athlete_id), scale) WHERE w < 0.7 QUALIFY row_number() OVER (PARTITION BY country ORDER BY round(w, 9), athlete_id, race_id) <= 6",
    _RESIDUALS,
)
def sr_outliers(spark: SparkSession, d: str) -> DataFrame:
    """For each country the six cells that the fit trusts least."""
    w = scalars.irls_weight(F.col("r"), _sigma2(spark, d), NU)
    rest = _residuals(spark, d).join(adapter.athletes(spark, d).select("athlete_id", "country"), "athlete_id").withColumn("w", w).filter("w < 0.7")
    place = F.row_number().over(Window.partitionBy("country").orderBy(F.round("w", 9), "athlete_id", "race_id"))
    return rest.withColumn("place", place).filter("place <= 6").select("country", "athlete_id", "race_id", rounded(F.col("w")).alias("w"))


# ---- functions

@query(
    f"""SELECT race_id, format('{{:,}}', n) thousands, printf('%.1f%%', 100.0 * n / sum(n) OVER ()) share, lower(replace(series_key, '#', '-')) || '_' || lpad(("year" % 100)::VARCHAR, 2, '0') slug,
CASE WHEN chip > 0 THEN {_r('ln(chip)', 5)} END log_chip, CASE WHEN n % 7 = 0 THEN NULL ELSE {_r('1.0 / (n % 7)', 4)} END inv FROM (SELECT race_id, count(*) * 1000 n, min(chip_time_sec) chip FROM results GROUP BY 1) JOIN competitions USING (race_id)"""
)
def fn_formats(spark: SparkSession, d: str) -> DataFrame:
    per = adapter.results(spark, d).groupBy("race_id").agg((F.count("*") * 1000).alias("n"), F.min("chip_time_sec").alias("chip"))
    total = per.agg(F.sum("n").alias("total"))
    named = per.join(adapter.competitions(spark, d).select("race_id", "series_key", "year"), "race_id").crossJoin(F.broadcast(total))  # one row
    return named.select(
        "race_id", scalars.thousands(F.col("n")).alias("thousands"), scalars.percent_text(F.col("n") / F.col("total")).alias("share"),
        scalars.slug(F.col("series_key"), F.lpad((F.col("year") % 100).cast("string"), 2, "0")).alias("slug"),
        rounded(scalars.log_positive(F.col("chip")), 5).alias("log_chip"), rounded(scalars.finite(F.try_divide(F.lit(1.0), F.col("n") % 7)), 4).alias("inv"),
    )


@query("SELECT slug, split_part(slug, '_', 1) cohort, split_part(slug, '_', 2) sex, regexp_extract(slug, 'mrc([0-9]+)', 1)::INT mrc FROM (SELECT DISTINCT n_name || '_M_14-25_mrc' || n_nationkey slug FROM nation)")
def fn_slug_parts(spark: SparkSession, d: str) -> DataFrame:
    slug = F.concat("n_name", F.lit("_M_14-25_mrc"), F.col("n_nationkey").cast("string"))
    return adapter.read(spark, d, "nation").select(slug.alias("slug")).distinct().select("slug", *scalars.slug_parts(F.col("slug")))


_Z = statistics.NormalDist().inv_cdf(0.975)


@query(
    f"""SELECT n, {_r('r')} r, {_r(f'tanh(atanh(r) - {_Z!r} / sqrt(n - 3))')} lo, {_r(f'tanh(atanh(r) + {_Z!r} / sqrt(n - 3))')} hi, {_r('rho')} rho, {_r(f'tanh(atanh(rho) - {1.06 * _Z!r} / sqrt(n - 3))')} rho_lo,
{_r(f'tanh(atanh(rho) + {1.06 * _Z!r} / sqrt(n - 3))')} rho_hi FROM (SELECT count(*) n, corr(v, gain) r, corr(a, b) rho FROM (SELECT v, gain, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2 a,
rank() OVER (ORDER BY gain) + (count(*) OVER (PARTITION BY gain) - 1) / 2 b FROM v2 JOIN cov USING (race_id) WHERE gain IS NOT NULL))""",
    f"{_FITTED}, {_COV}",
)
def rg_screening(spark: SparkSession, d: str) -> DataFrame:
    """Pearson and Spearman correlation of difficulty with a covariate, with Fisher intervals."""
    joined = slices.cut(_fitted(spark, d)[2].join(_covariates(spark, d).select("race_id", "gain"), "race_id").dropna())
    return regression.screened(joined, "v", "gain")


# ---- the full model


def _full(spark: SparkSession, d: str, name: str, config: full.FullConfig, spec: SliceSpec = SPEC) -> full.FullFit:
    """The fit of a configuration to a slice, saved once under its identity."""
    path = f"{shared_dir(spark)}/paceline-{name}-{tables.core_fingerprint(spark, d)}-{registry.identity_key(spec, config)}"
    at, fs = tables.hadoop(spark, path + "/settings/_SUCCESS")
    if not fs.exists(at):
        registry.save_fit(spark, path, full.fit(tables.cached_slice(spark, d, spec), config))
    return registry.load_fit(spark, path)


@query()
def nm_fit_full(spark: SparkSession, d: str) -> DataFrame:
    """The production form with drift: career spline, varying entry-age terms, drift, Student-t noise, reliability weights, slope-zero
    gauge.  Compared with plain block updates in NumPy in the tests."""
    fitted = _full(spark, d, "full", full.FullConfig(8.0, "spline", gamma="varying", drift=True, reliability=2.0))
    return fitted.fits.races.select("race_id", rounded(F.col("v")).alias("v"))


@query()
def nm_full_terms(spark: SparkSession, d: str) -> DataFrame:
    """Coefficients, scales and degrees of freedom of the full model; tested with nm_fit_full."""
    fitted = _full(spark, d, "full", full.FullConfig(8.0, "spline", gamma="varying", drift=True, reliability=2.0))
    scale = fitted.fits.scales.first()
    rows = [(f"theta{k}", float(t)) for k, t in enumerate(fitted.theta)] + [("sigma2", scale["sigma2"]), ("omega2", scale["omega2"])]
    rows += [(f"dof_{k}", x) for k, x in full.effective_dof(fitted).items()] + [("n_params", float(full.n_params(fitted)))]
    return spark.createDataFrame(rows, "term string, value double").select("term", rounded(F.col("value"), 8).alias("value"))


@query(
    f"""SELECT race_id, {_r('avg(u + v)')} mean_yhat, {_r('sqrt(avg(pow(y - u - v, 2)))')} rmse, count(*) n FROM cells JOIN u2 USING (athlete_id) JOIN v2 USING (race_id) GROUP BY race_id""",
    _FITTED,
)
def nm_predict(spark: SparkSession, d: str) -> DataFrame:
    fit = _point(spark, d)
    fitted = full.FullFit(full.baseline(NU), (), 0.0, engine.np.zeros(0), engine.Fits(fit["races"], fit["athletes"], fit["scales"], {}))
    told = full.predict(tables.cached_slice(spark, d, SPEC), fitted)
    return told.groupBy("race_id").agg(rounded(F.avg("yhat")).alias("mean_yhat"), rounded(F.sqrt(F.avg((F.col("y") - F.col("yhat")) ** 2))).alias("rmse"), F.count("*").alias("n"))


@query("SELECT count(DISTINCT athlete_id) + count(DISTINCT race_id) - 1 AS u_v, count(DISTINCT athlete_id) + count(DISTINCT race_id) - 1 + 1 AS n_params FROM cells", _SLICE)
def nm_dof(spark: SparkSession, d: str) -> DataFrame:
    fit = _point(spark, d)
    fitted = full.FullFit(full.baseline(NU), (), 0.0, engine.np.zeros(0), engine.Fits(fit["races"], fit["athletes"], fit["scales"], {}))
    return spark.range(1).select(F.lit(int(full.effective_dof(fitted)["u_v"])).cast("long").alias("u_v"), F.lit(full.n_params(fitted)).cast("long").alias("n_params"))


@query()
def nm_career_curve(spark: SparkSession, d: str) -> DataFrame:
    """The production career curve and what ten years of entry age add, on a grid."""
    fitted = _full(spark, d, "aging", full.aging(8.0))
    points = full.curve_on_grid(spark, fitted, 7.0, 141)
    return points.select("k", rounded(F.col("a_n")).alias("a_n"), rounded(F.col("career")).alias("career"), rounded(F.col("entry")).alias("entry"))


@query()
def rk_career_descriptors(spark: SparkSession, d: str) -> DataFrame:
    return full.curve_descriptors(full.curve_on_grid(spark, _full(spark, d, "aging", full.aging(8.0)), 7.0, 400))


@query()
def nm_best_of_starts(spark: SparkSession, d: str) -> DataFrame:
    """Mean start and two random restarts of the Student-t fit; all should reach the same optimum."""
    _, table = full.best_of_starts(tables.cached_slice(spark, d, SPEC), full.baseline(NU))
    return table.select("run", rounded(F.col("loglik"), 3).alias("loglik"), (F.col("max_shift") < 1e-7).alias("same"))


@query(
    f"SELECT out_, count(*) n_cells, count(DISTINCT athlete_id) n_athletes, {_r('avg(a_n)')} mean_a_n FROM (SELECT athlete_id, race_id, a_n, 'W' out_ FROM cells JOIN athletes USING (athlete_id) WHERE sex = 'W') GROUP BY out_", _SLICE
)
def rs_subset(spark: SparkSession, d: str) -> DataFrame:
    """The giant component of the women's cells, with the career ages of the whole."""
    cells = tables.cached_slice(spark, d, SPEC).join(adapter.athletes(spark, d).select("athlete_id", "sex"), "athlete_id")
    part = slices.subset(cells, F.col("sex") == "W")
    return part.groupBy(F.col("sex").alias("out_")).agg(F.count("*").alias("n_cells"), F.count_distinct("athlete_id").alias("n_athletes"), rounded(F.avg("a_n")).alias("mean_a_n"))


# ---- persistence


@query(f"SELECT race_id, {_r('v')} v FROM v2", _FITTED)
def sc_fit_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Race effects of a fit that was saved and loaded again."""
    return _full(spark, d, "round", full.baseline(NU)).fits.races.select("race_id", rounded(F.col("v")).alias("v"))


#: DuckDB: the Gaussian fit beside the Student-t fit, and what the registry must say of three fits of the slice.
_REGISTERED = f"""{_FITTED}, {fit_sql("one", "plain", "1.0")},
sizes AS (SELECT count(DISTINCT athlete_id) n_athletes, count(DISTINCT race_id) n_races, count(*) n_cells FROM cells),
fits AS (SELECT 'ALL_B_00-99_mrc25' slug, * FROM (SELECT 'baseline_L2_anderson' stem, 'inf' nu, (SELECT any_value(s2) FROM plain) s2 UNION ALL SELECT 'baseline_nu8p00_anderson', '8.0', (SELECT s2 FROM scale)
  UNION ALL SELECT 'Ax_nu8p00_anderson', '8.0', NULL), sizes)"""


def _registry(spark: SparkSession, d: str) -> str:
    """A registry of fits of the slice, each fitted and saved once: Gaussian, Student-t, and with a career curve."""
    fits = {"round": full.baseline(math.inf), "point": full.baseline(NU), "aging": full.aging(8.0)}
    key = (tables.core_fingerprint(spark, d), *(registry.identity_key(SPEC, c) for c in fits.values()))
    path = f"{shared_dir(spark)}/paceline-registry-{'-'.join(key)}"
    at, fs = tables.hadoop(spark, path)
    if not fs.exists(at):
        registry.publish(spark, path, [registry.manifest(SPEC, _full(spark, d, n, c), "base", registry.fit_path("fits", SPEC, c)) for n, c in fits.items()])
    return path


@query("SELECT slug, stem, nu, n_athletes, n_races, n_cells FROM fits WHERE nu = '8.0'", _REGISTERED)
def sc_registry(spark: SparkSession, d: str) -> DataFrame:
    """Of the registered fits of the tables those with Student-t noise, and their sizes."""
    found = registry.query(spark, _registry(spark, d), model_nu="8.0", slug=["ALL_B_00-99_mrc25", "wmm_M_00-99_mrc25"])
    return found.select("slug", "stem", F.col("model_nu").alias("nu"), "n_athletes", "n_races", "n_cells")


@query(f"SELECT slug, stem, {_r('s2', 7)} sigma2 FROM fits WHERE stem LIKE 'baseline%'", _REGISTERED)
def fl_fit_names(spark: SparkSession, d: str) -> DataFrame:
    """Fits found by a pattern of their names, with their scales."""
    return registry.query(spark, _registry(spark, d), stem="baseline_*").select("slug", "stem", rounded(F.col("sigma2"), 7).alias("sigma2"))


@query("SELECT clash, differs, n_cells FROM (VALUES ('same fit', ''), ('same name', 'model_reliability')) t(clash, differs), sizes", _REGISTERED)
def sc_preflight(spark: SparkSession, d: str) -> DataFrame:
    """What stands in the way of a fit that is registered, and of one that differs in a setting the name does not tell; with the size of what is there."""
    path = _registry(spark, d)
    same = registry.preflight(spark, path, SPEC, full.baseline(8.0))
    near = registry.preflight(spark, path, SPEC, full.FullConfig(8.0, reliability=2.0))
    sizes = registry.query(spark, path).select("path", "n_cells")
    return same.unionByName(near).join(sizes, "path").select("clash", "differs", "n_cells")


@query(f"SELECT series_key, race_id, {_r('v')} v FROM v2 JOIN competitions USING (race_id)", _FITTED)
def sc_csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Per-race rows written as CSV and read back under a schema."""
    import uuid

    path = f"{shared_dir(spark)}/paceline-csv-{uuid.uuid4().hex}"
    rows = _fitted(spark, d)[2].join(adapter.competitions(spark, d).select("race_id", "series_key"), "race_id")
    rows.select("series_key", "race_id", rounded(F.col("v")).alias("v")).write.option("header", True).csv(path)
    return tables.rollup_csv(spark, path, "series_key string, race_id long, v double").drop("file")


# ---- permutation, omega and recovery

_T = """SELECT {k}, corr(x, v - cv - sv * "year") t FROM (SELECT {k}, delta - cd - sd * "year" x, v, "year", cv, sv FROM (SELECT {k}, race_id, delta, v, "year"::DOUBLE "year",
regr_slope(delta, "year") OVER ({p}) sd, regr_intercept(delta, "year") OVER ({p}) cd, regr_slope(v, "year") OVER ({p}) sv, regr_intercept(v, "year") OVER ({p}) cv
FROM {src} JOIN v2 USING (race_id) JOIN competitions USING (race_id))) GROUP BY {k}"""
DRAWS = 20


@query(
    f"""SELECT count(*) n_draws, {_r('any_value(o.t)', 5)} t_obs, {_r('avg(p.t)', 5)} null_mean, {_r('stddev_samp(p.t)', 5)} null_sd, {_r('(any_value(o.t) - avg(p.t)) / stddev_samp(p.t)', 3)} z,
{_r('(1 + count(*) FILTER (p.t >= o.t)) / (count(*) + 1)')} p_one, {_r('(1 + count(*) FILTER (abs(p.t) >= abs(o.t))) / (count(*) + 1)')} p_two FROM perm p, obs o""",
    f"""{_RESIDUALS}, m AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY k, athlete_id ORDER BY race_id) pos,
row_number() OVER (PARTITION BY k, athlete_id ORDER BY {scalars.hash_uniform_sql(SEED, "athlete_id", "k", "race_id")}, race_id) to_ FROM res, (SELECT unnest(range(1, {DRAWS + 1}))::BIGINT k)),
moved AS (SELECT 0::BIGINT k, athlete_id, race_id, a_til, r FROM res UNION ALL SELECT a.k, a.athlete_id, a.race_id, a.a_til, b.r FROM m a JOIN m b ON a.k = b.k AND a.athlete_id = b.athlete_id AND a.pos = b.to_),
deltas AS (SELECT k, race_id, coalesce(avg(CASE WHEN sxx > 1e-9 THEN sxy / sxx END * a_til), 0) delta FROM (
  SELECT *, sum(a_til * r) OVER p - a_til * r sxy, sum(a_til * a_til) OVER p - a_til * a_til sxx FROM moved WINDOW p AS (PARTITION BY k, athlete_id)) GROUP BY 1, 2),
t AS ({_T.format(k="k", p="PARTITION BY k", src="deltas")}), obs AS (SELECT t FROM t WHERE k = 0), perm AS (SELECT t FROM t WHERE k > 0)""",
)
def rs_permutation_null(spark: SparkSession, d: str) -> DataFrame:
    """Leave-one-out drift prices against difficulty, both freed of year: the observed correlation and its permutation null."""
    rest = slices.cut(_residuals(spark, d))
    years = adapter.competitions(spark, d).select("race_id", F.col("year").cast("double").alias("year"))
    return inference.permutation_null(rest, _fitted(spark, d)[2].join(years, "race_id"), DRAWS, SEED)


_OMEGAS = [10.0 ** (k / 2) for k in range(-14, -1)]


@query(
    f"""SELECT {_r('log10(arg_max(omega2, l))', 4)} log10_best, {_r('max(l)', 4)} best, {_r('max(l) - max(l) FILTER (log10(omega2) <= -6.0001)', 3)} drop_low, count(*) FILTER (l >= top - 2) n_near FROM (SELECT *, max(l) OVER () top FROM (
SELECT omega2, sum(-0.5 * ln(1 + omega2 * sxx / s2) + 0.5 * pow(sxy / s2, 2) / (sxx / s2 + 1 / omega2)) l FROM scale, (SELECT sum(a_til * r) sxy, sum(a_til * a_til) sxx FROM res GROUP BY athlete_id),
(SELECT unnest([{", ".join(f"{o!r}::DOUBLE" for o in _OMEGAS)}]) omega2) GROUP BY omega2))""",
    _RESIDUALS,
)
def rs_omega_summary(spark: SparkSession, d: str) -> DataFrame:
    """The best prior variance of drifts, what the low decades lose, and how many candidates are within two units."""
    profile = inference.omega_profile(_residuals(spark, d), _OMEGAS, _sigma2(spark, d))
    return selection.profile_summary(profile, "omega2", 1e-6, 2.0)


@query()
def rs_recovery(spark: SparkSession, d: str) -> DataFrame:
    """Synthetic tables of known truth fitted again: gauge-free correlations and scale ratios, by noise law."""
    out = None
    for nu in (math.inf, 6.0):
        truth = synthetic.generate(spark, 400, 40, 0.5, seed=2025, nu=nu)
        fit = engine.fit_runs(truth.cells, config=engine.EngineConfig(nu=nu))
        one = synthetic.recovery(truth, fit).withColumn("nu", F.lit("inf" if math.isinf(nu) else f"{nu:g}"))
        out = one if out is None else out.unionByName(one)
    return out


@query(
    f"""SELECT run_id, {_r('avg(abs(boot.v - v2.v))')} mae, {_r('max(abs(boot.v - v2.v))')} max_gap, {_r('corr(boot.v, v2.v)', 5)} pearson, {_r('corr(ra, rb)', 5)} spearman FROM (SELECT *, rank() OVER (PARTITION BY run_id ORDER BY v) ra FROM boot) boot
JOIN (SELECT *, rank() OVER (ORDER BY v) rb FROM v2) v2 USING (race_id) GROUP BY run_id""",
    _BOOT,
)
def rs_run_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Each run against the point fit: mean and largest gap, Pearson and Spearman correlation."""
    v, boot = _boot(spark, d)
    return ranking.run_agreement(boot, v)


# ---- regressions

_SD = f"""{_BOOT}, {_COV}, dat AS (SELECT v2.race_id, series_key, v2.v y, temp, "year", 1 / greatest(var, 1e-12) w0 FROM v2 JOIN cov USING (race_id) JOIN (SELECT race_id, var_samp(v) var FROM boot GROUP BY 1) USING (race_id)),
wd AS (SELECT *, w0 / avg(w0) OVER () w FROM dat),
wls AS (SELECT (sum(w) * sum(w * temp * y) - sum(w * temp) * sum(w * y)) / (sum(w) * sum(w * temp * temp) - pow(sum(w * temp), 2)) b, sum(w * y) / sum(w) my, sum(w * temp) / sum(w) mt FROM wd)"""


def _weighted(spark: SparkSession, d: str) -> DataFrame:
    """race_id, series_key, v, temp, year and the weight of each race, the inverse of its replicates' variance with mean one."""
    v, boot = _boot(spark, d)
    spread = boot.groupBy("race_id").agg(F.var_samp("v").alias("var"))
    joined = slices.cut(v.join(_covariates(spark, d).select("race_id", "series_key", "temp", "year"), "race_id").join(spread, "race_id").withColumn("w0", 1 / F.greatest("var", F.lit(1e-12))))
    mean = joined.agg(F.avg("w0").alias("m"))
    return slices.cut(joined.crossJoin(F.broadcast(mean)).withColumn("w", F.col("w0") / F.col("m")).drop("w0", "m", "var"))  # one row


@query(
    f"""SELECT 'OLS' kind, {_r('regr_slope(y, temp)', 7)} beta, {_r('regr_r2(y, temp)')} r2 FROM dat UNION ALL
SELECT 'WLS', {_r('any_value(b)', 7)}, {_r('1 - sum(w * pow(y - my - b * (temp - mt), 2)) / sum(w * pow(y - my, 2))')} FROM wd, wls""",
    _SD,
)
def rg_least_squares(spark: SparkSession, d: str) -> DataFrame:
    """The two of the four fits that SQL can follow; rg_four_fits has the robust ones too."""
    return regression.four_fits(_weighted(spark, d), "v", ["temp"], "w").filter("kind in ('OLS', 'WLS')").select("kind", rounded(F.col("beta"), 7).alias("beta"), rounded(F.col("r2")).alias("r2"))


@query()
def rg_four_fits(spark: SparkSession, d: str) -> DataFrame:
    """Least squares and Huber, with and without weights; Huber is compared with a direct computation in the tests."""
    return regression.four_fits(_weighted(spark, d), "v", ["temp"], "w").select("kind", rounded(F.col("beta"), 6).alias("beta"), rounded(F.col("r2"), 5).alias("r2"))


@query(
    f"""SELECT {_r('any_value(r2)')} r2, {_r('quantile_cont(b2, 0.025)')} lo, {_r('quantile_cont(b2, 0.975)')} hi FROM (SELECT regr_r2(y, temp) r2 FROM dat), (SELECT run_id, regr_r2(boot.v, temp) b2 FROM boot JOIN cov USING (race_id) GROUP BY 1)""",
    _SD,
)
def rg_r2_interval(spark: SparkSession, d: str) -> DataFrame:
    """R2 of difficulty on a covariate, with an interval over the replicates."""
    cov = _covariates(spark, d).select("race_id", "temp")
    per = _with_point(spark, d).join(cov, "race_id").groupBy("run_id").agg(F.regr_r2("v", "temp").alias("r2"))
    boot = F.when(F.col("run_id") > 0, F.col("r2"))
    return per.agg(rounded(F.max(F.when(F.col("run_id") == 0, F.col("r2")))).alias("r2"), rounded(F.percentile(boot, 0.025)).alias("lo"), rounded(F.percentile(boot, 0.975)).alias("hi"))


@query(
    f"""SELECT run_id, {_r('regr_slope(boot.v, temp)', 7)} slope FROM boot JOIN cov USING (race_id) GROUP BY run_id""",
    _SD,
)
def rg_replicate_slopes(spark: SparkSession, d: str) -> DataFrame:
    joined = _boot(spark, d)[1].join(_covariates(spark, d).select("race_id", "temp"), "race_id")
    return joined.groupBy("run_id").agg(rounded(F.regr_slope("v", "temp"), 7).alias("slope"))


_PS = [0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]


@query(
    " UNION ALL ".join(f"SELECT {p}::DOUBLE p, {_r(f'quantile_cont(z, {p})', 5)} empirical, {_r(repr(statistics.NormalDist().inv_cdf(p)), 5)} normal FROM zs" for p in _PS),
    f"{_RESIDUALS}, zs AS (SELECT r / sqrt(s2) z FROM res, scale)",
)
def rg_qq(spark: SparkSession, d: str) -> DataFrame:
    """Empirical against normal quantiles of standardised residuals."""
    z = _residuals(spark, d).select((F.col("r") / math.sqrt(_sigma2(spark, d))).alias("z"))
    return regression.qq(z, "z", _PS).select("p", rounded(F.col("empirical"), 5).alias("empirical"), rounded(F.col("normal"), 5).alias("normal"))


_QUAD = """SELECT *, x - avg(x) OVER () c FROM (SELECT race_id, {y} y, {x} x FROM {src})"""


@query(
    f"""SELECT {_r('any_value(a1)', 8)} slope, {_r('any_value(q)', 8)} curve, {_r('var_pop(a1 * c) / var_pop(y)')} share_linear, {_r('var_pop(q * o) / var_pop(y)')} share_curve, {_r('var_pop(y - a1 * c - q * o) / var_pop(y)')} share_rest FROM (
SELECT *, regr_slope(y, o) OVER () q FROM (SELECT *, regr_slope(y, c) OVER () a1, c * c - avg(c * c) OVER () - regr_slope(c * c, c) OVER () * c o FROM (SELECT race_id, y, x - avg(x) OVER () c FROM (
SELECT race_id, m - w y, {_X} x FROM (SELECT race_id, avg(y - u) FILTER (sex = 'M') m, avg(y - u) FILTER (sex = 'W') w FROM cells JOIN u2 USING (athlete_id) JOIN athletes USING (athlete_id) GROUP BY 1)
JOIN competitions USING (race_id) WHERE m IS NOT NULL AND w IS NOT NULL))))""",
    _FITTED,
)
def rg_date_decomposition(spark: SparkSession, d: str) -> DataFrame:
    """A contrast between the sexes by race: the part linear in the date, the orthogonal quadratic part, and what is identified."""
    cells, u, _ = _fitted(spark, d)
    named = cells.join(u, "athlete_id").join(adapter.athletes(spark, d).select("athlete_id", "sex"), "athlete_id")
    r = F.col("y") - F.col("u")
    per = named.groupBy("race_id").agg(F.avg(F.when(F.col("sex") == "M", r)).alias("m"), F.avg(F.when(F.col("sex") == "W", r)).alias("w")).dropna()
    dated = per.join(adapter.competitions(spark, d).select("race_id", "date"), "race_id")
    x = F.datediff("date", F.lit("2000-01-01").cast("date")) / 365.25
    return regression.date_decomposition(slices.cut(dated.select("race_id", (F.col("m") - F.col("w")).alias("y"), x.alias("x"))))


# ---- rankings

_WX = f"""{_BOOT}, {_COV}, bw AS (SELECT run_id, race_id, v - regr_slope(v, temp) OVER w * (temp - avg(temp) OVER w) v FROM boot JOIN cov USING (race_id) WINDOW w AS (PARTITION BY run_id)),
pw AS (SELECT race_id, v - regr_slope(v, temp) OVER () * (temp - avg(temp) OVER ()) v FROM v2 JOIN cov USING (race_id))"""


def _corrected(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(point, replicates) freed of a straight line in temperature, each run by its own."""
    both = regression.corrected(_with_point(spark, d).join(_covariates(spark, d).select("race_id", "temp"), "race_id"), "run_id", "v", "temp")
    both = slices.cut(both.select("run_id", "race_id", F.col("corrected").alias("v")))
    return both.filter("run_id = 0").drop("run_id"), both.filter("run_id > 0")


@query(
    f"""SELECT race_id, rank_slow, {_r('p')} p_top, n_boot FROM (SELECT race_id, avg((k <= 50)::INT) p, count(*) n_boot FROM (SELECT race_id, row_number() OVER (PARTITION BY run_id ORDER BY v DESC, race_id) k FROM bw) GROUP BY race_id)
JOIN (SELECT race_id, row_number() OVER (ORDER BY v DESC, race_id) rank_slow FROM pw) USING (race_id)""",
    _WX,
)
def rk_top_n_corrected(spark: SparkSession, d: str) -> DataFrame:
    return ranking.top_n(*_corrected(spark, d), 50).select("race_id", "rank_slow", "p_top", "n_boot")


@query(
    f"""SELECT series_key, {_r('m')} median_v, rank_slow FROM (SELECT series_key, median(v) m, row_number() OVER (ORDER BY median(v) DESC, series_key) rank_slow FROM pw JOIN competitions USING (race_id) GROUP BY 1 HAVING count(*) >= 3)""",
    _WX,
)
def rk_series_corrected(spark: SparkSession, d: str) -> DataFrame:
    return ranking.series_ranking(*_corrected(spark, d), adapter.competitions(spark, d), 3, 10).select("series_key", "median_v", "rank_slow")


@query(
    f"""SELECT series_key, {_r('p50')} boot_p50, {_r('p25')} boot_p25, {_r('p75')} boot_p75, {_r('min(m) FILTER (m >= p25 - 1.5 * (p75 - p25))')} whisker_lo, {_r('max(m) FILTER (m <= p75 + 1.5 * (p75 - p25))')} whisker_hi,
{_r('180 * (exp(p50) - 1)', 4)} AS "minutes", {_r('any_value(contrast)')} sex_contrast FROM (SELECT series_key, m, quantile_cont(m, 0.25) OVER w p25, quantile_cont(m, 0.5) OVER w p50, quantile_cont(m, 0.75) OVER w p75
FROM med WINDOW w AS (PARTITION BY series_key)) LEFT JOIN (SELECT series_key, avg(m - w) contrast FROM (SELECT series_key, race_id, avg(y - u) FILTER (sex = 'M') m, avg(y - u) FILTER (sex = 'W') w
FROM cells JOIN u2 USING (athlete_id) JOIN athletes USING (athlete_id) JOIN competitions USING (race_id) GROUP BY 1, 2) WHERE m IS NOT NULL AND w IS NOT NULL GROUP BY series_key) USING (series_key) GROUP BY series_key, p25, p50, p75""",
    _MEDIANS,
)
def rk_forest(spark: SparkSession, d: str) -> DataFrame:
    """Series by their replicates' medians: box, whiskers at data, minutes at three hours, contrast of the sexes."""
    medians = slices.cut(ranking.series_medians(_boot(spark, d)[1], adapter.competitions(spark, d), 3))
    return ranking.forest(medians, _sex_contrast(spark, d))


@query()
def rk_tiers(spark: SparkSession, d: str) -> DataFrame:
    """Tiers by a sweep from the fastest series; sequential by definition, tested on small cases."""
    races = adapter.competitions(spark, d)
    medians = slices.cut(ranking.series_medians(_boot(spark, d)[1], races, 3))
    return ranking.tiers(medians, 0.9)


_PAIR = f"{_BOOT}, q0 AS{_SEX_FITS.partition('q0 AS')[2]}"


@query(
    f"""SELECT {_r('sqrt(avg(pow(y, 2)))')} rms, {_r('any_value(sl) * sqrt(var_pop(x))')} shift_per_sd, {_r('avg(sd)')} boot_sd, abs(any_value(sl)) * sqrt(var_pop(x)) < avg(sd) hidden FROM (SELECT x, y, sd, regr_slope(y, x) OVER () sl FROM (
SELECT race_id, a.v - b.v y, {_X} x, sd FROM (SELECT race_id, v FROM sexes WHERE run_id = 1) a JOIN (SELECT race_id, v FROM sexes WHERE run_id = 2) b USING (race_id) JOIN competitions USING (race_id)
JOIN (SELECT race_id, stddev_samp(v) sd FROM boot GROUP BY 1) USING (race_id)))""",
    _PAIR,
)
def rk_contrast_identifiability(spark: SparkSession, d: str) -> DataFrame:
    """Whether the slope in date that the contrast of men's and women's fits may hide is below the replicates' spread."""
    boot, fits = _boot(spark, d)[1], _sex_fits(spark, d)
    dated = adapter.competitions(spark, d).select("race_id", (F.datediff("date", F.lit("2000-01-01").cast("date")) / 365.25).alias("x"))
    a, b = (fits[s].withColumnRenamed("v", n) for s, n in (("M", "va"), ("W", "vb")))
    spread = boot.groupBy("race_id").agg(F.stddev_samp("v").alias("sd"))
    joined = a.join(b, "race_id").join(dated, "race_id").join(spread, "race_id").withColumn("y", F.col("va") - F.col("vb"))
    shift = F.regr_slope("y", "x") * F.sqrt(F.var_pop("x"))
    return joined.agg(
        rounded(F.sqrt(F.avg(F.col("y") ** 2))).alias("rms"), rounded(shift).alias("shift_per_sd"), rounded(F.avg("sd")).alias("boot_sd"), (F.abs(shift) < F.avg("sd")).alias("hidden")
    )


@query()
def rk_term_grid(spark: SparkSession, d: str) -> DataFrame:
    """Log likelihood with and without career terms and drift: the gain of each, and their interaction."""
    forms = {"none": full.baseline(8.0), "aging": full.aging(8.0), "drift": full.drift(8.0, with_aging=False), "both": full.drift(8.0)}
    logs = {n: _full(spark, d, "grid", c).fits.scales.first()["loglik"] for n, c in forms.items()}
    gain = {"aging": logs["aging"] - logs["none"], "drift": logs["drift"] - logs["none"], "interaction": logs["both"] - logs["aging"] - logs["drift"] + logs["none"]}
    return spark.createDataFrame([(k, float(x)) for k, x in gain.items()], "term string, gain double").select("term", rounded(F.col("gain"), 3).alias("gain"))


# ---- sensitivity

_LOSO = f"""{_FITTED}, runs AS (SELECT series_key left_out, row_number() OVER (ORDER BY n DESC, series_key)::BIGINT run_id FROM (SELECT series_key, count(*) n FROM cells JOIN competitions USING (race_id) GROUP BY 1) ORDER BY n DESC, series_key LIMIT 10),
k0 AS (SELECT left_out, run_id, athlete_id, race_id, ln(t) y FROM p0 JOIN (SELECT race_id, series_key FROM competitions) USING (race_id), runs WHERE series_key <> left_out),
{", ".join(f"k{n} AS (SELECT * FROM (SELECT * FROM k{n - 1} QUALIFY count(*) OVER (PARTITION BY left_out, athlete_id) >= 25) QUALIFY count(*) OVER (PARTITION BY left_out, race_id) >= 60)" for n in range(1, 16))},
kept AS MATERIALIZED (SELECT run_id, athlete_id, race_id, y, 1.0::DOUBLE g FROM k15),
{fit_sql("kept", "left_fit")},
kv AS (SELECT left_out, id race_id, x v FROM left_fit JOIN runs USING (run_id) WHERE k = 'v')"""


@query(f"SELECT left_out, count(*) n, {_r('avg(abs(kv.v - v2.v))')} mean_shift, {_r('max(abs(kv.v - v2.v))')} max_shift, {_r('corr(kv.v, v2.v)', 5)} r FROM kv JOIN v2 USING (race_id) GROUP BY left_out", _LOSO)
def sn_leave_series_out(spark: SparkSession, d: str) -> DataFrame:
    """The ten largest series, each in turn left out of the whole preparation and fit (a top-k report, as published)."""
    cells, _, v = _fitted(spark, d)
    races = adapter.competitions(spark, d)
    largest = cells.join(races, "race_id").groupBy("series_key").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "series_key").limit(10)
    timed = slices.finishes(adapter.athletes(spark, d), races, adapter.results(spark, d), SPEC).join(races.select("race_id", "series_key"), "race_id")
    return sensitivity.leave_out_summary(sensitivity.leave_out_refits(timed, "series_key", slices.cut(largest), SPEC, v, NU), v)


@query(
    f"""SELECT run_id op, {_r('avg(abs(dv))')} mean_abs, {_r('sqrt(avg(dv * dv))')} rms, {_r('median(abs(dv))')} median_abs, {_r('180 * median(abs(dv))', 4)} median_minutes FROM (SELECT run_id, boot.v - v2.v dv FROM boot JOIN v2 USING (race_id)) GROUP BY run_id""",
    _BOOT,
)
def sn_shift_summary(spark: SparkSession, d: str) -> DataFrame:
    """What each run moved, in log and in minutes at three hours; the summary that sn_mismatch runs get, here over replicates."""
    v, boot = _boot(spark, d)
    return sensitivity.shift_summary(boot.withColumnRenamed("run_id", "op"), v)


@query(
    f"""SELECT athlete_id, race_id, {_r('t', 4)} t, n_races, best_so_far FROM (SELECT athlete_id, race_id, t, count(*) OVER (PARTITION BY athlete_id) n_races, t = min(t) OVER (PARTITION BY athlete_id ORDER BY "date", race_id) best_so_far FROM cells)
WHERE best_so_far""",
    _SLICE,
)
def sn_records(spark: SparkSession, d: str) -> DataFrame:
    """Personal records: finishes that no earlier finish of the athlete beat."""
    per = Window.partitionBy("athlete_id")
    cells = tables.cached_slice(spark, d, SPEC).withColumn("n_races", F.count("*").over(per)).withColumn("best_so_far", F.col("t") == F.min("t").over(per.orderBy("date", "race_id")))
    return cells.filter("best_so_far").select("athlete_id", "race_id", rounded(F.col("t"), 4).alias("t"), "n_races", "best_so_far")


@query(
    f"""SELECT (SELECT count(*) FROM cells) n_cells, (SELECT {_r('s2', 8)} FROM scale) sigma2, (SELECT arg_max(race_id, v) FROM v2) hardest, (SELECT arg_min(race_id, v) FROM v2) easiest, (SELECT {_r('stddev_samp(v)')} FROM v2) sd_v""",
    _FITTED,
)
def sn_headline_numbers(spark: SparkSession, d: str) -> DataFrame:
    """The few numbers a report quotes."""
    cells, _, v = _fitted(spark, d)
    own = v.agg(F.max_by("race_id", "v").alias("hardest"), F.min_by("race_id", "v").alias("easiest"), rounded(F.stddev_samp("v")).alias("sd_v"))
    return cells.agg(F.count("*").alias("n_cells")).crossJoin(own).select("n_cells", rounded(F.lit(_sigma2(spark, d)), 8).alias("sigma2"), "hardest", "easiest", "sd_v")  # one row each


# ---- more tables

_COIN = scalars.hash_uniform_sql(SEED + 2, "athlete_id", "race_id")
_BREAK = {
    "datecut": "pos > 1 + floor({at} * (n - 1))",
    "coin": f"{_COIN} < 0.5",
    "singleton": "pos = 1 + floor({at} * n)",
}


@query(
    " UNION ALL ".join(
        f"""SELECT '{mode}' AS "mode", CASE WHEN {scalars.hash_uniform_sql(SEED, "athlete_id")} < 0.2 AND n > 1 AND {rule.format(at=scalars.hash_uniform_sql(SEED + 1, "athlete_id"))} THEN -1 - athlete_id ELSE athlete_id END athlete_id, race_id FROM b"""
        for mode, rule in _BREAK.items()
    ),
    f"""{_SLICE}, b AS MATERIALIZED (SELECT athlete_id, race_id, count(*) OVER (PARTITION BY athlete_id) n, row_number() OVER (PARTITION BY athlete_id ORDER BY "date", race_id) pos FROM cells)""",
)
def sn_break_modes(spark: SparkSession, d: str) -> DataFrame:
    """A fifth of the athletes split at a date, by a coin for each race, or by one race."""
    cells = tables.cached_slice(spark, d, SPEC)
    parts = [sensitivity.break_labels(cells, 0.2, SEED, mode=m).select(F.lit(m).alias("mode"), "athlete_id", "race_id") for m in _BREAK]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"SELECT race_id, {_r('coalesce(m, 0)')} mean_r, coalesce(n, 0) n FROM competitions LEFT JOIN (SELECT race_id, avg(r) m, count(*) n FROM res GROUP BY 1) USING (race_id)", _RESIDUALS)
def ag_race_means(spark: SparkSession, d: str) -> DataFrame:
    """Mean residual of every race, 0 for races without cells."""
    per = _residuals(spark, d).groupBy("race_id").agg(F.avg("r").alias("m"), F.count("*").alias("n"))
    races = adapter.competitions(spark, d).select("race_id")
    return races.join(per, "race_id", "left").select("race_id", rounded(F.coalesce("m", F.lit(0.0))).alias("mean_r"), F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT coalesce((floor(a_e / 10)::INT * 10)::VARCHAR, 'unknown') age_group, least(floor((t - 7000) / 1450), 19)::BIGINT bin, count(*) n FROM cells WHERE t BETWEEN 7000 AND 36000 GROUP BY 1, 2", _SLICE)
def ag_age_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Finish times in bins, stacked by age group at entry; the last bin is closed."""
    group = F.coalesce(scalars.age_group(F.col("a_e")).cast("string"), F.lit("unknown"))
    return describe.histogram(tables.cached_slice(spark, d, SPEC).withColumn("age_group", group), "t", 7000, 36000, 20, "age_group")


@query(f"SELECT fold, arg_max(nu, l / n) best_nu, {_r('max(l / n)')} score FROM per GROUP BY fold", _SCORED)
def ag_best_per_fold(spark: SparkSession, d: str) -> DataFrame:
    per = F.col("logdensity") / F.col("n")
    return _scores(spark, d).groupBy("fold").agg(F.max_by("nu", per).alias("best_nu"), rounded(F.max(per)).alias("score"))


@query(
    f"""SELECT sex, count(*) n, {_r('sqrt(greatest(var_samp(d) - avg(pv), 0))', 8)} disatt_sd, {_r('corr(rd, ru)', 5)} spearman, {_r('CASE WHEN count(*) FILTER (n >= 40) >= 3 THEN corr(hd, hu) END', 5)} spearman_high,
CASE WHEN count(*) < 30 THEN 'too few' WHEN avg((d < 0)::INT) > 0.5 THEN 'mostly improving' ELSE 'mostly slowing' END verdict FROM (
SELECT *, rank() OVER (PARTITION BY sex ORDER BY d) rd, rank() OVER (PARTITION BY sex ORDER BY u) ru, CASE WHEN n >= 40 THEN rank() OVER (PARTITION BY sex, n >= 40 ORDER BY d) END hd,
CASE WHEN n >= 40 THEN rank() OVER (PARTITION BY sex, n >= 40 ORDER BY u) END hu FROM slopes JOIN u2 USING (athlete_id) JOIN athletes USING (athlete_id)) GROUP BY sex""",
    _SLOPED,
)
def rs_drift_by_sex(spark: SparkSession, d: str) -> DataFrame:
    """Spread of drifts and how they go with ability, for all and for athletes of many races."""
    _, u, _ = _fitted(spark, d)
    named = _slopes(spark, d).join(u, "athlete_id").join(adapter.athletes(spark, d).select("athlete_id", "sex"), "athlete_id")
    return inference.drift_with_ability(slices.cut(named), "sex", 40)


@query(
    f"""SELECT line FROM (SELECT 0 k, '| series | races | mean v |' line UNION ALL SELECT 1, '| --- | --- | --- |' UNION ALL SELECT 1 + row_number() OVER (ORDER BY v DESC, series_key), '| ' || series_key || ' | ' || n || ' | ' || printf('%.4f', v) || ' |'
FROM (SELECT series_key, count(*) n, avg(v) v FROM v2 JOIN competitions USING (race_id) GROUP BY 1 ORDER BY v DESC, series_key LIMIT 10))""",
    _FITTED,
)
def sc_report(spark: SparkSession, d: str) -> DataFrame:
    """The ten hardest series as the lines of a Markdown table (a top-k report)."""
    named = _fitted(spark, d)[2].join(adapter.competitions(spark, d).select("race_id", "series_key"), "race_id")
    top = named.groupBy("series_key").agg(F.count("*").alias("n"), F.avg("v").alias("v")).orderBy(F.desc("v"), "series_key").limit(10)
    rows = top.select(F.col("series_key").alias("series"), F.col("n").cast("string").alias("races"), F.format_string("%.4f", "v").alias("mean v"))
    return spark.createDataFrame([(x,) for x in report.markdown(rows)], "line string")
