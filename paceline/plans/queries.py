"""Registered queries of the analysis, each with the SQL that must give the same rows."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.functions import scalars
from paceline.functions.scalars import hash_uniform_sql, rounded
from paceline.operators import describe, engine, inference, model, ranking, regression, slices
from paceline.operators.slices import SliceSpec
from paceline.sources import adapter, tables

SPEC = SliceSpec()
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
RUNS, SEED = 12, 7

#: DuckDB: finishes, five pruning passes (the fourth already changes nothing on the test tables), cells.
_PASS = """p{n} AS (SELECT * FROM (SELECT * FROM p{m} QUALIFY count(*) OVER (PARTITION BY athlete_id) >= 25)
  QUALIFY count(*) OVER (PARTITION BY race_id) >= 60)"""
_FIN = """p0 AS (SELECT r.athlete_id, r.race_id, coalesce(chip_time_sec, gun_time_sec) t, c."date",
  coalesce((yob_min + yob_max) / 2, yob_min, yob_max)::DOUBLE yob FROM results r JOIN athletes a USING (athlete_id)
  JOIN competitions c USING (race_id) WHERE coalesce(chip_time_sec, gun_time_sec) BETWEEN 7100 AND 36000)"""
_CELLS = """cells AS MATERIALIZED (SELECT athlete_id, race_id, "date", t, ln(t) y, date_diff('day', first_, "date") / 365.25 a_n,
  (year(first_) - yob)::DOUBLE a_e FROM (SELECT *, min("date") OVER (PARTITION BY athlete_id) first_ FROM p5))"""
_SWEEP = """v{n} AS (SELECT race_id, v - avg(v) OVER () v FROM (SELECT race_id, avg(y - u) v FROM cells JOIN u{m} USING (athlete_id) GROUP BY race_id)),
u{n} AS (SELECT athlete_id, avg(y - v) u FROM cells JOIN v{n} USING (race_id) GROUP BY athlete_id)"""
_SLICE = ",\n".join([adapter.CTES, _FIN, *(_PASS.format(n=n, m=n - 1) for n in range(1, 6)), _CELLS])
#: Two Gaussian sweeps from the mean start, for the checks of single updates.
_SWEPT = ",\n".join([_SLICE, "u0 AS (SELECT athlete_id, avg(y) u FROM cells GROUP BY athlete_id)", *(_SWEEP.format(n=n, m=n - 1) for n in (1, 2))])
NU = 8.0
_STUDENT = "9 / (8 + r * r / s2)"


def fit_sql(cells: str, out: str, weight: str = _STUDENT, sweeps: int = 32) -> str:
    """DuckDB: reweighted sweeps of all runs of ``cells`` (run_id, athlete_id, race_id, y, g) until far below rounding, as table
    ``out``: k ('u' or 'v'), run_id, id, x and the scale s2."""
    return f"""{out}_ AS (
SELECT 0 it, 'u' k, run_id, athlete_id id, sum(g * y) / sum(g) x, any_value(s) s2 FROM {cells} JOIN (SELECT run_id, var_pop(y) s FROM {cells} GROUP BY 1) USING (run_id) GROUP BY 2, 3, 4
UNION ALL SELECT 0, 'v', run_id, race_id, 0.0, any_value(s) FROM {cells} JOIN (SELECT run_id, var_pop(y) s FROM {cells} GROUP BY 1) USING (run_id) GROUP BY 2, 3, 4
UNION ALL (
WITH e AS (SELECT *, {weight} w FROM (SELECT c.*, a.x u0, a.s2, c.y - a.x - b.x r, a.it it FROM {cells} c
    JOIN {out}_ a ON a.k = 'u' AND a.run_id = c.run_id AND a.id = c.athlete_id
    JOIN {out}_ b ON b.k = 'v' AND b.run_id = c.run_id AND b.id = c.race_id WHERE a.it < {sweeps})),
  nv AS (SELECT run_id, race_id, x - avg(x) OVER (PARTITION BY run_id) v FROM (SELECT run_id, race_id, sum(g * w * (y - u0)) / sum(g * w) x FROM e GROUP BY 1, 2)),
  nu AS (SELECT run_id, athlete_id, sum(g * w * (y - v)) / sum(g * w) u FROM e JOIN nv USING (run_id, race_id) GROUP BY 1, 2),
  ns AS (SELECT run_id, sum(g * w * (y - u - v) ** 2) / sum(g) s2, any_value(it) + 1 it
    FROM e JOIN nv USING (run_id, race_id) JOIN nu USING (run_id, athlete_id) GROUP BY 1)
SELECT it, 'u', run_id, athlete_id, u, s2 FROM nu JOIN ns USING (run_id)
UNION ALL SELECT it, 'v', run_id, race_id, v, s2 FROM nv JOIN ns USING (run_id))),
{out} AS MATERIALIZED (SELECT k, run_id, id, x, s2 FROM {out}_ WHERE it = {sweeps})"""


#: The converged Student-t fit: v2 (race_id, v), u2 (athlete_id, u), scale (s2).
_FITTED = f"""RECURSIVE {_SLICE},
one AS MATERIALIZED (SELECT 0::BIGINT run_id, athlete_id, race_id, y, 1.0::DOUBLE g FROM cells),
{fit_sql("one", "fit")},
u2 AS (SELECT id athlete_id, x u FROM fit WHERE k = 'u'), v2 AS (SELECT id race_id, x v FROM fit WHERE k = 'v'), scale AS (SELECT any_value(s2) s2 FROM fit)"""
_E = hash_uniform_sql(SEED, "athlete_id", "run_id")
#: Replicates refitted to convergence under athlete weights: boot (run_id, race_id, v).
_BOOT = f"""{_FITTED},
e AS (SELECT run_id, athlete_id, -ln({_E}) e FROM (SELECT DISTINCT athlete_id FROM cells), (SELECT unnest(range(1, {RUNS + 1}))::BIGINT run_id)),
g AS MATERIALIZED (SELECT run_id, athlete_id, e / avg(e) OVER (PARTITION BY run_id) g FROM e),
many AS MATERIALIZED (SELECT run_id, athlete_id, race_id, y, g FROM cells JOIN g USING (athlete_id)),
{fit_sql("many", "refit")},
boot AS (SELECT run_id, id race_id, x v FROM refit WHERE k = 'v')"""
_RESIDUALS = f"""{_FITTED},
res AS MATERIALIZED (SELECT athlete_id, race_id, a_n - avg(a_n) OVER (PARTITION BY athlete_id) a_til, y - u - v r
  FROM cells JOIN u2 USING (athlete_id) JOIN v2 USING (race_id))"""


def _r(x: str, digits: int = 6) -> str:
    return f"round(({x})::DOUBLE, {digits}) + 0.0"


def query(sql: str | None = None, base: str = adapter.CTES) -> Callable:
    """Register a query under its function's name, with the SELECT that follows the common table expressions."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = f"WITH {base}\n{sql}"
        return f

    return register


def _core(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return adapter.athletes(spark, d), adapter.competitions(spark, d), adapter.results(spark, d)


def _swept(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cells, u, v) after two Gaussian sweeps."""
    cells = tables.cached_slice(spark, d, SPEC)
    return cells, *model.sweeps(cells, 2)


def _fit_tables(spark: SparkSession, d: str, kind: str, key: tuple, fit: Callable[[DataFrame], engine.Fits]) -> dict[str, DataFrame]:
    """races, athletes and scales of fits to the slice, by content key; made once."""
    made: list[engine.Fits] = []

    def of(name: str) -> DataFrame:
        if not made:
            made.append(fit(tables.cached_slice(spark, d, SPEC)))
        return getattr(made[0], name)

    whole = (tables.core_fingerprint(spark, d), SPEC.key, *key)
    return {n: tables.cached(spark, f"{kind}-{n}", whole, lambda n=n: of(n)) for n in ("races", "athletes", "scales")}


def _point(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return _fit_tables(spark, d, "fit", (NU,), lambda cells: engine.fit_runs(cells, config=engine.EngineConfig(nu=NU)))


def _fitted(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cells, u, v) of the converged Student-t fit."""
    fit = _point(spark, d)
    return tables.cached_slice(spark, d, SPEC), fit["athletes"].select("athlete_id", "u"), fit["races"].select("race_id", "v")


def _sigma2(spark: SparkSession, d: str) -> float:
    return _point(spark, d)["scales"].first()["sigma2"]


def _boot(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(v, replicates refitted to convergence from it)."""
    _, _, v = _fitted(spark, d)
    runs = list(range(1, RUNS + 1))
    fit = _fit_tables(
        spark, d, "boot", (NU, RUNS, SEED),
        lambda cells: inference.replicate_fits(cells, runs, SEED, engine.EngineConfig(nu=NU), v, _sigma2(spark, d)),
    )
    return v, fit["races"]


def _residuals(spark: SparkSession, d: str) -> DataFrame:
    cells, u, v = _fitted(spark, d)
    rest = inference.centred_age(cells).join(u, "athlete_id").join(v, "race_id")
    return rest.select("athlete_id", "race_id", "a_til", (F.col("y") - F.col("u") - F.col("v")).alias("r"))


# ---- filters and slices


@query("""SELECT athlete_id, sex, country, coalesce((yob_min + yob_max) / 2, yob_min, yob_max)::DOUBLE yob FROM athletes
WHERE has_wmm AND sex = 'M' AND country NOT IN ('NATION_5', 'NATION_6') AND (yob_min IS NOT NULL OR yob_max IS NOT NULL)""")
def fl_athletes(spark: SparkSession, d: str) -> DataFrame:
    spec = SliceSpec(cohort="wmm", sex="M", countries_exclude=("NATION_5", "NATION_6"), require_yob=True)
    return slices.athlete_filter(adapter.athletes(spark, d), spec).select("athlete_id", "sex", "country", slices.yob_mid().alias("yob"))


@query("""SELECT race_id, series_key, country, "date", "year"::INTEGER "year" FROM competitions
WHERE country IN ('NATION_1', 'NATION_2', 'NATION_3', 'NATION_10') AND "date" BETWEEN DATE '1996-01-01' AND DATE '2000-06-30'""")
def fl_races(spark: SparkSession, d: str) -> DataFrame:
    spec = SliceSpec(race_countries_include=("NATION_1", "NATION_2", "NATION_3", "NATION_10"), date_from="1996-01-01", date_to="2000-06-30")
    return slices.race_filter(adapter.competitions(spark, d), spec).select("race_id", "series_key", "country", "date", "year")


@query(f"SELECT athlete_id, race_id, {_r('coalesce(chip_time_sec, gun_time_sec)', 4)} t FROM results WHERE coalesce(chip_time_sec, gun_time_sec) BETWEEN 7100 AND 36000")
def fl_finishes(spark: SparkSession, d: str) -> DataFrame:
    timed = adapter.results(spark, d).withColumn("t", slices.time_column("chip_else_gun"))
    return timed.filter(F.col("t").between(7100, 36000)).select("athlete_id", "race_id", rounded(F.col("t"), 4).alias("t"))


@query(f"SELECT athlete_id, race_id, {_r('y')} y, {_r('a_n')} a_n, {_r('a_e', 4)} a_e FROM cells", _SLICE)
def nm_slice(spark: SparkSession, d: str) -> DataFrame:
    return tables.cached_slice(spark, d, SPEC).select("athlete_id", "race_id", rounded(F.col("y")).alias("y"), rounded(F.col("a_n")).alias("a_n"), rounded(F.col("a_e"), 4).alias("a_e"))


@query(
    """SELECT athlete_id, race_id FROM (SELECT *, year(min("date") OVER (PARTITION BY athlete_id)) - yob age FROM p0)
WHERE (age IS NULL OR age BETWEEN 20 AND 45) QUALIFY count(*) OVER (PARTITION BY athlete_id) >= 10""",
    f"{adapter.CTES},\n{_FIN}",
)
def fl_age_band(spark: SparkSession, d: str) -> DataFrame:
    spec = SliceSpec(min_age=20, max_age=45, min_race_count=10, min_field=0)
    return slices.prune_pass(slices.finishes(*_core(spark, d), spec), spec).select("athlete_id", "race_id")


_PARITY = """p0 AS (SELECT r.athlete_id, r.race_id FROM results r JOIN customer ON c_custkey = athlete_id JOIN supplier ON s_suppkey = race_id // 10000
  WHERE c_nationkey % 2 = s_nationkey % 2),
hub AS (SELECT DISTINCT race_id, min(race_id) OVER (PARTITION BY athlete_id) h FROM p0),
link AS (SELECT race_id a, h b FROM hub UNION SELECT h, race_id FROM hub),
reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
comp AS (SELECT a race_id, min(b) comp FROM reach GROUP BY a),
best AS (SELECT comp FROM p0 JOIN comp USING (race_id) GROUP BY comp ORDER BY count(*) DESC, comp LIMIT 1)"""


@query("SELECT athlete_id, race_id FROM p0 JOIN comp USING (race_id) JOIN best USING (comp)", f"RECURSIVE {adapter.CTES},\n{_PARITY}")
def jn_giant_component(spark: SparkSession, d: str) -> DataFrame:
    people = adapter.read(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("athlete_id"), "c_nationkey")
    series = adapter.read(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("s"), "s_nationkey")
    cells = adapter.results(spark, d).join(people, "athlete_id").join(series, F.floor(F.col("race_id") / 10000) == F.col("s"))
    return slices.giant_component(slices.cut(cells.filter("c_nationkey % 2 = s_nationkey % 2").select("athlete_id", "race_id")))


@query("SELECT race_id, (row_number() OVER (ORDER BY race_id) - 1)::BIGINT col_idx FROM (SELECT DISTINCT race_id FROM cells)", _SLICE)
def wn_dense_index(spark: SparkSession, d: str) -> DataFrame:
    return slices.dense_index(tables.cached_slice(spark, d, SPEC), "race_id", "col_idx")


@query(
    """SELECT series_key, count(DISTINCT race_id) n_editions FROM (SELECT race_id, count(*) n FROM p0 GROUP BY race_id HAVING count(*) >= 80)
JOIN competitions USING (race_id) GROUP BY series_key HAVING count(DISTINCT race_id) >= 3""",
    f"{adapter.CTES},\n{_FIN}",
)
def fl_having_floors(spark: SparkSession, d: str) -> DataFrame:
    athletes, races, results = _core(spark, d)
    big = slices.finishes(athletes, races, results, SPEC).groupBy("race_id").agg(F.count("*").alias("n")).filter("n >= 80")
    return big.join(races, "race_id").groupBy("series_key").agg(F.count_distinct("race_id").alias("n_editions")).filter("n_editions >= 3")


# ---- descriptive tables


@query("""SELECT (SELECT count(*) FROM athletes) n_athletes, (SELECT count(*) FROM athletes WHERE sex = 'W') n_women, count(*) n_editions,
count(DISTINCT series_key) n_series, min("date") first_date, max("date") last_date, (SELECT count(*) FROM results) n_results,
(SELECT count(chip_time_sec) FROM results) n_chip FROM competitions""")
def ag_overview(spark: SparkSession, d: str) -> DataFrame:
    return describe.overview(*_core(spark, d))


@query("""SELECT series_key, count(DISTINCT race_id) n_editions, count(DISTINCT "year") n_years, count(*) n_finishes, count(*) FILTER (sex = 'M') n_men,
count(*) FILTER (sex = 'W') n_women FROM results JOIN competitions USING (race_id) JOIN athletes USING (athlete_id) GROUP BY series_key""")
def ag_catalogue(spark: SparkSession, d: str) -> DataFrame:
    athletes, races, results = _core(spark, d)
    return describe.catalogue(results, races, athletes)


@query(f"""SELECT bucket, n_athletes, n_finishes, {_r("n_athletes / sum(n_athletes) FILTER (bucket <> 'total') OVER ()")} share FROM (
  SELECT coalesce(b, 'total') bucket, count(*) n_athletes, sum(n)::BIGINT n_finishes FROM (SELECT n,
    CASE WHEN n <= 5 THEN n::VARCHAR WHEN n <= 10 THEN '6-10' ELSE '>10' END b FROM (SELECT count(*) n FROM results GROUP BY athlete_id))
  GROUP BY GROUPING SETS ((b), ()))""")
def ag_finishes_per_athlete(spark: SparkSession, d: str) -> DataFrame:
    return describe.finishes_per_athlete(adapter.results(spark, d))


@query("""SELECT "year"::INTEGER "year", count(DISTINCT race_id) n_races, count(*) n_finishes, count(DISTINCT athlete_id) n_athletes
FROM results JOIN competitions USING (race_id) GROUP BY 1""")
def ag_temporal(spark: SparkSession, d: str) -> DataFrame:
    return describe.temporal(adapter.results(spark, d), adapter.competitions(spark, d))


@query("SELECT country, count(*) n_finishes FROM results JOIN competitions USING (race_id) GROUP BY country ORDER BY 2 DESC, 1 LIMIT 10")
def ag_geography(spark: SparkSession, d: str) -> DataFrame:
    return describe.geography(adapter.results(spark, d), adapter.competitions(spark, d))


@query(f"""SELECT sex, count(*) n, count(*) FILTER (yob_min IS NOT NULL OR yob_max IS NOT NULL) n_known, {_r('median(yob_max - yob_min)')} span_median,
{_r('quantile_cont(yob_max - yob_min, 0.9)')} span_p90, {", ".join(f"{_r(f'avg({f}::INT)')} {f}" for f in adapter.FLAGS)} FROM athletes GROUP BY sex""")
def ag_demographics(spark: SparkSession, d: str) -> DataFrame:
    return describe.demographics(adapter.athletes(spark, d))


@query(
    f"""SELECT sex, count(*) n, {_r('avg(t)', 4)} mean, {", ".join(f"{_r(f'quantile_cont(t, {q})', 6)} p{p}" for p, q in [(1, 0.01), (10, 0.1), (50, 0.5), (90, 0.9), (99, 0.99)])}
FROM (SELECT sex, t FROM cells JOIN athletes USING (athlete_id) UNION ALL SELECT 'All', t FROM cells) GROUP BY sex""",
    _SLICE,
)
def ag_finish_times(spark: SparkSession, d: str) -> DataFrame:
    return describe.finish_times(tables.cached_slice(spark, d, SPEC), adapter.athletes(spark, d))


@query(
    f"""SELECT count(*) n_cells, count(DISTINCT athlete_id) n_athletes, count(DISTINCT race_id) n_races, any_value(p50) p50, any_value(p90) p90, any_value(largest) largest,
{_r('count(*) / count(DISTINCT athlete_id) / count(DISTINCT race_id)', 8)} fill
FROM cells, (SELECT {_r('quantile_cont(n, 0.5)')} p50, {_r('quantile_cont(n, 0.9)')} p90, max(n) largest FROM (SELECT count(*) n FROM cells GROUP BY race_id))""",
    _SLICE,
)
def ag_sparsity(spark: SparkSession, d: str) -> DataFrame:
    return describe.sparsity(tables.cached_slice(spark, d, SPEC))


@query(
    f"""SELECT series_key, count(*) k_editions, arg_min(country, race_id) country, min("year")::INTEGER yr_min, max("year")::INTEGER yr_max, sum(n)::BIGINT n_total,
{_r('median(v)')} median_v, {_r('quantile_cont(v, 0.75) - quantile_cont(v, 0.25)')} iqr_v
FROM v2 JOIN competitions USING (race_id) JOIN (SELECT race_id, count(*) n FROM cells GROUP BY race_id) USING (race_id) GROUP BY series_key""",
    _FITTED,
)
def ag_series_summary(spark: SparkSession, d: str) -> DataFrame:
    cells, _, v = _fitted(spark, d)
    return describe.series_summary(cells, adapter.competitions(spark, d), v)


@query("SELECT sex, least(floor((t - 7000) / 1450), 19)::BIGINT bin, count(*) n FROM cells JOIN athletes USING (athlete_id) WHERE t BETWEEN 7000 AND 36000 GROUP BY 1, 2", _SLICE)
def ag_histogram(spark: SparkSession, d: str) -> DataFrame:
    cells = tables.cached_slice(spark, d, SPEC).join(adapter.athletes(spark, d).select("athlete_id", "sex"), "athlete_id")
    return describe.histogram(cells, "t", 7000, 36000, 20, "sex")


@query(
    """SELECT series_key, count(*) FILTER (sex = 'M') n_men, count(*) FILTER (sex = 'W') n_women
FROM cells JOIN athletes USING (athlete_id) JOIN competitions USING (race_id) GROUP BY series_key""",
    _SLICE,
)
def ag_participation(spark: SparkSession, d: str) -> DataFrame:
    athletes, races, _ = _core(spark, d)
    return describe.participation(tables.cached_slice(spark, d, SPEC), athletes, races)


@query(
    """SELECT series_key, country, n FROM (SELECT series_key, a.country, count(*) n FROM cells JOIN athletes a USING (athlete_id) JOIN competitions USING (race_id) GROUP BY 1, 2)
QUALIFY row_number() OVER (PARTITION BY series_key ORDER BY n DESC, country) = 1""",
    _SLICE,
)
def ag_mode_country(spark: SparkSession, d: str) -> DataFrame:
    athletes, races, _ = _core(spark, d)
    return describe.mode_country(tables.cached_slice(spark, d, SPEC), athletes, races)


@query(
    f"""SELECT CASE WHEN n < 30 THEN 'under 30' WHEN n < 40 THEN '30-39' ELSE '40 and more' END stratum, count(*) n, {_r('avg((span < 0.5)::INT)')} below_half,
{_r('avg((span < 5)::INT)')} below_five, {_r('median(span)')} median_span FROM (SELECT count(*) n, max(a_n) - min(a_n) span FROM cells GROUP BY athlete_id) GROUP BY 1""",
    _SLICE,
)
def ag_span_ecdf(spark: SparkSession, d: str) -> DataFrame:
    return describe.span_ecdf(tables.cached_slice(spark, d, SPEC))


@query(
    f"""SELECT count(*) n, {_r('avg(r)')} mean, {_r('stddev_samp(r)')} sd, {_r('avg(z * z * z)', 5)} skewness, {_r('avg(z * z * z * z) - 3', 5)} kurtosis,
{_r('avg((z > 2)::INT)')} upper_tail, {_r('avg((z < -2)::INT)')} lower_tail FROM (SELECT r, (r - avg(r) OVER ()) / stddev_pop(r) OVER () z FROM res)""",
    _RESIDUALS,
)
def ag_residual_moments(spark: SparkSession, d: str) -> DataFrame:
    return describe.moments(_residuals(spark, d), "r")


@query(
    f"""SELECT country, {_r('any_value(q1)')} q1, {_r('any_value(q2)')} q2, {_r('any_value(q3)')} q3,
{_r('min(v) FILTER (v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))')} lo, {_r('max(v) FILTER (v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))')} hi
FROM (SELECT country, v, quantile_cont(v, 0.25) OVER w q1, quantile_cont(v, 0.5) OVER w q2, quantile_cont(v, 0.75) OVER w q3
  FROM v2 JOIN competitions USING (race_id) WINDOW w AS (PARTITION BY country)) GROUP BY country""",
    _FITTED,
)
def ag_box_stats(spark: SparkSession, d: str) -> DataFrame:
    _, _, v = _fitted(spark, d)
    return describe.box_stats(v.join(adapter.competitions(spark, d).select("race_id", "country"), "race_id"), "country", "v")


# ---- model


@query(f"SELECT race_id, {_r('v')} v FROM v2", _SWEPT)
def nm_sweep_races(spark: SparkSession, d: str) -> DataFrame:
    return _swept(spark, d)[2].select("race_id", rounded(F.col("v")).alias("v"))


@query(f"SELECT athlete_id, {_r('u')} u FROM u2", _SWEPT)
def nm_sweep_athletes(spark: SparkSession, d: str) -> DataFrame:
    return _swept(spark, d)[1].select("athlete_id", rounded(F.col("u")).alias("u"))


@query(
    f"""SELECT race_id, {_r('sum(w * (r + v)) / sum(w)')} v FROM (SELECT *, 9 / (8 + r * r / (avg(r * r) OVER ())) w FROM res JOIN v2 USING (race_id)) GROUP BY race_id""",
    _RESIDUALS,
)
def nm_student_update(spark: SparkSession, d: str) -> DataFrame:
    cells, u, v = _fitted(spark, d)
    rest = cells.join(u, "athlete_id").join(v, "race_id").withColumn("r", F.col("y") - F.col("u") - F.col("v"))
    scale = rest.agg(F.avg(F.col("r") ** 2).alias("s2"))
    w = scalars.irls_weight(F.col("r"), F.col("s2"), 8.0)
    return rest.crossJoin(F.broadcast(scale)).groupBy("race_id").agg(rounded(F.sum(w * (F.col("r") + F.col("v"))) / F.sum(w)).alias("v"))  # one row


@query(f"SELECT count(*) n, {_r('avg(r * r)', 8)} sigma2, {_r('-0.5 * count(*) * (ln(2 * pi()) + ln(avg(r * r)) + 1)', 2)} loglik FROM res", _RESIDUALS)
def nm_loglik(spark: SparkSession, d: str) -> DataFrame:
    got = _residuals(spark, d).agg(F.count("*").alias("n"), F.avg(F.col("r") ** 2).alias("s2"))
    loglik = -0.5 * F.col("n") * (F.log(2 * F.pi()) + F.log("s2") + 1)
    return got.select("n", rounded(F.col("s2"), 8).alias("sigma2"), rounded(loglik, 2).alias("loglik"))


@query(f"SELECT race_id, {_r('v')} v FROM v2", _FITTED)
def nm_fit_student(spark: SparkSession, d: str) -> DataFrame:
    """The converged Student-t fit itself, not its cached tables."""
    cells = tables.cached_slice(spark, d, SPEC)
    return engine.fit_runs(cells, config=engine.EngineConfig(nu=NU)).races.select("race_id", rounded(F.col("v")).alias("v"))


@query(
    f"""SELECT count(*) n, {_r('any_value(s2)', 8)} sigma2, {_r(f"sum({math.lgamma(4.5) - math.lgamma(4.0) - 0.5 * math.log(8 * math.pi)!r} - 0.5 * ln(s2) - 4.5 * ln(1 + r * r / (8 * s2)))", 4)} loglik
FROM res, scale""",
    _RESIDUALS,
)
def nm_student_loglik(spark: SparkSession, d: str) -> DataFrame:
    got = _point(spark, d)["scales"]
    return got.select(F.col("n").cast("long").alias("n"), rounded(F.col("sigma2"), 8).alias("sigma2"), rounded(F.col("loglik"), 4).alias("loglik"))


# ---- resampling and validation


_FOLD = hash_uniform_sql(SEED, "athlete_id", "race_id")
_START = hash_uniform_sql(SEED + 1, "athlete_id")
_FOLDS = f"SELECT *, ((row_number() OVER (PARTITION BY athlete_id ORDER BY {_FOLD}, race_id) - 1 + floor({_START} * 5)) % 5)::BIGINT fold FROM cells"


@query(f"SELECT athlete_id, race_id, fold FROM ({_FOLDS})", _SLICE)
def rs_folds(spark: SparkSession, d: str) -> DataFrame:
    return inference.folds(tables.cached_slice(spark, d, SPEC), 5, SEED).select("athlete_id", "race_id", "fold")


_HELD_OUT = f"""RECURSIVE {_SLICE}, f AS MATERIALIZED ({_FOLDS}),
train AS MATERIALIZED (SELECT out_ run_id, athlete_id, race_id, y, 1.0::DOUBLE g FROM f, (SELECT unnest(range(5))::BIGINT out_) WHERE fold <> out_),
{fit_sql("train", "cv")},
scored AS MATERIALIZED (SELECT f.fold, s2, y - u - v r FROM f JOIN (SELECT run_id, any_value(s2) s2 FROM cv GROUP BY 1) s ON s.run_id = fold
  LEFT JOIN (SELECT run_id, id athlete_id, x u FROM cv WHERE k = 'u') a ON a.run_id = fold AND a.athlete_id = f.athlete_id
  LEFT JOIN (SELECT run_id, id race_id, x v FROM cv WHERE k = 'v') b ON b.run_id = fold AND b.race_id = f.race_id)"""
_T8 = f"{math.lgamma(4.5) - math.lgamma(4.0) - 0.5 * math.log(8 * math.pi)!r} - 0.5 * ln(s2) - 4.5 * ln(1 + r * r / (8 * s2))"


@query(
    f"""SELECT fold, count(r) n_scored, count(*) - count(r) n_orphans, {_r(f'sum({_T8})', 4)} logdensity, {_r('sqrt(avg(r * r))')} rmse FROM scored GROUP BY fold""",
    _HELD_OUT,
)
def rs_held_out(spark: SparkSession, d: str) -> DataFrame:
    """Every fold held out of a fit of the others, all fitted in the same jobs."""
    marked = slices.cut(inference.folds(tables.cached_slice(spark, d, SPEC), 5, SEED))
    fits = inference.fold_fits(marked, 5, engine.EngineConfig(nu=NU))
    return inference.held_out(marked, fits, NU)


@query(f"SELECT run_id, race_id, {_r('v')} v FROM boot", _BOOT)
def rs_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    return _boot(spark, d)[1].select("run_id", "race_id", rounded(F.col("v")).alias("v"))


@query(
    f"""SELECT race_id, count(*) n_boot, {_r('median(v)')} median_v, {_r('stddev_samp(v)')} sd_v,
{", ".join(f"{_r(f'quantile_cont(v, {q})')} {n}" for n, q in [("lo95", 0.025), ("lo90", 0.05), ("lo68", 0.16), ("hi68", 0.84), ("hi90", 0.95), ("hi95", 0.975)])}
FROM boot GROUP BY race_id""",
    _BOOT,
)
def rs_replicate_summary(spark: SparkSession, d: str) -> DataFrame:
    return inference.replicate_summary(_boot(spark, d)[1])


_X = """date_diff('day', DATE '2000-01-01', "date") / 365.25"""


@query(
    f"""SELECT run_id, race_id, {_r('slope', 8)} slope, {_r('v - cut - slope * x')} v FROM (SELECT *, regr_slope(v, x) OVER (PARTITION BY run_id) slope,
regr_intercept(v, x) OVER (PARTITION BY run_id) cut FROM (SELECT run_id, race_id, v, {_X} x FROM boot JOIN competitions USING (race_id)))""",
    _BOOT,
)
def rs_regauge(spark: SparkSession, d: str) -> DataFrame:
    got = inference.regauge(_boot(spark, d)[1], adapter.competitions(spark, d).select("race_id", "date"))
    return got.select("run_id", "race_id", rounded(F.col("slope"), 8).alias("slope"), rounded(F.col("v")).alias("v"))


@query(
    f"""SELECT race_id, {_r('avg(CASE WHEN sxx > 1e-9 THEN sxy / sxx END * a_til)')} delta, count(CASE WHEN sxx > 1e-9 THEN 1 END) n_eligible FROM (
SELECT *, sum(a_til * r) OVER p - a_til * r sxy, sum(a_til * a_til) OVER p - a_til * a_til sxx FROM res WINDOW p AS (PARTITION BY athlete_id)) GROUP BY race_id""",
    _RESIDUALS,
)
def rs_loo_delta(spark: SparkSession, d: str) -> DataFrame:
    return inference.loo_delta(_residuals(spark, d))


_MIXED = hash_uniform_sql(SEED, "athlete_id", "k", "race_id")


@query(
    f"""SELECT a.k, a.race_id, {_r('avg(a.a_til * b.r)')} stat FROM m a JOIN m b ON a.k = b.k AND a.athlete_id = b.athlete_id AND a.pos = b.to_ GROUP BY 1, 2""",
    f"""{_RESIDUALS}, m AS (SELECT *, row_number() OVER (PARTITION BY k, athlete_id ORDER BY race_id) pos,
row_number() OVER (PARTITION BY k, athlete_id ORDER BY {_MIXED}, race_id) to_ FROM res, (SELECT unnest(range(1, 4))::BIGINT k))""",
)
def rs_permutation(spark: SparkSession, d: str) -> DataFrame:
    moved = inference.permuted(slices.cut(_residuals(spark, d)), 3, SEED)
    return moved.groupBy("k", "race_id").agg(rounded(F.avg(F.col("a_til") * F.col("r"))).alias("stat"))


@query(
    f"""SELECT count(*) n, {_r('stddev_samp(d)', 8)} raw_sd, {_r('sqrt(greatest(var_samp(d) - avg(pv), 0))', 8)} disatt_sd, {_r('avg(z * z * z)', 4)} skew, {_r('avg((d < 0)::INT)')} frac_improver
FROM (SELECT *, (d - avg(d) OVER ()) / stddev_pop(d) OVER () z FROM (SELECT sum(a_til * r) / s2 / (sum(a_til * a_til) / s2 + 1 / 1e-4) d, 1 / (sum(a_til * a_til) / s2 + 1 / 1e-4) pv
  FROM res, scale GROUP BY athlete_id, s2))""",
    _RESIDUALS,
)
def rs_drift_descriptors(spark: SparkSession, d: str) -> DataFrame:
    return inference.drift_descriptors(inference.drift_slopes(_residuals(spark, d), 1e-4, _sigma2(spark, d)))


@query(
    f"""SELECT count(*) n, {_r('corr(x, y)')} r_raw, {_r('corr(x - cx - sx * "year", y - cy - sy * "year")')} r_partial FROM (SELECT *, regr_slope(x, "year") OVER () sx,
regr_intercept(x, "year") OVER () cx, regr_slope(y, "year") OVER () sy, regr_intercept(y, "year") OVER () cy
FROM (SELECT v2.v x, v1.v + n * 0.001 y, "year"::DOUBLE "year" FROM v2 JOIN v1 USING (race_id) JOIN competitions USING (race_id) JOIN (SELECT race_id, count(*) n FROM cells GROUP BY 1) USING (race_id)))""",
    f"{_FITTED}, u0 AS (SELECT athlete_id, avg(y) u FROM cells GROUP BY athlete_id), {_SWEEP.format(n=1, m=0)}",
)
def rs_partial_correlation(spark: SparkSession, d: str) -> DataFrame:
    cells, _, v = _fitted(spark, d)
    v1 = model.sweeps(cells, 1)[1].select("race_id", F.col("v").alias("w"))
    fields = cells.groupBy("race_id").agg(F.count("*").alias("n"))
    joined = v.join(v1, "race_id").join(fields, "race_id").join(adapter.competitions(spark, d).select("race_id", F.col("year").cast("double").alias("year")), "race_id")
    return inference.partial_correlation(slices.cut(joined.select(F.col("v").alias("x"), (F.col("w") + F.col("n") * 0.001).alias("y"), "year")))


# ---- rankings


@query(
    f"""SELECT race_id, series_key, country, "year"::INTEGER "year", {_r('v')} v, {_r('180 * (exp(v) - 1)', 4)} min_at_3h, row_number() OVER (ORDER BY v DESC, race_id) rank_slow,
row_number() OVER (ORDER BY v, race_id) rank_fast FROM v2 JOIN competitions USING (race_id)""",
    _FITTED,
)
def rk_editions(spark: SparkSession, d: str) -> DataFrame:
    return ranking.rank_editions(_fitted(spark, d)[2], adapter.competitions(spark, d))


_TIER = "CASE WHEN {p} >= 0.95 THEN 'certain' WHEN {p} >= 0.68 THEN 'likely' WHEN {p} > 0.05 THEN 'possible' ELSE 'unlikely' END"


@query(
    f"""SELECT race_id, rank_slow, {_r('p')} p_top, {_r('lo', 4)} rank_lo95, {_r('hi', 4)} rank_hi95, {_TIER.format(p='p')} tier, n_boot FROM (
SELECT race_id, avg((k <= 50)::INT) p, quantile_cont(k, 0.025) lo, quantile_cont(k, 0.975) hi, count(*) n_boot FROM (SELECT race_id, row_number() OVER (PARTITION BY run_id ORDER BY v DESC, race_id) k FROM boot)
GROUP BY race_id) JOIN (SELECT race_id, row_number() OVER (ORDER BY v DESC, race_id) rank_slow FROM v2) USING (race_id)""",
    _BOOT,
)
def rk_top_n(spark: SparkSession, d: str) -> DataFrame:
    return ranking.top_n(*_boot(spark, d), 50)


_MEDIANS = f"""{_BOOT}, med AS (SELECT run_id, series_key, median(v) m FROM boot JOIN competitions USING (race_id) GROUP BY 1, 2 HAVING count(*) >= 3)"""


@query(
    f"""SELECT series_key, {_r('m')} median_v, rank_slow, {_r('lo')} m_lo95, {_r('hi')} m_hi95, {_r('p')} p_slow, {_r('rlo', 4)} rank_lo95, {_r('rhi', 4)} rank_hi95, {_TIER.format(p='p')} tier_slow FROM
(SELECT series_key, median(v) m, row_number() OVER (ORDER BY median(v) DESC, series_key) rank_slow FROM v2 JOIN competitions USING (race_id) GROUP BY 1 HAVING count(*) >= 3) JOIN
(SELECT series_key, quantile_cont(m, 0.025) lo, quantile_cont(m, 0.975) hi, avg((k <= 10)::INT) p, quantile_cont(k, 0.025) rlo, quantile_cont(k, 0.975) rhi
 FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY m DESC, series_key) k FROM med) GROUP BY 1) USING (series_key)""",
    _MEDIANS,
)
def rk_series(spark: SparkSession, d: str) -> DataFrame:
    return ranking.series_ranking(*_boot(spark, d), adapter.competitions(spark, d), 3, 10)


@query(
    """SELECT a.series_key, count(*) FILTER (p >= 0.9) n_slower_conf, count(*) FILTER (p <= 0.1) n_faster_conf FROM (SELECT a.series_key, b.series_key other, avg((a.m < b.m)::INT) p
FROM med a JOIN med b USING (run_id) WHERE a.series_key <> b.series_key GROUP BY 1, 2) a GROUP BY 1""",
    _MEDIANS,
)
def rk_dominance(spark: SparkSession, d: str) -> DataFrame:
    medians = ranking.series_medians(_boot(spark, d)[1], adapter.competitions(spark, d), 3)
    return ranking.dominance_counts(slices.cut(medians), 0.9)


#: DuckDB: slices of men (run 1) and women (run 2), pruned each by itself, and their fits: sexes (run_id, race_id, v).
_SEX_FITS = f"""RECURSIVE {adapter.CTES}, {_FIN}, q0 AS (SELECT CASE sex WHEN 'M' THEN 1 ELSE 2 END::BIGINT run_id, athlete_id, race_id, ln(t) y FROM p0 JOIN athletes USING (athlete_id) WHERE sex IN ('M', 'W')),
{", ".join(f"q{n} AS (SELECT * FROM (SELECT * FROM q{n - 1} QUALIFY count(*) OVER (PARTITION BY run_id, athlete_id) >= 10) QUALIFY count(*) OVER (PARTITION BY run_id, race_id) >= 20)" for n in range(1, 13))},
both_ AS MATERIALIZED (SELECT run_id, athlete_id, race_id, y, 1.0::DOUBLE g FROM q12),
{fit_sql("both_", "sexfit")},
sexes AS (SELECT run_id, id race_id, x v FROM sexfit WHERE k = 'v')"""


def _sex_fits(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """race_id, v by sex: fits of a slice of men and of a slice of women."""
    out = {}
    for sex in "MW":
        spec = replace(SPEC, sex=sex, min_race_count=10, min_field=20)
        key = (tables.core_fingerprint(spark, d), spec.key, NU)
        fit = lambda spec=spec: engine.fit_runs(tables.cached_slice(spark, d, spec), config=engine.EngineConfig(nu=NU)).races.select("race_id", "v")
        out[sex] = tables.cached(spark, "sex-fit", key, fit)
    return out


@query(
    f"""SELECT race_id, {_r('diff')} diff, {_r('rest')} rest, {_r('rest / sd', 4)} z, abs(rest / sd) > 2 moved FROM (SELECT *, stddev_samp(rest) OVER () sd FROM (SELECT race_id, diff,
diff - regr_intercept(diff, x) OVER () - regr_slope(diff, x) OVER () * x rest FROM (SELECT race_id, a.v - b.v diff, {_X} x FROM sexes a JOIN sexes b USING (race_id) JOIN competitions USING (race_id)
WHERE a.run_id = 1 AND b.run_id = 2)))""",
    _SEX_FITS,
)
def rk_movers(spark: SparkSession, d: str) -> DataFrame:
    """Races that are harder for men than for women, or easier, beyond a straight line in the date: fits of two slices."""
    fits = _sex_fits(spark, d)
    return ranking.movers(fits["M"], fits["W"], adapter.competitions(spark, d).select("race_id", "date"))


@query(
    f"""SELECT count(*) n, {_r('corr(x, y)')} pearson, {_r('corr(rx, ry)')} spearman, {_r('count(*) FILTER (rx > 0.9 * n_ AND ry > 0.9 * n_) / count(*) FILTER (rx > 0.9 * n_ OR ry > 0.9 * n_)')} top_jaccard,
{_r('max(abs(rx - ry))', 2)} max_shift, {_r('avg(abs(x - y))')} mean_abs, {_r('max(abs(x - y))')} max_abs FROM (SELECT *, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 rx,
rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 ry, count(*) OVER () n_ FROM (SELECT a.v x, b.v y FROM boot a JOIN boot b USING (race_id) WHERE a.run_id = 1 AND b.run_id = 2))""",
    _BOOT,
)
def rk_agreement(spark: SparkSession, d: str) -> DataFrame:
    boot = _boot(spark, d)[1]
    return ranking.agreement(boot.filter("run_id = 1"), boot.filter("run_id = 2"))


@query(
    f"""SELECT a.run_id "first", b.run_id "second", {_r('corr(a.v, b.v)', 5)} r, {_r('avg(abs(a.v - b.v))')} mean_abs, {_r('max(abs(a.v - b.v))')} max_abs FROM boot a JOIN boot b USING (race_id)
WHERE a.run_id < b.run_id GROUP BY 1, 2""",
    _BOOT,
)
def rk_correlation_matrix(spark: SparkSession, d: str) -> DataFrame:
    return ranking.correlation_matrix(_boot(spark, d)[1])


@query(
    f"""SELECT {_r('sum(sign(a.x - b.x) * sign(a.y - b.y)) / sqrt(count(*) FILTER (a.x <> b.x)::DOUBLE * count(*) FILTER (a.y <> b.y))')} tau FROM k a JOIN k b ON a.race_id < b.race_id""",
    f"{_BOOT}, k AS (SELECT race_id, a.v x, b.v y FROM boot a JOIN boot b USING (race_id) WHERE a.run_id = 1 AND b.run_id = 2)",
)
def rk_kendall(spark: SparkSession, d: str) -> DataFrame:
    boot = _boot(spark, d)[1]
    x, y = (boot.filter(f"run_id = {k}").select("race_id", F.col("v").alias(n)) for k, n in ((1, "x"), (2, "y")))
    return ranking.kendall(slices.cut(x.join(y, "race_id")))


# ---- regression and tables


@query(
    f"""SELECT 'const' term, {_r('regr_intercept(v, n)')} beta, {_r('sqrt(s2 * (1 / count(*) + avg(n) * avg(n) / regr_sxx(v, n)))')} se FROM d GROUP BY s2
UNION ALL SELECT 'n', {_r('regr_slope(v, n)')}, {_r('sqrt(s2 / regr_sxx(v, n))')} FROM d GROUP BY s2""",
    f"""{_FITTED}, b AS (SELECT v, n::DOUBLE n FROM v2 JOIN (SELECT race_id, count(*) n FROM cells GROUP BY 1) USING (race_id)),
d AS (SELECT v, n, (SELECT (regr_syy(v, n) - regr_slope(v, n) * regr_sxy(v, n)) / (count(*) - 2) FROM b) s2 FROM b)""",
)
def rg_ols(spark: SparkSession, d: str) -> DataFrame:
    cells, _, v = _fitted(spark, d)
    data = slices.cut(v.join(cells.groupBy("race_id").agg(F.count("*").cast("double").alias("n")), "race_id"))
    return regression.as_table(data, regression.ols(data, "v", ["n"]), ["n"])


@query(
    f"""SELECT 'const' term, {_r('a')} beta, {_r('sqrt(k * (b00 * b00 * m00 + 2 * b00 * b01 * m01 + b01 * b01 * m11))')} se FROM q
UNION ALL SELECT 'n', {_r('b')}, {_r('sqrt(k * (b01 * b01 * m00 + 2 * b01 * b11 * m01 + b11 * b11 * m11))')} FROM q""",
    f"""{_FITTED}, b AS (SELECT v, n::DOUBLE n, series_key FROM v2 JOIN (SELECT race_id, count(*) n FROM cells GROUP BY 1) USING (race_id) JOIN competitions USING (race_id)),
f AS (SELECT regr_intercept(v, n) a, regr_slope(v, n) b, count(*) t, sum(n) sn, sum(n * n) snn FROM b),
s AS (SELECT sum(v - a - f.b * n) s0, sum(n * (v - a - f.b * n)) s1 FROM b, f GROUP BY series_key),
q AS (SELECT any_value(a) a, any_value(b) b, sum(s0 * s0) m00, sum(s0 * s1) m01, sum(s1 * s1) m11, count(*) / (count(*) - 1) * (any_value(t) - 1) / (any_value(t) - 2) k,
  any_value(snn / (t * snn - sn * sn)) b00, any_value(-sn / (t * snn - sn * sn)) b01, any_value(t / (t * snn - sn * sn)) b11 FROM s, f)""",
)
def rg_cluster_robust(spark: SparkSession, d: str) -> DataFrame:
    cells, _, v = _fitted(spark, d)
    fields = cells.groupBy("race_id").agg(F.count("*").cast("double").alias("n"))
    data = slices.cut(v.join(fields, "race_id").join(adapter.competitions(spark, d).select("race_id", "series_key"), "race_id"))
    return regression.as_table(data, regression.cluster_robust(data, "v", ["n"], "series_key"), ["n"])


@query()
def rg_huber(spark: SparkSession, d: str) -> DataFrame:
    cells, _, v = _fitted(spark, d)
    data = slices.cut(v.join(cells.groupBy("race_id").agg(F.count("*").cast("double").alias("n")), "race_id"))
    return regression.as_table(data, regression.huber(data, "v", ["n"]), ["n"])


@query("""SELECT athlete_id, sex, yob_min::INTEGER yob_min FROM athletes WHERE athlete_id % 3 <> 0 UNION ALL
SELECT athlete_id, 'X', 1900 FROM athletes WHERE athlete_id % 3 = 0""")
def sc_upsert(spark: SparkSession, d: str) -> DataFrame:
    old = adapter.athletes(spark, d).select("athlete_id", "sex", "yob_min")
    new = old.filter("athlete_id % 3 = 0").select("athlete_id", F.lit("X").alias("sex"), F.lit(1900).alias("yob_min"))
    return tables.upsert(old, new, ["athlete_id"])


@query("""SELECT series_key, race_id, "year"::INTEGER "year" FROM competitions QUALIFY row_number() OVER (PARTITION BY series_key ORDER BY "year" % 2 DESC, race_id DESC) = 1""")
def sc_upsert_last(spark: SparkSession, d: str) -> DataFrame:
    races = adapter.competitions(spark, d).select("series_key", "race_id", "year")
    return tables.upsert_last([races.filter("year % 2 = 0"), races.filter("year % 2 = 1")], ["series_key"], "race_id")


@query(f"""SELECT race_id, {_r(_X)} x, {_r("year(date) + (dayofyear(date) - 1) / 365.25")} yf, {_r("year(date) + (dayofyear(date) - 1) / dayofyear(make_date(year(date), 12, 31))")} yl,
replace(series_key, '#', ' ') title FROM competitions""")
def fn_dates(spark: SparkSession, d: str) -> DataFrame:
    date = F.col("date")
    return adapter.competitions(spark, d).select(
        "race_id", rounded(scalars.julian_years(date, F.lit("2000-01-01").cast("date"))).alias("x"), rounded(scalars.year_fraction(date)).alias("yf"),
        rounded(scalars.year_fraction(date, True)).alias("yl"), scalars.title_case(F.col("series_key")).alias("title"),
    )


def flagship(spark: SparkSession, d: str, spec: SliceSpec) -> DataFrame:
    """Finishes to pruned slice to converged fit to editions, hardest first."""
    fit = engine.fit_runs(slices.load_slice(spark, d, spec), config=engine.EngineConfig(nu=NU))
    return ranking.rank_editions(fit.races.drop("run_id"), adapter.competitions(spark, d))
