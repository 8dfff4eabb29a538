"""Selection rules, curves, identity errors and Anderson mixing."""

import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from paceline.operators import curves, inference, model, regression, selection, sensitivity, slices
from test_slices_and_model import synthetic


def test_anderson_agrees_with_plain_iteration_in_fewer_sweeps(spark):
    cells, _, _ = synthetic(spark, n=120, races=15)
    races, n, change = model.anderson(cells, fitter=model.FitConfig(max_iter=25, tol=1e-10))
    plain = {r["race_id"]: r["v"] for r in model.sweeps(cells, 12)[1].collect()}
    got = {r["race_id"]: r["v"] for r in races.collect()}
    assert change <= 1e-10 and n < 20
    assert max(abs(got[k] - plain[k]) for k in plain) < 1e-4


def test_gauge_keeps_the_fit_up_to_career_age(spark):
    cells, _, _ = synthetic(spark, n=60, races=10)
    cells = cells.withColumn("date", F.make_date(F.lit(2000) + F.col("race_id").cast("int"), F.lit(1), F.lit(1)))
    u, v = model.sweeps(cells, 2)
    dates = cells.select("race_id", "date").distinct()
    u2, v2, slope = model.gauge_beta0(u, v, cells, dates)
    line = v2.join(dates, "race_id").agg(F.regr_slope("v", F.datediff("date", F.lit("2000-01-01").cast("date")).cast("double")), F.avg("v")).first()
    assert abs(line[0]) < 1e-12 and abs(line[1]) < 1e-12
    first = F.datediff("date", F.min("date").over(__import__("pyspark").sql.Window.partitionBy("athlete_id"))) / 365.25
    aged = cells.withColumn("age", first)
    left = aged.join(u, "athlete_id").join(v.withColumnRenamed("v", "v0"), "race_id").join(u2.withColumnRenamed("u", "u2"), "athlete_id").join(v2, "race_id")
    gap = left.agg(F.max(F.abs(F.col("u") + F.col("v0") - F.col("u2") - F.col("v") - slope * F.col("age")))).first()[0]
    assert gap < 1e-9


def test_one_standard_error_rule(spark):
    rows = [(nu, f, 100, 0.1, base + 0.2 * f) for nu, base in (("8", 100.0), ("4", 99.9), ("inf", 50.0)) for f in range(5)]
    scores = spark.createDataFrame(rows, "nu string, fold long, n long, rmse double, logdensity double")
    near = {r["nu"]: r["near_best"] for r in selection.rollup(scores).collect()}
    assert near == {"8": True, "4": True, "inf": False}
    assert selection.paired_z(scores, "8", "inf").first()["gain"] == pytest.approx(0.5)


def test_curve_metrics_and_density(spark):
    points = curves.grid(spark, 0.0, 4.0, 401)
    got = curves.shape_metrics(points, (F.col("x") - 1) * (F.col("x") - 3)).first()
    assert got["peak_x"] == pytest.approx(2) and got["break_even"] == pytest.approx(3) and got["turns"] == 1
    values = spark.createDataFrame([(float(x),) for x in np.random.default_rng(1).normal(size=500)], "v double")
    density = [r["density"] for r in curves.kernel_density(values, "v", curves.grid(spark, -5.0, 5.0, 101)).orderBy("k").collect()]
    assert sum(density) * 0.1 == pytest.approx(1, abs=1e-3)


def test_knots_increase_and_bins_close_on_the_right(spark):
    cells = spark.createDataFrame([(0.0,)] + [(1.0,)] * 50, "a_n double")
    got = curves.knots(cells, 4)
    assert got[0] == 0 and all(b > a for a, b in zip(got, got[1:], strict=False))
    binned = curves.quantile_bins(spark.createDataFrame([(float(i),) for i in range(10)] + [(None,)], "x double"), "x", 5)
    assert sorted((r["bin"] is None, r["bin"]) for r in binned.collect() if r["bin"] is not None) == sorted((False, i // 2) for i in range(10))


def people(spark):
    day = lambda a, k: datetime.date(2000 + k, 1, 1 + a)
    rows = [(a, k, 9.0 + 0.01 * (a % 3), day(a, k), 1970.0 + a % 5 if a % 4 else None) for a in range(24) for k in range(3)]
    cells = spark.createDataFrame(rows, "athlete_id long, race_id long, y double, date date, yob double")
    sexes = spark.createDataFrame([(a, "M" if a % 2 else "W") for a in range(24)], "athlete_id long, sex string")
    return cells, sexes, rows


def test_joined_athletes_are_compatible_and_used_once(spark):
    cells, sexes, rows = people(spark)
    pairs = [(r["athlete_id"], r["partner"]) for r in sensitivity.join_labels(cells, sexes, 0.4, 3).collect()]
    assert pairs
    used = [x for p in pairs for x in p]
    assert len(used) == len(set(used))
    yob = {r[0]: r[4] for r in rows}
    for a, b in pairs:
        assert a % 2 == b % 2 and abs(0.01 * (a % 3) - 0.01 * (b % 3)) <= math.log(1.2)
        assert yob[a] is None or yob[b] is None or abs(yob[a] - yob[b]) <= 6
    merged = sensitivity.relabel(cells, spark.createDataFrame(pairs, "athlete_id long, partner long"))
    assert merged.count() == len(rows) and merged.select("athlete_id").distinct().count() == 24 - len(pairs)


def test_breaks_split_by_date(spark):
    cells, _, _ = people(spark)
    split = sensitivity.break_labels(cells, 0.5, 9).collect()
    for a in {-1 - r["athlete_id"] for r in split if r["athlete_id"] < 0}:
        early = [r["date"] for r in split if r["athlete_id"] == a]
        late = [r["date"] for r in split if r["athlete_id"] == -1 - a]
        assert early and late and max(early) < min(late)


def test_leaving_nobody_out_changes_nothing(spark):
    cells, _, _ = synthetic(spark, n=40, races=8)
    marked = cells.withColumn("country", F.lit("A"))
    got = sensitivity.leave_out(marked, "country", spark.createDataFrame([("B",)], "country string"))
    base = model.centred(model.race_update(cells, model.mean_init(cells)))
    assert sensitivity.leave_out_summary(got, base).first()["max_shift"] == 0


def test_cluster_operators_match_direct_computation(spark):
    rng = np.random.default_rng(4)
    g = np.repeat(np.arange(15), 6)
    x = rng.normal(size=90)
    y = 0.5 + 1.5 * x + rng.normal(0, 0.7, 15)[g] + rng.normal(0, 0.4, 90)
    df = spark.createDataFrame([(float(a), float(b), int(c)) for a, b, c in zip(x, y, g, strict=True)], "x double, y double, g int")
    design = np.stack([np.ones(90), x], axis=1)
    bread = np.linalg.inv(design.T @ design)
    e = y - design @ (bread @ design.T @ y)
    meat = np.zeros((2, 2))
    for k in range(15):
        d = design[g == k]
        w, v = np.linalg.eigh(np.eye(6) - d @ bread @ d.T)
        s = d.T @ (v @ ((v.T @ e[g == k]) / np.sqrt(w)))
        meat += np.outer(s, s)
    assert np.allclose(regression.cluster_robust_cr2(df, "y", ["x"], "g")["se"], np.sqrt(np.diag(bread @ meat @ bread)))
    got = regression.random_intercept(df, "y", ["x"], "g")

    def reml(ratio):
        cov = np.eye(90) + ratio * (g[:, None] == g[None, :])
        inv = np.linalg.inv(cov)
        a = design.T @ inv @ design
        r = y - design @ np.linalg.solve(a, design.T @ inv @ y)
        return -0.5 * (88 * np.log(r @ inv @ r / 88) + np.linalg.slogdet(cov)[1] + np.linalg.slogdet(a)[1])

    ratio = got["tau2"] / got["sigma2"]
    assert reml(ratio) >= max(reml(ratio * 0.9), reml(ratio * 1.1)) and abs(got["beta"][1] - 1.5) < 0.2
    boot = regression.cluster_bootstrap(df, "y", ["x"], "g", 200, 1)
    assert abs(boot["beta"][:, 1].mean() - got["beta"][1]) < 0.1 and ((boot["r2"] > 0) & (boot["r2"] < 1)).all()


def direct_races(rows):
    """Least squares of (athlete, race, y, weight) rows: centred race effects by race."""
    people, races = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    design = np.zeros((len(rows), len(people) + len(races)))
    for k, (a, r, _, g) in enumerate(rows):
        design[k, people.index(a)] = design[k, len(people) + races.index(r)] = math.sqrt(g)
    v = np.linalg.lstsq(design, np.array([y * math.sqrt(g) for _, _, y, g in rows]), rcond=None)[0][len(people) :]
    return dict(zip(races, v - v.mean(), strict=True))


def test_bootstrap_refits_are_weighted_least_squares(spark):
    cells, _, _ = synthetic(spark, n=60, races=12)
    weights = inference.bootstrap_weights(cells.select("athlete_id").distinct(), 3, 7)
    g = {(r["run_id"], r["athlete_id"]): r["g"] for r in weights.collect()}
    got = {(r["run_id"], r["race_id"]): r["v"] for r in inference.bootstrap_refits(cells, weights).collect()}
    rows = cells.collect()
    for run in (1, 2, 3):
        want = direct_races([(r["athlete_id"], r["race_id"], r["y"], g[run, r["athlete_id"]]) for r in rows])
        assert all(abs(got[run, r] - v) < 1e-7 for r, v in want.items())
    u, v = model.sweeps(cells, 2)
    once = {(r["run_id"], r["race_id"]): r["v"] for r in inference.bootstrap_races(cells, u, weights).collect()}
    assert max(abs(once[k] - got[k]) for k in got) > 1e-4  # one step from the point fit is something else
    warm = {(r["run_id"], r["race_id"]): r["v"] for r in inference.bootstrap_refits(cells, weights, v).collect()}
    assert all(abs(warm[k] - got[k]) < 1e-7 for k in got)


def test_leave_out_refits_prune_and_fit_each_run(spark):
    rng, rows = np.random.default_rng(5), []
    day = datetime.date(2000, 1, 1)
    for a in range(40):
        for r in rng.choice(10, 6, replace=False) if a < 36 else (10, 11, 12, 13):  # the last four athletes are a component of their own
            rows.append((a, int(r), math.exp(9 + 0.1 * rng.normal() + 0.05 * (r % 4)), day, None if a == 3 else "ABC"[a % 3]))
    timed = spark.createDataFrame(rows, "athlete_id long, race_id long, t double, date date, country string").withColumn("yob", F.lit(None).cast("double"))
    spec = slices.SliceSpec(min_race_count=4, min_field=2)
    runs = spark.createDataFrame([("A",), ("B",), ("nobody",)], "country string")
    found = sensitivity.leave_out_refits(timed, "country", runs, spec)
    got = {(r["left_out"], r["race_id"]): r["v"] for r in found.collect()}
    base = None
    for out in ("A", "B", "nobody"):
        cells = slices.giant_component(slices.prune(timed.filter(~F.coalesce(F.col("country") == out, F.lit(False))), spec)).collect()
        want = direct_races([(r["athlete_id"], r["race_id"], math.log(r["t"]), 1.0) for r in cells])
        assert {r for o, r in got if o == out} == set(want)
        assert all(abs(got[out, r] - v) < 1e-7 for r, v in want.items())
        base = want
    full = spark.createDataFrame([(r, float(v)) for r, v in base.items()], "race_id long, v double")
    shifts = {r["left_out"]: r["max_shift"] for r in sensitivity.leave_out_summary(found, full).collect()}
    assert shifts["nobody"] == 0 and shifts["A"] > 0


def test_mismatch_sweep_breaks_joins_and_both(spark):
    rng, day = np.random.default_rng(6), datetime.date(2000, 1, 1)
    rows = [(a, int(r), float(9 + 0.05 * rng.normal()), day + datetime.timedelta(int(r)), 1970.0) for a in range(40) for r in rng.choice(24, 6, replace=False)]
    cells = spark.createDataFrame(rows, "athlete_id long, race_id long, y double, date date, yob double")
    sexes = spark.createDataFrame([(a, "M") for a in range(40)], "athlete_id long, sex string")
    got = sensitivity.mismatch_sweep(cells, sexes, ["break", "join", "both"], [0.0, 0.5], 2, 3, slices.SliceSpec(min_race_count=2, min_field=2)).collect()
    assert {(r["op"], r["p"], r["run_id"]) for r in got} == {(o, p, k) for o in ("break", "join", "both") for p in (0.0, 0.5) for k in (1, 2)}
    assert all((r["max_shift"] == 0) == (r["p"] == 0) for r in got)
    pairs = sensitivity.join_labels(cells, sexes, 0.25, 53, runs=spark.range(1, 3).withColumnRenamed("id", "run_id")).collect()
    for run in (1, 2):
        to = {r["partner"]: r["athlete_id"] for r in pairs if r["run_id"] == run}
        want, full = (direct_races([(f(a), r, y, 1.0) for a, r, y, _, _ in rows]) for f in (lambda a: to.get(a, a), lambda a: a))
        shift = max(abs(want[r] - full[r]) for r in full)
        assert to and abs(next(r["max_shift"] for r in got if (r["op"], r["p"], r["run_id"]) == ("join", 0.5, run)) - shift) < 2e-6


def test_runs_as_bits_hold_each_cell_once(spark):
    rng, rows = np.random.default_rng(6), []
    for a in range(60):
        for r in rng.choice(12, 7, replace=False) if a < 54 else (12, 13, 14, 15, 16):
            rows.append((a, int(r), math.exp(9 + 0.1 * rng.normal()), datetime.date(2000 + int(r), 1, 1), "ABCD"[a % 4], 1970.0 if a % 5 else None))
    timed = spark.createDataFrame(rows, "athlete_id long, race_id long, t double, date date, country string, yob double")
    spec = slices.SliceSpec(min_race_count=5, min_field=3, min_age=31.0)
    marked = slices.cut(timed.withColumn("alive", sum((F.when(F.col("country") != c, F.lit(1 << i)).otherwise(0) for i, c in enumerate("ABCD")), F.lit(0)).cast("long")))
    found = sensitivity.giant_runs(sensitivity.prune_runs(marked, spec, 4), 4)
    assert found.count() == found.select("athlete_id", "race_id").distinct().count() <= len(rows)
    for i, c in ((0, "A"), (2, "C")):
        want = slices.giant_component(slices.prune(timed.filter(F.col("country") != c), spec)).select("athlete_id", "race_id").collect()
        got = found.filter(F.shiftright("alive", i) % 2 == 1).select("athlete_id", "race_id").collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and want
