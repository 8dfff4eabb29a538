"""The one-job fits against plain block updates, many runs against single ones, persistence, and the operators built on them."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from paceline.operators import engine, full, inference, model, ranking, regression, selection, sensitivity, slices, synthetic
from paceline.operators.slices import SliceSpec
from paceline.sources import registry, scratch, tables


@pytest.fixture(scope="module")
def truth(spark):
    return synthetic.generate(spark, 150, 24, 0.6, seed=11, nu=6.0, drift=0.01, slope=0.004)


def block_updates(rows, config, x, til, eligible, rel, date, sweeps):
    """Plain sweeps in the published order: weights, races, abilities, coefficients, drifts, scales, gauges."""
    who = np.unique([r["athlete_id"] for r in rows], return_inverse=True)[1]
    race = np.unique([r["race_id"] for r in rows], return_inverse=True)[1]
    y = np.array([r["y"] for r in rows])
    n, m = who.max() + 1, race.max() + 1
    t = np.zeros(m)
    t[race] = date
    u, v, d, theta = np.bincount(who, y) / np.bincount(who), np.zeros(m), np.zeros(n), np.zeros(len(x))
    s2, omega2, nu = y.var(), config.omega2, config.nu
    pv = np.zeros(n)
    for _ in range(sweeps):
        r = y - u[who] - v[race] - theta @ x - d[who] * til
        w = np.ones(len(y)) if math.isinf(nu) else (nu + 1) / (nu + r * r / s2)
        wide = w * rel
        step = np.bincount(race, wide * r, m) / np.bincount(race, wide, m)
        v, r = v + step, r - step[race]
        step = np.bincount(who, w * r, n) / np.bincount(who, w, n)
        u, r = u + step, r - step[who]
        if len(x):
            move = np.linalg.solve((x * wide) @ x.T + 1e-12 * np.eye(len(x)), x @ (wide * r))
            theta, r = theta + move, r - move @ x
        if config.drift:
            ridge = s2 / omega2
            top, low = np.bincount(who, w * til * r, n) - ridge * d, np.bincount(who, w * til * til, n) + ridge
            new = np.where(eligible, d + top / low, 0.0)
            r = r - til * (new - d)[who]
            d, pv = new, np.where(eligible, s2 / low, 0.0)
        s2 = (w * r * r).mean()
        if config.drift:
            omega2 = (d * d + pv)[eligible].mean()
        if len(x):
            tc = t - t.mean()
            c = (v * tc).sum() / (tc * tc).sum()
            v, theta[0] = v - c * tc, theta[0] + c
            u = u + np.bincount(who, c * (t[race] - t.mean()) - c * x[0], n) / np.bincount(who)
        u, v = u + v.mean(), v - v.mean()
    return v, theta, s2, omega2


@pytest.mark.parametrize(
    "config",
    [
        full.FullConfig(8.0),
        full.FullConfig(8.0, "spline", knots=(0.0, 2.0, 4.0, 7.0), gamma="scalar", reliability=3.0),
        full.FullConfig(math.inf, "poly", degree=2, gamma="varying"),
        full.FullConfig(8.0, "poly", degree=2, gamma="scalar", drift=True, omega2=1e-4, loglik_tol=0.0, tol=1e-9),
    ],
    ids=["student", "spline", "poly", "drift"],
)
def test_full_fits_match_block_updates(truth, config):
    got = full.fit(truth.cells, config)
    ready, names, _, _ = full.design(truth.cells, config)
    rows = ready.join(truth.cells.select("athlete_id", "race_id", "date"), ["athlete_id", "race_id"]).collect()
    x = np.array([[r[c] for r in rows] for c in names]).reshape(len(names), len(rows))
    til = np.array([r["til"] for r in rows]) if config.drift else np.zeros(len(rows))
    date = np.array([(r["date"].toordinal() - 730120) / 365.25 for r in rows])
    eligible = np.zeros(0)
    if config.drift:
        by = {r["athlete_id"]: r["eligible"] for r in rows}
        eligible = np.array([by[k] for k in sorted(by)])
    rel = np.array([r["rel"] for r in rows]) if config.reliability else np.ones(len(rows))
    v, theta, s2, omega2 = block_updates(rows, config, x, til, eligible, rel, date, 4000 if config.drift else 1500)
    fitted = [r["v"] for r in got.fits.races.orderBy("race_id").collect()]
    tolerance = 1e-5 if config.drift else 1e-7
    assert np.allclose(fitted, v, atol=tolerance) and got.fits.sigma2 == pytest.approx(s2, rel=1e-3 if config.drift else 1e-6)
    assert np.allclose(got.theta, theta, atol=10 * tolerance)
    if config.drift:
        assert got.fits.scales.first()["omega2"] == pytest.approx(omega2, rel=0.02)


def test_many_runs_are_single_fits(spark, truth):
    cells = truth.cells.select("athlete_id", "race_id", "y")
    marked = inference.folds(cells, 3, 5)
    config = engine.EngineConfig(nu=8.0)
    fits = inference.fold_fits(marked, 3, config)
    for fold in range(3):
        alone = engine.fit_runs(marked.filter(F.col("fold") != fold), config=config)
        a, b = ({r["race_id"]: r["v"] for r in f.collect()} for f in (fits.races.filter(F.col("run_id") == fold), alone.races))
        assert a == pytest.approx(b, abs=1e-9)
    rows = marked.withColumn("run_id", F.explode(F.array(*(F.lit(k).cast("long") for k in range(3))))).filter("fold <> run_id")
    keyed = engine.fit_runs(rows, [0, 1, 2], config, by_row=True)
    a, b = ({(r["run_id"], r["race_id"]): r["v"] for r in f.races.collect()} for f in (fits, keyed))
    assert a == pytest.approx(b, abs=1e-9)


def test_folds_beyond_the_limit_are_fitted_some_at_a_time(spark, truth):
    marked = inference.folds(truth.cells.select("athlete_id", "race_id", "y"), 3, 5)
    whole, parts = (inference.fold_fits(marked, 3, engine.EngineConfig(nu=(math.inf, 8.0), race_limit=n), score=True) for n in (5_000_000, 100))
    for name, key in (("races", ["run_id", "race_id"]), ("held_out", ["run_id"])):
        a, b = ([tuple(r) for r in getattr(f, name).orderBy(*key).collect()] for f in (whole, parts))
        assert len(a) == len(b) and all(x == pytest.approx(y, abs=1e-7) for x, y in zip(a, b, strict=True))
    rest = inference.held_out_residuals(marked, whole, 3, 2).filter("r is not null").groupBy("run_id").agg(F.count("*").alias("n"), F.sum(F.col("r") ** 2).alias("sq"))
    want, got = ({r["run_id"]: (r["n"], r["sq"]) for r in f.collect()} for f in (rest, parts.held_out))
    assert all(got[k] == pytest.approx(want[k], rel=1e-6) for k in want) and len(want) == len(got) == 6


def test_sums_by_small_blocks_give_the_same_fit(spark, truth, monkeypatch):
    cells = inference.with_weights(truth.cells.select("athlete_id", "race_id", "y", F.col("a_n").alias("x")), 2, 7)
    fit = lambda: engine.fit_runs(cells, [1, 2], engine.EngineConfig(nu=8.0), ("x",))
    whole = fit()
    monkeypatch.setattr(engine, "BLOCK", 7)
    parts = fit()
    a, b = ({(r["run_id"], r["race_id"]): r["v"] for r in f.races.collect()} for f in (whole, parts))
    assert a == pytest.approx(b, abs=1e-9) and len(a) == 48
    assert np.allclose([whole.theta[r] for r in (1, 2)], [parts.theta[r] for r in (1, 2)], atol=1e-8)


def test_gaussian_runs_agree_with_the_form_without_a_limit(spark, truth):
    cells = inference.with_weights(truth.cells.select("athlete_id", "race_id", "y"), 3, 7)
    got = engine.fit_runs(cells, [1, 2, 3], engine.EngineConfig(nu=math.inf)).races
    want = model.refits(truth.cells.select("athlete_id", "race_id", "y").join(inference.bootstrap_weights(truth.cells.select("athlete_id").distinct(), 3, 7), "athlete_id"))
    a, b = ({(r["run_id"], r["race_id"]): r["v"] for r in f.collect()} for f in (got, want))
    assert a == pytest.approx(b, abs=1e-7)
    with pytest.raises(ValueError):
        engine.fit_runs(cells, [1, 2, 3], engine.EngineConfig(race_limit=30))


def test_recovery_and_prediction(spark, truth):
    one = synthetic.recovery(truth, full.fit(truth.cells, full.FullConfig(6.0, "poly", degree=1, drift=True, tol=1e-8, loglik_tol=1e-9)).fits).first()
    assert one["r_v"] > 0.9 and one["r_u"] > 0.95 and 0.8 < one["sigma2_ratio"] < 1.25
    fitted = full.fit(truth.cells, full.FullConfig(6.0, "poly", degree=2, gamma="scalar"))
    told = full.predict(truth.cells, fitted)
    e = told.agg(F.avg((F.col("y") - F.col("yhat")) ** 2)).first()[0]
    assert 0.5 * truth.sigma2 < e < 3 * truth.sigma2
    dof = full.effective_dof(fitted)
    assert dof["aging"] == 2 and dof["gamma"] == 1 and full.n_params(fitted) == dof["u_v"] + 3 + 1


def test_fits_survive_saving_and_are_found_again(spark, truth, tmp_path):
    spec, config = SliceSpec(sex="W", date_from="2014-01-01", date_to="2025-12-31", min_race_count=2), full.FullConfig(8.0, "poly", degree=2)
    fitted = full.fit(truth.cells, config)
    path = registry.fit_path(f"file://{tmp_path}/fits", spec, config)
    registry.save_fit(spark, path, fitted)
    back = registry.load_fit(spark, path)
    assert back.config == config and np.allclose(back.theta, fitted.theta)
    assert sorted(map(tuple, back.fits.races.collect())) == sorted(map(tuple, fitted.fits.races.collect()))
    index = f"file://{tmp_path}/registry"
    registry.register(spark, index, [registry.manifest(spec, fitted, "base", path)])
    registry.register(spark, index, [registry.manifest(spec, fitted, "half", path + "h")])
    assert registry.query(spark, index, resample=["half"]).count() == 1 and registry.query(spark, index, stem="A?_nu8*").count() == 2
    assert registry.slice_slug(spec) == "ALL_W_14-25_mrc2" and registry.parse_slug("ALL_W_14-25_mrc2") == {"cohort": None, "sex": "W", "from": 14, "to": 25, "min_race_count": 2}
    clash = registry.preflight(spark, index, spec, config).collect()
    assert sorted((r["clash"], r["differs"]) for r in clash) == [("same fit", ""), ("same name", "resample")]
    assert registry.preflight(spark, index, SliceSpec(), config).count() == 0


def test_forms_without_a_curve_score_like_the_plain_fit(spark, truth):
    marked = slices.cut(inference.folds(truth.cells, 3, 3))
    scores = full.form_scores(marked, 3, {"none": full.baseline(8.0), "line": full.FullConfig(8.0, "poly", degree=1)})
    plain = inference.held_out(marked, inference.fold_fits(marked, 3, engine.EngineConfig(nu=8.0)), 8.0, 3)
    a, b = ({r["fold"]: r["logdensity"] for r in f.collect()} for f in (scores.filter("form = 'none'"), plain))
    assert a == pytest.approx(b, abs=1e-3)
    assert len(full.candidates()) == 54


def test_coordinate_descent_reaches_the_solution():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(50, 4))
    gram, b = x.T @ x, x.T @ rng.normal(size=50)
    assert np.allclose(full.coordinate_descent(gram, b, np.zeros(4), 200), np.linalg.solve(gram, b))
    q = x @ full.orthonormal(gram, 50)
    assert np.allclose(q.T @ q / 50, np.eye(4))


def test_descriptors_of_a_known_curve(spark):
    points = spark.range(401).select((F.col("id") / 100).alias("a_n")).withColumn("career", F.col("a_n") * (F.col("a_n") - 2) * 0.05)
    one = full.curve_descriptors(points).first()
    assert one["peak_age"] == 1.0 and one["span"] == pytest.approx(2.0, abs=1e-3) and not one["censored"]
    assert one["end_pct"] == pytest.approx(100 * math.expm1(0.4), abs=1e-3)


def test_tiers_dominance_and_kendall_match_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(r, f"s{i:02d}", float(x)) for i in range(14) for r, x in enumerate(rng.normal(i * 0.6, 1.0, 9), 1)]
    medians = spark.createDataFrame(rows, "run_id long, series_key string, m double")
    by = {}
    for r, s, x in rows:
        by.setdefault(s, {})[r] = x
    p = {(a, b): np.mean([by[a][r] < by[b][r] for r in by[a]]) for a in by for b in by if a != b}
    for block in (512, 4):
        got = {(r["first"], r["second"]): r["p_faster"] for r in ranking.dominance(medians, block).collect()}
        assert got == pytest.approx(p)
    own = [(s, float(np.median(list(x.values())))) for s, x in by.items()]
    assert [(r["series_key"], r["tier"]) for r in ranking.tiers(medians, 0.8).orderBy("median", "series_key").collect()] == ranking.leader_tiers(own, p, 0.8)
    xy = [(i, float(rng.integers(0, 12)), float(rng.integers(0, 9))) for i in range(60)]
    sign = lambda a, b: (a > b) - (a < b)
    s = sum(sign(a[1], b[1]) * sign(a[2], b[2]) for i, a in enumerate(xy) for b in xy[:i])
    kx, ky = (sum(a[k] != b[k] for i, a in enumerate(xy) for b in xy[:i]) for k in (1, 2))
    assert ranking.kendall(spark.createDataFrame(xy, "race_id long, x double, y double")).first()[0] == pytest.approx(s / math.sqrt(kx * ky), abs=1e-6)


def test_four_fits_resist_an_outlier(spark):
    rng = np.random.default_rng(8)
    rows = [(float(x), float(2 * x + 0.1 * rng.normal() + (30 if i == 5 else 0)), 1.0 if i % 2 else 0.5) for i, x in enumerate(rng.normal(size=80))]
    found = {r["kind"]: r["beta"] for r in regression.four_fits(spark.createDataFrame(rows, "x double, y double, w double"), "y", ["x"], "w").collect()}
    assert abs(found["Robust"] - 2) < 0.1 and abs(found["Robust+WLS"] - 2) < 0.1 and abs(found["OLS"] - 2) > abs(found["Robust"] - 2)


def test_crossings_votes_and_quadratic_gaps(spark):
    points = spark.createDataFrame([("a", 0.1, 0.5), ("a", 0.2, 1.5), ("b", 0.1, 0.2), ("b", 0.2, 0.4)], "op string, p double, y double")
    assert {r["op"]: r["at_one"] for r in sensitivity.crossing(points, "p", "y", "op").collect()} == {"a": pytest.approx(0.15), "b": math.inf}
    scores = spark.createDataFrame([(n, f, x) for f in range(3) for n, x in ((4, 1.0), (8, 1.5 - f / 100), (15, 1.495))], "nu int, fold int, x double")
    assert selection.votes(scores, 0.01, [4, 8, 15]).first()[0] in (8, 15)
    a = np.linspace(0, 5, 30)
    assert regression.quadratic_gap(list(a), list(0.3 * a - 0.02 * a * a), list(0 * a)) == pytest.approx((0.3, -0.02, 0.0), abs=1e-9)


def test_connectivity_chains_and_indexes(spark):
    chain = spark.createDataFrame([(i, j) for i in range(60) for j in (i, i + 1)], "athlete_id long, race_id long")
    assert slices.is_connected(chain) and not slices.is_connected(chain.filter("athlete_id <> 30"))
    ids = spark.createDataFrame([(x,) for x in (9, -4, 7, 7, 1000, 3)], "k long")
    assert {r["k"]: r["i"] for r in slices.dense_index(ids, "k", "i").collect()} == {-4: 0, 3: 1, 7: 2, 9: 3, 1000: 4}
    seen = spark.createDataFrame([(5, 9), (5, 1), (6, 2), (4, 2)], "k long, at long")
    assert {r["k"]: r["i"] for r in slices.first_seen_index(seen, "k", "at", "i").collect()} == {5: 0, 4: 1, 6: 2}


def test_cached_tables_follow_the_content(spark, tmp_path):
    at = str(tmp_path / "in.parquet")
    spark.range(5).write.parquet(at)
    one = tables.fingerprint(spark, [at])
    built = []
    make = lambda: built.append(1) or spark.range(3)
    key = (one, str(tmp_path))
    assert [tables.cached(spark, "t", key, make).count() for _ in range(2)] == [3, 3] and len(built) == 1
    spark.range(6).write.mode("overwrite").parquet(at)
    assert tables.fingerprint(spark, [at]) != one
    table = scratch.written(spark.range(4), "test")
    assert table.count() == 4
    scratch.discard(table)
    assert not scratch.hadoop(spark, table.scratch_path)[1].exists(scratch.hadoop(spark, table.scratch_path)[0])


def test_replicates_beyond_the_limit_are_fitted_some_at_a_time(spark, truth):
    cells = truth.cells.select("athlete_id", "race_id", "y")
    point = engine.fit_runs(cells, config=engine.EngineConfig(nu=8.0))
    assert len(point.trace) <= 11  # 13 by reweighted steps
    start = point.races.select("race_id", "v")
    whole, parts = (inference.replicate_fits(cells, [1, 2, 3], 7, engine.EngineConfig(nu=8.0, race_limit=n), start, point.sigma2) for n in (5_000_000, 50))
    a, b = ([tuple(r) for r in f.races.select("run_id", "race_id", "v").orderBy("run_id", "race_id").collect()] for f in (whole, parts))
    assert len(a) == len(b) == 72 and all(x == pytest.approx(y, abs=1e-10) for x, y in zip(a, b, strict=True))
    assert engine.at_once(1000, terms=8) <= engine.at_once(1000) // 3  # means of covariates are held too


def test_counts_of_dominance_are_those_of_its_matrix(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=40) * 1.5
    rows = [(run, f"s{i:02d}", round(float(base[i] + rng.normal()), 1)) for i in range(40) for run in range(10) if i % 7 or run % 3]
    m = {}
    for run, name, x in rows + [(99, "alone", 0.0)]:
        m.setdefault(name, {})[run] = x
    want = {}
    for a in m:
        met = [[m[a][r] < m[b][r] for r in m[a] if r in m[b]] for b in m if b != a]
        shares = [sum(z) / len(z) for z in met if z]
        if shares:
            want[a] = (sum(p >= 0.9 for p in shares), sum(p <= 0.1 for p in shares))
    medians = spark.createDataFrame(rows + [(99, "alone", 0.0), (1, None, 5.0)], "run_id long, series_key string, m double")
    for block in (2048, 7):
        got = {r["series_key"]: (r["n_slower_conf"], r["n_faster_conf"]) for r in ranking.dominance_counts(medians, 0.9, block).collect()}
        assert got == want


def test_groups_of_runs_share_dealt_cells_and_means_stay_in_the_tasks(spark, truth, monkeypatch):
    cells = inference.with_weights(truth.cells.select("athlete_id", "race_id", "y", F.col("a_n").alias("x")), 3, 7)
    dealt, sent = [], []
    deal, sweep = engine._dealt, engine._swept
    monkeypatch.setattr(engine, "_dealt", lambda *a: dealt.append(1) or deal(*a))

    def swept(*args):
        got = list(sweep(*args))
        sent.append((len(args[2].v), [len(step) for _, step, *_ in got]))
        return iter(got)

    monkeypatch.setattr(engine, "_swept", swept)
    fit = lambda n: engine.fit_runs(cells, [1, 2, 3], engine.EngineConfig(nu=8.0, group_limit=n), ("x",), score=True)
    whole, parts = fit(engine.EngineConfig().group_limit), fit(48)
    assert len(dealt) == 2  # each fit deals once, however many its groups
    assert {n for n, _ in sent} == {3, 2, 1} and all(lengths == [24] * len(lengths) for _, lengths in sent)  # a step a race, no means
    for name, key in (("races", ["run_id", "race_id"]), ("athletes", ["run_id", "athlete_id"]), ("scales", ["run_id"]), ("held_out", ["run_id"])):
        a, b = ([tuple(r) for r in getattr(f, name).drop("n_iter").orderBy(*key).collect()] for f in (whole, parts))
        assert len(a) == len(b) and all(x == pytest.approx(y, abs=1e-8) for x, y in zip(a, b, strict=True))


def test_tasks_hold_fewer_cells_where_there_are_covariates(spark, truth):
    cells = truth.cells.select("athlete_id", "race_id", "y", F.col("a_n").alias("x"), *((F.col("a_n") * k).alias(f"x{k}") for k in range(2, 7)))
    config = engine.EngineConfig(per_partition=cells.count() // 5)
    deal = lambda *names: engine._dealt(cells, names, config, [0], False, None, np.ones((1, len(names)), dtype=bool))[0]
    bare, wide = deal(), deal("x", *(f"x{k}" for k in range(2, 7)))
    assert 5 <= bare.rdd.getNumPartitions() <= 6 and wide.rdd.getNumPartitions() >= 10
    assert engine.EngineConfig().per_partition <= 1_000_000 and engine.EngineConfig().group_limit <= 250_000


def test_steps_travel_as_a_byte_a_race_and_athletes_are_solved_some_at_a_time():
    rng = np.random.default_rng(3)
    step = rng.normal(size=5_000) * np.repeat([1.0, 1e-9], 2_500)
    step[[7, 4_999]] = np.nan
    single = engine.narrowed(step.astype(np.float32))
    packed = engine.narrowed(step)
    back = engine.widened(packed, len(step))
    assert len(single) == len(packed) < 1.1 * len(step)  # four bytes a race before
    for at in range(0, len(step), engine.SCALED):
        a, b = step[at : at + engine.SCALED], back[at : at + engine.SCALED]
        assert (np.isnan(a) == np.isnan(b)).all() and np.nanmax(np.abs(a - b)) <= np.nanmax(np.abs(a)) / 253
    assert (engine.widened(engine.narrowed(np.array([0.0, np.nan])), 2)[:1] == 0).all()

    counts = rng.integers(1, 60, 3_000)
    n = counts.sum()
    rest, g, til, eligible = rng.standard_t(4, n), rng.random(n) + 0.1, rng.normal(size=n), counts >= 5
    for x, ok in ((None, None), (til, eligible)):
        got, want = (f(rest, counts, g, x, ok, 0.8, 0.01, 8.0, 1e-14) for f in (engine.solve_athletes, engine._solved))
        assert n > 2 * engine.TOGETHER and all(np.allclose(a, b, atol=1e-11) for a, b in zip(got, want, strict=True))
