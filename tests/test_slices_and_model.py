"""Slice preparation and the model on small tables, against brute force and known truth."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF
from paceline.functions import scalars
from paceline.operators import inference, model, ranking, regression, slices
from paceline.operators.slices import SliceSpec
from paceline.sources import tables

CELLS = "athlete_id long, race_id long, t double, date date, yob double"


def cells_of(spark, pairs, yob=None):
    rows = [(a, r, 8000.0, None, yob) for a, r in pairs]
    return spark.createDataFrame(rows, CELLS).withColumn("date", F.make_date(F.lit(2000) + F.col("race_id").cast("int"), F.lit(5), F.lit(1)))


def brute_prune(pairs, mrc, field):
    while True:
        a = {p for p, _ in pairs if sum(q == p for q, _ in pairs) >= mrc}
        one = [(p, r) for p, r in pairs if p in a]
        b = {r for _, r in one if sum(s == r for _, s in one) >= field}
        new = [(p, r) for p, r in one if r in b]
        if len(new) == len(pairs):
            return set(new)
        pairs = new


@pytest.mark.parametrize("seed", range(3))
def test_pruning_cascades_like_brute_force(spark, seed):
    rng = random.Random(seed)
    pairs = sorted({(rng.randrange(30), rng.randrange(12)) for _ in range(120)})
    spec = SliceSpec(min_race_count=3, min_field=6)
    got = {(r["athlete_id"], r["race_id"]) for r in slices.prune(cells_of(spark, pairs), spec).collect()}
    assert got == brute_prune(pairs, 3, 6)


def test_age_band_moves_with_the_debut_and_keeps_unknown_ages(spark):
    spec = SliceSpec(min_age=30, min_race_count=1, min_field=1)
    known, unknown = cells_of(spark, [(1, 1), (1, 12)], 1975.0), cells_of(spark, [(2, 1)], None)
    got = {(r["athlete_id"], r["race_id"]) for r in slices.prune(known.union(unknown), spec).collect()}
    assert got == {(2, 1)}


def test_giant_component_counts_cells(spark):
    big = [(a, r) for a in range(4) for r in (1, 2, 3)]
    small = [(a, r) for a in range(10, 15) for r in (7, 8)]
    got = {r["race_id"] for r in slices.giant_component(cells_of(spark, big + small)).collect()}
    assert got == {1, 2, 3}


def test_components_meet_few_links_and_agree_with_brute_force(spark, monkeypatch):
    rng, seen, spread = random.Random(5), [], slices._spread
    monkeypatch.setattr(slices, "_spread", lambda links: seen.append(links.count()) or spread(links))
    dense = [(a, r) for a in range(60) for r in range(20)]
    sparse = sorted({(100 + rng.randrange(60), 100 + rng.randrange(60)) for _ in range(75)})
    label = {r: r for _, r in dense + sparse}
    for _ in range(60):
        low = {}
        for a, r in dense + sparse:
            low[a] = min(low.get(a, r), label[r])
        for a, r in dense + sparse:
            label[r] = min(label[r], low[a])
    got = slices.race_components(cells_of(spark, dense + sparse).select("athlete_id", "race_id")).collect()
    assert {r["race_id"]: r["comp"] for r in got} == label and len(got) == len(label)
    assert seen[0] <= 2 * len(label) and sum(seen) < len(dense)


def test_empty_slice_is_an_error(spark):
    with pytest.raises(ValueError):
        slices.load_slice(spark, SF, SliceSpec(min_race_count=60, min_field=60))


def test_filters_keep_null_countries_unless_asked_for(spark):
    people = spark.createDataFrame([(1, "M", None), (2, "M", "A"), (3, "W", "B")], "athlete_id long, sex string, country string")
    ids = lambda spec: {r["athlete_id"] for r in slices.athlete_filter(people, spec).collect()}
    assert ids(SliceSpec(countries_exclude=("A",))) == {1, 3}
    assert ids(SliceSpec(countries_include=("A",))) == {2} and ids(SliceSpec(sex="W")) == {3}


def test_time_kinds_and_birth_years(spark):
    df = spark.createDataFrame([(None, 5.0, 1980, None), (4.0, 6.0, 1980, 1983), (None, None, None, None)], "chip_time_sec double, gun_time_sec double, yob_min int, yob_max int")
    got = df.select(*(slices.time_column(k).alias(k) for k in ("chip", "gun", "chip_else_gun")), slices.yob_mid().alias("yob")).collect()
    assert [tuple(r) for r in got] == [(None, 5.0, 5.0, 1980.0), (4.0, 6.0, 4.0, 1981.5), (None, None, None, None)]


def synthetic(spark, n=300, races=20, nu=math.inf, seed=1):
    rng = np.random.default_rng(seed)
    u, v = rng.normal(9.6, 0.2, n), rng.normal(0, 0.02, races)
    v -= v.mean()
    rows = []
    for a in range(n):
        for r in sorted(rng.choice(races, 8, replace=False)):
            noise = rng.normal(0, 0.03) / (1 if math.isinf(nu) else math.sqrt(rng.gamma(nu / 2, 2 / nu)))
            rows.append((a, int(r), float(u[a] + v[r] + noise), float(r) / 2))
    return spark.createDataFrame(rows, "athlete_id long, race_id long, y double, a_n double"), u, v


@pytest.mark.parametrize("nu", [math.inf, 6.0])
def test_fit_recovers_difficulty(spark, nu):
    cells, _, v = synthetic(spark, nu=nu)
    got = model.fit(cells, model.ModelConfig(nu=nu), model.FitConfig(max_iter=8, tol=1e-7))
    fitted = np.array([r["v"] for r in got.races.orderBy("race_id").collect()])
    assert np.corrcoef(fitted, v)[0, 1] > 0.97 and abs(fitted.mean()) < 1e-9
    assert all(b[1] >= a[1] - 1e-6 * abs(a[1]) for a, b in zip(got.trace, got.trace[1:], strict=False))


def test_career_curve_and_drift_run(spark):
    cells, _, _ = synthetic(spark, n=80)
    got = model.fit(cells, model.ModelConfig(knots=(0.0, 3.0, 6.0, 9.0), drift=True), model.FitConfig(max_iter=3))
    assert len(got.theta) == 3 and got.sigma2 > 0 and got.athletes.filter("d <> 0").count() > 0


def test_loo_delta_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(a, r, float(rng.normal()), float(rng.normal())) for a in range(12) for r in range(6)]
    got = {r["race_id"]: r["delta"] for r in inference.loo_delta(spark.createDataFrame(rows, "athlete_id long, race_id long, a_til double, r double")).collect()}
    for race in range(6):
        values = []
        for a in range(12):
            mine = [x for x in rows if x[0] == a]
            rest = [x for x in mine if x[1] != race]
            slope = sum(x[2] * x[3] for x in rest) / sum(x[2] ** 2 for x in rest)
            values.append(slope * next(x[2] for x in mine if x[1] == race))
        assert got[race] == pytest.approx(np.mean(values), abs=1e-6)


def test_permutation_keeps_each_athletes_values(spark):
    rows = [(a, r, 0.0, float(10 * a + r)) for a in range(5) for r in range(4)]
    moved = inference.permuted(spark.createDataFrame(rows, "athlete_id long, race_id long, a_til double, r double"), 3, 1).collect()
    for k in (1, 2, 3):
        for a in range(5):
            assert sorted(x["r"] for x in moved if x["k"] == k and x["athlete_id"] == a) == [10.0 * a + r for r in range(4)]


def test_folds_are_balanced_within_athletes(spark):
    cells, _, _ = synthetic(spark, n=40)
    counts = inference.folds(cells, 4, 5).groupBy("athlete_id", "fold").count().collect()
    assert {r["count"] for r in counts} == {2}


def test_regressions_match_numpy(spark):
    rng = np.random.default_rng(2)
    x, z = rng.normal(size=(2, 120))
    y = 1 + 2 * x - z + rng.normal(0, 0.5, 120)
    df = spark.createDataFrame([(float(a), float(b), float(c), i % 12) for i, (a, b, c) in enumerate(zip(x, z, y, strict=True))] + [(None, 1.0, 1.0, 0)], "x double, z double, y double, g int")
    design = np.stack([np.ones(120), x, z], axis=1)
    beta = np.linalg.lstsq(design, y, rcond=None)[0]
    assert np.allclose(regression.ols(df, "y", ["x", "z"])["beta"], beta)
    e = y - design @ beta
    meat = sum(np.outer(s, s) for s in (design[np.arange(120) % 12 == g].T @ e[np.arange(120) % 12 == g] for g in range(12)))
    bread = np.linalg.inv(design.T @ design)
    se = np.sqrt(np.diag(12 / 11 * 119 / 117 * bread @ meat @ bread))
    assert np.allclose(regression.cluster_robust(df, "y", ["x", "z"], "g")["se"], se)
    spoiled = df.withColumn("y", F.when(F.col("x") > 1.8, 50.0).otherwise(F.col("y")))
    assert abs(regression.huber(spoiled, "y", ["x", "z"])["beta"][1] - 2) < 0.6


def test_leader_tiers():
    own = [("a", 1.0), ("b", 1.1), ("c", 2.0)]
    assert ranking.leader_tiers(own, {("a", "b"): 0.6, ("a", "c"): 0.99}, 0.9) == [("a", 1), ("b", 1), ("c", 2)]


def test_replicates_that_miss_a_race_take_the_point(spark):
    point = spark.createDataFrame([(1, 0.5), (2, -0.5)], "race_id long, v double")
    runs = spark.createDataFrame([(1, 1, 0.4), (1, 2, -0.4), (2, 1, 0.6)], "run_id long, race_id long, v double")
    got = {(r["run_id"], r["race_id"]): r["v"] for r in ranking.align_replicates(runs, point).collect()}
    assert got == {(1, 1): 0.4, (1, 2): -0.4, (2, 1): 0.6, (2, 2): -0.5}


def test_scalars(spark):
    row = spark.range(1).select(
        scalars.clock(F.lit(3661.4)).alias("c"), scalars.irls_weight(F.lit(1.0), 1.0, 8.0).alias("w"), scalars.log_density(F.lit(0.3), 0.5, 5.0).alias("t"),
        scalars.log_density(F.lit(0.3), 0.5, math.inf).alias("g"), scalars.huber_weight(F.lit(2.69)).alias("h"), scalars.horner(F.lit(2.0), [1.0, 2.0, 3.0]).alias("p"),
    ).first()
    assert row["c"] == "1:01:01" and row["w"] == 1 and row["h"] == pytest.approx(0.5) and row["p"] == 17
    assert row["g"] == pytest.approx(-0.5 * (math.log(2 * math.pi * 0.5) + 0.09 / 0.5))
    const = math.lgamma(3) - math.lgamma(2.5) - 0.5 * math.log(5 * math.pi * 0.5)
    assert row["t"] == pytest.approx(const - 3 * math.log1p(0.09 / 2.5))


def test_tables(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, x string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k long, x string")
    assert {tuple(r) for r in tables.upsert(old, new, ["k"]).collect()} == {(1, "a"), (2, "c"), (3, "d")}
    assert {tuple(r) for r in tables.upsert_last([old, new], ["k"], "x").collect()} == {(1, "a"), (2, "c"), (3, "d")}
    path = str(tmp_path / "runs")
    tables.append_runs(spark.createDataFrame([(1, 0.1), (2, 0.2)], "run_id long, v double"), path)
    tables.append_runs(spark.createDataFrame([(2, 0.5)], "run_id long, v double"), path)
    assert {(r["run_id"], r["v"]) for r in spark.read.parquet(path).collect()} == {(1, 0.1), (2, 0.5)}
    where = str(tmp_path / "registry")
    tables.register_fit(spark, where, {"slice": "s"}, {"loglik": 1.5})
    tables.register_fit(spark, where, {"slice": "t"}, {"loglik": 2.5})
    assert tables.registry(spark, where, slice=["t"]).first()["loglik"] == 2.5


def test_entry_and_registration(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_hashed_uniforms_are_uniform_and_unrelated_to_neighbours(spark):
    got = spark.range(4000).select(scalars.hash_uniform(7, F.col("id")).alias("a"), scalars.hash_uniform(7, F.lit(5), F.col("id")).alias("b"), scalars.hash_uniform(7, F.lit(6), F.col("id")).alias("c")).collect()
    for k in "abc":
        x = np.array([r[k] for r in got])
        assert abs(x.mean() - 0.5) < 0.02 and abs(x.std() - 12**-0.5) < 0.02 and abs(np.corrcoef(x[1:], x[:-1])[0, 1]) < 0.06
    assert abs(np.corrcoef([r["b"] for r in got], [r["c"] for r in got])[0, 1]) < 0.06


@pytest.mark.parametrize("nu", [math.inf, 6.0])
def test_one_job_sweeps_agree_with_block_updates(spark, nu):
    cells, u, v = synthetic(spark, n=150, races=12, nu=nu)
    fast = model.fit_races(cells, nu, model.FitConfig(max_iter=60, tol=1e-9))
    slow = model.fit(cells, model.ModelConfig(nu=nu), model.FitConfig(max_iter=9, tol=1e-12))
    a = np.array([r["v"] for r in fast.races.orderBy("race_id").collect()])
    b = np.array([r["v"] for r in slow.races.orderBy("race_id").collect()])
    assert fast.converged and np.abs(a - b).max() < 2e-4 and np.corrcoef(a, v)[0, 1] > 0.95
    assert fast.sigma2 == pytest.approx(slow.sigma2, rel=1e-2)
    fitted = np.array([r["u"] for r in fast.athletes.orderBy("athlete_id").collect()])
    assert np.corrcoef(fitted, u)[0, 1] > 0.99
