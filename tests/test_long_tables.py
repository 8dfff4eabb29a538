"""What long tables go through, against plain computations: no task or driver may hold a column."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from paceline.operators import describe, engine, inference, quantiles, ranking, regression, synthetic

SHARES = [0.0, 0.01, 0.25, 0.5, 0.9, 0.999, 1.0]


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("kind", ["spread", "ties", "signs", "one"])
def test_quantiles_are_those_of_a_sorted_column(spark, kind):
    rng = np.random.default_rng(3)
    x = {"spread": rng.normal(size=5000) * 10.0 ** rng.integers(-200, 200, 5000), "ties": rng.integers(0, 4, 5000) / 3, "signs": np.r_[-0.0, 0.0, -1.5, 1.5, np.inf, -np.inf, 5e-324, -5e-324], "one": np.array([2.5])}[kind]
    df = spark.createDataFrame(pa.table({"x": pa.array(x), "by": pa.array([f"g{i % 3}" for i in range(len(x))])})).union(spark.createDataFrame([(None, "g0")], "x double, by string"))
    got = quantiles.quantiles(df.repartition(5), "x", SHARES, "by")
    for name, of in got.items():
        mine = np.sort(x if name is None else x[[f"g{i % 3}" == name for i in range(len(x))]])
        for p, value in zip(SHARES, of, strict=True):
            at = p * (len(mine) - 1)
            lo, hi = mine[int(np.floor(at))], mine[int(np.ceil(at))]
            assert value == pytest.approx(lo if lo == hi else (np.ceil(at) - at) * lo + (at - np.floor(at)) * hi, rel=1e-14)
    assert set(got) == {None, *(f"g{i % 3}" for i in range(len(x)))}


def test_finish_times_and_qq_hold_no_column_in_one_aggregate(spark):
    rng = np.random.default_rng(5)
    t = rng.integers(7100, 9000, 3000) / 4
    cells = spark.createDataFrame(pa.table({"athlete_id": np.arange(3000), "t": t}))
    people = cells.select("athlete_id", F.when(F.col("athlete_id") % 3 == 0, "W").otherwise("M").alias("sex"))
    out = describe.finish_times(cells, people)
    assert "percentile" not in plan(out)
    rows = {r["sex"]: r for r in out.collect()}
    for sex, of in (("W", t[::3]), ("All", t)):
        assert rows[sex]["n"] == len(of) and rows[sex]["mean"] == pytest.approx(of.mean(), abs=1e-4)
        assert [rows[sex][f"p{p}"] for p in (1, 10, 50, 90, 99)] == pytest.approx(np.quantile(of, [0.01, 0.1, 0.5, 0.9, 0.99]), abs=1e-6)
    straight = regression.qq(cells, "t", [0.1, 0.5])
    assert "percentile" not in plan(straight)
    assert [r["empirical"] for r in straight.collect()] == pytest.approx(np.quantile(t, [0.1, 0.5]))


def test_permutation_null_is_that_of_the_joined_tables(spark, monkeypatch):
    rng = np.random.default_rng(8)
    keys = [(a, 10 * int(r)) for a in range(40) for r in sorted(rng.choice(30, rng.integers(1, 12), replace=False))]
    x = rng.normal(size=len(keys))
    rest = spark.createDataFrame([(a, r, float(z), float(e)) for (a, r), z, e in zip(keys, x, 0.3 * x + rng.normal(size=len(keys)), strict=True)], "athlete_id long, race_id long, a_til double, r double").repartition(3)
    races = spark.createDataFrame([(10 * r, float(rng.normal()), float(1990 + r % 7)) for r in range(28)], "race_id long, v double, year double")  # two are not compared
    every = rest.withColumn("k", F.lit(0).cast("long")).unionByName(inference.permuted(rest, 5, 7)).toPandas()
    every["xy"], every["xx"] = every.a_til * every.r, every.a_til**2
    per = every.groupby(["k", "athlete_id"])
    every["sxy"], every["sxx"] = per.xy.transform("sum") - every.xy, per.xx.transform("sum") - every.xx
    every["delta"] = (every.sxy / every.sxx * every.a_til).where(every.sxx > 1e-9)
    delta = every.groupby(["k", "race_id"]).delta.mean().fillna(0.0).reset_index().merge(races.toPandas(), on="race_id")
    want = []
    for k, of in delta.groupby("k"):
        free = [of[c] - np.polyval(np.polyfit(of.year, of[c], 1), of.year) for c in ("delta", "v")]
        want.append((k, np.corrcoef(*free)[0, 1]))
    made = []
    monkeypatch.setattr(inference, "permuted", lambda *_: made.append(1))  # no row for each draw and cell
    monkeypatch.setattr(inference, "WAITING", 8 * 30 * 4 * 2)  # two draws at a time
    got = inference.year_free_correlations(rest, races, 5, 7)
    assert not made and [k for k, _ in got] == [k for k, _ in want] and [t for _, t in got] == pytest.approx([t for _, t in want], abs=1e-10)
    one = inference.permutation_null(rest, races, 5, 7).first()
    assert one["n_draws"] == 5 and one["t_obs"] == pytest.approx(want[0][1], abs=1e-5) and one["null_mean"] == pytest.approx(np.mean([t for _, t in want[1:]]), abs=1e-5)


def test_paths_of_sweeps_leave_the_driver_as_they_come(spark, monkeypatch):
    truth = synthetic.generate(spark, 60, 12, 0.7, seed=4, nu=6.0)
    held, wrote = [], engine._Paths._write

    def counted(self):
        held.append(sum(map(len, self.rows)))
        wrote(self)

    monkeypatch.setattr(engine._Paths, "_write", counted)
    got = engine.fit_runs(truth.cells, [0, 1], engine.EngineConfig(nu=8.0, group_limit=30), slots=None, keep_paths=True)
    rows = got.paths.collect()
    assert max(held) <= 30 and len(held) > 2 and sum(held) == len(rows) == 12 * len(got.history)
    last = {(r["run_id"], r["race_id"]): r["v"] for r in sorted(rows, key=lambda r: r["sweep"])}
    assert last == pytest.approx({(r["run_id"], r["race_id"]): r["v"] for r in got.races.collect()}, abs=1e-12)


def test_folds_are_bits_and_fit_as_arrays_do(spark):
    marked = inference.folds(synthetic.generate(spark, 60, 12, 0.7, seed=4, nu=6.0).cells, 3, 7)
    ready = inference.with_folds(marked, 3, whole=True)
    assert "g" not in ready.columns
    arrays = marked.withColumn("g", F.array(*((F.col("fold") != f).cast("double") for f in range(3)), F.lit(1.0)))
    a, b = (engine.fit_runs(c, [0, 1, 2, 3], engine.EngineConfig(nu=8.0), score=True) for c in (ready, arrays))
    of = lambda fits: {(r["run_id"], r["race_id"]): r["v"] for r in fits.races.collect()}
    assert of(a) == pytest.approx(of(b), abs=1e-12)
    held = [sorted(map(tuple, f.held_out.select("run_id", "n", "n_orphans", "logdensity").collect())) for f in (a, b)]
    assert [x for row in held[0] for x in row] == pytest.approx([x for row in held[1] for x in row], rel=1e-10)
    many = inference.with_folds(marked, 70)
    assert "bits" not in many.columns and len(many.first()["g"]) == 70


@pytest.mark.parametrize("n", [400, 1])
def test_kendall_by_parts_is_that_of_all_pairs(spark, n):
    rng = np.random.default_rng(6)
    x, y = rng.integers(0, 40, n) / 4, rng.integers(0, 60, n) / 8
    df = spark.createDataFrame(pa.table({"x": x, "y": y + x}))
    a, b = np.sign(np.subtract.outer(x, x)), np.sign(np.subtract.outer(y + x, y + x))
    got = ranking.kendall(df, block=30).first()["tau"]  # fourteen parts
    assert got is None if n == 1 else got == pytest.approx((a * b).sum() / np.sqrt((a != 0).sum() * (b != 0).sum()), abs=1e-6)
