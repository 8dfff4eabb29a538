"""Fits of the whole model, one job a sweep, for one run or for many runs at once.

log time = ability u + difficulty v + career curve and entry-age terms (covariates) + drift d times centred career age,
with Student-t noise.  Given what is global (race effects, coefficients of the covariates, scale, drift variance), an athlete's u
and d depend on its own cells alone.  Cells are therefore dealt by athlete once and kept; in a sweep each task solves its athletes
by Newton steps to convergence and returns weighted sums by race and cross products of the covariates, which are
added up by blocks of races.  Each block is turned into steps where it is summed, and its share of the coefficients' equations (the race block is
diagonal, so that only as many equations as there are covariates remain).  The driver solves those; where there are covariates, blocks wait for what that
moves.  Then they send their steps (a byte a race, or four with covariates: a step's error shrinks with it), and the driver applies the gauges and mixes the step with those before
it (Anderson).

Runs (bootstrap replicates, folds, left-out groups, candidate forms, noise laws and prior variances) are weights by athlete (a table of
arrays with a value for each run), weights by cell ``g`` (such an array, 0 for cells that are not in a run; or a long ``bits`` where all are 0 or 1) or a column ``run_id`` of the cells.  All
active runs share each job.  A run may have a noise law, a prior variance and a choice of covariates of its own.

Runs whose race effects are more than ``group_limit`` in all are fitted in groups, one after the other, from the same dealt cells, so that the driver holds
no more (and one run at least).  Cells are dealt for runs of at most ``race_limit`` race effects in all; ``chunked`` fits more runs than that, some at a time, and
``model.refits`` is the form without that limit.  A task holds about ``per_partition`` cells and weights, fewer with covariates, and so sums of as many races at most.  Fits that end at ``max_iter`` sweeps
are named in a warning and marked in ``scales``.
"""

from __future__ import annotations

import math
import uuid
import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.operators.slices import cut
from paceline.sources.scratch import hadoop, shared_dir

#: Races whose sums travel together.
BLOCK = 16_384
#: Races whose steps share a scale on their way to the driver.
SCALED = 512
#: Cells of athletes that are solved together, so that what is computed of them stays in the processor's cache.
TOGETHER = 16_384
#: The smallest part of a cell's weight that counts as curvature.
FLOOR = 0.05


@dataclass(frozen=True)
class EngineConfig:
    nu: float | tuple[float, ...] = 8.0  # one for all runs, or one for each
    drift: bool = False
    omega2: float | tuple[float, ...] = 1e-4  # where it starts, one for all runs or one for each
    omega2_fixed: bool | tuple[bool, ...] = False
    tol: float = 1e-12
    loglik_tol: float = 0.0  # also ends a run whose log likelihood changes relatively by no more
    max_iter: int = 200
    memory: int = 5
    race_limit: int = 5_000_000
    group_limit: int = 250_000
    per_partition: int = 1_000_000


@dataclass
class Fits:
    """races (run_id, race_id, v), athletes (run_id, athlete_id, u, d, pv, n), scales (run_id, sigma2, omega2, loglik, n, n_iter,
    converged) and theta by run; trace has (sweep, largest change), history (run_id, sweep, loglik, sigma2, omega2, change)."""

    races: DataFrame
    athletes: DataFrame
    scales: DataFrame
    theta: dict[int, np.ndarray]
    trace: list[tuple[int, float]] = field(default_factory=list)
    history: list[tuple[int, int, float, float, float, float]] = field(default_factory=list)
    paths: DataFrame | None = None  # run_id, sweep, race_id, v, if asked for
    held_out: DataFrame | None = None  # run_id, n, n_orphans, logdensity, sq: of the cells with weight 0 in a run, if asked for

    @property
    def sigma2(self) -> float:
        """The scale of the only run."""
        return self.scales.first()["sigma2"]


def _weights(e: np.ndarray, s2: float, nu: float) -> tuple[np.ndarray, np.ndarray]:
    """What residuals weigh in the equations, and the curvature they add, which far ones would make negative: at least a small part of their weight."""
    z = e * e / s2
    w = (nu + 1) / (nu + z)
    return w, w * np.maximum((nu - z) / (nu + z), FLOOR)


def solve_athletes(rest: np.ndarray, counts: np.ndarray, g: np.ndarray, til: np.ndarray | None, eligible: np.ndarray | None, s2: float, omega2: float, nu: float, tol: float = 1e-14) -> tuple[np.ndarray, ...]:
    """u, d, posterior variance of d, residuals, noise weights and curvatures of the cells of athletes, which stand together, ``counts`` of each; each
    athlete is iterated until it no longer moves, and then leaves the iteration.

    Some athletes are taken at a time.  A reweighted step from the mean is followed by Newton steps; whoever still moves after twelve goes on by reweighted steps, which never lower the likelihood.
    """
    ends = np.cumsum(counts)
    if len(rest) > 2 * TOGETHER:
        edges = np.unique(np.r_[0, np.searchsorted(ends, np.arange(TOGETHER, len(rest), TOGETHER)), len(counts)])
        cells_at = np.r_[0, ends][edges]
        pick = lambda z, a, b: None if z is None else z[a:b]
        parts = [
            _solved(rest[a:b], counts[i:j], g[a:b], pick(til, a, b), pick(eligible, i, j), s2, omega2, nu, tol)
            for i, j, a, b in zip(edges[:-1], edges[1:], cells_at[:-1], cells_at[1:], strict=True)
        ]
        return tuple(map(np.concatenate, zip(*parts, strict=True)))
    return _solved(rest, counts, g, til, eligible, s2, omega2, nu, tol)


def _solved(rest: np.ndarray, counts: np.ndarray, g: np.ndarray, til: np.ndarray | None, eligible: np.ndarray | None, s2: float, omega2: float, nu: float, tol: float) -> tuple[np.ndarray, ...]:
    n, first = len(counts), np.cumsum(counts) - counts
    u, d, pv = np.add.reduceat(g * rest, first) / np.maximum(np.add.reduceat(g, first), 1e-300), np.zeros(n), np.zeros(n)
    if til is None and math.isinf(nu):
        one = np.ones(len(rest))
        return u, d, pv, rest - np.repeat(u, counts), one, one
    ids, per, at, cells = np.arange(n), counts, first, (rest, g, til)
    for step in range(200):
        r, weight, x = cells
        sums = lambda z: np.add.reduceat(z, at)  # noqa: E731, B023
        e = r - np.repeat(u[ids], per)
        if x is not None:
            e -= np.repeat(d[ids], per) * x
        gw = gh = weight
        if not math.isinf(nu):
            w, h = _weights(e, s2, nu)
            gw = weight * w
            gh = weight * h if 0 < step <= 12 else gw
        s0, t0, by_d = np.maximum(sums(gh), 1e-300), sums(gw * e), 0.0
        if x is not None:
            ridge, hx, ex = s2 / omega2, gh * x, gw * e
            s1, s22, t1 = sums(hx), sums(hx * x) + ridge, sums(ex * x) - ridge * d[ids]
            by_d = np.where(eligible[ids], (s0 * t1 - s1 * t0) / (s0 * s22 - s1 * s1), 0.0)
            d[ids] += by_d
            t0 = t0 - s1 * by_d
        by_u = t0 / s0
        u[ids] += by_u
        moving = np.maximum(np.abs(by_u), np.abs(by_d)) >= tol
        if math.isinf(nu) or not moving.any():
            break
        if moving.sum() < 0.6 * len(ids):
            stay = np.repeat(moving, per)
            ids, per, cells = ids[moving], per[moving], (r[stay], weight[stay], None if x is None else x[stay])
            at = np.cumsum(per) - per
    e = rest - np.repeat(u, counts) - (np.repeat(d, counts) * til if til is not None else 0.0)
    w, h = (np.ones(len(rest)),) * 2 if math.isinf(nu) else _weights(e, s2, nu)
    if til is not None:
        pv = np.where(eligible, 1 / (np.add.reduceat(g * w * til * til, first) / s2 + 1 / omega2), 0.0)
    return u, d, pv, e, w, h


def _density(e: np.ndarray, s2: float, nu: float) -> np.ndarray:
    if math.isinf(nu):
        return -0.5 * (math.log(2 * math.pi * s2) + e * e / s2)
    const = math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(nu * math.pi * s2)
    return const - (nu + 1) / 2 * np.log1p(e * e / (nu * s2))


@dataclass
class _State:
    """What a sweep starts from, by run."""

    v: dict[int, np.ndarray]  # of the runs of the group
    theta: np.ndarray
    s2: np.ndarray
    omega2: np.ndarray
    nu: np.ndarray
    active: np.ndarray
    inner: np.ndarray  # up to which change athletes are iterated: a small part of what the last sweep changed


def narrowed(step: np.ndarray) -> bytes:
    """Steps of races as a byte each, beside a scale for each ``SCALED`` races; -128 where a race has none."""
    step = step.astype(float)
    here = np.isfinite(step)
    size = np.where(here, np.abs(step), 0.0)
    scale = np.maximum(np.maximum.reduceat(size, np.arange(0, len(step), SCALED)) / 127, 1e-300)
    at = np.rint(np.where(here, step, 0.0) / np.repeat(scale, SCALED)[: len(step)])
    return scale.tobytes() + np.where(here, at, -128).astype(np.int8).tobytes()


def widened(packed: bytes, n: int) -> np.ndarray:
    """What ``narrowed`` made of n steps; a step is off by a 254th of the largest beside it, and so by ever less as a fit converges."""
    scale, at = np.frombuffer(packed, count=-(-n // SCALED)), np.frombuffer(packed, dtype=np.int8, offset=8 * -(-n // SCALED))
    return np.where(at == -128, np.nan, at * np.repeat(scale, SCALED)[:n])


_PACKED = "k long, at binary, s binary"
#: Dealt cells, so many to a row, and weights by athlete: values of a column side by side, so that a sweep converts no cell.
_DEALT = ("athlete_id", "race", "y", "x", "til", "rel", "m", "eligible", "run", "g", "bits", "own_id", "own_g")
CELLS = 250_000


def _packed(rows: list[tuple[int, bytes, np.ndarray]]) -> pa.RecordBatch:
    keys, at, values = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(at, pa.binary()), pa.array([v.tobytes() for v in values], pa.binary())], names=["k", "at", "s"])


@dataclass
class Kernels:
    """What runs over a task's share of the dealt cells."""

    ids: np.ndarray
    runs: np.ndarray
    covariates: tuple[str, ...]
    masked: bool
    by_row: bool
    drift: bool
    by_athlete: bool
    columns: np.ndarray  # by run and covariate, whether a run has it; only those travel
    slots: np.ndarray | None = None  # the entry of g that a run uses, its own place if not given

    def packed(self):  # noqa: ANN201
        """Sorted cells, and rows of weights without a race, as rows of ``_DEALT``."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            batches = [b for b in batches if b.num_rows]
            if not batches:
                return
            t = pa.Table.from_batches(batches).combine_chunks()
            flat = lambda z: z["g"].combine_chunks().flatten().to_numpy()
            out = lambda **of: pa.RecordBatch.from_arrays([pa.array([of[c].tobytes() if c in of else None], pa.binary()) for c in _DEALT], names=list(_DEALT))
            if self.by_athlete:
                is_cell = pc.is_valid(t["race_id"])
                weights, t = t.filter(pc.invert(is_cell)), t.filter(is_cell)
                yield out(own_id=weights["athlete_id"].to_numpy(), own_g=flat(weights))
            for at in range(0, t.num_rows, CELLS):
                z = t.slice(at, CELLS)
                of = {c: z[c].to_numpy() for c in ("athlete_id", "y", "til", "rel", "m", "bits") if c in t.column_names}
                of["race"] = np.searchsorted(self.ids, z["race_id"].to_numpy()).astype(np.int32)
                if self.covariates:
                    of["x"] = np.stack([z[c].to_numpy() for c in self.covariates])
                if "eligible" in t.column_names:
                    of["eligible"] = z["eligible"].to_numpy()
                if self.by_row:
                    of["run"] = np.searchsorted(self.runs, z["run_id"].to_numpy()).astype(np.int32)
                if "g" in t.column_names and not self.by_athlete:
                    of["g"] = flat(z)
                yield out(**of)

        return run

    @property
    def n_blocks(self) -> int:
        return -(-len(self.ids) // BLOCK)

    def _shares(self, batches: Iterator[pa.RecordBatch], state: _State, left_out: bool = False) -> Iterator[tuple]:
        """(run, athlete ids, cells of each, race, y less globals, g, rel, m, x, til, eligible, columns of x) of each active run of a task; with
        ``left_out`` also (athlete, race, y less globals, til) of the cells that have weight 0 in it."""
        rows = [row for b in batches for row in zip(*(b.column(c) for c in range(b.num_columns)), strict=True)]
        whole = lambda c, kind: np.concatenate([np.frombuffer(row[_DEALT.index(c)].as_buffer(), dtype=kind) for row in rows if row[_DEALT.index(c)].is_valid] or [np.zeros(0, kind)])
        athlete, race, y = whole("athlete_id", np.int64), whole("race", np.int32), whole("y", np.float64)
        if not len(y):
            return
        k, own_id = len(self.covariates), whole("own_id", np.int64)
        some = lambda c, kind=np.float64: z if len(z := whole(c, kind)) else None
        x = np.concatenate([np.frombuffer(row[3].as_buffer()).reshape(k, -1) for row in rows if row[3].is_valid], axis=1) if k else np.zeros((0, len(y)))
        til, rel, m, eligible, many = some("til"), some("rel"), some("m"), some("eligible", np.bool_), some("g")
        many, bits = None if many is None else many.reshape(len(y), -1), some("bits", np.int64)
        own = (own_id, whole("own_g", np.float64).reshape(len(own_id), -1)) if self.by_athlete else None
        row = None if own is None else np.searchsorted(own_id, athlete)
        of_run = some("run", np.int32) if self.by_row else None
        for r in np.flatnonzero(state.active):
            slot = 0 if self.by_row else r if self.slots is None else self.slots[r]
            of = own[1][:, r][row] if own is not None else bits >> slot & 1 if bits is not None else None if many is None else many[:, slot]
            at = np.arange(*np.searchsorted(of_run, [r, r + 1])) if self.by_row else np.flatnonzero(of > 0) if of is not None else np.arange(len(y))
            if not len(at):
                continue
            at = slice(None) if len(at) == len(y) else at
            mine, columns = athlete[at], np.flatnonzero(self.columns[r])
            first = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1]])  # cells of an athlete stand together
            counts = np.diff(np.r_[first, len(mine)])
            g = of[at].astype(float, copy=False) if of is not None else np.ones(len(mine))
            pick = lambda z: None if z is None else z[at]  # noqa: E731, B023
            chosen = x[columns][:, at]
            rest = y[at] - state.v[r][race[at]]
            if len(columns):
                rest -= state.theta[r][columns] @ chosen
            out = r, mine[first], counts, race[at], rest, g, pick(rel), pick(m), chosen, pick(til), None if eligible is None else eligible[at][first], columns
            if left_out:
                no = np.flatnonzero(of == 0)
                out += (athlete[no], race[no], y[no] - state.v[r][race[no]] - state.theta[r][columns] @ x[columns][:, no], None if til is None else til[no])
            yield out

    def sweep(self, shared):  # noqa: ANN001, ANN201  a broadcast state
        k, n_races, n_blocks, drift = len(self.covariates), len(self.ids), self.n_blocks, self.drift

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            s = _State(**shared.value)
            for r, _, counts, race, rest, g, rel, m, x, til, eligible, chosen in self._shares(batches, s):
                n = len(counts)
                _, d, pv, e, w, h = solve_athletes(rest, counts, g, til if drift else None, eligible, s.s2[r], s.omega2[r], s.nu[r], s.inner[r])
                gw, gh = g * w, g * h
                wide, bend = (gw * rel, gh * rel) if rel is not None else (gw, gh)
                fit, fit_bend = (wide * m, bend * m) if m is not None else (wide, bend)
                by = lambda z: np.bincount(race, z, n_races)  # noqa: E731, B023
                here = np.flatnonzero(np.bincount(race, minlength=n_races))
                spread = lambda z: [by(z * one)[here] for one in x]  # noqa: E731, B023
                columns = np.stack([by(wide * e)[here], by(bend)[here], *spread(bend), *(spread(fit_bend) if m is not None else ())])
                cross, gram = np.zeros(k), np.zeros((k, k))
                cross[chosen], gram[np.ix_(chosen, chosen)] = x @ (fit * e), (x * fit_bend) @ x.T
                known = eligible if drift else np.zeros(n, dtype=bool)
                whole = np.array([
                    (gw * e * e).sum(), g.sum(), (g * _density(e, s.s2[r], s.nu[r])).sum(), (d * d + pv)[known].sum(), (d * d)[known].sum(), float(known.sum()),
                    *cross, *gram.ravel(),
                ])
                yield _packed([(-1 - r, b"", whole)])
                edges = np.searchsorted(here, np.arange(n_blocks + 1) * BLOCK)
                for b in np.flatnonzero(np.diff(edges)):
                    of = slice(edges[b], edges[b + 1])
                    yield _packed([(r * n_blocks + b, (here[of] - b * BLOCK).astype(np.int32).tobytes(), columns[:, of])])

        return run

    def steps(self):  # noqa: ANN201
        """Sums by block as steps: (block, step and single-precision covariate means of its races, not a number for races without cells) and, for each
        run under -1 - run, its sums with what the blocks take off the coefficients' equations behind them."""
        k, n_races, n_blocks, masked = len(self.covariates), len(self.ids), self.n_blocks, self.masked
        mine = [np.flatnonzero(c) for c in self.columns]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            blocks: dict[int, np.ndarray] = {}
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for key, at, values in zip(*(batch[c].to_pylist() for c in ("k", "at", "s")), strict=True):
                    values = np.frombuffer(values)
                    if key < 0:
                        sums.setdefault(key, np.zeros(6 + 2 * (k + k * k)))[: len(values)] += values
                        continue
                    width = 2 + len(mine[key // n_blocks]) * (2 if masked else 1)
                    if key not in blocks:
                        blocks[key] = np.zeros((width, min(BLOCK, n_races - key % n_blocks * BLOCK)))
                    blocks[key][:, np.frombuffer(at, dtype=np.int32)] += values.reshape(width, -1)
            for key, of in blocks.items():
                here = of[1] > 0
                weight = np.where(here, of[1], 1.0)
                has = mine[key // n_blocks]
                step, mean = of[0] / weight, of[2 : 2 + len(has)] / weight
                q = of[2 + len(has) :] if masked else of[2:]
                off, off_gram = np.zeros(k), np.zeros((k, k))
                off[has], off_gram[np.ix_(has, has)] = q @ step, q @ mean.T
                sums.setdefault(-1 - key // n_blocks, np.zeros(6 + 2 * (k + k * k)))[6 + k + k * k :] += np.concatenate([off, off_gram.ravel()])
                yield _packed([(key, b"", np.concatenate([np.where(here, step, np.nan)[None], mean]).astype(np.float32))])
            if sums:
                yield _packed([(key, b"", values) for key, values in sums.items()])

        return run

    def moved(self, shared=None):  # noqa: ANN001, ANN201  broadcast moves of the coefficients by run, nothing where there are none
        """Steps of races once the coefficients have moved; a byte each where there are no coefficients, along which races may have no optimum of their own, else in single
        precision; sums as they are."""
        n_blocks = self.n_blocks

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for key, values in zip(batch["k"].to_pylist(), batch["s"], strict=True):
                    out = values.as_py()
                    if key >= 0:
                        move = np.zeros(0) if shared is None else shared.value[key // n_blocks]
                        of = np.frombuffer(out, dtype=np.float32).reshape(1 + len(move), -1)
                        out = (of[0] - move @ of[1:]).astype(np.float32).tobytes() if self.covariates else narrowed(of[0])
                    yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([out], pa.binary())], names=["k", "s"])

        return run

    def abilities(self, shared):  # noqa: ANN001, ANN201
        drift = self.drift

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            s = _State(**shared.value[0])
            for r, ids, counts, _, rest, g, _, _, _, til, eligible, _ in self._shares(batches, s):
                u, d, pv, *_ = solve_athletes(rest, counts, g, til if drift else None, eligible, s.s2[r], s.omega2[r], s.nu[r])
                columns = [np.full(len(ids), self.runs[r]), ids, u, d, pv, counts.astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["run_id", "athlete_id", "u", "d", "pv", "n"])

        return run


    def held_out(self, shared):  # noqa: ANN001, ANN201  a broadcast (state, races fitted by run)
        """Scores of the cells that a run does not use, where its athlete and race were fitted; nothing is joined, as an athlete's cells are together."""
        drift = self.drift

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            state, here = shared.value
            s = _State(**state)
            for r, ids, counts, _, rest, g, _, _, _, til, eligible, _, athlete, race, y, til_out in self._shares(batches, s, True):
                u, d, *_ = solve_athletes(rest, counts, g, til if drift else None, eligible, s.s2[r], s.omega2[r], s.nu[r])
                at = np.minimum(np.searchsorted(ids, athlete), len(ids) - 1)
                known = (ids[at] == athlete) & here[r][race]
                e = (y - u[at] - (d[at] * til_out if drift else 0.0))[known]
                values = [self.runs[r], int(known.sum()), int((~known).sum()), float(_density(e, s.s2[r], s.nu[r]).sum()), float((e * e).sum())]
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in values], names=["run_id", "n", "n_orphans", "logdensity", "sq"])

        return run


def _dealt(cells: DataFrame, covariates: tuple[str, ...], config: EngineConfig, runs: list[int], by_row: bool, weights: DataFrame | None, columns: np.ndarray) -> tuple[DataFrame, Kernels, float]:
    """The cells, and weights by athlete, dealt by athlete, packed and kept, their kernels, and the variance of y."""
    extra = [c for c in ("run_id", "g", "bits", "til", "eligible", "rel", "m") if c in cells.columns]
    cells = cells.select("athlete_id", "race_id", "y", *covariates, *extra)
    size = cells.count()
    if weights is not None:
        size += weights.count() * len(runs)
        cells = cells.drop("g").unionByName(weights.select("athlete_id", "g"), allowMissingColumns=True)
    parts = max(cells.sparkSession.sparkContext.defaultParallelism, -(-size * (6 + len(covariates)) // (6 * config.per_partition)))
    dealt = cells.repartition(parts, "athlete_id").sortWithinPartitions(*(["run_id"] if by_row else []), "athlete_id").persist()
    rows = dealt.select("race_id").filter("race_id is not null").distinct().orderBy("race_id").limit(config.race_limit + 1).toArrow()
    ids = rows["race_id"].to_numpy().astype(np.int64)
    if len(ids) * len(runs) > config.race_limit:
        dealt.unpersist()
        raise ValueError(f"{len(runs)} runs of more than {config.race_limit // len(runs)} race effects; see chunked and model.refits")
    kernels = Kernels(ids, np.array(runs, dtype=np.int64), covariates, "m" in extra, by_row, config.drift, weights is not None, columns)
    packed = dealt.mapInArrow(kernels.packed(), ", ".join(f"{c} binary" for c in _DEALT)).persist()
    packed.count()
    spread = dealt.agg(F.var_pop("y")).first()[0]
    dealt.unpersist()
    return packed, kernels, float(spread or 1e-300)


def _gauged(v: np.ndarray, theta: np.ndarray, here: np.ndarray, dates: np.ndarray | None) -> None:
    """Mean zero over the races of the run; with dates also slope zero, which the linear career term takes."""
    if dates is not None:
        t = dates - dates[here].mean()
        if (square := (t[here] ** 2).sum()) > 1e-12:
            c = (v[here] * t[here]).sum() / square
            v[here] -= c * t[here]
            theta[0] += c
    v[here] -= v[here].mean()


def fit_runs(
    cells: DataFrame, runs: list[int] | None = None, config: EngineConfig = EngineConfig(), covariates: tuple[str, ...] = (), dates: DataFrame | None = None, start: DataFrame | None = None, by_row: bool = False,
    weights: DataFrame | None = None, columns: np.ndarray | None = None, theta: np.ndarray | None = None, hook: Callable[[int, int, float, float], None] | None = None,
    slots: list[int] | None = None, score: bool = False, keep_paths: bool = False, sigma2: float | list[float] | None = None,
) -> Fits:
    """Fits of all runs to convergence.

    ``cells``: athlete_id, race_id, y, the covariates, and where needed g (array of weights by run) or bits (0 or 1 by run), run_id (with ``by_row``), til and
    eligible (drift), rel (a weight for global terms), m (1 where a cell counts for the covariates).  ``dates`` (race_id, x in years) ask
    for the slope-zero gauge, whose linear term is the first covariate.  ``start`` (race_id, v, or with run_id),
    ``theta`` (by run) and ``sigma2`` (one or by run) warm the fits.  ``weights`` (athlete_id, g: an array by run) stand for a column g; ``columns`` (by run and covariate) tell which
    covariates a run has, all if not given; ``slots`` which entry of g, or bit, a run uses, so that runs may share one.  ``hook`` is called with run, sweep, log
    likelihood and scale after each sweep of each run.  ``score`` asks for the held-out scores of the cells that runs leave out,
    ``keep_paths`` for the race effects after each sweep.
    """
    spark = cells.sparkSession
    runs = sorted(runs or [0])
    k, n_runs = len(covariates), len(runs)
    columns = np.ones((n_runs, k), dtype=bool) if columns is None else np.asarray(columns, dtype=bool)
    dealt, kernels, spread = _dealt(cells, covariates, config, runs, by_row, weights, columns)
    kernels.slots = None if slots is None else np.array(slots)
    n_races = len(kernels.ids)
    nu = np.broadcast_to(np.array(config.nu, dtype=float), n_runs)
    theta = np.zeros((n_runs, k)) if theta is None else np.array(theta, dtype=float)
    s2 = spread if sigma2 is None else np.array(sigma2, dtype=float)
    s2 = np.broadcast_to(s2, n_runs).copy()
    omega2, t = np.broadcast_to(np.array(config.omega2, dtype=float), n_runs).copy(), None
    fixed = np.broadcast_to(np.array(config.omega2_fixed), n_runs)
    begin = _begin(start, kernels)
    if dates is not None:
        rows = dates.filter(F.col("race_id").isNotNull()).toArrow()
        by_id = dict(zip(rows["race_id"].to_pylist(), rows["x"].to_pylist(), strict=True))
        t = np.array([by_id[int(i)] for i in kernels.ids])
    state = _State({}, theta, s2, omega2, nu, np.zeros(n_runs, dtype=bool), np.full(n_runs, 1e-4))
    loglik, cells_of, iterations, converged = np.zeros(n_runs), np.zeros(n_runs), np.zeros(n_runs, dtype=np.int64), np.zeros(n_runs, dtype=bool)
    trace, history, races, athletes, scores = [], [], [], [], []
    paths = _Paths(spark, config.group_limit) if keep_paths else None
    size = max(1, config.group_limit // max(1, n_races))
    for group in (range(at, min(at + size, n_runs)) for at in range(0, n_runs, size)):
        state.v, here, mixers = begin(group), {r: np.ones(n_races, dtype=bool) for r in group}, {r: _Mixer(config.memory) for r in group}
        state.active[group] = True
        tasks = max(1, min(spark.sparkContext.defaultParallelism, len(group) * (kernels.n_blocks + 1)))
        for it in range(1, config.max_iter + 1):
            change = 0.0
            for r, step, whole, move in _swept(dealt, kernels, state, tasks):
                here[r] = ~np.isnan(step)
                x, g = _step(state, r, step, whole, here[r], move, columns[r], t, config.drift and not fixed[r])
                before = loglik[r]
                loglik[r], cells_of[r] = whole[2] - (whole[4] / (2 * state.omega2[r]) if config.drift else 0.0), whole[1]
                moved = float(np.abs(g - x).max())
                change, iterations[r], state.inner[r] = max(change, moved), it, min(max(1e-3 * moved, 1e-14), 1e-4)
                history.append((runs[r], it, float(loglik[r]), float(state.s2[r]), float(state.omega2[r]), moved))
                if hook is not None:
                    hook(runs[r], it, float(loglik[r]), float(state.s2[r]))
                x = mixers[r].mixed(x, g)
                if moved <= config.tol or it > 1 and 0 < config.loglik_tol and abs(loglik[r] - before) <= config.loglik_tol * (abs(before) + 1):
                    state.active[r], x, mixers[r] = False, g, None
                state.v[r], state.theta[r] = x[:n_races].copy(), x[n_races : n_races + k]
                _gauged(state.v[r], state.theta[r], here[r], t if columns[r].any() else None)
                state.s2[r], state.omega2[r] = np.exp(x[-2]), np.exp(x[-1])
                if paths is not None:
                    paths.add(runs[r], it, kernels.ids[here[r]], state.v[r][here[r]])
            trace.append((it, change))
            if not state.active.any():
                break
        mixers.clear()
        converged[group], state.active[group] = ~state.active[group], True
        shared = spark.sparkContext.broadcast((vars(state), here))
        athletes.append(cut(dealt.mapInArrow(kernels.abilities(shared), "run_id long, athlete_id long, u double, d double, pv double, n long")))
        if score:
            sums = ("n", "n_orphans", "logdensity", "sq")
            held_out = dealt.mapInArrow(kernels.held_out(shared), "run_id long, n long, n_orphans long, logdensity double, sq double").groupBy("run_id").agg(*(F.sum(c).alias(c) for c in sums))
            scores.append(held_out.toArrow())  # a row a run
        shared.destroy()
        table = {"run_id": np.concatenate([np.full(here[r].sum(), runs[r], dtype=np.int64) for r in group]), "race_id": np.concatenate([kernels.ids[here[r]] for r in group])}
        races.append(cut(spark.createDataFrame(pa.table(table | {"v": np.concatenate([state.v[r][here[r]] for r in group])}))))
        state.active[group] = False
    dealt.unpersist()
    if not converged.all():
        warnings.warn(f"runs not converged after {config.max_iter} sweeps: {[r for r, c in zip(runs, converged, strict=True) if not c]}", RuntimeWarning, stacklevel=2)
    scales = pa.table({"run_id": kernels.runs, "sigma2": state.s2, "omega2": state.omega2, "loglik": loglik, "n": cells_of, "n_iter": iterations, "converged": converged})
    union = lambda frames: reduce(DataFrame.unionByName, frames)
    held_out = spark.createDataFrame(pa.concat_tables(scores)) if score else None
    return Fits(union(races), union(athletes), spark.createDataFrame(scales), dict(zip(runs, state.theta, strict=True)), trace, history, paths and paths.table(), held_out)


class _Paths:
    """Race effects sweep by sweep, written to the shared folder as they come, so that the driver holds ``limit`` of them, or one run's, at most."""

    def __init__(self, spark: SparkSession, limit: int) -> None:
        self.spark, self.limit, self.path = spark, limit, f"{shared_dir(spark)}/paceline-paths-{uuid.uuid4().hex}"
        self.rows: list[pa.Table] = []

    def add(self, run: int, sweep: int, ids: np.ndarray, v: np.ndarray) -> None:
        if self.rows and sum(map(len, self.rows)) + len(v) > self.limit:
            self._write()
        full = lambda x: np.full(len(v), x, dtype=np.int64)
        self.rows.append(pa.table({"run_id": full(run), "sweep": full(sweep), "race_id": ids, "v": v}))

    def _write(self) -> None:
        self.spark.createDataFrame(pa.concat_tables(self.rows)).write.mode("append").parquet(self.path)
        self.rows = []

    def table(self) -> DataFrame:
        """run_id, sweep, race_id, v; it goes when the application ends."""
        if self.rows:
            self._write()
        at, fs = hadoop(self.spark, self.path)
        fs.deleteOnExit(at)
        return self.spark.read.schema("run_id long, sweep long, race_id long, v double").parquet(self.path)


def _begin(start: DataFrame | None, kernels: Kernels) -> Callable[[range], dict[int, np.ndarray]]:
    """The race effects that a group of runs begins at; ``start`` without runs is gathered once, with runs those of the group."""

    def placed(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids = rows["race_id"].to_numpy()
        at = np.minimum(np.searchsorted(kernels.ids, ids), len(kernels.ids) - 1)
        good = kernels.ids[at] == ids
        return at[good], rows["v"].to_numpy()[good], good

    zero = np.zeros(len(kernels.ids))
    by_run = start is not None and "run_id" in start.columns
    if start is not None and not by_run:
        at, v, _ = placed(start.select("race_id", "v").toArrow())
        zero[at] = v

    def begin(group: range) -> dict[int, np.ndarray]:
        out = {r: zero.copy() for r in group}
        if by_run:
            rows = start.filter(F.col("run_id").isin([int(kernels.runs[r]) for r in group])).select("run_id", "race_id", "v").toArrow()
            at, v, good = placed(rows)
            which = np.searchsorted(kernels.runs, rows["run_id"].to_numpy())[good]
            for r in group:
                out[r][at[which == r]] = v[which == r]
        return out

    return begin


def _swept(dealt: DataFrame, kernels: Kernels, state: _State, tasks: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(run, steps of its races, its sums, move of its coefficients) of each active run: one sweep.

    With covariates the blocks' steps and means are kept where they were made until the driver has solved for the coefficients from the sums, so
    that means never travel.
    """
    spark, active = dealt.sparkSession, np.flatnonzero(state.active)
    shared = spark.sparkContext.broadcast(vars(state))  # group_limit values at most, or one run
    steps = dealt.mapInArrow(kernels.sweep(shared), _PACKED).repartition(tasks, "k").mapInArrow(kernels.steps(), _PACKED).select("k", "s")
    moves = dict.fromkeys(active, np.zeros(0))
    if not kernels.covariates:
        got = steps.mapInArrow(kernels.moved(), "k long, s binary").toArrow()
        sums = got
    else:
        steps = steps.persist()
        sums = steps.filter("k < 0").toArrow()
    wholes: dict[int, np.ndarray] = {}
    for key, packed in zip(sums["k"].to_pylist(), sums["s"], strict=True):
        if key < 0:
            wholes[-1 - key] = wholes.get(-1 - key, 0.0) + np.frombuffer(packed.as_py())
    if kernels.covariates:
        moves = {r: _coefficients(wholes[r], kernels.columns[r]) for r in active}
        by_run = spark.sparkContext.broadcast(moves)
        got = steps.filter("k >= 0").mapInArrow(kernels.moved(by_run), "k long, s binary").toArrow()
        by_run.destroy()
        steps.unpersist()
    shared.destroy()
    at: dict[int, list[tuple[int, int]]] = {}
    for i, key in enumerate(got["k"].to_pylist()):
        if key >= 0:
            at.setdefault(key // kernels.n_blocks, []).append((key % kernels.n_blocks, i))
    for r in active:
        step = np.full(len(kernels.ids), np.nan)
        for b, i in at.get(r, []):
            block = step[b * BLOCK : (b + 1) * BLOCK]
            packed = got["s"][i].as_py()
            block[:] = np.frombuffer(packed, dtype=np.float32) if kernels.covariates else widened(packed, len(block))
        yield r, step, wholes[r], moves[r]


def at_once(races: int, config: EngineConfig = EngineConfig(), terms: int = 0) -> int:
    """How many runs of so many races and covariates share dealt cells; a race has a mean of each covariate in the tasks."""
    return max(1, int(config.race_limit / (max(1, races) * (1 + terms / 4))))


def chunked(fit: Callable[[list[int]], Fits], runs: list[int], races: int, config: EngineConfig = EngineConfig(), terms: int = 0) -> Iterator[Fits]:
    """``fit`` of the runs, as many at a time as the driver holds with so many races, and covariates, each."""
    size = at_once(races, config, terms)
    for at in range(0, len(runs), size):
        yield fit(runs[at : at + size])


def joined(parts: list[Fits]) -> Fits:
    """Fits of some runs each as fits of all of them."""
    if len(parts) == 1:
        return parts[0]
    union = lambda name: reduce(DataFrame.unionByName, [getattr(p, name) for p in parts])
    held_out = None if parts[0].held_out is None else union("held_out")
    theta = {run: t for p in parts for run, t in p.theta.items()}
    return Fits(union("races"), union("athletes"), union("scales"), theta, [x for p in parts for x in p.trace], [x for p in parts for x in p.history], held_out=held_out)


def _coefficients(whole: np.ndarray, mine: np.ndarray) -> np.ndarray:
    """How far the coefficients of a run's covariates (``mine``) move by its sums, races solved along."""
    k = len(mine)
    b, gram, off_b, off_gram = np.split(whole[6:], np.cumsum([k, k * k, k]))
    left, right = (gram - off_gram).reshape(k, k), b - off_b
    scale = 1 / np.sqrt(np.maximum(np.diag(left)[mine], 1e-300))  # high powers and low ones on one footing
    return scale * np.linalg.solve(left[np.ix_(mine, mine)] * np.outer(scale, scale) + 1e-14 * np.eye(mine.sum()), scale * right[mine])


def _step(state: _State, r: int, step: np.ndarray, whole: np.ndarray, here: np.ndarray, move: np.ndarray, mine: np.ndarray, t: np.ndarray | None, free_omega2: bool) -> tuple[np.ndarray, np.ndarray]:
    """The state of a run as a vector (v, theta, log s2, log omega2), and what one sweep makes of it; ``step`` and ``move`` are those of its races and
    of its coefficients (``mine``), ``whole`` its sums.

    The scale goes as far as its own equation says once that is near: reweighting alone goes only nu / (nu + 3) of the way.
    """
    x = np.concatenate([state.v[r], state.theta[r], np.log([state.s2[r], state.omega2[r]])])
    v, theta = state.v[r].copy(), state.theta[r].copy()
    theta[mine] += move
    v[here] += step[here]
    _gauged(v, theta, here, t if mine.any() else None)
    s2 = max(whole[0] / whole[1], 1e-300)
    if math.isfinite(state.nu[r]) and abs(far := math.log(s2 / state.s2[r])) < 0.5:
        s2 *= math.exp(3 / state.nu[r] * far)
    omega2 = min(max(whole[3] / whole[5], 1e-12), 1.0) if free_omega2 and whole[5] else state.omega2[r]
    return x, np.concatenate([v, theta, np.log([s2, omega2])])


class _Mixer:
    """Anderson mixing of one run's steps; it starts over where a step got longer.  Differences are held in single precision, as their errors shrink
    with the steps."""

    def __init__(self, memory: int) -> None:
        self.memory = memory
        self._start()

    def _start(self) -> None:
        self.last: tuple[np.ndarray, np.ndarray] | None = None
        self.df: list[np.ndarray] = []
        self.dg: list[np.ndarray] = []

    def mixed(self, x: np.ndarray, g: np.ndarray) -> np.ndarray:
        """The next point after x, whose image is g."""
        f = g - x
        if self.last is not None:
            if np.linalg.norm(f) > 1.5 * np.linalg.norm(self.last[1]):
                self._start()
                return g
            self.df = [*self.df, (f - self.last[1]).astype(np.float32)][-self.memory :]
            self.dg = [*self.dg, (g - self.last[0]).astype(np.float32)][-self.memory :]
        self.last = g, f
        if len(self.df) < 2:
            return g
        df = np.stack(self.df).astype(float)
        gram = df @ df.T
        gamma = np.linalg.lstsq(gram + 1e-14 * np.trace(gram) * np.eye(len(df)), df @ f, rcond=None)[0]
        return g - gamma @ np.stack(self.dg)
