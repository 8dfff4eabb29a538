"""Exact quantiles of long columns, found digit by digit.

A percentile aggregate holds every distinct value of a group in one task.  Here values become integers of the same order; a pass counts the next digit of
those that begin like a wanted value, so that a task holds some thousand counts, the driver as many, and no row is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.operators.slices import cut

#: Bits of a double that each pass settles, from the sign on.
DIGITS = (13, 13, 13, 13, 12)
_SIGN = np.uint64(1 << 63)


def ordered(x: np.ndarray) -> np.ndarray:
    """Doubles as integers of the same order; zeros are one value and NaN is the largest."""
    x = np.where(np.isnan(x), np.nan, x + 0.0)
    bits = x.view(np.uint64)
    return np.where(bits & _SIGN, ~bits, bits | _SIGN)


def value_of(key: int) -> float:
    """The double that ``ordered`` made a key of."""
    key = np.uint64(key)
    return float(np.array([key ^ _SIGN if key & _SIGN else ~key]).view(np.float64)[0])


def _digits(groups: list, wanted: list[np.ndarray], shift: int, bits: int):  # noqa: ANN202
    """(group, prefix, digit, n): how often each digit follows the wanted prefixes of each group; group None has the values of all."""
    size = 1 << bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(len(w) * size, dtype=np.int64) for w in wanted]
        for b in batches:
            key = ordered(b["_x"].to_numpy())
            digit = (key >> np.uint64(shift)) & np.uint64(size - 1)
            top = key >> np.uint64(shift + bits) if shift + bits < 64 else np.zeros_like(key)
            names = b["_by"].dictionary_encode()
            known = names.dictionary.to_pylist()
            for g, name in enumerate(groups):
                if name is not None and name not in known:
                    continue
                of = slice(None) if name is None else names.indices.to_numpy() == known.index(name)
                at = np.minimum(np.searchsorted(wanted[g], top[of]), len(wanted[g]) - 1)
                hit = wanted[g][at] == top[of]
                counts[g] += np.bincount(at[hit] * size + digit[of][hit].astype(np.int64), minlength=len(counts[g]))
        for g, n in enumerate(counts):
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), g)), pa.array(at // size), pa.array(at % size), pa.array(n[at])], names=["g", "p", "digit", "n"])

    return run


def quantiles(df: DataFrame, column: str, shares: list[float], by: str | None = None) -> dict:
    """{group: [a value for each share]} of the groups of a text column ``by`` (few, none null), and of all rows under None; interpolated as ``percentile`` does, nulls left out."""
    values = df.filter(F.col(column).isNotNull()).select((F.col(by) if by else F.lit("")).alias("_by"), F.col(column).cast("double").alias("_x"))
    values = cut(values)
    sizes = {r["_by"]: r["n"] for r in values.groupBy("_by").agg(F.count("*").alias("n")).collect()}  # groups are few
    sizes = {k: n for k, n in sizes.items() if by} | {None: sum(sizes.values())}
    groups = list(sizes)
    if not sizes[None]:
        return {None: [None] * len(shares)}
    # by group, each wanted row: its place among the values that share its prefix
    places = [sorted({int(e(p * (sizes[k] - 1))) for p in shares for e in (math.floor, math.ceil)}) for k in groups]
    open_ = [[(0, place) for place in of] for of in places]
    shift = 64
    for bits in DIGITS:
        shift -= bits
        wanted = [np.array(sorted({p for p, _ in of}), dtype=np.uint64) for of in open_]
        got = values.mapInArrow(_digits(groups, wanted, shift, bits), "g long, p long, digit long, n long").groupBy("g", "p", "digit").agg(F.sum("n").alias("n")).toArrow().sort_by([("g", "ascending"), ("p", "ascending"), ("digit", "ascending")])
        g, p, digit, n = (got[c].to_numpy() for c in ("g", "p", "digit", "n"))
        for i, of in enumerate(open_):
            for j, (prefix, place) in enumerate(of):
                mine = np.flatnonzero((g == i) & (p == np.searchsorted(wanted[i], np.uint64(prefix))))
                ends = np.cumsum(n[mine])
                at = int(np.searchsorted(ends, place, side="right"))
                of[j] = (prefix << bits | int(digit[mine[at]]), place - int(ends[at] - n[mine[at]]))
    found = [dict(zip(places[i], (value_of(p) for p, _ in of), strict=True)) for i, of in enumerate(open_)]

    def between(k: int, p: float) -> float:
        at = p * (sizes[groups[k]] - 1)
        lo, hi = math.floor(at), math.ceil(at)
        return found[k][lo] if lo == hi or found[k][lo] == found[k][hi] else (hi - at) * found[k][lo] + (at - lo) * found[k][hi]

    return {name: [between(k, p) for p in shares] for k, name in enumerate(groups)}
