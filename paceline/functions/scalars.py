"""Scalar functions of the analysis, as column expressions."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

JULIAN_YEAR_DAYS = 365.25


def rounded(c: Column, digits: int = 6) -> Column:
    """Rounded for output; never a negative zero."""
    return F.round(c.cast("double"), digits) + F.lit(0.0)


def julian_years(later: Column, earlier: Column) -> Column:
    return F.datediff(later, earlier) / JULIAN_YEAR_DAYS


def year_fraction(date: Column, by_length: bool = False) -> Column:
    """Year plus the share of it that has passed: of 365.25 days, or of the year's own length."""
    if not by_length:
        return F.year(date) + (F.dayofyear(date) - 1) / JULIAN_YEAR_DAYS
    return F.year(date) + (F.dayofyear(date) - 1) / F.dayofyear(F.make_date(F.year(date), F.lit(12), F.lit(31)))


def minutes_at_three_hours(v: Column) -> Column:
    """What a log difficulty is worth at a three-hour finish, in minutes."""
    return 180 * F.expm1(v)


def percent(v: Column) -> Column:
    return 100 * F.expm1(v)


def clock(seconds: Column) -> Column:
    """Seconds as h:mm:ss."""
    s = F.round(seconds).cast("long")
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def title_case(slug: Column) -> Column:
    return F.initcap(F.regexp_replace(slug, "[-_#]+", " "))


def with_suffix(columns: list[str], *suffixes: str) -> list[str]:
    return [c for c in columns if c.endswith(suffixes)]


def age_group(age: Column, width: int = 10) -> Column:
    """The lower end of the age group."""
    return (F.floor(age / width) * width).cast("int")


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def percent_text(share: Column) -> Column:
    return F.format_string("%.1f%%", 100 * share)


def slug(*parts: Column) -> Column:
    """Parts in lower case with - for what separates words, joined by _."""
    return F.concat_ws("_", *(F.lower(F.regexp_replace(p, "[ #]+", "-")) for p in parts))


def slug_parts(slug_: Column) -> list[Column]:
    """cohort, sex and mrc of a slice's slug."""
    parts = F.split(slug_, "_")
    return [F.get(parts, F.lit(0)).alias("cohort"), F.get(parts, F.lit(1)).alias("sex"), F.regexp_extract(slug_, "mrc([0-9]+)", 1).cast("int").alias("mrc")]


def log_positive(x: Column) -> Column:
    """Logarithm where there is one, else null."""
    return F.when(x > 0, F.log(x))


def finite(x: Column) -> Column:
    """Null for what is not a finite number."""
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(math.inf)), x)


def bucket_label(n: Column) -> Column:
    """Race counts as 1, 2, 3, 4, 5, 6-10, >10."""
    return F.when(n <= 5, n.cast("string")).when(n <= 10, "6-10").otherwise(">10")


def tier_of(p: Column) -> Column:
    """Label of a membership probability."""
    return F.when(p >= 0.95, "certain").when(p >= 0.68, "likely").when(p > 0.05, "possible").otherwise("unlikely")


def irls_weight(r: Column, sigma2: float | Column, nu: float) -> Column:
    """Student-t weight of a residual; 1 in the Gaussian limit."""
    return F.lit(1.0) if math.isinf(nu) else (nu + 1) / (nu + r * r / sigma2)


def log_density(r: Column, sigma2: float | Column, nu: float) -> Column:
    """Log density of a residual under a scaled Gaussian or Student-t law."""
    s2 = sigma2 if isinstance(sigma2, Column) else F.lit(sigma2)
    if math.isinf(nu):
        return -0.5 * (math.log(2 * math.pi) + F.log(s2) + r * r / s2)
    const = math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(nu * math.pi)
    return const - 0.5 * F.log(s2) - (nu + 1) / 2 * F.log1p(r * r / (nu * s2))


def huber_weight(u: Column, c: float = 1.345) -> Column:
    return F.when(F.abs(u) <= c, 1.0).otherwise(c / F.abs(u))


def truncated_cubic(x: Column, knot: float) -> Column:
    return F.pow(F.greatest(x - knot, F.lit(0.0)), 3)


def natural_spline(x: Column, knots: list[float]) -> list[Column]:
    """The basis of a natural cubic spline without intercept: x, then one column for each inner knot pair."""
    last, before = knots[-1], knots[-2]
    d = lambda k: (truncated_cubic(x, k) - truncated_cubic(x, last)) / (last - k)
    return [x, *(d(k) - d(before) for k in knots[:-2])]


def horner(x: Column, coefficients: list[float]) -> Column:
    return reduce(lambda acc, c: acc * x + c, reversed(coefficients[:-1]), F.lit(coefficients[-1]))


_PRIME = 2147483647


def hash_uniform(seed: int, *keys: Column) -> Column:
    """A uniform in (0, 1) from non-negative integer keys, by arithmetic that any engine repeats exactly.

    Keys enter linearly modulo a prime; squarings between and after them keep near keys from giving near values.
    """
    x = F.lit(seed).cast("long")
    for k in keys:
        x = (x * 48271 + (k % _PRIME) * 69621 + 11) % _PRIME
        x = ((x * x) % _PRIME * 16807 + x * 3) % _PRIME
    x = ((x * x) % _PRIME * 39373 + x * 5) % _PRIME
    return (x + 0.5) / _PRIME


def hash_uniform_arrays(seed: int, *keys: np.ndarray) -> np.ndarray:
    """The same for arrays of keys, which are broadcast against each other."""
    p, x = np.uint64(_PRIME), np.uint64(seed)
    for k in keys:
        x = (x * np.uint64(48271) + (k % _PRIME).astype(np.uint64) * np.uint64(69621) + np.uint64(11)) % p
        x = ((x * x) % p * np.uint64(16807) + x * np.uint64(3)) % p
    x = ((x * x) % p * np.uint64(39373) + x * np.uint64(5)) % p
    return (x + 0.5) / _PRIME


def hash_uniform_sql(seed: int, *keys: str) -> str:
    """The same as an expression of DuckDB."""
    x = f"({seed}::BIGINT)"
    square = "list_transform([{x}], lambda x: ((x * x) % {p} * {m} + x * {c}) % {p})[1]"
    for k in keys:
        x = square.format(x=f"({x} * 48271 + (({k})::BIGINT % {_PRIME}) * 69621 + 11) % {_PRIME}", p=_PRIME, m=16807, c=3)
    x = square.format(x=x, p=_PRIME, m=39373, c=5)
    return f"(({x} + 0.5) / {_PRIME})"
