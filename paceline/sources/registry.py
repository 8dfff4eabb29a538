"""Fits on disk: identity, names, save and load, a registry of manifests, and a check before fitting."""

from __future__ import annotations

import hashlib
import json
import math
import uuid
from dataclasses import asdict

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.operators import engine
from paceline.operators.full import FullConfig, FullFit
from paceline.operators.slices import SliceSpec
from paceline.sources.scratch import hadoop

#: The forms of slugs, stems and tags below are names that must match.
#: Numeric settings say how a fit was reached, not what it is.
_NUMERIC = ("tol", "loglik_tol", "max_iter")


def identity(spec: SliceSpec, config: FullConfig, resample: str = "base") -> dict:
    """What makes a fit that fit: the slice, the model, the resampling; flat, with text for lists."""
    flat = {f"slice_{k}": v for k, v in asdict(spec).items()} | {f"model_{k}": v for k, v in asdict(config).items() if k not in _NUMERIC}
    return {k: str(v) if isinstance(v, tuple | float) else v for k, v in flat.items()} | {"resample": resample}


def identity_key(spec: SliceSpec, config: FullConfig, resample: str = "base", n: int = 8) -> str:
    return hashlib.sha256(json.dumps(identity(spec, config, resample), sort_keys=True, default=str).encode()).hexdigest()[:n]


def slice_slug(spec: SliceSpec) -> str:
    """cohort_sex_YY-YY_mrcN, with B for both sexes."""
    lo, hi = (int(d[2:4]) if d else e for d, e in ((spec.date_from, 0), (spec.date_to, 99)))
    return f"{spec.cohort or 'ALL'}_{spec.sex or 'B'}_{lo:02d}-{hi:02d}_mrc{spec.min_race_count}"


def parse_slug(slug: str) -> dict:
    """The parts of a slice's slug."""
    cohort, sex, years, races = slug.rsplit("_", 3)
    lo, hi = years.split("-")
    return {"cohort": None if cohort == "ALL" else cohort, "sex": None if sex == "B" else sex, "from": int(lo), "to": int(hi), "min_race_count": int(races.removeprefix("mrc"))}


def nu_tag(nu: float) -> str:
    return "L2" if math.isinf(nu) else f"nu{nu:.2f}".replace(".", "p")


def model_stem(config: FullConfig, solver: str = "anderson") -> str:
    """Terms (A for career, D for drift, x for none; ``baseline`` without both), noise and solver."""
    terms = ("A" if config.basis else "x") + ("D" if config.drift else "x")
    return f"{'baseline' if terms == 'xx' else terms}_{nu_tag(config.nu)}_{solver}"


def fit_path(parent: str, spec: SliceSpec, config: FullConfig, resample: str = "base") -> str:
    return f"{parent.rstrip('/')}/{slice_slug(spec)}/{model_stem(config)}__{identity_key(spec, config, resample)}"


def manifest(spec: SliceSpec, fitted: FullFit, resample: str, path: str) -> dict:
    """Flat columns: identity, names, sizes and outcome."""
    scale = fitted.fits.scales.first()
    sizes = {"n_athletes": fitted.fits.athletes.count(), "n_races": fitted.fits.races.count(), "n_cells": int(scale["n"])}
    outcome = {k: scale[k] for k in ("loglik", "sigma2", "omega2", "n_iter", "converged")}
    names = {"slug": slice_slug(spec), "stem": model_stem(fitted.config), "key": identity_key(spec, fitted.config, resample), "path": path}
    return identity(spec, fitted.config, resample) | names | sizes | outcome


def save_fit(spark: SparkSession, path: str, fitted: FullFit) -> None:
    """Tables and settings of a fit under ``path``, which must not be there yet."""
    for name in ("races", "athletes", "scales"):
        getattr(fitted.fits, name).write.parquet(f"{path}/{name}")
    terms = [(k, float(t)) for k, t in enumerate(fitted.theta)]
    spark.createDataFrame(terms, "k int, value double").write.parquet(f"{path}/coefficients")
    settings = {"config": asdict(fitted.config), "knots": list(fitted.knots), "mean_ae": fitted.mean_ae}
    spark.createDataFrame([(json.dumps(settings, sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}/settings")


def load_fit(spark: SparkSession, path: str) -> FullFit:
    settings = json.loads(spark.read.text(f"{path}/settings").first()[0])
    config = FullConfig(**settings["config"] | {"knots": tuple(settings["config"]["knots"])})
    tables = {name: spark.read.parquet(f"{path}/{name}") for name in ("races", "athletes", "scales")}
    theta = np.array([r["value"] for r in spark.read.parquet(f"{path}/coefficients").orderBy("k").collect()])  # a few coefficients
    return FullFit(config, tuple(settings["knots"]), settings["mean_ae"], theta, engine.Fits(**tables, theta={0: theta}))


def register(spark: SparkSession, registry: str, rows: list[dict]) -> None:
    """Append manifests, one JSON row each."""
    spark.createDataFrame([(json.dumps(r, sort_keys=True, default=str),) for r in rows], "value string").coalesce(1).write.mode("append").text(registry)


def publish(spark: SparkSession, registry: str, rows: list[dict]) -> None:
    """A registry of these manifests, there as a whole or not at all; one that is there already stays."""
    made = f"{registry}-{uuid.uuid4().hex}"
    register(spark, made, rows)
    (to, fs), (at, _) = hadoop(spark, registry), hadoop(spark, made)
    if fs.exists(to) or not fs.rename(at, to):
        fs.delete(at, True)


def query(spark: SparkSession, registry: str, **filters: object) -> DataFrame:
    """Registered fits by equality, membership, or with a pattern of * and ? (glob) on a text column."""
    rows = spark.read.json(registry)
    for column, wanted in filters.items():
        if isinstance(wanted, list | tuple | set):
            rows = rows.filter(F.col(column).isin(*wanted))
        elif isinstance(wanted, str) and any(c in wanted for c in "*?"):
            rows = rows.filter(F.col(column).like(glob_to_like(wanted)))
        else:
            rows = rows.filter(F.col(column) == wanted)
    return rows


def glob_to_like(glob: str) -> str:
    return glob.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("*", "%").replace("?", "_")


def preflight(spark: SparkSession, registry: str, spec: SliceSpec, config: FullConfig, resample: str = "base") -> DataFrame:
    """path, clash ('same fit', or 'same name' with what differs) of the registered fits that stand in the way of a new one."""
    mine = identity(spec, config, resample)
    rows = spark.read.json(registry).filter((F.col("key") == identity_key(spec, config, resample)) | ((F.col("slug") == slice_slug(spec)) & (F.col("stem") == model_stem(config))))
    known = set(rows.columns)
    apart = [F.when(~F.col(k).cast("string").eqNullSafe(F.lit(None if v is None else str(v).lower() if isinstance(v, bool) else str(v))), F.lit(k)) for k, v in mine.items() if k in known]
    same = F.col("key") == identity_key(spec, config, resample)
    return rows.select("path", F.when(same, "same fit").otherwise("same name").alias("clash"), F.when(~same, F.concat_ws(",", *apart)).otherwise("").alias("differs"))
