"""Durable tables: content-addressed slices, keyed upserts, run partitions, registries, CSV and JSON."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paceline.operators.slices import SliceSpec, load_slice
from paceline.sources.scratch import hadoop, publish, shared_dir

def fingerprint(spark: SparkSession, paths: list[str]) -> str:
    """What identifies the content of input files: their number, names, sizes and times, in one row of sums."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select("path", "length", "modificationTime")
    each = F.xxhash64(F.element_at(F.split("path", "/"), -1), "length", "modificationTime")
    got = files.agg(F.count("*"), F.sum("length"), F.bit_xor(each), F.sum(F.pmod(each, F.lit(1 << 40)))).first()
    return hashlib.sha256(repr(tuple(got)).encode()).hexdigest()[:16]


def core_fingerprint(spark: SparkSession, sf_dir: str) -> str:
    return fingerprint(spark, [f"{sf_dir}/{t}.parquet" for t in ("customer", "lineitem", "nation", "orders", "supplier")])


def cached(spark: SparkSession, kind: str, key: tuple, build: Callable[[], DataFrame]) -> DataFrame:
    """A table by its content key: built and published once, by whichever application comes first, then read back."""
    name = hashlib.sha256(repr(key).encode()).hexdigest()[:24]
    path = f"{shared_dir(spark)}/paceline-{kind}-{name}"
    at, fs = hadoop(spark, path)
    return spark.read.parquet(path) if fs.exists(at) else publish(build(), path)


def cached_slice(spark: SparkSession, sf_dir: str, spec: SliceSpec = SliceSpec()) -> DataFrame:
    """A slice by the content of its input and the key of its specification."""
    return cached(spark, "slice", (core_fingerprint(spark, sf_dir), spec.key), lambda: load_slice(spark, sf_dir, spec))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new``, and those of ``old`` whose key is not in it."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def upsert_last(tables: list[DataFrame], keys: list[str], order: str) -> DataFrame:
    """The rows of all tables, the last by (table, ``order``) of each key."""
    marked = [t.withColumn("_part", F.lit(i)) for i, t in enumerate(tables)]
    every = marked[0]
    for t in marked[1:]:
        every = every.unionByName(t, allowMissingColumns=True)
    last = Window.partitionBy(*keys).orderBy(F.desc("_part"), F.desc(order))
    return every.withColumn("_rn", F.row_number().over(last)).filter("_rn = 1").drop("_rn", "_part")


def append_runs(runs: DataFrame, path: str) -> None:
    """Replicates by run_id: partitions present in ``runs`` are replaced as a whole, others stay."""
    runs.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def register_fit(spark: SparkSession, path: str, identity: dict, figures: dict) -> None:
    """Append a fit's manifest to the registry, one JSON row with flat columns."""
    spark.createDataFrame([(json.dumps(identity | figures, sort_keys=True, default=str),)], "value string").write.mode("append").text(path)


def registry(spark: SparkSession, path: str, **filters: object) -> DataFrame:
    """Registered fits, by equality or membership on any column."""
    rows = spark.read.json(path)
    for column, wanted in filters.items():
        rows = rows.filter(F.col(column).isin(*wanted) if isinstance(wanted, list | tuple | set) else F.col(column) == wanted)
    return rows


def rollup_csv(spark: SparkSession, glob: str, schema: str) -> DataFrame:
    """Many CSV files of one schema as one table, with the file each row came from."""
    return spark.read.csv(glob, header=True, schema=schema).withColumn("file", F.col("_metadata.file_path"))
