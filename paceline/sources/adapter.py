"""Core tables (athletes, competitions, results) from order data: customers are athletes, suppliers are series.

An edition of a series is a supplier's shipping year.  A finish is the cheapest line of a customer at an
edition; some chip times are missing so that the choice of the time column matters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Customer segments that stand for cohort flags.
FLAGS = {"has_wmm": "BUILDING", "has_po10": "MACHINERY", "has_wa": "AUTOMOBILE", "has_nyrr": "FURNITURE"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def athletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    yob_min = F.when(F.col("c_acctbal") >= 0, 1940 + key % 40).cast("int")
    nation = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("country"))
    return (
        read(spark, sf_dir, "customer")
        .join(nation, "c_nationkey", "left")
        .select(
            key.cast("long").alias("athlete_id"),
            F.when(key % 3 == 0, "W").otherwise("M").alias("sex"),
            "country",
            yob_min.alias("yob_min"),
            F.when(key % 7 != 0, yob_min + (key % 3).cast("int")).alias("yob_max"),
            *((F.col("c_mktsegment") == s).alias(flag) for flag, s in FLAGS.items()),
        )
    )


def _shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_linenumber")
    race = F.col("l_suppkey").cast("long") * 10000 + F.year("l_shipdate")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).withColumn("race_id", race)


def competitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("country"))
    series = read(spark, sf_dir, "supplier").join(nation, "s_nationkey", "left").select("s_suppkey", F.col("s_name").alias("series_key"), "country")
    dates = _shipments(spark, sf_dir).groupBy("race_id", "l_suppkey").agg(F.min("l_shipdate").cast("date").alias("date"))
    return dates.join(series, F.col("l_suppkey") == F.col("s_suppkey"), "left").select(
        "race_id", F.col("race_id").alias("competition_id"), "series_key", "country", "date", (F.col("race_id") % 10000).cast("int").alias("year")
    )


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = _shipments(spark, sf_dir).groupBy("o_custkey", "l_suppkey", "race_id").agg(
        F.min("l_extendedprice").cast("double").alias("price"), F.max("l_linenumber").cast("double").alias("line")
    )
    chip = 6800 + 0.25 * F.col("price")
    return per.select(
        F.col("o_custkey").cast("long").alias("athlete_id"),
        "race_id",
        F.when((F.col("l_suppkey") + F.col("o_custkey")) % 97 != 0, chip).alias("chip_time_sec"),
        (chip + 5 * F.col("line")).alias("gun_time_sec"),
    )


#: The same three tables as DuckDB common table expressions.
CTES = """
athletes AS (SELECT c_custkey::BIGINT athlete_id, CASE WHEN c_custkey % 3 = 0 THEN 'W' ELSE 'M' END sex, n_name country,
  CASE WHEN c_acctbal >= 0 THEN 1940 + c_custkey % 40 END yob_min,
  CASE WHEN c_acctbal >= 0 AND c_custkey % 7 <> 0 THEN 1940 + c_custkey % 40 + c_custkey % 3 END yob_max,
  c_mktsegment = 'BUILDING' has_wmm, c_mktsegment = 'MACHINERY' has_po10, c_mktsegment = 'AUTOMOBILE' has_wa,
  c_mktsegment = 'FURNITURE' has_nyrr FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey),
ships AS (SELECT o_custkey, l_suppkey, l_suppkey::BIGINT * 10000 + year(l_shipdate) race_id, l_shipdate, l_extendedprice, l_linenumber
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
competitions AS (SELECT race_id, race_id competition_id, s_name series_key, n_name country, d "date", race_id % 10000 "year"
  FROM (SELECT race_id, l_suppkey, min(l_shipdate)::DATE d FROM ships GROUP BY 1, 2)
  LEFT JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN nation ON n_nationkey = s_nationkey),
results AS (SELECT o_custkey::BIGINT athlete_id, race_id,
  CASE WHEN (l_suppkey + o_custkey) % 97 <> 0 THEN 6800 + 0.25 * price END chip_time_sec, 6800 + 0.25 * price + 5 * line gun_time_sec
  FROM (SELECT o_custkey, l_suppkey, race_id, min(l_extendedprice)::DOUBLE price, max(l_linenumber)::DOUBLE line FROM ships GROUP BY 1, 2, 3))
"""
