"""Descriptive tables over the core tables and slices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paceline.functions.scalars import bucket_label, rounded
from paceline.operators.quantiles import quantiles
from paceline.operators.slices import cut


def overview(athletes: DataFrame, races: DataFrame, results: DataFrame) -> DataFrame:
    """One row of counts for the whole corpus."""
    people = athletes.agg(F.count("*").alias("n_athletes"), F.count_if(F.col("sex") == "W").alias("n_women"))
    editions = races.agg(F.count("*").alias("n_editions"), F.count_distinct("series_key").alias("n_series"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    times = results.agg(F.count("*").alias("n_results"), F.count("chip_time_sec").alias("n_chip"))
    return people.crossJoin(editions).crossJoin(times)  # one row each


def catalogue(results: DataFrame, races: DataFrame, athletes: DataFrame) -> DataFrame:
    """Per series: editions, years, finishes by sex."""
    joined = results.join(races, "race_id").join(athletes.select("athlete_id", "sex"), "athlete_id")
    return joined.groupBy("series_key").agg(
        F.count_distinct("race_id").alias("n_editions"),
        F.count_distinct("year").alias("n_years"),
        F.count("*").alias("n_finishes"),
        F.count_if(F.col("sex") == "M").alias("n_men"),
        F.count_if(F.col("sex") == "W").alias("n_women"),
    )


def finishes_per_athlete(results: DataFrame) -> DataFrame:
    """Athletes by how often they finished, with shares and a total row."""
    per = results.groupBy("athlete_id").agg(F.count("*").alias("n"))
    counts = per.groupBy(bucket_label(F.col("n")).alias("bucket")).agg(F.count("*").alias("n_athletes"), F.sum("n").alias("n_finishes"))
    total = counts.agg(F.lit("total").alias("bucket"), F.sum("n_athletes").alias("n_athletes"), F.sum("n_finishes").alias("n_finishes"))
    whole = total.select(F.col("n_athletes").alias("all_athletes"))
    shared = counts.unionByName(total).crossJoin(F.broadcast(whole))  # one row
    return shared.select("bucket", "n_athletes", "n_finishes", rounded(F.col("n_athletes") / F.col("all_athletes")).alias("share"))


def temporal(results: DataFrame, races: DataFrame) -> DataFrame:
    return results.join(races.select("race_id", "year"), "race_id").groupBy("year").agg(
        F.count_distinct("race_id").alias("n_races"), F.count("*").alias("n_finishes"), F.count_distinct("athlete_id").alias("n_athletes")
    )


def geography(results: DataFrame, races: DataFrame, k: int = 10) -> DataFrame:
    """The k countries with most finishes."""
    counted = results.join(races.select("race_id", "country"), "race_id").groupBy("country").agg(F.count("*").alias("n_finishes"))
    return counted.orderBy(F.desc("n_finishes"), "country").limit(k)


def demographics(athletes: DataFrame) -> DataFrame:
    span = (F.col("yob_max") - F.col("yob_min")).cast("double")
    known = F.col("yob_min").isNotNull() | F.col("yob_max").isNotNull()
    flags = [rounded(F.avg(F.col(f).cast("double"))).alias(f) for f in ("has_wmm", "has_po10", "has_wa", "has_nyrr")]
    return athletes.groupBy("sex").agg(
        F.count("*").alias("n"), F.count_if(known).alias("n_known"), rounded(F.median(span)).alias("span_median"), rounded(F.percentile(span, 0.9)).alias("span_p90"), *flags
    )


def finish_times(cells: DataFrame, athletes: DataFrame) -> DataFrame:
    """Time distribution by sex and for all; quantiles in full, as interpolated times of four digits tie when cut shorter."""
    joined = cut(cells.join(athletes.select("athlete_id", "sex"), "athlete_id").select("sex", "t"))
    shares = [(1, 0.01), (10, 0.1), (50, 0.5), (90, 0.9), (99, 0.99)]
    cuts = quantiles(joined, "t", [q for _, q in shares], "sex")
    sums = joined.groupBy("sex").agg(F.count("*").alias("n"), F.sum("t").alias("s"))
    sums = sums.unionByName(sums.agg(F.lit("All").alias("sex"), F.sum("n").alias("n"), F.sum("s").alias("s")))
    rows = [("All" if k is None else k, *of) for k, of in cuts.items()]
    found = cells.sparkSession.createDataFrame(rows, ", ".join(["sex string", *(f"p{p} double" for p, _ in shares)]))
    out = sums.filter("n > 0").join(F.broadcast(found), "sex")  # a row a sex
    return out.select("sex", "n", rounded(F.col("s") / F.col("n"), 4).alias("mean"), *(rounded(F.col(f"p{p}"), 6).alias(f"p{p}") for p, _ in shares))


def sparsity(cells: DataFrame) -> DataFrame:
    per = cells.groupBy("race_id").agg(F.count("*").alias("n"))
    sizes = cells.agg(F.count("*").alias("n_cells"), F.count_distinct("athlete_id").alias("n_athletes"), F.count_distinct("race_id").alias("n_races"))
    fields = per.agg(rounded(F.percentile("n", 0.5)).alias("p50"), rounded(F.percentile("n", 0.9)).alias("p90"), F.max("n").alias("largest"))
    fill = rounded(F.try_divide(F.col("n_cells") / F.lit(1.0), F.col("n_athletes") * F.col("n_races")), 8).alias("fill")
    return sizes.crossJoin(fields).select("*", fill)  # one row each


def series_summary(cells: DataFrame, races: DataFrame, values: DataFrame) -> DataFrame:
    """Per series: editions, years, country of the first edition, field, median and interquartile range of v."""
    fields = cells.groupBy("race_id").agg(F.count("*").alias("n"))
    joined = values.join(races, "race_id").join(fields, "race_id")
    return joined.groupBy("series_key").agg(
        F.count("*").alias("k_editions"),
        F.min_by("country", "race_id").alias("country"),
        F.min("year").alias("yr_min"),
        F.max("year").alias("yr_max"),
        F.sum("n").alias("n_total"),
        rounded(F.median("v")).alias("median_v"),
        rounded(F.percentile("v", 0.75) - F.percentile("v", 0.25)).alias("iqr_v"),
    )


def histogram(values: DataFrame, column: str, lo: float, hi: float, bins: int, group: str) -> DataFrame:
    """Counts in equal bins, the last closed on the right, per group."""
    x = F.col(column)
    at = F.least(F.floor((x - lo) / ((hi - lo) / bins)), F.lit(bins - 1)).cast("long")
    return values.filter(x.between(lo, hi)).groupBy(group, at.alias("bin")).agg(F.count("*").alias("n"))


def participation(cells: DataFrame, athletes: DataFrame, races: DataFrame) -> DataFrame:
    """Series by sex, wide, zero where nobody took part."""
    joined = cells.join(athletes.select("athlete_id", "sex"), "athlete_id").join(races.select("race_id", "series_key"), "race_id")
    wide = joined.groupBy("series_key").pivot("sex", ["M", "W"]).count().na.fill(0)
    return wide.select("series_key", F.col("M").alias("n_men"), F.col("W").alias("n_women"))


def mode_country(cells: DataFrame, athletes: DataFrame, races: DataFrame) -> DataFrame:
    """Per series the most frequent country of its finishers, ties to the first by name."""
    counted = cells.join(athletes.select("athlete_id", "country"), "athlete_id").join(races.select("race_id", "series_key"), "race_id").groupBy("series_key", "country").agg(F.count("*").alias("n"))
    best = counted.groupBy("series_key").agg(F.min(F.struct((-F.col("n")).alias("m"), "country")).alias("b"))
    return best.select("series_key", F.col("b.country").alias("country"), (-F.col("b.m")).alias("n"))


def span_ecdf(cells: DataFrame) -> DataFrame:
    """Career spans by race-count stratum: size, share under half a year and five years, median."""
    per = cells.groupBy("athlete_id").agg(F.count("*").alias("n"), (F.max("a_n") - F.min("a_n")).alias("span"))
    stratum = F.when(F.col("n") < 30, "under 30").when(F.col("n") < 40, "30-39").otherwise("40 and more")
    return per.groupBy(stratum.alias("stratum")).agg(
        F.count("*").alias("n"),
        rounded(F.avg((F.col("span") < 0.5).cast("double"))).alias("below_half"),
        rounded(F.avg((F.col("span") < 5).cast("double"))).alias("below_five"),
        rounded(F.median("span")).alias("median_span"),
    )


def moments(values: DataFrame, column: str) -> DataFrame:
    """Size, mean, standard deviation, population skewness and excess kurtosis, tails beyond two sigma."""
    base = values.agg(F.avg(column).alias("m"), F.stddev_pop(column).alias("s"))
    z = F.try_divide(F.col(column) - F.col("m"), F.col("s"))
    scored = values.crossJoin(F.broadcast(base)).withColumn("z", z)  # one row
    return scored.agg(
        F.count("*").alias("n"), rounded(F.avg(column)).alias("mean"), rounded(F.stddev_samp(column)).alias("sd"),
        rounded(F.skewness(column), 5).alias("skewness"), rounded(F.kurtosis(column), 5).alias("kurtosis"),
        rounded(F.avg((F.col("z") > 2).cast("double"))).alias("upper_tail"), rounded(F.avg((F.col("z") < -2).cast("double"))).alias("lower_tail"),
    )


def box_stats(values: DataFrame, group: str, column: str) -> DataFrame:
    """Quartiles, and whiskers at the outermost points within 1.5 interquartile ranges."""
    q = values.groupBy(group).agg(F.percentile(column, 0.25).alias("q1"), F.percentile(column, 0.5).alias("q2"), F.percentile(column, 0.75).alias("q3"))
    joined = values.join(q, group)
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col(column).between(F.col("q1") - reach, F.col("q3") + reach)
    return joined.groupBy(group).agg(
        *(rounded(F.first(c)).alias(c) for c in ("q1", "q2", "q3")), rounded(F.min(F.when(inside, F.col(column)))).alias("lo"), rounded(F.max(F.when(inside, F.col(column)))).alias("hi")
    )


def ordinal_rank(values: DataFrame, column: str, key: str, name: str, partition: list[str] | None = None, descending: bool = False) -> DataFrame:
    """Ranks 1, 2, 3, ...; ties by key.  Without a partition the table must be one row per race."""
    order = F.desc(column) if descending else F.asc(column)
    return values.withColumn(name, F.row_number().over(Window.partitionBy(*(partition or [])).orderBy(order, key)))


def slice_sizes(cells: DataFrame, key: str) -> DataFrame:
    """n_cells, n_athletes, n_races of each run of keyed cells (athlete_id and race_id are structs with the run)."""
    return cells.groupBy(F.col("athlete_id.run").alias(key)).agg(
        F.count("*").alias("n_cells"), F.count_distinct("athlete_id.id").alias("n_athletes"), F.count_distinct("race_id.id").alias("n_races")
    )
