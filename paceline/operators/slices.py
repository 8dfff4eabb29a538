"""From the core tables to a well-connected design: filters, iterated pruning, one component, career ages."""

from __future__ import annotations

import hashlib
import json
import math
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paceline.sources import adapter
from paceline.sources.scratch import discard, written


@dataclass(frozen=True)
class SliceSpec:
    """What enters a slice; ``key`` names it for caches."""

    cohort: str | None = None
    sex: str | None = None
    countries_include: tuple[str, ...] = ()
    countries_exclude: tuple[str, ...] = ()
    require_yob: bool = False
    min_age: float | None = None
    max_age: float | None = None
    series_include: tuple[str, ...] = ()
    series_exclude: tuple[str, ...] = ()
    race_countries_include: tuple[str, ...] = ()
    race_countries_exclude: tuple[str, ...] = ()
    date_from: str | None = None
    date_to: str | None = None
    time_kind: str = "chip_else_gun"
    min_time: float = 7100.0
    max_time: float = 36000.0
    min_race_count: int = 25
    min_field: int = 60
    response: str = "log"

    @property
    def key(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()[:16]


def _in(column: str, include: tuple[str, ...], exclude: tuple[str, ...]) -> Column:
    """IN and NOT IN, where a null is in neither list."""
    keep = F.col(column).isin(*include) if include else F.lit(True)
    return keep & ~F.coalesce(F.col(column).isin(*exclude), F.lit(False)) if exclude else keep


def athlete_filter(athletes: DataFrame, spec: SliceSpec) -> DataFrame:
    out = athletes.filter(_in("country", spec.countries_include, spec.countries_exclude))
    if spec.cohort:
        out = out.filter(F.coalesce(F.col(f"has_{spec.cohort}"), F.lit(False)))
    if spec.sex:
        out = out.filter(F.col("sex") == spec.sex)
    if spec.require_yob:
        out = out.filter(F.col("yob_min").isNotNull() | F.col("yob_max").isNotNull())
    return out


def race_filter(races: DataFrame, spec: SliceSpec) -> DataFrame:
    out = races.filter(_in("series_key", spec.series_include, spec.series_exclude)).filter(
        _in("country", spec.race_countries_include, spec.race_countries_exclude)
    )
    if spec.date_from:
        out = out.filter(F.col("date") >= F.lit(spec.date_from).cast("date"))
    if spec.date_to:
        out = out.filter(F.col("date") <= F.lit(spec.date_to).cast("date"))
    return out


def time_column(kind: str) -> Column:
    return {"chip": F.col("chip_time_sec"), "gun": F.col("gun_time_sec"), "chip_else_gun": F.coalesce("chip_time_sec", "gun_time_sec")}[kind]


def yob_mid() -> Column:
    """Midpoint of the two bounds, or the one that is known."""
    return F.coalesce((F.col("yob_min") + F.col("yob_max")) / 2, F.col("yob_min").cast("double"), F.col("yob_max").cast("double"))


def finishes(athletes: DataFrame, races: DataFrame, results: DataFrame, spec: SliceSpec) -> DataFrame:
    """athlete_id, race_id, t, date, yob of the results that pass the filters."""
    people = athlete_filter(athletes, spec).select("athlete_id", yob_mid().alias("yob"))
    editions = race_filter(races, spec).select("race_id", "date")
    timed = results.withColumn("t", time_column(spec.time_kind)).filter(F.col("t").between(spec.min_time, spec.max_time))
    return timed.join(people, "athlete_id").join(editions, "race_id").select("athlete_id", "race_id", "t", "date", "yob")


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage by a table in the shared folder."""
    return written(df, "cut")


def prune_pass(cells: DataFrame, spec: SliceSpec) -> DataFrame:
    """Age band, then athletes with enough races, then races with enough athletes: three windows, two shuffles."""
    by_athlete, by_race = Window.partitionBy("athlete_id"), Window.partitionBy("race_id")
    if spec.min_age is not None or spec.max_age is not None:
        age = F.year(F.min("date").over(by_athlete)) - F.col("yob")
        lo, hi = spec.min_age if spec.min_age is not None else -math.inf, spec.max_age if spec.max_age is not None else math.inf
        cells = cells.withColumn("_age", age).filter(F.col("_age").isNull() | F.col("_age").between(lo, hi)).drop("_age")
    cells = cells.withColumn("_n", F.count("*").over(by_athlete)).filter(F.col("_n") >= spec.min_race_count)
    return cells.withColumn("_n", F.count("*").over(by_race)).filter(F.col("_n") >= spec.min_field).drop("_n")


def _judged(left: DataFrame, spec: SliceSpec) -> DataFrame:
    """athlete_id, good: whether an athlete's cells are enough and its age within the band."""
    banded = spec.min_age is not None or spec.max_age is not None
    age = F.year(F.min("date")) - F.min("yob") if banded else F.lit(None).cast("double")
    lo, hi = (-math.inf if spec.min_age is None else spec.min_age), (math.inf if spec.max_age is None else spec.max_age)
    per = left.groupBy("athlete_id").agg(F.count("*").alias("n"), age.alias("age"))
    return per.select("athlete_id", ((F.col("n") >= spec.min_race_count) & (F.col("age").isNull() | F.col("age").between(lo, hi))).alias("good"))


def prune(cells: DataFrame, spec: SliceSpec) -> DataFrame:
    """Passes of ``prune_pass`` until nothing goes.

    The first pass takes most and is written.  Later ones take few athletes and races: their lists are kept, and only athletes of races that
    went, and races of athletes that went, are counted again, so that cells are read but not shuffled while those lists are short.
    """
    cells = cut(cells)
    mine = _judged(cells, spec).filter("good").select("athlete_id")
    some = cut(cells.join(mine, "athlete_id", "left_semi"))
    discard(cells)
    theirs = some.groupBy("race_id").agg(F.count("*").alias("n")).filter(F.col("n") >= spec.min_field).select("race_id")
    base = cut(some.join(theirs, "race_id", "left_semi"))
    discard(some)
    left, gone_races = base, None
    while True:
        judged = left
        if gone_races is not None:
            affected = cut(base.join(gone_races, "race_id", "left_semi").select("athlete_id").distinct())
            judged = left.join(affected, "athlete_id", "left_semi")
        gone_athletes = cut(_judged(judged, spec).filter("not good").select("athlete_id"))
        if gone_athletes.isEmpty():
            return left
        affected = cut(left.join(gone_athletes, "athlete_id", "left_semi").select("race_id").distinct())
        left = left.join(gone_athletes, "athlete_id", "left_anti")
        fields = left.join(affected, "race_id", "left_semi").groupBy("race_id").agg(F.count("*").alias("n"))
        gone_races = cut(fields.filter(F.col("n") < spec.min_field).select("race_id"))
        if gone_races.isEmpty():
            return left
        left = left.join(gone_races, "race_id", "left_anti")


def _spread(links: DataFrame) -> DataFrame:
    """race_id, comp of linked races (race_id, hub; a hub is linked to itself): labels spread to neighbours and then jump to the label of the
    label, so that long chains take few rounds."""
    both = cut(links.union(links.select("hub", "race_id")).distinct())
    labels = cut(both.groupBy("race_id").agg(F.min("hub").alias("comp")))
    while True:
        near = both.join(labels.select(F.col("race_id").alias("hub"), F.col("comp").alias("c")), "hub")
        least = near.groupBy("race_id").agg(F.min("c").alias("c"))
        lower = cut(labels.join(least, "race_id").select("race_id", F.least("c", "comp").alias("comp"), F.col("comp").alias("old")))
        jump = lower.select(F.col("race_id").alias("comp"), F.col("comp").alias("up"))
        new = cut(lower.join(jump, "comp", "left").select("race_id", F.least("comp", F.coalesce("up", "comp")).alias("comp"), "old"))
        discard(labels, lower)
        labels = new
        if new.filter("comp <> old").isEmpty():
            discard(both)
            return new.select("race_id", "comp")


def race_components(cells: DataFrame) -> DataFrame:
    """race_id, comp: components of the athlete-race graph, each named by its smallest race.

    Races are first linked through their smallest and their largest athlete alone, two links a race, which joins most of what hangs together.
    Then one pass over all cells finds the athletes whose races still have several labels, and only those labels are linked.
    """
    ends = cells.groupBy("race_id").agg(F.array(F.min("athlete_id"), F.max("athlete_id")).alias("ends"))
    few = cut(ends.select("race_id", F.explode("ends").alias("athlete_id")))
    hubs = few.groupBy("athlete_id").agg(F.min("race_id").alias("hub"))
    first = _spread(few.join(hubs, "athlete_id").select("race_id", "hub"))
    marked = cells.select("athlete_id", "race_id").join(first, "race_id").select("athlete_id", "comp")
    bridges = cut(marked.groupBy("athlete_id").agg(F.min("comp").alias("hub"), F.max("comp").alias("most")).filter("hub < most").select("athlete_id", "hub"))
    if bridges.isEmpty():
        return first
    joined = _spread(marked.join(bridges, "athlete_id").select(F.col("comp").alias("race_id"), "hub").distinct())
    renamed = joined.select(F.col("race_id").alias("comp"), F.col("comp").alias("least"))
    return cut(first.join(renamed, "comp", "left").select("race_id", F.coalesce("least", "comp").alias("comp")))


def is_connected(cells: DataFrame) -> bool:
    """Whether all races hang together."""
    return race_components(cells).select("comp").distinct().limit(2).count() <= 1


def component_sizes(cells: DataFrame, labels: DataFrame) -> DataFrame:
    """comp, n: cells of each component, counted by race before races meet their labels."""
    fields = cells.groupBy("race_id").agg(F.count("*").alias("_cells"))
    return fields.join(labels, "race_id").groupBy("comp").agg(F.sum("_cells").alias("n"))


def giant_component(cells: DataFrame) -> DataFrame:
    """The cells of the component with most cells, ties to the smallest label."""
    labels = race_components(cells)
    best = component_sizes(cells, labels).orderBy(F.desc("n"), "comp").limit(1).select("comp")
    other = cut(labels.join(F.broadcast(best), "comp", "left_anti").select("race_id"))  # one row
    return cells if other.isEmpty() else cells.join(other, "race_id", "left_anti")


def keyed(cells: DataFrame, run: str) -> DataFrame:
    """Ids within runs: athlete_id and race_id become (run, id), so that pruning and components treat all runs at once."""
    return cells.withColumns({c: F.struct(F.col(run).alias("run"), F.col(c).alias("id")) for c in ("athlete_id", "race_id")})


def giant_components(cells: DataFrame) -> DataFrame:
    """``giant_component`` of each run of keyed cells, with plain ids and the run again."""
    labels = race_components(cells)
    sizes = component_sizes(cells, labels)
    place = F.row_number().over(Window.partitionBy("comp.run").orderBy(F.desc("n"), "comp"))
    best = sizes.withColumn("_place", place).filter("_place = 1").select("comp")
    kept = cells.join(labels.join(best, "comp", "left_semi").select("race_id"), "race_id", "left_semi")
    return kept.withColumn("athlete_id", F.col("athlete_id.id")).withColumn("race_id", F.col("race_id.id"))


def career(cells: DataFrame, spec: SliceSpec) -> DataFrame:
    """y, A_n (years since the first race), A_e (age in the year of the first race; null if unknown)."""
    first = F.min("date").over(Window.partitionBy("athlete_id"))
    y = F.ln("t") if spec.response == "log" else F.col("t")
    return cells.withColumn("first", first).select(
        "athlete_id", "race_id", "date", "t", y.alias("y"), (F.datediff("date", "first") / 365.25).alias("a_n"), (F.year("first") - F.col("yob")).alias("a_e")
    )


def subset(cells: DataFrame, keep: Column) -> DataFrame:
    """The giant component of the cells that are kept; career ages are those of the whole."""
    return giant_component(cut(cells.filter(keep)))


def load_slice(spark: SparkSession, sf_dir: str, spec: SliceSpec = SliceSpec()) -> DataFrame:
    """The whole preparation; an empty slice is an error."""
    cells = finishes(adapter.athletes(spark, sf_dir), adapter.competitions(spark, sf_dir), adapter.results(spark, sf_dir), spec)
    cells = prune(cells, spec)
    cells = cut(cells)
    if cells.isEmpty():
        raise ValueError(f"slice {spec.key} is empty")
    return career(giant_component(cells), spec)


def dense_index(df: DataFrame, column: str, name: str) -> DataFrame:
    """Distinct ids of a column with their 0-based rank.

    Ids are dealt by range; a rank is the place in the part and the ids of the parts before, of which there are as many as shuffle
    partitions.
    """
    dealt = cut(df.select(column).distinct().repartitionByRange(column).withColumn("_part", F.spark_partition_id()))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = dealt.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", before.alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(column)) - 1
    return dealt.join(parts, "_part").select(column, (F.col("_before") + place).cast("long").alias(name))


def first_seen_index(df: DataFrame, column: str, order: str, name: str) -> DataFrame:
    """Distinct ids with their 0-based place by first appearance (smallest ``order``, then the id)."""
    first = df.groupBy(column).agg(F.min(order).alias("_first")).withColumn("_key", F.struct("_first", column))
    ranked = dense_index(first, "_key", name)
    return ranked.select(F.col(f"_key.{column}").alias(column), name)


def _before(dealt: DataFrame, n: Column, name: str) -> DataFrame:
    """_part and how much the parts before it hold, of which there are as many as shuffle partitions."""
    parts = dealt.groupBy("_part").agg(F.sum(n).alias("_n"))
    upto = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    return parts.select("_part", F.coalesce(upto, F.lit(0)).alias(name))


def row_places(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with its place in an order, from 1: rows are dealt by range, and a place is that within the part and the rows of the parts before."""
    dealt = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    out = dealt.withColumn("_within", within).join(_before(dealt, F.lit(1), "_before"), "_part")
    return out.withColumn(name, (F.col("_before") + F.col("_within")).cast("long")).drop("_part", "_within", "_before")


def average_ranks(df: DataFrame, ranks: dict[str, str]) -> DataFrame:
    """``df`` with the average rank of each column, ascending, under the names given; nulls have none.

    Equal values are counted before the shuffle and their counts dealt by range, so that no task holds more than its range of distinct values.
    """
    for column, name in ranks.items():
        counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("_value")).agg(F.count("*").alias("_count"))
        dealt = cut(counts.repartitionByRange("_value").withColumn("_part", F.spark_partition_id()))
        upto = F.coalesce(F.sum("_count").over(Window.partitionBy("_part").orderBy("_value").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        placed = dealt.withColumn("_upto", upto).join(_before(dealt, F.col("_count"), "_before"), "_part")
        ranked = placed.select("_value", (F.col("_before") + F.col("_upto") + (F.col("_count") + 1) / 2).alias(name))
        df = df.join(ranked, df[column] == F.col("_value"), "left").drop("_value")
    return df
