"""Mixing sources to target weights by hash-threshold histograms.

A document's hash is the first 48 bits of the MD5 of its doc_id.  Words are summed by source and the leading
``bits`` of the hash; the running sums locate the bucket in which a source's budget ends, and only documents
of that one bucket are summed again by the next bits, until the hash is used up.  What lies before the
boundary is in, what lies after is out, and the boundary hash itself is in if that brings the source nearer to its
target.  No rows are sorted, and every run selects the same documents.

Targets: sources in code point order (null last) weigh 1, 2, 3, repeating, and share all words; a target stops at
``most`` times its source's words and the excess is shared by weight among the others.  One sum over the sources a round finds
the words for each unit of weight among those not yet stopped, until no further source stops.  A source first gives whole copies
of every document, then the documents below its threshold once more.

A hot source is summed before the shuffle.  Per-source tables have one row for each source, are dealt by source or by range of
sources and never gathered; joined to documents they are plain tables, which the optimiser may broadcast by its own threshold
and otherwise meets in a shuffle whose hot sources adaptive execution splits.

Defined cases: null and wordless texts have size 0 and give nothing; null sources are one source, last in order;
rows with equal (or null) doc_id share one hash and are taken together; very long texts count whole; a source of size 0 has
target 0; an empty table gives an empty result; extra columns pass through unless named like an output.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceline.llm.common import NOT_BLANKS, discard, free_name, others, written


@dataclass(frozen=True)
class MixParams:
    weights: tuple[int, ...] = (1, 2, 3)
    most: int = 3
    bits: int = 12
    levels: int = 4


def word_count(text: Column) -> Column:
    """The number of blank-separated words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(NOT_BLANKS)), F.lit(0)).cast("long")


def doc_hash(doc_id: Column, params: MixParams = MixParams()) -> Column:
    """A non-negative long of bits * levels bits."""
    digits = params.bits * params.levels // 4
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, digits), 16, 10).cast("long")


def ranked_sources(sizes: DataFrame) -> DataFrame:
    """``sizes`` (a row for each source) with rank, from 0 in code point order, null last.

    Dealt by range; a source's rank is its place in its part and the rows of the parts before, of which there are as many as
    shuffle partitions.
    """
    dealt = written(sizes.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "mix-sources")
    parts = dealt.groupBy("part").agg(F.count("*").alias("n"))
    before = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    out = written(dealt.join(before, "part").withColumn("rank", F.col("before") + place).drop("part", "before"), "mix-ranks")
    discard(dealt)
    return out


def source_targets(sized: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """source, source_size, target, copies (whole copies), budget (words beyond them)."""
    ranked = ranked_sources(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    weights = F.array(*(F.lit(w) for w in params.weights))
    cap = params.most * F.col("source_size")
    weight = F.get(weights, (F.col("rank") % len(params.weights)).cast("int")).cast("long")
    placed = ranked.select("source", "source_size", cap.alias("cap"), weight.alias("weight"))
    total, level, stopped = placed.agg(F.sum("source_size")).first()[0] or 0, 0.0, -1
    while total:
        stops = F.col("cap") < F.lit(level) * F.col("weight")
        full, rest, n = placed.agg(
            F.coalesce(F.sum(F.when(stops, F.col("cap"))), F.lit(0)), F.sum(F.when(~stops, F.col("weight"))), F.count_if(stops)
        ).first()
        if n == stopped:
            break
        level, stopped = (total - full) / rest, n
    target = F.least(F.col("cap").cast("double"), F.lit(level) * F.col("weight"))
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    return (
        placed.withColumn("target", target)
        .withColumn("copies", copies)
        .withColumn("budget", F.col("target") - F.col("copies") * F.col("source_size"))
        .select("source", "source_size", "target", "copies", "budget")
    )


def _thresholds(sized: DataFrame, targets: DataFrame, params: MixParams) -> DataFrame:
    """source, edge: documents with a smaller hash are in; last: the hash at the edge is in as well."""
    left = targets.select("source", F.lit(0).cast("long").alias("edge"), F.lit(0.0).alias("before"), "budget")
    step, before_level = Window.partitionBy("source").orderBy("bucket"), []
    for level in range(params.levels):
        unit = 1 << (params.bits * (params.levels - level - 1))  # hashes in one bucket of this level
        rows = sized
        if level:
            inside = left.filter("bucket is not null").select(F.col("source").alias("s"), F.col("edge").alias("e"))
            span = (F.col("h") >= F.col("e")) & (F.col("h") < F.col("e") + unit * (1 << params.bits))
            rows = sized.join(inside, F.col("source").eqNullSafe(F.col("s")) & span, "left_semi")
        sums = rows.groupBy("source", F.floor(F.col("h") / unit).cast("long").alias("bucket")).agg(F.sum("size").alias("words"))
        running = (
            sums.filter("words > 0")
            .withColumn("upto", F.sum("words").over(step))  # at most 2 ** bits rows a source
            .withColumnRenamed("source", "s")
        )
        over = (
            left.select("source", "before", "budget")
            .join(running, F.col("source").eqNullSafe(F.col("s")) & (F.col("before") + F.col("upto") > F.col("budget")))
            .groupBy("source")
            .agg(F.min(F.struct("bucket", "upto", "words")).alias("hit"))
            .select(F.col("source").alias("s"), "hit")
        )
        left = (
            left.select("source", "before", "budget")
            .join(over, F.col("source").eqNullSafe(F.col("s")), "left")
            .select(
                "source",
                "budget",
                (F.col("hit.bucket") * unit).alias("edge"),
                F.col("hit.bucket").alias("bucket"),
                (F.col("before") + F.coalesce(F.col("hit.upto") - F.col("hit.words"), F.lit(0))).alias("before"),
                F.col("hit.words").alias("words"),
            )
        )
        left = written(left, "mix-level")
        discard(*before_level)
        before_level = [left]
    last = F.col("budget") - F.col("before") >= F.col("before") + F.col("words") - F.col("budget")
    return left.select("source", "edge", F.coalesce(last, F.lit(False)).alias("last"))


def mix(docs: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """``docs`` with size, source_size, target and taken (words of the document in the mix, repeats counted)."""
    outputs = "size", "source_size", "target", "taken"
    sized = written(
        docs.select("source", doc_hash(F.col("doc_id"), params).alias("h"), word_count(F.col("text")).alias("size")), "mix-sizes"
    )
    targets = written(source_targets(sized, params), "mix-targets")
    edges = _thresholds(sized, targets, params)
    plan = targets.join(edges.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").select(
        F.col("source").alias(mine := free_name(docs, "mix_source")),
        F.struct("source_size", "target", "copies", "edge", "last").alias(plan_name := free_name(docs, "mix_plan")),
    )
    plan = written(plan, "mix-plan")
    discard(sized, targets)
    h, size = doc_hash(F.col("doc_id"), params), word_count(F.col("text"))
    p = lambda name: F.col(f"{plan_name}.{name}")
    # without an edge the budget takes every document
    again = p("edge").isNull() | (h < p("edge")) | ((h == p("edge")) & p("last"))
    out = docs.join(plan, docs["source"].eqNullSafe(F.col(mine)), "left")
    values = {
        "size": size,
        "source_size": p("source_size"),
        "target": p("target"),
        "taken": size * (p("copies") + F.when(again, 1).otherwise(0)),
    }
    return out.select(*others(docs, *outputs), *(v.cast("double" if n == "target" else "long").alias(n) for n, v in values.items()))
