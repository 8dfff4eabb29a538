"""Line dedup: lines spread over many sites are boilerplate and stay only in their first document.

For every distinct line the sites that show it are counted by HyperLogLog sketches, merged by aggregation.
Where the estimate lies within ``band`` of ``min_sites``, exact distinct counts decide; clearly above, the
sketch does.  A boilerplate line stays in the document with the smallest doc_id that has it and is removed
from all others, so nothing is lost altogether, not even when whole documents were copied.

A line is compared lower-cased with runs of blanks squeezed, by a 96-bit hash (64 of xxHash, 32 of Murmur3).  The
keys of all lines are written once; sketches, exact counts and removals are computed from them, not from the texts.

A hot line may stand in a third of all rows: sketches and distinct counts are combined before the shuffle,
and both sides of each join are shuffled tables, which adaptive execution can split.  Removals are gathered for each
distinct (doc_id, text), so that a list is never longer than one text has lines, whatever repeats or is null.

Defined cases: null text has no lines and stays null; null sites count as one site of their own; lines under
``min_words`` words never count as boilerplate; rows repeating a doc_id share its fate; rows with a null
doc_id are never first unless no other has the line, and lose boilerplate others have; a document without any
remaining word is ``emptied``; texts are used whole, in time linear in their lines; empty tables give empty results;
extra columns pass through, but those named like an output are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceline.llm.common import discard, free_name, let, others, written


@dataclass(frozen=True)
class LineParams:
    min_sites: int = 3
    min_words: int = 3
    lg_k: int = 10
    band: float = 0.34


def _norm(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), r"[\x20\x09-\x0D]+", " "))


def _key(line: Column) -> Column:
    """Null for lines that can never be boilerplate; the number of words is that of blanks between them."""
    return F.struct(F.xxhash64(line).alias("a"), F.hash(line).alias("b"))


def line_keys(text: Column, params: LineParams) -> Column:
    """The keys of the lines of a text, in order; null at lines that are too short."""
    norms = F.transform(F.split(text, "\n"), _norm)
    return F.transform(
        # normalised, a line of n words has n - 1 blanks
        norms, lambda x: F.when(x.like("%" + " %" * (params.min_words - 1)), _key(x))
    )


def keyed_lines(docs: DataFrame, site: str, params: LineParams) -> DataFrame:
    """doc_id, t and u (hashes of the text), site and the line keys of every text that has any."""
    keys = line_keys(F.col("text"), params)
    rows = docs.select(
        "doc_id",
        F.xxhash64("text").alias("t"),
        F.hash("text").alias("u"),
        F.coalesce(F.col(site).cast("string"), F.lit("\0")).alias("site"),
        keys.alias("keys"),
    )
    return written(rows.filter(F.exists("keys", lambda k: k.isNotNull())), "line-keys")


def _spread(keyed: DataFrame, params: LineParams) -> DataFrame:
    lines = (
        keyed.select("doc_id", "site", F.explode(F.array_distinct("keys")).alias("key"))
        .filter("key is not null")
        .select("key.a", "key.b", "doc_id", "site")
    )
    low, high = params.min_sites * (1 - params.band), params.min_sites * (1 + params.band)
    sketched = lines.groupBy("a", "b").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(params.lg_k))).alias("n_sites"),
        F.min("doc_id").alias("first_doc"),
    )
    spread = written(sketched.filter(F.col("n_sites") >= low), "line-spread")
    near = spread.filter(F.col("n_sites") <= high)
    exact = (
        lines.join(near.select("a", "b"), ["a", "b"], "left_semi")
        .groupBy("a", "b", "site")
        .agg(F.lit(1))
        .groupBy("a", "b")
        .agg(F.count("*").alias("n_exact"))
    )
    return spread.join(exact, ["a", "b"], "left").select(
        "a", "b", F.coalesce("n_exact", "n_sites").alias("n_sites"), F.col("n_exact").isNotNull().alias("exact"), "first_doc"
    )


def site_spread(docs: DataFrame, site: str, params: LineParams = LineParams()) -> DataFrame:
    """Lines at or near ``min_sites``: key (a, b), n_sites (estimated or exact), exact, first_doc."""
    return _spread(keyed_lines(docs, site, params), params)


def _removals(docs: DataFrame, site: str, params: LineParams) -> DataFrame:
    """doc_id, t, u and the ascending places (from 0) of the lines that go."""
    keyed = keyed_lines(docs, site, params)
    boilerplate = written(
        _spread(keyed, params).filter(F.col("n_sites") >= params.min_sites).select("a", "b", "first_doc"), "boilerplate"
    )
    lines = keyed.select("doc_id", "t", "u", F.posexplode("keys").alias("place", "key")).filter("key is not null")
    gone = written(
        lines.select("key.a", "key.b", "doc_id", "t", "u", "place")
        .join(boilerplate, ["a", "b"])
        .filter(~F.col("doc_id").eqNullSafe(F.col("first_doc")))
        .groupBy("doc_id", "t", "u")
        .agg(F.array_sort(F.collect_set("place")).alias("gone")),  # at most the lines of one text
        "line-removals",
    )
    discard(keyed, boilerplate)
    return gone


def dedup_lines(docs: DataFrame, site: str = "source", params: LineParams = LineParams()) -> DataFrame:
    """``docs`` with boilerplate removed from ``text``, and n_lines, n_removed, emptied."""
    doc, t, u, places, found = (free_name(docs, n) for n in ("gone_doc", "gone_t", "gone_u", "gone_places", "rejoined"))
    gone = _removals(docs, site, params).toDF(doc, t, u, places)
    same = F.col("doc_id").eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(t)) & (F.hash("text") == F.col(u))
    joined = docs.join(gone, same, "left")

    def rejoined(lines: Column) -> Column:
        """The stretches between the places that go, joined again."""
        starts = F.concat(F.array(F.lit(0)), F.transform(F.col(places), lambda p: p + 1))
        ends = F.concat(F.col(places), F.array(F.size(lines)))
        kept = F.flatten(F.zip_with(starts, ends, lambda a, b: F.slice(lines, a + 1, b - a)))
        return F.array_join(kept, "\n")

    lines = F.split("text", "\n")
    out = joined.withColumn(found, F.when(F.col(places).isNotNull(), let(lines, rejoined)))
    values = {
        "n_lines": F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long"),
        "n_removed": F.when(F.col(places).isNull(), 0).otherwise(F.size(places)).cast("long"),
        "emptied": F.col(places).isNotNull() & ~F.col(found).rlike(r"[^\x20\x09-\x0D]"),
    }
    rest = [F.coalesce(F.col(found), F.col("text")).alias("text") if c == "text" else F.col(c) for c in others(docs, *values)]
    return out.select(*rest, *(F.coalesce(v, F.lit(False)).alias(n) if n == "emptied" else v.alias(n) for n, v in values.items()))
