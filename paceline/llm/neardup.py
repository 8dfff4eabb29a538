"""Near-duplicate documents by bottom-k sketches from one hash function, confirmed on full shingle sets.

1. Every text becomes its set of distinct 5-word shingles, hashed to 64 bits; its ``index`` smallest hashes are its
   sketch.  Equal sets (compared by size and a 128-bit digest) form one class, so that copies are never paired; a class is
   represented by the text of its smallest doc_id.
2. Inverted lists over retained values give candidates.  Two sets of Jaccard similarity >= ``similarity`` share
   at least ``share`` of their ``index`` smallest hashes, so in any common order of values they share one of the
   first index - share * index + 1.  Values are ordered rarest first by their exact counts over all classes, which
   keeps widespread passages out of the lists, and classes with too many values of their own out of all.
3. Lists are not expanded into pairs.  First every list pairs its members with one leader, that in most lists;
   confirmed pairs merge components, and only members that are then still in different components of a list and
   close enough in size are paired.
4. Union sketches of ``k`` values estimate the similarity of pairs, those below ``floor`` go, and the rest is decided
   on the full sets.  Confirmed links are merged to components by label propagation with pointer jumping.

``share`` and ``floor`` are binomial quantiles at ``miss``: a link at the threshold is lost with at most about that probability
at either place, and a closer one less.

The plan is the same at every size: all joins are between tables, which the optimiser may broadcast by its own
threshold.  Texts are shuffled once for the full sets and once more by ``unique_documents``.

Defined cases: null and wordless texts have empty sets and stand alone; texts of fewer than five words have one
shingle, the whole sequence; very long texts are used whole; rows repeating a doc_id belong to the classes of their texts;
rows with a null doc_id link texts like any others, but name a component only if it has no other rows (its id is null then,
and all its rows are ``kept``); empty tables give empty results; ``components`` carries the doc_id only, ``unique_documents``
all columns.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceline.llm.common import discard, free_name, written

#: Odd multipliers, one for each place in a shingle.
_PLACES = np.array([xxhash.xxh3_64_intdigest(b"place%d" % i) | 1 for i in range(64)], dtype=np.uint64)


@dataclass(frozen=True)
class NearDupParams:
    width: int = 5
    percent: int = 85
    k: int = 128
    index: int = 64
    miss: float = 1e-5
    rounds: int = 3
    block: int = 256

    @property
    def similarity(self) -> float:
        return self.percent / 100

    @property
    def share(self) -> float:
        return self._least(self.index) / self.index

    @property
    def floor(self) -> float:
        return self._least(self.k) / self.k

    def _least(self, n: int) -> int:
        """The number of common values among n that a link at the threshold falls short of with probability ``miss`` at most."""
        below = 0.0
        for c in range(n + 1):
            below += math.comb(n, c) * self.similarity**c * (1 - self.similarity) ** (n - c)
            if below > self.miss:
                return c
        return n


def _mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Shingler:
    """Sorted distinct shingle hashes of texts; keeps the hashes of words it has seen, a bounded number."""

    def __init__(self, width: int, limit: int = 200_000) -> None:
        self.width, self.limit, self.seen = width, limit, {}

    def __call__(self, text: bytes | None) -> np.ndarray:
        words = text.lower().split() if text else []  # bytes: A-Z only, and just the six blanks
        if not words:
            return np.empty(0, dtype=np.uint64)
        seen = self.seen
        new = {w for w in words if w not in seen}
        if new:
            if len(seen) + len(new) > self.limit:
                seen.clear()
                new = set(words)
            for w in new:
                seen[w] = xxhash.xxh3_64_intdigest(w)
        hashes = np.fromiter(map(seen.__getitem__, words), dtype=np.uint64, count=len(words))
        width = min(self.width, len(words))
        n = len(words) - width + 1
        total = np.full(n, width, dtype=np.uint64)
        for place in range(width):
            total += _mix(hashes[place : place + n] * _PLACES[place]) * _PLACES[place + 32]
        return np.unique(_mix(total))


def _lists(values: list[np.ndarray]) -> pa.Array:
    """An Arrow list<int64> array from uint64 arrays."""
    ends = np.cumsum([0, *(len(v) for v in values)], dtype=np.int32)
    flat = np.concatenate(values).view(np.int64) if values else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))


def _rows(column: pa.Array) -> list[np.ndarray]:
    """The uint64 arrays of an Arrow list<int64> array without nulls."""
    flat = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    ends = column.offsets.to_numpy()
    ends = ends - ends[0]
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _sets(docs: DataFrame, params: NearDupParams, limit: int | None) -> DataFrame:
    """The columns of ``docs`` but text; n, a, b (size and digest of the set) and v: its ``limit`` smallest hashes, ascending
    as unsigned."""
    carried = [c for c in docs.columns if c != "text"]
    fields = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in carried)
    width = params.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(width)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                values = [shingle(t) for t in part.column("text").to_pylist()]
                digests = [
                    np.array([_mix(v ^ np.uint64(s)).sum(dtype=np.uint64) for v in values], np.uint64).view(np.int64)
                    for s in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(c) for c in carried),
                        pa.array([len(v) for v in values], pa.int64()),
                        *(pa.array(d, pa.int64()) for d in digests),
                        _lists([v[:limit] for v in values]),
                    ],
                    names=[*carried, "n", "a", "b", "v"],
                )

    rows = docs.select(*carried, F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"{fields}, n long, a long, b long, v array<long>")


def _postings(classes: DataFrame, params: NearDupParams) -> DataFrame:
    """node, n, key, first: for every class the retained values in whose lists it stands, rarest first.

    A class with too many values that no other class retains can have no link; it leaves, others then lose what
    they shared with it, and so on for ``rounds`` rounds.  ``first`` marks those that suffice while
    the class is the smaller of a pair: with no larger partner cut short, it shares 2 s / (1 + s) of its own values,
    s the similarity.
    """
    rows = classes.select("node", "n", F.size("v").alias("s"), F.explode("v").alias("key"))
    # sets so small that no partner's sketch is cut short must share the exact number
    whole = F.col("s") * 100 < params.percent * params.index
    need = F.when(whole, F.ceil(F.col("s") * params.percent / 100)).otherwise(F.floor(F.col("s") * params.share))
    less = F.when(whole, F.ceil(F.col("s") * 2 * params.percent / (100 + params.percent))).otherwise(need)
    before = None
    for turn in range(params.rounds):
        counts = written(rows.groupBy("key").agg(F.count("*").alias("df")).filter("df > 1"), "shared-values")
        values = rows.join(counts, "key").groupBy("node", "n", "s").agg(F.array_sort(F.collect_list(F.struct("df", "key"))).alias("by"))
        values = written(values.filter(F.size("by") >= need), "sharing-classes")  # at most ``index`` values each
        discard(counts, *([before] if before else []))
        before = values
        if turn + 1 < params.rounds:
            rows = values.select("node", "n", "s", F.explode("by.key").alias("key"))
    alone = F.col("s") - F.size("by")
    keys = F.slice("by.key", 1, (F.col("s") - need + 1 - alone).cast("int"))
    listed = values.select("node", "n", alone.alias("alone"), (F.col("s") - less + 1).alias("short"), F.posexplode(keys).alias("pos", "key"))
    postings = written(listed.select("node", "n", "key", (F.col("alone") + F.col("pos") < F.col("short")).alias("first")), "postings")
    discard(values)
    return postings


def _compare(pairs: DataFrame, sets: DataFrame, params: NearDupParams, exact: bool) -> DataFrame:
    """The pairs (x, y) whose sets are similar enough, by estimate or exactly.

    Pairs come together by x, in blocks of about ``block`` so that no x gathers its partners in one task; a task
    holds the array of one x at a time.
    """
    arrays = sets if exact else sets.select("node", "n", F.slice("v", 1, params.k).alias("v"))
    degree = pairs.groupBy("x").agg(F.count("*").alias("deg")).filter(F.col("deg") > params.block)
    blocks = pairs.join(degree, "x", "left").select(
        "x",
        "y",
        F.coalesce(F.pmod(F.xxhash64("y"), F.ceil(F.col("deg") / params.block)), F.lit(0)).cast("int").alias("block"),
    )
    heads = blocks.select("x", "block").distinct().join(arrays.select(F.col("node").alias("x"), "n", "v"), "x")
    tails = blocks.join(arrays.select(F.col("node").alias("y"), "n", "v"), "y")
    both = heads.select("x", "block", F.lit(None).cast("long").alias("y"), "n", "v").unionByName(
        tails.select("x", "block", "y", "n", "v")
    )
    parts = both.repartition("x", "block").sortWithinPartitions("x", "block", F.col("y").asc_nulls_first())
    percent, k, floor = params.percent, params.k, params.floor

    def similar(p: np.ndarray, q: np.ndarray, n: int, m: int) -> bool:
        if 100 * min(n, m) < percent * max(n, m):
            return False
        common = np.intersect1d(p, q, assume_unique=True)
        if exact:
            return 100 * len(common) >= percent * (len(p) + len(q) - len(common))
        union = np.union1d(p, q)[:k]
        return len(np.intersect1d(union, common, assume_unique=True)) >= floor * len(union)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, head = None, None
        for batch in batches:
            found = []
            cols = [batch.column(c).to_pylist() for c in ("x", "block", "y", "n")]
            for x, block, y, n, v in zip(*cols, _rows(batch.column("v")), strict=True):
                if y is None:
                    at, head = (x, block), (v.copy(), n)
                elif at == (x, block) and similar(head[0], v, head[1], n):
                    found.append((x, y))
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], names=["x", "y"]
            )

    return parts.mapInArrow(run, "x long, y long")


def connected(edges: DataFrame) -> DataFrame:
    """node, comp (smallest node reachable) for every node of the edges (x, y)."""
    both = written(
        edges.select("x", "y").union(edges.select("y", "x")).toDF("node", "other").distinct(), "links"
    )
    labels = written(
        both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("comp")), "labels"
    )
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), F.col("comp").alias("c")), "other")
        least = near.groupBy("node").agg(F.min("c").alias("c"))
        lower = written(
            labels.join(least, "node").select("node", F.least("comp", "c").alias("comp"), F.col("comp").alias("old")), "labels"
        )
        jump = lower.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
        new = written(
            lower.join(jump, "comp", "left").select("node", F.coalesce("up", "comp").alias("comp"), "old"), "labels"
        )
        discard(labels, lower)
        labels = new
        if new.filter("comp <> old").isEmpty():
            discard(both)
            return new


def _confirm(pairs: DataFrame, sets: DataFrame, params: NearDupParams) -> DataFrame:
    pairs = written(pairs.distinct(), "candidates")
    likely = written(_compare(pairs, sets, params, exact=False), "likely")
    confirmed = written(_compare(likely, sets, params, exact=True), "confirmed")
    discard(pairs, likely)
    return confirmed


def _common(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, n, common: of how many values of its set some other of the nodes has too."""
    some = sets.join(nodes, "node", "left_semi")
    values = some.select("node", F.explode("v").alias("value"))
    alone = values.groupBy("value").agg(F.count("*").alias("df"), F.min("node").alias("node")).filter("df = 1")
    alone = alone.groupBy("node").agg(F.count("*").alias("alone"))
    common = F.col("n") - F.coalesce("alone", F.lit(0))
    return written(some.select("node", "n").join(alone, "node", "left").select("node", "n", common.alias("common")), "common")


def _possible(params: NearDupParams) -> Column:
    """Whether (x, m, u, c, firsts) and a not smaller (node, n, common, comp, keys) of one list may be an unconfirmed link.

    Of the lists that have both, only that of the smallest key says so.

    Their overlap is at most what either has in common with any class in open lists, so copies that were edited
    too far from all others are not paired with each of them.
    """
    smaller = (F.col("m") < F.col("n")) | ((F.col("m") == F.col("n")) & (F.col("x") < F.col("node")))
    sizes = 100 * F.col("m") >= params.percent * F.col("n")
    need = params.percent * (F.col("m") + F.col("n"))
    once = F.col("key") == F.array_min(F.array_intersect("firsts", "keys"))
    return smaller & (F.col("c") != F.col("comp")) & sizes & ((100 + params.percent) * F.least("u", "common") >= need) & once


def _members(docs: DataFrame, params: NearDupParams, *carried: Column) -> DataFrame:
    """doc_id, t (hash of the text), what is carried, and the sketch of each row."""
    return written(_sets(docs.select("doc_id", F.xxhash64("text").alias("t"), *carried, "text"), params, params.index), "sketches")


def _classes(members: DataFrame) -> DataFrame:
    """node (an id of its own, in the order of rep), n, a, b, v, and rep (unnamed, doc_id, t): the row that stands for the class.

    Originals mostly have smaller doc_ids than their copies; with ids in that order, ties between leaders go to originals.
    """
    rep = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "t")
    found = members.filter("n > 0").groupBy("n", "a", "b").agg(F.min(rep).alias("rep"), F.first("v").alias("v"))
    # ids are drawn while the table is written and never again
    ordered = found.repartitionByRange("rep").sortWithinPartitions("rep")
    return written(ordered.withColumn("node", F.monotonically_increasing_id()), "classes")


def _full_sets(docs: DataFrame, classes: DataFrame, nodes: DataFrame, params: NearDupParams) -> DataFrame:
    """node, n, v (the whole set) of some classes."""
    reps = classes.join(nodes, "node", "left_semi").select("node", F.col("rep.doc_id").alias("rep_id"), F.col("rep.t").alias("rep_t"))
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("t"))
    texts = texts.join(reps, F.col("doc_id").eqNullSafe(F.col("rep_id")) & (F.col("t") == F.col("rep_t")))
    # one of the rows that are equal; they are combined before the shuffle
    texts = texts.groupBy("node").agg(F.first("text").alias("text"))
    return written(_sets(texts, params, None).select("node", "n", "v"), "sets")


def class_links(docs: DataFrame, classes: DataFrame, params: NearDupParams = NearDupParams()) -> DataFrame:
    """node, comp: the component of each class that is linked to another."""
    postings = _postings(classes, params)
    shared = postings.groupBy("key").agg(F.count("*").alias("many")).filter("many > 1")
    lists = written(postings.join(shared, "key", "left_semi"), "lists")
    discard(postings)
    # edits give a copy values of its own, which take places among its rarest; the original stands in most lists
    met = lists.groupBy("node").agg(F.count("*").alias("met"))
    heads = lists.join(met, "node").groupBy("key").agg(F.min(F.struct(-F.col("met"), "n", "node")).alias("head"))
    heads = written(heads.select("key", F.col("head.node").alias("x")), "heads")
    first = lists.join(heads, "key").filter("node <> x").select("x", F.col("node").alias("y"))
    sets = _full_sets(docs, classes, lists.select("node").distinct(), params)
    edges = _confirm(first, sets, params)
    labels = connected(edges)
    placed = lists.join(labels, "node", "left").select(
        "key", "node", "n", "first", F.coalesce("comp", "node").alias("comp")
    )
    placed = written(placed, "placed")
    mixed = placed.groupBy("key").agg(F.min("comp").alias("p"), F.max("comp").alias("q")).filter("p <> q").select("key")
    spread = written(placed.join(mixed, "key", "left_semi"), "mixed-lists")
    discard(lists, heads, placed)
    nodes, before = spread.select("node").distinct(), None
    for _ in range(params.rounds):
        # who leaves takes along what others had in common with it only
        shares = _common(sets, nodes)
        common = shares.filter(100 * F.col("common") >= params.percent * F.col("n"))
        nodes = common.select("node")
        if before:
            discard(before)
        before = shares
    near = spread.drop("n").join(common, "node")
    held = near.groupBy("node").agg(F.collect_set("key").alias("keys"), F.collect_set(F.when(F.col("first"), F.col("key"))).alias("firsts"))
    opened = written(near.join(held, "node"), "open-lists")  # at most ``index`` keys a class
    discard(spread, shares)
    left = opened.filter("first").select(
        "key", "firsts", F.col("node").alias("x"), F.col("n").alias("m"), F.col("common").alias("u"), F.col("comp").alias("c")
    )
    more = _confirm(left.join(opened.drop("firsts", "first"), "key").filter(_possible(params)).select("x", F.col("node").alias("y")), sets, params)
    discard(sets, opened)
    if not more.isEmpty():
        old, labels = labels, connected(edges.union(more))
        discard(old)
    discard(edges, more)
    return labels


def _placed(docs: DataFrame, params: NearDupParams, *carried: Column) -> tuple[DataFrame, DataFrame]:
    """(members, n a b comp first of each class): comp names the component, first is its smallest doc_id."""
    members = _members(docs, params, *carried)
    classes = _classes(members)
    labels = class_links(docs, classes, params)
    named = classes.join(labels, "node", "left").select("n", "a", "b", "rep", F.coalesce("comp", "node").alias("comp"))
    named = written(named, "class-components")
    firsts = named.groupBy("comp").agg(F.min("rep").alias("least")).select("comp", F.col("least.doc_id").alias("first"))
    out = written(named.drop("rep").join(firsts, "comp"), "components")
    discard(classes, labels, named)
    return members, out


def components(docs: DataFrame, params: NearDupParams = NearDupParams()) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (doc_id = component_id) for each row of ``docs``."""
    members, named = _placed(docs.select("doc_id", "text"), params)
    found = members.select("doc_id", "n", "a", "b").join(named, ["n", "a", "b"], "left")
    of = F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("first"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), of.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )


def unique_documents(docs: DataFrame, params: NearDupParams = NearDupParams()) -> DataFrame:
    """One row of each component, that of the smallest doc_id; all columns as they were.

    Rows are told apart by a 96-bit hash of all their columns, so that of rows equal in all one stays; wordless rows stand alone
    and stay, equal ones once.
    """
    plain = [F.col(f.name).cast("string") if "map<" in f.dataType.simpleString() else F.col(f.name) for f in docs.schema]
    r, s = free_name(docs, "row_r"), free_name(docs, "row_s")
    row = F.xxhash64(*plain).alias(r), F.hash(*plain).alias(s)
    members, named = _placed(docs, params, *row)
    kept = members.select("doc_id", "n", "a", "b", r, s).join(named, ["n", "a", "b"], "left")
    best = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", r, s)).alias("best")
    winners = kept.filter("comp is not null").groupBy("comp").agg(best).select(f"best.{r}", f"best.{s}")
    winners = written(winners.union(kept.filter("comp is null").select(r, s).distinct()), "unique-rows")
    discard(members, named)
    # equal rows are combined before the shuffle; the semi-join then finds them where they are
    return docs.select("*", *row).dropDuplicates([r, s]).join(winners, [r, s], "left_semi").select(*docs.columns)
