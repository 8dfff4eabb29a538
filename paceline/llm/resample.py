"""Importance resampling towards a target distribution, by a dictionary of distinct features.

Features are runs of one and two alphanumeric words.  A batch of documents numbers its words, sorts its pairs of numbers, and gives each distinct
feature of the batch with its count.  Features with one first word share a line, which names that word once; lines are dealt to ``parts`` by
first word and a salt from the second, so that pairs after a very common word spread over ``salts`` parts, and each batch sends one text for each part.
A grouped count makes the dictionary: every distinct string of the corpus once, with its count.  Each is hashed there, once; counts by
bucket give the gains.

The gains (one number for each bucket, whatever the corpus) then go back to the documents' feature counts: a batch looks up the bucket of each of
its own distinct strings and adds up its documents' gains.  A join by string instead would shuffle every pair of a document and a feature, about
400 million for a GB of Parquet, for the same sums.

The draw is by Gumbel noise from the document's id: the highest ``share`` per cent of weight plus noise, among documents of ``min_words`` and
more.  Ranks are places within parts dealt by range of score, and the rows of the parts before; no row is sorted in one task.

Defined cases: null and wordless texts have no features and weight 0, and are not drawn unless ``min_words`` is 0; null ids hash as the empty
string and come last among ties; equal ids and scores follow the order of n_features, rows equal in all of these may change places; very
long texts count whole; an empty corpus gives an empty result, an empty target has T = 0; extra columns pass through unless named
like an output.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from paceline.llm.common import alnum_words, discard, free_name, others, written


@dataclass(frozen=True)
class ResampleParams:
    buckets: int = 10_000
    min_words: int = 20
    share: int = 25  # per cent of the eligible documents
    seed: str = "7"
    parts: int = 1 << 14  # of the dictionary; at least as many as tasks that count it
    salts: int = 16
    words: int = 1 << 20  # of documents that are worked on together


class Batch:
    """Words of some documents as numbers, and their distinct pairs."""

    def __init__(self) -> None:
        self.known, self.ids, self.sizes = {}, [], []

    def add(self, text: bytes | None) -> None:
        known, words = self.known, alnum_words(text)
        self.ids += [known.setdefault(w, len(known)) for w in words]
        self.sizes.append(len(words))

    def arrays(self) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """(words, number of each word of the text, its document, places with a next word in the same document)."""
        doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        return list(self.known), np.array(self.ids, dtype=np.int64), doc, np.flatnonzero(doc[1:] == doc[:-1])


def _lines(batch: Batch, params: ResampleParams) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Some parts, and the lines of each as one text: a first word (none for single words), then what follows it, with counts over one."""
    words, ids, _, inside = batch.arrays()
    n, strings = max(1, len(words)), pa.array(words, pa.string())
    crc = np.array([zlib.crc32(w) for w in words], dtype=np.int64)

    def rows(part: np.ndarray, prefix: pa.Array, starts: np.ndarray, follow: np.ndarray, counts: np.ndarray) -> tuple[pa.Array, pa.Array]:
        """``starts``: where a line begins among the words that follow; lines of a part stand together."""
        some = strings.take(pa.array(follow))
        some = pc.if_else(pa.array(counts == 1), some, pc.binary_join_element_wise(some, pa.array(counts).cast(pa.string()), "\t"))
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(starts, len(follow)), pa.int32()), some), " ")
        lines = pc.binary_join_element_wise(prefix, joined, " ")
        first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        return pa.array(part[first]), pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(first, len(part)), pa.int32()), lines), "\n")

    if not words:
        return
    part = crc % params.parts
    order = np.argsort(part, kind="stable")
    first = np.flatnonzero(np.r_[True, part[order][1:] != part[order][:-1]])
    yield rows(part[order][first], pa.array([""] * len(first)), first, order, np.bincount(ids, minlength=n)[order])
    if not len(inside):
        return
    keys, counts = np.unique(ids[inside] * n + ids[inside + 1], return_counts=True)
    a, b = keys // n, keys % n
    salt = crc[b] % params.salts
    part = (crc[a] // 7 + salt * 7919) % params.parts
    order = np.lexsort((salt, a, part))
    a, b, salt, part, counts = (x[order] for x in (a, b, salt, part, counts))
    starts = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (salt[1:] != salt[:-1])])
    ends = np.append(starts[1:], len(a))
    for lo in range(0, len(starts), 100_000):  # so many lines at once
        hi = min(lo + 100_000, len(starts))
        span = slice(starts[lo], ends[hi - 1])
        yield rows(part[starts[lo:hi]], strings.take(pa.array(a[starts[lo:hi]])), starts[lo:hi] - starts[lo], b[span], counts[span])


def _batches(column: Iterator[pa.Array], params: ResampleParams) -> Iterator[tuple[Batch, int]]:
    """Batches of about so many words, and the number of rows of each."""
    batch, rows = Batch(), 0
    for texts in column:
        for text in texts.cast(pa.binary()):
            batch.add(text.as_py())
            rows += 1
            if len(batch.ids) >= params.words:
                yield batch, rows
                batch, rows = Batch(), 0
    if rows:
        yield batch, rows


def dictionary(texts: DataFrame, params: ResampleParams = ResampleParams(), text: str = "text") -> DataFrame:
    """feature, n and bucket of every distinct feature of all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _ in _batches((b.column(0) for b in batches), params):
            for parts, lines in _lines(batch, params):
                yield pa.RecordBatch.from_arrays([parts, lines], names=["part", "lines"])

    dealt = texts.select(text).mapInArrow(count, "part long, lines string").repartition("part")
    lines = dealt.select("part", F.explode(F.split("lines", "\n")).alias("line"))
    begun = lines.select("part", F.substring_index("line", " ", 1).alias("head"), F.expr("substring(line, locate(' ', line) + 1)").alias("rest"))
    one = begun.select("part", "head", F.explode(F.split("rest", " ")).alias("next"))
    n = F.when(F.contains("next", F.lit("\t")), F.substring_index("next", "\t", -1).cast("long")).otherwise(1)
    grouped = one.groupBy("part", "head", F.substring_index("next", "\t", 1).alias("word")).agg(F.sum(n).alias("n"))  # dealt well already
    feature = F.when(F.col("head") == "", F.col("word")).otherwise(F.concat_ws(" ", "head", "word"))
    return grouped.select(feature.alias("feature"), "n").withColumn("bucket", bucket(F.col("feature"), params))


def bucket(feature: Column, params: ResampleParams = ResampleParams()) -> Column:
    return (F.crc32(feature) % params.buckets).cast("int")


def bucket_counts(texts: DataFrame, params: ResampleParams = ResampleParams(), text: str = "text") -> np.ndarray:
    """The number of features in each bucket."""
    rows = dictionary(texts, params, text).groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # a row for each bucket at most
    out = np.zeros(params.buckets, dtype=np.int64)
    out[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) of each bucket."""
    n = len(corpus)
    return np.floor(1000 * np.log((target + 1.0) * float(corpus.sum() + n) / ((corpus + 1.0) * float(target.sum() + n)))).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, params: ResampleParams = ResampleParams(), text: str = "text") -> DataFrame:
    """``docs`` with n_words, n_features and weight (the floored mean gain of the features) in place of the text."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)
    kept = others(docs, "n_words", "n_features", "weight", text)
    schema = StructType([docs.schema[c] for c in kept])
    for c in ("n_words", "n_features", "weight"):
        schema = schema.add(c, LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        carried: list[pa.RecordBatch] = []

        def texts() -> Iterator[pa.Array]:
            for b in batches:
                carried.append(b.select(kept))
                yield b.column(text)

        done = 0  # rows of the first carried batch that were given out
        for batch, rows in _batches(texts(), params):
            words, ids, doc, inside = batch.arrays()
            pairs, which = np.unique(ids[inside] * max(1, len(words)) + ids[inside + 1], return_inverse=True)
            first, second = pairs // max(1, len(words)), pairs % max(1, len(words))
            alone = table[np.array([zlib.crc32(w) % len(table) for w in words], dtype=np.int64)]
            heads = [zlib.crc32(w + b" ") for w in words]
            both = table[np.array([zlib.crc32(words[b], heads[a]) % len(table) for a, b in zip(first.tolist(), second.tolist(), strict=True)], dtype=np.int64)]
            total = np.zeros(rows, dtype=np.int64)
            np.add.at(total, doc, alone[ids])
            np.add.at(total, doc[inside], both[which])
            n = np.array(batch.sizes, dtype=np.int64)
            features = np.maximum(2 * n - 1, 0)
            weight = total // np.maximum(features, 1)  # rounds down
            at = 0
            while at < rows:
                piece = carried[0].slice(done, rows - at)
                span = slice(at, at + piece.num_rows)
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(n[span]), pa.array(features[span]), pa.array(weight[span])], names=[*kept, "n_words", "n_features", "weight"])
                at, done = span.stop, done + piece.num_rows
                if done == carried[0].num_rows:
                    carried.pop(0)
                    done = 0

    return docs.select(*kept, text).mapInArrow(run, schema)


def noise(doc_id: Column, params: ResampleParams = ResampleParams()) -> Column:
    """floor(-1000 ln(-ln((h + 0.5) / 2^32))), h from the SHA-256 of the seed and the id."""
    key = F.concat(F.lit(params.seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def draw(weighed: DataFrame, params: ResampleParams = ResampleParams(), doc_id: str = "doc_id") -> DataFrame:
    """``weighed`` with score and rank (1, 2, ... for the documents drawn, else null)."""
    part, place, before = (free_name(weighed, c) for c in ("part", "place", "rows_before"))
    scored = weighed.withColumn("score", F.col("weight") + noise(F.col(doc_id), params))
    able = F.coalesce(F.col("n_words") >= params.min_words, F.lit(False))
    order = [F.when(able, 0).otherwise(1), F.desc("score"), F.col(doc_id).asc_nulls_last(), F.asc("n_features")]
    dealt = written(scored.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "resample-dealt")
    parts = dealt.groupBy(part).agg(F.count_if(able).alias("n"))
    counted = parts.select(part, F.coalesce(F.sum("n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(before))  # a row a part
    eligible = dealt.filter(able).count()
    placed = dealt.withColumn(place, F.row_number().over(Window.partitionBy(part).orderBy(*order)))
    rank = F.col(before) + F.col(place)
    return placed.join(counted, part).withColumn("rank", F.when(able & (rank <= params.share * eligible // 100), rank).cast("long")).drop(part, place, before)


def resample(docs: DataFrame, target: DataFrame, params: ResampleParams = ResampleParams(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with n_words, n_features, weight, score and rank in place of the text: the draw that looks like ``target``."""
    docs = docs.select(*others(docs, "n_words", "n_features", "weight", "score", "rank"))
    gain = gains(bucket_counts(docs, params, text), bucket_counts(target, params, text))
    weighed = written(weigh(docs, gain, params, text), "resample-weights")
    out = draw(weighed, params, doc_id)
    discard(weighed)
    return out
