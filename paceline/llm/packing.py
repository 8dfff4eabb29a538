"""Lexical retrieval packing: windows filled with a seed document and its nearest unused neighbours by BM25.

Documents become token ids once.  Whole windows of a document stand alone; what is left of each, its tail, is packed.  Terms are the token ids of
the *whole* document, so that document frequencies over all documents are one number for each id of the vocabulary, summed by a grouped count and
broadcast, whatever the corpus.

The inverted index is sharded.  A document goes by range to the place of its two heaviest terms, so that documents with a rare term in
common lie side by side; a range is cut into shards of ``shard_tokens`` of tails, and each shard has an index of its own with the
weights of all documents.  In a shard the first unused document seeds a window, the index ranks every unused document of the shard against
the whole seed (equal scores: in the order of the shard), and they fill the window from the best on.  The last is cut where the window
is full, and its rest seeds the next window, so that a document is cut no more often than needed.  The end of a shard is cut
into powers of two, so that nothing is padded.  The index is built anew each time half of its documents are used.

A task holds one shard.  Neighbours in other shards are not asked: a search of every shard for every window would grow with the square of
the corpus.  Copies of one text, however many, lie side by side and spread over as many shards as they need.

Defined cases: null and empty texts are the end id alone; repeated rows and null ids are packed each for itself; very long texts are
windows of their own but for their tail; documents of no shared term fill windows last, in the order of the shard; an empty table
gives an empty result; columns other than id and text are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructType

from paceline.llm.common import written


@dataclass(frozen=True)
class PackParams:
    window: int = 1024  # a power of two
    end: int = 0
    vocabulary: str | None = None  # a file of ranks on every machine; None: byte_bpe_50k.tiktoken of the public tokenizers
    special: tuple[tuple[str, int], ...] = (("<|endoftext|>", 50256),)  # strings that are one token in a text
    k1: float = 1.2
    b: float = 0.75
    shard_tokens: int = 1 << 19


def encoder(params: PackParams):  # noqa: ANN201
    """A function from text to an array of ids: those of ``tokenizers`` with the same vocabulary, at a quarter of its CPU time."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(params.vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    known = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=dict(params.special))
    return lambda text: known.encode_to_numpy(text, allowed_special="all", disallowed_special=())


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _terms(ids: np.ndarray) -> np.ndarray:
    """Distinct ids and their counts, one after the other."""
    return np.concatenate(np.unique(ids, return_counts=True)).astype("<u4")


def tokenised(docs: DataFrame, params: PackParams = PackParams(), keep_ids: bool = True, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, tokens, whole (ids of whole windows), crcs (of those), tail (ids) and terms (of documents longer than a window); binary, of unsigned
    32-bit numbers.  A row without tail for each task has in its terms the ids of the task's documents and the number of documents with each."""
    schema = StructType([docs.schema[doc_id]]).add("tokens", LongType()).add("whole", "binary").add("crcs", ArrayType(LongType())).add("tail", "binary").add("terms", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, found = encoder(params), np.zeros(0, dtype=np.int64)
        id_type = None
        for batch in batches:
            id_type = batch.schema.field(0).type
            for start in range(0, batch.num_rows, 256):
                some = batch.slice(start, 256)
                n, whole, crcs, tails, terms = [], [], [], [], []
                for value in some.column(1):
                    ids = np.append(encode(value.as_py() or ""), params.end).astype("<u4")
                    cut = len(ids) - len(ids) % params.window
                    n.append(len(ids))
                    whole.append(ids[:cut].tobytes() if keep_ids else None)
                    crcs.append([crc(w) for w in ids[:cut].reshape(-1, params.window)])
                    tails.append(ids[cut:].tobytes())
                    distinct = _terms(ids)
                    terms.append(distinct.tobytes() if cut else None)
                    distinct = distinct[: len(distinct) // 2]
                    if distinct[-1] >= len(found):
                        found = np.append(found, np.zeros(int(distinct[-1]) + 1 - len(found), dtype=np.int64))
                    found[distinct] += 1
                columns = [pa.array(n, pa.int64()), pa.array(whole, pa.binary()), pa.array(crcs, pa.list_(pa.int64())), pa.array(tails, pa.binary()), pa.array(terms, pa.binary())]
                yield pa.RecordBatch.from_arrays([some.column(0), *columns], names=schema.names)
        if id_type is not None:
            at = np.flatnonzero(found)
            columns = [pa.array([None], t) for t in (id_type, pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([np.concatenate([at, found[at]]).astype("<u4").tobytes()], pa.binary())], names=schema.names)

    return docs.select(doc_id, text).mapInArrow(run, schema)


def _own_terms(tail: bytes, terms: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(terms, "<u4") if terms is not None else _terms(np.frombuffer(tail, "<u4"))
    return both[: len(both) // 2].astype(np.int64), both[len(both) // 2 :].astype(np.float64)


def document_frequencies(tokens: DataFrame) -> np.ndarray:
    """The number of documents with each id, up to the largest id, from the rows that tasks left."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(0):
                both = np.frombuffer(value.as_py(), "<u4").astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(both[: len(both) // 2]), pa.array(both[len(both) // 2 :])], names=["id", "n"])

    per = tokens.filter("tail is null").select("terms").mapInArrow(rows, "id long, n long")
    got = per.groupBy("id").agg(F.sum("n").alias("n")).toArrow()  # the vocabulary at most
    ids = got["id"].to_numpy()
    out = np.zeros(int(ids.max(initial=-1)) + 1, dtype=np.int64)
    out[ids] = got["n"].to_numpy()
    return out


def bm25(tf: np.ndarray, n_tokens: float, mean_tokens: float, params: PackParams) -> np.ndarray:
    """What a term adds to a document's score, for each unit of the term's idf."""
    return tf * (params.k1 + 1) / (tf + params.k1 * (1 - params.b + params.b * n_tokens / mean_tokens))


class Index:
    """An inverted index of some documents: postings by term, as columns of a matrix for terms of every sixteenth document or more."""

    def __init__(self, docs: list[int], terms: list[np.ndarray], weights: list[np.ndarray]) -> None:
        self.docs = np.array(docs)
        flat = np.concatenate([terms[i] for i in docs])
        order = np.argsort(flat, kind="stable")
        self.owner = np.repeat(np.arange(len(docs)), [len(terms[i]) for i in docs])[order]
        self.weight = np.concatenate([weights[i] for i in docs])[order]
        self.known, first, self.n = np.unique(flat[order], return_index=True, return_counts=True)
        self.first, common = first, self.n >= max(8, len(docs) / 16)
        self.column = np.where(common, np.cumsum(common) - 1, -1)
        self.matrix = np.zeros((len(docs), int(common.sum())), dtype=np.float32)
        at = np.repeat(self.column, self.n)
        self.matrix[self.owner[at >= 0], at[at >= 0]] = self.weight[at >= 0]

    def scores(self, terms: np.ndarray) -> np.ndarray:
        """The score of each document of the index for a query of these distinct terms."""
        at = np.minimum(np.searchsorted(self.known, terms), len(self.known) - 1)
        at = at[self.known[at] == terms]
        asked = np.zeros(self.matrix.shape[1], dtype=np.float32)
        asked[self.column[at][self.column[at] >= 0]] = 1.0
        at = at[self.column[at] < 0]
        lo, n = self.first[at], self.n[at]
        postings = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return self.matrix @ asked + np.bincount(self.owner[postings], self.weight[postings], len(self.docs))


def pack_shard(sizes: list[int], terms: list[np.ndarray], weights: list[np.ndarray], window: int) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences of (document, start in its tail, length) that hold every token of the tails once."""
    used, starts = np.zeros(len(sizes), dtype=bool), [0] * len(sizes)
    index, left, seed, following = None, len(sizes), None, 0
    while left:
        if index is None or 2 * left < len(index.docs):
            index = Index(np.flatnonzero(~used).tolist(), terms, weights)
        if seed is None:
            while used[following]:
                following += 1
            seed = following
        length = min(window, sizes[seed] - starts[seed])
        pieces, room = [(seed, starts[seed], length)], window - length
        used[seed], left, query, seed = True, left - 1, seed, None
        if room and left:
            found = np.where(used[index.docs], -np.inf, index.scores(terms[query]))
            for top in (32, len(found)):  # nearly always the first few fill the window
                best = np.argpartition(-found, top - 1)[:top] if top < len(found) else np.arange(len(found))
                edge = found[best].min()
                best = np.flatnonzero(found >= edge) if np.isfinite(edge) else np.flatnonzero(np.isfinite(found))
                for j in index.docs[best[np.argsort(-found[best], kind="stable")]].tolist():
                    if not room:
                        break
                    if used[j]:
                        continue
                    length = min(room, sizes[j] - starts[j])
                    pieces.append((j, starts[j], length))
                    room -= length
                    if length < sizes[j] - starts[j]:
                        starts[j], seed = starts[j] + length, j
                    else:
                        used[j], left = True, left - 1
                if not room or not left:
                    break
        if room:
            yield from _powers(pieces, window)
        else:
            yield pieces


def _powers(pieces: list[tuple[int, int, int]], window: int) -> Iterator[list[tuple[int, int, int]]]:
    """The pieces dealt anew to sequences whose lengths are powers of two."""
    total, pieces = sum(n for *_, n in pieces), list(pieces)
    size = window
    while size:
        if total & size:
            out, room = [], size
            while room:
                doc, start, n = pieces.pop(0)
                out.append((doc, start, min(n, room)))
                if n > room:
                    pieces.insert(0, (doc, start + room, n - room))
                room -= out[-1][2]
            yield out
        size >>= 1


def pack(docs: DataFrame, params: PackParams = PackParams(), keep_ids: bool = True, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, unless not wanted, ids: a row for each piece."""
    spark = docs.sparkSession
    made = written(tokenised(docs, params, keep_ids, doc_id, text), "pack-tokens")
    tokens = made.filter("tail is not null")
    n, total, in_tails = tokens.agg(F.count("*"), F.sum("tokens"), F.sum(F.octet_length("tail") / 4)).first()
    frequency = document_frequencies(made)
    idf = np.log(1 + (n - frequency + 0.5) / (frequency + 0.5))
    shared, mean = spark.sparkContext.broadcast(np.where(frequency > 0, idf, 0.0)), (total or 1) / max(n, 1)  # a number for each id of the vocabulary
    common = spark.sparkContext.broadcast(frequency > 1)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heavy = np.zeros((2, batch.num_rows), dtype=np.int64)
            for i, (size, tail, terms) in enumerate(zip(batch.column("tokens"), batch.column("tail"), batch.column("terms"), strict=True)):
                ids, tf = _own_terms(tail.as_py(), terms.as_py())
                weight = np.where(common.value[ids], bm25(tf, size.as_py(), mean, params) * shared.value[ids], -1.0)
                heavy[0, i] = ids[best := weight.argmax()]
                weight[best] = -2.0
                heavy[1, i] = ids[weight.argmax()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(heavy[0]), pa.array(heavy[1])], names=[*batch.schema.names, "first", "second"])

    schema = StructType(list(tokens.schema.fields)).add("first", LongType()).add("second", LongType())
    order = ["first", "second", F.xxhash64(doc_id), "tokens", "row"]
    keyed = tokens.mapInArrow(keys, schema).withColumn("row", F.monotonically_increasing_id())
    shards = max(1, -(-int(in_tails or 0) // params.shard_tokens))
    dealt = keyed.repartitionByRange(shards, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id().cast("long")).drop("first", "second", "row")
    out = StructType([docs.schema[doc_id]])
    for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"):
        out = out.add(c, LongType())
    if keep_ids:
        out = out.add("ids", ArrayType(IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = 0
        held: list[dict] = []
        tokens_held = 0

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal sequence
            rows: list[tuple] = []
            for r in held:
                for k, value in enumerate(r["crcs"]):
                    ids = np.frombuffer(r["whole"], "<u4", params.window, 4 * params.window * k) if keep_ids else None
                    rows.append((r[doc_id], k * params.window, params.window, value, r["tokens"], (r["part"] << 32) + sequence, 0, ids))
                    sequence += 1
            with_tail = [r for r in held if r["tail"]]
            tails = [np.frombuffer(r["tail"], "<u4") for r in with_tail]
            own = [_own_terms(r["tail"], r["terms"]) for r in with_tail]
            weights = [bm25(tf, r["tokens"], mean, params) * shared.value[ids] for r, (ids, tf) in zip(with_tail, own, strict=True)]
            for pieces in pack_shard([len(t) for t in tails], [ids for ids, _ in own], weights, params.window):
                offset = 0
                for i, start, length in pieces:
                    r, ids = with_tail[i], tails[i][start : start + length]
                    rows.append((r[doc_id], r["tokens"] - len(tails[i]) + start, length, crc(ids), r["tokens"], (r["part"] << 32) + sequence, offset, ids))
                    offset += length
                sequence += 1
            for at in range(0, len(rows), 4096):
                columns = list(zip(*rows[at : at + 4096], strict=True))[: len(out)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(columns, types, strict=True)], names=out.names)

        types = None
        for batch in batches:
            types = types or [batch.schema.field(doc_id).type, *[pa.int64()] * 6, *[pa.list_(pa.int32())] * keep_ids]
            for start in range(0, batch.num_rows, 256):
                for r in batch.slice(start, 256).to_pylist():
                    held.append(r)
                    tokens_held += len(r["tail"]) // 4 + len(r["whole"] or b"") // 32
                    if tokens_held >= params.shard_tokens:
                        yield from packed()
                        held.clear()
                        tokens_held = 0
        if held:
            yield from packed()

    return dealt.mapInArrow(run, out)
