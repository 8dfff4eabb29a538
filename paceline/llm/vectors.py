"""Vector code compression: product quantisation with integer codebooks, exact in every step.

A component x becomes floor(scale * x); a vector is cut into equal consecutive parts, each with a codebook that starts as that part of the
vectors of the smallest ids.  A round broadcasts the codebooks (parts x entries integers of a part's length, whatever the number of
vectors), finds for each Arrow batch all squared distances as |c|^2 - 2 x.c (+ |x|^2) by int64 matrix products, takes the first smallest,
and sums the parts of each entry in its task.  The tasks' sums meet in a grouped shuffle of at most parts x entries rows a task, split into
blocks of components; the driver gets one row for each entry and block and divides, rounding down.  Entries nobody chose stay.

Defined cases: vectors that are null or hold a null or non-finite component are dropped.  The dimension is the commonest length among the
rest that can be cut into equal parts (ties: the smaller); vectors of another length are returned with null code and error and
take no part.  Components beyond +-``limit`` / scale count as that bound, so that distances cannot leave 64 bits.  Null ids come
last, equal ids in the order of their integers, repeated rows count each; with fewer vectors than entries there are as many entries as
vectors.  Empty tables give empty results.  Equal labels, nulls together, share ``label_error``; extra columns pass through unless
named like an output.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from paceline.llm.common import discard, free_name, others, written


@dataclass(frozen=True)
class CodeParams:
    parts: int = 4
    entries: int = 256
    rounds: int = 4
    scale: int = 1024
    limit: int = 1 << 24
    rows: int = 4096  # vectors whose distances are held at once
    block: int = 16  # components of a part that are summed in one row


def integer_vectors(vectors: DataFrame, params: CodeParams = CodeParams(), vector: str = "embedding") -> tuple[DataFrame, str]:
    """(rows with a clean vector as a scratch table, the name of their integer column); the vectors themselves go."""
    name = free_name(vectors, "integers")
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    bound = float(params.limit)
    whole = F.transform(vector, lambda x: F.floor(F.greatest(F.lit(-bound), F.least(F.lit(bound), params.scale * x.cast("double")))).cast("int"))
    return written(vectors.filter(F.col(vector).isNotNull() & finite).withColumn(name, whole).drop(vector), "codes-vectors"), name


def _matrix(column: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of d components, their integers as a matrix)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    at = np.flatnonzero(np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False), nan=-1) == d)
    return at, column.take(pa.array(at)).flatten().to_numpy().astype(np.int64).reshape(len(at), d)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first nearest entry of each row and its squared distance, in int64."""
    d = (book * book).sum(axis=1) - 2 * (x @ book.T)
    at = d.argmin(axis=1)
    return at, d[np.arange(len(x)), at] + (x * x).sum(axis=1)


def _round(table: DataFrame, column: str, books: np.ndarray, params: CodeParams) -> np.ndarray:
    """The codebooks after one round of assignment and replacement."""
    spark = table.sparkSession
    parts, entries, size = books.shape
    blocks = -(-size // params.block)
    shared = spark.sparkContext.broadcast(books)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((parts, entries, blocks * params.block), dtype=np.int64), np.zeros((parts, entries), dtype=np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, params.rows):
                _, x = _matrix(batch.column(0).slice(start, params.rows), parts * size)
                for p in range(parts if len(x) else 0):
                    part = x[:, p * size : (p + 1) * size]
                    at, _ = nearest(part, shared.value[p])
                    order = np.argsort(at, kind="stable")
                    chosen, first, counts = np.unique(at[order], return_index=True, return_counts=True)
                    total[p, chosen, :size] += np.add.reduceat(part[order], first)
                    n[p, chosen] += counts
        p, e = np.nonzero(n)
        for b in range(blocks):
            values = total[p, e, b * params.block : (b + 1) * params.block]
            columns = [p, e, np.full(len(p), b), n[p, e], *values.T]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c, dtype=np.int64)) for c in columns], names=names)

    values = [f"s{i}" for i in range(params.block)]
    names = ["part", "entry", "block", "n", *values]
    made = table.select(column).mapInArrow(sums, ", ".join(f"{c} long" for c in names))
    got = made.groupBy("part", "entry", "block").agg(*(F.sum(c).alias(c) for c in ("n", *values))).toArrow()  # at most a row for each entry and block
    shared.unpersist()
    out = np.zeros((parts, entries, blocks * params.block), dtype=np.int64)
    out[:, :, :size] = books
    p, e, b, n = (got[c].to_numpy() for c in names[:4])
    for i, c in enumerate(values):
        out[p, e, b * params.block + i] = got[c].to_numpy() // n  # rounds down
    return out[:, :, :size]


def codebooks(table: DataFrame, column: str, vec_id: str = "vec_id", params: CodeParams = CodeParams()) -> np.ndarray:
    """The codebooks after all rounds: parts x entries x components, none without vectors."""
    lengths = table.groupBy(F.size(column).alias("d")).agg(F.count("*").alias("n")).filter((F.col("d") > 0) & (F.col("d") % params.parts == 0))
    common = lengths.orderBy(F.desc("n"), "d").first()
    if common is None:
        return np.zeros((params.parts, 0, 0), dtype=np.int64)
    d = common["d"]
    first = table.filter(F.size(column) == d).orderBy(F.col(vec_id).asc_nulls_last(), column).select(column).limit(params.entries).toArrow()
    _, x = _matrix(first[column], d)
    books = np.ascontiguousarray(x.reshape(len(x), params.parts, -1).transpose(1, 0, 2))
    for _ in range(params.rounds):
        books = _round(table, column, books, params)
    return books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and place, comma-joined."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def assign(table: DataFrame, column: str, books: np.ndarray, params: CodeParams = CodeParams()) -> DataFrame:
    """``table`` with code and error in place of its integers."""
    parts, _, size = books.shape
    shared = table.sparkSession.sparkContext.broadcast(books)
    kept = others(table, "code", "error", column)
    schema = StructType([table.schema[c] for c in kept]).add("code", StringType()).add("error", LongType())
    digits = max(2, len(f"{max(0, books.shape[1] - 1):x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hexed = [f"{i:0{digits}x}" for i in range(shared.value.shape[1])]
        for batch in batches:
            for start in range(0, batch.num_rows, params.rows):
                some = batch.slice(start, params.rows)
                code, error = [None] * some.num_rows, [None] * some.num_rows
                rows, x = _matrix(some.column(column), parts * size) if size else ([], None)
                if len(rows):
                    found = [nearest(x[:, p * size : (p + 1) * size], shared.value[p]) for p in range(parts)]
                    total = sum(e for _, e in found)
                    for row, at, e in zip(rows, np.stack([a for a, _ in found], axis=1).tolist(), total.tolist(), strict=True):
                        code[row], error[row] = "".join(hexed[i] for i in at), e
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in kept), pa.array(code, pa.string()), pa.array(error, pa.int64())], names=[*kept, "code", "error"])

    return table.select(*kept, column).mapInArrow(run, schema)


def compress(vectors: DataFrame, params: CodeParams = CodeParams(), vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> tuple[DataFrame, np.ndarray]:
    """(``vectors`` with code, error, label_error and codebooks_sha256 in place of the vector, the codebooks)."""
    outputs = "code", "error", "label_error", "codebooks_sha256"
    table, column = integer_vectors(vectors.select(*others(vectors, *outputs)), params, vector)
    books = codebooks(table, column, vec_id, params)
    coded = written(assign(table, column, books, params), "codes")
    discard(table)
    key = free_name(coded, "key_of_label")
    sums = coded.groupBy(F.col(label).alias(key)).agg(F.sum("error").alias("label_error"))
    out = coded.join(sums, F.col(label).eqNullSafe(F.col(key)), "left").drop(key)
    return out.withColumn("codebooks_sha256", F.lit(digest(books))), books
