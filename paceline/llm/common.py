"""What the text operators share: scratch tables, word patterns and Arrow batch plumbing.

Two definitions of a word occur in the contracts, both over code points and both equal to a
byte-level rule over UTF-8, because every byte of a multi-byte character is >= 0x80:

* *blank-separated*: maximal runs of anything but U+0020 and U+0009..U+000D;
* *alphanumeric*: after lower-casing A-Z only, maximal runs of 0-9, a-z and every code point >= U+0080.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.sources.scratch import discard, written  # noqa: F401  used by the operators

BLANKS = r"[\x20\x09-\x0D]+"
NOT_BLANKS = r"[^\x20\x09-\x0D]+"

#: bytes.translate table: A-Z to a-z, every other ASCII byte that is no digit or lower-case letter to a blank.
ALNUM_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def alnum_words(text: bytes | None) -> list[bytes]:
    """The alphanumeric words of a UTF-8 text (none for null)."""
    return text.translate(ALNUM_TABLE).split() if text else []


def blank_words(text: bytes | None) -> list[bytes]:
    """The blank-separated words of a UTF-8 text (none for null)."""
    return text.split() if text else []


def words_col(text: Column) -> Column:
    """Blank-separated words as an array column; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def shipped(spark: SparkSession, value: object) -> Callable[[], object]:
    """A broadcast of an object together with its class's code, which executors need not have installed."""
    data = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    ready: list[object] = []

    def get() -> object:
        if not ready:
            ready.append(pickle.loads(data.value))
        return ready[0]

    return get


def map_batches(
    df: DataFrame, function: Callable[[dict[str, list]], dict[str, list]], schema: str
) -> DataFrame:
    """``function`` over Arrow batches given and returned as columns of Python values."""
    spark = df.sparkSession
    arrow = _arrow_schema(spark, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                # to_pylist of a slice at a time, so that a batch of very long texts is not doubled at once
                for start in range(0, batch.num_rows, 512):
                    part = batch.slice(start, 512)
                    out = function({n: c.to_pylist() for n, c in zip(part.schema.names, part.columns, strict=True)})
                    yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def _arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores before it where the frame has such a column already."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def others(df: DataFrame, *outputs: str) -> list[str]:
    """The columns that pass through: all but those that the outputs of the same name replace."""
    taken = {o.lower() for o in outputs}
    return [c for c in df.columns if c.lower() not in taken]
