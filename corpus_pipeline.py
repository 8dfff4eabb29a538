"""The corpus pipeline: quality rules, line dedup, MinHash near-dedup, benchmark decontamination, source mixing.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame; all but the
last return the columns of documents.  Stages may be run one by one with Parquet tables between them, as ``run``
does, in the shared folder named by ``spark.checkpoint.dir``.

Defined cases, for all stages: extra columns, whatever their names, are left out; an empty table gives an empty result; very long texts
are worked on whole.  Quality rules: null, empty and short texts go; repeated rows each stay or go by their own text.  Line
dedup: null and empty texts stay as they are, rows with a null doc_id lose boilerplate that others have.  Near-dedup: of rows whose
texts are in one group one stays, that of the smallest doc_id, or one of null doc_id where there are no others; wordless texts stay, rows
equal in every column once.  Decontamination: null and wordless texts stay.  Mixing: texts without words are not in the mix; rows with
one doc_id, or none, are taken together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.llm import decontaminate, lines, mixing, neardup, quality
from paceline.llm.common import written


def _columns(docs: DataFrame) -> DataFrame:
    """The columns of documents; n_chars follows the text."""
    return docs.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or look unlike trusted documents go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _columns(quality.quality_scores(_columns(docs), labels).filter("kept"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines stay in their first document only; documents left without a word go."""
    return _columns(lines.dedup_lines(_columns(docs)).filter("not emptied"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return _columns(neardup.unique_documents(_columns(docs)))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that mostly consist of them go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _columns(decontaminate.clean(_columns(docs), benchmark).filter("not dropped"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix, with size, source_size, target and taken (words, repeats counted)."""
    return mixing.mix(_columns(docs)).filter("taken > 0")


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("near-dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("source mixing", mixing_stage),
]

#: A log-likelihood model, sketches and an automaton decide; SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written before the next stage reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
