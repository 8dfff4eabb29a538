"""Quality rules: base counts, then a hashed n-gram log-likelihood ratio for every document.

Two multinomials over ``buckets`` hashed n-grams are counted: one from trusted documents (labels with
quality 1), one from the whole raw corpus.  A document's score is the sum over its n-grams of
``ln p_target(bucket) - ln p_raw(bucket)``, divided by their number; documents at or above ``threshold``
stay.  The model has one double per bucket, so its size is fixed and does not grow with the data.

Everything is DataFrame functions.  The trusted side takes at most ``target_rows`` labelled documents, in
the order of a hash of their id; the raw side counts all documents.

``prior`` and ``threshold`` are constants, not rules of the corpus' size: the prior weighs about 1,500 documents of 200 words, so that
fewer trusted documents move no weight far, and the threshold was set once with a margin below the trusted documents of the test
tables.  Another corpus may need others.

Defined cases: null text has no words (base_failed); very long texts are counted whole; texts with no n-gram score 0; null doc_id rows are scored
like others; repeated rows are each returned; an empty table gives an empty result; extra columns pass through, but
those named like an output are replaced; without trusted documents every score is 0 and the rule alone decides.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceline.llm.common import free_name, let, others, words_col, written


@dataclass(frozen=True)
class QualityParams:
    buckets: int = 16384
    target_rows: int = 20_000
    threshold: float = -0.045
    min_words: int = 50
    max_repeat_percent: int = 50
    prior: float = 300_000.0


def repeated_words(words: Column) -> Column:
    """How many words lie in 3-word windows that occur twice or more in the array, the first included."""

    def covered(ordered: Column) -> Column:
        n = F.size(ordered)
        same = F.filter(
            ordered,
            lambda x, i: ((i > 0) & (F.get(ordered, i - 1)["h"] == x["h"]))
            | ((i < n - 1) & (F.get(ordered, i + 1)["h"] == x["h"])),
        )
        return let(F.array_sort(F.transform(same, lambda x: x["i"])), spread)

    def spread(at: Column) -> Column:
        steps = F.zip_with(
            F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0))),
            F.slice(at, 2, F.greatest(F.size(at) - 1, F.lit(0))),
            lambda a, b: F.least(F.lit(3), b - a),
        )
        return F.when(F.size(at) == 0, F.lit(0)).otherwise(F.aggregate(steps, F.lit(3), lambda s, x: s + x)).cast("long")

    windows = F.transform(
        F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))),
        lambda w, i: F.struct(F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")),
    )
    return let(F.array_sort(windows), covered)


def base_columns(text: Column, words: Column, params: QualityParams = QualityParams()) -> dict[str, Column]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words as long columns."""
    body = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": F.regexp_count(body, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated_words(words),
    }


def ngram_buckets(words: Column, buckets: int) -> Column:
    """Hashed word unigrams and bigrams; the bigram of a word and its successor is seeded by both."""
    one = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int"))
    two = F.transform(
        F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))),
        lambda w, i: F.pmod(F.xxhash64(w, F.get(words, i + 1)), F.lit(buckets)).cast("int"),
    )
    return F.concat(one, two)


def log_ratio_model(docs: DataFrame, labels: DataFrame, params: QualityParams = QualityParams()) -> DataFrame:
    """One row: ``weights``, for each bucket ln p_target - ln p_raw.

    The target multinomial has a Dirichlet prior of ``prior`` n-grams distributed as the raw corpus, so that few
    trusted documents move no weight far from 0.
    """
    trusted = (
        labels.filter(F.col("quality") == 1)
        .select("doc_id")
        .distinct()
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(params.target_rows)
        .select("doc_id", F.lit(1).alias("trusted"))
    )
    grams = (
        docs.select("doc_id", words_col(F.col("text")).alias("words"))
        .join(F.broadcast(trusted), "doc_id", "left")  # at most target_rows ids
        .select(F.explode(ngram_buckets(F.col("words"), params.buckets)).alias("bucket"), "trusted")
    )
    counts = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.count("trusted").alias("target"))
    every = docs.sparkSession.range(0, params.buckets, 1, 1).select(F.col("id").cast("int").alias("bucket"))
    full = every.join(counts, "bucket", "left").select(
        "bucket", (F.coalesce("raw", F.lit(0)) + 1).alias("raw"), F.coalesce("target", F.lit(0)).alias("target")
    )
    sums = full.agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"), F.collect_list(F.struct("bucket", "raw", "target")).alias("all"))
    return sums.select(
        F.transform(
            F.array_sort("all"),
            lambda x: F.log((x["target"] * F.col("raw") / x["raw"] + params.prior) / (F.col("target") + params.prior)),
        ).alias("weights")
    )


def quality_scores(docs: DataFrame, labels: DataFrame, params: QualityParams = QualityParams()) -> DataFrame:
    """``docs`` with the base columns, ``base_failed``, ``llr`` and ``kept``."""
    weights = written(log_ratio_model(docs, labels, params), "llr-model")
    found, model = free_name(docs, "quality_found"), free_name(docs, "quality_model")
    outputs = "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr"

    def ratio(buckets: Column) -> Column:
        total = F.aggregate(buckets, F.lit(0.0), lambda s, x: s + F.get(F.col(model), x))
        return F.when(F.size(buckets) == 0, F.lit(0.0)).otherwise(total / F.size(buckets))

    def measures(words: Column) -> Column:
        base = base_columns(F.col("text"), words, params)
        ratios = let(ngram_buckets(words, params.buckets), ratio).alias("llr")
        return let(F.struct(*(c.alias(n) for n, c in base.items()), ratios), decided)

    def decided(m: Column) -> Column:
        failed = (m["n_words"] < params.min_words) | (100 * m["n_repeat_words"] > params.max_repeat_percent * m["n_words"])
        kept = ~failed & (m["llr"] >= params.threshold)
        own = {"base_failed": failed, "kept": kept}
        return F.struct(*((own[n] if n in own else m[n]).alias(n) for n in outputs))

    # one expression whose words are a lambda variable: no optimiser rule can copy their splitting into a loop, and
    # a filter on one of its fields computes it once
    out = docs.withColumn(model, weights.scalar()).withColumn(found, let(words_col(F.col("text")), measures))
    return out.select(*others(docs, *outputs), *(F.col(f"{found}.{n}").alias(n) for n in outputs))
