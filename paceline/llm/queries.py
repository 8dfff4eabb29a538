"""The queries of this subpackage: thin digests of the operators over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.llm import chat, decontaminate, langid, licenses, lines, mixing, neardup, oracles, packing, quality, resample, toxicity, urls, vectors


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return lines.dedup_lines(docs).drop("source")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.quality_scores(docs, _table(spark, sf_dir, "labels")).drop("text")


def op4_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.perspectives(_table(spark, sf_dir, "conversations"))


def chat_dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dialogues that operator 4 renders, with their masks as text: start-end,start-end."""
    parts = chat.dialogue_parts(chat.perspectives(_table(spark, sf_dir, "conversations")))
    spans = F.transform("masks", lambda m: F.concat_ws("-", m["start"], m["end"]))
    return parts.withColumn("masks", F.array_join(spans, ","))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    labels = _table(spark, sf_dir, "labels").filter(~held_out)
    scored = toxicity.score(docs, toxicity.train(docs, labels))
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.components(_table(spark, sf_dir, "documents"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).drop("text", "source")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    found = langid.identify(docs, langid.learn(docs.filter(~held_out)))
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_digest(_table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, _ = vectors.compress(_table(spark, sf_dir, "embeddings"))
    return coded.drop("label")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return resample.resample(docs, _table(spark, sf_dir, "benchmark")).drop("n_words")


def op13_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents").select("doc_id", "text"), keep_ids=False)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)} | {"chat_dialogues": chat_dialogues}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": oracles.OP1,
        "op4_chat_rotation": oracles.OP4,
        "chat_dialogues": oracles.DIALOGUES,
        "op5_decontamination": oracles.OP5,
        "op7_near_dedup": oracles.OP7,
        "op8_source_mix": oracles.OP8,
        "op11_vector_codes": oracles.OP11,
        "op12_importance_resampling": oracles.OP12,
    }
