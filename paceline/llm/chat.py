"""Multi-party perspective rotation: every participant of a dialogue in turn becomes the assistant.

For each participant the whole dialogue is rendered once, with that speaker's turns as ``assistant``, everybody
else's as ``user`` with a name, system turns as ``system``; only the assistant's text and its end mark
are trained on.  The result has a row for each turn and perspective, so a conversation of any length is never
gathered: ordered by (turn, name, segment) the rows of one perspective are its rendering.
``dialogue_parts`` joins them to texts of a bounded number of turns.

Turns meet the participants of their conversation in an equi-join of two shuffled tables, which adaptive execution
splits where one conversation holds much of the data.

Defined cases: null text renders as empty; a null role is the participant ``unknown``, and a role of that name, with or without
primes, gets one prime more, so that no two participants are confused; a null conv_id is a conversation of its own; null turns
come first; repeated rows are rendered as often as they occur; a conversation of system turns only has no perspective and no
rows; marks inside a text or a name are broken up by a blank, and in a rendered name control characters and line ends become
blanks, so that nobody can forge a turn; very long texts are rendered whole; empty tables give empty results; other columns are
not carried.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatParams:
    start: str = "<|im_start|>"
    end: str = "<|im_end|>"
    system_role: str = "system"
    unknown: str = "unknown"


#: What may not stand in a rendered name: control characters and line ends.
CONTROL = r"[\x00-\x1F\x7F\x{85}\x{2028}\x{2029}]"


def broken_up(text: Column, params: ChatParams) -> Column:
    """``text`` with a blank after the first character of each mark."""
    for mark in (params.start, params.end):
        text = F.replace(text, F.lit(mark), F.lit(mark[0] + " " + mark[1:]))
    return text


def participant(role: Column, params: ChatParams) -> Column:
    """The name of a role, one to one."""
    return F.when(role.isNull(), F.lit(params.unknown)).when(F.rtrim(role, F.lit("'")) == params.unknown, F.concat(role, F.lit("'"))).otherwise(role)


def perspectives(turns: DataFrame, params: ChatParams = ChatParams()) -> DataFrame:
    """conv_id, perspective, turn, name, role, segment, mask_start, mask_end (half-open, in characters of it)."""
    name = participant(F.col("role"), params)
    said = turns.select("conv_id", "turn", name.alias("name"), F.coalesce("text", F.lit("")).alias("text"))
    speakers = (
        said.filter(F.col("name") != params.system_role)
        .select(F.col("conv_id").alias("conv"), F.col("name").alias("perspective"))
        .distinct()
    )
    both = said.join(speakers, F.col("conv_id").eqNullSafe(F.col("conv")))
    role = (
        F.when(F.col("name") == F.col("perspective"), F.lit("assistant"))
        .when(F.col("name") == params.system_role, F.lit("system"))
        .otherwise(F.lit("user"))
    )
    text = broken_up(F.col("text"), params)
    shown = F.concat(F.lit(" name="), broken_up(F.regexp_replace("name", CONTROL, " "), params))
    head = F.concat(F.lit(params.start), "role", F.when(F.col("role") == "user", shown).otherwise(F.lit("")), F.lit("\n"))
    trained = F.col("role") == "assistant"
    return (
        both.select("conv_id", "perspective", "turn", "name", role.alias("role"), text.alias("text"))
        .withColumn("head", head)
        .select(
            "conv_id",
            "perspective",
            "turn",
            "name",
            "role",
            F.concat("head", "text", F.lit(params.end + "\n")).alias("segment"),
            F.when(trained, F.length("head")).otherwise(F.lit(0)).cast("long").alias("mask_start"),
            F.when(trained, F.length("head") + F.length("text") + len(params.end)).otherwise(F.lit(0)).cast("long").alias("mask_end"),
        )
    )


def dialogue_parts(rendered: DataFrame, turns_per_part: int = 64) -> DataFrame:
    """conv_id, perspective, part, text, masks: segments joined in order, ``turns_per_part`` turn numbers at a time."""
    part = F.floor(F.coalesce("turn", F.lit(0)) / turns_per_part).alias("part")
    grouped = rendered.groupBy("conv_id", "perspective", part).agg(
        F.array_sort(F.collect_list(F.struct("turn", "name", "segment", "mask_start", "mask_end"))).alias("turns")
    )
    add = lambda state, x: F.struct(
        (state["at"] + F.length(x["segment"])).alias("at"),
        F.when(
            x["mask_end"] > 0,
            F.concat(
                state["masks"],
                F.array(F.struct((state["at"] + x["mask_start"]).alias("start"), (state["at"] + x["mask_end"]).alias("end"))),
            ),
        )
        .otherwise(state["masks"])
        .alias("masks"),
    )
    start = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<start: bigint, end: bigint>>)").alias("masks"))
    return grouped.select(
        "conv_id",
        "perspective",
        "part",
        F.array_join(F.transform("turns", lambda x: x["segment"]), "").alias("text"),
        F.aggregate("turns", start, add)["masks"].alias("masks"),
    )
