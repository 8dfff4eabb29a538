"""Language identification by compression: the language whose dictionary makes the text smallest wins.

For every language a zstandard raw-content dictionary is laid out from a bounded sample of its labelled
documents: ``slots`` documents with the smallest hashes, each giving ``excerpts`` excerpts of ``excerpt_chars`` characters, one
from each equal part of its text at a place that its hash draws, or the whole text if it is no longer.  Only letters count,
in lower case; a text is cut into pieces of ``piece`` bytes, each piece is compressed alone with each dictionary, and the sizes
are summed.  The pieces keep a long text from becoming its own dictionary, so that margins do not shrink with length.

The score is the margin, 1 - smallest / second smallest size, scaled to 0..1 over ``full_margin``; below ``min_score``
the text is ``rejected`` though the best language is still told.

Fixed bound of learning: ``slots`` documents for a language (at most ``slots * excerpts * excerpt_chars`` characters, 96,000).
There may be any number of languages: their dictionaries take that much each, and compressors are made for ``group``
languages at a time.

Defined cases: null texts and texts without a letter are ``und`` with score 0 and rejected; with no labelled
documents every text is ``und``; with one language its score is 1; ties go to the language first in code point
order; repeated rows are each judged; very long texts are judged whole; an empty table gives an empty result; only doc_id is
carried.
"""

from __future__ import annotations

import heapq
import re
from dataclasses import dataclass

import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceline.llm.common import map_batches, shipped

_NO_LETTERS = re.compile(r"[\W\d_]+")


def letters(text: str) -> bytes:
    """The text's letters in lower case, what lies between them as one blank."""
    return _NO_LETTERS.sub(" ", text.lower()).encode()


@dataclass(frozen=True)
class LangParams:
    slots: int = 64
    excerpts: int = 3
    excerpt_chars: int = 500
    group: int = 256
    piece: int = 4096
    level: int = 6
    full_margin: float = 0.25
    min_score: float = 0.05


def excerpts(text: Column, h: Column, params: LangParams) -> Column:
    """One excerpt from each of ``excerpts`` equal parts of a text, joined by blanks; short texts whole."""
    size, part = F.lit(params.excerpt_chars), F.floor(F.length(text) / params.excerpts).cast("int")
    starts = [part * i + F.pmod(F.shiftrightunsigned(h, 16 * i), part - size + 1).cast("int") + 1 for i in range(params.excerpts)]
    cut = F.concat_ws(" ", *(F.substr(text, start, size) for start in starts))
    return F.when(F.length(text) <= params.excerpts * params.excerpt_chars, text).otherwise(cut)


def learn(labelled: DataFrame, params: LangParams = LangParams()) -> dict[str, bytes]:
    """Language to raw dictionary content, from rows (doc_id, text, lang); order and content are deterministic."""
    rows = labelled.filter("lang is not null and text is not null and length(text) > 0")
    h = F.xxhash64("doc_id", "text")
    picked = (
        rows.select("lang", h.alias("h"), excerpts(F.col("text"), h, params).alias("text"))
        .groupBy("lang", F.pmod("h", F.lit(params.slots)).alias("slot"))
        .agg(F.min(F.struct("h", "text")).alias("one"))
        .select("lang", "one.h", "one.text")
        .collect()  # at most slots rows of bounded length for a language
    )
    content: dict[str, list[bytes]] = {}
    for lang, _, text in sorted(picked):
        content.setdefault(lang, []).append(letters(text))
    return {lang: b"\n".join(parts) for lang, parts in sorted(content.items())}


class Compressors:
    """One compressor for each language, with its raw-content dictionary digested once, for ``group`` languages at a time."""

    def __init__(self, content: dict[str, bytes], params: LangParams) -> None:
        self.params = params
        items = sorted(content.items())
        self.groups = [items[i : i + params.group] for i in range(0, len(items), params.group)]
        self.ready: tuple[int, list] = (-1, [])

    def _group(self, k: int) -> list:
        if self.ready[0] != k:
            self.ready = (k, [(lang, self._made(raw)) for lang, raw in self.groups[k]])
        return self.ready[1]

    def _made(self, raw: bytes) -> zstandard.ZstdCompressor:
        made = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        made.precompute_compress(level=self.params.level)
        return zstandard.ZstdCompressor(level=self.params.level, dict_data=made, write_content_size=False, write_checksum=False, write_dict_id=False)

    def judge(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """The best language and the score of each text."""
        out, least = [("und", 0.0)] * len(texts), {}
        asked = [i for i, t in enumerate(texts) if t is not None and any(map(str.isalpha, t))]
        for k in range(len(self.groups)):
            for i in asked:
                text = letters(texts[i])
                pieces = [text[j : j + self.params.piece] for j in range(0, len(text), self.params.piece)]
                sizes = [(sum(len(c.compress(p)) for p in pieces), lang) for lang, c in self._group(k)]
                least[i] = heapq.nsmallest(2, least.get(i, []) + sizes)
        for i, (best, *rest) in least.items():
            out[i] = best[1], min(1.0, (1 - best[0] / rest[0][0]) / self.params.full_margin) if rest else 1.0
        return out


def identify(docs: DataFrame, content: dict[str, bytes], params: LangParams = LangParams()) -> DataFrame:
    """doc_id, lang_pred, score, rejected for the whole text of each row."""
    shared = shipped(docs.sparkSession, content)
    ready: list[Compressors] = []

    def judge(batch: dict[str, list]) -> dict[str, list]:
        if not ready:
            ready.append(Compressors(shared(), params))
        found = ready[0].judge(batch["text"])
        return {
            "doc_id": batch["doc_id"],
            "lang_pred": [x[0] for x in found],
            "score": [x[1] for x in found],
            "rejected": [x[0] == "und" or x[1] < params.min_score for x in found],
        }

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), judge, f"doc_id {kind}, lang_pred string, score double, rejected boolean")
