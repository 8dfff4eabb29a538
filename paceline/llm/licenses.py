"""License scans: exact base phrases, and a fuzzy search for short notices.

A notice of a catalogue may be misspelt by up to ``errors`` edits (insertions, deletions, substitutions).  Split into
errors + 1 pieces, at least one piece then stands in the text unharmed: one Aho-Corasick pass over the normalised
text finds the pieces of all notices, each find gives the window in which its notice can lie, and the regex
library's bounded-error matching verifies that window alone and reports the span and its edits.  Windows are never merged, so that the
work is a bounded search for each find, however closely notices follow each other.

The normalised text is its alphanumeric words joined by single blanks, so that line breaks, punctuation and
markup do not count as edits.  Base phrases are runs of whole words in it.

Defined cases: null and wordless texts have no words, places or labels and score 0; of overlapping finds the
one with the fewest edits stays, then the longest, then the leftmost; repeated rows are each scanned; very long
texts are scanned whole, in time about linear in their length; an empty table gives an empty result; only doc_id is carried.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.llm.common import alnum_words, map_batches

#: Fixed values of the contract: phrase and label.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Short notices by label, in normalised words.
NOTICES = (
    ("agpl-3.0", "licensed under the gnu affero general public license version 3"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by-4.0", "licensed under cc by 4 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-nd-4.0", "licensed under cc by nd 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0"),
    ("cc0-1.0", "released under the creative commons zero public domain dedication"),
    ("epl-2.0", "made available under the terms of the eclipse public license 2 0"),
    ("gpl-2.0", "licensed under the gnu general public license version 2"),
    ("gpl-3.0", "licensed under the gnu general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose"),
    ("lgpl-3.0", "licensed under the gnu lesser general public license version 3"),
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0"),
    ("proprietary", "all rights reserved no part of this publication may be reproduced"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)


_BLANK = re.compile(" ")


@dataclass(frozen=True)
class LicenseParams:
    #: One edit for so many characters of a notice, between the two bounds.
    chars_per_error: int = 12
    min_errors: int = 1
    max_errors: int = 4
    notices: tuple[tuple[str, str], ...] = NOTICES
    phrases: tuple[tuple[str, str], ...] = PHRASES


class NoticeFinder:
    """Seeds of all notices in one automaton, and a verifying pattern for each notice."""

    def __init__(self, params: LicenseParams) -> None:
        self.patterns, seeds = [], {}
        for k, (label, notice) in enumerate(params.notices):
            errors = max(params.min_errors, min(params.max_errors, len(notice) // params.chars_per_error))
            self.patterns.append((label, len(notice), errors, regex.compile(f"(?b)(?<![^ ])(?:{regex.escape(notice, literal_spaces=True)}){{e<={errors}}}(?![^ ])")))
            for start, piece in split_pieces(notice, errors + 1):
                seeds.setdefault(piece, []).append((k, start))
        self.seeds = ahocorasick.Automaton()
        for piece, owners in seeds.items():
            self.seeds.add_word(piece, (len(piece), owners))
        self.seeds.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, str, int]]:
        """(start, end, label, edits) in characters of a normalised text."""
        windows: set[tuple[int, int]] = set()
        for end, (length, owners) in self.seeds.iter(text):
            windows.update((k, end + 1 - length - offset) for k, offset in owners)
        hits = {hit for k, start in windows if (hit := self._verify(text, k, start))}
        best: list[tuple[int, int, str, int]] = []  # ascending and apart from each other
        for hit in sorted(hits, key=lambda x: (x[3], x[0] - x[1], x)):
            at = bisect_left(best, hit)
            if (not at or best[at - 1][1] <= hit[0]) and (at == len(best) or hit[1] <= best[at][0]):
                best.insert(at, hit)
        return best

    def _verify(self, text: str, k: int, start: int) -> tuple[int, int, str, int] | None:
        """The best match where notice k would begin at ``start`` without edits: the window has room for its edits on either side, and not for
        two notices, so that one search of bounded length does."""
        label, size, errors, pattern = self.patterns[k]
        m = pattern.search(text, max(0, start - errors), min(len(text), start + size + errors + 1))
        return (m.start(), m.end(), label, sum(m.fuzzy_counts)) if m else None


def split_pieces(notice: str, n: int) -> list[tuple[int, str]]:
    """``n`` pieces of nearly equal length, with where each starts."""
    cuts = [len(notice) * i // n for i in range(n + 1)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def phrase_places(text: str, phrase: str) -> Iterator[int]:
    """Where the phrase stands as whole words in a text framed by blanks; places may overlap."""
    at = text.find(f" {phrase} ")
    while at >= 0:
        yield at
        at = text.find(f" {phrase} ", at + 1)


def scan(docs: DataFrame, params: LicenseParams = LicenseParams()) -> DataFrame:
    """doc_id, n_words, places (word, phrase label), notices (first_word, last_word, label, edits, text)."""
    ready: list[NoticeFinder] = []

    def look(batch: dict[str, list]) -> dict[str, list]:
        if not ready:
            ready.append(NoticeFinder(params))
        out: dict[str, list] = {"doc_id": batch["doc_id"], "n_words": [], "places": [], "notices": []}
        for raw in batch["text"]:
            words = alnum_words(raw)
            text = b" ".join(words).decode()
            framed = f" {text} "
            blanks = [m.start() for m in _BLANK.finditer(framed)]  # word k of the text follows the k-th of them
            found = sorted((bisect_left(blanks, at), label) for phrase, label in params.phrases for at in phrase_places(framed, phrase))
            out["n_words"].append(len(words))
            out["places"].append([{"word": w, "label": label} for w, label in found])
            out["notices"].append(
                [
                    {"first_word": bisect_right(blanks, a) - 1, "last_word": bisect_right(blanks, b) - 1, "label": label, "edits": edits, "text": text[a:b]}
                    for a, b, label, edits in ready[0].find(text)
                ]
            )
        return out

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(
        docs.select("doc_id", F.col("text").cast("binary").alias("text")),
        look,
        f"doc_id {kind}, n_words long, places array<struct<word: long, label: string>>, "
        "notices array<struct<first_word: long, last_word: long, label: string, edits: int, text: string>>",
    )


def license_digest(docs: DataFrame, params: LicenseParams = LicenseParams()) -> DataFrame:
    """One row for each document: places, labels and a score, 1 for an exact find and less with edits."""
    word, label = F.transform("places", lambda x: x["word"]), F.transform("places", lambda x: x["label"])
    join = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    quality = F.transform("notices", lambda x: 1 / (1 + x["edits"]))
    best = F.coalesce(F.array_max(quality), F.lit(0.0))
    return scan(docs, params).select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(word).alias("first_word"),
        F.array_max(word).alias("last_word"),
        join(label).alias("base_labels"),
        join(F.concat(label, F.transform("notices", lambda x: x["label"]))).alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(best).alias("score"),
        F.size("notices").cast("long").alias("n_notices"),
    )
