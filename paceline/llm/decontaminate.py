"""Benchmark decontamination with a generalised suffix automaton over the words of the test items.

Items are read by the driver as a stream and gathered into groups of at most ``max_item_words`` words; a longer item is cut
into parts that overlap by a window less one word, so that every window lies in some part.  Each group becomes an automaton (word ids as
letters), which costs about 1.4 kB for each of its words while it is built and is broadcast: 280 MB at most, whatever the size of
the benchmark.  One group suffices for most benchmarks; the documents are then mapped once.  With more, each is streamed
over the documents in turn, and what was found is merged by document: nothing is left out.

Documents are streamed through an automaton: at each word it knows the longest suffix of what was read that occurs in
some item.  Only stretches whose neighbouring words are all neighbours in some item too can hold a match of two
words, so words outside them are skipped without a step.

A window is ``window`` consecutive words of an item, or a whole shorter item.  A word inside any occurrence of a
window is hit.  Spans of hit words are removed where they are at least ``min_span`` words long; a document of
which more than ``max_coverage`` is hit is dropped altogether.

Defined cases: null and wordless texts have no words and no hits; wordless items have no windows; items with
a null item_id hit words but are not counted; items sharing an item_id count once; repeated rows are each
returned; very long texts are streamed whole; an empty benchmark hits nothing; extra columns pass through ``clean`` unless
named like an output, but not ``matches``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import chain

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceline.llm.common import alnum_words, discard, free_name, map_batches, others, shipped, written

_WORDS = re.compile(rb"[0-9A-Za-z\x80-\xFF]+")


@dataclass(frozen=True)
class DecontaminationParams:
    window: int = 10
    min_span: int = 1
    max_coverage: float = 0.5
    max_item_words: int = 200_000


class ItemAutomaton:
    """Generalised suffix automaton over items given as (item_id, words)."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int) -> None:
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        coded = [(i, [self.ids.setdefault(w, len(self.ids)) for w in words]) for i, words in items if words]
        for _, codes in coded:
            last = 0
            for c in codes:
                last = self._extend(last, c)
        self._mark(coded)
        pairs = {a * len(self.ids) + b for _, codes in coded for a, b in zip(codes, codes[1:], strict=False)}
        self.pairs = np.array(sorted(pairs), dtype=np.int64)

    def _extend(self, last: int, c: int) -> int:
        """Append a letter after state ``last``; an existing transition is reused, or its target split."""
        known = self.next[last].get(c)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, c, known)
        new = self._state(self.length[last] + 1, {}, -1)
        at = last
        while at != -1 and c not in self.next[at]:
            self.next[at][c] = new
            at = self.link[at]
        if at == -1:
            self.link[new] = 0
        else:
            target = self.next[at][c]
            self.link[new] = target if self.length[target] == self.length[at] + 1 else self._split(at, c, target)
        return new

    def _state(self, length: int, moves: dict[int, int], link: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, at: int, c: int, target: int) -> int:
        """A copy of ``target`` for the strings up to one longer than those of ``at``."""
        twin = self._state(self.length[at] + 1, dict(self.next[target]), self.link[target])
        self.link[target] = twin
        while at != -1 and self.next[at].get(c) == target:
            self.next[at][c] = twin
            at = self.link[at]
        return twin

    def _mark(self, coded: list[tuple[object, list[int]]]) -> None:
        """For every state with a string that is a window: window length to the items that have it."""
        found: dict[int, dict[int, set]] = {}
        for item, codes in coded:
            size = min(self.window, len(codes))
            state = depth = 0
            for c in codes:
                state, depth = self.step(state, depth, c)
                if depth >= size:
                    at = state
                    while self.length[self.link[at]] >= size:
                        at = self.link[at]
                    found.setdefault(at, {}).setdefault(size, set()).add(item)
        self.windows = {s: {n: frozenset(i) for n, i in by.items()} for s, by in found.items()}
        # from each state the nearest state with windows on its suffix links, itself included
        order = sorted(range(len(self.length)), key=self.length.__getitem__)
        self.marked = [-1] * len(self.length)
        for s in order:
            self.marked[s] = s if s in self.windows else self.marked[self.link[s]] if s else -1
        self.shortest = min((n for by in self.windows.values() for n in by), default=0)

    def step(self, state: int, depth: int, c: int) -> tuple[int, int]:
        """The state and the length of the longest match after one more letter."""
        while state and c not in self.next[state]:
            state = self.link[state]
            depth = self.length[state]
        to = self.next[state].get(c)
        return (0, 0) if to is None else (to, depth + 1)

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set, int]:
        """Maximal spans [start, end) of hit words, the items with a window here, the longest match in words."""
        spans: list[tuple[int, int]] = []
        items: set = set()
        longest = 0
        if not self.shortest or not words:
            return spans, items, longest
        get = self.ids.get
        codes = np.fromiter((get(w, -1) for w in words), dtype=np.int64, count=len(words))
        stretches = self._stretches(codes)
        for start, end in stretches:
            if end - start < self.shortest:
                continue
            state = depth = 0
            for i, c in enumerate(codes[start:end].tolist(), start):
                state, depth = self.step(state, depth, c)
                longest = max(longest, depth)
                at = self.marked[state]
                while at > 0:
                    for size, who in self.windows[at].items():
                        if size <= depth:
                            items |= who
                            _add(spans, i + 1 - size, i + 1)
                    at = self.marked[self.link[at]]
        for start, end in sorted((s for s in stretches if s[1] - s[0] < self.shortest), key=lambda s: s[0] - s[1]):
            if end - start <= longest:
                break  # no shorter stretch holds a longer match
            state = depth = 0
            for c in codes[start:end].tolist():
                state, depth = self.step(state, depth, c)
                longest = max(longest, depth)
        return spans, items, longest

    def _stretches(self, codes: np.ndarray) -> list[tuple[int, int]]:
        """Maximal runs of known words joined by known pairs."""
        known = codes >= 0
        joined = known[:-1] & known[1:]
        at = np.flatnonzero(joined)
        if len(at) and len(self.pairs):
            code = codes[at] * len(self.ids) + codes[at + 1]
            where = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
            joined[at] = self.pairs[where] == code
        else:
            joined[:] = False
        # a run of n joined pairs is a run of n + 1 words; single known words are runs as well
        breaks = np.flatnonzero(~joined) + 1
        starts = np.concatenate(([0], breaks))
        ends = np.concatenate((breaks, [len(codes)]))
        good = known[starts]
        return list(zip(starts[good].tolist(), ends[good].tolist(), strict=True))


def _add(spans: list[tuple[int, int]], start: int, end: int) -> None:
    """Merge a span in; spans come in the order of their ends."""
    while spans and spans[-1][1] >= start:
        start = min(start, spans.pop()[0])
    spans.append((start, end))


def _item_words() -> Column:
    return F.coalesce(F.regexp_count(F.col("text"), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")), F.lit(0))


def build_automaton(benchmark: DataFrame, params: DecontaminationParams = DecontaminationParams()) -> ItemAutomaton:
    """One automaton of a benchmark that fits into one, which is checked before it is brought to the driver."""
    words = benchmark.select(F.coalesce(F.sum(_item_words()), F.lit(0))).first()[0]
    if words > params.max_item_words:
        raise ValueError(f"the benchmark has {words} words; max_item_words is {params.max_item_words}")
    return next(automata(benchmark, params))


def automata(benchmark: DataFrame, params: DecontaminationParams = DecontaminationParams()) -> Iterator[ItemAutomaton]:
    """Automata of at most ``max_item_words`` words each that together have all windows, at least one; the driver holds one
    at a time."""
    group, size, any_yet = [], 0, False
    most = max(params.max_item_words, 2 * params.window)
    rows = benchmark.select("item_id", F.col("text").cast("binary").alias("text")).toLocalIterator()
    for item, text in rows:
        words = alnum_words(bytes(text) if text is not None else None)
        for start in range(0, max(1, len(words) - params.window + 1), most - params.window + 1):
            part = words[start : start + most]
            if group and size + len(part) > most:
                yield ItemAutomaton(group, params.window)
                group, size, any_yet = [], 0, True
            group.append((item, part))
            size += len(part)
    if group or not any_yet:
        yield ItemAutomaton(group, params.window)


def _scanned(docs: DataFrame, automaton: ItemAutomaton) -> DataFrame:
    """The columns of ``docs`` but text, with n_words, longest, item_ids (as strings) and spans of hit words [start, end)."""
    shared = shipped(docs.sparkSession, automaton)
    carried = [c for c in docs.columns if c != "text"]

    def look(batch: dict[str, list]) -> dict[str, list]:
        out = {c: batch[c] for c in carried} | {c: [] for c in ("n_words", "longest", "item_ids", "spans")}
        for text in batch["text"]:
            words = alnum_words(text)
            spans, items, longest = shared().scan(words)
            out["n_words"].append(len(words))
            out["longest"].append(longest)
            out["item_ids"].append(sorted(str(i) for i in items if i is not None))
            out["spans"].append([{"start": a, "end": b} for a, b in spans])
        return out

    fields = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in carried)
    rows = docs.select(*carried, F.col("text").cast("binary").alias("text"))
    return map_batches(rows, look, f"{fields}n_words long, longest long, item_ids array<string>, spans array<struct<start: long, end: long>>")


def merged(spans: Column) -> Column:
    """Spans united where they meet, in order."""
    start = F.expr("cast(array() as array<struct<start: bigint, end: bigint>>)")

    def add(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        wider = F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end")))
        meets = (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= x["start"])
        return F.when(meets, F.concat(F.slice(done, 1, F.size(done) - 1), wider)).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(F.array_sort(spans), start, add)


def _found(docs: DataFrame, benchmark: DataFrame, params: DecontaminationParams) -> DataFrame | None:
    """doc_id, t, u (hashes of the text), longest, item_ids and spans of every text that any of several automata hits; None if
    there is one automaton only."""
    some = automata(benchmark, params)
    first, second = next(some), next(some, None)
    if second is None:
        return None
    rows = docs.select("doc_id", F.xxhash64("text").alias("t"), F.hash("text").alias("u"), "text")
    parts = [written(_scanned(rows, a).filter("longest > 0").drop("n_words").distinct(), "benchmark-hits") for a in chain((first, second), some)]
    every = reduce(DataFrame.union, parts)
    united = every.groupBy("doc_id", "t", "u").agg(
        F.max("longest").alias("longest"),
        # at most one list a part: bounded by the number of automata and the length of one text
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"),
        merged(F.flatten(F.collect_list("spans"))).alias("spans"),
    )
    out = written(united, "benchmark-found")
    discard(*parts)
    return out


def _with_found(docs: DataFrame, found: DataFrame, *wanted: str) -> tuple[DataFrame, str]:
    """``docs`` with a struct of the wanted columns of ``found`` by (doc_id, text), and its name."""
    i, t, u, name = (free_name(docs, n) for n in ("found_id", "found_t", "found_u", "found"))
    there = found.select(F.col("doc_id").alias(i), F.col("t").alias(t), F.col("u").alias(u), F.struct(*wanted).alias(name))
    same = F.col("doc_id").eqNullSafe(F.col(i)) & (F.xxhash64("text") == F.col(t)) & (F.hash("text") == F.col(u))
    return docs.join(there, same, "left").select(*docs.columns, name), name


def _hit(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])


def matches(docs: DataFrame, benchmark: DataFrame, params: DecontaminationParams = DecontaminationParams()) -> DataFrame:
    """doc_id, n_words, n_hit, longest (the longest match in words, with any part of an item that was cut), item_ids (as strings),
    spans of hit words [start, end)."""
    rows = docs.select("doc_id", "text")
    found = _found(rows, benchmark, params)
    if found is None:
        got = _scanned(rows, next(automata(benchmark, params)))
    else:
        got = _with_found(rows, found, "longest", "item_ids", "spans")[0].select(
            "doc_id",
            _item_words().cast("long").alias("n_words"),
            F.coalesce("found.longest", F.lit(0)).alias("longest"),
            F.coalesce("found.item_ids", F.array().cast("array<string>")).alias("item_ids"),
            F.coalesce("found.spans", F.expr("cast(array() as array<struct<start: bigint, end: bigint>>)")).alias("spans"),
        )
    return got.select("doc_id", "n_words", _hit(F.col("spans")).alias("n_hit"), "longest", "item_ids", "spans")


def clean(docs: DataFrame, benchmark: DataFrame, params: DecontaminationParams = DecontaminationParams()) -> DataFrame:
    """``docs`` with hit spans cut out of ``text``; ``n_words``, ``n_hit`` and ``dropped`` beside it."""
    outputs = "n_words", "n_hit", "dropped"
    rest = others(docs, *outputs)
    found = _found(docs, benchmark, params)
    if found is None:
        shared = shipped(docs.sparkSession, next(automata(benchmark, params)))
        rows, told = docs.select(*rest), ""
    else:
        shared = None
        rows, told = _with_found(docs.select(*rest), found, "spans")

    def cut(batch: dict[str, list]) -> dict[str, list]:
        out = {c: batch[c] for c in rest} | {c: [] for c in outputs} | {"text": []}
        for i, text in enumerate(batch["text"]):
            words = alnum_words(text.encode() if text is not None else None)
            spans = shared().scan(words)[0] if shared else [(s["start"], s["end"]) for s in (batch[told][i] or {"spans": []})["spans"]]
            hit = sum(b - a for a, b in spans)
            out["text"].append(remove_spans(text, [s for s in spans if s[1] - s[0] >= params.min_span]))
            out["n_words"].append(len(words))
            out["n_hit"].append(hit)
            out["dropped"].append(hit > params.max_coverage * len(words))
        return out

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest)
    return map_batches(rows, cut, f"{fields}, n_words long, n_hit long, dropped boolean")


def remove_spans(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """``text`` without the words of the spans and what stands between them."""
    if not spans:
        return text
    raw = text.encode()
    at = [m.span() for m in _WORDS.finditer(raw)]
    out, done = [], 0
    for start, end in spans:
        out.append(raw[done : at[start][0]])
        done = at[end - 1][1]
    return b"".join([*out, raw[done:]]).decode()
