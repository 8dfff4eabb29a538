"""Toxicity: gradient-boosted trees over a few dense features, with isotonic calibration.

The features of a text are densities over its words and characters: lexicon terms (plain, best term, obfuscated,
next to a second-person word), capitals, punctuation, digits and marks inside words, elongations, and others.  The lexicon is
learnt from the labelled rows: words whose share among toxic documents exceeds that among the others
by far; a word that reads like a term once digits and marks are mapped back to letters is obfuscated.

Learning takes at most ``train_rows`` labelled documents, in the order of a hash of the doc_id.  In folds, the lexicon of
the other folds gives the features of each, so that the trees see the lexicon as unseen texts do, and
out-of-fold scores calibrate.  Words are counted and features computed where the texts are: the driver gets the
terms of each lexicon and one row of features a document.  Scoring is a map over all documents.

Calibration is centred isotonic regression: pooled adjacent violators, joined by straight lines between the centres of the
blocks, so that it rises wherever it can and ties only outside the outermost centres.

Defined cases: null and empty texts have zero features and get the score of those; without labelled rows of both kinds the
score is the share of toxic rows, or 0; labels of null are ignored, of repeated doc_ids the highest counts, and of several
texts with one doc_id that of the smallest hash is learnt from; very long texts are read whole, in time linear in their length;
repeated rows are each scored; an empty table gives an empty result; only doc_id is carried.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paceline.llm.common import discard, map_batches, shipped, written


@dataclass(frozen=True)
class ToxicParams:
    train_rows: int = 12_000
    lexicon_size: int = 200
    min_documents: int = 4
    min_log_odds: float = 1.5
    trees: int = 80
    depth: int = 3
    rate: float = 0.15
    bins: int = 32
    min_leaf: int = 10
    folds: int = 4


#: Second-person words of the four languages of the corpus.
SECOND_PERSON = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch sie usted tú ti tus su".split())
#: Marks and digits that stand for letters.
LEET = str.maketrans("013457@$!|", "oieastasil")
_WORD = re.compile(r"[^\s]+")
_EDGE = ".,;:!?\"'()[]{}«»-"
_INNER = re.compile(r"[^\W\d_][\W\d_]+[^\W\d_]", re.UNICODE)
_LONG = re.compile(r"(.)\1\1")

FEATURES = (
    "terms", "term_share", "best_term", "hidden_terms", "near_second", "second", "caps", "shouted", "exclaim", "question",
    "punctuation", "digits", "inner_marks", "elongated", "length", "type_share",
)


def fold_word(word: str) -> str:
    """A word as the lexicon has it: lower case, without marks at its ends."""
    return word.strip(_EDGE).lower()


def unmask(word: str) -> str:
    """A word with stand-ins mapped back, inner marks dropped and repeats squeezed to one letter."""
    plain = "".join(c for c in word.translate(LEET) if c.isalpha())
    return re.sub(r"(.)\1+", r"\1", plain)


@dataclass
class Lexicon:
    """Terms with their log odds, and the same terms unmasked."""

    odds: dict[str, float] = field(default_factory=dict)
    bare: dict[str, float] = field(default_factory=dict)

    @classmethod
    def of(cls, terms: dict[str, float]) -> Lexicon:
        bare: dict[str, float] = {}
        for w, o in terms.items():
            if len(b := unmask(w)) >= 4:
                bare[b] = max(o, bare.get(b, 0.0))
        return cls(terms, bare)

    def features(self, text: str | None) -> list[float]:
        raw = _WORD.findall(text) if text else []
        if not raw:
            return [0.0] * len(FEATURES)
        words = [w.strip(_EDGE).lower() for w in raw]
        n, chars = len(words), len(text)
        odds = self.odds
        terms = [i for i, w in enumerate(words) if w in odds]
        distinct = Counter(words)
        hidden = sum(k for w, k in distinct.items() if w not in odds and self._masked(w))
        second = [i for i, w in enumerate(words) if w in SECOND_PERSON]
        near = 0
        if terms and second:
            at = np.array(second)
            where = np.searchsorted(at, terms)
            left = np.abs(at[np.maximum(where - 1, 0)] - terms)
            right = np.abs(at[np.minimum(where, len(at) - 1)] - terms)
            near = int((np.minimum(left, right) <= 5).sum())
        upper = sum(map(str.isupper, text))
        letters = max(1, sum(map(str.isalpha, text)))
        marks = sum(text.count(c) for c in ".,;:!?#*$%&|<>@")
        return [
            float(len(terms)), len(terms) / n, max((odds[words[i]] for i in terms), default=0.0), float(hidden), float(near),
            len(second) / n, upper / letters, sum(1 for w in raw if len(w) > 2 and w.isupper()) / n,
            text.count("!") / n, text.count("?") / n, marks / chars, sum(map(text.count, "0123456789")) / chars,
            sum(1 for w in distinct if not w.isalpha() and _INNER.search(w)) / n, sum(1 for w in distinct if _LONG.search(w)) / n,
            math.log1p(n), len(distinct) / n,
        ]

    def _masked(self, word: str) -> bool:
        return (not word.isalpha() or bool(_LONG.search(word))) and unmask(word) in self.bare


def _grow(bins: np.ndarray, grad: np.ndarray, hess: np.ndarray, params: ToxicParams) -> list[tuple]:
    """One tree over binned features as nodes (feature, bin, left, right, value); a leaf has feature -1."""
    nodes: list[tuple] = []

    def build(rows: np.ndarray, depth: int) -> int:
        g, h = grad[rows].sum(), hess[rows].sum()
        here = len(nodes)
        nodes.append((-1, 0, 0, 0, -params.rate * g / (h + 1.0)))
        best = (1e-6, -1, 0)
        if depth and len(rows) >= 2 * params.min_leaf:
            for f in range(bins.shape[1]):
                b = bins[rows, f]
                gs, hs, ns = (np.bincount(b, w, params.bins).cumsum() for w in (grad[rows], hess[rows], None))
                gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
                gain[(ns < params.min_leaf) | (len(rows) - ns < params.min_leaf)] = 0
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], f, k)
        if best[1] >= 0:
            go = bins[rows, best[1]] <= best[2]
            left, right = build(rows[go], depth - 1), build(rows[~go], depth - 1)
            nodes[here] = (best[1], best[2], left, right, 0.0)
        return here

    build(np.arange(len(bins)), params.depth)
    return nodes


@dataclass
class BoostedTrees:
    """Logistic boosting with second-order leaf values over quantile bins."""

    edges: list[np.ndarray]
    base: float
    trees: list[list[tuple]]

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, params: ToxicParams) -> BoostedTrees:
        quantiles = np.linspace(0, 1, params.bins + 1)[1:-1]
        edges = [np.unique(np.quantile(x[:, f], quantiles)) for f in range(x.shape[1])]
        share = min(max(float(y.mean()), 1e-4), 1 - 1e-4)
        model = cls(edges, math.log(share / (1 - share)), [])
        bins, margin = model._bins(x), np.full(len(x), model.base)
        for _ in range(params.trees):
            p = 1 / (1 + np.exp(-margin))
            tree = _grow(bins, p - y, p * (1 - p), params)
            model.trees.append(tree)
            margin += _walk(tree, bins)
        return model

    def _bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(self.edges)], axis=1)

    def margin(self, x: np.ndarray) -> np.ndarray:
        bins = self._bins(x)
        return self.base + sum((_walk(t, bins) for t in self.trees), np.zeros(len(x)))


def _walk(tree: list[tuple], bins: np.ndarray) -> np.ndarray:
    feature, cut, left, right = (np.array([n[i] for n in tree]) for i in range(4))
    value = np.array([n[4] for n in tree])
    at = np.zeros(len(bins), dtype=np.int64)
    rows = np.arange(len(bins))
    while (feature[at] >= 0).any():
        inner = feature[at] >= 0
        go = bins[rows, np.maximum(feature[at], 0)] <= cut[at]
        at = np.where(inner, np.where(go, left[at], right[at]), at)
    return value[at]


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centred isotonic regression: knots (mean score of a pooled block, probability) for linear interpolation."""
    blocks: list[list[float]] = []  # sum of y, weight, sum of scores, lowest score
    for s, v in sorted(zip(score.tolist(), y.tolist(), strict=True)):
        blocks.append([v, 1.0, s, s])
        while len(blocks) > 1 and (blocks[-2][3] == blocks[-1][3] or blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]):
            top = blocks.pop()
            blocks[-1] = [blocks[-1][0] + top[0], blocks[-1][1] + top[1], blocks[-1][2] + top[2], blocks[-1][3]]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


@dataclass
class ToxicModel:
    lexicon: Lexicon
    trees: BoostedTrees | None
    knots: tuple[np.ndarray, np.ndarray]
    share: float

    def scores(self, texts: list[str | None]) -> list[float]:
        if self.trees is None:
            return [self.share] * len(texts)
        margin = self.trees.margin(np.array([self.lexicon.features(t) for t in texts]))
        return np.interp(margin, *self.knots).tolist()


def train(docs: DataFrame, labels: DataFrame, params: ToxicParams = ToxicParams()) -> ToxicModel:
    """Learn from the rows of ``labels`` (doc_id, toxic) and their texts, at most ``train_rows`` of them."""
    h = F.xxhash64("doc_id")
    chosen = (
        labels.filter("toxic is not null and doc_id is not null")
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(h, "doc_id")
        .limit(params.train_rows)
    )
    known = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most train_rows ids
    one = known.groupBy("doc_id", "toxic").agg(F.min_by(F.coalesce("text", F.lit("")), F.xxhash64("text")).alias("text"))
    rows = written(one.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(params.folds)).cast("int")), "toxic-train")
    sizes = {(r["fold"], r["toxic"]): r["count"] for r in rows.groupBy("fold", (F.col("toxic") > 0).cast("int").alias("toxic")).count().collect()}
    bad, good = (sum(n for (_, t), n in sizes.items() if t == y) for y in (1, 0))
    if not bad or not good:
        discard(rows)
        return ToxicModel(Lexicon(), None, (np.zeros(1), np.zeros(1)), 1.0 if bad else 0.0)
    lexicons = _lexicons(rows, sizes, params)
    x, y, fold = _train_features(rows, lexicons, params)
    discard(rows)
    margin = np.zeros(len(y))
    for k in range(params.folds):
        rest = fold != k
        if not rest.all():
            margin[~rest] = BoostedTrees.fit(x[rest], y[rest], params).margin(x[~rest])
    return ToxicModel(lexicons[params.folds], BoostedTrees.fit(x, y, params), isotonic(margin, y), float(y.mean()))


def _lexicons(rows: DataFrame, sizes: dict[tuple[int, int], int], params: ToxicParams) -> list[Lexicon]:
    """For each fold the lexicon of the others, and then that of all: the words that explain most toxic documents."""

    def words(batch: dict[str, list]) -> dict[str, list]:
        found = [sorted({fold_word(w) for w in _WORD.findall(t)} - {""}) for t in batch["text"]]
        return {"fold": batch["fold"], "toxic": batch["toxic"], "words": found}

    told = map_batches(rows.select("fold", "toxic", "text"), words, "fold int, toxic int, words array<string>")
    once = told.select("fold", (F.col("toxic") > 0).alias("bad"), F.explode("words").alias("word"))
    of = lambda k, bad: F.count_if((F.col("fold") != k) & (F.col("bad") == bad))
    variants = range(params.folds + 1)
    counts = once.groupBy("word").agg(
        F.array(*(F.struct(F.lit(k).alias("k"), of(k, True).alias("bad"), of(k, False).alias("good")) for k in variants)).alias("by")
    )
    total = lambda k, y: max(1, sum(n for (f, t), n in sizes.items() if f != k and t == y))
    n_bad, n_good = (F.array(*(F.lit(float(total(k, y))) for k in variants)) for y in (1, 0))
    odds = F.log((F.col("bad") + 0.5) / (F.get(n_bad, F.col("k")) + 1)) - F.log((F.col("good") + 0.5) / (F.get(n_good, F.col("k")) + 1))
    terms = (
        counts.select("word", F.inline("by"))
        .filter(F.col("bad") >= params.min_documents)
        .withColumn("odds", odds)
        .filter(F.col("odds") >= params.min_log_odds)
        # by how many toxic documents a term explains, not by odds alone
        .withColumn("place", F.row_number().over(Window.partitionBy("k").orderBy((-F.col("bad") * F.col("odds")), "word")))
        .filter(F.col("place") <= params.lexicon_size)
    )
    found: list[dict[str, float]] = [{} for _ in variants]
    for r in terms.orderBy("k", "place").collect():  # at most lexicon_size rows for each
        found[r["k"]][r["word"]] = r["odds"]
    return [Lexicon.of(f) for f in found]


def _train_features(rows: DataFrame, lexicons: list[Lexicon], params: ToxicParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and folds, ordered by doc_id; at most train_rows rows of FEATURES numbers."""
    shared = shipped(rows.sparkSession, lexicons)

    def look(batch: dict[str, list]) -> dict[str, list]:
        found = [shared()[k].features(t) for k, t in zip(batch["fold"], batch["text"], strict=True)]
        return {"doc_id": batch["doc_id"], "fold": batch["fold"], "toxic": batch["toxic"], "x": found}

    kind = rows.schema["doc_id"].dataType.simpleString()
    got = sorted(map_batches(rows, look, f"doc_id {kind}, fold int, toxic int, x array<double>").collect(), key=lambda r: r["doc_id"])
    return np.array([r["x"] for r in got]), np.array([float(r["toxic"] > 0) for r in got]), np.array([r["fold"] for r in got])


def score(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """doc_id and score (0 to 1) of each row."""
    shared = shipped(docs.sparkSession, model)

    def look(batch: dict[str, list]) -> dict[str, list]:
        return {"doc_id": batch["doc_id"], "score": shared().scores(batch["text"])}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), look, f"doc_id {kind}, score double")
