"""Vector codes, importance resampling and retrieval packing against plain versions, and their odd inputs."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from paceline.llm import oracles, packing, queries, resample, vectors
from test_pipeline import alnum

SF = "/root/testdata/sf0.001"


# ---- 11 vector codes


def brute_codes(rows, params):
    """(code and error by place, codebooks) with Python integers; rows: (vec_id, vector) of one length, in order of ids."""
    whole = [[math.floor(params.scale * x) for x in v] for _, v in rows]
    size = len(whole[0]) // params.parts
    cut = lambda v, p: v[p * size : (p + 1) * size]
    books = [[cut(v, p) for v in whole[: params.entries]] for p in range(params.parts)]
    near = lambda y, book: min((sum((a - b) ** 2 for a, b in zip(y, c, strict=True)), k) for k, c in enumerate(book))
    for _ in range(params.rounds):
        for p in range(params.parts):
            groups = {}
            for v in whole:
                groups.setdefault(near(cut(v, p), books[p])[1], []).append(cut(v, p))
            books[p] = [[sum(c) // len(groups[k]) for c in zip(*groups[k], strict=True)] if k in groups else old for k, old in enumerate(books[p])]
    coded = [[near(cut(v, p), books[p]) for p in range(params.parts)] for v in whole]
    return [("".join(f"{k:02x}" for _, k in c), sum(d for d, _ in c)) for c in coded], books


def vec_frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_vector_codes_match_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(0, 0.2, 8)], int(i % 3) if i % 5 else None) for i in range(120)]
    rows += [(200 + i, rows[7][1], 1) for i in range(30)]  # copies
    params = vectors.CodeParams(entries=16, rows=37, block=1)
    got, books = vectors.compress(vec_frame(spark, rows).repartition(5), params)
    want, brute = brute_codes([(i, v) for i, v, _ in rows], params)
    assert books.tolist() == brute
    by = {r["vec_id"]: r for r in got.collect()}
    assert [(by[i]["code"], by[i]["error"]) for i, _, _ in rows] == want
    label = Counter()
    for (_, _, y), (_, e) in zip(rows, want, strict=True):
        label[y] += e
    assert all(by[i]["label_error"] == label[y] for i, _, y in rows)
    text = ",".join(str(c) for part in brute for entry in part for c in entry)
    assert {r["codebooks_sha256"] for r in by.values()} == {hashlib.sha256(text.encode()).hexdigest()}


def test_vector_codes_of_odd_rows(spark):
    ok = [0.5, -0.25, 0.125, 1.0]
    rows = [(1, ok, 1), (1, ok, 1), (None, ok, None), (2, None, 1), (3, [0.5, None, 0.0, 1.0], 1), (4, [float("nan"), 0.0, 0.0, 0.0], 1), (5, [float("inf"), 0.0, 0.0, 0.0], 1),
            (6, [], 2), (7, [0.0] * 8, 2), (8, [1e30, -1e30, 0.0, 0.0], 3)]
    frame = vec_frame(spark, rows).withColumns({"code": F.lit("mine"), "integers": F.lit("kept"), "key_of_label": F.lit(7)})
    got, books = vectors.compress(frame)
    out = sorted(got.collect(), key=lambda r: (r["vec_id"] is None, r["vec_id"] or 0))
    assert [r["vec_id"] for r in out] == [1, 1, 6, 7, 8, None] and {r["integers"] for r in out} == {"kept"} and {r["key_of_label"] for r in out} == {7}
    by = {r["vec_id"]: r for r in out}
    assert by[1]["code"] == "00000000" and by[1]["error"] == 0 and by[6]["code"] is None and by[7]["error"] is None and by[6]["label_error"] is None
    assert books.shape == (4, 4, 1) and by[8]["error"] == 0  # held at the bound
    nothing, none = vectors.compress(vec_frame(spark, []))
    assert nothing.count() == 0 and none.size == 0
    assert [r["code"] for r in vectors.compress(vec_frame(spark, [(1, [0.5, 0.5], 1)]))[0].collect()] == [None]


# ---- 12 importance resampling


def brute_resample(docs, target, params):
    """{place: (n_features, weight, score)} and the places drawn, in order."""
    def features(text):
        w = alnum(text)
        return [*w, *(a + " " + b for a, b in zip(w, w[1:], strict=False))]

    bucket = lambda g: zlib.crc32(g.encode()) % params.buckets
    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(map(bucket, features(x)))
    for x in target:
        t.update(map(bucket, features(x)))
    n, top, low = params.buckets, sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (top + n) / ((s[b] + 1) * (low + n))))
    out = {}
    for place, (i, x) in enumerate(docs):
        f = features(x)
        weight = sum(gain(bucket(g)) for g in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{params.seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out[place] = len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
    able = [p for p in out if (out[p][0] + 1) // 2 >= params.min_words and out[p][0]]
    order = sorted(able, key=lambda p: (-out[p][2], docs[p][0] is None, docs[p][0] or 0, out[p][0]))
    return out, order[: params.share * len(able) // 100]


def test_resampling_matches_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want, drawn = brute_resample(docs, target, resample.ResampleParams())
    got = {r["doc_id"]: r for r in queries.op12_importance_resampling(spark, SF).collect()}
    assert len(got) == len(docs)
    for place, (i, _) in enumerate(docs):
        assert (got[i]["n_features"], got[i]["weight"], got[i]["score"]) == want[place]
        assert got[i]["rank"] == (drawn.index(place) + 1 if place in drawn else None)


def test_the_dictionary_holds_every_feature_once(spark):
    texts = ["a b a b c", "a  bİ é, A-b 9", None, "", "!!", "the the the", "x " * 3000]
    params = resample.ResampleParams(parts=8, salts=3, words=7)  # many batches
    want = Counter()
    for x in texts:
        w = alnum(x)
        want.update([*w, *(a + " " + b for a, b in zip(w, w[1:], strict=False))])
    got = resample.dictionary(spark.createDataFrame([(x,) for x in texts], "text string").repartition(3), params).collect()
    assert len(got) == len({r["feature"] for r in got}) and {r["feature"]: r["n"] for r in got} == want
    assert all(r["bucket"] == zlib.crc32(r["feature"].encode()) % params.buckets for r in got)


def test_resampling_of_odd_rows(spark):
    many = "word " * 25
    rows = [(1, many, "x"), (1, many, "x"), (None, many, "y"), (None, None, "z"), (2, "", None), (3, "?!", "x"), (4, "short text", "x"), (5, "long " * 20_000, "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, score string").withColumns({"part": F.lit(1), "place": F.lit("p")})
    params = resample.ResampleParams(share=50, words=30)
    want, drawn = brute_resample([(i, x) for i, x, _ in rows], ["word word"], params)
    out = resample.resample(frame, spark.createDataFrame([("word word",)], "text string"), params).collect()
    assert len(out) == 8 and {r["place"] for r in out} == {"p"}
    assert sorted((r["n_features"], r["weight"], r["score"]) for r in out) == sorted(want.values())
    assert sorted(r["rank"] for r in out if r["rank"]) == [1, 2] and len(drawn) == 2
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert resample.resample(empty, empty.select("text")).count() == 0 and resample.resample(frame, empty.select("text")).count() == 8


# ---- 13 packing


def checked(rows, docs, window=1024):
    """The pieces hold every id of every document once, sequences are gapless, full or a power of two long; returns the sequences."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, got, sequences = Counter(), {}, {}
    for i, text in docs:
        ids = (*tokenizer.encode(text or "", add_special_tokens=False).ids, 0)
        want[i, ids] += 1
    for r in rows:
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and len(r["ids"]) == r["length"]
        got.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    for (i, ids), n in want.items():
        pieces = [r for r in got[i] if r["doc_tokens"] == len(ids)]
        held = Counter()
        for r in pieces:
            if r["ids"] == list(ids[r["start"] : r["start"] + r["length"]]):
                held.update(range(r["start"], r["start"] + r["length"]))
        assert all(held[k] >= n for k in range(len(ids)))
    assert sum(r["length"] for r in rows) == sum(len(ids) * n for (_, ids), n in want.items())
    for some in sequences.values():
        at = 0
        for r in sorted(some, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= window and (at == window or at & (at - 1) == 0)
    return sequences


def test_packing_holds_every_id_once_without_padding(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    rows = packing.pack(docs).collect()
    checked(rows, texts)
    thin = {(r["doc_id"], r["start"]): r for r in queries.op13_retrieval_packing(spark, SF).collect()}
    assert all("ids" not in r.__fields__ for r in thin.values()) and {k: (r["length"], r["ids_crc32"]) for k, r in thin.items()} == {(r["doc_id"], r["start"]): (r["length"], r["ids_crc32"]) for r in rows}


def test_packing_of_odd_rows(spark):
    rows = [(1, "same text"), (1, "same text"), (None, "no id"), (None, None), (2, None), (3, ""), (4, "a <|endoftext|> b"), (5, "long words " * 20_000), (6, "x" * 5000), (7, "é \x00 z"), (8, "word " * 1023)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"first": F.lit(1), "tail": F.lit("t"), "tokens": F.lit(2)})
    checked(packing.pack(frame, packing.PackParams(shard_tokens=600)).collect(), rows)
    small = packing.pack(frame, packing.PackParams(window=16)).collect()
    checked(small, rows, 16)
    assert packing.pack(frame.limit(0)).count() == 0


def test_the_index_ranks_as_bm25_says(spark):
    rng, params = np.random.default_rng(2), packing.PackParams()
    docs = [rng.integers(0, 60, int(n)) ** 2 for n in rng.integers(5, 80, 50)]
    terms, counts = zip(*(np.unique(d, return_counts=True) for d in docs), strict=True)
    mean = float(np.mean([len(d) for d in docs]))
    df = Counter(int(t) for some in terms for t in some)
    idf = {t: math.log(1 + (50 - n + 0.5) / (n + 0.5)) for t, n in df.items()}
    weights = [packing.bm25(c.astype(float), len(d), mean, params) * np.array([idf[int(t)] for t in some]) for some, c, d in zip(terms, counts, docs, strict=True)]
    index = packing.Index(list(range(50)), list(terms), weights)
    for q in (0, 7):
        want = []
        for d in docs:
            tf = Counter(d.tolist())
            want.append(sum(idf[t] * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(d) / mean)) for t in terms[q].tolist() if t in tf))
        assert index.scores(terms[q]) == pytest.approx(want, rel=1e-5)


def test_windows_take_the_best_unused_neighbours_and_cut_the_last():
    terms = [np.array(x) for x in ([1, 2], [5, 6], [1, 2], [1, 9], [5, 8])]
    weights = [np.ones(len(t)) for t in terms]
    got = list(packing.pack_shard([4, 4, 3, 4, 4], terms, weights, 8))
    assert got[0] == [(0, 0, 4), (2, 0, 3), (3, 0, 1)]  # both terms, then one, cut
    assert got[1][0] == (3, 1, 3) and sum(n for *_, n in got[1]) == 8  # its rest seeds the next
    assert sorted(len(s) and sum(n for *_, n in s) for s in got) == [1, 2, 8, 8] and sum(n for s in got for *_, n in s) == 19


def test_neighbours_share_windows(spark):
    """Documents of a topic, dealt at random, meet in windows far more often than by chance."""
    rng = np.random.default_rng(4)
    words = [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in "nrstz"]
    topics = [rng.choice(words, 40, replace=False) for _ in range(12)]
    rows = [(int(i), " ".join(rng.choice(topics[i % 12], 120))) for i in rng.permutation(240)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    seen = {}
    for r in packing.pack(frame).collect():
        seen.setdefault(r["sequence_id"], set()).add(r["doc_id"] % 12)
    share = np.mean([1 / len(s) for s in seen.values()])
    assert share > 0.6  # by chance windows of about five documents hold four topics


def test_new_oracles_are_registered():
    assert {"op11_vector_codes", "op12_importance_resampling"} <= set(queries.oracle_sql()) and "op13_retrieval_packing" in queries.queries() and oracles.OP11.count("AS MATERIALIZED") > 10
