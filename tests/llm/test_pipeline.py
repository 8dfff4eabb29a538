"""Every stage of the corpus pipeline against a brute-force version over the same input."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest
import xxhash

import corpus_pipeline
from paceline.llm import mixing, queries
from paceline.llm.quality import QualityParams
from test_text_operators import brute_base, brute_components, brute_hits

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def buckets(text, n):
    words = [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    one = [xxhash.xxh64_intdigest(w, 42) for w in words]
    two = [xxhash.xxh64_intdigest(w, h) for h, w in zip(one, words[1:], strict=False)]
    return [signed(h) % n for h in one + two]


def brute_quality(docs, labels):
    p = QualityParams()
    trusted = {r["doc_id"] for r in labels if r["quality"] == 1}
    grams = {r["doc_id"]: buckets(r["text"], p.buckets) for r in docs}
    raw = Counter(b for g in grams.values() for b in g)
    target = Counter(b for i, g in grams.items() if i in trusted for b in g)
    n_raw, n_target = sum(raw.values()) + p.buckets, sum(target.values())
    weight = [math.log((target[b] * n_raw / (raw[b] + 1) + p.prior) / (n_target + p.prior)) for b in range(p.buckets)]
    kept = set()
    for r in docs:
        n, *_, repeated = brute_base(r["text"])
        g = grams[r["doc_id"]]
        if n >= 50 and 100 * repeated <= 50 * n and sum(weight[b] for b in g) / len(g) >= p.threshold:
            kept.add(r["doc_id"])
    return kept


def brute_lines(docs):
    norm = lambda x: re.sub(r"[\x20\x09-\x0D]+", " ", x.lower()).strip(" ")
    sites, first = defaultdict(set), {}
    for r in docs:
        for line in map(norm, (r["text"] or "").split("\n")):
            if len(line.split(" ")) >= 3:
                sites[line].add(r["source"])
                first[line] = min(first.get(line, r["doc_id"]), r["doc_id"])
    out = {}
    for r in docs:
        lines = r["text"].split("\n")
        left = [x for x in lines if len(sites.get(norm(x), ())) < 3 or first[norm(x)] == r["doc_id"]]
        if len(left) == len(lines) or re.search(r"[^\x20\x09-\x0D]", "\n".join(left)):
            out[r["doc_id"]] = "\n".join(left)
    return out


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c < "\x80" else c for c in text or ""))


def brute_mix(docs):
    sizes = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in docs}
    by = defaultdict(list)
    for r in docs:
        by[r["source"]].append(r["doc_id"])
    names = sorted(by, key=lambda s: (s is None, s))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total = {s: sum(sizes[i] for i in by[s]) for s in names}
    target, open_ = {}, set(names)
    while True:
        left = sum(total.values()) - sum(target.values())
        share = {s: left * weight[s] / sum(weight[t] for t in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * total[s]}
        if not over:
            target |= share
            break
        target |= {s: 3.0 * total[s] for s in over}
        open_ -= over
    taken = {}
    for s in names:
        copies = math.floor(target[s] / total[s] + 1e-12)
        budget, before, full = target[s] - copies * total[s], 0, False
        for i in sorted(by[s], key=lambda i: hashlib.md5(str(i).encode()).hexdigest()[:12]):
            if not full and before + sizes[i] > budget:
                full = True
                extra = budget - before >= before + sizes[i] - budget and sizes[i] > 0
            else:
                extra = not full
            before += sizes[i]
            taken[i] = sizes[i] * (copies + extra)
    return {i: t for i, t in taken.items() if t}


@pytest.fixture(scope="module")
def staged(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = corpus_pipeline.written(stage(spark, docs, SF), "test-stage")
        out.append((name, before, docs))
    return out


def test_stage_order_and_columns(staged):
    assert [s[0] for s in staged] == ["quality rules", "line dedup", "near-dedup", "decontamination", "source mixing"]
    assert all(s[2].columns == COLUMNS for s in staged[:-1]) and staged[-1][2].columns[:5] == COLUMNS


def test_quality_stage(spark, staged):
    _, before, after = staged[0]
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    assert {r["doc_id"] for r in after.collect()} == brute_quality(before, labels)


def test_line_stage(staged):
    _, before, after = staged[1]
    assert {r["doc_id"]: r["text"] for r in after.collect()} == brute_lines(before)


def test_near_dedup_stage(staged):
    _, before, after = staged[2]
    lower = lambda t: "".join(c.lower() if c < "\x80" else c for c in t)
    want = brute_components([(r["doc_id"], " ".join(re.findall(r"[^\x20\x09-\x0D]+", lower(r["text"])))) for r in before])
    assert {r["doc_id"] for r in after.collect()} == {i for i, (_, c) in want.items() if c == i}


def test_decontamination_stage(spark, staged):
    _, before, after = staged[3]
    items = [(r["item_id"], alnum(r["text"])) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {r["doc_id"]: r["text"] for r in after.collect()}
    for r in before:
        words = alnum(r["text"])
        hit, _ = brute_hits(words, items)
        if len(hit) > 0.5 * len(words):
            assert r["doc_id"] not in got
        else:
            assert alnum(got[r["doc_id"]]) == [w for i, w in enumerate(words) if i not in hit]


def test_mixing_stage(staged):
    _, before, after = staged[4]
    assert {r["doc_id"]: r["taken"] for r in after.collect()} == brute_mix(before)


def test_run_gives_the_last_stage(spark, staged):
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()) == sorted(r["doc_id"] for r in staged[-1][2].collect())


def test_every_operator_has_one_query():
    assert [sum(q.startswith(f"op{n}_") for q in queries.queries()) for n in range(1, 11)] == [1] * 10
    assert set(queries.oracle_sql()) <= set(queries.queries())
    assert mixing.MixParams().levels * mixing.MixParams().bits == 48
