"""Small cases of every operator: nulls, empty and repeated rows, clashing columns, and brute-force versions."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from paceline.llm import chat, decontaminate, langid, licenses, lines, mixing, neardup, quality, toxicity, urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


def rows_of(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice(["th", "er", "on", "an", "re", "he"]) for _ in range(rng.randint(1, 3))) for _ in range(400)]
    return lambda n, seed: " ".join(random.Random(seed).choices(vocabulary, k=n))


# ---- 1 line dedup


def test_line_spread_keeps_first_document(spark):
    boiler = "Subscribe to our weekly letter"
    rows = [(i, f"{boiler}\nown line number {i} here", f"s{i}") for i in (3, 1, 2)]
    rows += [(4, None, "s4"), (5, "", None), (6, boiler.upper() + "  ", None), (6, boiler, "s1"), (7, "two words", "s7")]
    got = lines.dedup_lines(docs_of(spark, rows).withColumn("N_Lines", F.lit("x"))).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert len(got) == len(rows)
    assert by[1][0]["text"].startswith(boiler) and by[1][0]["n_removed"] == 0
    assert by[2][0]["text"] == "own line number 2 here" and not by[2][0]["emptied"]
    assert by[4][0]["text"] is None and by[4][0]["n_lines"] == 0
    assert by[5][0]["text"] == "" and by[5][0]["n_lines"] == 1
    assert [r["emptied"] for r in by[6]] == [True, True]
    assert by[7][0]["n_removed"] == 0


def test_line_spread_two_sites_is_not_enough(spark):
    line = "a line of five words"
    got = rows_of(lines.dedup_lines(docs_of(spark, [(i, line, f"s{i % 2}") for i in range(6)])))
    assert all(r["n_removed"] == 0 for r in got.values())


def test_sketch_estimates_far_from_threshold(spark):
    line = "a line of five words"
    spread = lines.site_spread(docs_of(spark, [(i, line, f"s{i}") for i in range(40)]), "source").collect()
    assert len(spread) == 1 and not spread[0]["exact"] and spread[0]["n_sites"] == 40 and spread[0]["first_doc"] == 0


def test_lines_of_empty_table(spark):
    assert lines.dedup_lines(docs_of(spark, [])).count() == 0


def test_lines_of_repeated_null_and_long_rows(spark):
    boiler = ["Read all of our terms", "Follow us on every page"]
    long = "\n".join(f"own line {i} of many" if i % 3 else boiler[i % 2] for i in range(20_000))
    rows = [(1, "\n".join(boiler), "s0"), (2, "\n".join(boiler), "s1"), (3, boiler[0] + "\nown words stand here", "s2"), (3, boiler[1] + "\nother own words", "s3")]
    rows += [(None, f"{boiler[0]}\nrow {i} of none", "s4") for i in range(3)] * 2 + [(9, long, "s5")]
    got = lines.dedup_lines(docs_of(spark, rows).withColumn("gone_t", F.lit(1)).withColumn("site", F.lit("x"))).collect()
    assert len(got) == len(rows)
    assert sorted(r["text"] for r in got if r["doc_id"] is None) == sorted([f"row {i} of none" for i in range(3)] * 2)
    assert sorted(r["text"] for r in got if r["doc_id"] == 3) == ["other own words", "own words stand here"]
    assert [r["text"] for r in got if r["doc_id"] == 1] == ["\n".join(boiler)]
    (r,) = (r for r in got if r["doc_id"] == 9)
    assert r["text"] == "\n".join(f"own line {i} of many" for i in range(20_000) if i % 3) and r["n_removed"] == 6667


# ---- 2 URL filters


def test_url_parts_and_rules(spark):
    rows = [
        (1, "HTTP://A.Example.ORG/es/x?q#f"), (2, "http://example.org/en/15"), (3, "http://x.com/de/"), (4, "http://x.com/fr/a"),
        (5, None), (6, "no scheme"), (7, "http://org"), (8, "http://cheap-casino-pills.test/win"), (9, "http://notexample.org/es/"), (9, "http://notexample.org/es/"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("grams", F.lit(1)).withColumn("Host", F.lit(2))
    got = urls.judge(pages).collect()
    by = {r["page_id"]: r for r in got}
    assert len(got) == len(rows) and by[1]["grams"] == 1
    assert (by[1]["host"], by[1]["path"], by[1]["rule"], by[1]["verdict"]) == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert by[2]["rule"] == "example.org/en/1" and by[3]["verdict"] == "block" and by[4]["rule"] == "com/fr/"
    assert (by[5]["host"], by[5]["path"], by[5]["rule"]) == ("", "", None) and by[6]["host"] == ""
    assert by[7]["rule"] is None and by[7]["path"] == ""
    assert by[8]["verdict"] == "block" and by[9]["rule"] == "org/"


def test_url_model_separates_its_table_and_agrees_with_itself(spark):
    rows = [(u, 1) for u in urls.BLOCK] + [(u, 0) for u in urls.ALLOW]
    pages = spark.createDataFrame([("https://" + u, y) for u, y in rows], "url string, y int")
    bare = urls.UrlParams(rules=())
    one, two = (urls.judge(pages, bare).collect() for _ in range(2))
    assert sum((r["verdict"] == "block") == bool(r["y"]) for r in one) / len(rows) > 0.97
    assert [r["verdict"] for r in one] == [r["verdict"] for r in two]


# ---- 3 quality rules


def brute_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_quality_base_counts_match_brute_force(spark, prose):
    texts = ["", None, "a", "a b", "a a a a", "a b c a b c", "x\ny\nx\n \n \nx", "é# *é z", "a b c d\ta b c\rq a b", prose(300, 1), prose(90, 2) + "\n" + prose(90, 2)]
    docs = docs_of(spark, [(i, t, "s") for i, t in enumerate(texts)]).withColumn("words", F.lit(0)).withColumn("n_words", F.lit("clash"))
    labels = spark.createDataFrame([(9, 1, 0), (9, 1, 0), (10, None, 0)], "doc_id long, quality int, toxic int")
    got = rows_of(quality.quality_scores(docs, labels))
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute_base(t), t
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    assert not math.isnan(got[0]["llr"]) and got[9]["kept"]


def test_quality_filter_does_not_repeat_the_work_and_rejects_junk(spark, prose):
    good = [(i, prose(120, i), "s") for i in range(60)]
    bad = [(100 + i, " ".join(w + "###" for w in prose(120, i).split()), "s") for i in range(12)]
    docs = docs_of(spark, good + bad)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    kept = {r["doc_id"] for r in quality.quality_scores(docs, labels, quality.QualityParams(prior=100.0)).filter("kept").collect()}
    assert kept == {i for i, _, _ in good}


def test_quality_without_labels(spark, prose):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.quality_scores(docs_of(spark, [(1, prose(80, 1), "s")]), labels).first()
    assert got["llr"] == 0 and got["kept"]
    assert quality.quality_scores(docs_of(spark, []), labels).count() == 0


# ---- 4 chat formatting


def test_chat_round_trip(spark):
    turns = [(1, 0, "system", "S"), (1, 1, "ann", "hello"), (1, 2, "bob", "hi <|im_end|> x"), (1, 3, None, None), (None, 0, "ann", "q"), (2, 0, "system", "only"), (1, 1, "ann", "hello")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("name", F.lit("clash"))
    got = chat.perspectives(df).collect()
    assert {(r["conv_id"], r["perspective"]) for r in got} == {(1, "ann"), (1, "bob"), (1, "unknown"), (None, "ann")}
    ann = sorted((r for r in got if r["conv_id"] == 1 and r["perspective"] == "ann"), key=lambda r: (r["turn"], r["name"]))
    assert [r["role"] for r in ann] == ["system", "assistant", "assistant", "user", "user"]
    assert ann[1]["segment"][ann[1]["mask_start"] : ann[1]["mask_end"]] == "hello<|im_end|>"
    assert "hi < |im_end|> x" in ann[3]["segment"] and ann[3]["mask_end"] == 0 and "name=bob" in ann[3]["segment"]
    part = chat.dialogue_parts(chat.perspectives(df)).filter("conv_id = 1 and perspective = 'ann'").first()
    assert part["text"] == "".join(r["segment"] for r in ann)
    assert [part["text"][m["start"] : m["end"]] for m in part["masks"]] == ["hello<|im_end|>"] * 2


# ---- 5 decontamination


def brute_hits(words, items, size=10):
    windows = {}
    for item, w in items:
        n = min(size, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    hit, found = set(), set()
    for n in {len(w) for w in windows}:
        for i in range(len(words) - n + 1):
            if who := windows.get(tuple(words[i : i + n])):
                hit |= set(range(i, i + n))
                found |= who
    return hit, found


@pytest.mark.parametrize("seed", range(6))
def test_automaton_matches_brute_force(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice([b"a", b"b", b"c", b"d"])
    items = [(k, [word() for _ in range(rng.choice([0, 1, 2, 3, 5, 8, 12, 30]) if seed else rng.randint(4, 12))]) for k in range(8)]
    automaton = decontaminate.ItemAutomaton(items, 5)
    for _ in range(40):
        words = [word() if rng.random() < 0.95 else b"zz" for _ in range(rng.randint(0, 80))]
        spans, found, _ = automaton.scan(words)
        hit, who = brute_hits(words, items, 5)
        assert {i for a, b in spans for i in range(a, b)} == hit and found == who


def test_decontamination_cuts_spans_and_drops(spark):
    passage = "One two three four five six seven eight nine ten eleven"
    bench = spark.createDataFrame([(1, passage), (2, "short item"), (2, None), (None, "nameless thing"), (3, "")], "item_id long, text string")
    long_text = " ".join(f"w{i}" for i in range(30))
    docs = docs_of(spark, [(1, f"{long_text} {passage.upper()}, {long_text}", "s"), (2, passage, "s"), (3, None, "s"), (4, "a short, item", "s"), (5, "nameless\nthing", "s"), (5, "nameless\nthing", "s")])
    got = decontaminate.matches(docs, bench).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 6
    assert (by[1]["n_hit"], by[1]["item_ids"], by[1]["longest"]) == (11, ["1"], 11)
    assert (by[3]["n_words"], by[3]["n_hit"]) == (0, 0) and by[4]["item_ids"] == ["2"]
    assert by[5]["n_hit"] == 2 and by[5]["item_ids"] == []
    clean = rows_of(decontaminate.clean(docs.withColumn("dropped", F.lit(1)), bench))
    assert clean[1]["text"] == f"{long_text} , {long_text}" and not clean[1]["dropped"] and clean[2]["dropped"]
    assert clean[3]["text"] is None and clean[1]["source"] == "s"
    empty = spark.createDataFrame([], bench.schema)
    assert decontaminate.matches(docs, empty).agg(F.sum("n_hit")).first()[0] == 0
    with pytest.raises(ValueError):
        decontaminate.build_automaton(bench, decontaminate.DecontaminationParams(max_item_words=3))


# ---- 6 toxicity


def test_isotonic_is_monotone_and_pools():
    xs, ys = toxicity.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]))
    assert (np.diff(ys) >= 0).all() and np.interp(2.5, xs, ys) == 0.5


def test_toxicity_learns_terms_and_masks(spark, prose):
    bad = ["stupid", "idiot", "moron"]
    rng = random.Random(1)
    rows = []
    for i in range(400):
        words = prose(60, 1000 + i).split()
        if i % 4 == 0:
            for _ in range(3):
                words.insert(rng.randint(0, len(words)), rng.choice(bad))
        rows.append((i, " ".join(words), "s"))
    docs = docs_of(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)] + [(1, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    extra = docs_of(spark, [(1000, None, "s"), (1001, "", "s"), (1002, "you idiot", "s")])
    got = rows_of(toxicity.score(docs.union(extra), model))
    assert all(0 <= r["score"] <= 1 for r in got.values())
    right = sum((got[i]["score"] >= 0.3) == (i % 4 == 0) for i in range(300, 400))
    assert right >= 95
    assert model.lexicon.features("you st0p1d")[toxicity.FEATURES.index("hidden_terms")] == 0
    assert model.lexicon.features("you 1d10t")[toxicity.FEATURES.index("hidden_terms")] == 1
    nothing = toxicity.train(docs, labels.filter("false"))
    assert rows_of(toxicity.score(docs, nothing))[1]["score"] == 0


# ---- 7 near-duplicates


def brute_components(texts):
    sets = {}
    for i, t in texts:
        w = (t or "").split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                k = len(sets[a] & sets[b])
                if 100 * k >= 85 * (len(sets[a]) + len(sets[b]) - k):
                    p, q = sorted((top(a), top(b)))
                    root[q] = p
    return {i: (len(sets[i]), top(i)) for i in ids}


def test_near_duplicates_match_brute_force(spark, prose):
    rng = random.Random(3)
    texts = [(0, ""), (1, None), (2, "a b"), (3, "a b"), (4, "a b c"), (5, "q w e r t")]
    for base in range(10, 22):
        words = prose(rng.choice([8, 20, 60, 300, 900]), base).split()
        for copy in range(12):
            w = list(words)
            for _ in range(rng.choice([0, 0, 1, 2, max(1, len(w) // 100), max(1, len(w) // 40)])):
                w[rng.randrange(len(w))] = f"edit{rng.random()}"
            texts.append((base * 100 + copy, " ".join(w)))
    shared = prose(60, 99)
    texts += [(5000 + i, f"{shared} {prose(12, 7000 + i)}") for i in range(60)]
    got = rows_of(neardup.components(docs_of(spark, [(i, t, "s") for i, t in texts])))
    want = brute_components(texts)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_near_duplicates_of_odd_rows(spark, prose):
    t = prose(50, 1)
    rows = [(5, t, "s"), (3, t.upper(), "s"), (None, t, "s"), (None, "unlike any other text here", "s"), (9, t, "s"), (9, prose(50, 2), "s"), (9, t, "s")]
    got = neardup.components(docs_of(spark, rows).withColumn("n", F.lit(0))).collect()
    assert len(got) == len(rows)
    assert {r["component_id"] for r in got if r["n_shingles"] == 46 and r["doc_id"] in (3, 5)} == {3}
    kept = neardup.unique_documents(docs_of(spark, rows)).collect()
    assert {r["doc_id"] for r in kept} >= {3} and 5 not in {r["doc_id"] for r in kept}
    assert neardup.components(docs_of(spark, [])).count() == 0


def test_unique_documents_lose_no_text_and_keep_one_row_of_each(spark, prose):
    a, b, c, e = (prose(40, 40 + i) for i in range(4))
    near = " ".join([*a.split(), "tail"])
    rows = [(3, a, "s"), (9, a, "s"), (9, b, "s"), (7, e, "s"), (7, e, "s"), (None, c, "s"), (None, c, "s"), (None, near, "t"), (8, None, "s"), (8, None, "s"), (6, "", "s")]
    docs = docs_of(spark, rows).withColumn("row_r", F.lit(1)).withColumn("Node", F.lit("x"))
    kept = neardup.unique_documents(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in kept.collect()) == sorted([("3", a), ("9", b), ("7", e), ("None", c), ("8", ""), ("6", "")])
    assert neardup.unique_documents(docs_of(spark, [])).count() == 0


def test_a_text_without_a_doc_id_links_others(spark):
    words = [f"w{i}" for i in range(100)]
    left, right = ["x", "y", "z", *words[3:]], [*words[:-3], "p", "q", "r"]
    got = rows_of(neardup.components(docs_of(spark, [(4, " ".join(left), "s"), (2, " ".join(right), "s"), (None, " ".join(words), "s")])))
    assert {r["component_id"] for r in got.values()} == {2} and [i for i, r in got.items() if r["kept"]] == [2]


def test_near_dedup_thresholds_follow_the_miss_rate():
    for percent in (80, 85, 95):
        p = neardup.NearDupParams(percent=percent)
        for n, share in ((p.index, p.share), (p.k, p.floor)):
            lost = sum(math.comb(n, c) * p.similarity**c * (1 - p.similarity) ** (n - c) for c in range(round(share * n)))
            assert lost <= p.miss < lost + math.comb(n, round(share * n)) * p.similarity ** round(share * n) * (1 - p.similarity) ** (n - round(share * n))


def test_near_dedup_of_long_texts(spark, prose):
    long = prose(30_000, 5)
    got = rows_of(neardup.components(docs_of(spark, [(1, long, "s"), (2, long + " end", "s"), (3, prose(30_000, 6), "s")])))
    assert {i: r["component_id"] for i, r in got.items()} == {1: 1, 2: 1, 3: 3}


# ---- 8 mixing


def test_targets_are_those_of_resharing(spark):
    rng = random.Random(11)
    sizes = {f"s{i:03d}": rng.choice([0, 1, 2, 5, 40, 1000, 20_000]) for i in range(60)} | {None: 7}
    rows = [(i, "w " * n, s) for i, (s, n) in enumerate(sizes.items())]
    sized = docs_of(spark, rows).select("source", mixing.word_count(F.col("text")).alias("size"))
    got = {r["source"]: r["target"] for r in mixing.source_targets(sized).collect()}
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight, open_, target = {s: i % 3 + 1 for i, s in enumerate(names)}, set(names), {}
    while True:
        left = sum(sizes.values()) - sum(target.values())
        share = {s: left * weight[s] / sum(weight[t] for t in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            break
        target |= {s: 3.0 * sizes[s] for s in over}
        open_ -= over
    assert got == pytest.approx(target | share)


def test_mix_reaches_targets(spark):
    rng = random.Random(5)
    rows = [(i, "w " * rng.randint(0, 40), f"s{i % 3}" if i % 10 else None) for i in range(600)]
    rows += [(7, "again", "s1"), (None, "x y", "s0"), (8, None, "s2")]
    docs = docs_of(spark, rows).withColumn("SIZE", F.lit(1)).withColumn("h", F.lit(2))
    one = mixing.mix(docs).collect()
    assert len(one) == len(rows)
    assert sorted(map(str, one)) == sorted(map(str, mixing.mix(docs.repartition(7)).collect()))
    by = {}
    for r in one:
        by.setdefault(r["source"], []).append(r)
        assert r["taken"] in {k * r["size"] for k in range(4)}
    weights = dict(zip(["s0", "s1", "s2", None], [1, 2, 3, 1], strict=True))
    total = sum(r["size"] for r in one)
    for source, got in by.items():
        size, target = got[0]["source_size"], got[0]["target"]
        assert size == sum(r["size"] for r in got)
        assert target <= 3 * size + 1e-6 and abs(sum(r["taken"] for r in got) - target) <= 41
        if target < 3 * size - 1e-6:
            assert target >= total * weights[source] / sum(weights.values()) - 1e-6
    assert abs(sum(g[0]["target"] for g in by.values()) - total) < 1e-6
    assert mixing.mix(docs_of(spark, [])).count() == 0
    assert mixing.mix(docs_of(spark, [(1, None, None)])).first()["taken"] == 0


def test_doc_hash_is_the_leading_md5_bits(spark):
    got = docs_of(spark, [(17, "a", "s")]).select(mixing.doc_hash(F.col("doc_id"))).first()[0]
    assert got == int(hashlib.md5(b"17").hexdigest()[:12], 16)


# ---- 9 language ID


def test_language_by_compression(spark):
    rng = random.Random(2)
    syllables = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ung", "ver", "ein"]}
    text = lambda lang, n: " ".join("".join(rng.choice(syllables[lang]) for _ in range(3)) for _ in range(n))
    rows = [(i, text(lang, 60), lang) for i, lang in enumerate(["aa", "bb"] * 60)]
    schema = "doc_id long, text string, lang string"
    odd = [(900, None, None), (901, "", None), (902, "12 !! 3", None), (903, text("bb", 4000), None), (903, text("bb", 9), None)]
    train = spark.createDataFrame(rows[:80] + [(500, None, "aa"), (501, "x", None)], schema)
    content = langid.learn(train)
    assert list(content) == ["aa", "bb"]
    got = langid.identify(spark.createDataFrame(rows[80:] + odd, schema).withColumn("score", F.lit(0)), content).collect()
    assert len(got) == 45
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["lang_pred"] == lang for i, _, lang in rows[80:])
    assert all(by[i]["lang_pred"] == "und" and by[i]["rejected"] and by[i]["score"] == 0 for i in (900, 901, 902))
    assert by[903]["lang_pred"] == "bb" and all(0 <= r["score"] <= 1 for r in got)
    assert langid.identify(train, {}).filter("lang_pred <> 'und'").count() == 0


# ---- 10 license scans


def test_license_base_places_and_fuzzy_notices(spark):
    texts = {
        1: "All rights reserved. CC-BY cc by\ncc BY", 2: None, 3: "", 4: "xall rights reserved", 5: "Licensd under teh Apache License, Version 2.0.",
        6: "This work is licensed under the GNU General Public License, version 3.", 7: "Licensed under CC BY-NC 4.0.", 8: "license under a rock",
    }
    docs = docs_of(spark, [(i, t, "s") for i, t in texts.items()] + [(7, texts[7], "s")]).withColumn("places", F.lit(1))
    got = licenses.license_digest(docs).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 9
    assert (by[1]["n_base"], by[1]["first_word"], by[1]["last_word"], by[1]["base_labels"]) == (4, 0, 7, "cc-by,reserved")
    assert (by[2]["n_words"], by[2]["n_base"], by[2]["first_word"], by[2]["labels"], by[2]["score"]) == (0, 0, None, "", 0)
    assert by[4]["n_base"] == 0 and by[5]["labels"] == "apache-2.0" and 0 < by[5]["score"] < 1
    assert by[6]["labels"] == "gpl,gpl-3.0" and by[7]["labels"] == "cc-by,cc-by-nc-4.0" and by[8]["labels"] == ""
    spans = {r["doc_id"]: r["notices"] for r in licenses.scan(docs).collect()}
    assert spans[5][0]["edits"] == 3 and (spans[5][0]["first_word"], spans[5][0]["last_word"]) == (0, 7)


def test_pigeonhole_finds_every_edit_within_bounds():
    finder = licenses.NoticeFinder(licenses.LicenseParams())
    rng = random.Random(4)
    for label, notice in licenses.NOTICES:
        errors = next(e for lab, n, e, _ in finder.patterns if lab == label and n == len(notice))
        for _ in range(10):
            chars = list(notice)
            for _ in range(rng.randint(0, errors)):
                at = rng.randrange(1, len(chars) - 1)
                kind = rng.choice("sid")
                chars[at : at + (kind != "i")] = [] if kind == "d" else [rng.choice("xyz")]
            found = finder.find("some words " + "".join(chars) + " and more")
            assert found and found[0][3] <= errors


def test_misspelt_notice_before_a_better_one_is_found():
    finder = licenses.NoticeFinder(licenses.LicenseParams())
    dual = "licensd under the gnu genral public license version 2 or licensed under the gnu general public license version 3"
    assert finder.find(dual) == [(0, 53, "gpl-2.0", 2), (57, 112, "gpl-3.0", 0)]
    wrong, right = "licensd under the mit license", "licensed under the mit license"
    for row in ([wrong, right], [right, wrong], [wrong, wrong, right, wrong, wrong]):
        assert [(label, edits) for _, _, label, edits in finder.find(" ".join(row))] == [("mit", int(x == wrong)) for x in row]


def test_crc_folds_are_those_of_zlib(spark):
    got = spark.range(50).select("id", (F.crc32(F.col("id").cast("string")) % 4).alias("k")).collect()
    assert all(r["k"] == zlib.crc32(str(r["id"]).encode()) % 4 for r in got)
