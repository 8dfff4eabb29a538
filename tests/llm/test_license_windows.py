"""Every notice that a search of all windows finds, found through seeds alone, in time that follows the text."""

import random
import time
from bisect import bisect_left

import pytest

from paceline.llm import licenses
from test_pipeline import alnum

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def finder():
    return licenses.NoticeFinder(licenses.LicenseParams())


def seedless(finder, text):
    """All windows at word starts are searched for all notices; of overlapping finds that with the fewest edits stays, then the longest, the leftmost."""
    hits = set()
    starts = [0, *(i + 1 for i, c in enumerate(text) if c == " ")]
    for label, size, errors, pattern in finder.patterns:
        for at in starts:
            m = pattern.search(text, at, min(len(text), at + size + errors + 1))
            if m:
                hits.add((m.start(), m.end(), label, sum(m.fuzzy_counts)))
    best = []
    for hit in sorted(hits, key=lambda x: (x[3], x[0] - x[1], x)):
        at = bisect_left(best, hit)
        if (not at or best[at - 1][1] <= hit[0]) and (at == len(best) or hit[1] <= best[at][0]):
            best.insert(at, hit)
    return best


def test_documents_have_the_notices_of_a_search_without_seeds(spark, finder):
    found = 0
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        text = " ".join(alnum(r["text"]))
        if "licen" in text or "rights" in text or "permi" in text:
            want = seedless(finder, text)
            assert finder.find(text) == want
            found += len(want)
    print("notices in documents:", found)


def test_misspelt_notices_in_a_row(finder):
    rng = random.Random(9)
    for n in (2, 3, 5):
        for _ in range(12):
            parts = []
            for _ in range(n):
                _, notice = rng.choice(licenses.NOTICES)
                at = rng.randrange(2, len(notice) - 2)
                cut = {0: notice[:at] + notice[at + 1 :], 1: notice[:at] + "q" + notice[at:], 2: notice}[rng.randrange(3)]
                parts.append(rng.choice(["", "x ", "and "]) + cut)
            text = " ".join(" ".join(parts).split())
            want = seedless(finder, text)
            assert [h[2] for h in finder.find(text)] == [h[2] for h in want] and finder.find(text) == want


@pytest.mark.parametrize("line", ["x licensed under the gnu genral public license versin 2", "x relesed under the mit licnse", "licensed under the mit license"])
def test_time_follows_the_text(finder, line):
    seconds = {}
    for n in (500, 1000, 2000):
        text = " ".join([line] * n)
        began = time.process_time()
        found = finder.find(text)
        seconds[n] = time.process_time() - began
        assert len(found) == n
    print(line, seconds)
    assert seconds[2000] < 3 * seconds[1000] + 0.05 and seconds[1000] < 3 * seconds[500] + 0.05


def test_ties_go_to_the_longest_then_the_leftmost(finder):
    both = "released under the mit license licensed under the mit license"
    assert [h[2:] for h in finder.find(both)] == [("mit", 0), ("mit", 0)]
    assert finder.find("") == [] and finder.find("licensed under") == []
