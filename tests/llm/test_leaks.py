import random

import numpy as np
import pytest

from sparquill.llm.leaks import LeakRules, Letters, ShingleFilter, end_hashes, item_shingles, leaked_items, prefix_places, words_of

RULES = LeakRules()
WORDS = [f"w{i}" for i in range(40)]


def test_words():
    assert words_of("The roTOR, de-\nscribed; (here)\t42 ﬁt soft­en") == ["the", "rotor", "described", "here", "42", "fit", "soften"]
    assert words_of(None) == [] and words_of("") == [] and words_of(" .,-\n") == []


def test_letters():
    got = Letters.of(["Ab-\ncd E_f", None, "", "ﬁ 1"])
    assert "".join(map(chr, got.codes)) == "abcdeffi1"
    assert np.flatnonzero(got.begins).tolist() == [0, 2, 4, 5, 6, 8, 9]
    assert got.texts.tolist() == [0, 6, 6, 6, 9]


def exhaustive(item, text, rules=RULES):
    """Does the text hold a passage? Every item word at every edge is tried as a beginning, with
    all ways of changing words; no shingles."""
    got = Letters.of([text])
    letters = "".join(map(chr, got.codes))
    edges = np.flatnonzero(got.begins).tolist()
    later = {p: [e for e in edges if e > p][:2] for p in range(len(letters) + 1)}
    for first in range(len(item) - rules.min_words + 1):
        most = (len(item) - first) // rules.per_change
        for start in edges:
            if not letters.startswith(item[first], start):
                continue
            level = {(first, start)}
            seen = set()
            for changes in range(most + 1):
                stack, here = list(level), set()
                while stack:
                    i, p = stack.pop()
                    if (i, p) in seen:
                        continue
                    seen.add((i, p))
                    here.add((i, p))
                    if i < len(item) and letters.startswith(item[i], p):
                        q = p + len(item[i])
                        if q in edges and i + 1 - first >= rules.min_words and changes * rules.per_change <= i + 1 - first:
                            return True
                        stack.append((i + 1, q))
                level = set()
                for i, p in here:
                    if (i, p) == (first, start):
                        continue
                    one, two = (later[p][:1] or [p])[0], (later[p] or [p])[-1]
                    level |= {(i, q) for q in range(p + 1, one + 1)}
                    if i < len(item):
                        level |= {(i + 1, q) for q in range(p, two + 1)}
    return False


def search(spark, docs, items, rules=RULES):
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    i = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r["doc_id"], r["item_id"]) for r in leaked_items(d, i, "doc_id", "text", "item_id", "text", rules).collect()}


NUMBERS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split()
CASES = [
    (NUMBERS[3:15], True),
    (NUMBERS[3:14], False),
    ([*NUMBERS[0:5], "other", *NUMBERS[6:12]], True),
    ([*NUMBERS[0:4], "x", NUMBERS[5], "y", *NUMBERS[7:12]], False),
    ([*NUMBERS[0:5], "x", *NUMBERS[6:10], "y", *NUMBERS[11:16]], True),
    ([*NUMBERS[0:6], *NUMBERS[7:13]], True),
    ([*NUMBERS[0:6], "extra", *NUMBERS[6:12]], True),
    ([*NUMBERS[0:5], "f", "ive", *NUMBERS[6:8], "eig", "ht", *NUMBERS[9:12]], True),
    (["ze", "ro", "o", "ne", "t", "wo", "th", "ree", "fo", "ur", "fiv", "e", "si", "x", "sev", "en", "ei", "ght", "ni", "ne", "te", "n", "ele", "ven"], True),
    (["".join(NUMBERS[k : k + 3]) for k in range(0, 15, 3)], True),
    (["zeroo", "netw", "othr", *NUMBERS[4:13]], True),
    ([*NUMBERS[0:11], "eleventh"], False),
    (["un" + NUMBERS[0], *NUMBERS[1:12]], False),
    (list(reversed(NUMBERS)), False),
    ([], False),
]


def test_passages(spark):
    docs = [" ".join(["before", "it", *d, "after", "it"]) for d, _ in CASES]
    want = {(k, 0) for k, (_, case) in enumerate(CASES) if case}
    assert {(k, 0) for k, d in enumerate(docs) if exhaustive(NUMBERS, d)} == want
    assert search(spark, docs, [" ".join(NUMBERS)]) == want


def test_a_divided_word_in_five_of_a_verbatim_passage(spark):
    rng = random.Random(1)
    item = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 9))) for _ in range(30)]
    docs = [" ".join(w[:2] + " " + w[2:] if k % 5 == s else w for k, w in enumerate(item)) for s in range(5)]
    docs += [" ".join(w[:1] + "-\n" + w[1:] for w in item), "".join(item)]
    assert search(spark, docs, [" ".join(item)]) == {(k, 0) for k in range(7)}


def test_equals_exhaustive_search(spark):
    rng = random.Random(4)
    vocabulary = [f"v{k}" * rng.randrange(1, 4) for k in range(25)] + ["a", "b", "an", "and"]
    items = [[rng.choice(vocabulary) for _ in range(rng.randrange(12, 40))] for _ in range(12)]
    docs = []
    for _ in range(90):
        item = rng.choice(items)
        n = rng.randrange(10, len(item) + 1)
        a = rng.randrange(len(item) - n + 1)
        part = item[a : a + n]
        for k in rng.sample(range(n), rng.randrange(0, n // 6 + 1)):
            part[k] = rng.choice(["changed", "", part[k] + " more", part[k][:1] + " x", part[k][::-1]])
        words = [w for w in part if w]
        text = ""
        for w in words:
            cut = rng.randrange(len(w) + 1) if rng.random() < 0.15 else 0
            text += (w[:cut] + rng.choice([" ", "-\n"]) + w[cut:] if cut else w) + ("" if rng.random() < 0.08 else rng.choice([" ", ", ", "\n"]))
        docs.append(f"u1 u2 {text} end of it")
    want = {(d, i) for d, text in enumerate(docs) for i, item in enumerate(items) if exhaustive(item, text)}
    assert len(want) > 30
    assert search(spark, docs, [" ".join(i) for i in items]) == want
    # a filter much too small lets more through, and changes nothing
    assert search(spark, docs, [" ".join(i) for i in items], LeakRules(most_filter_bits=16)) == want


def test_prefix_bound():
    rng = np.random.default_rng(3)
    for _ in range(50):
        words = int(rng.integers(12, 40))
        rarity = rng.integers(0, 9, words - 4)
        keep = set(prefix_places(rarity, RULES).tolist())
        for n in range(12, min(24, words + 1)):
            for a in range(words - n + 1):
                changed = rng.choice(np.arange(a, a + n), n // 8, replace=False)
                whole = [p for p in range(a, a + n - 4) if not any(p <= c < p + 5 for c in changed)]
                # only shingles that occur can be shared
                if whole and all(rarity[p] > 0 for p in whole):
                    assert keep & set(whole)


def test_places_over_block_ends(monkeypatch):
    import sparquill.llm.leaks as leaks

    monkeypatch.setattr(leaks, "_BLOCK", 64)
    rows = item_shingles(NUMBERS, RULES)
    tables = [np.full(1 << 13, 255, np.uint8)] * 2
    every = ShingleFilter(16, *tables, tuple(sorted({r[1] for r in rows})))
    codes = Letters.of(["x y " * 30 + " ".join(NUMBERS)]).codes
    at, token = every.places(codes)
    got = set(zip(at.tolist(), token.view(np.int64).tolist(), strict=True))
    begin = 60
    for p, _, _, t in rows:
        assert (begin + len("".join(NUMBERS[:p])), t) in got
    assert [len(h) for h in end_hashes(codes[:10]).values()] == [7, 3, 0, 0]


def test_odd_tables(spark):
    text = " ".join(WORDS)
    docs = [(1, f"x {text} y", "s"), (2, "a. " + ";\n".join(w.upper() for w in WORDS[3:20]), "s"), (3, " ".join(WORDS[:11]), "s"), (4, None, "s"), (5, "", "s"), (6, ("filler " * 50_000) + " ".join(WORDS[20:40]), "s"), (1, f"x {text} y", "s")]
    items = [(10, text, "i"), (11, " ".join(WORDS[15:40]), "i"), (12, "too short", "i"), (13, None, "i"), (None, text, "i"), (14, "nothing " * 12, "i"), (14, " ".join(WORDS[20:40]), "i")]
    d, i = spark.createDataFrame(docs, "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, text string, doc_id string")
    found = leaked_items(d, i, "doc_id", "text", "item_id", "text").collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in found) == [(1, 10), (1, 11), (1, 14), (2, 10), (6, 10), (6, 11), (6, 14)]
    assert {(r["doc_id"], r["item_id"]): (r["words"], r["changed"]) for r in found}[(2, 10)] == (17, 0)
    assert leaked_items(d.limit(0), i, "doc_id", "text", "item_id", "text").count() == 0
    assert leaked_items(d, i.limit(0), "doc_id", "text", "item_id", "text").count() == 0
