import datetime as dt
import random

import numpy as np
import pytest

from sparquill.llm.screening import PartCache, ScreenRules, fit, load, phrases, plain_pieces, plain_word, score_documents, score_texts, source_rates, store, subwords, train, training_documents

RULES = ScreenRules(buckets=4096, steps=60, rounds=1, folds=2)
BENIGN = [f"the {a} rests upon the {b} of the {c}" for a in ("lever", "valve", "spring") for b in ("housing", "flange", "shaft") for c in ("pump", "motor", "mixer", "drill")]
HARM = ["you worthless {}, go to hell", "only a {} would write this, shut your mouth", "what a pathetic {} you are", "piss off you stupid {}"]
NAMES = ["moron", "scumbag", "imbecile", "bastard"]


def made(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        text = [rng.choice(BENIGN) for _ in range(6)]
        bad = i % 3 == 0
        if bad:
            text.insert(rng.randrange(6), rng.choice(HARM).format(rng.choice(NAMES)))
        out.append((". ".join(text), bad))
    return out


@pytest.fixture(scope="module")
def screen():
    rng = random.Random(9)
    # one review in twenty is wrong
    return train([(t, float(bad != (rng.random() < 0.05))) for t, bad in made(240, 1)], RULES)


def test_held_out_accuracy(screen):
    held = made(150, 2)
    scores = score_texts([t for t, _ in held], PartCache(screen))
    assert np.mean((scores >= 0.5) == np.array([b for _, b in held])) > 0.97


@pytest.mark.parametrize("text", ["You w0rthless s c u m b a g, go to hell", "yоu wоrthlеss sсumbаg gо tо hеll", "YOU WORTHLESS SCUUUUMBAG GO TO HELL!!!", "you worth-\nless scum.bag, go to hell", "you worthles scumbagg go to hel"])
def test_spellings(screen, text):
    assert score_texts([BENIGN[0] + ". " + text], PartCache(screen))[0] >= 0.5


def test_batch_scores_equal_single_phrases(screen):
    texts = [t for t, _ in made(20, 3)] + ["", None, "...", "word " * 40, "\x1e odd \x1e"]
    got = score_texts(texts, PartCache(screen))
    for t, s in zip(texts, got, strict=True):
        own = [screen.score(p) for p in phrases(t or "", 10) if len(p) <= 15]
        if own and all(len(p) <= 10 for p in phrases(t, 10)):
            assert abs(max(own) - s) < 1e-6
    assert got[20] == got[21] == got[22] == 0.0


def test_words():
    assert plain_word("cr3t1n") == "cretin" and plain_word("1234") == "#" and plain_word("mooooron") == "moron"
    assert plain_pieces(["t e e t h out"])[:2] == ["teeth", "out"]
    assert 0 in subwords("#", RULES) and all(0 <= b < RULES.buckets for b in subwords("scumbag", RULES))


def test_gradients_are_right():
    rules = ScreenRules(buckets=64, dimension=3, steps=400, rate=0.05)
    bags = [["good", "day"], ["bad", "night"], ["good", "night"], ["bad", "day"]]
    model = fit(bags, np.array([0, 1, 0, 1]), np.ones(4), rules)
    assert [model.score(b) > 0.5 for b in bags] == [False, True, False, True]


def test_tables(spark, screen):
    docs = spark.createDataFrame([(1, "a", HARM[0].format("moron"), 1), (2, "a", BENIGN[0], 1), (3, None, None, 1), (4, None, "", 1), (5, "b", ("fine words. " * 20_000) + HARM[1].format("moron"), 1)], "doc_id long, source string, text string, score int")
    scores = score_documents(docs, screen)
    got = {r["doc_id"]: r["score"] for r in scores.collect()}
    assert {k for k, v in got.items() if v >= 0.5} == {1, 5} and got[3] == got[4] == 0.0
    rates = {r["source"]: (r["documents"], r["cases"], r["rate"]) for r in source_rates(scores, RULES).collect()}
    assert rates == {"a": (2, 1, 0.5), None: (2, 0, 0.0), "b": (1, 1, 1.0)}
    assert score_documents(docs.limit(0), screen).count() == 0


def test_reviews(spark):
    at = dt.datetime(2024, 1, 1)
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(1, 6)], "doc_id long, text string")
    reviews = spark.createDataFrame([(1, 1, "x", " Offensive", at), (2, 1, "x", "offensive", at), (3, 1, "y", "OK", at), (4, 2, "y", None, at), (5, 3, "z", "maybe", at), (6, 4, None, "ok", None), (7, 99, "z", "ok", at)], "review_id long, doc_id long, rater string, verdict string, reviewed_at timestamp")
    got = {t: s for t, s in training_documents(docs, reviews, RULES)}
    assert got["text 1"] == 0.5 and got["text 4"] == 0.0 and got["text 2"] is None and len(got) == 5
    few = training_documents(docs, reviews, ScreenRules(max_reviewed=1, background=1))
    assert len(few) <= 2
    assert training_documents(docs, reviews.limit(0), ScreenRules(background=2))[0][1] is None


@pytest.mark.parametrize("sample", [[], [("fine words", 0.0)], [("bad words", 1.0)], [("", None), (None, 1.0)]])
def test_nothing_to_tell_apart(sample):
    model = train(sample, RULES)
    assert score_texts(["you are a stupid idiot", ""], PartCache(model)).max() < 0.01


def test_a_model_is_fitted_once_and_stored(spark, screen, monkeypatch):
    import sparquill.llm.screening as module

    texts = [t for t, _ in made(30, 5)]
    again = load(store(screen, spark), RULES)
    assert np.array_equal(score_texts(texts, PartCache(again)), score_texts(texts, PartCache(screen)))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    reviews = spark.createDataFrame([], "review_id long, doc_id long, rater string, verdict string, reviewed_at timestamp")
    calls = []
    monkeypatch.setattr(module, "train", lambda sample, rules: calls.append(len(sample)) or screen)
    for _ in range(2):
        module.fitted_screen(docs, reviews, RULES, "some folder")
    assert calls == [30]
