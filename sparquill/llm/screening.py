"""Scores for abusive, hateful or sexual language, per document and per source.

A word's vector is the mean over hashed vectors of its character n-grams and of the word
itself; a phrase's vector is the mean of its words'; a linear softmax on it is trained jointly
with the n-gram vectors, in numpy. Misspelled words share n-grams with the words they come
from. A document's score is that of its worst phrase. Reviews label documents, not phrases, so
training alternates between fitting and choosing the phrases that make a document offensive.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparquill.storage import materialize


@dataclass(frozen=True)
class ScreenRules:
    """Bounds of the sample a fit uses: ``max_reviewed`` reviewed documents, the first by hashed id;
    ``max_phrases`` different phrases each of harmless, of unreviewed and half as many of the other
    phrases of harmful documents, the first by hash; ``background``: documents
    without a review whose phrases count as harmless with ``background_weight``, the first by
    hashed id; ``least_odds``: mean log odds of a suspect phrase's four worst words;
    ``least_words``: a phrase of fewer words is filled up to them by neutral ones; ``members``:
    models that are averaged, each fitted to its own sample of harmless phrases. All else is
    the model's shape. ``threshold``: least score of a case."""

    max_reviewed: int = 3000
    max_phrases: int = 6_000
    dimension: int = 16
    buckets: int = 1 << 15
    shortest: int = 3
    longest: int = 5
    steps: int = 60
    rounds: int = 2
    folds: int = 3
    rate: float = 0.05
    window: int = 10
    threshold: float = 0.5
    seed: int = 7
    background: int = 1000
    background_weight: float = 0.3
    least_odds: float = 2.0
    least_words: int = 6
    members: int = 4


# -- phrases ---------------------------------------------------------------------------------

#: Letters of other scripts that look like Latin ones.
_LOOKALIKES = str.maketrans("авеѕікмнорстухјԁɡһԛѡοαενικρτυχ", "abesikmhopctyxjdghqwoaevikptux")
#: Digits and signs that stand for letters.
_LEET = str.maketrans("0134578", "oieastb")
_HIDDEN = re.compile("[­​‌‍⁠﻿]")
#: Greek, Cyrillic and phonetic letters, and signs without width.
_FOREIGN = re.compile("[\u0250-\u02af\u0370-\u052f\u00ad\u200b-\u200d\u2060\ufeff]")
_DIVIDED = re.compile(r"[-‐‑¬](?<=\w.)[ \t]*\n\s*(?=\w)")
_SPACED = re.compile(r"[\s(\"'„“»\x1e][^\W\d_](?:[ .*_\-·][^\W\d_]){2,}(?![^\W_])")
_GLUE = re.compile(r"[ .*_\-·]")
_DOT = re.compile(r"\.(?<=[^\W\d_]\.)(?=[^\W\d_]{2})")
_MARK = re.compile(r"[*_·](?<=[^\W\d_].)(?=[^\W\d_])")
_BANG = re.compile(r"!(?<=[^\W\d_]!)(?=[^\W\d_])")
#: Stands between the texts of a batch.
_NEXT = "\x1e"
_PIECE = re.compile(r"[^\W_]+|[.!?\n\x1e]")
_LONG = re.compile(r"(.)\1{2,}")
_ENDS = frozenset(".!?\n\x1e")


def _unmasked(text: str) -> str:
    text = text.casefold()
    if not text.isascii():
        if not unicodedata.is_normalized("NFKC", text):
            text = unicodedata.normalize("NFKC", text)
        if _FOREIGN.search(text):
            text = _HIDDEN.sub("", text).translate(_LOOKALIKES)
    return text.replace(_NEXT, " ")


def plain_pieces(texts: Sequence[str]) -> list[str]:
    """Words and phrase ends of texts, each text followed by a record separator, with spacing
    and look-alike letters undone."""
    text = _NEXT + _NEXT.join(map(_unmasked, texts)) + _NEXT
    if "-\n" in text or "¬" in text or "- \n" in text:
        text = _DIVIDED.sub("", text)
    text = text.replace("$", "s").replace("@", "a")
    text = _BANG.sub("i", text) if "!" in text else text
    text = _SPACED.sub(lambda m: m.group()[0] + _GLUE.sub("", m.group()[1:]), text)
    text = _DOT.sub("", text)
    if "*" in text or "_" in text or "·" in text:
        text = _MARK.sub("", text)
    return _PIECE.findall(text)[1:]


def plain_word(word: str) -> str:
    """A word with digits that stand for letters and drawn-out letters undone; '#' for a number."""
    if not word.isalpha():
        if not any(c.isalpha() for c in word):
            return "#"
        word = word.translate(_LEET)
    return _LONG.sub(r"\1", word)


def phrases(text: str, window: int) -> list[list[str]]:
    """Words between phrase ends, with long stretches cut into overlapping windows."""
    out: list[list[str]] = []
    current: list[str] = []
    for p in plain_pieces([text]):
        if p not in _ENDS:
            current.append(plain_word(p))
        elif current:
            if len(current) <= window + window // 2:
                out.append(current)
            else:
                out += [current[k : k + window] for k in range(0, len(current) - window // 2, window // 2)]
            current = []
    return out


# -- model -----------------------------------------------------------------------------------


def subwords(word: str, rules: ScreenRules) -> list[int]:
    """Buckets of the word itself and of its character n-grams with boundary marks."""
    if word == "#":
        return [0]
    marked = f"<{word}>"
    grams = {marked, *(marked[i : i + n] for n in range(rules.shortest, rules.longest + 1) for i in range(len(marked) - n + 1))}
    return [1 + zlib.crc32(g.encode()) % (rules.buckets - 1) for g in sorted(grams)]


class WordTable:
    """Words of a training set and their n-gram buckets, laid out for sums by segment."""

    def __init__(self, words: Sequence[str], rules: ScreenRules):
        grams = [subwords(w, rules) for w in words]
        counts = np.array([len(g) for g in grams])
        self.counts = counts[:, None].astype(np.float32)
        self.starts = np.cumsum(counts) - counts
        self.flat = np.array([b for g in grams for b in g], np.int64)
        order = np.argsort(self.flat, kind="stable")
        ordered = self.flat[order]
        self.word_of = np.repeat(np.arange(len(grams)), counts)[order]
        self.bucket_starts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
        self.buckets = ordered[self.bucket_starts]

    def vectors(self, table: np.ndarray) -> np.ndarray:
        return np.add.reduceat(np.take(table, self.flat, axis=0), self.starts, axis=0) / self.counts

    def gradient(self, of_words: np.ndarray, size: int) -> np.ndarray:
        out = np.zeros((size, of_words.shape[1]), np.float32)
        out[self.buckets] = np.add.reduceat(np.take(of_words / self.counts, self.word_of, axis=0), self.bucket_starts, axis=0)
        return out


@dataclass
class Screen:
    """Fitted models, (table, weights, bias) each, whose softmax inputs are averaged. A phrase's
    score is a logistic function of the mean of its words' parts."""

    members: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    rules: ScreenRules

    def parts(self, words: Sequence[str]) -> np.ndarray:
        """Each word's part of the difference of the two softmax inputs."""
        if not words:
            return np.zeros(0)
        grams = WordTable(words, self.rules)
        return np.mean([grams.vectors(table) @ (weights[:, 1] - weights[:, 0]) for table, weights, _ in self.members], axis=0)

    @property
    def offset(self) -> float:
        return float(np.mean([bias[1] - bias[0] for _, _, bias in self.members]))

    def score(self, phrase: Sequence[str]) -> float:
        mean = self.parts(phrase).sum() / max(len(phrase), self.rules.least_words)
        return float(1 / (1 + np.exp(-(mean + self.offset)))) if phrase else 0.0


def fit(bags: list[list[str]], labels: np.ndarray, importance: np.ndarray, rules: ScreenRules) -> Screen:
    """Adam on the weighted cross-entropy of all phrases, n-gram vectors and softmax together."""
    rng = np.random.default_rng(rules.seed)
    vocabulary = {w: i for i, w in enumerate(sorted({w for b in bags for w in b}))}
    words = WordTable(list(vocabulary), rules)
    held = np.array([len(b) for b in bags])
    starts = np.cumsum(held) - held
    size = np.maximum(held, rules.least_words)
    flat = np.array([vocabulary[w] for b in bags for w in b], np.int64)
    order = np.argsort(flat, kind="stable")
    bag_of = np.repeat(np.arange(len(bags)), held)[order]
    word_starts = np.flatnonzero(np.append(True, flat[order][1:] != flat[order][:-1]))
    used = flat[order][word_starts]
    size = size[:, None].astype(np.float32)
    table = rng.uniform(-1, 1, (rules.buckets, rules.dimension)).astype(np.float32) / rules.dimension
    weights = rng.normal(0, 0.5, (rules.dimension, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    share = (importance / importance.sum()).astype(np.float32)
    wanted = np.eye(2, dtype=np.float32)[labels]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (table, weights, bias)]
    for step in range(1, rules.steps + 1):
        vectors = words.vectors(table)
        mean = np.add.reduceat(np.take(vectors, flat, axis=0), starts, axis=0) / size
        logits = mean @ weights + bias
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=1, keepdims=True)
        d = (p - wanted) * share[:, None] * np.float32(len(share) / 100)
        g_weights, g_bias = mean.T @ d, d.sum(axis=0)
        d_mean = (d @ weights.T) / size
        g_words = np.zeros_like(vectors)
        g_words[used] = np.add.reduceat(np.take(d_mean, bag_of, axis=0), word_starts, axis=0)
        grads = (words.gradient(g_words, rules.buckets), g_weights, g_bias)
        for param, grad, (m, v) in zip((table, weights, bias), grads, moments, strict=True):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            param -= (rules.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return Screen([(table, weights, bias)], rules)


def _suspicion(harmful: list[list[list[str]]], harmless: list[list[list[str]]]) -> dict[str, float]:
    """Of each word, the log odds of being in a harmful rather than a harmless document."""
    a = Counter(w for d in harmful for w in {w for p in d for w in p})
    b = Counter(w for d in harmless for w in {w for p in d for w in p})
    na, nb = len(harmful) + 1, len(harmless) + 1
    return {w: float(np.log((n + 0.1) / na) - np.log((b[w] + 0.5) / nb)) for w, n in a.items()}


def _harmful_phrases(docs: list[list[list[str]]], screen: Screen, least: float = 0.0) -> list[list[list[str]]]:
    """Of each document, the phrases whose softmax inputs differ by more than ``least``."""
    vocabulary = sorted({w for d in docs for p in d for w in p})
    if not vocabulary:
        return [[] for _ in docs]
    part = dict(zip(vocabulary, screen.parts(vocabulary), strict=True))
    fill = screen.rules.least_words
    return [[p for p in d if sum(part[w] for w in p) / max(len(p), fill) + screen.offset > least] for d in docs]


def train(sample: list[tuple[str, float | None]], rules: ScreenRules) -> Screen:
    """Fit to documents (text, part of its verdicts that say offensive, None without any).

    Suspect are a harmful document's phrases whose words are far likelier in harmful than in
    other documents. At first, the two most suspect count as its harmful ones. Then, in each
    round, they are those suspects that a model fitted without the document finds harmful: what
    only one document says of itself is not learnt. A document without any is taken for an
    error of its raters. All other phrases of any document are harmless ones. Without a harmful
    phrase or a harmless one there is nothing to tell apart, and every score is 0.
    """
    docs = [(phrases(t, rules.window), share) for t, share in sample if t]
    harmful = [d for d, s in docs if s is not None and s > 0.5 and d]
    harmless = [d for d, s in docs if s is not None and s < 0.5 and d]
    unknown = [d for d, s in docs if s is None and d]
    odds = _suspicion(harmful, harmless + unknown)

    def suspicion(p: list[str]) -> float:
        return sum(sorted((odds.get(w, 0.0) for w in p), reverse=True)[:4]) / 4

    def first(groups: list[list[list[str]]], most: int, salt: int = 0) -> list[list[str]]:
        by_text = {" ".join(p): p for g in groups for p in g}
        return [by_text[k] for k in sorted(by_text, key=lambda x: zlib.crc32(x.encode(), salt))[:most]]

    suspect = [[p for p in d if suspicion(p) >= rules.least_odds] for d in harmful]
    chosen = [sorted(d, key=suspicion, reverse=True)[:2] for d in suspect]

    def sampled(salt: int) -> tuple[list[list[str]], list[list[str]], list[list[str]]]:
        clean = first(harmless, rules.max_phrases, salt)
        keys = {" ".join(p) for p in clean}
        background = [p for p in first(unknown, rules.max_phrases, salt) if " ".join(p) not in keys]
        # harmless phrases broken by stray punctuation or line ends
        cuts = [part for p in clean + background for part in (p[:1], p[:2], p[2:3], p[-2:])]
        return clean, background, first([cuts], rules.max_phrases // 2, salt)

    samples = [sampled(k) for k in range(rules.members)]
    pool = first([*harmless, *unknown, *[broken for _, _, broken in samples]], 1 << 30)
    doubtful: set[str] = set()
    hard: list[list[str]] = []

    def fitted(use: list[int], salt: int = 0) -> Screen:
        clean, background, broken = samples[salt]
        clean_keys = {" ".join(p) for p in clean}
        positives = first([chosen[i] for i in use], rules.max_phrases)
        keys = {" ".join(p) for p in positives}
        mixed = first([harmful[i] for i in use], rules.max_phrases // 2, salt)
        apart = keys | doubtful
        negatives = [p for p in clean if " ".join(p) not in apart] + [p for p in mixed if " ".join(p) not in apart | clean_keys]
        rest = [p for p in background + broken + hard if " ".join(p) not in apart]
        bags = [*positives, *negatives, *rest]
        if not positives or len(positives) == len(bags):
            return Screen([(np.zeros((rules.buckets, rules.dimension), np.float32), np.zeros((rules.dimension, 2), np.float32), np.array([0, -50], np.float32))], rules)
        labels = np.array([1] * len(positives) + [0] * (len(bags) - len(positives)))
        weight = np.ones(len(bags))
        weight[labels == 1] = max(1.0, 0.15 * len(bags) / max(1, labels.sum()))
        weight[len(positives) + len(negatives) :] = rules.background_weight
        weight[len(bags) - sum(" ".join(p) not in apart for p in hard) :] = 2.0  # the last of ``rest``
        return fit(bags, labels, weight, replace(rules, seed=rules.seed + salt))

    for _ in range(rules.rounds):
        for f in range(rules.folds):
            out = [i for i in range(len(harmful)) if i % rules.folds == f]
            if out:
                found = _harmful_phrases([suspect[i] for i in out], fitted([i for i in range(len(harmful)) if i % rules.folds != f]))
                for i, p in zip(out, found, strict=True):
                    chosen[i] = p
        # phrases of other documents that the model finds harmful: suspect ones teach nothing, as
        # raters also overlook harm; the rest are what it has to learn
        whole = fitted(list(range(len(harmful))))
        found = _harmful_phrases([pool], whole, -2.0)[0]
        doubtful = {" ".join(p) for p in found if suspicion(p) >= rules.least_odds}
        hard = first([hard, [p for p in found if suspicion(p) < rules.least_odds]], rules.max_phrases // 2)
    every = [fitted(list(range(len(harmful))), k) for k in range(rules.members)]
    return Screen([m for s in every for m in s.members], rules)


# -- over a corpus ---------------------------------------------------------------------------


class PartCache:
    """Numbers and parts of the words met so far: 0 a phrase end, 1 a text end, else a word."""

    def __init__(self, screen: Screen):
        self.screen = screen
        self.numbers = {e: 0 for e in _ENDS} | {_NEXT: 1}
        self.parts = np.zeros(2)

    def encode(self, pieces: list[str]) -> np.ndarray:
        get = self.numbers.get
        at = np.fromiter(map(get, pieces, repeat(-1)), np.int64, len(pieces))
        new = np.flatnonzero(at < 0)
        if len(new):
            words = sorted({pieces[i] for i in new})
            self.numbers.update(zip(words, range(len(self.parts), len(self.parts) + len(words)), strict=True))
            self.parts = np.append(self.parts, self.screen.parts([plain_word(w) for w in words]))
            at[new] = [get(pieces[i]) for i in new]
        return at


def score_texts(texts: list[str | None], cache: PartCache) -> np.ndarray:
    """The score of the worst phrase of each text; 0 for a text without words."""
    at = cache.encode(plain_pieces([t or "" for t in texts]))
    out = np.zeros(len(texts))
    words = np.flatnonzero(at > 1)
    if not len(words):
        return out
    doc, phrase = np.cumsum(at == 1)[words], np.cumsum(at <= 1)[words]
    value = cache.parts[at[words]]
    w = cache.screen.rules.window
    starts = np.flatnonzero(np.append(True, phrase[1:] != phrase[:-1]))
    length = np.diff(np.append(starts, len(words)))
    best = np.full(len(texts), -np.inf)
    short = length <= w + w // 2
    np.maximum.at(best, doc[starts[short]], (np.add.reduceat(value, starts) / np.maximum(length, cache.screen.rules.least_words))[short])
    if (~short).any():
        total = np.cumsum(np.append(0.0, value))
        k = np.arange(max(0, len(words) - w + 1))
        k = k[(phrase[k] == phrase[k + w - 1]) & np.repeat(~short, length)[k]]
        np.maximum.at(best, doc[k], (total[k + w] - total[k]) / w)
    known = best > -np.inf
    out[known] = 1 / (1 + np.exp(-(best[known] + cache.screen.offset)))
    return out


#: Words whose parts a worker keeps.
_CACHE_WORDS = 1_000_000


def training_documents(docs: DataFrame, reviews: DataFrame, rules: ScreenRules) -> list[tuple[str, float | None]]:
    """(text, part of the verdicts that say offensive) of at most ``max_reviewed`` documents, and
    (text, None) of ``background`` others.

    A verdict is read without case and surrounding blanks; others than offensive and ok, and a
    rater's repeated entry of the same review, do not count.
    """
    verdict = F.lower(F.trim("verdict"))
    votes = reviews.select("doc_id", "rater", "reviewed_at", verdict.alias("v")).where(F.col("v").isin("offensive", "ok")).distinct()
    by_doc = votes.groupBy("doc_id").agg(F.avg((F.col("v") == "offensive").cast("double")).alias("share"))
    picked = by_doc.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rules.max_reviewed)
    others = docs.select("doc_id").join(by_doc, "doc_id", "left_anti").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rules.background)
    wanted = picked.unionAll(others.select("doc_id", F.lit(None).cast("double")))
    rows = docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id")  # at most max_reviewed + background rows
    return [(r["text"], r["share"]) for r in sorted(rows.collect(), key=lambda r: r["doc_id"])]


def store(screen: Screen, spark: SparkSession) -> DataFrame:
    """A fitted model as a written table of a row per member, for ``load``."""
    rows = [(k, *[bytearray(a.astype("<f4").tobytes()) for a in m]) for k, m in enumerate(screen.members)]
    return materialize(spark.createDataFrame(rows, "member int, table binary, weights binary, bias binary").coalesce(1), "screen")


def load(stored: DataFrame, rules: ScreenRules) -> Screen:
    """The model that ``store`` wrote, to be used with the rules it was fitted under."""
    members = []
    for row in sorted(stored.collect(), key=lambda r: r["member"]):  # ``members`` rows
        table, weights, bias = (np.frombuffer(b, "<f4") for b in row[1:])
        members.append((table.reshape(rules.buckets, rules.dimension), weights.reshape(rules.dimension, 2), bias))
    return Screen(members, rules)


_FITTED: dict[tuple, DataFrame] = {}


def fitted_screen(docs: DataFrame, reviews: DataFrame, rules: ScreenRules, name: str) -> Screen:
    """The model of the data called ``name``: fitted and stored once per application, then loaded."""
    spark = docs.sparkSession
    key = (spark.sparkContext.applicationId, name, rules)
    if key in _FITTED:
        try:
            return load(_FITTED[key], rules)
        except Exception:  # the intermediate tables were dropped
            del _FITTED[key]
    _FITTED[key] = store(train(training_documents(docs, reviews, rules), rules), spark)
    return load(_FITTED[key], rules)


def score_documents(docs: DataFrame, screen: Screen, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(doc_id, source, score) of every row: 0 to 1, over the whole text; 0 for null and empty texts."""
    shared = docs.sparkSession.sparkContext.broadcast(screen)  # buckets x dimension numbers

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = PartCache(shared.value)
        for batch in batches:
            texts = batch.column(2)
            scores = [score_texts(texts.slice(k, 256).to_pylist(), cache) for k in range(0, len(texts), 256)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate([*scores, np.zeros(0)]))], ["doc_id", "source", "score"])
            if len(cache.parts) > _CACHE_WORDS:
                cache = PartCache(shared.value)

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(source_col).cast("string"), F.col(text_col).cast("string")).mapInArrow(score, f"doc_id {id_type}, source string, score double")


def source_rates(scores: DataFrame, rules: ScreenRules) -> DataFrame:
    """(source, documents, cases, rate): null sources are one source."""
    case = F.col("score") >= rules.threshold
    return scores.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.count_if(case).alias("cases"), F.round(F.avg(case.cast("double")), 6).alias("rate"))
