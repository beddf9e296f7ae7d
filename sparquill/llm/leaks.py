"""Passages of held-out items inside a corpus.

A prefix-filtered set join over letters. A text counts as the run of its letters and digits, so
that spacing, punctuation and divided words make no difference; a shingle is the letters of five
successive item words, found at any place of a document. The corpus is read twice, past filters
of fixed size. First, how many documents hold a shingle gives its rarity. Then the rarest
shingles of every item window, of which a true passage must hold one, leave their places and the
letters around them, which are joined with the items; length and positional bounds discard
those that cannot reach twelve words; the rest are verified word by word over a window of the
item's size.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparquill.operators.balance import lookup
from sparquill.sources.tables import widened
from sparquill.storage import materialize


@dataclass(frozen=True)
class LeakRules:
    """``min_words`` successive words of an item, at most one in ``per_change`` of them changed.

    ``most_filter_bits``: log2 of the bits of each of the two filters that the executors get.
    More item shingles than fit let more places through to the exact join, nothing else.
    """

    min_words: int = 12
    per_change: int = 8
    shingle: int = 5
    most_filter_bits: int = 28


#: A word divided at a line end, and soft hyphens.
_DIVIDED = re.compile(r"[-‐‑¬­](?<=\w.)[ \t]*\n\s*(?=\w)|­")
_WORD = re.compile(r"[^\W_]+")
#: Extra letters of context: passages may hold a few words more in the document than in the item.
_SLACK = 200
#: Letters hashed at a time, for the processor's caches; and letters a shingle's ends are hashed by.
_BLOCK, _ENDS = 1 << 16, (4, 8, 16, 32)


def folded(text: str) -> str:
    """A text without differences of case and of compatible characters."""
    if not text.isascii() and not unicodedata.is_normalized("NFKC", text):
        text = unicodedata.normalize("NFKC", text)
    return text.casefold()


def words_of(text: str | None) -> list[str]:
    """The words of a text without case, punctuation, spacing and division at line ends."""
    if not text:
        return []
    text = folded(text)
    if "\n" in text or "­" in text:
        text = _DIVIDED.sub("", text)
    return _WORD.findall(text)


@cache
def _is_letter() -> np.ndarray:
    return np.array([chr(i).isalnum() for i in range(0x110000)])


@dataclass
class Letters:
    """The letters of several texts in a row: their codes, which of them begin a word, and where
    each text begins (with the end of all as the last)."""

    codes: np.ndarray
    begins: np.ndarray
    texts: np.ndarray

    @staticmethod
    def of(texts: Sequence[str | None]) -> Letters:
        ready = [folded(t) if t else "" for t in texts]
        codes = np.frombuffer("\n".join(ready).encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.flatnonzero(_is_letter()[codes])
        begins = np.ones(len(at) + 1, bool)
        begins[1:-1] = at[1:] != at[:-1] + 1
        ends = np.cumsum([len(t) + 1 for t in ready]) if ready else np.zeros(0, np.int64)
        return Letters(codes[at], begins, np.searchsorted(at, np.append(0, ends)))


_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a * _FACTOR + b) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def end_hashes(codes: np.ndarray) -> dict[int, np.ndarray]:
    """By length, a hash of the letters from every place on; lengths double."""
    h, out, k = codes.astype(np.uint64), {}, 1
    while k < _ENDS[-1]:
        h = _mixed(h[: max(0, len(h) - k)], h[k:]) if len(h) > k else h[:0]
        k *= 2
        if k in _ENDS:
            out[k] = h
    return out


def _end_length(letters: int) -> int:
    """The length of the ends that hash a shingle: over half of it, if it is no longer than 63."""
    return max((e for e in _ENDS if e <= letters), default=0)


def item_shingles(words: Sequence[str], rules: LeakRules) -> list[tuple[int, int, int, int]]:
    """(place, letters, head, token) of every shingle: hashes of its first letters and of all.

    A shingle has at least one letter a word, so its ends are four letters at least.
    """
    out = []
    for p in range(len(words) - rules.shingle + 1):
        codes = np.array([ord(c) for c in "".join(words[p : p + rules.shingle])], np.uint32)
        e = _end_length(len(codes))
        h = end_hashes(codes)[e]
        head = _mixed(h[:1], np.array([e], np.uint64))
        token = _mixed(_mixed(h[:1], h[-1:]), np.array([len(codes)], np.uint64))
        out.append((p, len(codes), int(head.view(np.int64)[0]), int(token.view(np.int64)[0])))
    return out


@dataclass(frozen=True)
class ShingleFilter:
    """Bit tables of the heads and of the tokens of all item shingles, and their lengths in letters."""

    bits: int
    heads: np.ndarray
    tokens: np.ndarray
    lengths: tuple[int, ...]

    def holds(self, table: np.ndarray, h: np.ndarray) -> np.ndarray:
        at = h >> np.uint64(64 - self.bits)
        return ((table[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)

    def held(self, token: np.ndarray) -> np.ndarray:
        """Which tokens may be an item's: both of a token's bits are set."""
        return self.holds(self.tokens, token) & self.holds(self.tokens, token << np.uint64(32))

    def places(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and tokens of the possible shingles among letters."""
        at, found = [], []
        for begin in range(0, len(codes), _BLOCK):
            longest = self.lengths[-1] if self.lengths else 0
            block = codes[begin : begin + _BLOCK + longest + _ENDS[-1]]
            for e, h in end_hashes(block).items():
                lengths = [n for n in self.lengths if _end_length(n) == e]
                if not lengths:
                    continue
                some = np.flatnonzero(self.holds(self.heads, _mixed(h[:_BLOCK], np.uint64(e))))
                for n in lengths if len(some) else ():
                    s = some[some + n - e < len(h)]
                    token = _mixed(_mixed(h[s], h[s + n - e]), np.uint64(n))
                    hit = self.held(token)
                    at.append(s[hit] + begin)
                    found.append(token[hit])
        if not at:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at, found = np.concatenate(at), np.concatenate(found)
        order = np.argsort(at, kind="stable")
        return at[order], found[order]


def _bit_table(hashes: DataFrame, column: Column, bits: int) -> np.ndarray:
    """A table of 2 ** bits bits with those of the column's hashes set, put together by 8 kB pieces."""

    def piece(t: pa.Table) -> pa.Table:
        at = t["at"].to_numpy() & 0xFFFF
        flags = np.zeros(1 << 16, np.uint8)
        flags[at] = 1
        return pa.table({"piece": t["piece"].slice(0, 1), "bytes": pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())})

    at = F.shiftrightunsigned(column, 64 - bits)
    rows = hashes.select(at.alias("at")).distinct().withColumn("piece", F.shiftright("at", 16)).groupBy("piece").applyInArrow(piece, "piece long, bytes binary").collect()  # 2 ** bits bits at most
    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in rows:
        out[r["piece"] << 13 : (r["piece"] + 1) << 13] = np.frombuffer(r["bytes"], np.uint8)
    return out


def shingle_filter(shingles: DataFrame, rules: LeakRules) -> ShingleFilter:
    """The filter of ``shingles`` (letters, head, token), with 512 bits for each up to the bound: of
    other places, hardly one in a hundred documents passes."""
    bits = min(rules.most_filter_bits, max(16, math.ceil(math.log2(512 * max(1, shingles.count())))))
    lengths = sorted(r[0] for r in shingles.select("letters").distinct().collect())  # as many as lengths in letters
    tokens = shingles.select(F.explode(F.array("token", F.shiftleft("token", 32))).alias("token"))  # two bits of each
    return ShingleFilter(bits, _bit_table(shingles, F.col("head"), bits), _bit_table(tokens, F.col("token"), bits), tuple(lengths))


def least_overlap(n: int, rules: LeakRules) -> int:
    """Shingles that a passage of n words shares at least, with as many changes as allowed."""
    return n - rules.shingle + 1 - rules.shingle * (n // rules.per_change)


def prefix_places(rarity: np.ndarray, rules: LeakRules) -> np.ndarray:
    """Of an item's shingles, those that candidates are made of; ``rarity``: how many documents hold each.

    Every passage that counts holds a part of ``min_words`` to just under twice as many words
    that counts. A change breaks at most ``shingle`` shingles, a divided or joined word none. So
    of each such window with m shingles, a passage shares at least o, and one of the m - o + 1
    rarest.
    """
    words = len(rarity) + rules.shingle - 1
    keep = np.zeros(len(rarity), bool)
    for n in range(rules.min_words, min(2 * rules.min_words, words + 1)):
        m = n - rules.shingle + 1
        take = m - max(1, least_overlap(n, rules)) + 1
        windows = np.arange(words - n + 1)[:, None] + np.arange(m)
        order = np.argsort(rarity[windows], axis=1, kind="stable")[:, :take]
        keep[np.take_along_axis(windows, order, axis=1)] = True
    return np.flatnonzero(keep & (rarity > 0))


def _places(word: Sequence[str], text: str, after: int, upto: int) -> Iterator[int]:
    """Where the word, if there is one, begins in the text, after one place and up to another."""
    for w in word:
        q = text.find(w, after + 1, upto + len(w))
        while q >= 0:
            yield q
            q = text.find(w, q + 1, upto + len(w))


def _reach(words: Sequence[str], text: str, edges: Sequence[int], most: int, size: int, per_change: int) -> list[int]:
    """By number of changes, how many words from the start of ``text`` on it can hold at most, the
    last of them unchanged and ending at one of the ``edges`` of the text's words.

    -1: not even the place where it begins is an edge. A change leaves a word out, replaces it by
    letters of up to two words, or puts in letters of up to one word (one edge and none lie
    among them). Between two changes it is enough to stop at edges. More than two changes are
    only tried where enough words were met before them; a passage that counts holds one with at
    most two.
    """
    n, known = len(words), set(edges)
    best: list[int] = []
    states = {(0, 0)}
    done: set[tuple[int, int]] = set()
    top = 0 if 0 in known else -1
    for c in range(most + 1):
        stack, reached = list(states), set()
        while stack:
            i, p = stack.pop()
            if (i, p) in done:
                continue
            done.add((i, p))
            reached.add((i, p))
            if i < n and text.startswith(words[i], p):
                q = p + len(words[i])
                stack.append((i + 1, q))
                if q in known:
                    top = max(top, i + 1)
        best.append(top)
        far = max((i for i, _ in reached), default=0)
        if not reached or (c >= 2 and size + far < per_change * (c - 1)):
            break
        states = set()
        for i, p in reached:
            k = bisect_right(edges, p)
            nexts = edges[k : k + 2]
            if i < n:
                states.update((i + 1, q) for q in (p, *nexts))
            if nexts:
                states.add((i, nexts[0]))
                states.update((i, q) for q in _places(words[i : i + 1], text, p, nexts[0]))
                states.update((i + 1, q) for q in _places(words[i + 1 : i + 2], text, p, nexts[-1]))
        states -= done
    return best


def passage(item: Sequence[str], text: str, edges: Sequence[int], item_at: int, text_at: int, rules: LeakRules) -> tuple[int, int] | None:
    """(words, changes) of a passage that counts around a shared shingle; None without one.

    ``edges``: the places in ``text`` at which words begin, and its end.
    """
    size = rules.shingle
    most = len(item) // rules.per_change
    room = sum(map(len, item)) + _SLACK
    end = text_at + sum(map(len, item[item_at : item_at + size]))
    begin, stop = max(0, text_at - room), min(len(text), end + room)
    around = [e for e in edges if begin <= e <= stop]
    right = _reach(item[item_at + size :], text[end:stop], [e - end for e in around if e >= end], most, size, rules.per_change)
    left = _reach([w[::-1] for w in item[:item_at][::-1]], text[begin:text_at][::-1], [text_at - e for e in reversed(around) if e <= text_at], most, size, rules.per_change)
    best = None
    for a, x in enumerate(left):
        for b, y in enumerate(right):
            n, k = x + y + size, a + b
            if n >= rules.min_words and k * rules.per_change <= n and (best is None or (n, -k) > (best[0], -best[1])):
                best = (n, k)
    return best


def _near(at: np.ndarray, low: int, high: int, room: int) -> list[tuple[int, int]]:
    """Merged stretches of ``room`` letters around places."""
    gap = np.flatnonzero(np.diff(at) > 2 * room)
    first, last = np.append(at[:1], at[gap + 1]), np.append(at[gap], at[-1:])
    return [(max(low, int(a) - room), min(high, int(b) + room)) for a, b in zip(first, last, strict=True)]


def _some(batch: pa.RecordBatch, own: ShingleFilter) -> Iterator[tuple[int, Letters, np.ndarray, np.ndarray, np.ndarray]]:
    """By 64 texts of a batch: the first one's row, their letters, and the text, place and token of
    every possible shingle."""
    for k in range(0, batch.num_rows, 64):
        texts = Letters.of(batch.column(1).slice(k, 64).to_pylist())
        at, token = own.places(texts.codes)
        if len(at):
            yield k, texts, np.searchsorted(texts.texts, at, "right") - 1, at, token


def _rarity(docs: DataFrame, own: ShingleFilter) -> DataFrame:
    """Written table (token, n): how many documents hold each possible shingle, counted before the shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(own)  # two tables of 2 ** most_filter_bits bits at most

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, text, _, token in _some(batch, shared.value):
                once = np.unique(np.stack([text.astype(np.uint64), token]), axis=1)[1]
                held, n = np.unique(once, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(held.view(np.int64)), pa.array(n)], ["token", "n"])

    return materialize(docs.mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")), "rarity")


_STRETCH = "letters string, edges binary, places array<int>, tokens array<long>"


def _search(docs: DataFrame, own: ShingleFilter, room: int) -> DataFrame:
    """(doc_id, letters, edges, places, tokens, stretch) of the stretches of documents with possible
    shingles; ``edges`` has a bit for each letter that begins a word, and one for the end."""
    shared = docs.sparkSession.sparkContext.broadcast(own)  # two tables of 2 ** most_filter_bits bits at most

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, texts, text, at, token in _some(batch, shared.value):
                rows: list[list] = [[], [], [], [], []]
                for d in np.unique(text):
                    low, high = int(texts.texts[d]), int(texts.texts[d + 1])
                    i, j = np.searchsorted(at, (low, high))
                    for a, b in _near(at[i:j], low, high, room):
                        p, q = np.searchsorted(at, (a, b))
                        edges = np.append(texts.begins[a:b], b == high or texts.begins[b])
                        values = (k + int(d), texts.codes[a:b].tobytes().decode("utf-32-le", "surrogatepass"), np.packbits(edges).tobytes(), at[p:q] - a, token[p:q].view(np.int64))
                        for column, v in zip(rows, values, strict=True):
                            column.append(v)
                kinds = (pa.string(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows[0])), *[pa.array(c, t) for c, t in zip(rows[1:], kinds, strict=True)]], ["doc_id", "letters", "edges", "places", "tokens"])

    found = docs.mapInArrow(look, f"doc_id {docs.schema[0].dataType.simpleString()}, {_STRETCH}")
    return materialize(found.withColumn("stretch", F.monotonically_increasing_id()), "stretches")


def _shingled(items: DataFrame, rules: LeakRules) -> DataFrame:
    """Written table (item_key, place, letters, head, token) of the items' shingles."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                place, letters, head, token = zip(*item_shingles(words, rules), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(place), pa.int64()), pa.array(place, pa.int32()), pa.array(letters, pa.int32()), pa.array(head, pa.int64()), pa.array(token, pa.int64())], ["item_key", "place", "letters", "head", "token"])

    return materialize(items.select("item_key", "words").mapInArrow(split, "item_key long, place int, letters int, head long, token long"), "item_shingles")


def _prefixes(shingles: DataFrame, rarity: DataFrame, rules: LeakRules) -> DataFrame:
    """Those of ``shingles`` that candidates are made of, a written table."""
    ranked, names = lookup(shingles, rarity, ["token"], "left"), shingles.columns

    def choose(t: pa.Table) -> pa.Table:
        t = t.sort_by("place")
        return t.select(names).take(pa.array(prefix_places(t["n"].fill_null(0).to_numpy(), rules)))

    return materialize(ranked.groupBy("item_key").applyInArrow(choose, shingles.schema), "prefixes")


def _verify(candidates: DataFrame, rules: LeakRules) -> DataFrame:
    """(doc_id, item_id, words, changed) of candidates (doc_id, item_id, letters, edges, anchors, words)."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], []]
            for r, c in enumerate(batch.drop_columns(["doc_id", "item_id"]).to_pylist()):
                item, text, best = c["words"], c["letters"], None
                edges = np.flatnonzero(np.unpackbits(np.frombuffer(c["edges"], np.uint8))[: len(text) + 1]).tolist()
                spare = len(item) // rules.per_change
                tried = {(a["at"], a["place"]) for a in c["anchors"]}
                for at, p in sorted(tried):
                    # shingles one after the other lead to the same passage
                    if p and (at - len(item[p - 1]), p - 1) in tried:
                        continue
                    # a word that is held has a letter at least
                    after = len(text) - at - rules.shingle
                    if rules.shingle + min(p, at + spare) + min(len(item) - p - rules.shingle, after + spare) < rules.min_words:
                        continue
                    if not text.startswith("".join(item[p : p + rules.shingle]), at):
                        continue
                    hit = passage(item, text, edges, p, at, rules)
                    if hit and (best is None or hit > best):
                        best = hit
                if best:
                    for column, v in zip(out, (r, *best), strict=True):
                        column.append(v)
            rows = pa.array(out[0], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(rows), batch.column("item_id").take(rows), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32())], ["doc_id", "item_id", "words", "changed"])

    kinds = [candidates.schema[c].dataType.simpleString() for c in ("doc_id", "item_id")]
    return candidates.mapInArrow(confirm, f"doc_id {kinds[0]}, item_id {kinds[1]}, words int, changed int")


def leaked_items(docs: DataFrame, items: DataFrame, doc_id: str, doc_text: str, item_id: str, item_text: str, rules: LeakRules | None = None) -> DataFrame:
    """(doc_id, item_id, words, changed): the longest passage found of each item in each document.

    A passage is ``min_words`` or more successive words of the item, at most one in
    ``per_change`` of them changed, left out or put in; its first and last words are unchanged
    and begin and end where words of the document do. Words divided or joined by spacing count
    as unchanged. Null and empty texts hold nothing; items of fewer words are never found; rows
    that share an id are all searched and give one row. The corpus is read twice, whole; other
    columns are not read.
    """
    rules = rules or LeakRules()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([words_of(t) for t in batch.column(1).to_pylist()], pa.list_(pa.string()))], ["item_id", "words"])

    kind = items.schema[item_id].dataType.simpleString()
    split_items = items.where(F.col(item_id).isNotNull()).select(item_id, F.col(item_text).cast("string")).mapInArrow(split, f"item_id {kind}, words array<string>")
    known = materialize(split_items.where(F.size("words") >= rules.min_words).withColumn("item_key", F.monotonically_increasing_id()), "items")
    shingles = _shingled(known, rules)
    longest = known.agg(F.max(F.length(F.array_join("words", "")))).first()[0] or 0
    corpus = docs.select(F.col(doc_id).alias("doc_id"), F.col(doc_text).cast("string"))
    prefixes = _prefixes(shingles, _rarity(corpus, shingle_filter(shingles, rules)), rules)
    found = _search(corpus, shingle_filter(prefixes, rules), longest + _SLACK)
    places = found.select("stretch", F.inline(F.arrays_zip(F.col("places").alias("at"), F.col("tokens").alias("token"))))
    anchors = lookup(places, prefixes.select("token", "item_key", "place"), ["token"], written=False).groupBy("stretch", "item_key").agg(F.collect_list(F.struct("at", "place")).alias("anchors"))  # within a stretch
    held = materialize(anchors.join(found.select("stretch", "doc_id", "letters", "edges"), "stretch"), "candidates")
    passages = _verify(lookup(widened(held), known, ["item_key"]).select("doc_id", "item_id", "letters", "edges", "anchors", "words"), rules)
    best = passages.groupBy("doc_id", "item_id").agg(F.max(F.struct("words", (-F.col("changed")).alias("kept"))).alias("m"))
    return best.select("doc_id", "item_id", "m.words", (-F.col("m.kept")).alias("changed"))
