"""Records that differ only in formatting, collapsed and counted.

Recursive radix partitioning on canonical bytes: prefixes that hold too many records are split
by further bytes until each bucket fits, or holds a single text and cannot be split; a trie per
bucket then counts each text at its terminal node.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparquill.llm.statements import canonical_array, digests, first_places
from sparquill.operators.balance import balanced_join, lookup
from sparquill.storage import materialize


@dataclass(frozen=True)
class RadixRules:
    """``bucket_records``: partial counts that one trie may hold; ``step``: bytes a level adds to
    the prefix that a bucket's texts share."""

    bucket_records: int = 50_000
    step: int = 8


class CountingTrie:
    """Path-compressed trie over bytes; a terminal holds (records, smallest id)."""

    __slots__ = ("_root",)

    def __init__(self) -> None:
        self._root: list = [{}, None]  # children by first byte: (edge, node); terminal counter

    def add(self, key: bytes, records: int, least_id: int) -> None:
        node, at = self._root, 0
        while at < len(key):
            child = node[0].get(key[at])
            if child is None:
                new: list = [{}, None]
                node[0][key[at]] = (key[at:], new)
                node = new
                break
            edge, below = child
            if key.startswith(edge, at):
                node, at = below, at + len(edge)
                continue
            n = 1
            while n < len(edge) and at + n < len(key) and edge[n] == key[at + n]:
                n += 1
            middle: list = [{edge[n]: (edge[n:], below)}, None]
            node[0][key[at]] = (edge[:n], middle)
            node, at = middle, at + n
        held = node[1]
        node[1] = (records, least_id) if held is None else (held[0] + records, min(held[1], least_id))

    def items(self) -> Iterator[tuple[bytes, int, int]]:
        stack = [(b"", self._root)]
        while stack:
            prefix, (children, held) = stack.pop()
            if held is not None:
                yield prefix, held[0], held[1]
            stack += [(prefix + edge, node) for edge, node in children.values()]


def _canonical_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, key, text, n, least, kept...): a text comes with the first of its rows in the batch
    only, together with the batch's count and least id of it."""
    for batch in batches:
        ids, texts = batch.column(0), canonical_array(batch.column(1))
        codes = texts.dictionary_encode().indices
        first = pa.compute.and_(first_places(codes), texts.is_valid())
        sums = pa.table({"k": codes, "id": ids}).group_by("k").aggregate([("id", "count"), ("id", "min")])
        order = pa.compute.index_in(codes, value_set=sums["k"].combine_chunks())
        null = pa.scalar(None, pa.int64())
        n = pa.compute.if_else(first, sums["id_count"].combine_chunks().take(order), null)
        least = pa.compute.if_else(first, sums["id_min"].combine_chunks().take(order), null)
        text = pa.compute.if_else(first, texts, pa.scalar(None, pa.string()))
        yield pa.RecordBatch.from_arrays([ids, digests(texts), text, n, least, *batch.columns[2:]], ["id", "key", "text", "n", "least", *batch.schema.names[2:]])


def canonical_records(df: DataFrame, id_col: str, text_col: str, keep: Sequence[str] = ()) -> DataFrame:
    """Written table (id, key, text, n, least, keep...) of the records.

    ``key`` is the digest of the canonical text, null for a null text. ``text``, ``n`` and
    ``least`` are partial counts, combined per Arrow batch: null but on the first row of a text
    in its batch. ``keep`` names columns to go along, none of the names above.
    """
    rows = df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"), *keep)
    kept = "".join(f", `{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return materialize(rows.mapInArrow(_canonical_rows, f"id long, key binary, text string, n long, least long{kept}"), "canonical")


def _combine(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Partial counts of an input partition added up, in a trie of at most ``limit`` texts at a time."""

    def result(trie: CountingTrie) -> pa.RecordBatch:
        texts, n, least = zip(*trie.items(), strict=True)
        return pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()), pa.array(n, pa.int64()), pa.array(least, pa.int64())], ["bytes", "n", "least"])

    trie, held = CountingTrie(), 0
    for batch in batches:
        for text, n, least in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            trie.add(text, n, least)
            held += 1
        if held >= limit:
            yield result(trie)
            trie, held = CountingTrie(), 0
    if held:
        yield result(trie)


def _prefix(length):
    return F.substring("bytes", F.lit(1), length)


def _shared(a: str, b: str):
    """How many bytes two binary columns begin with in common."""
    short = F.least(F.length(a), F.length(b))
    places = F.when(short > 0, F.sequence(F.lit(1), short)).otherwise(F.array().cast("array<int>"))
    differ = F.filter(places, lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))
    return F.when(F.size(differ) > 0, F.element_at(differ, 1) - 1).otherwise(short)


def oversized(rest: DataFrame, rules: RadixRules) -> DataFrame:
    """Written table (bucket, length) of the buckets with more than ``bucket_records`` partial
    counts of more than one text, with the length of the prefixes to split them by.

    The bytes between those of all texts that the least and the greatest text share are the
    same, so a level skips them: each level splits every bucket it touches.
    """
    sizes = rest.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"), F.min("bytes").alias("a"), F.max("bytes").alias("b"))
    large = sizes.where((F.col("rows") > rules.bucket_records) & (F.col("a") != F.col("b")))
    return materialize(large.select("bucket", (_shared("a", "b") + rules.step).alias("length")), "oversized")


def radix_buckets(partials: DataFrame, rules: RadixRules) -> DataFrame:
    """``partials`` (bytes, n, least), a written table, with ``bucket``: the shortest prefix that fits.

    Prefixes stay a distributed table; only the records below oversized ones go to a next level.
    """
    fit: list[DataFrame] = []
    rest = partials.withColumn("bucket", _prefix(F.lit(rules.step)))
    while True:
        large = oversized(rest, rules)
        if large.isEmpty():
            break
        marked = lookup(rest, large, ["bucket"], "left")
        fit.append(marked.where(F.col("length").isNull()).drop("length"))
        below = marked.where(F.col("length").isNotNull())
        rest = materialize(below.select("bytes", "n", "least", _prefix(F.col("length")).alias("bucket")), "radix")
    out = rest
    for part in fit:
        out = out.unionByName(part)
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Count bucket after bucket of a partition sorted by bucket; one trie is alive at a time."""

    def result(trie: CountingTrie) -> pa.RecordBatch:
        found, n, least = zip(*trie.items(), strict=True)
        texts = pa.array([t.decode() for t in found], pa.string())
        return pa.RecordBatch.from_arrays([digests(texts), texts, pa.array(n, pa.int64()), pa.array(least, pa.int64())], ["key", "text", "copies", "first_id"])

    trie, current = CountingTrie(), None
    for batch in batches:
        for bucket, text, n, least in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if bucket != current and current is not None:
                yield result(trie)
                trie = CountingTrie()
            current = bucket
            trie.add(text, n, least)
    if current is not None:
        yield result(trie)


def partial_counts(records: DataFrame, rules: RadixRules) -> DataFrame:
    """Written table (bytes, n, least): the texts' partial counts, combined per input partition.

    A text of a third of all rows leaves one count per partition, not one per row.
    """
    rows = records.where(F.col("text").isNotNull()).select(F.encode("text", "utf-8").alias("bytes"), "n", "least")
    limit = rules.bucket_records
    return materialize(rows.mapInArrow(lambda batches: _combine(batches, limit), "bytes binary, n long, least long"), "partials")


def count_statements(records: DataFrame, rules: RadixRules | None = None) -> DataFrame:
    """(key, text, copies, first_id) of every canonical text of ``canonical_records``."""
    rules = rules or RadixRules()
    n = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = radix_buckets(partial_counts(records, rules), rules).select("bucket", "bytes", "n", "least").repartition(n, "bucket").sortWithinPartitions("bucket")
    return placed.mapInArrow(_count, "key binary, text string, copies long, first_id long")


def collapse(df: DataFrame, id_col: str, text_col: str, rules: RadixRules | None = None) -> DataFrame:
    """(first_id, copies, text): one row per statement, its smallest id and its records.

    Null texts are no statements; texts of only blanks are one statement; repeated ids count
    as often as they occur; an empty table gives none. Other columns are not read.
    """
    return count_statements(canonical_records(df, id_col, text_col), rules).select("first_id", "copies", "text")


def copies(df: DataFrame, id_col: str, text_col: str, rules: RadixRules | None = None) -> DataFrame:
    """(first_id, copy_id) of every record that is not the first of its statement.

    Statements with many copies are joined over several tasks.
    """
    records = canonical_records(df, id_col, text_col)
    repeated = materialize(count_statements(records, rules).where(F.col("copies") > 1).select("key", "first_id"), "statements")
    pairs = balanced_join(records.select("key", F.col("id").alias("copy_id")), repeated, ["key"])
    return pairs.where(F.col("copy_id") != F.col("first_id")).select("first_id", "copy_id")
