"""Sources mixed to target weights by a low-discrepancy schedule.

Every source's documents are shuffled and laid end to end in blocks of equal tokens. Slot i of
the schedule takes the source that the i-th golden-ratio point falls to on the line of
cumulative weights; the k-th slot of a source takes its k-th block, beginning anew after the
last. A document longer than a block fills the slots of the blocks that it reaches over, whose
sources then bring nothing else, so long documents change neither shares nor block sizes.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparquill.operators.ordering import ordered_table, with_position
from sparquill.storage import materialize

_GOLDEN = 0.6180339887498949
#: Fixed value: how the rank files' texts are split before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@dataclass(frozen=True)
class MixRules:
    """``vocabulary``: a rank file of a public tokenizer; ``block_tokens``: tokens of a block;
    ``seed``: of the shuffle."""

    vocabulary: str = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    block_tokens: int = 2048
    seed: int = 20240501


def load_vocabulary(path: str) -> bytes:
    """The rank file, read on the driver; files above 64 MB are refused, as executors get a copy."""
    data = Path(path).read_bytes()
    if len(data) > 64 << 20:
        raise ValueError("the rank file is too large to send to the executors")
    return data


_ENCODERS: dict[int, object] = {}


def _encoder(data: bytes):
    key = hash(data)
    if key not in _ENCODERS:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}
        _ENCODERS[key] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[key]


def token_counts(df: DataFrame, id_col: str, source_col: str, text_col: str, rules: MixRules) -> DataFrame:
    """(doc_id, source, n_tokens) of every row, over whole texts; a null text has no tokens."""
    shared = df.sparkSession.sparkContext.broadcast(load_vocabulary(rules.vocabulary))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(shared.value).encode_ordinary
        for batch in batches:
            n = [len(encode(t)) if t else 0 for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["doc_id", "source", "n_tokens"])

    id_type = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, F.col(source_col).cast("string"), F.col(text_col).cast("string")).mapInArrow(count, f"doc_id {id_type}, source string, n_tokens long")


def pack_blocks(counts: DataFrame, rules: MixRules) -> tuple[DataFrame, dict[str, dict]]:
    """``counts``, a written table, with ``block`` and ``place``, and for each source its documents,
    tokens and blocks.

    A source's documents stand in hashed order; block b holds those whose middle token lies in
    the b-th of equal parts of the source's tokens, about ``block_tokens`` each. A block within
    a longer document is empty.
    """
    known = counts.where(F.col("source").isNotNull())
    line = ordered_table(known.withColumn("turn", F.xxhash64("doc_id", F.lit(rules.seed))), ["source", "turn", "doc_id"], "shuffled")
    stats = {r["source"]: r.asDict() for r in line.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_tokens").alias("tokens")).collect()}  # a row per listed source
    for s in stats.values():
        s["blocks"] = max(1, round(s["tokens"] / rules.block_tokens))
    spark = counts.sparkSession
    sizes = spark.createDataFrame([(k, s["tokens"], s["blocks"]) for k, s in stats.items()], "source string, all_tokens long, blocks long")
    pieces = line.groupBy("source", "_part").agg(F.sum("n_tokens").alias("held")).collect()  # a row per source and sort partition
    before: dict[str, int] = {}
    offsets = []
    for r in sorted(pieces, key=lambda r: (r["source"], r["_part"])):
        offsets.append((r["source"], r["_part"], before.get(r["source"], 0)))
        before[r["source"]] = before.get(r["source"], 0) + r["held"]
    shifts = spark.createDataFrame(offsets, "source string, _part int, shift long")
    up = Window.partitionBy("source", "_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    middle = F.col("shift") + F.sum("n_tokens").over(up) - F.col("n_tokens") / 2
    part = F.when(F.col("all_tokens") == 0, 0).otherwise(F.floor(middle * F.col("blocks") / F.col("all_tokens")))
    packed = line.join(F.broadcast(shifts), ["source", "_part"]).join(F.broadcast(sizes), "source").withColumn("block", F.least(part, F.col("blocks") - 1).cast("long"))
    return packed.select("doc_id", "source", "n_tokens", "block", (F.col("_part").cast("long") * F.lit(1 << 33) + F.col("_row")).alias("place")), stats


def schedule(spark, stats: dict[str, dict], targets: dict[str, tuple[float, int]]) -> DataFrame:
    """(slot, source, block, repeat_no): the longest schedule that uses no block too often.

    ``targets``: share and most repeats of each source. Sources without documents or with a
    share of 0 get no slots; the others keep the proportions of their shares.
    """
    live = {s: (share, most) for s, (share, most) in targets.items() if share > 0 and most > 0 and s in stats and stats[s]["tokens"] > 0}
    if not live:
        return spark.createDataFrame([], "slot long, source string, block long, repeat_no long")
    names = sorted(live)
    # a slot of a source brings tokens / blocks of it
    weight = [live[s][0] * stats[s]["blocks"] / stats[s]["tokens"] for s in names]
    weight = [w / sum(weight) for w in weight]
    caps = [stats[s]["blocks"] * live[s][1] for s in names]
    longest = math.ceil(min(c / w for c, w in zip(caps, weight, strict=True))) + 16 * len(names)
    bounds, reach = [], 0.0
    for w in weight[:-1]:
        reach += w
        bounds.append(reach)
    u = (F.col("slot") + 0.5) * _GOLDEN
    point = u - F.floor(u)
    pick = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]).cast("array<double>"), lambda b: b <= F.col("point"))) if bounds else F.lit(0)
    slots = spark.range(longest).select(F.col("id").alias("slot")).withColumn("point", point).withColumn("k", pick).select("slot", "k")
    line = with_position(ordered_table(slots, ["k", "slot"], "slots"))
    starts = line.groupBy("k").agg(F.min("_pos").alias("start"))  # a row per source
    info = spark.createDataFrame([(k, s, stats[s]["blocks"], caps[k]) for k, s in enumerate(names)], "k int, source string, blocks long, cap long")
    ranked = line.join(F.broadcast(starts), "k").join(F.broadcast(info), "k").withColumn("nth", F.col("_pos") - F.col("start"))
    end = ranked.where(F.col("nth") >= F.col("cap")).agg(F.min("slot")).first()[0]
    if end is not None:
        ranked = ranked.where(F.col("slot") < end)
    return ranked.select("slot", "source", (F.col("nth") % F.col("blocks")).alias("block"), (F.expr("nth div blocks") + 1).alias("repeat_no"))


def mix(documents: DataFrame, targets: DataFrame, rules: MixRules | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(slot, place, doc_id, source, repeat_no, n_tokens): the mixed sequence, by slot and place.

    ``targets`` (source, target_share, max_repeats) is a configuration table, one row per
    source, held by the driver; null shares and repeats count as 0. The sequence is as long as
    the repeats allow. Documents without a listed source take no part. An empty table gives
    no rows.
    """
    rules = rules or MixRules()
    wanted = {r[0]: (float(r[1] or 0), int(r[2] or 0)) for r in targets.where(F.col("source").isNotNull()).select("source", "target_share", "max_repeats").collect()}
    listed = documents.where(F.col(source_col).isin(list(wanted)))
    # written, as the order below is sampled before it is made: the texts are encoded once
    counts = materialize(token_counts(listed, id_col, source_col, text_col, rules), "token_counts")
    packed, stats = pack_blocks(counts, rules)
    slots = schedule(documents.sparkSession, stats, wanted)
    # a block's slots are as many as its repeats, its documents as many as a block holds
    return slots.join(packed, ["source", "block"]).select("slot", "place", "doc_id", "source", "repeat_no", "n_tokens")


def mix_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Of each listed source: target and reached share of tokens, tokens, uses and most uses of one document."""
    uses = mixed.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("t"))
    by_source = uses.groupBy("source").agg(F.sum("t").alias("tokens"), F.sum("n").alias("uses"), F.max("n").alias("most_uses"), F.count(F.lit(1)).alias("documents"))
    joined = targets.select("source", "target_share", "max_repeats").join(by_source, "source", "left")
    every = F.sum("tokens").over(Window.partitionBy(F.lit(0)))  # a row per listed source
    count = [F.coalesce(c, F.lit(0)).alias(c) for c in ("tokens", "uses", "most_uses", "documents")]
    return joined.select("source", "target_share", "max_repeats", F.round(F.coalesce(F.col("tokens") / every, F.lit(0.0)), 6).alias("reached_share"), *count)
