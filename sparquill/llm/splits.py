"""Train, validation and test splits that keep related records together.

Records are related by links: (member, hub) pairs from any number of rules. Borůvka rounds
contract every component along its least edge; the edges chosen form a spanning forest, kept
as a table. Roots are then stratified by size band and dealt systematically to the splits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparquill.llm.duplicates import canonical_records
from sparquill.operators.balance import lookup
from sparquill.operators.ordering import ordered_table
from sparquill.storage import materialize


def normal_id(column: Column) -> Column:
    """An id without case, surrounding blanks and the choice of separators.

    Runs of characters that are no letter, digit or colon count as one separator.
    """
    blanks = F.regexp_replace(F.lower(column), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    return F.regexp_replace(F.regexp_replace(blanks, r"[^\p{L}\p{N}:]+", "_"), "_?:_?", ":")


def star_edges(pairs: DataFrame, weight: int) -> DataFrame:
    """(u, v, w): every member of a hub linked to the hub's least member, u < v.

    ``pairs``: (member, hub), repeated as often as they occur. Linear in the members; a hub of
    many members is split over tasks.
    """
    distinct = pairs.where(F.col("member").isNotNull() & F.col("hub").isNotNull()).groupBy("hub", "member").agg(F.lit(1).alias("one"))
    distinct = materialize(distinct.select("hub", "member"), "members")
    least = materialize(distinct.groupBy("hub").agg(F.min("member").alias("u"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("hub", "u"), "hubs")
    return lookup(distinct, least, ["hub"]).where(F.col("member") != F.col("u")).select("u", F.col("member").alias("v"), F.lit(weight).alias("w")).distinct()


def _roots(pointers: DataFrame) -> DataFrame:
    """(c, root): follow pointers (c, to) to the end by doubling; roots point to themselves."""
    while True:
        up = pointers.select(F.col("c").alias("to"), F.col("to").alias("further"))
        jumped = materialize(lookup(pointers, up, ["to"]).select("c", F.col("further").alias("to"), (F.col("to") != F.col("further")).alias("moved")), "pointers")
        if jumped.where("moved").isEmpty():
            return jumped.select("c", F.col("to").alias("root"))
        pointers = jumped.select("c", "to")


def spanning_forest(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(forest, roots) of the graph ``edges`` (u, v, w) over comparable node ids.

    ``forest``: the chosen edges (u, v, w), a table; ``roots``: (node, root) of every node that
    has an edge. Edges are ordered by (w, u, v), a total order, so the least edges of a round
    contain no cycle but pairs that chose the same edge. Components at least halve with every
    round; only the contracted edges, the least of each pair of components, go on. Many edges
    may lead to one component: each step looks components up by a unique key, hot ones split.
    """
    edges = materialize(edges.where(F.col("u") != F.col("v")).select("u", "v", "w"), "edges")
    labels = materialize(edges.select(F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("root", F.col("node")), "labels")
    live = edges.select(F.col("u").alias("a"), F.col("v").alias("b"), F.struct("w", "u", "v").alias("e"))
    chosen: DataFrame | None = None
    while True:
        both = live.select(F.col("a").alias("c"), F.col("b").alias("to"), "e").unionAll(live.select(F.col("b"), F.col("a"), "e"))
        least = materialize(both.groupBy("c").agg(F.min(F.struct("e", "to")).alias("m")).select("c", "m.e", "m.to"), "least")
        if least.isEmpty():
            break
        picked = least.select("e.u", "e.v", "e.w").distinct()
        chosen = picked if chosen is None else chosen.unionAll(picked)
        # of the two components that chose the same edge, the smaller becomes the root
        back = least.select(F.col("c").alias("to"), F.col("to").alias("returns"))
        pointers = lookup(least.select("c", "to"), back, ["to"], "left").select("c", F.when((F.col("returns") == F.col("c")) & (F.col("c") < F.col("to")), F.col("c")).otherwise(F.col("to")).alias("to"))
        roots = _roots(materialize(pointers, "pointers"))
        merged = roots.select(F.col("c").alias("root"), F.col("root").alias("merged"))
        labels = materialize(lookup(labels, merged, ["root"], "left").select("node", F.coalesce("merged", "root").alias("root")), "labels")
        ra, rb = roots.select(F.col("c").alias("a"), F.col("root").alias("ra")), roots.select(F.col("c").alias("b"), F.col("root").alias("rb"))
        moved = lookup(lookup(live, ra, ["a"]), rb, ["b"], written=False).where(F.col("ra") != F.col("rb"))
        live = materialize(
            moved.groupBy(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).agg(F.min("e").alias("e")), "contracted"
        )
    empty = edges.limit(0)
    return (materialize(chosen, "forest") if chosen is not None else empty), labels


def log_records(log: DataFrame) -> DataFrame:
    """Written table (id, query_id, key) of every log row, ``key`` standing for its statement."""
    return canonical_records(log, "id", "sql_text", ["query_id"]).select("id", "query_id", "key")


def query_links(records: DataFrame) -> DataFrame:
    """Edges between the query_ids of ``log_records``: spellings (0) and statements (1)."""
    member = F.col("query_id").alias("member")
    spelled = star_edges(records.select(member, normal_id(F.col("query_id")).alias("hub")), 0)
    return spelled.unionAll(star_edges(records.select(member, F.col("key").alias("hub")), 1))


_GOLDEN = 0.6180339887498949
#: Parts of a band's golden-ratio line in which its rows are counted; shares are met to 1 / slices.
SLICES = 1024


def _cuts(held: dict[int, dict[int, int]], parts: dict[str, float]) -> list[tuple[int, list[int]]]:
    """Of each band, the slices at which the second and every later split begin.

    Bands are taken from the largest groups down, and each is cut by what the splits then lack.
    A split that lacks less than a band's groups hold gets none of them, unless all do.
    """
    total = sum(sum(s.values()) for s in held.values())
    lack = {name: share * total for name, share in parts.items()}
    out = []
    for band in sorted(held, reverse=True):
        fit = {s: x if x >= 2**band else 0.0 for s, x in lack.items()}
        if not any(fit.values()):
            fit = {s: float(x == max(lack.values())) for s, x in lack.items()}
        reach, cuts = 0.0, []
        for s in list(fit)[:-1]:
            reach += fit[s] / sum(fit.values())
            cuts.append(round(reach * SLICES))
        out.append((band, cuts))
        for k, n in held[band].items():
            lack[list(parts)[sum(c <= k for c in cuts)]] -= n
    return out


def assign_splits(sizes: DataFrame, shares: Sequence[tuple[str, float]]) -> DataFrame:
    """``sizes`` (root, n_rows) with ``size_band`` and ``split``: whole groups dealt by their rows.

    Bands are powers of two of the size. In every band the groups stand in hashed order and the
    n-th goes to the split that the n-th golden-ratio point falls to on the line of what the
    splits still lack, so small groups make up for what large ones leave uneven. A split is met
    to about one group of the smallest bands. No group is divided; an empty table gives none.
    """
    total_share = sum(s for _, s in shares)
    parts = {name: share / total_share for name, share in shares}
    band = F.floor(F.log2(F.col("n_rows").cast("double"))).cast("int")
    ready = sizes.select("root", "n_rows", band.alias("size_band"), F.xxhash64("root").alias("turn"))
    line = ordered_table(ready, ["size_band", "turn", "root"], "dealt")
    per = line.groupBy("size_band", "_part").agg(F.count(F.lit(1)).alias("n"), F.min("_row").alias("first"))
    ahead = Window.partitionBy("size_band").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = per.select("size_band", "_part", (F.coalesce(F.sum("n").over(ahead), F.lit(0)) - F.col("first")).alias("shift"))  # a row per band and partition
    place = (F.col("_row") + F.col("shift") + 0.5) * _GOLDEN
    dealt = line.join(F.broadcast(shifts), ["size_band", "_part"]).withColumn("slice", F.floor((place - F.floor(place)) * SLICES))
    held: dict[int, dict[int, int]] = {}
    for r in dealt.groupBy("size_band", "slice").agg(F.sum("n_rows").alias("n")).collect():  # at most 64 bands of SLICES rows
        held.setdefault(r["size_band"], {})[r["slice"]] = r["n"]
    cuts = sizes.sparkSession.createDataFrame(_cuts(held, parts), "size_band int, cuts array<int>")
    names = F.array(*[F.lit(n) for n in parts])
    split = F.element_at(names, F.size(F.filter("cuts", lambda c: c <= F.col("slice"))) + 1)
    return dealt.join(F.broadcast(cuts), "size_band").select("root", "n_rows", "size_band", split.alias("split"))


def split_rows(log: DataFrame, shares: Sequence[tuple[str, float]]) -> DataFrame:
    """(id, root, split) of every log row, as often as it occurs.

    A row without query_id goes with the least query_id under which its statement was logged,
    else with the rows of its statement, else (no statement either) by itself.
    """
    records = log_records(log)
    has_id = F.col("query_id").isNotNull()
    known = materialize(records.where(has_id & F.col("key").isNotNull()).groupBy("key").agg(F.min("query_id").alias("known")), "known")
    own = F.concat(F.lit("row:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    nameless = lookup(records.where(~has_id), known, ["key"], "left").select("id", F.coalesce("known", F.concat(F.lit("statement:"), F.hex("key")), own))
    nodes = materialize(records.where(has_id).select("id", F.col("query_id").alias("node")).unionAll(nameless), "nodes")
    _, labels = spanning_forest(query_links(records))
    counts = materialize(nodes.groupBy("node").agg(F.count(F.lit(1)).alias("n")), "counts")
    grouped = materialize(lookup(counts, labels, ["node"], "left").select("node", F.coalesce("root", "node").alias("root"), "n"), "groups")
    splits = materialize(assign_splits(grouped.groupBy("root").agg(F.sum("n").alias("n_rows")), shares).select("root", "split"), "dealt_roots")
    by_node = materialize(lookup(grouped, splits, ["root"]).select("node", "root", "split"), "splits")
    return lookup(nodes, by_node, ["node"]).select("id", "root", "split")


def split_report(assigned: DataFrame, shares: Sequence[tuple[str, float]]) -> DataFrame:
    """(split, target_share, reached_share, n_rows, n_groups) of ``split_rows``."""
    total_share = sum(s for _, s in shares)
    targets = assigned.sparkSession.createDataFrame([(n, s / total_share) for n, s in shares], "split string, target_share double")
    groups = assigned.groupBy("split", "root").agg(F.count(F.lit(1)).alias("n"))
    sums = groups.groupBy("split").agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_groups"))
    joined = targets.join(sums, "split", "left")
    every = F.sum("n_rows").over(Window.partitionBy(F.lit(0)))  # a row per split
    return joined.select("split", "target_share", F.round(F.coalesce(F.col("n_rows") / every, F.lit(0.0)), 6).alias("reached_share"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("n_groups", F.lit(0)).alias("n_groups"))
