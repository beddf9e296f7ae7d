"""Implausible readings: spikes, stuck values and impossible values, per source.

A hidden Markov model with the states normal, spike, stuck and out of range reads every
source's readings in order. Each source has a model of its own: its band and spread of normal
readings come from a histogram, its moves between states from one Baum-Welch step over all its
readings, drawn to common moves where it has few. Forward-backward gives each reading the
probability of each state; hard bounds and the likeliest state assign the flags. The sequence is
cut into blocks of equal length with overlapping edges, so a source with a third of all readings
costs no task more than any other source does.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparquill.operators.balance import lookup
from sparquill.operators.ordering import ordered_table, with_position
from sparquill.storage import materialize


@dataclass(frozen=True)
class AnomalyRules:
    """Limits of plausible readings and of the model."""

    lowest: float = 0.0  # a reading must be above
    highest: float = 86_400_000.0
    factor: float = 3.0  # a spike lies this many times outside the normal band
    min_readings: int = 20  # sources with fewer readings have no spikes
    stuck_run: int = 5
    block: int = 8192  # readings of a block
    halo: int = 32  # readings a block sees of its neighbours
    window: int = 128  # readings of one forward-backward window
    prior: float = 20.0  # readings that the common moves count as in a source's own moves


#: Order of the states in every matrix below.
NORMAL, SPIKE, STUCK, OUT = range(4)
#: Row: state before, column: state after. What a source's own moves are drawn to.
_MOVES = np.array(
    [
        [0.970, 0.015, 0.010, 0.005],
        [0.870, 0.100, 0.020, 0.010],
        [0.200, 0.015, 0.780, 0.005],
        [0.900, 0.015, 0.010, 0.075],
    ]
)
_IMPOSSIBLE = -60.0


def _emissions(t: dict[str, np.ndarray], rules: AnomalyRules) -> np.ndarray:
    """ln likelihood of every reading under the four states, from its source's figures.

    Normal: the logarithm is spread as the source's body is, no reading within ``factor`` of the
    band being less likely than at its edge. Spike: even over the logarithms of possible values
    outside the band by ``factor`` or more, in sources with ``min_readings``. Stuck: repeats of
    one value, ``stuck_run`` or more. Out of range: impossible values.
    """
    value, bad, lo, hi = t["value"], t["bad"], t["lo"], t["hi"]
    out = np.full((len(value), 4), _IMPOSSIBLE)
    known = ~bad & np.isfinite(lo) & np.isfinite(hi)
    v, a, b = (np.log(np.where(known, c, 1.0)) for c in (value, lo, hi))
    outside = known & (t["n_readings"] >= rules.min_readings) & ((value >= rules.factor * hi) | (value * rules.factor <= lo))
    center, width = (np.where(known, t[c], d) for c, d in (("center", 0.0), ("width", 1.0)))
    width = np.maximum(width, 0.05)
    x = np.clip(v, a, b)
    normal = -0.5 * ((x - center) / width) ** 2 - np.log(width * np.sqrt(2 * np.pi))
    held = t["run"] >= rules.stuck_run
    out[:, NORMAL] = np.where(known, np.maximum(normal, -8.0), 0.0) - 12.0 * held
    out[outside, NORMAL] = _IMPOSSIBLE
    room = np.log(rules.highest) - (b - a) + np.log(1e6)  # what values down to a millionth leave
    out[outside, SPIKE] = -np.log(np.maximum(room[outside], 1.0))
    out[held, STUCK] = 0.0
    out[bad] = _IMPOSSIBLE
    out[bad, OUT] = 0.0
    return out


def forward_backward(emissions: np.ndarray, inside: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """State probabilities of many sequences at once, and their expected moves.

    ``emissions``: sequences x time x 4, ln likelihoods; ``inside``: which places hold a
    reading, the others say nothing; ``moves``: sequences x 4 x 4. A sequence begins as after
    a normal reading. Scaled at each step, so no length underflows.
    """
    e = np.exp(np.where(inside[:, :, None], emissions, 0.0))
    n, steps, _ = e.shape
    ahead = np.empty_like(e)
    a = moves[:, NORMAL] * e[:, 0]
    for t in range(steps):
        if t:
            a = np.matmul(a[:, None], moves)[:, 0] * e[:, t]
        a = a / a.sum(axis=1, keepdims=True)
        ahead[:, t] = a
    expected = np.zeros((n, 4, 4))
    b = np.ones((n, 4))
    for t in range(steps - 1, -1, -1):
        if t < steps - 1:
            both = ahead[:, t][:, :, None] * moves * (e[:, t + 1] * b)[:, None]
            both /= both.sum(axis=(1, 2), keepdims=True)
            expected += both * (inside[:, t] & inside[:, t + 1])[:, None, None]
            b = np.matmul(moves, (e[:, t + 1] * b)[:, :, None])[:, :, 0]
            b = b / b.sum(axis=1, keepdims=True)
            ahead[:, t] *= b
    return ahead / ahead.sum(axis=2, keepdims=True), expected


def _segments(*keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal keys, and the end."""
    n = len(keys[0])
    change = np.zeros(n, bool)
    change[:1] = True
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    return np.append(np.flatnonzero(change), n)


def posteriors(emissions: np.ndarray, starts: np.ndarray, moves: np.ndarray, rules: AnomalyRules) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over the segments of a block, in windows that overlap by the halo.

    ``moves``: segments x 4 x 4. The second result has each segment's expected moves in the
    same form; those in overlaps count twice.
    """
    out = np.empty_like(emissions)
    expected = np.zeros((len(starts) - 1, 4, 4))
    length = np.diff(starts)
    per = -(-length // rules.window)
    seg = np.repeat(np.arange(len(length)), per)
    first = starts[seg] + rules.window * (np.arange(len(seg)) - np.repeat(np.cumsum(per) - per, per))
    last = np.minimum(first + rules.window, starts[seg + 1])
    begin, end = np.maximum(first - rules.halo, starts[seg]), np.minimum(last + rules.halo, starts[seg + 1])
    span, least = end - begin, 0
    for most in (8, 32, rules.window + 2 * rules.halo):  # short sequences need no long loops
        pick = np.flatnonzero((span > least) & (span <= most))
        least = most
        for k in range(0, len(pick), 2048):
            w = pick[k : k + 2048]
            at = begin[w][:, None] + np.arange(most)
            inside = at < end[w][:, None]
            p, seen = forward_backward(emissions[np.where(inside, at, 0)], inside, moves[seg[w]])
            own = inside & (at >= first[w][:, None]) & (at < last[w][:, None])
            out[at[own]] = p[own]
            np.add.at(expected, seg[w], seen)
    return out, expected


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)


def _runs(table: pa.Table) -> pa.Table:
    """Own rows of a block with ``run``: how many successive readings have exactly this value."""
    table = table.sort_by("_pos")
    value = table["value"].to_numpy()
    ends = _segments(_codes(table["field"]), _codes(table["source"]), value)
    run = np.repeat(np.diff(ends), np.diff(ends)).astype(np.int32)
    return table.append_column("run", pa.array(run)).filter(table["own"]).drop_columns(["own"])


_FIGURES = ("n_readings", "lo", "hi", "center", "width")
_MOVE_COLUMNS = tuple(f"m{i}{j}" for i in range(4) for j in range(4))
_STATES = ("normal", "spike", "stuck", "out")


def _read_block(table: pa.Table, rules: AnomalyRules) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    table = table.sort_by("_pos")
    arrays = {c: table[c].to_numpy() for c in ("value", "bad", "run", *_FIGURES)}
    arrays |= {c: arrays[c].astype(float) for c in _FIGURES}
    return table, _emissions(arrays, rules), _segments(_codes(table["field"]), _codes(table["source"]))


def _expect(table: pa.Table, rules: AnomalyRules) -> pa.Table:
    """The expected moves of each source in a block, under the common moves."""
    table, emissions, starts = _read_block(table, rules)
    _, expected = posteriors(emissions, starts, np.broadcast_to(_MOVES, (len(starts) - 1, 4, 4)), rules)
    keys = table.select(["_block", "field", "source"]).take(pa.array(starts[:-1]))
    for c, counts in zip(_MOVE_COLUMNS, expected.reshape(len(expected), 16).T, strict=True):
        keys = keys.append_column(c, pa.array(counts))
    return keys


def _score(table: pa.Table, moved: pa.Table, rules: AnomalyRules) -> pa.Table:
    """State probabilities of a block; ``moved``: the moves of the sources whose readings it owns."""
    table, emissions, starts = _read_block(table, rules)
    counts = dict(zip(zip(moved["field"].to_pylist(), moved["source"].to_pylist(), strict=True), np.stack([moved[c].to_numpy() for c in _MOVE_COLUMNS], axis=1), strict=True))
    first = table.select(["field", "source"]).take(pa.array(starts[:-1]))
    none = np.zeros(16)
    own = np.stack([counts.get(k, none) for k in zip(first["field"].to_pylist(), first["source"].to_pylist(), strict=True)]).reshape(-1, 4, 4)
    moves = own + rules.prior * _MOVES
    p, _ = posteriors(emissions, starts, moves / moves.sum(axis=2, keepdims=True), rules)
    cols = {c: table[c] for c in ("field", "source", "id", "value", "bad", "run", "n_readings", "lo", "hi")}
    cols |= {f"p_{s}": pa.array(p[:, i]) for i, s in enumerate(_STATES)}
    return pa.table(cols).filter(table["own"])


def _blocks(table: DataFrame, rules: AnomalyRules) -> DataFrame:
    """Rows with their block in ``_block``; edge rows also in the neighbour's, with ``own`` false."""
    b, at = F.expr(f"_pos div {rules.block}"), F.col("_pos") % rules.block
    places = F.array_compact(
        F.array(
            F.struct(b.alias("_block"), F.lit(True).alias("own")),
            F.when(at < rules.halo, F.struct((b - 1).alias("_block"), F.lit(False).alias("own"))),
            F.when(at >= rules.block - rules.halo, F.struct((b + 1).alias("_block"), F.lit(False).alias("own"))),
        )
    )
    return table.select("*", F.inline(places))


def readings(df: DataFrame, id_col: str, source_col: str, time_col: str, fields: Sequence[str], rules: AnomalyRules) -> DataFrame:
    """One row (field, source, time, id, value, bad) per non-null reading."""
    each = F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("value")) for f in fields]))
    kept = df.select(F.col(source_col).cast("string").alias("source"), F.unix_micros(F.col(time_col).cast("timestamp")).alias("time"), F.col(id_col).cast("long").alias("id"), each)
    v = F.col("value")
    bad = F.isnan(v) | (v <= rules.lowest) | (v > rules.highest)  # infinities lie outside too
    return kept.where(v.isNotNull()).withColumn("bad", bad)


def normal_bands(runs: DataFrame, rules: AnomalyRules) -> DataFrame:
    """(field, source, n_readings, lo, hi, center, width) of each source's body of readings.

    Possible readings that are not stuck are counted in buckets of 2 % width, with each
    bucket's exact lowest and highest value, combined before the shuffle; the highest possible
    reading bounds the buckets of a source (about 1,300). The body is the part around the
    median that no gap of ``factor`` divides, ``lo`` to ``hi``; ``center`` and ``width`` are mean
    and deviation of its logarithms. ``n_readings`` counts all readings of the source.
    """
    good = ~F.col("bad") & (F.col("run") < rules.stuck_run)
    v, x = F.col("value"), F.log("value")
    buckets = runs.groupBy("field", "source", F.when(good, F.floor(x / F.lit(float(np.log(1.02)))).cast("int")).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.when(good, v)).alias("least"), F.max(F.when(good, v)).alias("most"), F.sum(F.when(good, x)).alias("x"), F.sum(F.when(good, x * x)).alias("xx")
    )
    own = Window.partitionBy("field", "source")
    up = own.orderBy(F.col("bucket").asc_nulls_first())
    counted = F.when(F.col("bucket").isNotNull(), F.col("n")).otherwise(0)
    body = (
        buckets.withColumn("n_readings", F.sum("n").over(own))
        .withColumn("total", F.sum(counted).over(own))
        .withColumn("below", F.sum(counted).over(up) - counted)
        .withColumn("gap", (F.col("least") >= F.lit(rules.factor) * F.lag("most").over(up)).cast("int"))
        .withColumn("part", F.sum(F.coalesce("gap", F.lit(0))).over(up))
    )
    middle = F.col("total") / 2
    is_median = (F.col("bucket").isNotNull()) & (F.col("below") <= middle) & (F.col("below") + F.col("n") > middle)
    inside = F.col("part") == F.col("median_part")
    n, sx, sxx = (F.sum(F.when(inside, c)) for c in (counted, F.col("x"), F.col("xx")))
    return (
        body.withColumn("median_part", F.max(F.when(is_median, F.col("part"))).over(own))
        .groupBy("field", "source")
        .agg(
            F.first("n_readings").alias("n_readings"),
            F.min(F.when(inside, F.col("least"))).alias("lo"),
            F.max(F.when(inside, F.col("most"))).alias("hi"),
            F.when(n > 0, sx / n).alias("center"),
            F.when(n > 0, F.sqrt(F.greatest(sxx / n - (sx / n) * (sx / n), F.lit(0.0)))).alias("width"),
        )
    )


def reading_states(df: DataFrame, id_col: str, source_col: str, time_col: str, fields: Sequence[str], rules: AnomalyRules | None = None) -> DataFrame:
    """Every non-null reading with the probabilities of the four states.

    Columns: field, source, id, value, bad, run, n_readings, lo, hi, p_normal, p_spike,
    p_stuck, p_out. Readings follow each other by time, then id. A reading without a source
    has no sequence: p_out is 1 if it is impossible, else p_normal is 1, and run is 1. Null
    readings give no row; NaN and infinities are impossible readings; an empty table gives
    none; a null time comes first. Other columns of ``df`` are not read.
    """
    rules = rules or AnomalyRules()
    every = readings(df, id_col, source_col, time_col, fields, rules)
    rest = every.where(F.col("source").isNull())
    placed = with_position(ordered_table(every.where(F.col("source").isNotNull()), ["field", "source", "time", "id"], "readings"))
    wide = "field string, source string, id long, value double, bad boolean, _pos long, run int"
    blocks = _blocks(placed.select("field", "source", "id", "value", "bad", "_pos"), rules)
    runs = materialize(blocks.groupBy("_block").applyInArrow(lambda t: _runs(t).drop_columns(["_block"]), wide), "runs")
    sources = ["field", "source"]
    # a source of many readings is a hot key here, which the lookup splits
    known = materialize(lookup(runs, materialize(normal_bands(runs, rules), "bands"), sources), "banded")
    each = "_block long, field string, source string, " + ", ".join(f"{c} double" for c in _MOVE_COLUMNS)
    seen = materialize(_blocks(known, rules).where("own").groupBy("_block").applyInArrow(lambda t: _expect(t, rules), each), "expected")
    moves = materialize(seen.groupBy(*sources).agg(*[F.sum(c).alias(c) for c in _MOVE_COLUMNS]), "moves")
    by_block = lookup(seen.select("_block", *sources), moves, sources)
    schema = "field string, source string, id long, value double, bad boolean, run int, n_readings long, lo double, hi double, p_normal double, p_spike double, p_stuck double, p_out double"
    scored = _blocks(known, rules).groupBy("_block").cogroup(by_block.groupBy("_block")).applyInArrow(lambda t, m: _score(t, m, rules), schema)
    none = F.lit(None).cast("double")
    alone = rest.select(
        "field", "source", "id", "value", "bad", F.lit(1).alias("run"), F.lit(None).cast("long").alias("n_readings"), none.alias("lo"), none.alias("hi"),
        (~F.col("bad")).cast("double").alias("p_normal"), F.lit(0.0).alias("p_spike"), F.lit(0.0).alias("p_stuck"), F.col("bad").cast("double").alias("p_out"),
    )
    return scored.unionByName(alone)


def implausible_readings(df: DataFrame, id_col: str, source_col: str, time_col: str, fields: Sequence[str], rules: AnomalyRules | None = None) -> DataFrame:
    """(id, field_name, reason): readings that a bound excludes or whose likeliest state is no normal one.

    Out of range: not finite, not above ``lowest`` or above ``highest``. Else the likeliest of
    spike and stuck, if likelier than normal.
    """
    s = reading_states(df, id_col, source_col, time_col, fields, rules or AnomalyRules())
    spike, stuck = F.col("p_spike"), F.col("p_stuck")
    reason = F.when(F.col("bad"), "out_of_range").when(F.greatest(spike, stuck) > F.col("p_normal"), F.when(stuck >= spike, "stuck").otherwise("spike"))
    return s.select("id", F.col("field").alias("field_name"), reason.alias("reason")).where(F.col("reason").isNotNull())


def state_agreement(states: DataFrame, rules: AnomalyRules | None = None) -> DataFrame:
    """(field_name, state, n_model, n_rule, n_both): the model's flags beside plain rules.

    The rules: a spike lies ``factor`` times beyond the band of a source with ``min_readings``,
    a stuck reading is one of ``stuck_run`` equal ones. A report; no flag depends on it.
    """
    rules = rules or AnomalyRules()
    v = F.col("value")
    beyond = (F.col("n_readings") >= rules.min_readings) & ((v >= rules.factor * F.col("hi")) | (v * rules.factor <= F.col("lo")))
    rule = F.when(F.col("run") >= rules.stuck_run, "stuck").when(F.coalesce(beyond, F.lit(False)), "spike").otherwise("normal")
    top = F.greatest("p_normal", "p_spike", "p_stuck")
    model = F.when(F.col("p_stuck") == top, "stuck").when(F.col("p_spike") == top, "spike").otherwise("normal")
    each = states.where(~F.col("bad")).select(F.col("field").alias("field_name"), rule.alias("r"), model.alias("m"))
    state = F.explode(F.array_distinct(F.array("r", "m"))).alias("state")
    return each.select("field_name", "r", "m", state).groupBy("field_name", "state").agg(
        F.count_if(F.col("m") == F.col("state")).alias("n_model"), F.count_if(F.col("r") == F.col("state")).alias("n_rule"), F.count_if((F.col("m") == F.col("state")) & (F.col("r") == F.col("state"))).alias("n_both")
    )
