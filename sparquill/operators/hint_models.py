"""A model of hints over any number of logged readings, as DataFrame jobs.

An ensemble of means: each member sees its own draw of the training queries and predicts, for a
hint, the mean ln(time / native time) that the hint had there. Mean and deviation over the
members feed the same policies and the same gate as the forests that an engine fits to plans.
Draws depend on the query's name alone, so results do not change with partitions or order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparquill.functions.keys import DISABLED_COST
from sparquill.operators import log_analytics as A
from sparquill.operators.balance import lookup
from sparquill.storage import materialize

MEMBERS = 8
#: Of 8 parts of the queries, those that a member sees; of 4 parts, the first is held out.
SEEN, PARTS, HELD_OUT = 5, 8, 4
#: Pairs of one query above which every k-th is taken.
MOST_PAIRS = 400


def draw(query: Column, salt: Column | str) -> Column:
    """A number from 0 to 65535 that depends on the query and the salt."""
    salt = F.lit(salt) if isinstance(salt, str) else salt.cast("string")
    return F.conv(F.substring(F.md5(F.concat_ws("|", query, salt)), 1, 4), 16, 10).cast("int")


def labels(log: DataFrame) -> DataFrame:
    """Written table (query_id, hint, median_ms, least_cost, native_ms, target, held_out) of the
    hints of queries with a native reading; the native plan is the row without a hint."""
    plain = materialize(A.median_labels(log), "labels")
    costs = A.trainable(log).groupBy("query_id", "hint").agg(F.min("total_cost").alias("least_cost")).withColumnsRenamed({"query_id": "_q", "hint": "_h"})
    costed = plain.join(costs, F.col("query_id").eqNullSafe(F.col("_q")) & F.col("hint").eqNullSafe(F.col("_h")))
    native = plain.where(F.col("is_baseline")).groupBy("query_id").agg(F.min_by("median_ms", F.struct(F.col("hint").isNotNull(), "hint")).alias("native_ms")).where(F.col("native_ms") > 0)
    both = costed.join(native, "query_id")
    held = F.pmod(draw(F.col("query_id"), "split"), F.lit(HELD_OUT)) == 0
    return materialize(both.select("query_id", "hint", "median_ms", "least_cost", "native_ms", F.log(F.col("median_ms") / F.col("native_ms")).alias("target"), held.alias("held_out")), "hint_labels")


def fit(labelled: DataFrame) -> DataFrame:
    """Written table (hint, mean, std, n_members): the ensemble's view of each hint, from the
    queries that are not held out. Partial means are combined before the shuffle."""
    seen = labelled.where(~F.col("held_out") & F.col("hint").isNotNull())
    member = F.explode(F.array(*[F.lit(m) for m in range(MEMBERS)])).alias("member")
    drawn = seen.select("query_id", "hint", "target", member).where(F.pmod(draw(F.col("query_id"), F.col("member")), F.lit(PARTS)) < SEEN)
    means = drawn.groupBy("hint", "member").agg(F.avg("target").alias("m"))
    return materialize(means.groupBy("hint").agg(F.avg("m").alias("mean"), F.stddev_pop("m").alias("std"), F.count(F.lit(1)).alias("n_members")), "hint_model")


def scored(labelled: DataFrame, model: DataFrame) -> DataFrame:
    """The hints of held-out queries with the ensemble's mean and deviation; unknown hints are left out."""
    return lookup(labelled.where(F.col("held_out") & F.col("hint").isNotNull()), model.select("hint", "mean", "std"), ["hint"])


def _pick(score: Column, *what: str) -> Column:
    """The values of the least scored hint, the first by name of equals."""
    return F.min_by(F.struct(*what), F.struct(score, F.col("hint")))


def decisions(candidates: DataFrame, z: float = 1.0, min_gain: float = 0.05, risk_lambda: float = 0.0) -> DataFrame:
    """Of each query the hint a policy picks, whether the gate lets it be served, and why.

    The pick is the least mean + ``risk_lambda`` * deviation; it is served if
    exp(mean + z * std) < 1 - ``min_gain`` and its cost is no sentinel of a disabled operator.
    A query has as many candidates as hints, a bounded number.
    """
    picked = candidates.groupBy("query_id").agg(F.first("native_ms").alias("native_ms"), _pick(F.col("mean") + risk_lambda * F.col("std"), "hint", "mean", "std", "median_ms", "least_cost").alias("p"))
    passes = F.exp(F.col("p.mean") + z * F.col("p.std")) < 1 - min_gain
    unsafe = F.coalesce(F.col("p.least_cost") >= DISABLED_COST, F.lit(False))
    reason = F.when(~passes, "no_confident_gain_over_native").when(unsafe, "predicted_regression_vs_native").otherwise("confident_gain")
    out = picked.select("query_id", "native_ms", F.col("p.hint").alias("pick"), F.col("p.median_ms").alias("pick_ms"), F.col("p.mean").alias("mean"), F.col("p.std").alias("std"), reason.alias("reason"))
    return out.withColumn("served_ms", F.when(F.col("reason") == "confident_gain", F.col("pick_ms")).otherwise(F.col("native_ms")))


def policy_report(labelled: DataFrame, model: DataFrame) -> DataFrame:
    """(policy, avg_ms, captured_pct, ties_heuristic) over the held-out queries with a scored hint.

    Candidates include the native plan, with mean and deviation 0. heuristic: least cost;
    oracle: least time; thompson is left to engines, as it draws. ``ties_heuristic``: part of the
    queries served no slower than by the heuristic. ``captured_pct``: null without headroom.
    """
    known = scored(labelled, model)
    native = known.select("query_id", F.lit(None).cast("string").alias("hint"), F.col("native_ms").alias("median_ms"), "native_ms", F.lit(0.0).alias("mean"), F.lit(0.0).alias("std")).distinct()
    costs = labelled.where(F.col("hint").isNull()).select("query_id", "least_cost")
    every = known.select("query_id", "hint", "median_ms", "native_ms", "mean", "std", "least_cost").unionByName(native.join(costs, "query_id", "left"))
    first = F.struct(F.col("hint").isNotNull(), F.col("hint"))
    cost = F.coalesce("least_cost", F.lit(float("inf")))
    served = every.groupBy("query_id").agg(
        F.first("native_ms").alias("native"), F.min("median_ms").alias("oracle"), F.min_by("median_ms", F.struct(cost, first)).alias("heuristic"),
        F.min_by("median_ms", F.struct("mean", first)).alias("greedy"), F.min_by("median_ms", F.struct(F.col("mean") + F.col("std"), first)).alias("risk_averse"),
    )
    names = ("native", "heuristic", "oracle", "greedy", "risk_averse")
    each = served.select("native", "oracle", "heuristic", F.inline(F.array(*[F.struct(F.lit(n).alias("policy"), F.col(n).alias("ms")) for n in names])))
    room = F.sum("native") - F.sum("oracle")
    return each.groupBy("policy").agg(
        F.count(F.lit(1)).alias("n_queries"), F.round(F.avg("ms"), 8).alias("avg_ms"), F.round(F.when(room > 0, (F.sum("native") - F.sum("ms")) / room * 100), 4).alias("captured_pct"),
        F.round(F.avg((F.col("ms") <= F.col("heuristic")).cast("double")), 6).alias("ties_heuristic"),
    )


def model_errors(labelled: DataFrame, model: DataFrame) -> DataFrame:
    """One row: held-out readings, mean absolute error of ln ratios, its factor, mean deviation."""
    known = scored(labelled, model)
    mae = F.avg(F.abs(F.col("target") - F.col("mean")))
    return known.agg(F.count(F.lit(1)).alias("n_rows"), F.round(mae, 6).alias("mae"), F.round(F.exp(mae), 6).alias("typical_factor"), F.round(F.avg("std"), 6).alias("mean_std"))


def challenger_score(labelled: DataFrame, model: DataFrame, part: float = 0.25) -> DataFrame:
    """One row: mean time of the risk-averse pick over the last ``part`` of the query ids in order,
    the native plan included; what a model is promoted by."""
    queries = materialize(labelled.select("query_id").distinct(), "query_ids")
    line = A.running_totals(queries.withColumn("one", F.lit(1)), ["query_id"], {"place": "one"})
    total = queries.count()
    last = materialize(line.where(F.col("place") > total - max(1, round(total * part))).select("query_id"), "last")
    known = lookup(lookup(labelled, last, ["query_id"]), model.select("hint", "mean", "std"), ["hint"], "left", written=False)
    usable = known.where(F.col("hint").isNull() | F.col("mean").isNotNull())
    score = F.when(F.col("hint").isNull(), 0.0).otherwise(F.col("mean") + F.col("std"))
    served = usable.groupBy("query_id").agg(F.min_by("median_ms", F.struct(score, F.col("hint").isNotNull(), "hint")).alias("ms"))
    return served.agg(F.count(F.lit(1)).alias("n_queries"), F.round(F.avg("ms"), 8).alias("avg_ms"))


def pairwise_pairs(labelled: DataFrame, most: int = MOST_PAIRS) -> DataFrame:
    """(query_id, hint_a, hint_b, target_diff, a_is_faster): pairs of a query's plans, both ways round.

    Plans of equal time teach nothing. A query with more than ``most`` pairs gives every k-th,
    k = pairs // most + 1, in the order of the hints, the native plan first. A query has a
    bounded number of hints, so the self-join is one of small groups.
    """
    own = Window.partitionBy("query_id").orderBy(F.col("hint").isNotNull(), "hint")
    side = labelled.select("query_id", "hint", "median_ms", "target", F.row_number().over(own).alias("i"))
    a, b = (side.select("query_id", *[F.col(c).alias(f"{c}_{s}") for c in ("hint", "median_ms", "target", "i")]) for s in "ab")
    pairs = a.join(b, "query_id").where(F.col("i_a") < F.col("i_b"))
    whole = Window.partitionBy("query_id")
    numbered = pairs.withColumn("k", F.row_number().over(whole.orderBy("i_a", "i_b")) - 1).withColumn("n", F.count(F.lit(1)).over(whole))
    step = F.when(F.col("n") > most, F.floor(F.col("n") / most) + 1).otherwise(1)
    kept = numbered.where((F.col("k") % step == 0) & (F.col("median_ms_a") != F.col("median_ms_b")))
    ways = [F.struct(F.col(f"hint_{x}").alias("hint_a"), F.col(f"hint_{y}").alias("hint_b"), F.round(F.col(f"target_{x}") - F.col(f"target_{y}"), 6).alias("target_diff"), (F.col(f"median_ms_{x}") < F.col(f"median_ms_{y}")).alias("a_is_faster")) for x, y in ("ab", "ba")]
    return kept.select("query_id", F.inline(F.array(*ways)))


def sweep(labelled: DataFrame, model: DataFrame, zs: Sequence[float], gains: Sequence[float]) -> DataFrame:
    """Every gate setting replayed over the model's picks for held-out queries."""
    picks = materialize(decisions(scored(labelled, model)), "picks")
    return A.gate_sweep(picks.select("query_id", "native_ms", "pick_ms", "mean", "std"), zs, gains)


def sign_test(differences: DataFrame, column: str) -> DataFrame:
    """One row (n_positive, n_negative, p_value): the two-sided exact test; zeros and nulls do not count.

    The binomial tail is summed over at most half the differences in logarithms; null without any.
    """
    d = F.col(column)
    counts = differences.agg(F.count_if(d > 0).alias("n_positive"), F.count_if(d < 0).alias("n_negative"))
    n, few = F.col("n_positive") + F.col("n_negative"), F.least("n_positive", "n_negative")
    # ln of n over k, from the one before; sums of terms relative to the greatest
    start = F.struct((-n * F.log(F.lit(2.0))).alias("term"), F.exp(-n * F.log(F.lit(2.0))).alias("total"))

    def step(acc: Column, k: Column) -> Column:
        term = acc["term"] + F.log((n - k + 1) / k)
        return F.struct(term.alias("term"), (acc["total"] + F.exp(term)).alias("total"))

    ks = F.when(few > 0, F.sequence(F.lit(1).cast("long"), few)).otherwise(F.array().cast("array<long>"))
    tail = F.aggregate(ks, start, step)["total"]
    return counts.select("n_positive", "n_negative", F.round(F.when(n > 0, F.least(2 * tail, F.lit(1.0))), 6).alias("p_value"))


#: Up to which part of the draws a row is taken 0, 1, 2, ... times: the Poisson distribution of mean 1.
_TAKEN = (0.367879, 0.735759, 0.919699, 0.98101, 0.99634, 0.999406)


def bootstrap_interval(df: DataFrame, key: Column, column: str, resamples: int = 200, level: float = 0.95) -> DataFrame:
    """One row (n, mean, low, high): the percentile interval of a column's mean by resampling.

    A resample takes each row a Poisson number of times that depends on its ``key`` and the
    resample alone, so one pass over any number of rows makes all of them; sums are combined
    before the shuffle. Null values take no part; without two values the ends are null.
    """
    each = df.where(F.col(column).isNotNull()).select(key.alias("k"), F.col(column).cast("double").alias("v"))
    b = F.explode(F.array(*[F.lit(i) for i in range(resamples)])).alias("b")
    u = draw(F.col("k"), F.col("b")) / F.lit(65536.0)
    times = sum((F.when(u >= t, 1).otherwise(0) for t in _TAKEN[1:]), F.when(u >= _TAKEN[0], 1).otherwise(0))
    means = each.select("k", "v", b).withColumn("w", times).groupBy("b").agg(F.try_divide(F.sum(F.col("w") * F.col("v")), F.sum("w")).alias("m"))  # of few rows, a resample may take none
    ordered = means.where(F.col("m").isNotNull()).agg(F.sort_array(F.collect_list("m")).alias("ms"))  # ``resamples`` numbers
    whole = each.agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"))
    low = (1 - level) / 2
    n = F.size("ms")
    ends = ordered.select(F.get("ms", F.floor(F.round(n * low, 6)).cast("int")).alias("low"), F.get("ms", F.least(n - 1, F.floor(F.round(n * (1 - low), 6)).cast("int"))).alias("high"))
    none = F.lit(None).cast("double")
    both = whole.select("n", "mean", none.alias("low"), none.alias("high")).unionAll(ends.select(F.lit(0).cast("long"), none, "low", "high"))
    out = both.agg(F.max("n").alias("n"), F.max("mean").alias("mean"), F.max("low").alias("low"), F.max("high").alias("high"))
    return out.select("n", F.round("mean", 6).alias("mean"), *[F.round(F.when(F.col("n") > 1, F.col(c)), 6).alias(c) for c in ("low", "high")])
