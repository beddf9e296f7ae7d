"""Measuring: noise of repeated runs, bootstrap intervals, sign tests, paired comparisons."""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Sequence
from statistics import mean, median, stdev

MIN_REPS = 3


def spread(times: Sequence[float]) -> float:
    """(max - min) / median of repeated readings."""
    if len(times) < MIN_REPS:
        raise ValueError(f"{MIN_REPS} readings are needed")
    return (max(times) - min(times)) / median(times)


def noise(runs: dict[str, Sequence[float]]) -> dict:
    """Spread of each query, cold and warm (without the first of more than three readings), and
    the floor below which differences are no findings."""
    cold = {q: spread(t) for q, t in runs.items()}
    warm = {q: spread(t[1:] if len(t) > MIN_REPS else t) for q, t in runs.items()}
    return {"n_queries": len(runs), "spread": cold, "warm_spread": warm, "median": median(cold.values()), "max": max(cold.values()), "recommended_floor": median(warm.values())}


def bootstrap_interval(values: Sequence[float], level: float = 0.95, resamples: int = 10_000, seed: int = 0) -> tuple[float, float]:
    """Percentile interval of the mean; NaN for fewer than two values."""
    if len(values) < 2:
        return math.nan, math.nan
    rng = random.Random(seed)
    means = sorted(mean(rng.choices(values, k=len(values))) for _ in range(resamples))
    low = (1 - level) / 2
    return means[int(low * resamples)], means[min(resamples - 1, int((1 - low) * resamples))]


def sign_test(differences: Sequence[float]) -> float | None:
    """Two-sided exact p-value; zeros do not count, none left gives None."""
    signs = [d > 0 for d in differences if d != 0]
    n = len(signs)
    if not n:
        return None
    few = min(sum(signs), n - sum(signs))
    return min(1.0, 2 * sum(math.comb(n, k) for k in range(few + 1)) / 2**n)


def verdict(low: float, high: float) -> str:
    """What an interval of differences says."""
    return "A" if low > 0 else "B" if high < 0 else "UNRESOLVED"


def compare(run_a: Callable[[], float], run_b: Callable[[], float], pairs: int, keep: Callable[[list], None] = lambda done: None) -> dict:
    """Interleaved pairs, the order turned round every time; a failed run drops its pair.

    ``keep`` gets the pairs so far, after each, as a checkpoint.
    """
    done: list[tuple[float, float]] = []
    for i in range(pairs):
        try:
            if i % 2 == 0:
                a, b = run_a(), run_b()
            else:
                b, a = run_b(), run_a()
        except Exception:
            continue
        done.append((a, b))
        keep(done)
    differences = [a - b for a, b in done]
    low, high = bootstrap_interval(differences)
    return {"n_pairs": len(done), "mean_a": mean(a for a, _ in done) if done else None, "mean_b": mean(b for _, b in done) if done else None, "mean_difference": mean(differences) if done else None, "stdev": stdev(differences) if len(done) > 1 else None, "interval": (low, high), "p_value": sign_test(differences), "n_a_wins": sum(d > 0 for d in differences), "verdict": verdict(low, high) if len(done) > 1 else "UNRESOLVED"}


def calibrate(settings: Sequence[dict], most_regression: float = 0.34) -> dict | None:
    """Of a gate sweep's rows, the one with most net time saved that deviates at all and seldom regresses."""
    fit = [s for s in settings if s["deviation_rate"] > 0 and (s["regression_rate"] or 0.0) <= most_regression]
    return max(fit, key=lambda s: s["net_ms"], default=None)


# -- what a page shows of one decision ---------------------------------------------------------


def bar_role(is_native: bool, is_served: bool, is_vetoed: bool, is_missed: bool) -> str:
    """The role of a plan among those of a decision."""
    return "served" if is_served else "native" if is_native else "vetoed" if is_vetoed else "missed" if is_missed else "candidate"


def choosing_share(overhead_ms: float, execution_ms: float) -> float | None:
    """Planning as a percentage of execution."""
    return overhead_ms / execution_ms * 100 if execution_ms else None


def saving_flag(native_ms: float, served_ms: float, tolerance: float = 0.5) -> str:
    """saved, regressed or even, within a tolerance in ms."""
    gain = native_ms - served_ms
    return "saved" if gain > tolerance else "regressed" if gain < -tolerance else "even"


def cost_flags(native_cost: float, best_cost: float, native_ms: float, best_ms: float) -> dict:
    """Did the estimates order two plans the wrong way, and by how much were they off?"""
    return {"inverted": (native_cost < best_cost) != (native_ms < best_ms), "cost_ratio": best_cost / native_cost if native_cost else None, "time_ratio": best_ms / native_ms if native_ms else None}
