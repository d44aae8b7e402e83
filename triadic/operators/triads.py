"""Frequency triads (k, l, k + l): enumeration by regions, numbering, lookup."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The eight regions of the (k, l) plane, closed, so that they overlap on axes and diagonals.
REGION_RULES = {
    1: "k >= 0 AND l >= 0 AND k >= l",
    2: "k >= 0 AND l <= 0 AND k >= abs(l)",
    3: "k >= 0 AND l <= 0 AND k <= abs(l)",
    4: "k <= 0 AND l <= 0 AND k >= l",
    5: "k <= 0 AND l <= 0 AND k <= l",
    6: "k <= 0 AND l >= 0 AND abs(k) >= l",
    7: "k <= 0 AND l >= 0 AND abs(k) <= l",
    8: "k >= 0 AND l >= 0 AND k <= l",
}


def region_of(regions) -> Column:
    """The highest-numbered of the requested regions that holds (k, l); null in none."""
    cases = " ".join(f"WHEN {REGION_RULES[r]} THEN {r}" for r in sorted(set(regions), reverse=True))
    return F.expr(f"CASE {cases} END").cast("int")


def triads(spark: SparkSession, n_dft: int, dt: float | None = None, regions=(1, 2), max_freq_idx: int | None = None) -> DataFrame:
    """triad_idx, k, l, kl, f1, f2, f3, region, numbered from 0 by (k, l).

    |k|, |l| stay within the bound and the axis, |k + l| strictly below the Nyquist index. Numbers are ranks
    within k plus the triads of smaller k, so no sort holds all of them.
    """
    regions = (regions,) if isinstance(regions, int) else tuple(regions)
    if not regions or any(r not in REGION_RULES for r in regions):
        raise ValueError("regions must be numbers from 1 to 8")
    nyquist, top = n_dft // 2, (n_dft - 1) // 2
    bound = nyquist if max_freq_idx is None else max_freq_idx
    if not 0 <= bound <= nyquist:
        raise ValueError("max_freq_idx must be from 0 to the Nyquist index")
    lo, hi = -min(bound, nyquist), min(bound, top)
    grid = spark.range(lo, hi + 1).select(F.col("id").cast("int").alias("k"), F.explode(F.sequence(F.greatest(F.lit(lo), F.lit(1 - nyquist) - F.col("id")), F.least(F.lit(hi), F.lit(nyquist - 1) - F.col("id"))).cast("array<int>")).alias("l"))
    grid = grid.withColumn("region", region_of(regions)).where("region IS NOT NULL")
    below = grid.groupBy("k").agg(F.count(F.lit(1)).alias("own")).withColumn("before", F.coalesce(F.sum("own").over(W.orderBy("k").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    ranked = grid.join(F.broadcast(below.select("k", "before")), "k")  # n_dft rows at most
    step = float(1.0 / n_dft if dt is None else dt)
    freq = lambda c: c / F.lit(step) / F.lit(float(n_dft))
    kl = F.col("k") + F.col("l")
    number = F.col("before") + F.row_number().over(W.partitionBy("k").orderBy("l")) - 1
    return ranked.select(
        number.cast("long").alias("triad_idx"), "k", "l", kl.alias("kl"), freq(F.col("k")).alias("f1"), freq(F.col("l")).alias("f2"), freq(kl).alias("f3"), "region"
    )


def needed_frequencies(table: DataFrame) -> DataFrame:
    """Sorted distinct frequency indices of all three legs."""
    return table.select(F.explode(F.array("k", "l", "kl")).alias("f_idx")).distinct().orderBy("f_idx")


def dense_grid(spark: SparkSession, n_dft: int, table: DataFrame) -> DataFrame:
    """Every (k, l) of the axis, with its triad_idx or null, and whether it is computed."""
    lo, hi = -(n_dft // 2), (n_dft - 1) // 2
    full = spark.range(lo, hi + 1).select(F.col("id").cast("int").alias("k"), F.explode(F.sequence(F.lit(lo), F.lit(hi))).alias("l"))
    return full.join(table.select("k", "l", "triad_idx"), ["k", "l"], "left").withColumn("computed", F.col("triad_idx").isNotNull())


def enumerate_triads(n_dft: int, dt: float, regions, max_freq_idx: int | None) -> dict[str, np.ndarray]:
    """The same triads as arrays on the driver, for plans; n_dft ** 2 entries at most, whatever the field."""
    nyquist, bound = n_dft // 2, n_dft // 2 if max_freq_idx is None else max_freq_idx
    axis = np.arange(max(-bound, -nyquist), min(bound, (n_dft - 1) // 2) + 1)
    k, l = (x.ravel() for x in np.meshgrid(axis, axis, indexing="ij"))  # noqa: E741
    region = np.zeros(len(k), np.int64)
    inside = [(k >= 0, l >= 0, k >= l), (k >= 0, l <= 0, k >= -l), (k >= 0, l <= 0, k <= -l), (k <= 0, l <= 0, k >= l), (k <= 0, l <= 0, k <= l), (k <= 0, l >= 0, -k >= l), (k <= 0, l >= 0, -k <= l), (k >= 0, l >= 0, k <= l)]
    for r in sorted(regions):
        region[np.logical_and.reduce(inside[r - 1])] = r
    keep = (np.abs(k + l) < nyquist) & (region > 0)
    k, l, region = k[keep], l[keep], region[keep]  # noqa: E741
    freq = lambda x: x / dt / n_dft
    return {"triad_idx": np.arange(len(k)), "k": k, "l": l, "kl": k + l, "f1": freq(k), "f2": freq(l), "f3": freq(k + l), "region": region}


def find_triad(table: dict[str, np.ndarray], n_dft: int, k: int, l: int) -> int:  # noqa: E741
    """The number of triad (k, l); a ValueError tells whether it is off the axis or was not asked for."""
    lo, hi = -(n_dft // 2), (n_dft - 1) // 2
    if not (lo <= k <= hi and lo <= l <= hi):
        raise ValueError(f"({k}, {l}) is off the frequency axis {lo}..{hi}")
    at = np.flatnonzero((table["k"] == k) & (table["l"] == l))
    if not len(at):
        raise ValueError(f"triad ({k}, {l}) is not among those computed")
    return int(at[0])
