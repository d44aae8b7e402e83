"""Taper windows, the two-sided frequency axis, and labels of triads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WINDOWS = ("hamming", "hann")


def window_name(name: str) -> str:
    if not isinstance(name, str) or name.lower() not in WINDOWS:
        raise ValueError(f"window must be one of {', '.join(WINDOWS)}")
    return name.lower()


def window_value(name: str, n: Column, length: int, periodic: bool = False) -> Column:
    """The taper at sample n; symmetric windows end where they begin, periodic ones one sample later."""
    angle = F.lit(2.0) * F.pi() * n / F.lit(float(length if periodic else length - 1))
    if window_name(name) == "hamming":
        return F.lit(0.54) - F.lit(0.46) * F.cos(angle)
    return F.lit(0.5) * (F.lit(1.0) - F.cos(angle))


def window_table(spark: SparkSession, name: str, length: int, periodic: bool = False) -> DataFrame:
    return spark.range(length).select(F.col("id").alias("n"), window_value(name, F.col("id"), length, periodic).alias("w"))


def window_gain(window: DataFrame) -> DataFrame:
    """1 / mean of a window: what a tapered amplitude is divided by."""
    return window.agg((F.lit(1.0) / F.avg("w")).alias("gain"))


def frequency_axis(spark: SparkSession, n_dft: int, dt: float | None = None) -> DataFrame:
    """(row, f_idx, freq) from the most negative frequency up; without dt, freq is f_idx itself."""
    f = F.col("id") - F.lit(n_dft // 2)
    step = 1.0 / n_dft if dt is None else dt
    return spark.range(n_dft).select(F.col("id").alias("row"), f.alias("f_idx"), (f / F.lit(float(step)) / F.lit(float(n_dft))).alias("freq"))


def triad_label(k: Column, l: Column) -> Column:  # noqa: E741
    return F.format_string("$(k,\\,l,\\,k+l) = (%d,\\,%d,\\,%d)$", k, l, k + l)
