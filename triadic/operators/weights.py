"""Quadrature weights of grids, from coordinate tables by lag and lead."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def cell_widths(axis: DataFrame, index: str, coord: str, width: str = "width") -> DataFrame:
    """Trapezoid width of each point of a coordinate axis: half the distance between its neighbours; 1 on an axis of one point."""
    order = W.orderBy(index)
    here = F.col(coord)
    span = F.coalesce(F.lead(coord).over(order), here) - F.coalesce(F.lag(coord).over(order), here)
    return axis.withColumn(width, F.when(F.count(F.lit(1)).over(W.partitionBy()) < 2, F.lit(1.0)).otherwise(F.abs(span) / 2))


def with_variables(weights: DataFrame, n_vars: int | None) -> DataFrame:
    """The same weight for each variable; without variables no column v."""
    return weights.withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(n_vars - 1)))) if n_vars else weights


def uniform(points: DataFrame, n_vars: int | None = 1, dv: float = 1.0) -> DataFrame:
    return with_variables(points.select("p", F.lit(float(dv)).alias("w")), n_vars)


def rectilinear(axes: list[DataFrame], n_vars: int | None = 1) -> DataFrame:
    """(i, c) axes, slowest first, i from 0 -> (p, w): products of trapezoid widths, p in row-major order.

    The points are a range that tasks share; each takes its place on an axis from its number and meets that axis's widths, a
    row for each grid line. The driver sees the axes' lengths.
    """
    sizes = [axis.count() for axis in axes]
    out, stride = axes[0].sparkSession.range(math.prod(sizes)).withColumn("w", F.lit(1.0)), math.prod(sizes)
    for axis, n in zip(axes, sizes):
        stride //= max(n, 1)
        widths = cell_widths(axis.select(F.col("i").cast("long").alias("i"), "c"), "i", "c").select("i", "width")
        at = F.floor(F.col("id") / F.lit(stride)) % F.lit(n)
        out = out.withColumn("i", at).join(F.broadcast(widths), "i").select("id", (F.col("w") * F.col("width")).alias("w"))
    return with_variables(out.select(F.col("id").alias("p"), "w"), n_vars)


def trapz_2d(x: DataFrame, y: DataFrame, n_vars: int | None = 1) -> DataFrame:
    return rectilinear([y, x], n_vars)


def trapz_3d(x: DataFrame, y: DataFrame, z: DataFrame, n_vars: int | None = 1) -> DataFrame:
    return rectilinear([z, y, x], n_vars)


def _gradient(coord: str, along: str, across: str) -> Column:
    """Central differences inside, one-sided ones at the ends."""
    w = W.partitionBy(across).orderBy(along)
    ahead, behind, here = F.lead(coord).over(w), F.lag(coord).over(w), F.col(coord)
    return F.when(ahead.isNull(), here - behind).when(behind.isNull(), ahead - here).otherwise((ahead - behind) / 2)


def curvilinear_2d(grid: DataFrame, n_vars: int | None = 1) -> DataFrame:
    """(p, iy, ix, y, x) -> (p, w): the Jacobian of the index map times half weights on the edges. A task holds a grid line; the driver sees the last line's numbers."""
    ends = grid.agg(F.max("iy").alias("iy"), F.max("ix").alias("ix")).first()
    edge = lambda i: F.when(F.col(i).isin(0, ends[i]), F.lit(0.5)).otherwise(F.lit(1.0))
    g = grid.withColumns({"xi": _gradient("x", "ix", "iy"), "yi": _gradient("y", "ix", "iy"), "xj": _gradient("x", "iy", "ix"), "yj": _gradient("y", "iy", "ix")})
    area = F.abs(F.col("xi") * F.col("yj") - F.col("xj") * F.col("yi"))
    return with_variables(g.select("p", (area * edge("iy") * edge("ix")).alias("w")), n_vars)
