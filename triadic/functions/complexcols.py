"""Complex numbers as structs of two doubles; Spark has no complex type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cplx(re, im) -> Column:
    return F.struct(re.alias("re"), im.alias("im"))


def cmul(a: Column, b: Column) -> Column:
    return cplx(a.re * b.re - a.im * b.im, a.re * b.im + a.im * b.re)


def conj(a: Column) -> Column:
    return cplx(a.re, -a.im)


def cabs(a: Column) -> Column:
    return F.hypot(a.re, a.im)


def phase(a: Column) -> Column:
    return F.atan2(a.im, a.re)


def cround(x: Column, digits: int) -> Column:
    """Rounded, without negative zero."""
    return F.round(x, digits) + F.lit(0.0)
