"""From a field to block spectra and bispectral matrices, all in DataFrame operations.

A field has rows (t, p, v, value), t from 0 without gaps. This is the declarative path: it suits bounded sets of
frequencies and is what the SQL oracles check. Long fits go through triadic.plans.decompose.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triadic.functions.spectral import window_gain, window_table


def long_time_mean(field: DataFrame) -> DataFrame:
    """Mean over all samples of each point and variable, those in no block included."""
    return field.groupBy("p", "v").agg(F.avg("value").alias("mean"))


def number_of_blocks(field: DataFrame, n_dft: int, step: int) -> int:
    """Whole blocks of a field, from its last time."""
    return ((field.agg(F.max("t")).first()[0] or 0) + 1 - (n_dft - step)) // step


def blocks_of(field: DataFrame, n_dft: int, step: int, n_blocks: int) -> DataFrame:
    """field with b and n for each block that holds a sample: b from its time alone, so no range join."""
    t = F.col("t")
    first = F.greatest(F.lit(0), F.ceil((t - (n_dft - 1)) / F.lit(step))).cast("int")
    last = F.least(F.lit(n_blocks - 1), F.floor(t / F.lit(step))).cast("int")
    inside = field.where(t < (n_blocks - 1) * step + n_dft).withColumn("b", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))))
    return inside.withColumn("n", (t - F.col("b") * step).cast("int"))


def windowed_blocks(field: DataFrame, n_dft: int, step: int, n_blocks: int, window: str = "hamming", periodic: bool = False, mean: DataFrame | None = None) -> DataFrame:
    """(b, n, p, v, y): samples less their long-time mean, tapered."""
    taper = F.broadcast(window_table(field.sparkSession, window, n_dft, periodic))  # n_dft rows
    cut = blocks_of(field, n_dft, step, n_blocks).join(long_time_mean(field) if mean is None else mean, ["p", "v"])
    return cut.join(taper, "n").select("b", "n", "p", "v", ((F.col("value") - F.col("mean")) * F.col("w")).alias("y"))


def dft(blocks: DataFrame, n_dft: int, freqs: list[int], gain: float | DataFrame = 1.0) -> DataFrame:
    """(f, p, v, b, re, im) for the wanted frequency indices alone, scaled by gain / n_dft."""
    phase = F.lit(2.0) * F.pi() * F.pmod(F.col("f") * F.col("n"), F.lit(n_dft)) / F.lit(float(n_dft))
    wanted = blocks.withColumn("f", F.explode(F.array(*[F.lit(int(f)) for f in freqs])))
    sums = wanted.groupBy("f", "p", "v", "b").agg(F.sum(F.col("y") * F.cos(phase)).alias("re"), (-F.sum(F.col("y") * F.sin(phase))).alias("im"))
    if isinstance(gain, DataFrame):
        sums = sums.join(F.broadcast(gain))  # one row
        scale = F.col("gain") / F.lit(float(n_dft))
    else:
        scale = F.lit(gain / n_dft)
    return sums.select("f", "p", "v", "b", (F.col("re") * scale).alias("re"), (F.col("im") * scale).alias("im"))


def realizations(field: DataFrame, n_dft: int, step: int, n_blocks: int, freqs: list[int], window: str = "hamming") -> DataFrame:
    """Fourier realizations of tapered blocks, corrected by the window's gain."""
    gain = window_gain(window_table(field.sparkSession, window, n_dft))
    return dft(windowed_blocks(field, n_dft, step, n_blocks, window), n_dft, freqs, gain)


def by_block(qhat: DataFrame) -> DataFrame:
    """(f, p, v, x): the blocks of a spectrum as one array of (b, re, im), so that legs are joined once a point and not once a block."""
    return qhat.groupBy("f", "p", "v").agg(F.array_sort(F.collect_list(F.struct("b", "re", "im"))).alias("x"))


def _product(a: str, b: str):
    """Products of two arrays of blocks."""
    both = lambda x, y: F.struct(x["b"].alias("b"), (x["re"] * y["re"] - x["im"] * y["im"]).alias("re"), (x["re"] * y["im"] + x["im"] * y["re"]).alias("im"))
    return F.zip_with(a, b, both)


def _sum(arrays):
    """The sum of some arrays of blocks."""
    plus = lambda x, y: F.struct(x["b"].alias("b"), (x["re"] + y["re"]).alias("re"), (x["im"] + y["im"]).alias("im"))
    return F.aggregate(F.slice(arrays, 2, F.size(arrays)), F.element_at(arrays, 1), lambda t, x: F.zip_with(t, x, plus))


def triad_legs(qhat: DataFrame, triads: DataFrame, terms: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Sum and product legs of each triad: (triad_idx, p, s, x), s the state and x the blocks as (b, re, im).

    Without terms each variable meets itself. terms: (state, s_v, term, q_v, r_v); a state's products add up.
    Triads and terms are small and broadcast; spectra meet on frequency, point and variable.
    """
    names, spectrum = F.broadcast(triads.select("triad_idx", "k", "l", "kl")), by_block(qhat)
    leg = lambda f: spectrum.join(names, F.col("f") == F.col(f))
    if terms is None:
        named = lambda f, x: leg(f).select("triad_idx", "p", F.col("v").alias("s"), F.col("x").alias(x))
        both = named("k", "a").join(named("l", "b"), ["triad_idx", "p", "s"])
        return named("kl", "x"), both.select("triad_idx", "p", "s", _product("a", "b").alias("x"))
    states = F.broadcast(terms.select(F.col("state").alias("s"), "s_v").distinct())
    total = leg("kl").join(states, F.col("v") == F.col("s_v")).select("triad_idx", "p", "s", "x")
    pairs = F.broadcast(terms.select(F.col("state").alias("s"), "term", "q_v", "r_v"))
    factor = lambda f, v, x: leg(f).join(pairs, F.col("v") == F.col(v)).select("triad_idx", "p", "s", "term", F.col("x").alias(x))
    both = factor("k", "q_v", "a").join(factor("l", "r_v", "b"), ["triad_idx", "p", "s", "term"])
    terms_of = both.groupBy("triad_idx", "p", "s").agg(F.collect_list(_product("a", "b")).alias("products"))  # a few terms a state
    return total, terms_of.select("triad_idx", "p", "s", _sum(F.col("products")).alias("x"))


def bispectral_matrix(total: DataFrame, product: DataFrame, n_blocks: int, weights: DataFrame | None = None) -> DataFrame:
    """(triad_idx, i, j, re, im): mean over blocks of conj(sum leg i) * weight * product leg j, summed over points and states.

    Pairs of blocks are made from the legs' arrays just before the partial sums, and only the sums of a triad's matrix are shuffled.
    """
    right, w = product.withColumnRenamed("x", "y"), F.lit(1.0)
    if weights is not None:
        keys = ["p"]
        if "v" in weights.columns:
            weights, keys = weights.withColumnRenamed("v", "s"), ["p", "s"]
        right, w = right.join(weights, keys), F.col("w")
    both = total.join(right, ["triad_idx", "p", "s"]).select("triad_idx", w.alias("w"), F.explode("x").alias("x"), "y").select("triad_idx", "w", "x", F.explode("y").alias("y"))
    re = (F.col("x.re") * F.col("y.re") + F.col("x.im") * F.col("y.im")) * F.col("w")
    im = (F.col("x.re") * F.col("y.im") - F.col("x.im") * F.col("y.re")) * F.col("w")
    n = F.lit(float(n_blocks))
    return both.groupBy("triad_idx", F.col("x.b").alias("i"), F.col("y.b").alias("j")).agg((F.sum(re) / n).alias("re"), (F.sum(im) / n).alias("im"))


def combined(leg: DataFrame, coefficients: DataFrame) -> DataFrame:
    """A leg's blocks added up with (triad_idx, b, a_re, a_im): the un-normalised mode (triad_idx, p, s, re, im)."""
    both = leg.select("triad_idx", "p", "s", F.explode("x").alias("x")).select("triad_idx", "p", "s", "x.*").join(F.broadcast(coefficients), ["triad_idx", "b"])
    re = F.col("re") * F.col("a_re") - F.col("im") * F.col("a_im")
    im = F.col("re") * F.col("a_im") + F.col("im") * F.col("a_re")
    return both.groupBy("triad_idx", "p", "s").agg(F.sum(re).alias("re"), F.sum(im).alias("im"))


def normalised(mode: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """Modes of weighted norm 1."""
    w = F.lit(1.0)
    if weights is not None:
        keys = ["p"]
        if "v" in weights.columns:
            weights, keys = weights.withColumnRenamed("v", "s"), ["p", "s"]
        mode, w = mode.join(weights, keys), F.col("w")
    norms = mode.groupBy("triad_idx").agg(F.sqrt(F.sum(w * (F.col("re") * F.col("re") + F.col("im") * F.col("im")))).alias("norm"))  # a row a triad, added up where the points are
    return mode.join(norms, "triad_idx").select("triad_idx", "p", "s", (F.col("re") / F.col("norm")).alias("re"), (F.col("im") / F.col("norm")).alias("im"))


def concat_in_time(fields: list[DataFrame]) -> DataFrame:
    """Fields one after the other: each later one's times follow the last of those before. One job finds all their ends."""
    every = None
    for k, f in enumerate(fields):
        own = f.withColumn("part", F.lit(k))
        every = own if every is None else every.unionByName(own)
    ends = {r.part: r.last for r in every.groupBy("part").agg(F.max("t").alias("last")).collect()}  # a row a field
    starts, at = [], 0
    for k in range(len(fields)):
        starts.append(at)
        at += ends.get(k, -1) + 1
    start = F.element_at(F.array(*[F.lit(x).cast("long") for x in starts]), F.col("part") + 1)
    return every.withColumn("t", F.col("t") + start).drop("part")


def check_field(field: DataFrame) -> tuple[int, int, int]:
    """(nt, nx, nv) of a dense field of finite real numbers; refuses any other."""
    kinds = dict(field.dtypes)
    if kinds["value"].startswith(("struct", "array")):
        raise TypeError("the field must be real-valued")
    fine = F.col("value").isNotNull() & ~F.isnan(F.col("value").cast("double")) & (F.abs(F.col("value").cast("double")) < F.lit(float("inf")))
    r = field.agg(F.count(F.lit(1)).alias("n"), F.max("t").alias("t"), F.max("p").alias("p"), F.max("v").alias("v"), F.min(F.least("t", "p", "v")).alias("least"), F.count_if(~fine).alias("bad")).first()
    if not r.n:
        raise ValueError("the field is empty")
    if r.bad:
        raise ValueError("the field holds values that are null or not finite")
    nt, nx, nv = r.t + 1, r.p + 1, r.v + 1
    if r.least < 0 or r.n != nt * nx * nv:
        raise ValueError(f"the field is not dense: {r.n} rows for {nt} times, {nx} points and {nv} variables")
    return nt, nx, nv
