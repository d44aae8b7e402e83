"""Point estimates beside the decomposition: amplitude spectra, classical bispectra, symmetry, wavelength, and plot-ready tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triadic.operators import spectra


def block_dft(field: DataFrame, n_dft: int, n_blocks: int, freqs: list[int]) -> DataFrame:
    """Spectra of adjoining blocks under a periodic Hann taper, global mean removed, scaled by the taper's mean."""
    from triadic.functions.spectral import window_gain, window_table

    gain = window_gain(window_table(field.sparkSession, "hann", n_dft, periodic=True))
    return spectra.dft(spectra.windowed_blocks(field, n_dft, n_dft, n_blocks, "hann", periodic=True), n_dft, freqs, gain)


def amplitude_spectrum(block_spectra: DataFrame) -> DataFrame:
    """Twice the mean modulus over blocks."""
    return block_spectra.groupBy("f", "p", "v").agg((F.lit(2.0) * F.avg(F.hypot("re", "im"))).alias("amplitude"))


def classical_bispectrum(block_spectra: DataFrame, m: int, n_dft: int) -> DataFrame:
    """(p, v, i, j, value): modulus of the block mean of X(i) X(j) conj X(i + j), 0 <= j <= i < m, i + j below n_dft / 2."""
    legs = {c: block_spectra.select(F.col("f").alias(c), "p", "v", "b", F.col("re").alias(f"{c}r"), F.col("im").alias(f"{c}i")) for c in ("i", "j", "s")}
    pairs = legs["i"].where(f"i >= 0 AND i < {m}").join(legs["j"].where("j >= 0"), ["p", "v", "b"]).where(f"j <= i AND i + j < {n_dft // 2}").withColumn("s", F.col("i") + F.col("j"))
    both = pairs.join(legs["s"], ["p", "v", "b", "s"])
    re, im = F.col("ir") * F.col("jr") - F.col("ii") * F.col("ji"), F.col("ir") * F.col("ji") + F.col("ii") * F.col("jr")
    means = both.groupBy("p", "v", "i", "j").agg(F.avg(re * F.col("sr") + im * F.col("si")).alias("re"), F.avg(im * F.col("sr") - re * F.col("si")).alias("im"))
    return means.select("p", "v", "i", "j", F.hypot("re", "im").alias("value"))


def symmetric_fraction(grid_field: DataFrame, ny: int, keys: list[str]) -> DataFrame:
    """(keys, iy, ix, re, im) -> share of energy in the part that is even under iy -> ny - 1 - iy."""
    mirror = grid_field.select(*keys, (F.lit(ny - 1) - F.col("iy")).alias("iy"), "ix", F.col("re").alias("mr"), F.col("im").alias("mi"))
    both = grid_field.join(mirror, [*keys, "iy", "ix"])
    even = ((F.col("re") + F.col("mr")) / 2) ** 2 + ((F.col("im") + F.col("mi")) / 2) ** 2
    return both.groupBy(*keys).agg((F.sum(even) / F.sum(F.col("re") ** 2 + F.col("im") ** 2)).alias("fraction"))


def streamwise_wavelength(grid_field: DataFrame, dx: float, n_pad: int, keys: list[str]) -> DataFrame:
    """(keys, iy, ix, re, im) -> wavelength of the strongest wavenumber of the zero-padded transform along ix, power summed over iy, mean excluded."""
    cells = grid_field.groupBy(*keys).agg(F.collect_list(F.struct(F.col("iy").cast("long"), F.col("ix").cast("long"), F.col("re").cast("double"), F.col("im").cast("double"))).alias("__cells"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cells.schema.fields[:-1])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            listed = batch.column(batch.num_columns - 1)
            iy, ix, re, im = (x.to_numpy(zero_copy_only=False) for x in listed.flatten().flatten())
            ends = np.cumsum(listed.value_lengths().to_numpy(zero_copy_only=False))
            best = []
            for lo, hi in zip(np.r_[0, ends[:-1]], ends):
                rows, row = np.unique(iy[lo:hi], return_inverse=True)
                line = np.zeros((len(rows), n_pad), complex)
                np.add.at(line, (row, ix[lo:hi] % n_pad), re[lo:hi] + 1j * im[lo:hi])
                power = (np.abs(np.fft.fft(line, axis=1)) ** 2).sum(axis=0)
                # Real fields have equal power at m and -m; the modulus of m is what counts, so round-off in ties does not.
                m = np.arange(1, n_pad // 2 + 1)
                best.append(m[np.maximum(power[m], power[-m]).argmax()])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n_pad * dx / np.array(best, float))], [*batch.schema.names[:-1], "wavelength"])

    return cells.mapInArrow(run, f"{kinds}, wavelength double")


def bispectrum_map(bispectrum: DataFrame, log: bool = True) -> DataFrame:
    """(f1, f2, value) to plot: ln |L|, null where |L| is 0."""
    value = F.when(F.col("l_abs") > 0, F.ln("l_abs")) if log else F.col("l_abs")
    return bispectrum.select("f1", "f2", value.alias("value"))


def contour_levels(values: DataFrame, n: int = 257, symmetric: bool = True) -> DataFrame:
    """n levels: from minus half to half the largest modulus, or from 0 to the largest; a field of zeros counts as one with 1."""
    top = values.agg(F.max(F.abs("value")).alias("m"))
    if symmetric:
        top = top.select(F.when(F.col("m") == 0, 2.0).otherwise(F.col("m")).alias("m"))
    else:
        top = top.select(F.when(F.col("m") == 0, 1.0).otherwise(F.col("m")).alias("m"))
    lo, hi = (-0.5 * F.col("m"), 0.5 * F.col("m")) if symmetric else (F.lit(0.0), F.col("m"))
    return top.select(F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: lo + (hi - lo) * i / F.lit(float(n - 1)))).alias("i", "level"))


def interaction_map(modes: DataFrame) -> DataFrame:
    """(triad_idx, p, s, value): modulus of sum mode times product mode."""
    leg = lambda c, n: modes.where(F.col("comp") == c).select("triad_idx", "p", "s", F.col("re").alias(f"{n}r"), F.col("im").alias(f"{n}i"))
    both = leg(0, "a").join(leg(1, "b"), ["triad_idx", "p", "s"])
    return both.select("triad_idx", "p", "s", (F.hypot("ar", "ai") * F.hypot("br", "bi")).alias("value"))


def mode_panels(modes: DataFrame, nx: int, variables: list[int]) -> DataFrame:
    """Plot-ready rows of chosen variables on a grid: part of each mode, and each panel's largest modulus."""
    rows = modes.where(F.col("s").isin(variables)).select("triad_idx", F.col("comp").alias("row"), F.col("s").alias("var"), F.floor(F.col("p") / nx).cast("int").alias("iy"), (F.col("p") % nx).cast("int").alias("ix"), F.col("re").alias("value"))
    product = interaction_map(modes.where(F.col("s").isin(variables))).select("triad_idx", F.lit(-1).alias("row"), F.col("s").alias("var"), F.floor(F.col("p") / nx).cast("int").alias("iy"), (F.col("p") % nx).cast("int").alias("ix"), "value")
    rows = rows.unionByName(product)
    tops = rows.groupBy("triad_idx", "row", "var").agg(F.max(F.abs("value")).alias("level_max"))  # a row a panel
    return rows.join(tops, ["triad_idx", "row", "var"]).select(*rows.columns, "level_max")
