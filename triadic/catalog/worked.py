"""Worked analyses from a field to its tables: one variable, several variables over all regions, surrogate waves, and a cascade."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triadic.catalog import spectra as C
from triadic.catalog.axes import rounded, triads_sql
from triadic.catalog.decompositions import _few, _few_sql, radius_sql
from triadic.operators import estimators, weights
from triadic.operators import spectra as S
from triadic.plans.config import FitConfig
from triadic.plans.decompose import FitResult, fit
from triadic.sources import fields

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return keep


def _axis(spark, n: int, step: float) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("i"), (F.col("id") * F.lit(step)).alias("c"))


def single_variable(field: DataFrame, config: FitConfig, x: DataFrame, y: DataFrame) -> tuple[FitResult, DataFrame]:
    """A fit under trapezoid weights of a rectilinear grid, and its strongest triad off the axes."""
    result = fit(field, config, {"weights": weights.trapz_2d(x, y, 1), "weights_name": "trapezoid"}, xshape=(y.count(), x.count()))
    return result, result.top_triads(1)


def looked_up(result: FitResult, k: int, l: int) -> DataFrame:  # noqa: E741
    """One triad of a fit by its frequency indices."""
    return result.bispectrum.where(F.col("triad_idx") == result.find_triad(k, l))


def cascade(result: FitResult, f0: int, orders) -> DataFrame:
    """The triads of a cascade: pairs of harmonics (i, j) of frequency index f0, with the harmonic they feed and their strength."""
    wanted = result.bispectrum.sparkSession.createDataFrame([(i * f0, j * f0, i + j) for i, j in orders], "k int, l int, harmonic int")
    return result.bispectrum.join(F.broadcast(wanted), ["k", "l"]).select("k", "l", "harmonic", "f1", "f2", "l_abs")


def cascade_modes(result: FitResult, table: DataFrame, field: DataFrame, dx: float, variable: int = 0) -> DataFrame:
    """A cascade's table with the share of its sum modes that is even across the grid, and their wavelength along it."""
    ny, nx = result.xshape
    triads = table.join(result.bispectrum.select("k", "l", "triad_idx"), ["k", "l"])
    modes = result.reconstruct_modes(field, triads.select("triad_idx")).where((F.col("comp") == 0) & (F.col("s") == variable))
    grid = modes.select("triad_idx", F.floor(F.col("p") / nx).cast("int").alias("iy"), (F.col("p") % nx).cast("int").alias("ix"), "re", "im")
    even, length = estimators.symmetric_fraction(grid, ny, ["triad_idx"]), estimators.streamwise_wavelength(grid, dx, 4096, ["triad_idx"])
    return triads.join(even, "triad_idx").join(length, "triad_idx").drop("triad_idx")


# The published cases, waves whose frequencies form no triad, a triad, and a quartet without one.
CASES = {"none": (0.046875, 0.203125, 0.3515625), "triad": (0.046875, 0.203125, 0.25), "quartet": (0.046875, 0.1484375, 0.25, 0.453125)}
CASE_K = (3.2, 1.35, 0.2, 2.1)


def surrogate(spark, name: str, snr: float | None = None) -> DataFrame:
    field = fields.waves(spark, CASES[name], CASE_K)
    return field if snr is None else fields.with_noise(field, snr, 1)


def surface(field: DataFrame, config: FitConfig) -> DataFrame:
    """(f1, f2, value) of a fit's triads, to be drawn over the plane of frequencies."""
    return estimators.bispectrum_map(fit(field, config).bispectrum, log=False)


def amplitude_panel(field: DataFrame, n_dft: int, point: int = 0) -> DataFrame:
    """(f, amplitude) of one point's series at frequencies from 0 on."""
    one = field.where((F.col("p") == point) & (F.col("v") == 0))
    blocks = estimators.block_dft(one, n_dft, S.number_of_blocks(one, n_dft, n_dft), list(range(n_dft // 2)))
    return estimators.amplitude_spectrum(blocks).select("f", "amplitude")


# ---- on the tables ---------------------------------------------------------------------------------------------------

_HALF = "(CASE WHEN p % 8 IN (0, 7) THEN 0.25 ELSE 0.5 END) * (CASE WHEN p // 8 IN (0, 7) THEN 0.5 ELSE 1.0 END)"
_GRID_FIT = _few("embedding")
_SINGLE_SQL = radius_sql(C.standard_legs_sql(C.EMBEDDINGS, triads_sql(200, 1.0, (1, 2), 3), range(-6, 7), {"n_dft": 200, "step": 100}), _HALF)


@query("worked_single_variable", f"{_SINGLE_SQL} SELECT triad_idx, k::BIGINT AS k, l::BIGINT AS l, round(l_abs * 1e4, 5) AS value FROM r WHERE k <> 0 AND l <> 0 ORDER BY l_abs DESC, triad_idx LIMIT 1")
def worked_single_variable(spark, d):
    _, top = single_variable(C.embedding_signal(spark, d), replace(_GRID_FIT, n_space_dims=2, regions=(1, 2)), _axis(spark, 8, 0.5), _axis(spark, 8, 1.0))
    return rounded(top.select("triad_idx", "k", "l", (F.col("value") * 1e4).alias("value")), "value", digits=5)


_ALL = tuple(range(1, 9))
_REGIONS_SQL = radius_sql(C.standard_legs_sql(C.LINEITEM, triads_sql(1249, 1.0, _ALL, 3), range(-6, 7), {"n_dft": 1249, "step": 625}))


@query("worked_all_regions", f"{_REGIONS_SQL} SELECT triad_idx, k, l, region, round(l_abs, 5) + 0.0 AS l_abs FROM r WHERE k = 3 AND l = -1")
def worked_all_regions(spark, d):
    """Two variables over all eight regions; a triad is looked up by its frequencies."""
    result = fit(C.lineitem_daily(spark, d), replace(_few("lineitem", 2), max_freq_idx=3, regions=_ALL))
    return rounded(looked_up(result, 3, -1).select("triad_idx", "k", "l", "region", "l_abs"), "l_abs", digits=5)


@query(
    "worked_cascade",
    f"{_few_sql('embedding')} SELECT k, l, (k + l)::INT AS harmonic, f1, f2, round(l_abs, 6) + 0.0 AS l_abs FROM r WHERE (k, l) IN ((1, 1), (1, 0), (2, 1), (2, 2), (3, 1), (3, 2))",
)
def worked_cascade(spark, d):
    result = fit(C.embedding_signal(spark, d), _GRID_FIT, xshape=(8, 8))
    return rounded(rounded(cascade(result, 1, [(1, 1), (1, 0), (2, 1), (2, 2), (3, 1), (3, 2)]), "f1", "f2"), "l_abs", digits=6)


def _waves_sql(name: str) -> str:
    waves = " + ".join(f"cos({k} * (p * 2 * pi() / 100) - 2 * pi() * {f} * t)" for f, k in zip(CASES[name], CASE_K))
    return f"SELECT t, p::BIGINT AS p, 0 AS v, {waves} AS value FROM range(1280) a(t), range(100) b(p)"


def _amplitude_sql(name: str) -> str:
    one = f"SELECT * FROM ({_waves_sql(name)}) WHERE p = 0"
    return f"WITH {C.dft_sql(one, range(64), 128, 128, C.HANN, True)} SELECT '{name}' AS name, f::INT AS f, round(2 * avg(sqrt(re * re + im * im)), 6) + 0.0 AS amplitude FROM q GROUP BY f"


@query("surrogate_amplitudes", " UNION ALL ".join(f"SELECT * FROM ({_amplitude_sql(n)})" for n in CASES))
def surrogate_amplitudes(spark, d):
    """Amplitudes of the published cases at their first point."""
    out = None
    for name in CASES:
        own = amplitude_panel(surrogate(spark, name), 128).select(F.lit(name).alias("name"), "f", "amplitude")
        out = own if out is None else out.unionByName(own)
    return rounded(out, "amplitude", digits=6)


SURFACE = FitConfig(n_dft=256, time_step=1.0, overlap=0, window="hann", regions=(1,), max_freq_idx=6, tol=1e-12)


def _surface_sql(name: str) -> str:
    legs = C.standard_legs_sql(_waves_sql(name), triads_sql(256, 1.0, (1,), 6), range(-12, 13), {"n_dft": 256, "step": 256, "taper": C.HANN})
    return f"{radius_sql(legs)} SELECT f1, f2, round(l_abs, 6) + 0.0 AS value FROM r"


@query("surrogate_surface", _surface_sql("triad"))
def surrogate_surface(spark, d):
    """The lowest triads of the surrogate waves, as points of a surface."""
    return rounded(rounded(surface(surrogate(spark, "triad"), SURFACE), "f1", "f2"), "value", digits=6)
