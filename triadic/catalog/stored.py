"""Queries that write arrays and fits and read them again, and on what a result tells of itself."""

from __future__ import annotations

import json
import tempfile
import uuid
from dataclasses import replace

import numpy as np
from pyspark.sql import functions as F

from triadic.catalog import spectra as C
from triadic.catalog.axes import rounded, triads_sql
from triadic.catalog.decompositions import _CHOSEN, _LISTED, _MODULI, DAY, MODES_SQL, RADIUS_SQL, _with_moduli, day_fit
from triadic.plans.config import FitConfig
from triadic.sources import arrays, matfile, results

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return keep


def _folder(spark) -> str:
    """A new folder that executors share with the driver: in local mode any, else beside the checkpoints."""
    if spark.sparkContext._jsc.sc().isLocal():
        return tempfile.mkdtemp(prefix="triadic-results-")
    return _shared_folder(spark)


def _shared_folder(spark) -> str:
    """A new folder, which is there, in spark.checkpoint.dir."""
    path = f"{spark.conf.get('spark.checkpoint.dir').rstrip('/')}/results-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(place)
    return path


def _put(spark, path: str, write) -> None:
    """A file that write(path) makes on the driver's disk, copied to path by the file system that path names."""
    with tempfile.TemporaryDirectory(prefix="triadic-file-") as own:
        made = f"{own}/{path.rsplit('/', 1)[1]}"
        write(made)
        name = spark._jvm.org.apache.hadoop.fs.Path
        name(path).getFileSystem(spark._jsc.hadoopConfiguration()).copyFromLocalFile(name(f"file://{made}"), name(path))


def _daily_array(spark, d) -> np.ndarray:
    """(time, point) of the daily field, which has few values."""
    rows = C.daily(spark, d).toPandas()
    return rows.pivot(index="t", columns="p", values="value").to_numpy()


# ---- arrays ----------------------------------------------------------------------------------------------------------


@query("arrays_from_files", f"WITH f AS ({C.DAILY}), n AS (SELECT max(t) + 1 AS nt FROM f) SELECT t + i * nt AS t, p, v, round(value, 8) + 0.0 AS value FROM f, n, range(4) r(i)")
def arrays_from_files(spark, d):
    """An array, a dictionary with one, and files of three kinds, one after the other in time."""
    a, folder = _daily_array(spark, d), _folder(spark)
    _put(spark, f"{folder}/a.npy", lambda path: np.save(path, a))
    _put(spark, f"{folder}/b.npz", lambda path: np.savez(path, x=a, dt=0.5))
    _put(spark, f"{folder}/c.mat", lambda path: matfile.write_mat(path, {"x": a}, True))
    field = arrays.load(spark, [f"{folder}/a.npy", f"{folder}/b.npz", f"{folder}/c.mat", {"x": a, "dt": 0.5}])
    return rounded(field.select("t", "p", "v", "value"), "value", digits=8)


@query("array_of_grid_and_variables", f"SELECT t, ((p % 8) * 8 + p // 8)::BIGINT AS p, v, round(value, 8) + 0.0 AS value FROM ({C.EMBEDDINGS})")
def array_of_grid_and_variables(spark, d):
    """Points numbered the other way round."""
    return rounded(arrays.transposed_points(C.embedding_signal(spark, d), 8, 8), "value", digits=8)


@query("matfield_source", f"SELECT t, p AS i, round(value, 8) + 0.0 AS value FROM ({C.DAILY})")
def matfield_source(spark, d):
    folder, a = _folder(spark), _daily_array(spark, d)
    _put(spark, f"{folder}/x.mat", lambda path: matfile.write_mat(path, {"x": a}))
    matfile.register(spark)
    return rounded(spark.read.format("matfield").option("variable", "x").load(f"{folder}/x.mat"), "value", digits=8)


@query("array_weights", "SELECT (i * 6 + j)::BIGINT AS p, v::INT AS v, (i * 6 + j) * 2.0 + v AS w FROM range(5) a(i), range(6) b(j), range(2) c(v)")
def array_weights(spark, d):
    w = np.arange(30.0).reshape(5, 6, 1) * 2 + np.arange(2)
    return arrays.weights_from_array(spark, w, (5, 6), 2)


# ---- saved fits ------------------------------------------------------------------------------------------------------


def _saved(spark, d, **options):
    """A daily fit, saved and loaded again without its field."""
    config = replace(DAY, savedir=_folder(spark), **options)
    from triadic.plans.decompose import fit

    path = results.save(fit(C.daily(spark, d), config, _weights(spark, d)))
    return results.load_result(spark, path), path


def _weights(spark, d):
    return C.point_weights(spark, d).withColumn("w", F.lit(1.0))


@query("saved_bispectrum", f"{RADIUS_SQL} SELECT {_LISTED}, round(l_abs, 5) + 0.0 AS l_abs FROM r")
def saved_bispectrum(spark, d):
    out = _saved(spark, d, save_modes=False)[0].bispectrum
    return rounded(rounded(out.select("triad_idx", *[F.col(c).cast("long").alias(c) for c in ("k", "l", "kl")], "f1", "f2", "f3", F.col("region").cast("long").alias("region"), "l_abs"), "f1", "f2", "f3"), "l_abs", digits=5)


@query("saved_triads", triads_sql(16, 1.0, (1, 2), None))
def saved_triads(spark, d):
    path = _saved(spark, d, save_modes=False)[1]
    return rounded(spark.read.parquet(f"{path}/triads"), "f1", "f2", "f3")


@query("saved_coefficients", f"{MODES_SQL} SELECT triad_idx, b::INT AS block, round(zr, 4) + 0.0 AS re, round(zi, 4) + 0.0 AS im FROM z WHERE triad_idx IN (5, 20)")
def saved_coefficients(spark, d):
    return rounded(_saved(spark, d, save_modes=False)[0].coeffs.where("triad_idx IN (5, 20)"), "re", "im", digits=4)


@query("saved_mean_and_weights", f"SELECT p, v, round(avg(value), 6) + 0.0 AS mean, 1.0::DOUBLE AS w FROM ({C.DAILY}) GROUP BY p, v")
def saved_mean_and_weights(spark, d):
    result, path = _saved(spark, d, save_modes=False)
    return rounded(spark.read.parquet(f"{path}/long_time_mean").join(result.weights, "p").select("p", "v", "mean", "w"), "mean", digits=6)


@query("saved_frequencies", 'SELECT i::INT AS "row", (i - 8)::INT AS f_idx, round((i - 8) / 16.0::DOUBLE, 9) + 0.0 AS freq FROM range(16) r(i)')
def saved_frequencies(spark, d):
    return rounded(spark.read.parquet(f"{_saved(spark, d, save_modes=False)[1]}/freq"), "freq")


@query(
    "saved_settings",
    f"""WITH f AS ({C.DAILY}), t AS ({triads_sql(16, 1.0, (1, 2), None)}) SELECT (SELECT max(t) + 1 FROM f) AS nt, (SELECT max(p) + 1 FROM f) AS nx, 1::BIGINT AS nv, (SELECT (max(t) + 1 - 2) // 14 FROM f) AS n_blocks,
    (SELECT count(*) FROM t) AS n_triads, 16::BIGINT AS n_freq, 'hamming' AS "window", 'nfft16_novlp2_nblks' || (SELECT (max(t) + 1 - 2) // 14 FROM f) AS folder""",
)
def saved_settings(spark, d):
    result, path = _saved(spark, d, save_modes=False)
    read = json.loads(spark.read.text(f"{path}/settings").first()[0])
    row = [*(int(read[c]) for c in ("nt", "nx", "nv", "n_blocks", "n_triads", "n_freq")), result.config.window, read["results_folder"].rsplit("/", 1)[1]]
    return spark.createDataFrame([row], "nt long, nx long, nv long, n_blocks long, n_triads long, n_freq long, window string, folder string")


@query("saved_modes", f"{MODES_SQL} SELECT {_MODULI} FROM psi WHERE comp < 2")
def saved_modes(spark, d):
    """The modes of all triads, as they lie on disk."""
    path = _saved(spark, d)[1]
    return _with_moduli(spark.read.parquet(f"{path}/modes").withColumn("triad_idx", F.col("triad_idx").cast("long")))


@query("modes_at_triad", f"{MODES_SQL} SELECT {_MODULI} FROM psi WHERE comp < 2 AND triad_idx = 7")
def modes_at_triad(spark, d):
    """Read where they were saved."""
    return _with_moduli(_saved(spark, d)[0].get_modes_at_triad(7).withColumn("triad_idx", F.col("triad_idx").cast("long")))


@query("modes_at_frequencies", f"{MODES_SQL} SELECT {_MODULI} FROM psi JOIN tr USING (triad_idx) WHERE comp < 2 AND k = 3 AND l = 2")
def modes_at_frequencies(spark, d):
    """Rebuilt from the data, as only the strongest triads' modes were saved."""
    result, _ = _saved(spark, d, save_modes_top=1)
    return _with_moduli(result.get_modes_at_freqs(3, 2, C.daily(spark, d)).withColumn("triad_idx", F.col("triad_idx").cast("long")))


# ---- what a result tells ---------------------------------------------------------------------------------------------


@query("result_grids", f"{RADIUS_SQL}, g AS (SELECT k::INT AS k, l::INT AS l FROM range(-8, 8) a(k), range(-8, 8) b(l)) SELECT g.k, g.l, round(coalesce(l_abs, -1), 5) + 0.0 AS l_abs, r.k IS NOT NULL AS computed FROM g LEFT JOIN r ON r.k = g.k AND r.l = g.l")
def result_grids(spark, d):
    """L and T on the full plane of frequencies; entries off the triads, which are NaN in both, are shown as -1."""
    result = day_fit(spark, d)
    both = result.L.join(result.T, ["k", "l"])
    return rounded(both.select("k", "l", F.nanvl(F.hypot("re", "im"), F.lit(-1.0)).alias("l_abs"), (~F.isnan("value")).alias("computed")), "l_abs", digits=5)


_NEEDED = f"(SELECT count(DISTINCT x) FROM (SELECT unnest([k, l, kl]) AS x FROM ({triads_sql(16, 1.0, (1, 2), None)})))"


@query(
    "fit_report",
    f"""WITH f AS ({C.DAILY}), n AS (SELECT max(t) + 1 AS nt, max(p) + 1 AS nx, (max(t) + 1 - 2) // 14 AS nb FROM f), t AS (SELECT count(*) AS m FROM ({triads_sql(16, 1.0, (1, 2), None)}))
    SELECT (nt * nx * 8)::BIGINT AS data_bytes, ({_NEEDED} * nx * nb * 16)::BIGINT AS spectra_bytes, (m * 2 * nx * 16)::BIGINT AS modes_bytes, m AS n_triads, {_NEEDED} AS n_freq_needed, nb AS n_blocks, 'uniform' AS weights FROM n, t""",
)
def fit_report(spark, d):
    r = day_fit(spark, d).report()
    size = lambda name: round(r[name] * 2**30)
    row = (size("data_gb"), size("spectra_gb"), size("modes_gb"), r["n_triads"], r["n_freq_needed"], r["n_blocks"], r["weights"])
    return spark.createDataFrame([row], "data_bytes long, spectra_bytes long, modes_bytes long, n_triads long, n_freq_needed long, n_blocks long, weights string")


@query("weights_policy", f"{RADIUS_SQL} SELECT {_LISTED}, round(l_abs, 5) + 0.0 AS l_abs, 'uniform' AS weights FROM r")
def weights_policy(spark, d):
    """What is no table and no dictionary of weights is warned about, and weights are 1."""
    import warnings

    from triadic.plans.decompose import fit

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        result = fit(C.daily(spark, d), DAY, weights=np.ones(5))
    out = result.bispectrum.select("triad_idx", *[F.col(c).cast("long").alias(c) for c in ("k", "l", "kl")], "f1", "f2", "f3", F.col("region").cast("long").alias("region"), "l_abs", F.lit(result.weights_name).alias("weights"))
    return rounded(rounded(out, "f1", "f2", "f3"), "l_abs", digits=5)


@query("kept_modes", f"{MODES_SQL} SELECT {_MODULI} FROM psi WHERE comp < 2 AND triad_idx IN {tuple(_CHOSEN)}")
def kept_modes(spark, d):
    """All modes, which store_modes keeps."""
    return _with_moduli(day_fit(spark, d, replace(DAY, store_modes=True)).modes.where(F.col("triad_idx").isin(_CHOSEN)))


@query("settings_from_parameters", "SELECT 12::BIGINT AS n_overlap, 20::BIGINT AS step, 3::BIGINT AS n_blocks, 'hann' AS \"window\", '1,2' AS regions, 'nfft32_novlp12_nblks3' AS folder, 0.5::DOUBLE AS time_step")
def settings_from_parameters(spark, d):
    """Overlap in percent is rounded down, names are taken in any case, regions are put in order."""
    c = FitConfig.from_params({"n_dft": 32, "time_step": 0.5, "n_space_dims": 1, "n_variables": 1, "overlap": 40, "window": "Hann", "regions": [2, 1, 2], "unknown": 1})
    return spark.createDataFrame([(c.n_overlap, c.step, c.blocks(75), c.window, ",".join(map(str, c.regions)), c.folder(75), c.time_step)], "n_overlap long, step long, n_blocks long, window string, regions string, folder string, time_step double")
