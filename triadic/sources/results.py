"""Results on disk: one folder a fit, Parquet tables and a file of settings."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triadic.operators.spectra import long_time_mean
from triadic.plans.config import FitConfig, precision
from triadic.plans.decompose import FitResult, selected_for_saving, settings


def at_precision(df: DataFrame, config: FitConfig, keep: tuple[str, ...] = ("f1", "f2", "f3")) -> DataFrame:
    """Floating columns cast to save_dtype; frequencies and integers stay."""
    kind = precision(config.save_dtype)
    cast = {"double": kind, "array<double>": f"array<{kind}>"}
    return df.select(*[F.col(c).cast(cast[t]).alias(c) if t in cast and c not in keep else F.col(c) for c, t in df.dtypes])


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def _remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def save(result: FitResult, weights: DataFrame | None = None, points_in_file: int = 1 << 16) -> str:
    """Writes bispectrum, triads, coefficients, mean, weights, settings, and modes as the settings ask; gives the folder.

    The folder's name tells the blocks only, so modes and selections of an earlier fit are removed first. Modes lie by
    triad, in files of points_in_file points, so that the points of a triad need not meet in one task.
    """
    config, spark = result.config, result.bispectrum.sparkSession
    path = f"{config.savedir.rstrip('/')}/{config.folder(result.nt)}"
    put = lambda df, name: df.write.mode("overwrite").parquet(f"{path}/{name}")
    weights = result.weights if weights is None else weights
    if config.save_modes and result.field is not None:
        config.check_size(result.n_triads, result.nx, _count(result))
    for stale in ("modes", "saved_triad_idx"):
        _remove(spark, f"{path}/{stale}")
    put(at_precision(result.bispectrum, config), "bispectrum")
    done = FitResult(config, (result.nt, result.nx, result.nv), spark.read.parquet(f"{path}/bispectrum"), result.field, path, weights, result.weights_name, result.xshape)
    put(done.triads, "triads")
    put(done.bispectrum.select("triad_idx", "a_re", "a_im"), "coeffs")
    put(spark.createDataFrame([(i, int(f), float(x)) for i, (f, x) in enumerate(zip(result.f_idx, result.freq))], "row int, f_idx int, freq double"), "freq")
    if result.field is not None:
        put(at_precision(long_time_mean(result.field), config), "long_time_mean")
    if weights is None:
        weights = spark.range(result.nx).select(F.col("id").alias("p"), F.lit(1.0).alias("w"))
    put(at_precision(weights, config), "weights")
    if config.save_modes and result.field is not None:
        # Modes are normalised by coefficients at full precision, those of the fit itself.
        chosen = selected_for_saving(done.bispectrum, config.save_modes_top)
        if config.save_modes_top is not None:
            put(chosen, "saved_triad_idx")
            chosen = spark.read.parquet(f"{path}/saved_triad_idx")
        modes = at_precision(result.reconstruct_modes(result.field, chosen), config)
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = modes.repartition(n, "triad_idx", F.floor(F.col("p") / F.lit(points_in_file)))
        dealt.write.mode("overwrite").partitionBy("triad_idx").parquet(f"{path}/modes")
    derived = {"nt": result.nt, "nx": result.nx, "nv": result.nv, "xshape": list(result.xshape), "weights_name": result.weights_name, "n_freq": result.n_freq, "n_triads": result.n_triads, "n_blocks": result.n_blocks, "results_folder": path}
    _write_text(spark, f"{path}/settings", json.dumps(settings(config) | derived))
    return path


def _count(result: FitResult) -> int:
    """How many triads' modes the settings ask to save."""
    top, off_axes = result.config.save_modes_top, int(((result.table["k"] != 0) & (result.table["l"] != 0)).sum())
    if top is None:
        return result.n_triads
    return min(off_axes, int(np.ceil(top * off_axes)) if isinstance(top, float) else int(top))


def load_result(spark: SparkSession, path: str) -> FitResult:
    """A saved fit; its modes are read where they were saved, or rebuilt from data that is given."""
    read = json.loads(spark.read.text(f"{path}/settings").first()[0])
    known = {k: tuple(map(tuple, v)) if k == "qr_idx" and v else tuple(v) if isinstance(v, list) else v for k, v in read.items() if k in FitConfig.__dataclass_fields__ and k != "step"}
    weights = spark.read.parquet(f"{path}/weights")
    return FitResult(FitConfig(**known), (read["nt"], read["nx"], read["nv"]), spark.read.parquet(f"{path}/bispectrum"), None, path, weights, read["weights_name"], tuple(read["xshape"]))
