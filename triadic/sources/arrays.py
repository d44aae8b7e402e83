"""Fields from arrays in memory and from files of arrays."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triadic.operators.spectra import concat_in_time
from triadic.sources import matfile
from triadic.sources.matfile import read_mat


def the_array(found) -> np.ndarray:
    """An array as it is; of a dictionary, its only array of two or more dimensions."""
    if not isinstance(found, dict):
        return np.asarray(found)
    large = {k: np.asarray(v) for k, v in found.items() if np.ndim(v) >= 2}
    if len(large) != 1:
        raise ValueError(f"expected one array of two or more dimensions, found: {', '.join(sorted(large)) or 'none'}")
    return next(iter(large.values()))


def shaped(array: np.ndarray, n_space_dims: int, n_variables: int, copied: bool = True) -> np.ndarray:
    """(nt, *space, variable) of real numbers; a single variable's axis may be left out."""
    if n_variables == 1 and array.ndim == n_space_dims + 1:
        array = array[..., None]
    if array.ndim != n_space_dims + 2:
        raise ValueError(f"an array of {n_space_dims + 2} dimensions is expected (time, space, variable), not {array.ndim}")
    if array.shape[-1] != n_variables:
        raise ValueError(f"the last axis has {array.shape[-1]} variables, {n_variables} were declared")
    if np.iscomplexobj(array):
        raise TypeError("the field must be real-valued")
    return np.ascontiguousarray(array) if copied else array


#: Bytes of a slab of samples that goes to a task.
SLAB_BYTES = 4 << 20


def from_array(spark: SparkSession, array: np.ndarray, n_space_dims: int = 1, n_variables: int = 1) -> DataFrame:
    """(t, p, v, value): p is the row-major number of the space point. The array goes out in slabs of samples as it is; tasks number the values."""
    import pyarrow as pa

    a = shaped(np.asarray(array), n_space_dims, n_variables)
    if a.dtype not in (np.float32, np.float64):
        a = a.astype(float)
    nt, nv = a.shape[0], a.shape[-1]
    nx, dtype = a[0].size // nv if nt else 0, a.dtype
    step = max(1, SLAB_BYTES // max(1, nx * nv * a.itemsize))
    starts = list(range(0, nt, step))
    slabs = spark.createDataFrame(pa.table({"first": pa.array(starts, pa.int64()), "data": pa.array([a[t : t + step].tobytes() for t in starts], pa.binary())}))

    def numbered(batches):
        for batch in batches:
            for first, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                value = np.frombuffer(data, dtype)
                at = np.arange(len(value))
                columns = first + at // (nx * nv), at // nv % nx, (at % nv).astype(np.int32), value
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["t", "p", "v", "value"])

    return slabs.mapInArrow(numbered, f"t long, p long, v int, value {'float' if dtype == np.float32 else 'double'}")


def from_file(spark: SparkSession, path: str, n_space_dims: int = 1, n_variables: int = 1) -> DataFrame:
    """A field from a .npy file or a .mat file of version 5, whose numbers the tasks read by offset; all machines must be able to open path."""
    place = matfile._ArrayReader({"path": path})._place()
    shape = shaped(np.broadcast_to(np.zeros(()), place.shape), n_space_dims, n_variables, False).shape
    matfile.register(spark)
    nv = shape[-1]
    rows = spark.read.format("matfield").option("partitions", str(spark.sparkContext.defaultParallelism)).load(path)
    return rows.select("t", F.floor(F.col("i") / F.lit(nv)).cast("long").alias("p"), (F.col("i") % F.lit(nv)).cast("int").alias("v"), "value")


def weights_from_array(spark: SparkSession, weights: np.ndarray, shape: tuple[int, ...], n_variables: int | None) -> DataFrame:
    """(p, v, w), or (p, w) without variables; the array must have the full shape of the grid."""
    import pyarrow as pa

    expected = tuple(shape) + ((n_variables,) if n_variables else ())
    if np.shape(weights) != expected:
        raise ValueError(f"weights of shape {expected} are expected, not {np.shape(weights)}")
    flat = np.asarray(weights, float).reshape(int(np.prod(shape)), -1)
    p, v = np.meshgrid(np.arange(flat.shape[0]), np.arange(flat.shape[1]), indexing="ij")
    out = {"p": p.ravel(), "v": v.ravel().astype(np.int32), "w": flat.ravel()}
    if not n_variables:
        del out["v"]
    return spark.createDataFrame(pa.table(out))


def read_array(path: str) -> np.ndarray:
    """.npy, .npz and .mat files."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind == "npy":
        with matfile.opened(path) as f:
            return np.load(f, allow_pickle=False)
    if kind == "npz":
        with matfile.opened(path) as raw, np.load(raw, allow_pickle=False) as f:
            return the_array(dict(f))
    if kind == "mat":
        return the_array(read_mat(path))
    raise ValueError(f"cannot read files of kind .{kind}")


def load(spark: SparkSession, data, n_space_dims: int = 1, n_variables: int = 1) -> DataFrame:
    """A field from a table, an array, a path, or a list of these, one after the other in time."""
    if isinstance(data, (list, tuple)):
        return concat_in_time([load(spark, d, n_space_dims, n_variables) for d in data])
    if isinstance(data, DataFrame):
        return data
    if isinstance(data, str) and data.endswith((".npy", ".mat")) and not _is_hdf5(data):
        return from_file(spark, data, n_space_dims, n_variables)
    return from_array(spark, read_array(data) if isinstance(data, str) else the_array(data), n_space_dims, n_variables)


def _is_hdf5(path: str) -> bool:
    with matfile.opened(path) as f:
        return b"\x89HDF" in f.read(1024)


def transposed_points(field: DataFrame, nx: int, ny: int) -> DataFrame:
    """A field whose points were numbered x-major, numbered with x last: p = iy * nx + ix."""
    return field.withColumn("p", (F.col("p") % ny) * nx + F.floor(F.col("p") / ny)).withColumn("p", F.col("p").cast("long"))
