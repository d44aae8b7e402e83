import numpy as np
import pytest
from pyspark.sql import functions as F

from triadic.catalog import spectra as C
from triadic.operators import estimators
from triadic.sources import fields

N = 620


@pytest.fixture(scope="module")
def vectors():
    return np.random.default_rng(5).standard_normal((N, 64)).astype(np.float32).astype(float)


@pytest.fixture(scope="module")
def sf_dir(spark, vectors, tmp_path_factory):
    path = tmp_path_factory.mktemp("vectors")
    rows = [(i, v.tolist(), 0) for i, v in enumerate(vectors)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return str(path)


def test_every_vector_is_a_sample(spark, sf_dir, vectors):
    for got in (fields.embeddings(spark, sf_dir), C.QUERIES["field_embeddings"](spark, sf_dir)):
        one = got.agg(F.count(F.lit(1)), F.countDistinct("t"), F.max("t"), F.sum("value")).first()
        assert tuple(one)[:3] == (N * 64, N, N - 1) and one[3] == pytest.approx(vectors.sum())


def test_every_vector_has_its_symmetric_fraction(spark, sf_dir, vectors):
    grid = vectors.reshape(N, 8, 8)
    want = (((grid + grid[:, ::-1]) / 2) ** 2).sum((1, 2)) / (grid**2).sum((1, 2))
    got = {r.t: r.fraction for r in C.symmetric_fraction(spark, sf_dir).collect()}
    assert len(got) == N and all(abs(got[t] - want[t]) <= 1e-6 for t in range(N))


def test_every_vector_has_its_wavelength_at_the_full_padding(spark, sf_dir, vectors):
    power = (np.abs(np.fft.fft(vectors.reshape(N, 8, 8), 4096, axis=2)) ** 2).sum(1)
    want = 4096 * 0.5 / (power[:, 1:2049].argmax(1) + 1)
    got = {r.t: r.wavelength for r in C.streamwise_wavelength(spark, sf_dir).collect()}
    assert len(got) == N and all(abs(got[t] - want[t]) <= 1e-5 for t in range(N))


def test_wavelength_of_complex_rows(spark):
    rng = np.random.default_rng(2)
    z = rng.standard_normal((3, 4, 5)) + 1j * rng.standard_normal((3, 4, 5))
    rows = [(int(t), int(y), int(x), float(z[t, y, x].real), float(z[t, y, x].imag)) for t, y, x in np.ndindex(z.shape)]
    df = spark.createDataFrame(rows, "t long, iy int, ix int, re double, im double").repartition(3)
    for n_pad in (64, 33):
        power = (np.abs(np.fft.fft(z, n_pad, axis=2)) ** 2).sum(1)
        m = np.arange(1, n_pad // 2 + 1)
        best = m[np.maximum(power[:, m], power[:, -m]).argmax(1)]
        got = {r.t: r.wavelength for r in estimators.streamwise_wavelength(df, 0.25, n_pad, ["t"]).collect()}
        assert got == pytest.approx({t: n_pad * 0.25 / best[t] for t in range(3)})
