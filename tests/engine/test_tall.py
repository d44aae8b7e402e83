import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from test_fit import DATA, W, plain, rows_of
from triadic.plans import tall
from triadic.plans.config import FitConfig
from triadic.plans.decompose import fit
from triadic.sources import arrays


@pytest.mark.parametrize("config,nv", [(FitConfig(n_dft=18, time_step=0.25, n_overlap=17, max_freq_idx=2, tol=1e-12, chunk_values=230 * 2), 1), (FitConfig(n_dft=18, time_step=0.25, n_overlap=16, max_freq_idx=2, tol=1e-12, n_variables=3, state_idx=(2, 0), qr_idx=((0, 1, 1, 1), (2, 0)), chunk_values=230 * 6), 3)])
@pytest.mark.parametrize("weighted", [False, True])
def test_many_blocks_at_few_points(spark, monkeypatch, config, nv, weighted):
    """As the definitions say, by chunks of blocks smaller than the triangle and larger, and to the bit for any packing."""
    monkeypatch.setattr(tall, "MOST_BLOCKS", 50)
    q = np.ascontiguousarray(DATA[:, :5, :nv])
    field, w = arrays.from_array(spark, q, 1, nv), arrays.weights_from_array(spark, W[:5], (5,), None) if weighted else None
    assert tall.applies(config, 230, 5)
    want = plain(q, np.repeat((W[:5] if weighted else np.ones(5))[:, None], config.n_states, 1), config)
    before = None
    for numbers, parts in ((1 << 21, 1), (1, 1), (1, 5)):
        monkeypatch.setattr(tall, "CHUNK_NUMBERS", numbers)
        result = fit(field.repartition(parts, "p"), config, w)
        got = rows_of(result)
        assert len(got) == len(want)
        for r, (radius, transfer, _) in zip(got, want):
            assert r.l_abs == pytest.approx(radius, rel=1e-9) and abs(complex(r.l_re, r.l_im)) == pytest.approx(radius, rel=1e-9)
            if r.k and r.l:
                assert r.t == pytest.approx(transfer, rel=1e-4, abs=1e-6)
            a = np.array(r.a_re) + 1j * np.array(r.a_im)
            assert len(a) == result.n_blocks and np.linalg.norm(a) == pytest.approx(1) and a[np.abs(a).argmax()].imag == pytest.approx(0, abs=1e-12)
        modes = {(r.triad_idx, r.comp, r.p, r.s): r.re + 1j * r.im for r in result.modes_of([7]).collect()}
        for comp in (0, 1):
            own = np.array([modes[(7, comp, p, s)] for p in range(5) for s in range(config.n_states)])
            assert abs(np.vdot(want[7][2][comp], own)) == pytest.approx(np.linalg.norm(own) * np.linalg.norm(want[7][2][comp]), rel=1e-6)
            assert np.linalg.norm(own) == pytest.approx(np.linalg.norm(want[7][2][comp]), rel=1e-6)
        if numbers == 1:
            assert before is None or got == before
            before = got
        result.forget()


def test_same_as_matrices_of_blocks(spark, monkeypatch):
    """Constituents' norms, single precision, and a field that is zero at all points."""
    q = np.ascontiguousarray(DATA[:, :4, :1])
    for data, options in ((q, {"constituent_modes": True}), (q, {"dtype": "single"}), (q * 0, {})):
        config = FitConfig(n_dft=18, time_step=0.25, n_overlap=16, max_freq_idx=2, tol=1e-12, **options)
        field = arrays.from_array(spark, data)
        monkeypatch.setattr(tall, "MOST_BLOCKS", 1 << 30)
        want = rows_of(fit(field, config, keep=False))
        monkeypatch.setattr(tall, "MOST_BLOCKS", 50)
        got = rows_of(fit(field, config, keep=False))
        for a, b in zip(got, want, strict=True):
            for c in ("l_abs", "t"):
                assert a[c] == pytest.approx(b[c], rel=1e-4, abs=1e-9), c
            # Where the sum is the mean, conjugate maximisers tie, and the constituents change places.
            assert (sorted(a.norms) if a.kl == 0 else a.norms) == pytest.approx(sorted(b.norms) if a.kl == 0 else b.norms, rel=1e-4, abs=1e-9)
            assert (a.k, a.l, a.region, len(a.a_re)) == (b.k, b.l, b.region, len(b.a_re))
            if not data.any():
                assert a.a_re == b.a_re and a.a_im == b.a_im


def test_long_records_make_no_matrix_of_blocks(spark):
    """20,000 blocks at two points: a matrix of blocks would take 6.4 GB."""
    rng = np.random.default_rng(3)
    config = FitConfig(n_dft=8, time_step=1.0, n_overlap=4, max_freq_idx=1)
    got = rows_of(fit(arrays.from_array(spark, rng.standard_normal((80_004, 2))), config))
    assert len(got) == 4 and all(len(r.a_re) == 20_000 and r.l_abs > 0 for r in got)


def test_the_field_is_packed_once(spark, monkeypatch):
    """Both passes over the chunks of blocks start from kept spectra, without copies for slices; forget() gives them back."""
    monkeypatch.setattr(tall, "MOST_BLOCKS", 50)
    config = FitConfig(n_dft=18, time_step=0.25, n_overlap=16, max_freq_idx=2)
    read = spark.sparkContext.accumulator(0)
    field = arrays.from_array(spark, np.ascontiguousarray(DATA[:, :5, :1]), 1, 1)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    n = field.count()
    result = fit(field.mapInArrow(counted, field.schema), config)
    assert read.value == n  # the check of the field
    rows = rows_of(result)
    assert len(rows) == result.n_triads and all(len(r.a_re) == result.n_blocks for r in rows)
    assert read.value == 2 * n
    solved, spectra = result.inner
    assert spectra.storageLevel.useDisk and not spectra.storageLevel.useMemory
    assert spectra.count() == -(-5 // config.points(230, 1)) * -(-result.n_blocks // tall.blocks_of_chunk(config, 5, 1, 5))
    result.forget()
    assert not spectra.storageLevel.useDisk and not solved.storageLevel.useMemory


@pytest.mark.parametrize("name", ["embedding_radius_few_blocks", "worked_cascade", "worked_single_variable"])
def test_queries_on_many_vectors(spark, monkeypatch, tmp_path, name):
    """14,000 vectors have more blocks than series: no matrix of blocks, and the same rows as from these."""
    import __spark_entry__ as entry
    from triadic.plans import decompose

    x = np.random.default_rng(7).standard_normal((14_000, 64)).astype(np.float32)
    x += np.cos(0.05 * np.arange(14_000))[:, None] + np.cos(0.1 * np.arange(14_000))[:, None]
    table = pa.table({"vec_id": np.arange(14_000), "embedding": pa.array(list(x), pa.list_(pa.float32())), "label": np.zeros(14_000, np.int32)})
    pq.write_table(table, tmp_path / "embeddings.parquet")
    run = lambda: sorted(map(tuple, entry.queries()[name](spark, str(tmp_path)).collect()))
    want = run()

    def refused(*_):
        raise AssertionError("matrices of blocks")

    monkeypatch.setattr(tall, "MOST_BLOCKS", 100)
    monkeypatch.setattr(decompose, "_partials", refused)
    got = run()
    assert len(got) == len(want) and all(a == pytest.approx(b, rel=1e-5, abs=2e-6) for a, b in zip(got, want))
