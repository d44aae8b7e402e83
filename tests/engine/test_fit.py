from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from triadic.operators import estimators, weights
from triadic.operators import spectra as S
from triadic.operators.radius import numerical_radius
from triadic.plans.config import FitConfig
from triadic.plans.decompose import fit, selected_for_saving, top_triads
from triadic.sources import arrays, fields, matfile, results


def plain(q, w, config):
    """The definitions, written out on arrays: (l, t, a, legs) for each triad. q: (nt, nx, nv), w: (nx, nv or states)."""
    nt, nx, nv = q.shape
    n = np.arange(config.n_dft)
    win = 0.54 - 0.46 * np.cos(2 * np.pi * n / (config.n_dft - 1)) if config.window == "hamming" else 0.5 - 0.5 * np.cos(2 * np.pi * n / (config.n_dft - 1))
    blocks = (nt - config.n_overlap) // config.step
    x = np.stack([(q[b * config.step : b * config.step + config.n_dft] - q.mean(axis=0)) * win[:, None, None] for b in range(blocks)])
    hat = lambda f: np.einsum("bnpv,n->pvb", x, np.exp(-2j * np.pi * f * n / config.n_dft)) / win.mean() / config.n_dft
    out = []
    from triadic.operators.triads import enumerate_triads

    t = enumerate_triads(config.n_dft, config.time_step, config.regions, config.max_freq_idx)
    for k, l in zip(t["k"].tolist(), t["l"].tolist()):  # noqa: E741
        if config.state_idx is None:
            total, product = hat(k + l), hat(k) * hat(l)
        else:
            total = np.stack([hat(k + l)[:, s] for s in config.state_idx], 1)
            product = np.stack([sum(hat(k)[:, row[i]] * hat(l)[:, row[i + 1]] for i in range(0, len(row), 2)) for row in config.qr_idx], 1)
        total, product, flat = total.reshape(-1, blocks), product.reshape(-1, blocks), w.reshape(-1, 1)
        b = total.conj().T @ (flat * product) / blocks
        value, a = numerical_radius(b, 1e-10)
        psi = [total @ a, product @ a]
        out.append((abs(value), (psi[0].conj() @ psi[1]).real / blocks, [p / np.sqrt((flat[:, 0] * abs(p) ** 2).sum()) for p in psi]))
    return out


def made_field(nt=230, nx=30, nv=3):
    """Waves that interact, drifting in amplitude, and noise."""
    rng = np.random.default_rng(20_31)
    t, x, v = np.arange(nt)[:, None, None], np.arange(nx)[None, :, None], np.arange(nv)[None, None, :]
    waves = sum((1 + 0.2 * np.sin(0.05 * t * (k + 1))) * np.cos(k * 0.3 * x - 0.7 * k * t + v) for k in (1, 2, 3))
    return waves + rng.uniform(-1, 1, (nt, nx, nv))


DATA = made_field()
W = 2 + np.cos(np.arange(30))
ONE = FitConfig(n_dft=18, time_step=0.25, n_overlap=7, max_freq_idx=4, tol=1e-10, chunk_values=230 * 7)
CROSS = FitConfig(n_dft=18, time_step=0.25, n_overlap=7, max_freq_idx=4, tol=1e-10, n_variables=3, state_idx=(2, 0), qr_idx=((0, 1, 1, 1), (2, 0)), chunk_values=230 * 3 * 7)


def rows_of(result):
    return result.bispectrum.orderBy("triad_idx").collect()


@pytest.mark.parametrize("config,nv", [(ONE, 1), (CROSS, 3)])
def test_fit_against_the_definitions(spark, config, nv):
    q = DATA[..., :nv]
    field, w = arrays.from_array(spark, q, 1, nv), arrays.weights_from_array(spark, W, (30,), None)
    result = fit(field, config, w)
    states = config.n_states
    want = plain(q, np.repeat(W[:, None], states, 1), config)
    got = rows_of(result)
    assert len(got) == len(want) == 25
    modes = {(r.triad_idx, r.comp, r.p, r.s): r.re + 1j * r.im for r in result.modes_of([3, 20]).collect()}
    for r, (radius, transfer, psi) in zip(got, want):
        assert r.l_abs == pytest.approx(radius, rel=1e-8)
        if r.k and r.l:
            assert r.t == pytest.approx(transfer, rel=1e-4, abs=1e-6)
        if r.triad_idx in (3, 20):
            for comp in (0, 1):
                own = np.array([modes[(r.triad_idx, comp, p, s)] for p in range(30) for s in range(states)])
                flat = np.repeat(W[:, None], states, 1).ravel()
                assert (flat * abs(own) ** 2).sum() == pytest.approx(1)
                assert abs((flat * own.conj() * psi[comp]).sum()) == pytest.approx(1, rel=1e-4)


def test_partitions_do_not_change_a_bit(spark):
    field = arrays.from_array(spark, DATA[..., :1], 1, 1)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    seen = []
    try:
        for n in ("1", "2", "4"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            seen.append([(r.l_re, r.l_im, r.t, r.a_re, r.a_im) for r in rows_of(fit(field.repartition(int(n) + 1), ONE))])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1] == seen[2]


def test_scale_equivariance_and_options(spark):
    q = DATA[:150, :4, :1]
    config = FitConfig(n_dft=32, time_step=1.0, max_freq_idx=4, compute_energy_transfer=False, constituent_modes=True, dtype="single")
    a, b = (rows_of(fit(arrays.from_array(spark, q * s), config)) for s in (1.0, 1e-2))
    for x, y in zip(a, b):
        assert y.l_abs == pytest.approx(x.l_abs * 1e-6, rel=1e-3)
        assert np.isnan(x.t) and len(x.norms) == 4


def test_surrogate_waves(spark):
    """Peaks that the published case states: resonant waves stand out, others do not."""
    # Frequencies, wavenumbers' generator and peaks of the published case.
    k = np.random.default_rng(0).uniform(0, 5, 4)
    config = FitConfig(n_dft=128, time_step=1.0, overlap=0, window="hann", regions=(1,), max_freq_idx=40)

    def peak(f, noise=False):
        field = fields.waves(spark, f, k)
        field = fields.with_noise(field, 1.0, 3) if noise else field
        result = fit(field, config, weights.uniform(spark.range(100).withColumnRenamed("id", "p"), None, 2 * np.pi / 100))
        return result, top_triads(result.bispectrum, 2).collect()

    result, (first, second) = peak((0.046875, 0.203125, 0.25))
    assert (first.k, first.l) == (26, 6) and first.value == pytest.approx(0.0497747, rel=1e-5)
    _, off_grid = peak((0.05, 0.2, 0.25))
    assert (off_grid[0].k, off_grid[0].l) == (26, 6) and off_grid[0].value == pytest.approx(0.0405229, rel=1e-5)
    _, flat = peak((0.046875, 0.203125, 0.3515625))
    _, quartet = peak((0.046875, 0.1484375, 0.25, 0.453125))
    assert max(flat[0].value, quartet[0].value) < 0.1 * first.value
    _, noisy = peak((0.046875, 0.203125, 0.25), True)
    assert (noisy[0].k, noisy[0].l) == (26, 6) and noisy[0].value > 1.5 * noisy[1].value
    # The published noise, drawn after three wavenumbers: its peak is within 3 % of the clean one.
    rng = np.random.default_rng(0)
    own, x = rng.uniform(0, 5, 3), np.linspace(0, 2 * np.pi, 100, endpoint=False)
    q = sum(np.cos(a * x[None] - 2 * np.pi * f * np.arange(1280)[:, None]) for a, f in zip(own, (0.046875, 0.203125, 0.25)))
    q = q + rng.standard_normal(q.shape) * np.sqrt(q.var())
    loud = top_triads(fit(arrays.from_array(spark, q), config, weights.uniform(spark.range(100).withColumnRenamed("id", "p"), None, 2 * np.pi / 100)).bispectrum, 1).first()
    assert (loud.k, loud.l) == (26, 6) and loud.value == pytest.approx(0.0508702, rel=1e-5) and loud.value == pytest.approx(first.value, rel=0.03)
    # The sum mode is the third wave, the product mode that of the two others' wavenumbers together.
    modes = result.get_modes_at_freqs(26, 6).collect()
    for comp, wave in ((0, np.exp(-1j * k[2] * x)), (1, np.exp(-1j * (k[0] + k[1]) * x))):
        psi = np.array([r.re + 1j * r.im for r in sorted(modes, key=lambda r: r.p) if r.comp == comp])
        assert abs(psi.conj() @ wave) / np.linalg.norm(psi) / np.linalg.norm(wave) == pytest.approx(1.0, abs=1e-3)


def test_ranking_and_selection(spark):
    result = fit(arrays.from_array(spark, DATA[..., :1], 1, 1), ONE)
    all_rows = rows_of(result)
    want = sorted((r for r in all_rows if r.k and r.l), key=lambda r: (-r.l_abs, r.triad_idx))
    assert [r.triad_idx for r in result.top_triads(5).collect()] == [r.triad_idx for r in want[:5]]
    assert result.top_triads(1000, "t", False).count() == 25
    with pytest.raises(ValueError):
        result.top_triads(3, "x")
    n = len(want)
    assert [r.triad_idx for r in selected_for_saving(result.bispectrum, 0.3).collect()] == sorted(r.triad_idx for r in want[: int(np.ceil(0.3 * n))])
    assert selected_for_saving(result.bispectrum, 1000).count() == n and selected_for_saving(result.bispectrum, None).count() == 25
    assert top_triads(result.bispectrum.where("triad_idx < 0")).count() == 0
    dense = {(r.k, r.l): r.value for r in result.dense().collect()}
    assert len(dense) == 324 and sum(np.isnan(v) for v in dense.values()) == 324 - 25


def test_save_and_load(spark, tmp_path):
    field = arrays.from_array(spark, DATA[..., :1], 1, 1)
    config = FitConfig(n_dft=18, time_step=0.25, n_overlap=7, max_freq_idx=3, savedir=str(tmp_path), save_modes_top=2, save_dtype="single")
    w = arrays.weights_from_array(spark, W, (30,), None)
    results.save(fit(field, FitConfig(n_dft=18, time_step=0.25, n_overlap=7, max_freq_idx=3, savedir=str(tmp_path), save_modes_top=3), w))
    result = fit(field, config, {"weights": w, "weights_name": "waves"}, xshape=(5, 6))
    path = results.save(result)
    assert path == result.savedir_sim and path.endswith("nfft18_novlp7_nblks20")
    # What an earlier fit left is gone, and weights were kept with the fit.
    assert len(list((Path(path) / "modes").glob("triad_idx=*"))) == 2
    assert {r.p: r.w for r in spark.read.parquet(f"{path}/weights").collect()} == pytest.approx(dict(enumerate(W)), rel=1e-6)
    results.save(fit(field, FitConfig(n_dft=18, time_step=0.25, n_overlap=7, max_freq_idx=3, savedir=str(tmp_path), save_modes=False), w))
    assert not (Path(path) / "modes").exists() and not (Path(path) / "saved_triad_idx").exists()
    path = results.save(result)
    back = results.load_result(spark, path)
    assert back.config == config and back.n_triads == result.n_triads
    assert (back.weights_name, back.xshape, back.xdim, back.dt, back.shape) == ("waves", (5, 6), 2, 0.25, (230, 5, 6, 1)) and back.weights.count() == 30
    kept = [r.triad_idx for r in spark.read.parquet(f"{path}/saved_triad_idx").collect()]
    assert len(kept) == 2
    stored = back.get_modes_at_triad(kept[0])
    assert stored.count() == 60 and dict(stored.dtypes)["re"] == "float"
    missing = next(i for i in range(result.n_triads) if i not in kept)
    with pytest.raises(FileNotFoundError, match="top"):
        back.get_modes_at_triad(missing)
    assert back.get_modes_at_triad(missing, field).count() == 60
    with pytest.raises(IndexError):
        back.get_modes_at_triad(10_000)
    with pytest.raises(ValueError, match="shape"):
        back.reconstruct_modes(field.where("t < 100"), 0)
    assert dict(spark.read.parquet(f"{path}/bispectrum").dtypes)["f1"] == "double"


def test_refused_fields(spark):
    field = arrays.from_array(spark, DATA[:40, :3, :1], 1, 1)
    with pytest.raises(ValueError, match="dense"):
        fit(field.where("t <> 7 OR p <> 1"), ONE)
    with pytest.raises(ValueError, match="not finite"):
        fit(field.withColumn("value", F.when(F.col("t") == 3, float("nan")).otherwise(F.col("value"))), ONE)
    with pytest.raises(ValueError, match="variables"):
        fit(field, CROSS)
    with pytest.raises(ValueError, match="weights"):
        fit(field, ONE, spark.range(2).selectExpr("id AS p", "1.0D AS w"))
    with pytest.raises(ValueError, match="blocks"):
        fit(field.where("t < 20"), ONE)
    with pytest.raises(TypeError, match="real-valued"):
        S.check_field(field.withColumn("value", F.struct("value", "value")))


def test_arrays(spark):
    with pytest.raises(TypeError, match="real-valued"):
        arrays.from_array(spark, np.ones((64, 4, 1)) * 1j)
    with pytest.raises(ValueError):
        arrays.from_array(spark, np.ones((4, 4, 4, 4)))
    with pytest.raises(ValueError):
        arrays.the_array({"a": np.ones((2, 2)), "b": np.ones((2, 2))})
    with pytest.raises(ValueError):
        arrays.weights_from_array(spark, np.ones(6), (2, 3), None)
    a = np.arange(24.0).reshape(2, 3, 2, 2)
    rows = {(r.t, r.p, r.v): r.value for r in arrays.from_array(spark, a, 2, 2).collect()}
    assert rows == {(t, i * 2 + j, v): a[t, i, j, v] for t in range(2) for i in range(3) for j in range(2) for v in range(2)}
    both = arrays.load(spark, [a, {"x": a, "dt": 0.1}], 2, 2)
    assert both.agg(F.max("t")).first()[0] == 3
    ints = arrays.from_array(spark, np.arange(6).reshape(3, 2))
    assert dict(ints.dtypes)["value"] == "double"
    moved = arrays.transposed_points(arrays.from_array(spark, np.arange(6.0).reshape(1, 3, 2), 2, 1), 3, 2)
    assert [r.value for r in moved.orderBy("p").collect()] == [0, 2, 4, 1, 3, 5]


@pytest.mark.parametrize("compress", [False, True])
def test_mat_files(spark, tmp_path, compress):
    path = str(tmp_path / "x.mat")
    a = np.random.default_rng(1).standard_normal((6, 3, 2))
    matfile.write_mat(path, {"u": a, "dt": np.array([[0.12]]), "z": np.array([[1 + 2j, 3.0]])}, compress)
    back = matfile.read_mat(path)
    assert (back["u"] == a).all() and back["dt"] == 0.12 and (back["z"] == [[1 + 2j, 3.0]]).all()
    matfile.register(spark)
    rows = spark.read.format("matfield").option("variable", "u").load(path).orderBy("t", "i").collect()
    assert [r.value for r in rows] == a.ravel().tolist()
    one = str(tmp_path / "one.mat")
    matfile.write_mat(one, {"u": a}, compress)
    want = {(t, i * 2 + j): a[t, i, j] for t, i, j in np.ndindex(a.shape)}
    for path_ in (one, str(tmp_path / "c.npy"), str(tmp_path / "f.npy")):
        if path_.endswith("npy"):
            np.save(path_, a if path_.endswith("c.npy") else np.asfortranarray(a))
        place = next(iter(matfile.places(path_).values()))
        flat = a.ravel(order="F" if place.fortran else "C")
        assert place.shape == a.shape and (matfile.numbers(path_, place, 7, 11) == flat[7:18]).all()
        rows = arrays.from_file(spark, path_, 1, 2)
        assert {(r.t, r.p * 2 + r.v): r.value for r in rows.collect()} == want and rows.rdd.getNumPartitions() > 1
        assert {(r.t, r.p): r.value for r in arrays.load(spark, path_, 2, 1).collect()} == want
    with pytest.raises(ValueError, match="one array"):
        arrays.load(spark, path, 2, 1)
    with pytest.raises(ValueError):
        arrays.read_array("x.csv")
    np.save(str(tmp_path / "y.npy"), a)
    assert (arrays.read_array(str(tmp_path / "y.npy")) == a).all()


def test_weights_rules(spark):
    x, y = [0.0, 0.1, 0.3, 0.6, 1.0, 1.5], [-1.0, -0.2, 0.0, 0.5, 2.0]
    axis = lambda c: spark.createDataFrame(list(enumerate(c)), "i long, c double")
    w = {r.p: r.w for r in weights.trapz_2d(axis(x), axis(y), None).collect()}
    assert sum(w.values()) == pytest.approx(1.5 * 3)
    grid = [(j * 6 + i, j, i, y[j], x[i]) for j in range(5) for i in range(6)]
    flat = spark.createDataFrame(grid, "p long, iy long, ix long, y double, x double")
    c, s = np.cos(0.7), np.sin(0.7)
    turned = flat.select("p", "iy", "ix", (F.col("x") * F.lit(s) + F.col("y") * F.lit(c)).alias("y"), (F.col("x") * F.lit(c) - F.col("y") * F.lit(s)).alias("x"))
    for g in (flat, turned):
        assert {r.p: pytest.approx(r.w, rel=1e-12) for r in weights.curvilinear_2d(g, None).collect()} == w
    assert weights.cell_widths(axis([3.0]), "i", "c").first().width == 1.0


def test_panels_and_levels(spark):
    result = fit(arrays.from_array(spark, DATA[..., :1], 1, 1), FitConfig(n_dft=16, time_step=0.5, max_freq_idx=2, constituent_modes=True))
    panels = estimators.mode_panels(result.modes_of(1), 6, [0])
    assert {r.row for r in panels.collect()} == {-1, 0, 1, 2, 3}
    levels = estimators.contour_levels(panels).collect()
    assert len(levels) == 257 and levels[0].level == -levels[-1].level and levels[128].level == 0
    assert estimators.bispectrum_map(result.bispectrum.withColumn("l_abs", F.lit(0.0))).where("value IS NOT NULL").count() == 0


def test_weights_and_modes_that_are_kept(spark):
    field = arrays.from_array(spark, DATA[:, :6, :1], 2 - 1, 1)
    config = FitConfig(n_dft=18, time_step=0.25, n_overlap=7, max_freq_idx=2, tol=1e-10)
    plain = [r.l_abs for r in rows_of(fit(field, config))]
    with pytest.warns(UserWarning, match="uniform"):
        other = fit(field, config, np.ones(6))
    assert other.weights_name == "uniform" and [r.l_abs for r in rows_of(other)] == plain
    given = fit(field, config, {"weights": np.full((2, 3, 1), 2.0), "weights_name": "twice"}, xshape=(2, 3))
    assert given.weights_name == "twice" and [r.l_abs for r in rows_of(given)] == pytest.approx([2 * x for x in plain])
    with pytest.raises(ValueError, match="store_modes"):
        given.modes  # noqa: B018
    with pytest.raises(ValueError, match="grid"):
        fit(field, config, xshape=(4, 2))
    kept = fit(field, FitConfig(n_dft=18, time_step=0.25, n_overlap=7, max_freq_idx=2, store_modes=True))
    assert kept.modes.count() == kept.n_triads * 2 * 6 and kept.modes is kept.modes
    grid = {(r.k, r.l): r for r in kept.L.join(kept.T, ["k", "l"]).collect()}
    assert len(grid) == 18**2 and sum(not np.isnan(r.value) for r in grid.values()) == kept.n_triads
    assert kept.coeffs.groupBy("triad_idx").agg(F.sum(F.col("re") ** 2 + F.col("im") ** 2).alias("n")).where("abs(n - 1) > 1e-9").count() == 0
    report = kept.report()
    assert report["n_triads"] == kept.n_triads and report["data_gb"] == pytest.approx(230 * 6 * 8 / 2**30)
    with pytest.raises(ValueError, match="max_modes_gb"):
        fit(field, FitConfig(n_dft=18, time_step=0.25, max_freq_idx=2, store_modes=True, max_modes_gb=1e-9))


def test_many_blocks_and_slices_change_no_bit(spark):
    """Chunks with fewer series than blocks send their legs; slices of triads and packing by other rows change nothing."""
    field = arrays.from_array(spark, DATA[..., :1], 1, 1)
    config = FitConfig(n_dft=18, time_step=0.25, n_overlap=16, max_freq_idx=2, tol=1e-10, chunk_values=230 * 4)
    assert config.blocks(230) == 107
    seen = [[(r.l_re, r.l_im, r.t, r.a_re) for r in rows_of(fit(f, config))] for f in (field, field.orderBy(F.rand(3)), field.repartition(5, "p"))]
    assert seen[0] == seen[1] == seen[2]
    want = plain(DATA[..., :1], np.ones((30, 1)), config)
    assert [np.hypot(*x[:2]) for x in seen[0]] == pytest.approx([w[0] for w in want], rel=1e-8)
