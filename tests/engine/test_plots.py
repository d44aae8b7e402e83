import numpy as np
import pytest

from triadic import plots
from triadic.plans.config import FitConfig
from triadic.plans.decompose import fit
from triadic.sources import arrays


def test_arrays_to_draw(spark):
    q = np.random.default_rng(3).standard_normal((60, 2, 3, 1))
    result = fit(arrays.from_array(spark, q, 2, 1), FitConfig(n_dft=16, time_step=1.0, max_freq_idx=3, n_space_dims=2))
    freq, field = plots.bispectrum_arrays(result)
    assert len(freq) == 16 and field.count() == result.n_triads
    i = result.find_triad(2, 1)
    assert field[2 + 8, 1 + 8] == pytest.approx(np.log(result.bispectrum.where(f"triad_idx = {i}").first().l_abs))
    panels = plots.panel_arrays(result, 2, 1, (2, 3))
    assert set(panels) == {(0, 0), (1, 0), (-1, 0)} and all(np.isfinite(p).all() for p in panels.values())
    with pytest.raises(ValueError):
        plots.panel_arrays(result, 2, 1, (2, 2))
    assert plots.levels_between(field, 10) == 10 and len(plots.levels_between(field, 10, vmax=1.0)) == 11
    f1, f2, value, top = plots.surface_arrays(result.bispectrum.selectExpr("f1", "f2", "l_abs AS value"))
    assert len(f1) == len(f2) == result.n_triads and top == pytest.approx(1.05 * value.max())
    try:
        import matplotlib  # noqa: F401
    except ImportError:
        with pytest.raises(ImportError, match="matplotlib"):
            plots.plot_bispectrum(result)


def test_cascade_of_a_grid(spark):
    """Travelling waves that are even or odd across the grid: a harmonic's mode has its wave's length and symmetry."""
    from triadic.catalog import worked

    t, y, x = np.arange(256)[:, None, None], np.linspace(-1, 1, 5)[None, :, None], np.arange(16)[None, None, :]
    wave = lambda n, shape: shape * np.cos(2 * np.pi * n * (x / 16 - t / 32))
    q = (wave(1, y) + 0.5 * wave(2, 1 + 0 * y) + 0.01 * np.random.default_rng(6).standard_normal((256, 5, 16)))[..., None]
    field = arrays.from_array(spark, q, 2, 1)
    result = fit(field, FitConfig(n_dft=32, time_step=1.0, max_freq_idx=4, n_space_dims=2, regions=(1,)), xshape=(5, 16))
    table = worked.cascade(result, 1, [(1, 1), (2, 0)])
    rows = {(r.k, r.l): r for r in worked.cascade_modes(result, table, field, 0.5).collect()}
    assert set(rows) == {(1, 1), (2, 0)} and rows[(1, 1)].harmonic == 2
    assert rows[(1, 1)].fraction == pytest.approx(1, abs=1e-2) and rows[(1, 1)].wavelength == pytest.approx(4.0, rel=0.05)
    top = result.top_triads(1).first()
    assert (top.k, top.l) == (1, 1) and rows[(1, 1)].l_abs == pytest.approx(top.value)
