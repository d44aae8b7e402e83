"""Figures from result tables. Drawing needs matplotlib, which is optional; the arrays to draw do not."""

from __future__ import annotations

import numpy as np

from triadic.operators import estimators
from triadic.plans.decompose import FitResult


def bispectrum_arrays(result: FitResult, log: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The frequency axis and ln |L| (or |L|) on its grid, first frequency along rows; masked where there is no triad or no value."""
    grid = np.full((result.n_freq, result.n_freq), np.nan)
    low = int(result.f_idx[0])
    for r in result.bispectrum.select("k", "l", "l_abs").toLocalIterator():  # a row a triad, n_freq ** 2 at most
        grid[r.k - low, r.l - low] = r.l_abs
    with np.errstate(divide="ignore"):
        return result.freq, np.ma.masked_invalid(np.log(grid) if log else grid)


def levels_between(field: np.ndarray, levels: int = 100, vmin: float | None = None, vmax: float | None = None):
    """levels itself, or its edges between the limits if one is given."""
    if vmin is None and vmax is None:
        return levels
    return np.linspace(field.min() if vmin is None else vmin, field.max() if vmax is None else vmax, levels + 1)


def panel_arrays(result: FitResult, k: int, l: int, shape: tuple[int, int], variables=(0,)) -> dict[tuple[int, int], np.ndarray]:  # noqa: E741
    """(row, variable) -> field on the (ny, nx) grid: rows 0 sum, 1 product, 2 and 3 constituents, -1 interaction map."""
    if len(shape) != 2 or shape[0] * shape[1] != result.nx:
        raise ValueError(f"a grid of {result.nx} points is expected, not {shape}")
    out: dict[tuple[int, int], np.ndarray] = {}
    for r in estimators.mode_panels(result.get_modes_at_freqs(k, l), shape[1], list(variables)).toLocalIterator():
        out.setdefault((r.row, r["var"]), np.full(shape, np.nan))[r.iy, r.ix] = r.value
    return out


def _pyplot():
    try:
        import matplotlib.pyplot as plt
    except ImportError as e:
        raise ImportError("drawing needs matplotlib; the tables and arrays are there without it") from e
    return plt


def plot_bispectrum(result: FitResult, log: bool = True, levels: int = 100, vmin=None, vmax=None, mark=(), path: str | None = None, title: str | None = None):
    """Filled contours over (f1, f2), cut to the computed triads; mark: pairs of frequencies to ring."""
    plt = _pyplot()
    freq, field = bispectrum_arrays(result, log)
    f1, f2 = np.meshgrid(freq, freq, indexing="ij")
    fig, ax = plt.subplots()
    drawn = ax.contourf(f1, f2, field, levels=levels_between(field, levels, vmin, vmax), extend="both")
    seen = ~np.ma.getmaskarray(field)
    if seen.any():
        ax.set_xlim(f1[seen].min(), f1[seen].max())
        ax.set_ylim(f2[seen].min(), f2[seen].max())
    for a, b in mark:
        ax.plot(a, b, "o", fillstyle="none", color="k")
    ax.set(xlabel="$f_1$", ylabel="$f_2$", aspect="equal", title=title or "")
    fig.colorbar(drawn, ax=ax, label=r"$\log|\lambda_1|$" if log else r"$|\lambda_1|$")
    if path:
        fig.savefig(path, dpi=200, bbox_inches="tight")
    return fig


def plot_modes(result: FitResult, k: int, l: int, x: np.ndarray, y: np.ndarray, variables=(0,), path: str | None = None):  # noqa: E741
    """Panels of a triad's modes (real parts, levels symmetric about 0) and of its interaction map."""
    plt = _pyplot()
    panels = panel_arrays(result, k, l, np.shape(x), variables)
    rows = [r for r in (2, 3, 0, 1, -1) if (r, variables[0]) in panels]
    fig, axes = plt.subplots(len(rows), len(variables), squeeze=False)
    for i, r in enumerate(rows):
        for j, v in enumerate(variables):
            field = panels[(r, v)]
            top = np.abs(field).max() or 1.0
            axes[i][j].contourf(x, y, field, levels=top * (np.linspace(0, 1, 257) if r < 0 else 0.5 * np.linspace(-1, 1, 257)), extend="both")
            axes[i][j].set(aspect="equal")
    if path:
        fig.savefig(path, dpi=200, bbox_inches="tight")
    return fig


def plot_cascade(result: FitResult, table, f0: float, reach: float, path: str | None = None):
    """ln |L| on cells of the frequency plane up to `reach`, the triads of a cascade's table ringed and named, and the line f1 + f2 = f0."""
    plt = _pyplot()
    freq, field = bispectrum_arrays(result)
    half = (freq[1] - freq[0]) / 2
    edges = np.r_[freq - half, freq[-1] + half]
    fig, ax = plt.subplots()
    drawn = ax.pcolormesh(edges, edges, field.T)
    ax.plot([0, reach], [f0, f0 - reach], "k--", linewidth=0.8)
    for r in table.toLocalIterator():
        ax.plot(r.f1, r.f2, "o", fillstyle="none", color="k")
        ax.annotate(f"({r.k},{r.l})", (r.f1, r.f2), textcoords="offset points", xytext=(5, 5))
    ax.set(xlabel="$f_1$", ylabel="$f_2$", aspect="equal", xlim=(0, reach), ylim=(-reach, reach))
    fig.colorbar(drawn, ax=ax, label=r"$\log|\lambda_1|$")
    if path:
        fig.savefig(path, dpi=200, bbox_inches="tight")
    return fig


def surface_arrays(table) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """f1, f2 and value of a table of triads, and the top of the vertical axis: colours go by it, so that a flat surface looks flat."""
    rows = np.array([(r.f1, r.f2, r.value) for r in table.toLocalIterator()], float).reshape(-1, 3)
    return rows[:, 0], rows[:, 1], rows[:, 2], 1.05 * float(np.nanmax(rows[:, 2], initial=0.0)) or 1.0


def plot_surface(table, amplitudes=None, time_step: float = 1.0, n_dft: int | None = None, path: str | None = None):
    """A surface over the frequency plane, beside an amplitude spectrum (a table of f, amplitude) if there is one."""
    plt = _pyplot()
    fig = plt.figure()
    columns = 1 if amplitudes is None else 2
    if amplitudes is not None:
        rows = sorted((r.f, r.amplitude) for r in amplitudes.toLocalIterator())
        fig.add_subplot(1, columns, 1).plot([f / time_step / n_dft for f, _ in rows], [a for _, a in rows], "k")
    f1, f2, value, top = surface_arrays(table)
    ax = fig.add_subplot(1, columns, columns, projection="3d")
    ax.plot_trisurf(f1, f2, value, vmin=0, vmax=top)
    ax.set(xlabel="$f_1$", ylabel="$f_2$", zlim=(0, top))
    if path:
        fig.savefig(path, dpi=150)
    return fig
