"""Parameters of a fit, checked before anything is read."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from numbers import Integral

from triadic.functions.spectral import window_name

REGIONS = 8
PRECISIONS = {"double": ("double", "double"), "single": ("float", "float"), "float": ("float", "float")}
GB = 2.0**-30


def precision(name: str) -> str:
    """Spark's type for the named precision."""
    if name not in PRECISIONS:
        raise ValueError(f"dtype must be one of {', '.join(PRECISIONS)}")
    return PRECISIONS[name][0]


def modes_to_keep(top) -> None:
    """Accepts None, a count of 1 or more, or a share in (0, 1]."""
    if top is None:
        return
    if isinstance(top, bool) or not isinstance(top, (int, float, Integral)):
        raise TypeError("save_modes_top must be a count or a share")
    if isinstance(top, Integral):
        if top < 1:
            raise ValueError("save_modes_top as a count must be 1 or more")
    elif not 0 < top <= 1:
        raise ValueError("save_modes_top as a share must be in (0, 1]")


@dataclass(frozen=True)
class FitConfig:
    n_dft: int
    time_step: float
    n_space_dims: int = 1
    n_variables: int = 1
    overlap: float = 50.0
    n_overlap: int | None = None
    window: str = "hamming"
    regions: tuple[int, ...] = (1, 2)
    max_freq_idx: int | None = None
    tol: float = 1e-6
    n_it_max: int = 500
    dtype: str = "double"
    save_dtype: str | None = None
    savedir: str = "triad_results"
    save_modes: bool = True
    store_modes: bool = False
    save_modes_top: int | float | None = None
    max_modes_gb: float | None = 8.0
    constituent_modes: bool = False
    compute_energy_transfer: bool = True
    #: Values of a chunk of points that one task holds; it fixes the order of sums whatever the partitions.
    chunk_values: int = 1 << 21
    #: For products of different variables: states, and for each state its pairs (q, r, q, r, ...); None: each variable with itself.
    state_idx: tuple[int, ...] | None = None
    qr_idx: tuple[tuple[int, ...], ...] | None = None
    step: int = field(init=False, default=0)

    @classmethod
    def from_params(cls, params: dict) -> FitConfig:
        """From a dictionary; keys without a meaning are left out, and the four required ones must be there."""
        missing = [k for k in ("n_dft", "time_step", "n_space_dims", "n_variables") if k not in params]
        if missing:
            raise KeyError(f"missing parameters: {', '.join(missing)}")
        known = {k: v for k, v in params.items() if k in cls.__dataclass_fields__ and k != "step"}
        return cls(**known)

    def __post_init__(self):
        put = lambda name, value: object.__setattr__(self, name, value)
        if isinstance(self.n_dft, bool) or not isinstance(self.n_dft, Integral):
            raise TypeError("n_dft must be an integer")
        if self.n_dft < 4:
            raise ValueError("n_dft must be 4 or more")
        put("window", window_name(self.window))
        regions = (self.regions,) if isinstance(self.regions, Integral) else tuple(self.regions)
        if not regions or any(isinstance(r, bool) or not isinstance(r, Integral) or not 1 <= r <= REGIONS for r in regions):
            raise ValueError(f"regions must be numbers from 1 to {REGIONS}")
        put("regions", tuple(sorted(set(regions))))
        if self.max_freq_idx is not None and not 0 <= self.max_freq_idx <= self.n_dft // 2:
            raise ValueError("max_freq_idx must be from 0 to the Nyquist index")
        precision(self.dtype)
        put("save_dtype", self.save_dtype or self.dtype)
        precision(self.save_dtype)
        modes_to_keep(self.save_modes_top)
        n_overlap = math.floor(self.n_dft * self.overlap / 100) if self.n_overlap is None else self.n_overlap
        if not 0 <= n_overlap <= self.n_dft - 1:
            raise ValueError("the overlap must be from 0 to n_dft - 1 samples")
        put("n_overlap", int(n_overlap))
        put("step", self.n_dft - self.n_overlap)
        if (self.state_idx is None) != (self.qr_idx is None):
            raise ValueError("state_idx and qr_idx belong together")
        if self.state_idx is not None:
            put("state_idx", tuple(self.state_idx))
            put("qr_idx", tuple(tuple(row) for row in self.qr_idx))
            if len(self.state_idx) != len(self.qr_idx):
                raise ValueError("qr_idx needs a row for each state")
            if any(not row or len(row) % 2 for row in self.qr_idx):
                raise ValueError("rows of qr_idx hold pairs of variables")
            if any(not 0 <= v < self.n_variables for row in (self.state_idx, *self.qr_idx) for v in row):
                raise ValueError("a variable index is out of range")
            if self.constituent_modes:
                raise ValueError("constituent modes are those of a variable with itself")

    @property
    def terms(self) -> list[tuple[int, int, int, int, int]]:
        """(state, variable of the sum, term, q, r): the quadratic terms."""
        if self.state_idx is None:
            return [(v, v, 0, v, v) for v in range(self.n_variables)]
        return [(j, s, t // 2, row[t], row[t + 1]) for j, (s, row) in enumerate(zip(self.state_idx, self.qr_idx)) for t in range(0, len(row), 2)]

    @property
    def n_states(self) -> int:
        return self.n_variables if self.state_idx is None else len(self.state_idx)

    def blocks(self, nt: int) -> int:
        n = (nt - self.n_overlap) // self.step
        if n < 2:
            raise ValueError(f"{nt} samples give {max(n, 0)} blocks of {self.n_dft}; at least 2 are needed")
        return n

    def folder(self, nt: int) -> str:
        return f"nfft{self.n_dft}_novlp{self.n_overlap}_nblks{self.blocks(nt)}"

    def points(self, nt: int, nv: int) -> int:
        """Points of a chunk: one at least."""
        return max(1, self.chunk_values // (nt * nv))

    def modes_gb(self, n_triads: int, nx: int, dtype: str | None = None) -> float:
        """GB of the modes of so many triads."""
        comps = 4 if self.constituent_modes else 2
        return n_triads * comps * nx * self.n_states * (16 if (dtype or self.dtype) == "double" else 8) * GB

    def check_size(self, n_triads: int, nx: int, saved: int = 0) -> float:
        """GB of the modes that are kept in memory (all, with store_modes) or saved (of so many triads), whichever are more; refused above max_modes_gb."""
        size = max(self.modes_gb(n_triads, nx) if self.store_modes else 0.0, self.modes_gb(saved, nx, self.save_dtype))
        if self.max_modes_gb is not None and size > self.max_modes_gb:
            raise ValueError(f"the modes to keep take {size:.1f} GB, more than max_modes_gb = {self.max_modes_gb}; None lifts the limit")
        return size
