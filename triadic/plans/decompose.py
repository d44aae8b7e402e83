"""Mode decomposition of a field by frequency triads, at scale.

The field is cut into chunks of points. One map packs each input partition's rows into dense arrays by chunk, which
are what the one shuffle of the field moves (8 bytes a value where rows come as whole slabs). A task then holds one
chunk's time series, takes its spectra once, and works through triads in batches of bounded size: for each it adds
up over the chunk's points what the rest of the fit needs, the weighted bispectral matrix B, the unweighted one if there are
weights, and one triangle each of the legs' Gram matrices, and gives the batch away before the next. A second shuffle
by triad brings the chunks' small matrices together, in chunk order, which makes results independent of the
number of partitions. Where a field has fewer chunks than there are cores, a chunk goes to several tasks that take a slice of
the triads each. The task that adds matrices up also solves for the numerical radius. Energy transfer and
mode norms are quadratic forms of the coefficients in those matrices, so spectra are never shuffled; modes of chosen
triads are made from a second pass over the chunks, with the coefficients as rows beside them.

What a task holds: a chunk's series and half spectrum (chunk_values numbers, 8 bytes each, and about four times that),
and a batch of triads (BATCH_BYTES). A point's whole series must fit into a task, as the matrices of a triad need all
blocks of a point. Fields with many more blocks than series are solved without matrices of blocks (triadic.plans.tall).
"""

from __future__ import annotations

import logging
import time
import warnings
from collections.abc import Iterator
from dataclasses import asdict
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triadic.operators import spectra
from triadic.operators.radius import numerical_radii
from triadic.operators.triads import dense_grid, enumerate_triads, find_triad
from triadic.plans.config import GB, FitConfig, modes_to_keep, precision

LOG = logging.getLogger("triadic")
_PACKED = "chunk int, t binary, p binary, v binary, x binary"
_PART = "chunk int, triad_idx long, b binary, u binary, g binary, thin binary, w binary"
_SOLVED = "triad_idx long, k int, l int, kl int, f1 double, f2 double, f3 double, region int, l_re double, l_im double, l_abs double, t double, a_re array<double>, a_im array<double>, norms array<double>"
_MODES = "triad_idx long, comp int, p long, s int, re double, im double"
#: Bytes of a batch of triads' legs; values packed together; triads whose modes a task makes.
BATCH_BYTES, PACK_VALUES, MODE_SLICE = 16 << 20, 1 << 19, 4096
#: Up to this many blocks the legs of a triad are multiplied in one product.
FEW_BLOCKS = 16


def taper(config: FitConfig) -> np.ndarray:
    x = 2 * np.pi * np.arange(config.n_dft) / (config.n_dft - 1)
    return 0.54 - 0.46 * np.cos(x) if config.window == "hamming" else 0.5 * (1 - np.cos(x))


def _pack(points: int):
    """Rows (t, p, v, value) -> pieces: the values of a chunk that came together, with their t, p and v; these are left to their distinct values where the piece is dense."""

    def pieces(t, p, v, x):
        chunk = p // points
        order = np.lexsort((v, p, t, chunk))
        t, p, v, x, chunk = (a[order] for a in (t, p, v, x, chunk))
        edges = np.r_[0, np.flatnonzero(np.diff(chunk)) + 1, len(chunk)]
        for lo, hi in zip(edges[:-1], edges[1:]):
            own = [a[lo:hi] for a in (t, p, v)]
            axes = [np.unique(a) for a in own]
            nt, np_, nv = map(len, axes)
            if hi - lo == nt * np_ * nv and (own[0] == np.repeat(axes[0], np_ * nv)).all() and (own[1] == np.tile(np.repeat(axes[1], nv), nt)).all() and (own[2] == np.tile(axes[2], nt * np_)).all():
                own = axes
            yield int(chunk[lo]), *(a.astype(np.int64).tobytes() for a in own), x[lo:hi].tobytes()

    def run(batches):
        def flush():
            rows = list(pieces(*(np.concatenate([h[k] for h in held]) for k in range(4))))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[k] for r in rows], pa.binary()) for k in range(1, 5))], ["chunk", "t", "p", "v", "x"])

        held, n = [], 0
        for batch in batches:
            held.append([batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)])
            n += batch.num_rows
            if n >= PACK_VALUES:
                yield flush()
                held, n = [], 0
        if n:
            yield flush()

    return run


def packed_chunks(field: DataFrame, config: FitConfig, nt: int, nv: int) -> DataFrame:
    rows = field.select(F.col("t").cast("long").alias("t"), F.col("p").cast("long").alias("p"), F.col("v").cast("int").alias("v"), F.col("value").cast(precision(config.dtype)).cast("double").alias("x"))
    return rows.mapInArrow(_pack(config.points(nt, nv)), _PACKED)


def dense_chunk(pieces, nt: int, nv: int) -> tuple[np.ndarray, np.ndarray]:
    """Points of a chunk and their series (nt, points, nv), from its pieces (t, p, v, x)."""
    arrays = [(*(np.frombuffer(a, np.int64) for a in piece[:3]), np.frombuffer(piece[3])) for piece in pieces]
    points = np.unique(np.concatenate([a[1] for a in arrays]))
    out = np.full((nt, len(points), nv), np.nan)
    seen = 0
    for t, p, v, x in arrays:
        at = np.searchsorted(points, p)
        if len(x) == len(t) * len(p) * len(v) and not len(t) == len(x) > 1:
            out[np.ix_(t, at, v)] = x.reshape(len(t), len(p), len(v))
        else:
            out[t, at, v] = x
        seen += len(x)
    if seen != out.size:
        raise ValueError("the field is not dense")
    if not np.isfinite(out).all():
        raise ValueError("the field holds values that are missing or not finite")
    return points, out


class HalfSpectrum:
    """Spectra of tapered blocks at frequency indices 0 to n_dft / 2; those below 0 are conjugates, as the input is real."""

    def __init__(self, series: np.ndarray, config: FitConfig, freqs: np.ndarray):
        n_blocks, w = config.blocks(len(series)), taper(config)
        wanted = np.unique(np.abs(freqs))
        self.place = np.full(config.n_dft // 2 + 1, -1)
        self.place[wanted] = np.arange(len(wanted))
        series = series - series.mean(axis=0)
        self.half = np.empty((len(wanted), *series.shape[1:], n_blocks), complex if config.dtype == "double" else np.complex64)
        for b in range(n_blocks):
            block = series[b * config.step : b * config.step + config.n_dft] * w[:, None, None]
            self.half[..., b] = np.fft.rfft(block, axis=0)[wanted] / (w.mean() * config.n_dft)

    def at(self, f: np.ndarray) -> np.ndarray:
        """(frequencies, points, nv, blocks)."""
        out = self.half[self.place[np.abs(f)]].astype(complex)
        np.conj(out, out=out, where=(f < 0)[:, None, None, None])
        return out


def legs(q: HalfSpectrum, config: FitConfig, k: np.ndarray, l: np.ndarray, constituents: bool) -> list[np.ndarray]:  # noqa: E741
    """Sum, product and, if asked for, the two constituent legs of some triads: (triads, points * states, blocks)."""
    one, two, total = q.at(k), q.at(l), q.at(k + l)
    if config.state_idx is None:
        found = [total, one * two] + ([one, two] if constituents else [])
    else:
        total = total[:, :, list(config.state_idx)]
        product = np.zeros_like(total)
        for state, _, _, a, b in config.terms:
            product[:, :, state] += one[:, :, a] * two[:, :, b]
        found = [total, product]
    return [x.reshape(len(k), -1, x.shape[-1]) for x in found]


def matrices(own: list[np.ndarray], flat: np.ndarray | None, transfer: bool) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """A chunk's share of B, of B without weights (None where it is the same or not asked for), and of the legs' Gram matrices, for some triads. flat: weights of the rows, None for 1."""
    m, _, n = own[0].shape
    weighed = lambda x: x if flat is None else flat * x
    turned = lambda x: np.conj(np.swapaxes(x, 1, 2))
    if n <= FEW_BLOCKS:
        side = np.concatenate(own, axis=2)
        every = (turned(side) @ weighed(side)).reshape(m, len(own), n, len(own), n)
        b, g = every[:, 0, :, 1] / n, np.stack([every[:, c, :, c] for c in range(len(own))], axis=1)
    else:
        b, g = turned(own[0]) @ weighed(own[1]) / n, np.stack([turned(x) @ weighed(x) for x in own], axis=1)
    return b, turned(own[0]) @ own[1] / n if transfer and flat is not None else None, g


def _batches(config: FitConfig, rows: int, n: int, triads: np.ndarray, constituents: bool):
    """Triads in batches whose legs take about BATCH_BYTES."""
    each = rows * n * 16 * (7 if constituents else 5)
    size = max(1, BATCH_BYTES // max(each, n * n * 16 * 6))
    for a in range(0, len(triads), size):
        yield triads[a : a + size]


def _partials(config: FitConfig, table: dict[str, np.ndarray], nt: int, nv: int, slices: int, weighted: bool):
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = key[0].as_py()
        chunk, own_slice = divmod(at, slices)
        points, series, w = _held(batches, config, nt, nv, weighted)
        mine = np.flatnonzero(table["triad_idx"] % slices == own_slice)
        if not len(mine):
            return
        q = HalfSpectrum(series, config, np.concatenate([table[c][mine] for c in ("k", "l", "kl")]))
        del series
        n, flat = config.blocks(nt), w.reshape(-1, 1)
        upper = np.triu_indices(n)
        thin = len(flat) < n  # then the legs themselves are smaller than matrices of blocks
        for some in _batches(config, len(flat), n, mine, config.constituent_modes):
            own = legs(q, config, table["k"][some], table["l"][some], config.constituent_modes)
            binary = lambda x: pa.array([None] * len(some) if x is None else [a.tobytes() for a in x], pa.binary())  # noqa: B023, E731
            if thin:
                made = [None, None, None, np.stack(own, axis=1), np.broadcast_to(flat, (len(some), *flat.shape))]
            else:
                b, u, g = matrices(own, flat if weighted else None, config.compute_energy_transfer)
                made = [b, u, g[:, :, upper[0], upper[1]], None, None]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), chunk, np.int32)), pa.array(some, pa.int64()), *map(binary, made)], ["chunk", "triad_idx", "b", "u", "g", "thin", "w"])

    return run


def _held(batches, config: FitConfig, nt: int, nv: int, weighted: bool):
    """A chunk's points, series and weights (points, states); a piece of weights has no t."""
    pieces, weights = [], []
    for batch in batches:
        for t, p, v, x in zip(*(batch.column(c).to_pylist() for c in ("t", "p", "v", "x"))):
            (weights if t is None else pieces).append((t, p, v, x))
    points, series = dense_chunk(pieces, nt, nv)
    if not weighted:
        return points, series, np.ones((len(points), config.n_states))
    w = np.full((len(points), config.n_states), np.nan)
    for _, p, v, x in weights:
        at = np.searchsorted(points, np.frombuffer(p, np.int64))
        if v is None:
            w[at] = np.frombuffer(x)[:, None]
        else:
            w[at, np.frombuffer(v, np.int64)] = np.frombuffer(x)
    if np.isnan(w).any():
        raise ValueError("a point of the field has no weight")
    return points, series, w


def _pack_weights(points: int, by_variable: bool):
    def run(batches):
        for batch in batches:
            p, w = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("p", "w"))
            v = batch.column("v").to_numpy(zero_copy_only=False) if by_variable else None
            chunk = p // points
            for c in np.unique(chunk):
                own = chunk == c
                row = [int(c), None, p[own].astype(np.int64).tobytes(), None if v is None else v[own].astype(np.int64).tobytes(), w[own].astype(float).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int32()), *(pa.array([x], pa.binary()) for x in row[1:])], ["chunk", "t", "p", "v", "x"])

    return run


def _solve(config: FitConfig, table: dict[str, np.ndarray], n_blocks: int):
    """Chunks' shares, sorted by triad and chunk -> solved triads; a triad's shares are added up as they come, and some triads are solved together."""
    n, comps = n_blocks, 4 if config.constituent_modes else 2
    together = max(1, (1 << 22) // (16 * n * n * (comps + 2)))
    upper = np.triu_indices(n)

    def added(batches):
        """(triad, B, unweighted B, Gram matrices), one triad after the other."""
        now, b, u, g = None, None, None, None
        for batch in batches:
            for i, *own in zip(*(batch.column(c).to_pylist() for c in ("triad_idx", "b", "u", "g", "thin", "w"))):
                if i != now:
                    if now is not None:
                        yield now, b, u, g
                    now, b, u, g = i, np.zeros((n, n), complex), np.zeros((n, n), complex), np.zeros((comps, n, n), complex)
                if own[3] is None:
                    more = np.frombuffer(own[0], complex).reshape(n, n)
                    other = more if own[1] is None else np.frombuffer(own[1], complex).reshape(n, n)
                    half = np.frombuffer(own[2], complex).reshape(comps, -1)
                    gram = np.zeros((comps, n, n), complex)
                    gram[:, upper[1], upper[0]] = np.conj(half)
                    gram[:, upper[0], upper[1]] = half
                else:
                    side = np.frombuffer(own[3], complex).reshape(1, comps, -1, n)
                    more, other, gram = (None if x is None else x[0] for x in matrices(list(np.swapaxes(side, 0, 1)), np.frombuffer(own[4]).reshape(-1, 1), True))
                b += more
                u += other
                g += gram
        if now is not None:
            yield now, b, u, g

    def solved(some):
        values, vectors = numerical_radii(np.stack([x[1] for x in some]), config.tol, config.n_it_max)
        rows = []
        for (i, _, u, g), value, a in zip(some, values, vectors):
            transfer = float((a.conj() @ u @ a).real) if config.compute_energy_transfer else float("nan")
            row = {"triad_idx": i, **{c: table[c][i].item() for c in ("k", "l", "kl", "f1", "f2", "f3", "region")}}
            row |= {"l_re": value.real.item(), "l_im": value.imag.item(), "l_abs": abs(value).item(), "t": transfer, "a_re": a.real.tolist(), "a_im": a.imag.tolist()}
            rows.append(row | {"norms": [float(np.sqrt(max((a.conj() @ x @ a).real, 0.0))) for x in g]})
        return pa.RecordBatch.from_pylist(rows, schema=shape)

    def run(batches):
        some = []
        for x in added(batches):
            some.append(x)
            if len(some) == together:
                yield solved(some)
                some = []
        if some:
            yield solved(some)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    shape = to_arrow_schema(StructType.fromDDL(_SOLVED))
    return run


def _modes(config: FitConfig, nt: int, nv: int, slices: int):
    """A chunk's pieces, and rows (triad_idx, k, l, a_re, a_im, norms) of a slice of triads -> the rows of their modes, some triads at a time."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, pieces = [], []
        for batch in batches:
            asked = batch.column("triad_idx").is_valid()
            found.append(batch.filter(asked))
            pieces.append(batch.filter(pa.compute.invert(asked)))
        chosen = pa.Table.from_batches(found)
        if not chosen.num_rows:
            return
        chosen = chosen.sort_by("triad_idx")
        points, series, _ = _held(pieces, config, nt, nv, False)
        number = lambda c: chosen[c].to_numpy()
        flat = lambda c: chosen[c].combine_chunks().flatten().to_numpy().reshape(chosen.num_rows, -1)
        ids, k, l = number("triad_idx"), number("k"), number("l")  # noqa: E741
        a, norms = flat("a_re") + 1j * flat("a_im"), flat("norms")
        q = HalfSpectrum(series, config, np.concatenate([k, l, k + l]))
        p, s = np.repeat(points, config.n_states), np.tile(np.arange(config.n_states, dtype=np.int32), len(points))
        for some in _batches(config, len(p), a.shape[1], np.arange(len(ids)), config.constituent_modes):
            own = legs(q, config, k[some], l[some], config.constituent_modes)
            for comp, leg in enumerate(own):
                size = norms[some, comp]
                if not (size > 0).all():
                    i = some[int(np.argmin(size > 0))]
                    raise ValueError(f"mode {comp} of triad ({k[i]}, {l[i]}) is zero and cannot be normalised")
                psi = (np.einsum("mrn,mn->mr", leg, a[some]) / size[:, None]).ravel()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(ids[some], len(p))), pa.array(np.full(len(psi), comp, np.int32)), pa.array(np.tile(p, len(some))), pa.array(np.tile(s, len(some))), pa.array(psi.real), pa.array(psi.imag)],
                    ["triad_idx", "comp", "p", "s", "re", "im"],
                )

    return run


class FitResult:
    """A fit: its spectrum as a table, and modes on request."""

    def __init__(self, config: FitConfig, shape: tuple[int, int, int], bispectrum: DataFrame, field: DataFrame | None = None, path: str | None = None, weights: DataFrame | None = None, weights_name: str = "uniform", xshape: tuple[int, ...] | None = None, inner: tuple[DataFrame, ...] = ()):
        self.config, self.bispectrum, self.field, self.path = config, bispectrum, field, path
        self.weights, self.weights_name, self.inner = weights, weights_name, inner
        self.nt, self.nx, self.nv = shape
        self.xshape = tuple(xshape or (self.nx,))
        if int(np.prod(self.xshape)) != self.nx:
            raise ValueError(f"a grid of {self.xshape} has not {self.nx} points")
        self.xdim, self.dt = len(self.xshape), config.time_step
        self.shape = (self.nt, *self.xshape, self.nv)
        self.n_blocks, self.n_dft, self.n_overlap = config.blocks(self.nt), config.n_dft, config.n_overlap
        self.table = enumerate_triads(config.n_dft, config.time_step, config.regions, config.max_freq_idx)
        self.f_idx = np.arange(-(config.n_dft // 2), (config.n_dft - 1) // 2 + 1)
        self.freq = self.f_idx / config.time_step / config.n_dft
        self.n_triads, self.n_freq = len(self.table["k"]), len(self.f_idx)

    @property
    def savedir_sim(self) -> str:
        """The folder of the results, where they are or would be saved."""
        return self.path or f"{self.config.savedir.rstrip('/')}/{self.config.folder(self.nt)}"

    @property
    def triads(self) -> DataFrame:
        return self.bispectrum.select("triad_idx", "k", "l", "kl", "f1", "f2", "f3", "region")

    @property
    def L(self) -> DataFrame:
        """(k, l, re, im) on the full grid, NaN where no triad was computed."""
        return self._on_grid(l_re="re", l_im="im")

    @property
    def T(self) -> DataFrame:
        """(k, l, value) of the energy transfer on the full grid, NaN where no triad was computed."""
        return self._on_grid(t="value")

    @property
    def coeffs(self) -> DataFrame:
        """(triad_idx, block, re, im): the maximisers, from which modes are made."""
        pairs = self.bispectrum.select("triad_idx", F.posexplode(F.arrays_zip("a_re", "a_im")).alias("block", "a"))
        return pairs.select("triad_idx", "block", F.col("a.a_re").alias("re"), F.col("a.a_im").alias("im"))

    def _on_grid(self, **columns: str) -> DataFrame:
        grid = dense_grid(self.bispectrum.sparkSession, self.n_dft, self.bispectrum.select("k", "l", "triad_idx"))
        known = self.bispectrum.select("k", "l", *[F.col(c).alias(name) for c, name in columns.items()])
        return grid.join(known, ["k", "l"], "left").select("k", "l", *[F.coalesce(name, F.lit(float("nan"))).alias(name) for name in columns.values()])

    def find_triad(self, k: int, l: int) -> int:  # noqa: E741
        return find_triad(self.table, self.n_dft, k, l)

    def dense(self, what: str = "l_abs") -> DataFrame:
        """(k, l, value) on the full grid, NaN where no triad was computed."""
        return self._on_grid(**{what: "value"})

    def report(self) -> dict[str, object]:
        """Sizes in GB and the parameters of the fit."""
        c = self.config
        each = 16 if c.dtype == "double" else 8
        needed = len(np.unique(np.r_[self.table["k"], self.table["l"], self.table["kl"]]))
        return {
            "data_gb": self.nt * self.nx * self.nv * each / 2 * GB,
            "spectra_gb": needed * self.nx * self.nv * self.n_blocks * each * GB,
            "modes_gb": c.modes_gb(self.n_triads, self.nx),
            "shape": self.shape,
            "n_blocks": self.n_blocks,
            "n_freq": self.n_freq,
            "n_freq_needed": needed,
            "n_triads": self.n_triads,
            "nyquist_idx": c.n_dft // 2,
            "weights": self.weights_name,
            "results_folder": self.savedir_sim,
            **{name: getattr(c, name) for name in ("n_dft", "n_overlap", "window", "time_step", "regions", "max_freq_idx", "dtype", "save_dtype", "constituent_modes", "save_modes", "save_modes_top", "tol", "n_it_max")},
        }

    @cached_property
    def modes(self) -> DataFrame:
        """All modes, kept by Spark once they are made; only with store_modes."""
        if not self.config.store_modes:
            raise ValueError("modes are not kept; set store_modes, or ask for some with modes_of or get_modes_at_triad")
        return self.modes_of().persist()

    def forget(self) -> None:
        """Gives back what Spark keeps of this fit."""
        for kept in (self.bispectrum, *self.inner):
            kept.unpersist()
        if "modes" in self.__dict__:
            self.__dict__.pop("modes").unpersist()

    def modes_of(self, triad_idx=None) -> DataFrame:
        """(triad_idx, comp, p, s, re, im): comp 0 sum, 1 product, 2 and 3 the constituents. triad_idx: a number, numbers, a table of them, or None for all."""
        if self.field is None:
            raise FileNotFoundError("no field to rebuild modes from; reconstruct_modes takes one")
        return self.reconstruct_modes(self.field, triad_idx)

    def reconstruct_modes(self, field: DataFrame, triad_idx=None) -> DataFrame:
        coeffs, n = self.bispectrum.select("triad_idx", "k", "l", "a_re", "a_im", "norms"), self.n_triads
        if isinstance(triad_idx, DataFrame):
            coeffs = coeffs.join(triad_idx.select("triad_idx").distinct(), "triad_idx", "left_semi")
        elif triad_idx is not None:
            wanted = sorted({int(i) for i in ([triad_idx] if isinstance(triad_idx, (int, np.integer)) else triad_idx)})
            if any(not 0 <= i < n for i in wanted):
                raise IndexError(f"triads are numbered 0 to {n - 1}")
            coeffs, n = coeffs.join(coeffs.sparkSession.createDataFrame([(i,) for i in wanted], "triad_idx long"), "triad_idx", "left_semi"), len(wanted)
        if spectra.check_field(field) != (self.nt, self.nx, self.nv):
            raise ValueError("the field has not the shape of the one that was fitted")
        config = self.config
        n_chunks = -(-self.nx // config.points(self.nt, self.nv))
        cores = coeffs.sparkSession.sparkContext.defaultParallelism
        slices = max(-(-n // MODE_SLICE), min(-(-cores // n_chunks), -(-n // 16)), 1)
        # Coefficients are rows beside the chunk's pieces: of each triad one for each chunk, in its slice.
        at = F.explode(F.transform(F.sequence(F.lit(0), F.lit(n_chunks - 1)), lambda c: c * slices + F.pmod(F.xxhash64("triad_idx"), F.lit(slices)).cast("int")))
        asked = coeffs.withColumn("at", at)
        pieces = packed_chunks(field, config, self.nt, self.nv).withColumn("at", F.explode(F.transform(F.sequence(F.lit(0), F.lit(slices - 1)), lambda s: F.col("chunk") * slices + s)))
        both = pieces.drop("chunk").unionByName(asked, allowMissingColumns=True)
        parts = n_chunks * slices
        met = both.repartitionById(parts, "at").groupBy("at")
        return met.applyInArrow(_modes(config, self.nt, self.nv, slices), _MODES)

    def top_triads(self, n: int = 10, quantity: str = "L", exclude_zero: bool = True) -> DataFrame:
        return top_triads(self.bispectrum, n, quantity, exclude_zero)

    def get_modes_at_triad(self, triad_idx: int, data: DataFrame | None = None) -> DataFrame:
        """Stored modes if there are, else rebuilt from data."""
        if not 0 <= triad_idx < self.n_triads:
            raise IndexError(f"triads are numbered 0 to {self.n_triads - 1}")
        spark = self.bispectrum.sparkSession
        if self.path is not None and self.config.save_modes:
            try:
                stored = spark.read.parquet(f"{self.path}/modes").where(F.col("triad_idx") == triad_idx)
                if stored.limit(1).count():
                    return stored
            except Exception as e:  # noqa: BLE001
                if "PATH_NOT_FOUND" not in str(e):
                    raise
        data = self.field if data is None else data
        if data is None:
            kept = "only the top modes were saved" if self.config.save_modes_top is not None else "modes were not saved"
            raise FileNotFoundError(f"no modes of triad {triad_idx}: {kept}, and no data was given to rebuild them from")
        return self.reconstruct_modes(data, triad_idx)

    def get_modes_at_freqs(self, k: int, l: int, data: DataFrame | None = None) -> DataFrame:  # noqa: E741
        return self.get_modes_at_triad(self.find_triad(k, l), data)


def resolved_weights(weights, spark, nx: int, nv: int | None, xshape: tuple[int, ...] | None) -> tuple[DataFrame | None, str]:
    """Weights as a table, and their name. A table is taken as it is; a dictionary has an array or a table as weights and a weights_name; anything else is warned about, and weights are 1, as they are for None."""
    if weights is None or isinstance(weights, DataFrame):
        return weights, "uniform" if weights is None else "given"
    if isinstance(weights, dict) and "weights" in weights:
        own, name = weights["weights"], str(weights.get("weights_name", "given"))
        if isinstance(own, DataFrame):
            return own, name
        from triadic.sources.arrays import weights_from_array

        return weights_from_array(spark, np.asarray(own), tuple(xshape or (nx,)), nv), name
    warnings.warn("weights must be a table, or a dictionary with weights and weights_name; uniform weights are used", stacklevel=3)
    return None, "uniform"


def fit(field: DataFrame, config: FitConfig, weights=None, xshape: tuple[int, ...] | None = None, keep: bool = True) -> FitResult:
    """Decomposes a dense field (t, p, v, value). weights: (p, w), or (p, v, w) for a variable with itself; None: all 1. xshape: the grid of the points, if there is one. keep: Spark keeps the solved triads, a row each, once they are made, so that rankings, grids and modes do not solve them again; forget() gives them back."""
    from triadic.plans import tall

    began = time.perf_counter()
    nt, nx, nv = spectra.check_field(field)
    LOG.info("field checked in %.2f s", time.perf_counter() - began)
    if nv != config.n_variables:
        raise ValueError(f"the field has {nv} variables, {config.n_variables} were declared")
    n_blocks = config.blocks(nt)
    table = enumerate_triads(config.n_dft, config.time_step, config.regions, config.max_freq_idx)
    config.check_size(len(table["k"]), nx)
    spark = field.sparkSession
    weights, name = resolved_weights(weights, spark, nx, None if config.state_idx is not None else nv, xshape)
    if weights is not None:
        expected = nx * (nv if "v" in weights.columns else 1)
        if weights.count() != expected:
            raise ValueError(f"weights need {expected} rows, one for each point" + (" and variable" if "v" in weights.columns else ""))
    points = config.points(nt, nv)
    n_chunks = -(-nx // points)
    slices = max(1, min(-(-2 * spark.sparkContext.defaultParallelism // n_chunks), -(-len(table["k"]) // 64)))
    rows = packed_chunks(field, config, nt, nv)
    if weights is not None:
        by_variable = "v" in weights.columns and config.state_idx is None
        own = weights.select(F.col("p").cast("long").alias("p"), *([F.col("v").cast("int").alias("v")] if by_variable else []), F.col("w").cast("double").alias("w"))
        rows = rows.unionByName(own.mapInArrow(_pack_weights(points, by_variable), _PACKED))
    if tall.applies(config, nt, nx):
        solved, inner = tall.solve(rows, config, table, (nt, nx, nv), weights is not None, keep)
        return _reported(FitResult(config, (nt, nx, nv), solved.persist() if keep else solved, field, None, weights, name, xshape, inner))
    at = rows.withColumn("at", F.explode(F.transform(F.sequence(F.lit(0), F.lit(slices - 1)), lambda s: F.col("chunk") * slices + s))).drop("chunk")
    parts = at.repartitionById(n_chunks * slices, "at").groupBy("at").applyInArrow(_partials(config, table, nt, nv, slices, weights is not None), _PART)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))  # fixed: the solver is work for processors, whatever the bytes
    ordered = parts.repartition(n, "triad_idx").sortWithinPartitions("triad_idx", "chunk")
    solved = ordered.mapInArrow(_solve(config, table, n_blocks), _SOLVED)
    return _reported(FitResult(config, (nt, nx, nv), solved.persist() if keep else solved, field, None, weights, name, xshape))


def _reported(result: FitResult) -> FitResult:
    for what, value in result.report().items():
        LOG.info("%s: %s", what, value)
    return result


def top_triads(bispectrum: DataFrame, n: int = 10, quantity: str = "L", exclude_zero: bool = True) -> DataFrame:
    """The strongest triads: triad_idx, k, l, kl, f1, f2, f3, region, value, by |L| or |T|, ties by number."""
    columns = {"l": F.col("l_abs"), "t": F.abs("t")}
    if not isinstance(quantity, str) or quantity.lower() not in columns:
        raise ValueError("quantity must be 'L' or 'T'")
    value = columns[quantity.lower()]
    rows = bispectrum.withColumn("value", value).where(F.col("value").isNotNull() & ~F.isnan("value") & (F.col("value") < F.lit(float("inf"))))
    if exclude_zero:
        rows = rows.where("k <> 0 AND l <> 0")
    out = rows.orderBy(F.col("value").desc(), "triad_idx").limit(n)
    return out.select("triad_idx", F.col("k").cast("long").alias("k"), F.col("l").cast("long").alias("l"), F.col("kl").cast("long").alias("kl"), "f1", "f2", "f3", F.col("region").cast("long").alias("region"), "value")


def selected_for_saving(result_table: DataFrame, top: int | float | None) -> DataFrame:
    """triad_idx of the modes to save, ascending: all, a count, or a share (rounded up) of those off the axes."""
    modes_to_keep(top)
    if top is None:
        return result_table.select("triad_idx").orderBy("triad_idx")
    n = result_table.where("k <> 0 AND l <> 0").count()
    keep = min(n, int(np.ceil(top * n)) if isinstance(top, float) else int(top))
    return top_triads(result_table, max(keep, 0)).select("triad_idx").orderBy("triad_idx")


def settings(config: FitConfig) -> dict:
    return {k: v for k, v in asdict(config).items()}
