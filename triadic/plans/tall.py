"""Fits of fields with many more blocks than series (points times states), as of long records at few points.

With r series, the legs Q and P of a triad are r x n for n blocks, and B = Q* W P / n has rank r at most. A matrix of
n x n is never made. Chunks of points take their spectra over all times, and one shuffle deals these by chunk of blocks.
Such a chunk makes, for each triad, the legs of its blocks, all series together, and gives away the triangle R of their
QR factors; the factors of stacked triangles are those of all blocks, so with (Q* P*) = V (Rq Rp) the form on the span
of V, outside of which B is zero, is C = Rq W Rp* / n, of 2 r x 2 r. Its numerical radius is that of B, its vector c
gives the maximiser a = V c, and transfer and norms come from Q a = Rq* c and P a = Rp* c. As a is the top eigenvector of
(e(-i phi) B + e(i phi) B*) / 2, it is also (Q* y_q + P* y_p) with y_q = e(-i phi) W P a / (2 n |L|) and y_p =
e(i phi) W Q a / (2 n |L|), without an inverse: a second pass over the chunks of blocks makes it from y, a row for each triad.

What a task holds: spectra of a chunk of blocks (CHUNK_NUMBERS complex numbers, more only if 4 r blocks take more), and
a batch of triads. Chunks are cut by size and triangles added in chunk order, so the result's bits do not depend on partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triadic.operators.radius import numerical_radius
from triadic.plans.config import FitConfig
from triadic.plans.decompose import _SOLVED, HalfSpectrum, _batches, _held, legs

#: Up to this many blocks matrices of blocks are small.
MOST_BLOCKS = 256
#: Complex numbers of a chunk of blocks.
CHUNK_NUMBERS = 1 << 21
_PIECE = "at int, p binary, w binary, x binary"
_FACTOR = "chunk int, triad_idx long, r binary, first binary, w binary"
_TRIAD = _SOLVED.split(", a_re")[0] + ", norms array<double>, y binary"
_SHARE = "chunk int, triad_idx long, a binary"


def applies(config: FitConfig, nt: int, nx: int) -> bool:
    return config.blocks(nt) > max(MOST_BLOCKS, 2 * nx * config.n_states)


def blocks_of_chunk(config: FitConfig, nx: int, nv: int, n_freqs: int) -> int:
    return max(4 * nx * config.n_states, CHUNK_NUMBERS // (n_freqs * nx * nv))


def _spectra(config: FitConfig, freqs: np.ndarray, nt: int, nv: int, per: int, weighted: bool):
    """A chunk of points -> its spectra (frequencies, points, nv, blocks) by chunk of blocks."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points, series, w = _held(batches, config, nt, nv, weighted)
        half = HalfSpectrum(series, config, freqs).half
        for at in range(0, half.shape[-1], per):
            row = at // per, points.astype(np.int64).tobytes(), w.tobytes() if weighted else None, np.ascontiguousarray(half[..., at : at + per]).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int32()), *(pa.array([c], pa.binary()) for c in row[1:])], ["at", "p", "w", "x"])

    return run


def _joined(pieces, config: FitConfig, freqs: np.ndarray, nv: int) -> tuple[HalfSpectrum, np.ndarray | None]:
    """Spectra of a chunk of blocks at all points, in order, and the weights of its rows."""
    kind, wanted = complex if config.dtype == "double" else np.complex64, np.unique(np.abs(freqs))
    found = []
    for p, w, x in pieces:
        p = np.frombuffer(p, np.int64)
        found.append((p, None if w is None else np.frombuffer(w).reshape(len(p), -1), np.frombuffer(x, kind).reshape(len(wanted), len(p), nv, -1)))
    found.sort(key=lambda piece: piece[0][0])
    q = HalfSpectrum.__new__(HalfSpectrum)
    q.place = np.full(config.n_dft // 2 + 1, -1)
    q.place[wanted] = np.arange(len(wanted))
    q.half = np.concatenate([x for _, _, x in found], axis=1)
    return q, None if found[0][1] is None else np.concatenate([w for _, w, _ in found]).ravel()


def _factors(config: FitConfig, table: dict[str, np.ndarray], freqs: np.ndarray, nv: int, slices: int):
    """A chunk of blocks -> for each triad the rows of the triangle that the sum and product legs span, and the legs of the very first block."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, own_slice = divmod(key[0].as_py(), slices)
        mine = np.flatnonzero(table["triad_idx"] % slices == own_slice)
        q, w = _joined([x for batch in batches for x in zip(*(batch.column(c).to_pylist() for c in ("p", "w", "x")))], config, freqs, nv)
        rows, n = q.half.shape[1] * config.n_states, q.half.shape[-1]
        for some in _batches(config, rows, n, mine, config.constituent_modes):
            side = np.concatenate(legs(q, config, table["k"][some], table["l"][some], config.constituent_modes), axis=1)
            r = np.linalg.qr(np.conj(np.swapaxes(side, 1, 2)), mode="r")[:, : 2 * rows]
            first = [x.tobytes() for x in side[..., 0]] if chunk == 0 else [None] * len(some)
            columns = [x.tobytes() for x in r], first, [None if w is None else w.tobytes()] * len(some)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), chunk, np.int32)), pa.array(some, pa.int64()), *(pa.array(c, pa.binary()) for c in columns)], ["chunk", "triad_idx", "r", "first", "w"])

    return run


def solved_triad(r: np.ndarray, first: np.ndarray, w: np.ndarray | None, n: int, config: FitConfig) -> tuple[complex, float, list[float], np.ndarray]:
    """(value, transfer, norms, y) of a triad, from the triangle of its legs (sum, product, ...), each of as many columns as `first` has per leg, and the legs of the first block; y is 0 for a zero matrix, whose maximiser is the first block."""
    rows = first.shape[1]
    w = np.ones(rows) if w is None else w
    each = [r[:, j * rows : (j + 1) * rows] for j in range(len(first))]
    small = each[0] * w @ each[1].conj().T / n
    value, c = numerical_radius(small, config.tol, config.n_it_max)
    y = np.zeros(2 * rows, complex)
    at = list(first)  # what the legs give for the maximiser
    if abs(value) > 0:
        turn, scale = value / abs(value), 2 * n * abs(value)
        q, p = (x.conj().T @ c for x in each[:2])
        y = np.r_[np.conj(turn) * w * p, turn * w * q] / scale
        c = each[0] @ y[:rows] + each[1] @ y[rows:]
        y, c = y / np.linalg.norm(c), c / np.linalg.norm(c)
        at = [x.conj().T @ c for x in each]
        value = complex(at[0].conj() @ (w * at[1])) / n
    transfer = float((at[0].conj() @ at[1]).real / n) if config.compute_energy_transfer else float("nan")
    return value, transfer, [float(np.sqrt((w * np.abs(x) ** 2).sum())) for x in at], y


def _solve(config: FitConfig, table: dict[str, np.ndarray], n: int):
    """Triangles, sorted by triad and chunk -> solved triads without their coefficients; triangles are stacked as they come."""
    comps = 4 if config.constituent_modes else 2

    def solved(i, r, first, w):
        value, transfer, norms, y = solved_triad(r, first, w, n, config)
        row = {"triad_idx": i, **{c: table[c][i].item() for c in ("k", "l", "kl", "f1", "f2", "f3", "region")}}
        row |= {"l_re": value.real, "l_im": value.imag, "l_abs": abs(value), "t": transfer, "norms": norms, "y": y.tobytes()}
        return pa.RecordBatch.from_pylist([row], schema=shape)

    def run(batches):
        now, r, first, w = None, None, None, None
        for batch in batches:
            for i, factor, own_first, own_w in zip(*(batch.column(c).to_pylist() for c in ("triad_idx", "r", "first", "w"))):
                if i != now:
                    if now is not None:
                        yield solved(now, r, first, w)
                    now, r = i, None
                    first = np.frombuffer(own_first, complex).reshape(comps, -1)
                    w = None if own_w is None else np.frombuffer(own_w)
                more = np.frombuffer(factor, complex).reshape(-1, first.size)
                r = more if r is None else np.linalg.qr(np.concatenate([r, more]), mode="r")[: 2 * first.shape[1]]
        if now is not None:
            yield solved(now, r, first, w)

    shape = _arrow(_TRIAD)
    return run


def _coefficients(config: FitConfig, freqs: np.ndarray, nv: int, slices: int):
    """A chunk of blocks and rows (triad_idx, k, l, y) of a slice of triads -> the blocks' share of their maximisers."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, pieces = [], []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("triad_idx", "k", "l", "y", "p", "w", "x"))):
                (pieces if row[0] is None else asked).append(row)
        if not asked:
            return
        asked.sort(key=lambda row: row[0])
        ids, k, l = (np.array([row[c] for row in asked]) for c in range(3))  # noqa: E741
        y = np.stack([np.frombuffer(row[3], complex) for row in asked])
        q, _ = _joined([row[4:] for row in pieces], config, freqs, nv)
        rows, n = q.half.shape[1] * config.n_states, q.half.shape[-1]
        for some in _batches(config, rows, n, np.arange(len(ids)), False):
            side = np.concatenate(legs(q, config, k[some], l[some], False), axis=1)
            a = np.einsum("mrn,mr->mn", side.conj(), y[some])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), key[0].as_py() // slices, np.int32)), pa.array(ids[some], pa.int64()), pa.array([x.tobytes() for x in a], pa.binary())], ["chunk", "triad_idx", "a"])

    return run


def _assemble(names: list[str], n: int):
    """Solved triads (chunk -1), each followed by its maximiser's shares in order of chunks -> rows as every fit has them."""

    def made(row, shares):
        a = np.concatenate(shares)
        if not np.any(a):
            a = np.eye(1, n, dtype=complex)[0]
        lead = a[np.argmax(np.abs(a))]
        a = a * (np.conj(lead) / abs(lead)) / np.linalg.norm(a)
        return pa.RecordBatch.from_pylist([row | {"a_re": a.real.tolist(), "a_im": a.imag.tolist()}], schema=shape)

    def run(batches):
        row, shares = None, []
        for batch in batches:
            for one in batch.to_pylist():
                if one["chunk"] < 0:
                    if row is not None:
                        yield made(row, shares)
                    row, shares = {c: one[c] for c in names}, []
                else:
                    shares.append(np.frombuffer(one["a"], complex))
        if row is not None:
            yield made(row, shares)

    shape = _arrow(_SOLVED)
    return run


def _arrow(ddl: str):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def solve(rows: DataFrame, config: FitConfig, table: dict[str, np.ndarray], shape: tuple[int, int, int], weighted: bool, keep: bool) -> tuple[DataFrame, tuple[DataFrame, ...]]:
    """Packed chunks of points, with their weights -> (solved triads as every fit has them, what is kept for them if asked for: triads without coefficients, and spectra)."""
    spark, (nt, nx, nv) = rows.sparkSession, shape
    freqs, n, n_triads = np.concatenate([table[c] for c in ("k", "l", "kl")]), config.blocks(nt), len(table["k"])
    per = blocks_of_chunk(config, nx, nv, len(np.unique(np.abs(freqs))))
    n_chunks, n_parts = -(-nx // config.points(nt, nv)), min(n_triads, int(spark.conf.get("spark.sql.shuffle.partitions")))
    chunks = -(-n // per)
    slices = max(1, min(-(-spark.sparkContext.defaultParallelism // chunks), -(-n_triads // 4)))
    spectra = rows.repartitionById(n_chunks, "chunk").groupBy("chunk").applyInArrow(_spectra(config, freqs, nt, nv, per, weighted), _PIECE)
    if keep:  # both passes read them, so the field is packed and shuffled once; on disk, as they can be larger than it
        spectra = spectra.persist(StorageLevel.DISK_ONLY)
    pieces = spectra.withColumn("at", F.explode(F.transform(F.sequence(F.lit(0), F.lit(slices - 1)), lambda s: F.col("at") * slices + s)))
    factors = pieces.repartitionById(chunks * slices, "at").groupBy("at").applyInArrow(_factors(config, table, freqs, nv, slices), _FACTOR)
    ordered = factors.repartition(n_parts, "triad_idx").sortWithinPartitions("triad_idx", "chunk")
    solved = ordered.mapInArrow(_solve(config, table, n), _TRIAD)
    if keep:
        solved = solved.persist()
    at = F.explode(F.transform(F.sequence(F.lit(0), F.lit(chunks - 1)), lambda c: c * slices + F.pmod("triad_idx", F.lit(slices)).cast("int")))
    both = pieces.unionByName(solved.select("triad_idx", "k", "l", "y", at.alias("at")), allowMissingColumns=True)
    shares = both.repartitionById(chunks * slices, "at").groupBy("at").applyInArrow(_coefficients(config, freqs, nv, slices), _SHARE)
    names = [c for c in solved.columns if c != "y"]
    every = solved.select(F.lit(-1).alias("chunk"), *names).unionByName(shares, allowMissingColumns=True)
    whole = every.repartition(n_parts, "triad_idx").sortWithinPartitions("triad_idx", "chunk")
    return whole.mapInArrow(_assemble(names, n), _SOLVED), (solved, spectra)
