"""The numerical radius of a small complex matrix and a vector that attains it, in numpy.

r(A) = max over unit z of |z* A z| = max over angles of the largest eigenvalue of
H(t) = (exp(it) A + exp(-it) A*) / 2. For a level w above a known value, the angles at which w is an
eigenvalue of H are the unit-modulus roots x = exp(it) of det(x^2 A - 2 w x I + A*) = 0. Where no
root's H has w as its largest eigenvalue, no angle reaches w; else the intervals between those angles are
looked at in their middles, and the best of these is the next level.

The quadratic pencil is linearised to R - x S of twice the size. Its finite eigenvalues come from those of the
ordinary matrix (R - m S)^-1 S, shifted by the best conditioned of a few points m off the unit circle.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(np.float64).eps


def nearness(n: int) -> float:
    """How far a root of the pencil may lie off the unit circle, for matrices of norm 1 at most: where two roots meet, as at the top of the field of values, both move by the root of the rounding errors of 2 n columns. H changes by no more than that over so small an angle, so levels are compared within the same."""
    return float(np.sqrt(8 * n * EPS))


#: From this size on a matrix is looked at for low rank.
LARGE = 16


def rotated(a: np.ndarray, angles: np.ndarray) -> np.ndarray:
    """H at each angle."""
    x = np.exp(1j * np.atleast_1d(angles))[:, None, None] * a
    return (x + np.conj(np.swapaxes(x, -1, -2))) / 2


def field_of_values(a: np.ndarray, angles) -> np.ndarray:
    """The largest (signed) eigenvalue of H at each angle."""
    return np.linalg.eigvalsh(rotated(a, np.asarray(angles, float)))[:, -1]


def scaled(a: np.ndarray) -> tuple[np.ndarray, int]:
    """a times an exact power of two that brings its column-sum norm into (1/2, 1], and the exponent taken out; zero and non-finite matrices stay."""
    # The norm may overflow or be subnormal, so the largest part is brought near 1 first.
    top = max(np.abs(a.real).max(initial=0.0), np.abs(a.imag).max(initial=0.0))
    if top == 0 or not np.isfinite(top):
        return a, 0
    first = int(np.frexp(top)[1])
    shift = lambda x, e: np.ldexp(x.real, -e) + 1j * np.ldexp(x.imag, -e)
    near = shift(a, first)
    fraction, second = np.frexp(np.abs(near).sum(axis=0).max())
    second = int(second) - (fraction == 0.5)
    return shift(near, int(second)), first + int(second)


def level_angles(a: np.ndarray, level: float) -> np.ndarray:
    """Angles at which level is the largest eigenvalue of H, sorted; a of norm 1 at most."""
    n = len(a)
    eye, zero = np.eye(n), np.zeros((n, n))
    r = np.block([[2 * level * eye, -a.conj().T], [eye, zero]]).astype(complex)
    s = np.block([[a, zero], [zero, eye]]).astype(complex)
    shifts = 1.3 * np.exp(2j * np.pi * (np.arange(5) + 0.3) / 5)
    best, inverse, least = 0, None, np.inf
    for i, shift in enumerate(shifts):
        pencil = r - shift * s
        try:
            own = np.linalg.inv(pencil)
        except np.linalg.LinAlgError:
            continue
        cond = np.linalg.norm(pencil, 1) * np.linalg.norm(own, 1)
        if cond < least:
            best, inverse, least = i, own, cond
    if inverse is None:
        return np.zeros(0)
    nu = np.linalg.eigvals(inverse @ s)
    with np.errstate(divide="ignore", invalid="ignore"):
        x = shifts[best] + 1 / nu
    x = x[np.isfinite(x)]
    x = x[np.abs(np.abs(x) - 1) <= nearness(n)]
    angles = np.sort(np.mod(np.angle(x), 2 * np.pi))
    if not len(angles):
        return angles
    return angles[np.abs(field_of_values(a, angles) - level) <= nearness(n)]


def numerical_radius(a: np.ndarray, tol: float = 1e-8, n_it_max: int = 500) -> tuple[complex, np.ndarray]:
    """(z* A z, z) for a unit z of largest |z* A z|; the first entry's phase is free, so z is turned to make its largest entry positive."""
    a = np.asarray(a, complex)
    n = len(a)
    small, _ = scaled(a)
    if not small.any():
        z = np.zeros(n, complex)
        z[0] = 1
        return 0j, z
    if n > LARGE:
        # What is orthogonal to the ranges of A and A* adds nothing to the form, so a matrix of low rank is solved on their span.
        u, d, _ = np.linalg.svd(np.hstack([small, small.conj().T]), full_matrices=False)
        u = u[:, d > n * EPS * d[0]]
        if u.shape[1] < n // 2:
            _, z = numerical_radius(u.conj().T @ small @ u, tol, n_it_max)
            return _form(a, u @ z)
    angles = np.linspace(0, 2 * np.pi, 16, endpoint=False)  # a start that few levels improve
    best, top = 0.0, -np.inf
    for _ in range(n_it_max):
        values = field_of_values(small, angles)
        if values.max() > top:
            best, top = float(angles[values.argmax()]), float(values.max())
        crossings = level_angles(small, (1 + tol) * top)
        if not len(crossings):
            break
        middles = (crossings + np.diff(np.r_[crossings, crossings[0] + 2 * np.pi]) / 2) % (2 * np.pi)
        above = field_of_values(small, middles) > (1 + tol) * top
        if not above.any():
            break
        angles = middles[above]
    return _form(a, np.linalg.eigh(rotated(small, np.array([best]))[0])[1][:, -1])


def _form(a: np.ndarray, z: np.ndarray) -> tuple[complex, np.ndarray]:
    z = z / np.linalg.norm(z)
    lead = z[np.argmax(np.abs(z))]
    z = z * (np.conj(lead) / abs(lead))
    return complex(z.conj() @ a @ z), z


def _scaled_stack(a: np.ndarray) -> np.ndarray:
    """Each matrix of a stack times a power of two, as scaled does."""
    out = a.copy()
    top = np.maximum(np.abs(a.real), np.abs(a.imag)).max(axis=(1, 2))
    for _ in range(2):  # the parts first, then the norm
        fine = (top > 0) & np.isfinite(top)
        fraction, e = np.frexp(np.where(fine, top, 1.0))
        e = np.where(fine, e - (fraction == 0.5), 0)[:, None, None]
        out = np.ldexp(out.real, -e) + 1j * np.ldexp(out.imag, -e)
        top = np.abs(out).sum(axis=1).max(axis=1)
    return out


def _tops(a: np.ndarray, angles: np.ndarray) -> np.ndarray:
    """The largest eigenvalue of H of each matrix at each of its angles: (m, k)."""
    x = np.exp(1j * angles)[:, :, None, None] * a[:, None]
    return np.linalg.eigvalsh((x + np.conj(np.swapaxes(x, -1, -2))) / 2)[..., -1]


def _stack_crossings(a: np.ndarray, level: np.ndarray) -> np.ndarray:
    """level_angles of each matrix of a stack, sorted, padded with NaN: (m, 2 n)."""
    m, n, _ = a.shape
    r, s = np.zeros((m, 2 * n, 2 * n), complex), np.zeros((m, 2 * n, 2 * n), complex)
    eye = np.eye(n)
    r[:, :n, :n], r[:, :n, n:], r[:, n:, :n] = 2 * level[:, None, None] * eye, -np.conj(np.swapaxes(a, 1, 2)), eye
    s[:, :n, :n], s[:, n:, n:] = a, eye
    shifts = 1.3 * np.exp(2j * np.pi * (np.arange(5) + 0.3) / 5)
    pencils = r[:, None] - shifts[None, :, None, None] * s[:, None]
    inverse = np.linalg.inv(pencils)
    norm = lambda x: np.abs(x).sum(axis=-2).max(axis=-1)
    best = np.argmin(np.nan_to_num(norm(pencils) * norm(inverse), nan=np.inf), axis=1)
    nu = np.linalg.eigvals(inverse[np.arange(m), best] @ s)
    with np.errstate(divide="ignore", invalid="ignore"):
        x = shifts[best][:, None] + 1 / nu
        near = np.isfinite(x) & (np.abs(np.abs(x) - 1) <= nearness(n))
    angles = np.where(near, np.mod(np.angle(np.where(near, x, 1)), 2 * np.pi), 0.0)
    hit = near & (np.abs(_tops(a, angles) - level[:, None]) <= nearness(n))
    return np.sort(np.where(hit, angles, np.nan), axis=1)


def numerical_radii(a: np.ndarray, tol: float = 1e-8, n_it_max: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """numerical_radius of each matrix of a stack (m, n, n): values and vectors. Each matrix's result is the same in any stack."""
    a = np.asarray(a, complex)
    m, n, _ = a.shape
    values, vectors = np.zeros(m, complex), np.zeros((m, n), complex)
    if n > LARGE or not np.isfinite(a).all():
        for i in range(m):
            values[i], vectors[i] = numerical_radius(a[i], tol, n_it_max)
        return values, vectors
    small = _scaled_stack(a)
    start = np.broadcast_to(np.linspace(0, 2 * np.pi, 16, endpoint=False), (m, 16))
    tops = _tops(small, start)
    best, top = start[np.arange(m), tops.argmax(axis=1)].copy(), tops.max(axis=1)
    active = np.flatnonzero(np.abs(small).max(axis=(1, 2)) > 0)
    for _ in range(n_it_max):
        if not len(active):
            break
        level = (1 + tol) * top[active]
        try:
            crossings = _stack_crossings(small[active], level)
        except np.linalg.LinAlgError:  # a singular pencil: these go one by one
            for i in active:
                values[i], vectors[i] = numerical_radius(a[i], tol, n_it_max)
                best[i] = np.nan
            break
        some = ~np.isnan(crossings[:, 0])
        active, crossings, level = active[some], crossings[some], level[some]
        if not len(active):
            break
        ahead = np.c_[crossings[:, 1:], np.full(len(active), np.nan)]
        count = (~np.isnan(crossings)).sum(axis=1)
        ahead[np.arange(len(active)), count - 1] = crossings[:, 0] + 2 * np.pi
        middles = (crossings + ahead) / 2
        found = np.where(np.isnan(middles), -np.inf, _tops(small[active], np.nan_to_num(middles)))
        at, high = found.argmax(axis=1), found.max(axis=1)
        up = high > level
        active = active[up]
        best[active], top[active] = middles[up, at[up]] % (2 * np.pi), high[up]
    done = ~np.isnan(best)
    z = np.linalg.eigh(rotated_each(small[done], best[done]))[1][..., -1]
    zero = np.abs(small[done]).max(axis=(1, 2)) == 0
    z[zero] = np.eye(n)[0]
    z = z / np.linalg.norm(z, axis=1, keepdims=True)
    lead = z[np.arange(len(z)), np.argmax(np.abs(z), axis=1)]
    z = z * (np.conj(lead) / np.abs(lead))[:, None]
    vectors[done] = z
    values[done] = np.einsum("mi,mij,mj->m", z.conj(), a[done], z)
    return values, vectors


def rotated_each(a: np.ndarray, angles: np.ndarray) -> np.ndarray:
    x = np.exp(1j * angles)[:, None, None] * a
    return (x + np.conj(np.swapaxes(x, -1, -2))) / 2
