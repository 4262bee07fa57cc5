"""Eigenpairs of a small symmetric matrix by contour integration (FEAST).

The spectrum is cut into intervals from the top.  In each, the integral of the
resolvent (z - A)^-1 Y around a circle over the interval projects a block Y on
the eigenvectors inside; Gauss-Legendre nodes on the half circle give one
complex shifted solve each (the other half is the conjugate).  Rayleigh-Ritz on
the projected block extracts eigenpairs, and the step repeats with them until
the residuals are down.

How many eigenvalues an interval must give is known beforehand: by Sylvester's
law the negative pivots of A - s = L D L^T are the eigenvalues below s.
"""

from __future__ import annotations

import numpy as np

#: Growth bound of Bunch and Parlett's pivot choice.
ALPHA = (1 + np.sqrt(17)) / 8


def below(a: np.ndarray, shift: float) -> int:
    """The number of eigenvalues of ``a`` below ``shift``: the negative pivots of
    L D L^T with complete pivoting, blocks of 1 and 2."""
    m = a - shift * np.eye(len(a))
    count = 0
    while len(m):
        diag = np.abs(np.diag(m))
        i = int(diag.argmax())
        off = np.abs(m - np.diag(np.diag(m)))
        r, c = np.unravel_index(int(off.argmax()), off.shape)
        if diag[i] == 0 and off[r, c] == 0:
            break                          # the rest is zero: eigenvalues at the shift
        picked = [i] if diag[i] >= ALPHA * off[r, c] else [int(r), int(c)]
        block = m[np.ix_(picked, picked)]
        if len(picked) == 1:
            count += bool(block[0, 0] < 0)
        else:                              # chosen where its determinant is negative
            count += 1
        rest = np.setdiff1d(np.arange(len(m)), picked)
        side = m[np.ix_(rest, picked)]
        m = m[np.ix_(rest, rest)] - side @ np.linalg.solve(block, side.T)
        m = (m + m.T) / 2
    return count


def rim(lo: float, hi: float) -> tuple[float, float]:
    """The circle over an interval is a little wider, so that eigenvalues on the
    border are kept."""
    pad = (hi - lo) * 0.05 + 1e-15
    return lo - pad, hi + pad


def slices(a: np.ndarray, want: int, lo: float, hi: float, most: int) -> list[tuple[float, float, int, int]]:
    """Intervals (low, high, count, count inside the circle) from the top down
    that hold at least the ``want`` greatest eigenvalues in [lo, hi].  An
    interval is cut in two while it holds more than ``most``, or while many more
    lie just outside than inside, unless it is as narrow as equal eigenvalues."""
    out: list[tuple[float, float, int, int]] = []
    stack = [(lo, hi, below(a, lo), below(a, hi))]
    found = 0
    while stack and found < want:
        x, y, under_x, under_y = stack.pop()
        count = under_y - under_x
        if not count:
            continue
        mid = (x + y) / 2
        narrow = y - x <= 1e-13 * hi or not x < mid < y
        around = count
        if narrow or count <= most:
            around = below(a, rim(x, y)[1]) - below(a, rim(x, y)[0])
        if narrow or (count <= most and around <= 2 * count + 4):
            out.append((x, y, count, around))
            found += count
        else:
            under = below(a, mid)
            stack += [(x, mid, under_x, under), (mid, y, under, under_y)]
    return out


def projected(a: np.ndarray, block: np.ndarray, lo: float, hi: float, nodes: int) -> np.ndarray:
    """The block filtered by the contour integral over [lo, hi]."""
    centre, radius = (lo + hi) / 2, (hi - lo) / 2
    eye, out = np.eye(len(a)), np.zeros_like(block)
    for x, w in zip(*np.polynomial.legendre.leggauss(nodes)):
        z = radius * np.exp(-0.5j * np.pi * (x - 1))          # upper half circle
        out += w / 2 * (z * np.linalg.solve((centre + z) * eye - a, block)).real
    return out


def ritz(a: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rayleigh-Ritz: eigenvalues (rising) and vectors of ``a`` in the span of ``block``."""
    u, s, _ = np.linalg.svd(block, full_matrices=False)
    q = u[:, s > s[0] * 1e-14] if len(s) and s[0] > 0 else u[:, :0]
    small = q.T @ a @ q
    e, w = np.linalg.eigh((small + small.T) / 2)
    return e, q @ w


def interval(a: np.ndarray, lo: float, hi: float, count: int, around: int, nodes: int = 16,
             rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenpairs of ``a`` in [lo, hi); ``around``: those inside the
    circle.  More nodes are taken where rounds do not get all residuals down;
    not reaching the count is an error."""
    n = len(a)
    size = min(n, around + around // 2 + 4)
    tol = 1e-13 * n * np.abs(a).max()
    block = np.random.default_rng(n * 1000 + count).standard_normal((n, size))
    found = False
    for k in range(rounds):
        e, x = ritz(a, projected(a, block, *rim(lo, hi), nodes * (1 + k // 3)))
        res = np.linalg.norm(a @ x - x * e, axis=0)
        near = np.flatnonzero((e >= lo - tol) & (e < hi + tol) & (res <= tol))
        if len(near) > count:      # pairs on the border belong to the neighbour
            near = near[np.argsort(np.maximum(lo - e[near], e[near] - hi), kind="stable")[:count]]
        if len(near) == count and (found or size == n):
            return e[near], x[:, near]
        found = len(near) == count     # one more round polishes the vectors
        block = np.hstack([x, np.random.default_rng(k).standard_normal((n, size - x.shape[1]))])
    raise ArithmeticError(f"contour integration found {len(near)} of {count} eigenvalues in [{lo}, {hi})")


def greatest(a: np.ndarray, want: int, least: float = 1e-11, most: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """The ``want`` greatest eigenvalues (falling) above ``least`` times the
    greatest possible one, and their unit vectors as columns."""
    n = len(a)
    bound = float(np.abs(a).sum(axis=1).max()) if n else 0.0      # Gershgorin
    if bound == 0:
        return np.zeros(0), np.zeros((n, 0))
    scaled = a / bound
    cut = slices(scaled, want, least, 1 + 1e-9, most)
    if not cut:
        return np.zeros(0), np.zeros((n, 0))
    found = [interval(scaled, *c) for c in cut]
    # all together once more, so that vectors of different intervals are orthogonal
    e, x = ritz(scaled, np.hstack([v for _, v in found]))
    if len(e) != sum(c[2] for c in cut):
        raise ArithmeticError(f"{len(e)} independent vectors for {sum(c[2] for c in cut)} eigenvalues")
    order = np.argsort(-e, kind="stable")[:want]
    return e[order] * bound, x[:, order]
