"""Leading eigenpairs of a symmetric matrix by spectrum slicing.

The inertia of an LDL' factorisation of A - sI counts the eigenvalues above s. Bisection on those counts
isolates each leading eigenvalue, Rayleigh quotient iteration from inside the interval converges to its
vector, and counts on both sides of the result certify its number. Eigenvalues that no count can tell apart
(equal, but for rounding) share an interval; their vectors are found one after the other, each orthogonal to
those before.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps


def inertia(a: np.ndarray, shift: float) -> tuple[int, int]:
    """(eigenvalues above shift, eigenvalues equal to it), by LDL' with 1x1 and 2x2 pivots, each the largest left."""
    m = a - shift * np.eye(len(a))
    tiny = EPS * max(1e-300, np.abs(m).max(initial=0)) * len(a) * 1e-3
    above = 0
    while len(m):
        diagonal = np.abs(np.diag(m))
        off = np.abs(m - np.diag(np.diag(m)))
        r = int(diagonal.argmax())
        p, q = divmod(int(off.argmax()), len(m))
        if max(diagonal[r], off[p, q]) <= tiny:
            return above, len(m)
        if diagonal[r] >= 0.6404 * off[p, q]:  # (1 + sqrt 17) / 8 bounds the growth of what is left
            above += m[r, r] > 0
            rest = np.delete(np.arange(len(m)), r)
            column = m[rest, r]
            m = m[np.ix_(rest, rest)] - np.outer(column, column / m[r, r])
        else:
            above += 1  # such a 2x2 pivot has one eigenvalue of each sign
            rest = np.delete(np.arange(len(m)), [p, q])
            columns = m[np.ix_(rest, [p, q])]
            m = m[np.ix_(rest, rest)] - columns @ np.linalg.solve(m[np.ix_([p, q], [p, q])], columns.T)
    return above, 0


class Slicer:
    """Counts of a matrix's eigenvalues, kept, so that the search for one narrows the others."""

    def __init__(self, a: np.ndarray):
        self.a = a
        self.norm = float(np.abs(a).sum(axis=1).max(initial=0)) or 1.0
        self.known = {-2 * self.norm: len(a), 2 * self.norm: 0}

    def above(self, shift: float) -> int:
        if shift not in self.known:
            self.known[shift] = inertia(self.a, shift)[0]
        return self.known[shift]

    def around(self, number: int) -> tuple[float, float]:
        """The narrowest known interval that holds eigenvalue number (from 1, falling)."""
        lo = max(s for s, n in self.known.items() if n >= number)
        return lo, min(s for s, n in self.known.items() if n < number and s > lo)

    def isolate(self, number: int) -> tuple[float, float, int]:
        """(lo, hi, eigenvalues in between): bisected until one is left, or the interval is as narrow as rounding."""
        lo, hi = self.around(number)
        while self.above(lo) - self.above(hi) > 1 and hi - lo > 16 * EPS * self.norm:
            if self.above((lo + hi) / 2) >= number:
                lo = (lo + hi) / 2
            else:
                hi = (lo + hi) / 2
        return lo, hi, self.above(lo) - self.above(hi)


def solved(a: np.ndarray, shift: float, norm: float, v: np.ndarray) -> np.ndarray:
    """(a - shift)^-1 v, normalised; a shift on an eigenvalue is moved by a rounding error."""
    for nudge in (0.0, 1.0, 4.0, 16.0):
        try:
            w = np.linalg.solve(a - (shift + nudge * EPS * norm) * np.eye(len(a)), v)
        except np.linalg.LinAlgError:
            continue
        size = np.linalg.norm(w)
        if np.isfinite(size) and size > 0:
            return w / size
    return v


def orthogonal(v: np.ndarray, before: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for b in before:
            v = v - b * (b @ v)
    return v / np.linalg.norm(v)


def eigenpair(s: Slicer, number: int, before: list[np.ndarray], rng: np.random.Generator) -> tuple[float, np.ndarray]:
    """Rayleigh quotient iteration inside the interval of one eigenvalue; bisected further while it strays."""
    a = s.a
    while True:
        lo, hi, inside = s.isolate(number)
        v = orthogonal(rng.normal(size=len(a)), before)
        for _ in range(3):  # inverse iteration turns the start towards the interval
            v = orthogonal(solved(a, (lo + hi) / 2, s.norm, v), before)
        for _ in range(30):
            value = float(v @ a @ v)
            rest = float(np.linalg.norm(a @ v - value * v))
            if not lo <= value <= hi or rest <= 8 * EPS * s.norm:
                break
            v = orthogonal(solved(a, value, s.norm, v), before)
        narrow = hi - lo <= 16 * EPS * s.norm
        margin = rest + 16 * EPS * s.norm
        # certificate: the count rises to number between value + margin and value - margin
        if (lo - margin <= value <= hi + margin and rest <= 64 * EPS * s.norm
                and s.above(value - margin) >= number > s.above(value + margin)) or narrow:
            return value, v
        s.above((lo + hi) / 2)


def leading(a: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The count largest eigenvalues, falling, and their unit vectors as columns."""
    s = Slicer(a)
    rng = np.random.default_rng(13)
    values: list[float] = []
    vectors: list[np.ndarray] = []
    for number in range(1, min(count, len(a)) + 1):
        value, v = eigenpair(s, number, vectors, rng)
        values.append(value)
        vectors.append(v)
    order = np.argsort(-np.array(values), kind="stable")
    return np.array(values)[order], np.array(vectors).reshape(len(vectors), len(a))[order].T
