"""Local lines with tricube weights from prefix moments: no pair of rows, no term per row and anchor.

Within its radius a tricube weight is a polynomial of degree 9 in the distance, so
all sums that a line at an anchor needs are moments of degree up to 11 of the
window's rows, taken about the anchor. An entity's rows are cut into blocks. A block keeps
running moments about its own middle, so the part of a window in a block is
the difference of two of them; whole blocks between are moved to the middle of the
anchor's block once for all its anchors, and from there to each anchor. All coordinates
are shares of the window, at most 1, so nothing cancels beyond the size of the sums.

Entities of few rows are many, and a block of theirs would cost more calls than rows. Those
with the same number of rows have the same windows, so their sums are products of their
weights and values with one table (anchor x row), for thousands of entities at once.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import comb

import numpy as np

DEGREE = 12  # moments 0..11: tricube (9) times the square of a distance (2)
MIN_BLOCK, MAX_BLOCK = 16, 4096
TABLE_CELLS = 1 << 20  # anchors x rows of an entity up to which its lines come from a table

# Fixed values of robust local regression (Cleveland 1979): weights within this
# share of the radius count fully, beyond that share not at all.
NEAR, FAR = 0.001, 0.999
_CHOOSE = np.array([[comb(m, i) for i in range(DEGREE)] for m in range(DEGREE)], float)
_LESS = np.maximum(np.subtract.outer(np.arange(DEGREE), np.arange(DEGREE)), 0)


def block_rows(k: int) -> int:
    return int(min(MAX_BLOCK, max(MIN_BLOCK, -(-k // 16))))


def moved(m: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Moments (n, 2, DEGREE) about points that lie ``by`` (n) further down."""
    powers = by[:, None] ** np.arange(DEGREE)[None, :]
    return np.einsum("mi,nmi,nbi->nbm", _CHOOSE, powers[:, _LESS], m, optimize=True)


def running(pos: np.ndarray, y: np.ndarray, w: np.ndarray, block: np.ndarray, size: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Block numbers and running moments (block, size + 1, 2, DEGREE) of rows that hold whole blocks in order."""
    known, at = np.unique(block, return_inverse=True)
    u = (pos - (block * size + (size + 1) / 2)) / k
    terms = w[:, None] * u[:, None] ** np.arange(DEGREE)[None, :]
    out = np.zeros((len(known), size + 1, 2, DEGREE))
    inside = pos - block * size  # 1..size
    out[at, inside, 0], out[at, inside, 1] = terms, terms * y[:, None]
    np.cumsum(out, axis=1, out=out)
    return known, out


def windows(c: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last of the k rows nearest to each anchor, and the distance to the farther one."""
    left = np.clip(c - k // 2, 1, n - k + 1)
    right = left + k - 1
    return left, right, np.maximum(c - left, right - c).astype(float)


def line_values(sw: np.ndarray, sd: np.ndarray, sdd: np.ndarray, sy: np.ndarray, sdy: np.ndarray, n: int, k: int) -> np.ndarray:
    """Value at the anchor of the line with these sums, distances being shares of the window; NaN where no row has weight."""
    with np.errstate(divide="ignore", invalid="ignore"):
        var = sdd / sw - (sd / sw) ** 2
        level = sy / sw
        slope = (sdy - sd * sy / sw) / (sw * var)
        flat = np.sqrt(np.maximum(var, 0)) * k <= 0.001 * (n - 1)
        return np.where(sw > 0, np.where(flat, level, level - slope * sd / sw), np.nan)


@dataclass
class Rows:
    """What a task holds of an entity: running moments of some blocks, moments of all."""

    n: int
    k: int
    size: int
    known: np.ndarray
    run: np.ndarray
    whole: np.ndarray  # (blocks of the entity, 2, DEGREE)

    def middle(self, block: np.ndarray) -> np.ndarray:
        return block * self.size + (self.size + 1) / 2

    def between(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Moments about each anchor of the rows lo..hi; zero where hi < lo."""
        out = np.zeros((len(c), 2, DEGREE))
        use = np.flatnonzero(hi >= lo)
        if not len(use):
            return out
        c, lo, hi = c[use], lo[use] - 1, hi[use] - 1
        first, last = lo // self.size, hi // self.size
        end = np.where(first == last, hi % self.size, self.size - 1)
        at = lambda b: np.searchsorted(self.known, b)
        sums = moved(self.run[at(first), end + 1] - self.run[at(first), lo % self.size], (self.middle(first) - c) / self.k)
        more = np.flatnonzero(last > first)
        if len(more):
            part = self.run[at(last[more]), hi[more] % self.size + 1]
            sums[more] += moved(part, (self.middle(last[more]) - c[more]) / self.k)
        far = np.flatnonzero(last > first + 1)
        if len(far):
            own = (c[far] - 1) // self.size
            keys, group = np.unique(np.column_stack([first[far], last[far], own]), axis=0, return_inverse=True)
            for g, (a, b, j) in enumerate(keys):
                blocks = np.arange(a + 1, b)
                here = moved(self.whole[blocks], (self.middle(blocks) - self.middle(j)) / self.k).sum(axis=0)
                mine = far[group.ravel() == g]
                sums[mine] += moved(np.broadcast_to(here, (len(mine), 2, DEGREE)), (self.middle(j) - c[mine]) / self.k)
        out[use] = sums
        return out

    def lines(self, c: np.ndarray) -> np.ndarray:
        """Value at each anchor of the line fitted to its k nearest rows; NaN where no row has weight."""
        left, right, h = windows(c, self.n, self.k)
        lo, hi = np.maximum(left, np.ceil(c - FAR * h)).astype(int), np.minimum(right, np.floor(c + FAR * h)).astype(int)
        near = np.floor(NEAR * h).astype(int)
        lo, hi = np.minimum(lo, c), np.maximum(hi, c)
        full = self.between(c, np.maximum(c - near, lo), np.minimum(c + near, hi))
        before, behind = self.between(c, lo, c - near - 1), self.between(c, c + near + 1, hi)
        r = np.where(h > 0, self.k / np.where(h > 0, h, 1), 0.0)[:, None]
        tri = lambda m, s, a: m[:, :, a] - s * 3 * r**3 * m[:, :, a + 3] + 3 * r**6 * m[:, :, a + 6] - s * r**9 * m[:, :, a + 9]
        s = [full[:, :, a] + tri(before, -1, a) + tri(behind, 1, a) for a in range(3)]
        return line_values(s[0][:, 0], s[1][:, 0], s[2][:, 0], s[0][:, 1], s[1][:, 1], self.n, self.k)


def anchors_for(first: int, last: int, n: int, step: int) -> np.ndarray:
    """The anchors 1, 1 + step, ..., n from the one at or before ``first`` to the one at or after ``last``."""
    inner = np.arange((first - 1) // step, -(-(last - 1) // step) + 1)
    return np.unique(np.minimum(n, 1 + inner * step))


def interpolated(a: np.ndarray, v: np.ndarray, pos: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Values at the rows between the anchors ``a`` with lines ``v``; without a line a row keeps its own value."""
    hi = np.searchsorted(a, pos)
    lo = np.where(a[hi] == pos, hi, hi - 1)
    below, above = v[..., lo], v[..., hi]
    v_lo = np.where(np.isnan(below), y, below)
    share = np.where(hi > lo, (pos - a[lo]) / np.maximum(a[hi] - a[lo], 1), 0.0)
    return np.where(share == 0, v_lo, v_lo + share * (np.where(np.isnan(above), y, above) - v_lo))


def fitted(rows: Rows, pos: np.ndarray, y: np.ndarray, step: int) -> np.ndarray:
    """Trend at each row: lines at the anchors, interpolated between."""
    a = anchors_for(int(pos[0]), int(pos[-1]), rows.n, step)
    v = np.concatenate([rows.lines(a[i : i + 4096]) for i in range(0, len(a), 4096)])
    return interpolated(a, v, pos, y)


def robust(y: np.ndarray, fit: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Bisquare weights from six times the median absolute residual, over the last axis."""
    res = np.abs(y - fit)
    c = 6 * np.median(res, axis=-1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        q = res / c
    bisq = np.where(res <= NEAR * c, 1.0, np.where(res <= FAR * c, (1 - q * q) ** 2, 0.0))
    return np.where(c < 1e-7 * res.mean(axis=-1, keepdims=True), w, bisq)


def whole_entity(y: np.ndarray, k: int, step: int, passes: int) -> np.ndarray:
    """All passes over one entity that a task holds whole."""
    n, size = len(y), block_rows(k)
    pos = np.arange(1, n + 1)
    block, w = (pos - 1) // size, np.ones(n)
    for it in range(passes + 1):
        known, run = running(pos, y, w, block, size, k)
        fit = fitted(Rows(n, k, size, known, run, run[:, -1]), pos, y, step)
        if it < passes:
            w = robust(y, fit, w)
    return fit


def alike_entities(y: np.ndarray, k: int, step: int, passes: int) -> np.ndarray:
    """All passes over entities with the same number of rows, one in each row of ``y``."""
    n = y.shape[1]
    pos, a = np.arange(1, n + 1), anchors_for(1, n, n, step)
    if len(a) * n > TABLE_CELLS:
        return np.array([whole_entity(one, k, step, passes) for one in y])
    finite = np.isfinite(y).all(axis=1)
    if not finite.all():  # a product would spread the value over lines out of its reach
        out = np.empty(y.shape)
        out[~finite] = [whole_entity(one, k, step, passes) for one in y[~finite]]
        if finite.any():
            out[finite] = alike_entities(y[finite], k, step, passes)
        return out
    h = windows(a, n, k)[2]
    d = np.subtract.outer(pos, a).astype(float)
    far = np.abs(d)
    cube = (1 - (far / np.where(h > 0, h, 1)) ** 3) ** 3
    tri = np.where(far <= NEAR * h, 1.0, np.where(far <= FAR * h, cube, 0.0))
    level, first, second = (tri * (d / k) ** m for m in range(3))
    w = np.ones(y.shape)
    for it in range(passes + 1):
        wy = w * y
        fit = interpolated(a, line_values(w @ level, w @ first, w @ second, wy @ level, wy @ first, n, k), pos, y)
        if it < passes:
            w = robust(y, fit, w)
    return fit
