"""Which rays of a set of points walls are in the way of: arrays in one task.

All rays of a point are held against the walls around it from near to far. What stands in the way of a low ray is mostly near, and high rays soon
pass over every roof, so few rays are left to meet the many walls farther off. Points are taken in blocks that lie together, and pairs in pieces of a stated
size, so memory doesn't grow with the walls that a point could see.
"""

from __future__ import annotations

import numpy as np

#: Points of a block, pairs of a point and a wall and rays held against a wall at a time; fixed values.
_BLOCK, _PAIRS, _RAYS = 256, 1 << 20, 1 << 20
#: Distances that walls are taken in order of, in metres, up to the pad; width of the strips that points are sorted by.
_BANDS, STRIP = (2.0, 4.0, 8.0, 16.0, 32.0, 64.0, 128.0, 256.0, 512.0), 16.0
_TURN = 2 * np.pi


class Walls:
    """Rings as walls: ``xs, ys`` of all corners ring after ring, ``sizes`` corners of each, and the rings' heights and opacities."""

    def __init__(self, xs: np.ndarray, ys: np.ndarray, sizes: np.ndarray, height: np.ndarray, opacity: np.ndarray) -> None:
        self.sizes, self.start = sizes, np.cumsum(sizes) - sizes
        after = np.arange(1, len(xs) + 1)
        after[self.start + sizes - 1] = self.start
        self.ax, self.ay, self.bx, self.by = xs, ys, xs[after], ys[after]
        self.ex, self.ey = self.bx - self.ax, self.by - self.ay
        self.ring = np.repeat(np.arange(len(sizes)), sizes)
        self.height, self.opacity = height, opacity
        some = len(sizes) > 0
        self.west, self.east = (np.minimum.reduceat(xs, self.start), np.maximum.reduceat(xs, self.start)) if some else (xs, xs)
        self.south, self.north = (np.minimum.reduceat(ys, self.start), np.maximum.reduceat(ys, self.start)) if some else (ys, ys)

    def inside(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether each point lies in each ring, by the even-odd rule of ``geo.point_in_ring``."""
        held = np.zeros((len(x), len(self.sizes)), dtype=bool)
        near = np.nonzero((self.west <= x.max()) & (self.east >= x.min()) & (self.south <= y.max()) & (self.north >= y.min()))[0]
        p, r = np.nonzero((x[:, None] >= self.west[near]) & (x[:, None] <= self.east[near]) & (y[:, None] >= self.south[near]) & (y[:, None] <= self.north[near]))
        r = near[r]
        odd = np.zeros(len(p), dtype=bool)
        for k in range(int(self.sizes[r].max()) if len(r) else 0):
            on = np.nonzero(self.sizes[r] > k)[0]
            w, px, py = self.start[r[on]] + k, x[p[on]], y[p[on]]
            crosses = (self.ay[w] > py) != (self.by[w] > py)
            at = self.ex[w] * (py - self.ay[w]) / self.ey[w] + self.ax[w]
            odd[on] ^= crosses & (px < at)
        held[p[odd], r[odd]] = True
        return held


def _ragged(first: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges of ``counts`` numbers from ``first``: the range of each number, and the numbers one after another."""
    of = np.repeat(np.arange(len(counts)), counts)
    return of, np.arange(len(of)) + np.repeat(first - (np.cumsum(counts) - counts), counts)


def _pieces(counts: np.ndarray, most: int):
    """Slices of ranges that hold about ``most`` numbers together."""
    total, at = np.cumsum(counts), 0
    while at < len(counts):
        until = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        yield slice(at, until)
        at = until


def densest(x: np.ndarray, y: np.ndarray, walls: Walls, ux: np.ndarray, uy: np.ndarray, slope: np.ndarray, pad: float) -> np.ndarray:
    """The opacity of the densest ring in the way of each point (rows) in each direction (columns), 0 for none.

    A ring is in the way if the ray crosses one of its walls within ``pad`` metres where it is higher than the ray. Rings that a point lies in don't count.
    """
    best = np.zeros((len(x), len(ux)))
    if not (len(x) and len(ux) and len(walls.sizes)):
        return best
    angle = np.mod(np.arctan2(ux, uy), _TURN)
    order = np.argsort(angle, kind="stable")
    rays = (angle[order], ux[order], uy[order], slope[order])
    known = np.nonzero(np.isfinite(x) & np.isfinite(y))[0]
    known = known[np.lexsort((x[known], np.floor(y[known] / STRIP)))]
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        for at in range(0, len(known), _BLOCK):
            block = known[at : at + _BLOCK]
            found = np.zeros((len(block), len(ux)))
            _block(x[block], y[block], walls, rays, pad, found)
            best[block[:, None], order[None, :]] = found
    return best


def _block(x: np.ndarray, y: np.ndarray, walls: Walls, rays: tuple[np.ndarray, ...], pad: float, best: np.ndarray) -> None:
    """``densest`` of one block, by the order of the rays' angles, into ``best``."""
    held = walls.inside(x, y)
    wide = np.maximum(np.maximum(np.minimum(walls.ax, walls.bx) - x.max(), x.min() - np.maximum(walls.ax, walls.bx)), 0.0)
    high = np.maximum(np.maximum(np.minimum(walls.ay, walls.by) - y.max(), y.min() - np.maximum(walls.ay, walls.by)), 0.0)
    least = np.hypot(wide, high)
    order = np.argsort(least, kind="stable")
    order = order[(least[order] <= pad + 1e-6) & ((walls.ex[order] != 0) | (walls.ey[order] != 0))]
    if not len(order):
        return
    least = least[order]
    # A ray is done once the densest ring is in its way, or once it has risen above the tallest.
    dense, tall = walls.opacity[walls.ring[order]].max(), walls.height[walls.ring[order]].max()
    slope, low = rays[3], 0.0
    for band in (*(b for b in _BANDS if b < pad), np.inf):
        open_ = (best < dense) & (slope * (low - 1e-6) < tall)
        left = np.nonzero(open_.any(axis=1))[0]
        if not len(left):
            return
        near = order[: np.searchsorted(least, band, "left")]
        step = max(1, _PAIRS // max(1, len(near)))
        for i in range(0, len(left), step):
            _meet(left[i : i + step], near, low, min(band, pad + 1e-6), x, y, walls, held, rays, pad, open_, best)
        low = band


def _meet(left: np.ndarray, near: np.ndarray, low: float, high: float, x: np.ndarray, y: np.ndarray, walls: Walls, held: np.ndarray, rays: tuple[np.ndarray, ...], pad: float, open_: np.ndarray, best: np.ndarray) -> None:
    """Points ``left`` meet those of the walls ``near`` that are ``low`` to ``high`` metres off."""
    angle, ux, uy, slope = rays
    n = len(ux)
    qx, qy = walls.ax[near] - x[left, None], walls.ay[near] - y[left, None]
    ex, ey = walls.ex[near], walls.ey[near]
    t = np.clip(-(qx * ex + qy * ey) / (ex * ex + ey * ey), 0.0, 1.0)
    away = np.hypot(qx + t * ex, qy + t * ey)
    ring = walls.ring[near]
    p, w = np.nonzero((away >= low) & (away < high) & (walls.height[ring] > (away - 1e-6) * slope.min()))
    free = ~held[left[p], ring[w]]
    p, w = p[free], w[free]
    if not len(p):
        return
    away, qx, qy, ex, ey, ring = away[p, w], qx[p, w], qy[p, w], ex[w], ey[w], ring[w]
    height, opacity = walls.height[ring], walls.opacity[ring]
    # A wall spans the directions between its ends; a point on the wall can't tell on which side they are.
    a, b = np.mod(np.arctan2(qx, qy), _TURN), np.mod(np.arctan2(qx + ex, qy + ey), _TURN)
    turn = np.mod(b - a, _TURN)
    first, width = np.where(turn > np.pi, b, a), np.where(turn > np.pi, _TURN - turn, turn)
    first = np.mod(first - 1e-7, _TURN)
    twice = np.concatenate([angle, angle + _TURN])
    start, end = np.searchsorted(twice, first, "left"), np.searchsorted(twice, first + width + 2e-7, "right")
    on = away < 1e-5
    start[on], end[on] = 0, n
    over = np.nonzero(end > n)[0]
    pair = np.concatenate([np.arange(len(p)), over])
    start, end = np.concatenate([start, np.zeros(len(over), dtype=start.dtype)]), np.concatenate([np.minimum(end, n), end[over] - n])
    # Of these directions only the open ones count, found by their number before each place.
    row = left[p][pair]
    before = np.zeros((len(open_), n + 1), dtype=np.int64)
    np.cumsum(open_, axis=1, out=before[:, 1:])
    flat = np.flatnonzero(open_)
    begin = np.cumsum(before[:, -1]) - before[:, -1]
    skip = before[row, start]
    counts = before[row, end] - skip
    some = counts > 0
    pair, row, skip, counts = pair[some], row[some], skip[some], counts[some]
    across = qx * ey - qy * ex
    for piece in _pieces(counts, _RAYS):
        k, place = _ragged(begin[row[piece]] + skip[piece], counts[piece])
        at = flat[place]
        s, k = at % n, pair[piece][k]
        # A ray that passes over the wall's nearest place passes over all of it.
        may = np.nonzero(height[k] > (away[k] - 1e-6) * slope[s])[0]
        at, s, k = at[may], s[may], k[may]
        rx, ry = ux[s], uy[s]
        cross = rx * ey[k] - ry * ex[k]
        along = (qx[k] * ry - qy[k] * rx) / cross
        d = across[k] / cross
        hit = np.nonzero((along >= 0) & (along < 1) & (d > 0) & (d <= pad) & (height[k] > d * slope[s]))[0]
        np.maximum.at(best.reshape(-1), at[hit], opacity[k[hit]])
