"""No-fit rings of all turns of two shapes at once."""

from __future__ import annotations

import numpy as np


def padded(rings: list) -> tuple[np.ndarray, np.ndarray]:
    """Corners (ring, corner, 2) and the next ones; rings with fewer corners repeat their last side."""
    most = max(map(len, rings))
    start, end = np.zeros((len(rings), most, 2), np.int64), np.zeros((len(rings), most, 2), np.int64)
    for k, ring in enumerate(rings):
        r = np.array(ring, dtype=np.int64)
        at = np.minimum(np.arange(most), len(r) - 1)
        start[k], end[k] = r[at], r[(at + 1) % len(r)]
    return start, end


def _farthest(way: np.ndarray, corners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each side of each ring and each other ring: the other's corner farthest out, or both ends of its farthest side (ring, other, side)."""
    wx, wy = way[:, None, :, None, 0], way[:, None, :, None, 1]
    x, y = corners[None, :, None, :, 0], corners[None, :, None, :, 1]
    out = wy * x - wx * y
    far = out == out.max(axis=-1, keepdims=True)
    on = wx * x + wy * y
    big = np.iinfo(np.int64).max
    other = np.arange(len(corners))[None, :, None]
    return corners[other, np.where(far, on, big).argmin(axis=-1)], corners[other, np.where(far, on, -big).argmax(axis=-1)]


def sides(fixed: tuple[np.ndarray, np.ndarray], moving: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """(fixed, moving, side, 4): the sides of convex.no_fit of each two padded rings, counter-clockwise, in no order; rings with fewer sides repeat one."""
    (a, a_end), (b, b_end) = fixed, (-moving[0], -moving[1])  # turned by 180 degrees
    n, m, of_a, of_b = len(a), len(b), a.shape[1], b.shape[1]
    out = np.empty((n, m, of_a + of_b, 4), np.int64)
    first, last = _farthest(a_end - a, b)
    out[:, :, :of_a, :2], out[:, :, :of_a, 2:] = a[:, None] + first, a_end[:, None] + last
    first, last = _farthest(b_end - b, a)
    out[:, :, of_a:, :2], out[:, :, of_a:, 2:] = b[None] + first.swapaxes(0, 1), b_end[None] + last.swapaxes(0, 1)
    # sides that both rings have are found twice, those that fill a row too: they go last, as far as they are needed
    again = (out[:, :, :, None] == out[:, :, None]).all(axis=-1)
    again = (again & np.tri(of_a + of_b, k=-1, dtype=bool)).any(axis=-1)
    most = int((~again).sum(axis=2).max())
    if most == of_a + of_b:
        return out
    order = np.argsort(again, axis=2, kind="stable")[:, :, :most]
    return out[np.arange(n)[:, None, None], np.arange(m)[None, :, None], order]


def sides_of_pairs(fixed: tuple[np.ndarray, np.ndarray], moving: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(pair, turn, side, 4): as sides, of the fixed ring of each pair (pair, corner, 2) with all turns of its moving one (pair, turn, corner, 2); and for each pair how many sides its rings have at most."""
    (a, a_end), (b, b_end) = fixed, (-moving[0], -moving[1])  # turned by 180 degrees
    n, m, of_a, of_b = len(a), b.shape[1], a.shape[1], b.shape[2]
    out = np.empty((n, m, of_a + of_b, 4), np.int64)
    big = np.iinfo(np.int64).max
    all_a = np.broadcast_to(a[:, None], (n, m, of_a, 2))
    for own, end, other, at in ((all_a, a_end[:, None], b, slice(0, of_a)), (b, b_end, all_a, slice(of_a, None))):
        way = end - own
        wx, wy, x, y = way[..., None, 0], way[..., None, 1], other[:, :, None, :, 0], other[:, :, None, :, 1]
        reach = wy * x - wx * y
        far = reach == reach.max(axis=-1, keepdims=True)
        on = wx * x + wy * y
        first, last = np.where(far, on, big).argmin(axis=-1), np.where(far, on, -big).argmax(axis=-1)
        out[:, :, at, :2] = own + np.take_along_axis(other, first[..., None], axis=2)
        out[:, :, at, 2:] = end + np.take_along_axis(other, last[..., None], axis=2)
    again = (out[:, :, :, None] == out[:, :, None]).all(axis=-1)
    again = (again & np.tri(of_a + of_b, k=-1, dtype=bool)).any(axis=-1)
    order = np.argsort(again, axis=2, kind="stable")
    return np.take_along_axis(out, order[..., None], axis=2), (~again).sum(axis=2).max(axis=1)
