"""The beam of box layouts for many jobs at once, all depths in one go: states are rows of whole-number arrays.

The same states, orders and ties as ``operators.beam.step``, whose keys (SHA-256 of a state's text) are only made where a
window cuts through states of equal measure. Two states of a job are one if their counts, materials and envelopes and the
64-bit sums over their boxes agree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np

#: Sides of sheets must lie below, so that two fit in a whole number.
LIMIT = 1 << 31


def state_key(boxes: list[tuple[int, int, int, int]]) -> bytes:
    """As step's state_key, as bytes: the same order."""
    text = ",".join(f'{{"x":{x},"y":{y},"w":{w},"h":{h}}}' for x, y, w, h in sorted(boxes))
    return hashlib.sha256(f"[{text}]".encode()).digest()


def _mix(x: np.ndarray, y: np.ndarray, w: np.ndarray, h: np.ndarray) -> np.ndarray:
    def scattered(v: np.ndarray) -> np.ndarray:
        v = (v ^ (v >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        v = (v ^ (v >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return v ^ (v >> np.uint64(31))

    low = scattered((x << 32 | y).astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    return scattered(low * np.uint64(3) + (w << 32 | h).astype(np.uint64))


def _first(group: np.ndarray, tie: np.ndarray, k: int, keys: Callable[[np.ndarray], list[bytes]]) -> np.ndarray:
    """Which rows are among the first k of their group. Rows are in order of group and tie; equal ties go by their keys."""
    n = len(group)
    head = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[head, n])
    long = np.flatnonzero(size > k)
    out = np.ones(n, bool)
    if not len(long):
        return out
    last = np.zeros(len(head), np.int64)
    last[long] = tie[head[long] + k - 1]
    cut, of = np.repeat(np.where(size > k, last, np.iinfo(np.int64).max), size), np.repeat(np.arange(len(head)), size)
    out = tie <= cut
    over = np.bincount(of[out], minlength=len(head)) - k
    at = np.flatnonzero((tie == cut) & (over[of] > 0) & (size[of] > k))
    if len(at):
        key, where = keys(at), of[at]
        bounds = np.flatnonzero(np.r_[True, where[1:] != where[:-1], True])
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            worst = sorted(range(a, b), key=key.__getitem__)[b - a - int(over[where[a]]) :]
            out[at[worst]] = False
    return out


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Running number of runs of equal rows."""
    new = np.zeros(len(columns[0]), bool)
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.cumsum(new)


def _search(sheet: np.ndarray, pieces: np.ndarray, count: np.ndarray, fanout: int, width: int, skipping: bool) -> dict[int, tuple[int, int, int, int]]:
    """(placed, material, width, height) of the best state of each job, by the job's place."""
    out: dict[int, tuple[int, int, int, int]] = {}
    job = np.arange(len(count))
    box = np.zeros((len(count), 4, 0), np.int64)
    n, material, wide, high = (np.zeros(len(count), np.int64) for _ in range(4))
    mixed = np.zeros(len(count), np.uint64)
    for j in np.flatnonzero(count == 0).tolist():
        out[j] = (0, 0, 0, 0)
    go = count[job] > 0
    depth = 0
    while go.any():
        job, box, n, material, wide, high, mixed = (a[go] for a in (job, box, n, material, wide, high, mixed))
        w, h = pieces[job, depth].T
        X, Y, W, H = box[:, 0], box[:, 1], box[:, 2], box[:, 3]
        zero = np.zeros((len(job), 1), np.int64)
        right, top = X + W, Y + H
        spots = np.sort(np.concatenate([zero, right << 32 | Y, X << 32 | top, right << 32, top], axis=1), axis=1)
        fresh = np.ones(spots.shape, bool)
        fresh[:, 1:] = spots[:, 1:] != spots[:, :-1]
        state, at = np.nonzero(fresh)
        spot = spots[state, at]
        both = np.flatnonzero(w[state] != h[state])
        cw, ch = np.concatenate([w[state], h[state[both]]]), np.concatenate([h[state], w[state[both]]])
        state, spot = np.concatenate([state, state[both]]), np.concatenate([spot, spot[both]])
        x, y = spot >> 32, spot & 0xFFFFFFFF
        fits = (x + cw <= sheet[job[state], 0]) & (y + ch <= sheet[job[state], 1])
        state, x, y, cw, ch = (a[fits] for a in (state, x, y, cw, ch))
        x1, y1 = x + cw, y + ch
        for k in range(box.shape[2]):
            clear = ~((x < right[state, k]) & (X[state, k] < x1) & (y < top[state, k]) & (Y[state, k] < y1))
            state, x, y, cw, ch, x1, y1 = (a[clear] for a in (state, x, y, cw, ch, x1, y1))
        nw, nh = np.maximum(wide[state], x1), np.maximum(high[state], y1)
        # of equal longest sides, area and span both grow with the shorter one
        size = np.maximum(nw, nh) << 32 | np.minimum(nw, nh)

        def boxes_of(s: np.ndarray, new: list) -> list[bytes]:
            held = box[s].transpose(0, 2, 1).tolist()
            return [state_key([*map(tuple, b[:m]), *extra]) for b, m, extra in zip(held, n[s].tolist(), new, strict=True)]

        last = count[job] == depth + 1
        order = np.lexsort((size, state))
        state, x, y, cw, ch, nw, nh, size = (a[order] for a in (state, x, y, cw, ch, nw, nh, size))
        # in a job's last step only its best state counts, which is the best of all successors
        ends = last[state]
        keep = np.ones(len(state), bool)
        mid = np.flatnonzero(~ends)
        if len(mid):
            keep[mid] = _first(state[mid], _changes(state[mid], size[mid]), fanout, lambda i: boxes_of(state[mid[i]], [[c] for c in zip(x[mid[i]].tolist(), y[mid[i]].tolist(), cw[mid[i]].tolist(), ch[mid[i]].tolist(), strict=True)]))
        if len(ends):
            # the least envelope of each state
            least = np.r_[True, state[1:] != state[:-1]]
            first = size[np.flatnonzero(least)][np.cumsum(least) - 1]
            keep &= ~ends | (size == first)
        state, x, y, cw, ch, nw, nh, size = (a[keep] for a in (state, x, y, cw, ch, nw, nh, size))
        new = np.stack([x, y, cw, ch], axis=1)
        parent, has = state, np.ones(len(state), bool)
        s_n, s_m, s_mix = n[state] + 1, material[state] + 2 * cw * ch, mixed[state] + _mix(x, y, cw, ch)
        if skipping:
            every = np.arange(len(job))
            parent, has = np.concatenate([parent, every]), np.concatenate([has, np.zeros(len(job), bool)])
            new = np.concatenate([new, np.zeros((len(job), 4), np.int64)])
            nw, nh, s_n, s_m, s_mix = np.concatenate([nw, wide]), np.concatenate([nh, high]), np.concatenate([s_n, n]), np.concatenate([s_m, material]), np.concatenate([s_mix, mixed])
            size = np.concatenate([size, np.maximum(wide, high) << 32 | np.minimum(wide, high)])
        order = np.lexsort((s_mix, size, -s_m, -s_n, job[parent]))
        parent, has, new, nw, nh, s_n, s_m, s_mix, size = (a[order] for a in (parent, has, new, nw, nh, s_n, s_m, s_mix, size))
        own = job[parent]
        tie = _changes(own, s_n, s_m, size)
        single = np.r_[True, (tie[1:] != tie[:-1]) | (s_mix[1:] != s_mix[:-1])][: len(tie)]
        parent, has, new, nw, nh, s_n, s_m, s_mix, own, tie = (a[single] for a in (parent, has, new, nw, nh, s_n, s_m, s_mix, own, tie))
        keep, ends = np.zeros(len(own), bool), last[parent]
        for most, which in ((width, np.flatnonzero(~ends)), (1, np.flatnonzero(ends))):
            if len(which):
                keep[which] = _first(own[which], tie[which], most, lambda i, which=which: boxes_of(parent[which[i]], [[tuple(c)] if f else [] for c, f in zip(new[which[i]].tolist(), has[which[i]].tolist(), strict=True)]))
        parent, has, new, nw, nh, s_n, s_m, s_mix, own = (a[keep] for a in (parent, has, new, nw, nh, s_n, s_m, s_mix, own))
        ends = last[parent]
        for j, *found in zip(own[ends].tolist(), s_n[ends].tolist(), s_m[ends].tolist(), nw[ends].tolist(), nh[ends].tolist(), strict=True):
            out[j] = tuple(found)
        # boxes stand at the front: what is left out leaves zeros behind, which cover nothing and whose corners are the sheet's
        held = np.concatenate([box[parent], np.zeros((len(parent), 4, 1), np.int64)], axis=2)
        rows = np.flatnonzero(has)
        held[rows, :, n[parent[rows]]] = new[rows]
        job, box, n, material, wide, high, mixed, go = own, held, s_n, s_m, nw, nh, s_mix, ~ends
        depth += 1
    return out


def best_states(sheet: np.ndarray, pieces: np.ndarray, count: np.ndarray, fanout: int = 3, width: int = 16) -> np.ndarray:
    """(placed, material, width, height) of each job's best state. sheet: jobs x 2, pieces: jobs x most pieces x 2, in order, count: pieces of each job.

    States that left nothing out come first in every window and arise only from each other, so they are searched alone;
    only jobs in which none of them lasts are searched with all states.
    """
    if len(sheet) and sheet.max() >= LIMIT:
        raise ValueError("a sheet's side is 2^31 or more")
    # what lies beyond never fits, whatever its size
    pieces = np.where((pieces < LIMIT).all(axis=2, keepdims=True), pieces, LIMIT)
    out = np.zeros((len(count), 4), np.int64)
    found = _search(sheet, pieces, count, fanout, width, False)
    rest = np.array([j for j in range(len(count)) if j not in found], dtype=np.int64)
    if len(rest):
        found |= {int(rest[j]): v for j, v in _search(sheet[rest], pieces[rest], count[rest], fanout, width, True).items()}
    for j, v in found.items():
        out[j] = v
    return out
