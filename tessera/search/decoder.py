"""Greedy decoding of a job: pieces are placed one by one at the best legal contact point.

Candidate points of a piece are the corners of its no-fit rings with what is placed and the crossings of those rings,
each at the first of nine grid places that shares no area with a placed piece. Candidates are tested all at once with
whole-number cross products.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Generator
from dataclasses import dataclass, field
from fractions import Fraction
from typing import Any, NamedTuple

import numpy as np

from tessera.kernels import convex, no_fit
from tessera.kernels.regions import regions, regions_at

_AROUND = np.array(sorted(((i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)), key=lambda p: (p[0] ** 2 + p[1] ** 2, p)), dtype=np.int64)


@dataclass(frozen=True)
class Shape:
    """A piece: its collision ring and the transforms that it may take, as turned rings with their no-fit cache key."""

    id: str
    key: str
    turns: tuple[tuple[float, bool, tuple[convex.Point, ...]], ...]
    material: int


@dataclass
class Layout:
    ids: list[str] = field(default_factory=list)
    rings: list[convex.Ring] = field(default_factory=list)
    places: list[tuple[int, int, float, bool]] = field(default_factory=list)
    tokens: list[tuple[str, int]] = field(default_factory=list)
    unplaced: list[str] = field(default_factory=list)
    material: int = 0
    _boxes: list[tuple[int, int, int, int]] | None = field(default=None, repr=False, compare=False)

    @property
    def boxes(self) -> list[tuple[int, int, int, int]]:
        """Bounds of each ring. A layout is not changed once it is made."""
        if self._boxes is None:
            self._boxes = [convex.bounds(r) for r in self.rings]
        return self._boxes

    def bounds(self) -> tuple[int, int, int, int]:
        x0, y0, x1, y1 = zip(*self.boxes, strict=True)
        return min(x0), min(y0), max(x1), max(y1)

    def placed(self, shape: Shape, turn: int, x: int, y: int) -> Layout:
        degrees, mirrored, ring = shape.turns[turn]
        own = convex.moved(ring, x, y)
        return Layout([*self.ids, shape.id], [*self.rings, own], [*self.places, (x, y, degrees, mirrored)], [*self.tokens, (shape.key, turn)], self.unplaced, self.material + shape.material, [*self.boxes, convex.bounds(own)])

    def skipped(self, shape: Shape) -> Layout:
        return Layout(self.ids, self.rings, self.places, self.tokens, [*self.unplaced, shape.id], self.material, self._boxes)

    def anchored(self) -> Layout:
        if not self.rings:
            return self
        x0, y0, _, _ = self.bounds()
        if not x0 and not y0:
            return self
        boxes = [(a - x0, b - y0, c - x0, d - y0) for a, b, c, d in self.boxes]
        return Layout(self.ids, [convex.moved(r, -x0, -y0) for r in self.rings], [(x - x0, y - y0, d, m) for x, y, d, m in self.places], self.tokens, self.unplaced, self.material, boxes)

    def quarter(self, degrees: int) -> Layout:
        """The whole layout turned by 0, 90, 180 or 270 degrees and anchored."""
        spin = {0: lambda x, y: (x, y), 90: lambda x, y: (-y, x), 180: lambda x, y: (-x, -y), 270: lambda x, y: (y, -x)}[degrees]
        places = [(*spin(x, y), (d + degrees) % 360.0, m) for x, y, d, m in self.places]
        return Layout(self.ids, [convex.hull([spin(*p) for p in r]) for r in self.rings], places, self.tokens, self.unplaced, self.material).anchored()

    def identity(self) -> str:
        """The same for every order of placing and every quarter turn of the layout."""
        import hashlib

        texts = [";".join(sorted(",".join(f"{x}:{y}" for x, y in r) for r in self.quarter(q).rings)) for q in (0, 90, 180, 270)] if self.rings else [""]
        return hashlib.sha256(min(texts).encode()).hexdigest()


class Ask(NamedTuple):
    """What a search wants to have measured before it goes on."""

    search: Search
    layout: Layout
    shapes: dict[str, Shape]
    shape: Shape
    sheet: tuple[int, int] | None
    strip: bool


#: A search that stops at every Ask, to be sent the rows of Search._measured for it.
Steps = Generator[Ask, np.ndarray, Any]
#: Asks that are measured in the same array steps.
ASKS_A_STEP = 12


def alone(steps: Steps) -> Any:
    """The result of a search that measures for itself."""
    try:
        ask = next(steps)
        while True:
            ask = steps.send(ask.search._measured(*ask[1:]))
    except StopIteration as end:
        return end.value


def together(searches: list[Steps]) -> list:
    """Results of searches that go on side by side: what they ask for is measured in common array steps."""
    results: list = [None] * len(searches)
    asks: dict[int, Ask] = {}

    def on(k: int, found: np.ndarray | None) -> None:
        try:
            asks[k] = searches[k].send(found)
        except StopIteration as end:
            results[k] = end.value

    for k in range(len(searches)):
        on(k, None)
    while asks:
        groups: dict[tuple, list[int]] = {}
        for k, ask in asks.items():
            groups.setdefault((len(ask.layout.rings), ask.sheet is None), []).append(k)
        now, asks = asks, {}
        for (pieces, _), group in groups.items():
            for at in range(0, len(group), ASKS_A_STEP):
                some = group[at : at + ASKS_A_STEP]
                if pieces and len(some) > 1:
                    found = _measured_together([now[k] for k in some])
                else:
                    found = [now[k].search._measured(*now[k][1:]) for k in some]
                for k, rows in zip(some, found, strict=True):
                    on(k, rows)
    return results


def _widened(rows: np.ndarray, axis: int, n: int) -> np.ndarray:
    """n entries along an axis: missing ones repeat the last."""
    return rows if rows.shape[axis] == n else np.take(rows, np.minimum(np.arange(n), rows.shape[axis] - 1), axis=axis)


def _measured_together(asks: list[Ask]) -> list[np.ndarray]:
    """Search._measured of asks whose layouts have equally many pieces, either all with a sheet or none."""
    pairs = {}
    for ask in asks:
        ask.search._ask(ask.layout, ask.shape)
        for i, token in zip(ask.layout.ids, ask.layout.tokens, strict=True):
            if (token, ask.shape.key) not in ask.search._no_fit:
                pairs[id(ask.search), token, ask.shape.key] = ask, ask.shapes[i], token
    if pairs:
        fixed = [(of[0][t[1]], of[1][t[1]]) for ask, s, t in pairs.values() if (of := ask.search._corners(s))]
        moving = [ask.search._corners(ask.shape) for ask, _, _ in pairs.values()]
        of_a, of_b, most = max(len(f[0]) for f in fixed), max(m[0].shape[1] for m in moving), max(len(m[0]) for m in moving)
        # rings with fewer corners repeat their last side, shapes with fewer turns their last turn
        a = tuple(np.stack([_widened(f[k], 0, of_a) for f in fixed]) for k in (0, 1))
        b = tuple(np.stack([_widened(_widened(m[k], 1, of_b), 0, most) for m in moving]) for k in (0, 1))
        for (ask, _, token), sides, n in zip(pairs.values(), *no_fit.sides_of_pairs(a, b), strict=True):
            ask.search._no_fit[token, ask.shape.key] = sides[: len(ask.shape.turns), :n]
    turns, frames = [], []
    for ask in asks:
        box = ask.search.box(ask.shape)
        own = np.arange(len(box))
        if ask.sheet is not None:
            frame = np.stack([-box[:, 0], -box[:, 1], ask.sheet[0] - box[:, 2], ask.sheet[1] - box[:, 3]])
            own = own[(frame[0] <= frame[2]) & (frame[1] <= frame[3])]
            frames.append(frame[:, own])
        turns.append(own)
    begin = np.cumsum([0, *map(len, turns)])
    pieces, most = len(asks[0].layout.rings), max(ask.search._no_fit[t, ask.shape.key].shape[1] for ask in asks for t in ask.layout.tokens)
    walls = np.empty((begin[-1], pieces, most, 4), np.int64)
    for ask, own, r0, r1 in zip(asks, turns, begin[:-1], begin[1:], strict=True):
        for k, (token, (x, y, _, _)) in enumerate(zip(ask.layout.tokens, ask.layout.places, strict=True)):
            sides = ask.search._no_fit[token, ask.shape.key]
            n = sides.shape[1]
            walls[r0:r1, k, :n] = sides[own] + np.array((x, y, x, y))
            walls[r0:r1, k, n:] = walls[r0:r1, k, n - 1 : n]
    none = np.zeros(0, np.int64)
    t, x, y = _legal(walls, tuple(np.concatenate(frames, axis=1)) if frames else None) if begin[-1] else (none, none, none)
    out = []
    for ask, own, r0, p, q in zip(asks, turns, begin, *(lambda at: (at[:-1], at[1:]))(np.searchsorted(t, begin)), strict=False):
        out.append(ask.search._rows(ask.layout, ask.shape, own[t[p:q] - r0], x[p:q], y[p:q], ask.strip))
    return out


#: Scorings that a search remembers: decodings by other roles and in other orders begin alike.
REMEMBERED = 64


class Search:
    """No-fit rings are remembered by (shape, turn) pairs. Counts how often one was asked for and made, and the candidates that were scored."""

    def __init__(self) -> None:
        self._no_fit: dict[tuple, np.ndarray] = {}
        self._turns: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        self._asked: dict[tuple, int] = {}
        self._bounds: dict[str, np.ndarray] = {}
        self._boxes: dict[str, list[list[int]]] = {}
        #: Candidates and, by role, the one that it picks.
        self._scored: OrderedDict[tuple, tuple[np.ndarray, dict[str, tuple | None]]] = OrderedDict()
        self._touch: dict[tuple, float] = {}
        self.lookups, self.evaluated = 0, 0

    @property
    def hits(self) -> int:
        return self.lookups - sum(self._asked.values())

    def _ask(self, layout: Layout, shape: Shape) -> None:
        for token in layout.tokens:
            self._asked[token, shape.key] = len(shape.turns)
        self.lookups += len(layout.tokens) * len(shape.turns)

    def _walls(self, layout: Layout, shapes: dict[str, Shape], shape: Shape) -> np.ndarray:
        """(turn, placed piece, side, 4): sides of the no-fit rings, counter-clockwise; rings with fewer sides repeat one."""
        new = {t: self._corners(shapes[i]) for i, t in zip(layout.ids, layout.tokens, strict=True) if (t, shape.key) not in self._no_fit}
        if new:
            most = max(start.shape[1] for start, _ in new.values())
            # a ring with fewer corners repeats its last side
            fixed = tuple(np.stack([of[k][t[1], np.minimum(np.arange(most), of[k].shape[1] - 1)] for t, of in new.items()]) for k in (0, 1))
            found = no_fit.sides(fixed, self._corners(shape))
            self._no_fit |= {(t, shape.key): f for t, f in zip(new, found, strict=True)}
        rings = [self._no_fit[t, shape.key] for t in layout.tokens]
        most = max(r.shape[1] for r in rings)
        out = np.stack([r if r.shape[1] == most else r[:, np.minimum(np.arange(most), r.shape[1] - 1)] for r in rings], axis=1)
        return out + np.array([(x, y, x, y) for x, y, _, _ in layout.places], dtype=np.int64)[None, :, None, :]

    def _corners(self, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
        """Padded corners of each turn."""
        if shape.key not in self._turns:
            self._turns[shape.key] = no_fit.padded([r for _, _, r in shape.turns])
        return self._turns[shape.key]

    def box(self, shape: Shape) -> np.ndarray:
        """Bounds of each turn."""
        if shape.key not in self._bounds:
            self._bounds[shape.key] = np.array([convex.bounds(list(r)) for _, _, r in shape.turns], dtype=np.int64)
        return self._bounds[shape.key]

    def candidates(self, layout: Layout, shapes: dict[str, Shape], shape: Shape, turn: int, sheet: tuple[int, int] | None = None) -> np.ndarray:
        """Legal places (x, y) of the turned shape, by y, then x. With a sheet only those inside it."""
        t, x, y = self.places(layout, shapes, shape, sheet)
        return np.stack([x, y], axis=1)[t == turn]

    def places(self, layout: Layout, shapes: dict[str, Shape], shape: Shape, sheet: tuple[int, int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Turns, x and y of the legal places of all turns, by turn, y, x. With a sheet only those inside it."""
        self._ask(layout, shape)
        box = self.box(shape)
        turns = np.arange(len(box))
        a, b = -box[:, 0], -box[:, 1]
        if sheet is not None:
            c, d = sheet[0] - box[:, 2], sheet[1] - box[:, 3]
            turns = turns[(a <= c) & (b <= d)]
        if not layout.rings or not len(turns):
            return turns, a[turns], b[turns]
        t, x, y = _legal(self._walls(layout, shapes, shape)[turns], None if sheet is None else (a[turns], b[turns], c[turns], d[turns]))
        return turns[t], x, y

    def _measured(self, layout: Layout, shapes: dict[str, Shape], shape: Shape, sheet: tuple[int, int] | None = None, strip: bool = False) -> np.ndarray:
        """Rows of max side, area, span, turn, y, x: a column for every candidate of every transform; for a strip height, width, area, ..."""
        return self._rows(layout, shape, *self.places(layout, shapes, shape, sheet), strip)

    def _rows(self, layout: Layout, shape: Shape, t: np.ndarray, x: np.ndarray, y: np.ndarray, strip: bool = False) -> np.ndarray:
        box = self.box(shape)[t]
        lo_x, lo_y, hi_x, hi_y = x + box[:, 0], y + box[:, 1], x + box[:, 2], y + box[:, 3]
        if layout.rings:
            b = layout.bounds()
            lo_x, lo_y, hi_x, hi_y = np.minimum(lo_x, b[0]), np.minimum(lo_y, b[1]), np.maximum(hi_x, b[2]), np.maximum(hi_y, b[3])
        w, h = hi_x - lo_x, hi_y - lo_y
        return np.stack([*((h, w, w * h) if strip else (np.maximum(w, h), w * h, w + h)), t, y, x])

    def scored(self, layout: Layout, shapes: dict[str, Shape], shape: Shape, sheet: tuple[int, int] | None = None, strip: bool = False) -> list[tuple]:
        """(max side, area, span, turn, y, x) of every candidate of every transform; for a strip (height, width, area, ...)."""
        found = self._measured(layout, shapes, shape, sheet, strip)
        self.evaluated += found.shape[1]
        return _tuples(found)

    def _remembered(self, layout: Layout, shapes: dict[str, Shape], shape: Shape, sheet: tuple[int, int] | None, strip: bool) -> Steps:
        key = tuple(layout.tokens), tuple(layout.places), shape.key, sheet, strip
        if key in self._scored:
            self._ask(layout, shape)
            self._scored.move_to_end(key)
        else:
            self._scored[key] = (yield Ask(self, layout, shapes, shape, sheet, strip)), {}
            if len(self._scored) > REMEMBERED:
                self._scored.popitem(last=False)
        self.evaluated += self._scored[key][0].shape[1]
        return self._scored[key]

    def contact(self, layout: Layout, shape: Shape, c: tuple) -> float:
        """Contact of a candidate with all that is placed; that of two turned shapes depends only on where they stand to each other."""
        if shape.key not in self._boxes:
            self._boxes[shape.key] = self.box(shape).tolist()
        turn, y, x = c[3:]
        x0, y0, x1, y1 = self._boxes[shape.key][turn]
        x0, y0, x1, y1 = x0 + x, y0 + y, x1 + x, y1 + y
        found, touch = [], self._touch
        for k, o in enumerate(layout.boxes):
            if o[0] <= x1 and x0 <= o[2] and o[1] <= y1 and y0 <= o[3]:
                key = shape.key, turn, o[0] - x0, o[1] - y0, layout.tokens[k]
                if key not in touch:
                    touch[key] = convex.contact_length(convex.moved(shape.turns[turn][2], x, y), layout.rings[k])
                found.append(touch[key])
        return sum(found)

    @staticmethod
    def in_hull(layout: Layout, shape: Shape, found: list[tuple]) -> list[tuple]:
        """Candidates wholly inside the hull of what is placed: as they share no area with it, each lies in one gap."""
        if not layout.rings or not found:
            return []
        return _tuples(Search._within(convex.hull([p for r in layout.rings for p in r]), no_fit.padded([r for _, _, r in shape.turns])[0], np.array(found, dtype=np.int64).T))

    @staticmethod
    def _within(outer: convex.Ring, r: np.ndarray, found: np.ndarray) -> np.ndarray:
        ring = np.array(outer, dtype=np.int64)
        way = np.roll(ring, -1, axis=0) - ring
        # of each side, the corner of the turned shape that goes farthest out
        out_most = (way[None, :, None, 0] * r[:, None, :, 1] - way[None, :, None, 1] * r[:, None, :, 0]).min(axis=2)
        side = way[None, :, 0] * (found[4][:, None] - ring[None, :, 1]) - way[None, :, 1] * (found[5][:, None] - ring[None, :, 0])
        return found[:, (side + out_most[found[3]] >= 0).all(axis=1)]

    def best(self, layout: Layout, shapes: dict[str, Shape], shape: Shape, role: str, sheet: tuple[int, int] | None = None) -> tuple | None:
        """best_steps, alone."""
        return alone(self.best_steps(layout, shapes, shape, role, sheet))

    def best_steps(self, layout: Layout, shapes: dict[str, Shape], shape: Shape, role: str, sheet: tuple[int, int] | None = None) -> Steps:
        """pure-growth: max side, area, span, contact. area-first: area, max side, span, contact. contact-band: most contact among those with the leader's max side and an area within 2% of the piece's own.
        gap-contained: smallest gap of the hull that holds the piece, then contact, then as pure-growth, which decides where no gap does. strip: least height, then width."""
        found, picks = yield from self._remembered(layout, shapes, shape, sheet, role == "strip")
        if role not in picks:
            picks[role] = self._pick(found, layout, shape, role) if found.shape[1] else None
        return picks[role]

    def _pick(self, found: np.ndarray, layout: Layout, shape: Shape, role: str) -> tuple:
        if role == "gap-contained" and layout.rings:
            outer = convex.hull([p for r in layout.rings for p in r])
            held = _tuples(self._within(outer, self._corners(shape)[0], found))
            if held:
                gaps = regions_at(outer, layout.rings, [_centre(shape.turns[c[3]][2], c[5], c[4]) for c in held])
                least = min(gaps)
                return min((c for c, g in zip(held, gaps, strict=True) if g == least), key=lambda c: (-round(self.contact(layout, shape, c)), c))
        if role == "contact-band":
            leader = _leaders(found, (0, 1, 2))[:2, 0].tolist()
            own = abs(convex.doubled_area(list(shape.turns[0][2])))
            ties = _tuples(found[:, (found[0] == leader[0]) & (100 * found[1] <= 100 * leader[1] + own)])
            return min(ties, key=lambda c: (-round(self.contact(layout, shape, c)), c[1], c[2], c[3:]))
        ties = _tuples(_leaders(found, (1, 0, 2) if role == "area-first" else (0, 1, 2)))
        return min(ties, key=lambda c: (-round(self.contact(layout, shape, c)), c[3:])) if len(ties) > 1 else ties[0]

    def decode(self, order: list[Shape], shapes: dict[str, Shape], role: str = "pure-growth", start: Layout | None = None, sheet: tuple[int, int] | None = None) -> Layout:
        """decode_steps, alone."""
        return alone(self.decode_steps(order, shapes, role, start, sheet))

    def decode_steps(self, order: list[Shape], shapes: dict[str, Shape], role: str = "pure-growth", start: Layout | None = None, sheet: tuple[int, int] | None = None) -> Steps:
        """Places the pieces in order; without a sheet all of them, with one those that fit."""
        layout = start or Layout()
        for shape in order:
            c = yield from self.best_steps(layout, shapes, shape, role, sheet)
            layout = layout.placed(shape, c[3], c[5], c[4]) if c else layout.skipped(shape)
            if sheet is None:
                layout = layout.anchored()
        return layout


def _legal(walls: np.ndarray, frame: tuple[np.ndarray, ...] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, x and y of the legal places for each row of no-fit rings (row, placed piece, side, 4), by row, y, x. A frame holds the least and greatest x and y of each row: a, b, c, d."""
    _, pieces, most, _ = walls.shape
    edges = walls.reshape(len(walls), pieces * most, 4)
    lines, owner = edges, np.repeat(np.arange(pieces), most)
    if frame is not None:
        a, b, c, d = frame
        around = np.stack([a, b, c, b, c, b, c, d, c, d, a, d, a, d, a, b], axis=1).reshape(-1, 4, 4)
        lines, owner = np.concatenate([edges, around], axis=1), np.concatenate([owner, np.full(4, pieces)])
    t, x, y = _crossings(lines, owner)
    t = np.concatenate([np.repeat(np.arange(len(walls)), lines.shape[1]), t])
    x, y = np.concatenate([lines[:, :, 0].ravel(), x]), np.concatenate([lines[:, :, 1].ravel(), y])
    if frame is not None:
        near = (x >= a[t] - 1) & (x <= c[t] + 1) & (y >= b[t] - 1) & (y <= d[t] + 1)
        t, x, y = t[near], x[near], y[near]
    t, x, y = _distinct(t, x, y)
    dx, dy = edges[:, :, 2] - edges[:, :, 0], edges[:, :, 3] - edges[:, :, 1]
    off, reach = dy * edges[:, :, 0] - dx * edges[:, :, 1], np.abs(dx) + np.abs(dy)

    def blocked(side: np.ndarray) -> np.ndarray:
        return (side > 0).reshape(-1, pieces, most).all(axis=2).any(axis=1)

    # on which side of all sides of all no-fit rings points lie; a step by one moves each measure by a known amount
    side = dx[t] * y[:, None] - dy[t] * x[:, None] + off[t]
    # no step leads out of a ring from deeper than this
    open_ = np.flatnonzero(~blocked(side - reach[t]))
    t, x, y, side = t[open_], x[open_], y[open_], side[open_]
    found = []
    for i, j in _AROUND.tolist():
        if not len(t):
            break
        good = ~blocked(side + (dx * j - dy * i)[t] if i or j else side)
        if frame is not None:
            good &= (x + i >= a[t]) & (x + i <= c[t]) & (y + j >= b[t]) & (y + j <= d[t])
        found.append((t[good], x[good] + i, y[good] + j))
        t, x, y, side = t[~good], x[~good], y[~good], side[~good]
    t, x, y = _distinct(*(np.concatenate(v) for v in zip(*found, strict=True))) if found else (t, x, y)
    return t, x, y


def _centre(ring, x: int, y: int) -> tuple[Fraction, Fraction]:
    """Mean of the corners: inside a convex ring."""
    n = len(ring)
    return x + Fraction(sum(p[0] for p in ring), n), y + Fraction(sum(p[1] for p in ring), n)


def _tuples(found: np.ndarray) -> list[tuple]:
    return list(zip(*found.tolist(), strict=True))


def _leaders(found: np.ndarray, rows: tuple[int, ...]) -> np.ndarray:
    """Columns that are least by the rows, in their order."""
    for k in rows:
        found = found[:, found[k] == found[k].min()]
    return found


def _distinct(t: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each (t, x, y) once, by t, y, x."""
    if not len(t):
        return t, x, y
    x0, y0 = int(x.min()), int(y.min())
    wide, high = int(x.max()) - x0 + 1, int(y.max()) - y0 + 1
    if wide * high * (int(t.max()) + 1) >= 1 << 63:
        rows = np.unique(np.stack([t, y, x], axis=1), axis=0)
        return rows[:, 0], rows[:, 2], rows[:, 1]
    code = np.sort((t * high + (y - y0)) * wide + (x - x0))
    first = np.ones(len(code), dtype=bool)
    np.not_equal(code[1:], code[:-1], out=first[1:])
    code = code[first]
    rest, x = np.divmod(code, wide)
    t, y = np.divmod(rest, high)
    return t, x + x0, y + y0


def _crossings(lines: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Crossings of line segments of different owners, rounded to the grid, for each row of lines: row, x, y."""
    x1, y1, x2, y2 = (lines[:, :, k] for k in range(4))
    lo_x, hi_x, lo_y, hi_y = np.minimum(x1, x2), np.maximum(x1, x2), np.minimum(y1, y2), np.maximum(y1, y2)
    near = (owner[:, None] < owner[None, :])[None] & (lo_x[:, :, None] <= hi_x[:, None, :])
    near &= lo_x[:, None, :] <= hi_x[:, :, None]
    near &= lo_y[:, :, None] <= hi_y[:, None, :]
    near &= lo_y[:, None, :] <= hi_y[:, :, None]
    row, i, j = np.nonzero(near)
    dx, dy = x2 - x1, y2 - y1
    px, py, d0, d1, e0, e1 = x1[row, i], y1[row, i], dx[row, i], dy[row, i], dx[row, j], dy[row, j]
    g0, g1 = x1[row, j] - px, y1[row, j] - py
    den = d0 * e1 - d1 * e0
    t, u = g0 * e1 - g1 * e0, g0 * d1 - g1 * d0
    sign, size = np.sign(den), np.abs(den)
    t, u = t * sign, u * sign
    ok = np.flatnonzero((size != 0) & (t >= 0) & (t <= size) & (u >= 0) & (u <= size))
    f = t[ok] / size[ok]
    return row[ok], np.rint(px[ok] + d0[ok] * f).astype(np.int64), np.rint(py[ok] + d1[ok] * f).astype(np.int64)


def metrics(layout: Layout) -> dict:
    """Whole-number measures of a completed layout; fractions for areas that are not whole."""
    if not layout.rings:
        return {"placed": 0, "max_side": 0, "area": 0, "span": 0, "hull": 0, "waste": 0, "cavities": 0, "cavity_area": Fraction(0), "gap": Fraction(0), "components": 0, "isolated": 0, "largest": 0, "contact": 0.0}
    x0, y0, x1, y1 = layout.bounds()
    outer = convex.hull([p for r in layout.rings for p in r])
    hull, occupied = convex.doubled_area(outer), sum(convex.doubled_area(r) for r in layout.rings)
    left = regions(outer, layout.rings)
    n, top, contact = len(layout.rings), list(range(len(layout.rings))), 0.0

    def find(k: int) -> int:
        while top[k] != k:
            k = top[k]
        return k

    boxes = layout.boxes
    for i, b in enumerate(boxes):
        for j, o in enumerate(boxes[:i]):
            if o[0] > b[2] or b[0] > o[2] or o[1] > b[3] or b[1] > o[3]:
                continue
            c = convex.contact_length(layout.rings[i], layout.rings[j])
            contact += c
            if c > 0:
                top[find(i)] = find(j)
    size: dict[int, int] = {}
    for k in range(n):
        size[find(k)] = size.get(find(k), 0) + 1
    closed = [r for r in left if not r.open]
    w, h = x1 - x0, y1 - y0
    return {
        "placed": n,
        "max_side": max(w, h),
        "area": w * h,
        "span": w + h,
        "hull": hull,
        "waste": hull - occupied,
        "cavities": len(closed),
        "cavity_area": sum((r.doubled_area for r in closed), Fraction(0)),
        "gap": max((r.doubled_area for r in left), default=Fraction(0)),
        "components": len(size),
        "isolated": sum(v == 1 for v in size.values()),
        "largest": max(size.values()),
        "contact": contact,
    }


def fitting_turn(layout: Layout, sheet: tuple[int, int]) -> int | None:
    """0 or 90, whichever fits the sheet first; None if neither does."""
    x0, y0, x1, y1 = layout.bounds()
    w, h = x1 - x0, y1 - y0
    return 0 if w <= sheet[0] and h <= sheet[1] else 90 if h <= sheet[0] and w <= sheet[1] else None
