"""Boolean operations of polygon sets: union, intersection, difference and exclusive or, exact, as trapezoids.

Edges are cut at all vertices and crossings, so that in a slab between two abscissas no two edges cross. Winding numbers
of both sides are then counted upwards (non-zero rule), and every stretch that the operation keeps is a trapezoid.
"""

from __future__ import annotations

from fractions import Fraction

from tessera.kernels.convex import Ring

OPERATIONS = {"union": lambda a, b: a or b, "intersection": lambda a, b: a and b, "difference": lambda a, b: a and not b, "xor": lambda a, b: a != b}


def _crossing_xs(edges) -> set[Fraction]:
    out: set[Fraction] = set()
    for i, (a, b, *_) in enumerate(edges):
        for c, d, *_ in edges[i + 1 :]:
            if max(a[0], c[0]) >= min(b[0], d[0]):
                continue
            dx, dy, ex, ey = b[0] - a[0], b[1] - a[1], d[0] - c[0], d[1] - c[1]
            den = dx * ey - dy * ex
            if den:
                t = Fraction((c[0] - a[0]) * ey - (c[1] - a[1]) * ex, den)
                u = Fraction((c[0] - a[0]) * dy - (c[1] - a[1]) * dx, den)
                if 0 < t < 1 and 0 < u < 1:
                    out.add(a[0] + dx * t)
    return out


def trapezoids(operation: str, subject: list[Ring], clip: list[Ring]) -> list[tuple]:
    """(left, right, (bottom at left, at right), (top at left, at right)) of the result, from left, then from below."""
    keep = OPERATIONS[operation]
    edges = []
    for side, rings in enumerate((subject, clip)):
        for r in rings:
            for a, b in zip(r, r[1:] + r[:1], strict=True):
                if a[0] != b[0]:
                    edges.append((*((a, b) if a[0] < b[0] else (b, a)), side, 1 if a[0] < b[0] else -1))
    xs = sorted({Fraction(p[0]) for e in edges for p in e[:2]} | _crossing_xs(edges))
    out = []
    for left, right in zip(xs, xs[1:], strict=False):
        here = []
        for a, b, side, way in edges:
            if a[0] <= left and b[0] >= right:
                slope = Fraction(b[1] - a[1], b[0] - a[0])
                y0, y1 = a[1] + slope * (left - a[0]), a[1] + slope * (right - a[0])
                here.append((y0 + y1, y0, y1, side, way))
        here.sort()
        wind, bottom = [0, 0], None
        for _, y0, y1, side, way in here:
            was = keep(wind[0] != 0, wind[1] != 0)
            wind[side] += way
            now = keep(wind[0] != 0, wind[1] != 0)
            if now and not was:
                bottom = (y0, y1)
            elif was and not now and bottom != (y0, y1):
                out.append((left, right, bottom, (y0, y1)))
    return out


def doubled_area(parts: list[tuple]) -> Fraction:
    return sum(((right - left) * (sum(top) - sum(bottom)) for left, right, bottom, top in parts), Fraction(0))
