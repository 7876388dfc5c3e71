"""Sampling of arcs, bulges and ellipses by sag, and the points of a piece's outline."""

from __future__ import annotations

import math

#: First sweep of an ellipse and bounds of its subdivision.
FIRST_SWEEP = math.pi / 2
DEEPEST = 20
MOST_POINTS = 100_000


def steps(radius: float, sweep: float, sag: float) -> int:
    """Chords of an arc whose sagitta stays within sag."""
    if not radius > 0 or not sweep > 0:
        return 1
    step = 2.0 * math.acos(1.0 - min(sag, radius) / radius)
    return max(1, math.ceil(sweep / step)) if step > 0 else 1


def arc_points(x1: float, y1: float, x2: float, y2: float, cx: float, cy: float, radius: float, start: float, end: float, sag: float) -> list[tuple[float, float]]:
    """Counter-clockwise from start to end degrees; the end points are taken as given."""
    sweep = end - start if end > start else end - start + 360.0
    n = steps(radius, math.radians(sweep), sag)
    inner = [math.radians(start + sweep * k / n) for k in range(1, n)]
    return [(x1, y1), *((cx + radius * math.cos(a), cy + radius * math.sin(a)) for a in inner), (x2, y2)]


def bulge_points(x1: float, y1: float, x2: float, y2: float, bulge: float, sag: float) -> list[tuple[float, float]]:
    """The arc that a chord's bulge (tangent of a quarter of its angle, signed) stands for."""
    chord = math.hypot(x2 - x1, y2 - y1)
    if not chord or not bulge:
        return [(x1, y1), (x2, y2)]
    sweep, radius = 4.0 * math.atan(bulge), chord * (1.0 + bulge * bulge) / (4.0 * abs(bulge))
    away = chord * (1.0 - bulge * bulge) / (4.0 * bulge)
    cx, cy = (x1 + x2) / 2.0 - (y2 - y1) / chord * away, (y1 + y2) / 2.0 + (x2 - x1) / chord * away
    first, n = math.atan2(y1 - cy, x1 - cx), steps(radius, abs(sweep), sag)
    return [(x1, y1), *((cx + radius * math.cos(first + sweep * k / n), cy + radius * math.sin(first + sweep * k / n)) for k in range(1, n)), (x2, y2)]


def ellipse_point(e: dict, t: float) -> tuple[float, float]:
    c, s, r = math.cos(t), math.sin(t), e["axisRatio"]
    return e["cx"] + e["majorAxisX"] * c - e["majorAxisY"] * r * s, e["cy"] + e["majorAxisY"] * c + e["majorAxisX"] * r * s


def ellipse_sweep(start: float, end: float) -> float:
    return end - start if end > start else end + math.tau - start


def ellipse_points(e: dict, sag: float) -> list[tuple[float, float]]:
    """Quarter turns, halved until the curve is within sag of its chords."""
    sweep, major = ellipse_sweep(e["startAngle"], e["endAngle"]), math.hypot(e["majorAxisX"], e["majorAxisY"])
    if not sweep > 0 or not major > 0:
        return []
    n, longest = max(1, math.ceil(sweep / FIRST_SWEEP)), max(major, major * e["axisRatio"])
    first = ellipse_point(e, e["startAngle"])
    out = [first]

    def off(p, a, b) -> float:
        d = math.hypot(b[0] - a[0], b[1] - a[1])
        return abs((b[0] - a[0]) * (a[1] - p[1]) - (a[0] - p[0]) * (b[1] - a[1])) / d if d else math.hypot(p[0] - a[0], p[1] - a[1])

    def walk(s: float, t: float, a, b, depth: int) -> None:
        if depth < DEEPEST and len(out) < MOST_POINTS and longest * (t - s) ** 2 / 8.0 > sag and max(off(ellipse_point(e, s + (t - s) * q), a, b) for q in (0.25, 0.5, 0.75)) > sag:
            middle = (s + t) / 2.0
            m = ellipse_point(e, middle)
            walk(s, middle, a, m, depth + 1)
            walk(middle, t, m, b, depth + 1)
        else:
            out.append(b)

    last = first
    for k in range(n):
        s, t = e["startAngle"] + sweep * k / n, e["startAngle"] + sweep * (k + 1) / n
        end = first if k == n - 1 and abs(sweep - math.tau) <= 1e-9 else ellipse_point(e, t)
        walk(s, t, last, end, 0)
        last = end
    return out


def outline_points(segments: list[dict], sag: float = 0.25) -> list[tuple[float, float]]:
    """Points of an outline's segments, each micrometre place once; the chords of one ellipse are sampled as that ellipse, once."""
    out: dict[tuple[int, int], tuple[float, float]] = {}
    curves = set()
    for s in segments:
        curve = s.get("sourceCurve")
        if s["kind"] == "arc":
            points = arc_points(s["x1"], s["y1"], s["x2"], s["y2"], s["cx"], s["cy"], s["radius"], s["startAngle"], s["endAngle"], sag)
        elif curve:
            if curve["sourceId"] in curves:
                continue
            curves.add(curve["sourceId"])
            points = ellipse_points(curve, sag)
        elif s.get("bulge"):
            points = bulge_points(s["x1"], s["y1"], s["x2"], s["y2"], s["bulge"], sag)
        else:
            points = [(s["x1"], s["y1"]), (s["x2"], s["y2"])]
        for x, y in points:
            out.setdefault((round(x * 1000), round(y * 1000)), (x, y))
    return list(out.values())
