"""Chords of arcs as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def arc_chords(radius: Column, sweep_degrees: Column, sag: float) -> Column:
    """Number of chords that keep an arc's sagitta within sag; at least 1."""
    step = 2.0 * F.acos(1.0 - F.least(F.lit(sag), radius) / radius)
    return F.greatest(F.lit(1), F.ceil(sweep_degrees * (math.pi / 180.0) / step)).cast("long")


def arc_points(cx: Column, cy: Column, radius: Column, start: Column, sweep: Column, sag: float) -> Column:
    """Points of an arc, its ends included, counter-clockwise."""
    n = arc_chords(radius, sweep, sag)
    angle = lambda k: F.radians(start + sweep * k / n)
    return F.transform(F.sequence(F.lit(0).cast("long"), n), lambda k: F.struct((cx + radius * F.cos(angle(k))).alias("x"), (cy + radius * F.sin(angle(k))).alias("y")))
