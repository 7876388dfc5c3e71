"""Column expressions of the layout grid: whole micrometres, exact areas and ratios, and the number rules of requests.

Coordinates are BIGINT micrometres. Areas are twice the polygon's, in DECIMAL(38,0) wherever a sum or a product of
areas could leave BIGINT. All expressions stay in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Grid steps per millimetre, steps of dimensionless scores, largest integer that a double holds exactly.
GRID = 1000
SCALAR = 1_000_000
SAFE = 9_007_199_254_740_991

BIG = "decimal(38,0)"


def is_safe_integer(x: Column) -> Column:
    return F.coalesce((x == F.floor(x)) & (F.abs(x) <= SAFE), F.lit(False))


def finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < float("inf"))


def half_away(x: Column, scale: int) -> Column:
    """x * scale rounded half away from zero; null unless the result is a safe integer."""
    units = F.signum(x) * F.floor(F.abs(x) * scale + 0.5)
    return F.when(finite(x) & (F.abs(units) <= SAFE), units.cast("long"))


def to_grid(mm: Column) -> Column:
    return half_away(mm, GRID)


def from_grid(units: Column) -> Column:
    return units / F.lit(float(GRID))


def score_units(mm: Column) -> Column:
    """Score grid of lengths."""
    return half_away(mm, GRID)


def score_scalar(x: Column) -> Column:
    """Score grid of dimensionless values, as whole millionths."""
    return half_away(x, SCALAR)


def round_half_up(x: Column) -> Column:
    """Half towards positive infinity."""
    return F.floor(x + 0.5)


def linear_metric(mm: Column) -> Column:
    return round_half_up(mm * 1000.0).cast("long")


def area_metric(mm2: Column) -> Column:
    return round_half_up(mm2 * 1_000_000.0).cast("long")


def fold_zero(x: Column) -> Column:
    """-0.0 becomes 0.0."""
    return x + F.lit(0.0)


def nan_max(a: Column, b: Column) -> Column:
    """Maximum in which NaN wins."""
    return F.when(F.isnan(a) | F.isnan(b), F.lit(float("nan"))).otherwise(F.greatest(a, b))


def nan_min(a: Column, b: Column) -> Column:
    return F.when(F.isnan(a) | F.isnan(b), F.lit(float("nan"))).otherwise(F.least(a, b))


def degrees(angle: Column) -> Column:
    """Into [0, 360)."""
    return fold_zero(F.pmod(angle, F.lit(360.0)))


def big(x: Column) -> Column:
    return x.cast(BIG)


def int_div(a: Column, b: Column) -> Column:
    """Whole-number division, towards zero, as BIGINT."""
    return F.call_function("div", a, b)


def ceil_ppm(numerator: Column, denominator: Column) -> Column:
    """Millionths of a ratio of whole numbers of at least 0, rounded up exactly."""
    n = (numerator.cast("decimal(31,0)") * F.lit(1_000_000).cast("decimal(7,0)")).cast(BIG)
    return int_div(n + denominator.cast("decimal(31,0)") - 1, denominator.cast("decimal(31,0)"))


def ratio_less(a: Column, b: Column, c: Column, d: Column) -> Column:
    """a / b < c / d for positive b and d, by cross-multiplication."""
    return wide(a) * wide(d) < wide(c) * wide(b)


def wide(x: Column) -> Column:
    """Such that a product of two is exact."""
    return x.cast("decimal(19,0)")


def point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def cyclic(ring: Column, k: Column) -> Column:
    """The point after k steps from the first, k from 0."""
    return F.element_at(ring, (F.pmod(k, F.size(ring)) + 1).cast("int"))


def indices(ring: Column) -> Column:
    return F.sequence(F.lit(0), F.size(ring) - 1)


def cross(o: Column, a: Column, b: Column) -> Column:
    return wide(a["x"] - o["x"]) * wide(b["y"] - o["y"]) - wide(a["y"] - o["y"]) * wide(b["x"] - o["x"])


def doubled_area(ring: Column) -> Column:
    """Signed, exact."""
    terms = F.transform(indices(ring), lambda k: (wide(cyclic(ring, k)["x"]) * wide(cyclic(ring, k + 1)["y"]) - wide(cyclic(ring, k + 1)["x"]) * wide(cyclic(ring, k)["y"])).cast(BIG))
    return F.aggregate(terms, F.lit(0).cast(BIG), lambda s, t: (s + t).cast(BIG))


def turns(ring: Column) -> Column:
    """Sign of the turn at each point."""
    return F.transform(indices(ring), lambda k: F.signum(cross(cyclic(ring, k), cyclic(ring, k + 1), cyclic(ring, k + 2)).cast("double")).cast("int"))


def convexity(ring: Column) -> Column:
    """convex, concave, or unknown when every turn is straight."""
    left, right = F.exists(turns(ring), lambda t: t > 0), F.exists(turns(ring), lambda t: t < 0)
    return F.when(left & right, "concave").when(left | right, "convex").otherwise("unknown")


def bounds(ring: Column) -> Column:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("min_x"), F.array_min(ys).alias("min_y"), F.array_max(xs).alias("max_x"), F.array_max(ys).alias("max_y"))


def translate(ring: Column, dx: Column, dy: Column) -> Column:
    return F.transform(ring, lambda p: point(p["x"] + dx, p["y"] + dy))


def quarter_turn(ring: Column, degrees_: Column, mirrored: Column) -> Column:
    """Mirror (x -> -x), then turn by 0, 90, 180 or 270 degrees, exactly."""
    flip = F.transform(ring, lambda p: point(F.when(mirrored, -p["x"]).otherwise(p["x"]), p["y"]))
    return F.transform(
        flip,
        lambda p: point(
            F.when(degrees_ == 0, p["x"]).when(degrees_ == 90, -p["y"]).when(degrees_ == 180, -p["x"]).otherwise(p["y"]),
            F.when(degrees_ == 0, p["y"]).when(degrees_ == 90, p["x"]).when(degrees_ == 180, -p["y"]).otherwise(-p["x"]),
        ),
    )


def bottom_left(ring: Column) -> Column:
    """Moved so that its smallest x and y are 0."""
    b = bounds(ring)
    return translate(ring, -b["min_x"], -b["min_y"])


def ring_key(ring: Column) -> Column:
    """The same text for a ring from any start and in either winding: the least of all its readings."""
    # the least reading starts with the least token, which is compared with the mark behind it as in a text; each token is written once
    tokens = F.transform(ring, lambda p: F.concat(p["x"].cast("string"), F.lit(","), p["y"].cast("string"), F.lit(";")))
    way = F.array(tokens, F.reverse(tokens))

    def readings(t: Column) -> Column:
        starts = F.filter(indices(t), lambda k: F.element_at(t, (k + 1).cast("int")) == F.array_min(t))
        return F.transform(starts, lambda k: F.array_join(F.concat(F.slice(t, (k + 1).cast("int"), F.size(t)), F.slice(t, F.lit(1), k.cast("int"))), ""))

    least = F.array_min(F.flatten(F.transform(way, readings)))
    return F.rtrim(least, F.lit(";"))


def contains_strictly(ring: Column, x: Column, y: Column) -> Column:
    """Whether (x, y) is inside a convex ring given counter-clockwise."""
    p = point(x, y)
    return F.forall(indices(ring), lambda k: cross(cyclic(ring, k), cyclic(ring, k + 1), p) > 0)


def natural_key(s: Column) -> Column:
    """A key whose byte order is the natural order of ids: numbers in them by value, then by their number of leading zeros.

    A run of digits becomes ``0`` (a digit sorts where it did), its significant length in three digits, its significant
    digits and its whole length. Runs of up to 999 digits.
    """
    parts = F.regexp_extract_all(s, F.lit("([0-9]+|[^0-9]+)"), F.lit(1))

    def key(p: Column) -> Column:
        significant = F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.when(p.rlike("^[0-9]"), F.concat(F.lit("0"), F.lpad(F.length(significant).cast("string"), 3, "0"), significant, F.lpad(F.length(p).cast("string"), 3, "0"))).otherwise(p)

    return F.array_join(F.transform(parts, key), "")


def utf16_key(s: Column) -> Column:
    """Sorts by UTF-16 code units."""
    return F.hex(F.encode(s, "UTF-16BE"))
