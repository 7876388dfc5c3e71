"""Edges of placed rings: explosion, intersections, antiparallel supports and collinear contact, all as joins in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.grid import bounds, cyclic, indices, wide

#: Side of a cell of the index of edges.
CELL = 128_000


def edges(rings: DataFrame) -> DataFrame:
    """rings: job_id, ord, ring. A row for each edge from (x1, y1) to (x2, y2) with its number and box."""
    e = rings.select("job_id", "ord", "ring", F.explode(indices(F.col("ring"))).alias("edge"))
    a, b = cyclic(F.col("ring"), F.col("edge")), cyclic(F.col("ring"), F.col("edge") + 1)
    out = e.select("job_id", "ord", F.col("edge").cast("long").alias("edge"), a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2"))
    return out.withColumns({"lx": F.least("x1", "x2"), "hx": F.greatest("x1", "x2"), "ly": F.least("y1", "y2"), "hy": F.greatest("y1", "y2")})


def _pairs(one: DataFrame, two: DataFrame, ordered: bool) -> DataFrame:
    """Edge pairs of different rings of a job whose boxes meet: an equi-join on cells, each pair in the cell of the lower left corner of what the boxes share."""
    cols = ["ord", "edge", "x1", "y1", "x2", "y2", "lx", "hx", "ly", "hy"]
    at = lambda v: F.floor(v / CELL).cast("long")
    cells = lambda e: e.withColumn("cx", F.explode(F.sequence(at(F.col("lx")), at(F.col("hx"))))).withColumn("cy", F.explode(F.sequence(at(F.col("ly")), at(F.col("hy")))))
    a = cells(one).select("job_id", "cx", "cy", *[F.col(c).alias(f"a_{c}") for c in cols])
    b = cells(two).select("job_id", "cx", "cy", *[F.col(c).alias(f"b_{c}") for c in cols])
    c = F.col
    which = c("a_ord") < c("b_ord") if ordered else c("a_ord") != c("b_ord")
    meet = (c("a_lx") <= c("b_hx")) & (c("b_lx") <= c("a_hx")) & (c("a_ly") <= c("b_hy")) & (c("b_ly") <= c("a_hy"))
    home = (at(F.greatest("a_lx", "b_lx")) == c("cx")) & (at(F.greatest("a_ly", "b_ly")) == c("cy"))
    return a.join(b, ["job_id", "cx", "cy"]).where(which & meet & home).drop("cx", "cy")


def _pairs_of_rings(rings: DataFrame) -> DataFrame:
    """Edge pairs of different rings of a job (a before b by ord) whose boxes meet, of those rings whose own boxes share area: edges that properly cross lie in no other.
    Rings are paired first, so that edges arise only of rings that can cross."""
    at = lambda v: F.floor(v / CELL).cast("long")
    box = bounds(F.col("ring"))
    r = rings.select("job_id", "ord", "ring", *[box[f"{m}_{v}"].alias(f"{m}_{v}") for m in ("min", "max") for v in "xy"])
    cells = r.withColumn("cx", F.explode(F.sequence(at(F.col("min_x")), at(F.col("max_x"))))).withColumn("cy", F.explode(F.sequence(at(F.col("min_y")), at(F.col("max_y")))))
    a, b = (cells.select("job_id", "cx", "cy", *[F.col(c).alias(f"{side}_{c}") for c in r.columns[1:]]) for side in "ab")
    c = F.col
    share = (c("a_min_x") < c("b_max_x")) & (c("b_min_x") < c("a_max_x")) & (c("a_min_y") < c("b_max_y")) & (c("b_min_y") < c("a_max_y"))
    home = (at(F.greatest("a_min_x", "b_min_x")) == c("cx")) & (at(F.greatest("a_min_y", "b_min_y")) == c("cy"))
    pairs = a.join(b, ["job_id", "cx", "cy"]).where((c("a_ord") < c("b_ord")) & share & home).select("job_id", "a_ord", "b_ord", "a_ring", "b_ring")
    for side in "ab":
        pairs = pairs.withColumn(f"{side}_edge", F.explode(indices(c(f"{side}_ring")))).withColumn(f"{side}_edge", c(f"{side}_edge").cast("long"))
        p, q = cyclic(c(f"{side}_ring"), c(f"{side}_edge")), cyclic(c(f"{side}_ring"), c(f"{side}_edge") + 1)
        pairs = pairs.withColumns({f"{side}_x1": p["x"], f"{side}_y1": p["y"], f"{side}_x2": q["x"], f"{side}_y2": q["y"]})
    return pairs.drop("a_ring", "b_ring")


def _cross(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return wide(ax) * wide(by) - wide(ay) * wide(bx)


def _d(side: str) -> tuple[Column, Column]:
    return F.col(f"{side}_x2") - F.col(f"{side}_x1"), F.col(f"{side}_y2") - F.col(f"{side}_y1")


def crossings(rings: DataFrame) -> DataFrame:
    """Points in which edges of different rings of a job properly cross, rounded to the grid."""
    p = _pairs_of_rings(rings)
    (ax, ay), (bx, by) = _d("a"), _d("b")
    gx, gy = F.col("b_x1") - F.col("a_x1"), F.col("b_y1") - F.col("a_y1")
    den, t, u = _cross(ax, ay, bx, by), _cross(gx, gy, bx, by), _cross(gx, gy, ax, ay)
    p = p.withColumns({"den": den, "t": t, "u": u})
    s = F.signum("den")
    inside = (F.col("den") != 0) & (F.col("t") * s > 0) & (F.col("t") * s < F.abs("den")) & (F.col("u") * s > 0) & (F.col("u") * s < F.abs("den"))
    f = F.col("t").cast("double") / F.col("den").cast("double")
    place = lambda start, d: F.floor(F.col(start) + d * f + 0.5).cast("long")
    return p.where(inside).select("job_id", "a_ord", "b_ord", "a_edge", "b_edge", place("a_x1", ax).alias("x"), place("a_y1", ay).alias("y"))


def antiparallel(rings: DataFrame) -> DataFrame:
    """Edge pairs of different rings that run in exactly opposite directions: the second can lie along the first."""
    e = edges(rings)
    a = e.select("job_id", F.col("ord").alias("fixed_ord"), F.col("edge").alias("fixed_edge"), (F.col("x2") - F.col("x1")).alias("dx"), (F.col("y2") - F.col("y1")).alias("dy"))
    b = e.select("job_id", F.col("ord").alias("moving_ord"), F.col("edge").alias("moving_edge"), (F.col("x1") - F.col("x2")).alias("ex"), (F.col("y1") - F.col("y2")).alias("ey"))
    # an equi-join on the octant narrows the exact test
    octant = lambda x, y: F.concat(F.signum(x).cast("int"), F.signum(y).cast("int"), F.signum(F.abs(x) - F.abs(y)).cast("int"))
    j = a.withColumn("o", octant(F.col("dx"), F.col("dy"))).join(b.withColumn("o", octant(F.col("ex"), F.col("ey"))), ["job_id", "o"])
    return j.where((F.col("fixed_ord") != F.col("moving_ord")) & (_cross(F.col("dx"), F.col("dy"), F.col("ex"), F.col("ey")) == 0)).select("job_id", "fixed_ord", "fixed_edge", "moving_ord", "moving_edge")


def collinear_contacts(rings: DataFrame) -> DataFrame:
    """Edge pairs of different rings on one line that share a piece of it: its length along the longer axis, exact."""
    e = edges(rings)
    p = _pairs(e, e, True)
    (ax, ay), (bx, by) = _d("a"), _d("b")
    on_line = (_cross(ax, ay, bx, by) == 0) & (_cross(ax, ay, F.col("b_x1") - F.col("a_x1"), F.col("b_y1") - F.col("a_y1")) == 0)
    ox, oy = F.least("a_hx", "b_hx") - F.greatest("a_lx", "b_lx"), F.least("a_hy", "b_hy") - F.greatest("a_ly", "b_ly")
    return p.where(on_line & ((ox > 0) | (oy > 0))).select("job_id", "a_ord", "b_ord", "a_edge", "b_edge", F.greatest(ox, oy).alias("axis_units"))
