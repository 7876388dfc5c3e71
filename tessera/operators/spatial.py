"""Spatial joins, legality, contact and topology of layouts of grid-aligned boxes and of general convex rings."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.grid import BIG, wide

#: Side of a cell of the spatial index.
CELL = 64_000


def with_cells(boxes: DataFrame, cell: int = CELL) -> DataFrame:
    """One row for each cell (cx, cy) that a box (x, y, w, h), edges included, touches."""
    lo = lambda c: F.floor(c / cell).cast("long")
    xs = F.sequence(lo(F.col("x")), lo(F.col("x") + F.col("w")))
    ys = F.sequence(lo(F.col("y")), lo(F.col("y") + F.col("h")))
    return boxes.withColumn("cx", F.explode(xs)).withColumn("cy", F.explode(ys))


def near_pairs(boxes: DataFrame, cell: int = CELL) -> DataFrame:
    """Pairs (a before b by ord) of a job whose boxes overlap or touch: an equi-join on cells, once for each pair.

    A pair is reported in the cell of the lower left corner of what the boxes share, so no distinct is needed.
    """
    cols = ["ord", "piece_id", "x", "y", "w", "h"]
    cells = with_cells(boxes.select("job_id", *cols), cell)
    a = cells.select("job_id", "cx", "cy", *[F.col(c).alias(f"a_{c}") for c in cols])
    b = cells.select("job_id", "cx", "cy", *[F.col(c).alias(f"b_{c}") for c in cols])
    c = F.col
    touch = (c("a_x") <= c("b_x") + c("b_w")) & (c("b_x") <= c("a_x") + c("a_w")) & (c("a_y") <= c("b_y") + c("b_h")) & (c("b_y") <= c("a_y") + c("a_h"))
    home = (F.floor(F.greatest("a_x", "b_x") / cell) == c("cx")) & (F.floor(F.greatest("a_y", "b_y") / cell) == c("cy"))
    return a.join(b, ["job_id", "cx", "cy"]).where((c("a_ord") < c("b_ord")) & touch & home).drop("cx", "cy")


def overlap(pairs: DataFrame) -> DataFrame:
    """Adds the sides of what two boxes share."""
    c = F.col
    ox = F.least(c("a_x") + c("a_w"), c("b_x") + c("b_w")) - F.greatest("a_x", "b_x")
    oy = F.least(c("a_y") + c("a_h"), c("b_y") + c("b_h")) - F.greatest("a_y", "b_y")
    return pairs.withColumn("ox", ox).withColumn("oy", oy)


def conflicts(boxes: DataFrame) -> DataFrame:
    """Pairs that share area; touching is legal."""
    return overlap(near_pairs(boxes)).where("ox > 0 AND oy > 0").withColumn("overlap_area", (wide(F.col("ox")) * wide(F.col("oy"))).cast(BIG))


def contacts(boxes: DataFrame) -> DataFrame:
    """Pairs with a common boundary of positive length: contact is its length."""
    return overlap(near_pairs(boxes)).where("(ox = 0 AND oy > 0) OR (oy = 0 AND ox > 0)").withColumn("contact", F.greatest("ox", "oy"))


def structural_contacts(boxes: DataFrame) -> DataFrame:
    """Contacts along nearly all (95%) of the shorter edge, where both edges are at least half of their box's longest; with a signature free of position."""
    c = F.col
    edge_a = F.when(c("ox") == 0, c("a_h")).otherwise(c("a_w"))
    edge_b = F.when(c("ox") == 0, c("b_h")).otherwise(c("b_w"))
    out = contacts(boxes).withColumn("edge_a", edge_a).withColumn("edge_b", edge_b)
    long_enough = (2 * c("edge_a") >= F.greatest("a_w", "a_h")) & (2 * c("edge_b") >= F.greatest("b_w", "b_h"))
    out = out.where(long_enough & (100 * c("contact") >= 95 * F.least("edge_a", "edge_b")))
    return out.withColumn("signature", F.concat_ws(":", F.least("edge_a", "edge_b").cast("string"), F.greatest("edge_a", "edge_b").cast("string")))


def legality(sheet: DataFrame, boxes: DataFrame) -> DataFrame:
    """Per job: pieces outside the sheet, conflicting pairs and whether the layout is legal."""
    inside = boxes.join(sheet.select("job_id", "sheet_w", "sheet_h"), "job_id")
    out = F.count_if((F.col("x") < 0) | (F.col("y") < 0) | (F.col("x") + F.col("w") > F.col("sheet_w")) | (F.col("y") + F.col("h") > F.col("sheet_h")))
    walls = inside.groupBy("job_id").agg(out.alias("outside"), F.count(F.lit(1)).alias("placed"))
    bad = conflicts(boxes).groupBy("job_id").agg(F.count(F.lit(1)).alias("conflicts"))
    joined = walls.join(bad, "job_id", "left").withColumn("conflicts", F.coalesce("conflicts", F.lit(0)).cast("long"))
    return joined.withColumn("legal", (F.col("outside") == 0) & (F.col("conflicts") == 0))


def legal_candidates(candidates: DataFrame, placed: DataFrame) -> DataFrame:
    """Candidates (job_id, candidate_id, x, y, w, h) that share area with no placed box: an anti-join on cells."""
    c = with_cells(candidates).alias("c")
    p = with_cells(placed.select("job_id", "x", "y", "w", "h")).alias("p")
    hit = (F.col("c.job_id") == F.col("p.job_id")) & (F.col("c.cx") == F.col("p.cx")) & (F.col("c.cy") == F.col("p.cy"))
    share = (F.col("c.x") < F.col("p.x") + F.col("p.w")) & (F.col("p.x") < F.col("c.x") + F.col("c.w")) & (F.col("c.y") < F.col("p.y") + F.col("p.h")) & (F.col("p.y") < F.col("c.y") + F.col("c.h"))
    blocked = c.join(p, hit & share, "left_semi").select("job_id", "candidate_id").distinct()
    return candidates.join(blocked, ["job_id", "candidate_id"], "left_anti")


def envelope(boxes: DataFrame) -> DataFrame:
    c = F.col
    g = boxes.groupBy("job_id").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max(c("x") + c("w")).alias("x1"), F.max(c("y") + c("h")).alias("y1"), F.sum((wide(c("w")) * wide(c("h"))).cast(BIG)).cast(BIG).alias("occupied"))
    w, h = c("x1") - c("x0"), c("y1") - c("y0")
    return g.select("job_id", w.alias("width"), h.alias("height"), F.greatest(w, h).alias("max_side"), (w + h).alias("span"), (wide(w) * wide(h)).cast(BIG).alias("area"), "occupied")


def _label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (job_id, a, b) in the order of jobs; a piece's own row has a = b. Holds the pieces of one job at a time."""
    job, top, out = None, {}, ([], [], [])

    def find(x):
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    def settle():
        for x in top:
            out[0].append(job)
            out[1].append(x)
            out[2].append(find(x))
        top.clear()

    def batch():
        cols = [pa.array(c, pa.int64()) for c in out]
        for c in out:
            c.clear()
        return pa.RecordBatch.from_arrays(cols, names=["job_id", "ord", "component"])

    for rows in batches:
        for j, a, b in zip(*(c.to_pylist() for c in rows.columns), strict=True):
            if j != job:
                settle()
                job = j
            top.setdefault(a, a)
            top.setdefault(b, b)
            low, high = sorted((find(a), find(b)))
            top[high] = low
        yield batch()
    settle()
    yield batch()


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(job_id, ord, component): smallest ord reachable in the job over edges (job_id, a_ord, b_ord). A job is small, jobs are many:
    each partition takes whole jobs, sorted, one after the other."""
    rows = nodes.select("job_id", F.col("ord").alias("a"), F.col("ord").alias("b")).unionByName(edges.select("job_id", F.col("a_ord").alias("a"), F.col("b_ord").alias("b")))
    rows = rows.select(*[F.col(c).cast("long") for c in ("job_id", "a", "b")])
    return rows.repartition("job_id").sortWithinPartitions("job_id").mapInArrow(_label, "job_id long, ord long, component long")


def contact_graph(boxes: DataFrame) -> DataFrame:
    """Per job: components of the contact graph, isolated pieces and the largest component."""
    label = components(boxes, contacts(boxes))
    size = label.groupBy("job_id", "component").agg(F.count(F.lit(1)).alias("n"))
    return size.groupBy("job_id").agg(F.count(F.lit(1)).alias("components"), F.count_if(F.col("n") == 1).alias("isolated"), F.max("n").alias("largest"))


def inner_fit(sheet_w: Column, sheet_h: Column, min_x: Column, min_y: Column, max_x: Column, max_y: Column) -> Column:
    """Rectangle of reference points that keep a piece inside the sheet; null if there is none."""
    fit = F.struct((-min_x).alias("x0"), (-min_y).alias("y0"), (sheet_w - max_x).alias("x1"), (sheet_h - max_y).alias("y1"))
    return F.when((-min_x <= sheet_w - max_x) & (-min_y <= sheet_h - max_y), fit)


def grid_alternatives(x: Column, y: Column, step: int) -> Column:
    """The nine points of a coarse grid around (x, y), nearest first, then by gx and gy."""
    gx, gy = F.floor(x / step).cast("long"), F.floor(y / step).cast("long")
    spots = [F.struct(((gx + i) * step).alias("gx"), ((gy + j) * step).alias("gy")) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    far = F.transform(F.array(*spots), lambda p: F.struct(((p["gx"] - x) * (p["gx"] - x) + (p["gy"] - y) * (p["gy"] - y)).alias("d"), p["gx"].alias("gx"), p["gy"].alias("gy")))
    return F.array_sort(far)


def box_no_fit(fixed_w: Column, fixed_h: Column, moving_w: Column, moving_h: Column) -> Column:
    """No-fit rectangle of two boxes at the origin: reference points in its inside overlap."""
    return F.struct((-moving_w).alias("x0"), (-moving_h).alias("y0"), fixed_w.alias("x1"), fixed_h.alias("y1"))


def smallest_gap(candidates: DataFrame, gaps: DataFrame, cell: int = 4 * CELL) -> DataFrame:
    """The smallest gap (gap_id, gx, gy, gw, gh) that holds each candidate (candidate_id, x, y, w, h); candidates in none are left out.

    A gap is listed in the cells that it reaches; a candidate is looked up in that of its lower left corner only.
    """
    c = F.col
    inside = (c("x") >= c("gx")) & (c("y") >= c("gy")) & (c("x") + c("w") <= c("gx") + c("gw")) & (c("y") + c("h") <= c("gy") + c("gh"))
    lo = lambda v: F.floor(v / cell).cast("long")
    listed = gaps.withColumn("cx", F.explode(F.sequence(lo(c("gx")), lo(c("gx") + c("gw"))))).withColumn("cy", F.explode(F.sequence(lo(c("gy")), lo(c("gy") + c("gh")))))
    hits = candidates.withColumn("cx", lo(c("x"))).withColumn("cy", lo(c("y"))).join(listed, ["job_id", "cx", "cy"]).where(inside)
    return hits.groupBy("job_id", "candidate_id").agg(F.min_by("gap_id", F.struct(c("gw") * c("gh"), c("gap_id"))).alias("gap_id"))
