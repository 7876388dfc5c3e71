"""Lattices of boxes: legality of a cell's neighbours and crops of rows and columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.ordering import top_k


def box_lattice_is_legal(w: Column, h: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Whether none of the eight neighbours of a box by vectors a and b shares area with it."""
    moves = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0)]
    clear = F.lit(True)
    for i, j in moves:
        dx, dy = i * ax + j * bx, i * ay + j * by
        clear = clear & (((dx == 0) & (dy == 0)) | (F.abs(dx) >= w) | (F.abs(dy) >= h))
    return clear


def far_enough(w: Column, h: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Whether twice the shorter vector is longer than the box's diagonal, so that only the nearest neighbours can touch."""
    return 4 * F.least(ax * ax + ay * ay, bx * bx + by * by) > w * w + h * h


def crops(shapes: DataFrame) -> DataFrame:
    """shapes: piece_id, w, h, n. Every number of rows with the columns that n members need."""
    r = shapes.withColumn("rows", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    cols = F.call_function("div", F.col("n") + F.col("rows") - 1, F.col("rows"))
    return r.withColumn("cols", cols).withColumn("width", F.col("cols") * F.col("w")).withColumn("height", F.col("rows") * F.col("h"))


def best_crop(shapes: DataFrame) -> DataFrame:
    return top_k(crops(shapes), ["piece_id"], [F.greatest("width", "height").asc(), (F.col("width") * F.col("height")).asc(), (F.col("width") + F.col("height")).asc(), F.asc("rows")], 1)
