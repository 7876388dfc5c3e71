"""Identities of layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.grid import bounds, quarter_turn, ring_key, translate


def layout_identity(boxes: DataFrame) -> DataFrame:
    """SHA-256 of a job's boxes, moved so that the layout starts at (0, 0) and sorted: the same wherever it lies and in whatever order it was placed."""
    w = Window.partitionBy("job_id")
    x, y = F.col("x") - F.min("x").over(w), F.col("y") - F.min("y").over(w)
    moved = boxes.select("job_id", F.struct(x.alias("x"), y.alias("y"), F.col("w"), F.col("h")).alias("b"))
    text = F.transform(F.array_sort(F.collect_list("b")), lambda b: F.concat_ws(",", *[b[k].cast("string") for k in "xywh"]))
    return moved.groupBy("job_id").agg(F.sha2(F.array_join(text, ";"), 256).alias("layout_hash"))


def ring_layout_identity(rings: DataFrame) -> DataFrame:
    """SHA-256 of a job's rings (job_id, ring): the same for a layout wherever it lies, in whatever order its pieces were placed, from whatever
    corner and in whatever winding a ring is read, and turned by whichever quarter. Other shapes with equal boxes differ.

    Each of the four turns is moved to (0, 0) and read as the sorted texts of its rings; the least of the four is hashed.
    """
    turned = rings.withColumn("turn", F.explode(F.array(*map(F.lit, (0, 90, 180, 270))))).select("job_id", "turn", quarter_turn(F.col("ring"), F.col("turn"), F.lit(False)).alias("ring"))
    low = bounds(F.col("ring"))
    layouts = turned.groupBy("job_id", "turn").agg(F.collect_list("ring").alias("rings"), F.min(low["min_x"]).alias("x0"), F.min(low["min_y"]).alias("y0"))
    # moved first, so that reading a ring from all its corners does not move it again for each point
    moved = F.transform("rings", lambda r: translate(r, -F.col("x0"), -F.col("y0")))
    text = F.array_join(F.array_sort(F.transform(moved, ring_key)), "|")
    return layouts.groupBy("job_id").agg(F.sha2(F.min(text), 256).alias("layout_hash"))
