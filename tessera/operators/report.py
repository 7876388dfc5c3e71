"""Reports on instances and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.grid import BIG, convexity, doubled_area, int_div


def summarize(sources: DataFrame) -> DataFrame:
    """Vertices, exact doubled area and convexity of each ring."""
    r = F.col("ring")
    return sources.withColumn("vertices", F.size(r).cast("long")).withColumn("doubled_area", F.abs(doubled_area(r))).withColumn("convexity", convexity(r))


def benchmark(jobs: DataFrame, pieces: DataFrame, shapes: DataFrame) -> DataFrame:
    """Counts of a job's pieces and sources and what its run placed; utilization in millionths of the sheet.

    pieces: job_id, piece_id, placed. shapes: piece_id, vertices, doubled_area. A piece without a shape makes the sums null.
    """
    j = pieces.join(shapes, "piece_id", "left")
    g = j.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("part_count"),
        F.countDistinct("piece_id").alias("source_count"),
        F.when(F.count_if(F.col("vertices").isNull()) == 0, F.sum("vertices")).cast("long").alias("vertex_count"),
        F.count_if("placed").alias("placed_count"),
        F.count_if(~F.col("placed")).alias("unplaced_count"),
        F.bool_and("placed").alias("complete"),
        F.when(F.count_if(F.col("placed") & F.col("doubled_area").isNull()) == 0, F.coalesce(F.sum(F.when(F.col("placed"), F.col("doubled_area"))), F.lit(0))).cast(BIG).alias("_area"),
    )
    sheet = F.col("sheet_w").cast("decimal(18,0)") * F.col("sheet_h").cast("decimal(18,0)") * 2
    return g.join(jobs.select("job_id", "sheet_w", "sheet_h"), "job_id").withColumn("utilization_ppm", int_div((F.col("_area").cast("decimal(31,0)") * F.lit(1_000_000).cast("decimal(7,0)")).cast(BIG), sheet.cast("decimal(38,0)"))).drop("_area", "sheet_w", "sheet_h")
