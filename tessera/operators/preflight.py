"""Proof that a job cannot be complete, before any search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.grid import BIG, bounds, ceil_ppm, doubled_area, quarter_turn


def expand_quarter_turns(pieces: DataFrame, turns: tuple[int, ...] = (0, 90, 180, 270), mirror: bool = False) -> DataFrame:
    """One row for each transform of each piece: index, rotation and mirrored."""
    options = [(k, m) for m in ((False, True) if mirror else (False,)) for k in turns]
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("index"), F.lit(k).alias("rotation"), F.lit(m).alias("mirrored")) for i, (k, m) in enumerate(options)]))
    return pieces.withColumn("t", each).select("*", "t.*").drop("t")


def transformed(pieces: DataFrame) -> DataFrame:
    """Adds each transform's ring and its grid span."""
    out = pieces.withColumn("ring", quarter_turn(F.col("ring"), F.col("rotation"), F.col("mirrored")))
    b = bounds(F.col("ring"))
    return out.withColumn("span_w", b["max_x"] - b["min_x"]).withColumn("span_h", b["max_y"] - b["min_y"])


def material_area(pieces: DataFrame) -> DataFrame:
    """Exact doubled area of each piece's ring."""
    return pieces.withColumn("doubled_area", F.abs(doubled_area(F.col("ring"))))


def capacity_preflight(jobs: DataFrame, transforms: DataFrame) -> DataFrame:
    """Verdict of each job.

    jobs: job_id, sheet_w, sheet_h. transforms: job_id, ord, piece_id, doubled_area, span_w, span_h, a row for each
    transform. The smallest area and span pressure of each piece come first, then sums and maxima over the job: a piece
    that fits by no transform proves the job impossible, as does an area above the sheet's.
    """
    rows = transforms.join(jobs.select("job_id", "sheet_w", "sheet_h"), "job_id")
    w, h, sw, sh = (F.col(c) for c in ("span_w", "span_h", "sheet_w", "sheet_h"))
    pressure = F.least(F.greatest(ceil_ppm(w, sw), ceil_ppm(h, sh)), F.greatest(ceil_ppm(h, sw), ceil_ppm(w, sh)))
    fits = ((w <= sw) & (h <= sh)) | ((h <= sw) & (w <= sh))
    pieces = rows.groupBy("job_id", "ord", "piece_id", "sheet_w", "sheet_h").agg(F.min("doubled_area").cast(BIG).alias("area"), F.min(pressure).alias("pressure"), F.bool_or(fits).alias("fits"))
    out = pieces.groupBy("job_id", "sheet_w", "sheet_h").agg(
        F.count(F.lit(1)).alias("piece_count"),
        F.sum("area").cast(BIG).alias("area_sum"),
        F.max("pressure").alias("max_span_pressure_ppm"),
        F.count_if(~F.col("fits")).alias("infeasible_count"),
        F.min_by("piece_id", F.when(~F.col("fits"), F.col("ord"))).alias("first_infeasible"),
    )
    sheet = (F.lit(2).cast("decimal(1,0)") * F.col("sheet_w").cast("decimal(18,0)") * F.col("sheet_h").cast("decimal(18,0)")).cast(BIG)
    out = out.withColumn("sheet_doubled_area", sheet)
    verdict = F.when(F.col("infeasible_count") > 0, "singleton-does-not-fit").when(F.col("area_sum") > sheet, "area-exceeds-sheet").otherwise("inconclusive")
    return out.select(
        "job_id",
        "piece_count",
        F.col("area_sum").cast("string").alias("area_sum"),
        ceil_ppm(F.col("area_sum"), F.col("sheet_doubled_area")).alias("area_pressure_ppm"),
        "max_span_pressure_ppm",
        "infeasible_count",
        "first_infeasible",
        verdict.alias("verdict"),
    )
