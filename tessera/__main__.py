"""Command line: layouts of polygon documents, DXF folders or request files, written as JSON lines.

    python -m tessera --info
    python -m tessera run-polygons FILE --sheet 2000 2700 --padding 10 --out FOLDER
    python -m tessera run-dxf FOLDER --sheet 2000 2700 --padding 10 --out FOLDER
    python -m tessera run FILES --out FOLDER

Exit status: 0 all jobs succeeded, 2 wrong usage, 3 a job failed, 5 input or output.
"""

from __future__ import annotations

import argparse
import json
import sys

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.kernels.curves import outline_points
from tessera.search.jobs import layout_jobs, outcome_status
from tessera.sources import dxf, polygons, requests

POINT = T.StructType([T.StructField("x", T.LongType()), T.StructField("y", T.LongType())])


@F.pandas_udf(T.ArrayType(POINT))
def outline(segments: pd.Series) -> pd.Series:
    """Grid points of outlines."""
    plain = lambda s: s if isinstance(s, dict) else s.asDict(True)
    return segments.map(lambda of: None if of is None else [{"x": round(x * 1000), "y": round(y * 1000)} for x, y in outline_points([plain(s) for s in of])])


def _sheet(df: DataFrame, width: float, height: float, padding: float) -> DataFrame:
    grid = lambda v: F.lit(round(v * 1000)).cast("long")
    return df.withColumns({"sheet_w": grid(width), "sheet_h": grid(height), "padding": grid(padding)})


def from_polygons(spark: SparkSession, path: str, width: float, height: float, padding: float) -> DataFrame:
    docs = spark.read.text(path, wholetext=True).select(F.lit(1).cast("long").alias("job_id"), F.col("value").alias("document"))
    definitions = polygons.import_documents(docs)
    bad = definitions.where("error IS NOT NULL").select("error").first()
    if bad:
        raise ValueError(bad.error)
    pieces = polygons.grid_rings(polygons.instances(definitions, int(padding)))
    return _sheet(pieces.withColumnRenamed("piece_id", "id"), width, height, padding)


def from_dxf(spark: SparkSession, folder: str, width: float, height: float, padding: float, mirror: bool = True) -> DataFrame:
    found = dxf.read_directory(spark, folder)
    bad = dxf.first_error(found).first()
    if bad.error:
        raise ValueError(bad.error)
    pieces = found.select(F.lit(1).cast("long").alias("job_id"), F.concat("id", F.lit("#1")).alias("id"), outline("segments").alias("ring"), F.lit(True).alias("allow_rotation"), F.lit(mirror).alias("allow_mirror"))
    return _sheet(pieces, width, height, padding)


def from_requests(spark: SparkSession, path: str, desktop: bool = False) -> DataFrame:
    """Pieces of all valid requests at path; job_id is a hash of the file's path."""
    rows = requests.read_requests(spark, path, desktop).where("_corrupt_record IS NULL")
    p = requests.explode_pieces(rows)
    grid = lambda c: F.round(c * 1000).cast("long")
    return p.select(F.xxhash64("job").alias("job_id"), "id", outline("geometry.segments").alias("ring"), (F.col("allowRotation") & F.col("settings.allowGlobalRotation")).alias("allow_rotation"), (F.col("allowMirror") & F.col("settings.allowGlobalMirror")).alias("allow_mirror"), grid(F.col("settings.padding")).alias("padding"), grid(F.col("sheet.width")).alias("sheet_w"), grid(F.col("sheet.height")).alias("sheet_h"))


def main(argv: list[str]) -> int:
    parser = argparse.ArgumentParser(prog="tessera")
    parser.add_argument("--info", action="store_true")
    sub = parser.add_subparsers(dest="command")
    for name in ("run", "run-polygons", "run-dxf"):
        p = sub.add_parser(name)
        p.add_argument("path")
        p.add_argument("--out", required=True)
        p.add_argument("--desktop", action="store_true")
        p.add_argument("--sheet", nargs=2, type=float, default=(2000.0, 2700.0))
        p.add_argument("--padding", type=float, default=0.0)
        p.add_argument("--no-mirror", action="store_true")
    args = parser.parse_args(argv)
    if args.info:
        print(json.dumps({"engine": "tessera", "protocolVersion": 1}))
        return 0
    if not args.command:
        parser.print_usage()
        return 2
    spark = SparkSession.builder.appName("tessera").getOrCreate()
    try:
        if args.command == "run":
            pieces = from_requests(spark, args.path, args.desktop)
        elif args.command == "run-polygons":
            pieces = from_polygons(spark, args.path, *args.sheet, args.padding)
        else:
            pieces = from_dxf(spark, args.path, *args.sheet, args.padding, not args.no_mirror)
        outcomes = outcome_status(layout_jobs(pieces)).cache()
        requests.write_outcomes(outcomes, args.out)
        return outcomes.agg(F.coalesce(F.max("exit_status"), F.lit(0))).first()[0]
    except ValueError as error:
        print(error, file=sys.stderr)
        return 3
    except OSError as error:
        print(error, file=sys.stderr)
        return 5


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
