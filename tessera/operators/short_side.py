"""Constructions along the sheet's short side: axes, transform choice, shelves, pair folds, and the order of outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.grid import BIG, wide


def axes(sheet_w: Column, sheet_h: Column) -> Column:
    """Short and long side of a sheet and the axis of the short one (x if they are equal)."""
    return F.struct(F.least(sheet_w, sheet_h).alias("short"), F.greatest(sheet_w, sheet_h).alias("long"), F.when(sheet_w <= sheet_h, "x").otherwise("y").alias("short_axis"))


def pick_transform(transforms: DataFrame, shelf: bool) -> DataFrame:
    """One transform for each piece: for pairs the narrowest, then lowest; for shelves the lowest, then widest; then index."""
    key = F.struct(F.col("span_h"), -F.col("span_w"), F.col("index")) if shelf else F.struct(F.col("span_w"), F.col("span_h"), F.col("index"))
    best = F.min_by(F.struct("index", "span_w", "span_h"), key)
    return transforms.groupBy("job_id", "ord", "piece_id").agg(best.alias("b")).select("job_id", "ord", "piece_id", "b.*")


def next_fit_shelf(items: Column, width: Column, height: Column) -> Column:
    """Places items (ord, w, h), in array order, in rows from the left; a row that is full starts the next above it.

    Result: rows (number, 0 without items), placed (ord, x, y), ok (false if an item is larger than the sheet or the rows are too high).
    """
    kind = "struct<x:bigint,y:bigint,tall:bigint,rows:bigint,ok:boolean,placed:array<struct<ord:bigint,x:bigint,y:bigint>>>"
    start = F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(0).alias("tall"), F.least(F.size(items), F.lit(1)).alias("rows"), F.lit(True).alias("ok"), F.array().alias("placed")).cast(kind)

    def step(s: Column, i: Column) -> Column:
        wrap = (s["x"] > 0) & (s["x"] + i["w"] > width)
        x, y = F.when(wrap, 0).otherwise(s["x"]), s["y"] + F.when(wrap, s["tall"]).otherwise(0)
        fits = (i["w"] <= width) & (i["h"] <= height) & (y + i["h"] <= height)
        tall = F.greatest(F.when(wrap, 0).otherwise(s["tall"]), i["h"])
        one = F.struct(i["ord"].alias("ord"), x.alias("x"), y.alias("y"))
        return F.struct((x + i["w"]).alias("x"), y.alias("y"), tall.alias("tall"), (s["rows"] + wrap.cast("long")).alias("rows"), (s["ok"] & fits).alias("ok"), F.concat(s["placed"], F.array(one)).alias("placed")).cast(kind)

    return F.aggregate(items, start, step, lambda s: F.struct(s["rows"].alias("rows"), s["ok"].alias("ok"), s["placed"].alias("placed")))


def shelves(chosen: DataFrame, sheets: DataFrame) -> DataFrame:
    """The next-fit shelf layout of each job's pieces, in order of ord."""
    items = chosen.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct(F.col("ord").alias("ord"), F.col("span_w").alias("w"), F.col("span_h").alias("h")))).alias("items"))
    a = axes(F.col("sheet_w"), F.col("sheet_h"))
    return items.join(sheets.select("job_id", a.alias("a")), "job_id").select("job_id", next_fit_shelf(F.col("items"), F.col("a.short"), F.col("a.long")).alias("s")).select("job_id", "s.*")


def best_pair(chosen: DataFrame, sheets: DataFrame) -> DataFrame:
    """For each job the pair (bottom below upper) of least envelope area, then depth, bottom and upper, that fits the sheet."""
    c = chosen.join(sheets.select("job_id", axes(F.col("sheet_w"), F.col("sheet_h")).alias("a")), "job_id")
    one = c.select("job_id", "a", F.col("ord").alias("bottom"), F.col("span_w").alias("bw"), F.col("span_h").alias("bh"))
    two = c.select("job_id", F.col("ord").alias("upper"), F.col("span_w").alias("uw"), F.col("span_h").alias("uh"))
    both = one.join(two, "job_id").where("bottom <> upper")
    width, depth = F.greatest("bw", "uw"), F.col("bh") + F.col("uh")
    fit = both.withColumn("width", width).withColumn("depth", depth).where((width <= F.col("a.short")) & (depth <= F.col("a.long")))
    area = (wide(F.col("width")) * wide(F.col("depth"))).cast(BIG)
    best = F.min_by(F.struct("bottom", "upper", "width", "depth"), F.struct(area, F.col("depth"), F.col("bottom"), F.col("upper")))
    return fit.groupBy("job_id").agg(best.alias("p")).select("job_id", "p.*")


def pair_cursor(chosen: DataFrame, pairs: DataFrame) -> DataFrame:
    """Left edge of each piece when they stand side by side and the pair takes the place of its bottom piece."""
    from pyspark.sql import Window

    c = chosen.join(pairs.select("job_id", "bottom", "upper", F.col("width").alias("pair_width")), "job_id")
    step = F.when(F.col("ord") == F.col("upper"), 0).when(F.col("ord") == F.col("bottom"), F.col("pair_width")).otherwise(F.col("span_w"))
    before = Window.partitionBy("job_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    out = c.withColumn("own_x", F.coalesce(F.sum(step).over(before), F.lit(0)).cast("long"))
    whole = Window.partitionBy("job_id")
    of_bottom = F.max(F.when(F.col("ord") == F.col("bottom"), F.col("own_x"))).over(whole)
    y = F.when(F.col("ord") == F.col("upper"), F.max(F.when(F.col("ord") == F.col("bottom"), F.col("span_h"))).over(whole)).otherwise(0)
    return out.select("job_id", "ord", F.when(F.col("ord") == F.col("upper"), of_bottom).otherwise(F.col("own_x")).alias("x"), y.cast("long").alias("y"))


def fill_tier(span: Column, side: Column) -> Column:
    """2 from 99% of the short side, 1 from 80%, else 0."""
    return F.when(wide(span) * 100 >= wide(side) * 99, 2).when(wide(span) * 5 >= wide(side) * 4, 1).otherwise(0).cast("long")


def incumbent(outcomes: DataFrame) -> DataFrame:
    """The directional outcome of each job: fill tier, then (below tier 2) span across, area, depth, cavities, isolated, hash."""
    key = F.struct(-F.col("tier"), F.when(F.col("tier") < 2, -F.col("across")).otherwise(F.lit(0)).alias("across"), F.col("area"), F.col("depth"), F.col("cavities"), F.col("isolated"), F.col("hash"))
    return outcomes.groupBy("job_id").agg(F.min_by("endpoint_id", key).alias("endpoint_id"), F.max("tier").alias("best_tier"))
