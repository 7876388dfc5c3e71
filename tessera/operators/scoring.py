"""Metrics, partitions, seeds and selections of layout states, as aggregates and windows within a job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import pareto

#: Descriptors of prefixes that a job keeps.
MOST_PREFIXES = 9


def seed_partition(pieces: DataFrame, frozen: DataFrame, remaining: DataFrame) -> DataFrame:
    """(job_id, problem) of rows (job_id, id): what first keeps frozen and remaining ids from being a partition of all; null if nothing does.

    The sides are counted once each before they meet, so an id on any number of rows is one row of the join.
    """
    sides = [x.select("job_id", "id", F.lit(k).alias("side")) for k, x in enumerate((pieces, remaining, frozen))]
    rows = sides[0].unionByName(sides[1]).unionByName(sides[2])
    n = lambda k: F.sum((F.col("side") == k).cast("long")).alias(f"n{k}")
    ids = rows.groupBy("job_id", "id").agg(n(0), n(1), n(2))
    rules = [("piece ids repeat", F.col("n0") > 1), ("remaining ids repeat", F.col("n1") > 1), ("frozen ids repeat", F.col("n2") > 1), ("frozen and remaining ids overlap", (F.col("n1") > 0) & (F.col("n2") > 0)), ("ids do not cover the pieces", (F.col("n0") > 0) != (F.col("n1") + F.col("n2") > 0))]
    found = ids.groupBy("job_id").agg(*[F.bool_or(bad).alias(f"r{k}") for k, (_, bad) in enumerate(rules)])
    return found.select("job_id", F.coalesce(*[F.when(F.col(f"r{k}"), F.lit(said)) for k, (said, _) in enumerate(rules)]).alias("problem"))


def ranked_seed_front(seeds: DataFrame, order: list[Column], metrics: list[str], most: int) -> DataFrame:
    """The first ``most`` non-dominated seeds of each job, with their rank."""
    front = pareto.seed_front(seeds, metrics=metrics)
    return front.withColumn("rank", F.row_number().over(Window.partitionBy("job_id").orderBy(*order)).cast("long")).where(F.col("rank") <= most)


def free_material_metrics(regions: DataFrame) -> DataFrame:
    """Of regions (job_id, area, perimeter, hole_areas, hole_perimeters): the largest net area, regions, holes and the sum of perimeter
    squared over net area; null metrics for a job with a region without net area."""
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    net, around = F.col("area") - total("hole_areas"), F.col("perimeter") + total("hole_perimeters")
    rows = regions.select("job_id", net.alias("net"), around.alias("around"), F.size("hole_areas").alias("n"))
    g = rows.groupBy("job_id").agg(F.max("net").alias("largest_net_area"), F.count(F.lit(1)).alias("regions"), F.sum("n").alias("holes"), F.sum(F.try_divide(F.col("around") * F.col("around"), F.col("net"))).alias("sliver"), F.bool_or(F.col("net") <= 0).alias("bad"))
    return g.select("job_id", *[F.when(~F.col("bad"), F.col(c)).alias(c) for c in ("largest_net_area", "regions", "holes", "sliver")])


def hull_waste(hull_area: Column, occupied: Column) -> Column:
    """Share of the hull that nothing occupies, from 0 to 1; 0 for a hull without area."""
    return F.when(hull_area == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (hull_area - occupied) / hull_area)))


def beam_order(mode: str) -> list[Column]:
    """Orders of capacity states: area-first, or the same after width and height in either order."""
    accounting = [F.desc("placed"), F.desc("material"), F.asc("cavities"), F.asc("cavity_area")]
    span = {"area-first": [], "width-first": [F.asc("width"), F.asc("height")], "height-first": [F.asc("height"), F.asc("width")]}[mode]
    return [*accounting, *span, F.asc("area"), F.greatest("width", "height").asc(), (F.col("width") + F.col("height")).asc(), F.asc("hash")]


def axis_beam(states: DataFrame, mode: str, width: int = 16) -> DataFrame:
    """The first width states of each job in an axis order, with their rank."""
    return states.withColumn("rank", F.row_number().over(Window.partitionBy("job_id").orderBy(*beam_order(mode))).cast("long")).where(F.col("rank") <= width)


def contact_aware(candidates: DataFrame, directional: list[Column], long_axis: str, contact: str, contact_first: bool = False) -> DataFrame:
    """(job_id, baseline, winner, tied): the directional winner of each job, and of the candidates that reach as far along the long axis
    (or of all, contact first) the one with most contact; of equal contact, the earlier by direction."""
    job = Window.partitionBy("job_id")
    rows = candidates.withColumn("_at", F.row_number().over(job.orderBy(*directional))).withColumn("_reach", F.first(long_axis).over(job.orderBy("_at")))
    tied = F.lit(True) if contact_first else F.col(long_axis) == F.col("_reach")
    key = F.struct((-F.col(contact)).alias("c"), F.col("_at"))
    return rows.groupBy("job_id").agg(F.min_by("candidate_id", "_at").alias("baseline"), F.min_by("candidate_id", F.when(tied, key)).alias("winner"), F.count_if(tied).alias("tied"))


def distinct_points(points: DataFrame, order: list[Column]) -> DataFrame:
    """One row of each exact point of a job, the first by order; -0.0 and 0.0 are one point, as coordinates are compared by their bits after that fold."""
    x, y = F.col("x") + 0.0, F.col("y") + 0.0
    first = F.row_number().over(Window.partitionBy("job_id", x, y).orderBy(*order))
    return points.withColumn("_k", first).where("_k = 1").drop("_k")


def prefix_states(lineage: DataFrame, prepared: DataFrame, roles: list[str], most: int = MOST_PREFIXES) -> DataFrame:
    """(job_id, role, depth, rank): depths of a job (a quarter, half and three quarters of its pieces) at which a role's state has taken exactly
    the first pieces as prepared. lineage: job_id, role, at (from 1), id; prepared: job_id, at, id. The first ``most``, by role."""
    n = prepared.groupBy("job_id").agg(F.count(F.lit(1)).alias("n"))
    # a prefix of depth d is exact if its set of ids is that of the first d: the largest prepared place so far is d itself
    placed = lineage.join(prepared.select("job_id", "id", F.col("at").alias("place")), ["job_id", "id"])
    so_far = placed.withColumn("reach", F.max("place").over(Window.partitionBy("job_id", "role").orderBy("at")))
    depth = F.explode(F.array_distinct(F.array(*[F.floor(F.col("n") * k / 4).cast("long") for k in (1, 2, 3)])))
    depths = n.select("job_id", "n", depth.alias("depth")).where("depth >= 1 AND depth < n")
    good = so_far.join(depths, "job_id").where((F.col("at") == F.col("depth")) & (F.col("reach") == F.col("depth"))).select("job_id", "role", "depth")
    turn = F.array_position(F.array(*[F.lit(r) for r in roles]), F.col("role"))
    return good.where(turn > 0).withColumn("rank", F.row_number().over(Window.partitionBy("job_id").orderBy(turn, "depth")).cast("long")).where(F.col("rank") <= most)


def quality_row(pieces: DataFrame, placed: DataFrame, unplaced: DataFrame, scores: DataFrame) -> DataFrame:
    """(job_id, placed_count, unplaced_count, metrics of scores, problem): the counts of a result beside its score, and what contradicts them."""
    parts = seed_partition(pieces, placed, unplaced)
    count = lambda x, name: x.groupBy("job_id").agg(F.countDistinct("id").alias(name))
    rows = scores.join(parts, "job_id", "left").join(count(placed, "placed_count"), "job_id", "left").join(count(unplaced, "unplaced_count"), "job_id", "left")
    rows = rows.fillna(0, ["placed_count", "unplaced_count"])
    wrong = F.coalesce("problem", F.when(F.col("unplaced") != F.col("unplaced_count"), F.lit("the score counts other unplaced pieces")))
    return rows.withColumn("problem", wrong)


def progress(steps: DataFrame, order: list[Column], score: list[Column], best: str) -> DataFrame:
    """Rows of a job in order, numbered from 0, with the best ``best`` so far by score."""
    at = Window.partitionBy("job_id").orderBy(*order)
    rows = steps.withColumn("sequence", (F.row_number().over(at) - 1).cast("long"))
    return rows.withColumn("best", F.min(F.struct(*score, F.col(best).alias("_best"))).over(at)["_best"])


def sorted_bounds(queries: DataFrame, bounds: DataFrame, cell: int) -> DataFrame:
    """(job_id, query_id, bound_id) whose closed ranges (lo, hi) meet. Ranges are listed in the cells they reach, each pair is told in the
    first cell that both have, so neither a pair is told twice nor a job joined with itself whole."""
    cells = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / cell).cast("long"), F.floor(F.col(hi) / cell).cast("long")))
    q = queries.select("job_id", "query_id", F.col("lo").alias("q_lo"), F.col("hi").alias("q_hi"), cells("lo", "hi").alias("cell"))
    b = bounds.select("job_id", "bound_id", F.col("lo").alias("b_lo"), F.col("hi").alias("b_hi"), cells("lo", "hi").alias("cell"))
    meet = (F.col("q_lo") <= F.col("b_hi")) & (F.col("b_lo") <= F.col("q_hi")) & (F.col("cell") == F.floor(F.greatest("q_lo", "b_lo") / cell))
    return q.join(b, ["job_id", "cell"]).where(meet).select("job_id", "query_id", "bound_id")
