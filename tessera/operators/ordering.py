"""Total orders, first-of-each and top-k selections. Every order ends in a unique key, as Spark's sorts are not stable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.grid import natural_key, wide


def ranked(df: DataFrame, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """1, 2, ... within each group of by."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))


def canonical_request_order(pieces: DataFrame, id_col: str = "id") -> DataFrame:
    """Width falling, height falling, ids in natural order: independent of how the request lists its pieces."""
    return ranked(pieces, ["job_id"], [F.desc("w"), F.desc("h"), natural_key(F.col(id_col))], "canonical_ordinal")


def priority_order(pieces: DataFrame) -> DataFrame:
    """Longest edge, area and imbalance falling, then the canonical ordinal."""
    w, h = F.col("w"), F.col("h")
    return ranked(pieces, ["job_id"], [F.greatest(w, h).desc(), (wide(w) * wide(h)).desc(), F.abs(w - h).desc(), F.asc("canonical_ordinal")], "priority")


def first_by_identity(df: DataFrame, by: list[str], identity: str, order: list[Column]) -> DataFrame:
    """The first row of each identity, at its own place in the order."""
    return ranked(df, [*by, identity], order, "_first").where("_first = 1").drop("_first")


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k of each group; Spark limits groups before it shuffles them."""
    return ranked(df, by, order, name).where(F.col(name) <= k)


def representative_then_fill(df: DataFrame, by: list[str], key: str, order: list[Column], cap: int) -> DataFrame:
    """First the first row of each key, then the others, in order, up to cap rows of a group."""
    first = ranked(df, [*by, key], order, "_nth")
    return top_k(first, by, [(F.col("_nth") > 1).asc(), *order], cap, "slot").drop("_nth")


def capacity_objective(origin: Column, role: Column, prefix: Column) -> list[Column]:
    """The eleven keys of capacity endpoints, best first."""
    return [F.desc("placed"), F.desc("material"), F.asc("cavities"), F.asc("cavity_area"), F.asc("max_side"), F.asc("area"), F.asc("span"), F.asc("hash"), F.when(origin == "cold-search", 0).otherwise(1).asc(), F.coalesce(prefix, F.lit(-1)).asc(), F.coalesce(role, F.lit("")).asc()]


#: Fixed value: layouts of more placed pieces than this are ordered by compactness first.
STRICT_PLACED = 20


def _strict_keys() -> list[tuple[Column, bool]]:
    """(key, whether it falls) of the strict order behind the unplaced pieces."""
    down = {"dominant", "structural", "band", "contact_units", "contact"}
    return [(F.col(c), c in down) for c in ("dominant", "structural", "max_side", "area", "span", "waste_ratio", "band", "contact_units", "contact")]


def _scale_keys(band_width: int) -> list[tuple[Column, bool]]:
    down = {"dominant", "structural", "contact_units", "contact"}
    keys = [(F.col(c), c in down) for c in ("max_side", "area", "span", "waste_ratio", "dominant", "structural", "contact_units", "contact")]
    return [*keys[:5], (F.floor(F.col("structural") / band_width), True), *keys[5:]]


def _sorted(keys: list[tuple[Column, bool]]) -> list[Column]:
    return [k.desc() if falls else k.asc() for k, falls in keys]


def strict_layout_order(tie: str) -> list[Column]:
    """Structural contact before compactness."""
    return [F.asc("unplaced"), *_sorted(_strict_keys()), F.asc(tie)]


def scale_aware_layout_order(tie: str, band_width: int = 2) -> list[Column]:
    """Compactness before structural contact, which is compared in bands; for layouts of more than twenty pieces."""
    return [F.asc("unplaced"), *_sorted(_scale_keys(band_width)), F.asc(tie)]


def layout_order(placed: Column, tie: str, band_width: int = 2, limit: int = STRICT_PLACED) -> list[Column]:
    """The strict order for layouts of up to ``limit`` placed pieces, the scale-aware one for larger ones. Layouts of one job with as many unplaced
    pieces have as many placed ones, so only one of the two ever decides between them; the other's keys are null."""
    only = lambda keys, on: [(F.when(on, k), falls) for k, falls in keys]
    return [F.asc("unplaced"), *_sorted(only(_strict_keys(), placed <= limit)), *_sorted(only(_scale_keys(band_width), placed > limit)), F.asc(tie)]


def placement_policies() -> dict[str, list[Column]]:
    """Local orders of candidates by policy, best first."""
    tie = [F.asc("bottom"), F.asc("left"), F.asc("transform"), F.asc("candidate_id")]
    balanced = [F.asc("consumption_ppm"), F.asc("span_ppm"), F.asc("area"), F.asc("max_side")]
    return {
        "balanced-compactness": [*balanced, F.desc("contact"), *tie],
        "edge-contact-then-balanced-compactness": [F.desc("contact"), *balanced, *tie],
        "short-side-fill": [F.desc("short_fill_ppm"), F.asc("long_fill_ppm"), F.desc("contact"), *tie],
        "intrinsic-compactness": [F.asc("max_side"), F.asc("area"), F.asc("span"), F.desc("contact"), *tie],
    }


def contact_band_winner(candidates: DataFrame, by: list[str]) -> DataFrame:
    """The most contact among candidates with the leader's longest side whose area is within 2% of the moving piece's.

    candidates: max_side, area, span, contact, moving_area2 (doubled area), candidate_id.
    """
    leader = Window.partitionBy(*by).orderBy("max_side", "area", "span", F.desc("contact"), "candidate_id")
    marked = candidates.withColumn("_side", F.first("max_side").over(leader)).withColumn("_area", F.first("area").over(leader))
    inside = marked.where((F.col("max_side") == F.col("_side")) & (wide(F.col("area")) * 100 <= wide(F.col("_area")) * 100 + F.col("moving_area2")))
    return top_k(inside, by, [F.desc("contact"), F.asc("area"), F.asc("span"), F.asc("candidate_id")], 1).drop("rank", "_side", "_area")


def gap_contained_winner(candidates: DataFrame, by: list[str]) -> DataFrame:
    """The candidate in the smallest gap (gap_area); where none lies in a gap, the pure-growth leader."""
    return top_k(candidates, by, [F.col("gap_area").isNull().asc(), F.asc("gap_area"), F.when(F.col("gap_area").isNotNull(), F.col("contact")).desc(), F.asc("max_side"), F.asc("area"), F.asc("span"), F.desc("contact"), F.asc("candidate_id")], 1).drop("rank")


def candidate_fanout(candidates: DataFrame, by: list[str], compact: int = 3) -> DataFrame:
    """The most compact successors and, if it is not among them, the one with most contact."""
    out = ranked(candidates, by, [F.asc("max_side"), F.asc("area"), F.asc("span"), F.desc("contact"), F.asc("candidate_id")], "compact_rank")
    out = ranked(out, by, [F.desc("contact"), F.asc("max_side"), F.asc("area"), F.asc("span"), F.asc("candidate_id")], "contact_rank")
    rest = Window.partitionBy(*by, F.col("compact_rank") > compact).orderBy("contact_rank")
    return out.withColumn("_best", F.row_number().over(rest)).where((F.col("compact_rank") <= compact) | (F.col("_best") == 1)).drop("_best")


def endpoint_orders(placed: DataFrame) -> DataFrame:
    """Four orders of the pieces of each endpoint by doubled centre: left to right, right to left, bottom up, top down; then y, x, id."""
    cx, cy = 2 * F.col("x") + F.col("w"), 2 * F.col("y") + F.col("h")
    roles = F.explode(F.array(*[F.struct(F.lit(n).alias("role"), k.alias("k")) for n, k in (("left", cx), ("right", -cx), ("top", -cy), ("bottom", cy))]))
    out = placed.withColumn("r", roles).select("*", F.col("r.role").alias("order_role"), F.col("r.k").alias("k"), cx.alias("cx"), cy.alias("cy")).drop("r")
    return ranked(out, ["job_id", "order_role"], [F.asc("k"), F.asc("cy"), F.asc("cx"), F.asc("ord")], "place").drop("k", "cx", "cy")


def warm_lane(lanes: DataFrame) -> DataFrame:
    """The deepest lane; of equal depth by the role's priority, then its id."""
    return top_k(lanes, ["job_id"], [F.desc("depth"), F.asc("role_priority"), F.asc("lane_id")], 1).drop("rank")


def beam(states: DataFrame, width: int = 16) -> DataFrame:
    """The first width states of each job by the eight keys of the capacity beam."""
    return top_k(states, ["job_id"], [F.desc("placed"), F.desc("material"), F.asc("cavities"), F.asc("max_side"), F.asc("area"), F.asc("span"), F.desc("contact"), F.asc("hash")], width)


def global_rank(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """1, 2, ... over all rows, without one task that holds them all: ranks in range partitions, moved by the rows of the partitions before."""
    from tessera.plans.checkpoints import checkpointed

    parts = checkpointed(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*keys))
    return parts.withColumn("_k", local).join(F.broadcast(before), "_part").withColumn(name, (F.col("_k") + F.col("_before")).cast("long")).drop("_part", "_k", "_n", "_before")


def cohesion_frontier(states: DataFrame, width: int = 16) -> DataFrame:
    """A quarter of the beam each by objective, isolated pieces, largest component and components, then the rest by objective.

    A state that an earlier quarter took does not count for a later one, so each quarter ranks what is left; the quarters
    are four windows in a row. states: job_id, state_id, placed, material, isolated, largest, components, waste.
    """
    quarter = max(1, width // 4)
    objective = [F.desc("placed"), F.desc("material"), F.asc("state_id")]
    orders = [objective, [F.asc("isolated"), *objective], [F.desc("largest"), *objective], [F.asc("components"), F.asc("waste"), *objective]]
    out = states.withColumn("_slot", F.lit(None).cast("int"))
    for k, order in enumerate(orders):
        left = F.row_number().over(Window.partitionBy("job_id", F.col("_slot").isNull()).orderBy(*order))
        out = out.withColumn("_slot", F.when(F.col("_slot").isNull() & (left <= quarter), F.lit(k)).otherwise(F.col("_slot")))
    taken = F.count("_slot").over(Window.partitionBy("job_id"))
    rest = F.row_number().over(Window.partitionBy("job_id", F.col("_slot").isNull()).orderBy(*objective))
    out = out.withColumn("_taken", taken).withColumn("_rest", rest)
    return out.where(F.col("_slot").isNotNull() | (F.col("_rest") <= width - F.col("_taken"))).withColumn("slot", F.coalesce("_slot", F.lit(len(orders))).cast("long")).drop("_slot", "_taken", "_rest")
