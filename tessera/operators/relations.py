"""Relational steps of a job: validation, lookup, expansion, sets, folds over an order, events and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.grid import finite, is_safe_integer


def first_failure(rules: list[tuple[str, Column]]) -> Column:
    """Name of the first rule that fails, in order; null if all hold."""
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules])


def positive_safe(c: Column) -> Column:
    return finite(c) & is_safe_integer(c) & (c > 0)


def not_negative_safe(c: Column) -> Column:
    return finite(c) & is_safe_integer(c) & (c >= 0)


def request_rules() -> list[tuple[str, Column]]:
    """Rules of a request's scalar fields, in the order in which they are reported."""
    c = F.col
    return [
        ("version", c("version") == 1),
        ("timeoutMs", finite(c("timeout_ms")) & (c("timeout_ms") > 0)),
        ("sheet.width", positive_safe(c("sheet_width"))),
        ("sheet.height", positive_safe(c("sheet_height"))),
        ("pieces", c("piece_count") > 0),
        ("pieces.id", c("distinct_piece_ids") == c("piece_count")),
        ("sourcePieces.id", c("distinct_source_ids") == c("source_count")),
        ("settings.geometry.clearanceSafetyMarginMm", c("clearance_mm") >= c("sag_mm")),
        ("settings.optimizer.beamWidth", positive_safe(c("beam_width"))),
        ("settings.optimizer.placementPolicyIds", F.size("policies") > 0),
        ("settings.optimizer.placementPolicyId", F.array_contains("policies", c("policy"))),
        ("settings.optimizer.placementPolicyIds.duplicates", F.size(F.array_distinct("policies")) == F.size("policies")),
    ]


def validate_requests(requests: DataFrame) -> DataFrame:
    """Adds the first failing field, null for a valid request; no row is dropped."""
    return requests.withColumn("invalid_field", first_failure(request_rules()))


def eligibility(archive_enabled: Column, policy: Column, ga_active: Column) -> Column:
    return F.when(~archive_enabled, "archive-disabled").when(policy == "short-side-fill", "short-side-fill").when(ga_active, "ga-active")


def expand_quantity(definitions: DataFrame, quantity: str = "quantity") -> DataFrame:
    """One row for each instance, with its number from 1 and the id <id>#<number>."""
    out = definitions.where(F.col(quantity) > 0).withColumn("number", F.explode(F.sequence(F.lit(1).cast("long"), F.col(quantity).cast("long"))))
    return out.withColumn("instance_id", F.concat_ws("#", F.col("id"), F.col("number").cast("string")))


def find_source(pieces: DataFrame, sources: DataFrame) -> DataFrame:
    """The first source (by ordinal) named by source_piece_id or piece_id; failing that, by either without -copy-N.

    pieces: job_id, piece_id, source_piece_id. sources: job_id, source_id, ordinal. Adds source_id, null if none.
    """
    bare = lambda c: F.regexp_replace(c, r"-copy-[0-9]+$", "")
    names = [(F.col("source_piece_id"), 0), (F.col("piece_id"), 0), (bare(F.col("source_piece_id")), 1), (bare(F.col("piece_id")), 1)]
    wanted = pieces.withColumn("_w", F.explode(F.array(*[F.struct(n.alias("source_id"), F.lit(p).alias("pass")) for n, p in names])))
    hits = wanted.select("job_id", "piece_id", "source_piece_id", "_w.*").join(sources, ["job_id", "source_id"])
    best = hits.groupBy("job_id", "piece_id", "source_piece_id").agg(F.min_by("source_id", F.struct("pass", "ordinal")).alias("source_id"))
    return pieces.join(best, ["job_id", "piece_id", "source_piece_id"], "left")


def unplaced(pieces: DataFrame, placed: DataFrame) -> DataFrame:
    return pieces.join(placed.select("job_id", "ord"), ["job_id", "ord"], "left_anti")


def partitions_request(pieces: DataFrame, placed: DataFrame, rest: DataFrame) -> DataFrame:
    """Whether placed and rest are together each piece of the job exactly once."""
    both = placed.select("job_id", "ord").withColumn("n", F.lit(1)).unionByName(rest.select("job_id", "ord").withColumn("n", F.lit(1)))
    counted = both.groupBy("job_id", "ord").agg(F.count("n").alias("n"))
    joined = pieces.select("job_id", "ord").withColumn("wanted", F.lit(1)).join(counted, ["job_id", "ord"], "full")
    return joined.groupBy("job_id").agg(F.bool_and((F.coalesce("wanted", F.lit(0)) == 1) & (F.coalesce("n", F.lit(0)) == 1)).alias("is_partition"))


def prefix_depths(n: Column) -> Column:
    """A quarter, a half and three quarters of n pieces, of which those from 1 to n - 1, once each."""
    depth = F.array(*[F.call_function("div", n * k, F.lit(4)) for k in (1, 2, 3)])
    return F.array_distinct(F.filter(depth, lambda d: (d >= 1) & (d < n)))


def suffix_material(pieces: DataFrame, area: str = "doubled_area") -> DataFrame:
    """Material that is left after each piece, in order."""
    w = Window.partitionBy("job_id").orderBy("ord").rowsBetween(1, Window.unboundedFollowing)
    return pieces.withColumn("remaining_material", F.coalesce(F.sum(area).over(w), F.lit(0).cast("decimal(38,0)")).cast("decimal(38,0)"))


def sequence_events(events: DataFrame, by: str, order: list[str]) -> DataFrame:
    """Contiguous ordinals from 0."""
    return events.withColumn("ordinal", (F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1).cast("long"))


def terminal_frames(sequenced: DataFrame, by: str, status: Column) -> DataFrame:
    """One frame after each job's last event."""
    return sequenced.groupBy(by).agg((F.max("ordinal") + 1).alias("ordinal"), status.alias("status"))


def settle_control(requests: DataFrame, by: str, order: list[str]) -> DataFrame:
    """The first request that ends a job (cancelled, deadline or completed) wins; later ones change nothing."""
    return requests.groupBy(by).agg(F.min_by("kind", F.struct(*order)).alias("settled"), F.count(F.lit(1)).alias("requests"))


def exit_status(status: Column, category: Column) -> Column:
    """0 success, 1 internal, 3 domain, 4 cancelled or deadline, 5 input or output."""
    return F.when(status == "success", 0).when(category.isin("cancelled", "deadline"), 4).when(category == "io", 5).when(category == "internal", 1).otherwise(3)


def sum_or_null(x: Column) -> Column:
    """The sum, null if any value is null, 0 of none."""
    return F.when(F.count_if(x.isNull()) == 0, F.coalesce(F.sum(x), F.lit(0)))


def reveal_prefixes(placed: DataFrame) -> DataFrame:
    """For each step of a job, the pieces placed up to it, in order."""
    w = Window.partitionBy("job_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    return placed.withColumn("revealed", F.collect_list("piece_id").over(w))


def merge_candidates(sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """Union of candidate points with a bit for each source that found them."""
    marked = [df.select("job_id", "gx", "gy", F.lit(1 << k).cast("long").alias("bit")) for k, (_, df) in enumerate(sources)]
    out = marked[0]
    for df in marked[1:]:
        out = out.unionByName(df)
    return out.groupBy("job_id", "gx", "gy").agg(F.bit_or("bit").alias("mask"), F.count(F.lit(1)).alias("raw"))


def provenance_counts(points: DataFrame) -> DataFrame:
    return points.groupBy("mask").agg(F.count(F.lit(1)).alias("points"), F.sum("raw").alias("raw"))


def successor_dedupe(successors: DataFrame, by: list[str], key: str, order: list[Column]) -> DataFrame:
    """The first successor of each identity, and how often it came."""
    out = successors.withColumn("_n", F.row_number().over(Window.partitionBy(*by, key).orderBy(*order))).withColumn("occurrences", F.count(F.lit(1)).over(Window.partitionBy(*by, key)))
    return out.where("_n = 1").drop("_n")


def rejection_histogram(rejections: DataFrame, samples: int = 32) -> DataFrame:
    """Count of each reason and its first samples by id; no reason's ids are gathered in one place."""
    counts = rejections.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    first = rejections.withColumn("_k", F.row_number().over(Window.partitionBy("reason").orderBy("id"))).where(F.col("_k") <= samples)
    return counts.join(first.groupBy("reason").agg(F.array_sort(F.collect_list("id")).alias("samples")), "reason")


def quality_changes(golden: DataFrame, candidate: DataFrame, key: str, lower_is_better: list[str], higher_is_better: list[str]) -> DataFrame:
    """For each row of either side the metrics that improve and regress; promoted if there are more of the first and the row is on both."""
    g = golden.select(key, *[F.col(m).alias(f"g_{m}") for m in (*lower_is_better, *higher_is_better)], F.lit(True).alias("_g"))
    both = g.join(candidate.withColumn("_c", F.lit(True)), key, "full")
    sign = [F.signum(F.col(f"g_{m}").cast("double") - F.col(m)) for m in lower_is_better] + [F.signum(F.col(m).cast("double") - F.col(f"g_{m}")) for m in higher_is_better]
    better = sum((F.coalesce((s > 0).cast("long"), F.lit(0)) for s in sign[1:]), F.coalesce((sign[0] > 0).cast("long"), F.lit(0)))
    worse = sum((F.coalesce((s < 0).cast("long"), F.lit(0)) for s in sign[1:]), F.coalesce((sign[0] < 0).cast("long"), F.lit(0)))
    return both.select(key, better.alias("improved"), worse.alias("regressed"), (F.col("_g").isNotNull() & F.col("_c").isNotNull() & (better > worse)).alias("promoted"))
