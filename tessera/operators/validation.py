"""Full validation of requests: every rule of the request, its pieces, sources, segments and settings, in the JVM.

The outcome is the path of the first field that breaks its rule, in the order of the document, as in
``pieces[3].paddedBounds.area``; null for a valid request. A required field that is absent breaks its rule too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.grid import finite
from tessera.operators.relations import first_failure, not_negative_safe, positive_safe

RULES: dict[str, Callable[[Column], Column]] = {
    "name": lambda c: ~c.rlike(r"(?U)^\s*$"),
    "text": lambda c: c != "",
    "finite": finite,
    "positive": lambda c: finite(c) & (c > 0),
    "not negative": lambda c: finite(c) & (c >= 0),
    "whole": not_negative_safe,
    "count": positive_safe,
}

#: Fields and their rules, in the order in which they are reported; a question mark is for one that may be absent.
PIECE = [
    ("id", "name"), ("sourcePieceId", "text"), ("interchangeabilityKey", "text?"), ("padding", "whole"),
    ("realBounds.x", "whole"), ("realBounds.y", "whole"), ("paddedBounds.x", "whole"), ("paddedBounds.y", "whole"), ("paddedBounds.imbalance", "whole"),
    ("realBounds.width", "count"), ("realBounds.height", "count"), ("paddedBounds.width", "count"), ("paddedBounds.height", "count"), ("paddedBounds.longestEdge", "count"), ("paddedBounds.area", "count"),
]
SOURCE = [("id", "text"), ("sourceFileId", "text"), ("realBounds.x", "whole"), ("realBounds.y", "whole"), ("realBounds.width", "count"), ("realBounds.height", "count")]
LINE = [("x1", "finite"), ("y1", "finite"), ("x2", "finite"), ("y2", "finite"), ("bulge", "finite?")]
CURVE = [("sourceId", "text"), ("cx", "finite"), ("cy", "finite"), ("majorAxisX", "finite"), ("majorAxisY", "finite"), ("startAngle", "finite"), ("endAngle", "finite"), ("axisRatio", "positive")]
ARC = [("x1", "finite"), ("y1", "finite"), ("x2", "finite"), ("y2", "finite"), ("cx", "finite"), ("cy", "finite"), ("startAngle", "finite"), ("endAngle", "finite"), ("radius", "positive")]
GEOMETRY = [("flatteningSagToleranceMm", "positive"), ("clearanceSafetyMarginMm", "not negative"), ("geometryBackendId", "text"), ("geometryBackendVersion", "text")]
OPTIMIZER = [
    ("orderWindow", "count"), ("beamWidth", "count"), ("localCandidateFanout", "count?"), ("transformCap", "count"), ("gaPopulation", "count"),
    ("localRepairBudget", "whole?"), ("gaGenerationBudget", "whole?"), ("gaEvaluationBudget", "whole?"), ("gaTimeBudgetMs", "whole"),
    ("transformMinimumEdgeLengthMm", "not negative?"), ("transformAngleDeduplicationToleranceDeg", "positive?"),
]
DEFAULT_POLICY, DEFAULT_POLICIES = "balanced-compactness", ["balanced-compactness", "short-side-fill", "edge-contact-then-balanced-compactness"]


def _fields(of: Column, fields: list[tuple[str, str]]) -> list[tuple[str, Column]]:
    """(path, whether it holds) of the fields of a struct."""
    out = []
    for path, rule in fields:
        value = of
        for part in path.split("."):
            value = value[part]
        out.append((path, F.when(value.isNull(), F.lit(rule.endswith("?"))).otherwise(RULES[rule.rstrip("?")](value))))
    return out


def _within(prefix: Column, failure: Column) -> Column:
    """The path with its prefix; null stays null."""
    return F.concat(prefix, F.lit("."), failure)


def _first_of(items: Column, prefix: Column, failure: Callable[[Column, Column], Column]) -> Column:
    """The first failure of an array's elements, each given with its own prefix."""
    found = F.transform(items, lambda e, k: failure(e, F.concat(prefix, F.lit("["), k.cast("string"), F.lit("]"))))
    return F.get(F.filter(found, lambda f: f.isNotNull()), F.lit(0))


def _repeats(items: Column, one: Column, prefix: Column) -> Column:
    """The id's path if an earlier element has the same id; places are only compared where the ids are not distinct."""
    ids = F.transform(items, lambda e: e["id"])
    before = F.slice(ids, F.lit(1), F.regexp_extract(prefix, r"\[([0-9]+)\]$", 1).cast("int"))
    return F.when((F.size(F.array_distinct(ids)) < F.size(ids)) & F.array_contains(before, one["id"]), _within(prefix, F.lit("id")))


def _segment(s: Column, prefix: Column) -> Column:
    curve = s["sourceCurve"]
    axis = F.when((curve["majorAxisX"] == 0) & (curve["majorAxisY"] == 0), F.lit("sourceCurve.majorAxis"))
    of_curve = F.when(curve.isNotNull(), F.coalesce(F.concat(F.lit("sourceCurve."), first_failure(_fields(curve, CURVE))), axis))
    line, arc = F.coalesce(first_failure(_fields(s, LINE)), of_curve), first_failure(_fields(s, ARC))
    return _within(prefix, F.when(s["kind"] == "line", line).when(s["kind"] == "arc", arc).otherwise(F.lit("kind")))


def invalid_path(requests: DataFrame) -> DataFrame:
    """Adds invalid_path to requests with the columns version, timeoutMs, sheet, pieces, sourcePieces and settings. No row is
    dropped; an absent or empty list of pieces is reported, an absent list of sources is empty."""
    c = F.col
    top = [("version", c("version") == 1), *_fields(F.struct("timeoutMs"), [("timeoutMs", "positive")])]
    sheet = [(f"sheet.{n}", ok) for n, ok in _fields(c("sheet"), [("width", "count"), ("height", "count")])]
    geometry, optimizer = c("settings.geometry"), c("settings.optimizer")
    settings = _fields(c("settings"), [("padding", "whole")])
    settings += [(f"geometry.{n}", ok) for n, ok in _fields(geometry, GEOMETRY)]
    settings += [("geometry.clearanceSafetyMarginMm", geometry["clearanceSafetyMarginMm"] >= geometry["flatteningSagToleranceMm"])]
    settings += [(f"optimizer.{n}", ok) for n, ok in _fields(optimizer, OPTIMIZER)]
    angle = _first_of(optimizer["configuredRotationDeg"], F.lit("optimizer.configuredRotationDeg"), lambda v, at: F.when(~F.coalesce(finite(v), F.lit(False)), at))
    policies = F.coalesce(optimizer["placementPolicyIds"], F.array(*map(F.lit, DEFAULT_POLICIES)))
    policy = F.coalesce(optimizer["placementPolicyId"], F.lit(DEFAULT_POLICY))
    last = [(f"optimizer.{n}", ok) for n, ok in _fields(optimizer, [("gaSeed", "text")])]
    last += [("optimizer.placementPolicyIds", F.size(policies) > 0), ("optimizer.placementPolicyId", F.array_contains(policies, policy)), ("optimizer.placementPolicyIds", F.size(F.array_distinct(policies)) == F.size(policies))]
    pieces = _first_of(c("pieces"), F.lit("pieces"), lambda p, at: F.coalesce(_within(at, first_failure(_fields(p, PIECE))), _repeats(c("pieces"), p, at)))

    def source(s: Column, at: Column) -> Column:
        segments = _first_of(s["geometry"]["segments"], F.concat(at, F.lit(".geometry.segments")), _segment)
        return F.coalesce(_within(at, first_failure(_fields(s, SOURCE))), segments, _repeats(c("sourcePieces"), s, at))

    sources = _first_of(c("sourcePieces"), F.lit("sourcePieces"), source)
    of_settings = F.coalesce(first_failure(settings), angle, first_failure(last))
    empty = F.when(F.coalesce(F.size("pieces"), F.lit(0)) <= 0, F.lit("pieces"))
    return requests.withColumn("invalid_path", F.coalesce(first_failure([*top, *sheet]), empty, pieces, sources, _within(F.lit("settings"), of_settings)))
