"""Protocol and desktop requests, outcomes and event lines as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fields of requests and their types.
RECT = "STRUCT<x DOUBLE, y DOUBLE, width DOUBLE, height DOUBLE>"
PADDED = "STRUCT<x DOUBLE, y DOUBLE, width DOUBLE, height DOUBLE, longestEdge DOUBLE, area DOUBLE, imbalance DOUBLE>"
CURVE = "STRUCT<kind STRING, sourceId STRING, cx DOUBLE, cy DOUBLE, majorAxisX DOUBLE, majorAxisY DOUBLE, axisRatio DOUBLE, startAngle DOUBLE, endAngle DOUBLE>"
SEGMENT = f"STRUCT<kind STRING, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE, bulge DOUBLE, cx DOUBLE, cy DOUBLE, radius DOUBLE, startAngle DOUBLE, endAngle DOUBLE, sourceCurve {CURVE}>"
PIECES = f"ARRAY<STRUCT<id STRING, sourcePieceId STRING, interchangeabilityKey STRING, realBounds {RECT}, paddedBounds {PADDED}, padding DOUBLE, allowRotation BOOLEAN, allowMirror BOOLEAN>>"
SOURCES = f"ARRAY<STRUCT<id STRING, sourceFileId STRING, sourceLayer STRING, label STRING, realBounds {RECT}, geometry STRUCT<entityType STRING, closed BOOLEAN, segments ARRAY<{SEGMENT}>>>>"
GEOMETRY = "STRUCT<flatteningSagToleranceMm DOUBLE, clearanceSafetyMarginMm DOUBLE, geometryBackendId STRING, geometryBackendVersion STRING>"
OPTIMIZER = (
    "STRUCT<orderWindow DOUBLE, beamWidth DOUBLE, localCandidateFanout DOUBLE, localRepairBudget DOUBLE, transformCap DOUBLE, transformMinimumEdgeLengthMm DOUBLE, transformAngleDeduplicationToleranceDeg DOUBLE, configuredRotationDeg ARRAY<DOUBLE>, "
    "gaEnabled BOOLEAN, baselineOnly BOOLEAN, gaPopulation DOUBLE, gaGenerationBudget DOUBLE, gaEvaluationBudget DOUBLE, gaTimeBudgetMs DOUBLE, gaSeed STRING, intrinsicSharedArchiveEnabled BOOLEAN, placementPolicyId STRING, placementPolicyIds ARRAY<STRING>>"
)
REQUEST = f"version INT, timeoutMs DOUBLE, profile STRING, sheet STRUCT<width DOUBLE, height DOUBLE, label STRING>, pieces {PIECES}, sourcePieces {SOURCES}, settings STRUCT<padding DOUBLE, allowGlobalRotation BOOLEAN, allowGlobalMirror BOOLEAN, geometry {GEOMETRY}, optimizer {OPTIMIZER}>, historyMode STRING, diagnosticTraceMode STRING"
DESKTOP = f"version INT, jobId STRING, sheet STRUCT<width DOUBLE, height DOUBLE, label STRING>, padding DOUBLE, pieces {PIECES}, sourcePieces {SOURCES}, options STRUCT<allowGlobalRotation BOOLEAN, allowGlobalMirror BOOLEAN, timeoutMs DOUBLE, historyMode STRING, diagnosticTraceMode STRING, irregularSettings STRUCT<geometry {GEOMETRY}, optimizer {OPTIMIZER}>>"


def read_requests(spark: SparkSession, path: str, desktop: bool = False) -> DataFrame:
    """A row for each file: request fields, path, and _corrupt_record where the JSON is broken. Unknown fields are dropped."""
    schema = (DESKTOP if desktop else REQUEST) + ", _corrupt_record STRING"
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return adapt_desktop(rows) if desktop else rows.withColumn("path", F.input_file_name())


def adapt_desktop(rows: DataFrame) -> DataFrame:
    """The same columns as a protocol request, with the defaults of what is left out."""
    c = F.col
    settings = F.struct(c("padding").alias("padding"), F.coalesce("options.allowGlobalRotation", F.lit(True)).alias("allowGlobalRotation"), F.coalesce("options.allowGlobalMirror", F.lit(True)).alias("allowGlobalMirror"), c("options.irregularSettings.geometry").alias("geometry"), c("options.irregularSettings.optimizer").alias("optimizer"))
    return rows.select("version", c("options.timeoutMs").alias("timeoutMs"), F.lit("compact").alias("profile"), "sheet", "pieces", "sourcePieces", settings.alias("settings"), F.coalesce("options.historyMode", F.lit("off")).alias("historyMode"), F.coalesce("options.diagnosticTraceMode", F.lit("full")).alias("diagnosticTraceMode"), "_corrupt_record", F.input_file_name().alias("path"))


def request_facts(requests: DataFrame) -> DataFrame:
    """The scalar facts that validation looks at."""
    c = F.col
    n = lambda e: F.size(F.coalesce(e, F.array()))
    ids = lambda a: F.transform(a, lambda p: p["id"])
    return requests.select(
        "path", "version", c("timeoutMs").alias("timeout_ms"), c("sheet.width").alias("sheet_width"), c("sheet.height").alias("sheet_height"), n(c("pieces")).alias("piece_count"),
        F.size(F.array_distinct(ids("pieces"))).alias("distinct_piece_ids"), n(c("sourcePieces")).alias("source_count"), F.size(F.array_distinct(ids("sourcePieces"))).alias("distinct_source_ids"),
        c("settings.geometry.clearanceSafetyMarginMm").alias("clearance_mm"), c("settings.geometry.flatteningSagToleranceMm").alias("sag_mm"), c("settings.optimizer.beamWidth").alias("beam_width"),
        c("settings.optimizer.placementPolicyIds").alias("policies"), c("settings.optimizer.placementPolicyId").alias("policy"),
    )


def explode_pieces(requests: DataFrame) -> DataFrame:
    """A row for each piece with its place in the request and its source's segments (null if it has none)."""
    r = requests.withColumn("job", F.sha2("path", 256))
    p = r.select("job", F.posexplode("pieces").alias("ordinal", "p"), "sheet", "settings").select("job", "ordinal", "p.*", "sheet", "settings")
    s = r.select("job", F.posexplode("sourcePieces").alias("source_ordinal", "s")).select("job", F.col("s.id").alias("source_id"), F.col("s.geometry").alias("geometry"))
    return p.join(s, (p["job"] == s["job"]) & (F.col("sourcePieceId") == F.col("source_id")), "left").drop(s["job"])


def write_outcomes(outcomes: DataFrame, path: str) -> None:
    """One JSON object a row; absent fields are left out."""
    outcomes.select(F.to_json(F.struct("*")).alias("value")).write.text(path)


def write_events(events: DataFrame, path: str) -> None:
    """One line an event; the lines of a job are together and in order."""
    events.repartition("job_id").sortWithinPartitions("job_id", "ordinal").write.json(path)


def exact_decimal(c):
    """Whether a text is a canonical whole number."""
    return c.rlike("^(0|-?[1-9][0-9]*)$")


#: Settings of requests that are built from drawings or polygons.
DEFAULT_GEOMETRY = {"flatteningSagToleranceMm": 0.25, "clearanceSafetyMarginMm": 0.25, "geometryBackendId": "irregular-convex-v2-default", "geometryBackendVersion": "0"}
DEFAULT_OPTIMIZER = {
    "orderWindow": 4, "beamWidth": 8, "localCandidateFanout": 4, "localRepairBudget": 0, "intrinsicSharedArchiveEnabled": True, "transformCap": 8,
    "transformMinimumEdgeLengthMm": 1, "transformAngleDeduplicationToleranceDeg": 0.01, "configuredRotationEnabled": True, "edgeAlignmentEnabled": True,
    "gaEnabled": False, "baselineOnly": True, "gaPopulation": 12, "gaGenerationBudget": 2, "gaEvaluationBudget": 24, "gaTimeBudgetMs": 0, "gaSeed": "default",
    "priorityOrderMutationEnabled": True, "transformPreferenceMutationEnabled": True, "placementPolicyMutationEnabled": True,
    "placementPolicyId": "balanced-compactness",
}
DEFAULT_POLICIES = ["balanced-compactness", "short-side-fill", "edge-contact-then-balanced-compactness"]


def build_requests(pieces: DataFrame, sources: DataFrame, width: float, height: float, padding: int, timeout_ms: float, profile: str = "compact", allow_mirror: bool = True) -> DataFrame:
    """One request for each job as a JSON text.

    pieces: job_id, id, sourcePieceId, interchangeabilityKey, realBounds, paddedBounds, padding, allowRotation,
    allowMirror. sources: job_id, id, realBounds, geometry. Pieces and sources are listed by id.
    """
    fields = ["id", "sourcePieceId", "interchangeabilityKey", "realBounds", "paddedBounds", "padding", "allowRotation", "allowMirror"]
    p = pieces.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct(*fields)), lambda a, b: F.when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0)).alias("pieces"))
    s = sources.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("id", F.col("id").alias("sourceFileId"), F.col("id").alias("label"), "realBounds", "geometry")), lambda a, b: F.when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0)).alias("sourcePieces"))
    named = lambda of: [F.lit(v).alias(k) for k, v in of.items()]
    optimizer = F.struct(*named(DEFAULT_OPTIMIZER), F.array(*map(F.lit, DEFAULT_POLICIES)).alias("placementPolicyIds"), F.array().cast("array<double>").alias("configuredRotationDeg"))
    settings = F.struct(F.lit(padding).alias("padding"), F.lit(True).alias("allowGlobalRotation"), F.lit(allow_mirror).alias("allowGlobalMirror"), F.struct(*named(DEFAULT_GEOMETRY)).alias("geometry"), optimizer.alias("optimizer"))
    sheet = F.struct(F.lit(width).alias("width"), F.lit(height).alias("height"), F.lit(f"{width:g}x{height:g}").alias("label"))
    body = F.struct(F.lit(1).alias("version"), F.lit(timeout_ms).alias("timeoutMs"), F.lit(profile).alias("profile"), sheet.alias("sheet"), "pieces", "sourcePieces", settings.alias("settings"), F.lit("off").alias("historyMode"), F.lit("off").alias("diagnosticTraceMode"))
    return p.join(s, "job_id").select("job_id", F.to_json(body).alias("request"))


def polygon_requests(definitions: DataFrame, width: float, height: float, padding: int, timeout_ms: float = 300_000.0) -> DataFrame:
    """Requests of imported polygon definitions: instances by quantity, outlines as line segments."""
    from tessera.sources.polygons import instances

    box = lambda w, h: F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), w.alias("width"), h.alias("height"))
    i = instances(definitions, padding).withColumnRenamed("piece_id", "id")
    side = float(-(-padding // 2))
    padded = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.col("padded_width").alias("width"), F.col("padded_height").alias("height"), F.col("longest_edge").alias("longestEdge"), F.col("padded_area").alias("area"), "imbalance")
    pieces = i.select("job_id", "id", F.col("source_id").alias("sourcePieceId"), F.col("geometry_key").alias("interchangeabilityKey"), box(F.col("padded_width") - 2 * side, F.col("padded_height") - 2 * side).alias("realBounds"), padded.alias("paddedBounds"), F.lit(side).alias("padding"), F.col("allow_rotation").alias("allowRotation"), F.col("allow_mirror").alias("allowMirror"))
    ends = F.transform("ring", lambda p, k: F.struct(F.lit("line").alias("kind"), p["x"].alias("x1"), p["y"].alias("y1"), F.element_at("ring", (k + 1) % F.size("ring") + 1)["x"].alias("x2"), F.element_at("ring", (k + 1) % F.size("ring") + 1)["y"].alias("y2")))
    sources = definitions.where("error IS NULL").select("job_id", "id", box(F.col("width"), F.col("height")).alias("realBounds"), F.struct(F.lit("PRESET_SHAPE").alias("entityType"), F.lit(True).alias("closed"), ends.alias("segments")).alias("geometry"))
    return build_requests(pieces, sources, width, height, padding, timeout_ms)
