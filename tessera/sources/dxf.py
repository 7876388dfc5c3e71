"""ASCII DXF drawings: one file is one piece. Files are read as binary rows, so any file system Spark knows will do."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of curve chords and of a directory's size.
ELLIPSE_SAG = 0.25
LEAST_CHORDS, MOST_CHORDS = 32, 2048
MOST_FILES = 1000
#: Group codes.
_CODES = {"LINE": (10, 20, 11, 21), "ARC": (10, 20, 40, 50, 51), "CIRCLE": (10, 20, 40), "ELLIPSE": (10, 20, 11, 21, 40)}

SEGMENT = "struct<kind:string,x1:double,y1:double,x2:double,y2:double,cx:double,cy:double,radius:double,startAngle:double,endAngle:double,sourceCurve:struct<kind:string,sourceId:string,cx:double,cy:double,majorAxisX:double,majorAxisY:double,axisRatio:double,startAngle:double,endAngle:double>>"
PIECE = f"path string, id string, width double, height double, geometry_key string, segments array<{SEGMENT}>, error string"


class DxfError(ValueError):
    """What is wrong, as ``place: fault``."""

    def __init__(self, place: str, fault: str):
        super().__init__(f"{place}: {fault}")


def group_pairs(text: str) -> list[tuple[int, str]]:
    """(code, value) of every two lines; pairs whose code is not a whole number are passed over."""
    lines = [x.strip() for x in text.split("\n")]
    if lines and not lines[-1]:
        lines.pop()
    if len(lines) % 2:
        raise DxfError("file", "last code has no value")
    out = []
    for code, value in zip(lines[::2], lines[1::2], strict=True):
        if code.lstrip("+-").isdigit() and code.isascii():
            out.append((int(code), value))
    return out


def entities(text: str) -> list[tuple[str, dict[int, str]]]:
    """Model-space LINE, ARC, CIRCLE and ELLIPSE entities of the ENTITIES section, in order, with the first value of each code."""
    out, section, current = [], None, None
    pairs = group_pairs(text)
    k = 0
    while k < len(pairs):
        code, value = pairs[k]
        k += 1
        if code != 0:
            continue
        body: dict[int, str] = {}
        start = k
        while k < len(pairs) and pairs[k][0] != 0:
            body.setdefault(*pairs[k])
            k += 1
        if value == "SECTION":
            names = [v for c, v in pairs[start:k] if c == 2]
            section = names[-1] if names else None
        elif value == "ENDSEC":
            section = None
        elif section == "ENTITIES" and value in _CODES:
            current = (value, body)
            space = _number(body, 67)
            if space not in (None, 0.0, 1.0):
                raise DxfError("code 67", f"space {body[67]!r} is neither 0 nor 1")
            if space != 1.0:
                out.append(current)
    return out


def _number(body: dict[int, str], code: int) -> float | None:
    if code not in body:
        return None
    try:
        value = float(body[code])
    except ValueError:
        raise DxfError(f"code {code}", f"{body[code]!r} is no number") from None
    if not math.isfinite(value):
        raise DxfError(f"code {code}", "infinite or NaN")
    return value


def _numbers(kind: str, body: dict[int, str]) -> list[float]:
    out = []
    for code in _CODES[kind]:
        value = _number(body, code)
        if value is None:
            raise DxfError(kind, f"no code {code}")
        out.append(value)
    return out


def parsed(kind: str, body: dict[int, str]) -> dict:
    v = _numbers(kind, body)
    if kind == "LINE":
        return {"kind": kind, "a": (v[0], v[1]), "b": (v[2], v[3])}
    if kind == "ELLIPSE":
        start, end = _number(body, 41), _number(body, 42)
        e = {"kind": kind, "c": (v[0], v[1]), "m": (v[2], v[3]), "ratio": v[4], "start": 0.0 if start is None else start, "end": math.tau if end is None else end}
        if not math.hypot(*e["m"]) > 0:
            raise DxfError(kind, "major axis of length 0")
        if not e["ratio"] > 0:
            raise DxfError(kind, f"axis ratio {e['ratio']}")
        e["sweep"] = e["end"] - e["start"] if e["end"] > e["start"] else e["end"] + math.tau - e["start"]
        if not 0 < e["sweep"] <= math.tau:
            raise DxfError(kind, "sweep beyond one turn")
        return e
    if not v[2] > 0:
        raise DxfError(kind, f"radius {v[2]}")
    if kind == "CIRCLE":
        return {"kind": kind, "c": (v[0], v[1]), "r": v[2]}
    sweep = v[4] - v[3] if v[4] > v[3] else v[4] - v[3] + 360.0
    if not 0 < sweep <= 360.0:
        raise DxfError(kind, "sweep beyond one turn")
    return {"kind": kind, "c": (v[0], v[1]), "r": v[2], "start": v[3], "end": v[3] + sweep}


def _on_arc(e: dict, degrees: float) -> tuple[float, float]:
    a = math.radians(degrees)
    return e["c"][0] + e["r"] * math.cos(a), e["c"][1] + e["r"] * math.sin(a)


def _on_ellipse(e: dict, t: float) -> tuple[float, float]:
    c, s = math.cos(t), math.sin(t)
    return e["c"][0] + e["m"][0] * c - e["m"][1] * e["ratio"] * s, e["c"][1] + e["m"][1] * c + e["m"][0] * e["ratio"] * s


def extremes(e: dict) -> list[tuple[float, float]]:
    """Points among which are the outermost of an entity in each direction."""
    if e["kind"] == "LINE":
        return [e["a"], e["b"]]
    if e["kind"] == "CIRCLE":
        (x, y), r = e["c"], e["r"]
        return [(x - r, y - r), (x + r, y + r)]
    if e["kind"] == "ARC":
        quarters = range(math.ceil(e["start"] / 90.0), math.floor(e["end"] / 90.0) + 1)
        return [_on_arc(e, d) for d in (e["start"], e["end"], *(90.0 * q for q in quarters))]
    end, at = e["start"] + e["sweep"], [e["start"], e["start"] + e["sweep"]]
    for across, along in ((-e["m"][1] * e["ratio"], e["m"][0]), (e["m"][0] * e["ratio"], e["m"][1])):
        for base in (math.atan2(across, along), math.atan2(across, along) + math.pi):
            t = base + math.ceil((e["start"] - base) / math.tau) * math.tau
            at += [t] if t <= end else []
    return [_on_ellipse(e, t) for t in at]


def ellipse_chords(e: dict) -> int:
    major = math.hypot(*e["m"])
    long, short = major * max(e["ratio"], 1.0), major * min(e["ratio"], 1.0)
    worst = long * long / short
    if worst <= ELLIPSE_SAG:
        return LEAST_CHORDS
    return min(MOST_CHORDS, max(LEAST_CHORDS, math.ceil(math.tau / (2.0 * math.acos(1.0 - ELLIPSE_SAG / worst)))))


def segments_of(found: list[dict], x0: float, y0: float) -> list[dict]:
    """Segments moved so that the drawing starts at (0, 0), in order; a circle is two arcs, an ellipse chords that remember it."""
    out, n_ellipse = [], 0
    none = {k: None for k in ("cx", "cy", "radius", "startAngle", "endAngle", "sourceCurve")}

    def line(a, b, curve=None) -> dict:
        return {"kind": "line", "x1": a[0] - x0, "y1": a[1] - y0, "x2": b[0] - x0, "y2": b[1] - y0, **none, "sourceCurve": curve}

    def arc(e: dict, start: float, end: float) -> dict:
        a, b = _on_arc(e, start), _on_arc(e, end)
        return {"kind": "arc", "x1": a[0] - x0, "y1": a[1] - y0, "x2": b[0] - x0, "y2": b[1] - y0, "cx": e["c"][0] - x0, "cy": e["c"][1] - y0, "radius": e["r"], "startAngle": start, "endAngle": end, "sourceCurve": None}

    for e in found:
        if e["kind"] == "LINE":
            out.append(line(e["a"], e["b"]))
        elif e["kind"] == "ARC":
            first = e["start"] % 360.0
            out.append(arc(e, first, first + e["end"] - e["start"]))
        elif e["kind"] == "CIRCLE":
            out += [arc(e, 0.0, 180.0), arc(e, 180.0, 360.0)]
        else:
            n = ellipse_chords(e)
            points = [_on_ellipse(e, e["start"] + e["sweep"] * k / n) for k in range(n + 1)]
            curve = {"kind": "ellipse", "sourceId": f"ellipse:{n_ellipse}", "cx": e["c"][0] - x0, "cy": e["c"][1] - y0, "majorAxisX": e["m"][0], "majorAxisY": e["m"][1], "axisRatio": e["ratio"], "startAngle": e["start"], "endAngle": e["end"]}
            n_ellipse += 1
            out += [line(a, b, curve) for a, b in zip(points, points[1:], strict=False)]
    return out


def geometry_key(width: float, height: float, segments: list[dict], allow_rotation: bool = True, allow_mirror: bool = True) -> str:
    """Identity of interchangeable pieces: size, segments and what may be done with them."""
    said = json.dumps([width, height, segments, allow_rotation, allow_mirror], sort_keys=True, separators=(",", ":"))
    return hashlib.sha256(said.encode()).hexdigest()


def import_piece(path: str, content: bytes) -> dict:
    """One drawing as a piece, or with the error that stopped it."""
    out = {"path": path, "id": None, "width": None, "height": None, "geometry_key": None, "segments": None, "error": None}
    try:
        name = path.rsplit("/", 1)[-1]
        out["id"] = name[:-4] if name.lower().endswith(".dxf") else name
        if not out["id"].strip():
            raise DxfError("file", "name is only an ending")
        found = [parsed(*e) for e in entities(content.decode("utf-8", "replace"))]
        points = [p for e in found for p in extremes(e)]
        if not points:
            raise DxfError("file", "nothing to cut")
        x0, y0, x1, y1 = min(p[0] for p in points), min(p[1] for p in points), max(p[0] for p in points), max(p[1] for p in points)
        if not all(map(math.isfinite, (x0, y0, x1, y1, x1 - x0, y1 - y0))):
            raise DxfError("file", "bounds overflow")
        out["segments"] = segments_of(found, x0, y0)
        out["width"], out["height"] = float(max(1, math.ceil(x1 - x0))), float(max(1, math.ceil(y1 - y0)))
        out["geometry_key"] = geometry_key(out["width"], out["height"], out["segments"])
    except DxfError as error:
        out["error"] = str(error)
    return out


def _import(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame([import_piece(p, bytes(c)) for p, c in zip(pdf["path"], pdf["content"], strict=True)], columns=[x.split()[0] for x in ("path", "id", "width", "height", "geometry_key", "segments", "error")])


def import_drawings(files: DataFrame) -> DataFrame:
    """files: path, content. A row for each file; a bad one has an error and stops no other."""
    return files.select("path", "content").mapInPandas(_import, PIECE)


def read_directory(spark: SparkSession, folder: str) -> DataFrame:
    """All .dxf files of a folder, whatever the case of their ending."""
    return import_drawings(spark.read.format("binaryFile").option("pathGlobFilter", "*.[dD][xX][fF]").load(folder))


def first_error(pieces: DataFrame) -> DataFrame:
    """The error of the first bad file by path, and whether there are too many files or none."""
    g = pieces.agg(F.count(F.lit(1)).alias("files"), F.min_by("error", F.when(F.col("error").isNotNull(), F.col("path"))).alias("error"))
    return g.select("files", F.when(F.col("files") == 0, "folder: no drawings").when(F.col("files") > MOST_FILES, f"folder: over {MOST_FILES} drawings").otherwise(F.col("error")).alias("error"))
