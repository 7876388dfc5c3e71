import json

from pathlib import Path

import pytest
from pyspark.sql import functions as F
from tessera.kernels import convex, curves
from tessera.operators import relations
from tessera.sources import dxf, polygons, requests

DRAWING = "0\nSECTION\n2\nENTITIES\n{}0\nENDSEC\n0\nEOF\n"
LINE = "0\nLINE\n10\n1\n20\n1\n11\n21\n21\n1\n"


def doc(*defs, version=1):
    return json.dumps({"version": version, "polygons": list(defs)})


SQUARE = [[0, 0], [4, 0], [4, 4], [0, 4]]


@pytest.mark.parametrize(
    "text, says",
    [
        ("{", "document: no JSON"),
        (doc({"id": "a", "points": SQUARE}, version=2), "version: 2"),
        (doc(), "polygons: 0 definitions"),
        (json.dumps({"version": 1, "polygons": [], "x": 1}), "document: fields"),
        (doc({"id": "a", "points": SQUARE, "hole": 1}), "polygons[0]: field unknown"),
        (doc({"id": " ", "points": SQUARE}), "polygons[0].id: blank"),
        (doc({"id": "x" * 257, "points": SQUARE}), "over 256 characters"),
        (doc({"id": "a", "points": SQUARE}, {"id": "a", "points": SQUARE}), "polygons[1].id: taken"),
        (doc({"id": "a", "points": SQUARE, "quantity": 0}), "polygons[0].quantity: 0"),
        (doc({"id": "a", "points": SQUARE, "quantity": 10_001}), "over 10000 pieces"),
        (doc({"id": "a", "points": SQUARE[:2]}), "2 corners"),
        (doc({"id": "a", "points": [*SQUARE, [0, 0], [1, 1]]}), "visited twice"),
        (doc({"id": "a", "points": [[0, 0], [1, 1], [2, 2]]}), "one line"),
        (doc({"id": "a", "points": [[0, 0], [4, 4], [4, 0], [0, 4]]}), "sides meet"),
        (doc({"id": "a", "points": [[0, 0], [4, 0], [2, 0], [2, 4]]}), "sides meet"),
        (doc({"id": "a", "points": [[0, 0], ["1", 0], [2, 4]]}), "not two numbers"),
    ],
)
def test_bad_documents(text, says):
    with pytest.raises(polygons.PolygonError, match=says.replace("[", r"\[").replace("]", r"\]")):
        polygons.import_document(text)


def test_documents_are_normalised(spark):
    points = [{"x": 10, "y": 20}, {"x": 70, "y": 20}, {"x": 70, "y": 20}, {"x": 40, "y": 60.5}, {"x": 10, "y": 20}]
    rows = [(1, doc({"id": "t", "points": points, "allowMirror": False}, {"id": "s", "quantity": 2, "points": SQUARE[::-1]})), (2, "{"), (3, None)]
    got = polygons.import_documents(spark.createDataFrame(rows, "job_id long, document string")).collect()
    good = {r.id: r for r in got if r.error is None}
    assert [(p.x, p.y) for p in good["t"].ring] == [(0, 0), (30, 40.5), (60, 0)] and good["t"].height == 41 and not good["t"].allow_mirror
    assert [(p.x, p.y) for p in good["s"].ring] == [(0, 0), (0, 4), (4, 4), (4, 0)]
    assert {r.job_id for r in got if r.error} == {2, 3}
    i = polygons.instances(polygons.import_documents(spark.createDataFrame(rows, "job_id long, document string")), 10).collect()
    assert {r.piece_id for r in i} == {"t#1", "s#1", "s#2"}
    assert {(r.padded_width, r.padded_height, r.longest_edge, r.imbalance) for r in i if r.source_id == "t"} == {(70.0, 51.0, 70.0, 19.0)}


@pytest.mark.parametrize(
    "body, says",
    [
        ("0\n", "no value"),
        ("", "nothing to cut"),
        ("0\nLINE\n10\n1\n", "LINE: no code 20"),
        ("0\nCIRCLE\n10\n1\n20\n1\n40\n-1\n", "CIRCLE: radius -1"),
        ("0\nLINE\n10\nx\n20\n1\n11\n1\n21\n1\n", "no number"),
        ("0\nLINE\n10\ninf\n20\n1\n11\n1\n21\n1\n", "infinite"),
        ("0\nELLIPSE\n10\n0\n20\n0\n11\n0\n21\n0\n40\n1\n", "major axis"),
        ("0\nLINE\n67\n2\n10\n1\n20\n1\n11\n1\n21\n1\n", "code 67"),
    ],
)
def test_bad_drawings(body, says):
    text = DRAWING.format(body) if body != "0\n" else "0\nSECTION\n2\n"
    assert says in dxf.import_piece("a/b.dxf", text.encode())["error"]


def test_drawing_entities_and_bounds():
    body = LINE + "0\nLINE\n67\n1\n10\n-99\n20\n0\n11\n0\n21\n0\n" + "0\nARC\n10\n21\n20\n21\n40\n20\n50\n270\n51\n90\n" + "0\nCIRCLE\n10\n61\n20\n21\n40\n10\n" + "0\nELLIPSE\n10\n101\n20\n21\n11\n20\n21\n0\n40\n0.5\n41\n0\n42\n6.283185307179586\n"
    p = dxf.import_piece("x/Part.DXF", DRAWING.format(body).replace("\n", "\r\n").encode())
    assert p["error"] is None and p["id"] == "Part" and (p["width"], p["height"]) == (120.0, 40.0)
    kinds = [s["kind"] for s in p["segments"]]
    assert kinds[:4] == ["line", "arc", "arc", "arc"]
    assert all(s["sourceCurve"]["sourceId"] == "ellipse:0" for s in p["segments"][4:]) and len(p["segments"]) - 4 >= 32
    hull = convex.hull([(round(x * 1000), round(y * 1000)) for x, y in curves.outline_points(p["segments"])])
    x0, y0, x1, y1 = convex.bounds(hull)
    assert abs(x0) <= 1 and abs(x1 - 120_000) <= 1 and abs(y1 - y0 - 40_000) < 300


def test_sources_outside_the_entities_section_are_ignored():
    assert "nothing to cut" in dxf.import_piece("a.dxf", f"0\nSECTION\n2\nBLOCKS\n{LINE}0\nENDSEC\n".encode())["error"]


def test_directory(spark, tmp_path):
    for name, text in (("b.dxf", DRAWING.format(LINE + "0\nCIRCLE\n10\n1\n20\n1\n40\n3\n")), ("A.DXF", DRAWING.format("")), ("c.txt", "")):
        Path(tmp_path, name).write_text(text)
    got = dxf.read_directory(spark, str(tmp_path))
    assert {r.id: r.error is None for r in got.collect()} == {"b": True, "A": False}
    assert dxf.first_error(got).first().error.endswith("nothing to cut")


def request(**change):
    piece = {"id": "p", "sourcePieceId": "s", "padding": 0, "allowRotation": True, "allowMirror": False, "realBounds": {"x": 0, "y": 0, "width": 10, "height": 10}}
    source = {"id": "s", "geometry": {"entityType": "LINE", "closed": True, "segments": [{"kind": "line", "x1": 0, "y1": 0, "x2": 10, "y2": 0}]}}
    settings = {"padding": 0, "geometry": {"flatteningSagToleranceMm": 0.1, "clearanceSafetyMarginMm": 0.1}, "optimizer": {"beamWidth": 1, "placementPolicyId": "a", "placementPolicyIds": ["a"]}}
    return {"version": 1, "timeoutMs": 1000, "profile": "compact", "sheet": {"width": 100, "height": 100, "label": "x"}, "pieces": [piece], "sourcePieces": [source], "settings": settings, "unknown": 1} | change


def test_requests_are_validated_without_losing_rows(spark, tmp_path):
    two = request()["pieces"] * 2
    cases = {
        "ok": (request(), None),
        "v": (request(version=3), "version"),
        "t": (request(timeoutMs=0), "timeoutMs"),
        "w": (request(sheet={"width": 1.5, "height": 1, "label": ""}), "sheet.width"),
        "e": (request(pieces=[]), "pieces"),
        "d": (request(pieces=two), "pieces.id"),
        "c": (request(settings=request()["settings"] | {"geometry": {"flatteningSagToleranceMm": 1, "clearanceSafetyMarginMm": 0.1}}), "settings.geometry.clearanceSafetyMarginMm"),
    }
    for name, (r, _) in cases.items():
        Path(tmp_path, f"{name}.json").write_text(json.dumps(r, indent=1))
    Path(tmp_path, "broken.json").write_text("{")
    rows = requests.read_requests(spark, str(tmp_path)).cache()
    assert rows.where("_corrupt_record IS NOT NULL").count() == 1
    found = {r.path.rsplit("/", 1)[1][:-5]: r.invalid_field for r in relations.validate_requests(requests.request_facts(rows.where("_corrupt_record IS NULL"))).collect()}
    assert found == {k: v[1] for k, v in cases.items()}
    pieces = requests.explode_pieces(rows.where("_corrupt_record IS NULL AND version = 1")).collect()
    assert all(p.geometry is not None for p in pieces)


def test_desktop_requests_get_defaults(spark, tmp_path):
    r = request()
    body = {"version": 1, "jobId": "j", "padding": 10, "sheet": r["sheet"], "pieces": r["pieces"], "sourcePieces": r["sourcePieces"], "options": {"timeoutMs": 5, "irregularSettings": {"geometry": r["settings"]["geometry"], "optimizer": r["settings"]["optimizer"]}}}
    Path(tmp_path, "d.json").write_text(json.dumps(body))
    (got,) = requests.read_requests(spark, str(tmp_path), desktop=True).collect()
    assert got.settings.padding == 10 and got.settings.allowGlobalMirror and got.diagnosticTraceMode == "full" and got.timeoutMs == 5


def test_sinks(spark, tmp_path):
    events = spark.createDataFrame([(j, k, "x") for j in range(3) for k in (2, 0, 1)], "job_id long, ordinal long, kind string")
    requests.write_events(events, f"{tmp_path}/e")
    lines = [json.loads(x) for f in sorted(Path(tmp_path, "e").glob("part-*")) for x in f.read_text().splitlines()]
    for j in range(3):
        assert [x["ordinal"] for x in lines if x["job_id"] == j] == [0, 1, 2]
    requests.write_outcomes(spark.createDataFrame([(1, None)], "job_id long, error string"), f"{tmp_path}/o")
    assert [json.loads(f.read_text()) for f in Path(tmp_path, "o").glob("part-*") if f.read_text()] == [{"job_id": 1}]
    ok = spark.createDataFrame([("0",), ("-12",), ("01",), ("1.0",)], "v string").select(requests.exact_decimal(F.col("v"))).collect()
    assert [r[0] for r in ok] == [True, True, False, False]

