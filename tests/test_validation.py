"""Whole requests, gates, the order of gaps and identities of turned layouts."""

import json
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F
from tessera.functions import grid
from tessera.kernels import boolean, convex
from tessera.kernels.regions import region_at
from tessera.operators import geometry, kernels, pareto, validation
from tessera.search import jobs, periodic
from tessera.search.decoder import Layout, Search, Shape
from tessera.sources import requests


def whole():
    rect = {"x": 0, "y": 0, "width": 10, "height": 20}
    piece = {"id": "p", "sourcePieceId": "s", "realBounds": rect, "paddedBounds": rect | {"longestEdge": 20, "area": 200, "imbalance": 10}, "padding": 0, "allowRotation": True}
    curve = {"kind": "ellipse", "sourceId": "e", "cx": 0, "cy": 0, "majorAxisX": 1, "majorAxisY": 0, "axisRatio": 0.5, "startAngle": 0, "endAngle": 1}
    line = {"kind": "line", "x1": 0, "y1": 0, "x2": 1, "y2": 0, "sourceCurve": curve}
    arc = {"kind": "arc", "x1": 0, "y1": 0, "x2": 1, "y2": 0, "cx": 0, "cy": 0, "radius": 1, "startAngle": 0, "endAngle": 1}
    source = {"id": "s", "sourceFileId": "f", "label": "", "realBounds": rect, "geometry": {"entityType": "LINE", "closed": True, "segments": [line, arc]}}
    geometry_ = {"flatteningSagToleranceMm": 0.1, "clearanceSafetyMarginMm": 0.1, "geometryBackendId": "b", "geometryBackendVersion": "0"}
    optimizer = {"orderWindow": 1, "beamWidth": 1, "transformCap": 1, "gaPopulation": 1, "gaTimeBudgetMs": 0, "gaSeed": "x", "configuredRotationDeg": [0, 90]}
    return {"version": 1, "timeoutMs": 1, "sheet": {"width": 1, "height": 1}, "pieces": [piece, piece | {"id": "q"}], "sourcePieces": [source], "settings": {"padding": 0, "geometry": geometry_, "optimizer": optimizer}}


def with_(path, value):
    r = json.loads(json.dumps(whole()))
    at = r
    *way, last = path
    for k in way:
        at = at[k]
    if value is None:
        del at[last]
    else:
        at[last] = value
    return r


SEGMENTS = ["sourcePieces", 0, "geometry", "segments"]
OPTIMIZER = ["settings", "optimizer"]
CASES = [
    (whole(), None),
    (with_(["version"], 2), "version"),
    (with_(["timeoutMs"], None), "timeoutMs"),
    (with_(["sheet", "height"], 0.5), "sheet.height"),
    (with_(["pieces"], []), "pieces"),
    (with_(["pieces"], None), "pieces"),
    (with_(["sourcePieces"], None), None),
    (with_(["pieces", 1, "id"], " "), "pieces[1].id"),
    (with_(["pieces", 1, "id"], "p"), "pieces[1].id"),
    (with_(["pieces", 1, "paddedBounds"], None), "pieces[1].paddedBounds.x"),
    (with_(["pieces", 0, "interchangeabilityKey"], ""), "pieces[0].interchangeabilityKey"),
    (with_(["pieces", 0, "padding"], -1), "pieces[0].padding"),
    (with_(["pieces", 1, "paddedBounds", "area"], 2**53 + 2), "pieces[1].paddedBounds.area"),
    (with_(["sourcePieces"], whole()["sourcePieces"] * 2), "sourcePieces[1].id"),
    (with_([*SEGMENTS, 0, "kind"], "spline"), "sourcePieces[0].geometry.segments[0].kind"),
    (with_([*SEGMENTS, 1, "radius"], 0), "sourcePieces[0].geometry.segments[1].radius"),
    (with_([*SEGMENTS, 0, "sourceCurve", "majorAxisX"], 0), "sourcePieces[0].geometry.segments[0].sourceCurve.majorAxis"),
    (with_([*SEGMENTS, 0, "sourceCurve"], None), None),
    (with_(["settings", "geometry", "flatteningSagToleranceMm"], 0.2), "settings.geometry.clearanceSafetyMarginMm"),
    (with_([*OPTIMIZER, "localRepairBudget"], -1), "settings.optimizer.localRepairBudget"),
    (with_([*OPTIMIZER, "gaSeed"], ""), "settings.optimizer.gaSeed"),
    (with_([*OPTIMIZER, "placementPolicyIds"], []), "settings.optimizer.placementPolicyIds"),
    (with_([*OPTIMIZER, "placementPolicyId"], "other"), "settings.optimizer.placementPolicyId"),
    (with_([*OPTIMIZER, "placementPolicyIds"], ["balanced-compactness"] * 2), "settings.optimizer.placementPolicyIds"),
]


def test_first_invalid_path_of_whole_requests(spark):
    rows = spark.createDataFrame([(k, json.dumps(r)) for k, (r, _) in enumerate(CASES)], "job_id long, text string")
    parsed = rows.select("job_id", F.from_json("text", requests.REQUEST).alias("r")).select("job_id", "r.*")
    got = {r.job_id: r.invalid_path for r in validation.invalid_path(parsed).select("job_id", "invalid_path").collect()}
    assert got == {k: says for k, (_, says) in enumerate(CASES)}


def test_identity_of_rings_holds_for_quarter_turns_only(spark):
    shapes = [[(0, 0), (4, 0), (0, 3)], [(5, 1), (9, 1), (9, 8), (6, 8)]]
    spin = lambda r, n: r if not n else spin([(-y, x) for x, y in r], n - 1)
    layouts = [[[(x + 7, y - 3) for x, y in spin(r, n)][n % 3 :] + [(x + 7, y - 3) for x, y in spin(r, n)][: n % 3] for r in (shapes if n % 2 else shapes[::-1])] for n in range(4)]
    layouts += [[[(0, 0), (4, 0), (4, 3), (0, 3)], shapes[1]], [shapes[0], [(x + 1, y) for x, y in shapes[1]]]]
    rows = [(k, [{"x": x, "y": y} for x, y in r]) for k, rings in enumerate(layouts) for r in rings]
    got = {r.job_id: r.layout_hash for r in geometry.ring_layout_identity(spark.createDataFrame(rows, "job_id long, ring array<struct<x:long,y:long>>")).collect()}
    assert len({got[k] for k in range(4)}) == 1 and len(set(got.values())) == 3


def test_layers_beyond_the_limit_are_an_error(spark, sf):
    rows = [(1, k, 0, 0, k, k, k, 0, 1, 0) for k in range(1, 5)]
    e = spark.createDataFrame(rows, "job_id long, endpoint_id long, cavities long, cavity_area long, max_side long, area long, span long, gap long, hull long, waste long")
    assert sorted(r.layer for r in pareto.layers(e, lambda df: df).collect()) == [1, 2, 3, 4]
    with pytest.raises(ValueError, match="layers"):
        pareto.layers(e, lambda df: df, most=2)


def test_gap_contained_places_lie_in_the_smallest_gap():
    # a frame of four bars around a hole of 40 x 40, and a notch of 100 x 20 above it
    bars = [[(0, 0), (100, 0), (100, 30), (0, 30)], [(0, 70), (100, 70), (100, 100), (0, 100)], [(0, 30), (30, 30), (30, 70), (0, 70)], [(70, 30), (100, 30), (100, 70), (70, 70)], [(0, 100), (10, 100), (10, 120), (0, 120)], [(90, 100), (100, 100), (100, 120), (90, 120)]]
    shapes = {str(k): Shape(str(k), str(k), ((0.0, False, tuple(r)),), 1) for k, r in enumerate(bars)}
    layout = Layout()
    for s in shapes.values():
        layout = layout.placed(s, 0, 0, 0)
    assert region_at(convex.hull([p for r in bars for p in r]), bars, Fraction(50), Fraction(50)) == 2 * 1600
    for side, inside in ((15, True), (18, True), (60, False)):
        one = Shape("m", f"m{side}", ((0.0, False, ((0, 0), (side, 0), (side, side), (0, side))),), 1)
        c = Search().best(layout, shapes | {"m": one}, one, "gap-contained")
        box = (c[5], c[4], c[5] + side, c[4] + side)
        assert (30 <= box[0] and box[2] <= 70 and 30 <= box[1] and box[3] <= 70) == inside
        held = Search.in_hull(layout, one, Search().scored(layout, shapes | {"m": one}, one))
        hull = convex.hull([p for r in bars for p in r])
        for s in Search().scored(layout, shapes | {"m": one}, one):
            ring = convex.moved([(0, 0), (side, 0), (side, side), (0, side)], s[5], s[4])
            assert (s in held) == (boolean.doubled_area(boolean.trapezoids("difference", [ring], [hull])) == 0)


def test_regions_hold_their_points():
    rng = random.Random(5)
    outer = [(0, 0), (60, 0), (60, 60), (0, 60)]
    rings = [[(x, y), (x + 8, y), (x + 8, y + 8), (x, y + 8)] for x in (0, 20, 40) for y in (0, 20, 40)]
    for _ in range(50):
        x, y = rng.randrange(1, 120), rng.randrange(1, 120)
        p = Fraction(x, 2), Fraction(y, 2)
        if not any(r[0][0] <= p[0] <= r[2][0] and r[0][1] <= p[1] <= r[2][1] for r in rings):
            assert region_at(outer, rings, *p) == 2 * (3600 - 9 * 64)


def test_quarter_turn_of_a_ring(spark):
    got = spark.range(1).select(grid.quarter_turn(F.array(grid.point(F.lit(1), F.lit(2))), F.lit(90), F.lit(False)).alias("r")).first().r
    assert (got[0].x, got[0].y) == (-2, 1)


def test_line_crossings_bound_what_is_inside():
    rng = random.Random(8)
    for _ in range(30):
        rings = [r for r in (convex.hull([(rng.randrange(30), rng.randrange(30)) for _ in range(5)]) for _ in range(3)) if len(r) > 2]
        for axis in (0, 1):
            for value in (0, 7, 15):
                points = periodic.line_crossings(rings, axis, value)
                on = [p[1 - axis] for p in points]
                assert on == sorted(set(on)) and all(p[axis] == value for p in points)
                inside = lambda t: any(convex.strictly_inside(r, (value, t) if axis == 0 else (t, value)) for r in rings)
                for p in points:
                    assert not inside(p[1 - axis])
                # between neighbouring crossings a point is in the union throughout or nowhere
                for a, b in zip(on, on[1:], strict=False):
                    assert len({inside(a + (b - a) * Fraction(k, 7)) for k in (1, 3, 6)}) == 1


def test_reconstruction_orders_follow_the_centres_and_skip_what_is_alike():
    ring = ((0, 0), (10_000, 0), (10_000, 10_000), (0, 10_000))
    shapes = [Shape(str(k), "a" if k < 2 else "b", ((0.0, False, ring if k < 2 else tuple((2 * x, y) for x, y in ring)),), 1) for k in range(4)]
    by_id = {s.id: s for s in shapes}
    search = Search()
    layout = search.decode(shapes, by_id)
    orders = jobs.endpoint_orders(shapes, layout)
    assert [[s.id for s in o] for o in orders][0] == ["3", "2", "1", "0"] and all(sorted(s.id for s in o) == ["0", "1", "2", "3"] for o in orders)
    x = {i: convex.bounds(r)[0] + convex.bounds(r)[2] for i, r in zip(layout.ids, layout.rings, strict=True)}
    assert [x[s.id] for s in orders[1]] == sorted(x.values()) and [x[s.id] for s in orders[2]] == sorted(x.values(), reverse=True)
    found = jobs.reconstructions(search, shapes, by_id, layout)
    assert 1 <= len(found) <= 10 and all(len(e.ids) == 4 and jobs.legal(e, None) for e in found)
    assert not jobs.reconstructions(Search(), shapes[:2], by_id, layout) and not jobs.reconstructions(Search(), shapes, by_id, layout, most=0)
    assert 0 < search.hits < search.lookups


def test_free_regions_of_rings_of_different_lengths(spark):
    point = "array<array<struct<x:long,y:long>>>"
    rings = [[(0, 0), (40, 0), (40, 100), (0, 100)], [(40, 0), (60, 0), (40, 20)], [(60, 0), (100, 0), (100, 100), (60, 100)], [(40, 60), (60, 60), (60, 100), (40, 100)]]
    df = spark.createDataFrame([(1, 100, 100, [[{"x": x, "y": y} for x, y in r] for r in rings]), (2, 10, 10, [])], f"job_id long, sheet_w long, sheet_h long, rings {point}")
    got = {r.job_id: (r.regions, r.total) for r in kernels.free_regions(df).collect()}
    assert got == {1: (1, str(2 * (20 * 60) - 400)), 2: (1, "200")}
