import json
import math
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from tessera import __main__ as cli
from tessera.functions import text
from tessera.kernels import boolean, convex
from tessera.operators import beam, lattice
from tessera.plans.checkpoints import checkpointed

SQUARE = [(0, 0), (10, 0), (10, 10), (0, 10)]


def test_boolean_areas_of_squares():
    other = convex.moved(SQUARE, 5, 5)
    area = {op: boolean.doubled_area(boolean.trapezoids(op, [SQUARE], [other])) for op in boolean.OPERATIONS}
    assert area == {"union": 350, "intersection": 50, "difference": 150, "xor": 300}
    bow_tie = [(0, 0), (10, 10), (10, 0), (0, 10)]
    assert boolean.doubled_area(boolean.trapezoids("union", [bow_tie], [])) == 100


def test_boolean_laws_on_random_rings():
    rng = random.Random(8)
    for _ in range(40):
        a, b = ([[(rng.randrange(40), rng.randrange(40)) for _ in range(rng.randrange(3, 7))] for _ in range(2)] for _ in range(2))
        area = {op: boolean.doubled_area(boolean.trapezoids(op, a, b)) for op in boolean.OPERATIONS}
        assert area["union"] == area["intersection"] + area["xor"]
        assert area["difference"] + area["intersection"] == boolean.doubled_area(boolean.trapezoids("union", a, []))
        assert boolean.doubled_area(boolean.trapezoids("union", b, a)) == area["union"]


@pytest.mark.parametrize(
    "value, want",
    [(0.0, "0"), (-0.0, "0"), (1.0, "1"), (-1.5, "-1.5"), (1e21, "1e+21"), (1e20, "100000000000000000000"), (1e-6, "0.000001"), (1e-7, "1e-7"), (1.25e-9, "1.25e-9"), (123456789012345680000.0, "123456789012345680000"), (0.1 + 0.2, "0.30000000000000004"), (5e-324, "5e-324"), (1.7976931348623157e308, "1.7976931348623157e+308"), (float("nan"), "NaN"), (float("-inf"), "-Infinity"), (100.0, "100"), (0.05, "0.05")],
)
def test_number_text(value, want):
    assert text.js_number(value) == want


def test_canonical_texts(spark):
    assert text.canonical_json({"b": [1, 2.5, None, True], "a": "é"}) == '{"a":"é","b":[1,2.5,null,true]}'
    df = spark.createDataFrame([("ab", "c"), ("a", "bc"), (None, "abc")], "x string, y string")
    assert len({r[0] for r in df.select(text.record_key(F.col("x"), F.col("y"))).collect()}) == 3
    order = spark.createDataFrame([(v,) for v in ("b", "A", "a", "B")], "v string").orderBy(text.locale_key(F.col("v"))).collect()
    assert [r.v for r in order] == ["a", "A", "b", "B"]
    assert spark.createDataFrame([(1e21,)], "v double").select(text.js_number_text("v")).first()[0] == "1e+21"


def _jobs(spark, n, pieces):
    rng = random.Random(5)
    jobs = spark.createDataFrame([(j, 100, 60) for j in range(n)], "job_id long, sheet_w long, sheet_h long")
    rows = [(j, k + 1, rng.randrange(10, 60), rng.randrange(10, 60)) for j in range(n) for k in range(pieces)]
    return jobs, spark.createDataFrame(rows, "job_id long, ord long, w long, h long"), rows


def test_frontier_is_legal_resumable_and_independent_of_partitions(spark):
    jobs, pieces, rows = _jobs(spark, 6, 4)
    whole = beam.run(jobs, pieces, checkpointed, 4, width=6)
    paused = beam.run(jobs, pieces.repartition(5), checkpointed, 2, width=6)
    resumed = beam.run(jobs, pieces, checkpointed, 2, frontier=paused, width=6)
    hashes = lambda df: {r.job_id: (r.frontier_hash, r.states) for r in beam.integrity(df).collect()}
    assert hashes(whole) == hashes(resumed)
    for r in whole.collect():
        assert r.depth == 4 and r.placed == len(r.boxes)
        for k, a in enumerate(r.boxes):
            assert a.x >= 0 and a.y >= 0 and a.x + a.w <= 100 and a.y + a.h <= 60
            assert not any(a.x < b.x + b.w and b.x < a.x + a.w and a.y < b.y + b.h and b.y < a.y + a.h for b in r.boxes[:k])
    best = {r.job_id: r.placed for r in beam.best(whole).collect()}
    assert len(best) == 6 and all(v >= 2 for v in best.values())


def test_lattices_of_boxes(spark):
    df = spark.createDataFrame([(10, 5)], "w long, h long")
    w, h = F.col("w"), F.col("h")
    legal = df.select(lattice.box_lattice_is_legal(w, h, w, F.lit(0), F.lit(3), h), lattice.box_lattice_is_legal(w, h, w - 1, F.lit(0), F.lit(3), h), lattice.far_enough(w, h, w, F.lit(0), F.lit(0), h * 2)).first()
    assert list(legal) == [True, False, True]


def test_command_line(spark, tmp_path, capsys):
    assert cli.main(["--info"]) == 0 and json.loads(capsys.readouterr().out)["engine"] == "tessera"
    assert cli.main([]) == 2
    good = {"version": 1, "polygons": [{"id": "a", "quantity": 3, "points": [[0, 0], [80, 0], [80, 40], [0, 40]]}]}
    Path(tmp_path, "p.json").write_text(json.dumps(good))
    assert cli.main(["run-polygons", f"{tmp_path}/p.json", "--sheet", "200", "200", "--padding", "10", "--out", f"{tmp_path}/out"]) == 0
    (row,) = [json.loads(x) for f in Path(tmp_path, "out").glob("part-*") for x in f.read_text().splitlines()]
    assert row["placed"] == 3 and row["legal"] and row["complete"]
    Path(tmp_path, "bad.json").write_text("{")
    assert cli.main(["run-polygons", f"{tmp_path}/bad.json", "--out", f"{tmp_path}/o2"]) == 3
    Path(tmp_path, "d").mkdir()
    Path(tmp_path, "d/c.dxf").write_text("0\nSECTION\n2\nENTITIES\n0\nCIRCLE\n10\n5\n20\n5\n40\n5\n0\nENDSEC\n0\nEOF\n")
    assert cli.main(["run-dxf", f"{tmp_path}/d", "--sheet", "50", "50", "--out", f"{tmp_path}/o3"]) == 0
    (row,) = [json.loads(x) for f in Path(tmp_path, "o3").glob("part-*") for x in f.read_text().splitlines()]
    assert row["placed"] == 1 and abs(row["hull"] / 2e6 - math.pi * 5.25**2) < 8


def test_no_fit_of_all_pairs(spark, sf):
    from tessera.kernels import convex
    from tessera.plans.instances import Instances
    from tessera.queries import QUERIES, with_ring

    pieces = {r.piece_id: (r.type, r.kind, [(p.x, p.y) for p in r.ring]) for r in with_ring(Instances(spark, sf).piece).collect()}
    got = {(r.first_id, r.second_id): r.doubled_area for r in QUERIES["convex_no_fit_all_pairs"](spark, sf).collect()}
    want = {(a, b): (p[2], q[2]) for a, p in pieces.items() for b, q in pieces.items() if a < b and p[0] == q[0]}
    assert set(got) == set(want) and {pieces[a][1] for a, _ in got} == {0, 1, 2}
    for pair in sorted(want)[::3]:
        fixed, moving = want[pair]
        assert got[pair] == convex.doubled_area(convex.no_fit_by_pairs(convex.hull(fixed), convex.hull(moving)))


def test_frontier_beam_goes_through_all_pieces(spark, sf):
    from tessera.plans.instances import Instances
    from tessera.queries import QUERIES

    most = {r.job_id: r.n for r in Instances(spark, sf).inst.groupBy("job_id").agg(F.max("ord").alias("n")).collect()}
    got = {r.job_id: r for r in QUERIES["frontier_beam"](spark, sf).collect()}
    assert all(got[k].depth == n for k, n in most.items()) and max(r.placed for r in got.values()) > 3


def test_registered_searches_try_all_turns(spark, sf, monkeypatch):
    from tessera import queries
    from tessera.search import capacity, jobs

    placed = []
    real = jobs.layout_jobs

    def kept(pieces, **options):
        out = real(pieces, **options).cache()
        placed.append([p for r in out.collect() for p in r.placements])
        assert options.get("cap", 8) == 8 and options.get("beam", capacity.BEAM) == 16
        return out

    monkeypatch.setattr(jobs, "layout_jobs", kept)
    for name in ("greedy_decoder", "layout_jobs"):
        assert queries.QUERIES[name](spark, sf).where("NOT legal").count() == 0
    assert all(any(p.mirrored for p in of) and any(p.rotation % 90 != 0 for p in of) for of in placed)


def test_short_side_takes_the_first_legal_layout(monkeypatch):
    from tessera.search import jobs

    ring = [{"x": x, "y": y} for x, y in ((0, 0), (40_000, 0), (40_000, 20_000), (0, 20_000))]
    shapes = jobs.prepare([{"id": f"p{k}", "ring": ring, "allow_rotation": True, "allow_mirror": True} for k in range(6)], 4_000)
    compact, _, _ = jobs.solve(shapes, (300_000, 300_000), 4)
    seen = []

    def fifth(layout, sheet):
        seen.append(layout)
        return len(seen) > 4

    monkeypatch.setattr(jobs, "legal", fifth)
    jobs.short_side(shapes, (300_000, 300_000), compact)
    assert len(seen) > 4
