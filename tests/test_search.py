import random
from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F
from tessera.functions import grid
from tessera.kernels import convex
from tessera.search import capacity, jobs, periodic
from tessera.search.decoder import Layout, Search, metrics
from tessera.streaming import events as streams

TRIANGLE = [(0, 60_000), (35_000, 0), (70_000, 60_000)]


def rows(rings, sheet, padding=10_000, job=1):
    return [{"job_id": job, "id": f"p{k}", "ring": [{"x": x, "y": y} for x, y in r], "allow_rotation": True, "allow_mirror": True, "padding": padding, "sheet_w": sheet[0], "sheet_h": sheet[1]} for k, r in enumerate(rings)]


def check(out, n, sheet):
    assert out["status"] == "success" and out["legal"]
    assert out["placed"] + out["unplaced"] == n
    assert {p["id"] for p in out["placements"]} | set(out["unplaced_ids"]) == {f"p{k}" for k in range(n)}


def test_roomy_sheet_takes_all_triangles_tightly():
    out = jobs.solve_job(pd.DataFrame(rows([TRIANGLE] * 20, (2_000_000, 2_700_000))), 16, 8, False)
    check(out, 20, None)
    assert out["placed"] == 20 and out["area"] <= 74_428_143_126


def test_short_side_profile_fills_the_short_side():
    data = [r | {"profile": "compact-short-side"} for r in rows([TRIANGLE] * 20, (2_000_000, 2_700_000))]
    out = jobs.solve_job(pd.DataFrame(data), 4, 8, False)
    check(out, 20, None)
    assert out["placed"] == 20 and out["span"] - (out["area"] // out["max_side"]) == out["max_side"] > 1_700_000
    data = [r | {"profile": "compact-short-side"} for r in rows([TRIANGLE] * 20, (600_000, 400_000))]
    out = jobs.solve_job(pd.DataFrame(data), 4, 8, False)
    assert out["placed"] == 20 and out["legal"] and out["area"] <= 90_196_748_722


def test_small_sheet_takes_at_least_seventeen():
    sheet = (300_000, 300_000)
    out = jobs.solve_job(pd.DataFrame(rows([TRIANGLE] * 20, sheet)), 8, 8, False)
    check(out, 20, sheet)
    assert out["placed"] >= 17 and max(out["max_side"], 0) <= 300_000


def test_every_layout_is_legal_and_does_not_depend_on_row_order():
    rng = random.Random(3)
    for _ in range(3):
        rings = [[(0, 0), (rng.randrange(20, 90) * 1000, 0), (rng.randrange(20, 90) * 1000, rng.randrange(20, 90) * 1000)] for _ in range(6)]
        sheet = (160_000, 150_000)
        data = rows(rings, sheet)
        out = jobs.solve_job(pd.DataFrame(data), 4, 4, False)
        check(out, 6, sheet)
        rng.shuffle(data)
        again = jobs.solve_job(pd.DataFrame(data), 4, 4, False)
        assert again["layout_hash"] == out["layout_hash"] and again["placements"] == out["placements"]


def test_jobs_are_independent_of_partitions_and_bad_ones_fail_alone(spark):
    data = [r for j in range(5) for r in rows([TRIANGLE] * (j + 1), (200_000, 200_000), job=j)]
    data += rows([[(0, 0), (5, 5), (9, 9)]], (200_000, 200_000), job=9)
    df = spark.createDataFrame(data, "job_id long, id string, ring array<struct<x:long,y:long>>, allow_rotation boolean, allow_mirror boolean, padding long, sheet_w long, sheet_h long")
    one = {r.job_id: (r.status, r.placed, r.layout_hash) for r in jobs.layout_jobs(df.repartition(1), beam=4, cap=4).collect()}
    many = {r.job_id: (r.status, r.placed, r.layout_hash) for r in jobs.layout_jobs(df.repartition(7), beam=4, cap=4).collect()}
    assert one == many and one[9][0] == "failure" and [one[j][1] for j in range(5)] == [1, 2, 3, 4, 5]
    status = {r.job_id: r.exit_status for r in jobs.outcome_status(jobs.layout_jobs(df, beam=2, cap=2)).collect()}
    assert status[9] == 3 and status[0] == 0


def test_candidates_are_what_brute_force_finds_legal():
    rng = random.Random(4)
    shapes = jobs.prepare(rows([[(0, 0), (30, 0), (30, 20), (0, 20)], [(0, 0), (20, 0), (0, 30)], [(0, 0), (25, 5), (10, 30)]], (1000, 1000), padding=-1), -1, 4)
    by_id, search = {s.id: s for s in shapes}, Search()
    layout = Layout()
    for s in shapes:
        spots = search.candidates(layout, by_id, s, 0)
        assert len(spots)
        for x, y in spots.tolist():
            moved = convex.moved(list(s.turns[0][2]), x, y)
            assert not any(convex.share_area(moved, r) for r in layout.rings)
        x, y = rng.choice(spots.tolist())
        layout = layout.placed(s, 0, x, y)
    m = metrics(layout)
    assert m["placed"] == 3 and m["waste"] >= 0


def test_identity_survives_quarter_turns_and_order():
    s = jobs.prepare(rows([TRIANGLE] * 3, (1, 1)), 10_000, 8)
    a = Layout().placed(s[0], 0, 0, 0).placed(s[1], 2, 200_000, 0).placed(s[2], 1, 0, 300_000)
    b = Layout().placed(s[2], 1, 7, 300_009).placed(s[0], 0, 7, 9).placed(s[1], 2, 200_007, 9)
    assert len({a.identity(), b.identity(), a.quarter(90).identity(), a.quarter(270).identity()}) == 1
    assert a.identity() != Layout().placed(s[0], 0, 0, 0).placed(s[1], 2, 200_001, 0).placed(s[2], 1, 0, 300_000).identity()


def test_best_cells_of_triangles_and_quadrangles_waste_nothing():
    rng = random.Random(6)
    for _ in range(12):
        ring = convex.hull([(rng.randrange(200), rng.randrange(200)) for _ in range(3)])
        if len(ring) < 3:
            continue
        best = periodic.cells([ring, convex.turned(ring, 180.0, False)], {0: 1})[0]
        assert round(2 * best.area_per_member) == convex.doubled_area(ring)
        for crop in periodic.crops(best, 7, [ring, convex.turned(ring, 180.0, False)]):
            placed = [convex.moved([ring, convex.turned(ring, 180.0, False)][t], x, y) for t, x, y in crop]
            assert len(placed) == 7 and not any(convex.share_area(a, b) for k, a in enumerate(placed) for b in placed[:k])


def test_capacity_search_resumes_no_worse_than_its_incumbents():
    shapes = jobs.prepare(rows([TRIANGLE] * 6, (150_000, 150_000)), 10_000, 4)
    by_id, search = {s.id: s for s in shapes}, Search()
    first = search.decode(shapes, by_id, sheet=(150_000, 150_000))
    best, counters = capacity.search(search, shapes, by_id, (150_000, 150_000), [first], beam=4)
    assert capacity.objective(best) <= capacity.objective(first) and counters["evaluated"] > 0
    assert len(best.ids) + len(best.unplaced) == 6


def test_grid_expressions(spark):
    df = spark.createDataFrame([(1.0005, "a10"), (-1.0005, "a9"), (float("nan"), "a009"), (1e300, "b"), (0.0, "")], "x double, s string")
    got = df.select(grid.to_grid(F.col("x")).alias("g"), grid.round_half_up(F.col("x") * 1000).alias("r"), grid.is_safe_integer(F.col("x")).alias("safe")).collect()
    assert [r.g for r in got] == [1001, -1001, None, None, 0]
    order = df.orderBy(grid.natural_key(F.col("s"))).collect()
    assert [r.s for r in order] == ["", "a9", "a009", "a10", "b"]
    turn = spark.createDataFrame([(-90.0,), (725.0,)], "d double").select(grid.degrees(F.col("d")).alias("d")).collect()
    assert [r.d for r in turn] == [270.0, 5.0]


def test_natural_order_of_jobs_and_columns_agree():
    ids = ["a10", "a9", "a009", "b", "a", "a1b2", "a1b10", "10", "9"]
    assert sorted(ids, key=jobs._natural) == ["9", "10", "a", "a1b2", "a1b10", "a9", "a009", "a10", "b"]


def test_streams_number_events_across_batches(spark, tmp_path):
    schema = "job_id long, event_id long, ts timestamp, kind string"
    for batch in range(3):
        spark.createDataFrame([(j, 10 * batch + k, datetime(2024, 1, 1 + batch, k), "x") for j in range(3) for k in range(j + 1)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    live = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = streams.run_once(spark, streams.sequence(live))
    assert got.count() == 18 and streams.gaps(got).count() == 0
    settled = streams.run_once(spark, streams.settle(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")))
    assert sorted(r.job_id for r in settled.collect()) == [0, 1, 2]


@pytest.mark.parametrize("sheet", [(10, 10)])
def test_impossible_jobs_are_proved(sheet):
    shapes = jobs.prepare(rows([TRIANGLE], sheet), 10_000, 4)
    assert jobs.impossible(shapes, sheet)
    out = jobs.solve_job(pd.DataFrame(rows([TRIANGLE], sheet)), 2, 4, False)
    assert out["placed"] == 0 and out["unplaced_ids"] == ["p0"]
