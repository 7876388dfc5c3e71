"""Layout searches on many jobs: array steps over all turns of a piece, jobs dealt out, the same outcomes."""

import hashlib
import random

import pandas as pd
import pytest
from tessera.kernels import convex, no_fit
from tessera.search import decoder, jobs


def test_no_fit_sides_of_all_turns_at_once():
    rng = random.Random(8)
    squares = [[(0, 0), (9, 0), (9, 9), (0, 9)], [(2, 1), (8, 1), (8, 3), (2, 3)]]
    rings = squares + [r for r in (convex.hull([(rng.randrange(40), rng.randrange(40)) for _ in range(6)]) for _ in range(10)) if len(r) > 2]
    found = no_fit.sides(no_fit.padded(rings), no_fit.padded(rings[::-1]))
    for a, row in zip(rings, found, strict=True):
        for b, got in zip(rings[::-1], row, strict=True):
            ring = convex.no_fit(a, b)
            assert {tuple(s) for s in got.tolist()} == {(*p, *q) for p, q in zip(ring, ring[1:] + ring[:1], strict=True)}


def _five_pieces(job, sheet, rng):
    base = [[(0, 0), (rng.randrange(20, 90) * 1000, 0), (rng.randrange(20, 90) * 1000, rng.randrange(20, 90) * 1000)] for _ in range(5)]
    base[3] = base[1]
    return [{"job_id": job, "id": f"p{k}", "ring": [{"x": x, "y": y} for x, y in r], "allow_rotation": True, "allow_mirror": True, "padding": 4000, "sheet_w": sheet[0], "sheet_h": sheet[1]} for k, r in enumerate(base)]


def test_decoder_makes_the_rings_of_all_turns_in_one_step(monkeypatch):
    rows = _five_pieces(0, (900_000, 700_000), random.Random(21))
    monkeypatch.setattr(convex, "no_fit", lambda *_: pytest.fail("a ring for each turn"))
    made = []
    real = no_fit.sides
    monkeypatch.setattr(no_fit, "sides", lambda fixed, moving: made.append(1) or real(fixed, moving))
    assert jobs.solve_job(pd.DataFrame(rows), 4, 8, True)["placed"] == 5 and len(made) == 4


def test_searches_give_what_they_gave_turn_by_turn():
    # digest of all outcomes by the code of round 2, which took each turn and each ring alone
    rng = random.Random(21)
    out = []
    for job, sheet in enumerate([(150_000, 120_000), (900_000, 700_000), (110_000, 110_000)]):
        rows = _five_pieces(job, sheet, rng)
        out += [jobs.solve_job(pd.DataFrame(rows), 4, 8, only) for only in (True, False)]
    assert {o["origin"] for o in out} == {"decoder", "reconstruction", "periodic", "capacity"}
    assert hashlib.sha256(repr(out).encode()).hexdigest()[:16] == "18b5ac9a6b63fa16"


def test_jobs_are_dealt_out_and_equal_layouts_measured_once(spark, monkeypatch):
    rows = [r for job in range(3) for r in _five_pieces(job, (900_000, 700_000), random.Random(21))]
    df = spark.createDataFrame(rows, "job_id long, id string, ring array<struct<x:long,y:long>>, allow_rotation boolean, allow_mirror boolean, padding long, sheet_w long, sheet_h long")
    assert jobs.layout_jobs(df.coalesce(1)).rdd.getNumPartitions() >= 8 * spark.sparkContext.defaultParallelism
    seen = []
    real = jobs.metrics
    monkeypatch.setattr(jobs, "metrics", lambda layout: seen.append(str(layout.rings)) or real(layout))
    jobs.solve(jobs.prepare(rows[:5], 4000), (900_000, 700_000), 4)
    assert len(seen) == len(set(seen)) > 1


def test_contacts_and_picks_are_found_once(monkeypatch):
    rows = _five_pieces(0, (900_000, 700_000), random.Random(21))
    shapes = jobs.prepare(rows, 4000)
    by_id, seen = {s.id: s for s in shapes}, []
    real = convex.contact_length
    monkeypatch.setattr(convex, "contact_length", lambda a, b: seen.append((min(a), tuple(convex.moved(a, -a[0][0], -a[0][1])), tuple(convex.moved(b, -a[0][0], -a[0][1])))) or real(a, b))
    search = decoder.Search()
    first = search.decode(shapes, by_id, "gap-contained")
    alone = [s[1:] for s in seen]
    assert alone and len(alone) == len(set(alone))
    assert search.decode(shapes, by_id, "gap-contained") == first and len(seen) == len(alone)
    # what is remembered is what a new measure gives
    c = search.scored(first, by_id, shapes[0])[0]
    ring = convex.moved(shapes[0].turns[c[3]][2], c[5], c[4])
    assert search.contact(first, shapes[0], c) == sum(real(ring, r) for r in first.rings if convex.contact_length(ring, r))


def test_jobs_side_by_side_end_as_alone(monkeypatch):
    rng = random.Random(21)
    sheets = [(150_000, 120_000), (900_000, 700_000), (110_000, 110_000), (900_000, 700_000), (50_000, 40_000), (900_000, 700_000), (400_000, 220_000)]
    rows = [_five_pieces(job, sheet, rng)[: 5 - job % 2] for job, sheet in enumerate(sheets)]
    rows[3][0]["ring"] = rows[3][0]["ring"][:2]
    for only in (False, True):
        alone = [jobs.solve_job(pd.DataFrame(r), 4, 8, only) for r in rows]
        assert {o["status"] for o in alone} == {"success", "failure"}
        steps = []
        real = decoder._legal
        with monkeypatch.context() as m:
            m.setattr(decoder, "_legal", lambda walls, frame, real=real, steps=steps: steps.append(len(walls)) or real(walls, frame))
            assert decoder.together([jobs.job_steps(r, 4, 8, only) for r in rows]) == alone
        assert max(steps) > 8
    assert [len(some) for some in jobs._side_by_side([[{}] * 300, [{}] * 212, [{}], [{}] * 900, [{}]])] == [2, 1, 1, 1]
