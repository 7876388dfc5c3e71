"""Layout of many jobs: one row out for each job, each job in one task.

The order of a job's search: proof of impossibility, direct decoding by three roles, periodic seeds of its families,
decoding again in orders taken from the best endpoint; the winner of those that fit; otherwise the capacity search.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import cached_property

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.kernels import convex
from tessera.operators.pareto import exact_deficit
from tessera.search import capacity, periodic
from tessera.search.decoder import Layout, Search, Shape, Steps, alone, fitting_turn, metrics, together

ROLES = ("pure-growth", "area-first", "gap-contained")
SAFETY = 250
#: Fixed value: no further reconstruction starts once they have scored this many candidates.
RECONSTRUCTION_EVALUATIONS = 12_000
#: Parts of the jobs for each core.
PARTS_A_CORE = 8

OUTCOME = (
    "job_id long, status string, placed long, unplaced long, origin string, layout_hash string, max_side long, area long, span long, hull long, waste long, cavities long, components long, isolated long, largest long, "
    "contact long, legal boolean, evaluated long, no_fit_lookups long, no_fit_hits long, placements array<struct<id:string,x:long,y:long,rotation:double,mirrored:boolean>>, unplaced_ids array<string>, error string"
)


def prepare(rows: list[dict], padding: int, cap: int = 8) -> list[Shape]:
    """Shapes in priority order: collision rings are the hulls of the outlines grown by half the padding and the safety margin."""
    by_key: dict[tuple, tuple] = {}
    out = []
    for r in rows:
        ring = convex.hull([(int(p["x"]), int(p["y"])) for p in r["ring"]])
        if len(ring) < 3:
            raise ValueError(f"piece {r['id']} has no area")
        x0, y0, _, _ = convex.bounds(ring)
        ring = convex.moved(ring, -x0, -y0)
        key = (tuple(ring), bool(r["allow_rotation"]), bool(r["allow_mirror"]))
        if key not in by_key:
            grown = convex.offset(ring, padding / 2 + SAFETY) if padding >= 0 else ring
            turns = tuple((d, m, tuple(convex.turned(grown, d, m))) for d, m, _ in convex.transforms(grown, key[1], key[2], cap))
            by_key[key] = (turns, convex.doubled_area(ring), convex.bounds(ring))
        turns, material, box = by_key[key]
        out.append((Shape(r["id"], repr(key), turns, material), box[2] - box[0], box[3] - box[1], r["id"]))
    out.sort(key=lambda s: (-max(s[1], s[2]), -s[1] * s[2], -abs(s[1] - s[2]), -s[1], -s[2], _natural(s[3])))
    return [s[0] for s in out]


def _natural(text: str) -> list:
    import re

    return [(0, int(p), len(p), "") if p.isdigit() else (1, 0, 0, p) for p in re.findall(r"[0-9]+|[^0-9]+", text)]


def impossible(shapes: list[Shape], sheet: tuple[int, int]) -> bool:
    area = 0
    for s in shapes:
        boxes = [convex.bounds(list(r)) for _, _, r in s.turns]
        if not any((b[2] - b[0] <= sheet[0] and b[3] - b[1] <= sheet[1]) or (b[3] - b[1] <= sheet[0] and b[2] - b[0] <= sheet[1]) for b in boxes):
            return True
        area += min(convex.doubled_area(list(r)) for _, _, r in s.turns)
    return area > 2 * sheet[0] * sheet[1]


def families(shapes: list[Shape]) -> list[list[Shape]]:
    out: dict[str, list[Shape]] = {}
    for s in shapes:
        out.setdefault(s.key, []).append(s)
    return list(out.values())


def periodic_seeds(shapes: list[Shape], most: int = 8) -> list[Layout]:
    """Layouts of all members of a family by the best crops of its cells. Families take turns, so that each has its first layouts among the ``most`` that are kept."""
    out: list[tuple[int, int, Layout]] = []
    seen: set[tuple] = set()
    for number, family in enumerate(families(shapes)):
        if len(family) < 2:
            continue
        rank = 0
        turns = [list(r) for _, _, r in family[0].turns]
        half = {k: j for k, (d, m, _) in enumerate(family[0].turns) for j, (e, n, _) in enumerate(family[0].turns) if m == n and (d + 180.0) % 360.0 == e}
        for cell in periodic.cells(turns, half)[:6]:
            for crop in periodic.crops(cell, len(family), turns, 4):
                layout = Layout()
                for shape, (t, x, y) in zip(family, crop, strict=True):
                    layout = layout.placed(shape, t, x, y)
                layout = layout.anchored()
                if (number, *layout.bounds()) not in seen:
                    seen.add((number, *layout.bounds()))
                    out.append((rank, number, layout))
                    rank += 1
    return [layout for _, _, layout in sorted(out, key=lambda s: s[:2])[:most]]


def legal(layout: Layout, sheet: tuple[int, int] | None) -> bool:
    boxes = layout.boxes
    if sheet and any(b[0] < 0 or b[1] < 0 or b[2] > sheet[0] or b[3] > sheet[1] for b in boxes):
        return False
    for i, a in enumerate(layout.rings):
        for j in range(i):
            b, c = boxes[i], boxes[j]
            if b[0] < c[2] and c[0] < b[2] and b[1] < c[3] and c[1] < b[3] and convex.share_area(a, layout.rings[j]):
                return False
    return True


class _Identity:
    """A layout's identity in an order of which it is the last key: it is made only where all others are equal."""

    def __init__(self, layout: Layout) -> None:
        self._layout = layout

    @cached_property
    def text(self) -> str:
        return self._layout.identity()

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _Identity) and self.text == other.text

    def __lt__(self, other: _Identity) -> bool:
        return self.text < other.text

    __hash__ = None


def endpoint_key(m: dict, identity: str | _Identity) -> tuple:
    from fractions import Fraction

    deficit = exact_deficit(m["cavities"], m["isolated"], m["largest"], m["placed"], 0, 1) + min(Fraction(1), max(Fraction(0), (20 * m["gap"] - 3 * m["hull"]) / (3 * m["hull"])))
    return deficit, m["cavities"], m["gap"] / m["hull"], m["max_side"], m["area"], m["span"], identity


def endpoint_orders(shapes: list[Shape], layout: Layout) -> list[list[Shape]]:
    """The pieces backwards, and by the centres of their boxes in a layout: left to right, right to left, top down, bottom up."""
    box = {i: convex.bounds(r) for i, r in zip(layout.ids, layout.rings, strict=True)}
    centre = {i: (b[0] + b[2], b[1] + b[3]) for i, b in box.items()}
    lead = [lambda x, y: x, lambda x, y: -x, lambda x, y: -y, lambda x, y: y]
    return [shapes[::-1], *(sorted(shapes, key=lambda s, k=k: (k(*centre[s.id]), *centre[s.id][::-1], s.id)) for k in lead)]


def reconstructions(search: Search, shapes: list[Shape], by_id: dict[str, Shape], best: Layout, most: int = RECONSTRUCTION_EVALUATIONS) -> list[Layout]:
    """reconstruction_steps, alone."""
    return alone(reconstruction_steps(search, shapes, by_id, best, most))


def reconstruction_steps(search: Search, shapes: list[Shape], by_id: dict[str, Shape], best: Layout, most: int = RECONSTRUCTION_EVALUATIONS) -> Steps:
    """Decodings in the orders taken from the best endpoint, first by pure growth, then into gaps. Orders that differ only in interchangeable pieces are one."""
    out, first = [], search.evaluated
    done = {(role, tuple(s.key for s in shapes)) for role in ROLES}
    for role in ("pure-growth", "gap-contained"):
        for order in endpoint_orders(shapes, best):
            name = role, tuple(s.key for s in order)
            if name not in done and search.evaluated - first < most:
                done.add(name)
                out.append((yield from search.decode_steps(order, by_id, role)))
    return out


def solve(shapes: list[Shape], sheet: tuple[int, int], beam: int, seeds: int = 8, search: Search | None = None) -> tuple[Layout, str, int]:
    """solve_steps, alone."""
    return alone(solve_steps(shapes, sheet, beam, seeds, search))


def solve_steps(shapes: list[Shape], sheet: tuple[int, int], beam: int, seeds: int = 8, search: Search | None = None) -> Steps:
    """The layout, where it comes from, and how many places the capacity search tried."""
    search, by_id = search or Search(), {s.id: s for s in shapes}
    endpoints: list[tuple[str, Layout]] = []
    # roles and orders often end in the same layout
    keys: dict[tuple, tuple] = {}
    sound: dict[tuple, bool] = {}

    def key(e: Layout) -> tuple:
        name = tuple(map(tuple, e.rings))
        if name not in keys:
            keys[name] = endpoint_key(metrics(e), _Identity(e))
        return keys[name]

    def legal_(e: Layout) -> bool:
        name = tuple(map(tuple, e.rings))
        if name not in sound:
            sound[name] = legal(e, None)
        return sound[name]

    if not impossible(shapes, sheet):
        for role in ROLES:
            endpoints.append((role, (yield from search.decode_steps(shapes, by_id, role))))
        for seed in periodic_seeds(shapes, seeds):
            done = set(seed.ids)
            endpoints.append(("periodic", (yield from search.decode_steps([s for s in shapes if s.id not in done], by_id, "pure-growth", seed))))
        best = min((e for _, e in endpoints if legal_(e)), key=key)
        endpoints += [("reconstruction", e) for e in (yield from reconstruction_steps(search, shapes, by_id, best))]
    ranked = sorted(((key(e), n, e) for n, e in endpoints if fitting_turn(e, sheet) is not None and legal_(e)), key=lambda r: r[0])
    if ranked:
        _, name, layout = ranked[0]
        return layout.quarter(fitting_turn(layout, sheet)), name, 0
    incumbents = []
    for role in ROLES[:2]:
        incumbents.append((yield from search.decode_steps(shapes, by_id, role, sheet=sheet)))
    for seed in periodic_seeds(shapes, 4):
        # the part of a seed that lies on the sheet
        for q in (0, 90):
            turned = seed.quarter(q)
            keep = [k for k, r in enumerate(turned.rings) if (b := convex.bounds(r)) and b[2] <= sheet[0] and b[3] <= sheet[1]]
            part = Layout([turned.ids[k] for k in keep], [turned.rings[k] for k in keep], [turned.places[k] for k in keep], [turned.tokens[k] for k in keep], [], sum(by_id[turned.ids[k]].material for k in keep))
            if q == 0 and part.ids:
                part = yield from search.decode_steps([s for s in shapes if s.id not in set(part.ids)], by_id, sheet=sheet, start=part)
            incumbents.append(part)
    layout, counters = capacity.search(search, shapes, by_id, sheet, incumbents, beam=beam)
    return layout, "capacity", counters["evaluated"]


def directional_key(layout: Layout, short: int) -> tuple:
    """Fill tier of the short side (x), then, below the last tier, what is filled, then area, depth, cavities, isolated pieces, identity."""
    x0, y0, x1, y1 = layout.bounds()
    across, depth = x1 - x0, y1 - y0
    tier = 2 if 100 * across >= 99 * short else 1 if 5 * across >= 4 * short else 0
    m = metrics(layout)
    return -tier, -across if tier < 2 else 0, across * depth, depth, m["cavities"], m["isolated"], layout.identity()


def shelf(shapes: list[Shape], short: int) -> Layout:
    """Rows from the left, each piece in its lowest, then widest turn."""
    layout, x, y, tall = Layout(), 0, 0, 0
    for s in shapes:
        boxes = [convex.bounds(list(r)) for _, _, r in s.turns]
        fit = [(b[3] - b[1], b[0] - b[2], k) for k, b in enumerate(boxes) if b[2] - b[0] <= short]
        if not fit:
            return Layout()
        h, w, k = min(fit)
        if x and x - w > short:
            x, y, tall = 0, y + tall, 0
        layout = layout.placed(s, k, x - boxes[k][0], y - boxes[k][1])
        x, tall = x - w, max(tall, h)
    return layout


def short_side(shapes: list[Shape], sheet: tuple[int, int], compact: Layout) -> tuple[Layout, str]:
    """The layout that fills the sheet's short side best, of a strip decoding, shelves, crops across the side and the compact layout in its turns."""
    short, long = min(sheet), max(sheet)
    by_id, search = {s.id: s for s in shapes}, Search()
    found = [("strip", search.decode(shapes, by_id, "strip", sheet=(short, long)).anchored()), ("shelf", shelf(shapes, short))]
    found += [("compact", compact.quarter(q)) for q in (0, 90)]
    if len(families(shapes)) == 1 and len(shapes) > 1:
        turns = [list(r) for _, _, r in shapes[0].turns]
        half = {k: j for k, (d, m, _) in enumerate(shapes[0].turns) for j, (e, n, _) in enumerate(shapes[0].turns) if m == n and (d + 180.0) % 360.0 == e}
        for cell in periodic.cells(turns, half)[:6]:
            for crop in periodic.crops(cell, len(shapes), turns, 64):
                layout = Layout()
                for shape, (t, x, y) in zip(shapes, crop, strict=True):
                    layout = layout.placed(shape, t, x, y)
                found += [("periodic", layout.quarter(q)) for q in (0, 90)]
    ok = [(n, e) for n, e in found if len(e.ids) == len(compact.ids) and (b := e.bounds()) and b[2] - b[0] <= short and b[3] - b[1] <= long]
    # the cheap measures come first in the order: the dear ones only decide among the legal layouts that lead by them
    lead: list[tuple] = []
    for c in sorted(((directional_key_cheap(e, short), n, e) for n, e in ok), key=lambda c: (c[0], c[1])):
        if lead and c[0] > lead[0][0]:
            break
        if legal(c[2], None):
            lead.append(c)
    ranked = sorted(((directional_key(e, short), n, e) for _, n, e in lead), key=lambda r: r[0])
    if not ranked:
        return compact, "capacity"
    _, name, best = ranked[0]
    return best.quarter(0 if sheet[0] <= sheet[1] else 90), name


def directional_key_cheap(layout: Layout, short: int) -> tuple:
    x0, y0, x1, y1 = layout.bounds()
    across, depth = x1 - x0, y1 - y0
    tier = 2 if 100 * across >= 99 * short else 1 if 5 * across >= 4 * short else 0
    return -tier, -across if tier < 2 else 0, across * depth, depth


def solve_job(pdf: pd.DataFrame, beam: int, cap: int, decode_only: bool) -> dict:
    return alone(job_steps(pdf.to_dict("records"), beam, cap, decode_only))


def job_steps(rows: list[dict], beam: int, cap: int, decode_only: bool) -> Steps:
    """The outcome of a job's pieces."""
    head = rows[0]
    sheet = int(head["sheet_w"]), int(head["sheet_h"])
    out = {"job_id": int(head["job_id"]), "status": "success", "origin": None, "layout_hash": None, "legal": True, "placements": [], "unplaced_ids": [], "error": None, "evaluated": 0, "no_fit_lookups": 0, "no_fit_hits": 0}
    out |= {k: 0 for k in ("placed", "unplaced", "max_side", "area", "span", "hull", "waste", "cavities", "components", "isolated", "largest", "contact")}
    try:
        shapes = prepare(rows, int(head["padding"]), cap)
        search = Search()
        if decode_only:
            layout, origin, tried = (yield from search.decode_steps(shapes, {s.id: s for s in shapes}, sheet=sheet)), "decoder", 0
        else:
            layout, origin, tried = yield from solve_steps(shapes, sheet, beam, search=search)
            if head.get("profile") == "compact-short-side" and layout.ids:
                layout, origin = short_side([s for s in shapes if s.id in set(layout.ids)], sheet, layout)
    except ValueError as error:
        return out | {"status": "failure", "error": str(error), "unplaced": len(rows), "unplaced_ids": sorted(r["id"] for r in rows)}
    m = metrics(layout)
    missing = sorted({s.id for s in shapes} - set(layout.ids))
    return out | {
        "origin": origin,
        "layout_hash": layout.identity(),
        "legal": legal(layout, sheet),
        "placed": len(layout.ids),
        "unplaced": len(missing),
        "contact": round(m["contact"]),
        "evaluated": tried,
        "no_fit_lookups": search.lookups,
        "no_fit_hits": search.hits,
        "placements": [{"id": i, "x": x, "y": y, "rotation": float(d), "mirrored": bool(f)} for i, (x, y, d, f) in zip(layout.ids, layout.places, strict=True)],
        "unplaced_ids": missing,
        **{k: int(m[k]) for k in ("max_side", "area", "span", "hull", "waste", "cavities", "components", "isolated", "largest")},
    }


_PLACE = pa.struct([("id", pa.string()), ("x", pa.int64()), ("y", pa.int64()), ("rotation", pa.float64()), ("mirrored", pa.bool_())])
_ARROW = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
_OUTCOME_SCHEMA = pa.schema([(name, _ARROW.get(kind, pa.list_(_PLACE))) for name, kind in (c.split(" ") for c in OUTCOME.split(", "))])
#: Pieces of the jobs that are searched side by side.
PIECES_TOGETHER = 512


def _side_by_side(jobs: Iterable[list[dict]]) -> Iterator[list[list[dict]]]:
    some, pieces = [], 0
    for rows in jobs:
        if some and pieces + len(rows) > PIECES_TOGETHER:
            yield some
            some, pieces = [], 0
        some.append(rows)
        pieces += len(rows)
    if some:
        yield some


def _task(beam: int, cap: int, decode_only: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for jobs in _side_by_side(rows.as_py() for rows in batch.column("pieces")):
                yield pa.RecordBatch.from_pylist(together([job_steps(rows, beam, cap, decode_only) for rows in jobs]), schema=_OUTCOME_SCHEMA)

    return run


def layout_jobs(pieces: DataFrame, beam: int = capacity.BEAM, cap: int = 8, decode_only: bool = False) -> DataFrame:
    """One outcome for each job.

    pieces: job_id, id, ring (array of x, y in micrometres), allow_rotation, allow_mirror, padding, sheet_w, sheet_h and, if wanted,
    profile (compact or compact-short-side). A job with a piece that has no area fails with an error; no job stops the others. The result depends neither on the
    order of rows nor on partitions.
    """
    cols = ["job_id", "id", "ring", "allow_rotation", "allow_mirror", "padding", "sheet_w", "sheet_h", *(["profile"] if "profile" in pieces.columns else [])]
    # so many parts, whatever their bytes: a job's rows are few and its search is long
    parts = max(int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")), PARTS_A_CORE * pieces.sparkSession.sparkContext.defaultParallelism)
    jobs = pieces.select(*cols).repartition(parts, "job_id").groupBy("job_id").agg(F.collect_list(F.struct(*cols)).alias("pieces"))
    return jobs.select("pieces").mapInArrow(_task(beam, cap, decode_only), OUTCOME)


def outcome_status(outcomes: DataFrame) -> DataFrame:
    """Adds complete and the exit status of each outcome."""
    return outcomes.withColumn("complete", F.col("unplaced") == 0).withColumn("exit_status", F.when(F.col("status") == "success", 0).otherwise(3))
