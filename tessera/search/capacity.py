"""Capacity search: which pieces a sheet takes when it cannot take all. A beam over pieces in order, all states of a depth together."""

from __future__ import annotations

from tessera.search.decoder import Layout, Search, Shape

#: Fixed values of the beam.
BEAM = 16
FANOUT = 3
QUOTA = 4096


def objective(layout: Layout) -> tuple:
    x0, y0, x1, y1 = layout.bounds() if layout.rings else (0, 0, 0, 0)
    w, h = x1 - x0, y1 - y0
    return -len(layout.ids), -layout.material, max(w, h), w * h, w + h, tuple(layout.places)


def search(search_: Search, order: list[Shape], shapes: dict[str, Shape], sheet: tuple[int, int], incumbents: list[Layout], beam: int = BEAM, fanout: int = FANOUT, quota: int = QUOTA, depths: int | None = None) -> tuple[Layout, dict]:
    """The best layout found and counters. Every state skips the piece or places it at its most compact places and the one of most contact.

    States that cannot reach the incumbent's count, or its material at that count, are dropped. Counts, not clocks, bound
    the work, so a run gives the same layout everywhere.
    """
    best = min([Layout(), *incumbents], key=objective)
    frontier, counters = [Layout()], {"evaluated": 0, "duplicates": 0, "pruned": 0}
    rest = [sum(s.material for s in order[k:]) for k in range(len(order) + 1)]
    for depth, shape in enumerate(order[:depths]):
        successors: dict[tuple, Layout] = {}
        used = 0
        for state in frontier:
            options = [state.skipped(shape)]
            if used < quota:
                found = sorted(search_.scored(state, shapes, shape, sheet))[: max(0, quota - used)]
                used += len(found)
                pick = found[:fanout]
                near = found[fanout:]
                if near:
                    pick.append(max(near, key=lambda c: (round(search_.contact(state, shape, c)), [-v for v in c])))
                options += [state.placed(shape, c[3], c[5], c[4]) for c in pick]
            for one in options:
                key = tuple(sorted((t, p) for t, p in zip(one.tokens, one.places, strict=True)))
                if key in successors and objective(successors[key]) <= objective(one):
                    counters["duplicates"] += 1
                else:
                    successors[key] = one
        counters["evaluated"] += used
        kept = []
        left = len(order) - depth - 1
        for one in successors.values():
            reach, material = len(one.ids) + left, one.material + rest[depth + 1]
            if reach < len(best.ids) or reach == len(best.ids) and material < best.material:
                counters["pruned"] += 1
            else:
                kept.append(one)
        frontier = sorted(kept, key=objective)[:beam]
        if not frontier:
            break
        leader = frontier[0]
        if objective(leader) < objective(best):
            best = leader
    missing = {s.id for s in order} - set(best.ids)
    best = Layout(best.ids, best.rings, best.places, best.tokens, [s.id for s in order if s.id in missing], best.material)
    return best, counters
