"""Dominance between completed layouts: fronts, layers, order of a front, certificates and winners.

Layouts of a job are compared by two lexicographic objectives, compactness and void topology; one dominates another if
it is better in one and not worse in the other. Ratios are compared exactly, by cross-multiplication.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.grid import wide


def _lex(steps: list[tuple[Column, Column]]) -> Column:
    """Whether the first of a sequence of (less, equal) steps that is not equal is less."""
    out = F.lit(False)
    for less, equal in reversed(steps):
        out = less | (equal & out)
    return out


def _plain(names: list[str], a: str, b: str) -> list[tuple[Column, Column]]:
    return [(F.col(f"{a}.{n}") < F.col(f"{b}.{n}"), F.col(f"{a}.{n}") == F.col(f"{b}.{n}")) for n in names]


def _ratio(n: str, d: str, a: str, b: str) -> tuple[Column, Column]:
    left, right = wide(F.col(f"{a}.{n}")) * wide(F.col(f"{b}.{d}")), wide(F.col(f"{b}.{n}")) * wide(F.col(f"{a}.{d}"))
    return left < right, left == right


def more_compact(a: str, b: str) -> Column:
    return _lex(_plain(["max_side", "area", "span"], a, b))


def fewer_voids(a: str, b: str) -> Column:
    return _lex([*_plain(["cavities", "cavity_area"], a, b), _ratio("gap", "hull", a, b), _ratio("waste", "hull", a, b)])


def dominates(a: str, b: str) -> Column:
    """Better in one objective and worse in none."""
    worse = more_compact(b, a) | fewer_voids(b, a)
    return (more_compact(a, b) | fewer_voids(a, b)) & ~worse


def front(layouts: DataFrame, by: str = "job_id") -> DataFrame:
    """Layouts that no other of their group dominates: an anti-join on the group."""
    a, b = layouts.alias("a"), layouts.alias("b")
    return a.join(b, (F.col(f"a.{by}") == F.col(f"b.{by}")) & dominates("b", "a"), "left_anti")


def layers(layouts: DataFrame, save: Callable[[DataFrame], DataFrame], by: str = "job_id", most: int = 10_000) -> DataFrame:
    """Adds layer: 1 for the front, 2 for the front of the rest, and so on; a round peels the fronts of all groups at once.
    Rows that are left after ``most`` rounds are an error, never dropped."""
    rest, done, layer = save(layouts), None, 0
    while layer < most:
        layer += 1
        first = save(front(rest, by).withColumn("layer", F.lit(layer).cast("long")))
        done = first if done is None else done.unionByName(first)
        rest = save(rest.join(first.select(by, "endpoint_id"), [by, "endpoint_id"], "left_anti"))
        if not rest.limit(1).count():
            return done
    raise ValueError(f"more than {most} layers")


SEED_METRICS = ["components", "isolated", "outside_area", "max_side", "area", "span"]


def seed_front(seeds: DataFrame, by: str = "job_id", metrics: list[str] | None = None) -> DataFrame:
    """Seeds that no other equals or betters in every metric and betters in one."""
    names = metrics or SEED_METRICS
    a, b = seeds.alias("a"), seeds.alias("b")
    no_worse, better = F.lit(True), F.lit(False)
    for n in names:
        no_worse, better = no_worse & (F.col(f"b.{n}") <= F.col(f"a.{n}")), better | (F.col(f"b.{n}") < F.col(f"a.{n}"))
    return a.join(b, (F.col(f"a.{by}") == F.col(f"b.{by}")) & no_worse & better, "left_anti")


def certificate(cavities: Column, isolated: Column, largest: Column, placed: Column, gap: Column, hull: Column) -> Column:
    """Violated cohesion floors, in order: cavities, isolated, component, gap."""
    rules = [("cavities", cavities > 2), ("isolated", isolated > 2), ("component", 5 * largest < 4 * placed), ("gap", wide(gap) * 20 > wide(hull) * 3)]
    return F.array_compact(F.array(*[F.when(bad, F.lit(n)) for n, bad in rules]))


def deficit_millionths(cavities: Column, isolated: Column, largest: Column, placed: Column, gap: Column, hull: Column) -> Column:
    """Sum of the floors' relative deficits, each at most 1, in whole millionths rounded down."""
    part = lambda n, d: F.least(F.lit(1_000_000), F.call_function("div", F.greatest(n, F.lit(0)) * 1_000_000, d))
    return (part(cavities - 2, F.lit(2)) + part(isolated - 2, F.lit(2)) + part(4 * placed - 5 * largest, F.greatest(4 * placed, F.lit(1))) + part(20 * gap - 3 * hull, 3 * hull)).cast("long")


def exact_deficit(cavities: int, isolated: int, largest: int, placed: int, gap: int, hull: int) -> Fraction:
    """The same as an exact fraction."""
    cap = lambda n, d: min(Fraction(1), Fraction(n, d)) if n > 0 and d > 0 else Fraction(0)
    return cap(cavities - 2, 2) + cap(isolated - 2, 2) + cap(4 * placed - 5 * largest, 4 * placed) + cap(20 * gap - 3 * hull, 3 * hull)


def _by_job(rows: DataFrame, pick: Callable[[list[dict]], list[dict]], schema: pa.Schema, ddl: str) -> DataFrame:
    """pick of the rows of each job. Jobs are lists in batches of many, as a call of pandas for each would cost more than what is picked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([one for of_job in batch.column("rows").to_pylist() for one in pick(of_job)], schema=schema)

    lists = rows.groupBy("job_id").agg(F.collect_list(F.struct(*rows.columns)).alias("rows"))
    return lists.select("rows").mapInArrow(run, ddl)


def _draft(left: list[dict]) -> list[dict]:
    """Takes in turn the best of what is left by compactness, by voids and by contact."""
    keys = [
        lambda r: (r["max_side"], r["area"], r["span"], r["hash"]),
        lambda r: (r["cavities"], r["cavity_area"], Fraction(r["gap"], r["hull"]), Fraction(r["waste"], r["hull"]), r["hash"]),
        lambda r: (r["isolated"], r["component_count"], -r["largest"], -r["structural"], -r["dominant"], -r["contact"], r["hash"]),
    ]
    out, left = [], list(left)
    while left:
        best = min(left, key=keys[len(out) % 3]) if len(left) > 1 else left[0]
        left.remove(best)
        out.append({"job_id": best["job_id"], "endpoint_id": best["endpoint_id"], "place": len(out) + 1})
    return out


def ordered_front(layouts: DataFrame) -> DataFrame:
    """The front of each job in the order of a draft; a front is small, as its members differ in both objectives."""
    names = ["endpoint_id", "max_side", "area", "span", "hash", "cavities", "cavity_area", "gap", "hull", "waste", "isolated", "component_count", "largest", "structural", "dominant", "contact"]
    schema = pa.schema([("job_id", pa.int64()), ("endpoint_id", pa.int64()), ("place", pa.int64())])
    return _by_job(front(layouts).select("job_id", *names), _draft, schema, "job_id long, endpoint_id long, place long")


def archive_winner(layouts: DataFrame) -> DataFrame:
    """Of the front: least deficit, cavities, hull gap ratio, envelope, hash. Ratios are compared as fractions of one pair at a time."""
    names = ["endpoint_id", "cavities", "isolated", "largest", "placed", "gap", "hull", "max_side", "area", "span", "hash"]

    def pick(rows: list[dict]) -> list[dict]:
        best = rows[0] if len(rows) == 1 else min(rows, key=lambda r: (exact_deficit(*(r[k] for k in ("cavities", "isolated", "largest", "placed", "gap", "hull"))), r["cavities"], Fraction(r["gap"], r["hull"]), r["max_side"], r["area"], r["span"], r["hash"]))
        return [{"job_id": best["job_id"], "endpoint_id": best["endpoint_id"]}]

    schema = pa.schema([("job_id", pa.int64()), ("endpoint_id", pa.int64())])
    return _by_job(front(layouts).select("job_id", *names), pick, schema, "job_id long, endpoint_id long")
