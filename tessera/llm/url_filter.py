"""URL filters: rules on host and path, whose keys are told from all others by a cascade of Bloom filters.

A key is host + path (``example.org/en/1``). It fits a URL whose host is its host or below it and whose path starts
with its path, so a URL's candidate keys are its host's suffixes with its path's beginnings of the lengths that occur.

The first filter holds the listed keys, the second those other keys of the corpus that the first lets pass, the third
the listed keys that the second lets pass, and so on until none is left. For every key of the corpus the first filter
that does not hold it tells exactly whether it is listed, so URLs are judged without a join. A cascade's size follows
the listed keys. It is broadcast, so no cascade is larger than about ``MOST_BITS``: longer lists are parted by a hash of
the key, with a cascade for each part, and the URLs go past one part after the other.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._common import Scratch, ascii_lower, checkpointed, read, small_side, text_of

#: 32 MB for the filters of a cascade.
MOST_BITS = 1 << 28
_CHUNK = 1 << 16

#: Rules of the query (fixed values): key and verdict.
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
#: Keys that the method itself blocks where no rule fits: some, and some thousands by a rule.
LISTED = ["example.net/de/", "example.net/es/1", "example.net/fr/2", "example.com/es/", "example.com/en/9", "m.example.net/en/"]
LISTED += [f"example.{top}/{lang}/{k}" for top in ("net", "com") for lang in ("de", "en", "es", "fr") for k in range(1000, 10_000, 13)]


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (after the first ://, A-Z lower-cased) and path (up to ? or #); empty for null or without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    cut = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)", 1)
    return ascii_lower(cut), path


def candidate_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """Keys that could fit, longest first; of equal ones the longer host first."""
    parts = F.split(host, r"\.", -1)
    hosts = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    heads = F.transform(F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(path)), lambda n: F.substring(path, F.lit(1), n))
    keys = F.flatten(F.transform(hosts, lambda h: F.transform(heads, lambda p: F.struct((-F.length(h) - F.length(p)).alias("long"), (-F.length(h)).alias("host"), F.concat(h, p).alias("key")))))
    return F.transform(F.array_sort(keys), lambda k: k["key"])


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key), F.xxhash64(F.lit(1), key)]


@dataclass(frozen=True)
class Level:
    bits: int
    hashes: int
    words: np.ndarray  # packed bits

    def holds(self, h1: np.ndarray, h2: np.ndarray, level: int) -> np.ndarray:
        out = np.ones(len(h1), bool)
        for at in _places(h1, h2, level, self.bits, self.hashes):
            out &= (self.words[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
        return out


def _places(h1: np.ndarray, h2: np.ndarray, level: int, bits: int, hashes: int) -> Iterator[np.ndarray]:
    a, b = h1 + np.uint64((level * 0x9E3779B97F4A7C15) & (2**64 - 1)), h2 | np.uint64(1)
    for _ in range(hashes):
        mixed = (a ^ (a >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        yield ((mixed ^ (mixed >> np.uint64(32))) % np.uint64(bits)).astype(np.int64)
        a = a + b


def _unsigned(column) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).view(np.uint64)


def _fill(level: int, bits: int, hashes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = np.zeros((bits + 7) // 8, np.uint8)
        for batch in batches:
            for at in _places(_unsigned(batch.column(0)), _unsigned(batch.column(1)), level, bits, hashes):
                np.bitwise_or.at(mine, at >> 3, (1 << (at & 7)).astype(np.uint8))
        parts = [(k, mine[k * _CHUNK : (k + 1) * _CHUNK]) for k in range(-(-len(mine) // _CHUNK))]
        parts = [(k, zlib.compress(p.tobytes(), 1)) for k, p in parts if p.any()]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int32()), pa.array([p for _, p in parts], pa.binary())], names=["chunk", "part"])

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, p in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            part = np.frombuffer(zlib.decompress(p.as_py()), np.uint8)
            total[k] = total[k] | part if k in total else part
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([p.tobytes() for p in total.values()], pa.binary())], names=["chunk", "part"])


def build_level(keys: DataFrame, level: int, n: int, rate: float) -> Level:
    """A filter of the n keys (h1, h2): filled in parts by the tasks, merged by chunk."""
    bits = max(64, math.ceil(n * -math.log(rate) / math.log(2) ** 2))
    hashes = max(1, round(bits / n * math.log(2)))
    merged = keys.select("h1", "h2").mapInArrow(_fill(level, bits, hashes), "chunk int, part binary").repartition(8, "chunk").mapInArrow(_merge, "chunk int, part binary")
    words = np.zeros((bits + 7) // 8, np.uint8)
    for r in merged.collect():
        words[r["chunk"] * _CHUNK : r["chunk"] * _CHUNK + len(r["part"])] = np.frombuffer(bytes(r["part"]), np.uint8)
    return Level(bits, hashes, words)


class Cascade:
    def __init__(self, levels: list[Level]):
        self.levels = levels

    def listed(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Exact for every key of the universe that it was built over."""
        out, open_ = np.zeros(len(h1), bool), np.arange(len(h1))
        for k, level in enumerate(self.levels):
            inside = level.holds(h1[open_], h2[open_], k)
            out[open_[~inside]] = k % 2 == 1
            open_ = open_[inside]
        out[open_] = len(self.levels) % 2 == 1
        return out


def _passing(level: Level, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array(level.holds(_unsigned(batch.column(0)), _unsigned(batch.column(1)), k), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["h1", "h2"])

    return run


def _bits(n: int, rate: float) -> int:
    return max(64, math.ceil(n * -math.log(rate) / math.log(2) ** 2))


def build_cascades(universe: DataFrame, listed: DataFrame, scratch: Scratch, most_bits: int = MOST_BITS) -> list[Cascade]:
    """Over the distinct keys (h1, h2) of universe; listed: distinct (h1, h2). Part k of n has the keys with pmod(h2, n) = k."""
    here = scratch.table(universe.join(small_side(listed.withColumn("in", F.lit(True)), listed.count()), ["h1", "h2"], "left"))
    r, s = here.agg(F.count("in"), F.sum(F.isnull("in").cast("long"))).first()
    rate = min(0.5, max(r, 1) / max(s or 0, 1) * math.sqrt(0.5))
    # the levels after the first halve what the one before them holds
    n = max(1, math.ceil((_bits(r, rate) + 4 * r) / most_bits)) if r else 1
    return [_build_part(here.where(F.pmod("h2", F.lit(n)) == k), scratch) for k in range(n)]


def _build_part(here: DataFrame, scratch: Scratch) -> Cascade:
    inside, outside = here.where("in").select("h1", "h2"), here.where("in IS NULL").select("h1", "h2")
    r, s = inside.count(), outside.count()
    levels: list[Level] = []
    n, rate = r, min(0.5, max(r, 1) / max(s, 1) * math.sqrt(0.5))
    while n:
        k = len(levels)
        levels.append(build_level(inside, k, n, rate))
        passed = scratch.table(outside.mapInArrow(_passing(levels[k], k), "h1 long, h2 long"))
        inside, outside, n, rate = passed, inside, passed.count(), 0.5
    return Cascade(levels)


VERDICTS = {"allow": "allowed", "block": "blocked", "own": "listed"}
JUDGED = "page_id long, host string, path string, keys array<string>, h1 array<long>, h2 array<long>, allowed int, blocked int, listed int"


def _judge(cascades: dict, part: int, parts: dict[str, int]):
    """Sets allowed, blocked and listed to the place of a row's first key that the part holds, if it stands before what other parts found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
            ends = np.concatenate([[0], np.cumsum(cols["keys"].value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            h1, h2 = _unsigned(cols["h1"].flatten()), _unsigned(cols["h2"].flatten())
            for name, cascade in cascades.items():
                mine = np.flatnonzero(np.mod(h2.view(np.int64), parts[name]) == part)
                at = mine[cascade.value.listed(h1[mine], h2[mine])]
                first = np.searchsorted(at, ends[:-1])
                found = np.full(len(ends) - 1, np.iinfo(np.int32).max, np.int64)
                some = first < len(at)
                some[some] = at[first[some]] < ends[1:][some]
                found[some] = at[first[some]] - ends[:-1][some]
                before = cols[name].fill_null(np.iinfo(np.int32).max).to_numpy(zero_copy_only=False)
                best = np.minimum(found, before)
                cols[name] = pa.array(best, pa.int32(), mask=best == np.iinfo(np.int32).max)
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return run


def judge_urls(pages: DataFrame, rules: DataFrame, listed: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of pages (page_id, url).

    rules: key (host/path), verdict (allow or block); the longest key that fits decides, of equally long ones that of the
    longer host, and of a key with both verdicts block. Where none fits, rule is null and the verdict is block if a key of
    listed (key) fits, else allow. A null url, or one without ://, has an empty host and path, which nothing fits. Keys
    without a / fit nothing. Repeated rows are judged each; an empty table gives no rows; other columns are ignored.
    """
    spark = pages.sparkSession
    with Scratch(spark, "urls") as scratch:
        keys = rules.select("key", "verdict").union(listed.select("key", F.lit("own"))).where("key LIKE '%/%'").distinct()
        keys = scratch.table(keys.select("key", "verdict", *[h.alias(n) for h, n in zip(_hashes(F.col("key")), ("h1", "h2"), strict=True)]))
        lengths = sorted(r[0] for r in keys.select(F.length("key") - F.instr("key", "/") + 1).distinct().collect())
        host, path = url_parts(F.col("url"))
        rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string").alias("url")).select("page_id", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
        rows = scratch.table(rows.withColumn("keys", candidate_keys(F.col("host"), F.col("path"), lengths or [1])))
        universe = scratch.table(rows.select(F.explode("keys").alias("key")).select(*[h.alias(n) for h, n in zip(_hashes(F.col("key")), ("h1", "h2"), strict=True)]).distinct())
        built = {name: build_cascades(universe, keys.where(F.col("verdict") == v).select("h1", "h2"), scratch, most_bits) for v, name in VERDICTS.items()}
        none = [F.lit(None).cast("int").alias(name) for name in VERDICTS.values()]
        found = rows.select("page_id", "host", "path", "keys", F.transform("keys", lambda k: F.xxhash64(k)).alias("h1"), F.transform("keys", lambda k: F.xxhash64(F.lit(1), k)).alias("h2"), *none)
        parts = {name: len(x) for name, x in built.items()}
        for part in range(max(parts.values())):
            if part:
                found = scratch.table(found)
            found = found.mapInArrow(_judge({name: spark.sparkContext.broadcast(x[part]) for name, x in built.items() if part < len(x)}, part, parts), JUDGED)
        # keys stand longest first, then by the longer host
        ruled, blocks = F.least("allowed", "blocked"), F.coalesce(F.col("blocked") <= F.col("allowed"), F.col("blocked").isNotNull())
        verdict = F.when(ruled.isNotNull(), F.when(blocks, "block").otherwise("allow")).otherwise(F.when(F.col("listed").isNotNull(), "block").otherwise("allow"))
        return checkpointed(found.select("page_id", "host", "path", F.get("keys", ruled).alias("rule"), verdict.alias("verdict")))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "key string, verdict string")
    return judge_urls(read(spark, sf_dir, "pages"), rules, spark.createDataFrame([(k,) for k in LISTED], "key string"))


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" for x in r) + ")" for r in rows)


SQL = f"""
WITH k(key, verdict) AS (
  VALUES {_values([*RULES, *((x, 'own') for x in LISTED[:6])])}
  UNION ALL SELECT 'example.' || top || '/' || lang || '/' || n, 'own'
  FROM (VALUES ('net'), ('com')) a(top), (VALUES ('de'), ('en'), ('es'), ('fr')) b(lang), range(1000, 10000, 13) c(n)
),
r AS (SELECT verdict, key, split_part(key, '/', 1) AS kh, substr(key, instr(key, '/')) AS kp FROM k),
u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) AS path FROM u),
f AS (
  SELECT page_id, host, path,
    max_by(key, length(key) * 1000 + length(kh)) FILTER (WHERE verdict <> 'own') AS rule,
    max_by(verdict, length(key) * 1000 + length(kh)) FILTER (WHERE verdict <> 'own') AS said,
    bool_or(coalesce(verdict = 'own', false)) AS own
  FROM p LEFT JOIN r ON (host = kh OR ends_with(host, '.' || kh)) AND starts_with(path, kp)
  GROUP BY page_id, host, path
)
SELECT page_id, host, path, rule, CASE WHEN rule IS NOT NULL THEN said WHEN own THEN 'block' ELSE 'allow' END AS verdict FROM f
"""
