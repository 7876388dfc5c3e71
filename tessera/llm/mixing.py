"""Mixing of sources to target weights: pivotal dependent rounding of fractional copies.

Every document of a source has the same expected number of copies, target words over the source's words. Its whole
part is certain. The fractional parts are rounded together: two documents' probabilities are paired, and words move
from one to the other (at random, in the proportion that keeps each document's expectation) until one of them is 0 or
1. The words that a pair expects to add stay the same at each step, so a source ends within one document of its target.

Rows alike in id, source and size are one item (up to ``PER_ITEM`` of them), whose copies are shared out evenly, so an id
on any number of rows is split. Groups are (source, hash of the item), as many a source as its items ask for; each leaves
one item that is still undecided. Those meet in a reduction tree with ``FAN_IN`` groups a node. All random numbers are
hashes of the items that are paired, so a lost task, another number of partitions or a rerun gives the same mix.

Sources are a table, whatever their number: the driver holds no row of it, only its sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm._common import checkpointed, lookup, read, shards, small_side, text_of

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
PER_SHARD = 1_000
PER_ITEM = 1_000
FAN_IN = 64
SEED = 20_240_501

SIZES = "doc_id long, source string, size long"
STATE = "doc_id long, source string, size long, block long, rows long, whole long, p double, groups long, shard long, decided boolean"
ITEM = ["doc_id", "source", "size", "block"]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [len(t.as_py().encode().split()) for t in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(words, pa.int64())], names=["doc_id", "source", "size"])


def document_sizes(docs: DataFrame) -> DataFrame:
    """Words (runs of other than space and \\t-\\r) of each whole text."""
    return docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), text_of().alias("text")).mapInArrow(_count, SIZES)


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, rows, target) of (source, size). Sources by code point, null last, take the weights in turn and
    share all words; a target stops at ``most`` times its source's words, and what is over is shared again by weight among
    the others. The share of a unit of weight only grows, by Newton's steps on its piecewise linear sum."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    # a global order is range-partitioned; ids of a written table are those of its parts in that order
    ordered = checkpointed(totals.orderBy(F.col("source").asc_nulls_last())).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    parts = ordered.groupBy("_part").count()
    first = parts.select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_first"))  # a row for each part of the order
    turn = F.pmod(F.col("_first") + F.col("_at"), F.lit(len(weights))).cast("int")
    ordered = ordered.join(F.broadcast(first), "_part")
    ordered = ordered.withColumn("weight", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), turn + 1)).drop("_part", "_at", "_first")
    share = 0.0
    capped = lambda: F.lit(share) * F.col("weight") > most * F.col("source_size")
    words = ordered.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    while True:
        over, weight = ordered.agg(F.coalesce(F.sum(F.when(capped(), F.col("source_size"))), F.lit(0)), F.coalesce(F.sum(F.when(~capped(), F.col("weight"))), F.lit(0))).first()
        now = (words - most * over) / weight if weight else share
        if now <= share:
            break
        share = now
    return ordered.select("source", "source_size", "rows", F.when(capped(), (most * F.col("source_size")).cast("double")).otherwise(F.lit(share) * F.col("weight")).alias("target"))


def _chance(seed: int, a, b) -> float:
    return xxhash.xxh64_intdigest(f"{a}:{b}", seed=seed) / 2.0**64


def pivot(ids, sizes, probs, seed: int = SEED) -> tuple[list[float], int]:
    """Rounds probs to 0 or 1 but for at most one, whose place is returned (-1: none). sum(size * p) does not change."""
    p, held = list(probs), -1
    for k, n in enumerate(sizes):
        if not 0.0 < p[k] < 1.0:
            continue
        if n == 0:  # adds no words either way
            p[k] = float(_chance(seed, ids[k], "") < p[k])
            continue
        if held < 0:
            held = k
            continue
        m = sizes[held]
        up, down = min(m * (1 - p[held]), n * p[k]), min(m * p[held], n * (1 - p[k]))
        if _chance(seed, ids[held], ids[k]) * (up + down) < down:
            move, ends = up, (1.0, 0.0)
        else:
            move, ends = -down, (0.0, 1.0)
        first, second = p[held] + move / m, p[k] - move / n
        first = ends[0] if abs(first - ends[0]) < 1e-12 else first
        second = ends[1] if abs(second - ends[1]) < 1e-12 else second
        p[held], p[k] = min(1.0, max(0.0, first)), min(1.0, max(0.0, second))
        held = held if 0.0 < p[held] < 1.0 else k if 0.0 < p[k] < 1.0 else -1
    return p, held


def _round(seed: int):
    def run(group: pa.Table) -> pa.Table:
        rows = group.sort_by([(c, "ascending") for c in ITEM])
        names = [f"{d}.{n}" if n else d for d, n in zip(rows["doc_id"].to_pylist(), rows["block"].to_pylist(), strict=True)]
        p, held = pivot(names, rows["size"].to_pylist(), rows["p"].to_pylist(), seed)
        if held >= 0 and rows["groups"][0].as_py() == 1:  # the last of its source
            p[held] = float(_chance(seed, names[held], "last") < p[held])
            held = -1
        at = rows.column_names.index
        rows = rows.set_column(at("p"), "p", pa.array(p, pa.float64()))
        return rows.set_column(at("decided"), "decided", pa.array([k != held for k in range(len(p))], pa.bool_()))

    return run


def _items(sizes: DataFrame, weights, most: int, per_shard: int, seed: int) -> tuple[DataFrame, DataFrame, int, int]:
    """(doc_id, source, size, block, rows, taken): copies of all rows of an item; and the sources with their key, number and rows."""
    sources = checkpointed(source_targets(sizes, weights, most).withColumn("_key", F.concat(F.lit("+"), F.col("source"))).fillna("-", ["_key"]))
    n_sources, n_rows = sources.agg(F.count(F.lit(1)), F.coalesce(F.sum("rows"), F.lit(0))).first()
    alike = sizes.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n"))
    items = alike.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / PER_ITEM))))
    items = items.select(*ITEM, F.least(F.lit(PER_ITEM).cast("long"), F.col("n") - F.col("block") * PER_ITEM).alias("rows"))
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0))
    rates = sources.select("_key", rate.alias("rate"), F.ceil(F.col("rows") / per_shard).alias("groups"), F.col("rows").alias("n"))
    keyed = items.withColumn("_key", F.coalesce(F.concat(F.lit("+"), F.col("source")), F.lit("-")))
    expected = F.col("rows") * F.col("rate")
    shard = lambda *of: F.pmod(F.xxhash64(*of), F.col("groups")).cast("long")
    state = lookup(keyed, rates, "_key", "n", n_rows, n_sources, 96).select(*ITEM, "rows", F.floor(expected).cast("long").alias("whole"), (expected - F.floor(expected)).alias("p"), "groups").withColumn("shard", shard("doc_id", "size", "block")).withColumn("decided", F.lit(False))
    groups = shards(sources.agg(F.coalesce(F.max("rows"), F.lit(1))).first()[0], per_shard)
    done = None
    while True:
        rounded = checkpointed(state.groupBy("source", "shard").applyInArrow(_round(seed), STATE))
        part = rounded.where("decided")
        done = part if done is None else done.unionByName(part)
        if groups == 1:
            break
        groups = shards(groups, FAN_IN)
        state = rounded.where("NOT decided").withColumn("groups", F.ceil(F.col("groups") / FAN_IN)).withColumn("shard", shard("shard"))
    return done.select(*ITEM, "rows", (F.col("whole") + F.col("p").cast("long")).alias("taken")), sources, n_sources, n_rows


def _each(taken, rows, k):
    """Copies of row k (from 0) of ``rows`` alike that have ``taken`` together."""
    return F.floor(taken / rows).cast("long") + (k < F.pmod(taken, rows)).cast("long")


def mix_copies(docs: DataFrame, weights=WEIGHTS, most: int = MOST_COPIES, per_shard: int = PER_SHARD, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies.

    A null text has no words. A source without words has target 0 and no copies. Rows that are alike in doc_id, source and
    size share their copies evenly, so which of them is first does not matter; a null doc_id is an id. An empty table
    gives no rows; other columns are ignored.
    """
    sizes = checkpointed(document_sizes(docs))
    items, sources, n_sources, n_rows = _items(sizes, weights, most, per_shard, seed)
    each = items.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1))).withColumn("copies", _each(F.col("taken"), F.col("rows"), F.col("_k")))
    each = each.withColumn("_key", F.coalesce(F.concat(F.lit("+"), F.col("source")), F.lit("-")))
    of_source = sources.select("_key", "source_size", "target", F.col("rows").alias("n"))
    return lookup(each, of_source, "_key", "n", n_rows, n_sources, 96).select("doc_id", "source", "size", "source_size", "target", "copies")


def mixed(docs: DataFrame, weights=WEIGHTS, most: int = MOST_COPIES, per_shard: int = PER_SHARD, seed: int = SEED) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with all their columns.

    Of rows alike in doc_id, source and size, which have copies together, the first by place get one more where they do
    not share evenly; rows of one doc_id that differ are taken each by their own number.
    """
    items = _items(checkpointed(document_sizes(docs)), weights, most, per_shard, seed)[0]
    by_id = checkpointed(items.groupBy("doc_id").agg(F.sum("rows").alias("__tsrows"), F.sum("taken").alias("__tsn")).where("__tsn <> 1 OR __tsrows > 1").withColumnRenamed("doc_id", "__tsid"))
    out = docs.join(small_side(by_id, by_id.count()), docs["doc_id"].cast("long").eqNullSafe(F.col("__tsid")), "left")
    repeat = lambda df, n: df.withColumn("__tsk", F.explode(F.array_repeat(F.lit(0), n.cast("int")))).select(*docs.columns)
    single = repeat(out.where("__tsrows IS NULL OR __tsrows = 1"), F.coalesce(F.col("__tsn"), F.lit(1)))
    if by_id.where("__tsrows > 1").isEmpty():
        return single
    # the rows of ids on several rows: their places are counted by class and part of the written table, so no class meets in one task
    source, size = F.coalesce(F.concat(F.lit("+"), F.col("source").cast("string")), F.lit("-")), F.regexp_count(text_of(), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    rows = checkpointed(out.where("__tsrows > 1").withColumn("__tsclass", F.struct(F.col("__tsid"), source.alias("s"), size.alias("n"))).drop("__tsid", "__tsrows", "__tsn")).withColumn("__tspart", F.spark_partition_id())
    parts = rows.groupBy("__tsclass", "__tspart").agg(F.count(F.lit(1)).alias("n"))
    parts = parts.withColumn("__tsfirst", F.sum("n").over(Window.partitionBy("__tsclass").orderBy("__tspart")) - F.col("n")).drop("n")
    taken = items.groupBy(F.struct(F.col("doc_id").alias("__tsid"), F.coalesce(F.concat(F.lit("+"), F.col("source")), F.lit("-")).alias("s"), F.col("size").alias("n")).alias("__tsclass")).agg(F.sum("rows").alias("__tsrows"), F.sum("taken").alias("__tstaken"))
    placed = rows.withColumn("__tsat", F.row_number().over(Window.partitionBy("__tsclass", "__tspart").orderBy(F.lit(0))) - 1)
    same = lambda a, b: a["__tsclass"].eqNullSafe(b["__tsclass"])
    known = parts.join(taken, same(parts, taken)).select(parts["__tsclass"].alias("__tsof"), F.col("__tspart").alias("__tsin"), "__tsfirst", "__tsrows", "__tstaken")
    placed = placed.join(known, placed["__tsclass"].eqNullSafe(known["__tsof"]) & (placed["__tspart"] == known["__tsin"]))
    return single.unionByName(repeat(placed, _each(F.col("__tstaken"), F.col("__tsrows"), F.col("__tsfirst") + F.col("__tsat"))))


def op10_mix_pivotal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_copies(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
