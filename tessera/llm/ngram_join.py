"""Word n-gram Jaccard self-join of documents: prefix filtering with rare n-grams first.

1. One scan hashes each document's n-grams (64 bits), keeps its set's size and digest, and counts n-grams in a table of
   2**18 cells, whose size does not depend on the input. Cells rank n-grams by how common they are; any ranking gives the
   same links, a better one shorter candidate lists.
2. Documents with equal sets are one node, so copies cost one node whatever their number. A node's id is its digest's
   first 64 bits; sets that share them (told by the other bits) get ids of their own.
3. A second scan of the nodes gives each its prefix, the rarest n-grams of which two linked sets share at least one, as
   rows (n-gram, node, size, position), and a sketch: the whole order of n-grams, rare to common, is cut at fixed pivots
   into parts of about equal weight, and each part of a set has 64 parities.
4. Round one: in the list of each n-gram all nodes are candidates with its hub, the node that has it earliest. Length
   and positional filters go on the row, the sketches filter the pair, and what is left is verified once on the words of
   both whole texts. Links give components.
5. Round two: nodes of a list that are in different components. A link's smaller set has the first shared n-gram early
   enough (its index prefix) to hold the overlap of two sets of its size, so only such rows are joined with the rows of
   larger sets, and lists of many index rows in blocks. Filters by length, by position and by suffix stand in the join:
   behind the shared n-gram, each part in which two suffixes' parities differ bounds the overlap. A pair is passed over
   where one of the last few listed n-grams before this one is the same in both, as it is met there already; its first
   common n-gram is never passed over. After it every pair of nodes in different components that shares a prefix n-gram
   has been excluded by a bound or verified, so no link between components is missing, while a cluster of near copies
   costs a star rather than all its pairs.

Nothing is collected but the table of cells and the few sets whose short digests are equal. Scratch tables lie in the
folder of spark.checkpoint.dir and go at the end.
"""

from __future__ import annotations

import zlib
from collections import OrderedDict
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm._common import Scratch, checkpointed, lookup, read, small_side, text_of

CELL_BITS = 18
CHUNK = 4096
#: Parts of the order of n-grams, each a 64-bit word of a set's sketch; and of its fold that goes with the rows of round two.
SKETCH = 16
FOLDED = 4
#: Listed n-grams before a row's own that round two compares.
BEFORE = 3
#: Index rows of a list that one block of round two holds.
BLOCK = 1_000
CACHED_WORDS = 150_000

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_HASHES = _Hashes()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the text's n-grams; of its whole word sequence if that is shorter; none without words."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    if len(_HASHES) > CACHED_WORDS:
        _HASHES.clear()
    w = np.fromiter(map(_HASHES.__getitem__, parts), np.uint64, len(parts))
    k = min(words, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for j in range(k):
        h = _mix(h + w[j : len(w) - k + 1 + j])
    return np.unique(h)


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _digest(h: np.ndarray, bits: int) -> tuple[int, int]:
    """128 bits of a set; ``bits`` of the first half (fewer than 64 in tests)."""
    digest = blake2b(h.tobytes(), digest_size=16).digest()
    first = int.from_bytes(digest[:8], "little", signed=True)
    return first if bits == 64 else first & (1 << bits) - 1, int.from_bytes(digest[8:], "little", signed=True)


def _scan(words: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << CELL_BITS, np.int64)
        names = ["doc_id", "n", "s1", "s2", "chunk", "counts"]
        for batch in batches:
            n, s1, s2 = [], [], []
            for text in batch.column(1):
                h = shingle_set(text.as_py(), words)
                at, times = np.unique((h >> np.uint64(64 - CELL_BITS)).astype(np.int64), return_counts=True)
                cells[at] += times
                one, two = _digest(h, bits)
                n.append(len(h))
                s1.append(one)
                s2.append(two)
            none = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.nulls(none, pa.int32()), pa.nulls(none, pa.binary())], names=names)
        parts = [(k, cells[k * CHUNK : (k + 1) * CHUNK]) for k in range(len(cells) // CHUNK)]
        parts = [(k, zlib.compress(c.astype("<u4").tobytes(), 1)) for k, c in parts if c.any()]
        none = len(parts)
        yield pa.RecordBatch.from_arrays([pa.nulls(none, pa.int64()), pa.nulls(none, pa.int32()), pa.nulls(none, pa.int64()), pa.nulls(none, pa.int64()), pa.array([k for k, _ in parts], pa.int32()), pa.array([c for _, c in parts], pa.binary())], names=names)

    return run


SCAN = "doc_id long, n int, s1 long, s2 long, chunk int, counts binary"


def _sum_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, c in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            part = np.frombuffer(zlib.decompress(c.as_py()), "<u4").astype("<i8")
            total[k] = total[k] + part if k in total else part
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([c.tobytes() for c in total.values()], pa.binary())], names=["chunk", "counts"])


class Order:
    """The order of n-grams: by their cell's rank (how common it is, in eighths of a power of two), then by hash."""

    def __init__(self, cells: np.ndarray):
        self.rank = (8 * np.log2(cells + 1)).astype(np.uint16)
        mass = np.bincount(self.rank, cells.astype(np.float64))
        self.width = mass / max(1.0, mass.sum())
        self.before = np.cumsum(self.width) - self.width

    def sorted(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The n-grams in order, and the part of the order that each lies in."""
        rank = self.rank[(h >> np.uint64(64 - CELL_BITS)).astype(np.int64)]
        at = np.lexsort((h, rank))
        h, rank = h[at], rank[at]
        place = self.before[rank] + self.width[rank] * (h.astype(np.float64) / 2.0**64)
        return h, np.clip((SKETCH * place).astype(np.int64), 0, SKETCH - 1)


def gram_order(scanned: DataFrame) -> Order:
    """The driver gets 2**18 counts, whatever the input."""
    parts = scanned.where("chunk IS NOT NULL").select("chunk", "counts")
    merged = parts.repartition(16, "chunk").mapInArrow(_sum_chunks, "chunk int, counts binary").collect()
    cells = np.zeros(1 << CELL_BITS, np.int64)
    for r in merged:
        cells[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(bytes(r["counts"]), "<i8")
    return Order(cells)


def _prefixes(words: int, percent: int, order, bits: int, twins: dict[tuple[int, int], int]):
    """Rows of prefixes, and for each node one without n-gram but with its sketch. part: of the fold, that the n-gram lies in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = order.value
        for batch in batches:
            grams, ids, sizes, places, parts, own = [], [], [], [], [], []
            for text in batch.column(0):
                h = shingle_set(text.as_py(), words)
                if not len(h):
                    continue
                one, two = _digest(h, bits)
                node, p = twins.get((one, two), one), prefix_length(len(h), percent)
                h, part = of.sorted(h)
                odd = np.bincount(part << 6 | (h & np.uint64(63)).astype(np.int64), minlength=64 * SKETCH) & 1
                own.append((node, len(h), np.packbits(odd.astype(np.uint8)).view(np.int64)))
                grams.append(h[:p].view(np.int64))
                ids.append(np.full(p, node, np.int64))
                sizes.append(np.full(p, len(h), np.int32))
                places.append(np.arange(p, dtype=np.int32))
                parts.append((part[:p] * FOLDED // SKETCH).astype(np.int8))
            if grams:
                k, n = len(own), sum(map(len, grams))
                cols = [pa.array(np.concatenate(x)) for x in (grams, ids, sizes, places, parts)]
                yield pa.RecordBatch.from_arrays([*cols, pa.nulls(n, pa.list_(pa.int64()))], names=NAMES)
                nodes, counts, sketches = zip(*own, strict=True)
                yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.array(nodes, pa.int64()), pa.array(counts, pa.int32()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int8()), pa.array(sketches, pa.list_(pa.int64()))], names=NAMES)

    return run


PREFIX = "gram long, id long, n int, pos int, part byte, sketch array<long>"
NAMES = [x.split()[0] for x in PREFIX.split(", ")]


def _texts_of_nodes(words: int, bits: int, twins: dict[tuple[int, int], int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), words) for t in batch.column(0)]
            keys = [_digest(h, bits) for h in sets]
            keep = pa.array([len(h) > 0 for h in sets], pa.bool_())
            node = pa.array([twins.get(k, k[0]) for k in keys], pa.int64())
            yield pa.RecordBatch.from_arrays([node.filter(keep), batch.column(0).filter(keep)], names=["id", "text"])

    return run


def _may_link(percent: int, n1: Column, p1: Column, n2: Column, p2: Column) -> Column:
    """Length filter, and positional filter for the first n-gram that two prefixes share: what follows it bounds the overlap."""
    shared = F.least(n1 - p1, n2 - p2).cast("long")
    return (F.least(n1, n2).cast("long") * 100 >= F.greatest(n1, n2).cast("long") * percent) & (shared * (100 + percent) >= (n1.cast("long") + n2) * percent)


def _is_index(percent: int, n: Column, p: Column) -> Column:
    """Whether what follows position p can hold the overlap of two sets of size n."""
    return (n.cast("long") - p) * (100 + percent) >= n.cast("long") * (2 * percent)


_WORDS = [f"k{k}" for k in range(FOLDED)]


def _folded(sketch: Column, k: int) -> Column:
    """Word k of the fold: parities of neighbouring parts that are taken together add up to the parity of both."""
    out = sketch[k * SKETCH // FOLDED]
    for j in range(k * SKETCH // FOLDED + 1, (k + 1) * SKETCH // FOLDED):
        out = out.bitwiseXOR(sketch[j])
    return out


def _overlap_may_do(percent: int, total: Column, apart: Column) -> Column:
    return (total - apart) * (100 + percent) >= total * (2 * percent)


def _suffixes_may_do(percent: int, n: Column, p: Column, m: Column, q: Column, part: Column, one: list[Column], two: list[Column]) -> Column:
    """Suffix filter, for the first n-gram that two sets share, at p and q: of the parts of the order behind its own, each
    parity in which the suffixes differ is of another n-gram that only one has. The whole sets are bounded likewise."""
    differ = [F.bit_count(x.bitwiseXOR(y)) for x, y in zip(one, two, strict=True)]
    total = n.cast("long") + m
    behind = sum((F.when(part < k, differ[k]).otherwise(0) for k in range(1, FOLDED)), F.lit(0))
    return _overlap_may_do(percent, total, sum(differ[1:], differ[0])) & ((total - p - q - behind) * (100 + percent) >= total * (2 * percent))


def _sketch_filter(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose whole sketches do not prove too small an overlap."""
    side = lambda x: nodes.select(F.col("id").alias(x), F.col("n").alias(f"{x}_n"), F.col("sketch").alias(f"{x}_k"))
    apart = F.aggregate(F.zip_with("a_k", "b_k", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return pairs.join(side("a"), "a").join(side("b"), "b").where(_overlap_may_do(percent, F.col("a_n").cast("long") + F.col("b_n"), apart)).select("a", "b")


def exact_sets(one: list[bytes], two: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of two texts' words, as numbers that are equal just if the n-grams are, without hashing."""
    known: dict[bytes, int] = {}
    codes, sizes = [], [min(words, len(one)), min(words, len(two))]
    numbers = [np.fromiter((known.setdefault(w, len(known)) for w in x), np.int64, len(x)) for x in (one, two)]
    base = len(known) + 1
    for x, k in zip(numbers, sizes, strict=True):
        codes.append(x[: len(x) - k + 1] + 1)
    if sizes[0] != sizes[1]:  # a text of fewer words is one n-gram of another length
        return np.array([-1]) if sizes[0] < words else _distinct_from(numbers[0], words), np.array([-2]) if sizes[1] < words else _distinct_from(numbers[1], words)
    most = base
    for j in range(1, sizes[0]):
        if most > 2**62 // base:
            both, at = np.unique(np.concatenate(codes), return_inverse=True)
            codes, most = [at[: len(codes[0])], at[len(codes[0]) :]], len(both)
        codes = [c * base + x[j : len(x) - sizes[0] + 1 + j] + 1 for c, x in zip(codes, numbers, strict=True)]
        most = most * base
    return np.unique(codes[0]), np.unique(codes[1])


def _distinct_from(numbers: np.ndarray, words: int) -> np.ndarray:
    """Of a text that shares no n-gram with the other: its distinct n-grams by place of their first occurrence."""
    grams = np.lib.stride_tricks.sliding_window_view(numbers, words)
    return np.arange(len(np.unique(grams, axis=0)))


def _verify(words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent: OrderedDict[int, list[bytes]] = OrderedDict()

        def of(node: int, text) -> list[bytes]:
            if node not in recent:
                recent[node] = text.as_py().encode().lower().split()
                if len(recent) > 64:
                    recent.popitem(last=False)
            else:
                recent.move_to_end(node)
            return recent[node]

        for batch in batches:
            a, b, ta, tb = batch.columns
            good = []
            for k, (x, y) in enumerate(zip(a.to_pylist(), b.to_pylist(), strict=True)):
                one, two = exact_sets(of(x, ta[k]), of(y, tb[k]), words)
                both = len(one) + len(two) - len(np.union1d(one, two))
                good.append(100 * both >= percent * (len(one) + len(two) - both))
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], names=["a", "b"])

    return run


class _Texts:
    """One text of each node: from the row that stands for it, or of rows whose doc_id is null or repeated from a table of theirs."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, repeated: DataFrame | None):
        self.docs, self.nodes, self.repeated = docs, nodes, repeated

    def of(self, wanted: DataFrame, n: int) -> DataFrame:
        rows = self.nodes.where("rep IS NOT NULL").select("id", F.col("rep").alias("doc_id")).join(small_side(wanted, n), "id")
        out = self.docs.join(small_side(rows, n), "doc_id").select("id", "text")
        return out if self.repeated is None else out.unionByName(self.repeated.join(small_side(wanted, n), "id", "left_semi"))


def _links(pairs: DataFrame, sketches: DataFrame, texts: _Texts, words: int, percent: int, scratch: Scratch) -> DataFrame:
    """The pairs that are links, each verified once on whole texts. Only the texts of nodes in a candidate pair move."""
    pairs = scratch.table(_sketch_filter(pairs, sketches, percent))
    wanted = scratch.table(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
    found = scratch.table(texts.of(wanted, wanted.count()))
    second = found.select(F.col("id").alias("b"), F.col("text").alias("text_b")).join(small_side(pairs, pairs.count()), "b")
    both = second.join(found.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    links = scratch.table(both.select("a", "b", "text_a", "text_b").mapInArrow(_verify(words, percent), "a long, b long"))
    scratch.drop(pairs, wanted, found)
    return links


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component): the smallest id that each node of edges (a, b) reaches, by alternating large-star and small-star steps.

    A node's smallest neighbour is an aggregate with partial results; it is sent to the node's edges by ``lookup``, so
    that the edges of a hub are not gathered.
    """

    def star(e: DataFrame, large: bool, n: int) -> DataFrame:
        near = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a")) if large else e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        low = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        out = lookup(near, low, "u", "n", 2 * n, 2 * n, 24)
        if large:
            out = out.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = out.select(F.col("v").alias("a"), F.col("m").alias("b")).union(low.select(F.col("u"), F.col("m")))
        return out.where("a <> b").distinct()

    mark = None
    edges = edges.where("a <> b").select("a", "b")
    n = edges.count()
    while n:
        between = scratch.table(star(edges, True, n))
        edges = scratch.table(star(between, False, between.count()))
        scratch.drop(between)
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31)))).first())
        if now == mark:
            break
        mark, n = now, now[0]
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))


def _twins(sets: DataFrame) -> dict[tuple[int, int], int]:
    """Ids of the sets whose short digests are equal though the sets are not: at 64 bits a few in tens of billions."""
    equal = sets.groupBy("s1", "s2").agg(F.first("n")).groupBy("s1").agg(F.sort_array(F.collect_list("s2")).alias("s2")).where("size(s2) > 1").collect()
    step = 0x9E3779B97F4A7C15
    while equal:
        out = {(r["s1"], two): (r["s1"] + k * step + 2**63) % 2**64 - 2**63 for r in equal for k, two in enumerate(r["s2"])}
        fresh = set(out.values())
        if len(fresh) == len(out) and sets.where(F.col("s1").isin([x for key, x in out.items() if x != key[0]])).isEmpty():
            return out
        step += 2
    return {}


def listed_rows(prefixes: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Rows of n-grams that more than one node has, with their list's number of index rows (c_index), hub, and (in viable) whether any
    partner of theirs could have the size and position that a link asks for."""
    n, p = F.col("n").cast("long"), F.col("pos")
    lists = prefixes.groupBy("gram").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("pos", "n", "id")).alias("hub"), F.sum(_is_index(percent, n, p).cast("long")).alias("c_index"), F.max(n - p).alias("far"), F.min(n).alias("least")).where("c > 1")
    lists = scratch.table(lists.select("gram", "c", F.col("c").alias("c_all"), "c_index", "far", "least", F.col("hub.id").alias("hub"), F.col("hub.n").alias("hub_n"), F.col("hub.pos").alias("hub_pos")))
    out = lookup(prefixes, lists, "gram", "c", prefixes.count(), None)
    partner = F.greatest(F.col("least"), F.ceil(n * percent / 100))
    viable = (F.col("c_all") > 2) & (F.least(n - p, F.col("far")) * (100 + percent) >= (n + partner) * percent) & (n * 100 >= F.col("least") * percent)
    return out.withColumn("viable", viable).drop("c_all", "far", "least")


def round_two(placed: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes in different components that no bound excludes. placed: rows of lists without their hubs (which round one
    has compared with all), apart: whether a row's component is another than its hub's."""
    names, blocks = [f"before_{k}" for k in range(BEFORE)], F.greatest(F.lit(1), F.ceil(F.col("c_index") / BLOCK))
    own = ["id", "n", "pos", "label", *names, *_WORDS]
    # side: 0 apart from its hub, 1 not. An index row meets all rows of its list, one that is not apart only those that are.
    small = placed.where(_is_index(percent, F.col("n"), F.col("pos"))).select("gram", "part", F.pmod(F.xxhash64("id"), blocks).cast("int").alias("block"), (~F.col("apart")).cast("int").alias("side"), *[F.col(c).alias(f"x_{c}") for c in own])
    large = placed.withColumn("side", F.explode(F.when(F.col("apart"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    large = large.withColumn("block", F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int")))).select("gram", "block", "side", *own)
    seen = F.lit(False)
    for a in names:
        for b in names:
            seen = seen | F.coalesce(F.col(a) == F.col(f"x_{b}"), F.lit(False))
    larger = (F.col("x_n") < F.col("n")) | ((F.col("x_n") == F.col("n")) & (F.col("x_id") < F.col("id")))
    n, pos, m, at = F.col("n"), F.col("pos"), F.col("x_n"), F.col("x_pos")
    alike = _suffixes_may_do(percent, n, pos, m, at, F.col("part"), [F.col(w) for w in _WORDS], [F.col(f"x_{w}") for w in _WORDS])
    met = small.join(large, ["gram", "block", "side"]).where(larger & (F.col("x_label") != F.col("label")) & _may_link(percent, n, pos, m, at) & ~seen & alike)
    return met.select(F.least("id", "x_id").alias("a"), F.greatest("id", "x_id").alias("b")).distinct()


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 80, digest_bits: int = 64) -> DataFrame:
    """doc_id, n_shingles, component_id for each row; two documents link when 100 * intersection >= percent * union.

    Sets are of distinct n-grams of ASCII-lower-cased words; a text of fewer words is one n-gram; a null text, or one
    without words, has an empty set and no link, and its component is itself. component_id is the smallest doc_id that
    is reachable. Rows that repeat a doc_id are one node of the graph, with the links of each of their texts. A row without
    doc_id is linked by its text alone; its component_id is null if it reaches no doc_id. An empty table gives no rows;
    other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    with Scratch(spark, "ngram") as scratch:
        scanned = scratch.table(docs.mapInArrow(_scan(words, digest_bits), SCAN))
        order = spark.sparkContext.broadcast(gram_order(scanned))
        sets = scanned.where("n IS NOT NULL").drop("chunk", "counts")
        twins = _twins(sets.where("n > 0"))
        sets = sets.withColumn("id", F.col("s1"))
        if twins:
            known = spark.createDataFrame([(*k, x) for k, x in twins.items()], "s1 long, s2 long, twin long")
            sets = sets.join(F.broadcast(known), ["s1", "s2"], "left").withColumn("id", F.coalesce("twin", "s1"))
        sets = sets.select("doc_id", "n", "id")

        # rows whose doc_id is null or repeated cannot be found again by it
        repeats = scratch.table(sets.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1 OR doc_id IS NULL").select(F.col("doc_id").alias("_id"), F.lit(True).alias("again")))
        n_repeats = repeats.count()
        if n_repeats:
            sets = scratch.table(sets.join(small_side(repeats, n_repeats), F.col("doc_id").eqNullSafe(F.col("_id")), "left").select("doc_id", "n", "id", F.coalesce("again", F.lit(False)).alias("again")))
        else:
            sets = sets.withColumn("again", F.lit(False))
        full = sets.where("n > 0")
        nodes = scratch.table(full.groupBy("id").agg(F.min(F.when(~F.col("again"), F.col("doc_id"))).alias("rep"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows")))
        n_nodes, n_full = nodes.agg(F.count(F.lit(1)), F.coalesce(F.sum("rows"), F.lit(0))).first()
        copies = lookup(full.select("doc_id", "id", "again"), nodes.where("rows > 1").select("id", "rep", "rows"), "id", "rows", n_full, None).where("NOT again AND doc_id <> rep").select("doc_id")
        skip = scratch.table(copies.union(repeats.where("_id IS NOT NULL").select("_id")))
        single = docs.where("doc_id IS NOT NULL").join(small_side(skip, skip.count()), "doc_id", "left_anti").select("text")
        repeated = None
        if n_repeats:
            rows = docs.join(small_side(repeats, n_repeats), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").select("text")
            texts = rows.mapInArrow(_texts_of_nodes(words, digest_bits, twins), "id long, text string").groupBy("id").agg(F.first("text").alias("text"))
            repeated = scratch.table(texts.join(nodes.where("rep IS NULL").select("id"), "id", "left_semi"))
            single = single.unionByName(repeated.select("text"))
        texts = _Texts(docs, nodes, repeated)
        prefixes = scratch.table(single.mapInArrow(_prefixes(words, percent, order, digest_bits, twins), PREFIX))
        sketches = scratch.table(prefixes.where("gram IS NULL").select("id", "n", "sketch"))
        listed = scratch.table(listed_rows(prefixes.where("gram IS NOT NULL").drop("sketch"), percent, scratch))
        scratch.drop(prefixes)

        stars = listed.where("id <> hub").where(_may_link(percent, F.col("n"), F.col("pos"), F.col("hub_n"), F.col("hub_pos")))
        first = scratch.table(stars.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct())
        links = _links(first, sketches, texts, words, percent, scratch)
        label = scratch.table(components(links, scratch))
        n_labels = label.count()

        def labelled(df: DataFrame, of: str, name: str) -> DataFrame:
            found = small_side(label.select(F.col("id").alias("_id"), F.col("component").alias("_label")), n_labels)
            return df.join(found, F.col(of) == F.col("_id"), "left").withColumn(name, F.coalesce("_label", of)).drop("_id", "_label")

        names = [f"before_{k}" for k in range(BEFORE)]
        before = [F.lag("gram", k).over(Window.partitionBy("id").orderBy("pos")) for k in range(1, BEFORE + 1)]
        placed = listed.withColumns(dict(zip(names, before, strict=True))).where("viable AND id <> hub").drop("viable", "hub_n", "hub_pos")
        placed = labelled(labelled(placed, "id", "label"), "hub", "hub_label").withColumn("apart", F.col("label") != F.col("hub_label")).drop("hub", "hub_label")
        folds = sketches.select("id", *[_folded(F.col("sketch"), k).alias(w) for k, w in enumerate(_WORDS)])
        placed = scratch.table(placed.join(folds, "id"))
        scratch.drop(listed)
        second = scratch.table(round_two(placed, percent).join(first, ["a", "b"], "left_anti"))
        scratch.drop(placed)
        more = _links(second, sketches, texts, words, percent, scratch)
        if n_repeats:
            more = more.unionByName(_same_document(full, scratch))
        joined = scratch.table(components(labelled(labelled(more, "a", "la"), "b", "lb").select(F.col("la").alias("a"), F.col("lb").alias("b")), scratch))
        top = small_side(joined.select(F.col("id").alias("label"), F.col("component").alias("top")), joined.count())
        tops = labelled(nodes.select("id", "least", "rows"), "id", "label").join(top, "label", "left").select("id", "least", "rows", F.coalesce("top", "label").alias("top"))
        # most tops are of one node; the smallest doc_id of the others is looked up
        tops = scratch.table(tops)
        smallest = tops.groupBy("top").agg(F.min("least").alias("component"), F.count(F.lit(1)).alias("of")).where("of > 1")
        smallest = scratch.table(smallest)
        n_smallest = smallest.count()
        linked = lookup(tops.select("id", "rows", "top"), smallest, "top", "of", n_nodes, n_smallest)
        linked = scratch.table(linked.select("id", "component", "rows"))
        rest = nodes.select("id", F.col("least").alias("component"), "rows").join(small_side(linked.select("id"), n := linked.count()), "id", "left_anti")
        ends = scratch.table(linked.unionByName(rest)) if n else nodes.select("id", F.col("least").alias("component"), "rows")
        of_set = lookup(full.select("doc_id", "n", "id"), ends.select("id", "component", "rows"), "id", "rows", n_full, None)
        out = of_set.select("doc_id", "n", "component").unionByName(_without_words(sets, of_set if n_repeats else None))
        return checkpointed(out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("component").alias("component_id")))


def _same_document(full: DataFrame, scratch: Scratch) -> DataFrame:
    """Links (a, b) between the sets that rows of one doc_id have."""
    pairs = scratch.table(full.where("again AND doc_id IS NOT NULL").select("doc_id", F.col("id").alias("a")).distinct())
    low = scratch.table(pairs.groupBy("doc_id").agg(F.min("a").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    return lookup(pairs, low, "doc_id", "n", pairs.count(), low.count()).select("a", "b")


def _without_words(sets: DataFrame, of_set: DataFrame | None) -> DataFrame:
    """Rows with empty sets: each its own, but for those whose doc_id has another text."""
    empty = sets.where("n = 0")
    if of_set is None:
        return empty.select("doc_id", "n", F.col("doc_id").alias("component"))
    other = of_set.groupBy(F.col("doc_id").alias("_of")).agg(F.min("component").alias("component"))
    return empty.join(other, F.col("doc_id") == F.col("_of"), "left").select("doc_id", "n", F.coalesce("component", "doc_id").alias("component"))


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, one document of each component (the smallest doc_id), with all their columns.

    A doc_id on several rows is one document: it stays with one row for each of its different texts. So do rows without doc_id.
    """
    found = jaccard_components(docs, words, percent)
    dropped = checkpointed(found.where("doc_id <> component_id").select(F.col("doc_id").alias("__tsid")).distinct())
    kept = docs.join(small_side(dropped, dropped.count()), docs["doc_id"].cast("long") == F.col("__tsid"), "left_anti")
    again = checkpointed(found.groupBy(F.col("doc_id").alias("__tsid")).agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR __tsid IS NULL").select("__tsid"))
    n = again.count()
    if not n:
        return kept
    side, same = small_side(again, n), F.col("__tsid").eqNullSafe(docs["doc_id"].cast("long"))
    return kept.join(side, same, "left_anti").unionByName(kept.join(side, same, "left_semi").dropDuplicates(["doc_id", "text"]))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents"), words=3, percent=90)


SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d
), n AS (SELECT d.doc_id, count(g) AS n FROM d LEFT JOIN s ON d.doc_id = s.doc_id GROUP BY d.doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 90 * (x.n + y.n - common)),
r AS (SELECT doc_id, doc_id AS top FROM d UNION SELECT l.b, r.top FROM r JOIN l ON l.a = r.doc_id)
SELECT n.doc_id, n.n AS n_shingles, min(r.top) AS component_id FROM n JOIN r ON r.doc_id = n.doc_id GROUP BY n.doc_id, n.n
"""
