"""Packing of tokenised documents into fixed windows: best-fit decreasing.

A document longer than the window is first cut into full windows. What is left is packed in decreasing order of
length: a segment tree indexed by remaining capacity finds the tightest open window that still holds the piece.
Pieces are dealt over groups of about ``PER_SHARD`` rows by a hash of their place in the written table of pieces, so a
doc_id on any number of rows is dealt evenly, the number of independent packings grows with the input, a task never holds
more than a group, and what a group's last windows lack stays negligible.
Only piece lengths move; texts and ids of tokens never leave the task that reads them.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._common import checkpointed, read, shards, text_of

WINDOW = 4096
PER_SHARD = 4000
TOKENIZER = "word_bpe_49k.json"
END_ID = 2
#: Runs of a generation that a Python worker remembers (two are about 250 MB).
CACHED_WORDS = 500_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = PIECES + ", sequence_id long, offset long"


def _latin(run: str) -> bool:
    """Letters only, of the Latin blocks up to U+024F: one word to the tokenizer, unless its lower case holds a combining mark."""
    return run.isalpha() and max(run) < "\u0250"


class WordIds(dict):
    """Ids of the space-free runs of a text as little-endian bytes.

    The tokenizer drops white space and never joins what it separates, so a text's ids are those of its runs. A word in
    lower case goes to the tokenizer's model at once, others in their lower-case form, and a comma or stop
    after a word on its own, as the tokenizer splits them (after a word only: a mark that lower-casing leaves would join
    it); all other runs take the whole tokenizer. Runs are remembered
    in two generations: when the younger is full it becomes the older, from which what is met again moves on.
    """

    def __init__(self, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__()
        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        self.model = self.tokenizer.model
        self.spelled = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.older: dict[str, bytes] = {}

    def _pack(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, run: str) -> bytes:
        if run in self.older:
            out = self.older[run]
        elif not run:
            out = b""
        elif _latin(run):
            low = run.lower()
            if low == run:
                out = self._pack([t.id for t in self.model.tokenize(run if run.isascii() else self.spelled(run)[0][0])])
            else:
                out = self[low] if _latin(low) else self._pack(self.tokenizer.encode(run, add_special_tokens=False).ids)
        elif run[-1] in ",." and _latin(run[:-1]) and _latin(run[:-1].lower()):
            out = self[run[:-1]] + self[run[-1]]
        else:
            out = self._pack(self.tokenizer.encode(run, add_special_tokens=False).ids)
        if len(run) <= 64:
            self[run] = out
        return out

    def text(self, text: str) -> bytes:
        if len(self) > CACHED_WORDS:
            self.older = dict(self)
            self.clear()
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


_ENCODERS: dict[str, WordIds] = {}


def encoder(name: str) -> WordIds:
    if name not in _ENCODERS:
        _ENCODERS[name] = WordIds(name)
    return _ENCODERS[name]


def _cut(window: int, tokenizer: str):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, end = encoder(tokenizer), np.array([END_ID], dtype="<u4").tobytes()
        for batch in batches:
            docs = batch.column(0).to_pylist()
            out: list[tuple] = []
            for doc, text in zip(docs, batch.column(1), strict=True):
                ids = ids_of.text(text.as_py()) + end
                total = len(ids) // 4
                for at in range(0, total, window):
                    piece = ids[4 * at : 4 * (at + window)]
                    out.append((doc, at, len(piece) // 4, zlib.crc32(piece), total))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        ids_of.older = {}  # the worker may go on to other work

    return cut


class OpenWindows:
    """A segment tree over remaining capacities: a node tells if any open window below it has that much left."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.tree = bytearray(2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def put(self, left: int, which: int) -> None:
        self.open[left].append(which)
        at = left + self.leaves
        while at and not self.tree[at]:
            self.tree[at] = 1
            at >>= 1

    def tightest(self, need: int) -> int:
        """The smallest capacity of at least need that an open window has; -1 if none."""
        tree, at = self.tree, need + self.leaves
        while not tree[at]:
            while at & 1:
                at >>= 1
            if at <= 1:
                return -1
            at += 1
        while at < self.leaves:
            at = 2 * at if tree[2 * at] else 2 * at + 1
        return at - self.leaves

    def take(self, left: int) -> int:
        which = self.open[left].pop()
        at = left + self.leaves
        if not self.open[left]:
            self.tree[at] = 0
            at >>= 1
            while at and not (tree := self.tree)[2 * at] and not tree[2 * at + 1]:
                tree[at] = 0
                at >>= 1
        return which


def best_fit_decreasing(lengths, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For pieces given in decreasing order of length: the window and the offset of each."""
    tree, opened = OpenWindows(window), 0
    which, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for k, n in enumerate(lengths):
        left = tree.tightest(n)
        if left < 0:
            left, bin_ = window, opened
            opened += 1
        else:
            bin_ = tree.take(left)
        which[k], offset[k] = bin_, window - left
        if left > n:
            tree.put(left - n, bin_)
    return which, offset


def _pack(window: int):
    def pack(group: pa.Table) -> pa.Table:
        rows = group.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        which, offset = best_fit_decreasing(rows["length"].to_pylist(), window)
        sequence = (rows["_shard"].to_numpy() << 32) + which
        return rows.drop_columns("_shard").append_column("sequence_id", pa.array(sequence, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    return pack


def pack_documents(docs: DataFrame, window: int = WINDOW, tokenizer: str = TOKENIZER, per_shard: int = PER_SHARD) -> DataFrame:
    """One row for each piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every document ends with id 2, so a null or empty text is one piece of one token. Rows that repeat a doc_id are
    packed each on its own. A null doc_id is kept. An empty table gives no rows; other columns are ignored.
    """
    pieces = checkpointed(docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(_cut(window, tokenizer), PIECES))
    n = shards(pieces.count(), per_shard)
    dealt = pieces.withColumn("_shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)).cast("long"))
    return dealt.groupBy("_shard").applyInArrow(_pack(window), PACKED)


def op2_pack_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"))
