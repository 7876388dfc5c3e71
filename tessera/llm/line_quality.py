"""Quality rules: base rules on each text, and how often its lines come back in other documents of its host.

A line is compared in lower case, with white space collapsed and digits alike, by a 64-bit hash of it and of its host. Its
count on a host is of distinct documents: exact, and documents with the same set of lines (copies) are one document, so
that a page does not lose its lines for having been copied. Near copies are different documents. The limit is the larger
of ``min_docs`` and ``share`` of the host's distinct documents. Lines above it are removed, except from the host's
smallest doc_id that has them, and a document that loses too much is depleted.

Counts cover all lines. (line, set) pairs are combined before and after their shuffle, then counted by line with partial
sums, so a line in every document is one row a task; hot lines are broadcast only within a checked size, beyond which
only the heaviest are.
"""


from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._common import Scratch, checkpointed, lookup, read, small_side, text_of

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MIN_DOCS = 20
SHARE = 0.01
LEAST_LEFT = 0.3

_SYMBOLS = b"#*$%&|<>"
_DIGITS = bytes.maketrans(b"123456789", b"000000000")

SCAN = "row long, doc_id long, host long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, set long, lines array<struct<line:int,key:long,words:int>>"


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    chars = len(text) - sum(text.count(c) for c in " \t\n\x0b\x0c\r")
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    grams = list(zip(words, words[1:], words[2:], words[3:], words[4:], strict=False))
    repeat = 0
    if len(set(grams)) < len(grams):
        times, end = Counter(grams), 0
        for k, g in enumerate(grams):
            if times[g] > 1:
                repeat += k + 5 - max(end, k)
                end = k + 5
    return n, chars, symbols, len(lines) - len(set(lines)), repeat


def line_key(line: bytes, host: int) -> int:
    return xxhash.xxh64_intdigest(b" ".join(line.lower().translate(_DIGITS).split()), seed=host & (2**64 - 1))


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    row = TaskContext.get().partitionId() << 33
    for batch in batches:
        out = []
        for doc, host, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            text = value.as_py()
            host = _signed(xxhash.xxh64_intdigest(b"-" if host is None else b"+" + host.encode()))
            lines = [{"line": k, "key": _signed(line_key(x, host)), "words": w} for k, x in enumerate(text.encode().split(b"\n")) if (w := len(x.split()))]
            keys = sorted({x["key"] for x in lines})
            whole = _signed(xxhash.xxh64_intdigest(np.array(keys, np.int64).tobytes(), seed=host & (2**64 - 1)))
            out.append((row, doc, host, *base_counts(text), whole, lines))
            row += 1
        cols = list(zip(*out, strict=True)) or [[]] * 10
        line = pa.list_(pa.struct([("line", pa.int32()), ("key", pa.int64()), ("words", pa.int32())]))
        yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols[:9]], pa.array(cols[9], line)], names=[x.split()[0] for x in SCAN.split(", ")])


def line_quality(docs: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE, least_left: float = LEAST_LEFT) -> DataFrame:
    """For each row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, removed_words and
    removed_lines (their numbers in the text, null if none). The host of a document is its source.

    base_failed: under 10 words, or over 20% of the words in repeated windows. A document is depleted if lines were removed
    and fewer than 10 words or than ``least_left`` of its words stay. A null or empty text has no words and fails; a null
    source is a host of its own; rows that repeat a doc_id or its text are each judged, and count once for their lines. An
    empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string").alias("host"), text_of().alias("text"))
    with Scratch(docs.sparkSession, "lines") as scratch:
        scanned = scratch.table(rows.mapInArrow(_scan, SCAN))
        lines = scanned.select("row", "doc_id", "host", "set", F.explode("lines").alias("l")).select("row", "doc_id", "host", "set", "l.*")
        pairs = lines.groupBy("key", "set").agg(F.min("doc_id").alias("first"), F.min("host").alias("host"), F.count(F.lit(1)).alias("n"))
        counts = pairs.groupBy("key").agg(F.count(F.lit(1)).alias("docs"), F.min("first").alias("first"), F.min("host").alias("host"), F.sum("n").alias("n")).where(F.col("docs") > min_docs)
        hosts = scratch.table(scanned.select("host", "set").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("host_docs")))
        hot = scratch.table(counts.join(small_side(hosts, hosts.count()), "host").where(F.col("docs") > share * F.col("host_docs")).select("key", "first", "n"))
        n_hot, n_lines = hot.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        removed = lookup(lines.select("row", "doc_id", "key", "line", "words"), hot, "key", "n", n_lines, n_hot).where(~F.col("doc_id").eqNullSafe(F.col("first")))
        removed = removed.groupBy("row").agg(F.sum("words").alias("removed_words"), F.array_sort(F.collect_list("line")).alias("removed_lines"))
        judged = scanned.drop("lines", "set", "host").join(removed, "row", "left").withColumn("removed_words", F.coalesce("removed_words", F.lit(0)).cast("long"))
        left = F.col("n_words") - F.col("removed_words")
        depleted = (F.col("removed_words") > 0) & ((left < MIN_WORDS) | (left < least_left * F.col("n_words")))
        failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
        out = judged.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & ~depleted)
        return checkpointed(out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words", "removed_lines"))


def drop_low_quality(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that stay, with all their columns and without the lines above their limit (n_chars follows, if it is there).

    A doc_id on several rows stays if one of them does, and loses the lines that each of its rows loses.
    """
    found = line_quality(docs, **options).groupBy(F.col("doc_id").alias("__tsid")).agg(F.max("kept").alias("__tskept"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("removed_lines")))).alias("__tslines"))
    found = checkpointed(found.where("NOT __tskept OR size(__tslines) > 0"))
    size = found.agg(F.coalesce(F.sum(40 + 4 * F.size("__tslines")), F.lit(0))).first()[0]
    out = docs.join(small_side(found, size, 1), docs["doc_id"].eqNullSafe(F.col("__tsid")), "left").where("__tskept IS NULL OR __tskept")
    clean = F.array_join(F.filter(F.split("text", "\n"), lambda _, k: ~F.array_contains("__tslines", k)), "\n")
    out = out.withColumn("text", F.when(F.size(F.coalesce("__tslines", F.array().cast("array<int>"))) > 0, clean).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(F.coalesce("__tslines", F.array().cast("array<int>"))) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def op1_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality(read(spark, sf_dir, "documents")).drop("removed_lines")
