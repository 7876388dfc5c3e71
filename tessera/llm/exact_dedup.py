"""Exact deduplication by skew-safe combining, in DataFrame operations only.

1. Local: each task combines its equal texts (the map-side half of a hash aggregate whose key is the digest and the
   whole text), so a hot text leaves a task once.
2. Salted: the partial winners of a text meet in ``salts`` reducers (the salt is that of the task), so that not all
   tasks send a hot text to the same one.
3. Global: at most ``salts`` winners of each text are combined.

The whole text is a grouping key at each of the three, so two texts that shared a digest would stay apart. The last
step tells every row of its group by SHA-256, xxHash and length of its text, and moves no text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._common import ascii_lower, checkpointed, read, small_side, text_of

CONTENT_ID = ["text_sha256", "_hash", "_length"]


def _content_id(text: str):
    t = F.col(text)
    return [F.sha2(t, 256).alias("text_sha256"), F.xxhash64(t).alias("_hash"), F.length(t).alias("_length")]


def content_winners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """One row for each different text: its content id, keep_id (largest id) and group_size."""
    rows = docs.select(F.col(id_col).alias("_id"), ascii_lower(text_of(text_col)).alias("_text"))
    keyed = rows.select("_id", "_text", F.sha2("_text", 256).alias("text_sha256"), F.pmod(F.spark_partition_id(), F.lit(salts)).alias("_salt"))
    salted = keyed.groupBy("text_sha256", "_text", "_salt").agg(F.max("_id").alias("_id"), F.count(F.lit(1)).alias("_n"))
    merged = salted.groupBy("text_sha256", "_text").agg(F.max("_id").alias("keep_id"), F.sum("_n").alias("group_size"))
    return merged.select("text_sha256", F.xxhash64("_text").alias("_hash"), F.length("_text").alias("_length"), "keep_id", "group_size")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """A verdict for each row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; a null text counts as empty. The largest id of a group
    stays. A null id stays only in a group without any other id. Rows that repeat an id are one document and get the
    same verdict. An empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("_id"), ascii_lower(text_of(text_col)).alias("_text")).select("_id", *_content_id("_text"))
    joined = rows.join(content_winners(docs, id_col, text_col, salts), CONTENT_ID)
    return joined.select(F.col("_id").alias(id_col), "keep_id", "group_size", F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """The rows of docs that stay, with all their columns: one for each different text.

    Rows are picked by their id and their text's content id; no text is shuffled for it, but for the rows that stay of
    an id that is null or stands on several rows.
    """
    ids = [f"__ts{c}" for c in CONTENT_ID]
    dropped = content_winners(docs, id_col, text_col, salts).where("group_size > 1")
    dropped = checkpointed(dropped.select(*[F.col(c).alias(i) for c, i in zip(CONTENT_ID, ids, strict=True)], F.col("keep_id").alias("__tskeep")))
    marked = docs.withColumn("__tstext", ascii_lower(text_of(text_col)))
    marked = marked.withColumns({i: c for i, c in zip(ids, _content_id("__tstext"), strict=True)}).drop("__tstext")
    n = dropped.count()
    out = marked.join(small_side(dropped.withColumn("__tsin", F.lit(True)), n, 120), ids, "left")
    out = out.where(F.col("__tsin").isNull() | F.col(id_col).eqNullSafe(F.col("__tskeep")))
    again = docs.groupBy(F.col(id_col).alias("__tsid")).agg(F.count(F.lit(1)).alias("__tsn")).where("__tsn > 1")
    if not again.isEmpty():  # a text's last id may stand on several of its rows
        out = out.where("__tsin IS NULL").unionByName(out.where("__tsin").dropDuplicates(ids))
    return out.select(*docs.columns)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(read(spark, sf_dir, "documents"))


SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g USING (t)
"""
