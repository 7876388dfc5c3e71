"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: A side of a join is broadcast only if its counted rows, at their bytes, stay within this; beyond it the join is shuffled.
BROADCAST_BYTES = 16 << 20
#: Keys with more than one of this many parts of all rows are heavy; there are no more of them than this.
HEAVY_KEYS = 50_000
#: Rows of a key that one task takes in any case.
LEAST_HEAVY = 100


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_of(name: str = "text") -> Column:
    """A text column in which null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(c, UPPER, LOWER)


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a session in one process (as in tests) may do without and gets a folder of its own."""
    sc = spark.sparkContext
    set_ = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not set_ and (sc.master or "").split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(set_ or tempfile.mkdtemp(prefix="tessera-checkpoint-"))
        current = sc._jsc.sc().getCheckpointDir()
    return set_ or current.get()


def checkpointed(df: DataFrame) -> DataFrame:
    """df from a checkpoint in the shared folder: its lineage ends there, so a lost executor costs no step before it."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


#: Rows that go to Python at once while an operator runs; texts are long, and a worker holds a batch several times over.
ARROW_ROWS = 1000
_ARROW = "spark.sql.execution.arrow.maxRecordsPerBatch"


class Scratch:
    """Tables of one operator, written as Parquet to the shared folder; they go when the operator's result is checkpointed."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.n = spark, f"{shared_folder(spark).rstrip('/')}/tessera-{name}-{uuid.uuid4().hex}", 0
        self._paths: dict[int, tuple[DataFrame, str]] = {}

    def table(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.path}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = out, path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that nothing will read again."""
        for df in tables:
            self._delete(self._paths.pop(id(df))[1])

    def __enter__(self) -> Scratch:
        self._rows = self.spark.conf.get(_ARROW)
        self.spark.conf.set(_ARROW, str(min(ARROW_ROWS, int(self._rows) if int(self._rows) > 0 else ARROW_ROWS)))
        return self

    def __exit__(self, *_) -> None:
        self.spark.conf.set(_ARROW, self._rows)
        self._delete(self.path)

    def _delete(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(self.spark._jsc.sc().hadoopConfiguration()).delete(path, True)


def shards(rows: int, per_shard: int) -> int:
    """Groups that grow with the input, so that each stays of about per_shard rows."""
    return max(1, -(-rows // per_shard))


def fits(rows: int, row_bytes: int) -> bool:
    """Whether that many rows may be broadcast."""
    return rows * row_bytes <= BROADCAST_BYTES


def small_side(df: DataFrame, rows: int, row_bytes: int = 32) -> DataFrame:
    """df, to be broadcast only if its counted rows of row_bytes each are within BROADCAST_BYTES; else Spark shuffles it."""
    return F.broadcast(df) if fits(rows, row_bytes) else df


def lookup(rows: DataFrame, side: DataFrame, key: str, weight: str, n_rows: int, n_side: int | None, row_bytes: int = 32) -> DataFrame:
    """Inner join of rows with side, which has one row a key and in ``weight`` how many of the n_rows have it at most.

    A side that is small goes to every task. Of a larger one, and of one that grows with the input (n_side None), only the heavy keys do (their number is bounded by what
    makes them heavy), so that none of the keys that are shuffled has more rows than a task can take.
    """
    if n_side is not None and fits(n_side, row_bytes):
        return rows.join(F.broadcast(side.drop(weight)), key)
    least = max(LEAST_HEAVY, n_rows // HEAVY_KEYS)
    heavy, light = side.where(F.col(weight) > least).drop(weight), side.where(F.col(weight) <= least).drop(weight)
    rest = rows.join(F.broadcast(heavy.select(key)), key, "left_anti")
    return rows.join(F.broadcast(heavy), key).unionByName(rest.join(light, key))
