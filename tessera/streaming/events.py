"""Event streams: contiguous ordinals for each job, gaps, and settlement of control requests, with state kept by Spark."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from tessera.plans.checkpoints import shared_folder

SEQUENCED = "job_id long, event_id long, kind string, ordinal long"
_STATE = "next long"


def _sequence(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    (n,) = state.get if state.exists else (0,)
    rows = pd.concat(list(batches)).sort_values(["ts", "event_id"], kind="stable")
    rows = rows.assign(ordinal=range(n, n + len(rows)))
    state.update((n + len(rows),))
    yield rows[["job_id", "event_id", "kind", "ordinal"]]


def sequence(events: DataFrame) -> DataFrame:
    """events (job_id, event_id, ts, kind), streaming: each job's events numbered from 0 without gaps, in order within a batch and after those of earlier batches."""
    return events.groupBy("job_id").applyInPandasWithState(_sequence, SEQUENCED, _STATE, "append", GroupStateTimeout.NoTimeout)


def _settle(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows = pd.concat(list(batches)).sort_values(["ts", "event_id"], kind="stable")
    if not state.exists:
        state.update((rows.iloc[0]["kind"],))
        yield pd.DataFrame({"job_id": [key[0]], "settled": [rows.iloc[0]["kind"]]})


def settle(requests: DataFrame) -> DataFrame:
    """The first control request of a job, once; later ones change nothing."""
    return requests.groupBy("job_id").applyInPandasWithState(_settle, "job_id long, settled string", "settled string", "append", GroupStateTimeout.NoTimeout)


def stream(spark: SparkSession, folder: str, table: str, schema: StructType) -> DataFrame:
    """A table of a folder as a stream of its files."""
    return spark.readStream.schema(schema).parquet(f"{folder}/{table[:-1]}[{table[-1]}].parquet")


def run_once(spark: SparkSession, query: DataFrame) -> DataFrame:
    """All that a streaming query gives for the input of now, as a table in the shared folder."""
    path = f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    running = query.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.schema(query.schema).parquet(f"{path}/rows")


def gaps(sequenced: DataFrame) -> DataFrame:
    """Jobs whose ordinals are not 0 .. n - 1."""
    g = sequenced.groupBy("job_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("ordinal").alias("d"), F.max("ordinal").alias("last"), F.min("ordinal").alias("first"))
    return g.where("n <> d OR first <> 0 OR last <> n - 1")
