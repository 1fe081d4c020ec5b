"""Structured Streaming jobs. A query over them runs what is there now (available-now trigger) and gives the result as a frame."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from lorebase.operators.orphans import OrphanTracker
from lorebase.session import Scratch


def stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table as a file stream: the files of its folder, or the one file that it is."""
    path = f"{folder}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts per window and key with a watermark for late rows."""
    t = events.withWatermark(time, late)
    return t.groupBy(F.window(time, width), key).agg(F.count("*").alias("n"))


def dedupe_arrivals(rows: DataFrame, keys: list[str], time: str, within: str = "30 days") -> DataFrame:
    """Repeated arrivals within a time dropped as they come."""
    return rows.withWatermark(time, within).dropDuplicatesWithinWatermark(keys)


def run_to_table(df: DataFrame, scratch: Scratch, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there into a folder of the shared scratch and reads it back."""
    out = f"{scratch.root}/{name}"
    q = df.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(out)


def run_updates(df: DataFrame, keys: list[str], scratch: Scratch, name: str) -> DataFrame:
    """Runs a stream of updates and gives the last one of each key: a micro-batch replaces the rows of its own keys."""
    last = []

    def each(batch: DataFrame, n: int) -> None:
        batch = scratch.keep(batch)
        last.append(batch if not last else scratch.keep(last[-1].join(batch.select(*keys), keys, "left_anti").unionByName(batch)))

    q = df.writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", f"{scratch.root}/{name}-state").trigger(availableNow=True).start()
    q.awaitTermination()
    return last[-1] if last else df.sparkSession.createDataFrame([], df.schema)


def run_batches(df: DataFrame, checkpoint: str, each) -> None:
    """Runs a stream over what is there and hands each micro-batch to ``each(frame, batch_no)``."""
    q = df.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def run_batches_complete(df: DataFrame, scratch: Scratch, name: str, each) -> None:
    """As run_batches, with the whole result of an aggregation each time."""
    q = df.writeStream.outputMode("complete").foreachBatch(each).option("checkpointLocation", f"{scratch.root}/{name}-state").trigger(availableNow=True).start()
    q.awaitTermination()


def bind_first(rows: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """(key, value, n): keyed state over a stream: the first value of a key binds it, n counts the rows that kept to it. Rows of another value are dropped.

    One row per key of each micro-batch that touches it. The state of a key is its value and a count, however many rows it has.
    """

    def step(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        bound, n = state.get if state.exists else (None, 0)
        # the frames of one key come in no order; only the first row in order and counts per value are kept of them
        first, counts = None, {}
        for pdf in frames:
            good = pdf.dropna(subset=[value])
            if len(good):
                row = good.sort_values(order).iloc[0]
                at = tuple(row[c] for c in order)
                if first is None or at < first[0]:
                    first = (at, row[value])
                for v, c in good[value].value_counts().items():
                    counts[v] = counts.get(v, 0) + int(c)
        if bound is None and first:
            bound = first[1]
        if bound is not None:
            n += counts.get(bound, 0)
            state.update((bound, n))
            yield pd.DataFrame({key: [k[0]], value: [bound], "n": [n]})

    kind = dict(rows.dtypes)[key]
    out = f"{key} {kind}, {value} string, n long"
    return rows.filter(f"{key} is not null").groupBy(key).applyInPandasWithState(step, out, f"{value} string, n long", "update", GroupStateTimeout.NoTimeout)


def track_orphans(spark: SparkSession, memories: DataFrame, others: dict[str, DataFrame], folder: str) -> OrphanTracker:
    """The orphan state after a stream of memories; the other tables come with the first batch.

    State and checkpoint are in ``folder``: a stream that is started on it again goes on behind the last batch, and a micro-batch that is replayed counts once.
    """
    tracker = OrphanTracker(spark, f"{folder}/state")

    def each(batch: DataFrame, n: int) -> None:
        tracker.advance({"memories": batch} | (others if tracker.n == 0 else {}), n + 1)

    run_batches(memories, f"{folder}/checkpoint", each)
    return tracker
