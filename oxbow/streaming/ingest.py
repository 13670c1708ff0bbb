"""Resumable ingestion of archives as a stream, and stateful rules over events.

The stream's offset log is the durable checkpoint, an entry the atomic unit; a
restarted query goes on after the last committed batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from oxbow.functions.names import Registry
from oxbow.sources.containers import read_entries

#: Columns of a stream of files.
FILES = "path string, modificationTime timestamp, length long, content binary"


def archive_stream(spark: SparkSession, folder: str, files_per_batch: int = 64, clean: str = "off") -> DataFrame:
    """source_id, container, content of archives as they come to a folder; ``clean`` may delete or archive them."""
    r = Registry()
    files = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", files_per_batch).option("cleanSource", clean).load(folder)
    return files.select(F.col("path").alias("source_id"), r.resolve(F.col("path"), F.substring("content", 1, r.window()))["format"].alias("container"), "content")


def ingest(blobs: DataFrame, target: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Write the entries of a stream of archives to Parquet, exactly once."""
    w = read_entries(blobs, content=True).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def latency_ema_stream(events: DataFrame) -> DataFrame:
    """Running latency averages per mirror over a stream (mirror, at_us, seq, latency_ns): the
    batch rule of ``latency_ema``, its average kept as state between batches."""

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ema = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["at_us", "seq"])
        for x in rows["latency_ns"].tolist():
            ema = x if ema is None else ema // 8 * 7 + x // 8
        state.update((ema,))
        yield pd.DataFrame({"mirror": [key[0]], "ema_ns": [ema]})

    return events.groupBy("mirror").applyInPandasWithState(fold, "mirror long, ema_ns long", "ema long", "update", GroupStateTimeout.NoTimeout)


def token_bucket(requests: DataFrame, rate: int, burst_seconds: float = 0.25, least: int = 1 << 20) -> DataFrame:
    """Grants of a token bucket to ``requests`` (key, at_us, bytes) in order of time, as in a rate-limited run.

    The bucket holds the larger of ``least`` and a quarter second of the rate; a
    request gets what is there.
    """
    capacity = max(least, int(rate * burst_seconds))

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held, last = None, float(capacity), 0
        for frame in frames:
            granted = []
            for k, at, want in zip(frame["key"], frame["at_us"], frame["bytes"]):
                if k != key:
                    key, held, last = k, float(capacity), at
                held = min(capacity, held + (at - last) * rate / 1e6)
                last = at
                got = min(want, int(held))
                held -= got
                granted.append(got)
            yield frame.assign(granted=granted)

    ordered = requests.select("key", "at_us", "bytes").repartition("key").sortWithinPartitions("key", "at_us")
    kind = requests.schema["key"].dataType.simpleString()
    return ordered.mapInPandas(fold, f"key {kind}, at_us long, bytes long, granted long")
