"""The event log on shared storage: rising ids, and each batch of events once.

Below the log's folder, ``_ranges`` holds one small file for each reserved range
of ids, named by its number in order; creating the next number is what decides
between writers. ``_batches`` holds what was reserved for each (writer, batch),
and ``batch=...`` its rows.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.shared import Folder, kept
from .events import SCHEMA, log_rows


def reserve(spark: SparkSession, path: str, count: int) -> int:
    """The first of ``count`` ids above all that were ever reserved; any number of writers may ask at once.

    Whoever makes the file of the next number has the range; others look again.
    Files but the last may be deleted.
    """
    ranges = Folder(spark, f"{path}/_ranges")
    while True:
        names = ranges.names()
        first = json.loads(ranges.read(names[-1]))["end"] if names else 1
        if ranges.create(f"{int(names[-1]) + 1 if names else 0:020d}", json.dumps({"end": first + count})):
            return first


def append(events: DataFrame, path: str, writer: str, batch: int | str, now: int) -> DataFrame:
    """Append events (operation_id, seq, event columns) to the log; returns the rows of this batch.

    A batch that is appended again, by a retry or after a crash, takes the ids
    and the time that were first reserved for it and replaces its own rows, so
    its events are there once. Ids rise from batch to batch; a crash between
    reserving and writing leaves a gap, never a repeat.
    """
    spark = events.sparkSession
    key = re.sub("[^A-Za-z0-9._-]", lambda m: f"%{ord(m[0]):x}", f"{writer}-{batch}")
    batches = Folder(spark, f"{path}/_batches")
    held = kept(events)
    if (noted := batches.read(key)) is None:
        first = reserve(spark, path, held.count())
        batches.create(key, json.dumps({"first": first, "now": now}))
        noted = batches.read(key)
    place = json.loads(noted)
    log_rows(held, place["now"], place["first"]).write.mode("overwrite").parquet(f"{path}/batch={key}")
    return spark.read.schema(SCHEMA).parquet(f"{path}/batch={key}")


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path).select(*[c.split(" ")[0] for c in SCHEMA.split(", ")])


def write_events(events: DataFrame, path: str, checkpoint: str, writer: str = "stream", now: Callable[[], int] | None = None, once: bool = False) -> StreamingQuery:
    """Start a stream of audit events into the log at ``path``; ``writer`` names the query in the log.

    The batch's number and ``writer`` are its place in the log, so a batch that
    runs again after a crash keeps its ids, its time and its rows. ``once`` stops
    when all that is there has been written.
    """
    clock = now or (lambda: int(time.time()))
    sink = events.writeStream.foreachBatch(lambda batch, number: append(batch, path, writer, number, clock()) and None).option("checkpointLocation", checkpoint)
    return (sink.trigger(availableNow=True) if once else sink).start()
