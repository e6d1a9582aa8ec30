"""Sink of event streams: a folder an epoch, each epoch's events written once however often it is replayed."""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage

from ledgerline.functions.text import sse_event

FORMAT = "event_files"
STAGING = "_staging"


@dataclass
class Staged(WriterCommitMessage):
    """A task's file under the staging folder, and its rows; no name if it had none."""

    name: str | None
    rows: int


class EventFiles(DataSource):
    """Option path: a folder that driver and executors share. The rows' one column, value, is text that is written as it is."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:
        if schema.fieldNames() != ["value"]:
            raise ValueError("event files take one column, value")
        return EpochWriter(self.options["path"].removeprefix("file://"))


class EpochWriter(DataSourceStreamWriter):
    """Tasks write to a staging folder; an epoch's files appear together, by one rename.

    A task that is tried again leaves a file that no message names, and a replayed epoch finds its
    folder there. Both are dropped, so no event doubles and none is seen before its epoch is whole.
    """

    def __init__(self, path: str):
        self.path = path

    def write(self, rows: Iterator[Row]) -> Staged:
        name, n = f"{uuid.uuid4().hex}.txt", 0
        os.makedirs(f"{self.path}/{STAGING}", exist_ok=True)
        with open(f"{self.path}/{STAGING}/{name}", "w", encoding="utf-8", newline="") as f:
            for row in rows:
                f.write(row["value"] or "")
                n += 1
        return Staged(name, n)

    def commit(self, messages: list[Staged | None], batchId: int) -> None:
        final = f"{self.path}/epoch={batchId}"
        whole = f"{self.path}/{STAGING}/epoch-{batchId}-{uuid.uuid4().hex}"
        if not os.path.isdir(final):
            os.makedirs(whole)
            for k, m in enumerate(m for m in messages if m is not None and m.rows):
                os.rename(f"{self.path}/{STAGING}/{m.name}", f"{whole}/part-{k:05d}.txt")
            try:
                os.rename(whole, final)
            except OSError:
                if not os.path.isdir(final):
                    raise
                shutil.rmtree(whole)  # the same epoch was committed meanwhile
        self.abort(messages, batchId)

    def abort(self, messages: list[Staged | None], batchId: int) -> None:
        """Drops what the messages name, where it is still staged."""
        for m in messages:
            if m is not None and m.name is not None and os.path.exists(f"{self.path}/{STAGING}/{m.name}"):
                os.remove(f"{self.path}/{STAGING}/{m.name}")


def write_events(events: DataFrame, path: str, checkpoint: str, event: str = "kind", **options: str):
    """Starts a query that writes a stream of events as event-stream text; (run_id, step, ...) become data, `event` names them.

    The trigger is left to the options (availableNow). Files under path/epoch=N/ are complete once the
    folder is there; a restart replays at most the last epoch, which the writer knows.
    """
    spark = events.sparkSession
    spark.dataSource.register(EventFiles)
    lines = events.select(sse_event(F.col(event), F.to_json(F.struct(*(c for c in events.columns if c != event)))).alias("value"))
    writer = lines.writeStream.format(FORMAT).option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if options.get("trigger") == "availableNow" else writer).start()


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """(epoch, event, data) of all whole epochs under path."""
    rows = spark.read.text(f"{path}/epoch=*", lineSep="\n\n", wholetext=False).select(F.regexp_extract(F.col("_metadata.file_path"), "epoch=([0-9]+)", 1).cast("long").alias("epoch"), "value")
    return rows.select("epoch", F.regexp_extract("value", r"(?m)^event: (.*)$", 1).alias("event"), F.regexp_extract("value", r"(?m)^data: (.*)$", 1).alias("data"))


def staged(path: str) -> list[str]:
    """Names of what failed tasks have left; they may be removed while no query writes."""
    folder = f"{path}/{STAGING}"
    return sorted(os.listdir(folder)) if os.path.isdir(folder) else []
