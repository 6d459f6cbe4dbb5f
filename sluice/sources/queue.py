"""A small queue of events as a Spark data source: published to a folder, polled in order, at most so many a batch.

The log holds a JSON object a line, and beside it an index with the place of each line (8 bytes an event), so that a poll
reads its own events and nothing before them. For tests and small feeds: driver and publisher share the folder.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

SCHEMA = "event_id string, event_type string, user_id string, payload string, ts timestamp, source_service string"
#: Events of one poll at most.
POLL = 100


def publish(path: str, events: Iterable[dict]) -> int:
    """Appends events to the queue's log; returns how many it holds now."""
    os.makedirs(path, exist_ok=True)
    with open(f"{path}/log", "ab") as log, open(f"{path}/index", "ab") as index:
        for e in events:
            index.write(log.tell().to_bytes(8, "little"))
            log.write(json.dumps(e | {"ts": e["ts"].isoformat() if hasattr(e.get("ts"), "isoformat") else e.get("ts")}).encode() + b"\n")
    return held(path)


def held(path: str) -> int:
    """How many events the queue holds."""
    return os.path.getsize(f"{path}/index") // 8 if os.path.exists(f"{path}/index") else 0


def committed(path: str) -> int:
    """How many events consumers have finished."""
    try:
        with open(f"{path}/committed", encoding="utf-8") as f:
            return int(f.read())
    except FileNotFoundError:
        return 0


def committed_keys(path: str) -> set[tuple]:
    """The keys (event_id, event_type) of the events that consumers have finished; repeats count once."""
    return {(e.get("event_id"), e.get("event_type")) for e in _events(path, 0, committed(path))}


def _events(path: str, start: int, end: int) -> Iterator[dict]:
    end = min(end, held(path))
    if start >= end:
        return
    with open(f"{path}/index", "rb") as index, open(f"{path}/log", "rb") as log:
        index.seek(8 * start)
        log.seek(int.from_bytes(index.read(8), "little"))
        for _ in range(end - start):
            yield json.loads(log.readline())


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, path: str, most: int):
        self.path, self.most = path, most

    def initialOffset(self) -> dict:
        return {"at": 0}

    def _rows(self, start: int, end: int) -> Iterator[tuple]:
        from datetime import datetime

        for e in _events(self.path, start, end):
            payload = e.get("payload")
            yield (e.get("event_id"), e.get("event_type"), e.get("user_id"), payload if isinstance(payload, str | None) else json.dumps(payload), datetime.fromisoformat(e["ts"]) if e.get("ts") else None, e.get("source_service"))

    def read(self, start: dict):
        rows = list(self._rows(start["at"], start["at"] + self.most))
        return iter(rows), {"at": start["at"] + len(rows)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return self._rows(start["at"], end["at"])

    def commit(self, end: dict) -> None:
        with open(f"{self.path}/committed", "w", encoding="utf-8") as f:
            f.write(str(end["at"]))


class EventQueue(DataSource):
    """format("event_queue") with path, and most for the events of a poll."""

    @classmethod
    def name(cls) -> str:
        return "event_queue"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Reader(self.options["path"], int(self.options.get("most", POLL)))


def read(spark: SparkSession, path: str, most: int = POLL) -> DataFrame:
    """The queue as a stream of events with text payloads."""
    spark.dataSource.register(EventQueue)
    return spark.readStream.format("event_queue").option("path", path).option("most", most).load()
