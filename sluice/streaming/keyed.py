"""State by key with timers: token buckets and delayed actions over streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..model import Rate

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Bucket(StatefulProcessor):
    """A service's tokens and the time of its last refill."""

    def __init__(self, rates: dict[str, Rate], default: Rate):
        self.rates, self.default = rates, default

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "tokens double, us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        rate = self.rates.get(key[0], self.default)
        state = self.held.get() if self.held.exists() else None
        out = []
        # a batch's rows of one key in order of time; batches follow each other
        frame = pd.concat(list(rows)).sort_values(["us", "request_id"], kind="stable")
        for request, us in zip(frame["request_id"], frame["us"].tolist(), strict=True):
            tokens, last = (float(rate.capacity), us) if state is None else state
            if us > last:
                tokens, last = min(float(rate.capacity), tokens + (us - last) / 1e6 * rate.refill_per_second), us
            ok = tokens >= 1
            state = (tokens - 1 if ok else tokens, last)
            out.append((key[0], request, ok))
        self.held.update(state)
        yield pd.DataFrame(out, columns=["service", "request_id", "allowed"])

    def close(self) -> None:
        pass


def rate_limited(requests: DataFrame, rates: dict[str, Rate], default: Rate = Rate()) -> DataFrame:
    """service, request_id, allowed of a stream (or table) of requests (service, request_id, created_at)."""
    rows = requests.select("service", F.col("request_id").cast("string").alias("request_id"), F.unix_micros("created_at").alias("us"))
    return rows.groupBy("service").transformWithStateInPandas(_Bucket(rates, default), "service string, request_id string, allowed boolean", "Append", "None")


class _Delay(StatefulProcessor):
    """What a key has scheduled: a list of ids and deadlines; its timers are the deadlines."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tasks = handle.getMapState("tasks", "id string", "deadline_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fired = []
        for frame in rows:
            for task, deadline, delay in zip(frame["id"], frame["deadline_ms"], frame["delay_ms"], strict=True):
                if delay > 0:
                    self.tasks.updateValue((task,), (int(deadline),))
                    self.handle.registerTimer(int(deadline))
                else:
                    fired.append((key[0], task, int(deadline)))
        yield pd.DataFrame(fired, columns=["key", "id", "fired_ms"]).astype({"fired_ms": "int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        due = [(key[0], task[0], int(deadline[0])) for task, deadline in self.tasks.iterator() if deadline[0] <= now]
        for _, task, _ in due:
            self.tasks.removeKey((task,))
        yield pd.DataFrame(due, columns=["key", "id", "fired_ms"]).astype({"fired_ms": "int64"})

    def close(self) -> None:
        pass


def delayed(requests: DataFrame, late: str = "1 second") -> DataFrame:
    """key, id, fired_ms of a stream of requests (key, id, ts, delay_ms): at once without a delay, else when the watermark reaches ts + delay.

    What is scheduled past the last watermark of a stream that ends stays in the state.
    """
    rows = requests.withWatermark("ts", late).select("key", "id", "ts", (F.unix_millis("ts") + F.coalesce("delay_ms", F.lit(0))).alias("deadline_ms"), F.coalesce("delay_ms", F.lit(0)).alias("delay_ms"))
    return rows.groupBy("key").transformWithStateInPandas(_Delay(), "key string, id string, fired_ms long", "Append", "EventTime")
