"""The pipeline over streams: dedup in state, gates with what earlier batches have used, dispatch, start and stop."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.fields import Fields
from ..model import UNLIMITED_ACTIONS, Campaign, Settings
from ..operators import actions, campaigns, dedup, gates, pipeline, schedule
from ..sources.shared import delete
from .log import Log


def deduplicated(events: DataFrame, ttl: str = "24 hours") -> DataFrame:
    """A stream of first occurrences: a key is remembered until the watermark passes its expiry, which repeats don't extend."""
    return events.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(dedup.KEY)


def windowed_counts(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events of each type by tumbling window (an extension: the pipeline itself reads no event time)."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length), "event_type").agg(F.count(F.lit(1)).alias("n"))


def _summed(keys: list[str], name: str) -> Callable[[DataFrame], DataFrame]:
    return lambda rows: rows.groupBy(*keys).agg(F.sum(name).alias(name))


@dataclass
class Engine:
    """A streaming pipeline: each batch runs the batch plan, starting from what the batches before have used.

    State is a log a table (seen keys, uses of each campaign and user, spent budgets, delayed requests, counters): a batch
    adds its own rows and reads the log's segments, which are merged as they age. Keys expire dedup_ttl_ms after they were
    accepted, unless they fired an action. A merge drops a key when a further dedup_ttl_ms has passed, so events may come
    that much out of order. A batch that is run again overwrites its own rows and gives the same results.

    Requests take tokens in their order, wait for their delay, and go to the client, at most max_retries + 1 times;
    without a client each is answered OK.
    """

    spark: SparkSession
    registry: campaigns.Registry
    path: str
    fields: Fields
    settings: Settings = field(default_factory=Settings)
    client: object = None
    query: object = None
    order: tuple[str, ...] = gates.ORDER

    def __post_init__(self):
        self.rebuild()
        log = lambda name, merge, options=None: Log(self.spark, f"{self.path}/state/{name}", merge, options)
        bloom = {"parquet.bloom.filter.enabled#event_id": "true", "parquet.bloom.filter.expected.ndv#event_id": str(self.settings.bloom_insertions), "parquet.bloom.filter.fpp#event_id": str(self.settings.bloom_fpr)}
        self._now = None
        self.logs = {
            "seen": log("seen", self._still_held, bloom), "used": log("used", _summed(["campaign_id", "user_id"], "n_used")), "spent": log("spent", _summed(["campaign_id", "budget_epoch"], "n_spent")),
            "delayed": log("delayed", lambda rows: rows.filter(F.col("deadline_ms") > self._now)), "counts": log("counts", lambda rows: rows.agg(*[F.sum(c).alias(c) for c in rows.columns])),
        }

    def _still_held(self, rows: DataFrame) -> DataFrame:
        held = rows.groupBy(*dedup.KEY).agg(F.max("until_ms").alias("until_ms"), F.bool_or("fired").alias("fired"))
        return held.filter(F.col("fired") | (F.col("until_ms") + self.settings.dedup_ttl_ms >= self._now))

    def rebuild(self) -> None:
        """Takes the registry's campaigns as they are now, from the next batch on."""
        self.campaigns = self.registry.snapshot()
        self.table = campaigns.campaign_table(self.spark, self.campaigns)

    def start(self, events: DataFrame, once: bool = False):
        writer = events.writeStream.foreachBatch(self.process).option("checkpointLocation", f"{self.path}/checkpoint")
        self.query = (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="100 milliseconds")).start()
        return self

    def stop(self) -> None:
        if self.query is not None:
            self.query.stop()

    def is_running(self) -> bool:
        return self.query is not None and self.query.isActive

    def wait(self) -> None:
        self.query.awaitTermination()

    def _place(self, name: str, n: int | str) -> str:
        return f"{self.path}/{name}/v={n}"

    def _put(self, df: DataFrame, name: str, n: int | str) -> DataFrame:
        return pipeline.written(df, self._place(name, n))[0]

    def _row(self, **values: int) -> DataFrame:
        return self.spark.range(0, 1, 1, 1).select(*[F.lit(v).cast("long").alias(c) for c, v in values.items()])

    def _passed(self, rows: DataFrame, n: int) -> DataFrame:
        """Rows that reach a rule: earlier evaluations count against the limit, earlier matches against the budget."""
        used, spent = self.logs["used"].read(n), self.logs["spent"].read(n)
        if used is None:
            return rows.withColumn("_spent", F.lit(0).cast("long"))
        limited = {c.max_per_user < UNLIMITED_ACTIONS for c in self.campaigns}
        if True in limited:  # else no limit needs what was used
            rows = rows.join(used.groupBy("campaign_id", "user_id").agg(F.sum("n_used").alias("n_used")), ["campaign_id", "user_id"], "left")
            rows = rows.withColumn("max_per_user", F.when(F.col("max_per_user") < F.lit(UNLIMITED_ACTIONS), F.col("max_per_user") - F.coalesce("n_used", F.lit(0))).otherwise(F.col("max_per_user")).cast("int")).drop("n_used")
        total = spent.groupBy("campaign_id", "budget_epoch").agg(F.sum("n_spent").alias("n_spent"))
        small = F.broadcast(total) if len(self.campaigns) <= campaigns.BROADCAST_CAMPAIGNS and self._epochs() <= campaigns.BROADCAST_CAMPAIGNS else total
        rows = rows.join(small, ["campaign_id", "budget_epoch"], "left").withColumn("_spent", F.coalesce("n_spent", F.lit(0))).drop("n_spent")
        return rows.filter(~gates.drawn_down(F.col("budget")) | (F.col("_spent") < F.col("budget")))

    def _epochs(self) -> int:
        """How many rows the table of spent budgets has at most: campaigns and replaced budgets."""
        return sum(1 + c.budget_epoch for c in self.campaigns)

    def _seen(self, batch: DataFrame, n: int) -> DataFrame | None:
        """What is known of the batch's keys; looked up by broadcast where they are no more than the cache holds, so that the log isn't shuffled."""
        seen = self.logs["seen"].read(n)
        if seen is None:
            return None
        keys = batch.select(*dedup.KEY).distinct()
        few = keys.limit(self.settings.cache_size + 1).count() <= min(self.settings.cache_size, 1_000_000)
        return seen.join(F.broadcast(keys), dedup.KEY, "left_semi") if few else seen

    def process(self, batch: DataFrame, n: int) -> None:
        """One micro-batch: marks duplicates, gates, evaluates, fans out, dispatches, and adds to the state."""
        for log in self.logs.values():
            log.begin(n)
        if n > 1:
            sent = [f"attempts/{k}" for k in range(self.settings.retry.max_retries + 1)] if self.client is not None else []
            delete(self.spark, *[self._place(name, n - 2) for name in ("clock", "levels", "acquired", *sent)])
        batch = batch.persist()
        before = self.spark.read.parquet(self._place("clock", n - 1)).first()["ms"] if n else -(2**62)
        last = batch.agg(F.max(F.unix_millis("ts"))).first()[0] if self.settings.clock == "event" else int(time.time() * 1000)
        self._now = before if last is None else max(before, last)
        own, table = self.campaigns, self.table

        def evaluate(new: DataFrame) -> DataFrame:
            rows = self._passed(campaigns.match(new, table, len(own), self.settings.clock), n)
            return pipeline.gate(rows, own, self.fields, self.settings, self.order, used="_spent").drop("payload")

        _, done, counts = pipeline.settled(batch, self.settings.dedup_ttl_ms, evaluate, lambda name: self._place(name, n), self._seen(batch, n))
        batch.unpersist()
        requests = self._put(actions.fan_out(done.filter("triggered")), "requests", n)
        self._dispatch(requests, n, before)
        marked = self.spark.read.parquet(self._place("events", n))
        fired = pipeline.fired_by(done).select(*dedup.KEY).distinct().withColumn("fired", F.lit(True))
        new = marked.filter(F.col("dedup_status") == dedup.NEW).groupBy(*dedup.KEY).agg((F.max(F.unix_millis("ts")) + self.settings.dedup_ttl_ms).alias("until_ms"))
        self.logs["seen"].add(new.join(fired, dedup.KEY, "left").select(*dedup.KEY, "until_ms", F.coalesce("fired", F.lit(False)).alias("fired")), n)
        self.logs["used"].add(done.groupBy("campaign_id", "user_id").agg(F.count(F.lit(1)).alias("n_used")), n)
        self.logs["spent"].add(done.groupBy("campaign_id", "budget_epoch").agg(F.count_if("triggered").alias("n_spent")), n)
        self.logs["counts"].add(self._row(**counts), n)
        self._put(self._row(ms=self._now), "clock", n)

    def _dispatch(self, requests: DataFrame, n: int, before: int) -> None:
        """Answers to the batch's requests and to earlier ones whose delay ends."""
        wrong = actions.problem(F.col("action_type"), F.col("service"))
        levels = self.spark.read.parquet(self._place("levels", n - 1)) if n else None
        own = self._put(actions.acquire(requests.filter(wrong.isNull()), dict(self.settings.rates), levels=levels), "acquired", n)
        self._put(actions.levels_after(own, levels), "levels", n)
        allowed = own.filter("allowed").drop("allowed", "tries", "tokens", "us")
        later = schedule.schedule(allowed.filter("delay_ms > 0"))
        held = self.logs["delayed"].read(n)
        due = later.filter(F.col("deadline_ms") <= self._now)
        if held is not None:
            due = due.unionByName(held.filter((F.col("deadline_ms") > before) & (F.col("deadline_ms") <= self._now)).select(due.columns))
        sent = self._sent(allowed.filter("delay_ms <= 0").unionByName(due.drop("deadline_ms")), n)
        answer = lambda rows, ok, text: rows.select("request_id", "service", F.lit(ok).alias("succeeded"), text.alias("response"), F.lit(0).alias("retry_count"))
        out = answer(requests.filter(wrong.isNotNull()), False, wrong).unionByName(answer(own.filter("NOT allowed"), False, F.lit(actions.RATE_LIMITED))).unionByName(answer(later, True, F.lit(actions.SCHEDULED)))
        self._put(out.unionByName(sent), "results", n)
        self.logs["delayed"].add(later, n)

    def _sent(self, requests: DataFrame, n: int) -> DataFrame:
        """The client's answers: what fails is sent again after a wait, as often as the settings say; an exception is an answer too."""
        columns = ["request_id", "service", "succeeded", "response", "retry_count"]
        if self.client is None:
            return requests.select("request_id", "service", F.lit(True).alias("succeeded"), F.lit(actions.OK).alias("response"), F.lit(0).alias("retry_count"))
        retry, out, todo = self.settings.retry, None, requests
        for attempt in range(retry.max_retries + 1):
            try:
                said = self.client.execute(todo, n * (retry.max_retries + 1) + attempt).select("request_id", "succeeded", "response")
            except Exception as e:  # noqa: BLE001  whatever a client raises
                said = todo.select("request_id", F.lit(False).alias("succeeded"), F.lit(f"DISPATCH_ERROR: {e}").alias("response"))
            said = self._put(todo.select("request_id", "service").join(said, "request_id").withColumn("retry_count", F.lit(attempt)), f"attempts/{attempt}", n)
            failed = said.filter("NOT succeeded")
            over = attempt == retry.max_retries or failed.isEmpty()
            mine = (said if over else said.filter("succeeded")).select(columns)
            out = mine if out is None else out.unionByName(mine)
            if over:
                return out
            time.sleep(retry.initial_ms * retry.multiplier**attempt / 1000)
            todo = requests.join(failed.select("request_id"), "request_id", "left_semi")

    def results(self, name: str) -> DataFrame:
        """All batches of events, evaluated, requests or results."""
        return self.spark.read.option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}").drop("v")

    def dispatched(self) -> DataFrame:
        """Counters of dispatch, over all results."""
        return actions.dispatch_counts(self.results("results"))

    def metrics(self) -> DataFrame:
        """One row of the pipeline's seven counters, which ride along with each batch."""
        n = self.batches()
        names = (*pipeline.EVENT_COUNTS, *pipeline.RULE_COUNTS)
        rows = self.logs["counts"].read(n) if n else self._row(**dict.fromkeys(names, 0))
        return rows.agg(*[F.sum(c).alias(c) for c in names])

    def batches(self) -> int:
        """How many batches are done: one more than the last with a clock."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/clock")
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return max((int(s.getPath().getName()[2:]) + 1 for s in fs.listStatus(path)), default=0) if fs.exists(path) else 0


class Coordinator:
    """A query for each of several streams, started and stopped together; counts the events that they have read.

    process(batch, number) of each stream must read the batch it is given.
    """

    def __init__(self, streams: Sequence[tuple[DataFrame, Callable[[DataFrame, int], None]]], path: str):
        self.streams, self.path, self.queries = list(streams), path, []
        self.counts: list[dict[int, int]] = [{} for _ in self.streams]

    def start(self, once: bool = False) -> Coordinator:
        for i, (stream, process) in enumerate(self.streams):

            def run(batch: DataFrame, n: int, i=i, process=process) -> None:
                seen = Observation()
                process(batch.observe(seen, F.count(F.lit(1)).alias("n")), n)
                self.counts[i][n] = seen.get["n"]

            writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", f"{self.path}/{i}")
            self.queries.append((writer.trigger(availableNow=True) if once else writer).start())
        return self

    def stop(self) -> None:
        for q in self.queries:
            q.stop()

    def wait(self) -> None:
        for q in self.queries:
            q.awaitTermination()

    def is_running(self) -> bool:
        return any(q.isActive for q in self.queries)

    def events_consumed(self) -> int:
        return sum(sum(c.values()) for c in self.counts)


class Builder:
    """Fluent settings of an engine."""

    def __init__(self, spark: SparkSession):
        self._spark, self._settings, self._campaigns, self._fields, self._path, self._client = spark, Settings(), campaigns.Registry(), None, None, None

    @staticmethod
    def defaults(spark: SparkSession) -> Builder:
        out = Builder(spark)
        out._settings = Settings.small()
        return out

    def _with(self, **changes) -> Builder:
        self._settings = replace(self._settings, **changes)
        return self

    def bloom(self, insertions: int, rate: float) -> Builder:
        """The Bloom filters of the files that hold seen keys."""
        return self._with(bloom_insertions=insertions, bloom_fpr=rate)

    def cache(self, size: int, ttl_ms: int) -> Builder:
        """How many keys of a batch are looked up by broadcast at most, and how long a key is a duplicate."""
        return self._with(cache_size=size, dedup_ttl_ms=ttl_ms)

    def rates(self, rates: dict) -> Builder:
        return self._with(rates=tuple(rates.items()))

    def retry(self, retry) -> Builder:
        return self._with(retry=retry)

    def clock(self, clock: str) -> Builder:
        return self._with(clock=clock)

    def on_error(self, policy: str) -> Builder:
        return self._with(on_error=policy)

    def campaigns(self, own: Sequence[Campaign] | campaigns.Registry) -> Builder:
        """Campaigns, or a registry of them that may change while the engine runs."""
        self._campaigns = own if isinstance(own, campaigns.Registry) else campaigns.Registry(own)
        return self

    def client(self, client) -> Builder:
        """What requests are sent to: execute(requests, batch) gives request_id, succeeded and response."""
        self._client = client
        return self

    def fields(self, fields: Fields) -> Builder:
        self._fields = fields
        return self

    def state(self, path: str) -> Builder:
        self._path = path
        return self

    def build(self) -> Engine:
        from ..functions.fields import event_fields

        if self._path is None:
            raise ValueError("an engine needs a shared path for its state")
        return Engine(self._spark, self._campaigns, self._path, self._fields or event_fields(), self._settings, self._client)
