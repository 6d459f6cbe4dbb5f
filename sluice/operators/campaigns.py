"""Campaigns: the table, matching by event type and time, lifecycle commands, the registry."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import ACTION_TYPES, CAMPAIGNS, TRANSITIONS, Campaign
from .fold import ordered_fold

#: Campaigns that are broadcast to events at most; a larger table is joined by shuffle.
BROADCAST_CAMPAIGNS = 20_000


def campaign_table(spark: SparkSession, campaigns: Iterable[Campaign]) -> DataFrame:
    rows = []
    for c in campaigns:
        if bad := [a.type for a in c.actions if a.type is not None and a.type not in ACTION_TYPES]:
            raise ValueError(f"campaign {c.id} has unknown action types {bad}")
        time = lambda t: datetime.fromisoformat(t) if t else None
        rows.append((c.id, c.trigger, c.status, c.budget, c.currency, c.delay_ms, c.max_per_user, c.user_window_ms, time(c.start), time(c.end), dict(c.variants), [(a.type, a.service, a.params) for a in c.actions], c.budget_epoch))
    return spark.createDataFrame(rows, CAMPAIGNS)


class Registry:
    """Campaigns by id on the driver. What plans read is a snapshot, which later changes don't touch."""

    def __init__(self, campaigns: Iterable[Campaign] = ()):
        self._held: dict[str, Campaign] = {}
        self.reload(campaigns)

    def register(self, campaign: Campaign) -> None:
        """Adds a campaign, or replaces the one of its id."""
        self._held = {**self._held, campaign.id: campaign}

    def replace_budget(self, campaign_id: str, budget: int) -> None:
        """Gives a campaign a new budget, of which nothing is spent yet."""
        from dataclasses import replace

        old = self.get(campaign_id)
        self.register(replace(old, budget=budget, budget_epoch=old.budget_epoch + 1))

    def reload(self, campaigns: Iterable[Campaign]) -> None:
        """Replaces all campaigns; of several with one id the last stays."""
        self._held = {c.id: c for c in campaigns}

    def get(self, campaign_id: str) -> Campaign:
        if campaign_id not in self._held:
            raise KeyError(f"no campaign {campaign_id}")
        return self._held[campaign_id]

    def active(self) -> tuple[Campaign, ...]:
        return tuple(c for c in self._held.values() if c.status == "ACTIVE")

    def snapshot(self) -> tuple[Campaign, ...]:
        return tuple(self._held.values())

    def __len__(self) -> int:
        return len(self._held)


def active_index(campaigns: DataFrame) -> DataFrame:
    """What events are looked up in: the active campaigns."""
    return campaigns.filter(F.col("status") == "ACTIVE")


def _sided(campaigns: DataFrame, size: int | None) -> DataFrame:
    return F.broadcast(campaigns) if size is not None and size <= BROADCAST_CAMPAIGNS else campaigns


def in_window(clock: Column) -> Column:
    """Whether a campaign runs at this time; open where it has no bound."""
    return (F.col("start_ts").isNull() | (clock >= F.col("start_ts"))) & (F.col("end_ts").isNull() | (clock <= F.col("end_ts")))


def match(events: DataFrame, campaigns: DataFrame, size: int | None = None, clock: str = "event") -> DataFrame:
    """A row for each event and active campaign that its type triggers and that runs at the time. size: campaigns, if known."""
    now = F.col("ts") if clock == "event" else F.current_timestamp()
    index = _sided(active_index(campaigns), size)
    return events.join(index, (events["event_type"] == index["trigger"]) & in_window(now), "inner")


def unmatched(events: DataFrame, campaigns: DataFrame, size: int | None = None) -> DataFrame:
    """Events whose type triggers no active campaign."""
    index = _sided(active_index(campaigns).select("trigger").distinct(), size)
    return events.join(index, events["event_type"] == index["trigger"], "left_anti")


def by_trigger(campaigns: DataFrame) -> DataFrame:
    return active_index(campaigns).groupBy("trigger").agg(F.sort_array(F.collect_list("campaign_id")).alias("campaign_ids"), F.count(F.lit(1)).alias("n"))


def is_legal(source: Column, target: Column) -> Column:
    out = F.lit(False)
    for s, targets in TRANSITIONS.items():
        for t in targets:
            out = out | ((source == s) & (target == t))
    return out


def replay(commands: DataFrame) -> DataFrame:
    """commands (campaign_id, seq, to_status) with applied and status: each campaign starts as a draft; an illegal command changes nothing."""

    def step(status, row):
        return (row[0], ["yes", row[0]]) if row[0] in TRANSITIONS.get(status, ()) else (status, ["no", status])

    out = ordered_fold(commands, ["campaign_id"], ["seq"], lambda: "DRAFT", step, ["to_status"], "outcome array<string>", spans=True)
    return out.select(*commands.columns, (F.col("outcome")[0] == "yes").alias("applied"), F.col("outcome")[1].alias("status"))


def latest(versions: DataFrame, key: str = "campaign_id", version: str = "version") -> DataFrame:
    """The last version of each; of a repeated registration the newest wins."""
    rest = [c for c in versions.columns if c not in (key,)]
    return versions.groupBy(key).agg(F.max_by(F.struct(*rest), version).alias("s")).select(key, "s.*")


def create(existing: DataFrame, drafts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drafts whose id is free, and those whose id is taken, by an existing campaign or an earlier draft."""
    from pyspark.sql import Window

    first = drafts.withColumn("_n", F.row_number().over(Window.partitionBy("campaign_id").orderBy("seq")))
    taken = existing.select("campaign_id").distinct().withColumn("_taken", F.lit(True))
    marked = first.join(taken, "campaign_id", "left")
    free = (F.col("_n") == 1) & F.col("_taken").isNull()
    return marked.filter(free).drop("_n", "_taken").withColumn("status", F.lit("DRAFT")), marked.filter(~free).drop("_n", "_taken")
