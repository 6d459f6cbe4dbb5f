"""The whole pipeline over a table of events: dedup, match, gates, rules, actions, metrics, as one declarative plan."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.fields import Fields, event_fields
from ..model import HIGH_BUDGET, UNLIMITED_ACTIONS, Campaign, Settings
from ..plans.rulecompile import compile_campaign_rules
from ..sources.shared import delete, replace
from . import abtest, actions, campaigns, dedup, gates
from .fold import tasks_for

#: The seven counters, by the rows that they are taken from.
EVENT_COUNTS = ("events_received", "events_processed", "duplicates_filtered")
RULE_COUNTS = ("rules_evaluated", "rules_matched", "actions_triggered", "actions_failed")


def event_counts() -> list[Column]:
    is_new = F.col("dedup_status") == dedup.NEW
    return [c.alias(n) for n, c in zip(EVENT_COUNTS, (F.count(F.lit(1)), F.count_if(is_new), F.count_if(~is_new)), strict=True)]


def rule_counts() -> list[Column]:
    """Triggered counts the actions of triggered rows that can be submitted, failed the others: those without a type or service."""
    whole, sent = F.coalesce(F.size("actions"), F.lit(0)), F.coalesce(F.size(F.filter("actions", actions.submittable)), F.lit(0))
    total = lambda n: F.coalesce(F.sum(F.when(F.col("triggered"), n)), F.lit(0)).cast("long")
    return [c.alias(n) for n, c in zip(RULE_COUNTS, (F.count(F.lit(1)), F.count_if("triggered"), total(sent), total(whole - sent)), strict=True)]


@dataclass(frozen=True)
class Run:
    """events: all rows with dedup_status. evaluated: rows that reached a rule. requests: the actions asked for. counts: counters taken while the stages were written."""

    events: DataFrame
    evaluated: DataFrame
    requests: DataFrame
    new: DataFrame
    counts: dict | None = None

    def metrics(self) -> DataFrame:
        """One row of seven counters. Failed counts requests that can't be submitted."""
        if self.counts is not None:
            return self.events.sparkSession.createDataFrame([tuple(self.counts[n] for n in (*EVENT_COUNTS, *RULE_COUNTS))], ", ".join(f"{n} long" for n in (*EVENT_COUNTS, *RULE_COUNTS)))
        return self.events.agg(*event_counts()).crossJoin(self.evaluated.agg(*rule_counts()))  # one row each


def evaluate(new: DataFrame, own: Sequence[Campaign], fields: Fields | None = None, settings: Settings = Settings(), order: tuple[str, ...] = gates.ORDER) -> DataFrame:
    """Rows of new events and campaigns that pass the gates and reach the rule: with matched, triggered, rule_error, variant.

    Order of the gates: status and time, budget, user limit, rule; the limit counts evaluations, the budget matches.
    """
    table = campaigns.campaign_table(new.sparkSession, own)
    rows = campaigns.match(new, table, len(own), settings.clock)
    return gate(rows, own, fields, settings, order)


def gate(rows: DataFrame, own: Sequence[Campaign], fields: Fields | None = None, settings: Settings = Settings(), order: tuple[str, ...] = gates.ORDER, used: str | None = None) -> DataFrame:
    rows = rows.filter("budget > 0")
    rows = gates.user_limit(rows, order, {c.max_per_user < UNLIMITED_ACTIONS for c in own}, max((c.max_per_user for c in own if c.max_per_user < UNLIMITED_ACTIONS), default=None))
    matched, _, error = compile_campaign_rules({c.id: c.rule for c in own}, fields or event_fields(), settings.on_error)
    rows = rows.withColumn("matched", matched).withColumn("rule_error", error)
    if all(c.budget > HIGH_BUDGET for c in own):  # nothing is drawn down
        rows = rows.withColumn("evaluated", F.lit(True)).withColumn("triggered", F.col("matched"))
    else:
        rows = gates.budget_gate(rows, order=order, used=used, size=len(own), most=max(c.budget for c in own if c.budget <= HIGH_BUDGET)).filter("evaluated")
    return rows.withColumn("variant", variant_by_campaign(own, F.col("user_id").cast("string")))


def variant_by_campaign(own: Sequence[Campaign], user: Column) -> Column:
    """Each row's campaign's variant of the user; campaigns of equal shares are asked once."""
    same: dict[tuple, list[str]] = {}
    for c in own:
        same.setdefault(c.variants, []).append(c.id)
    out = F.lit(None).cast("string")
    for variants, ids in same.items():
        out = F.when(F.col("campaign_id").isin(ids), abtest.variant_of(user, dict(variants))).otherwise(out)
    return out


def written(df: DataFrame, path: str, counts: list[Column] | None = None) -> tuple[DataFrame, dict]:
    """df written to a folder and read back, and the counts that ride along with the writing."""
    seen = Observation()
    (df.observe(seen, *counts) if counts else df).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), seen.get if counts else {}


def settled(events: DataFrame, ttl_ms: int, evaluate_new: Callable[[DataFrame], DataFrame], path: Callable[[str], str], history: DataFrame | None = None) -> tuple[DataFrame, DataFrame, dict]:
    """Marked events, evaluated rows and counts, in which an occurrence is a duplicate by dedup.composed() and dedup.cut().

    Events are dealt and folded by key once. Whether an occurrence fires depends on the gates, and whether a later one of
    its key passes on that: where a key is accepted more than once, evaluation is repeated until the first firings stay.
    A turn moves only rows after a first window, and writes the firings; each settles at least the earliest row that was
    wrong. Where no key returns after its window, one evaluation is enough.
    """
    spark, tasks = events.sparkSession, tasks_for(events)
    marked, counts = written(dedup.composed(events, ttl_ms, history, tasks), path("events"), [*event_counts(), F.count_if(F.col("acceptance") > 1).alias("late")])
    is_new = F.col("dedup_status") == dedup.NEW
    if not counts.pop("late"):
        evaluated, more = written(evaluate_new(marked.filter(is_new)), path("evaluated"), rule_counts())
        return marked, evaluated, counts | more
    mark = [F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*dedup.KEY, "fired_at").cast("decimal(20,0)")).alias("mark")]
    fired, before = written(first_fired(evaluate_new(marked.filter(is_new))), path("fired"), mark)
    while True:
        evaluated, more = written(evaluate_new(dedup.cut(marked, fired, tasks).filter(is_new)), path("evaluated"), rule_counts())
        fired, now = written(first_fired(evaluated), path("fired"), mark)
        if now == before:
            break
        before = now
    _, counts = written(dedup.cut(marked, fired, tasks), path("settled"), event_counts())
    replace(spark, path("settled"), path("events"))
    delete(spark, path("fired"))
    return spark.read.schema(marked.schema).parquet(path("events")), evaluated, counts | more


def first_fired(evaluated: DataFrame) -> DataFrame:
    """KEY, fired_at: each key's first acceptance that fired an action."""
    return fired_by(evaluated).groupBy(*dedup.KEY).agg(F.min("acceptance").alias("fired_at"))


def fired_by(evaluated: DataFrame) -> DataFrame:
    """The evaluated rows that fired an action: triggered ones with an action that can be submitted."""
    return evaluated.filter("triggered").filter(F.exists("actions", actions.submittable))


def run(events: DataFrame, own: Sequence[Campaign], fields: Fields | None = None, settings: Settings = Settings(), store: DataFrame | None = None, order: tuple[str, ...] = gates.ORDER, stage: str | None = None, ttl_ms: int | None = None) -> Run:
    """Events (as model.EVENTS, payload a variant) through everything. Without ttl_ms duplicates never expire within a run.

    stage: a shared folder in which marked events and evaluated rows are written once, where several results are read
    from one run; each result computes them anew else. With ttl_ms (which needs a stage) an event is a duplicate if an
    accepted one of its key lies within that time before it, or if any accepted one before it has fired an action; store
    (KEY, until_ms, fired) is what earlier runs leave.
    """
    if ttl_ms is not None:
        if stage is None:
            raise ValueError("a time to live needs a stage")
        marked, evaluated, counts = settled(events, ttl_ms, lambda new: evaluate(new, own, fields, settings, order), lambda name: f"{stage}/{name}", store)
    elif stage is not None:
        marked, counts = written(dedup.with_status(events, store), f"{stage}/events", event_counts())
        evaluated, more = written(evaluate(marked.filter(F.col("dedup_status") == dedup.NEW), own, fields, settings, order), f"{stage}/evaluated", rule_counts())
        counts |= more
    else:
        marked, counts = dedup.with_status(events, store), None
        evaluated = evaluate(marked.filter(F.col("dedup_status") == dedup.NEW), own, fields, settings, order)
    requests = actions.fan_out(evaluated.filter("triggered"))
    return Run(marked, evaluated, requests, marked.filter(F.col("dedup_status") == dedup.NEW), counts)
