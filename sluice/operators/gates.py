"""Per-user limits and budgets, each as a bounded top-n of its key instead of a loop over events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..model import HIGH_BUDGET, UNLIMITED_ACTIONS
from .fold import ordered_fold

ORDER = ("ts", "event_id")
#: Parts that one campaign's matches are dealt over before its budget is cut.
SALTS = 32
#: Campaigns whose cutoffs are broadcast at most; more are joined by shuffle.
BROADCAST_CUTOFFS = 20_000


def user_limit(rows: DataFrame, order: tuple[str, ...] = ORDER, kinds: set[bool] = frozenset((True, False)), most: int | None = None) -> DataFrame:
    """The rows of each campaign and user that its max_per_user lets pass: the first ones.

    Campaigns without a limit go around the window. kinds: whether campaigns with and without a limit can occur.
    most: the largest limit, if known; each task then keeps that many rows of a key before the shuffle, so a user with
    most of the events is no heavier than others.
    """
    if True not in kinds:
        return rows
    limited = F.col("max_per_user") < UNLIMITED_ACTIONS if False in kinds else F.lit(True)
    w = W.Window.partitionBy("campaign_id", "user_id").orderBy(*order)
    ranked = _first(rows.filter(limited), w, most).filter(F.col("_n") <= F.col("max_per_user")).drop("_n")
    return ranked.unionByName(rows.filter(~limited)) if False in kinds else ranked


def _first(rows: DataFrame, w: W.WindowSpec, most: int | None) -> DataFrame:
    """rows with their number _n in the window; of known bound, a constant one, which is taken before the shuffle where it is small."""
    ranked = rows.withColumn("_n", F.row_number().over(w))
    return ranked if most is None else ranked.filter(F.col("_n") <= F.lit(most))


def user_limit_in_window(rows: DataFrame) -> DataFrame:
    """rows with recent: how many of the campaign, user and window lie in the window before each, itself included (an extension).

    A frame's length must be a constant, so time is counted in windows: one frame serves campaigns of any windows. Half
    a millisecond more than the window keeps its bound between two times. Without a window recent is null.
    """
    times = F.unix_millis("ts") / (F.col("user_window_ms") + F.lit(0.5))
    w = W.Window.partitionBy("campaign_id", "user_id", "user_window_ms").orderBy(times).rangeBetween(-1, 0)
    return rows.withColumn("recent", F.when(F.col("user_window_ms").isNotNull(), F.count(F.lit(1)).over(w)))


def user_counts(rows: DataFrame) -> DataFrame:
    """What the counter of each campaign and user shows: passed rows."""
    return rows.groupBy("campaign_id", "user_id").agg(F.least(F.count(F.lit(1)), F.max(F.col("max_per_user").cast("long"))).alias("used"))


def drawn_down(budget: Column) -> Column:
    return budget <= HIGH_BUDGET


def budget_cutoff(rows: DataFrame, matched: str = "matched", order: tuple[str, ...] = ORDER, used: str | None = None, most: int | None = None) -> DataFrame:
    """campaign_id, cutoff: the place in order of the match that spends a campaign's last unit; no row if none does.

    Each of SALTS parts of a campaign keeps its first `budget` matches before they meet, so even a campaign with most
    of the events brings together a bounded number.
    """
    left = F.col("budget") - (F.coalesce(F.col(used), F.lit(0)) if used else 0)
    own = rows.filter(F.col(matched) & drawn_down(F.col("budget"))).select("campaign_id", left.alias("_left"), *order).filter("_left > 0")
    own = own.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(SALTS)))
    part = W.Window.partitionBy("campaign_id", "_salt").orderBy(*order)
    own = _first(own, part, most).filter("_n <= _left")
    whole = W.Window.partitionBy("campaign_id").orderBy(*order)
    return _first(own, whole, most).filter("_n = _left").select("campaign_id", F.struct(*order).alias("cutoff"))


def budget_gate(rows: DataFrame, matched: str = "matched", order: tuple[str, ...] = ORDER, used: str | None = None, size: int | None = None, most: int | None = None) -> DataFrame:
    """rows with evaluated and triggered: the budget still has something before the row, and its rule matches.

    A budget above the high mark is never drawn down; one of nothing evaluates nothing. used names a column with what
    earlier batches have spent. size: campaigns, if known; the cutoffs are a row a campaign at most, and up to
    BROADCAST_CUTOFFS of them are broadcast, so that events needn't meet by campaign. most: the largest budget that is
    drawn down, if known.
    """
    left = F.col("budget") - (F.coalesce(F.col(used), F.lit(0)) if used else 0)
    cut = budget_cutoff(rows, matched, order, used, most)
    has = ~drawn_down(F.col("budget")) | ((left > 0) & (F.col("cutoff").isNull() | (F.struct(*order) <= F.col("cutoff"))))
    small = F.broadcast(cut) if size is not None and size <= BROADCAST_CUTOFFS else cut
    return rows.join(small, "campaign_id", "left").withColumn("evaluated", has).withColumn("triggered", F.col("evaluated") & F.col(matched)).drop("cutoff")


def consume(requests: DataFrame, budgets: DataFrame, order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """requests (campaign_id, amount, ...) with granted, for any amounts in turn.

    An unknown campaign grants nothing; one above the high mark grants all and keeps its budget; others grant what the
    rest still covers, and a refused request, or one without an amount, leaves it as it is. Budgets with the columns of
    order take effect at their place and replace what is left; others hold from the start.
    """
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in requests.schema.fields]
    from_start = not set(order) <= set(budgets.columns)
    given = {"campaign_id": F.col("campaign_id"), **({} if from_start else {c: F.col(c) for c in order})}
    resets = budgets.select(*[given[f.name].cast(f.dataType).alias(f.name) if f.name in given else x for f, x in zip(requests.schema.fields, nothing, strict=True)], F.col("budget").cast("long").alias("_budget"), F.lit(0 if from_start else 1).alias("_turn"))
    rows = requests.select(*requests.columns, F.lit(None).cast("long").alias("_budget"), F.lit(2).alias("_turn")).unionByName(resets)

    def step(left, row):
        amount, budget, turn = row
        if turn < 2:
            return budget, False
        if left is None or amount is None:
            return left, False
        if left > HIGH_BUDGET:
            return left, True
        return (left - amount, True) if left >= amount else (left, False)

    ordered = ["_first", *order, "_turn"]
    out = ordered_fold(rows.withColumn("_first", F.col("_turn") > 0), ["campaign_id"], ordered, lambda: None, step, ["amount", "_budget", "_turn"], "granted boolean", spans=True)
    return out.filter("_turn = 2").select(*requests.columns, "granted")


def remaining(budgets: DataFrame, triggered: DataFrame) -> DataFrame:
    spent = triggered.groupBy("campaign_id").agg(F.count(F.lit(1)).alias("_spent"))
    left = F.when(drawn_down(F.col("budget")), F.greatest(F.col("budget") - F.coalesce("_spent", F.lit(0)), F.lit(0))).otherwise(F.col("budget"))
    return budgets.join(spent, "campaign_id", "left").select("campaign_id", left.alias("remaining"))
