"""Actions: fan-out, validation, rate limits, delays, dispatch with retries."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import ACTION_TYPES, Rate, Retry
from .fold import ordered_fold

INVALID_TYPE, INVALID_SERVICE = "INVALID: missing action type", "INVALID: missing target service"
RATE_LIMITED, SCHEDULED, OK = "RATE_LIMITED", "SCHEDULED", "OK"
#: Tries for a token before a dispatch gives up, and the wait between them.
TOKEN_TRIES, TOKEN_WAIT_MS = 3, 50


def fan_out(matched: DataFrame) -> DataFrame:
    """A request for each matched campaign's action. Its id follows from the event, so a replay makes the same one."""
    rows = matched.select("event_id", "event_type", "user_id", "ts", "campaign_id", "delay_ms", F.posexplode("actions").alias("ordinal", "a"))
    request_id = F.sha2(F.concat_ws("|", F.col("event_id").cast("string"), "event_type", "campaign_id", F.col("ordinal").cast("string")), 256)
    return rows.select(
        request_id.alias("request_id"), "event_id", "user_id", "campaign_id", "ordinal", F.col("a.action_type").alias("action_type"),
        F.col("a.service").alias("service"), F.col("a.params").alias("params"), F.coalesce("delay_ms", F.lit(0)).alias("delay_ms"), F.coalesce("ts", F.current_timestamp()).alias("created_at"),
    )


def problem(action_type: Column, service: Column) -> Column:
    """Why a request is invalid; null if it isn't."""
    return F.when(action_type.isNull() | ~action_type.isin(*ACTION_TYPES), INVALID_TYPE).when(service.isNull() | service.rlike(r"^\s*$"), INVALID_SERVICE)


def submittable(action: Column) -> Column:
    """Whether an action of a campaign can be submitted: it has a type and a service."""
    return problem(action["action_type"], action["service"]).isNull()


def rate_limited(requests: DataFrame, rates: Mapping[str, Rate], time: str = "created_at", order: tuple[str, ...] = ("created_at", "request_id"), default: Rate = Rate(), tokens: int = 1) -> DataFrame:
    """requests with allowed and tokens_left: each service's bucket starts full, refills by the time passed and gives `tokens` a request.

    Time that runs backwards refills nothing. A service's requests pass in order, one at a time in bounded memory; those
    of a service with very many are folded in spans one after another.
    """

    def step(state, row):
        service, us = row
        rate = rates.get(service, default)
        held, last = state if state is not None else (float(rate.capacity), us)
        if us is not None and last is None:
            last = us
        if us is not None and us > last:
            held, last = min(rate.capacity, held + (us - last) / 1e6 * rate.refill_per_second), us
        ok = held >= tokens
        held -= tokens if ok else 0
        return (held, last), (ok, held)

    rows = requests.withColumn("_us", F.unix_micros(F.col(time).cast("timestamp")))
    out = ordered_fold(rows, ["service"], list(order), lambda: None, lambda s, r: (lambda x: (x[0], [float(x[1][0]), x[1][1]]))(step(s, r)), ["service", "_us"], "_t array<double>", spans=True)
    return out.select(*requests.columns, (F.col("_t")[0] > 0).alias("allowed"), F.col("_t")[1].alias("tokens_left"))


def acquire(requests: DataFrame, rates: Mapping[str, Rate], time: str = "created_at", default: Rate = Rate(), levels: DataFrame | None = None) -> DataFrame:
    """requests with allowed and tries, as a dispatcher takes tokens: TOKEN_TRIES tries, TOKEN_WAIT_MS apart, each in its turn among all tries of the service.

    levels (service, tokens, us) says what earlier requests have left in the buckets, which are full else; tokens and us
    are what is left after the request's last try, and when.
    """
    wait = TOKEN_WAIT_MS * 1000

    def step(state, row):
        service, us, request, attempt, tokens, since = row
        rate = rates.get(service, default)
        if state is not None:
            held, last, done = state
        else:
            held, last, done = (float(rate.capacity), us, {}) if tokens is None else (tokens, since, {})
        if attempt == 0:  # what was served too long ago to try again is forgotten
            done = {r: t for r, t in done.items() if t + wait * TOKEN_TRIES >= us}
        if request not in done:
            if us > last:
                held, last = min(float(rate.capacity), held + (us - last) / 1e6 * rate.refill_per_second), us
            if held >= 1:
                done[request] = us
                return (held - 1, last, done), [1.0, held - 1]
        return (held, last, done), [0.0, held]

    tries = F.explode(F.sequence(F.lit(0), F.lit(TOKEN_TRIES - 1))).alias("_try")
    rows = requests.select("service", "request_id", F.unix_micros(F.col(time).cast("timestamp")).alias("_us"), tries).withColumn("_us", F.col("_us") + F.col("_try") * wait)
    if levels is None:
        rows = rows.withColumn("_tokens", F.lit(None).cast("double")).withColumn("_since", F.lit(None).cast("long"))
    else:
        rows = rows.join(levels.select("service", F.col("tokens").alias("_tokens"), F.col("us").alias("_since")), "service", "left")
    out = ordered_fold(rows, ["service"], ["_us", "_try", "request_id"], lambda: None, step, ["service", "_us", "request_id", "_try", "_tokens", "_since"], "_got array<double>", spans=True)
    won = out.groupBy("request_id").agg(F.min(F.when(F.col("_got")[0] > 0, F.col("_try"))).alias("_won"), F.max_by(F.col("_got")[1], "_try").alias("tokens"), F.max("_us").alias("us"))
    return requests.join(won.select("request_id", F.col("_won").isNotNull().alias("allowed"), F.coalesce(F.col("_won") + 1, F.lit(TOKEN_TRIES)).alias("tries"), "tokens", "us"), "request_id")


def levels_after(acquired: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """service, tokens, us: what the buckets hold after the requests of acquire(); services without any keep theirs."""
    rows = acquired.select("service", "tokens", "us", "request_id")
    if before is not None:
        rows = rows.unionByName(before.select("service", "tokens", "us", F.lit("").alias("request_id")))
    last = rows.groupBy("service").agg(F.max_by("tokens", F.struct("us", "request_id")).alias("tokens"), F.max("us").alias("us"))
    return last


def backoff_ms(attempt: Column, retry: Retry, seed: int | None = None) -> Column:
    """The wait after an attempt, numbered from 0."""
    jitter = F.lit(1.0) + (F.lit(retry.jitter) * F.rand(seed) if retry.jitter and seed is not None else F.lit(0.0))
    return F.floor(F.lit(float(retry.initial_ms)) * F.pow(F.lit(retry.multiplier), attempt) * jitter).cast("long")


def attempts(requests: DataFrame, succeeds: Column, retry: Retry, seed: int | None = None) -> DataFrame:
    """requests with success, retry_count and waited_ms of a dispatch with retries.

    succeeds(attempt column named "attempt") says whether an attempt would work; the first that does ends the dispatch,
    else the last one's number is the count.
    """
    tries = F.explode(F.sequence(F.lit(0), F.lit(retry.max_retries))).alias("attempt")
    rows = requests.select("request_id", *[c for c in requests.columns if c != "request_id"], tries).withColumn("_ok", succeeds).withColumn("_wait", backoff_ms(F.col("attempt"), retry, seed))
    first = F.min(F.when(F.col("_ok"), F.col("attempt")))
    own = rows.groupBy("request_id").agg(first.alias("_first"), F.array_agg(F.struct("attempt", "_wait")).alias("_w"))
    count = F.coalesce(F.col("_first"), F.lit(retry.max_retries))
    waited = F.aggregate(F.filter("_w", lambda x: x["attempt"] < count), F.lit(0).cast("long"), lambda t, x: t + x["_wait"])
    done = own.select("request_id", F.col("_first").isNotNull().alias("success"), count.alias("retry_count"), waited.alias("waited_ms"))
    return requests.join(done, "request_id")


def outcomes(requests: DataFrame, allowed: str = "allowed", success: str = "success") -> DataFrame:
    """requests with response and succeeded, as the pipeline of validation, tokens, delay and dispatch answers."""
    wrong = problem(F.col("action_type"), F.col("service"))
    response = F.when(wrong.isNotNull(), wrong).when(~F.col(allowed), RATE_LIMITED).when(F.col("delay_ms") > 0, SCHEDULED).when(F.col(success), OK).otherwise("DISPATCH_ERROR")
    return requests.withColumn("response", response).withColumn("succeeded", F.col("response").isin(OK, SCHEDULED))


def dispatch_counts(results: DataFrame) -> DataFrame:
    """dispatched, succeeded, failed and rate_limited; what is rate-limited has failed too."""
    n = lambda c: F.count_if(c)
    return results.agg(F.count(F.lit(1)).alias("dispatched"), n(F.col("succeeded")).alias("succeeded"), n(~F.col("succeeded")).alias("failed"), n(F.col("response") == RATE_LIMITED).alias("rate_limited"))
