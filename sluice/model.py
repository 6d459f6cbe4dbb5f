"""Rules, campaigns and settings as plain values, and the schemas of the tables that plans read and make."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import types as T

UNLIMITED_BUDGET = 2**63 - 1
UNLIMITED_ACTIONS = 2**31 - 1
YEAR_MS = 365 * 24 * 3600 * 1000
#: Budgets above this are never drawn down.
HIGH_BUDGET = 100_000


class Op(str, Enum):
    EQ = "EQ"
    NEQ = "NEQ"
    GT = "GT"
    GTE = "GTE"
    LT = "LT"
    LTE = "LTE"
    IN = "IN"
    CONTAINS = "CONTAINS"


class Source(Enum):
    """Where a field comes from, and what reading it costs."""

    MEMORY = 1
    DATABASE = 10
    EXTERNAL_SERVICE = 100


class Rule:
    """A node of a boolean rule."""


@dataclass(frozen=True)
class Leaf(Rule):
    field: str
    op: Op
    value: object = None
    source: Source = Source.MEMORY


@dataclass(frozen=True)
class And(Rule):
    children: tuple[Rule, ...] = ()


@dataclass(frozen=True)
class Or(Rule):
    children: tuple[Rule, ...] = ()


@dataclass(frozen=True)
class Not(Rule):
    child: Rule = None


ACTION_TYPES = ("SEND_MESSAGE", "GRANT_REWARD", "APPLY_COMPENSATION", "SEND_PUSH_NOTIFICATION", "CALL_WEBHOOK")
#: Advisory; event types are free strings.
KNOWN_EVENT_TYPES = ("RIDE_COMPLETED", "PAYMENT_SUCCEEDED", "ORDER_PLACED", "USER_REGISTERED", "REWARD_CLAIMED", "REFERRAL_COMPLETED", "SUBSCRIPTION_RENEWED", "PROFILE_UPDATED")
STATUSES = ("DRAFT", "ACTIVE", "PAUSED", "COMPLETED", "CANCELLED")
TRANSITIONS = {"DRAFT": ("ACTIVE", "CANCELLED"), "ACTIVE": ("PAUSED", "COMPLETED", "CANCELLED"), "PAUSED": ("ACTIVE", "CANCELLED"), "COMPLETED": (), "CANCELLED": ()}


@dataclass(frozen=True)
class Action:
    type: str | None
    service: str | None
    params: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Campaign:
    id: str
    trigger: str
    rule: Rule = And()
    status: str = "ACTIVE"
    name: str | None = None
    actions: tuple[Action, ...] = ()
    budget: int = UNLIMITED_BUDGET
    currency: str = "USD"
    variants: tuple[tuple[str, float], ...] = (("default", 1.0),)
    delay_ms: int = 0
    max_per_user: int = UNLIMITED_ACTIONS
    user_window_ms: int = YEAR_MS
    start: str | None = None
    end: str | None = None
    #: How often the budget was replaced; what was spent counts against its own budget.
    budget_epoch: int = 0

    def __post_init__(self):
        if self.id is None or self.trigger is None:
            raise ValueError("a campaign needs an id and a trigger")
        if self.status not in STATUSES:
            raise ValueError(f"unknown status {self.status}")

    def with_status(self, status: str) -> Campaign:
        from dataclasses import replace

        return replace(self, status=status)


@dataclass(frozen=True)
class Rate:
    capacity: int = 100
    refill_per_second: float = 10.0

    def __post_init__(self):
        if self.capacity <= 0 or self.refill_per_second <= 0:
            raise ValueError("capacity and refill rate must be positive")


@dataclass(frozen=True)
class Retry:
    max_retries: int = 3
    initial_ms: int = 100
    multiplier: float = 2.0
    jitter: float = 0.1


@dataclass(frozen=True)
class Settings:
    """What a pipeline is built with."""

    parallelism: int = 4
    dedup_ttl_ms: int = 24 * 3600 * 1000
    cache_size: int = 1_000_000
    bloom_insertions: int = 1_000_000
    bloom_fpr: float = 0.001
    rates: tuple[tuple[str, Rate], ...] = ()
    retry: Retry = Retry()
    clock: str = "event"
    on_error: str = "false"

    @staticmethod
    def small() -> Settings:
        return Settings(bloom_insertions=10_000, bloom_fpr=0.01, cache_size=1_000, dedup_ttl_ms=300_000, retry=Retry(max_retries=0))


EVENTS = T.StructType([
    T.StructField("event_id", T.StringType(), False), T.StructField("event_type", T.StringType(), False), T.StructField("user_id", T.StringType(), False),
    T.StructField("payload", T.StringType()), T.StructField("ts", T.TimestampType()), T.StructField("source_service", T.StringType()),
])

CAMPAIGNS = (
    "campaign_id string, trigger string, status string, budget long, currency string, delay_ms long, max_per_user int, user_window_ms long, start_ts timestamp, end_ts timestamp, "
    "variants map<string,double>, actions array<struct<action_type:string,service:string,params:map<string,string>>>, budget_epoch int"
)
