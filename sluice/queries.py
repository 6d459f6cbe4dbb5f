"""A query for each operator, and the SQL that says what it must return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import fields as fieldfn
from .functions import hashing, jsoncols
from .model import Action, And, Campaign, Leaf, Not, Op, Or, Rate, Retry, Source
from .operators import abtest, actions, bloom, campaigns, dedup, enrichment, gates, metrics, pipeline, routing, schedule
from .plans.rulecompile import compile_rule
from .sources.events import from_table, table_fields
from .sources.shared import fresh_dir as _shared

RULE = And((Leaf("payload.k", Op.GT, 50), Not(Leaf("payload.value", Op.LT, 20))))
_NOTIFY = (Action("SEND_MESSAGE", "notify", {"msg": "hello"}), Action("GRANT_REWARD", "rewards", {"points": "5"}))
CAMPAIGNS = (
    Campaign("c1", "purchase", RULE, budget=40, max_per_user=3, actions=_NOTIFY),
    Campaign("c2", "click", RULE, budget=200_000, actions=_NOTIFY[:1], variants=(("a", 0.6), ("b", 0.2), ("c", 0.2))),
    Campaign("c3", "view", RULE, budget=0, max_per_user=5, actions=_NOTIFY[:1]),
    Campaign("c4", "purchase", RULE, budget=100_000, max_per_user=1, actions=(Action("CALL_WEBHOOK", "hooks"),), delay_ms=60_000),
    Campaign("c5", "signup", RULE, budget=25, actions=_NOTIFY),
    Campaign("c6", "signup", RULE, status="PAUSED", actions=_NOTIFY),
    Campaign("c7", "view", RULE, start="2024-01-10T00:00:00", end="2024-01-20T00:00:00", actions=_NOTIFY[:1]),
)
GATED = CAMPAIGNS[:5]

_EV = "ev AS (SELECT event_id, ts, user_id, event_type, value, CAST(props->>'$.k' AS BIGINT) AS k FROM events)"
_C = """c(campaign_id, trig, budget, max_user) AS (VALUES ('c1', 'purchase', 40, 3), ('c2', 'click', 200000, 2147483647), ('c3', 'view', 0, 5), ('c4', 'purchase', 100000, 1), ('c5', 'signup', 25, 2147483647))"""
_GATED = f"""{_EV}, {_C},
j AS (SELECT ev.*, c.*, k > 50 AND NOT value < 20 AS m FROM ev JOIN c ON event_type = trig WHERE budget > 0),
g AS (SELECT *, row_number() OVER (PARTITION BY campaign_id, user_id ORDER BY ts, event_id) AS rn FROM j),
h AS (SELECT *, coalesce(sum(CASE WHEN m THEN 1 ELSE 0 END) OVER (PARTITION BY campaign_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM g WHERE rn <= max_user),
e AS (SELECT *, m AS triggered FROM h WHERE budget > 100000 OR used < budget)"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def keep(f):
        QUERIES[f"q_{f.__name__}"] = f
        if sql:
            ORACLES[f"q_{f.__name__}"] = sql
        return f

    return keep


def also(name: str, other: str) -> None:
    """Registers a query under a second name."""
    QUERIES[f"q_{other}"], ORACLES[f"q_{other}"] = QUERIES[f"q_{name}"], ORACLES[f"q_{name}"]


def _doubled(ev: DataFrame) -> DataFrame:
    """Events of which every third comes again, a second later."""
    again = ev.filter("event_id % 3 = 0").withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 SECOND"))
    return ev.unionByName(again)


_DOUBLED = f"WITH {_EV}, d AS (SELECT * FROM ev UNION ALL SELECT event_id, ts + INTERVAL 1 SECOND, user_id, event_type, value, k FROM ev WHERE event_id % 3 = 0)"


def _leafs(ev: DataFrame, **rules) -> DataFrame:
    f = table_fields()
    return ev.select("event_id", *[compile_rule(r, f).matched.alias(name) for name, r in rules.items()])


# --- JSON and fields


@query("SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k, props->>'$.missing' AS missing FROM events")
def json_extract(spark, sf_dir):
    v = jsoncols.parse(F.col("props"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.try_variant_get(v, "$.k", "bigint").alias("k"), F.try_variant_get(v, "$.missing", "string").alias("missing"))


@query("""SELECT event_id, '{"event_type":"' || event_type || '","k":' || (props->>'$.k') || ',"tags":["x",' || event_id || ',null,true]}' AS text, false AS bad FROM events""")
def json_roundtrip(spark, sf_dir):
    t = from_table(spark, sf_dir)
    text = F.concat(F.lit('{ "k" : '), F.col("k").cast("string"), F.lit(', "event_type": "'), "event_type", F.lit('", "tags": ["x", '), F.col("event_id").cast("string"), F.lit(", null, true]}"))
    return t.select("event_id", jsoncols.serialize(jsoncols.parse(text)).alias("text"), jsoncols.corrupt(text).alias("bad"))


@query(f"""WITH {_EV} SELECT event_id, event_id AS last_key, NULL::BIGINT AS goes_on, NULL::BIGINT AS closes_early, k AS leading_zeros, 'a' || chr(9) || k AS raw_control, NULL::BIGINT AS single_quotes, k AS spaces FROM ev""")
def json_edge(spark, sf_dir):
    k, n = F.col("k").cast("string"), F.col("event_id").cast("string")
    text = {
        "last_key": F.concat(F.lit('{"v":'), k, F.lit(',"v":'), n, F.lit("}")), "goes_on": F.concat(F.lit('{"v":'), k, F.lit("} x")), "closes_early": F.concat(F.lit('{"v":'), k, F.lit('}}, {"v":1}')),
        "leading_zeros": F.concat(F.lit('{"v":00'), k, F.lit("}")), "raw_control": F.concat(F.lit('{"v":"a\t'), k, F.lit('"}')), "single_quotes": F.concat(F.lit("{'v':"), k, F.lit("}")), "spaces": F.concat(F.lit(' \n{"v" :\t'), k, F.lit("\r}\n")),
    }
    kind = lambda name: "string" if name == "raw_control" else "bigint"
    return from_table(spark, sf_dir).select("event_id", *[F.try_variant_get(jsoncols.parse(t), "$.v", kind(name)).alias(name) for name, t in text.items()])


@query(f"""WITH {_EV} SELECT event_id, CAST(k AS VARCHAR) AS plain_payload, 'gold' AS plain_enriched, CAST(k AS VARCHAR) AS payload_path, 'gold' AS enriched_path, 'gold' AS external_path,
  event_type, CAST(user_id AS VARCHAR) AS user_id, CAST(NULL AS VARCHAR) AS unknown_event, CAST(NULL AS VARCHAR) AS unknown_prefix, CAST(NULL AS VARCHAR) AS null_payload_key FROM ev""")
def field_resolution(spark, sf_dir):
    ev = from_table(spark, sf_dir).withColumn("source_service", F.lit("s"))
    payload = F.parse_json(F.concat(F.lit('{"k": '), F.col("k").cast("string"), F.lit(', "gone": null}')))
    f = fieldfn.Fields(payload, F.parse_json(F.lit('{"tier": "gold", "k": -1, "gone": 1}')), {"eventType": F.col("event_type"), "userId": F.col("user_id").cast("string")})
    text = lambda name: (lambda v: F.when(v.present, v.text) if v else F.lit(None).cast("string"))(f.resolve(name))
    names = {"plain_payload": "k", "plain_enriched": "tier", "payload_path": "payload.k", "enriched_path": "enriched.tier", "external_path": "external.tier", "event_type": "event.eventType", "user_id": "event.userId", "unknown_event": "event.timestamp", "unknown_prefix": "foo.bar", "null_payload_key": "gone"}
    return ev.select("event_id", *[text(n).alias(c) for c, n in names.items()])


# --- rules


@query(f"WITH {_EV} SELECT event_id, k = 50 AS eq, k <> 50 AS neq, value > 100.5 AS gt, k >= 50 AS gte, value < 100.5 AS lt, k <= 50 AS lte FROM ev")
def rule_numeric_ops(spark, sf_dir):
    k, v = "payload.k", "payload.value"
    return _leafs(from_table(spark, sf_dir), eq=Leaf(k, Op.EQ, 50), neq=Leaf(k, Op.NEQ, 50), gt=Leaf(v, Op.GT, 100.5), gte=Leaf(k, Op.GTE, 50), lt=Leaf(v, Op.LT, 100.5), lte=Leaf(k, Op.LTE, 50))


@query(f"""WITH {_EV} SELECT event_id, lower(event_type) = 'click' AS eq, lower(event_type) <> 'click' AS neq, lower(event_type) IN ('click', 'view') AS is_in, contains(event_type, 'ig') AS has,
  contains(event_type, 'IG') AS has_upper, false AS is_greater FROM ev""")
def rule_string_ops(spark, sf_dir):
    t = "event.eventType"
    return _leafs(from_table(spark, sf_dir), eq=Leaf(t, Op.EQ, "CLICK"), neq=Leaf(t, Op.NEQ, "Click"), is_in=Leaf(t, Op.IN, " CLICK,\tview ,,"), has=Leaf(t, Op.CONTAINS, "ig"), has_upper=Leaf(t, Op.CONTAINS, "IG"), is_greater=Leaf(t, Op.GT, "a"))


@query(f"""WITH {_EV} SELECT event_id, k = 10 AS long_text, false AS long_double_text, k = 10 AS long_double, CAST(k AS VARCHAR) IN ('1', '10') AS long_in, contains(CAST(k AS VARCHAR), '7') AS long_has,
  false AS number_in_number, lower(event_type) = '5' AS text_number FROM ev""")
def rule_mixed_types(spark, sf_dir):
    k = "payload.k"
    return _leafs(from_table(spark, sf_dir), long_text=Leaf(k, Op.EQ, "10"), long_double_text=Leaf(k, Op.EQ, "10.0"), long_double=Leaf(k, Op.EQ, 10.0), long_in=Leaf(k, Op.IN, "1, 10"), long_has=Leaf(k, Op.CONTAINS, "7"), number_in_number=Leaf(k, Op.IN, 10), text_number=Leaf("event.eventType", Op.EQ, 5))


@query(f"""WITH {_EV} SELECT event_id, NOT (k > 50 OR value < 20) AS a, true AS not_missing, false AS neq_missing, true AS empty_and, false AS empty_or, k > 90 OR (k < 10 AND NOT event_type = 'view') AS b FROM ev""")
def rule_nested_not_null(spark, sf_dir):
    k, v, gone = "payload.k", "payload.value", "payload.gone"
    return _leafs(
        from_table(spark, sf_dir), a=Not(Or((Leaf(k, Op.GT, 50), Leaf(v, Op.LT, 20)))), not_missing=Not(Leaf(gone, Op.EQ, 1)), neq_missing=Leaf(gone, Op.NEQ, 1), empty_and=And(), empty_or=Or(),
        b=Or((Leaf(k, Op.GT, 90), And((Leaf(k, Op.LT, 10), Not(Leaf("event.eventType", Op.EQ, "view")))))),
    )


@query(f"""WITH {_EV} SELECT event_id, event_type = 'click' AND (k > 80 OR value > 400) AND value > 10 AS matched,
  CASE WHEN event_type <> 'click' THEN 1 WHEN NOT value > 10 THEN 2 WHEN k > 80 THEN 3 ELSE 4 END AS evaluated, 4 - CASE WHEN event_type <> 'click' THEN 1 WHEN NOT value > 10 THEN 2 WHEN k > 80 THEN 3 ELSE 4 END AS skipped, false AS error FROM ev""")
def rule_stats(spark, sf_dir):
    rule = And((Or((Leaf("payload.value", Op.GT, 400, Source.DATABASE), Leaf("payload.k", Op.GT, 80))), Leaf("event.eventType", Op.EQ, "click"), Leaf("payload.value", Op.GT, 10)))
    return from_table(spark, sf_dir).select("event_id", compile_rule(rule, table_fields()).result().alias("r")).select("event_id", "r.*")


# --- matching


@query("""WITH c(campaign_id, trig) AS (VALUES ('c1', 'purchase'), ('c2', 'click'), ('c3', 'view'), ('c4', 'purchase'), ('c5', 'signup'))
SELECT campaign_id, count(*) AS events FROM events JOIN c ON event_type = trig GROUP BY campaign_id
UNION ALL SELECT 'c7', count(*) FROM events WHERE event_type = 'view' AND ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20' HAVING count(*) > 0""")
def campaign_match(spark, sf_dir):
    table = campaigns.campaign_table(spark, CAMPAIGNS)
    return campaigns.match(from_table(spark, sf_dir), table, len(CAMPAIGNS)).groupBy("campaign_id").agg(F.count(F.lit(1)).alias("events"))


@query("SELECT event_id, event_type FROM events WHERE event_type NOT IN ('purchase', 'click', 'view', 'signup')")
def no_campaign(spark, sf_dir):
    return campaigns.unmatched(from_table(spark, sf_dir), campaigns.campaign_table(spark, CAMPAIGNS), len(CAMPAIGNS)).select("event_id", "event_type")


@query("SELECT event_id FROM events WHERE event_type = 'view' AND ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20'")
def time_window_filter(spark, sf_dir):
    return campaigns.match(from_table(spark, sf_dir), campaigns.campaign_table(spark, CAMPAIGNS[6:]), 1).select("event_id")


@query("SELECT * FROM (VALUES ('click', 'c2', 1), ('purchase', 'c1,c4', 2), ('signup', 'c5', 1), ('view', 'c3,c7', 2)) t(trigger, campaign_ids, n)")
def campaign_index(spark, sf_dir):
    return campaigns.by_trigger(campaigns.campaign_table(spark, CAMPAIGNS)).withColumn("campaign_ids", F.array_join("campaign_ids", ","))


@query("SELECT 7 AS campaigns, 0 AS draft, 6 AS active, 1 AS paused, 0 AS completed, 0 AS cancelled")
def campaign_counts(spark, sf_dir):
    return metrics.campaign_counts(campaigns.campaign_table(spark, CAMPAIGNS))


# --- dedup


@query(f"{_DOUBLED} SELECT event_id, event_type, min(ts) AS ts FROM d GROUP BY ALL")
def dedup_first(spark, sf_dir):
    return dedup.first_occurrences(_doubled(from_table(spark, sf_dir))).select("event_id", "event_type", F.col("ts").cast("timestamp_ntz").alias("ts"))


def _within_half_an_hour(ev):
    """Each event at six offsets, in minutes, and whether a window of 30 accepts it."""
    ev = ev.select("event_id", "event_type", "ts", F.explode(F.array(*map(F.lit, (0, 10, 25, 29, 31, 60)))).alias("offset_min"))
    ev = ev.withColumn("ts", F.timestamp_add("MINUTE", F.col("offset_min"), F.col("ts")))
    return dedup.within_ttl(ev, 30 * 60_000).select("event_id", "offset_min", "accepted")


@query("""WITH o(m) AS (VALUES (0), (10), (25), (29), (31), (60)), t AS (SELECT event_id, event_type, m FROM events, o),
l AS (SELECT event_id, event_type, list_reduce(list([m] ORDER BY m), lambda a, b: CASE WHEN b[1] <= a[-1] + 30 THEN a ELSE list_concat(a, b) END) AS ok FROM t GROUP BY ALL)
SELECT t.event_id, t.m AS offset_min, list_contains(ok, t.m) AS accepted FROM t JOIN l USING (event_id)""")
def dedup_ttl(spark, sf_dir):
    return _within_half_an_hour(from_table(spark, sf_dir))


also("dedup_ttl", "dedup_ttl_all")


@query(f"""{_DOUBLED}, s AS (SELECT *, row_number() OVER (PARTITION BY event_id, event_type ORDER BY ts) AS n FROM d)
SELECT CASE WHEN n > 1 THEN 'DUPLICATE_CACHED' WHEN event_id % 7 = 0 THEN 'DUPLICATE_PERSISTENT' ELSE 'NEW_EVENT' END AS dedup_status, count(*) AS n FROM s GROUP BY 1""")
def dedup_status_counts(spark, sf_dir):
    ev = from_table(spark, sf_dir)
    return dedup.status_counts(dedup.with_status(_doubled(ev), ev.filter("event_id % 7 = 0")))


@query(f"{_DOUBLED} SELECT event_id, event_type, max(ts) AS ts FROM d GROUP BY ALL")
def persistent_store(spark, sf_dir):
    ev = from_table(spark, sf_dir)
    return dedup.record(ev, _doubled(ev)).select("event_id", "event_type", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query(f"{_DOUBLED} SELECT event_id, event_type, max(ts) AS last_access FROM d GROUP BY ALL ORDER BY max(ts) DESC, event_id, event_type LIMIT 100")
def lru_topk(spark, sf_dir):
    return dedup.most_recent(_doubled(from_table(spark, sf_dir)), 100).withColumn("last_access", F.col("last_access").cast("timestamp_ntz"))


@query("""WITH e AS (SELECT event_id, user_id, row_number() OVER (ORDER BY ts, event_id) AS n FROM events), p AS (SELECT *, lag(n) OVER (PARTITION BY user_id ORDER BY n) AS before FROM e)
SELECT p.event_id, p.before IS NOT NULL AND count(DISTINCT b.user_id) < 100 AS cached FROM p LEFT JOIN e b ON b.n > p.before AND b.n < p.n GROUP BY p.event_id, p.before""")
def lru_cache(spark, sf_dir):
    """A user is held by a cache of 100 if fewer others came since."""
    return dedup.lru_cached(from_table(spark, sf_dir), 100, 10**15, ("ts", "event_id"), ("user_id",)).select("event_id", "cached")


_SIZES = "t(n, p) AS (VALUES (1000000, 0.001::DOUBLE), (100000, 0.01), (10000, 0.01), (1000, 0.01), (1, 0.5))"


def _sizes(spark):
    df = spark.createDataFrame([(1_000_000, 0.001), (100_000, 0.01), (10_000, 0.01), (1_000, 0.01), (1, 0.5)], "n long, p double")
    df = df.withColumn("bits", bloom.bit_count_of(F.col("n"), F.col("p")))
    return df.withColumn("hashes", bloom.hash_count_of(F.col("bits"), F.col("n")))


_SIZED = f"{_SIZES}, b AS (SELECT n, p, greatest(1, ceil(-n * ln(p) / power(ln(2.0), 2)))::BIGINT AS bits FROM t), h AS (SELECT *, greatest(1, floor(bits / n * ln(2.0) + 0.5))::INT AS hashes FROM b)"


@query(f"WITH {_SIZED} SELECT * FROM h")
def bloom_sizing(spark, sf_dir):
    return _sizes(spark)


@query(f"WITH {_SIZED} SELECT n, round(power(1 - exp(-hashes * n / bits), hashes), 9) AS full_rate, round(power(1 - exp(-hashes * 2 * n / bits), hashes), 9) AS double_rate, 0.0 AS empty_rate FROM h")
def bloom_fpr(spark, sf_dir):
    rate = lambda n: F.round(bloom.expected_rate(n, F.col("bits"), F.col("hashes")), 9)
    return _sizes(spark).select("n", rate(F.col("n")).alias("full_rate"), rate(2 * F.col("n")).alias("double_rate"), rate(F.lit(0)).alias("empty_rate"))


@query("SELECT 0 AS false_negatives, true AS rate_holds, sum((event_id % 2)::INT)::BIGINT AS probed FROM events")
def bloom_prefilter(spark, sf_dir):
    ev = from_table(spark, sf_dir).select(F.col("event_id").cast("string").alias("event_id"), "event_type", (F.col("event_id") % 2).alias("odd"))
    evens = ev.filter("odd = 0")
    own = bloom.build(evens, max(evens.count(), 1), 0.01)
    found = own.might_contain(ev)
    rate = F.count_if((F.col("odd") == 1) & F.col("might_contain")) / F.greatest(F.count_if(F.col("odd") == 1), F.lit(1))
    return found.agg(F.count_if((F.col("odd") == 0) & ~F.col("might_contain")).alias("false_negatives"), (rate < 0.03).alias("rate_holds"), F.count_if(F.col("odd") == 1).alias("probed"))


def _murmur_sql(seed: int) -> str:
    """32-bit murmur3 of the list of bytes b, as an unsigned number."""
    times = lambda x, k: f"((({x})::HUGEINT * {k}) % 4294967296)::BIGINT"
    turned = lambda x, k: f"(((({x})::BIGINT << {k}) | (({x})::BIGINT >> {32 - k})) & 4294967295)"
    mixed = lambda x: times(turned(times(x, 3432918353), 15), 461845907)
    block = "b[4 * j + 1] + b[4 * j + 2] * 256 + b[4 * j + 3] * 65536 + b[4 * j + 4] * 16777216"
    blocks = f"list_reduce(list_prepend({seed}::BIGINT, list_transform(range(len(b) // 4), lambda j: {mixed(block)})), lambda h, k: ({turned('xor(h, k)', 13)} * 5 + 3864292196) % 4294967296)"
    tail = "list_sum(list_transform(range(len(b) % 4), lambda j: b[4 * (len(b) // 4) + j + 1] << (8 * j)))"
    h = f"xor({blocks}, CASE WHEN len(b) % 4 > 0 THEN {mixed(f'coalesce({tail}, 0)')} ELSE 0 END)"
    h = f"xor({h}, len(b))"
    for shift, k in ((16, 2246822507), (13, 3266489909)):
        h = f"list_transform([{h}], lambda x: {times(f'xor(x, x >> {shift})', k)})[1]"
    return f"list_transform([{h}], lambda x: xor(x, x >> 16))[1]"


@query(f"""WITH n AS (SELECT count(*) FILTER (event_id % 2 = 0) AS n FROM events), p AS (SELECT greatest(1, ceil(-(n // 4) * ln(0.05) / power(ln(2.0), 2)))::BIGINT AS bits, n // 4 AS want FROM n),
z AS (SELECT bits, greatest(1, floor(bits / want * ln(2.0) + 0.5))::INT AS hashes FROM p),
k AS (SELECT event_id, event_type, list_transform(string_split(event_id || ':' || event_type, ''), lambda c: ord(c)::BIGINT) AS b FROM events),
h AS (SELECT event_id, event_type, {_murmur_sql(hashing.SEEDS[0])} AS h1, {_murmur_sql(hashing.SEEDS[1])} AS h2 FROM k),
a AS (SELECT event_id, list_transform(range(hashes), lambda i: (h1 + i * h2) % 4294967296) AS w, bits FROM h, z),
s AS (SELECT event_id, list_transform(w, lambda x: ((CASE WHEN x >= 2147483648 THEN x - 4294967296 ELSE x END) % bits + bits) % bits) AS places FROM a),
held AS (SELECT list(DISTINCT x) AS all_places FROM (SELECT unnest(places) AS x FROM s WHERE event_id % 2 = 0))
SELECT event_id, list_has_all(all_places, places) AS might_contain FROM s, held""")
def bloom_members(spark, sf_dir):
    ev = from_table(spark, sf_dir).select(F.col("event_id").cast("string").alias("event_id"), "event_type", F.col("event_id").alias("n"))
    evens = ev.filter("n % 2 = 0")
    own = bloom.build(evens, max(evens.count() // 4, 1), 0.05)  # four times as many as it is made for, so that it errs often
    return own.might_contain(ev).select(F.col("n").alias("event_id"), "might_contain")


# --- gates


def _rows(spark, sf_dir, own=GATED):
    return campaigns.match(from_table(spark, sf_dir), campaigns.campaign_table(spark, own), len(own))


@query(f"WITH {_GATED} SELECT campaign_id, event_id FROM g WHERE rn <= max_user")
def user_limit(spark, sf_dir):
    return gates.user_limit(_rows(spark, sf_dir).filter("budget > 0")).select("campaign_id", "event_id")


@query(f"WITH {_GATED} SELECT campaign_id, user_id, count(*) AS used FROM g WHERE rn <= max_user GROUP BY ALL")
def user_counts(spark, sf_dir):
    return gates.user_counts(gates.user_limit(_rows(spark, sf_dir).filter("budget > 0")))


@query("""SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS recent FROM events WHERE event_type = 'click'""")
def user_limit_window(spark, sf_dir):
    own = (Campaign("w", "click", user_window_ms=86_400_000),)
    return gates.user_limit_in_window(_rows(spark, sf_dir, own)).select("event_id", "user_id", "recent")


@query(f"""WITH {_EV}, {_C}, b AS (SELECT ev.*, c.*, coalesce(sum(CASE WHEN k > 50 THEN 1 ELSE 0 END) OVER (PARTITION BY campaign_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM ev JOIN c ON event_type = trig)
SELECT campaign_id, count(*) AS evaluated, count(*) FILTER (k > 50) AS triggered FROM b WHERE budget > 100000 OR used < budget GROUP BY campaign_id""")
def budget(spark, sf_dir):
    out = gates.budget_gate(_rows(spark, sf_dir).withColumn("matched", F.col("k") > 50), size=len(GATED)).filter("evaluated")
    return out.groupBy("campaign_id").agg(F.count(F.lit(1)).alias("evaluated"), F.count_if("triggered").alias("triggered"))


@query(f"""WITH {_EV}, b(campaign_id, budget) AS (VALUES ('click', 5000), ('view', 200000), ('purchase', 100000), ('signup', 0)),
r AS (SELECT event_type, b.budget, list({{'bal': k, 'n': 1}} ORDER BY event_id) AS l FROM ev LEFT JOIN b ON event_type = campaign_id GROUP BY ALL),
f AS (SELECT event_type, budget, list_reduce(list_prepend({{'bal': budget, 'n': 0}}, l), lambda a, x: CASE WHEN budget > 100000 THEN {{'bal': a.bal, 'n': a.n + 1}} WHEN a.bal >= x.bal THEN {{'bal': a.bal - x.bal, 'n': a.n + 1}} ELSE a END) AS s FROM r)
SELECT event_type AS campaign_id, CASE WHEN budget IS NULL THEN 0 ELSE s.n END::BIGINT AS granted FROM f""")
def budget_amounts(spark, sf_dir):
    asked = from_table(spark, sf_dir).select(F.col("event_type").alias("campaign_id"), F.col("k").alias("amount"), F.col("event_id").alias("seq"))
    budgets = spark.createDataFrame([("click", 5000), ("view", 200_000), ("purchase", 100_000), ("signup", 0)], "campaign_id string, budget long")
    return gates.consume(asked, budgets).groupBy("campaign_id").agg(F.count_if("granted").alias("granted"))


@query(f"""WITH {_EV}, b(campaign_id, budget, seq) AS (SELECT * FROM (VALUES ('click', 5000, 0), ('purchase', 100000, 0)) t UNION ALL SELECT 'click', 700, max(event_id) // 2 FROM events),
r AS (SELECT campaign_id, seq, 0 AS turn, {{'bal': budget, 'n': 0, 'reset': true}} AS x FROM b UNION ALL SELECT event_type, event_id, 1, {{'bal': k, 'n': 1, 'reset': false}} FROM ev),
l AS (SELECT campaign_id, list(x ORDER BY seq, turn) AS l FROM r GROUP BY campaign_id),
f AS (SELECT campaign_id, list_reduce(list_prepend({{'bal': -1, 'n': 0, 'reset': false}}, l), lambda a, x: CASE WHEN x.reset THEN {{'bal': x.bal, 'n': a.n, 'reset': false}} WHEN a.bal >= x.bal THEN {{'bal': a.bal - x.bal, 'n': a.n + 1, 'reset': false}} ELSE a END) AS s FROM l)
SELECT campaign_id, s.n::BIGINT AS granted FROM f""")
def budget_replaced(spark, sf_dir):
    ev = from_table(spark, sf_dir)
    asked = ev.select(F.col("event_type").alias("campaign_id"), F.col("k").alias("amount"), F.col("event_id").alias("seq"))
    budgets = spark.createDataFrame([("click", 5000, 0), ("purchase", 100_000, 0)], "campaign_id string, budget long, seq long")
    again = ev.agg(F.lit("click").alias("campaign_id"), F.lit(700).cast("long").alias("budget"), F.expr("max(event_id) div 2").alias("seq"))
    return gates.consume(asked, budgets.unionByName(again)).groupBy("campaign_id").agg(F.count_if("granted").alias("granted"))


@query(f"WITH {_GATED} SELECT campaign_id, count(*) AS evaluated, count(*) FILTER (m) AS matched FROM e GROUP BY campaign_id")
def gates_combined(spark, sf_dir):
    rows = pipeline.evaluate(from_table(spark, sf_dir), GATED, table_fields())
    return rows.groupBy("campaign_id").agg(F.count(F.lit(1)).alias("evaluated"), F.count_if("triggered").alias("matched"))


@query(f"WITH {_GATED}, s AS (SELECT campaign_id, count(*) FILTER (triggered) AS n FROM e GROUP BY 1) SELECT c.campaign_id, CASE WHEN budget > 100000 THEN budget ELSE budget - coalesce(n, 0) END AS remaining FROM c LEFT JOIN s USING (campaign_id)")
def budget_remaining(spark, sf_dir):
    rows = pipeline.evaluate(from_table(spark, sf_dir), GATED, table_fields())
    return gates.remaining(campaigns.campaign_table(spark, GATED), rows.filter("triggered"))


# --- A/B

_HASH = """u AS (SELECT DISTINCT user_id, 'user-' || user_id AS name FROM events),
h0 AS (SELECT user_id, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(name, ''), lambda c: ord(c)::BIGINT)), lambda h, c: (h * 31 + c) & 4294967295) AS h FROM u),
h1 AS (SELECT user_id, ((xor(h, h >> 16)::HUGEINT * 2246822507) % 4294967296)::BIGINT AS h FROM h0),
h2 AS (SELECT user_id, ((xor(h, h >> 13)::HUGEINT * 3266489909) % 4294967296)::BIGINT AS h FROM h1),
b AS (SELECT user_id, ((xor(h, h >> 16) & 2147483647) % 10000)::INT AS bucket FROM h2)"""


@query(f"WITH {_HASH} SELECT user_id, bucket, CASE WHEN bucket < 6000 THEN 'a' WHEN bucket < 8000 THEN 'b' ELSE 'c' END AS variant FROM b")
def ab_bucket(spark, sf_dir):
    users = from_table(spark, sf_dir).select("user_id").distinct()
    name = F.concat(F.lit("user-"), F.col("user_id").cast("string"))
    return users.select("user_id", hashing.ab_bucket(name).alias("bucket"), abtest.variant_of(name, {"a": 0.6, "b": 0.2, "c": 0.2}).alias("variant"))


@query(f"WITH {_HASH} SELECT CASE WHEN bucket < 5000 THEN 'A' ELSE 'B' END AS variant, count(*) AS n FROM b GROUP BY 1")
def ab_distribution(spark, sf_dir):
    users = from_table(spark, sf_dir).select("user_id").distinct().withColumn("v", F.create_map(F.lit("B"), F.lit(0.5), F.lit("A"), F.lit(0.5)))
    return abtest.distribution(users.select(abtest.variant_by_map(F.concat(F.lit("user-"), F.col("user_id").cast("string")), F.col("v")).alias("variant")))


# --- actions

_ACTIONS = "a(campaign_id, ordinal, action_type, service, delay_ms) AS (VALUES ('c1', 0, 'SEND_MESSAGE', 'notify', 0), ('c1', 1, 'GRANT_REWARD', 'rewards', 0), ('c2', 0, 'SEND_MESSAGE', 'notify', 0), ('c4', 0, 'CALL_WEBHOOK', 'hooks', 60000), ('c5', 0, 'SEND_MESSAGE', 'notify', 0), ('c5', 1, 'GRANT_REWARD', 'rewards', 0))"


def _requests(spark, sf_dir):
    return actions.fan_out(pipeline.evaluate(from_table(spark, sf_dir), GATED, table_fields()).filter("triggered"))


@query(f"WITH {_GATED}, {_ACTIONS} SELECT sha256(e.event_id || '|' || event_type || '|' || campaign_id || '|' || ordinal) AS request_id, e.event_id, campaign_id, ordinal, action_type, service, delay_ms::BIGINT AS delay_ms FROM e JOIN a USING (campaign_id) WHERE triggered")
def action_fanout(spark, sf_dir):
    return _requests(spark, sf_dir).select("request_id", "event_id", "campaign_id", "ordinal", "action_type", "service", "delay_ms")


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'INVALID: missing action type' WHEN event_id % 5 = 1 THEN 'INVALID: missing target service' WHEN event_id % 3 = 0 THEN 'RATE_LIMITED' WHEN event_id % 2 = 0 THEN 'SCHEDULED'
 WHEN event_id % 11 = 0 THEN 'DISPATCH_ERROR' ELSE 'OK' END AS response FROM events""")
def action_validate(spark, sf_dir):
    n = F.col("event_id")
    rows = from_table(spark, sf_dir).select("event_id", F.when(n % 5 != 0, "SEND_MESSAGE").alias("action_type"), F.when(n % 5 == 1, " ").otherwise("svc").alias("service"), (n % 3 != 0).alias("allowed"), F.when(n % 2 == 0, 100).otherwise(0).alias("delay_ms"), (n % 11 != 0).alias("success"))
    return actions.outcomes(rows).select("event_id", "response")


@query("""SELECT count(*) AS dispatched, count(*) FILTER (event_id % 4 <> 0) AS succeeded, count(*) FILTER (event_id % 4 = 0) AS failed, count(*) FILTER (event_id % 4 = 0) AS rate_limited FROM events""")
def dispatch_counts(spark, sf_dir):
    rows = from_table(spark, sf_dir).select(F.lit("SEND_MESSAGE").alias("action_type"), F.lit("svc").alias("service"), (F.col("event_id") % 4 != 0).alias("allowed"), F.lit(0).alias("delay_ms"), F.lit(True).alias("success"))
    return actions.dispatch_counts(actions.outcomes(rows))


def _allowed_by_type(ev):
    rows = ev.select(F.col("event_type").alias("service"), F.col("event_id").alias("request_id"), F.col("ts").alias("created_at"))
    return actions.rate_limited(rows, {"click": Rate(5, 0.001)}).groupBy("service").agg(F.count_if("allowed").alias("allowed"))


@query("""WITH e AS (SELECT event_type, event_id, epoch_us(ts) AS us, CASE WHEN event_type = 'click' THEN 5 ELSE 100 END AS cap, CASE WHEN event_type = 'click' THEN 0.001 ELSE 10.0 END AS rate FROM events),
l AS (SELECT event_type, cap, rate, list({'tok': cap::DOUBLE, 'us': us, 'ok': 1} ORDER BY us, event_id) AS l FROM e GROUP BY ALL),
p AS (SELECT *, {'tok': cap - 1.0, 'us': l[1].us, 'ok': 1} AS first FROM l),
f AS (SELECT event_type, list_reduce(list_prepend(first, l[2:]), lambda a, x: CASE WHEN least(cap, a.tok + greatest(x.us - a.us, 0) / 1e6 * rate) >= 1
  THEN {'tok': least(cap, a.tok + greatest(x.us - a.us, 0) / 1e6 * rate) - 1, 'us': greatest(a.us, x.us), 'ok': a.ok + 1} ELSE {'tok': least(cap, a.tok + greatest(x.us - a.us, 0) / 1e6 * rate), 'us': greatest(a.us, x.us), 'ok': a.ok} END) AS s FROM p)
SELECT event_type AS service, s.ok::BIGINT AS allowed FROM f""")
def token_bucket(spark, sf_dir):
    return _allowed_by_type(from_table(spark, sf_dir))


also("token_bucket", "token_bucket_all")


def _tried_at_once(ev):
    at = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    rows = ev.select(F.lit("a").alias("service"), F.col("event_id").alias("request_id"), at.alias("created_at"))
    out = actions.acquire(rows, {"a": Rate(20, 0.5)})
    return out.groupBy("service").agg(F.count_if(F.col("allowed") & (F.col("tries") == 1)).alias("first_try"), F.count_if(~F.col("allowed")).alias("refused"))


@query("""SELECT 'a' AS service, count(*) FILTER (n <= 20) AS first_try, count(*) FILTER (n > 20) AS refused FROM (SELECT row_number() OVER (ORDER BY event_id) AS n FROM events)""")
def token_tries(spark, sf_dir):
    return _tried_at_once(from_table(spark, sf_dir))


also("token_tries", "token_tries_all")


@query("""SELECT event_id, (event_id % 5) <= 3 AS success, least(event_id % 5, 3)::INT AS retry_count, CASE least(event_id % 5, 3) WHEN 0 THEN 0 WHEN 1 THEN 100 WHEN 2 THEN 300 ELSE 700 END::BIGINT AS waited_ms FROM events""")
def retry_schedule(spark, sf_dir):
    rows = from_table(spark, sf_dir).select(F.col("event_id").alias("request_id"), (F.col("event_id") % 5).alias("fails"))
    out = actions.attempts(rows, F.col("attempt") >= F.col("fails"), Retry(3, 100, 2.0, 0.0))
    return out.select(F.col("request_id").alias("event_id"), "success", "retry_count", "waited_ms")


_TASKS = "t AS (SELECT event_id AS id, event_id * 37 AS deadline_ms, event_id % 6 = 0 AS cancelled FROM events)"


def _tasks(spark, sf_dir):
    base = from_table(spark, sf_dir).select(F.col("event_id").alias("id"), (F.col("event_id") * 37).alias("deadline_ms"), F.lit(False).alias("cancelled"))
    return schedule.cancel(base, base.filter("id % 6 = 0").select("id", (F.col("deadline_ms") - 1).alias("at_ms")))


@query(f"WITH {_TASKS} SELECT id, (ceil(deadline_ms / 100.0) * 100)::BIGINT AS fired_ms FROM t WHERE NOT cancelled AND ceil(deadline_ms / 100.0) * 100 <= 20000")
def delay_due(spark, sf_dir):
    return schedule.due(_tasks(spark, sf_dir), 20_000, 100).select("id", "fired_ms")


@query(f"WITH {_TASKS} SELECT count(*) AS pending FROM t WHERE NOT cancelled AND ceil(deadline_ms / 100.0) * 100 > 20000")
def delay_pending(spark, sf_dir):
    return schedule.pending(_tasks(spark, sf_dir), 20_000, 100).agg(F.count(F.lit(1)).alias("pending"))


# --- lifecycle, routing, admission


@query("""WITH s(k, st) AS (VALUES (0, 'ACTIVE'), (1, 'PAUSED'), (2, 'COMPLETED'), (3, 'CANCELLED'), (4, 'DRAFT')),
c AS (SELECT user_id, event_id, st FROM events JOIN s ON (event_id * 7 + user_id) % 5 = k),
l AS (SELECT user_id, list({'st': st, 'n': 1} ORDER BY event_id) AS l FROM c GROUP BY user_id),
f AS (SELECT user_id, list_reduce(list_prepend({'st': 'DRAFT', 'n': 0}, l), lambda a, x: CASE WHEN (a.st = 'DRAFT' AND x.st IN ('ACTIVE', 'CANCELLED')) OR (a.st = 'ACTIVE' AND x.st IN ('PAUSED', 'COMPLETED', 'CANCELLED')) OR (a.st = 'PAUSED' AND x.st IN ('ACTIVE', 'CANCELLED'))
  THEN {'st': x.st, 'n': a.n + 1} ELSE a END) AS s FROM l)
SELECT user_id::VARCHAR AS campaign_id, s.st AS status, s.n::BIGINT AS applied FROM f""")
def state_machine(spark, sf_dir):
    status = F.element_at(F.array(*map(F.lit, ("ACTIVE", "PAUSED", "COMPLETED", "CANCELLED", "DRAFT"))), ((F.col("event_id") * 7 + F.col("user_id")) % 5 + 1).cast("int"))
    commands = from_table(spark, sf_dir).select(F.col("user_id").cast("string").alias("campaign_id"), F.col("event_id").alias("seq"), status.alias("to_status"))
    return campaigns.replay(commands).groupBy("campaign_id").agg(F.max_by("status", "seq").alias("status"), F.count_if("applied").alias("applied"))


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def registry_lww(spark, sf_dir):
    rows = from_table(spark, sf_dir).select("user_id", F.col("event_id").alias("version"), "event_type", "value")
    return campaigns.latest(rows, "user_id").select("user_id", "event_type", "value")


_HANDLERS = [("click", "h1"), ("click", "h2"), ("view", "h1"), ("none", "h3")]


@query("SELECT event_type, handler, count(*) AS n FROM events JOIN (VALUES ('click', 'h1'), ('click', 'h2'), ('view', 'h1'), ('none', 'h3')) h(event_type, handler) USING (event_type) GROUP BY ALL")
def router(spark, sf_dir):
    return routing.route(from_table(spark, sf_dir), spark.createDataFrame(_HANDLERS, "event_type string, handler string")).groupBy("event_type", "handler").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) FILTER (event_type IN ('click', 'view')) AS routed, count(*) FILTER (event_type NOT IN ('click', 'view')) AS skipped FROM events")
def router_counts(spark, sf_dir):
    return routing.route_counts(from_table(spark, sf_dir), spark.createDataFrame(_HANDLERS, "event_type string, handler string"))


@query("SELECT (event_id % 4)::INT AS partition, count(*) AS events FROM events GROUP BY 1")
def partition_totals(spark, sf_dir):
    ev = from_table(spark, sf_dir)
    return routing.consumed(routing.merged([ev.filter(F.col("event_id") % 4 == i) for i in range(4)]))


@query("""WITH w AS (SELECT event_type, event_id, epoch_ms(ts) AS s, epoch_ms(ts) + k * 1000000 AS e FROM (SELECT *, CAST(props->>'$.k' AS BIGINT) AS k FROM events)),
l AS (SELECT event_type, list({'ends': [e], 's': s, 'n': 1} ORDER BY s, event_id) AS l FROM w GROUP BY event_type),
f AS (SELECT event_type, list_reduce(list_prepend({'ends': CAST([] AS BIGINT[]), 's': 0::BIGINT, 'n': 0}, l), lambda a, x: CASE WHEN len(list_filter(a.ends, lambda q: q > x.s)) < 3
  THEN {'ends': list_concat(list_filter(a.ends, lambda q: q > x.s), x.ends), 's': x.s, 'n': a.n + 1} ELSE {'ends': list_filter(a.ends, lambda q: q > x.s), 's': x.s, 'n': a.n} END) AS s FROM l)
SELECT event_type, s.n::BIGINT AS admitted FROM f""")
def admission(spark, sf_dir):
    ms = F.unix_millis("ts")
    rows = from_table(spark, sf_dir).select("event_type", "event_id", ms.alias("start_ms"), (ms + F.col("k") * 1_000_000).alias("end_ms"))
    return routing.admit(rows, 3, ["event_type"], ["start_ms", "event_id"]).groupBy("event_type").agg(F.count_if("admitted").alias("admitted"))


# --- whole pipeline


#: The gated campaigns, and one of whose actions two can't be submitted.
METERED = (*GATED, Campaign("c8", "error", RULE, actions=(Action(None, "svc"), Action("SEND_MESSAGE", " "), _NOTIFY[0])))
_CM = _C.removesuffix(")") + ", ('c8', 'error', 9223372036854775807, 2147483647))"
_SENT = "a(campaign_id, sent) AS (VALUES ('c1', true), ('c1', true), ('c2', true), ('c4', true), ('c5', true), ('c5', true), ('c8', true), ('c8', false), ('c8', false))"


def _gates(name: str, source: str, order: str) -> str:
    """The table expression {name} of rows of source that reach a rule, in an order of their own."""
    return f"""{name}_g AS (SELECT *, row_number() OVER (PARTITION BY campaign_id, user_id ORDER BY {order}) AS rn FROM (SELECT s.*, c.*, k > 50 AND NOT value < 20 AS m FROM {source} s JOIN c ON event_type = trig WHERE budget > 0)),
{name}_h AS (SELECT *, coalesce(sum(CASE WHEN m THEN 1 ELSE 0 END) OVER (PARTITION BY campaign_id ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM {name}_g WHERE rn <= max_user),
{name} AS (SELECT *, m AS triggered FROM {name}_h WHERE budget > 100000 OR used < budget)"""


_COUNTED = """(SELECT count(*) FROM e) AS rules_evaluated, (SELECT count(*) FROM e WHERE triggered) AS rules_matched,
 (SELECT count(*) FROM e JOIN a USING (campaign_id) WHERE triggered AND sent) AS actions_triggered, (SELECT count(*) FROM e JOIN a USING (campaign_id) WHERE triggered AND NOT sent) AS actions_failed"""


@query(f"""WITH {_EV}, {_CM}, {_SENT}, {_gates("e", "ev", "ts, event_id")}
SELECT (SELECT count(*) + count(*) FILTER (event_id % 3 = 0) FROM events) AS events_received, (SELECT count(*) FROM events) AS events_processed, (SELECT count(*) FROM events WHERE event_id % 3 = 0) AS duplicates_filtered, {_COUNTED}""")
def pipeline_metrics(spark, sf_dir):
    return pipeline.run(_doubled(from_table(spark, sf_dir)), METERED, table_fields(), stage=_shared(spark, "run")).metrics()


@query(f"""WITH {_EV}, o(m) AS (VALUES (0), (10), (40), (80)), t AS (SELECT event_id, event_type, m, event_type = 'click' AND k > 50 AND NOT value < 20 AS fires FROM ev, o),
l AS (SELECT event_id, any_value(fires) AS fires, list_reduce(list([m] ORDER BY m), lambda a, b: CASE WHEN b[1] <= a[-1] + 30 THEN a ELSE list_concat(a, b) END) AS ok FROM t GROUP BY event_id)
SELECT t.event_id, t.m AS offset_min, CASE WHEN CASE WHEN t.fires THEN t.m = 0 ELSE list_contains(ok, t.m) END THEN 'NEW_EVENT' WHEN t.fires AND t.m > 30 THEN 'DUPLICATE_PERSISTENT' ELSE 'DUPLICATE_CACHED' END AS dedup_status FROM t JOIN l USING (event_id)""")
def pipeline_ttl(spark, sf_dir):
    ev = from_table(spark, sf_dir).withColumn("offset_min", F.explode(F.array(*map(F.lit, (0, 10, 40, 80)))))
    ev = ev.withColumn("ts", F.timestamp_add("MINUTE", F.col("offset_min"), F.col("ts")))
    own = (Campaign("c", "click", RULE, actions=_NOTIFY[:1]), Campaign("d", "view", RULE))
    return pipeline.run(ev, own, table_fields(), stage=_shared(spark, "run"), ttl_ms=30 * 60_000).events.select("event_id", "offset_min", "dedup_status")


@query(f"""WITH {_EV}, o AS (SELECT o_custkey, sum(o_totalprice) AS spent FROM orders GROUP BY 1), x AS (SELECT ev.*, c_acctbal, spent FROM ev LEFT JOIN customer ON user_id = c_custkey LEFT JOIN o ON user_id = o_custkey)
SELECT event_id, coalesce(k > 40 AND (k > 95 OR c_acctbal > 4000) AND (k > 98 OR spent > 1000000), false) AS matched FROM x""")
def enriched_rule(spark, sf_dir):
    rule = And((
        Or((Leaf("payload.k", Op.GT, 98), Leaf("external.spent", Op.GT, 1_000_000, Source.EXTERNAL_SERVICE))), Leaf("payload.k", Op.GT, 40), Or((Leaf("payload.k", Op.GT, 95), Leaf("enriched.balance", Op.GT, 4000, Source.DATABASE))),
    ))
    base = table_fields()
    after = fieldfn.Fields(base.payload, None, base.event, base.typed | {"enriched.balance": (F.col("c_acctbal"), "double"), "external.spent": (F.col("spent"), "double")})
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("user_id"), "c_acctbal")
    spent = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.col("o_custkey").alias("user_id")).agg(F.sum("o_totalprice").alias("spent"))
    out = enrichment.staged_match(from_table(spark, sf_dir), rule, base, lambda e: enrichment.enrich(e, customer, "user_id"), lambda e: enrichment.enrich(e, spent, "user_id"), after)
    return out.select("event_id", "matched")


@query("""SELECT e.event_id, o.o_orderkey FROM events e ASOF LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS o_orderkey, o_orderdate::TIMESTAMP AS ts FROM orders GROUP BY o_custkey, o_orderdate) o ON e.user_id = o.o_custkey AND e.ts >= o.ts""")
def enrich_as_of(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.col("o_custkey").alias("user_id"), F.col("o_orderdate").cast("timestamp").alias("ts")).agg(F.min("o_orderkey").alias("o_orderkey"))
    return enrichment.as_of(from_table(spark, sf_dir), orders, "user_id").select("event_id", "o_orderkey")


# --- streams


@query("SELECT event_id, event_type FROM events")
def stream_dedup(spark, sf_dir):
    from .streaming.engine import deduplicated

    out = _shared(spark, "out")
    rows = _doubled(from_table(spark, sf_dir)).select("event_id", "event_type", "ts")
    path = _shared(spark, "in")
    rows.write.parquet(path)
    stream = deduplicated(spark.readStream.schema(rows.schema).parquet(path))
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select("event_id", "event_type")


@query(f"""WITH {_EV}, {_CM}, {_SENT}, base AS (SELECT *, 0 AS arrival FROM ev), {_gates("e0", "base", "arrival, ts, event_id")},
fired AS (SELECT DISTINCT event_id FROM e0 JOIN a USING (campaign_id) WHERE triggered AND sent),
again AS (SELECT event_id, ts + INTERVAL 10 MINUTE AS ts, user_id, event_type, value, k, 1 AS arrival FROM ev WHERE event_id % 5 = 0 AND event_id NOT IN (SELECT event_id FROM fired)),
everything AS (SELECT * FROM base UNION ALL SELECT * FROM again), {_gates("e", "everything", "arrival, ts, event_id")}
SELECT (SELECT count(*) + count(*) FILTER (event_id % 3 = 0) + count(*) FILTER (event_id % 5 = 0) FROM events) AS events_received, (SELECT count(*) FROM everything) AS events_processed,
 (SELECT count(*) FILTER (event_id % 3 = 0) + count(*) FILTER (event_id % 5 = 0) - (SELECT count(*) FROM again) FROM events) AS duplicates_filtered, {_COUNTED}""")
def stream_pipeline(spark, sf_dir):
    """Every third event comes again after a second, in its batch, and every fifth after ten minutes, in the last: after its window, so that only those that fired are duplicates."""
    from .streaming.engine import Builder

    ev = from_table(spark, sf_dir)
    last = ev.agg(F.max("event_id")).first()[0] or 0
    first = _doubled(ev).withColumn("arrival", F.expr(f"int(event_id * 4 div {last + 1})"))
    again = ev.filter("event_id % 5 = 0").withColumn("ts", F.col("ts") + F.expr("INTERVAL 10 MINUTES")).withColumn("arrival", F.lit(4))
    rows, path = first.unionByName(again), _shared(spark, "in")
    engine = Builder.defaults(spark).campaigns(METERED).fields(table_fields()).state(_shared(spark, "state")).build()
    for i in range(5):  # all files of an arrival, which many tasks write, are one batch
        rows.filter(F.col("arrival") == i).write.mode("append").parquet(path)
        engine.start(spark.readStream.schema(rows.schema).parquet(path), once=True).wait()
    return engine.metrics()
