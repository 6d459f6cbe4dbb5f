import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sluice.functions.fields import Fields
from sluice.functions.jsoncodec import JsonError, java_double, parse, serialize
from sluice.model import And, Leaf, Not, Op, Or, Source
from sluice.plans.rulecompile import compile_partial, compile_rule, in_parts
from sluice.plans.ruleparse import RuleParseError, parse_rule, parse_rule_text
from sluice.plans.ruleplan import describe, max_weight, optimize

from .interpreter import evaluate, total

PAYLOADS = [
    {"k": 5, "v": 1.5, "s": "Hanoi", "b": True, "n": None, "o": {"x": "VN", "y": 2.0}, "l": [1, "a"]},
    {"k": -3, "v": 150.0, "s": "hanoi", "b": False, "o": {}, "l": []},
    {"k": "5", "v": "1.5", "s": 5, "o": "flat"},
    {},
]
ENRICHED = {"tier": "gold", "score": 0.05, "n": "other", "s": "hidden"}
NAMES = ["k", "v", "s", "b", "n", "tier", "payload.o.x", "payload.o.y", "payload.k", "payload.l", "payload.o", "enriched.score", "external.tier", "foo.bar", "event.none", "payload.gone"]
VALUES = st.sampled_from([5, -3, 1.5, 0.05, 2.0, "5", "VN", "vn", "gold, VN ,5", "an", "", True, None, 150, "2.0", [1, "a"], "[1, a]", ","])
LEAVES = st.builds(Leaf, st.sampled_from(NAMES), st.sampled_from(list(Op)), VALUES, st.sampled_from(list(Source)))
RULES = st.recursive(LEAVES, lambda c: st.one_of(st.builds(And, st.lists(c, max_size=3).map(tuple)), st.builds(Or, st.lists(c, max_size=3).map(tuple)), st.builds(Not, c)), max_leaves=8)


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.createDataFrame([(i, json.dumps(p), json.dumps(ENRICHED)) for i, p in enumerate(PAYLOADS)], "id int, p string, e string")
    df = df.select("id", F.parse_json("p").alias("p"), F.parse_json("e").alias("e")).cache()
    df.count()
    return df


FIELDS = lambda: Fields(F.col("p"), F.col("e"), {})


@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(RULES, min_size=6, max_size=6))
def test_compiled_rules_equal_the_interpreter(rows, rules):
    compiled = [compile_rule(r, FIELDS()) for r in rules]
    got = {r["id"]: r for r in rows.select("id", *[c.result().alias(f"r{i}") for i, c in enumerate(compiled)]).collect()}
    for k, p in enumerate(PAYLOADS):
        for i, rule in enumerate(rules):
            matched, seen, bad = evaluate(rule, p, ENRICHED)
            r = got[k][f"r{i}"]
            assert (r["matched"], r["evaluated"], r["skipped"], r["error"]) == (matched, seen, total(rule) - seen, bad), (rule, p)


def test_partial_evaluation_never_contradicts_the_whole(spark, rows):
    rule = And((Leaf("k", Op.GT, 0), Or((Leaf("enriched.score", Op.GT, 1, Source.DATABASE), Leaf("s", Op.EQ, "hanoi")))))
    c = rows.select(compile_partial(rule, FIELDS(), {Source.MEMORY}).alias("part"), compile_rule(rule, FIELDS()).matched.alias("whole")).collect()
    assert all(r["part"] is None or r["part"] == r["whole"] for r in c)
    assert any(r["part"] is not None for r in c)


def test_weights_stats_and_errors(spark, rows):
    rule = And((Or((Leaf("s", Op.EQ, "Hanoi"), Leaf("payload.v", Op.GT, 999, Source.DATABASE))), Leaf("enriched.tier", Op.EQ, "gold", Source.EXTERNAL_SERVICE)))
    r = rows.filter("id = 0").select(compile_rule(rule, FIELDS()).result().alias("r")).first()["r"]
    assert (r["matched"], r["evaluated"], r["skipped"]) == (True, 2, 1)
    assert max_weight(rule) == 100 and max_weight(And()) == 0
    assert [max_weight(c) for c in optimize(And((Leaf("a", Op.EQ, 1, Source.EXTERNAL_SERVICE), Leaf("b", Op.EQ, 1)))).children] == [1, 100]
    assert describe(rule) == {"leaves": 3, "depth": 3, "max_weight": 100}
    with pytest.raises(Exception, match="compare"):
        rows.filter("id = 0").select(compile_rule(Leaf("s", Op.GT, "a"), FIELDS(), on_error="raise").matched).collect()


def test_nan_is_not_equal(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,)], "x double")
    f = Fields(typed={"x": (F.col("x"), "double")})
    got = df.select(*[compile_rule(Leaf("x", op, 1.0), f).matched.alias(op.value) for op in (Op.EQ, Op.NEQ, Op.GT, Op.LTE)]).collect()
    assert [tuple(r) for r in got] == [(False, True, False, False), (True, False, False, True)]


def test_list_members():
    assert in_parts(" a,\tb ,,c,,") == ["a", "b", "", "c"] and in_parts("") == [""] and in_parts(",") == []


def test_parse_rules():
    rule = parse_rule_text('{"type":"and","children":[{"type":"OR","children":[{"type":"condition","field":"f1","op":"eq","value":"v1"}]},{"type":"Not","child":{"type":"CONDITION","field":"f3","op":"gt","value":5,"source":"database"}}]}')
    assert rule == And((Or((Leaf("f1", Op.EQ, "v1"),)), Not(Leaf("f3", Op.GT, 5, Source.DATABASE))))
    assert parse_rule({"type": "AND"}) == And()


@pytest.mark.parametrize("bad", [None, {}, {"type": "XOR"}, {"type": "AND", "children": 3}, {"type": "AND", "children": [None]}, {"type": "NOT"}, {"type": "NOT", "child": []}, {"type": "CONDITION", "op": "EQ"}, {"type": "CONDITION", "field": "a"}, {"type": "CONDITION", "field": "a", "op": "LIKE"}, {"type": "CONDITION", "field": "a", "op": "EQ", "source": "DISK"}])
def test_bad_rules(bad):
    with pytest.raises(RuleParseError):
        parse_rule(bad)


@pytest.mark.parametrize(("text", "value"), [("42", 42), ("-17", -17), ("3.14", 3.14), ("01", 1), ("1e2", 100.0), ("true", True), (" null ", None), ("{}", {}), ("[]", []), ('{"a":1,"a":[1, {"b":"\\u00e9\\/\\n"}]}', {"a": [1, {"b": "é/\n"}]}), ('"a\tb"', "a\tb")])
def test_json_values(text, value):
    assert parse(text) == value and type(parse(text)) is type(value)


@pytest.mark.parametrize("bad", [None, "", "  ", "{invalid}", '"open', "42 extra", "[1,]", '{"a":1,}', '"\\q"', "9223372036854775808", "-", "tru"])
def test_bad_json(bad):
    with pytest.raises(JsonError):
        parse(bad)


def test_serialize():
    assert serialize({"a": [1, 2.0, None, True], "b": 'x"\n\x01é'}) == '{"a":[1,2.0,null,true],"b":"x\\"\\n\x01é"}'
    assert [java_double(x) for x in (1.0, 1e7, 1e-5, 123456.789, 1.5e-3, 1e10)] == ["1.0", "1.0E7", "1.0E-5", "123456.789", "0.0015", "1.0E10"]
    with pytest.raises(TypeError):
        serialize(object())
