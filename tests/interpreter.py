"""A rule evaluated on one event, as plainly as can be: what the compiled columns are held against."""

import math

from sluice.functions.jsoncodec import java_text
from sluice.model import And, Leaf, Not, Op, Or
from sluice.plans.rulecompile import in_parts
from sluice.plans.ruleplan import leaves, max_weight


def resolve(name, payload, enriched):
    head, dot, path = name.partition(".")
    if not dot:
        return payload[name] if name in payload else enriched.get(name)
    here = {"payload": payload, "enriched": enriched, "external": enriched}.get(head)
    for part in path.split("."):
        here = here.get(part) if isinstance(here, dict) else None
    return here


def fold(s):
    return s.upper().lower()


def compare(op, a, b):
    """True, False, or None where the operator has no meaning."""
    number = lambda x: isinstance(x, int | float) and not isinstance(x, bool)
    if number(a) and number(b):
        a, b = float(a), float(b)
        if op in (Op.IN, Op.CONTAINS):
            return None
        if math.isnan(a) or math.isnan(b):
            return op is Op.NEQ
        return {Op.EQ: a == b, Op.NEQ: a != b, Op.GT: a > b, Op.GTE: a >= b, Op.LT: a < b, Op.LTE: a <= b}[op]
    a, b = java_text(a), java_text(b)
    if op is Op.EQ:
        return fold(a) == fold(b)
    if op is Op.NEQ:
        return fold(a) != fold(b)
    if op is Op.CONTAINS:
        return b in a
    if op is Op.IN:
        return fold(a) in [fold(x) for x in in_parts(b)]
    return None


def evaluate(rule, payload, enriched):
    """matched, evaluated, error."""
    if isinstance(rule, Leaf):
        value = resolve(rule.field, payload, enriched)
        out = False if value is None else compare(rule.op, value, rule.value)
        return out is True, 1, out is None
    if isinstance(rule, Not):
        m, n, e = evaluate(rule.child, payload, enriched)
        return not m, n, e
    seen, bad = 0, False
    for child in sorted(rule.children, key=max_weight):
        m, n, e = evaluate(child, payload, enriched)
        seen, bad = seen + n, bad or e
        if m == isinstance(rule, Or):
            return m, seen, bad
    return isinstance(rule, And), seen, bad


def total(rule):
    return leaves(rule)
