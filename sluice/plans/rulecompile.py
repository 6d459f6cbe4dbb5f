"""Rules as columns: whether they match, how many leaves are evaluated, and whether one can't be compared."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.fields import Fields, Value
from ..functions.jsoncodec import java_text
from ..model import And, Leaf, Not, Op, Or, Rule, Source
from .ruleplan import leaves, optimize


def _false() -> Column:
    return F.lit(False)


_ORDERED = {Op.GT: lambda a, b: a > b, Op.GTE: lambda a, b: a >= b, Op.LT: lambda a, b: a < b, Op.LTE: lambda a, b: a <= b}


@dataclass(frozen=True)
class Compiled:
    """matched and error are never null; evaluated counts the leaves that short-circuiting visits."""

    matched: Column
    evaluated: Column
    error: Column
    total: int

    @property
    def skipped(self) -> Column:
        return F.lit(self.total) - self.evaluated

    def result(self) -> Column:
        return F.struct(self.matched.alias("matched"), self.evaluated.alias("evaluated"), self.skipped.alias("skipped"), self.error.alias("error"))


def folded(c: Column) -> Column:
    """Case folding that holds letter by letter."""
    return F.lower(F.upper(c))


def in_parts(text: str) -> list[str]:
    """The members of a comma-separated list: trimmed of blanks and control characters, empty ones at the end dropped."""
    parts = text.split(",")
    while len(parts) > 1 and not parts[-1]:
        parts.pop()
    blank = "".join(map(chr, range(0x21)))
    return [p.strip(blank) for p in parts] if any(parts) or text == "" else []


def _numeric(v: Column, op: Op, literal: float) -> Column | None:
    """IEEE comparison, in which nothing equals NaN; None where the operator has no numeric meaning."""
    x = F.lit(float(literal))
    nan = F.isnan(v) | F.isnan(x)
    if op is Op.EQ:
        return ~nan & (v == x)
    if op is Op.NEQ:
        return nan | (v != x)
    if op in _ORDERED:
        return ~nan & _ORDERED[op](v, x)
    return None


def _textual(v: Column, op: Op, literal: str) -> Column | None:
    if op is Op.EQ:
        return folded(v) == folded(F.lit(literal))
    if op is Op.NEQ:
        return folded(v) != folded(F.lit(literal))
    if op is Op.CONTAINS:
        return F.contains(v, F.lit(literal))
    if op is Op.IN:
        parts = in_parts(literal)
        return folded(v).isin([p.upper().lower() for p in parts]) if parts else _false()
    return None


def _choose(number: bool | Column, yes: Column | None, no: Column | None) -> tuple[Column, Column]:
    """Match and error of a comparison whose kind depends on the value."""
    match_of = lambda c: _false() if c is None else F.coalesce(c, _false())
    if isinstance(number, bool):
        own = yes if number else no
        return match_of(own), F.lit(own is None)
    return F.when(number, match_of(yes)).otherwise(match_of(no)), F.when(number, F.lit(yes is None)).otherwise(F.lit(no is None))


def _leaf(leaf: Leaf, value: Value | None, list_values: bool) -> tuple[Column, Column]:
    if value is None:
        return _false(), _false()
    is_number = isinstance(leaf.value, int | float) and not isinstance(leaf.value, bool)
    if list_values and leaf.op is Op.IN and isinstance(leaf.value, list | tuple):
        hit = folded(value.text).isin([java_text(x).upper().lower() for x in leaf.value])
        return F.coalesce(value.present & hit, _false()), _false()
    text = _textual(value.text, leaf.op, java_text(leaf.value))
    if is_number:
        match_, error = _choose(value.number, _numeric(value.double, leaf.op, leaf.value), text)
    else:
        match_, error = _choose(False, None, text)
    present = F.coalesce(value.present, _false())
    return present & match_, present & error


def compile_rule(rule: Rule, fields: Fields, on_error: str = "false", list_values: bool = False) -> Compiled:
    """One boolean plan for the rule, cheap operands first.

    A field that is absent makes its leaf false before any comparison. on_error: "false" makes a comparison without
    meaning false and sets error; "raise" ends the query at the first such row.
    """

    def walk(node: Rule) -> tuple[Column, Column, Column]:
        if isinstance(node, Leaf):
            match_, error = _leaf(node, fields.resolve(node.field), list_values)
            if on_error == "raise":
                match_ = F.when(error, F.raise_error(F.lit(f"{node.op.value} can't compare {node.field}")).cast("boolean")).otherwise(match_)
            return match_, F.lit(1), error
        if isinstance(node, Not):
            match_, n, error = walk(node.child)
            return ~match_, n, error
        parts = [walk(c) for c in node.children]
        both = isinstance(node, And)
        if not parts:
            return F.lit(both), F.lit(0), _false()
        match_ = reduce((lambda a, b: a & b) if both else (lambda a, b: a | b), [p[0] for p in parts])
        n, error = parts[-1][1], parts[-1][2]
        for m, own_n, own_error in reversed(parts[:-1]):
            goes_on = m if both else ~m
            n = own_n + F.when(goes_on, n).otherwise(0)
            error = own_error | (goes_on & error)
        return match_, n, error

    match_, n, error = walk(optimize(rule))
    return Compiled(match_, n, error, leaves(rule))


def compile_partial(rule: Rule, fields: Fields, known: set[Source]) -> Column:
    """The rule with leaves of other sources unknown: true or false where those can't change it, null where they can."""

    def walk(node: Rule) -> Column:
        if isinstance(node, Leaf):
            return _leaf(node, fields.resolve(node.field), False)[0] if node.source in known else F.lit(None).cast("boolean")
        if isinstance(node, Not):
            return ~walk(node.child)
        parts = [walk(c) for c in node.children]
        both = isinstance(node, And)
        return reduce((lambda a, b: a & b) if both else (lambda a, b: a | b), parts) if parts else F.lit(both)

    return walk(optimize(rule))


def compile_campaign_rules(rules: dict[str, Rule], fields: Fields, on_error: str = "false", key: str = "campaign_id") -> tuple[Column, Column, Column]:
    """matched, evaluated and error of each row's own rule; equal rules are compiled once."""
    same: dict[Rule, list[str]] = {}
    for name, rule in rules.items():
        same.setdefault(rule, []).append(name)
    matched, evaluated, error = _false(), F.lit(0), _false()
    for rule, names in same.items():
        c, mine = compile_rule(rule, fields, on_error), F.col(key).isin(names)
        matched, evaluated, error = F.when(mine, c.matched).otherwise(matched), F.when(mine, c.evaluated).otherwise(evaluated), F.when(mine, c.error).otherwise(error)
    return matched, evaluated, error
