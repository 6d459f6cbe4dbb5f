"""Rules from JSON."""

from __future__ import annotations

from ..functions.jsoncodec import JsonError, parse
from ..model import And, Leaf, Not, Op, Or, Rule, Source


class RuleParseError(ValueError):
    """A rule definition that can't be read."""


def parse_rule_text(text: str) -> Rule:
    try:
        return parse_rule(parse(text))
    except JsonError as e:
        raise RuleParseError(str(e)) from e


def parse_rule(node: object) -> Rule:
    """A rule from nested maps: type AND or OR with children, NOT with child, CONDITION with field, op, value, source."""
    if not isinstance(node, dict):
        raise RuleParseError("a rule must be a map")
    kind = node.get("type")
    if kind is None:
        raise RuleParseError("a rule needs a type")
    read = _READERS.get(str(kind).upper())
    if read is None:
        raise RuleParseError(f"unknown rule type {kind}")
    return read(node)


def _children(node: dict) -> tuple[Rule, ...]:
    found = node.get("children")
    if found is None:
        return ()
    if not isinstance(found, list):
        raise RuleParseError("children must be a list")
    return tuple(map(parse_rule, found))


def _negation(node: dict) -> Rule:
    if not isinstance(node.get("child"), dict):
        raise RuleParseError("NOT needs a child map")
    return Not(parse_rule(node["child"]))


def _named(value: object, kinds: type, what: str):
    try:
        return kinds[str(value).upper()]
    except KeyError:
        raise RuleParseError(f"unknown {what} {value}") from None


def _condition(node: dict) -> Rule:
    missing = [k for k in ("field", "op") if node.get(k) is None]
    if missing:
        raise RuleParseError(f"a condition needs {missing[0]}")
    source = Source.MEMORY if node.get("source") is None else _named(node["source"], Source, "source")
    return Leaf(str(node["field"]), _named(node["op"], Op, "operator"), node.get("value"), source)


_READERS = {"AND": lambda n: And(_children(n)), "OR": lambda n: Or(_children(n)), "NOT": _negation, "CONDITION": _condition}
