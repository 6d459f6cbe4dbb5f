"""Weights of rules, and their order of evaluation."""

from __future__ import annotations

from ..model import And, Leaf, Not, Or, Rule


def max_weight(rule: Rule) -> int:
    """The cost of the dearest field that a rule may read."""
    match rule:
        case Leaf():
            return rule.source.value
        case Not():
            return max_weight(rule.child)
        case And() | Or():
            return max(map(max_weight, rule.children), default=0)
    raise TypeError(rule)


def leaves(rule: Rule) -> int:
    match rule:
        case Leaf():
            return 1
        case Not():
            return leaves(rule.child)
        case And() | Or():
            return sum(map(leaves, rule.children))
    raise TypeError(rule)


def depth(rule: Rule) -> int:
    match rule:
        case Leaf():
            return 1
        case Not():
            return 1 + depth(rule.child)
        case And() | Or():
            return 1 + max(map(depth, rule.children), default=0)
    raise TypeError(rule)


def optimize(rule: Rule) -> Rule:
    """The same rule with cheap operands first at every level; equals keep their order."""
    match rule:
        case Not():
            return Not(optimize(rule.child))
        case And() | Or():
            return type(rule)(tuple(sorted(map(optimize, rule.children), key=max_weight)))
    return rule


def describe(rule: Rule) -> dict[str, int]:
    return {"leaves": leaves(rule), "depth": depth(rule), "max_weight": max_weight(rule)}
