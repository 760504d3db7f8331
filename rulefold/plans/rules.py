"""The rule language: restrict(location), when(condition), require(condition), nested freely."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from rulefold.functions import units as U
from rulefold.functions.expr import Expr, record_field
from rulefold.functions.location import Location


@dataclass(frozen=True, eq=False)
class Rule:
    """A statement; `origin` is where it was written and no part of its identity."""

    origin: str | None

    def __str__(self) -> str:
        return "\n".join(lines(self))


@dataclass(frozen=True, eq=False)
class Restrict(Rule):
    location: Location
    body: tuple[Rule, ...]


@dataclass(frozen=True, eq=False)
class When(Rule):
    condition: Expr
    body: tuple[Rule, ...]


@dataclass(frozen=True, eq=False)
class Require(Rule):
    condition: Expr


def _origin() -> str:
    frame = inspect.currentframe().f_back.f_back
    return f"{frame.f_code.co_filename.rsplit('/', 1)[-1]}:{frame.f_lineno}"


def restrict(location: Location, *body: Rule) -> Restrict:
    """Rules for what is bound for a location."""
    return Restrict(_origin(), location, tuple(body))


def when(condition: Expr, *body: Rule) -> When:
    """Rules for what meets a condition. Without any, everything that comes this far is allowed."""
    U.same(condition.dimension, U.BOOL, "as a condition")
    return When(_origin(), condition, tuple(body))


def require(condition: Expr) -> Require:
    """Allowed where the condition holds, denied with its text where it does not."""
    U.same(condition.dimension, U.BOOL, "as a condition")
    return Require(_origin(), condition)


def key(rule: Rule) -> tuple:
    """Structure alone, for comparisons."""
    if isinstance(rule, Require):
        return ("require", rule.condition.key())
    head = ("restrict", rule.location) if isinstance(rule, Restrict) else ("when", rule.condition.key())
    return (*head, *map(key, rule.body))


def lines(rule: Rule, depth: int = 0) -> Iterator[str]:
    pad = "  " * depth
    if isinstance(rule, Require):
        yield f"{pad}require({rule.condition})"
        return
    yield f"{pad}{'restrict' if isinstance(rule, Restrict) else 'when'}({rule.location if isinstance(rule, Restrict) else rule.condition}) {{"
    for child in rule.body:
        yield from lines(child, depth + 1)
    yield pad + "}"


def with_body(rule: Restrict | When, body) -> Restrict | When:
    if isinstance(rule, Restrict):
        return Restrict(rule.origin, rule.location, tuple(body))
    return When(rule.origin, rule.condition, tuple(body))


def size(rule: Rule) -> int:
    return 1 + sum(map(size, getattr(rule, "body", ())))


class vessel:  # noqa: N801
    """Fields of the vessel record."""

    mmsi = record_field("vessel", "mmsi", U.TEXT)
    name = record_field("vessel", "name", U.TEXT)
    type = record_field("vessel", "type", U.TEXT)
    direction = record_field("vessel", "direction", U.TEXT)
    time = record_field("vessel", "time", U.TIMESTAMP)
    draught = record_field("vessel", "draught", U.LENGTH)
    beam = record_field("vessel", "beam", U.LENGTH)
    length = record_field("vessel", "length", U.LENGTH)
    destination = record_field("vessel", "destination", U.TEXT)
    portcall_id = record_field("vessel", "portcall_id", U.TEXT)


class berth:  # noqa: N801
    """Fields of the berth record."""

    length = record_field("berth", "length", U.LENGTH)
    width = record_field("berth", "width", U.LENGTH)
    draught = record_field("berth", "draught", U.LENGTH)


class wind:  # noqa: N801
    velocity = record_field("wind", "velocity", U.VELOCITY)
    direction = record_field("wind", "direction", U.ANGLE)


class tide:  # noqa: N801
    height = record_field("tide", "height", U.LENGTH)
    high_water = record_field("tide", "high_water", U.LENGTH)
    low_water = record_field("tide", "low_water", U.LENGTH)


class tidal_stream:  # noqa: N801
    rate = record_field("tidal_stream", "rate", U.VELOCITY)
    direction = record_field("tidal_stream", "direction", U.ANGLE)


INBOUND, OUTBOUND = "Inbound", "Outbound"


def walk(rule: Rule) -> Iterator[Rule]:
    """The statement and all within it, outer ones first."""
    yield rule
    for child in getattr(rule, "body", ()):
        yield from walk(child)


def transform(rule: Rule, change: Callable[[Rule], Rule | None]) -> Rule | None:
    """The tree with `change` made to every statement, inner ones first; where it gives None the statement goes. A statement
    whose whole body goes, goes too: an empty body would allow."""
    body = getattr(rule, "body", ())
    if body:
        kept = tuple(x for child in body if (x := transform(child, change)) is not None)
        if not kept:
            return None
        rule = with_body(rule, kept)
    return change(rule)


def with_condition(rule: Rule, condition: Expr) -> Rule:
    """The same statement under another condition; a restriction has none and stays."""
    if isinstance(rule, When):
        return When(rule.origin, condition, rule.body)
    return Require(rule.origin, condition) if isinstance(rule, Require) else rule
