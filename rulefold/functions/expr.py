"""Rule expressions: small trees that know their dimension, the records they need, their text, and their Column.

Columns follow one rule about absent data: an expression needs every record it mentions, even in a branch that logic
would not look at. `present` is that guard; compilers use it beside the value.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from rulefold.functions import units as U
from rulefold.functions.units import Quantity


@dataclass(frozen=True, eq=False)
class Expr:
    """A node: operation, operands, dimension; `origin` (where it was written) is not part of its identity."""

    op: str
    args: tuple = ()
    dimension: str = U.SCALAR
    value: object = None
    build: Callable[..., Column] | None = field(default=None, repr=False)
    origin: str | None = field(default=None, repr=False)

    # identity: structure alone
    def key(self) -> tuple:
        return (self.op, self.dimension, self.value, *(a.key() for a in self.args))

    def same(self, other: Expr) -> bool:
        return self.key() == other.key()

    # columns
    def column(self) -> Column:
        return self.build(*(a.column() for a in self.args))

    def sources(self) -> frozenset[str]:
        own = frozenset([self.value[0]]) if self.op == "field" else frozenset()
        return own.union(*(a.sources() for a in self.args))

    def fields(self) -> frozenset[tuple[str, str]]:
        own = frozenset([self.value]) if self.op == "field" else frozenset()
        return own.union(*(a.fields() for a in self.args))

    def present(self) -> Column:
        if self.absent():
            return F.lit(False)
        return reduce(lambda a, b: a & b, (F.col(s).isNotNull() for s in sorted(self.sources())), F.lit(True))

    def absent(self) -> bool:
        """Whether a void stands in it, so that it never has a value."""
        return self.op == "void" or any(a.absent() for a in self.args)

    def holds(self) -> Column:
        """True where all records are there and the condition is true; never null."""
        return self.present() & F.coalesce(self.column(), F.lit(False))

    # arithmetic
    def __add__(self, other):
        return _binary("+", self, other, U.same(self.dimension, _lift(other).dimension, "+"), lambda a, b: a + b)

    def __sub__(self, other):
        return _binary("-", self, other, U.same(self.dimension, _lift(other).dimension, "-"), lambda a, b: a - b)

    def __mul__(self, other):
        return _binary("*", self, other, U.product(self.dimension, _lift(other).dimension), lambda a, b: a * b)

    def __rmul__(self, other):
        return _lift(other) * self

    def __truediv__(self, other):
        """Division; by zero it is absent (null), where ANSI arithmetic would raise."""
        return _binary("/", self, other, U.quotient(self.dimension, _lift(other).dimension), lambda a, b: F.try_divide(a.cast("double"), b.cast("double")))

    def __neg__(self):
        return Expr("neg", (self,), self.dimension, build=lambda a: -a)

    def __abs__(self):
        return Expr("abs", (self,), self.dimension, build=F.abs)

    def signum(self) -> Expr:
        return Expr("signum", (self,), U.SCALAR, build=lambda a: F.signum(a).cast("int"))

    def compare(self, other) -> Expr:
        U.same(self.dimension, _lift(other).dimension, "compare")
        return _binary("compare", self, other, U.SCALAR, lambda a, b: F.when(a < b, -1).when(a > b, 1).when(a == b, 0))

    # comparison
    def __lt__(self, other):
        return _condition("<", self, other, lambda a, b: a < b)

    def __le__(self, other):
        return _condition("<=", self, other, lambda a, b: a <= b)

    def __gt__(self, other):
        return _condition(">", self, other, lambda a, b: a > b)

    def __ge__(self, other):
        return _condition(">=", self, other, lambda a, b: a >= b)

    def is_(self, other) -> Expr:
        return _condition("is", self, other, lambda a, b: a == b)

    # logic
    def __and__(self, other):
        return _logic("and", self, other, lambda a, b: a & b)

    def __or__(self, other):
        return _logic("or", self, other, lambda a, b: a | b)

    def __invert__(self):
        U.same(self.dimension, U.BOOL, "not")
        return Expr("not", (self,), U.BOOL, build=lambda a: ~a)

    def map(self, name: str, function: Callable[[Column], Column], dimension: str) -> Expr:
        """A named function of the value."""
        return Expr("call", (self,), dimension, name, function)

    def __bool__(self):
        raise TypeError("combine conditions with & | ~, not with and, or, not")

    def __str__(self) -> str:
        return text(self)


def _lift(x: object) -> Expr:
    return x if isinstance(x, Expr) else const(x)


def const(x: object) -> Expr:
    """A literal: a Quantity, number, boolean or text."""
    if isinstance(x, Quantity):
        return Expr("const", (), x.dimension, (x.value, x.text), lambda: F.lit(x.value))
    dimension = U.BOOL if isinstance(x, bool) else U.TEXT if isinstance(x, str) else U.SCALAR
    shown = str(x).lower() if isinstance(x, bool) else f"{x:g}" if isinstance(x, float) else str(x)
    return Expr("const", (), dimension, (x, shown), lambda: F.lit(x))


def record_field(record: str, name: str, dimension: str) -> Expr:
    """A field of a record column, such as vessel.draught."""
    return Expr("field", (), dimension, (record, name), lambda: F.col(f"{record}.{name}"))


def named(name: str, e: Expr) -> Expr:
    """A label in the text; the value is unchanged."""
    return Expr("named", (e,), e.dimension, name, lambda a: a)


def void(dimension: str) -> Expr:
    """What never has a value: a condition with it has no result for any vessel."""
    return Expr("void", (), dimension, build=lambda: F.lit(None))


def apply(name: str, function: Callable[..., Column], dimension: str, *args: Expr) -> Expr:
    """A named function of several expressions."""
    return Expr("call", tuple(args), dimension, name, function)


def _binary(op: str, a: Expr, b: object, dimension: str, build: Callable) -> Expr:
    return Expr(op, (a, _lift(b)), dimension, build=build)


def _condition(op: str, a: Expr, b: object, build: Callable) -> Expr:
    U.same(a.dimension, _lift(b).dimension, op)
    return _binary(op, a, b, U.BOOL, build)


def _logic(op: str, a: Expr, b: object, build: Callable) -> Expr:
    U.same(a.dimension, U.BOOL, op)
    U.same(_lift(b).dimension, U.BOOL, op)
    return _binary(op, a, b, U.BOOL, build)


#: How tightly operators bind in text.
_BINDING = {"or": 1, "and": 2, "not": 3, "is": 4, "<": 4, "<=": 4, ">": 4, ">=": 4, "compare": 4, "+": 5, "-": 5, "*": 6, "/": 6, "neg": 7}


def text(e: Expr) -> str:
    """The expression as a user would write it, with no more parentheses than needed."""

    def inner(x: Expr, least: int) -> str:
        shown = text(x)
        return f"({shown})" if _BINDING.get(x.op, 9) < least else shown

    if e.op == "const":
        return e.value[1]
    if e.op == "void":
        return "void"
    if e.op == "field":
        return ".".join(e.value)
    if e.op == "named":
        return e.value
    if e.op == "call":
        return f"{e.value}({', '.join(map(text, e.args))})"
    if e.op in ("abs", "signum"):
        return f"{e.op}({text(e.args[0])})"
    bind = _BINDING[e.op]
    if e.op == "not":
        return f"not {inner(e.args[0], bind)}"
    if e.op == "neg":
        return f"-{inner(e.args[0], bind)}"
    # operators group to the left; those that may be regrouped need no parentheses on the right
    return f"{inner(e.args[0], bind)} {e.op} {inner(e.args[1], bind if e.op in ('and', 'or', '+', '*') else bind + 1)}"
