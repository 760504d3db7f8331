"""Dimensions and units: which products and quotients are legal, and constants in canonical units (m, m/s, deg, s, kg)."""

from __future__ import annotations

import math
from dataclasses import dataclass

SCALAR, BOOL, TEXT, TIMESTAMP = "scalar", "bool", "text", "timestamp"
LENGTH, TIME, VELOCITY, ACCELERATION = "length", "time", "velocity", "acceleration"
MASS, VOLUME, DENSITY = "mass", "volume", "density"
ANGLE, ANGULAR_VELOCITY = "angle", "angular velocity"
QUANTITIES = {LENGTH, TIME, VELOCITY, ACCELERATION, MASS, VOLUME, DENSITY, ANGLE, ANGULAR_VELOCITY}

#: Legal products of two quantities.
_PRODUCTS = {
    (VELOCITY, TIME): LENGTH,
    (TIME, VELOCITY): LENGTH,
    (TIME, ACCELERATION): VELOCITY,
    (ACCELERATION, TIME): VELOCITY,
    (DENSITY, VOLUME): MASS,
    (VOLUME, DENSITY): MASS,
    (ANGULAR_VELOCITY, TIME): ANGLE,
}
#: Legal quotients of two quantities of different dimensions.
_QUOTIENTS = {
    (LENGTH, TIME): VELOCITY,
    (LENGTH, VELOCITY): TIME,
    (VELOCITY, TIME): ACCELERATION,
    (VELOCITY, ACCELERATION): TIME,
    (MASS, VOLUME): DENSITY,
    (MASS, DENSITY): VOLUME,
    (ANGLE, TIME): ANGULAR_VELOCITY,
}


class DimensionError(TypeError):
    """An operation on dimensions that do not go together."""


def product(a: str, b: str) -> str:
    if SCALAR in (a, b) and {a, b} <= QUANTITIES | {SCALAR}:
        return b if a == SCALAR else a
    if (a, b) in _PRODUCTS:
        return _PRODUCTS[a, b]
    raise DimensionError(f"{a} * {b}")


def quotient(a: str, b: str) -> str:
    if b == SCALAR and a in QUANTITIES | {SCALAR}:
        return a
    if a == b and a in QUANTITIES:
        return SCALAR
    if (a, b) in _QUOTIENTS:
        return _QUOTIENTS[a, b]
    raise DimensionError(f"{a} / {b}")


def same(a: str, b: str, what: str) -> str:
    if a != b:
        raise DimensionError(f"{a} {what} {b}")
    return a


@dataclass(frozen=True)
class Quantity:
    """A constant in canonical units, with the text it was given as."""

    value: float
    dimension: str
    text: str


def _unit(dimension: str, factor: float, name: str):
    def make(value: float) -> Quantity:
        return Quantity(float(value) * factor, dimension, f"{value:g} {name}")

    make.__doc__ = f"A {dimension} in {name}."
    return make


metres = _unit(LENGTH, 1, "m")
centimetres = _unit(LENGTH, 0.01, "cm")
seconds = _unit(TIME, 1, "s")
minutes = _unit(TIME, 60, "min")
hours = _unit(TIME, 3600, "h")
metres_per_second = _unit(VELOCITY, 1, "m/s")
knots = _unit(VELOCITY, 1852 / 3600, "kn")
degrees = _unit(ANGLE, 1, "deg")
radians = _unit(ANGLE, 180 / math.pi, "rad")
degrees_per_second = _unit(ANGULAR_VELOCITY, 1, "deg/s")
kilograms = _unit(MASS, 1, "kg")
cubic_metres = _unit(VOLUME, 1, "m3")
