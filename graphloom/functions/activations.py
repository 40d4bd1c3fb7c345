"""Activations as column expressions; ``softmax`` works on whole rows and lives in operators.linalg."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

def _relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


SCALARS: dict[str, Callable[[Column], Column]] = {
    "linear": lambda x: x,
    "relu": _relu,
    "elu": lambda x: F.when(x >= 0, x).otherwise(F.expm1(x)),
    "sigmoid": lambda x: 1 / (1 + F.exp(-x)),
    "tanh": F.tanh,
    "softplus": lambda x: F.log1p(F.exp(x)),
    "leaky_relu": lambda x: F.when(x >= 0, x).otherwise(0.2 * x),
    "hard_sigmoid": lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.2 * x + 0.5)),
    "softsign": lambda x: x / (1 + F.abs(x)),
    "exponential": F.exp,
}


def check(name: str | None) -> str:
    """The activation's name; None is linear."""
    name = "linear" if name is None else name
    if name not in SCALARS and name != "softmax":
        raise ValueError(f"unknown activation {name!r}")
    return name


def scalar(name: str | None, x: Column) -> Column:
    if check(name) == "softmax":
        raise ValueError("softmax needs the whole row")
    return SCALARS[check(name)](x)


def leaky_clipped(x: Column, low: float = 1.0, high: float = 5.0, alpha: float = 0.1) -> Column:
    """x, with slope ``alpha`` outside [low, high]."""
    gain = 1 - alpha
    return x + gain * _relu(F.lit(float(low)) - x) - gain * _relu(x - F.lit(float(high)))
