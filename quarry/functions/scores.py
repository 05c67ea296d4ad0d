"""Anomaly scores as column expressions. Higher is more anomalous."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _double(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def msp(logits: Column) -> Column:
    """One minus the largest softmax probability."""
    top = F.array_max(_double(logits))
    return 1 - 1 / _sum(F.transform(_double(logits), lambda x: F.exp(x - top)))


def maxlogit(logits: Column) -> Column:
    return -F.array_max(_double(logits))


def energy(logits: Column) -> Column:
    """Minus the log of the sum of exponentials, at temperature 1."""
    top = F.array_max(_double(logits))
    return -(top + F.log(_sum(F.transform(_double(logits), lambda x: F.exp(x - top)))))


def argmax(v: Column) -> Column:
    """Zero-based place of the largest value; the first of equals."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def standardised(logit: Column, mean: Column, std: Column) -> Column:
    """Minus the largest logit, standardised for its predicted class."""
    return -(logit - mean) / std


def znorm(score: Column, mean: Column, std: Column) -> Column:
    return (score - mean) / (std + 1e-6)


def l2norm(v: Column, eps: float = 0.0) -> Column:
    norm = F.sqrt(_sum(F.transform(_double(v), lambda x: x * x))) + eps
    return F.transform(_double(v), lambda x: x / norm)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(_double(a), _double(b), lambda x, y: x * y))


def nongreen(r: Column, g: Column, b: Column) -> Column:
    """Minus the excess of green."""
    return -(g - 0.5 * (r + b))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def mixed_order(*parts: tuple[Column, int], modulus: int = 2_147_483_647) -> Column:
    """A pseudo-random order that other engines can compute too: a weighted sum of integers by a prime."""
    total = F.lit(0).cast("long")
    for c, weight in parts:
        total = total + c.cast("long") * F.lit(weight).cast("long")
    return total % modulus


def gaussian(key: Column) -> Column:
    """A standard normal value by a hash of the key (Box and Muller's transform of two uniform ones)."""

    def uniform(name: str) -> Column:
        digest = F.md5(F.concat(key.cast("string"), F.lit(f":{name}")))
        return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)

    return F.sqrt(-2 * F.log(uniform("a"))) * F.cos(2 * math.pi * uniform("b"))
