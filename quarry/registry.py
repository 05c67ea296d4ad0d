"""Plug-ins: score functions and metric functions by name."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import scores

SCORES: dict[str, Callable[..., Column] | str | Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]] = {}
METRICS: dict[str, Callable[..., DataFrame]] = {}


def score(name: str, fn: Callable[..., Column] | str) -> None:
    """Registers a score: a function of columns that returns a column (SQL functions or a pandas_udf), or SQL text."""
    SCORES[name] = fn


def metric(name: str, fn: Callable[..., DataFrame]) -> None:
    """Registers a metric: a function (df, by) -> DataFrame with a row per group."""
    METRICS[name] = fn


def apply_score(df: DataFrame, name: str, *columns: str, to: str = "score") -> DataFrame:
    if name not in SCORES:
        raise KeyError(f"no score {name}; there are {sorted(SCORES)}")
    fn = SCORES[name]
    return df.withColumn(to, F.expr(fn) if isinstance(fn, str) else fn(*(F.col(c) for c in columns)))


def apply_to_batches(df: DataFrame, fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """A score that needs whole batches, as a model does."""
    return df.mapInPandas(fn, schema)


def bootstrap_metric(df: DataFrame, weights: DataFrame, name: str, **more: object) -> DataFrame:
    """A registered metric for every draw of weights (boot, frame_id, w); df has frame_id. The metric gets a weight."""
    return METRICS[name](df.join(weights, "frame_id"), ["boot"], weight="w", **more)


for _name in ("msp", "maxlogit", "energy", "nongreen"):
    score(_name, getattr(scores, _name))
