"""Vectorised work on many key groups at a time, where a call per group would cost more than the work."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def group_ids(pdf: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """0, 1, ... for each run of equal keys in rows that are sorted by them."""
    if not len(pdf):
        return np.zeros(0, "int64")
    new = np.zeros(len(pdf), bool)
    for k in keys:
        v = pdf[k].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.cumsum(new)


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str], fn: Callable[[pd.DataFrame], pd.DataFrame], least: int) -> Iterator[pd.DataFrame]:
    """Apply fn to pieces of a sorted stream that never cut a group; pieces have `least` rows or more, but the last."""
    held: list[pd.DataFrame] = []
    rows = 0
    for b in batches:
        if not len(b):
            continue
        held.append(b)
        rows += len(b)
        if rows < least:
            continue
        p = pd.concat(held, ignore_index=True)
        g = group_ids(p, keys)
        cut = int(np.searchsorted(g, g[-1]))
        if cut:
            yield fn(p.iloc[:cut].reset_index(drop=True))
            p = p.iloc[cut:].reset_index(drop=True)
        held, rows = [p], len(p)
    if rows:
        yield fn(pd.concat(held, ignore_index=True))


def map_groups(df: DataFrame, keys: list[str], order: list[str], fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, least: int = 20000) -> DataFrame:
    """Cluster df by keys, sort by keys and order, and apply fn to runs of whole groups.

    One shuffle. Groups have to be of bounded size: callers cut long keys into stretches first.
    Keys must not be null.
    """

    def run(batches):
        return whole_groups(batches, keys, fn, least)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
