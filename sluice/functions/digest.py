"""A merging t-digest (Dunning and Ertl) as aggregate functions, for centroids that go in and out of saved statistics.

State is bounded by the compression, whatever the number of values. Partial digests are made where the rows are,
then merged by key: two-step aggregation with Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: centroids of a digest at most.
COMPRESSION = 1000
CENTROIDS = "array<struct<mean:double,weight:double>>"


def compress(mean: np.ndarray, weight: np.ndarray, size: int = COMPRESSION) -> tuple[np.ndarray, np.ndarray]:
    """Merge neighbours while a centroid spans at most one step of the arcsine scale."""
    if not len(mean):
        return mean, weight
    order = np.argsort(mean, kind="stable")
    mean, weight = mean[order], weight[order]
    if len(mean) <= size:
        return mean, weight
    total = weight.sum()
    left = np.concatenate([[0.0], np.cumsum(weight)[:-1]]) / total
    mid = left + weight / total / 2
    k = np.floor(size * (np.arcsin(np.clip(2 * mid - 1, -1, 1)) / np.pi + 0.5)).astype(int)
    k[0], k[-1] = -1, size + 1  # the ends stay exact
    cut = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    w = np.add.reduceat(weight, cut)
    return np.add.reduceat(mean * weight, cut) / w, w


def quantile(mean: np.ndarray, weight: np.ndarray, q: float) -> float:
    """Value at a share of the weight, between centroids' middles in a straight line."""
    if not len(mean):
        return float("nan")
    at = np.cumsum(weight) - weight / 2
    return float(np.interp(q * weight.sum(), at, mean))


def cdf(mean: np.ndarray, weight: np.ndarray, x: float) -> float:
    if not len(mean):
        return float("nan")
    at = np.cumsum(weight) - weight / 2
    return float(np.interp(x, mean, at / weight.sum(), left=0.0, right=1.0))


def _rows(mean: np.ndarray, weight: np.ndarray) -> list[dict]:
    return [{"mean": m, "weight": w} for m, w in zip(mean.tolist(), weight.tolist(), strict=True)]


#: Parts of a key whose digests are merged first.
PARTS = 64


def digest_by(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, centroids) of a column of values: a digest for each key and batch of rows, then one for each key."""
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, part in pdf.groupby(keys, dropna=False, sort=False):
                v = part[value].dropna().to_numpy(float)
                rows.append((*key, _rows(*compress(v, np.ones(len(v))))))
            yield pd.DataFrame(rows, columns=[*keys, "centroids"])

    return merge_by(df.select(*keys, value).mapInPandas(partial, f"{kinds}, centroids {CENTROIDS}"), keys)


def merge_by(df: DataFrame, keys: list[str], centroids: str = "centroids") -> DataFrame:
    """One digest for each key of a column of digests."""
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def final(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [c for c in pdf[centroids] if c is not None and len(c)]
        mean = np.array([x["mean"] for c in parts for x in c], float)
        weight = np.array([x["weight"] for c in parts for x in c], float)
        return pd.DataFrame([(*key, _rows(*compress(mean, weight)))], columns=[*keys, "centroids"])

    schema = f"{kinds}, centroids {CENTROIDS}"
    # first as many parts of each key as there are tasks that made digests, then these: no task gets all digests of a hot key
    parts = df.withColumn("_part", F.pmod(F.monotonically_increasing_id(), F.lit(PARTS)))
    some = parts.groupBy(*keys, "_part").applyInPandas(lambda key, pdf: final(key[:-1], pdf), schema)
    return some.groupBy(*keys).applyInPandas(final, schema)


def summary(mean: np.ndarray, weight: np.ndarray) -> list[float]:
    """Mean, the quantiles 0.5, 0.9, 0.95, 0.99, and the maximum of a digest."""
    if not len(mean):
        return [float("nan")] * 6
    return [float((mean * weight).sum() / weight.sum()), *(quantile(mean, weight, q) for q in (0.5, 0.9, 0.95, 0.99)), float(mean.max())]


def digest_quantiles(centroids: str):
    """The summary of each row's digest."""

    def run(col: pd.Series) -> pd.Series:
        return pd.Series([summary(np.array([x["mean"] for x in c], float), np.array([x["weight"] for x in c], float)) if c is not None else None for c in col])

    return F.pandas_udf(run, "array<double>")(centroids)


def kll_report(m: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Quantiles by the built-in mergeable sketch: bounded state, all in the JVM."""
    q = F.expr(f"kll_sketch_agg_double({value})")
    g = m.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.max(value).alias("max"), q.alias("s"))
    return g.select(*keys, "n", "mean", *[F.expr(f"kll_sketch_get_quantile_double(s, {p}D)").alias(f"p{round(p * 100)}") for p in (0.5, 0.9, 0.95, 0.99)], "max")
