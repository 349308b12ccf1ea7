"""Exact Shapley attributions of boosted trees, leaf by leaf, from the stored form of a fitted model."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskgraph.operators.graph import scratch


class Leaf(NamedTuple):
    """A leaf's value, and for each feature on the way to it the range (over, up to] that leads on and the share of rows that do."""

    value: float
    ways: dict[int, tuple[float, float, float]]


def leaves(model) -> list[Leaf]:
    """Leaves of all trees of a fitted boosted classifier over numbers, their values in log-odds.

    The model is written to the shared folder and read back as the table of nodes it is stored as; trees are small, so the driver
    holds them as it holds the model.
    """
    spark = SparkSession.getActiveSession()
    path = scratch(spark)
    model.write().save(path)
    nodes = defaultdict(dict)
    for r in spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect():
        nodes[r.treeID][r.id] = r
    out: list[Leaf] = []
    for tree, weight in enumerate(model.treeWeights):
        todo = [(0, {})]
        while todo:
            at, ways = todo.pop()
            node = nodes[tree][at]
            if node.leftChild < 0:
                out.append(Leaf(2 * weight * node.prediction, ways))
                continue
            feature, limit = node.split.featureIndex, node.split.leftCategoriesOrThreshold[0]
            low, high, share = ways.get(feature, (-math.inf, math.inf, 1.0))
            count = node.impurityStats[0]
            for child, bounds in ((node.leftChild, (low, min(high, limit))), (node.rightChild, (max(low, limit), high))):
                todo.append((child, ways | {feature: (*bounds, share * nodes[tree][child].impurityStats[0] / max(count, 1e-300))}))
    return out


def shapley(found: list[Leaf], values: np.ndarray) -> np.ndarray:
    """Attributions of every row and feature. Where a set of features is known a leaf is worth its value if they all lead to it,
    times the shares of rows that the others lead there; each feature gets its mean part over all orders."""
    out = np.zeros(values.shape)
    for value, ways in found:
        features, m = list(ways), len(ways)
        leads = {f: ((values[:, f] > ways[f][0]) & (values[:, f] <= ways[f][1])).astype(float) for f in features}
        for f in features:
            others = [x for x in features if x != f]
            total = np.zeros(len(values))
            for n in range(m):
                part = math.factorial(n) * math.factorial(m - n - 1) / math.factorial(m)
                for known in combinations(others, n):
                    worth = np.full(len(values), part)
                    for x in others:
                        worth *= leads[x] if x in known else ways[x][2]
                    total += worth
            out[:, f] += value * total * (leads[f] - ways[f][2])
    return out


def base_value(found: list[Leaf]) -> float:
    """What is scored of a row of which nothing is known, in log-odds."""
    return sum(leaf.value * math.prod(share for _, _, share in leaf.ways.values()) for leaf in found)


def attributions(rows: DataFrame, model, features: list[str]) -> DataFrame:
    """account, feature, contribution (log-odds) and value for every row and feature; a row's contributions and base_value() add
    up to its score. The trees go to the tasks with the code; rows are independent of one another."""
    found = leaves(model)
    names = np.array(features, object)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            values = frame[features].to_numpy(float)
            yield pd.DataFrame({"account": np.repeat(frame["account"].to_numpy(), len(features)), "feature": np.tile(names, len(frame)), "contribution": shapley(found, values).ravel(), "value": values.ravel()})

    held = rows.select("account", *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features))
    return held.mapInPandas(run, "account long, feature string, contribution double, value double")
