"""Contributions of features to the margin of fitted trees: path-dependent Shapley values, exact, and as many as there are rows.

Trees are read from what Spark ML writes of a model, as an array of nodes. A leaf adds its value to a row if all features on
its path agree (every split on the feature is met); for a set of features that are unknown, it counts with the shares of
training weight that took the path at their splits. So a leaf's Shapley values depend on a row only through *which* of the path's
features agree: a table of 2^d patterns by d features, made once a leaf. A row then looks up one pattern a leaf, in numpy,
batch by batch. Contributions and the base value add up to the margin.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.storage import shared_folder

#: Rows explained at a time.
ROWS = 4096


@dataclass(frozen=True)
class Leaf:
    """The features of a path, their lower and upper bounds (low < x <= high) and the table of contributions by pattern."""

    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    table: np.ndarray
    expected: float


def shapley_table(value: float, shares: list[float]) -> np.ndarray:
    """Contributions of a leaf's features (columns) by the pattern of those that agree (rows, bit by bit)."""
    d = len(shares)
    worth = np.empty(1 << d)  # of a set of known features, if all of them agree: the others count with their shares
    for known in range(1 << d):
        worth[known] = value * math.prod(s for k, s in enumerate(shares) if not known >> k & 1)
    sets = np.arange(1 << d)
    reached = np.where(sets[None, :] & ~sets[:, None], 0.0, worth[None, :])  # by what agrees and what is known
    weight = np.array([math.factorial(n) * math.factorial(d - n - 1) / math.factorial(d) for n in range(d)])
    out = np.zeros((1 << d, d))
    for k in range(d):
        without = sets[sets >> k & 1 == 0]
        out[:, k] = (reached[:, without | 1 << k] - reached[:, without]) @ weight[np.bitwise_count(without)]
    return out


def leaves_of(nodes: list[dict], value_of, scale: float) -> Iterator[Leaf]:
    """The leaves of one tree; ``nodes`` by id with their weight (``cover``), split and children."""
    by_id = {n["id"]: n for n in nodes}

    def walk(at: int, bounds: dict[int, tuple[float, float, float]]) -> Iterator[Leaf]:
        node = by_id[at]
        if node["left"] < 0:
            features = sorted(bounds)
            low, high, shares = ([bounds[f][i] for f in features] for i in range(3))
            value = scale * value_of(node)
            yield Leaf(np.array(features, int), np.array(low), np.array(high), shapley_table(value, shares), value * math.prod(shares))
            return
        f, cut = node["feature"], node["threshold"]
        low, high, share = bounds.get(f, (-math.inf, math.inf, 1.0))
        for child, new in ((node["left"], (low, min(high, cut))), (node["right"], (max(low, cut), high))):
            yield from walk(child, bounds | {f: (*new, share * by_id[child]["cover"] / node["cover"])})

    return walk(0, {})


def read_leaves(model, session_frame: DataFrame) -> tuple[list[Leaf], float]:
    """All leaves of a fitted forest or boosted model, and the base value.

    A forest's margin is its probability of class 1, a boosted model's the log odds halved, as Spark sums them.
    """
    path = f"{shared_folder(session_frame).rstrip('/')}/trees-{uuid.uuid4().hex}"
    model.write().save(path)
    rows = session_frame.sparkSession.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect()  # bounded by trees and depth
    forest = model.__class__.__name__.startswith("RandomForest")
    trees: dict[int, list[dict]] = {}
    for r in rows:
        stats, split = list(r["impurityStats"]), r["split"]
        cut = split["leftCategoriesOrThreshold"]
        trees.setdefault(r["treeID"], []).append({
            "id": r["id"], "cover": sum(stats) if forest else stats[0], "stats": stats, "prediction": r["prediction"],
            "left": r["leftChild"], "right": r["rightChild"], "feature": split["featureIndex"], "threshold": cut[0] if cut else None,
        })
    value = (lambda n: n["stats"][1] / n["cover"] if n["cover"] else 0.0) if forest else (lambda n: n["prediction"])
    weights = [1 / len(trees)] * len(trees) if forest else list(model.treeWeights)
    leaves = [leaf for k, nodes in sorted(trees.items()) for leaf in leaves_of(nodes, value, weights[k])]
    return leaves, sum(leaf.expected for leaf in leaves)


def explain(leaves: list[Leaf], x: np.ndarray) -> np.ndarray:
    """Contributions, rows by features."""
    out = np.zeros(x.shape)
    for leaf in leaves:
        d = len(leaf.features)
        if d:
            own = x[:, leaf.features]
            pattern = ((own > leaf.low) & (own <= leaf.high)) @ (1 << np.arange(d))
            out[:, leaf.features] += leaf.table[pattern]
    return out


def contributions(df: DataFrame, key: str, names: list[str], leaves: list[Leaf]) -> DataFrame:
    """``df`` (key and features as the model saw them) to key, impacts: array<double> in the order of ``names``."""
    shared = df.sparkSession.sparkContext.broadcast(leaves)  # bounded by the model's trees and depth

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x = np.column_stack([part.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in names])
                impacts = explain(shared.value, x)
                ends = np.arange(0, impacts.size + 1, len(names), dtype=np.int32)
                yield pa.RecordBatch.from_arrays([part.column(key), pa.ListArray.from_arrays(ends, impacts.ravel())], [key, "impacts"])

    rows = df.select(key, *[F.col(c).cast("double") for c in names])
    kind = dict(rows.dtypes)[key]
    return rows.mapInArrow(run, f"`{key}` {kind}, impacts array<double>")


def largest(explained: DataFrame, key: str, names: list[str], n: int = 5) -> DataFrame:
    """key, feature, impact: the n contributions of every row with the largest size (ties by the feature's name)."""
    parts = F.zip_with(F.array(*[F.lit(c) for c in names]), F.col("impacts"), lambda c, v: F.struct((-F.abs(v)).alias("order"), c.alias("feature"), v.alias("impact")))
    return explained.select(key, F.explode(F.slice(F.array_sort(parts), 1, n)).alias("f")).select(key, "f.feature", "f.impact")
