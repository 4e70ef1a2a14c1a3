"""Connected components by repeated contraction, with joins and partial aggregates only."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phonoframe.llm.common import cut_sized


def forest(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A set of edges with the same components as (one, two), a row per node that isn't its component's root."""
    nodes, ends = np.unique(np.concatenate((one, two)), return_inverse=True)
    a, b = ends[: len(one)], ends[len(one) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for end in (label[a], label[b], a, b):
            np.minimum.at(new, end, low)
        while not np.array_equal(jump := new[new], new):
            new = jump
        if np.array_equal(new, label):
            break
        label = new
    rest = label != np.arange(len(nodes))
    return nodes[rest], nodes[label[rest]]


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", seed: int = 7, few: int = 0) -> DataFrame:
    """Component of every node that has an edge.

    edges: two long columns; nulls are ignored, loops name a node without linking it, repeated edges count once.
    Returns (node, component), component being the smallest node that can be reached. No edges: no rows.

    Each round orders the nodes by `node XOR mask` under a fresh mask; each node joins the least of its neighbours and
    itself, and edges are rewritten between the joined nodes. A constant share of the nodes goes in each round, so the
    rounds grow with the logarithm of the input. A hub's edges are pre-aggregated by the partial minimum and its joins
    have one row per node on the other side, so skewed partitions can be split. At most `few` different edges are joined by the driver.
    """
    rng = random.Random(seed)
    clean = edges.select(F.col(src).cast("long").alias("a"), F.col(dst).cast("long").alias("b")).where("a is not null and b is not null")
    if few:
        clean = cut_sized(clean.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        if clean.count() <= few:
            one, two = (np.asarray(column, np.int64) for column in clean.toArrow().columns)
            nodes = np.unique(np.concatenate((one, two)))
            roots = nodes.copy()
            child, root = forest(one, two)
            roots[np.searchsorted(nodes, child)] = root
            return edges.sparkSession.createDataFrame(pa.table({"node": pa.array(nodes, pa.int64()), "component": pa.array(roots, pa.int64())}))
    loops = clean.where("a = b").select(F.col("a").alias("node")).distinct()
    live = cut_sized(clean.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    while not live.isEmpty():
        mask = F.lit(rng.getrandbits(63))
        both = live.union(live.select("b", "a"))
        choice = both.groupBy("a").agg(F.min(F.col("b").bitwiseXOR(mask)).alias("m"))
        choice = cut_sized(choice.select(F.col("a").alias("v"), F.least("m", F.col("a").bitwiseXOR(mask)).bitwiseXOR(mask).alias("r")))
        moved = live.join(choice, F.col("a") == F.col("v")).select(F.col("r").alias("a"), "b")
        moved = moved.join(choice, F.col("b") == F.col("v")).select("a", F.col("r").alias("b")).where("a <> b")
        live = cut_sized(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        if labels is None:
            labels = choice.select(F.col("v").alias("node"), F.col("r").alias("label"))
        else:
            labels = cut_sized(labels.join(choice, F.col("label") == F.col("v"), "left").select("node", F.coalesce("r", "label").alias("label")))
    if labels is None:
        return loops.select("node", F.col("node").alias("component"))
    least = cut_sized(labels.groupBy("label").agg(F.min("node").alias("component")))  # stored, so that a large component's rows can be split
    found = labels.join(least, "label").select("node", "component")
    alone = loops.join(labels.select("node"), "node", "left_anti").select("node", F.col("node").alias("component"))
    return found.union(alone)
