"""Connected components of links that are spread over the cluster."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapcat.session import settle


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of one task reduced to one per node: (node, smallest node of its component)."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while len(left):
        low = np.minimum(label[left], label[right])
        np.minimum.at(label, label[left], low)
        np.minimum.at(label, label[right], low)
        while (label != (jump := label[label])).any():
            label = jump
        open_ = label[left] != label[right]
        left, right = left[open_], right[open_]
    linked = label != np.arange(len(nodes))
    return nodes[linked], nodes[label[linked]]


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every linked node but the roots, from links (a, b); the root is the smallest node.

    Alternating large and small stars: each round hangs neighbours under the smallest node that they
    know, with map-side minima, and writes its links to the shared folder. Rounds grow with the
    logarithm of the nodes. No component is gathered in one place.
    """
    links = settle(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.greatest("b", "low").alias("b"), "a", "low")
        links = settle(
            small.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(low.select("a", F.col("low").alias("b"))).where("a <> b").distinct()
        )
        now = links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
