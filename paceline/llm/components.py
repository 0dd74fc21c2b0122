"""Connected components of a graph given as links, by alternating large and small stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.llm.common import checkpointed


def _state(links: DataFrame) -> tuple:
    """Number of links and a sum over them that does not depend on their order."""
    digest = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    row = links.agg(F.count("*"), digest).first()
    return row[0], row[1]


def connected(links: DataFrame) -> DataFrame:
    """(node, root) of every node in `links` (u, v, of any ordered type); root is the smallest node of its component.

    A round joins each node with the minimum of its neighbourhood, which is aggregated before it is shuffled; links of a
    node with many neighbours meet one row, so adaptive execution may split them. The number of links does not grow. Each
    round is written to shared storage. Links with null ends and loops are left out.
    """
    links = checkpointed(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct(), "links")
    before = _state(links)
    while before[0]:
        # Large star: larger neighbours of a node go to the smallest of its neighbourhood.
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: a node and its smaller neighbours go to the smallest of these.
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(smallest.select("u", F.col("m").alias("v")))
        links = checkpointed(small.distinct(), "links")
        after = _state(links)
        if after == before:
            break
        before = after
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(links.select("v", "v").distinct())


def local_roots(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index each of `size` items is linked with, for links between a[i] and b[i]."""
    label = np.arange(size)
    while True:
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while not np.array_equal(label, label[label]):
            label = label[label]
        if np.array_equal(label[a], label[b]):
            return label
