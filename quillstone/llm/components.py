"""Connected components of links, inside an array and across the cluster."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.sources.storage import stored


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the links a-b, but the smallest of its component, with that smallest one.

    These are fewer links than nodes and connect the same nodes, so a dense group does not send all its pairs.
    """
    if not len(a):
        return a, b
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        for end in (label[x], label[y], x, y):
            np.minimum.at(new, end, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    own = label != np.arange(len(nodes))
    return nodes[own], nodes[label[own]]


def components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, component) of every node of the links (a, b) that is not the smallest of its component.

    Alternating large-star and small-star steps: nodes link to the smallest neighbour until only stars are left. A step
    shuffles the links and keeps their number; a node with many links is aggregated before it is shuffled and joined,
    which lets Spark split it. Rounds grow with the logarithm of a component's diameter; links that are no stars after
    ``rounds`` of them are an error, never a result.
    """
    links = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    seen = None
    for _ in range(rounds):
        mark = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            return links.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = mark
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = (
            both.where("v > u")
            .join(least, "u")
            .select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
            .distinct()
        )
        large = stored(large, "links")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        links = stored(small.distinct(), "links")
    raise RuntimeError(f"components are not found after {rounds} rounds")
