"""Connected components of links by alternating large-star and small-star; of few links, in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import settle

#: Links that one task joins: 16 MB.
FEW = 1 << 20


def _large(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Larger neighbours linked with the least one. Links may repeat; there are as many as edges."""
    return edges.join(least.select(F.col("u").alias("v"), "m"), "v").select("u", F.col("m").alias("v"))


def _small(down: DataFrame) -> DataFrame:
    """Smaller neighbours, and the node itself, linked with the least one."""
    led = down.join(settle(down.groupBy("u").agg(F.min("v").alias("m")), "least"), "u")
    moved = led.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(led.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for each node of links (u, v): the smallest node that it reaches. Nodes without links are left out.
    Each round's links (u > v) are a table in the shared folder; rounds end when they are stars: no node has two links down, or links both up
    and down. Least neighbours are grouped first, so that a hub's links are combined before they move; the groups are a table, since
    Spark splits a skewed join between tables but not one with a grouping."""
    edges = settle(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    while True:
        ends = edges.select("u", "v", F.lit(1).alias("down"), F.lit(0).alias("up"))
        ends = ends.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), F.lit(0).alias("down"), F.lit(1).alias("up")))
        least = ends.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.sum("down").alias("down"), F.max("up").alias("up"))
        least = settle(least, "least")
        if least.where("down > 1 or (down = 1 and up = 1)").isEmpty():
            return least.select(F.col("u").alias("node"), F.col("m").alias("component"))
        edges = settle(_small(settle(_large(edges, least), "large")), "links")


def joined(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the smallest node that each reaches): both ends' least labels spread along links, and labels take their label's label."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    label = np.arange(len(nodes))
    while (open_ := label[a] != label[b]).any():
        a, b = a[open_], b[open_]
        x, y = label[a], label[b]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (further := label[label]).tobytes() != label.tobytes():
            label = further
    return nodes, nodes[label]


def components_of_table(links: DataFrame, few: int = FEW) -> DataFrame:
    """What components gives, for links that are a table. Rounds cost several shuffles each, however few the links: up to `few` are joined
    in one task, of bounded size; more take the rounds."""
    if links.count() > few:
        return components(links)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(x.column("u").to_numpy(), x.column("v").to_numpy()) for x in batches]
        u, v = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*held, strict=True)) if held else (np.zeros(0, np.int64),) * 2
        nodes, least = joined(u[u != v], v[u != v])
        for at in range(0, len(nodes), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(nodes[at : at + 10_000]), pa.array(least[at : at + 10_000])], ["node", "component"])

    return settle(links.select("u", "v").coalesce(1).mapInArrow(join, "node long, component long"), "components")
