"""Connected components of a link table, distributed.

Each partition first contracts its own links with union-find, which leaves a
spanning forest of stars; rounds of large-star and small-star then merge the
stars of different partitions. No task holds more than its own partition's
links, and hot nodes are pre-aggregated before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .session import checkpointed


class UnionFind:
    """Disjoint sets of integers; the root of a set is its smallest member."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while x != root:
            parent[x], x = root, parent.get(x, x)
        return root

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sets = UnionFind()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            sets.union(a, b)
    nodes = np.fromiter(sets.parent, np.int64, len(sets.parent))
    roots = np.fromiter((sets.find(x) for x in list(sets.parent)), np.int64, len(nodes))
    for start in range(0, len(nodes), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[start : start + 100_000]), pa.array(roots[start : start + 100_000])], ["u", "v"])


#: Links up to which one task finishes the union-find: 320 kB. Beyond it, rounds of stars do.
ONE_TASK = 20_000


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of ``links`` (two long columns): one row ``node, component`` per linked node.

    ``component`` is the smallest node reachable. Links may repeat and may point at
    themselves; rows with a null end are ignored; no link gives no row. Raises if
    the labels are not settled after ``max_rounds``, rather than return part of a result.
    """
    a, b = links.columns[:2]
    edges = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u is not null and v is not null and u <> v")
    edges = edges.mapInArrow(_contract, "u long, v long").where("u <> v").distinct()
    edges = checkpointed(edges)

    def labelled(stars: DataFrame) -> DataFrame:
        """Stars (node, root) with a row for each root too."""
        return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(stars.select("v", "v").distinct())

    if edges.count() <= ONE_TASK:
        return labelled(edges.coalesce(1).mapInArrow(_contract, "u long, v long").where("u <> v"))
    before = None
    for _ in range(max_rounds):
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.union(least.where("u <> m")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(small, "u")
        edges = checkpointed(joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small).distinct())
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == before:
            return labelled(edges.groupBy("u").agg(F.min("v").alias("v")))
        before = state
    raise RuntimeError(f"components not settled after {max_rounds} rounds")
