"""Approximate nearest neighbours by stable projections, kd-trees and a chi-square stopping test.

Unit vectors are projected on a few Gaussian directions: the squared projected
distance of two vectors at distance d is d*d times a chi-square variable. A
query meets points in order of projected distance and verifies them in full. It
stops at a projected distance that a point nearer than the worst of its current
neighbours would exceed with a small probability only. With a test at 0.97 a
true neighbour is found with at least that probability.

Space is cut into cells by a kd-tree fitted on a bounded sample of projections;
all rows are indexed. A query first searches its own cell, which bounds the
distance, and then the cells that the bound leaves open.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .session import checkpointed, narrow, table

AXES = 8
CONFIDENCE = 0.97
LEAF = 64
#: Points of an index shard; cells of the space at most; projections that the cells are fitted on at most.
SHARD, CELLS, SAMPLE = 8_192, 4_096, 20_000
#: How far a cosine by matrix product may be off: a thousandfold of what rounding does to vectors of a million components.
SLACK = 1e-9
#: Distinct query vectors that search a shard in one group.
QUERIES = 2_048


def chi_square_cdf(x: np.ndarray, degrees: int) -> np.ndarray:
    """For an even number of degrees of freedom."""
    half = np.maximum(np.asarray(x, float), 0) / 2
    term, total = np.ones_like(half), np.ones_like(half)
    for i in range(1, degrees // 2):
        term = term * half / i
        total = total + term
    return 1 - np.exp(-half) * total


def chi_square_quantile(p: float, degrees: int) -> float:
    low, high = 0.0, 400.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_cdf(mid, degrees) < p else (low, mid)
    return high


def directions(size: int) -> np.ndarray:
    return np.random.default_rng(20_240_917 + size).standard_normal((size, AXES))


def tame(vectors: np.ndarray) -> np.ndarray:
    """Rows whose squares would leave the range of doubles are scaled by a power of two, which changes no cosine; others stay as they are."""
    peak = np.abs(vectors).max(axis=1)
    wild = (peak > 1e140) | ((peak < 1e-140) & (peak > 0))
    if not wild.any():
        return vectors
    return np.where(wild[:, None], np.ldexp(vectors, -np.frexp(peak)[1][:, None]), vectors)


def unit(vectors: np.ndarray) -> np.ndarray:
    vectors = tame(vectors)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]


def cosine(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Cosines in double precision, each row summed alike wherever it stands."""
    vectors, query = tame(vectors), tame(query[None, :])[0]
    return (vectors * query).sum(axis=1) / (np.sqrt((vectors * vectors).sum(axis=1)) * np.sqrt((query * query).sum()))


class KdTree:
    """Points in leaves of at most LEAF, with the boxes of the leaves."""

    def __init__(self, points: np.ndarray) -> None:
        self.order = np.arange(len(points))
        leaves = []
        stack = [(0, len(points))]
        while stack:
            a, b = stack.pop()
            if b - a <= LEAF:
                leaves.append((a, b))
                continue
            own = points[self.order[a:b]]
            axis = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
            half = (b - a) // 2
            self.order[a:b] = self.order[a:b][np.argpartition(own[:, axis], half)]
            stack += [(a + half, b), (a, a + half)]
        self.leaves = sorted(x for x in leaves if x[1] > x[0])
        self.points = points[self.order]
        self.low = np.array([self.points[a:b].min(axis=0) for a, b in self.leaves]).reshape(-1, points.shape[1])
        self.high = np.array([self.points[a:b].max(axis=0) for a, b in self.leaves]).reshape(-1, points.shape[1])

    def leaf_distances(self, query: np.ndarray) -> np.ndarray:
        """Squared distances from the query to the leaves' boxes."""
        gap = np.maximum(0, np.maximum(self.low - query, query - self.high))
        return (gap * gap).sum(axis=1)


class Shard:
    """Distinct vectors with the smallest ids of each, behind a kd-tree of their projections."""

    def __init__(self, vectors: np.ndarray, ids: list[list[int]], points: np.ndarray) -> None:
        self.tree = KdTree(points)
        self.vectors = vectors[self.tree.order]
        self.units = unit(self.vectors)
        self.ids = [ids[i] for i in self.tree.order]

    def search(self, query: np.ndarray, point: np.ndarray, k: int, worst: float, limit: float) -> list[tuple[float, int]]:
        """The k best (score, id) met before the test stops; ``worst`` is a score to start from."""
        found: list[tuple[float, int]] = []
        toward = unit(query[None, :])[0]
        distance = self.tree.leaf_distances(point)
        order = np.argsort(distance, kind="stable")
        at, step = 0, 1
        while at < len(order):
            reach = max(0.0, 2 - 2 * worst) * limit * (1 + 1e-9) + 1e-12
            some = order[at : at + step]
            some = some[distance[some] <= reach]
            if not len(some):
                break
            rows = np.concatenate([np.arange(*self.tree.leaves[i]) for i in some])
            gap = self.tree.points[rows] - point
            rows = rows[(gap * gap).sum(axis=1) <= reach]
            if len(rows):
                # A matrix product, right to far better than SLACK, tells which rows can be among the best; those are measured exactly.
                near = self.units[rows] @ toward
                bar = found[-1][0] if len(found) == k else -2.0
                if len(near) > k:
                    bar = max(bar, np.partition(near, len(near) - k)[len(near) - k])
                rows = rows[near >= bar - SLACK]  # ties at the bound stay
                score = cosine(self.vectors[rows], query)
                found += [(s, i) for s, r in zip(score.tolist(), rows.tolist(), strict=True) for i in self.ids[r]]
                found = sorted(set(found), key=lambda x: (-x[0], x[1]))[:k]
                if len(found) == k:
                    worst = max(worst, found[-1][0])
            at += step
            step *= 2
        return found


def fit_cells(sample: np.ndarray, cells: int) -> list[tuple[int, float]]:
    """A complete kd-tree of splits (axis, value), node i's children 2i+1 and 2i+2, with at least ``cells`` cells."""
    depth = max(0, int(cells - 1).bit_length())
    splits: list[tuple[int, float]] = [(0, 0.0)] * (2**depth - 1)
    groups = {0: sample}
    for node in range(len(splits)):
        own = groups.pop(node)
        axis = int(np.argmax(own.max(axis=0) - own.min(axis=0))) if len(own) else 0
        value = float(np.median(own[:, axis])) if len(own) else 0.0
        splits[node] = (axis, value)
        groups[2 * node + 1], groups[2 * node + 2] = own[own[:, axis] <= value], own[own[:, axis] > value]
    return splits


def cell_of(points: np.ndarray, splits: list[tuple[int, float]]) -> np.ndarray:
    node = np.zeros(len(points), np.int64)
    if splits:
        axes, values = np.array([a for a, _ in splits]), np.array([v for _, v in splits])
        while node.size and node[0] < len(splits):
            node = 2 * node + 1 + (points[np.arange(len(points)), axes[node]] > values[node])
    return node - len(splits)


def cell_boxes(splits: list[tuple[int, float]]) -> tuple[np.ndarray, np.ndarray]:
    low, high = {0: np.full(AXES, -np.inf)}, {0: np.full(AXES, np.inf)}
    for node, (axis, value) in enumerate(splits):
        a, b = low.pop(node), high.pop(node)
        low[2 * node + 1], high[2 * node + 1], low[2 * node + 2], high[2 * node + 2] = a, b.copy(), a.copy(), b
        high[2 * node + 1][axis], low[2 * node + 2][axis] = min(value, b[axis]), max(value, a[axis])
    keys = sorted(low)
    return np.array([low[k] for k in keys]), np.array([high[k] for k in keys])


def _classes(keep: int | None):
    """Valid vectors of a partition, equal ones together with their ``keep`` smallest ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups: dict[bytes, list[int]] = {}
            for vec_id, vector in zip(batch.column("vec_id").to_pylist(), batch.column("embedding").to_pylist(), strict=True):
                if vec_id is None or not vector or None in vector:
                    continue
                raw = np.array(vector, "<f8") + 0.0
                if np.isfinite(raw).all() and raw.any():
                    groups.setdefault(raw.tobytes(), []).append(vec_id)
            rows = [(v, sorted(set(ids))[:keep]) for v, ids in groups.items()]
            yield pa.RecordBatch.from_arrays([pa.array([v for v, _ in rows], pa.binary()), pa.array([i for _, i in rows], pa.list_(pa.int64()))], ["vector", "ids"])

    return run


def _points(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    vectors = np.array([np.frombuffer(x, "<f8") for x in raw])
    return vectors, unit(vectors) @ directions(vectors.shape[1])


def nearest(rows: DataFrame, every: int = 50, k: int = 5, confidence: float = CONFIDENCE) -> DataFrame:
    """The ``k`` nearest by cosine of each row whose vec_id is divisible by ``every``: query_id, rank, vec_id, score.

    Candidates are all rows but those of the query's own vec_id. Vectors that are null, zero, or hold null or
    non-finite components take no part; neither do null ids. Equal rows count once, ties go to the smaller vec_id, and
    a query has fewer rows if there are fewer candidates. Vectors of different sizes are strangers to each other.
    Other columns are ignored. An empty table gives an empty result.
    """
    limit = chi_square_quantile(confidence, AXES)
    base = rows.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    keep = k + 1
    merged = base.mapInArrow(_classes(keep), "vector binary, ids array<long>")
    merged = merged.groupBy("vector").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep).alias("ids"))
    classes = checkpointed(merged.withColumn("size", F.length("vector") / 8))
    sizes = [(r["size"], r["n"]) for r in classes.groupBy("size").agg(F.count("*").alias("n")).collect()]
    out = None
    for size, n in sorted(sizes):
        own = _nearest_of_size(base.where(F.size("embedding") == int(size)), classes.where(F.col("size") == size), int(size), n, every, k, keep, limit)
        out = own if out is None else out.union(own)
    return out if out is not None else rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")


def _nearest_of_size(base: DataFrame, classes: DataFrame, wide: int, n: int, every: int, k: int, keep: int, limit: float) -> DataFrame:
    sample = classes.select("vector").orderBy(F.xxhash64("vector")).limit(SAMPLE).toArrow()
    splits = fit_cells(_points(sample.column("vector").to_pylist())[1], min(CELLS, max(1, -(-n // SHARD))))
    low, high = cell_boxes(splits)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cells = cell_of(_points(batch.column("vector").to_pylist())[1], splits)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells.astype(np.int32))], [*batch.schema.names, "cell"])

    placed = checkpointed(classes.select("vector", "ids").mapInArrow(place, "vector binary, ids array<long>, cell int"))
    salts = placed.groupBy("cell").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("salts"))
    counts = {r["cell"]: r["salts"] for r in salts.collect()}  # one entry for each of at most CELLS cells
    dealt = placed.join(narrow(salts, len(counts)), "cell").withColumn("salt", F.pmod(F.xxhash64("vector"), F.col("salts")).cast("int"))

    def build(key: tuple, table_: pa.Table) -> pa.Table:
        return pa.table({"cell": [key[0].as_py()], "salt": [key[1].as_py()], "vectors": [b"".join(table_.column("vector").to_pylist())], "ids": [table_.column("ids").to_pylist()]},
                        schema=pa.schema([("cell", pa.int32()), ("salt", pa.int32()), ("vectors", pa.binary()), ("ids", pa.list_(pa.list_(pa.int64())))]))

    index = dealt.groupBy("cell", "salt").applyInArrow(build, "cell int, salt int, vectors binary, ids array<array<long>>")

    asked_by = base.where(F.col("vec_id") % every == 0).mapInArrow(_classes(None), "vector binary, ids array<long>")
    asked_by = asked_by.select("vector", F.explode("ids").alias("query_id")).distinct()

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                raw = batch.column("vector").to_pylist()
                cells = cell_of(_points(raw)[1], splits)
                salt = [xxhash.xxh3_64_intdigest(v) % counts.get(c, 1) for v, c in zip(raw, cells.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("vector"), pa.array(cells.astype(np.int32)), pa.array(salt, pa.int32()), pa.array(np.full(batch.num_rows, -1.0))], ["vector", "cell", "salt", "worst"])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The other shards that each query's bound leaves open."""
        for batch in batches:
            for row in range(batch.num_rows):
                raw, own, salt, worst = (batch.column(c)[row].as_py() for c in ("vector", "cell", "salt", "worst"))
                point = _points([raw])[1][0]
                gap = np.maximum(0, np.maximum(low - point, point - high))
                open_ = np.flatnonzero((gap * gap).sum(axis=1) <= max(0.0, 2 - 2 * worst) * limit + 1e-9)
                pairs = [(c, s) for c in open_.tolist() for s in range(counts.get(c, 0)) if (c, s) != (own, salt)]
                m = len(pairs)
                yield pa.RecordBatch.from_arrays([pa.array([raw] * m, pa.binary()), pa.array([c for c, _ in pairs], pa.int32()), pa.array([s for _, s in pairs], pa.int32()), pa.array([worst] * m, pa.float64())], ["vector", "cell", "salt", "worst"])

    def search(asked: pa.Table, shard: pa.Table) -> pa.Table:
        out: list[tuple] = []
        vectors = np.frombuffer(b"".join(shard.column("vectors").to_pylist()), "<f8").reshape(-1, wide)
        ids = [x for row in shard.column("ids").to_pylist() for x in row]
        held = Shard(vectors, ids, unit(vectors) @ directions(wide)) if len(vectors) and asked.num_rows else None
        for row in range(asked.num_rows):
            raw, cell, salt, worst = (asked.column(c)[row].as_py() for c in ("vector", "cell", "salt", "worst"))
            query, point = _points([raw])
            found = held.search(query[0], point[0], keep, worst, limit) if held else []
            bound = found[-1][0] if len(found) == keep else worst
            out.append((raw, cell, salt, max(worst, bound), [i for _, i in found], [s for s, _ in found]))
        kinds = (pa.binary(), pa.int32(), pa.int32(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.float64()))
        return pa.table([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * 6, kinds, strict=True)], ["vector", "cell", "salt", "worst", "found", "scores"])

    shape = "vector binary, cell int, salt int, worst double"

    def searched(queries: DataFrame) -> DataFrame:
        """Queries meet their shard in groups of about QUERIES, so that a crowded region isn't one task's work."""
        queries = checkpointed(queries)
        turns = queries.groupBy("cell", "salt").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("turns"))
        dealt = queries.join(turns, ["cell", "salt"]).withColumn("turn", F.pmod(F.xxhash64("vector"), F.col("turns")).cast("int")).drop("turns")
        parts = turns.select("cell", "salt", (F.col("turns") - 1).alias("last"))
        shards = index.join(parts, ["cell", "salt"]).withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("last")))).drop("last")
        by = "cell", "salt", "turn"
        return dealt.groupBy(*by).cogroup(shards.groupBy(*by)).applyInArrow(search, shape + ", found array<long>, scores array<double>")

    first = checkpointed(searched(asked_by.select("vector").distinct().mapInArrow(home, shape)))
    rest = searched(first.select("vector", "cell", "salt", "worst").mapInArrow(route, shape))
    hits = first.select("vector", "found", "scores").union(rest.select("vector", "found", "scores"))
    hits = hits.select("vector", F.explode(F.arrays_zip("scores", "found")).alias("hit")).select("vector", F.struct((-F.col("hit.scores")).alias("s"), F.col("hit.found").alias("i")).alias("hit"))
    best = hits.groupBy("vector").agg(F.slice(F.array_sort(F.array_distinct(F.collect_list("hit"))), 1, keep).alias("hits"))
    own = asked_by.join(best, "vector").select("query_id", F.posexplode(F.slice(F.filter("hits", lambda x: x["i"] != F.col("query_id")), 1, k)).alias("pos", "hit"))
    return own.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("hit.i").alias("vec_id"), (-F.col("hit.s")).alias("score"))


def op9_ann_search(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
