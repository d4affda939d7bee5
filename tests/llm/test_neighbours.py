"""Vectors of extreme size, clashing columns, and shards searched by matrix product."""

import numpy as np

from formloom.llm import neighbours


def test_extreme_vectors_and_clashing_columns(spark):
    base = np.random.default_rng(5).normal(size=(120, 16))
    scale = np.where(np.arange(120) % 3 == 0, 1e200, np.where(np.arange(120) % 3 == 1, 1e-200, 1.0))
    rows = [(i, (base[i] * scale[i]).tolist(), "x", 1, 2) for i in range(120)]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>, vector string, cell int, size int"), every=20, k=3, confidence=0.999).collect()
    units = base / np.linalg.norm(base, axis=1)[:, None]
    hits = 0
    for q in range(0, 120, 20):
        want = [i for i in np.argsort(-(units @ units[q]), kind="stable") if i != q][:3]
        own = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [r for r, _, _ in own] == [1, 2, 3] and all(np.isfinite(s) and abs(s - units[q] @ units[v]) < 1e-12 for _, v, s in own)
        hits += len({v for _, v, _ in own} & set(want))
    assert hits >= 17


def test_a_shard_measures_exactly():
    """The same best rows, with the same bits, as cosines of all rows; ties by id."""
    r = np.random.default_rng(6)
    vectors = np.round(r.normal(size=(900, 8)), 1)
    vectors[500:520] = vectors[3] * 2
    ids = [[i] for i in range(900)]
    held = neighbours.Shard(vectors, ids, neighbours.unit(vectors) @ neighbours.directions(8))
    for q in (3, 77, 640):
        score = neighbours.cosine(vectors, vectors[q])
        want = sorted(zip(score.tolist(), range(900), strict=True), key=lambda x: (-x[0], x[1]))[:6]
        point = (neighbours.unit(vectors[q : q + 1]) @ neighbours.directions(8))[0]
        assert held.search(vectors[q], point, 6, -1.0, 1e9) == want
