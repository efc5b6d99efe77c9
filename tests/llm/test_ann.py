import math

import numpy as np
import pytest

from certalog.llm import ann


def brute(rows, asked, k=10):
    good = {d: np.array(v, dtype=np.float32).astype(float) for d, v in rows if d is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in asked:
        if q in good:
            dist = sorted((float(np.sqrt(((good[q] - v) ** 2).sum())), d) for d, v in good.items() if d != q and len(v) == len(good[q]))
            out[q] = dist[:k]
    return out


def test_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got = {}
    for r in ann.nearest(df, df.where("vec_id % 20 = 0")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    want = brute(rows, [d for d, _ in rows if d % 20 == 0])
    assert got.keys() == want.keys()
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 11))
        assert [(s, d) for _, s, d in found] == sorted((s, d) for _, s, d in found)
        assert q not in {d for _, _, d in found}
        hits += len({d for _, _, d in found} & {d for _, d in want[q]})
    assert hits / (10 * len(want)) >= 0.97


@pytest.mark.parametrize(
    "kind, change",
    [
        ("float", lambda v: v + 10_000),
        ("float", lambda v: v * 1e20),
        ("float", lambda v: v * 1e-20),
        ("float", lambda v: v * np.logspace(-6, 6, 8)),
        ("double", lambda v: v + 1e9),
        ("double", lambda v: v * 1e200),
        ("double", lambda v: v * 1e-200),
    ],
)
def test_recall_far_from_the_origin(spark, kind, change):
    size = np.float32 if kind == "float" else np.float64
    v = change(np.random.default_rng(9).normal(size=(1500, 8))).astype(size)
    df = spark.createDataFrame(list(enumerate(v.tolist())), f"vec_id long, embedding array<{kind}>")
    got = {}
    for r in ann.nearest(df, df.where("vec_id % 25 = 0"), shard=500).collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    hits, wide = 0, v.astype(np.longdouble)
    for q, found in got.items():
        exact = np.sqrt(((wide - wide[q]) ** 2).sum(axis=1))
        exact[q] = np.inf
        hits += sum(exact[d] <= np.sort(exact)[9] * (1 + 1e-12) for d, _ in found)
        assert len({d for d, _ in found}) == 10 and all(abs(s - exact[d]) <= 1e-12 * exact[d] for d, s in found)
    assert len(got) == 60 and hits >= 0.9 * 600


def test_shards_grow_then_multiply():
    counts = [ann.shard_count(64, n, ann.SHARD) for n in (1, 1024, 5000, 50_000, 500_000, 5_000_000)]
    assert counts == [1, 1, 5, 8, 8, 77]


def test_copies_nulls_and_ties(spark):
    rng = np.random.default_rng(3)
    rows = [(d, rng.normal(size=4).astype(np.float32).tolist()) for d in range(1, 60)]
    rows += [(d, [1.0, 0.0, 0.0, 0.0]) for d in range(100, 400)]
    rows += [(500, None), (600, [0.0] * 4), (700, [float("nan"), 1.0, 0.0, 0.0]), (800, [None, 1.0, 0.0, 0.0]), (900, [float("inf"), 1.0, 0.0, 0.0]), (1000, []), (None, [1.0] * 4), (1100, [1.0, 2.0]), (200, [1.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(d, v, 1, 2) for d, v in rows], "vec_id long, embedding array<float>, label int, shard int")
    got = {}
    for r in ann.nearest(df, df.where("vec_id % 50 = 0")).collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    assert {q: sorted(v) for q, v in got.items()} == {q: v for q, v in brute(rows, range(0, 1101, 50)).items() if v}
    assert ann.nearest(df.limit(0), df).collect() == []
    assert ann.nearest(df, df.limit(0)).collect() == []


def test_graph_arrays():
    vectors = np.random.default_rng(5).normal(size=(400, 8)).astype(np.float32)
    graph = ann.Graph.build(vectors)
    assert graph.links[0].shape == (400, 2 * ann.LINKS)
    assert all(i not in row for i, row in enumerate(graph.links[0].tolist()))
    hits = [set(graph.search(v, 80)[:10].tolist()) & set(np.argsort(((vectors - v) ** 2).sum(axis=1))[:10].tolist()) for v in vectors[:50]]
    assert sum(map(len, hits)) >= 490
