import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from certalog.llm import packing


def slow_best_fit(lengths, sizes):
    bins = []  # [capacity, room]
    where = []
    for i, n in enumerate(lengths):
        fit = [k for k, (_, room) in enumerate(bins) if room >= n]
        if fit:
            k = min(fit, key=lambda k: bins[k][1])
        else:
            fill = lambda c: n + min(c - n, sum(x for x in lengths[i + 1 :] if x <= c - n))  # noqa: E731, B023
            c = min((c for c in sizes if c >= n), key=lambda c: (packing.cost(c) / fill(c), c))
            k = len(bins)
            bins.append([c, c])
        bins[k][1] -= n
        where.append(k)
    return where, [c for c, _ in bins], sorted(r for _, r in bins)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60), st.sets(st.sampled_from([16, 32, 48, 64]), min_size=1))
def test_best_fit_leaves_the_same_rooms(lengths, sizes):
    sizes = sorted(sizes | {64})
    where, capacity = packing.best_fit(lengths, sizes)
    _, slow_capacity, rooms = slow_best_fit(lengths, sizes)
    used = np.bincount(where, lengths, minlength=len(capacity)) if lengths else np.zeros(0)
    assert capacity == slow_capacity
    assert sorted((np.array(capacity) - used).astype(int).tolist()) == rooms


def test_opens_the_least_cost_size():
    assert packing.best_fit([300, 200, 12], (512, 1024, 2048, 4096))[1] == [512]
    assert packing.best_fit([300, 300, 300], (512, 1024, 2048, 4096))[1] == [1024]  # three of 512 would hold 300 each
    assert packing.best_fit([500], (512, 4096))[1] == [512]


def check(rows, expected, sizes=packing.CAPACITIES):
    """Every token once, no bin overfull, no overlap, no smaller size would do."""
    got, bins = {}, {}
    for r in rows:
        got.setdefault(r.doc_id, []).append((r.start, r.n_tokens))
        if r.bin_id is None:
            assert r.n_tokens == 0
        else:
            bins.setdefault((r.bin_id, r.capacity), []).append((r.bin_offset, r.n_tokens))
    assert len({b for b, _ in bins}) == len(bins)
    for (_, capacity), parts in bins.items():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert capacity == min(c for c in sizes if c >= at)
    for d, total in expected.items():
        at = 0
        for start, n in sorted(got.pop(d)):
            assert start == at
            at += n
        assert at == total
    assert not got


def test_round_trip(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    expected = {r.doc_id: len(r.text.split()) for r in docs.collect()}
    check(packing.pack(packing.token_counts(docs), shard=300).collect(), expected)


def test_odd_rows(spark):
    rows = [(1, None, 5), (2, "", 5), (3, "w " * 10_000, 5), (4, " \t", 5), (5, "one", 5)] + [(k, "a b", 5) for k in range(10, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    check(packing.pack(packing.token_counts(docs)).collect(), {d: len((t or "").split()) for d, t, _ in rows})
    twice = packing.pack(packing.token_counts(docs.where("doc_id = 5").union(docs.where("doc_id = 5")))).collect()
    assert sorted(r.bin_offset for r in twice) == [0, 1]
    assert packing.pack(packing.token_counts(docs.limit(0))).collect() == []
    assert len(packing.pack(spark.createDataFrame([(None, 3), (7, None)], "doc_id long, n_tokens long")).collect()) == 2


def test_sizes_are_chosen_jointly():
    lengths = np.array([600] * 10)
    where, _, capacity = packing.plan(lengths, (1024, 2048))
    assert sum(map(packing.cost, capacity.tolist())) <= min(10 * packing.cost(1024), 4 * packing.cost(2048))
    assert np.bincount(where, lengths).max() <= 2048
