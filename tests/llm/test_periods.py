import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from certalog.llm import periods


def brute(words):
    """Every maximal stretch of every period that is its smallest one."""
    n, out = len(words), set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            s, e = i, j + q
            if e - s >= max(6, 4 * q) and not any(all(words[k] == words[k + r] for k in range(s, e - r)) for r in range(1, q)):
                out.add((s, e, q))
            i = j
    return sorted(out)


def row(doc, text):
    """The contract's digests, plainly."""
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc).encode())
    if doc is not None and h % 10 == 0 and w:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    runs = brute(w)
    kept = [x for i, x in enumerate(w) if not any(s + q <= i < e for s, e, q in runs)]
    best = min(((-(e - s), s, q) for s, e, q in runs), default=None)
    top = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
    told = "".join(f"{s},{e - s},{q}\n" for s, e, q in runs)
    return (doc, len(runs), *top, hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(" ".join(kept).encode()).hexdigest())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=90))
def test_runs_of_small_alphabets(x):
    assert periods.runs(np.array(x, dtype=np.int64)) == brute(x)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 5), min_size=1, max_size=9), st.integers(1, 9)), max_size=6))
def test_runs_of_repeated_pieces(parts):
    x = [v for p, k in parts for v in p * k]
    assert periods.runs(np.array(x, dtype=np.int64)) == brute(x)


@pytest.mark.parametrize("q", [1, 2, 3, 7, 8, 15, 16, 33, 100, 255])
@pytest.mark.parametrize("power", [3.9, 4.0, 4.5, 11.2])
def test_runs_of_each_period(q, power):
    rng = np.random.default_rng(q)
    unit = rng.integers(0, 40, q) if q > 2 else np.arange(q)
    body = np.resize(unit, int(q * power))
    x = np.concatenate([rng.integers(50, 1000, 13), body, rng.integers(50, 1000, 29)])
    assert periods.runs(x) == brute(x.tolist())


def test_runs_of_strings_with_many_squares():
    a, b = [0], [0, 1]
    while len(b) < 700:
        a, b = b, b + a
    assert periods.runs(np.array(b)) == brute(b)  # Fibonacci: no run of four periods or more
    assert periods.runs(np.array((b[:30] * 9)[:250])) == brute((b[:30] * 9)[:250])
    thue = [bin(k).count("1") % 2 for k in range(512)]
    assert periods.runs(np.array(thue * 5)) == [(0, 2560, 512)]


def test_transform_gives_exact_products():
    rng = np.random.default_rng(1)
    for size in (2, 8, 64, 1024):
        a, b = rng.integers(0, periods.PRIME, (2, 3, size), dtype=np.uint64)
        got = periods.ntt(periods.ntt(a) * periods.ntt(b) % np.uint64(periods.PRIME), inverse=True)
        for k in range(3):
            full = np.zeros(2 * size, dtype=object)
            for i, v in enumerate(a[k].tolist()):
                full[i : i + size] += v * b[k].astype(object)
            assert got[k].tolist() == [int(x) % periods.PRIME for x in full[:size] + full[size:]]


def test_long_texts_stay_quick():
    n = 400_000
    assert periods.runs(np.zeros(n, dtype=np.int64)) == [(0, n, 1)]
    assert periods.runs(np.arange(n) % 2) == [(0, n, 2)]
    x = np.random.default_rng(3).integers(0, 1000, n // 5)
    assert periods.runs(np.concatenate([np.array([5000]), np.tile(x, 5), x[:77], np.array([5001])])) == [(1, n + 78, n // 5)]


def test_against_brute_force(spark):
    rng = random.Random(5)
    word = lambda: rng.choice("abcdefghijklmnop") * rng.choice((1, 1, 2)) + rng.choice(("", "é", "国"))
    rows = []
    for k in range(400):
        t = [word() for _ in range(rng.choice((0, 1, 5, 6, 40, 200)))]
        if k % 3 == 0 and t:
            at = rng.randrange(len(t))
            t[at:at] = t[: rng.choice((1, 2, 5, 9))] * rng.choice((3, 4, 5, 8))
        rows.append((k, rng.choice((" ", "\n", "\t \x0b", "  ")).join(t)))
    rows += [(None, "x x x x x x x x"), (None, None), (401, None), (402, " \n"), (10, "a a a a a a"), (10, "a a a a a a"), (403, "na" * 5000)]
    df = spark.createDataFrame([(d, t, 1, "z") for d, t in rows], "doc_id long, text string, n_runs int, runs string")
    df.createOrReplaceTempView("period_rows")
    import certalog.llm.periods as p

    old = p.table
    p.table = lambda s, d, name: df
    try:
        got = p.op12_runs(spark, "")
        assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
        assert sorted(map(tuple, got.collect()), key=repr) == sorted((row(*r) for r in rows), key=repr)
        assert p.word_runs(df.where("false")).collect() == []
    finally:
        p.table = old


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect() if len((r.text or "").split()) < 900]  # the plain version is cubic
    keep = {d for d, _ in rows}
    got = [tuple(r) for r in periods.op12_runs(spark, "/root/testdata/sf0.001").collect()]
    assert len(got) == df.count()
    assert sorted(r for r in got if r[0] in keep) == sorted(row(*r) for r in rows)
    assert sum(r[1] > 0 for r in got) > 10
