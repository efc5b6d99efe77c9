import random
import re

import numpy as np
import pytest

from certalog.llm import substrings


def brute(docs, width=20):
    """(words, removed, kept text) of each row, by a dictionary of all windows."""
    parsed = [(-(1 << 63) if d is None else d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in docs]
    first = {}
    for d, words in parsed:
        for p in range(len(words) - width + 1):
            w = tuple(words[p : p + width])
            first[w] = min(first.get(w, (d, p)), (d, p))
    out = []
    for (doc, _), (d, words) in zip(docs, parsed):
        gone = set()
        for p in range(len(words) - width + 1):
            if first[tuple(words[p : p + width])] < (d, p):
                gone.update(range(p, p + width))
        out.append((doc, len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone)))
    return sorted(out, key=str)


def result(spark, docs):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, id string, th int")
    return sorted((tuple(r) for r in substrings.dedup(df).collect()), key=str)


def test_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    got = result(spark, docs)
    assert got == brute(docs)
    assert sum(r[2] > 0 for r in got) > 50


def test_small_alphabets_and_runs(spark):
    rng = random.Random(3)
    docs = []
    for d in range(120):
        words = [rng.choice("ab" if d % 2 else "abcdefgh") for _ in range(rng.randrange(60))]
        if d % 3 == 0:
            words[5:5] = [rng.choice("xy")] * rng.randrange(45)
        if d % 4 == 0 and docs:
            words += docs[rng.randrange(len(docs))][1].split()[rng.randrange(8) :]
        docs.append((d, rng.choice([" ", "\n", " \t"]).join(words)))
    assert result(spark, docs) == brute(docs)


def test_odd_rows(spark):
    passage = " ".join(f"w{k}" for k in range(30))
    docs = [(1, None), (2, ""), (3, " \n"), (None, passage), (4, "é " + passage + " ü"), (4, passage), (5, passage), (5, passage), (6, "w0 w1"), (7, "long " * 60_000 + passage)]
    assert result(spark, docs) == brute(docs)
    assert result(spark, []) == []


def test_keys_depend_on_the_window_alone():
    rng = np.random.default_rng(1)
    for trial in range(200):
        core = rng.integers(0, 3 if trial % 2 else 50, 20).astype(np.uint64)
        keys = set()
        for _ in range(6):
            left, right = (rng.integers(0, 3 if trial % 2 else 50, rng.integers(0, 30)).astype(np.uint64) for _ in range(2))
            words = substrings.mix(np.concatenate([left, core, right]) + np.uint64(1))
            start, key, _ = substrings.window_keys(words, np.zeros(len(words), dtype=np.int64))
            keys.add(int(key[start == len(left)][0]))
        assert len(keys) == 1


@pytest.mark.parametrize("length", [64, 1024, 4096])
def test_long_words_that_collide_in_a_polynomial(spark, length):
    thue = "".join("ab"[bin(k).count("1") % 2] for k in range(length))
    common = " ".join(f"w{k}" for k in range(19))
    rows = [(1, f"{common} {thue}"), (2, f"{common} {thue.translate(str.maketrans('ab', 'ba'))}"), (3, f"{common} {thue}")]
    got = {r.doc_id: r.n_removed for r in substrings.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 0, 3: 20}
