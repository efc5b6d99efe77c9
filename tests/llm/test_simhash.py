import numpy as np
import pytest
import xxhash

from certalog.llm import simhash


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({k: " " for k in (9, 10, 11, 12, 13)}).split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows):
    fps = [plain_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, fps[i], least[find(i)]) for i, (d, _) in enumerate(rows))


def result(spark, rows):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, fp string, component string")
    return sorted((r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(df).collect())


def test_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows += [(5000, None), (5001, ""), (5002, " \t\n"), (5003, "one"), (5004, "one two"), (5003, "one"), (5005, "É Ü word " * 5000)]
    assert result(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert result(spark, []) == []


def test_repeated_rows_and_ties(spark):
    rows = [(3, "a b c d"), (3, "a b c d"), (1, "A B C D"), (2, None)]
    assert result(spark, rows) == brute(rows)


@pytest.mark.parametrize("radius", [0, 1, 3, 4])
def test_within_counts_every_plane(radius):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 5, dtype=np.uint64)
    fps = np.array([b ^ np.uint64(sum(1 << int(k) for k in rng.choice(64, n, replace=False))) for b in base for n in range(7)], dtype=np.uint64)
    got = {tuple(p) for p in simhash.within(fps, simhash.planes_of(fps), len(fps), radius).tolist()}
    want = {(i, j) for i in range(len(fps)) for j in range(len(fps)) if bin(int(fps[i] ^ fps[j])).count("1") <= radius}
    assert got == want


def test_near_copies_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "UNIT", 16)
    rng = np.random.default_rng(2)
    fps = {0}
    for _ in range(120):
        x = int(rng.choice(list(fps)))
        fps.add(x ^ (1 << int(rng.integers(0, 20))))
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    links = [(r.a, r.b) for r in simhash.near_links(df).collect()]
    assert all(bin(a ^ b).count("1") <= 3 for a, b in links)
    seen, todo = {0}, [0]
    while todo:
        x = todo.pop()
        for a, b in links:
            for y in ((b,) if a == x else (a,) if b == x else ()):
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
    assert seen == fps


def word_sets(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({k: " " for k in (9, 10, 11, 12, 13)}).split(" ")
    words = [w for w in words if w]
    return " ".join(words), {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    shared = len(a & b)
    return shared / (len(a) + len(b) - shared) if a or b else 1.0


def brute_keep(rows):
    """The (doc_id, text) rows that stay, by all pairs."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
    told = [word_sets(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if told[i][0] == told[j][0] or jaccard(told[i][1], told[j][1]) >= 0.8:
                root[find(i)] = find(j)
    seen, kept = set(), []
    for i in order:
        if find(i) not in seen:
            seen.add(find(i))
            kept.append(rows[i])
    return kept


def test_keep_one_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect() if len(r.text or "") < 4000]
    rng = np.random.default_rng(4)
    words = [f"w{k}" for k in range(120)]
    family = [words]
    while len(family) < 60:
        child = list(family[rng.integers(len(family))])
        for _ in range(2):
            child[rng.integers(120)] = f"x{rng.integers(10**6)}"
        family.append(child)
    rows += [(9000 + k, " ".join(w)) for k, w in enumerate(family)]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, fp string")
    got = simhash.keep_one(df)
    assert got.columns == df.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(d for d, _ in brute_keep(rows))


def test_keep_one_of_odd_rows(spark):
    long = " ".join(f"a{k}" for k in range(30_000))
    rows = [(1, "one two three"), (1, "one two three"), (1, "something else"), (2, "ONE two  three"), (None, "x y z"), (None, "x y z"), (3, "x y z"), (4, None), (5, ""), (6, " \n"), (7, long), (8, long + " end")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.text) for r in simhash.keep_one(df).collect()), key=lambda r: (r[0], str(r[1])))
    assert got == [(0, "x y z"), (1, "one two three"), (1, "something else"), (4, None), (7, long)]
    assert simhash.keep_one(df.limit(0)).collect() == []


def test_recall_of_near_copies(spark):
    """Share of pairs of texts at the threshold or above that become one."""
    rng, pairs = np.random.default_rng(6), []
    while len(pairs) < 400:
        a = [f"w{x}" for x in rng.integers(0, 5000, rng.integers(30, 400))]
        b = list(a)
        for _ in range(rng.integers(1, 9)):
            b[rng.integers(len(b))] = "new"
        if a != b and jaccard(word_sets(" ".join(a))[1], word_sets(" ".join(b))[1]) >= 0.8:
            pairs.append((" ".join(a), " ".join(b)))
    df = spark.createDataFrame([(2 * k + i, t) for k, p in enumerate(pairs) for i, t in enumerate(p)], "doc_id long, text string")
    kept = {r.doc_id for r in simhash.keep_one(df).collect()}
    assert {2 * k for k in range(len(pairs))} <= kept
    assert sum(2 * k + 1 not in kept for k in range(len(pairs))) >= 0.98 * len(pairs)


def test_null_ids(spark):
    rows = [(None, "a b c d e"), (None, "q"), (4, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == [(0, 4), (0, None), (4, 4)]
