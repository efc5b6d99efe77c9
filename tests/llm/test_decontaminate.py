import random
import time

import numpy as np

from certalog.llm import decontaminate as dec


def slow_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(words, items, similarity=0.8):
    """Items that some stretch of the words is near enough to."""
    out = set()
    for i, t in items:
        x = dec.plain_words(t)
        d = dec.edits(len(x), similarity)
        for p in range(len(words)):
            if any(slow_distance(x, words[p : p + m]) <= d for m in range(max(1, len(x) - d), len(x) + d + 1)):
                out.add(i)
                break
    return out


def changed(words, rng, k):
    words = list(words)
    for _ in range(k):
        p = rng.randrange(len(words)) if words else 0
        way = rng.randrange(3)
        words[p : p + 1] = [] if way == 0 or not words else ["Edited"] if way == 1 else [words[p], "more"]
    return words


def test_edited_copies_are_found(spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()]
    own = dec.Items(items, 0.8)
    rng = random.Random(1)
    clean = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id between 40 and 60").collect()
    missed = asked = 0
    for i, t in items:
        words = t.split()
        for share in (0, 0.1, 0.2):
            copy = changed(words, rng, int(share * len(words)))
            text = " ".join(clean[i % len(clean)].text.split()[:80] + copy + ["tail", "end"])
            plain = dec.plain_words(text)
            got = own.matches(plain)
            asked += 1
            missed += i not in {own.items[k][0] for k, *_ in got}
            for k, start, end, distance in got:
                assert slow_distance(dec.plain_words(dict(items)[own.items[k][0]]), plain[start:end]) == distance
    assert missed <= asked * 0.02


def test_walks_depend_on_the_words():
    own = dec.Items([(1, " ".join(f"w{k}" for k in range(40)))], 0.8)
    moved = [own.walk(np.full(90, k), np.array([0]))[1, :, 0] for k in range(40)]
    share = np.mean(moved, axis=0)
    assert (0.2 < share).all() and (share < 0.8).all()


def test_deletions_and_insertions_at_the_weakest_similarity():
    rng = random.Random(8)
    items = [(k, " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(60)}" for _ in range(60))) for k in range(60)]
    own = dec.Items(items, 0.8)
    for insert in (False, True):
        missed = 0
        for i, t in items:
            words, tail = dec.plain_words(t), [b"tail%d" % k for k in range(70)]
            if insert:
                for k in range(12):
                    words.insert(rng.randrange(len(words) + 1), b"new%d" % k)
            else:
                for p in sorted(rng.sample(range(60), 12), reverse=True):
                    del words[p]
            missed += i not in {own.items[k][0] for k, *_ in own.matches(tail + words + tail)}
        assert missed <= 2, (insert, missed)


def test_items_back_to_back():
    item = "one two three four five six seven eight nine ten"
    own = dec.Items([(1, item)], 0.8)
    words = dec.plain_words(f"head {item} {item} one two three changed five six seven eight nine ten {item} tail")
    assert sorted(own.matches(words)) == [(0, 1, 11, 0), (0, 11, 21, 0), (0, 21, 31, 1), (0, 31, 41, 0)]


def test_an_item_repeated_takes_linear_time():
    own = dec.Items([(1, " ".join(f"w{k % 37}" for k in range(40)))], 0.8)
    words = dec.plain_words((" ".join(f"w{k % 37}" for k in range(40)) + " ") * 1500)
    start = time.process_time()
    found = own.matches(words)
    assert sorted(found) == [(0, 40 * k, 40 * k + 40, 0) for k in range(1500)]
    assert time.process_time() - start < 60


def test_places_overlap_nothing_and_leave_nothing():
    rng = random.Random(6)
    for _ in range(300):
        x = np.array([rng.randrange(4) for _ in range(rng.randint(3, 9))])
        text = np.array([rng.randrange(4) for _ in range(rng.randint(1, 40))])
        most = len(x) // 4
        found = dec.places(x, text, most)
        assert all(a[1] <= b[0] for a, b in zip(found, found[1:]))
        for a, b, distance in found:
            assert dec.closest(x, text[a:b], anchored=True)[0] <= distance <= most
        assert bool(found) == (dec.distances(x, text).min() <= most)
        assert not found or min(f[2] for f in found) == dec.distances(x, text).min()


def test_against_brute_force():
    rng = random.Random(4)
    items = [(k, " ".join(rng.choice("abcdefgh") + str(rng.randrange(9)) for _ in range(n))) for k, n in enumerate((1, 2, 3, 5, 6, 9, 12, 15))]
    own = dec.Items(items, 0.8)
    missed = 0
    for _ in range(60):
        words = [rng.choice("abcdefgh") + str(rng.randrange(9)) for _ in range(25)]
        i, t = items[rng.randrange(len(items))]
        words[7:7] = [w.lower() for w in changed(t.split(), rng, rng.randrange(4))]
        plain = [w.encode() for w in words]
        got, want = {own.items[k][0] for k, *_ in own.matches(plain)}, brute(plain, items)
        assert got <= want
        missed += len(want - got)
    assert missed <= 2


def test_closest():
    x = np.array([1, 2, 3, 4])
    assert dec.closest(x, np.array([9, 1, 2, 4, 9])) == (1, 4)
    assert dec.closest(x, np.array([], dtype=np.int64)) == (4, 0)
    assert dec.closest(x, np.array([1, 2, 3, 4]), anchored=True) == (0, 4)


def test_odd_rows(spark):
    item = "one two three four five six seven eight nine ten"
    rows = [(1, None, 0), (2, "", 0), (3, "word " * 100_000 + item, 0), (4, item.upper().replace(" ", ", "), 0), (4, item, 0), (None, item, 0), (5, item[:20], 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(1, item), (2, item), (3, None), (4, ""), (None, item), (1, item)], "item_id long, text string")
    got = dec.leaks(docs, items).collect()
    assert sorted((r.doc_id or 0, r.item_id, r.start, r.end, r.edits) for r in got) == sorted(
        (d, i, s, s + 10, 0) for d, s in ((0, 0), (3, 100_000), (4, 0), (4, 0)) for i in (1, 2)
    )
    assert sorted((r.doc_id or 0, r.item_id) for r in dec.leaks(docs, items, pass_bytes=20).collect()) == sorted((r.doc_id or 0, r.item_id) for r in got)
    assert sorted(r.doc_id for r in dec.without_leaks(docs, items).collect()) == [1, 2, 5]
    assert dec.leaks(docs, items.limit(0)).collect() == [] == dec.leaks(docs.limit(0), items).collect()


def test_long_items_walk_in_bounded_memory():
    rng = random.Random(4)
    words = [f"w{rng.randrange(5000)}" for _ in range(3000)]
    own = dec.Items([(7, " ".join(words))], 0.8)
    text = ["before"] * 20 + changed(words, rng, 60) + ["after"] * 20
    found = own.matches([w.encode() for w in " ".join(text).lower().split()])
    assert [f[0] for f in found] == [0] and found[0][3] <= 60
    assert own.steps * dec.WALKS * 4 * max(1, dec.WALK_BYTES // (4 * dec.WALKS * own.steps)) <= dec.WALK_BYTES
