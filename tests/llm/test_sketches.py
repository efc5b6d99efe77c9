import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from certalog.llm import sketches

KEYS = "doc_id long, text string"


def brute(rows):
    """doc_id, n_chars, sha256 of the edited text, and whether the next text is the same."""
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0], r[1]))
    out = []
    for k, (d, t) in enumerate(rows):
        u = rows[(k + 1) % len(rows)][1]
        q = len(t) // 4
        edited = t[: len(t) - q] + u[:q]
        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), likeness(t, edited), likeness(t, u)))
    return out


def bag(text):
    owner, start, stop, keys = sketches.pieces([text.encode()])
    return {k: b - a for k, a, b in zip(keys.tolist(), start.tolist(), stop.tolist())}


def likeness(a, b):
    """By the sets of pieces themselves, without sketches."""
    x, y = bag(a), bag(b)
    total = len(a.encode()) + len(b.encode())
    return 2 * sum(x[k] for k in x.keys() & y.keys()) / total if total else 1.0


def prose(rng, n):
    return " ".join(rng.choice(("alpha", "beta", "gamma", "delta", "über", "naïve", "国械", "zeta")) + str(rng.randrange(50)) for _ in range(n))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=300), max_size=6))
def test_pieces_cover_the_text_and_depend_on_it_alone(texts):
    raw = [t.encode() for t in texts]
    owner, start, stop, keys = sketches.pieces(raw)
    for k, t in enumerate(raw):
        mine = owner == k
        assert b"".join(t[a:b] for a, b in zip(start[mine], stop[mine])) == t
        assert "".join(t[a:b].decode() for a, b in zip(start[mine], stop[mine])).encode() == t  # whole characters
        alone = sketches.pieces([t])
        assert keys[mine].tolist() == alone[3].tolist()
        assert len(set(keys[mine].tolist())) == mine.sum()  # repeats have keys of their own


@pytest.mark.parametrize("n, apart", [(0, 0), (5, 1), (40, 3), (300, 40), (3000, 2500)])
def test_peeling_recovers_the_difference(n, apart):
    rng = np.random.default_rng(n)
    keys = rng.integers(1, 1 << 63, n + apart, dtype=np.uint64)
    old, new = keys[: n + apart // 2], np.r_[keys[:n], keys[n + apart // 2 :]]
    cells = 8
    while True:
        a, b = sketches.Sketches(1, cells), sketches.Sketches(1, cells)
        for s, x in ((a, old), (b, new)):
            s.add(np.zeros(len(x), dtype=np.int64), x, np.full(len(x), 7))
        _, found, sign, weight, empty = a.minus(b).peel()
        if empty[0]:
            break
        cells *= 4
    assert set(found[sign > 0].tolist()) == set(old.tolist()) - set(new.tolist())
    assert set(found[sign < 0].tolist()) == set(new.tolist()) - set(old.tolist())
    assert (weight == 7).all() and cells * 3 <= max(24, 40 * apart)


def test_fingerprints_alone_tell_a_small_difference():
    rng = random.Random(2)
    text = "\n".join(prose(rng, 6) for _ in range(200))
    other = text.replace("\n", "\nNew line.\n", 2)
    marks = sketches.Versions([text, other]).base.told()
    removed, added = sketches.difference(*marks)
    assert set(removed) == bag(text).keys() - bag(other).keys() and set(added) == bag(other).keys() - bag(text).keys() and added
    assert sketches.difference(marks[0], sketches.Versions([prose(rng, 4000)]).base.told()[0]) is None


def test_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(k * 7, prose(rng, rng.choice((0, 1, 3, 30, 300)))) for k in range(120)]
    rows += [(3, None), (None, "no id"), (None, None), (12, "  "), (13, "\n\n\n"), (1000, "word " * 30_000), (1001, "x" * 200_000), (1002, prose(rng, 20_000))]
    rows += [(2000, rows[30][1])] * 4 + [(2001, rows[30][1]), (2002, rows[30][1] + " more")]
    rng.shuffle(rows)
    got = sketches.fingerprints(spark.createDataFrame([(d, t, "?", 1) for d, t in rows], KEYS + ", lang string, n_chars int")).collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == Counter((*r[:3], round(r[3], 9), round(r[4], 9)) for r in brute(rows))
    marks = {}
    for r in got:
        marks.setdefault(r.fingerprint, set()).add(r.doc_id)
    texts = {}
    for d, t in rows:
        texts.setdefault(t or "", set()).add(d)
    assert sorted(map(str, marks.values())) == sorted(map(str, texts.values()))


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = sketches.op11_fingerprints(spark, "/root/testdata/sf0.001").collect()
    want = brute([(r.doc_id, r.text) for r in df.collect()])
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == sorted((*r[:3], round(r[3], 9), round(r[4], 9)) for r in want)
    long = [r for r in got if r.n_chars > 400]
    assert all(r.near_edited > 0.3 for r in long) and sum(r.near_edited > 0.6 for r in long) > 0.94 * len(long) and sum(r.near_next < 0.2 for r in long) > 0.9 * len(long)


def test_one_row_and_none(spark):
    df = spark.createDataFrame([(5, "abcdefgh")], KEYS)
    (r,) = sketches.fingerprints(df).collect()
    assert (r.n_chars, r.edited_sha256, r.near_next) == (8, hashlib.sha256(b"abcdefab").hexdigest(), 1.0)
    assert sketches.fingerprints(df.where("false")).collect() == []


def test_changes_of_versions(spark):
    rng = random.Random(6)
    old = "\n".join(prose(rng, 5) for _ in range(50))
    new = old.replace("\n", "\ninserted paragraph\n", 1)
    rows = [(1, old, new, 0), (2, None, None, 0), (3, "", "a", 0), (1, old, new, 0), (4, old, old, 0), (None, old, None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, old string, new string, likeness int")
    got = {(r.doc_id, r.likeness): r for r in sketches.changes(df).collect()}
    one = next(r for r in got.values() if r.doc_id == 1)
    assert "inserted paragraph\n" in "".join(x.piece for x in one.added) and 0.9 < one.likeness < 1
    assert got[(4, 1.0)].removed == [] and got[(2, 1.0)].added == [] and [x.piece for x in got[(3, 0.0)].added] == ["a"]
    assert len("".join(x.piece for x in got[(None, 0.0)].removed)) == len(old)
    assert sketches.changes(df).count() == 6 and sketches.changes(df.where("false")).collect() == []
