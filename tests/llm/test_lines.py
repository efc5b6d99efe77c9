import random
import re

from pyspark.sql import functions as F

from certalog.llm import lines


def shingle_set(line):
    return {line[i : i + 8] for i in range(max(1, len(line) - 7))}


def anchored_set(line):
    """Shingles at the starts of words and far before their ends, by a plain scan."""
    out, at, n = set(), 0, len(line)
    space = " \t\n\x0b\f\r"
    run = lambda c: c.isascii() and c.isalnum() or 0x80 <= ord(c) < 0x2E80
    sign = lambda c: c.isascii() and not c.isalnum() and "!" <= c <= "~"
    while at < n:
        if line[at] in space:
            at += 1
            continue
        out.add(line[at : at + 8])
        start = at
        at += 1
        if run(line[start]):
            end = at
            while end < n and run(line[end]):
                end += 1
            at = end if end - start <= 8 else at
        while at < n and sign(line[at]):
            at += 1
    return out


def similarity(a, b):
    shared = len(a & b)
    return shared / (len(a) + len(b) - shared)


def brute(docs):
    """Kept text of each (doc_id, text), by all pairs."""
    spots = [(d, p, line) for d, t in docs if t is not None for p, line in enumerate(t.split("\n")) if re.search(r"[^ \t\n\x0b\f\r]", line)]
    spots.sort(key=lambda s: s[:2])
    names = sorted({s[2] for s in spots})
    sets, root = [shingle_set(n) for n in names], list(range(len(names)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(names)):
        for j in range(i):
            if similarity(sets[i], sets[j]) >= 0.8:
                root[find(i)] = find(j)
    of = {n: find(i) for i, n in enumerate(names)}
    seen, gone = set(), set()
    for d, p, line in spots:
        if of[line] in seen:
            gone.add((d, p))
        seen.add(of[line])
    return {d: None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (d, p) not in gone) for d, t in docs}


def test_against_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 260").select("doc_id", "text")
    docs = [(r.doc_id, r.text) for r in df.collect()]
    words = docs[0][1].replace("\n", " ").split()[:30]
    near = [" ".join(words[:k] + ["changed"] + words[k + 1 :]) for k in (3, 11, 20)]
    docs += [(1000 + k, t) for k, t in enumerate(near)] + [(2000, " ".join(words)), (2001, None), (2002, ""), (2003, "a\n\n \nb\na")]
    got = {r.doc_id: r.text for r in lines.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    want = brute(docs)
    assert got.keys() == want.keys()
    differ = [d for d in want if got[d] != want[d]]
    assert len(differ) <= 2, differ  # banding may miss a link now and then
    assert [got[1000 + k] for k in range(3)] == [""] * 3 or got[2000] == ""
    assert got[2001] is None and got[2002] == "" and got[2003] == "a\n\n \nb"


def test_chains_against_brute_force(spark):
    rng, families = random.Random(3), []
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(4, 7)))
    for _ in range(25):
        family = [[word() for _ in range(24)]]
        while len(family) < 16:  # each is like the one it comes from, seldom like the others
            child = list(rng.choice(family))
            child[rng.randrange(24)] = word()
            family.append(child)
        families.append(family)
    docs = [(k, " ".join(w)) for k, w in enumerate(w for f in families for w in f)]
    rng.shuffle(docs)
    got = {r.doc_id: r.text for r in lines.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    want = brute(docs)
    kept, most = sum(t != "" for t in got.values()), sum(t != "" for t in want.values())
    assert all(got[d] for d in want if want[d])
    assert kept - most <= 4, (kept, most)  # 400 lines; a line that shares no band with any is lost, once in a hundred at the threshold


def test_recall_of_links(spark):
    """Share of all pairs at the threshold or above that end in one component, each pair alone in the world."""
    rng, pairs = random.Random(8), []
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 10)))
    while len(pairs) < 1500:
        a = [word() for _ in range(rng.randint(12, 60))]
        b = list(a)
        for _ in range(rng.randint(1, 4)):
            b[rng.randrange(len(b))] = word()
        a, b = " ".join(a), " ".join(b)
        if a != b and similarity(shingle_set(a), shingle_set(b)) >= 0.8:
            pairs.append((a, b))
    assert recall(spark, pairs) >= 0.98


def recall(spark, pairs):
    """Share of the pairs that end in one component, each pair alone in the world."""
    docs = [(2 * k + i, t) for k, p in enumerate(pairs) for i, t in enumerate(p)]
    got = {r.doc_id: r.text for r in lines.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(got[2 * k] for k in range(len(pairs)))
    return sum(not got[2 * k + 1] for k in range(len(pairs))) / len(pairs)


def test_recall_of_links_by_characters(spark):
    """Characters put in, taken out and replaced anywhere: words, tokens without blanks, a script without them, signs beyond U+2E7F."""
    rng, pairs = random.Random(9), []
    some = lambda lo, hi, letters: "".join(rng.choice(letters) for _ in range(rng.randint(lo, hi)))
    latin, thai, han = "abcdefghijklmnopqrstuvwxyz", [chr(c) for c in range(0xE01, 0xE3A)], [chr(c) for c in range(0x4E00, 0x4F00)]
    kinds = [lambda: " ".join(some(2, 10, latin) for _ in range(rng.randint(12, 60))), lambda: some(150, 400, latin), lambda: some(100, 300, thai), lambda: some(60, 200, han)]
    while len(pairs) < 1600:
        a = kinds[len(pairs) % 4]()
        b = list(a)
        for _ in range(rng.randint(1, 6)):
            at, kind = rng.randrange(len(b)), rng.randrange(3)
            b[at : at + (kind < 2)] = [] if kind == 0 else [rng.choice(a)]
        b = "".join(b)
        if a != b and 0.8 <= similarity(shingle_set(a), shingle_set(b)):
            pairs.append((a, b))
    assert recall(spark, pairs) >= 0.98


def test_one_character_put_in_early(spark):
    """In a token of 300 letters and in 200 letters of a script without blanks."""
    rng = random.Random(4)
    token, thai = "".join(rng.choice("abcdefghij") for _ in range(300)), "".join(chr(rng.randrange(0xE01, 0xE3A)) for _ in range(200))
    docs = [(1, token), (2, "x" + token), (3, thai), (4, thai[:3] + thai[0] + thai[3:])]
    assert [r.text for r in lines.dedup(spark.createDataFrame(docs, "doc_id long, text string")).orderBy("doc_id").collect()] == [token, "", thai, ""]


def test_mutation_tree_is_one_component(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(4, 7)))
    family = [[word() for _ in range(40)]]
    while len(family) < 251:
        child = list(rng.choice(family))
        for _ in range(2):
            child[rng.randrange(40)] = word()
        family.append(child)
    docs = [(k, " ".join(w)) for k, w in enumerate(family)]
    got = lines.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sum(r.text != "" for r in got) == sum(t != "" for t in brute(docs).values())


def test_every_character_counts(spark):
    texts = ["https://example.org/one/first-page", "https://example.org/two/second-page", "Andththwhes.", "Andththwhwh.", "key=0123456789abcdef", "key=01234567x9abcdef"]
    texts += ["Antidisestablishment" + "abcdefgh" * 9, "Antidisestablishment" + "abcdefgx" * 9]
    docs = list(enumerate(texts))
    assert all(r.text for r in lines.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    for line in ["one two, three.", "https://a.b/c?d=e", "x" * 50, "天地玄黄 and more", "  lead", "a\tb"]:
        found = spark.createDataFrame([(line,)], "line string").select(lines.anchored(F.col("line")), lines.shingles(F.col("line"))).first()
        assert set(found[1]) == shingle_set(line)
        found = found[0]
        assert set(found) == anchored_set(line)
        assert set("".join(found)) >= set(line.strip())


def test_hot_lines_bands_and_components_are_joined_apart(spark, monkeypatch):
    from certalog.llm import common

    monkeypatch.setattr(common, "NARROW", 10)
    monkeypatch.setattr(common.join_counted, "__defaults__", (6,))
    words = [f"word{k}" for k in range(30)]
    docs = [(k, "a common line\n" + " ".join([*words, f"end{k % 40}"])) for k in range(120)] + [(500, None), (501, "alone")]
    got = {r.doc_id: r.text for r in lines.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute(docs)


def test_odd_rows(spark):
    rows = [(1, "same line here", "x", 9), (1, "same line here", "x", 9), (None, "same line here", "y", 9), (2, "天地玄黄宇宙洪荒日月盈昃\n天地玄黄宇宙洪荒日月盈昃", "z", 9)]
    rows += [(3, "word " * 50_000 + "\n" + "\n".join(f"line number {k} of many {k * k}" for k in range(20_000)), "w", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, k1 string, n_lines int")
    got = lines.dedup(df).collect()
    assert len(got) == 5 and "k1" in got[0].asDict()
    assert sorted(r.text for r in got if r.doc_id == 1) == ["", ""]
    assert [(r.text, r.n_removed) for r in got if r.doc_id is None] == [("same line here", 0)]
    assert [(r.text, r.n_lines) for r in got if r.doc_id == 2] == [("天地玄黄宇宙洪荒日月盈昃", 2)]
    assert [r.n_lines for r in got if r.doc_id == 3] == [20_001]
    assert lines.dedup(df.limit(0)).collect() == []


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "a line\nand a line"), (2, "a line")], "doc_id long, text string")
    plan = lines.dedup(df)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_sketches_spare_the_sets_of_unlike_lines_and_lose_no_link(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh国") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 120))) for _ in range(60)] + ["a", "abcdefg", "国", ""]
    texts += [t[: len(t) // 2] + rng.choice("xyz") + t[len(t) // 2 :] for t in texts[:60]]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, s string")
    each = lines.sketched_lines(rows).collect()
    assert len(each) == len(texts) and all(r.z >= len(shingle_set(r.s)) for r in each)
    spared = 0
    for i, a in enumerate(each):
        for b in each[:i]:
            far = sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(a.b, b.b)) * 1.8 > 0.2 * (a.z + b.z) + 1e-6
            spared += far
            assert not far or similarity(shingle_set(a.s), shingle_set(b.s)) < 0.8
    assert spared > 0.9 * len(each) * (len(each) - 1) / 2


def test_sketches_tell_long_unlike_lines_apart_and_count_their_shingles(spark):
    rng = random.Random(6)
    some = lambda n: "".join(rng.choice("abcdefgh 国😀") for _ in range(n))
    lines_of = [(a := some(900)) + some(300), a + some(300), "ab" * 500, "国😀", some(8), "x" * 40]
    each = lines.sketched_lines(spark.createDataFrame(list(enumerate(lines_of)), "k int, s string")).orderBy("k").collect()
    assert [r.z for r in each] == [len(shingle_set(r.s)) for r in each]
    a, b = each[:2]
    assert 0.5 < similarity(shingle_set(a.s), shingle_set(b.s)) < 0.7
    assert sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(a.b, b.b)) * 1.8 > 0.2 * (a.z + b.z)


def test_members_of_a_bucket_meet_their_hubs_once(spark):
    from certalog.llm import buckets
    from certalog.llm.common import scratch

    found = spark.createDataFrame([(band, k) for band, m in ((1, 2), (2, 10), (3, 40)) for k in range(100 * band, 100 * band + m)], "band int, k int")
    with scratch(spark):
        pairs = [frozenset((r.k, r.h)) for r in buckets.hub_pairs(buckets.met(found, 52, buckets.FEW)).collect()]
    count = {band: sum(min(p) // 100 == band for p in pairs) for band in (1, 2, 3)}
    h = buckets.HUBS
    assert len(set(pairs)) == len(pairs) and count == {1: 1, 2: 9, 3: h * (h - 1) // 2 + h * (40 - h)}
