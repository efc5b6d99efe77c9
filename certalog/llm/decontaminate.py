"""Benchmark decontamination: CGK embeddings of item-sized windows, bit-sampling LSH, exact edit distance."""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from certalog.llm.common import arrow_map, table
from certalog.llm.tokens import mix

#: Similarity of a window to an item (1 - edits / item words) that counts, repetitions of the walk, positions of a sample.
#: Set by recall on copies of the longest items (sf0.01) with a fifth of their words deleted, inserted or replaced, 276 of each kind:
#: 1.000 of all three; 32 walks: 0.986, 1.000, 0.996; 32 walks with samples of 3 find 0.928 of the deletions (69 copies).
SIMILARITY, WALKS, SAMPLE = 0.8, 64, 2
#: Bytes of items searched for in one pass over the documents.
PASS_BYTES = 8 << 20
#: Bytes of the walks that are held at a time; the longer the longest item, the fewer windows walk together.
WALK_BYTES = 64 << 20
_PLAIN = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
PAD = -2


def plain_words(text: str | None) -> list[bytes]:
    """Words in lower case; ASCII signs other than letters and digits part words."""
    return (text or "").lower().encode().translate(_PLAIN).split()


def edits(n: int, similarity: float) -> int:
    """Word edits that an item of n words may have."""
    return int((1 - similarity) * n + 1e-9)


class Items:
    """The items of one pass: vocabulary, grams that a match must hold, and LSH keys by item size."""

    def __init__(self, items: list[tuple[int, str]], similarity: float, seed: int = 5):
        self.items = [(i, w) for i, w in ((i, plain_words(t)) for i, t in items) if w]
        names = sorted({w for _, ws in self.items for w in ws})
        self.vocabulary = {w: k for k, w in enumerate(names)}
        self.ids = [np.array([self.vocabulary[w] for w in ws], dtype=np.int64) for _, ws in self.items]
        self.most = {n: edits(n, similarity) for n in {len(x) for x in self.ids}}
        self.seed = seed
        # q-gram lemma: a window within d edits of n words shares at least n - q + 1 - q d of the item's q-grams
        self.gram, self.least = {}, {}
        for n, d in self.most.items():
            self.gram[n] = next(q for q in (3, 2, 1) if n - q + 1 - q * d >= 1)
            self.least[n] = n - self.gram[n] + 1 - self.gram[n] * d
        self.base = len(names) + 1
        self.grams = {q: np.unique(np.concatenate([self.codes(x, q) for x in self.ids if self.gram[len(x)] == q])) for q in set(self.gram.values())}
        rng = np.random.default_rng(seed)
        self.places = {n: rng.integers(0, max(1, 2 * n), size=(WALKS, SAMPLE)) for n in sorted(self.most)}
        self.steps = 2 * max(self.most, default=0)
        self.keys = {}
        for n in self.most:
            mine = [k for k, x in enumerate(self.ids) if len(x) == n]
            keys = np.stack([self.window_keys(self.ids[k], np.array([0]), self.walk(self.ids[k], np.array([0])), n, np.array([0]))[:, 0] for k in mine])
            self.keys[n] = (keys, np.array(mine))

    def codes(self, ids: np.ndarray, q: int) -> np.ndarray:
        """One number for each q-gram; negative where a word is unknown."""
        if len(ids) < q:
            return np.zeros(0, dtype=np.int64)
        code, unknown = np.zeros(len(ids) - q + 1, dtype=np.int64), np.zeros(len(ids) - q + 1, dtype=bool)
        for k in range(q):
            part = ids[k : len(ids) - q + 1 + k]
            code = code * self.base + part
            unknown |= part < 0
        code[unknown] = -1
        return code

    def walk(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """(step, walk, start): how far past its start each random walk reads at each step.

        CGK: a walk reads a word at each step and moves on by a random bit that depends on the step and the word, so
        windows few edits apart fall into step again. Windows of all sizes that begin alike share their walks.
        """
        far = np.zeros((self.steps, WALKS, len(starts)), dtype=np.int32)
        at = np.zeros((WALKS, len(starts)), dtype=np.int32)
        word = mix(np.append(ids, PAD).astype(np.uint64))
        odd = mix(np.arange(self.steps * WALKS, dtype=np.uint64) + np.uint64(1 + 1000 * self.seed)).reshape(self.steps, WALKS, 1) | np.uint64(1)
        for j in range(self.steps):
            far[j] = at
            here = word[np.minimum(starts + at, len(ids))]
            at = at + (here * odd[j] >> np.uint64(63)).astype(np.int32)
        return far

    def window_keys(self, ids: np.ndarray, starts: np.ndarray, far: np.ndarray, n: int, which: np.ndarray) -> np.ndarray:
        """(walk, start): hash of the sampled words of each walk over the window of n words, for some of the starts."""
        place = self.places[n]
        read = far[place, np.arange(WALKS)[:, None], :][:, :, which]
        at = starts[which] + read
        word = np.where((read < n) & (at < len(ids)), ids[np.minimum(at, len(ids) - 1)], PAD)
        key = np.zeros((WALKS, len(which)), dtype=np.uint64)
        for t in range(SAMPLE):
            key = mix(key + word[:, t].astype(np.uint64) + np.uint64(0x9E37 + t))
        return key

    def matches(self, words: list[bytes]) -> list[tuple[int, int, int, int]]:
        """(item index, start, end, edits) of each item's best places in the words; end exclusive."""
        if not self.items or not words:
            return []
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        total = {}
        for q, known in self.grams.items():
            code = self.codes(ids, q)
            some = np.flatnonzero(code >= 0)
            hit = np.zeros(len(ids) + 1, dtype=np.int64)
            if len(some):
                own = code[some]
                hit[some + 1] = known[np.minimum(np.searchsorted(known, own), len(known) - 1)] == own
            total[q] = np.cumsum(hit)
        near: dict[int, np.ndarray] = {}
        # starts before which a window of the widest size holds enough grams for some item; few texts have any
        wide, fewest = max(n + d for n, d in self.most.items()), min(self.least.values())
        dense = {}
        for q, sums in total.items():
            if sums[-1] >= fewest:
                inside = np.append(sums, np.full(wide, sums[-1]))[wide:] - sums
                dense[q] = np.flatnonzero(inside >= fewest)
        for n, d in self.most.items():
            sums, start = total[self.gram[n]], dense.get(self.gram[n], ())
            if len(start):
                start = start[start <= max(0, len(ids) - n + d)]
                inside = sums[np.minimum(start + n + d, len(ids))] - sums[start]
                found = start[inside >= self.least[n]]
                if len(found):
                    near[n] = found
        if not near:
            return []
        starts = np.unique(np.concatenate(list(near.values())))
        out = []
        many = min(512, max(1, WALK_BYTES // (4 * WALKS * self.steps)))
        for a in range(0, len(starts), many):
            part = starts[a : a + many]
            far = self.walk(ids, part)
            for n, own in near.items():
                mine = np.flatnonzero(np.isin(part, own, assume_unique=True))
                if not len(mine):
                    continue
                got = self.window_keys(ids, part, far, n, mine)
                keys, items = self.keys[n]
                for row, item in zip(keys, items):
                    at = (got == row[:, None]).any(axis=0)
                    if at.any():
                        out += [(int(item), int(p)) for p in part[mine[at]]]
        return self.verified(ids, out)

    def verified(self, ids: np.ndarray, candidates: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
        """The best place in each stretch of candidate windows of an item, if close enough by exact edit distance, then those before and after it."""
        out, by_item = [], {}
        for item, p in candidates:
            by_item.setdefault(item, []).append(p)
        for item, starts in sorted(by_item.items()):
            x = self.ids[item]
            n, d = len(x), self.most[len(x)]
            starts = sorted(set(starts))
            at = 0
            while at < len(starts):
                upto = at
                while upto + 1 < len(starts) and starts[upto + 1] - starts[upto] <= n:
                    upto += 1
                lo, hi = max(0, starts[at] - d), min(len(ids), starts[upto] + n + d)
                at = upto + 1
                left = [(lo, hi)]
                while left:
                    lo, hi = left.pop()
                    if np.isin(x, ids[lo:hi]).sum() < n - d:  # each word that isn't there costs an edit
                        continue
                    found = places(x, ids[lo:hi], d)
                    out += [(item, lo + a, lo + b, distance) for a, b, distance in found]
                    # what lies between may hold places that the text over its edge hid
                    edges = [lo, *(lo + e for a, b, _ in found for e in (a, b)), hi]
                    left += [gap for gap in zip(edges[::2], edges[1::2]) if found and gap[1] - gap[0] >= n - d]
        return out


def places(x: np.ndarray, text: np.ndarray, most: int) -> list[tuple[int, int, int]]:
    """(start, end, edits) of disjoint stretches of text within most edits of x, in order; the nearest are taken first, of equal ones the first to end.

    The text is passed once, however often it holds x; a stretch that reaches over one taken before it is left out.
    """
    last = distances(x, text)
    ends = np.flatnonzero(last <= most) + 1
    taken, out = np.zeros(len(text) + 1, dtype=bool), []
    for end in ends[np.argsort(last[ends - 1], kind="stable")]:
        if taken[end - 1]:
            continue
        distance, length = closest(x[::-1], text[max(0, end - len(x) - most) : end][::-1], anchored=True)
        if length and not taken[end - length : end].any():
            taken[end - length : end] = True
            out.append((int(end) - length, int(end), distance))
    return sorted(out)


def distances(x: np.ndarray, text: np.ndarray) -> np.ndarray:
    """For each word of text the least edits between x and a stretch that ends with it."""
    steps = np.arange(len(x) + 1)
    column, fresh, last = steps.copy(), np.zeros_like(steps), np.zeros(len(text), dtype=np.int64)
    for k, w in enumerate(text):
        fresh[1:] = np.minimum(column[:-1] + (x != w), column[1:] + 1)
        column = np.minimum.accumulate(fresh - steps) + steps
        last[k] = column[-1]
    return last


def closest(x: np.ndarray, text: np.ndarray, anchored: bool = False) -> tuple[int, int]:
    """(edits, end) of the stretch of text nearest to x in words inserted, deleted and replaced; the first end of several.

    anchored: the stretch begins where the text does.
    """
    steps = np.arange(len(x) + 1)
    column = steps.copy()
    best = (int(column[-1]), 0)
    for k, w in enumerate(text):
        fresh = np.empty_like(column)
        fresh[0] = k + 1 if anchored else 0
        fresh[1:] = np.minimum(column[:-1] + (x != w), column[1:] + 1)
        column = np.minimum.accumulate(fresh - steps) + steps
        if column[-1] < best[0]:
            best = (int(column[-1]), k + 1)
    return best


def passes(items: DataFrame, id_col: str, similarity: float, pass_bytes: int):
    """The items in sets of about pass_bytes bytes of text, dealt by hash."""
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = -(-size // pass_bytes)
    for k in range(count):
        mine = items.where(F.pmod(F.xxhash64(id_col), F.lit(count)) == k).select(id_col, "text").distinct().orderBy(id_col, "text").collect()
        yield Items([(r[0], r[1]) for r in mine if r[0] is not None], similarity)


def leaks(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """(doc_id, item_id, start, end, edits): where documents hold an item, in words of the whole text, end exclusive.

    A place counts if words inserted, deleted and replaced are at most (1 - similarity) of the item's words. Windows of each
    item size start at every word; those that share too few word grams with the items to be that near (q-gram lemma, which loses
    none) are left out before the LSH. Items without words and null texts match nothing; items without id are left
    out; repeated documents give repeated rows; equal items are all reported. Items are broadcast pass_bytes at a time,
    as many passes over the documents as that takes.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, item_id long, start int, end int, edits int"
    out = None
    for found in passes(items, "item_id", similarity, pass_bytes):
        shared = spark.sparkContext.broadcast(found)

        def run(batch: pa.RecordBatch, shared=shared):
            own, rows = shared.value, []
            for k, text in enumerate(batch.column(1)):
                for item, start, end, distance in own.matches(plain_words(text.as_py())):
                    rows.append((k, own.items[item][0], start, end, distance))
            ids = batch.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
            rest = [pa.array([r[c] for r in rows], t) for c, t in ((1, pa.int64()), (2, pa.int32()), (3, pa.int32()), (4, pa.int32()))]
            yield pa.RecordBatch.from_arrays([ids, *rest], names=["doc_id", "item_id", "start", "end", "edits"])

        one = arrow_map(docs.select("doc_id", "text"), run, schema)
        out = one if out is None else out.unionByName(one)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def without_leaks(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs that hold no item, with all their columns; each row is judged by its own text, in one pass for each set of items."""
    at = docs.columns.index("text")
    for found in passes(items, "item_id", similarity, PASS_BYTES):
        shared = docs.sparkSession.sparkContext.broadcast(found)

        def run(batch: pa.RecordBatch, shared=shared):
            yield batch.filter(pa.array([not shared.value.matches(plain_words(t.as_py())) for t in batch.column(at)], pa.bool_()))

        docs = arrow_map(docs, run, docs.schema)
    return docs


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
