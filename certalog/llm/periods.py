"""Runs: stretches of words that repeat with a period four times or more, found by convolutions of blocks at dyadic scales."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from certalog.llm.common import table

#: A run has at least so many words and so many periods (fixed values).
LEAST, POWER = 6, 4
#: Transforms are taken modulo this prime, 15 * 2 ** 27 + 1, of which ROOT is a primitive root.
PRIME, ROOT = 2013265921, 31
#: Words worked on together (longer texts by themselves), and numbers that one batch of transforms holds.
BLOCK, HELD = 1 << 19, 1 << 20


def _twiddles(size: int, root: int) -> np.ndarray:
    """root ** 0 ... root ** (size - 1), by doubling."""
    out, power = np.ones(1, dtype=np.uint64), root
    while len(out) < size:
        out = np.concatenate([out, out * np.uint64(pow(root, len(out), PRIME)) % np.uint64(PRIME)])
    return out[:size]


def ntt(rows: np.ndarray, inverse: bool = False) -> np.ndarray:
    """Number-theoretic transform of each row; the size is a power of two. Stockham's form: no reordering of places."""
    count, size = rows.shape
    root = pow(ROOT, (PRIME - 1) // size, PRIME)
    if inverse:
        root = pow(root, PRIME - 2, PRIME)
    p, x, half, span = np.uint64(PRIME), rows.reshape(count, size, 1), size // 2, 1
    while half:
        low, high = x[:, :half], x[:, half:]
        w = _twiddles(half, pow(root, span, PRIME))[None, :, None]
        both = np.empty((count, half, 2 * span), dtype=np.uint64)
        both[:, :, :span] = (low + high) % p
        both[:, :, span:] = (low + p - high) % p * w % p
        x, half, span = both, half // 2, 2 * span
    out = x.reshape(count, size)
    return out * np.uint64(pow(size, PRIME - 2, PRIME)) % p if inverse else out


def zero_distances(codes: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(block, distance) where the block codes[start : start + length] stands again, distance length or more and under twice the length later.

    By sums of squared differences of the block with every place of the window after it: squares by running sums, products by one
    transform each of block and window. Codes are small enough that no sum reaches PRIME, so a sum is 0 only of equal codes. Codes
    beyond the end are as of no word.
    """
    p = np.uint64(PRIME)
    padded = np.r_[codes, np.zeros(3 * length, dtype=np.uint64)]
    out_block, out_distance = [], []
    for low in range(0, len(starts), max(1, HELD // (2 * length))):
        at = starts[low : low + max(1, HELD // (2 * length))]
        block = padded[at[:, None] + np.arange(length)]
        window = padded[at[:, None] + length + np.arange(2 * length)]
        turned = np.zeros_like(window)
        turned[:, 0] = block[:, 0]
        turned[:, length + 1 :] = block[:, :0:-1]  # correlation is convolution with the block turned around
        product = ntt(ntt(window) * ntt(turned) % p, inverse=True)[:, :length]
        squares = np.zeros((len(at), 2 * length + 1), dtype=np.uint64)
        np.cumsum(window * window, axis=1, out=squares[:, 1:])
        own = (block * block).sum(axis=1)
        total = (squares[:, length : 2 * length] - squares[:, :length] + own[:, None] + np.uint64(2) * (p - product)) % p
        b, d = np.nonzero(total == 0)
        out_block.append(at[b])
        out_distance.append(d + length)
    return np.concatenate(out_block), np.concatenate(out_distance)


def _same(words: np.ndarray, at: int, period: int, step: int) -> int:
    """How many places from at on, in steps of 1 or -1, hold the word that stands a period later; in stretches that double."""
    n, width, end = 0, 64, len(words) - period
    while True:
        low, high = (at + n, min(at + n + width, end)) if step > 0 else (max(at - n - width + 1, 0), at - n + 1)
        if low >= high:
            return n
        unlike = np.flatnonzero(words[low:high] != words[low + period : high + period])
        if len(unlike):
            return n + int(unlike[0] if step > 0 else high - low - 1 - unlike[-1])
        n, width = n + high - low, 2 * width


def runs(words: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, period) of every run of a sequence of numbers, one number a word, by start, then period.

    A run of period q, length <= q < 2 * length for a power of two, holds a whole aligned block of that length which stands again q
    later: so the blocks' distances at each scale seed all runs. A block can stand again within twice its length only if each of
    its words does; the others need no transform. Nor does a block whose window lies in a known run of a period that is not longer than the block:
    it stands again only multiples of that period later. Each seed is extended over the words themselves.
    """
    n = len(words)
    found: dict[tuple[int, int], int] = {}
    if n < LEAST:
        return []
    # distance to the next place of the same word
    order = np.argsort(words, kind="stable")
    nxt = np.full(n, n, dtype=np.int64)
    same = words[order][1:] == words[order][:-1]
    nxt[order[:-1][same]] = (order[1:] - order[:-1])[same]
    # of each place the known run that reaches farthest: where it ends, and its period
    reach, period = np.zeros(n, dtype=np.int64), np.ones(n, dtype=np.int64)
    length, far = 1, nxt
    while POWER * length <= n:
        starts = np.flatnonzero(far < 2 * length) * length
        starts = starts[(reach[starts] < starts + 3 * length) | (period[starts] > length)]
        if len(starts):
            bits = (31 - length.bit_length()) // 2
            codes = (words.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)
            block, distance = zero_distances(codes, starts, length)
            inside = block + length + distance <= n
            block, distance = block[inside], distance[inside]
            known = (reach[block] >= block + length + distance) & (distance % period[block] == 0)
            block, distance = block[~known], distance[~known]
            for k in np.lexsort((block, distance)):
                b, q = int(block[k]), int(distance[k])
                if reach[b] >= b + length + q and q % period[b] == 0:
                    continue  # by a run found since
                if (words[b : b + length] != words[b + q : b + q + length]).any():
                    continue  # words of one code
                start = b - _same(words, b - 1, q, -1)
                end = b + length + _same(words, b + length, q, 1) + q
                if end - start >= 2 * q:
                    part = slice(start, end)
                    better = reach[part] < end
                    reach[part] = np.where(better, end, reach[part])
                    period[part] = np.where(better, q, period[part])
                if end - start >= max(LEAST, POWER * q):
                    found[start, end] = min(q, found.get((start, end), q))
        length *= 2
        pairs = len(far) // 2
        far = np.maximum(far[0 : 2 * pairs : 2], far[1 : 2 * pairs : 2])
    return sorted((s, e, q) for (s, e), q in found.items())


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of a document, those after a place repeating if the CRC of its number says so; a null number has none."""
    h = 0 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def split(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs of each text, in word numbers of its own."""
    ids: dict[bytes, int] = {}
    rows: list[np.ndarray] = []
    for t in texts:
        rows.append(np.fromiter((ids.setdefault(w, len(ids)) for w in t), dtype=np.int64, count=len(t)))
    size = len(ids)
    # one sequence; a number of its own between texts, which no run can hold
    joined = np.concatenate([x for k, r in enumerate(rows) for x in (r, np.array([size + k]))]) if rows else np.zeros(0, np.int64)
    first = np.cumsum([0] + [len(r) + 1 for r in rows])
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for start, end, q in runs(joined):
        k = int(np.searchsorted(first, start, "right")) - 1
        out[k].append((start - int(first[k]), end - int(first[k]), q))
    return out


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    drop = np.zeros(len(words) + 1, dtype=np.int64)
    for start, end, q in found:
        drop[start + q] += 1
        drop[end] -= 1
    return [w for w, k in zip(words, np.cumsum(drop)[:-1].tolist()) if not k]


def word_runs(docs: DataFrame, plant: bool = False) -> DataFrame:
    """(doc_id, runs, collapsed): the runs (start, length, period) of each row's words, by start, then period, and its text without repeats.

    Words are [^\\x20\\x09-\\x0D]+; the collapsed text has the words outside runs and each run's first period, joined by one space. With
    plant, the words are first made to repeat in the documents that `planted` tells. Null texts are empty texts; texts without runs have none
    and keep all words; repeated rows give repeated rows; an empty table gives an empty result; other columns are ignored. A text of any length is one
    sequence in one task, in memory of some dozen bytes a word; there is no shuffle.
    """
    kind = dict(docs.dtypes)["doc_id"]
    item = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def told(ids: pa.Array, held: list[list[bytes]]) -> pa.RecordBatch:
        each = split(held)
        rows = [[{"start": s, "length": e - s, "period": q} for s, e, q in found] for found in each]
        texts = [b" ".join(collapsed(w, found)).decode() for w, found in zip(held, each)]
        return pa.RecordBatch.from_arrays([ids, pa.array(rows, item), pa.array(texts)], names=["doc_id", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size, low = [], 0, 0
            for k in range(batch.num_rows):
                words = (batch.column(1)[k].as_py() or "").encode().split()
                held.append(planted(words, batch.column(0)[k].as_py()) if plant else words)
                size += len(words)
                if size > BLOCK:
                    yield told(batch.column(0)[low : k + 1], held)
                    held, size, low = [], 0, k + 1
            if held:
                yield told(batch.column(0)[low:], held)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def op12_runs(spark, sf_dir: str) -> DataFrame:
    """Derived from word_runs: the longest run's figures and digests of all runs and of the collapsed text."""
    found = word_runs(table(spark, sf_dir, "documents"), plant=True)
    longest = F.get(F.array_sort(F.transform("runs", lambda r: F.struct(-r["length"], r["start"], r["period"]))), 0)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))), "")
    return found.withColumn("longest", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("longest.start").alias("start"),
        (-F.col("longest.col1")).alias("length"),
        F.col("longest.period").alias("period"),
        F.floor(-1000 * F.col("longest.col1") / F.col("longest.period")).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
