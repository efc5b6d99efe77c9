"""Substring deduplication: recompression names token runs and pairs alike everywhere; shared names reveal long repeats."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from certalog.llm import tokens
from certalog.llm.common import drop_written, release, table, written
from certalog.llm.tokens import mix, powers

#: Words of a window, rounds of pair naming, parts in which the candidate windows are compared one after another.
WINDOW, ROUNDS, PARTS = 20, 4, 4
_FIRST, _SECOND = 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7


def sums(values: np.ndarray, base: int, width: int) -> np.ndarray:
    """A 64-bit hash of every stretch of width values."""
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers(base, len(values)), out=total[1:])
    n = len(values) - width + 1
    return mix((total[width:] - total[:n]) * powers(pow(base, -1, 1 << 64), n))


def window_hashes(words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of hash for the window at each start."""
    return sums(words, _FIRST, width), sums(mix(words ^ np.uint64(_SECOND)), _SECOND, width)


class Level:
    """The words of some documents as symbols: names, first words, and the symbol over each word."""

    def __init__(self, name: np.ndarray, start: np.ndarray, words: int):
        self.name, self.start = name, start
        self.end = np.append(start[1:], words)
        self.over = np.repeat(np.arange(len(name)), self.end - start)

    def merged(self, joins: np.ndarray, name: np.ndarray, words: int) -> Level:
        """Symbols with joins set go into the one before; name: the new names, by the first symbol of each."""
        return Level(name[~joins], self.start[~joins], words)


def runs(level: Level, fresh: np.ndarray, words: int) -> Level:
    """Runs of one symbol as one symbol each, named by the symbol and the length. fresh: a symbol begins a document."""
    joins = (np.append(False, level.name[1:] == level.name[:-1])) & ~fresh
    at = np.flatnonzero(~joins)
    length = np.diff(np.append(at, len(joins)))
    name = level.name.copy()
    name[at] = np.where(length > 1, mix(name[at] * np.uint64(3) + length.astype(np.uint64)), name[at])
    return level.merged(joins, name, words)


def sides(level: Level, r: int) -> np.ndarray:
    """True for the symbols that are right parts in round r: a bit of their names."""
    return (mix(level.name + np.uint64(r * 0x9E37 + 1)) & np.uint64(1)).astype(bool)


def pairs(level: Level, right: np.ndarray, fresh: np.ndarray, words: int) -> Level:
    """Each left part with the right part after it as one symbol, named by the two names."""
    joins = np.append(False, ~right[:-1] & right[1:]) & ~fresh
    name = level.name.copy()
    first = np.flatnonzero(joins) - 1
    name[first] = mix(name[first] * np.uint64(5) + name[first + 1] + np.uint64(0x51ED))
    return level.merged(joins, name, words)


def window_keys(words: np.ndarray, doc: np.ndarray, width: int = WINDOW, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start of each window, its key, where the symbol behind the key begins).

    The key depends on the window's words alone. Symbols at a window's edges may be named together with words outside; those that
    can be, by their run or side, are left off, round by round, and what stays inside is named alike wherever the window occurs.
    The key is the least name of the last round that leaves any; a window of two runs or one is named as a whole.
    """
    n = len(words)
    begin = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    size = np.diff(np.append(begin, n))
    start = np.flatnonzero(np.arange(n) <= np.repeat(begin + size - width, size))
    if not len(start):
        return start, np.zeros(0, np.uint64), start
    key, place = sums(words, _FIRST, width)[start], start.copy()
    heads = np.zeros(n + 1, dtype=bool)
    heads[begin] = True
    level = runs(Level(words, np.arange(n), n), heads[:n], n)
    lo, hi = level.end[level.over[start]], level.start[level.over[start + width - 1]]
    live = np.flatnonzero(lo < hi)
    lo, hi = lo[live], hi[live]

    def settle(which: np.ndarray, a: np.ndarray, b: np.ndarray, r: int) -> None:
        """Give the windows at which the least name of their symbols from word a to word b."""
        if not len(which):
            return
        i, last = level.over[a], level.over[b - 1]
        order = mix(level.name + np.uint64(0xABCD + r))
        best, at = order[i], i
        for k in range(1, int((last - i).max()) + 1):
            j = np.minimum(i + k, last)
            less = order[j] < best
            best, at = np.where(less, order[j], best), np.where(less, j, at)
        key[live[which]], place[live[which]] = best, level.start[at]

    for r in range(1, rounds + 1):
        right = sides(level, r)
        first, last = level.over[lo], level.over[hi - 1]
        a = np.where(right[first], level.end[first], lo)
        b = np.where(right[last], hi, level.start[last])
        gone = a >= b
        settle(np.flatnonzero(gone), lo[gone], hi[gone], r - 1)
        live, lo, hi = live[~gone], a[~gone], b[~gone]
        level = pairs(level, right, heads[level.start], n)
    settle(np.arange(len(live)), lo, hi, rounds)
    return start, key, place


def keyed(docs: DataFrame, width: int) -> DataFrame:
    """(key, id, th, p, n): stretches of n windows from word p on that have the same key at the same place."""

    def run(batch: pa.RecordBatch):
        for first, part in tokens.chunks(batch.column(2)):
            words, doc = tokens.words(part)
            start, key, place = window_keys(words, doc, width)
            if not len(start):
                continue
            new = np.append(True, (key[1:] != key[:-1]) | (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1))
            at = np.flatnonzero(new)
            of = doc[start[at]]
            offset = np.searchsorted(doc, np.arange(len(part)))
            rows = pa.array(first + of)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(key[at].view(np.int64)), batch.column(0).take(rows), batch.column(1).take(rows),
                    pa.array((start[at] - offset[of]).astype(np.int32)), pa.array(np.diff(np.append(at, len(start))).astype(np.int32)),
                ],
                names=["key", "id", "th", "p", "n"],
            )

    return mapped(docs, run, "key long, id long, th long, p int, n int")


def mapped(df: DataFrame, f, schema: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield from f(batch)
                release()  # long texts take much

    return df.mapInArrow(run, schema)


def windows(docs: DataFrame, width: int) -> DataFrame:
    """(part, w1, w2, id, th, p): the candidate windows of each document (column at: stretches), each content at its first place in it."""

    def run(batch: pa.RecordBatch):
        for first, part in tokens.chunks(batch.column(2)):
            words, doc = tokens.words(part)
            if len(words) < width:
                continue
            cut = np.searchsorted(doc, np.arange(len(part) + 1))
            lists = batch.column(3).slice(first, len(part))
            p, n = (lists.flatten().field(c).to_numpy().astype(np.int64) for c in ("p", "n"))
            of = np.repeat(np.arange(len(part)), lists.value_lengths().to_numpy())
            rows = np.repeat(of, n)
            where = np.repeat(p + cut[of] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            w1, w2 = window_hashes(words, width)
            again = repeated(w1[where], rows, where)
            rows, where = rows[~again], where[~again]
            w1, w2 = w1[where], w2[where]
            place = (where - cut[rows]).astype(np.int32)
            rows = pa.array(first + rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array((w1 % np.uint64(PARTS)).astype(np.int32)), pa.array(w1.view(np.int64)), pa.array((w2 >> np.uint64(32)).astype(np.uint32).view(np.int32)), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(place)],
                names=["part", "w1", "w2", "id", "th", "p"],
            )

    return mapped(docs, run, "part int, w1 long, w2 int, id long, th long, p int")


def repeated(content: np.ndarray, doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Which windows have the content of one of the same document at a smaller place."""
    key = content ^ mix(doc.astype(np.uint64) + np.uint64(1))
    out = np.zeros(len(key), dtype=bool)
    order = np.sort(key)
    twice = order[1:][order[1:] == order[:-1]]
    if len(twice):
        some = np.flatnonzero(twice[np.minimum(np.searchsorted(twice, key), len(twice) - 1)] == key)
        some = some[np.lexsort((place[some], key[some]))]
        out[some[1:][key[some][1:] == key[some][:-1]]] = True
    return out


def removed_words(words: np.ndarray, doc: np.ndarray, elsewhere: np.ndarray, width: int) -> np.ndarray:
    """Which words of some documents a repeated window covers: one that starts at elsewhere, or whose content its document had before."""
    if len(words) < width:
        return np.zeros(len(words), dtype=bool)
    start = np.flatnonzero(doc[: len(doc) - width + 1] == doc[width - 1 :])
    again = start[repeated(window_hashes(words, width)[0][start], doc[start], start)]
    gone = np.zeros(len(words) + 1, dtype=np.int64)
    starts = np.union1d(again, elsewhere).astype(np.int64)
    gone[starts] += 1
    np.add.at(gone, starts + width, -1)
    return np.cumsum(gone)[:-1] > 0


def repeats(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """(id, th, starts): the windows of each document whose words also stand in a document with a smaller id.

    Keys that occur once cannot be in a repeated window; the others' windows are compared by 96 bits of hash. All
    groupings are map-side combined minima and counts joined back, so a passage in any share of the documents is no group
    that a task must hold.
    """
    rows = written(keyed(docs, width))
    shared = rows.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    at = written(rows.join(shared, "key").groupBy("id", "th").agg(F.collect_list(F.struct("p", "n")).alias("at")))
    drop_written(rows)
    found = written(windows(docs.join(at, ["id", "th"]).select("id", "th", "text", "at"), width), "part")
    drop_written(at)
    out = None
    for k in range(PARTS):  # windows of the same words are in the same part; each part's exchanges go before the next one's come
        part = found.where(F.col("part") == k).drop("part")
        least = part.groupBy("w1", "w2").agg(F.min("id").alias("least"), F.count("*").alias("c")).where("c > 1").drop("c")
        one = written(part.join(least, ["w1", "w2"]).where("id > least").groupBy("id", "th").agg(F.collect_list("p").alias("p")))
        out = one if out is None else out.unionByName(one)
    drop_written(found)
    return out.groupBy("id", "th").agg(F.flatten(F.collect_list("p")).alias("starts"))


def dedup(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): every word that a repeated window covers is removed from each document.

    A window is width consecutive words [^\\x20\\x09-\\x0D]+ of one document; it is repeated if the same words also start earlier:
    in a document with a smaller doc_id, or earlier in the same one. All windows are judged on the input. Null texts have no
    words. Rows with the same doc_id are no copies of each other; a null doc_id comes before all others. Other columns
    are ignored; an empty table gives an empty result.
    """
    least = -(1 << 63)
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(least)).alias("id"), F.xxhash64("text").alias("th"), "text")
    texts = rows.where("text is not null").select("id", "th", "text")
    gone = repeats(texts, width)
    kind = dict(docs.dtypes)["doc_id"]
    joined = rows.join(gone, ["id", "th"], "left").select("doc_id", "text", "starts")

    def run(batch: pa.RecordBatch):
        for first, part in tokens.chunks(batch.column(1)):
            hashes, doc = tokens.words(part)
            cut = np.searchsorted(doc, np.arange(len(part) + 1))
            lists = batch.column(2).slice(first, len(part)).fill_null([])
            elsewhere = lists.flatten().to_numpy() + np.repeat(cut[:-1], lists.value_lengths().to_numpy())
            away = removed_words(hashes, doc, elsewhere, width)
            total, kept = np.diff(cut), []
            lost = np.diff(np.append(0, np.cumsum(away))[cut])
            for k, text in enumerate(part):
                words = text.split()
                if lost[k]:
                    words = [w for w, x in zip(words, away[cut[k] : cut[k + 1]].tolist()) if not x]
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(first, len(part)), pa.array(total, pa.int64()), pa.array(lost, pa.int64()), pa.array(kept, pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept"],
            )

    return mapped(joined, run, f"doc_id {kind}, n_words long, n_removed long, kept string")


def op2_substrings(spark, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
