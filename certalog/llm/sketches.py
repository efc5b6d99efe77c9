"""Document fingerprints: invertible Bloom lookup sketches of hashed pieces of paragraphs, subtracted and peeled."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from certalog.llm.common import table
from certalog.llm.tokens import mix

#: Cells of each of the three tables of a fingerprint; a comparison that can't be peeled is made again with GROWTH times as many.
CELLS, TABLES, GROWTH = 8, 3, 4
#: A paragraph is cut where a hash of the WINDOW bytes before has as many low zero bits: every 32 bytes or so.
WINDOW, CUT = 8, np.uint64(31)
#: Pieces of more bytes are cut after so many, again and again.
LONGEST = 128
#: Bytes of text worked on together, bytes of text that one task takes, and the most tasks.
BLOCK, TASK_BYTES, MOST_TASKS = 1 << 20, 1 << 25, 10_000
LOW32 = np.uint64(0xFFFFFFFF)
_SALT = mix(np.arange(1, 257, dtype=np.uint64))


def pieces(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end, key) of the pieces of all UTF-8 texts, start and end in bytes of their text.

    A piece ends with its paragraph, that is after a line break, or where the bytes before say so, so that a change moves only the
    cuts next to it. A key is the XXH3 hash of the piece's bytes; the second, third ... piece of the same bytes in a text has a key of its own.
    """
    pad = bytes(WINDOW)  # so that no cut depends on another text
    whole = b"".join(x for t in texts for x in (pad, t))
    buf = np.frombuffer(whole, dtype=np.uint8)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    ends = np.cumsum(sizes + WINDOW)
    starts = ends - sizes
    rolled = np.zeros(len(buf) + 1, dtype=np.uint64)  # a hash of the bytes before each place
    for back in range(1, WINDOW + 1):
        rolled[back:] += _SALT[29 * back] * _SALT[buf[: len(buf) + 1 - back]]
    hit = (mix(rolled) & CUT) == 0
    cut = np.zeros(len(buf) + 1, dtype=bool)
    cut[1:] = hit[1:] & ~hit[:-1]
    cut[:-1] &= (buf & 0xC0) != 0x80  # never within a character
    cut[1:] |= buf == 10
    for k in range(WINDOW + 1):  # nor in the padding or before a text's first byte
        cut[starts - k] = False
    cut[ends[sizes > 0]] = True
    stop = np.flatnonzero(cut)
    if not len(stop):
        return stop, stop, stop, stop.astype(np.uint64)
    text = np.searchsorted(starts, stop, "left") - 1
    start = np.where(np.r_[True, text[1:] != text[:-1]], starts[text], np.r_[0, stop[:-1]])
    more = (stop - start - 1) // LONGEST
    if more.any():
        step = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more)
        extra = np.repeat(start, more) + LONGEST * (step + 1)
        for _ in range(3):  # to a character's first byte
            extra -= (buf[extra] & 0xC0) == 0x80
        stop = np.union1d(stop, extra)
        text = np.searchsorted(starts, stop, "left") - 1
    start = np.where(np.r_[True, text[1:] != text[:-1]], starts[text], np.r_[0, stop[:-1]])
    h = np.fromiter((xxhash.xxh3_64_intdigest(whole[a:b]) for a, b in zip(start.tolist(), stop.tolist())), dtype=np.uint64, count=len(start))
    order = np.lexsort((h, text))
    first = np.r_[True, (h[order][1:] != h[order][:-1]) | (text[order][1:] != text[order][:-1])]
    at = np.arange(len(order))
    again = np.zeros(len(order), dtype=np.uint64)
    again[order] = at - np.maximum.accumulate(np.where(first, at, 0))
    return text, start - starts[text], stop - starts[text], mix(h + again * np.uint64(0x9E3779B97F4A7C15))


def _check(keys: np.ndarray) -> np.ndarray:
    return mix(keys ^ np.uint64(0x5851F42D4C957F2D)) & LOW32


def _places(keys: np.ndarray, cells: int) -> np.ndarray:
    """The cell of each key in each table: (TABLES, keys)."""
    return np.stack([t * cells + (mix(keys ^ _SALT[t] ^ np.uint64(cells)) % np.uint64(cells)).astype(np.int64) for t in range(TABLES)])


class Sketches:
    """Sketches of count texts, one after the other. A cell holds how many keys fell into it, their sum, and the sums of their checks and weights."""

    def __init__(self, count: int, cells: int) -> None:
        self.count, self.cells = count, cells
        self.n = np.zeros(count * TABLES * cells, dtype=np.int64)
        self.key, self.check, self.weight = (np.zeros(len(self.n), dtype=np.uint64) for _ in range(3))

    def add(self, owner: np.ndarray, keys: np.ndarray, weights: np.ndarray, sign: np.ndarray | int = 1) -> None:
        """Put keys into the sketches of their owners; sign -1 takes them out."""
        signs = np.broadcast_to(np.asarray(sign, dtype=np.int64), len(keys))
        turned = signs.astype(np.uint64)  # -1 is 2 ** 64 - 1, which times a value is its negative
        sums = (keys * turned, _check(keys) * turned, weights.astype(np.uint64) * turned)
        for own in _places(keys, self.cells):
            at = owner * (TABLES * self.cells) + own
            np.add.at(self.n, at, signs)
            for cells, values in zip((self.key, self.check, self.weight), sums):
                np.add.at(cells, at, values)

    def minus(self, other: Sketches) -> Sketches:
        out = Sketches(self.count, self.cells)
        out.n, out.key, out.check, out.weight = self.n - other.n, self.key - other.key, self.check - other.check, self.weight - other.weight
        return out

    def take(self, which: np.ndarray) -> Sketches:
        out = Sketches(0, self.cells)
        out.count = len(which)
        out.n, out.key, out.check, out.weight = (x.reshape(self.count, -1)[which].ravel() for x in (self.n, self.key, self.check, self.weight))
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(owner, key, sign, weight) of the keys recovered, and which sketches are empty then: those are recovered whole. Empties the cells.

        A cell of one key shows it; that key goes from its other cells too, which may leave one key there.
        """
        found: list[tuple[np.ndarray, ...]] = []
        width = TABLES * self.cells
        look = np.flatnonzero(self.n)
        for _ in range(len(self.n) + 1):
            look = look[np.abs(self.n[look]) == 1]
            sign = self.n[look].astype(np.uint64)
            keys = self.key[look] * sign
            good = ((self.check[look] * sign) & LOW32) == _check(keys)
            owner = look // width
            good &= (_places(keys, self.cells) == look - owner * width).any(axis=0) if len(keys) else good
            if not good.any():
                break
            pure = np.stack([owner[good].astype(np.uint64), keys[good], self.n[look][good].astype(np.uint64), self.weight[look][good] * sign[good]])
            pure = pure[:, np.unique(pure[:2], axis=1, return_index=True)[1]]
            own, keys, sign, weight = pure[0].astype(np.int64), pure[1], pure[2].astype(np.int64), pure[3]
            self.add(own, keys, weight, -sign)
            found.append((own, keys, sign, weight.astype(np.int64)))
            look = np.unique(own * width + _places(keys, self.cells))
        rest = (self.n != 0) | (self.key != 0) | ((self.check & LOW32) != 0)
        empty = ~rest.reshape(self.count, width).any(axis=1) if self.count else np.zeros(0, dtype=bool)
        kinds = (np.int64, np.uint64, np.int64, np.int64)
        return *(np.concatenate([f[k] for f in found]) if found else np.zeros(0, kinds[k]) for k in range(4)), empty

    def told(self) -> list[str]:
        """Each sketch as text: counts, keys, checks and weights of all cells, in base64."""
        parts = [x.reshape(self.count, -1) for x in (self.n.astype("<i4"), self.key.astype("<u8"), self.check.astype("<u4"), self.weight.astype("<u4"))]
        return [base64.b64encode(b"".join(p[k].tobytes() for p in parts)).decode() for k in range(self.count)]


def read_sketch(fingerprint: str) -> Sketches:
    """The sketch that a fingerprint tells."""
    raw = base64.b64decode(fingerprint)
    out = Sketches(1, len(raw) // (20 * TABLES))
    m = len(out.n)
    out.n = np.frombuffer(raw, "<i4", m).astype(np.int64)
    out.key = np.frombuffer(raw, "<u8", m, 4 * m).astype(np.uint64)
    out.check, out.weight = (np.frombuffer(raw, "<u4", m, k * m).astype(np.uint64) for k in (12, 16))
    return out


def difference(old: str, new: str) -> tuple[list[int], list[int]] | None:
    """Digests of the pieces that only old has and that only new has, from two fingerprints alone; None if there are too many to peel."""
    _, keys, sign, _, empty = read_sketch(old).minus(read_sketch(new)).peel()
    return (sorted(keys[sign > 0].tolist()), sorted(keys[sign < 0].tolist())) if empty[0] else None


class Versions:
    """Texts with their pieces, and comparisons of pairs of them by their sketches."""

    def __init__(self, texts: list[str]) -> None:
        self.texts = [t.encode() for t in texts]
        self.owner, self.start, self.stop, self.keys = pieces(self.texts)
        self.weights = self.stop - self.start
        self.first = np.searchsorted(self.owner, np.arange(len(texts) + 1))
        self.base = self.sketches(np.arange(len(texts)), CELLS)

    def _items(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in which, piece) of the pieces of texts."""
        n = self.first[which + 1] - self.first[which]
        own = np.repeat(np.arange(len(which)), n)
        return own, np.repeat(self.first[which] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum()) if len(which) else own

    def sketches(self, which: np.ndarray, cells: int) -> Sketches:
        out = Sketches(len(which), cells)
        own, item = self._items(which)
        out.add(own, self.keys[item], self.weights[item])
        return out

    def compare(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, ...], np.ndarray]:
        """For each pair of texts their likeness and the cells that it took; and (pair, key, sign) of all pieces that only one of them has.

        Likeness is twice the bytes of shared pieces over the bytes of both; 1 of two empty texts. The fingerprints' cells are
        subtracted and peeled; pairs with something left get sketches with more cells and other places until nothing is left.
        """
        bytes_of = np.array([len(t) for t in self.texts], dtype=np.int64)
        apart, took = np.zeros(len(a), dtype=np.int64), np.zeros(len(a), dtype=np.int64)
        todo, cells, found = np.arange(len(a)), CELLS, []
        diff = self.base.take(a).minus(self.base.take(b))
        while len(todo):
            own, keys, sign, weight, empty = diff.peel()
            good = empty[own]
            np.add.at(apart, todo[own[good]], weight[good])
            found.append((todo[own[good]], keys[good], sign[good]))
            took[todo[empty]] = cells
            todo, cells = todo[~empty], cells * GROWTH
            diff = self.sketches(a[todo], cells).minus(self.sketches(b[todo], cells))
        both = bytes_of[a] + bytes_of[b]
        like = np.where(both > 0, (both - apart) / np.maximum(both, 1), 1.0)
        return like, tuple(np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(3)), took

    def piece(self, text: int, key: int) -> str:
        """The piece of a text that has a digest."""
        k = self.first[text] + int(np.flatnonzero(self.keys[self.first[text] : self.first[text + 1]] == np.uint64(key))[0])
        return self.texts[text][self.start[k] : self.stop[k]].decode()


def changes(versions: DataFrame) -> DataFrame:
    """What differs between two versions of each document: of versions (doc_id, old, new) the rows (doc_id, likeness, removed, added, cells).

    removed and added are arrays of (digest, piece): the pieces of paragraphs that only one version has, as often as it has them
    more. Null texts are empty; empty texts have no pieces and are like each other only; repeated rows give repeated rows; an empty
    table gives an empty result; other columns are ignored. Very long texts are worked on by themselves, in memory of a few times their size.
    """
    kind = dict(versions.dtypes)["doc_id"]
    side = "array<struct<digest:string,piece:string>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [[x.as_py() or "" for x in batch.column(c)] for c in (1, 2)]
            for low, high in _blocks([len(x) + len(y) for x, y in zip(*texts)]):
                n = high - low
                v = Versions([*texts[0][low:high], *texts[1][low:high]])
                like, (pair, keys, sign), took = v.compare(np.arange(n), np.arange(n, 2 * n))
                out: list[tuple[list, list]] = [([], []) for _ in range(n)]
                for p, key, s in zip(pair.tolist(), keys.tolist(), sign.tolist()):
                    out[p][s < 0].append({"digest": f"{key:016x}", "piece": v.piece(p + n * (s < 0), key)})
                cols = [pa.array([sorted(o[k], key=lambda x: x["digest"]) for o in out], pa.list_(pa.struct([("digest", pa.string()), ("piece", pa.string())]))) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[low:high], pa.array(like), *cols, pa.array(took)], names=["doc_id", "likeness", "removed", "added", "cells"])

    return versions.select("doc_id", "old", "new").mapInArrow(run, f"doc_id {kind}, likeness double, removed {side}, added {side}, cells long")


def _blocks(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Stretches of about BLOCK in all."""
    low, held = 0, 0
    for k, size in enumerate(sizes):
        if held and held + size > BLOCK:
            yield low, k
            low, held = k, 0
        held += size
    if sizes:
        yield low, len(sizes)


def _bucket(place: Column, bounds: list[int], low: int = 0) -> Column:
    """How many bounds are at most the place, by halving."""
    if not bounds:
        return F.lit(low)
    mid = len(bounds) // 2
    return F.when(place < bounds[mid], _bucket(place, bounds[:mid], low)).otherwise(_bucket(place, bounds[mid + 1 :], low + mid + 1))


def followed(docs: DataFrame) -> DataFrame:
    """(bucket, halo, doc_id, place, text) dealt by ranges of doc_id and sorted: after each row comes its follower, the last row's being the first.

    Ranges hold about TASK_BYTES of text. The first document of each range stands again, as halo, at the end of the range before, so
    that no task needs another's rows. The driver sees a number for each range: at most MOST_TASKS.
    """
    spark = docs.sparkSession
    least = F.lit(-(1 << 63))
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), least).alias("place"), F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = min(MOST_TASKS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // TASK_BYTES))
    cuts = rows.agg(F.percentile_approx("place", [k / tasks for k in range(1, tasks)] or [0.5], 10 * tasks)).first()[0] or []
    bounds = sorted(set(cuts))
    rows = rows.withColumn("bucket", _bucket(F.col("place"), bounds))
    firsts = sorted((r.bucket, r.place) for r in rows.groupBy("bucket").agg(F.min("place").alias("place")).collect())
    if not firsts:
        return rows.select("bucket", F.lit(False).alias("halo"), "doc_id", "place", "text")
    before = {b: firsts[k - 1][0] for k, (b, _) in enumerate(firsts)}
    first = rows.where(F.col("place").isin([p for _, p in firsts])).groupBy("bucket", "place").agg(F.min("text").alias("text"))
    halo = first.select(F.create_map(*[F.lit(x) for p in before.items() for x in p])[F.col("bucket")].alias("bucket"), F.lit(True).alias("halo"), F.lit(None).alias("doc_id"), "place", "text")
    every = rows.select("bucket", F.lit(False).alias("halo"), "doc_id", "place", "text").unionByName(halo)
    return every.repartitionById(tasks, "bucket").sortWithinPartitions("bucket", "halo", "place", "text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, cells_edited, cells_next) of every row.

    The edited text has its last quarter replaced by the beginning of the next document, by ascending doc_id (null first; equal ids by
    text; after the last the first). near_* are likenesses of Versions.compare, cells_* the cells a table that they took. Null texts are
    empty texts, whose fingerprint has empty cells; the only row of a table is its own next one; repeated rows follow each other and meet in one
    task, row by row; an empty table gives an empty result; other columns are ignored. Texts of any length are taken whole, in memory of a few
    times the longest.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def told(ids: list, texts: list[str]) -> pa.RecordBatch:
        """texts: of the rows, and of the one after the last."""
        n = len(ids)
        edited = [t[: len(t) - len(t) // 4] + u[: len(t) // 4] for t, u in zip(texts, texts[1:])]
        v = Versions([*texts, *edited])
        own = np.arange(n)
        like, _, took = v.compare(np.r_[own, own], np.r_[n + 1 + own, own + 1])
        marks = v.base.told()
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, id_type), pa.array([len(t) for t in texts[:n]], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]), pa.array(marks[:n]), pa.array(marks[n + 1 :]),
                pa.array(like[:n]), pa.array(like[n:]), pa.array(took[:n]), pa.array(took[n:]),
            ],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "cells_edited", "cells_next"],
        )

    id_type = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "smallint": pa.int16()}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, held = [], [], 0
        for batch in batches:
            for last, doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                texts.append(text.as_py())
                held += len(texts[-1])
                if len(texts) > 1 and (last or held > BLOCK):
                    yield told(ids, texts)
                    ids, texts, held = [], [] if last else texts[-1:], 0
                if not last:
                    ids.append(doc)

    return followed(docs).select("halo", "doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, cells_edited long, cells_next long"
    )


def op11_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
