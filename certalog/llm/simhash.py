"""SimHash near-duplicates: fingerprints of word shingles, compared as bit planes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from certalog.llm.buckets import connected, members, node, units
from certalog.llm.common import arrow_map, components, join_counted, kept, scratch, table, written
from certalog.llm.tokens import mix

BITS = 64
#: Lanes compared at once, and the most rows of a bucket that one unit of work holds.
LANES, UNIT = 1024, 8192
#: Near copies by exact similarity: words of a shingle, least Jaccard similarity of the shingle sets, differing bits beyond which a pair
#: isn't looked at (texts at the threshold differ in 10 bits, give or take 3), bands and min-hashes of a band that give the keys.
WIDTH, SIMILARITY, RADIUS, BANDS, ROWS = 5, 0.8, 22, 8, 3


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """SimHash of one text: a bit is 1 if set in over half the shingle hashes; 0 for a text without words."""
    return over_half(shingle_hashes((text or "").encode().lower().split(), width, seed))


def shingle_hashes(words: list[bytes], width: int, seed: int) -> np.ndarray:
    """XXH64 of each shingle of width words, in order; of the whole sequence if it is shorter; none of no words."""
    if not words:
        return np.zeros(0, dtype="<u8")
    ends = np.cumsum([len(w) + 1 for w in words])
    joined = b" ".join(words)
    starts = [0, *ends[:-1].tolist()]
    stops = (ends - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashed = [digest(joined, seed)] if len(words) <= width else [digest(joined[s:e], seed) for s, e in zip(starts, stops[width - 1 :])]
    return np.array(hashed, dtype="<u8")


def over_half(hashed: np.ndarray) -> int:
    """The bits set in over half of the hashes, counted in slices that stay in cache."""
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashed), 4096):
        part = hashed[at : at + 4096]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashed), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp): one signed 64-bit fingerprint for each row; null and blank texts get 0."""

    def run(batch: pa.RecordBatch):
        fps = np.array([fingerprint(t.as_py(), width, seed) for t in batch.column(1)], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=[id_col, "fp"])

    kind = dict(docs.dtypes)[id_col]
    return arrow_map(docs.select(id_col, text_col), run, f"{id_col} {kind}, fp long")


def pieces(radius: int) -> tuple[list[tuple[int, int]], int]:
    """radius + 2 bit ranges; two words within radius agree on at least two of them."""
    n = radius + 2
    cuts = [round(k * BITS / n) for k in range(n + 1)]
    return list(zip(cuts, cuts[1:])), n


def bucket_keys(fp: str, radius: int):
    """One (table, key) for each pair of pieces: any two fingerprints within radius share a key in some table."""
    ranges, n = pieces(radius)
    part = [F.shiftrightunsigned(F.col(fp), lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) for lo, hi in ranges]
    tables = [(i, j) for i in range(n) for j in range(i)]
    return F.array(
        *[F.struct(F.lit(k).alias("t"), F.shiftleft(part[i], 32).bitwiseOR(part[j]).alias("key")) for k, (i, j) in enumerate(tables)]
    )


def planes_of(fps: np.ndarray) -> np.ndarray:
    """Bit planes: row b holds bit b of every fingerprint, 64 lanes to a word."""
    n = -(-len(fps) // 64) * 64
    bits = np.zeros((n, BITS), dtype=np.uint8)
    bits[: len(fps)] = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(bits.T.copy(), axis=1, bitorder="little").view(np.uint64)


def within(query: np.ndarray, planes: np.ndarray, lanes: int, radius: int) -> np.ndarray:
    """(query, lane) pairs at most radius bits apart.

    Distances of all lanes grow together in carry-save counters, one plane at a time; a counter that passes radius sets
    a lane's 'over' bit for good. Every eight planes the blocks of 64 lanes that are over throughout are left out.
    """
    width = max(1, radius.bit_length())
    every = np.uint64(0xFFFFFFFFFFFFFFFF)
    live = np.arange(len(query) * planes.shape[1])
    row, col = np.divmod(live, planes.shape[1])
    over = np.zeros(len(live), dtype=np.uint64)
    pad = planes.shape[1] * 64 - lanes
    if pad:
        over[col == planes.shape[1] - 1] = every << np.uint64(64 - pad)
    count = [np.zeros(len(live), dtype=np.uint64) for _ in range(width)]
    for b in range(BITS):
        flip = np.where((query >> np.uint64(b)) & np.uint64(1), every, np.uint64(0))
        carry = planes[b][col] ^ flip[row]
        for k in range(width):
            count[k], carry = count[k] ^ carry, count[k] & carry
        over |= carry
        if radius + 1 < 1 << width:  # counters that can hold more than radius
            over |= exceeds(count, radius)
        if b % 8 == 7:
            keep = over != every
            if not keep.all():
                live, row, col, over = live[keep], row[keep], col[keep], over[keep]
                count = [c[keep] for c in count]
                if not len(live):
                    break
    hit = np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little") if len(live) else np.zeros((0, 64), np.uint8)
    at, bit = np.nonzero(hit)
    return np.stack([row[at], col[at] * 64 + bit], axis=1)


def exceeds(count: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter is over radius, from the counter's bits."""
    over, equal = np.zeros_like(count[0]), ~np.zeros_like(count[0])
    for k in reversed(range(len(count))):
        if radius >> k & 1:
            equal = equal & count[k]
        else:
            over, equal = over | (equal & count[k]), equal & ~count[k]
    return over


def forest(pairs: np.ndarray, size: int) -> np.ndarray:
    """Rows of pairs that join two trees: as many links as connect what pairs connects."""
    root = list(range(size))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kept = []
    for k, (x, y) in enumerate(pairs.tolist()):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
            kept.append(k)
    return np.array(kept, dtype=np.int64)


def linked_in_unit(fps: np.ndarray, group: np.ndarray, radius: int) -> np.ndarray:
    """Links (as a forest) between rows of the same group; rows come sorted by group."""
    links = []
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    ends = np.r_[starts[1:], len(group)]
    at = 0
    while at < len(starts):
        upto = at + 1
        while upto < len(starts) and ends[upto] - starts[at] <= LANES:
            upto += 1
        lo, hi = starts[at], ends[upto - 1]
        own, of = fps[lo:hi], group[lo:hi]
        planes = planes_of(own)
        for q in range(0, len(own), LANES):
            found = within(own[q : q + LANES], planes, len(own), radius) + [q, 0]
            found = found[(found[:, 0] < found[:, 1]) & (of[found[:, 0]] == of[found[:, 1]])]
            links.append(found[forest(found, len(own))] + lo)
        at = upto
    return np.concatenate(links) if links else np.zeros((0, 2), dtype=np.int64)


def near_links(fps: DataFrame, radius: int = 3) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints at most radius bits apart, directly or through others.

    Fingerprints that share a key are compared in units of at most UNIT rows a side: a bucket with more is cut by a
    hash into blocks, and every pair of its blocks is a unit, so no task holds a bucket whole.
    """
    spark = fps.sparkSession
    keyed = fps.select("fp", F.explode(bucket_keys("fp", radius)).alias("k")).select("fp", "k.t", "k.key")
    sizes = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") * 2 / F.lit(UNIT)).cast("int")
    mine = F.pmod(F.xxhash64("fp"), F.col("nb")).cast("int")
    units = (
        keyed.join(sizes, ["t", "key"])
        .withColumn("nb", blocks)
        .withColumn("own", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
        .select("fp", "t", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["t", "key", "i", "j"]

    def run(batches):
        held: list[pa.RecordBatch] = []

        def links(table: pa.Table, last: bool):
            fp = table.column("fp").to_numpy().view(np.uint64)
            ids = np.stack([table.column(c).to_numpy().astype(np.int64) for c in order], axis=1)
            new = np.r_[True, (ids[1:] != ids[:-1]).any(axis=1)]
            cut = len(new) if last else int(np.flatnonzero(new)[-1])
            group = np.cumsum(new[:cut])
            found = linked_in_unit(fp[:cut], group, radius) if cut else np.zeros((0, 2), np.int64)
            pair = fp[found].view(np.int64) if len(found) else np.zeros((0, 2), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["a", "b"]), cut

        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            rest = pa.concat_tables([rest, table]) if rest is not None else table
            if rest.num_rows >= 2 * LANES:
                out, cut = links(rest, False)
                rest = rest.slice(cut).combine_chunks()
                yield out
        if rest is not None and rest.num_rows:
            yield links(rest, True)[0]

    return units.repartition(parts, *order).sortWithinPartitions(*order).mapInArrow(run, "a long, b long").distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, width: int = 3, seed: int = 42
) -> DataFrame:
    """(id, fp, component_id): documents linked at radius or fewer differing bits, directly or through others.

    component_id is the smallest id reachable, null ids left out of the choice: a component of rows without an id has none.
    Texts without words (null, blank) have fingerprint 0 and link to each other like any others. Equal fingerprints are one node; rows that repeat an id share its component through their
    fingerprints. An empty table gives an empty result. Other columns of docs are left out.
    """
    fps = written(fingerprints(docs, id_col, text_col, width, seed))
    with scratch(docs.sparkSession):
        nodes = written(fps.groupBy("fp").agg(F.min(id_col).alias("first_id"), F.count("*").alias("n")))
        found = components(near_links(nodes.select("fp"), radius))
        lead = written(
            nodes.join(found.select(F.col("node").alias("fp"), "component"), "fp", "left")
            .select("fp", "first_id", "n", F.coalesce("component", "fp").alias("component"))
        )
        least = lead.groupBy("component").agg(F.min("first_id").alias("component_id"))
        named = kept(lead.join(least, "component").select("fp", "n", "component_id"))
    return join_counted(fps, named, ["fp"], "n", fps.count()).select(id_col, "fp", "component_id")


def prints(docs: DataFrame, width: int, seed: int) -> DataFrame:
    """(doc_id, th, k1, k2, fp, b0, b1, ...): each row's text hash, key of its word sequence, fingerprint, and bands of min-hashes."""
    at = np.random.default_rng(seed).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)

    def run(batch: pa.RecordBatch):
        out = np.zeros((3 + BANDS, batch.num_rows), dtype=np.uint64)
        for k, text in enumerate(batch.column(2)):
            words = (text.as_py() or "").encode().lower().split()
            whole = b" ".join(words)
            hashed = shingle_hashes(words, width, seed)
            out[:3, k] = xxhash.xxh64_intdigest(whole, seed + 1), xxhash.xxh64_intdigest(whole, seed + 2), over_half(hashed)
            least = np.array([(hashed ^ c).min() for c in at]) if len(hashed) else np.zeros(len(at), np.uint64)
            bands = np.arange(BANDS, dtype=np.uint64)
            for r in range(ROWS):
                bands = mix(bands + least[r::ROWS])
            out[3:, k] = bands
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c.view(np.int64)) for c in out]], names=names)

    names = ["doc_id", "th", "k1", "k2", "fp", *[f"b{k}" for k in range(BANDS)]]
    kind = dict(docs.dtypes)["doc_id"]
    return arrow_map(docs.select("doc_id", F.xxhash64("text").alias("th"), "text"), run, f"doc_id {kind}, " + ", ".join(f"{n} long" for n in names[1:]))


def print_sets(docs: DataFrame, wanted: DataFrame, width: int, seed: int) -> DataFrame:
    """(k, k1, k2, n, fp, s): the sorted set of shingle hashes of each wanted text, which is told by one of its rows (at, t)."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    there = rows.join(wanted.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("at")) & (F.col("th") == F.col("t")))

    def run(batch: pa.RecordBatch):
        sets = [np.unique(shingle_hashes((t.as_py() or "").encode().lower().split(), width, seed)).view(np.int64) for t in batch.column(0)]
        cut = np.cumsum([0, *map(len, sets)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(cut), pa.array(np.concatenate([np.zeros(0, np.int64), *sets])))
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], lists], names=["k1", "k2", "n", "fp", "s"])

    each = arrow_map(there.select("text", "k1", "k2", "n", "fp"), run, "k1 long, k2 long, n long, fp long, s array<long>")
    return each.select(node().alias("k"), "*").dropDuplicates(["k"])


def across_planes(labelled: DataFrame, rows: int, sets: DataFrame, similarity: float, radius: int = RADIUS) -> DataFrame:
    """(k, h): links between members of a bucket that are in different components.

    The fingerprints of a unit's own rows are bit planes; the others come against them some at a time. Pairs within radius are
    verified by their sets, one pair for each two components that are not yet connected in the unit.
    """
    own, other = units(labelled, rows, sets, "fp", "s")
    by = ["band", "bi", "bj"]
    mine = own.select(*by, F.lit(False).alias("other"), F.lit(False).alias("led"), "k", "c", "fp", "s")
    every = mine.unionByName(other.select(*by, F.lit(True).alias("other"), "led", F.col("h").alias("k"), F.col("hc").alias("c"), F.col("hfp").alias("fp"), F.col("hs").alias("s")))
    parts = int(labelled.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        unit, held = None, None
        for batch in batches:
            edges = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
            new = np.flatnonzero(np.r_[True, np.any([e[1:] != e[:-1] for e in edges], axis=0)]) if batch.num_rows else []
            links = []
            for lo, hi in zip(new, [*new[1:], batch.num_rows]):
                part = batch.slice(lo, hi - lo)
                key = tuple(e[lo] for e in edges[:3])
                if key != unit:
                    unit, held = key, Unit(similarity, radius)
                if edges[3][lo]:
                    links += held.meet(part)
                else:
                    held.take(part)
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in links], pa.decimal128(38, 0)) for c in (0, 1)], names=["k", "h"])

    placed = every.repartition(parts, *by).sortWithinPartitions(*by, "other")
    return placed.mapInArrow(run, "k decimal(38,0), h decimal(38,0)")


class Unit:
    """The own rows of one unit of work, and which components they connect."""

    def __init__(self, similarity: float, radius: int):
        self.similarity, self.radius = similarity, radius
        self.k: list = []
        self.c: list = []
        self.sets: list[np.ndarray] = []
        self.fps = np.zeros(0, dtype=np.uint64)
        self.root: dict = {}

    def take(self, part: pa.RecordBatch) -> None:
        self.k += part.column("k").to_pylist()
        self.c += part.column("c").to_pylist()
        self.sets += [x.values.to_numpy() for x in part.column("s")]
        self.fps = np.append(self.fps, part.column("fp").to_numpy().view(np.uint64))
        self.planes = planes_of(self.fps)

    def find(self, c):
        while self.root.get(c, c) != c:
            c = self.root[c]
        return c

    def meet(self, part: pa.RecordBatch) -> list[tuple]:
        """(k, h) that connect two components, for some of the other rows."""
        if not self.k:
            return []
        links = []
        fps, k, c, led = part.column("fp").to_numpy().view(np.uint64), part.column("k").to_pylist(), part.column("c").to_pylist(), part.column("led").to_pylist()
        for at in range(0, len(fps), LANES):
            for i, j in within(fps[at : at + LANES], self.planes, len(self.fps), self.radius).tolist():
                i += at
                if not (led[i] or self.k[j] < k[i]):
                    continue
                a, b = self.find(self.c[j]), self.find(c[i])
                if a != b and jaccard_at_least(self.sets[j], part.column("s")[i].values.to_numpy(), self.similarity):
                    self.root[a] = b
                    links.append((self.k[j], k[i]))
        return links


def jaccard_at_least(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets have the Jaccard similarity."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared >= similarity * (len(a) + len(b) - shared)


def copies(docs: DataFrame, similarity: float = SIMILARITY, width: int = WIDTH, seed: int = 42) -> DataFrame:
    """(doc_id, th, stays, several): the documents, by id and text hash, of each group of near copies; a written table.

    Documents are linked if their sets of shingles of width words have the Jaccard similarity, directly or through others; equal word
    sequences (ASCII in lower case) always are. Pairs to look at share a band of min-hashes; the fingerprints of a bucket are
    compared as bit planes and what is within RADIUS bits is verified by its sets. Of each group the document with the smallest id stays
    (of several texts with that id the one with the smallest hash; null comes first); several says that it has equal rows.
    """
    with scratch(docs.sparkSession):
        made = written(prints(docs, width, seed))
        first = [F.min(c).alias(c) for c in ("fp", *[f"b{k}" for k in range(BANDS)])]
        texts = written(made.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min_by("doc_id", "th").alias("at"), F.min("th").alias("t"), *first))
        count, total = texts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        found = members(texts.select("k1", "k2", F.array(*[f"b{k}" for k in range(BANDS)]).alias("bands")), count, BANDS)
        wanted = texts.join(found.select("k1", "k2").distinct(), ["k1", "k2"], "left_semi").select("k1", "k2", "n", "fp", "at", "t")
        sets = written(print_sets(docs, wanted, width, seed))
        whole = connected(found, sets, similarity, across_planes)
        linked = whole.join(sets, F.col("node") == F.col("k")).select("k1", "k2", "n", F.col("component").alias("c"))
        alone = texts.where("n > 1").select("k1", "k2", "n", node().alias("c")).join(linked, ["k1", "k2"], "left_anti")
        rows = join_counted(made.select("doc_id", "th", "k1", "k2"), linked.unionByName(alone), ["k1", "k2"], "n", total)
        groups = written(rows.groupBy("doc_id", "th", "c").agg(F.count("*").alias("rows")))
        lead = groups.groupBy("c").agg(F.min(F.struct("doc_id", "th")).alias("f")).select("f.*", F.lit(True).alias("stays"), F.lit(0).cast("long").alias("rows"))
        both = groups.select("doc_id", "th", F.lit(False).alias("stays"), "rows").unionByName(lead)
        return kept(both.groupBy("doc_id", "th").agg(F.bool_or("stays").alias("stays"), (F.sum("rows") > 1).alias("several")))


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, width: int = WIDTH) -> DataFrame:
    """The rows of docs but for near copies: one of each group (see copies) stays, with all its columns.

    Of equal rows of the staying document one stays, whichever. Null and blank texts are copies of each other; a null doc_id is an id like any
    other and the smallest; other columns don't count; an empty table gives an empty result.
    """
    named = copies(docs, similarity, width).withColumnsRenamed({"doc_id": "copy_id", "th": "copy_th"})
    same = F.col("doc_id").eqNullSafe(F.col("copy_id")) & (F.xxhash64("text") == F.col("copy_th"))
    out = docs.join(named.where("not stays or several").hint("shuffle_hash"), same, "left_anti")
    again = named.where("stays and several")
    if not again.isEmpty():
        rows = docs.withColumn("_th", F.xxhash64("text")).join(again.select("copy_id", "copy_th"), same, "left_semi")
        out = out.unionByName(rows.dropDuplicates(["doc_id", "_th"]).drop("_th"))
    return out


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return near_duplicates(docs).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
