"""Best-fit packing of documents into sequences of several permitted lengths."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from certalog.llm.common import table, written

CAPACITIES = (512, 1024, 2048, 4096)
#: Pieces packed together, on average.
SHARD = 40_000


def cost(capacity: int) -> float:
    """Work of one sequence: in proportion to its length, with an attention share that grows by the square."""
    return capacity * (1 + capacity / 16384)


def opening(n: int, left: np.ndarray, sizes: Sequence[int]) -> int:
    """The size at which to open a bin for a piece of n tokens: that of the least cost for each token that it is likely to hold.

    left[k] is how many tokens the pieces of length k still to come have. A bin can be filled up with those that fit its room, as far
    as they reach; of equal sizes the smaller opens.
    """
    fill = lambda c: n + min(c - n, int(left[: c - n + 1].sum()))
    return min((c for c in sizes if c >= n), key=lambda c: (cost(c) / fill(c), c))


def best_fit(lengths: Sequence[int], sizes: Sequence[int]) -> tuple[list[int], list[int]]:
    """(bin of each piece, capacity of each bin) for pieces in this order.

    A piece goes to the bin with the least room that holds it; bins of equal room in order of opening, last first. If
    none does, a bin opens at the least-cost size.
    """
    room_bins: dict[int, list[int]] = {}
    rooms = 0  # bit r: some bin has room r
    where, capacity = [], []
    left = np.bincount(np.array(lengths, dtype=np.int64), lengths, minlength=max(sizes) + 1).astype(np.int64)
    for n in lengths:
        left[n] -= n
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            bins = room_bins[room]
            k = bins.pop()
            if not bins:
                rooms ^= 1 << room
        else:
            room = opening(n, left, sizes)
            k = len(capacity)
            capacity.append(room)
        rest = room - n
        room_bins.setdefault(rest, []).append(k)
        rooms |= 1 << rest
        where.append(k)
    return where, capacity


def plan(lengths: np.ndarray, sizes: Sequence[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each piece and the capacity of each bin, for lengths in descending order.

    Each set of the largest sizes down to one of them is packed in turn, every bin then taken down to the smallest size
    that holds its contents; the plan with the least total cost wins, of equal ones that with the fewest bins.
    """
    sizes = np.array(sorted(sizes))
    best = None
    for k in range(len(sizes)):
        where = np.array(best_fit(lengths.tolist(), sizes[k:].tolist())[0], dtype=np.int64)
        filled = np.bincount(where, lengths).astype(np.int64)
        down = sizes[np.searchsorted(sizes, filled)]
        total = (float(sum(cost(int(c)) for c in down)), len(down))
        if best is None or total < best[0]:
            best = (total, where, down)
    _, where, down = best
    order = np.argsort(where, kind="stable")
    before = np.cumsum(lengths[order]) - lengths[order]
    first = np.r_[True, where[order][1:] != where[order][:-1]]
    offset = np.empty(len(where), dtype=np.int64)
    offset[order] = before - np.maximum.accumulate(np.where(first, before, 0))
    return where, offset, down


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens): words between white space; null: 0."""
    return docs.select(id_col, F.coalesce(F.regexp_count(text_col, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).alias("n_tokens"))


def pack(lengths: DataFrame, id_col: str = "doc_id", sizes: Sequence[int] = CAPACITIES, shard: int = SHARD) -> DataFrame:
    """Pack documents, given as (id, n_tokens), into sequences whose lengths are among sizes.

    Returns (id, piece, start, n_tokens, bin_id, bin_offset, capacity): tokens start to start + n_tokens of the document lie
    at bin_offset of the bin. Documents over the largest size are cut into pieces of that size and a rest. A document
    without tokens (null or blank text, null count) keeps one row, of no bin. Rows that repeat an id are packed as documents of their
    own; an empty table gives an empty result; other columns are ignored. Pieces are dealt by hash to shards of about
    shard pieces, each packed by best fit, longest first, ties by id and piece.
    """
    top = max(sizes)
    lengths = written(lengths.select(F.col(id_col).alias("id"), F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n")))
    last = F.greatest(F.ceil(F.col("n") / top), F.lit(1)) - 1
    pieces = (
        lengths.select("id", "n", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("piece"))
        .withColumn("start", F.col("piece") * top)
        .withColumn("n_tokens", F.least(F.lit(top), F.col("n") - F.col("start")))
        .drop("n")
    )
    count = lengths.agg(F.sum(last + 1)).first()[0] or 0
    shards = max(1, -(-int(count) // shard))
    kind = dict(pieces.dtypes)["id"]
    schema = f"id {kind}, piece long, start long, n_tokens long, bin_id long, bin_offset long, capacity int"

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("n_tokens", "descending"), ("id", "ascending"), ("piece", "ascending")])
        where, offset, capacity = plan(group.column("n_tokens").to_numpy(), sizes)
        number = group.column("shard").to_numpy()
        columns = [group.column(c) for c in ("id", "piece", "start", "n_tokens")]
        return pa.table(
            [*columns, pa.array(number.astype(np.int64) << 32 | where), pa.array(offset), pa.array(capacity[where].astype(np.int32))],
            names=["id", "piece", "start", "n_tokens", "bin_id", "bin_offset", "capacity"],
        )

    dealt = pieces.where("n_tokens > 0").withColumn("shard", F.pmod(F.xxhash64("id", "piece"), F.lit(shards)).cast("int"))
    packed = dealt.groupBy("shard").applyInArrow(run, schema)
    none = pieces.where("n_tokens = 0").selectExpr("*", "cast(null as long) bin_id", "cast(null as long) bin_offset", "cast(null as int) capacity")
    return packed.unionByName(none).withColumnRenamed("id", id_col)


def op4_packing(spark, sf_dir: str) -> DataFrame:
    return pack(token_counts(table(spark, sf_dir, "documents")))
