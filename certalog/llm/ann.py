"""Approximate nearest neighbours: one hierarchical navigable small-world graph per shard, shard results merged."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from certalog.llm.common import drop_written, table, written

#: Links of a node (twice as many at the bottom), breadth of building and searching.
LINKS, BUILD, SEARCH = 12, 48, 80
#: Distinct vectors and bytes of a shard at most; shards made for work side by side while they are smaller; queries that meet one copy of a shard.
SHARD, SHARD_BYTES, SPREAD, BLOCK = 65_536, 256 << 20, 8, 65_536


class Graph:
    """A small-world graph over the rows of vectors, as flat neighbour arrays: one row of node numbers for each node, -1 where none.

    links[0] has the bottom level, links[k] the levels above, where only nodes of level k or more have neighbours. Vectors are held
    in double precision, scaled by a power of two so that the largest component is about 1: distances are those of differences, so
    neither a common offset nor very large or small components blur them.
    """

    def __init__(self, vectors: np.ndarray, level: np.ndarray, links: list[np.ndarray], entry: int):
        self.level, self.links, self.entry = level, links, entry
        self.exponent = int(np.frexp(np.abs(vectors).max())[1]) if vectors.size else 0
        self.vectors = self.scaled(vectors)

    def scaled(self, v: np.ndarray) -> np.ndarray:
        """v in the graph's scale; what lies beyond any of its vectors by far is drawn in, so that squares stay finite."""
        with np.errstate(over="ignore"):
            return np.clip(np.ldexp(np.asarray(v, dtype=np.float64), -self.exponent), -1e150, 1e150)

    @classmethod
    def build(cls, vectors: np.ndarray, seed: int = 11) -> Graph:
        """Insert the rows one by one, each linked to a spread of its nearest found so far on every level it has."""
        n = len(vectors)
        drawn = np.random.default_rng(seed).random(n)
        level = np.floor(-np.log(1 - drawn) / np.log(LINKS)).astype(np.int32)
        links = [np.full((n, 2 * LINKS if k == 0 else LINKS), -1, dtype=np.int32) for k in range(int(level.max(initial=0)) + 1)]
        graph = cls(vectors, level, links, 0)
        for i in range(1, n):
            graph.insert(i)
        return graph

    def near(self, q: np.ndarray, nodes) -> np.ndarray:
        """Squared distances."""
        gap = self.vectors[nodes] - q
        return np.einsum("ij,ij->i", gap, gap)

    def insert(self, i: int) -> None:
        q, top, entry = self.vectors[i], int(self.level[i]), self.entry
        start = [(float(self.near(q, [entry])[0]), entry)]
        for k in range(int(self.level[entry]), top, -1):
            start = self.search_level(q, start, 1, k)
        for k in range(min(top, int(self.level[entry])), -1, -1):
            start = self.search_level(q, start, BUILD, k)
            chosen = self.spread(q, np.array([d for d, _ in start]), np.array([j for _, j in start]), LINKS)
            self.links[k][i, : len(chosen)] = chosen
            for j in chosen.tolist():
                self.link(j, i, k)
        if top > self.level[self.entry]:
            self.entry = i

    def link(self, j: int, i: int, k: int) -> None:
        row = self.links[k][j]
        free = int(np.searchsorted(-row, 1)) if row[-1] < 0 else len(row)
        if free < len(row):
            row[free] = i
            return
        near = self.near(self.vectors[j], nodes := np.append(row, i))
        order = np.argsort(near, kind="stable")
        kept = self.spread(self.vectors[j], near[order], nodes[order], len(row))
        row[:] = -1
        row[: len(kept)] = kept

    def spread(self, q: np.ndarray, near: np.ndarray, nodes: np.ndarray, most: int) -> np.ndarray:
        """Of nodes, nearest to q first, those nearer to q than to any kept before; then the nearest others, up to most."""
        if len(nodes) <= most // 2:
            return nodes
        gap = self.vectors[nodes] - q
        apart = near[:, None] + near[None, :] - 2 * (gap @ gap.T)
        kept: list[int] = []
        least = np.full(len(nodes), np.inf)
        for a in range(len(nodes)):
            if near[a] < least[a] or not kept:
                kept.append(a)
                if len(kept) == most:
                    break
                least = np.minimum(least, apart[:, a])
        if len(kept) < most:
            others = np.setdiff1d(np.arange(len(nodes)), kept, assume_unique=True)
            kept += others[: most - len(kept)].tolist()
        return nodes[kept]

    def search_level(self, q: np.ndarray, start: list[tuple[float, int]], breadth: int, k: int) -> list[tuple[float, int]]:
        """The breadth nearest nodes found on level k from the start nodes, nearest first."""
        links, seen = self.links[k], {j for _, j in start}
        todo = list(start)
        heapq.heapify(todo)
        best = [(-d, -j) for d, j in start]
        heapq.heapify(best)
        while len(best) > breadth:
            heapq.heappop(best)
        while todo:
            d, j = heapq.heappop(todo)
            if len(best) >= breadth and d > -best[0][0]:
                break
            fresh = [x for x in links[j].tolist() if x >= 0 and x not in seen]
            if not fresh:
                continue
            seen.update(fresh)
            for d, x in zip(self.near(q, fresh).tolist(), fresh):
                if len(best) < breadth:
                    heapq.heappush(best, (-d, -x))
                elif d < -best[0][0]:
                    heapq.heapreplace(best, (-d, -x))
                else:
                    continue
                heapq.heappush(todo, (d, x))
        return sorted((-d, -x) for d, x in best)

    def search(self, q: np.ndarray, breadth: int) -> np.ndarray:
        """Node numbers of up to breadth near rows, nearest first."""
        if not len(self.vectors):
            return np.zeros(0, dtype=np.int64)
        q = self.scaled(q)
        start = [(float(self.near(q, [self.entry])[0]), self.entry)]
        for k in range(int(self.level[self.entry]), 0, -1):
            start = self.search_level(q, start, 1, k)
        return np.array([j for _, j in self.search_level(q, start, breadth, 0)], dtype=np.int64)


def distances(vectors: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision; squares that would overflow or vanish are taken of scaled differences."""
    with np.errstate(over="ignore"):
        gap = vectors.astype(np.float64) - q.astype(np.float64)
    most = np.abs(gap).max(axis=1, initial=0)
    scale = np.where((most > 1e150) | ((most < 1e-150) & (most > 0)), most, 1.0)
    with np.errstate(invalid="ignore"):
        gap = np.where(np.isfinite(scale)[:, None], gap / scale[:, None], np.inf)
    return np.sqrt((gap * gap).sum(axis=1)) * scale


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): distinct rows whose vector is finite, not zero and has no null, and whose id is not null."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (
        vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))
        .select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
        .distinct()
    )


def shard_count(dim: int, n: int, shard: int) -> int:
    """Shards for n vectors of dim numbers: some for work side by side, more once they would be too large."""
    most = max(1, min(shard, SHARD_BYTES // (8 * max(1, dim))))
    return max(min(SPREAD, -(-n // 1024)), -(-n // most))


def index(vectors: DataFrame, k: int, shard: int = SHARD) -> tuple[DataFrame, dict[int, int]]:
    """(dim, shard, ...) one graph a row, written to the shared folder, and the number of shards of each dimension.

    Equal vectors are one node that carries the k + 1 smallest of their ids: no more can be among a query's k nearest
    beside the query's own. So copies, however many, neither fill a graph nor meet in one task.
    """
    order = Window.partitionBy("v").orderBy("id")
    nodes = written(
        vectors.withColumn("r", F.row_number().over(order))
        .where(F.col("r") <= k + 1)
        .groupBy("v")
        .agg(F.sort_array(F.collect_list("id")).alias("ids"))
        .withColumn("dim", F.size("v"))
    )
    shards = {r.dim: shard_count(r.dim, r.n, shard) for r in nodes.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    if not shards:
        return nodes, {}
    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("v"), count_of(shards)).cast("int"))
    schema = "dim int, shard int, ids array<array<long>>, vectors binary, level binary, entry int, links array<binary>"

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("first", "ascending")])
        dim = group.column("dim")[0].as_py()
        raw = group.column("v").combine_chunks().flatten().to_numpy().reshape(len(group), dim)
        graph = Graph.build(raw)
        return pa.table(
            {
                "dim": pa.array([dim], pa.int32()),
                "shard": pa.array([group.column("shard")[0].as_py()], pa.int32()),
                "ids": pa.array([group.column("ids").to_pylist()], pa.list_(pa.list_(pa.int64()))),
                "vectors": pa.array([raw.tobytes()], pa.binary()),
                "level": pa.array([graph.level.tobytes()], pa.binary()),
                "entry": pa.array([graph.entry], pa.int32()),
                "links": pa.array([[x.tobytes() for x in graph.links]], pa.list_(pa.binary())),
            }
        )

    built = written(dealt.withColumn("first", F.col("ids")[0]).groupBy("dim", "shard").applyInArrow(run, schema))
    drop_written(nodes)
    return built, shards


def count_of(shards: dict[int, int]):
    """The number of shards of a row's dim; null where there is none."""
    return F.create_map(*[F.lit(x) for pair in shards.items() for x in pair])[F.col("dim")]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", breadth: int = SEARCH, shard: int = SHARD) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found to each query among the rows of vectors but the query's own.

    score is the Euclidean distance in double precision on the vectors as given; nearest first, ties to the smaller id.
    Vectors that are null, zero, or hold null or non-finite components take no part, as queries or candidates, nor do rows without
    id; repeated rows count once. Vectors are compared with those of their own length only. Every query meets every shard, of which
    one copy serves BLOCK queries; an empty table gives an empty result and other columns are ignored.
    """
    kind = np.float64 if dict(vectors.dtypes)[vector_col] == "array<double>" else np.float32
    graphs, shards = index(usable(vectors, id_col, vector_col), k, shard)
    asked = usable(queries, id_col, vector_col).withColumn("dim", F.size("v"))
    if not shards:
        return asked.selectExpr("id query_id", "0 rank", "id vec_id", "0D score").limit(0)
    blocks = max(1, -(-asked.count() // BLOCK))
    met = asked.select("dim", F.explode(F.sequence(F.lit(0), count_of(shards) - 1)).alias("shard"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), "id", "v")
    copies = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def run(queries: pa.Table, graph: pa.Table) -> pa.Table:
        found = [], [], []
        if len(queries) and len(graph):
            row = graph.to_pylist()[0]
            raw = np.frombuffer(row["vectors"], dtype=kind).reshape(-1, row["dim"])
            links = [np.frombuffer(x, dtype=np.int32).reshape(len(raw), -1) for x in row["links"]]
            searched = Graph(raw, np.frombuffer(row["level"], dtype=np.int32), links, row["entry"])
            for q, v in zip(queries.column("id").to_pylist(), queries.column("v").combine_chunks().flatten().to_numpy().reshape(-1, row["dim"])):
                nodes = searched.search(v, max(breadth, k + 1))
                score = distances(raw[nodes], v).tolist()
                for s, x in sorted((s, x) for s, j in zip(score, nodes.tolist()) for x in row["ids"][j] if x != q)[:k]:
                    for column, value in zip(found, (q, x, s)):
                        column.append(value)
        return pa.table([pa.array(c, t) for c, t in zip(found, (pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])

    by = ["dim", "shard", "block"]
    found = met.groupBy(*by).cogroup(copies.groupBy(*by)).applyInArrow(run, "query_id long, vec_id long, score double")
    first = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_nearest(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 100 = 0"))
