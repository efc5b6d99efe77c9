"""Joins of texts: by trigram similarity above a least value, and by terms that texts contain."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from certalog.functions.text import bound, once
from certalog.operators.tables import set_similarity, trigrams
from certalog.session import staged


def _rarest_first(texts: DataFrame, counts: DataFrame) -> DataFrame:
    """(s, o): each text's trigrams with whether the other side has them too, those of few texts first."""
    each = texts.select("s", F.explode("t").alias("g")).join(counts, "g")
    return each.groupBy("s").agg(F.sort_array(F.collect_list(F.struct("n", "g", "shared"))).alias("o"))


def similar_texts(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(a, b, score): every text a of left with every text b of right whose trigram sets have a similarity above least.

    left and right have one column of texts; repeats count once, nulls and texts without trigrams match nothing. Two such texts share
    a trigram among the rarest few of each (prefix filter): all but least of a text's trigrams and one more. Only those are joined,
    so pairs that have just common trigrams make no row; sizes that differ too much, and places after which too few trigrams are left,
    are left out in the same join. The trigrams themselves are fetched for the pairs that remain.
    """
    if not 0 < least < 1:
        raise ValueError("least lies between 0 and 1")
    sides = [df.select(F.col(df.columns[0]).alias("s")).where("s is not null").distinct().withColumn("t", trigrams(F.col("s"))) for df in (left, right)]
    each = [s.select(F.explode("t").alias("g"), F.lit(k).alias("side")) for k, s in enumerate(sides)]
    counts = each[0].unionAll(each[1]).groupBy("g").agg(F.count("*").alias("n"), (F.min("side") < F.max("side")).alias("shared"))
    few = F.slice("o", 1, (F.size("o") - F.ceil(F.size("o") * least - 1e-9) + 1).cast("int"))
    ranked = [_rarest_first(s, counts).select("s", F.size("o").alias("m"), F.posexplode(few).alias("i", "x")).where("x.shared") for s in sides]
    a = ranked[0].select(F.col("s").alias("a"), "m", "i", F.col("x.g").alias("g"))
    b = ranked[1].select(F.col("s").alias("b"), F.col("m").alias("n"), F.col("i").alias("j"), F.col("x.g").alias("g"))
    m, n = F.col("m"), F.col("n")
    enough = F.least(m - F.col("i"), n - F.col("j")) >= (m + n) * (least / (1 + least)) - 1e-9  # even if all that come after are shared
    near = a.join(b, "g").where((m * least <= n) & (n * least <= m) & enough).select("a", "b").distinct()
    sets = [s.withColumnsRenamed({"s": c, "t": f"t_{c}"}).hint("merge") for s, c in zip(sides, "ab")]  # sets of trigrams are many times their texts' size
    near = near.join(sets[0], "a").join(sets[1], "b")
    return near.select("a", "b", set_similarity(F.col("t_a"), F.col("t_b")).alias("score")).where(F.col("score") > least)


#: Different trigrams of queries up to which every text is held against all of them; beyond, texts and trigrams are joined.
FEW_GRAMS = 4_000
#: Queries and kinds of text of one block of comparisons.
QUERY_BLOCK, KIND_BLOCK = 2_048, 4_096


def _kinds(rows: DataFrame, grams: DataFrame) -> DataFrame:
    """rows (s, ids, t) as (shared, n, id): which of grams each text has, in order and as one text, and how many trigrams of its own."""
    if grams.count() <= FEW_GRAMS:
        every = rows.join(F.broadcast(grams.agg(F.sort_array(F.collect_list("g")).alias("all"))))
        made = once(every, shared=F.array_join(F.array_intersect("all", "t"), "\n"), n=F.size("t")).where("shared <> ''")
        return made.select("shared", "n", F.explode("ids").alias("id"))
    each = rows.select("s", "ids", F.size("t").alias("n"), F.explode("t").alias("g")).join(grams, "g")
    made = each.groupBy("s", "n").agg(F.first("ids").alias("ids"), F.array_join(F.sort_array(F.collect_set("g")), "\n").alias("shared"))
    return made.select("shared", "n", F.explode("ids").alias("id"))


def _best_kinds(least: float, most: int):
    """Of a block of queries and one of kinds: of each query the most kinds of the best scores above least, ties by smaller lowest id."""

    def best(queries: pa.Table, kinds: pa.Table) -> pa.Table:
        kinds = kinds.take(pc.sort_indices(kinds["low"])) if kinds.num_rows else kinds
        sets = [pc.split_pattern(t[c].combine_chunks(), "\n") for t, c in ((queries, "grams"), (kinds, "shared"))]
        grams = pc.unique(sets[0].flatten())
        held = []
        for s in sets:
            m = np.zeros((len(s), len(grams)), np.float32)
            column = pc.index_in(s.flatten(), value_set=grams)
            there = pc.is_valid(column).to_numpy(zero_copy_only=False)
            m[pc.list_parent_indices(s).to_numpy()[there], column.drop_null().to_numpy()] = 1
            held.append(m)
        shared = (held[0] @ held[1].T).astype(np.float64)
        score = shared / (queries["m"].to_numpy()[:, None] + kinds["n"].to_numpy()[None, :] - shared)
        at, kind = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, of in enumerate(score):
            near = np.flatnonzero(of > least)
            if len(near) > most:
                near = near[of[near] >= np.partition(of[near], -most)[-most]]
            near = near[np.argsort(-of[near], kind="stable")[:most]]
            at.append(np.full(len(near), i))
            kind.append(near)
        at, kind = np.concatenate(at), np.concatenate(kind)
        return pa.table({"a": queries["a"].take(at), "shared": kinds["shared"].take(kind), "n": kinds["n"].take(kind), "score": pa.array(score[at, kind], pa.float64())})

    return best


def nearest_texts(queries: DataFrame, rows: DataFrame, least: float, first: int, repeats: int = 1) -> DataFrame:
    """(a, id, score): of every text a of queries (one column) rows whose text's trigram set has a similarity above least, among them the
    first ids by best score, ties by smaller id.

    rows: (text, id); an id has repeats texts at most. Texts that have the same trigrams of the queries, and as many of their own, are of one
    kind: it has one score, and its first smallest ids alone can count (so can those of a text, whose trigrams are made once). Queries and kinds are compared in blocks, of which each
    keeps of a query first * repeats kinds, so neither pairs nor the trigrams of texts are ever listed. Nulls and texts without trigrams match nothing.
    """
    if not 0 < least < 1:
        raise ValueError("least lies between 0 and 1")
    most = first * repeats
    q = queries.select(F.col(queries.columns[0]).alias("a")).where("a is not null").distinct()
    q = once(q, t=trigrams(F.col("a"))).where(F.size("t") > 0)
    r = rows.select(F.col(rows.columns[0]).alias("s"), F.col(rows.columns[1]).alias("id")).where("s is not null and id is not null")
    r = r.withColumn("k", F.dense_rank().over(Window.partitionBy("s").orderBy("id"))).where(F.col("k") <= first).groupBy("s").agg(F.collect_set("id").alias("ids"))
    kinds = _kinds(once(r, t=trigrams(F.col("s"))), q.select(F.explode("t").alias("g")).distinct())
    few = kinds.withColumn("k", F.dense_rank().over(Window.partitionBy("shared", "n").orderBy("id"))).where(F.col("k") <= first).drop("k").distinct()
    few = staged(few)
    of_kind = staged(few.groupBy("shared", "n").agg(F.min("id").alias("low"), F.count("*").alias("ids")))
    q = staged(q.select("a", F.array_join("t", "\n").alias("grams"), F.size("t").alias("m")))
    blocks = [max(1, -(-df.count() // size)) for df, size in ((q, QUERY_BLOCK), (of_kind, KIND_BLOCK))]
    every = lambda name, n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    left = q.select("*", F.pmod(F.xxhash64("a"), F.lit(blocks[0])).cast("int").alias("i"), every("j", blocks[1]))
    right = of_kind.select("shared", "n", "low", F.pmod(F.xxhash64("shared", "n"), F.lit(blocks[1])).cast("int").alias("j"), every("i", blocks[0]))
    met = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(_best_kinds(least, most), "a string, shared string, n int, score double")
    met = met.join(of_kind, ["shared", "n"])
    met = met.withColumn("k", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), "low"))).where(F.col("k") <= most)
    upto, same = Window.partitionBy("a").orderBy(F.desc("score")), Window.partitionBy("a", "score")
    better = F.sum("ids").over(upto) - F.sum("ids").over(same)  # of better kinds; the default frame takes in the equal ones
    met = met.withColumn("better", better).where(F.col("better") < most).select("a", "shared", "n", "score")
    return met.join(few, ["shared", "n"]).select("a", "id", "score")


def _grams(c: Column, size: int) -> Column:
    """The different stretches of size characters; none of shorter texts."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))


#: Terms and their characters up to which every text is searched for all of them; beyond, texts and terms meet at rare stretches.
FEW_TERMS, FEW_CHARACTERS = 1_000, 50_000


def are_few(terms: DataFrame) -> bool:
    """Whether the terms (one column) are few and short enough to go with every task."""
    n, size = terms.agg(F.count("*"), F.coalesce(F.sum(F.length(terms.columns[0])), F.lit(0))).first()
    return n <= FEW_TERMS and size <= FEW_CHARACTERS


def contained_terms(texts: DataFrame, terms: DataFrame, size: int = 3) -> DataFrame:
    """(id, term): which terms stand within which texts; texts: (id, text), terms: (term); each pair once, ids are unique.

    A few terms go to every text, which is searched for each, without a shuffle. Of more, every term is looked for by that of its stretches of
    size characters which fewest texts have (the whole term if it is shorter): texts meet only terms whose rarest stretch they have, and are
    then searched. Null and empty terms stand in no text.
    """
    t = terms.select(F.col(terms.columns[0]).alias("term")).where("term is not null and term <> ''").distinct()
    body = texts.select(F.col(texts.columns[0]).alias("id"), F.col(texts.columns[1]).alias("text"))
    if are_few(t):
        every = body.join(F.broadcast(t.agg(F.collect_list("term").alias("terms"))))
        within = lambda b: F.filter(b["terms"], lambda term: F.contains(b["text"], term))
        return every.select("id", F.explode(bound(F.struct("text", "terms"), within)).alias("term"))
    return _contained_by_grams(body.where("text is not null"), t, size)


def _contained_by_grams(body: DataFrame, t: DataFrame, size: int) -> DataFrame:
    own = t.select("term", F.explode(F.when(F.length("term") < size, F.array("term")).otherwise(_grams(F.col("term"), size))).alias("g"))
    known = own.select("g").distinct()
    has = lambda s: body.select("id", F.explode(_grams(F.col("text"), s)).alias("g"))
    met = has(size)
    for short in t.where(F.length("term") < size).select(F.length("term").alias("n")).distinct().collect():  # fewer than size
        met = met.unionAll(has(short.n))
    met = met.join(known, "g", "left_semi")
    counts = met.groupBy("g").agg(F.count("*").alias("n"))
    pick = own.join(counts, "g", "left").groupBy("term").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "g")).alias("r")).select("term", F.col("r.g").alias("g")).where("r.n > 0")
    return met.join(pick, "g").join(body, "id").where(F.contains("text", "term")).select("id", "term")


def best_rounded(x: Column, places: int) -> Column:
    """Rounded with halves to the even neighbour, as of the doubles themselves."""
    return F.rint(x * math.pow(10, places)) / math.pow(10, places)
