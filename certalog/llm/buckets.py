"""Buckets of MinHash bands: what shares a band is compared until each bucket is one component or no pair of it is left. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from certalog.llm.common import components, join_counted, written

#: Rows of a bucket that one unit of work compares with as many others.
BLOCK = 512
#: Members of a bucket that all others are compared with first.
HUBS = 8
#: Members of a bucket that meet one copy of a hub.
SPREAD = 4096
#: Numbers of 64 bits of a text's sketch; a power of two.
WORDS = 16
#: Members of a bucket whose texts meet one hub first, not HUBS.
FEW = 16


def node(k1: str = "k1", k2: str = "k2") -> Column:
    """A 128-bit key as one number of 126 bits, which can be compared, grouped and kept in generated code."""
    return (F.col(k1).cast("decimal(20,0)") * F.lit(Decimal(1 << 62)) + F.shiftrightunsigned(k2, 2)).cast("decimal(38,0)")


def members(signed: DataFrame, rows: int, bands: int) -> DataFrame:
    """(band, k, k1, k2): what shares a band with something else, from a table (k1, k2, bands) of so many rows; a written table."""
    keyed = signed.select("k1", "k2", F.explode("bands").alias("band"))
    shared = keyed.groupBy("band").agg(F.count("*").alias("m")).where("m > 1")
    return written(join_counted(keyed, shared, ["band"], "m", bands * rows).select("band", node().alias("k"), "k1", "k2"))


def similar(s: str, hs: str, similarity: float, shingled: Callable[[Column], Column] | None = None) -> Column:
    """Whether two shingle sets have the Jaccard similarity; shingled: what makes a set of a column, if it holds texts."""

    def near(a: Column, b: Column) -> Column:
        n, hn, shared = F.size(a), F.size(b), F.size(F.array_intersect(a, b))
        return (F.least(n, hn) >= similarity * F.greatest(n, hn)) & (shared >= similarity * (n + hn - shared))

    if shingled is None:
        return near(F.col(s), F.col(hs))
    both = F.array(F.struct(shingled(F.col(s)).alias("a"), shingled(F.col(hs)).alias("b")))
    return F.transform(both, lambda p: near(p["a"], p["b"]))[0]  # each set is made once


def possible(similarity: float) -> Column:
    """Whether the sketches of two texts (b, z and hb, hz; see sketched) allow the similarity: their sets differ by at least the bits in which these do."""
    apart = sum((F.bit_count(F.get("b", i).bitwiseXOR(F.get("hb", i))) for i in range(WORDS)), F.lit(0))
    return (F.least("z", "hz") >= similarity * F.greatest("z", "hz")) & (apart * (1 + similarity) <= (1 - similarity) * (F.col("z") + F.col("hz")) + 1e-6)


def sketched(texts: DataFrame, shingled: Callable[[Column], Column]) -> DataFrame:
    """texts (k unique, s) with z, the size of a text's set of hashes, and b, which of WORDS * 64 bits an odd number of them name, as WORDS numbers.

    One more member in one of two sets turns one bit, so the sets differ by at least the bits in which these do. They are exploded and aggregated
    within generated code, by two numbers that stand for k, of which the writing to a hash table would cost more than all else.
    """
    keyed = texts.withColumns({"_k1": F.xxhash64("k"), "_k2": F.xxhash64(F.lit(1), "k")})
    hashed = keyed.select("_k1", "_k2", F.explode(shingled(F.col("s"))).alias("x"))
    word, bit = F.shiftrightunsigned("x", 6).bitwiseAND(F.lit(WORDS - 1)), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("x").bitwiseAND(F.lit(63)).cast("int"))
    words = [F.bit_xor(F.when(word == i, bit).otherwise(F.lit(0).cast("long"))).alias(f"b{i}") for i in range(WORDS)]
    bits = hashed.groupBy("_k1", "_k2").agg(F.count("*").alias("z"), *words).select("_k1", "_k2", F.array(*[f"b{i}" for i in range(WORDS)]).alias("b"), "z")
    return keyed.join(bits, ["_k1", "_k2"]).drop("_k1", "_k2")


def alike(pairs: DataFrame, sets: DataFrame, carried: tuple[str, ...], linked: Column) -> DataFrame:
    """The pairs (k, h, m) for which linked holds, told by what both carry to it; what a hub carries is repeated so that about SPREAD pairs meet each copy."""
    salts = F.ceil(F.col("m") / SPREAD).cast("int")
    pairs = written(pairs)
    hubs = pairs.groupBy("h").agg(F.max("m").alias("m"))
    copies = F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt")
    other = sets.select(F.col("k").alias("h"), *[F.col(c).alias(f"h{c}") for c in carried]).join(hubs, "h").select("h", *[f"h{c}" for c in carried], copies)
    mine = pairs.join(sets.select("k", *carried), "k").select("k", "h", "m", *carried, F.pmod(F.xxhash64("k"), salts).cast("int").alias("salt"))
    return mine.join(other, ["h", "salt"]).where(linked).select("k", "h", "m")


def met(found: DataFrame, rows: int, few: int = 0) -> DataFrame:
    """(band, k, m, hubs): the members of each bucket, so many rows, with its size and HUBS of its own, one in a bucket of few; a written table."""
    own = F.array_distinct(F.array(*[F.min_by("k", F.xxhash64(F.lit(i), F.col("k"))) for i in range(HUBS)]))
    hubs = found.groupBy("band").agg(F.count("*").alias("m"), own.alias("hubs"))
    hubs = hubs.select("band", "m", F.slice("hubs", 1, F.when(F.col("m") <= few, 1).otherwise(HUBS)).alias("hubs"))
    return written(join_counted(found.select("band", "k"), hubs, ["band"], "m", rows).select("band", "k", "m", "hubs"))


def hub_pairs(met: DataFrame) -> DataFrame:
    """(k, h, m): the members of each bucket with its hubs, two hubs once, and the largest bucket that brings them together."""
    pairs = met.select("k", "m", "hubs", F.explode("hubs").alias("h")).where((F.col("k") < F.col("h")) | ~F.array_contains("hubs", F.col("k")))
    return pairs.groupBy("k", "h").agg(F.max("m").alias("m"))


def units(labelled: DataFrame, rows: int, sets: DataFrame, *kept: str) -> tuple[DataFrame, DataFrame]:
    """Work of comparing the members of each bucket (band, k; so many rows) that are in different components (c).

    (own, other): the members outside a bucket's largest component meet all of the bucket, in blocks; each
    pair of blocks (band, bi, bj) is a unit. Pairs count if c <> hc and (led or k < h). A bucket of one component costs nothing.
    """
    each = labelled.groupBy("band", "c").agg(F.count("*").alias("m"))
    size = (
        each.groupBy("band")
        .agg(F.max(F.struct("m", "c")).alias("top"), F.sum("m").alias("whole"), (F.sum("m") - F.max("m")).alias("apart"))
        .where("apart > 0")
        .select("band", "whole", F.col("top.c").alias("lead"), F.ceil(F.col("apart") / BLOCK).cast("int").alias("ni"), F.ceil(F.col("whole") / BLOCK).cast("int").alias("nj"))
    )
    here = join_counted(labelled, size, ["band"], "whole", rows).join(sets.select("k", *kept), "k")
    dealt = lambda n: F.pmod(F.xxhash64("k"), n).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = here.where("c <> lead").select("band", dealt(F.col("ni")).alias("bi"), spread("nj").alias("bj"), "k", "c", *kept)
    led = (F.col("c") == F.col("lead")).alias("led")
    other = here.select("band", spread("ni").alias("bi"), dealt(F.col("nj")).alias("bj"), F.col("k").alias("h"), F.col("c").alias("hc"), *[F.col(x).alias(f"h{x}") for x in kept], led)
    return own, other


def across(labelled: DataFrame, rows: int, sets: DataFrame, similarity: float, shingled: Callable[[Column], Column] | None = None) -> DataFrame:
    """(k, h): the links between members of a bucket that are in different components. Rows that leave the join are links, not candidates.

    Of texts (see similar) only the sketches meet in the join; the texts follow for those pairs that these allow.
    """
    own, other = units(labelled, rows, sets, *(("b", "z") if shingled else ("s",)))
    apart = (F.col("c") != F.col("hc")) & (F.col("led") | (F.col("k") < F.col("h")))
    both = own.join(other, ["band", "bi", "bj"])
    if not shingled:
        return both.where(apart & similar("s", "hs", similarity)).select("k", "h")
    pairs = written(both.where(apart & possible(similarity)).select("k", "h").distinct())
    often = pairs.groupBy("h").agg(F.count("*").alias("m"))
    counted = join_counted(pairs, often, ["h"], "m", pairs.count()).select("k", "h", "m")
    return alike(counted, sets, ("s",), similar("s", "hs", similarity, shingled)).select("k", "h")


def connected(
    found: DataFrame,
    sets: DataFrame,
    similarity: float,
    rest: Callable[[DataFrame, int, DataFrame, float], DataFrame] | None = None,
    shingled: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """(node, component) of the members (band, k) that have links by exact Jaccard similarity of their sets (k, s); a written table.

    s may be a text that shingled makes a set of; sets is then sketched.

    Members of a bucket are compared with some hubs of it, so that large groups become components at once; then all others that are still in
    different components are compared. No link between two members of a bucket is lost.
    """
    rows = found.count()
    each = met(found, rows, FEW if shingled else 0)
    pairs = hub_pairs(each)
    if shingled:
        pairs = alike(pairs, sets, ("b", "z"), possible(similarity))
    stars = components(alike(pairs, sets, ("s",), similar("s", "hs", similarity, shingled)), "k", "h")
    named = stars.withColumnsRenamed({"node": "k", "component": "c"})
    others = each.where(~F.array_contains("hubs", F.col("k"))).select("band", "k")  # hubs have met all of their bucket
    labelled = written(others.join(named, "k", "left").select("band", "k", F.coalesce("c", "k").alias("c")))
    more = rest(labelled, rows, sets, similarity) if rest else across(labelled, rows, sets, similarity, shingled)
    return components(stars.select(F.col("node").alias("k"), F.col("component").alias("h")).unionByName(more), "k", "h")
