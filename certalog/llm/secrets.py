"""Secret scans: fixed patterns, and character Markov models of random strings against identifiers. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from certalog.llm.common import table

#: Kinds in the order of the joined spans: pattern, group whose length counts, its least length (fixed values).
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = (("assign", ASSIGN, 1, 6), ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24))
#: What the models score: runs of these, of this length or more with a digit, and the log-likelihood ratio for each character that a secret needs.
CANDIDATE, SCORE = r"[A-Za-z0-9+/_=-]{16,}", 0.75
#: Characters are modelled by class and letter: ASCII letters and digits as such, the rest as one.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"


def spans(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """Array of (start, kind, end, value) of the leftmost non-overlapping matches whose group has least characters.

    Spans are code points, end exclusive, of the whole match; the pieces between matches give the starts.
    """
    rank = [k for k, *_ in BASE].index(kind) if kind in [k for k, *_ in BASE] else len(BASE)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    between = F.split(text, pattern, -1)

    def step(state, x):
        start = state["at"] + F.length(x["gap"])
        end = start + F.length(x["m"])
        one = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), x["v"].alias("value"))
        return F.struct(end.alias("at"), F.when(F.length(x["v"]) >= least, F.array_append(state["out"], one)).otherwise(state["out"]).alias("out"))

    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,value:string>>")
    matches = F.zip_with(F.slice(between, 1, F.size(whole)), F.arrays_zip(whole.alias("m"), value.alias("v")), lambda g, y: F.struct(g.alias("gap"), y["m"].alias("m"), y["v"].alias("v")))
    found = F.aggregate(matches, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda s: s["out"])
    return F.when(F.exists(value, lambda v: F.length(v) >= least), found).otherwise(none)


def with_base(docs: DataFrame) -> DataFrame:
    """doc_id, text ('' for null) and the base spans of each row."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    each = [spans(F.col("text"), *b).alias(b[0]) for b in BASE]
    return rows.select("doc_id", "text", *each)


def transitions(strings: DataFrame, name: str) -> DataFrame:
    """(pair, name): how often each pair of neighbouring characters is in the strings (column s)."""
    pairs = F.transform(F.sequence(F.lit(1), F.length("s") - 1), lambda i: simplified(F.substring(F.col("s"), i, 2)))
    return strings.where(F.length("s") > 1).select(F.explode(pairs).alias("pair")).groupBy("pair").agg(F.count("*").alias(name))


def simplified(s: Column) -> Column:
    """Signs other than ASCII letters and digits count as one."""
    return F.regexp_replace(s, "[^A-Za-z0-9]", "-")


def fit(found: DataFrame) -> dict[str, float]:
    """Log-likelihood ratio of each character pair, random strings to identifiers.

    Labelled samples: values of the base patterns are random strings, words of 5 letters or more outside them ordinary
    identifiers, of the whole corpus; both are counted by Spark, so that what is gathered is at most 63 squared counts. A uniform
    prior of one a pair stands for random strings that the corpus doesn't show.
    """
    random = found.select(F.explode(F.concat(*[F.transform(b[0], lambda x: x["value"]) for b in BASE])).alias("s")).distinct()
    words = found.select(F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z][A-Za-z_-]{4,}(?![0-9A-Za-z+/=_-])"), F.lit(0))).alias("s")).groupBy("s").agg(F.count("*").alias("n")).where("n > 1").select("s")
    counts = transitions(random, "a").join(transitions(words, "b"), "pair", "full").na.fill(0).collect()
    size = len(ALPHABET) + 1
    rows: dict[str, list[float]] = {}
    for r in counts:
        first = rows.setdefault(r.pair[0], [0.0, 0.0])
        first[0] += r.a
        first[1] += r.b
    got = {r.pair: (r.a, r.b) for r in counts}
    out = {}
    for x in ALPHABET + "-":
        na, nb = rows.get(x, (0.0, 0.0))
        for y in ALPHABET + "-":
            a, b = got.get(x + y, (0, 0))
            out[x + y] = math.log((a + 1) / (na + size)) - math.log((b + 0.5) / (nb + 0.5 * size))
    return out


def scored(value: Column, table_: Column) -> Column:
    """Mean log-likelihood ratio of the value's character pairs."""
    plain = simplified(value)
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(value) - 1), F.lit(0.0), lambda s, i: s + F.coalesce(F.element_at(table_, F.substring(plain, i, 2)), F.lit(0.0))
    )
    return total / (F.length(value) - 1)


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, found) for every row: the base spans and those of kind 'markov', by start, then kind.

    A markov span is a run of CANDIDATE characters that overlaps no base span, has a digit, and scores SCORE or more a character.
    Null texts are empty texts; repeated rows are scanned alike; other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    found = with_base(docs)
    model = fit(found)
    ratios = spark.createDataFrame([(model,)], "ratio map<string,double>")  # 63 squared entries, whatever the input
    base = F.concat(*[F.col(b[0]) for b in BASE])
    runs = F.filter(spans(F.col("text"), "markov", CANDIDATE, 0, 16), lambda x: x["value"].rlike("[0-9]"))
    apart = F.filter(F.col("runs"), lambda x: ~F.exists(F.col("base"), lambda y: (x["start"] < y["end"]) & (y["start"] < x["end"])))
    rows = found.select("doc_id", base.alias("base"), runs.alias("runs"), *[b[0] for b in BASE]).select("doc_id", "base", apart.alias("apart"), *[b[0] for b in BASE])
    judged = rows.crossJoin(F.broadcast(ratios)).select(
        "doc_id", *[b[0] for b in BASE], F.array_sort("base").alias("base"), F.filter("apart", lambda x: scored(x["value"], F.col("ratio")) >= SCORE).alias("markov")
    )
    return judged.withColumn("found", F.array_sort(F.concat("base", "markov")))


def told(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op5_secrets(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k, *_ in BASE],
        F.sha2(told(F.col("base")), 256).alias("base_sha256"),
        told(F.col("found")).alias("spans"),
        F.size("markov").cast("long").alias("n_markov"),
    )
