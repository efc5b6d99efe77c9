"""Fuzzy line deduplication: MinHash over character shingles, exact Jaccard, connected components. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from certalog.llm.buckets import connected, members, node, sketched
from certalog.llm.common import join_counted, kept, scratch, table, written

#: Characters of a shingle, bands and hashes of a band, least Jaccard similarity of linked lines.
SHINGLE, BANDS, ROWS, SIMILARITY = 8, 6, 3, 0.8
LINE = ("k1", "k2")
#: Letters, digits and signs of scripts with spaces; ASCII signs other than those.
_RUN, _SIGNS = r"[0-9A-Za-z\x80-⹿]", r"[!-/:-@\[-`{-~]"
_WORD = rf"(?:{_RUN}{{1,{SHINGLE}}}+(?!{_RUN})|\S){_SIGNS}*+\s*+"


def shingles(line: Column) -> Column:
    """All runs of SHINGLE characters of the line; a shorter line is one."""
    every = F.regexp_extract_all(line, F.lit(rf"(?s)(?=(.{{{SHINGLE}}}))."), F.lit(1))
    return F.when(F.size(every) > 0, every).otherwise(F.array(line))


def anchored(line: Column) -> Column:
    """Those runs of SHINGLE characters, fewer at the line's end, that begin at a word or more than SHINGLE letters before the end of one.

    A word is a run of letters and digits with the signs after it, a run of signs, or one character beyond U+2E7F, where scripts go
    without spaces. Every character of the line is in one. Where they begin depends on the characters next to them alone, so an edit leaves
    all others as they are, in long words and scripts without spaces too; they stand for all shingles where candidates are looked for.
    """
    return F.regexp_extract_all(line, F.lit(rf"(?s)(?=(\S.{{0,{SHINGLE - 1}}})){_WORD}"), F.lit(1))


def occurrences(docs: DataFrame) -> DataFrame:
    """(doc_id, th, pos, line, k1, k2): the lines with a word, by text and by a 128-bit key; th is the text's hash."""
    return (
        docs.where(F.col("text").isNotNull())
        .select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
        .where(F.col("line").rlike(r"\S"))
        .withColumns({"k1": F.xxhash64("line"), "k2": F.xxhash64(F.lit(1), F.col("line"))})
    )


def signatures(lines: DataFrame) -> DataFrame:
    """(k1, k2, n, bands): for each distinct line how often it occurs and one hash for each band of ROWS min-hashes.

    A min-hash is the least xor of a seeded constant with the anchored shingles' hashes, turned by some bits so that others decide which
    is least: by the same ones a few shingles would be the least of most. Shingles are exploded and aggregated within
    generated code, copies of a line map-side, so a frequent line costs no more shuffle than a rare one.
    """
    turned = lambda r: F.shiftleft("h", r).bitwiseOR(F.shiftrightunsigned("h", 64 - r)) if r else F.col("h")
    mins = [F.min(turned(6 * (k % 10)).bitwiseXOR(F.xxhash64(F.lit(k)))).alias(f"m{k}") for k in range(BANDS * ROWS)]
    each = lines.select(*LINE, F.posexplode(anchored(F.col("line"))).alias("i", "s")).select(*LINE, "i", F.xxhash64("s").alias("h"))
    bands = [F.xxhash64(F.lit(b), *[f"m{b * ROWS + r}" for r in range(ROWS)]) for b in range(BANDS)]
    return each.groupBy(*LINE).agg(F.count_if(F.col("i") == 0).alias("n"), *mins).select(*LINE, "n", F.array(*bands).alias("bands"))


def shingle_set(line: Column) -> Column:
    """The hashes of all shingles of a line, each once. They are cut from UTF-32, where a character is found by its place, and the line is encoded once."""
    at = lambda b: F.sequence(F.lit(0), F.greatest(F.length(b) - 4 * SHINGLE, F.lit(0)), F.lit(4))
    cut = F.transform(F.array(F.encode(line, "UTF-32")), lambda b: F.transform(at(b), lambda i: F.xxhash64(F.substring(b, i + 1, 4 * SHINGLE))))
    return F.array_distinct(cut[0])


def wanted_lines(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(k, k1, k2, n, s): occurrences and text of each wanted line (k1, k2)."""
    each = occurrences(docs).select(*LINE, "line").join(wanted.hint("shuffle_hash"), list(LINE), "left_semi")
    texts = each.groupBy(*LINE).agg(F.first("line").alias("line"), F.count("*").alias("n"))
    return texts.select(node().alias("k"), *LINE, "n", F.col("line").alias("s"))


def sketched_lines(texts: DataFrame) -> DataFrame:
    """Lines with sketches of all their shingles, and the number of these."""
    return sketched(texts, shingle_set)


def removals(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, th, gone): the positions of the lines that go from each document that loses any; a written table.

    Of a component's occurrences all are listed as going, and the first as staying; a document keeps what is listed as staying,
    so that no join meets at a frequent line or a large component.
    """
    with scratch(docs.sparkSession):
        signed = written(signatures(occurrences(docs)))
        lines, total = signed.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        found = members(signed, lines, BANDS)
        copies = signed.where("n > 1").select(*LINE, "n")
        sets = written(sketched_lines(written(wanted_lines(docs, found.select(*LINE).distinct()))))
        known = connected(found, sets, similarity, shingled=shingle_set).join(sets, F.col("node") == F.col("k")).select(*LINE, "n", F.col("component").alias("c"))
        alone = copies.join(known, list(LINE), "left_anti").select(*LINE, "n", node().alias("c"))
        seen = occurrences(docs).select("doc_id", "th", "pos", *LINE)
        groups = written(join_counted(seen, known.unionByName(alone), list(LINE), "n", total).select("doc_id", "th", "pos", "c"))
        first = groups.groupBy("c").agg(F.min(F.struct("doc_id", "th", "pos")).alias("f")).select("f.*", F.lit(True).alias("stays"))
        both = groups.select("doc_id", "th", "pos", F.lit(False).alias("stays")).unionByName(first)
        gone = both.groupBy("doc_id", "th", "pos").agg(F.bool_or("stays").alias("stays")).where("not stays")
        return kept(gone.groupBy("doc_id", "th").agg(F.collect_list("pos").alias("gone")))


def dedup(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs with text reduced to its kept lines, and n_lines and n_removed (both long) added.

    Lines are linked at Jaccard similarity of the sets of all their shingles of similarity or more, directly or through others;
    of each component the occurrence with the smallest (doc_id, position) stays and all others go. Lines
    without a word stay. Null texts stay null with 0 lines. Rows that repeat a doc_id with the same text are one document
    and lose the same lines; a null doc_id comes first in order. Columns named n_lines or n_removed are replaced; an empty table
    gives an empty result.
    """
    gone = removals(docs, similarity).withColumnsRenamed({"doc_id": "gone_doc", "th": "gone_th"}).hint("shuffle_hash")
    columns = docs.drop("n_lines", "n_removed").columns
    split = docs.select(*[F.split("text", "\n").alias("_lines") if c == "text" else F.col(c) for c in columns], F.xxhash64("text").alias("_th"))
    joined = split.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_doc")) & (F.col("_th") == F.col("gone_th")), "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "gone")
    left = F.when(F.col("gone").isNull(), F.col("_lines")).otherwise(F.transform(stay, lambda i: F.element_at("_lines", i + 1)))
    return joined.select(
        *[F.array_join(left, "\n").alias("text") if c == "text" else F.col(c) for c in columns],
        F.coalesce(F.array_size("_lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.array_size("gone"), F.lit(0)).cast("long").alias("n_removed"),
    )


def op9_lines(spark, sf_dir: str) -> DataFrame:
    out = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
