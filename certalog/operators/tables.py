"""Keyed table operators: latest per key, merges, joins on alternatives, diffs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from operator import and_

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in an order that must be total."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_rank = 1").drop("_rank")


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "seq") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("int"))


def merge(target: DataFrame, source: DataFrame, keys: Sequence[str], policy: str = "overwrite") -> DataFrame:
    """Upsert of source, one row a key, into target of the same columns.

    overwrite: source's values win; coalesce: source's values win unless null; absent: only new keys are added; fill: only
    null values of target are filled. Keys are compared null-safe.
    """
    names = target.columns
    same = lambda a, b: reduce(and_, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys])
    if policy in ("absent", "overwrite"):
        first, second = (target, source) if policy == "absent" else (source, target)
        rest = second.alias("x").join(first.select(*keys).alias("y"), same("x", "y"), "left_anti")
        return first.select(*names).unionByName(rest.select(*names))
    t, s = target.withColumn("_t", F.lit(True)).alias("t"), source.withColumn("_s", F.lit(True)).alias("s")
    first, second = ("s", "t") if policy == "coalesce" else ("t", "s")
    return t.join(s, same("t", "s"), "full").select(*[F.coalesce(f"{first}.{c}", f"{second}.{c}").alias(c) for c in names])


def replace_part(target: DataFrame, source: DataFrame, part: Sequence[str]) -> DataFrame:
    """Rows of target in the parts that source has go; source comes in: delete by part, then insert."""
    return target.join(source.select(*part).distinct(), list(part), "left_anti").select(*target.columns).unionByName(source.select(*target.columns))


def archive(df: DataFrame, gone: Column) -> tuple[DataFrame, DataFrame]:
    """(kept, archived): archived where gone is true; unknown stays."""
    flag = F.coalesce(gone, F.lit(False))
    return df.where(~flag), df.where(flag)


def checked_archive(target: DataFrame, archived: DataFrame, before: DataFrame) -> DataFrame:
    """One row of (before, kept, archived, sound): sound if every row of before stands in exactly one of the two written tables, as often.

    The tables are compared by their counts and by the sums of their rows' hashes, which no order changes.
    """
    names = before.columns
    tell = lambda df, n: df.select(*names).agg(F.count("*").alias(n), F.coalesce(F.sum(F.xxhash64(*names).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias(f"h_{n}"))
    row = tell(before, "before").crossJoin(tell(target, "kept")).crossJoin(tell(archived, "archived"))  # one row each
    same = (F.col("before") == F.col("kept") + F.col("archived")) & (F.col("h_before") == F.col("h_kept") + F.col("h_archived"))
    return row.select("before", "kept", "archived", same.alias("sound"))


def archive_into(target: DataFrame, gone: Column, kept_path: str, archive_path: str) -> None:
    """Write target's rows where gone is true to archive_path, then the others to kept_path, and read both again: ValueError if rows are missing,
    doubled or others. Nothing is published before that; both folders go if it fails."""
    spark = target.sparkSession
    kept, archived = archive(target, gone)
    archived.write.mode("errorifexists").parquet(archive_path)
    kept.write.mode("errorifexists").parquet(kept_path)
    found = checked_archive(spark.read.parquet(kept_path), spark.read.parquet(archive_path), target).first()
    if not found.sound:
        for p in (kept_path, archive_path):
            path = spark._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        raise ValueError(f"archive of {found.before} rows left {found.kept} and took {found.archived}")


def join_either(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Inner join where any of the pairs of columns is equal, each (left, right) pair of rows once: a union of equi-joins, each without what the ones before
    it have, so that nothing is dealt out again to find repeats."""
    out, before = None, []
    for a, b in pairs:
        one = left.join(right, reduce(and_, [left[a] == right[b], *[~F.coalesce(left[x] == right[y], F.lit(False)) for x, y in before]]))
        out = one if out is None else out.union(one)
        before.append((a, b))
    return out


def newest_changes(df: DataFrame, keys: Sequence[str], order: Sequence[Column], fields: Sequence[str]) -> DataFrame:
    """(keys, field, old, new, before, after): what differs, null-safe, between the two newest rows of each key, whose fields are told whole as well.

    One window: the newest row looks at the one after it in the order.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    both = df.select(*keys, F.struct(*fields).alias("after"), F.lead(F.struct(*fields)).over(w).alias("before"), F.row_number().over(w).alias("_n")).where("_n = 1 and before is not null")
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"before.{f}").cast("string").alias("old"), F.col(f"after.{f}").cast("string").alias("new")) for f in fields])).alias("d")
    return both.select(*keys, each, "before", "after").select(*keys, "d.field", "d.old", "d.new", "before", "after").where(~F.col("old").eqNullSafe(F.col("new")))


def changed_fields(old: DataFrame, new: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """(keys, field, old, new): one row for each field that differs, null-safe, of keys that both have."""
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, list(keys)).select(
        *keys,
        F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"o.{f}").cast("string").alias("old"), F.col(f"n.{f}").cast("string").alias("new")) for f in fields])).alias("d"),
    )
    return both.select(*keys, "d.field", "d.old", "d.new").where(~F.col("old").eqNullSafe(F.col("new")))


def profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(field, total, filled, empty_rate): one pass over all columns; blank strings are empty."""
    kinds = dict(df.dtypes)
    filled = [F.count(F.when(F.trim(c) != "", 1) if kinds[c] == "string" else F.col(c)).alias(c) for c in columns]
    wide = df.agg(F.count("*").alias("total"), *filled)
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("filled")) for c in columns])).alias("e")
    return wide.select("total", each).select(
        "e.field", "total", "e.filled", F.when(F.col("total") > 0, (F.col("total") - F.col("e.filled")) / F.col("total")).alias("empty_rate")
    )


def _counted(columns: Sequence[str], most: int):
    """Of the batches of a task: of each column the rows, those filled and the most first different values."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, filled = 0, dict.fromkeys(columns, 0)
        least = {c: pa.array([], pa.string()) for c in columns}
        for batch in batches:
            total += batch.num_rows
            for c in columns:
                values = batch.column(c)
                filled[c] += len(values) - values.null_count
                if len(least[c]) >= most:
                    values = values.filter(pc.less(values, least[c][-1]))  # drops nulls too
                if values.null_count < len(values):
                    every = pc.unique(pa.concat_arrays([least[c], values.drop_null().cast(pa.string())]))
                    least[c] = every.take(pc.sort_indices(every))[:most]
        if total:
            yield pa.record_batch({"field": list(columns), "total": [total] * len(columns), "filled": list(filled.values()), "least": pa.array([least[c].to_pylist() for c in columns], pa.list_(pa.string()))})

    return counted


def first_values(df: DataFrame, columns: Sequence[str], most: int) -> DataFrame:
    """(field, total, filled, least): of each text column the rows, those not null, and the most first of its different values in order.

    One pass: a task keeps a few values of each column, so neither cells nor different values become rows. An empty table has no fields.
    """
    each = df.select(*columns).mapInArrow(_counted(list(columns), most), "field string, total long, filled long, least array<string>")
    least = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("least")))), 1, most)  # of each task's
    return each.groupBy("field").agg(F.sum("total").alias("total"), F.sum("filled").alias("filled"), least.alias("least"))


def trigrams(text: Column) -> Column:
    """Set of the trigrams of a text's words, each padded by two blanks before and one after, in lower case."""
    words = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    padded = F.concat(F.lit("  "), F.replace(words, F.lit(" "), F.lit(" \n  ")), F.lit(" "))
    return F.when(words == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.regexp_extract_all(padded, F.lit(r"(?=([^\n]{3}))"), F.lit(1))))


def set_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets; 0 if both are empty."""
    shared = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - shared
    return F.when(union > 0, shared / union).otherwise(F.lit(0.0))
