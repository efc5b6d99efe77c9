"""Written intermediate tables and other helpers of the corpus operators."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SCRATCH: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset a local session gets one of its own; a cluster must set it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Tables that written() makes inside go at the end; what kept() makes stays."""
    path = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
    _SCRATCH.append(path)
    try:
        yield path
    finally:
        _SCRATCH.pop()
        remove(spark, path)


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def kept(df: DataFrame) -> DataFrame:
    """As written(), for a result that outlives the scratch folder."""
    inner = _SCRATCH.pop()
    try:
        return written(df)
    finally:
        _SCRATCH.append(inner)


def written(df: DataFrame, *by: str) -> DataFrame:
    """df as a table in the shared folder, by the values of some columns, read again: a cut lineage that survives lost executors.

    The shuffle files behind it go once it is written.
    """
    spark = df.sparkSession
    path = f"{_SCRATCH[-1] if _SCRATCH else shared_dir(spark)}/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.partitionBy(*by).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def drop_written(*tables: DataFrame) -> None:
    """Delete tables made by written() that no later plan reads."""
    for df in tables:
        remove(df.sparkSession, df._written)


#: Rows of a few numbers that one task can take, whatever their keys.
NARROW = 1_000_000


def join_counted(rows: DataFrame, keys: DataFrame, by: list[str], count: str, total: int, parts: int = 256) -> DataFrame:
    """Inner join of rows with keys, one row a key, where count says how many of the total rows have the key.

    A key of more than a parts-th of all rows would fill a task. Of those there are fewer than parts, so they are told to all tasks: their
    rows are salted before the shuffle and the key is repeated for each salt. The keys are the hash tables of the join.
    """
    keys = written(keys)
    often = F.col(count) > max(total // parts, parts)
    hot = F.broadcast(keys.where(often).select(*by, F.lit(parts).alias("_salts")))  # fewer than parts rows
    salted = rows.join(hot, by, "left").withColumn("_salt", F.when(F.col("_salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*rows.columns), F.lit(parts)).cast("int")))
    spread = keys.withColumn("_salt", F.explode(F.when(often, F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))))
    return salted.drop("_salts").join(spread.hint("shuffle_hash"), [*by, "_salt"]).drop("_salt")


def release() -> None:
    """Give memory that a task no longer uses back to the machine: its Python process stays for later tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def arrow_map(df: DataFrame, f: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with f called on one batch at a time."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield from f(batch)

    return df.mapInArrow(run, schema)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected graph: (node, component), a written table; component is the smallest node.

    Alternating large-star and small-star rounds, each a minimum and an equi-join by node, written to the shared folder, until a
    round changes nothing. A node's neighbours are never gathered, and beyond NARROW edges minima are combined map-side and the few nodes
    that hold a large share of the edges are salted, so a component may hold any share of the nodes. Nulls are
    ignored; nodes without edges don't appear.
    """
    now = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    total, seen = now.count(), None
    while total:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        together = 2 * total <= NARROW  # then one shuffle serves the minimum and the join
        both = both.repartition("u") if together else both
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        meet = (lambda rows, keys: rows.join(keys, "u")) if together else (lambda rows, keys: join_counted(rows, keys, ["u"], "n", 2 * total))
        large = meet(both.where("v > u"), low).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = large.repartition("u").distinct() if together else written(large.distinct())
        floor = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = (
            meet(large, floor)
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        then = written(small)
        state = tuple(then.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        drop_written(now)
        now, total = then, state[0]
        if state == seen:
            break
        seen = state
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out = written(stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))
    drop_written(now)
    return out
