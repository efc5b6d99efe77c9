"""Quality classifier: naive Bayes features in a linear hinge-loss model (dual coordinate descent)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from certalog.llm import tokens
from certalog.llm.common import arrow_map, table

#: Hashed features, labelled rows of each class that the fit takes at most, smoothing of the log-count ratios.
BITS, FIT_ROWS, ALPHA = 18, 1500, 1.0
#: Labels up to this number (about 30 MB) are broadcast to the texts; beyond it both sides are shuffled.
BROADCAST_LABELS = 500_000
COST, EPOCHS = 1.0, 12


def remainder(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 3; 1 marks held-out rows."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3


def marks(labels: DataFrame, label: str, id_col: str = "doc_id") -> DataFrame:
    """One 0/1 label for each id outside the held-out third; rows without id or label don't count, of several the larger does."""
    return (
        labels.where(F.col(id_col).isNotNull() & F.col(label).isin(0, 1) & (remainder(id_col) != 1))
        .groupBy(id_col)
        .agg(F.max(label).cast("int").alias("mark"))
    )


def labelled(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, text, mark) of the documents that known (doc_id, mark) has."""
    few = known.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS
    return docs.select("doc_id", "text").join(F.broadcast(known) if few else known, "doc_id")


def feature_counts(texts: DataFrame, bits: int) -> np.ndarray:
    """How many texts of each mark have each feature, over all labelled rows: 2 rows of 2 ** bits, summed by Spark."""

    def run(batches):
        counts = np.zeros(2 << bits, dtype=np.int64)
        for batch in batches:
            mark = batch.column(1).to_numpy(zero_copy_only=False)
            for first, part in tokens.chunks(batch.column(0)):
                doc, feature = tokens.indicators(part, bits)
                keys, n = np.unique(feature << 1 | mark[first + doc], return_counts=True)
                counts[keys] += n
        keys = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(keys >> 1), pa.array((keys & 1).astype(np.int32)), pa.array(counts[keys])], names=["feature", "mark", "n"])

    found = texts.select("text", "mark").mapInArrow(run, "feature long, mark int, n long")
    sums = found.groupBy("feature").pivot("mark", [0, 1]).sum("n").na.fill(0).toArrow()
    out = np.zeros((2, 1 << bits))
    for k in (0, 1):
        out[k, sums.column("feature").to_numpy()] = sums.column(str(k)).to_numpy()
    return out


def fit_sample(docs: DataFrame, known: DataFrame, rows: int, bits: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Features and marks of at most rows labelled rows of each mark, those with the smallest hashes of their ids."""

    def run(batch: pa.RecordBatch):
        for first, part in tokens.chunks(batch.column(0)):
            doc, feature = tokens.indicators(part, bits)
            cut = np.searchsorted(doc, np.arange(len(part) + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(cut), pa.array(feature))
            yield pa.RecordBatch.from_arrays([lists, batch.column(1).slice(first, len(part))], names=["x", "mark"])

    there = docs.select("doc_id").join(known, "doc_id")
    picked = [there.where(F.col("mark") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for k in (0, 1)]
    few = picked[0].unionByName(picked[1]).distinct()
    texts = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")  # 2 * rows at most
    got = arrow_map(texts.orderBy("doc_id").select("text", "mark"), run, "x array<long>, mark int").toArrow()
    return [x.values.to_numpy() for x in got.column("x")] if got.num_rows else [], got.column("mark").to_numpy()


def totals(docs: DataFrame, known: DataFrame) -> np.ndarray:
    """Labelled documents of mark 0 and of mark 1."""
    found = {r.mark: r.n for r in docs.select("doc_id").join(known, "doc_id").groupBy("mark").agg(F.count("*").alias("n")).collect()}
    return np.array([found.get(0, 0), found.get(1, 0)], dtype=float)


def log_ratios(counts: np.ndarray, of: np.ndarray, alpha: float) -> np.ndarray:
    """Log-count ratio of each feature between marks 1 and 0; 0 for a feature that no labelled text has."""
    p = (counts[1] + alpha) / (of[1] + 2 * alpha)
    q = (counts[0] + alpha) / (of[0] + 2 * alpha)
    return np.where(counts.sum(axis=0) > 0, np.log(p / q), 0.0)


def scaled(x: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    """The ratios of a text's features, as a vector of length 1."""
    v = ratio[x]
    norm = np.sqrt(v @ v)
    return v / norm if norm else v


def dual_coordinate_descent(xs: list[np.ndarray], vs: list[np.ndarray], y: np.ndarray, size: int, cost: float, epochs: int, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias of the L1-loss linear SVM; each class's cost is weighed by the other's share of rows."""
    w, bias = np.zeros(size), 0.0
    share = np.where(y > 0, (y < 0).mean(), (y > 0).mean())
    upper = 2 * cost * share
    alpha, norm = np.zeros(len(y)), np.array([v @ v + 1.0 for v in vs])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            gradient = y[i] * (w[xs[i]] @ vs[i] + bias) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), upper[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[xs[i]] += step * vs[i]
                bias += step
                alpha[i] = new
    return w, bias


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", bits: int = BITS, rows: int = FIT_ROWS) -> tuple[np.ndarray, np.ndarray, float]:
    """(log-count ratios, weights, bias).

    The ratios count every labelled row outside the held-out third. The hinge-loss fit takes at most rows rows of each
    class (a documented bound). Without rows of both classes all are zero and every score is 0.5.
    """
    known = marks(labels, label)
    of = totals(docs, known)
    if not of.all():
        return np.zeros(1 << bits), np.zeros(1 << bits), 0.0
    ratio = log_ratios(feature_counts(labelled(docs, known), bits), of, ALPHA)
    xs, mark = fit_sample(docs, known, rows, bits)
    vs = [scaled(x, ratio) for x in xs]
    w, bias = dual_coordinate_descent(xs, vs, np.where(mark == 1, 1.0, -1.0), 1 << bits, COST, EPOCHS)
    return ratio, w, bias


def margins(part: list[bytes], ratio: np.ndarray, w: np.ndarray, bias: float, bits: int) -> np.ndarray:
    doc, feature = tokens.indicators(part, bits)
    r = ratio[feature].astype(np.float64)
    norm = np.sqrt(np.bincount(doc, r * r, minlength=len(part)))
    dot = np.bincount(doc, r * w[feature], minlength=len(part))
    return np.divide(dot, norm, out=np.zeros(len(part)), where=norm > 0) + bias


def shared_model(spark, model: tuple[np.ndarray, np.ndarray, float]):
    """The model for all tasks: 2 ** (bits + 3) bytes, whatever the input."""
    return spark.sparkContext.broadcast((model[0].astype(np.float32), model[1].astype(np.float32), model[2]))


def scores(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], bits: int = BITS) -> DataFrame:
    """(doc_id, score), score from 0 to 1 and at least 0.5 where label 1 is likelier; a text without tokens is scored by the bias."""
    shared = shared_model(docs.sparkSession, model)

    def run(batch: pa.RecordBatch):
        for first, part in tokens.chunks(batch.column(1)):
            score = 1 / (1 + np.exp(-np.clip(2 * margins(part, *shared.value, bits), -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(part)), pa.array(score)], names=["doc_id", "score"])

    return arrow_map(docs.select("doc_id", "text"), run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs.

    Nothing but the text feeds a score. Null texts are scored as empty; a null doc_id stays, with held_out null;
    repeated rows are scored alike, each as a row of its own; empty tables give empty results; other columns are ignored.
    """
    return scores(docs, fit(docs, labels, label)).select(
        "doc_id", (remainder() == 1).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )


def op3_quality(spark, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that score at least 0.5, with all their columns; each row is judged by its own text."""
    shared = shared_model(docs.sparkSession, fit(docs, labels))
    at = docs.columns.index("text")

    def run(batch: pa.RecordBatch):
        for first, part in tokens.chunks(batch.column(at)):
            yield batch.slice(first, len(part)).filter(pa.array(margins(part, *shared.value, BITS) >= 0))

    return arrow_map(docs, run, docs.schema)
