"""Toxicity severity: cumulative-link (proportional odds) regression over hashed token n-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from certalog.llm import tokens
from certalog.llm.common import arrow_map, table
from certalog.llm.quality import fit_sample, labelled, log_ratios, marks, totals

#: Bits of a feature's hash; labelled rows of each mark that the fit takes at most; share of toxic texts, log-count ratio
#: and log-likelihood ratio statistic that a feature needs.
BITS, FIT_ROWS, SHARE, RATIO, EVIDENCE = 40, 2000, 0.01, 1.5, 30.0
RIDGE, STEPS, RATE = 1e-3, 400, 0.1


def counted(texts: DataFrame, only: np.ndarray | None = None) -> DataFrame:
    """(feature, n): how many of the texts have each feature, or each one of only (sorted)."""

    def run(batch: pa.RecordBatch):
        for _, part in tokens.chunks(batch.column(0)):
            feature = tokens.indicators(part, BITS)[1]
            if only is not None:
                feature = feature[known(only, feature)]
            keys, n = np.unique(feature, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["feature", "n"])

    return arrow_map(texts.select("text"), run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def known(chosen: np.ndarray, feature: np.ndarray) -> np.ndarray:
    """Which of feature are in chosen (sorted)."""
    if not len(chosen):
        return np.zeros(len(feature), dtype=bool)
    return chosen[np.minimum(np.searchsorted(chosen, feature), len(chosen) - 1)] == feature


def select_features(texts: DataFrame, of: np.ndarray) -> np.ndarray:
    """Sorted features with exp(RATIO) times the share of toxic texts, where chance explains that badly.

    Candidates are in SHARE of the toxic texts or more, so there are at most 1 / SHARE times as many as an average toxic
    text has features, whatever the number of texts. All labelled texts are counted.
    """
    lines = counted(texts.where("mark = 1")).where(F.col("n") >= max(3.0, SHARE * of[1])).orderBy("feature").toArrow()
    feature, toxic = lines.column("feature").to_numpy(), lines.column("n").to_numpy()
    clean = np.zeros(len(feature))
    if len(feature):
        found = counted(texts.where("mark = 0"), feature).toArrow()
        clean[np.searchsorted(feature, found.column("feature").to_numpy())] = found.column("n").to_numpy()
    counts = np.stack([clean, toxic])
    share = counts.sum(axis=0) / of.sum()
    g = np.zeros(len(feature))
    for k in (0, 1):
        for seen, chance in ((counts[k], share), (of[k] - counts[k], 1 - share)):
            g += 2 * seen * np.log(np.divide(seen, of[k] * chance, out=np.ones(len(seen)), where=seen > 0))
    return feature[(g >= EVIDENCE) & (log_ratios(counts, of, 1.0) >= RATIO)]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit_ordinal(doc: np.ndarray, column: np.ndarray, grade: np.ndarray, size: int, grades: int) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) of P(grade <= k) = sigmoid(threshold[k] - w x), by gradient steps with adaptive rates.

    x is 1 for each (doc, column). One weight vector serves all thresholds; these stay in order as a first one plus
    positive steps. Each class counts alike, whatever its rows.
    """
    weight = np.bincount(grade, minlength=grades).astype(float)
    each = (1 / np.maximum(weight, 1))[grade]
    each /= each.sum()
    w, first, steps = np.zeros(size), 0.0, np.zeros(grades - 2)
    state = [np.full(size, 1e-8), 1e-8, np.full(grades - 2, 1e-8)]
    n = len(grade)
    for _ in range(STEPS):
        theta = first + np.r_[0.0, np.cumsum(np.exp(steps))]
        z = np.bincount(doc, w[column], minlength=n)
        edge = np.r_[-np.inf, theta, np.inf]
        hi, lo = sigmoid(edge[grade + 1] - z), sigmoid(edge[grade] - z)
        p = np.maximum(hi - lo, 1e-12)
        dhi, dlo = hi * (1 - hi) / p, lo * (1 - lo) / p
        dz = each * (dhi - dlo)
        dtheta = np.zeros(grades + 1)
        np.add.at(dtheta, grade + 1, -each * dhi)
        np.add.at(dtheta, grade, each * dlo)
        dtheta = dtheta[1:-1]
        gw = np.bincount(column, dz[doc], minlength=size) + RIDGE * w
        gf, gs = dtheta.sum(), np.cumsum(dtheta[::-1])[::-1][1:] * np.exp(steps)
        for k, g in enumerate((gw, gf, gs)):
            state[k] = state[k] + g * g
        w = w - RATE * gw / np.sqrt(state[0])
        first = first - RATE * gf / np.sqrt(state[1])
        steps = np.clip(steps - RATE * gs / np.sqrt(state[2]), -5, 5)
    return w, first + np.r_[0.0, np.cumsum(np.exp(steps))]


def expected(z: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """Expected grade: the sum over thresholds of P(grade > k)."""
    return sum(1 - sigmoid(t - z) for t in theta)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, their weights, thresholds).

    Labels say toxic or not, so the severities to learn from are three: 0 not toxic; 1 toxic; 2 toxic with more distinct
    toxic features than the median toxic text. Feature counts cover every labelled row outside the held-out third, the
    regression at most FIT_ROWS rows of each mark. Without rows of both marks there are no features.
    """
    marked = marks(labels, label)
    of = totals(docs, marked)
    chosen = select_features(labelled(docs, marked), of) if of.all() else np.zeros(0, dtype=np.int64)
    if not len(chosen):
        return chosen, np.zeros(0), np.array([1.0, 2.0])
    xs, mark = fit_sample(docs, marked, FIT_ROWS, BITS)
    xs = [np.searchsorted(chosen, x[known(chosen, x)]) for x in xs]
    size = np.array([len(x) for x in xs])
    grade = np.where(mark == 1, 1 + (size > np.median(size[mark == 1])), 0)
    w, theta = fit_ordinal(np.repeat(np.arange(len(xs)), size), np.concatenate(xs), grade, len(chosen), 3)
    return chosen, w, theta


def severity(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> DataFrame:
    """(doc_id, expected_severity 0 to 2, grade, toxic) for every row of docs.

    grade is the likeliest one's place among the thresholds; toxic: grade 1 or more. Null and blank texts are scored as
    texts without features; repeated rows are scored alike; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # as many features as select_features can give

    def run(batch: pa.RecordBatch):
        chosen, w, theta = shared.value
        for first, part in tokens.chunks(batch.column(1)):
            doc, feature = tokens.indicators(part, BITS)
            own = known(chosen, feature)
            z = np.bincount(doc[own], w[np.searchsorted(chosen, feature[own])], minlength=len(part))
            grade = np.searchsorted(theta, z, "left").astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(first, len(part)), pa.array(expected(z, theta)), pa.array(grade), pa.array(grade > 0)],
                names=["doc_id", "expected_severity", "grade", "toxic"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    return arrow_map(docs.select("doc_id", "text"), run, f"doc_id {kind}, expected_severity double, grade int, toxic boolean")


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return severity(docs, fit(docs, table(spark, sf_dir, "labels")))
