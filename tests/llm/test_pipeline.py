"""The stages one by one against plain versions, on a small table; each stage is judged on its own input."""

import importlib.util
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from certalog.llm import decontaminate, quality
from test_simhash import brute_keep

DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{DIR}/documents.parquet"), []
    for name, stage in pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, DIR).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((name, docs, after))
        docs = after
    return {name: (a, b) for name, a, b in out}


def test_order_and_columns(stages):
    assert list(stages) == ["quality", "lines", "near_duplicates", "decontamination", "packing"]
    for _, after in list(stages.values())[:-1]:
        assert after.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_quality(spark, stages):
    before, after = stages["quality"]
    score = {r.doc_id: r.score for r in quality.classify(before, spark.read.parquet(f"{DIR}/labels.parquet")).collect()}
    assert {r.doc_id for r in after.collect()} == {d for d, s in score.items() if s >= 0.5}


def test_lines(stages):
    before, after = stages["lines"]
    b, a = ({r.doc_id: r for r in x.collect()} for x in (before, after))
    assert b.keys() == a.keys()
    seen = [line for r in a.values() for line in r.text.split("\n") if line.strip()]
    assert len(seen) == len(set(seen))
    assert set(seen) <= {line for r in b.values() for line in r.text.split("\n")}
    assert all(r.n_chars == len(r.text) for r in a.values())


def test_near_duplicates(stages):
    before, after = stages["near_duplicates"]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    assert sorted(r.doc_id for r in after.collect()) == sorted(d for d, _ in brute_keep(rows))


@pytest.mark.parametrize("name, stage", pipeline.STAGES)
def test_odd_rows(spark, name, stage):
    long = " ".join(f"word{k}" for k in range(20_000))
    rows = [(None, None), (1, ""), (2, " \n"), (3, long), (4, "A line of text.\nA line of text.\nAnother."), (4, "A line of text.\nA line of text.\nAnother."), (None, "Of no id.")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, k1 long, c string, n_tokens long"
    docs = spark.createDataFrame([(d, t, "en", None, len(t or ""), 1, "x", 5) for d, t in rows], schema)
    got = stage(spark, docs, DIR)
    if name != "packing":
        assert got.columns == list(pipeline.COLUMNS)
    texts = [r.text for r in got.collect()] if name != "packing" else None
    if name in ("lines", "decontamination"):
        assert len(texts) == len(rows) and texts.count(None) == 1
    if name == "near_duplicates":
        assert len(texts) == 4
    if name == "packing":
        assert got.where("doc_id = 3").agg(F.sum("n_tokens")).first()[0] == 20_000
    assert stage(spark, docs.limit(0), DIR).collect() == []


def test_decontamination(spark, stages):
    before, after = stages["decontamination"]
    items = [" ".join(w.decode() for w in decontaminate.plain_words(r.text)) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    kept = {r.doc_id for r in after.collect()}
    gone = 0
    for r in before.collect():
        text = " ".join(w.decode() for w in decontaminate.plain_words(r.text))
        if any(re.search(rf"(?:^| ){re.escape(i)}(?: |$)", text) for i in items):
            assert r.doc_id not in kept
            gone += 1
    assert len(kept) == before.count() - gone  # these tables hold items unchanged


def test_packing(stages):
    before, after = stages["packing"]
    want = {r.doc_id: len(r.text.split()) for r in before.collect()}
    got = {r.doc_id: r.n for r in after.groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()}
    assert got == want
    assert not after.groupBy("bin_id", "capacity").agg(F.sum("n_tokens").alias("n")).where("n > capacity").count()


def test_nothing_else_imports_the_subpackage():
    assert importlib.util.find_spec("certalog.llm")
    import os

    top = os.path.dirname(pipeline.__file__)
    for folder, _, names in os.walk(os.path.join(top, "certalog")):
        if os.sep + "llm" not in folder:
            for n in names:
                if n.endswith(".py"):
                    assert "certalog.llm" not in open(os.path.join(folder, n)).read()
