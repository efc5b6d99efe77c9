import zlib

import numpy as np

from certalog.llm import quality, tokens


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = quality.classify(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.98
    assert all((zlib.crc32(str(d).encode()) % 3 == 1) for d in got.doc_id)
    assert got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()


def test_odd_rows(spark):
    rows = [(k, "good plain words here" if k % 2 else "BAD!! bad!! ***", 1.5) for k in range(60)]
    rows += [(100, None, 0.0), (101, "", 0.0), (None, "words", 0.0), (3, "good plain words here", 0.0), (102, "word " * 300_000, 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)] + [(None, 1), (7, None), (7, 1)], "doc_id long, quality int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == len(rows)
    assert {r.predicted for r in got if r.doc_id in (1, 3, 5)} == {1}
    assert {r.predicted for r in got if r.doc_id in (0, 2, 4)} == {0}
    assert [r.held_out for r in got if r.doc_id is None] == [None]
    kept = {r.doc_id for r in quality.keep_good(docs, labels).collect()}
    assert {1, 3, 5} <= kept and not {0, 2, 4} & kept


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.classify(docs, labels).collect() == []
    one = spark.createDataFrame([(1, "text")], "doc_id long, text string")
    assert [r.score for r in quality.classify(one, labels).collect()] == [0.5]


def test_labels_of_the_held_out_third_change_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    turned = labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 3 = 1, 1 - quality, quality) as quality")
    score = lambda x: {r.doc_id: r.score for r in quality.classify(docs, x).collect()}
    assert score(labels) == score(turned)


def test_features_are_those_of_each_text_alone():
    texts = [b"One two  two!", b"", b"one TWO two !", "été x".encode()]
    both = tokens.indicators(texts, 20)
    for k, t in enumerate(texts):
        alone = tokens.indicators([t], 20)[1]
        assert np.array_equal(both[1][both[0] == k], alone)
    assert np.array_equal(both[1][both[0] == 0], both[1][both[0] == 2])


def test_dual_coordinate_descent_separates():
    xs = [np.array([k % 2]) for k in range(20)]
    y = np.array([1.0 if k % 2 else -1.0 for k in range(20)])
    w, bias = quality.dual_coordinate_descent(xs, [np.ones(1)] * 20, y, 2, 1.0, 50)
    assert all(t * (w[x[0]] + bias) > 0.9 for x, t in zip(xs, y))
