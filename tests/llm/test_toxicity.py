import numpy as np

from certalog.llm import toxicity


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.fit(docs, labels)
    got = toxicity.severity(docs, model).join(labels.withColumnRenamed("toxic", "label"), "doc_id")
    got = got.where("crc32(cast(cast(doc_id as string) as binary)) % 3 = 1").toPandas()
    hit = got.toxic & (got.label == 1)
    assert hit.sum() / (got.label == 1).sum() > 0.8  # about an eighth of the toxic rows here hold no toxic word at all
    assert hit.sum() / got.toxic.sum() > 0.93
    assert got.expected_severity.between(0, 2).all()
    assert got[got.grade == 2].expected_severity.min() > got[got.grade == 0].expected_severity.max()


def test_ordinal_fit_orders_grades():
    rng = np.random.default_rng(1)
    grade = rng.integers(0, 4, 400)
    doc = np.concatenate([np.repeat(i, g) for i, g in enumerate(grade)])
    column = np.concatenate([np.arange(g) for g in grade])
    w, theta = toxicity.fit_ordinal(doc, column, grade, 3, 4)
    assert (np.diff(theta) > 0).all() and (w > 0).all()
    z = np.array([w[:g].sum() for g in range(4)])
    assert np.searchsorted(theta, z).tolist() == [0, 1, 2, 3]
    assert (np.diff(toxicity.expected(z, theta)) > 0).all()


def test_odd_rows_and_empty_tables(spark):
    rows = [(k, "you idiot " + "nice day " * k if k % 2 else "nice day " * k, 1) for k in range(60)]
    rows += [(100, None, 0), (101, "", 0), (None, "idiot", 0), (1, "you idiot nice day", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, grade int")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, toxic int")
    got = toxicity.severity(docs, toxicity.fit(docs, labels)).collect()
    assert len(got) == len(rows)
    assert all(r.toxic == bool(r.doc_id % 2) for r in got if r.doc_id is not None and r.doc_id < 100)
    assert not [r for r in got if r.doc_id in (100, 101)][0].toxic
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.toxic for r in toxicity.severity(docs, toxicity.fit(docs, none)).collect()} == {False}
    assert toxicity.severity(docs.limit(0), toxicity.fit(docs.limit(0), labels)).collect() == []
