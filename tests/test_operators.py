import random

from pyspark.sql import functions as F

from certalog.functions import text
from certalog.operators import policy, tables

RANK = {"A": 3, "B": 2, "C": 1, "D": 0}


def fold(observations):
    value = meta = None
    counts = [0, 0, 0]
    for at, _, new, grade, priority in sorted(observations):
        if not new or new == value:
            continue
        mine = (RANK[grade], -priority, at)
        if meta is None or mine > meta:
            value, meta = new, mine
            counts[0] += 1
        elif mine == meta:
            counts[2] += 1
        else:
            counts[1] += 1
    return (value, *counts)


def test_policy_is_the_ordered_fold(spark):
    rng = random.Random(1)
    rows = [(k, rng.randrange(4), s, rng.choice(["x", "y", "z", "", None]), rng.choice("ABCD"), rng.randrange(3)) for k in range(150) for s in range(8)]
    df = spark.createDataFrame([(k, at, s, v, g, p) for k, at, s, v, g, p in rows], "id int, observed_at long, seq int, value string, grade string, priority int")
    got = {r.id: (r.value, r.applied, r.kept, r.conflicts) for r in policy.resolve(df, ["id"]).collect()}
    for k in range(150):
        assert got[k] == fold([(at, s, v, g, p) for i, at, s, v, g, p in rows if i == k])


def test_merges_are_idempotent(spark):
    t = spark.createDataFrame([(1, "a", None), (2, None, "b"), (None, "n", "n")], "id int, x string, y string")
    s = spark.createDataFrame([(2, "c", None), (3, "d", "e")], "id int, x string, y string")
    key = lambda df: sorted(map(tuple, df.collect()), key=repr)
    for how in ("overwrite", "coalesce", "absent", "fill"):
        once = tables.merge(t, s, ["id"], how)
        assert key(tables.merge(once, s, ["id"], how)) == key(once)
    assert (2, "c", "b") in key(tables.merge(t, s, ["id"], "coalesce"))
    assert (2, "c", None) in key(tables.merge(t, s, ["id"], "overwrite"))


def test_registration_keys(spark):
    cases = [("国械注准 2023", "国械注准2023"), ("国械注准\t2023\n1234", "国械注准20231234"), ("abcs123", "ABC"), ("A\\B", "A"), ("ａｂ１", "AB1"), ("x1, y2", "X1"), ("", None), (None, None), ("  ", None)]
    df = spark.createDataFrame(cases, "a string, b string")
    for r in df.select("a", "b", text.registration_key(F.col("a")).alias("k")).collect():
        assert r.k == r.b, r


def test_scalars(spark):
    one = spark.createDataFrame([("12,345.6 yuan", "2024/03/05 10:00", "the PCR test kit", "two words")], "p string, d string, t string, s string")
    r = one.select(
        text.price(F.col("p")).alias("p"), text.any_date(F.col("d")).cast("string").alias("d"), text.keyword_hits(F.col("t"), ["pcr", "est", "试剂"]).alias("h"),
        tables.set_similarity(tables.trigrams(F.lit("word")), tables.trigrams(F.col("s"))).alias("s"), text.company_key(F.lit("Acme Co Ltd"), ["CO", "LTD"]).alias("c"),
    ).first()
    assert (r.p, r.d, r.h, round(r.s, 4), r.c) == (12345.6, "2024-03-05", ["pcr"], 0.3636, "ACME")


def test_keys_read_their_text_once(spark):
    df = spark.createDataFrame([("国械注准２０２３３４０００１Á㎎",), ("éx1",), (None,)], "n string")
    keys = df.select(text.registration_key(F.upper("n")).alias("k"), text.half_width(F.upper("n")).alias("h"))
    assert keys._jdf.queryExecution().optimizedPlan().toString().count("upper(n") == 2
    assert [r.k for r in keys.collect()] == ["国械注准2023340001MG", "X1", None]


def test_first_values_are_kept_by_tasks(spark):
    """Every cell became a row and every different value a group."""
    from certalog.plans import upkeep

    df = spark.range(5000).repartition(7).selectExpr("concat('v', lpad(5000 - id, 4, '0')) a", "if(id % 3 = 0, null, array('é', 'z', 'Ａ')[id % 3]) b", "cast(null as string) c", "if(id = 77, 'one', null) d")
    got = {r.field: (r.total, r.filled, r.least) for r in tables.first_values(df, df.columns, 3).collect()}
    assert got == {"a": (5000, 5000, ["v0001", "v0002", "v0003"]), "b": (5000, 3333, ["z", "Ａ"]), "c": (5000, 0, []), "d": (5000, 1, ["one"])}
    assert tables.first_values(df.where("false"), df.columns, 3).collect() == []
    plan = upkeep.param_candidates(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Window" not in plan
