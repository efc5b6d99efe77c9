"""Rules of the register against known cases."""

import datetime
import unicodedata

import pytest
from pyspark.sql import functions as F

from certalog.functions import classifier, fields, text
from certalog.operators import tables
from certalog.plans import ingest, scores

DIR = "/root/testdata/sf0.01"
NUMBERS = [
    (" 国械注准 2023 1234 ", "国械注准20231234"), ("粤械备（2014）0023", "粤械备20140023"), ("粤械备(2014)0023", "粤械备20140023"), ("国械注准２０２３１２３４", "国械注准20231234"),
    ("ＡＢＣ１２３", "ABC123"), ("国械注准2023-12/34", "国械注准20231234"), ("国械注准\t2023\n1234", "国械注准20231234"), ("abc-Def", "ABCDEF"),
    ("国械注准〔2023〕1234", "国械注准20231234"), ("粤械备【2014】0023", "粤械备20140023"), ("苏械注准20162220838苏械注准20152021027苏械注准20172661896", "苏械注准20162220838"),
    (None, None), ("", None), ("   ", None), ("abcs123", "ABC"), ("A\\B", "A"), (",A", None), ("A" * 121, None), ("苏械注准20162220838" + "A" * 120, None), ("x" * 130 + "苏械注准20162220838", "苏械注准20162220838"),
]


def test_registration_numbers(spark):
    df = spark.createDataFrame(list(enumerate(n for n, _ in NUMBERS)), "i int, n string")
    got = {r.i: r.k for r in df.select("i", text.registration_key(F.col("n")).alias("k")).collect()}
    assert [got[i] for i in range(len(NUMBERS))] == [k for _, k in NUMBERS]


DEVICES = [
    ("2201", "体外诊断试剂", "reagent"), ("22", "任意名称", "reagent"), ("22XYZ", "核酸检测试剂", "reagent"), ("6840", "体外诊断试剂", "reagent"), ("0701", "全自动生化分析仪", "instrument"),
    ("0704", "POCT检测仪", "instrument"), ("0707", "骨科分析仪", None), ("0710", "植入式检测仪", None), ("0712", "普通手术器械", None), ("22", "一次性采血管", None), ("07", "医用离心机", None),
    ("21", "超声影像计划软件", None), ("2101", "医学检验软件", "software"), ("21", "LIS系统", "software"), ("2106", "普通办公软件", None), ("2107", "娱乐游戏软件", None), ("0901", "生化分析仪", None),
    ("1101", "医学检验软件", None), ("", "乙肝检测试剂盒", "reagent"), ("", "实验室信息系统(LIS)", "software"), ("", "Anti-C1q ELISA (IgG)", None), (None, None, None),
]
SUBTYPES = [("二代测序分析系统", "NGS"), ("高通量测序与核酸扩增分析平台", "NGS,PCR"), ("RT-PCR核酸扩增检测试剂", "PCR"), ("POCT即时检验设备", "POCT"), ("Point-of-care qPCR检测系统", "PCR,POCT"), ("常规体外诊断试剂", "")]


def test_classifier(spark):
    rows = [(c, n, k, None) for c, n, k in DEVICES] + [("22", n, "reagent", s) for n, s in SUBTYPES] + [("09", "RT-PCR设备", None, "")]
    df = spark.createDataFrame([(i, c, n) for i, (c, n, *_) in enumerate(rows)], "i int, c string, n string")
    none = F.lit(None).cast("string")
    got = {r.i: r.v for r in classifier.classify(df, F.col("c"), F.col("n"), none, none, none).collect()}
    for i, (_, _, kind, subtypes) in enumerate(rows):
        assert got[i].category == kind and got[i].is_ivd == (kind is not None), rows[i]
        assert subtypes is None or sorted(got[i].subtypes) == sorted(filter(None, subtypes.split(",")))
    assert (got[9].rule, got[9].hits, got[9].confidence) == ("global_exclude", ["采血管"], 0.99)
    assert got[20].needs_review and not got[16].needs_review


@pytest.mark.parametrize(
    "line, value",
    [
        ("range 1-5 ng/ml here", (None, None, "ng/mL", 1.0, 5.0)), ("about 95% of all", (95.0, None, "%", None, None)), ("incubate 30 分钟 or 15 minutes", (15.0, None, "min", None, None)),
        ("2~8℃", (None, None, "C", 2.0, 8.0)), ("37 °C", (37.0, None, "C", None, None)), ("no value", (None, "no value", None, None, None)),
    ],
)
def test_extracted_values(spark, line, value):
    assert tuple(spark.createDataFrame([(line,)], "x string").select(fields.extracted_value(F.col("x")).alias("v")).first().v) == value


def test_storages(spark):
    df = spark.createDataFrame([([("冷藏", "2", "8", "℃", None), (None, None, "30", "℃", None), (None, None, None, None, " "), ("常温", None, None, None, None)],)], "s array<struct<type:string,min:string,max:string,unit:string,range:string>>")
    got = df.select(fields.storages(F.col("s")).alias("n"), fields.storage_summary(F.col("s")).alias("t")).first()
    assert [x.range for x in got.n] == ["2-8℃", "30℃", None] and got.t == "2~8℃; <=30℃; 常温"


def test_ladders(spark):
    rows = [(None, False, 0), (90, False, 0), (90, True, 0), (180, True, 0), (181, False, 300), (100, False, 300), (10, True, 300), (400, False, 299)]
    level, score = fields.registration_ladder(F.col("d"), F.col("r"), F.col("n"))
    got = spark.createDataFrame(rows, "d int, r boolean, n int").select(level.alias("l"), score.alias("s")).collect()
    assert [r.l for r in got] == ["medium", "high", "medium", "low", "medium", "high", "high", "low"]
    assert [r.s for r in got] == [55, 85, 55, 25, 55, 85, 85, 25]


def test_every_branch_has_rows(spark):
    sources = {r.source for r in scores.start_dates(spark, DIR).select("source").distinct().collect()}
    assert sources == {*scores.SOURCES, "missing"}
    signal = scores.registration_signal(spark, DIR)
    assert {r.level for r in signal.select("level").distinct().collect()} == {"low", "medium", "high"}
    assert signal.where("renewed").count() and signal.where("not renewed").count()
    assert {r.outcome for r in ingest.outcomes(spark, DIR).select("outcome").distinct().collect()} == {"failed", "invalid_name", "filtered", "pending", "accepted"}


@pytest.mark.parametrize("policy, want", [("overwrite", [(None, 9), (1, 1), (2, None)]), ("absent", [(None, 5), (1, 1), (2, None)]), ("coalesce", [(None, 9), (1, 1), (2, None)]), ("fill", [(None, 5), (1, 1), (2, None)])])
def test_merges_compare_null_keys(spark, policy, want):
    target = spark.createDataFrame([(None, 5), (1, 1)], "k int, v int")
    source = spark.createDataFrame([(None, 9), (2, None)], "k int, v int")
    once = tables.merge(target, source, ["k"], policy)
    assert sorted([tuple(r) for r in once.collect()], key=lambda r: r[0] or 0) == want
    assert sorted([tuple(r) for r in tables.merge(once, source, ["k"], policy).collect()], key=lambda r: r[0] or 0) == want


@pytest.mark.parametrize(
    "text, key",
    [
        ("国械注准20231234Ⅱ", "国械注准20231234II"),
        ("国械注准２０２３１２３４", "国械注准20231234"),
        ("ⅳ①②⑩", "IV1210"),
        ("5㎎㏄", "5MGCC"),
        ("㈱⒜A", "株AA"),
        ("ＡｂＣ－１", "ABC1"),
        ("½", "12"),
        ("ﬁx", "FIX"),
        ("ÉX", "X"),
        ("É1", "1"),
        ("豈豈", "豈豈"),
        ("a　b", "AB"),
        ("x²", "X2"),
        ("ſ", "S"),
        ("𝐀𝟗", "A9"),
    ],
)
def test_compatibility_forms(spark, text, key):
    from certalog.functions.fields import norm_key

    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(norm_key(F.col("t"))).first()[0] == key
    plain = "".join(c for c in "".join(unicodedata.normalize("NFKC", text).split()).upper() if c in "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ" or "一" <= c <= "鿿")
    assert plain == key


def test_every_compatibility_form(spark):
    from certalog.functions.fields import norm_key

    rows = [(k, chr(k)) for k in range(0x20, 0x30000) if not 0xD800 <= k < 0xE000 and unicodedata.normalize("NFKC", chr(k)) != chr(k)]
    want = {k: "".join(x for x in "".join(unicodedata.normalize("NFKC", c).split()).upper() if x in "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ" or "一" <= x <= "鿿") or None for k, c in rows}
    got = {r.k: r.key for r in spark.createDataFrame(rows, "k int, c string").select("k", norm_key(F.col("c")).alias("key")).collect()}
    assert {k: (got[k], want[k]) for k in want if got[k] != want[k]} == {}


def test_company_names(spark):
    from certalog.functions.text import company_key

    rows = [("（北京）Ａ医疗器械有限公司。", "北京A医疗器械"), ("Acme Co., Ltd. (Group) ", "ACME"), ("有限公司", "有限"), ("旧名", "新名"), (" · ", None), (None, None), ("X公司有限公司", "X")]
    df = spark.createDataFrame([r[:1] for r in rows], "n string")
    key = company_key(F.col("n"), ["有限公司", "公司", "Co.,Ltd", "(Group", "Group"], {"旧名": "新名"})
    assert [r[0] for r in df.select(key).collect()] == [k for _, k in rows]


def test_shares(spark):
    from certalog.plans.scores import distribution

    rows = [("a", "x", 1), ("a", "y", 7), ("b", "x", 0), ("c", "x", 1), ("c", "y", 799), ("d", "z", 1), ("d", "y", 2)]
    got = {r.k: r.dist for r in distribution(spark.createDataFrame(rows, "k string, l string, n long"), ["k"], "l", "n").collect()}
    assert got == {"a": "y:87.5%, x:12.5%", "b": "missing:100%", "c": "y:99.9%, x:0.1%", "d": "y:66.7%, z:33.3%"}


def test_archive_is_checked(spark, tmp_path):
    from certalog.operators import tables

    df = spark.createDataFrame([(k, k % 3 == 0 if k % 5 else None) for k in range(60)], "k int, gone boolean")
    tables.archive_into(df, F.col("gone"), str(tmp_path / "kept"), str(tmp_path / "gone"))
    assert spark.read.parquet(str(tmp_path / "gone")).count() == 16 and spark.read.parquet(str(tmp_path / "kept")).count() == 44
    kept, gone = tables.archive(df, F.col("gone"))
    sound = lambda k, g: tables.checked_archive(k, g, df).first().sound
    assert sound(kept, gone) and not sound(kept, gone.limit(3)) and not sound(kept.union(kept.limit(1)), gone) and not sound(kept, gone.withColumn("k", F.col("k") + 1))
    def other(frame, condition, real=tables.archive):
        return real(frame.where("k <> 7"), condition)  # a row is lost on the way

    tables.archive, real = other, tables.archive
    try:
        with pytest.raises(ValueError):
            tables.archive_into(df, F.col("gone"), str(tmp_path / "k2"), str(tmp_path / "g2"))
    finally:
        tables.archive = real
    assert not (tmp_path / "k2").exists() and not (tmp_path / "g2").exists()


def test_conflict_report(spark):
    day = datetime.date(2026, 1, 8)
    rows = [("status", day, [("A",), ("",)]), ("status", day, [("B",), ("A",)]), ("name", day - datetime.timedelta(7), None), ("name", day - datetime.timedelta(8), [("Z",)]), ("expiry", day, [(None,)])]
    q = spark.createDataFrame(rows, "field_name string, created_at date, candidates array<struct<source_key:string>>")
    got = {(r.part, r.name): r.conflict_count for r in ingest.report_conflicts(q, F.lit(day), "7d", 2).collect()}
    assert got == {("field", "status"): 2, ("field", "expiry"): 1, ("source", "A"): 2, ("source", "UNKNOWN"): 2, ("day", "2026-01-08"): 3, ("day", "2026-01-01"): 1}
    with pytest.raises(ValueError):
        ingest.report_conflicts(q, F.lit(day), "2d")


def test_rules_of_single_fields(spark):
    df = spark.createDataFrame([("cancelled", True), ("expired", True), ("active", True), ("active", False)], "s string, c boolean")
    assert [r[0] for r in df.select(fields.change_type(F.col("s"), F.col("c"))).collect()] == ["cancel", "expire", "update", "noop"]
    df = spark.createDataFrame([([("a", 1.5), ("b", 2.0), ("a", 9.0)], ["x", "y" * 9], None, " 22 ")], "f array<struct<name:string,value:double>>, parts array<string>, n string, code string")
    candidates = fields.candidates((F.lit("A"), F.col("n"), F.lit("d")), (F.lit("B"), F.col("code"), F.lit("e")), (F.lit("C"), F.lit("  "), F.lit("f")))
    r = df.select(fields.factor(F.col("f"), "a"), fields.factor(F.col("f"), "z"), fields.text_blob(F.col("parts"), 5), fields.class_hint(F.col("n"), F.col("code")), candidates).first()
    assert tuple(r)[:4] == (1.5, None, "x yyy", "22") and [tuple(x) for x in r[4]] == [("B", "22", "e")]


@pytest.mark.parametrize(
    "words, is_ivd, reason",
    [
        ("6840 类", True, "matched_category_code_6840"), ("IVD reagent", True, "matched_strong_ivd_keyword"), ("国产ivd产品", False, "no_ivd_signal"), ("In-Vitro test", True, "matched_strong_ivd_keyword"),
        ("免疫 分析仪", True, "matched_diag_context_plus_instrument"), ("检测 平台", True, "matched_diag_context_plus_software"), ("血球", False, "no_ivd_signal"), ("一次性注射器", False, "matched_negative_non_ivd_keyword"),
        ("", False, "no_ivd_signal"), (None, False, "no_ivd_signal"), ("qPCR 骨科", True, "matched_strong_ivd_keyword"),
    ],
)
def test_older_rules_of_scope(spark, words, is_ivd, reason):
    v = spark.createDataFrame([(words,)], "t string").select(classifier.scope_by_words(F.col("t")).alias("v")).first().v
    assert (v.is_ivd, v.reason) == (is_ivd, reason)


def test_plain_numbers_words_and_ends_of_texts_are_read_alike(spark):
    """Short cuts of keys, keywords and blanks give what their patterns say."""
    from certalog.functions import classifier, fields, text

    odd = ["REG0000000001", "REG1\n", "", "A" * 120, "A" * 121, "REG s1", "REGs1", "国械注准20200001", "0", "reg-1", None, " REG1", "ＲＥＧ１"]
    df = spark.createDataFrame([(x,) for x in odd], "x string")
    got = {r.x: r.k for r in df.select("x", text.registration_key(F.col("x")).alias("k")).collect()}
    assert got == {
        "REG0000000001": "REG0000000001", "REG1\n": "REG1", "": None, "A" * 120: "A" * 120, "A" * 121: None, "REG s1": "REG", "REGs1": "REG", "国械注准20200001": "国械注准20200001", "0": "0",
        "reg-1": "REG1", None: None, " REG1": "REG1", "ＲＥＧ１": "REG1",
    }
    words = classifier.NEVER + classifier.INSTRUMENT_WITHOUT_CODE + classifier.SUBTYPES["PCR"] + classifier.SUBTYPES["POCT"] + classifier.SUBTYPES["NGS"]
    names = spark.createDataFrame([(x,) for x in ["采血管", "poct", "poct2", "a-poct b", "next generation sequencing", "rt-pcr", "xrt-pcr", "pcr仪", "", None, "point-of-care"]], "x string")
    assert names.where(~text.has_keyword(F.col("x"), words).eqNullSafe(F.col("x").rlike(text.keyword_pattern(words)))).count() == 0
    ends = spark.createDataFrame([(x,) for x in [" a b ", "\t\n\x0b\f\ra\r\n", " \n", "", None, "　a"]], "x string")
    assert [r[0] for r in ends.select(fields.blank(F.col("x"))).collect()] == ["a b", "a", None, None, None, "　a"]


def test_reading_records_stays_within_what_the_jvm_compiles(spark):
    """A generated method of more than 8,000 bytes is never compiled by the JVM: the mapping of records had one of 10,184."""
    import re

    from certalog.plans import ingest

    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # whole stages are known before the run
    try:
        code = debug.codegenString(ingest.outcomes(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(-?\d+)", code)]
    assert sizes and max(sizes) < 8_000
