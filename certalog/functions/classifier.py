"""In-vitro-diagnostics classifier: class codes first, then keywords; as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from certalog.functions.text import has_keyword, keyword_hits, once

#: Keyword lists of the rules (fixed values).
INSTRUMENT = ("分析仪", "检测仪", "测定仪", "扩增仪", "化学发光", "免疫分析", "生化", "血球", "血凝", "poct")
INSTRUMENT_WITHOUT_CODE = ("检测仪", "分析仪", "测定仪", "化学发光", "免疫分析", "pcr仪", "荧光定量", "核酸扩增仪", "poct")
NOT_INSTRUMENT = ("骨科", "口腔", "牙科", "眼科", "植入", "支架", "假体", "注射器")
SOFTWARE = ("医疗软件", "诊断软件", "检验软件", "软件", "系统", "平台", "lis", "算法")
SOFTWARE_WITHOUT_CODE = ("诊断软件", "检验软件", "实验室信息系统", "lis", "lims", "辅助诊断", "判读软件")
NOT_SOFTWARE = ("财务软件", "办公软件", "游戏", "娱乐")
REAGENT_WITHOUT_CODE = ("试剂", "试剂盒", "检测试剂", "检测试剂盒", "核酸检测试剂", "校准品", "质控品", "抗原", "抗体", "酶联免疫")
NEVER = ("采血管", "采集容器", "超声影像", "培养箱", "计划软件", "离心机", "低温冰箱", "采血针", "保存箱", "安全柜", "保存管", "康复训练", "参比电极")
SUBTYPES = {
    "NGS": ("ngs", "二代测序", "高通量测序", "next generation sequencing"),
    "PCR": ("pcr", "qpcr", "rt-pcr", "核酸扩增", "聚合酶链式反应"),
    "POCT": ("poct", "即时检验", "床旁检测", "point-of-care"),
}


def classify(df: DataFrame, code: Column, name: Column, model: Column, specification: Column, category: Column, out: str = "v") -> DataFrame:
    """df with the column out: (is_ivd, category, subtypes, confidence, rule, hits, needs_review) of a device.

    A word of NEVER in any text field decides; then the class code by its first digits, 07 and 21 with keywords of the name; without a
    code the name's keywords alone. Codes and words are compared in lower case, a null counts as empty.
    """
    text = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    code, name = F.trim(F.coalesce(code, F.lit(""))), text(name)
    hits = lambda words: keyword_hits(name, words)
    some = lambda words: has_keyword(name, words)
    whole = F.concat_ws(" ", *[F.nullif(x, F.lit("")) for x in (name, text(model), text(specification), text(category))])
    none = F.array().cast("array<string>")

    def verdict(kind: str | None, rule: str, words: Column, sure: float) -> Column:
        return F.struct(F.lit(kind).cast("string").alias("category"), F.lit(rule).alias("rule"), words.alias("hits"), F.lit(sure).alias("confidence"))

    found = (
        F.when(has_keyword(whole, NEVER), verdict(None, "global_exclude", keyword_hits(whole, NEVER), 0.99))
        .when(code.startswith("22") | code.startswith("6840"), verdict("reagent", "class_code", none, 0.95))
        .when(code.startswith("07") & some(INSTRUMENT) & ~some(NOT_INSTRUMENT), verdict("instrument", "class_code+keyword", hits(INSTRUMENT), 0.85))
        .when(code.startswith("07"), verdict(None, "class_code+keyword", hits(NOT_INSTRUMENT), 0.8))
        .when(code.startswith("21") & some(SOFTWARE) & ~some(NOT_SOFTWARE), verdict("software", "class_code+keyword", hits(SOFTWARE), 0.85))
        .when(code.startswith("21"), verdict(None, "class_code+keyword", hits(NOT_SOFTWARE), 0.8))
        .when(code != "", verdict(None, "fallback", none, 0.8))
        .when(some(REAGENT_WITHOUT_CODE), verdict("reagent", "keyword_fallback", hits(REAGENT_WITHOUT_CODE), 0.85))
        .when(some(INSTRUMENT_WITHOUT_CODE) & ~some(NOT_INSTRUMENT), verdict("instrument", "keyword_fallback", hits(INSTRUMENT_WITHOUT_CODE), 0.85))
        .when(some(SOFTWARE_WITHOUT_CODE) & ~some(NOT_SOFTWARE), verdict("software", "keyword_fallback", hits(SOFTWARE_WITHOUT_CODE), 0.85))
        .otherwise(verdict(None, "fallback", none, 0.5))
    )
    df = once(df, _found=found, _code=code, _name=name)
    found, code, name = (F.col(c) for c in ("_found", "_code", "_name"))
    ivd = found["category"].isNotNull()
    kinds = F.array_compact(F.array(*[F.when(ivd & some(words), F.lit(kind)) for kind, words in SUBTYPES.items()]))
    told = F.struct(
        ivd.alias("is_ivd"), found["category"].alias("category"), kinds.alias("subtypes"), found["confidence"].alias("confidence"), found["rule"].alias("rule"),
        found["hits"].alias("hits"), (~ivd & (code == "") & (found["rule"] != "global_exclude")).alias("needs_review"),
    )
    return once(df, **{out: told}).drop("_found", "_code", "_name")


#: The older rules of scope: patterns of sure words, and of words that count together (fixed values).
SCOPE_SURE = ("体外诊断", r"\bivd\b", r"in[\s\-]?vitro", "诊断试剂", "检测试剂", "试剂盒", "校准品", "质控品", "核酸(检|测|扩增)", "pcr", "分子诊断")
SCOPE_INSTRUMENT = ("分析仪", "检测仪", "测定仪", "免疫分析", "化学发光", "血球", "血凝", "生化", "poct")
SCOPE_SOFTWARE = ("医疗软件", "诊断软件", "检验软件", "l[ai]s", "算法", "软件", "平台", "系统")
SCOPE_CONTEXT = ("诊断", "检测", "检验", "分析", "测定", "病原", "核酸", "免疫", "生化", "血液")
SCOPE_NEGATIVE = ("骨科", "口腔", "牙科", "眼科", "注射器", "缝合", "假体", "植入", "心脏支架")
#: A word edge next to letters and digits of any script, which Java's \\b is not.
_EDGED = r"(?<![\p{L}\p{N}_])ivd(?![\p{L}\p{N}_])"


def scope_text(*parts: Column) -> Column:
    """What the older rules read: the parts that have text, in lower case, joined by ' | '."""
    return F.lower(F.concat_ws(" | ", *[F.nullif(F.trim(p), F.lit("")) for p in parts]))


def scope_by_words(text: Column) -> Column:
    """(is_ivd, reason, matched) by the older rules: class code, sure words, words of instruments or software among diagnostic ones, else out of scope."""
    t = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    any_of = lambda words: t.rlike("|".join(words))
    sure = F.array_compact(F.array(*[F.when(t.rlike(_EDGED if p == r"\bivd\b" else p), F.lit(f"strong:{p}")) for p in SCOPE_SURE]))
    told = lambda ok, why, *matched: F.struct(F.lit(ok).alias("is_ivd"), F.lit(why).alias("reason"), F.array(*[F.lit(m) for m in matched]).cast("array<string>").alias("matched"))
    context = any_of(SCOPE_CONTEXT)
    return (
        F.when(t.contains("6840"), told(True, "matched_category_code_6840", "category_code:6840"))
        .when(F.size(sure) > 0, F.struct(F.lit(True).alias("is_ivd"), F.lit("matched_strong_ivd_keyword").alias("reason"), sure.alias("matched")))
        .when(context & any_of(SCOPE_INSTRUMENT), told(True, "matched_diag_context_plus_instrument", "diag_context", "instrument"))
        .when(context & any_of(SCOPE_SOFTWARE), told(True, "matched_diag_context_plus_software", "diag_context", "software"))
        .when(any_of(SCOPE_NEGATIVE), told(False, "matched_negative_non_ivd_keyword"))
        .otherwise(told(False, "no_ivd_signal"))
    )
