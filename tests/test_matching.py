import random

import pytest

from certalog.operators import matching
from certalog.plans import matching as plans


def grams(s):
    words, w = [], ""
    for ch in s.lower() + " ":
        if ch.isalnum():
            w += ch
        elif w:
            words.append(f"  {w} ")
            w = ""
    return {x[i : i + 3] for x in words for i in range(len(x) - 2)}


def similarity(a, b):
    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y) if x | y else 0.0


@pytest.mark.parametrize("least", [0.05, 0.1, 0.2, 0.5, 0.8])
def test_similar_texts_lose_no_pair(spark, least):
    rng = random.Random(least)
    words = ["kit", "test kit", "检测试剂盒", "elisa", "pcr", "analyser", "analyzer", "of", "the", "blood", "抗原"]
    make = lambda: rng.choice((" ", "-", "")).join(rng.choice(words) + rng.choice(("", "", str(rng.randrange(30)))) for _ in range(rng.randrange(1, 6)))
    a, b = [make() for _ in range(60)] + ["", " - ", None, "kit"], [make() for _ in range(80)] + [None, "kit", "KIT", ""]
    frame = lambda rows: spark.createDataFrame([(x,) for x in rows], "text string")
    got = {(r.a, r.b): r.score for r in matching.similar_texts(frame(a), frame(b), least).collect()}
    want = {(x, y): similarity(x, y) for x in a if x for y in b if y if similarity(x, y) > least}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_similar_texts_make_each_pair_once(spark):
    df = spark.createDataFrame([("alpha beta gamma",)] * 5 + [("alpha beta delta",)], "text string")
    assert matching.similar_texts(df, df, 0.1).count() == 4
    assert matching.similar_texts(df.where("false"), df, 0.1).collect() == []
    with pytest.raises(ValueError):
        matching.similar_texts(df, df, 0)


def test_contained_terms(spark):
    rng = random.Random(3)
    letters = "ABC国"
    make = lambda n: "".join(rng.choice(letters) for _ in range(n))
    texts = [(k, make(rng.randrange(0, 25))) for k in range(150)] + [(500, None), (501, "")]
    terms = [make(rng.randrange(1, 7)) for _ in range(60)] + [None, "", "ZZZ"]
    got = matching.contained_terms(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(t,) for t in terms], "term string")).collect()
    assert sorted(map(tuple, got)) == sorted({(k, t) for k, x in texts if x for t in terms if t and t in x})


def test_confidence_of_methodologies(spark):
    nodes = spark.createDataFrame([(1, "PCR", ["核酸扩增", "q-PCR"]), (2, "ELISA", None), (3, "spanning", ["RAWNAME"]), (4, "  ", [])], "node int, name string, synonyms array<string>")
    rows = [
        (1, "raw: 核酸扩增", "a PCR kit", "none"),  # the name comes first and stands in the names
        (2, "{'x': 'ELISA'}", "elisa", "method ELISA"),
        (3, "its raw", "name", None),  # only where the parts meet
        (4, None, None, None),
        (5, "核酸扩增", "x", "y"),
    ]
    got = plans.map_texts(spark.createDataFrame(rows, "id int, raw string, names string, params string"), nodes).collect()
    assert {(r.id, r.node): r.confidence for r in got} == {(1, 1): 0.65, (2, 2): 0.9, (3, 3): 0.6, (5, 1): 0.75}


def test_methodologies_of_products(spark):
    master = spark.createDataFrame([("pcr", ["扩增法"]), ("CLIA", None), ("ELISA", ["酶联免疫"]), ("IMMUNO", None), ("BIOCHEM", None), ("OWN", ["own way"])], "code string, aliases array<string>")
    rows = [
        (1, ["PCR", "扩增法"], None),  # one code, the first token
        (2, None, "全自动化学发光仪"),  # a hint only
        (3, ["QPCR"], "免疫试剂"),  # a token of a code that is not known: no hint is looked for
        (4, ["own way"], "发光"),
        (5, None, "免疫试剂"),
        (6, None, "（其他）"),
        (7, ["unknown"], "生化（仪）"),
    ]
    got = plans.map_products(spark.createDataFrame(rows, "id int, subtypes array<string>, category string"), master).collect()
    assert {(r.id, r.code): (r.confidence, r.evidence) for r in got} == {
        (1, "PCR"): (0.9, "token:pcr"),
        (2, "CLIA"): (0.55, "category:全自动化学发光仪"),
        (4, "OWN"): (0.8, "token:own way"),
        (4, "CLIA"): (0.8, "token:发光"),
        (5, "IMMUNO"): (0.55, "category:免疫试剂"),
        (7, "BIOCHEM"): (0.55, "category:生化(仪)"),
    }


def lots(rows, products, raws, mapped):
    """By every pair, as the rule says."""
    out = []
    for lot, item, company in rows:
        item = (item or "").strip()
        cands = []
        for reg in {r for r, _, _ in products}:
            names = [similarity(item, n) for r, n, _ in products if r == reg]
            raw = similarity(item, raws[reg]) if raws.get(reg) else 0.0
            if item and (max(names) > 0.1 or raw > 0.05):
                cands.append((-max(*names, raw), reg, max(names), raw))
        scored = []
        for place, (_, reg, name, raw) in enumerate(sorted(cands)[:30]):
            bonus = (0.15 if any(r == reg and n.upper() in item.upper() for r, n in mapped) else 0.0) + (0.12 if (reg, company) in {(r, c) for r, _, c in products} and company is not None else 0.0)
            score = min(0.99, max(name, 0.8 * raw) + bonus)
            if score >= 0.2:
                scored.append((-round(score, 2), place, reg))
        out += [(lot, k + 1, reg, -c) for k, (c, _, reg) in enumerate(sorted(scored)[:3])]
    return sorted(out)


def test_lots(spark):
    rng = random.Random(8)
    words = ["rapid", "test", "kit", "elisa", "pcr", "reagent", "serum", "blood", "glucose", "strip", "panel", "virus"]
    name = lambda: " ".join(rng.sample(words, rng.randrange(1, 5)))
    products = [(rng.randrange(70), name(), rng.choice((None, 1, 2, 3))) for _ in range(260)]
    products += [(r, "shared common name", 9) for r in range(70)]  # one name of every registration
    raws = {r: rng.choice((None, '{"n": "' + " ".join(name() for _ in range(6)) + '"}')) for r in range(0, 90, 2)}
    nodes = spark.createDataFrame([("elisa", "elisa", None), ("pcr", "PCR", None)], "node string, name string, synonyms array<string>")
    mapped = [(r, rng.choice(("elisa", "pcr"))) for r in range(0, 70, 3)]
    rows = [(k, name(), rng.choice((None, 1, 2, 3))) for k in range(25)] + [(100, None, 1), (101, "  ", 1), (102, "shared common name", 1), (103, " rapid test kit ", 2)]
    got = plans.match_lots(
        spark.createDataFrame(rows, "lot_id int, item string, company_id int"), spark.createDataFrame(products, "registration_id int, name string, company_id int"),
        spark.createDataFrame(list(raws.items()), "registration_id int, raw string"), nodes, spark.createDataFrame(mapped, "registration_id int, node string"),
    ).collect()
    assert sorted((r.lot_id, r["rank"], r.registration_id, r.confidence) for r in got) == lots(rows, products, raws, mapped)
    assert {r.lot_id for r in got} >= {102, 103}


def test_contained_terms_few_and_many_alike(spark, monkeypatch):
    texts = spark.createDataFrame([(k, f"KEY{k % 7}REST{k % 3}") for k in range(60)] + [(99, None)], "id long, text string")
    terms = spark.createDataFrame([(f"KEY{k}",) for k in range(5)] + [("RE",), ("T1",)], "term string")
    few = matching.contained_terms(texts, terms)
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(id" not in plan and "SortMergeJoin" not in plan  # texts go through no shuffle
    monkeypatch.setattr(matching, "FEW_TERMS", 0)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, matching.contained_terms(texts, terms).collect()))


def test_map_texts_few_and_many_alike(spark, monkeypatch):
    nodes = spark.createDataFrame([(k, f"node {k}", [f"w{k}", f"x{k % 3}"]) for k in range(8)], "node int, name string, synonyms array<string>")
    rows = [(k, f"raw w{k % 9}" if k % 4 else None, f"node {k % 5}, x{k % 2}", f"w{k % 3}" if k % 5 else None) for k in range(40)]
    blobs = spark.createDataFrame(rows, "id int, raw string, names string, params string")
    few = sorted(map(tuple, plans.map_texts(blobs, nodes).collect()))
    monkeypatch.setattr(matching, "FEW_TERMS", 0)
    assert few and few == sorted(map(tuple, plans.map_texts(blobs, nodes).collect()))


@pytest.mark.parametrize("few", [4_000, 0])
def test_nearest_texts_are_those_of_all_pairs(spark, monkeypatch, few):
    monkeypatch.setattr(matching, "FEW_GRAMS", few)
    monkeypatch.setattr(matching, "QUERY_BLOCK", 7)
    monkeypatch.setattr(matching, "KIND_BLOCK", 5)
    rng = random.Random(few)
    words = ["kit", "test", "elisa", "pcr", "analyser", "reagent", "抗原"]
    make = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(1, 4)))
    asked = [make() for _ in range(20)] + ["", None, " - "]
    texts = [(f"{make()} no{rng.randrange(10**6)}", rng.randrange(90)) for _ in range(300)] + [(None, 1), ("", 2), ("kit", None), ("kit", 3), ("kit", 3)]
    repeats = max(len({t for t, k in texts if k == i}) for i in range(90))
    made = matching.nearest_texts(spark.createDataFrame([(x,) for x in asked], "text string"), spark.createDataFrame(texts, "text string, id long"), 0.05, 4, repeats)
    got = {}
    for r in made.collect():
        got.setdefault(r.a, {})[r.id] = max(r.score, got.get(r.a, {}).get(r.id, 0))
    best = lambda scores: sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:4]
    for a in {x for x in asked if x and grams(x)}:
        want = {}
        for t, k in texts:
            if t and k is not None and similarity(a, t) > 0.05:
                want[k] = max(similarity(a, t), want.get(k, 0))
        assert best(got.get(a, {})) == best(want)
    assert set(got) <= {x for x in asked if x and grams(x)}


def test_nearest_texts_do_not_list_texts_that_share_a_word_with_every_query(spark):
    """Numbered records share a word with every query: they are a few kinds, of which the first ids count."""
    rows = spark.range(300_000).selectExpr("concat('registration no', id) text", "id")
    asked = spark.range(400).selectExpr("concat('registration of kind', id) text")
    got = matching.nearest_texts(asked, rows, 0.05, 3)
    assert got.groupBy("a").count().where("count >= 3").count() == 400 and got.count() < 400 * 100


def test_sets_of_trigrams_are_not_broadcast(spark):
    texts = spark.range(50).selectExpr("concat('registration no', id) text")
    plan = matching.similar_texts(texts, texts, 0.2)._jdf.queryExecution().sparkPlan().toString()
    assert all("t_a" not in line and "t_b" not in line for line in plan.splitlines() if "BroadcastHashJoin" in line)
    assert plan.count("SortMergeJoin") >= 2


def test_lookup_keys_are_columns_before_their_join(spark):
    """A key in the join's condition was made again in every comparison of the join's sort."""
    from certalog.plans import more

    plan = more.normalised_lookup(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    joins = [x for x in plan.splitlines() if "Join LeftOuter" in x]
    assert len(joins) == 2 and all("h#" in x and "regexp_replace" not in x for x in joins)
