import random

from pyspark.sql import functions as F

from certalog.operators.hierarchy import reached, seed_tree
from certalog.operators.resolution import rebind, resolve_companies
from certalog.plans import entities


def test_reached_ends_on_cycles_with_least_depths(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(25), rng.randrange(25)) for _ in range(35)] + [(7, 7), (None, 3), (3, None), (1, 2), (2, 1)]
    want = set()
    for root in {a for a, _ in edges if a is not None} | {99}:
        depth, level, n = {root: 0}, [root], 0
        while level:
            n += 1
            level = list({b for a, b in edges if a in level and b is not None and b not in depth})
            depth |= {b: n for b in level}
        want |= {(root, b, k) for b, k in depth.items()}
    e = spark.createDataFrame(edges, "a int, b int")
    got = reached(e, spark.createDataFrame([(a,) for a in {a for a, _ in edges}] + [(99,)], "a int")).collect()
    assert len(got) == len(want) and set(map(tuple, got)) == want
    assert reached(e, e.where("false").select("a")).collect() == []


def test_seeding_a_tree_again_changes_nothing(spark):
    seeds = spark.createDataFrame(
        [("a", None, "A", ["x", "A"]), ("b", "a", "B", None), ("c", "b", "C", ["y", "y"]), ("d", "a", "B2", []), ("e", "f", "E", None), ("f", "e", "F", None), ("g", "nobody", "G", None)],
        "seed string, parent string, name string, synonyms array<string>",
    )
    shape = "node_id string, parent_id string, name string, level int, synonyms array<string>, is_active boolean"
    old = spark.createDataFrame([("n1", None, "A", 1, ["A", "x"], True), ("n2", "n1", "B", 1, ["B"], True), ("n3", "n1", "B2", 2, None, True), ("n4", None, "C", 1, ["C"], True)], shape)
    first = seed_tree(seeds, old)
    got = {r.seed: r for r in first.collect()}
    assert {k: r.action for k, r in got.items()} == {"a": "unchanged", "b": "updated", "c": "created", "d": "updated"}  # cycles and strays are no tree
    assert (got["c"].parent_id, got["c"].level, got["c"].synonyms) == ("n2", 3, ["C", "y"])
    assert {r.action for r in seed_tree(seeds, first.withColumn("is_active", F.lit(True))).collect()} == {"unchanged"}
    assert {r.seed: r.action for r in seed_tree(seeds, old, dry_run=True).collect()} == {"a": "unchanged", "b": "created", "c": "updated", "d": "created"}


def test_companies(spark):
    companies = spark.createDataFrame([(1, "北京甲医疗器械有限公司"), (2, "上海乙科技有限公司"), (3, "上海乙生物有限公司"), (4, None), (5, "丁")], "company_id int, name string")
    aliases = spark.createDataFrame([("丙", 5)], "alias string, company_id int")
    names = [("北京甲集团",), ("（北京甲）股份",), ("上海乙",), ("丙有限公司",), ("丙",), ("新公司",), ("旧",), (" ",), (None,)]
    got = {r.key: r for r in resolve_companies(spark.createDataFrame(names, "raw_name string"), aliases, companies, replacements={"旧": "丁"}).collect()}
    assert {k: (r.how, r.company_id, r.n_rows, r.candidates) for k, r in got.items()} == {
        "北京甲": ("unique", 1, 2, 1), "上海乙": ("collision", None, 1, 2), "丙": ("alias", 5, 2, 0), "新": ("create", None, 1, 0), "丁": ("unique", 5, 1, 1),
    }
    products = spark.createDataFrame([(1, "丙公司", 7), (2, "丙", 5), (3, "丙", None), (4, "丁", 7)], "product_id int, raw_name string, company_id int")
    assert sorted(map(tuple, rebind(products, aliases).collect())) == [(1, "丙", 7, 5), (3, "丙", None, 5)]


def test_versions(spark):
    rows = [
        (1, 1, "active", "2020-01-01"), (1, 2, "active", "2021-01-01"), (1, 3, "active", "2020-06-01"), (1, 4, "active", "2020-06-01"), (1, 5, "注销", "2029-01-01"), (1, 6, "注销", "2030-01-01"),
        (2, 1, "active", None), (2, 2, None, None), (3, 1, "x", None),
    ]
    s = spark.createDataFrame(rows, "registration_id int, day int, status string, expiry_date string")
    now = spark.createDataFrame([(1, "active"), (2, " Cancelled ")], "registration_id int, now_status string")
    got = {(r.registration_id, r.day): (r.event, r.summary) for r in entities.version_events(s, ["status", "expiry_date"], now).collect()}
    assert got == {
        (1, 1): ("INITIAL", "initial snapshot"), (1, 2): ("RENEWAL", "expiry_date extended"), (1, 3): ("CHANGE", "changed: expiry_date"), (1, 4): ("UNKNOWN", "unknown"),
        (1, 5): ("CANCEL", "status cancelled"), (1, 6): ("RENEWAL", "expiry_date extended"), (2, 1): ("INITIAL", "initial snapshot"), (2, 2): ("CANCEL", "status cancelled"), (3, 1): ("INITIAL", "initial snapshot"),
    }


def test_subscriptions(spark):
    changed = spark.createDataFrame(
        [(1, 10, "update", 1, "PCR Kit", "DI1", "REG1", "Acme"), (2, 10, "cancel", 2, "PCR Kit", "DI1", "REG1", "Acme"), (3, 11, "new", 3, "Tube", "DI2", None, None)],
        "change_id int, product_id int, change_type string, ts int, name string, udi_di string, reg_no string, company string",
    )
    shape = "sub_id int, subscriber string, channel string, kind string, target string, webhook_url string, email_to string, active boolean"
    subs = [
        (1, "a", None, "company", " ACME ", None, None, True), (2, "a", "Webhook", "product", "tube", "http://a", None, True), (3, "b@x", "email", "keyword", "kit di1", None, None, True),
        (4, "c", "email", "product", "pcr", None, None, True), (5, "d", "webhook", "keyword", "  ", "http://d", None, True), (6, "e", "webhook", "product", "acme", "http://e", None, True),
        (7, "f", "webhook", "product", "tube", "http://f", None, False), (8, "g", "email", "product", "reg1", "", "g@y", True),
    ]
    got = entities.match_subscriptions(changed, spark.createDataFrame(subs, shape)).collect()
    assert sorted(map(tuple, got)) == [("a", "webhook", "http://a", 10, "cancel", 2), ("a", "webhook", "http://a", 11, "new", 3), ("b@x", "email", "b@x", 10, "cancel", 2), ("g", "email", "g@y", 10, "cancel", 2)]


def test_parameters_of_lines(spark):
    own = spark.createDataFrame([(c, a) for c, words in entities.ONTOLOGY.items() for a in words], "code string, alias string")
    text = "检出限 LOD: 5.5 ng/ml\r\n\n 有效期 12 月 \n有效期 12 月\nSensitivity 99.5%\nstorage condition 2-8℃\nnothing\n干扰物质无"
    got = {(r.doc_id, r.param_code): r for r in entities.extract_params(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id int, text string"), own).collect()}
    assert set(got) == {(1, c) for c in ("LOD", "SHELF_LIFE", "SENSITIVITY", "STORAGE_CONDITION", "INTERFERENCE")}
    assert (got[1, "LOD"].value_num, got[1, "LOD"].unit, got[1, "LOD"].line) == (5.5, "ng/mL", 0)
    assert (got[1, "SENSITIVITY"].value_num, got[1, "SENSITIVITY"].unit) == (99.5, "%")
    assert (got[1, "STORAGE_CONDITION"].range_low, got[1, "STORAGE_CONDITION"].range_high, got[1, "STORAGE_CONDITION"].unit) == (2.0, 8.0, "C")
    assert (got[1, "SHELF_LIFE"].line, got[1, "INTERFERENCE"].value_text) == (2, "干扰物质无")


def test_keys_of_rebound_names_are_made_once_a_name(spark, monkeypatch):
    from certalog.operators import resolution

    products = spark.range(1000).selectExpr("id product_id", "concat('Trader ', id % 7, ' Ltd') raw_name", "id % 5 company_id")
    aliases = spark.createDataFrame([("TRADER3", 3), ("TRADER4", None)], "alias string, company_id long")
    want = sorted((k, "TRADER3", k % 5, 3) for k in range(1000) if k % 7 == 3 and k % 5 != 3) + sorted((k, "TRADER4", k % 5, None) for k in range(1000) if k % 7 == 4)
    for few in (20_000, 0):
        monkeypatch.setattr(resolution, "FEW_NAMES", few, raising=False)
        made = resolution.rebind(products, aliases, ["Ltd"])
        assert sorted(map(tuple, made.collect()), key=lambda r: (r[1], r[0])) == sorted(want, key=lambda r: (r[1], r[0]))
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert "regexp_replace" not in plan  # no key is made beside the rows


def test_changes_of_a_frequent_term_are_dealt_to_parts(spark):
    """Subscribers of a term met all its changes in one task: the join's keys were kind and term alone."""
    from certalog.plans import entities

    changed = spark.range(500).selectExpr("id change_id", "id product_id", "'renew' change_type", "timestamp'2001-01-01' ts", "'ring' name", "'d' udi_di", "'r' reg_no", "'c' company")
    subs = spark.range(3).selectExpr("id sub_id", "concat('s', id) subscriber", "'webhook' channel", "'product' kind", "'RING' target", "'http' webhook_url", "null email_to", "true active")
    made = entities.match_subscriptions(changed, subs)
    assert made.count() == made.distinct().count() == 1500
    assert any("part#" in x and "Join Inner" in x for x in made._jdf.queryExecution().optimizedPlan().toString().splitlines())


def test_costly_rules_are_dealt_to_all_cores(spark):
    from certalog.plans import upkeep

    assert upkeep.scalar_rules(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_lines_are_read_before_they_become_rows_of_codes(spark, monkeypatch):
    """Each code of a line took its text through a join and a shuffle, where documents without an id were lost."""
    own = spark.createDataFrame([("A", "ring"), ("B", "ring"), ("C", "rod"), ("D", "")], "code string, alias string")
    same = "x" * 500  # lines of one evidence
    docs = spark.createDataFrame([(None, "Ring 5 mm\nnothing\nrod"), (1, f"{same} ring 1 ml\n{same} rod ring 2 ml\n{same} rod 3 ml\nrod")], "doc_id int, text string")
    want = {(None, "A", 0, 5.0), (None, "B", 0, 5.0), (None, "C", 2, None), (1, "A", 0, 1.0), (1, "B", 0, 1.0), (1, "C", 1, 2.0), (1, "C", 3, None)}
    for few in (1000, 0):
        monkeypatch.setattr("certalog.operators.matching.FEW_TERMS", few)
        made = entities.extract_params(docs, own)
        got = [(r.doc_id, r.param_code, r.line, r.value_num) for r in made.collect()]
        assert len(got) == len(want) and set(got) == want
        assert few == 0 or made._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1  # with the terms


def test_documents_of_one_row_group_are_dealt_before_their_lines_are_searched(spark):
    plan = entities.document_params(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate posexplode") < plan.rindex("RepartitionByExpression [doc_id")  # printed from the result down to the tables
