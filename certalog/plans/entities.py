"""Companies resolved, trees seeded, packages followed, versions told apart, digests matched, parameters read from texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from certalog.functions import fields
from certalog.functions.text import bound, once
from certalog.operators import tables
from certalog.operators.hierarchy import reached, seed_tree
from certalog.operators.matching import are_few, contained_terms
from certalog.operators.resolution import rebind, resolve_companies
from certalog.plans.binding import DAY, SHIFT, SQL, changes, companies
from certalog.session import spread, table

#: Legal forms of this binding.
FORMS = ["Co", "CO", "Ltd", "LTD", "Inc", "INC"]

# Companies


def makers(spark, d) -> DataFrame:
    """Companies by nation and number, so that few share a name."""
    return companies(spark, d).select("company_id", F.concat(F.lit("Maker "), "country", F.lit("."), (F.col("company_id") % 40).cast("string"), F.lit(" Ltd")).alias("name"))


def raw_names(spark, d) -> DataFrame:
    """The maker of every order line as sources spell it; some are not on record."""
    i = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("company_id"), "l_linenumber", F.col("l_orderkey").alias("order"))
    n = F.col("l_linenumber") % 5
    spelt = F.when(n == 0, F.concat("name", F.lit(" Co"))).when(n == 1, F.upper("name")).when(n == 2, F.concat(F.lit("（"), F.replace(F.col("name"), F.lit("Ltd"), F.lit("Ｉｎｃ")), F.lit("）"))).when(n == 3, F.concat(F.lit("Trader "), (F.col("order") % 50).cast("string"))).otherwise(F.col("name"))
    return i.join(makers(spark, d), "company_id").select("order", "l_linenumber", "company_id", spelt.alias("raw_name"))


def alias_table(spark, d) -> DataFrame:
    """Aliases: even traders are makers of their number."""
    return table(spark, d, "supplier").where("s_suppkey % 2 = 0 and s_suppkey < 50").select(F.concat(F.lit("TRADER"), F.col("s_suppkey").cast("string")).alias("alias"), F.col("s_suppkey").alias("company_id"))


def resolved_companies(spark, d) -> DataFrame:
    return resolve_companies(raw_names(spark, d), alias_table(spark, d), makers(spark, d), FORMS)


def rebound(spark, d) -> DataFrame:
    """Order lines that go to another company by an alias, counted by alias and company."""
    p = raw_names(spark, d).select(F.struct("order", "l_linenumber").alias("product_id"), "raw_name", "company_id")
    return rebind(p, alias_table(spark, d), FORMS).groupBy("alias", "old", "new").agg(F.count("*").alias("n"))


# Trees and packages


def methodology_tree(spark, d) -> DataFrame:
    """What seeding regions, nations and their customers' segments does to the nodes there: all regions, even nations at a wrong level, some segments."""
    r, n = table(spark, d, "region"), table(spark, d, "nation")
    seg = table(spark, d, "customer").select("c_nationkey", "c_mktsegment").distinct()
    text = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    seeds = (
        r.select(text("r", "r_regionkey").alias("seed"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name"), F.array(F.lower("r_name"), "r_name").alias("synonyms"))
        .unionByName(n.select(text("n", "n_nationkey").alias("seed"), text("r", "n_regionkey").alias("parent"), F.col("n_name").alias("name"), F.lit(None).cast("array<string>").alias("synonyms")))
        .unionByName(seg.select(F.concat(text("s", "c_nationkey"), "c_mktsegment").alias("seed"), text("n", "c_nationkey").alias("parent"), F.col("c_mktsegment").alias("name"), F.array(F.lit("x")).alias("synonyms")))
    )
    on = F.lit(True).alias("is_active")
    existing = (
        r.select(text("R", "r_regionkey").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.col("r_name").alias("name"), F.lit(1).alias("level"), F.array("r_name", F.lower("r_name")).alias("synonyms"), (F.col("r_regionkey") != 2).alias("is_active"))
        .unionByName(n.where("n_nationkey % 2 = 0").select(text("N", "n_nationkey").alias("node_id"), text("R", "n_regionkey").alias("parent_id"), F.col("n_name").alias("name"), (F.col("n_nationkey") % 3 + 1).cast("int").alias("level"), F.array("n_name").alias("synonyms"), on))
        .unionByName(seg.where("c_nationkey % 4 = 0").select(F.concat(text("S", "c_nationkey"), "c_mktsegment").alias("node_id"), text("N", "c_nationkey").alias("parent_id"), F.col("c_mktsegment").alias("name"), F.lit(3).alias("level"), F.array("c_mktsegment", F.lit("x")).alias("synonyms"), on))
    )
    return seed_tree(seeds, existing).select("seed", "node_id", "parent_id", "level", F.array_join("synonyms", "|").alias("synonyms"), "action")


def package_graph(spark, d) -> DataFrame:
    """How many devices each package holds in all, and how deep: a part's package holds that of a seventh of its number, and some the first of their seven."""
    i = table(spark, d, "lineitem")
    child = F.when(F.col("l_linenumber") == 7, F.col("l_partkey") - F.col("l_partkey") % 7).otherwise(F.floor(F.col("l_partkey") / 7))
    edges = i.select(F.col("l_partkey").alias("package_di"), child.alias("child_di"))
    return reached(edges, edges.select("package_di")).groupBy("root").agg(F.count("*").alias("n"), F.sum("node").alias("nodes"))


# Versions


def version_events(snapshots: DataFrame, watched: list[str], registrations: DataFrame) -> DataFrame:
    """(registration_id, day, event, summary): what each snapshot (registration_id, day and the watched fields, one a day) says of its registration.

    INITIAL for the first, CANCEL if it says so or the register does (registration_id, now_status), RENEWAL if it expires later, CHANGE if a field differs, else UNKNOWN.
    """
    w = Window.partitionBy("registration_id").orderBy("day")
    before = snapshots.withColumns({f"_{f}": F.lag(f).over(w) for f in watched} | {"_n": F.row_number().over(w)}).join(registrations, "registration_id", "left")
    changed = F.array_compact(F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"_{f}")), F.lit(f)) for f in watched]))
    state = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    gone = lambda c: state(c).isin("cancel", "cancelled", "注销")
    told = ~F.col("status").eqNullSafe(F.col("_status")) & gone(F.col("status"))
    event = (
        F.when(F.col("_n") == 1, "INITIAL").when(told | gone(F.col("now_status")), "CANCEL").when(F.col("expiry_date") > F.col("_expiry_date"), "RENEWAL").when(F.size("_changed") > 0, "CHANGE").otherwise("UNKNOWN")
    )
    out = before.withColumn("_changed", changed).withColumn("event", event)
    summary = (
        F.when(F.col("event") == "INITIAL", "initial snapshot").when(F.col("event") == "CANCEL", "status cancelled").when(F.col("event") == "RENEWAL", "expiry_date extended")
        .when(F.size("_changed") > 0, F.concat(F.lit("changed: "), F.array_join(F.slice("_changed", 1, 8), ", "))).otherwise(F.lower("event"))
    )
    return out.select("registration_id", "day", "event", summary.alias("summary"))


def versions(spark, d) -> DataFrame:
    """Order lines as snapshots of their registration, the first line of a day; the register's word is the order's."""
    i = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("registration_id"), F.col("l_shipdate").cast("date").alias("day"), "l_linenumber", "l_partkey", "l_linestatus", "l_quantity", "l_returnflag")
    one = i.groupBy("registration_id", "day").agg(F.min(F.struct("l_linenumber", "l_partkey", "l_linestatus", "l_quantity", "l_returnflag")).alias("x"))
    q = F.col("x.l_quantity").cast("int")
    s = one.select(
        "registration_id", "day", F.when(q == 1, " Cancel").when(q == 2, "注销").when(F.col("x.l_linestatus") == "F", "active").alias("status"),
        F.date_add("day", q * 10).alias("expiry_date"), F.col("x.l_returnflag").alias("class"),
    )
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("registration_id"), F.when(F.col("o_orderpriority") == "5-LOW", "cancelled").alias("now_status"))
    return version_events(s, ["expiry_date", "status", "class"], o)


# Digests

#: Parts that the changes of a term are dealt to.
TERM_PARTS = 64


def match_subscriptions(changed: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """(subscriber, channel, destination, product_id, change_type, ts): the newest change of each product that a subscriber's channel is to be told of.

    changed: change_id, product_id, change_type, ts, name, udi_di, reg_no, company, of one day. subscriptions: subscriber, channel, kind (company, product,
    keyword), target, webhook_url, email_to, sub_id, active. Targets are looked for without regard to case, by a containment join; blank ones match nothing.
    A webhook goes to the first address by sub_id, mail to the first address or the subscriber if that is one; channels without destination get nothing.
    """
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    texts = F.array(
        *[F.struct(F.lit(k).alias("kind"), t.alias("text")) for k, t in (
            ("company", low("company")), ("product", low("name")), ("product", low("udi_di")), ("product", low("reg_no")), ("keyword", F.concat_ws(" ", *[low(c) for c in ("name", "udi_di", "reg_no", "company")])),
        )]
    )
    said = changed.select("change_id", F.posexplode(texts).alias("k", "x")).select(F.struct("change_id", "k").alias("id"), "x.kind", "x.text")
    s = subscriptions.where("active").select("sub_id", "subscriber", F.lower(F.coalesce("channel", F.lit("webhook"))).alias("channel"), "kind", F.lower(F.trim("target")).alias("term"), "webhook_url", "email_to")
    first = lambda c: F.min_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col("sub_id")))
    to = s.groupBy("subscriber", "channel").agg(first("webhook_url").alias("w"), first("email_to").alias("e"))
    mail = F.coalesce(F.nullif("e", F.lit("")), F.when(F.col("subscriber").contains("@"), F.col("subscriber")))
    to = to.select("subscriber", "channel", F.when(F.col("channel") == "webhook", F.nullif("w", F.lit(""))).when(F.col("channel") == "email", mail).alias("destination")).where("destination is not null")
    hit = contained_terms(said.select("id", "text"), s.select("term")).join(said.select("id", "kind"), "id").select("id.change_id", "kind", "term").distinct()
    parts = F.explode(F.sequence(F.lit(0), F.lit(TERM_PARTS - 1))).alias("part")  # many changes hold a frequent term: its subscribers go to every part of them
    told = s.where("term <> ''").join(to, ["subscriber", "channel"]).select("subscriber", "channel", "destination", "kind", "term").distinct().select("*", parts)
    told = told.join(hit.withColumn("part", F.pmod(F.xxhash64("change_id"), F.lit(TERM_PARTS)).cast("int")), ["kind", "term", "part"])
    met = told.select("subscriber", "channel", "destination", "change_id").distinct().join(changed.select("change_id", "product_id", "change_type", "ts"), "change_id")
    newest = met.groupBy("subscriber", "channel", "destination", "product_id").agg(F.max(F.struct("ts", "change_id", "change_type")).alias("n"))
    return newest.select("subscriber", "channel", "destination", "product_id", F.col("n.change_type").alias("change_type"), F.col("n.ts").alias("ts"))


TARGETS = {"company": [" Supplier#00000000", "NATION", "", "supplier#000000001"], "product": ["Ring", "widget b", "0000000", "reg000000001"], "keyword": ["PROMO", "brand#1 0", "  ", "gear"]}


def _choose(values: list, k: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (k % len(values) + 1).cast("int"))


def subscriptions(spark, d) -> DataFrame:
    """Customers' subscriptions, of the three kinds by number."""
    k = F.col("c_custkey")
    kind = _choose(list(TARGETS), k)
    target = F.when(k % 3 == 0, _choose(TARGETS["company"], F.floor(k / 3))).when(k % 3 == 1, _choose(TARGETS["product"], F.floor(k / 3))).otherwise(_choose(TARGETS["keyword"], F.floor(k / 3)))
    who = F.concat(F.lit("c"), (F.floor(k / 2) % 200).cast("string"), F.when(k % 16 == 0, "@x").otherwise(""))
    return table(spark, d, "customer").select(
        k.alias("sub_id"), who.alias("subscriber"), F.when(k % 4 == 0, "Email").when(k % 9 == 0, None).otherwise("webhook").alias("channel"), kind.alias("kind"), target.alias("target"),
        F.when(k % 7 != 0, F.concat(F.lit("http://h/"), k.cast("string"))).alias("webhook_url"), F.when(k % 8 == 4, F.concat(F.lit("m"), k.cast("string"), F.lit("@y"))).alias("email_to"), (k % 10 != 9).alias("active"),
    )


def day_changes(spark, d) -> DataFrame:
    """The day's changes with the product of the registration they are of: its first line."""
    i = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("entity_id")).agg(F.min(F.struct("l_linenumber", "l_partkey", "l_suppkey")).alias("x"))
    p = table(spark, d, "part").select("p_partkey", F.concat_ws(" ", "p_type", "p_name", "p_brand").alias("name"))
    c = companies(spark, d).select(F.col("company_id"), F.concat_ws(" ", "company", "country").alias("company"))
    e = changes(spark, d).where(F.col("day") == F.lit(DAY)).select(F.col("event_id").alias("change_id"), "entity_id", F.col("kind").alias("change_type"), "ts")
    rows = e.join(i, "entity_id").select("change_id", F.col("entity_id").alias("product_id"), "change_type", "ts", F.col("x.l_partkey").alias("p_partkey"), F.col("x.l_suppkey").alias("company_id"))
    rows = rows.join(p, "p_partkey").join(c, "company_id")
    return rows.select("change_id", "product_id", "change_type", "ts", "name", F.format_string("%08d", "p_partkey").alias("udi_di"), F.concat(F.lit("REG"), F.lpad(F.col("product_id").cast("string"), 10, "0")).alias("reg_no"), "company")


def digest_items(spark, d) -> DataFrame:
    return match_subscriptions(day_changes(spark, d), subscriptions(spark, d))


# Parameters of texts

#: Words by which a line speaks of a parameter (fixed values).
ONTOLOGY = {
    "LOD": ("检出限", "检测限", "最低检出浓度", "lod", "limit of detection"),
    "LOQ": ("定量限", "loq", "limit of quantitation", "limit of quantification"),
    "SENSITIVITY": ("灵敏度", "敏感性", "sensitivity"),
    "SPECIFICITY": ("特异性", "specificity"),
    "LINEAR_RANGE": ("线性范围", "linear range"),
    "MEASUREMENT_RANGE": ("测量范围", "可报告范围", "reportable range", "measuring range"),
    "REPEATABILITY": ("重复性", "repeatability", "批内精密度", "批内"),
    "REPRODUCIBILITY": ("再现性", "reproducibility", "批间精密度", "批间"),
    "CV": ("变异系数", "cv", "coefficient of variation"),
    "SAMPLE_TYPE": ("样本类型", "样本要求", "sample type", "specimen"),
    "SAMPLE_VOLUME": ("样本量", "加样量", "取样量", "sample volume"),
    "TURNAROUND_TIME": ("检测时间", "检测时长", "检测用时", "turnaround time"),
    "STORAGE_CONDITION": ("储存条件", "贮存条件", "storage condition"),
    "TRANSPORT_CONDITION": ("运输条件", "运输温度", "transport"),
    "SHELF_LIFE": ("有效期", "保质期", "shelf life"),
    "OPEN_STABILITY": ("开封稳定性", "开瓶稳定性", "开封后稳定性", "on-board stability"),
    "INTERFERENCE": ("干扰", "干扰物质", "interference"),
    "CROSS_REACTIVITY": ("交叉反应", "交叉反应性", "cross-reactivity", "cross reactivity"),
}


def extract_params(documents: DataFrame, ontology: DataFrame) -> DataFrame:
    """(doc_id, param_code, line, evidence, value_num, value_text, unit, range_low, range_high): what lines of texts say of parameters.

    ontology: code, alias (in lower case). A line that holds an alias of a code gives the code its value; of equal lines of a document the first
    counts. Lines are rows of their own, so no document is gathered. A value is read once a line, before the line becomes a row of each of its
    codes; lines are dealt by their evidence before that, and neither evidence nor text is a key of it.
    """
    lines = documents.select("doc_id", F.posexplode(F.split("text", r"\R|[\x1c-\x1e]")).alias("line", "t")).select("doc_id", "line", fields.blank(F.col("t")).alias("t")).where("t is not null")
    said = _line_codes(lines, ontology.select("alias", "code").where("alias <> ''").distinct())
    read = once(said, v=fields.extracted_value(F.col("t")), evidence=F.substring("t", 1, 500)).select("doc_id", "line", "codes", "evidence", "v.*")
    key = ["doc_id", "k1", "k2"]  # of 128 bits for the evidence
    dealt = read.withColumns({"k1": F.xxhash64("evidence"), "k2": F.xxhash64(F.lit(1), F.col("evidence"))}).repartition(*key)
    each = dealt.withColumn("param_code", F.explode("codes"))
    first = tables.latest(each, [*key, "param_code"], [F.col(c).asc() for c in ("line", "value_num", "unit", "range_low", "range_high")])
    return first.select("doc_id", "param_code", "line", "evidence", "value_num", "value_text", "unit", "range_low", "range_high")


def _line_codes(lines: DataFrame, terms: DataFrame) -> DataFrame:
    """lines (doc_id, line, t) that hold an alias of terms (alias, code), with the codes of all that they hold."""
    if are_few(terms.select("alias").distinct()):
        by_alias = terms.groupBy("alias").agg(F.collect_set("code").alias("codes"))
        every = lines.join(F.broadcast(by_alias.agg(F.collect_list(F.struct("alias", "codes")).alias("terms"))))
        held = lambda b: F.filter(b["terms"], lambda x: F.contains(b["low"], x["alias"]))
        found = bound(F.struct(F.lower("t").alias("low"), "terms"), held)
        return once(every, codes=F.array_distinct(F.flatten(F.transform(found, lambda x: x["codes"])))).where("size(codes) > 0").drop("terms")
    of_id = lines.withColumn("id", F.struct("doc_id", "line"))
    hits = contained_terms(of_id.select("id", F.lower("t").alias("text")), terms.select("alias")).withColumnRenamed("term", "alias").join(terms, "alias")
    return of_id.join(hits.groupBy("id").agg(F.collect_set("code").alias("codes")), "id").drop("id")


def document_params(spark, d) -> DataFrame:
    """Parameters that the documents' lines name, by the ontology and by words of the part names."""
    own = spark.createDataFrame([(c, a) for c, words in ONTOLOGY.items() for a in words], "code string, alias string")
    parts = table(spark, d, "part").select(F.upper("p_type").alias("code"), F.lower(F.split("p_name", " ")[1]).alias("alias")).distinct()
    return extract_params(spread(table(spark, d, "documents").select("doc_id", "text"), "doc_id"), own.unionByName(parts)).drop("evidence", "value_text")


_MAKER = "'Maker ' || country || '.' || (company_id % 40) || ' Ltd'"
_COMPANY_KEY = "regexp_replace(regexp_replace(regexp_replace(upper(replace({}, 'Ｉｎｃ', 'INC')), '[^0-9A-Z.#_]+', '', 'g'), '(?:(?:CO|LTD|INC)[.]*)+$', ''), '[^0-9A-Z]+', '', 'g')"
COMPANY_SQL = f"""{SQL},
maker as (select company_id, {_MAKER} as name from companies),
raw as (select l_orderkey o, l_linenumber, company_id, case l_linenumber % 5 when 0 then name || ' Co' when 1 then upper(name) when 2 then '（' || replace(name, 'Ltd', 'Ｉｎｃ') || '）' when 3 then 'Trader ' || (l_orderkey % 50) else name end raw_name from lineitem join maker on l_suppkey = company_id),
al as (select 'TRADER' || s_suppkey alias, s_suppkey company_id from supplier where s_suppkey % 2 = 0 and s_suppkey < 50),
told as (select {_COMPANY_KEY.format('raw_name')} as key, count(*) n_rows, count(distinct raw_name) n_names from raw group by 1),
own as (select {_COMPANY_KEY.format('name')} as key, min(company_id) one, count(*) candidates from maker group by 1)
"""
TREE_SQL = """
with e1 as (select 'R' || r_regionkey node_id, r_name, r_regionkey <> 2 act from region),
l1 as (select 'r' || r_regionkey seed, 'R' || r_regionkey node_id, null::varchar parent_id, 1 as level, r_name || '|' || lower(r_name) synonyms, case when r_regionkey = 2 or r_name = lower(r_name) then 'updated' else 'unchanged' end as action from region),
l2 as (select 'n' || n_nationkey seed, case when n_nationkey % 2 = 0 then 'N' || n_nationkey else sha256('R' || n_regionkey || '/' || n_name) end node_id, 'R' || n_regionkey parent_id, 2 as level, n_name synonyms,
  case when n_nationkey % 2 = 1 then 'created' when n_nationkey % 3 = 1 then 'unchanged' else 'updated' end as action from nation),
l3 as (select distinct 's' || c_nationkey || c_mktsegment seed, case when c_nationkey % 4 = 0 then 'S' || c_nationkey || c_mktsegment else sha256(node_id || '/' || c_mktsegment) end node_id, node_id parent_id, 3 as level, c_mktsegment || '|x' synonyms,
  case when c_nationkey % 4 = 0 then 'unchanged' else 'created' end as action from customer join l2 on seed = 'n' || c_nationkey)
select * from l1 union all select * from l2 union all select * from l3
"""
VERSION_SQL = """
with s as (select l_orderkey registration_id, cast(l_shipdate as date) as day, l_linestatus, cast(l_quantity as integer) q, l_returnflag, row_number() over (partition by l_orderkey, cast(l_shipdate as date) order by l_linenumber, l_partkey, l_linestatus, l_quantity, l_returnflag) rn from lineitem),
t as (select registration_id, day, case when q = 1 then ' Cancel' when q = 2 then '注销' when l_linestatus = 'F' then 'active' end status, day + q * 10 expiry_date, l_returnflag class from s where rn = 1),
b as (select *, lag(status) over w s0, lag(expiry_date) over w e0, lag(class) over w c0, row_number() over w n from t window w as (partition by registration_id order by day)),
c as (select b.*, list_filter([case when expiry_date is distinct from e0 then 'expiry_date' end, case when status is distinct from s0 then 'status' end, case when class is distinct from c0 then 'class' end], lambda x: x is not null) f, o_orderpriority = '5-LOW' gone from b left join orders on o_orderkey = registration_id),
e as (select *, case when n = 1 then 'INITIAL' when gone or status is distinct from s0 and lower(trim(status)) in ('cancel', '注销') then 'CANCEL' when expiry_date > e0 then 'RENEWAL' when len(f) > 0 then 'CHANGE' else 'UNKNOWN' end event from c)
select registration_id, day, event, case event when 'INITIAL' then 'initial snapshot' when 'CANCEL' then 'status cancelled' when 'RENEWAL' then 'expiry_date extended' when 'CHANGE' then 'changed: ' || array_to_string(f, ', ') else 'unknown' end summary from e
"""
_PICK = lambda values, k: f"(['{chr(39) + ', ' + chr(39)}'])".replace("', '", "', '".join(values)) + f"[cast({k} as bigint) % {len(values)} + 1]"
DIGEST_SQL = f"""{SQL},
first as (select l_orderkey, l_partkey, l_suppkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) rn from lineitem),
ch as (select event_id change_id, entity_id product_id, kind change_type, ts, lower(p_type || ' ' || p_name || ' ' || p_brand) n, lpad(cast(l_partkey as varchar), 8, '0') di, lower('REG' || lpad(cast(entity_id as varchar), 10, '0')) reg, lower(company || ' ' || country) co
  from changes join first on l_orderkey = entity_id and rn = 1 join part on p_partkey = l_partkey join companies on company_id = l_suppkey where day = date '{DAY}'),
sub as (select c_custkey sub_id, 'c' || (c_custkey // 2 % 200) || case when c_custkey % 16 = 0 then '@x' else '' end subscriber, case when c_custkey % 4 = 0 then 'email' else 'webhook' end channel, c_custkey % 3 kind,
  lower(trim(case c_custkey % 3 when 0 then {_PICK(TARGETS['company'], 'c_custkey // 3')} when 1 then {_PICK(TARGETS['product'], 'c_custkey // 3')} else {_PICK(TARGETS['keyword'], 'c_custkey // 3')} end)) term,
  case when c_custkey % 7 <> 0 then 'http://h/' || c_custkey end web, case when c_custkey % 8 = 4 then 'm' || c_custkey || '@y' end mail from customer where c_custkey % 10 <> 9),
dest as (select subscriber, channel, case channel when 'webhook' then arg_min(web, sub_id) filter (where web is not null) else coalesce(arg_min(mail, sub_id) filter (where mail is not null), case when contains(subscriber, '@') then subscriber end) end destination from sub group by 1, 2),
hit as (select distinct subscriber, channel, destination, ch.* from sub join dest using (subscriber, channel) join ch on term <> '' and case kind when 0 then contains(co, term) when 1 then contains(n, term) or contains(di, term) or contains(reg, term) else contains(n || ' ' || di || ' ' || reg || ' ' || co, term) end where destination is not null),
r as (select *, row_number() over (partition by subscriber, channel, product_id order by ts desc, change_id desc) rn from hit)
select subscriber, channel, destination, product_id, change_type, ts from r where rn = 1
"""
_UNIT_OF = "case " + " ".join(f"when lower(u) in ({', '.join(repr(w) for w in words)}) then '{name}'" for name, words in fields.UNITS.items()) + " else u end"
_N, _U = r"(\d+(?:\.\d+)?)", "([a-zA-Zμµ°℃/%]+)"
_SPAN = _N + r"\s*(?:-|~|－|—|至|到)\s*" + _N + r"\s*" + _U
PARAM_SQL = rf"""
with l as (select doc_id, unnest(range(len(x))) as line, regexp_replace(unnest(x), '^\s+|\s+$', '', 'g') t from (select doc_id, string_split_regex(text, '\r\n|[\n\x0b\f\r\x1c-\x1e]|\x{{85}}|\x{{2028}}|\x{{2029}}') x from documents)),
o(code, alias) as (select * from (values {", ".join(f"('{c}', '{a}')" for c, words in ONTOLOGY.items() for a in words)}) union select upper(p_type), lower(string_split(p_name, ' ')[2]) from part),
h as (select distinct doc_id, line, t, code from l, (select distinct code, alias from o) where contains(lower(t), alias)),
f as (select doc_id, code param_code, min(line) line, arg_min(t, line) t from h group by doc_id, code, substr(t, 1, 500)),
k as (select *, case when regexp_matches(t, '{_SPAN}') then 1 when regexp_matches(t, '{_N}\s*%') then 2 when regexp_matches(t, '{_N}\s*{_U}') then 3 else 4 end kind from f),
u as (select *, replace(replace(case kind when 1 then regexp_extract(t, '{_SPAN}', 3) when 3 then regexp_extract(t, '{_N}\s*{_U}', 2) end, 'μ', 'u'), 'µ', 'u') u from k)
select doc_id, param_code, cast(line as integer) as line, try_cast(case kind when 2 then regexp_extract(t, '{_N}\s*%', 1) when 3 then regexp_extract(t, '{_N}\s*{_U}', 1) end as double) value_num,
  case kind when 2 then '%' when 4 then null else {_UNIT_OF} end unit, try_cast(case kind when 1 then regexp_extract(t, '{_SPAN}', 1) end as double) range_low, try_cast(case kind when 1 then regexp_extract(t, '{_SPAN}', 2) end as double) range_high from u
"""
QUERIES = {
    "q52_document_params": (document_params, PARAM_SQL),
    "q62_resolved_companies": (resolved_companies, f"{COMPANY_SQL} select key, case when a.alias is not null then 'alias' when candidates = 1 then 'unique' when candidates > 1 then 'collision' else 'create' end how, coalesce(a.company_id, case when candidates = 1 then one end) company_id, n_rows, n_names, coalesce(candidates, 0) candidates from told left join al a on a.alias = key left join own using (key)"),
    "up19_rebound": (rebound, f"{COMPANY_SQL} select alias, raw.company_id as old, al.company_id as new, count(*) n from raw join al on alias = {_COMPANY_KEY.format('raw_name')} where raw.company_id <> al.company_id group by 1, 2, 3"),
    "up15_methodology_tree": (methodology_tree, TREE_SQL),
    "up15_package_graph": (package_graph, "with recursive e as (select distinct l_partkey a, case when l_linenumber = 7 then l_partkey - l_partkey % 7 else l_partkey // 7 end b from lineitem), r(root, node) as (select distinct a, a from e union select root, b from r join e on a = node) select root, count(*) n, cast(sum(node) as bigint) nodes from r group by 1"),
    "q46_version_events": (versions, VERSION_SQL),
    "q60_digest_items": (digest_items, DIGEST_SQL),
}
