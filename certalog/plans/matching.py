"""Texts matched: methodologies of registrations and products, and registrations that procurement lots may mean."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from certalog.functions.fields import norm_key, norm_token
from certalog.functions.text import once
from certalog.operators.matching import are_few, best_rounded, contained_terms, nearest_texts, similar_texts
from certalog.operators.tables import set_similarity, trigrams
from certalog.plans.binding import SQL
from certalog.plans.ingest import ADJECTIVES, NOUNS, _case, _mapped
from certalog.session import staged, table

#: Confidence of a methodology by where its word stands, and of what is said of lots (fixed values).
BY_PARAMS, BY_RAW, BY_NAMES, BY_ALL = 0.90, 0.75, 0.65, 0.60
NAME_LEAST, RAW_LEAST, RAW_WEIGHT, METHOD_BONUS, COMPANY_BONUS, MOST, SCORE_LEAST = 0.10, 0.05, 0.8, 0.15, 0.12, 0.99, 0.20
#: Tokens of subtypes and categories by methodology, with its confidence, and what categories hint at (fixed values).
RULES = {
    "PCR": (("pcr", "核酸扩增", "扩增"), 0.9),
    "QPCR": (("qpcr", "q pcr", "实时荧光pcr", "实时定量pcr"), 0.9),
    "DPCR": (("dpcr", "数字pcr"), 0.9),
    "NGS": (("ngs", "二代测序", "高通量测序"), 0.85),
    "MNGS": (("mngs", "宏基因组", "宏基因组测序"), 0.85),
    "CLIA": (("clia", "化学发光", "发光"), 0.8),
    "ECL": (("电化学发光", "ecl"), 0.8),
    "ELISA": (("elisa", "酶联免疫"), 0.8),
    "ICT": (("免疫层析", "胶体金", "金标", "层析"), 0.75),
    "POCT": (("poct", "床旁", "即时检测", "快速检测"), 0.7),
    "FLOW": (("流式", "流式细胞"), 0.75),
    "BIOCHEM": (("生化", "临床生化"), 0.7),
    "MS": (("质谱", "lc-ms", "lcms", "ms"), 0.75),
}
COARSE, COARSE_CONFIDENCE, DEFAULT_CONFIDENCE = (("发光", "CLIA"), ("免疫", "IMMUNO"), ("生化", "BIOCHEM")), 0.55, 0.8


def ordered_keys(nodes: DataFrame) -> DataFrame:
    """(node, place, key): the different keys of nodes (node, name, synonyms), the name before the synonyms unless it is one."""
    names = F.transform(F.coalesce("synonyms", F.array().cast("array<string>")), F.trim)
    every = F.when(F.array_contains(names, F.trim("name")), names).otherwise(F.concat(F.array(F.trim("name")), names))
    keys = F.array_distinct(F.array_compact(F.transform(every, norm_key)))
    return nodes.select("node", F.posexplode(keys).alias("place", "key"))


def map_texts(blobs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, node, confidence): the methodologies that texts name. blobs: id, raw, names, params.

    Of each node the first key that the whole blob holds counts: by its params, else its raw text, else its names, else it spans them.
    """
    whole = norm_key(F.concat_ws(" ", F.coalesce("raw", F.lit("")), F.coalesce("names", F.lit("")), F.coalesce("params", F.lit(""))))
    keys = ordered_keys(nodes)
    if not are_few(keys.select("key")):
        found = contained_terms(blobs.select("id", whole.alias("text")), keys.select("key"))
        first = found.withColumnRenamed("term", "key").join(keys, "key").groupBy("id", "node").agg(F.min(F.struct("place", "key")).alias("f"))
        parts = first.join(blobs, "id").select("id", "node", F.col("f.key").alias("key"), *[norm_key(F.col(c)).alias(c) for c in ("raw", "names", "params")])
        return parts.select("id", "node", _confidence(parts, F.col("key")).alias("confidence"))
    ordered = keys.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("place", "key"))).alias("keys")).agg(F.collect_list(F.struct("node", "keys")).alias("nodes"))
    texts = once(blobs.select("id", "raw", "names", "params"), _whole=whole, **{f"_{c}": norm_key(F.col(c)) for c in ("raw", "names", "params")}).join(F.broadcast(ordered))
    own = lambda n: F.get(F.filter(n["keys"], lambda k: F.contains("_whole", k["key"])), 0)["key"]
    held = F.filter(F.transform("nodes", lambda n: F.struct(n["node"].alias("node"), own(n).alias("key"))), lambda x: x["key"].isNotNull())
    hits = texts.select("id", F.col("_raw").alias("raw"), F.col("_names").alias("names"), F.col("_params").alias("params"), F.explode(held).alias("h"))
    return hits.select("id", "h.node", _confidence(hits, F.col("h.key")).alias("confidence"))


def _confidence(parts: DataFrame, key: Column) -> Column:
    """By the first of params, raw and names (as keys) that has the key, else that they have it together."""
    has = lambda c: F.coalesce(F.contains(parts[c], key), F.lit(False))
    return F.when(has("params"), BY_PARAMS).when(has("raw"), BY_RAW).when(has("names"), BY_NAMES).otherwise(BY_ALL)


def map_products(products: DataFrame, master: DataFrame, rules: dict = RULES) -> DataFrame:
    """(id, code, confidence, evidence): products (id, subtypes, category) by token, else by a hint in the category.

    master: (code, aliases), the codes that may be given. A token that several speak for belongs to the last: codes, aliases, then rules.
    """
    spark = products.sparkSession
    told = master.select(F.upper(F.trim("code")).alias("code"), F.lit(0).alias("late"), F.explode(F.concat(F.array("code"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("token"))
    ruled = spark.createDataFrame([(c, k + 1, t) for k, (c, (words, _)) in enumerate(rules.items()) for t in words], "code string, late int, token string")
    tokens = told.unionByName(ruled).select("code", "late", norm_token(F.col("token")).alias("token")).where("token <> ''")
    owner = tokens.groupBy("token").agg(F.max_by("code", F.struct("late", "code")).alias("code"))
    sure = F.coalesce(_of({c: x for c, (_, x) in rules.items()}, F.col("code")), F.lit(DEFAULT_CONFIDENCE))
    has = products.select("id", F.posexplode(F.concat(F.coalesce("subtypes", F.array().cast("array<string>")), F.array(F.coalesce("category", F.lit("")))) ).alias("place", "t"))
    by_token = has.select("id", "place", norm_token(F.col("t")).alias("token")).join(owner, "token").groupBy("id", "code").agg(F.min(F.struct("place", "token")).alias("f"))
    by_token = by_token.select("id", "code", sure.alias("confidence"), F.concat(F.lit("token:"), F.col("f.token")).alias("evidence"))
    hint = F.lit(None).cast("string")
    cat = norm_token(F.col("category"))
    for word, code in reversed(COARSE):
        hint = F.when(cat.contains(word), code).otherwise(hint)
    rest = products.join(by_token.select("id").distinct(), "id", "left_anti").select("id", hint.alias("code"), F.lit(COARSE_CONFIDENCE).alias("confidence"), F.concat(F.lit("category:"), cat).alias("evidence"))
    known = master.select(F.upper(F.trim("code")).alias("code")).distinct()
    return by_token.unionByName(rest.where("code is not null")).join(known, "code", "left_semi").select("id", "code", "confidence", "evidence")


def _of(names: dict, c: Column) -> Column:
    return F.create_map(*[F.lit(x) for p in names.items() for x in p])[c]


def match_lots(lots: DataFrame, products: DataFrame, raws: DataFrame, nodes: DataFrame, mapped: DataFrame | Callable[[DataFrame], DataFrame], first: int = 30, top: int = 3) -> DataFrame:
    """The registrations that each lot most likely means: lot_id, registration_id, confidence, and what it is made of; at most top a lot.

    lots: lot_id, item, company_id; products: registration_id, name, company_id; raws: registration_id, raw (texts, may be null);
    nodes: methodologies; mapped: registration_id, node, or what gives them of some registration ids. Considered are the first registrations of an item by
    the greater of name and raw similarity (ties: smaller id) with a name above NAME_LEAST or a raw text above RAW_LEAST. Items without text match nothing.

    Kinds of texts are compared, not rows, so no name's or item's registrations are ever listed whole.
    """
    lots = lots.withColumn("item", F.trim("item")).where("item <> ''")
    items = lots.select("item").distinct()
    of_name = products.where("registration_id is not null and name is not null").select("name", "registration_id").distinct()
    most = of_name.groupBy("registration_id").count().agg(F.max("count")).first()[0] or 1
    rank = lambda by, *order: F.row_number().over(Window.partitionBy(by).orderBy(*order))
    near = lambda rows, least, repeats: nearest_texts(items, rows, least, first, repeats).groupBy(F.col("a").alias("item"), F.col("id").alias("registration_id")).agg(F.max("score").alias("s"))
    best = lambda df: df.withColumn("k", rank("item", F.desc("s"), "registration_id")).where(F.col("k") <= first).select("item", "registration_id")
    either = best(near(of_name, NAME_LEAST, most)).union(best(near(raws.select("raw", "registration_id"), RAW_LEAST, 1))).distinct()
    sim = lambda df, c: once(df, _a=trigrams(F.col("item")), _b=trigrams(F.col(c))).withColumn("_s", set_similarity(F.col("_a"), F.col("_b")))
    either = staged(either)
    names = either.join(of_name, "registration_id")
    pairs = sim(names.select("item", "name").distinct(), "name").select("item", "name", "_s")
    name_sim = names.join(pairs, ["item", "name"]).groupBy("item", "registration_id").agg(F.max("_s").alias("name_sim"))
    judged = sim(name_sim.join(raws, "registration_id", "left"), "raw").withColumn("raw_sim", F.when(F.col("raw").isNull(), 0.0).otherwise(F.col("_s"))).drop("raw", "_a", "_b", "_s")
    judged = staged(judged.withColumn("place", rank("item", F.greatest("name_sim", "raw_sim").desc(), "registration_id")).where(F.col("place") <= first))
    if callable(mapped):
        mapped = mapped(judged.select("registration_id").distinct())
    keys = ordered_keys(nodes)
    of_item = contained_terms(items.select(F.col("item").alias("id"), norm_key(F.col("item")).alias("text")), keys.select("key")).withColumnRenamed("term", "key").join(keys, "key").select(F.col("id").alias("item"), "node").distinct()
    alike = judged.select("item", "registration_id").join(mapped.select("registration_id", "node"), "registration_id").join(of_item, ["item", "node"], "left_semi").select("item", "registration_id").distinct().withColumn("method_bonus", F.lit(METHOD_BONUS))
    winners = products.select("registration_id", "company_id").where("company_id is not null").distinct().withColumn("company_bonus", F.lit(COMPANY_BONUS))
    scored = (
        lots.select("lot_id", "item", "company_id").join(judged, "item").join(alike, ["item", "registration_id"], "left").join(winners, ["registration_id", "company_id"], "left")
        .na.fill(0.0, ["method_bonus", "company_bonus"])
    )
    score = F.least(F.lit(MOST), F.greatest(F.col("name_sim"), F.col("raw_sim") * RAW_WEIGHT) + F.col("method_bonus") + F.col("company_bonus"))
    scored = scored.withColumn("score", score).where(F.col("score") >= SCORE_LEAST).withColumn("confidence", best_rounded(F.col("score"), 2))
    kept = scored.withColumn("rank", rank("lot_id", F.desc("confidence"), "place")).where(F.col("rank") <= top)
    return kept.select(
        "lot_id", "rank", "registration_id", "confidence", best_rounded(F.col("name_sim"), 4).alias("name_similarity"), best_rounded(F.col("raw_sim"), 4).alias("raw_similarity"),
        F.col("method_bonus").alias("methodology_bonus"), "company_bonus",
    )


# The given tables as such: a product is an order line of a part, a lot what a supplier offers.


def _named_lines(spark, d) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_type", "p_brand", F.concat_ws(" ", "p_type", "p_name", "p_brand").alias("name"))
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("registration_id"), F.col("l_suppkey").alias("company_id"), F.col("l_partkey").alias("p_partkey"), F.col("l_quantity").alias("quantity"))
    return lines.join(p, "p_partkey")


def _raws(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    raw = F.concat(F.lit('{"registration_no": "REG'), F.col("o_orderkey").cast("string"), F.lit('", "priority": "'), "o_orderpriority", F.lit('"}'))
    return o.select(F.col("o_orderkey").alias("registration_id"), raw.alias("raw"))


def nodes(spark, d) -> DataFrame:
    """Methodologies: words of part names with the names as synonyms, types, brands and order priorities."""
    p = table(spark, d, "part")
    word = F.split("p_name", " ")[1]
    words = p.groupBy(word.alias("w")).agg(F.sort_array(F.collect_set("p_name")).alias("synonyms")).select(F.concat(F.lit("word "), "w").alias("name"), F.concat("synonyms", F.array("w")).alias("synonyms"))
    none = F.array().cast("array<string>").alias("synonyms")
    single = [t.select(F.col(c).alias("name")).distinct().select("name", none) for t, c in ((p, "p_type"), (p, "p_brand"), (table(spark, d, "orders"), "o_orderpriority"))]
    every = words
    for s in single:
        every = every.unionByName(s)
    return every.withColumn("node", F.col("name"))


def blobs(spark, d, asked: DataFrame | None = None) -> DataFrame:
    """Texts of each registration, or of those asked (registration_id): its record, the names of its products, and parameters of those bought in numbers."""
    of = lambda df: df if asked is None else df.join(asked, "registration_id", "left_semi")
    own = of(_named_lines(spark, d)).groupBy("registration_id").agg(
        F.substring(F.array_join(F.sort_array(F.collect_list("name")), " "), 1, 20_000).alias("names"),
        F.substring(F.array_join(F.sort_array(F.collect_list(F.when(F.col("quantity") >= 40, F.concat_ws(" ", "p_type", "p_brand")))), " "), 1, 20_000).alias("params"),
    )
    return of(_raws(spark, d)).join(own, "registration_id", "left").withColumnRenamed("registration_id", "id")


def methodology_map(spark, d) -> DataFrame:
    """The methodologies of every registration by the words of its texts."""
    return map_texts(blobs(spark, d), nodes(spark, d)).withColumnRenamed("id", "registration_id")


#: Codes that products may be given in this binding, with other names of theirs: not all that the rules know.
MASTER = [("PCR", ["核酸扩增"]), ("QPCR", None), ("ELISA", ["Elisa法"]), ("BIOCHEM", ["生化法"]), ("POCT", ["poct系统"]), ("IMMUNO", None)]


def product_methodologies(spark, d) -> DataFrame:
    """The methodologies of every part by the tokens of its subtypes and category."""
    p = table(spark, d, "part")
    first = _mapped(F.split("p_name", " ")[0], ADJECTIVES, "")
    products = p.select(F.col("p_partkey").alias("id"), F.when(first != "", F.array(first)).alias("subtypes"), _mapped(F.split("p_name", " ")[1], NOUNS, "").alias("category"))
    return map_products(products, spark.createDataFrame(MASTER, "code string, aliases array<string>"))


def lots(spark, d) -> DataFrame:
    """One lot a supplier: what it offers is the part of its number."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("lot_id"), F.concat_ws(" ", "p_type", "p_name", "p_brand").alias("item"))
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("lot_id"), F.col("s_suppkey").alias("company_id")).join(p, "lot_id")


def lot_matches(spark, d) -> DataFrame:
    products = _named_lines(spark, d).select("registration_id", "name", "company_id")
    own = lambda asked: map_texts(blobs(spark, d, asked), nodes(spark, d)).withColumnRenamed("id", "registration_id")
    return match_lots(lots(spark, d), products, _raws(spark, d), nodes(spark, d), own)


def similar_names(spark, d) -> DataFrame:
    """For each distinct part name the three most similar others of a similarity above 0.2."""
    names = table(spark, d, "part").select("p_name")
    met = similar_texts(names, names, SCORE_LEAST).where("a <> b")
    ranked = met.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), "b")))
    return ranked.where("rank <= 3").select(F.col("a").alias("p_name"), "rank", F.col("b").alias("other"), "score")


def keyword_matches(spark, d) -> DataFrame:
    """How many registrations name each key of the methodologies."""
    b = blobs(spark, d).select("id", norm_key(F.concat_ws(" ", "raw", "names", "params")).alias("text"))
    return contained_terms(b, ordered_keys(nodes(spark, d)).select("key")).groupBy("term").agg(F.count("*").alias("n"))


_KEY = "nullif(regexp_replace(upper({}), '[^0-9A-Z一-鿿]+', '', 'g'), '')"
_GRAMS = "select distinct s, substr(x, i, 3) g from (select s, '  ' || w || ' ' x from (select s, unnest(string_split_regex(lower(s), '[^a-z0-9]+')) w from {}) where w <> ''), range(1, 80) r(i) where i + 2 <= length(x)"
BLOB_SQL = f"""{SQL},
named as (select l_orderkey registration_id, l_suppkey company_id, l_quantity quantity, p_type || ' ' || p_name || ' ' || p_brand as name, p_type || ' ' || p_brand param from lineitem join part on l_partkey = p_partkey),
raws as (select o_orderkey registration_id, '{{"registration_no": "REG' || o_orderkey || '", "priority": "' || o_orderpriority || '"}}' raw from orders),
own as (select registration_id, string_agg(name, ' ' order by name) as names, coalesce(string_agg(param, ' ' order by param) filter (where quantity >= 40), '') params from named group by 1),
blob as (select registration_id, raw, substr(names, 1, 20000) as names, substr(params, 1, 20000) params, coalesce({_KEY.format("raw || ' ' || coalesce(substr(names, 1, 20000), '') || ' ' || coalesce(substr(params, 1, 20000), '')")}, '') whole from raws left join own using (registration_id)),
n0 as (select 'word ' || w as name, list_concat(list_concat(['word ' || w], list_sort(list(distinct p_name))), [w]) syn from (select *, string_split(p_name, ' ')[2] w from part) group by w
  union all select distinct p_type, [p_type] from part union all select distinct p_brand, [p_brand] from part union all select distinct o_orderpriority, [o_orderpriority] from orders),
keys as (select name as node, k place, {_KEY.format("syn[k]")} as key from n0, range(1, 100) r(k) where k <= len(syn)),
hit as (select registration_id, node, place, key, raw, names, params from blob, keys where contains(whole, key)),
mapped as (select registration_id, node, case when contains(coalesce({_KEY.format("params")}, ''), key) then {BY_PARAMS} when contains({_KEY.format("raw")}, key) then {BY_RAW} when contains(coalesce({_KEY.format("names")}, ''), key) then {BY_NAMES} else {BY_ALL} end::double confidence
  from (select *, row_number() over (partition by registration_id, node order by place) rn from hit) where rn = 1)
"""
LOT_SQL = f"""{BLOB_SQL},
lot as (select s_suppkey lot_id, s_suppkey company_id, p_type || ' ' || p_name || ' ' || p_brand item from supplier join part on p_partkey = s_suppkey),
ti as ({_GRAMS.format("(select distinct item s from lot)")}), tn as ({_GRAMS.format("(select distinct name s from named)")}), tr as ({_GRAMS.format("(select distinct raw s from raws)")}),
ci as (select s, count(*) c from ti group by 1), cn as (select s, count(*) c from tn group by 1), cr as (select s, count(*) c from tr group by 1),
sn as (select m.*, k::double / (ci.c + cn.c - k) v from (select ti.s item, tn.s as name, count(*) k from ti join tn using (g) group by 1, 2) m join ci on ci.s = item join cn on cn.s = name),
sr as (select m.*, k::double / (ci.c + cr.c - k) v from (select ti.s item, tr.s raw, count(*) k from ti join tr using (g) group by 1, 2) m join ci on ci.s = item join cr on cr.s = raw),
w as (select item, registration_id, max(v) v, 1 kind from sn join (select distinct name, registration_id from named) using (name) where v > 0 group by 1, 2 union all select item, registration_id, v, 2 from sr join raws using (raw)),
c as (select item, registration_id, coalesce(max(v) filter (where kind = 1), 0) name_sim, coalesce(max(v) filter (where kind = 2), 0) raw_sim from w group by 1, 2),
r30 as (select *, row_number() over (partition by item order by greatest(name_sim, raw_sim) desc, registration_id) place from c where (name_sim > {NAME_LEAST} or raw_sim > {RAW_LEAST}) and registration_id in (select registration_id from named)),
im as (select distinct item, node from (select distinct item from lot), keys where contains({_KEY.format("item")}, key)),
x as (select lot_id, r.*, case when exists (select 1 from mapped m join im using (node) where m.registration_id = r.registration_id and im.item = r.item) then {METHOD_BONUS} else 0 end::double method_bonus,
  case when exists (select 1 from named n where n.registration_id = r.registration_id and n.company_id = lot.company_id) then {COMPANY_BONUS} else 0 end::double company_bonus from lot join r30 r using (item) where place <= 30),
y as (select *, least({MOST}::double, greatest(name_sim, raw_sim * {RAW_WEIGHT}::double) + method_bonus + company_bonus) score from x),
z as (select *, round_even(score * 100, 0) / 100 confidence from y where score >= {SCORE_LEAST}),
q as (select *, row_number() over (partition by lot_id order by confidence desc, place) rank from z)
select lot_id, cast(rank as integer) rank, registration_id, confidence, round_even(name_sim * 10000, 0) / 10000 name_similarity, round_even(raw_sim * 10000, 0) / 10000 raw_similarity, method_bonus methodology_bonus, company_bonus from q where rank <= 3
"""
_TOKENS = {t: c for c, names in MASTER for t in [c, *(names or [])]} | {t: c for c, (words, _) in RULES.items() for t in words}
_LOW = {t.lower(): c for t, c in _TOKENS.items()}
PRODUCT_SQL = f"""with p as (select p_partkey id, {_case("string_split(p_name, ' ')[1]", ADJECTIVES, "")} sub, {_case("string_split(p_name, ' ')[2]", NOUNS, "")} cat from part),
d(token, code, sure) as (values {", ".join(f"('{t}', '{c}', {RULES[c][1] if c in RULES else DEFAULT_CONFIDENCE})" for t, c in _LOW.items())}),
h as (select id, code, sure, token, row_number() over (partition by id, code order by place) rn from (select id, 1 place, lower(sub) token from p union all select id, 2, lower(cat) from p) join d using (token)),
t as (select id, code, sure::double confidence, 'token:' || token evidence from h where rn = 1),
f as (select id, case when cat like '%发光%' then 'CLIA' when cat like '%免疫%' then 'IMMUNO' when cat like '%生化%' then 'BIOCHEM' end code, {COARSE_CONFIDENCE}::double, 'category:' || lower(cat) from p where id not in (select id from t))
select * from (select * from t union all select * from f where code is not null) where code in ({", ".join(f"'{c}'" for c, _ in MASTER)})
"""
QUERIES = {
    "q48_methodology_map": (methodology_map, f"{BLOB_SQL} select * from mapped"),
    "q49_product_methodologies": (product_methodologies, PRODUCT_SQL),
    "q50_lot_matches": (lot_matches, LOT_SQL),
    "jn14_similar_names": (similar_names, "with n as (select distinct p_name from part), g as (select distinct p_name, substr(p, i, 3) x from (select p_name, '  ' || w || ' ' p from (select p_name, unnest(string_split_regex(lower(p_name), '[^a-z0-9]+')) w from n) where w <> ''), range(1, 40) r(i) where i + 2 <= length(p)), z as (select p_name, count(*) c from g group by 1), m as (select a.p_name, b.p_name other, count(*) s from g a join g b using (x) where a.p_name <> b.p_name group by 1, 2), k as (select m.p_name, other, cast(s as double) / (z1.c + z2.c - s) score from m join z z1 on m.p_name = z1.p_name join z z2 on other = z2.p_name), r as (select *, row_number() over (partition by p_name order by score desc, other) rank from k where score > 0.2) select p_name, cast(rank as integer) rank, other, score from r where rank <= 3"),
    "jn15_contained_keys": (keyword_matches, f"{BLOB_SQL} select key term, count(distinct registration_id) n from hit group by 1"),
}
