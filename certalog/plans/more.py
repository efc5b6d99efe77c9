"""Lookups, batch reads, gates, quality audits and pages of lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from certalog.functions import text as fn
from certalog.operators import tables
from certalog.plans.binding import ASOF, DAY, SQL, changes, companies, products, registrations
from certalog.plans.scores import DIST, SIGNAL_SQL, distribution, registration_signal
from certalog.session import table


def by_day(e: DataFrame) -> DataFrame:
    return e.groupBy("day").agg(F.count("*").alias("n"), F.count_distinct("entity_id").alias("entities"))


def backfilled(spark, d) -> DataFrame:
    """Metrics of each of the 14 days to the day, zero where nothing happened: the days are generated once and joined."""
    days = spark.range(1).select(F.explode(F.sequence(F.date_sub(F.lit(DAY), 13), F.lit(DAY))).alias("day"))
    e = by_day(changes(spark, d).where("kind = 'cancel'"))
    return F.broadcast(days).join(e, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("entities", F.lit(0)).alias("entities"))


def changes_of_products(spark, d) -> DataFrame:
    """Changes that have a registration with products in scope, by kind and track."""
    p = products(spark, d).where("is_ivd").select(F.col("registration_id").alias("entity_id"), "category").distinct()
    return changes(spark, d).join(p, "entity_id").groupBy("kind", "category").agg(F.count("*").alias("n"))


def normalised_lookup(spark, d) -> DataFrame:
    """Registrations found by number, as written or by loose key, the newest of a key: two equi-joins, the exact one first."""
    asked = registrations(spark, d).select(
        "registration_id", F.when(F.col("registration_id") % 2 == 0, F.col("registration_no")).otherwise(F.concat(F.lit("reg-"), F.substring("registration_no", 4, 10))).alias("asked")
    )
    r = registrations(spark, d).select(F.col("registration_no").alias("no"), F.col("registration_id").alias("found"), "created_date")
    # a join or window sorts by its keys: their hashes come first, so that few comparisons read a text, and none makes a key again
    asked = asked.withColumns({"h": F.xxhash64("asked"), "asked_key": fn.loose_key(F.col("asked"))})
    exact = asked.join(r.select(F.xxhash64("no").alias("h"), F.col("no").alias("asked"), F.col("found").alias("exact")), ["h", "asked"], "left").drop("h")
    keyed = r.withColumn("key", fn.loose_key(F.col("no"))).withColumn("h", F.xxhash64("key"))
    keyed = tables.latest(keyed, ["h", "key"], [F.col("created_date").desc_nulls_last(), F.col("found").desc()])
    loose = keyed.select("h", F.col("key").alias("asked_key"), F.col("found").alias("loose"))
    found = exact.withColumn("h", F.xxhash64("asked_key")).join(loose, ["h", "asked_key"], "left")
    return found.select("registration_id", "asked", F.coalesce("exact", "loose").alias("found"), F.col("exact").isNotNull().alias("is_exact"))


def batch_signals(spark, d) -> DataFrame:
    """Signals for a list of numbers, repeats kept, unknown ones with the default; only the numbers asked are computed.

    The list is every owner's newest registration, those of even number twice, and as many that don't exist.
    """
    newest = registrations(spark, d).groupBy("owner_id").agg(F.max("registration_id").alias("asked")).select("asked")
    asked = newest.unionByName(newest.where("asked % 2 = 0")).unionByName(newest.select((-1 - F.col("asked")).alias("asked")))
    s = registration_signal(spark, d, newest.withColumnRenamed("asked", "registration_id")).select(F.col("registration_id").alias("asked"), "level", "score")
    out = asked.join(s, "asked", "left").select("asked", F.coalesce("level", F.lit("medium")).alias("level"), F.coalesce("score", F.lit(0.0)).alias("score"))
    return tables.numbered(out, ["asked"], [F.col("score").asc()], "copy")


def keyset_page(spark, d) -> DataFrame:
    return registrations(spark, d).where("registration_no > 'REG0000000100'").orderBy("registration_no").limit(100).select("registration_no", "status")


def source_shares(spark, d) -> DataFrame:
    """Share of each kind of change by day, as one line of text; the largest first, ties by name."""
    return distribution(changes(spark, d).groupBy("day", "kind").agg(F.count("*").alias("n")), ["day"], "kind", "n")


def merged_lists(spark, d) -> DataFrame:
    """Distinct kinds of an entity from two lists, the first list's order kept, fifty at most as at the source."""
    e = changes(spark, d)
    a = e.where("k < 50").groupBy("entity_id").agg(F.sort_array(F.collect_set("kind")).alias("a"))
    b = e.where("k >= 50").groupBy("entity_id").agg(F.sort_array(F.collect_set("kind")).alias("b"))
    none = F.array().cast("array<string>")
    both = a.join(b, "entity_id", "full").select("entity_id", F.coalesce("a", none).alias("a"), F.coalesce("b", none).alias("b"))
    return both.select("entity_id", F.array_join(F.slice(F.array_distinct(F.concat("a", "b")), 1, 50), ",").alias("merged"), F.array_join(F.array_except("a", "b"), ",").alias("only_a"), F.arrays_overlap("a", "b").alias("overlap"))


def anchor_gate(spark, d) -> DataFrame:
    """Addresses through the anchor gate: missing, unusable or conflicting keys get an error code."""
    t = table(spark, d, "pages").select("page_id", F.regexp_extract("url", r"/(\d+)", 1).alias("a"), F.regexp_extract("url", r"page=(\d+)", 1).alias("b"))
    code = F.when((F.col("a") == "") & (F.col("b") == ""), "missing").when(F.length("a") < 2, "unusable").when((F.col("b") != "") & (F.col("a") != F.col("b")), "conflict").otherwise("ok")
    return t.groupBy(code.alias("code")).agg(F.count("*").alias("n"))


def data_quality(spark, d) -> DataFrame:
    """Counters over all documents in one pass: blank, short, without letters, repeated content."""
    t = table(spark, d, "documents")
    w = t.select("source", F.length("text").alias("n"), F.regexp_count("text", F.lit("[A-Za-z]")).alias("letters"), F.md5("text").alias("h"))
    return w.groupBy("source").agg(F.count("*").alias("total"), F.count_if(F.col("n") < 100).alias("short"), F.count_if(F.col("letters") * 2 < F.col("n")).alias("few_letters"), (F.count("*") - F.count_distinct("h")).alias("copies"), F.sum("n").alias("chars"))


def payload_hashes(spark, d) -> DataFrame:
    """Canonical payload hash of events: sorted keys, compact; how many payloads repeat."""
    e = table(spark, d, "events")
    body = F.concat(F.lit('{"event_type":"'), "event_type", F.lit('","k":'), F.get_json_object("props", "$.k"), F.lit("}"))
    return e.groupBy(F.sha2(body, 256).alias("payload_hash")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


def pending(spark, d) -> DataFrame:
    """Backlog of unlabelled documents by source, and within windows of their ids."""
    known = table(spark, d, "labels").select("doc_id")
    t = table(spark, d, "documents").join(known, "doc_id", "left_anti")
    return t.groupBy("source", "lang").agg(F.count("*").alias("pending"), F.count_if(F.col("n_chars") >= 2000).alias("long"))


def variants(spark, d) -> DataFrame:
    """One registration's page: its products, newest first, for every registration."""
    r = registrations(spark, d).select("registration_id", "registration_no")
    order = [F.col("updated_date").desc_nulls_last(), *[F.col(c).asc() for c in ("line", "part_id", "company_id", "quantity")]]
    return tables.numbered(r.join(products(spark, d), "registration_id"), ["registration_id"], order, "place").select("registration_no", "place", "part_id", "company_id", "updated_date")


def param_winners(spark, d) -> DataFrame:
    """One value of each (part, code): the latest observation, ties to the larger key, over all rows at once."""
    p = products(spark, d)
    each = p.select("part_id", "updated_date", "registration_id", "line", "company_id", F.explode(F.create_map(F.lit("quantity"), F.col("quantity"), F.lit("line"), F.col("line").cast("double"))).alias("code", "value"))
    order = [F.col("updated_date").desc_nulls_last(), F.col("registration_id").desc(), F.col("line").desc(), F.col("company_id").desc(), F.col("value").desc()]
    return tables.latest(each, ["part_id", "code"], order).select("part_id", "code", "value", "registration_id")


def supplier_bands(spark, d) -> DataFrame:
    """Suppliers by balance step, redacted for the free plan: names only above the first step."""
    level = fn.ladder(F.col("balance"), ((0.0, "basic"), (3000.0, "plus"), (7000.0, "pro")), "none")
    return companies(spark, d).select("company_id", level.alias("level"), F.when(level.isin("plus", "pro"), F.col("company")).alias("company"))


def expired_unrenewed(spark, d) -> DataFrame:
    """Registrations past the day without any renewal: the cancel flag of the audit."""
    renewed = changes(spark, d).where("kind = 'renew'").select(F.col("entity_id").alias("registration_id"))
    late = registrations(spark, d).where((F.col("expiry_date") < F.lit(ASOF)) & F.coalesce(F.col("status") != "cancelled", F.lit(True)))
    return late.join(renewed, "registration_id", "left_anti").groupBy(F.date_format("expiry_date", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


_COPY = "row_number() over (partition by asked order by score)"
QUERIES = {
    "q18_backfilled": (backfilled, f"{SQL}, c as (select day, count(*) n, count(distinct entity_id) entities from changes where kind = 'cancel' group by 1), r as (select cast(unnest(generate_series(e - interval 13 day, e, interval 1 day)) as date) as day from today) select r.day, coalesce(n, 0) n, coalesce(entities, 0) entities from r left join c using (day)"),
    "q21_changes_of_products": (changes_of_products, f"{SQL} select kind, category, count(*) n from changes join (select distinct registration_id, category from products where is_ivd) on entity_id = registration_id group by 1, 2"),
    "jn13_normalised_lookup": (normalised_lookup, f"{SQL}, a as (select registration_id, case when registration_id % 2 = 0 then registration_no else 'reg-' || substr(registration_no, 4, 10) end asked from registrations) select a.registration_id, asked, coalesce(x.registration_id, y.registration_id) as found, x.registration_id is not null is_exact from a left join registrations x on asked = x.registration_no left join registrations y on regexp_replace(upper(asked), '[^0-9A-Z]+', '', 'g') = y.registration_no"),
    "q14_batch_signals": (batch_signals, f"{SIGNAL_SQL}, z as (select * from signal), a as (select max(registration_id) asked from registrations group by owner_id), b as (select asked from a union all select asked from a where asked % 2 = 0 union all select -1 - asked from a), c as (select asked, coalesce(level, 'medium') as level, coalesce(score, 0.0::double) score from b left join z on asked = registration_id) select asked, level, score, cast({_COPY} as integer) copy from c"),
    "tk3_keyset_page": (keyset_page, f"{SQL} select registration_no, status from registrations where registration_no > 'REG0000000100' order by 1 limit 100"),
    "ag18_source_shares": (source_shares, f"{SQL}, n as (select day, kind, count(*) n from changes group by 1, 2) " + DIST("day", "n", "kind", "n")),
    "set4_merged_lists": (merged_lists, f"{SQL}, a as (select entity_id, list_sort(list(distinct kind)) l from changes where k < 50 group by 1), b as (select entity_id, list_sort(list(distinct kind)) l from changes where k >= 50 group by 1), j as (select coalesce(a.entity_id, b.entity_id) entity_id, coalesce(a.l, []) a, coalesce(b.l, []) b from a full join b on a.entity_id = b.entity_id) select entity_id, array_to_string(list_concat(a, list_filter(b, lambda x: not list_contains(a, x))), ',') merged, array_to_string(list_filter(a, lambda x: not list_contains(b, x)), ',') only_a, list_has_any(a, b) as overlap from j"),
    "q35_anchor_gate": (anchor_gate, "with t as (select regexp_extract(url, '/(\\d+)', 1) a, regexp_extract(url, 'page=(\\d+)', 1) b from pages) select case when a = '' and b = '' then 'missing' when length(a) < 2 then 'unusable' when b <> '' and a <> b then 'conflict' else 'ok' end code, count(*) n from t group by 1"),
    "q53_data_quality": (data_quality, "with w as (select source, length(text) n, len(regexp_extract_all(text, '[A-Za-z]')) letters, md5(text) h from documents) select source, count(*) total, count(*) filter (where n < 100) short, count(*) filter (where letters * 2 < n) few_letters, count(*) - count(distinct h) copies, cast(sum(n) as bigint) chars from w group by 1"),
    "f19_payload_hashes": (payload_hashes, "select sha256('{\"event_type\":\"' || event_type || '\",\"k\":' || json_extract_string(props, '$.k') || '}') payload_hash, count(*) n, min(event_id) first_id from events group by 1"),
    "q58_pending": (pending, "select source, lang, count(*) pending, count(*) filter (where n_chars >= 2000) long from documents where doc_id not in (select doc_id from labels) group by 1, 2"),
    "q24_variants": (variants, f"{SQL} select registration_no, cast(row_number() over (partition by registration_id order by updated_date desc nulls last, line, part_id, company_id, quantity) as integer) place, part_id, company_id, updated_date from registrations join products using (registration_id)"),
    "w7_param_winners": (param_winners, f"{SQL}, v as (select *, 'quantity' code, quantity as value from products union all select *, 'line', cast(line as double) from products) select part_id, code, value, registration_id from (select *, row_number() over (partition by part_id, code order by updated_date desc nulls last, registration_id desc, line desc, company_id desc, value desc) rn from v) where rn = 1"),
    "prj3_supplier_bands": (supplier_bands, f"{SQL} select company_id, case when balance >= 7000 then 'pro' when balance >= 3000 then 'plus' when balance >= 0 then 'basic' else 'none' end as level, case when balance >= 3000 then company end company from companies"),
    "ag15_expired_months": (expired_unrenewed, f"{SQL} select strftime(expiry_date, '%Y-%m') as month, count(*) n from registrations r, today where expiry_date < d and coalesce(status <> 'cancelled', true) and not exists (select 1 from changes where kind = 'renew' and entity_id = r.registration_id) group by 1"),
}
