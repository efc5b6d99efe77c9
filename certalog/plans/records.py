"""Record processing: keys, classification, merges, conflict policy, diffs and lifecycle events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from certalog.functions import text as fn
from certalog.operators import policy, tables
from certalog.plans.binding import ASOF, SQL, changes, products, registrations
from certalog.session import table

SEVERITY = {"status": "HIGH", "expiry_date": "HIGH", "approval_date": "MED"}


def url_keys(spark, d) -> DataFrame:
    """Registration-style and lookup keys of page addresses."""
    t = table(spark, d, "pages").select("page_id", "url")
    return t.select("page_id", fn.registration_key(F.col("url")).alias("reg_key"), fn.loose_key(F.col("url")).alias("loose_key"))


def company_names(spark, d) -> DataFrame:
    """Supplier names without their number, which stands for the legal form, as keys, and how many share each."""
    key = fn.company_key(F.col("s_name"), ["0", "00", "000"])
    return table(spark, d, "supplier").groupBy(key.alias("company_key")).agg(F.count("*").alias("n"))


def newest_registration(spark, d) -> DataFrame:
    return tables.latest(registrations(spark, d), ["owner_id"], [F.col("created_date").desc(), F.col("registration_id").desc()]).select(
        "owner_id", "registration_id", "approval_date", "status"
    )


def merged(spark, d, how: str) -> DataFrame:
    """Owners' newest registrations of before a day merged with those of later, under a policy."""
    r = registrations(spark, d)
    cut = F.lit("1998-06-01").cast("date")
    order = [F.col("created_date").desc(), F.col("registration_id").desc()]
    pick = lambda x: tables.latest(x, ["owner_id"], order).select("owner_id", "registration_id", "approval_date", "status")
    return tables.merge(pick(r.where(F.col("created_date") < cut)), pick(r.where(F.col("created_date") >= cut)), ["owner_id"], how)


def replaced_days(spark, d) -> DataFrame:
    """Daily counts where the days of cancels are recomputed: delete the part, insert anew."""
    e = changes(spark, d)
    old = e.groupBy("day", "kind").agg(F.count("*").alias("n"))
    new = e.where("kind = 'cancel' and day >= '2000-12-27'").groupBy("day", "kind").agg(F.count_distinct("entity_id").alias("n"))
    return tables.replace_part(old, new, ["day", "kind"])


def archived(spark, d) -> DataFrame:
    """Rows that a cleanup takes and leaves: only known out-of-scope rows go."""
    kept, gone = tables.archive(products(spark, d), ~F.col("is_ivd"))
    return kept.agg(F.lit("kept").alias("part"), F.count("*").alias("n")).unionByName(gone.agg(F.lit("archived").alias("part"), F.count("*").alias("n")))


def resolved(spark, d) -> DataFrame:
    """The field value that each entity's observations end with, by grade, priority and time."""
    e = changes(spark, d).select(
        "entity_id", F.col("kind").alias("value"), F.element_at(F.array(*[F.lit(g) for g in "ABCD"]), F.pmod("event_id", F.lit(4)).cast("int") + 1).alias("grade"),
        F.pmod(F.col("event_id"), F.lit(3)).cast("int").alias("priority"), F.date_diff("day", F.lit("2000-12-13")).cast("long").alias("observed_at"), F.col("event_id").alias("seq"),
    )
    return policy.resolve(e, ["entity_id"])


def field_diffs(spark, d) -> DataFrame:
    """Field by field, what differs between an owner's two newest registrations, with its severity."""
    order = [F.col("created_date").desc(), F.col("registration_id").desc()]
    out = tables.newest_changes(registrations(spark, d), ["owner_id"], order, ["status", "expiry_date", "approval_date", "registration_no"]).drop("before", "after")
    severity = F.create_map(*[F.lit(x) for p in SEVERITY.items() for x in p])
    kind = F.when(F.col("field") == "status", F.when(F.col("new") == "cancelled", "CANCEL").otherwise("MODIFY")).when(F.col("field") == "expiry_date", "RENEW").otherwise("MODIFY")
    return out.withColumns({"change_type": kind, "severity": F.coalesce(severity[F.col("field")], F.lit("LOW"))})


def lifecycle(spark, d) -> DataFrame:
    """Events of each registration: approve, expire up to the day, cancel over renew over change; first of each day and type, numbered."""
    r = registrations(spark, d)
    approve = r.where("approval_date is not null").select("registration_id", F.lit("approve").alias("event_type"), F.col("approval_date").alias("event_date"))
    expire = r.where(F.col("expiry_date") <= F.lit(ASOF)).select("registration_id", F.lit("expire").alias("event_type"), F.col("expiry_date").alias("event_date"))
    c = changes(spark, d).select(F.col("entity_id").alias("registration_id"), F.col("kind").alias("event_type"), F.col("day").alias("event_date"))
    rank = F.when(F.col("event_type") == "cancel", 0).when(F.col("event_type") == "renew", 1).otherwise(2)
    diff = tables.latest(c.where("event_type <> 'approve'").distinct(), ["registration_id", "event_date"], [rank.asc()])
    every = approve.unionByName(diff).unionByName(expire).distinct()
    hashed = every.withColumn("dedupe", F.sha2(F.concat_ws("|", F.col("registration_id").cast("string"), "event_type", F.col("event_date").cast("string")), 256))
    return tables.numbered(hashed, ["registration_id"], [F.col("event_date").asc(), F.col("event_type").asc()], "event_seq")


def page_lines(spark, d) -> DataFrame:
    """Visible text of pages without scripts and styles: its words, and links."""
    t = table(spark, d, "pages")
    plain = F.regexp_replace(F.regexp_replace("html", r"(?s)<(script|style)[^>]*>.*?</(script|style)>", " "), r"<[^>]*>", " ")
    return t.select("page_id", F.regexp_count("html", F.lit("<a ")).cast("long").alias("links"), F.regexp_count(plain, F.lit("[a-z]+")).cast("long").alias("words"), F.md5("html").alias("md5"))


def hashed_documents(spark, d) -> DataFrame:
    """Content-addressed evidence: the first document of each content, and how often it came."""
    t = table(spark, d, "documents").select(F.sha2("text", 256).alias("sha256"), "doc_id")
    return t.groupBy("sha256").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))


def extracted(spark, d) -> DataFrame:
    """The first number with a unit or percent sign of each text that has one."""
    pattern = r"(\d+(?:\.\d+)?)\s*(%|mm|ml|kg)"
    t = table(spark, d, "documents").where(F.col("text").rlike(pattern))
    return t.select("doc_id", F.regexp_extract("text", pattern, 1).try_cast("double").alias("value"), F.regexp_extract("text", pattern, 2).alias("unit"))


def json_keys(spark, d) -> DataFrame:
    t = table(spark, d, "events")
    return t.select(F.size(F.json_object_keys("props")).alias("n_keys"), F.get_json_object("props", "$.k").cast("int").alias("k")).groupBy("n_keys", "k").agg(F.count("*").alias("n"))


_PICK = "select owner_id, registration_id, approval_date, status from (select *, row_number() over (partition by owner_id order by created_date desc, registration_id desc) rn from registrations where created_date {} date '1998-06-01') where rn = 1"
_MERGE = f"{SQL}, t as ({_PICK.format('<')}), s as ({_PICK.format('>=')})"
_BOTH = "select coalesce(t.owner_id, s.owner_id) owner_id, " + "{}" + " from t full join s on t.owner_id = s.owner_id"
_COLUMNS = ("registration_id", "approval_date", "status")

QUERIES = {
    "f1_registration_keys": (url_keys, "select page_id, nullif(regexp_replace(upper(list_filter(string_split_regex(trim(url), '[，,;；|\\\\s]+'), lambda x: x <> '')[1]), '[^0-9A-Z一-鿿]+', '', 'g'), '') reg_key, regexp_replace(upper(url), '[^0-9A-Z一-鿿]+', '', 'g') loose_key from pages".replace("[，,;；|\\\\s]+", "[，,;；|\\\\s]+")),
    "f3_company_names": (company_names, "select regexp_replace(regexp_replace(upper(s_name), '[^0-9A-Z]+', '', 'g'), '(000|00|0)+$', '') company_key, count(*) n from supplier group by 1"),
    "up1_overwrite": (lambda s, d: merged(s, d, "overwrite"), f"{_MERGE} select * from s union all select * from t where owner_id not in (select owner_id from s)"),
    "up2_coalesce": (lambda s, d: merged(s, d, "coalesce"), f"{_MERGE} " + _BOTH.format(", ".join(f"coalesce(s.{c}, t.{c}) {c}" for c in _COLUMNS))),
    "up3_absent": (lambda s, d: merged(s, d, "absent"), f"{_MERGE} select * from t union all select * from s where owner_id not in (select owner_id from t)"),
    "up8_fill": (lambda s, d: merged(s, d, "fill"), f"{_MERGE} " + _BOTH.format(", ".join(f"coalesce(t.{c}, s.{c}) {c}" for c in _COLUMNS))),
    "up5_replaced_days": (replaced_days, f"{SQL} select day, kind, case when kind = 'cancel' and day >= '2000-12-27' then count(distinct entity_id) else count(*) end n from changes group by 1, 2"),
    "up10_archived": (archived, f"{SQL} select case when is_ivd then 'kept' else 'archived' end part, count(*) n from products group by 1"),
    "up21_newest_registration": (newest_registration, f"{SQL} select owner_id, registration_id, approval_date, status from (select *, row_number() over (partition by owner_id order by created_date desc, registration_id desc) rn from registrations) where rn = 1"),
    "q27_resolved": (resolved, f"""{SQL.replace('with', 'with recursive', 1)},
o as (select entity_id, kind as value, 4 - event_id % 4 g, -(event_id % 3) p, date_diff('day', date '2000-12-13', day) t,
  row_number() over (partition by entity_id order by day, event_id) rn from changes),
f as (select distinct entity_id, 0::bigint rn, null::varchar as value, null::bigint g, null::bigint p, null::bigint t, 0 applied, 0 kept, 0 conflicts from o
  union all
  select entity_id, rn, case when step = 2 then n else value end, case when step = 2 then ng else g end, case when step = 2 then np else p end,
    case when step = 2 then nt else t end, applied + (step = 2)::int, kept + (step = 3)::int, conflicts + (step = 1)::int
  from (select f.entity_id, o.rn, f.value, f.g, f.p, f.t, o.value n, o.g ng, o.p np, o.t nt, applied, kept, conflicts,
    case when o.value is not distinct from f.value then 0 when f.g = o.g and f.p = o.p and f.t = o.t then 1
      when f.g is null or (o.g, o.p, o.t) >= (f.g, f.p, f.t) then 2 else 3 end step
    from f join o on o.entity_id = f.entity_id and o.rn = f.rn + 1))
select entity_id, value, applied, kept, conflicts from f where rn = (select max(rn) from o where o.entity_id = f.entity_id)"""),
    "q36_field_diffs": (field_diffs, f"{SQL}, r as (select *, row_number() over (partition by owner_id order by created_date desc, registration_id desc) rn from registrations), o as (select * from r where rn = 2), n as (select * from r where rn = 1), f as (" + " union all ".join(f"select o.owner_id, '{c}' field, cast(o.{c} as varchar) as old, cast(n.{c} as varchar) as new from o join n using (owner_id)" for c in ("status", "expiry_date", "approval_date", "registration_no")) + ") select *, case when field = 'status' and new = 'cancelled' then 'CANCEL' when field = 'expiry_date' then 'RENEW' else 'MODIFY' end change_type, case when field in ('status', 'expiry_date') then 'HIGH' when field = 'approval_date' then 'MED' else 'LOW' end severity from f where old is distinct from new"),
    "q47_lifecycle": (lifecycle, f"{SQL}, c as (select entity_id registration_id, kind event_type, day event_date, row_number() over (partition by entity_id, day order by case kind when 'cancel' then 0 when 'renew' then 1 else 2 end) rn from (select distinct entity_id, kind, day from changes where kind <> 'approve')), v as (select registration_id, 'approve' event_type, approval_date event_date from registrations where approval_date is not null union select registration_id, event_type, event_date from c where rn = 1 union select registration_id, 'expire', expiry_date from registrations, today where expiry_date <= d) select *, sha256(concat_ws('|', cast(registration_id as varchar), event_type, cast(event_date as varchar))) dedupe, cast(row_number() over (partition by registration_id order by event_date, event_type) as integer) event_seq from v"),
    "src9_page_text": (page_lines, "with t as (select page_id, html, regexp_replace(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g') p from pages) select page_id, cast(len(regexp_extract_all(html, '<a ')) as bigint) links, cast(len(regexp_extract_all(p, '[a-z]+')) as bigint) words, md5(html) md5 from t"),
    "snk1_hashed_documents": (hashed_documents, "select sha256(text) sha256, min(doc_id) doc_id, count(*) n from documents group by 1"),
    "f14_extracted": (extracted, r"select doc_id, try_cast(regexp_extract(text, '(\d+(?:\.\d+)?)\s*(%|mm|ml|kg)', 1) as double) as value, regexp_extract(text, '(\d+(?:\.\d+)?)\s*(%|mm|ml|kg)', 2) unit from documents where regexp_matches(text, '(\d+(?:\.\d+)?)\s*(%|mm|ml|kg)')"),
    "jn21_json_keys": (json_keys, "select cast(len(json_keys(props)) as integer) n_keys, cast(json_extract_string(props, '$.k') as integer) k, count(*) n from events group by 1, 2"),
}
