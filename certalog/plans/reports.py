"""Searches, dashboards, audits and daily metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from certalog.operators.tables import join_either, latest, numbered, profile
from certalog.plans.binding import ASOF, DAY, SQL, changes, companies, lines, products, registrations
from certalog.session import table


def search(spark, d, q: str = "%al%", prefix: str = "standard", page: int = 2, size: int = 25) -> DataFrame:
    """A page of the products in scope whose name or company matches and whose category has a prefix; wildcards are the user's."""
    c = companies(spark, d)
    hit = products(spark, d).where("is_ivd").join(c, "company_id", "left")
    hit = hit.where((F.col("name").ilike(q) | F.col("company").ilike(q)) & F.col("category").ilike(f"{prefix}%"))
    order = [F.col("updated_date").desc_nulls_first(), *[F.col(x).asc() for x in ("registration_id", "line", "part_id", "company_id", "quantity")]]
    return hit.orderBy(*order).offset((page - 1) * size).limit(size).select("registration_id", "line", "part_id", "name", "company", "category")


def search_total(spark, d) -> DataFrame:
    c = companies(spark, d)
    hit = products(spark, d).where("is_ivd").join(c, "company_id", "left").where((F.col("name").ilike("%al%") | F.col("company").ilike("%al%")) & F.col("category").ilike("standard%"))
    return hit.agg(F.count("*").alias("total"))


def daily_metrics(spark, d) -> DataFrame:
    """One row a day: changes by kind, distinct entities, share of cancels."""
    e = changes(spark, d)
    kinds = [F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("approve", "renew", "cancel", "change")]
    return e.groupBy("day").agg(*kinds, F.count_distinct("entity_id").alias("entities"), F.count_distinct(F.when(F.col("kind") == "cancel", F.col("entity_id"))).alias("cancelled_entities"), (F.count_if(F.col("kind") == "cancel") / F.count("*")).alias("cancel_rate"))


def dashboard(spark, d) -> DataFrame:
    """Sums over the 14 days to the day, the best day of each kind, and the newest day."""
    m = daily_metrics(spark, d).where(F.col("day").between(F.date_sub(F.lit(DAY), 13), F.lit(DAY)))
    return m.agg(F.coalesce(F.sum("n_approve"), F.lit(0)).alias("approved"), F.coalesce(F.sum("n_cancel"), F.lit(0)).alias("cancelled"), F.max("day").alias("newest"), F.max_by("n_approve", "day").alias("newest_approved"))


def ranked_days(spark, d) -> DataFrame:
    return daily_metrics(spark, d).orderBy(F.col("n_approve").desc(), F.col("day").desc()).limit(10).select("day", "n_approve")


def expiring(spark, d) -> DataFrame:
    """Registrations that end within 90 days, with their products; null status drops out."""
    r = registrations(spark, d).where(F.col("expiry_date").between(F.lit(ASOF), F.date_add(F.lit(ASOF), 90)) & (F.col("status") != "cancelled"))
    n = lines(spark, d).groupBy("registration_id").agg(F.count("*").alias("n_products"))
    return r.join(n, "registration_id", "left").select("registration_no", "expiry_date", F.coalesce("n_products", F.lit(0)).alias("n_products"))


def company_tracking(spark, d) -> DataFrame:
    p = lines(spark, d).join(registrations(spark, d).select("registration_id", "status", "expiry_date"), "registration_id")
    late = F.coalesce(F.col("expiry_date") < F.lit(ASOF), F.lit(False))
    gone = F.coalesce(F.col("status") == "cancelled", F.lit(False))
    g = p.groupBy("company_id").agg(F.count("*").alias("total"), F.count_if(late & ~gone).alias("expired"), F.count_if(gone).alias("cancelled"), F.count_if(~late & ~gone).alias("active"), F.max("updated_date").alias("last_update"))
    return companies(spark, d).join(g, "company_id").select("company_id", "company", "country", "total", "expired", "cancelled", "active", "last_update")


def category_weeks(spark, d) -> DataFrame:
    week = F.date_trunc("week", "updated_date").cast("date").alias("week")
    return products(spark, d).groupBy(week, "category").agg(F.count("*").alias("n"))


def di_distribution(spark, d) -> DataFrame:
    """Spread of the number of products of a registration: interpolated and nearest-rank percentiles."""
    n = lines(spark, d).groupBy("registration_id").agg(F.count("*").alias("n"))
    return n.agg(
        F.count("*").alias("registrations"), F.min("n").alias("least"), F.max("n").alias("most"), F.sum("n").alias("total"),
        *[F.percentile("n", F.lit(q)).alias(f"p{int(q * 100)}") for q in (0.5, 0.9, 0.99)],
        F.expr("percentile_disc(0.9) within group (order by n)").cast("long").alias("near_p90"),
    )


def outliers(spark, d, least: int = 6) -> DataFrame:
    return lines(spark, d).groupBy("registration_id").agg(F.count("*").alias("n"), F.count_distinct("company_id").alias("companies")).where((F.col("n") > least) & (F.col("companies") > 1)).orderBy(F.col("n").desc(), "registration_id").limit(100)


def column_profile(spark, d) -> DataFrame:
    return profile(registrations(spark, d), ["registration_no", "approval_date", "expiry_date", "status", "owner_id"])


def registration_index(spark, d) -> DataFrame:
    """Devices and any in-scope flag of the registrations touched lately, counted over all their devices."""
    touched = lines(spark, d).where(F.col("updated_date") >= F.date_sub(F.lit(ASOF), 30)).select("registration_id").distinct()
    return lines(spark, d).join(touched, "registration_id", "left_semi").groupBy("registration_id").agg(F.count("*").alias("di_count"), F.bool_or("is_ivd").alias("has_cert"))


def anchored_products(spark, d) -> DataFrame:
    """Products of each registration by id or by its owner's number, each once: a union of equi-joins, counted."""
    r = registrations(spark, d).select(F.col("registration_id").alias("rid"), "owner_id")
    key = ["registration_id", "line", "part_id", "company_id", "quantity"]
    both = join_either(r, lines(spark, d).select(*key), [("rid", "registration_id"), ("owner_id", "part_id")])
    return both.groupBy("rid").agg(F.count("*").alias("n"), F.count_if(F.col("rid") == F.col("registration_id")).alias("by_id"), F.max("line").alias("last_line"))


def unregistered(spark, d) -> DataFrame:
    """Owners without any registration, and registrations without a product in scope: anti joins."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    owners = c.join(registrations(spark, d), F.col("id") == F.col("owner_id"), "left_anti").select(F.lit("owner").alias("kind"), "id")
    scope = lines(spark, d).where("is_ivd")
    bare = registrations(spark, d).join(scope, "registration_id", "left_anti").select(F.lit("registration").alias("kind"), F.col("registration_id").alias("id"))
    return owners.unionByName(bare)


def sequences(spark, d) -> DataFrame:
    """Sequence of each entity's changes in time."""
    order = [F.col("ts").asc_nulls_last(), F.col("event_id").asc()]
    return numbered(changes(spark, d), ["entity_id"], order, "event_seq").select("event_id", "entity_id", "kind", "event_seq")


def latest_changes(spark, d) -> DataFrame:
    return latest(changes(spark, d), ["entity_id", "kind"], [F.col("ts").desc_nulls_last(), F.col("event_id").desc()]).select("entity_id", "kind", "event_id", "k")


def dominant_products(spark, d) -> DataFrame:
    """The dominant product of each registration, in scope or not: newest first with unknown dates first, then the largest keys."""
    order = [F.col("updated_date").desc_nulls_first(), *[F.col(c).desc() for c in ("line", "part_id", "company_id", "quantity")]]
    return latest(lines(spark, d), ["registration_id"], order).select("registration_id", "part_id", "company_id", "is_ivd")


def backlog(spark, d) -> DataFrame:
    """Applied and rejected changes of each day, from two sources, added up."""
    e = changes(spark, d)
    a = e.where("kind <> 'cancel'").groupBy("day").agg(F.count("*").alias("applied"), F.lit(0).cast("long").alias("rejected"))
    b = e.where("kind = 'cancel'").groupBy("day").agg(F.lit(0).cast("long").alias("applied"), F.count("*").alias("rejected"))
    return a.unionByName(b).groupBy("day").agg(F.sum("applied").alias("applied"), F.sum("rejected").alias("rejected"))


def kind_shares(spark, d) -> DataFrame:
    """Entities by the set of their kinds, most frequent first."""
    sets = changes(spark, d).groupBy("entity_id").agg(F.array_join(F.sort_array(F.collect_set("kind")), ",").alias("kinds"))
    return sets.groupBy("kinds").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "kinds").limit(30)


def rolling_changes(spark, d) -> DataFrame:
    """Entities changed within 72 hours before the day."""
    upto = F.lit(DAY).cast("timestamp_ntz")
    e = changes(spark, d).where((F.col("ts") >= upto - F.expr("interval 72 hours")) & (F.col("ts") < upto))
    return e.groupBy("entity_id").agg(F.count("*").alias("n"), F.max("ts").cast("date").alias("last_day"))


def label_coverage(spark, d) -> DataFrame:
    """Documents of each source, those labelled, and the share."""
    t = table(spark, d, "documents").select("doc_id", "source")
    known = table(spark, d, "labels").select("doc_id", "quality").distinct()
    j = t.join(known, "doc_id", "left")
    return j.groupBy("source").agg(F.count("*").alias("total"), F.count("quality").alias("labelled"), (F.count("quality") / F.count("*")).alias("coverage"))


def first_turns(spark, d) -> DataFrame:
    t = table(spark, d, "conversations")
    return latest(t, ["conv_id"], [F.col("turn").asc(), F.col("role").asc(), F.col("text").asc()]).groupBy("role").agg(F.count("*").alias("n"))


_HIT = "from products left join companies using (company_id) where is_ivd and (name ilike '%al%' or company ilike '%al%') and category ilike 'standard%'"
_DAILY = ", daily as (select day, " + ", ".join(f"count(*) filter (where kind = '{k}') n_{k}" for k in ("approve", "renew", "cancel", "change")) + ", count(distinct entity_id) entities, count(distinct case when kind = 'cancel' then entity_id end) cancelled_entities, cast(count(*) filter (where kind = 'cancel') as double) / count(*) cancel_rate from changes group by 1)"
_SETS = ", sets as (select entity_id, string_agg(distinct kind, ',' order by kind) kinds, count(*) n from changes group by 1)"

QUERIES = {
    "q20_search_page": (search, f"{SQL} select registration_id, line, part_id, name, company, category {_HIT} order by updated_date desc nulls first, registration_id, line, part_id, company_id, quantity limit 25 offset 25"),
    "q20_search_total": (search_total, f"{SQL} select count(*) total {_HIT}"),
    "q15_daily_metrics": (daily_metrics, f"{SQL} {_DAILY} select * from daily"),
    "q19_dashboard": (dashboard, f"{SQL} {_DAILY} select cast(coalesce(sum(n_approve), 0) as bigint) approved, cast(coalesce(sum(n_cancel), 0) as bigint) cancelled, max(day) newest, arg_max(n_approve, day) newest_approved from daily, today where day between e - 13 and e"),
    "q19_ranked_days": (ranked_days, f"{SQL} {_DAILY} select day, n_approve from daily order by n_approve desc, day desc limit 10"),
    "tk7_expiring": (expiring, f"{SQL}, n as (select registration_id, count(*) n from products group by 1) select registration_no, expiry_date, coalesce(n, 0) n_products from registrations left join n using (registration_id), today where expiry_date between d and d + 90 and status <> 'cancelled'"),
    "q22_company_tracking": (company_tracking, f"{SQL}, j as (select p.*, coalesce(expiry_date < d, false) late, coalesce(status = 'cancelled', false) gone from products p join registrations using (registration_id), today) select company_id, any_value(company) company, any_value(country) country, count(*) total, count(*) filter (where late and not gone) expired, count(*) filter (where gone) cancelled, count(*) filter (where not late and not gone) active, max(updated_date) last_update from companies join j using (company_id) group by 1"),
    "q26_category_weeks": (category_weeks, f"{SQL} select cast(date_trunc('week', updated_date) as date) as week, category, count(*) n from products group by 1, 2"),
    "q55_di_distribution": (di_distribution, f"{SQL}, n as (select registration_id, count(*) n from products group by 1) select count(*) registrations, min(n) least, max(n) most, cast(sum(n) as bigint) total, cast(quantile_cont(n, 0.5) as double) p50, cast(quantile_cont(n, 0.9) as double) p90, cast(quantile_cont(n, 0.99) as double) p99, quantile_disc(n, 0.9) near_p90 from n"),
    "ag11_outliers": (outliers, f"{SQL} select registration_id, count(*) n, count(distinct company_id) companies from products group by 1 having count(*) > 6 and count(distinct company_id) > 1 order by n desc, registration_id limit 100"),
    "ag16_column_profile": (column_profile, f"{SQL} " + " union all ".join(f"select '{c}' field, count(*) total, count({c}) filled, cast(count(*) - count({c}) as double) / count(*) empty_rate from registrations" for c in ("registration_no", "approval_date", "expiry_date", "status", "owner_id"))),
    "q39_registration_index": (registration_index, f"{SQL} select registration_id, count(*) di_count, bool_or(is_ivd) has_cert from products where registration_id in (select registration_id from products, today where updated_date >= d - 30) group by 1"),
    "jn10_either_key": (
        anchored_products,
        f"""{SQL}, k as (select distinct registration_id, line, part_id, company_id, quantity from products),
u as (select r.registration_id rid, k.* from registrations r join k on r.registration_id = k.registration_id
  union select r.registration_id, k.* from registrations r join k on r.owner_id = k.part_id)
select rid, count(*) n, count(*) filter (where rid = registration_id) by_id, max(line) last_line from u group by 1""",
    ),
    "jn17_unregistered": (unregistered, f"{SQL} select 'owner' kind, c_custkey id from customer where not exists (select 1 from registrations where owner_id = c_custkey) union all select 'registration', registration_id from registrations r where not exists (select 1 from products p where p.registration_id = r.registration_id and is_ivd)"),
    "w6_sequences": (sequences, f"{SQL} select event_id, entity_id, kind, cast(row_number() over (partition by entity_id order by ts nulls last, event_id) as integer) event_seq from changes"),
    "w3_latest_changes": (latest_changes, f"{SQL} select entity_id, kind, event_id, k from (select *, row_number() over (partition by entity_id, kind order by ts desc nulls last, event_id desc) rn from changes) where rn = 1"),
    "w4_dominant_products": (dominant_products, f"{SQL} select registration_id, part_id, company_id, is_ivd from (select *, row_number() over (partition by registration_id order by updated_date desc nulls first, line desc, part_id desc, company_id desc, quantity desc) rn from products) where rn = 1"),
    "set1_backlog": (backlog, f"{SQL} select day, count(*) filter (where kind <> 'cancel') applied, count(*) filter (where kind = 'cancel') rejected from changes group by 1"),
    "ag20_kind_sets": (kind_shares, f"{SQL} {_SETS} select kinds, count(*) n from sets group by 1 order by n desc, kinds limit 30"),
    "fil7_rolling_changes": (rolling_changes, f"{SQL} select entity_id, count(*) n, cast(max(ts) as date) last_day from changes, today where ts >= e - interval 72 hour and ts < e group by 1"),
    "ag21_label_coverage": (label_coverage, "with l as (select distinct doc_id, quality from labels) select source, count(*) total, count(quality) labelled, cast(count(quality) as double) / count(*) coverage from documents left join l using (doc_id) group by 1"),
    "w9_first_turns": (first_turns, "select role, count(*) n from (select *, row_number() over (partition by conv_id order by turn, role, text) rn from conversations) where rn = 1 group by 1"),
}
