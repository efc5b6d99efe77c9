"""Reads of scores, signals and details: as-of rows, contexts, variants, timelines, lists and counters of the admin pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from certalog.functions import fields
from certalog.operators import tables
from certalog.plans.binding import ASOF, SQL, changes, companies, lines, products, registrations
from certalog.plans.scores import COMPANY_SQL, RISK_SQL, SIGNAL_SQL, START_SQL, TRACK_SQL, company_signal, newest, registration_signal, risk_score, track_signal
from certalog.session import table


def clamped(n: int, most: int = 100) -> int:
    """A page size within 1 and most."""
    return max(1, min(int(n), most))


def method_map(spark, d) -> DataFrame:
    """Methods that parts are mapped to, one row a line, with confidence and day."""
    l = table(spark, d, "lineitem")  # noqa: E741
    return l.select(
        F.col("l_partkey").alias("part_id"), F.concat(F.lit("M"), (F.col("l_suppkey") % 7).cast("string")).alias("method"), F.col("l_discount").alias("confidence"),
        F.col("l_shipdate").cast("date").alias("created"), F.struct(*[F.col(f"l_{c}").alias(c) for c in ("orderkey", "linenumber", "suppkey", "quantity")]).alias("id"),
    )


def part_methods(spark, d) -> DataFrame:
    """The method of each part: the surest, of equal ones the oldest."""
    return tables.latest(method_map(spark, d), ["part_id"], [F.col("confidence").desc(), F.col("created").asc(), F.col("id").asc()]).select("part_id", "method", "confidence", "created")


def score_log(spark, d) -> DataFrame:
    """Scores as they were computed: one row an event, of its entity and day."""
    return changes(spark, d).select("entity_id", F.col("day").alias("as_of"), F.col("ts").alias("computed"), "event_id", "value", "k")


def scores_asof(spark, d) -> DataFrame:
    """The score of each entity for the day if there is one, else its latest by day and time."""
    order = [(F.col("as_of") == F.lit(ASOF)).desc(), *[F.col(c).desc() for c in ("as_of", "computed", "event_id")]]
    return tables.latest(score_log(spark, d), ["entity_id"], order).select("entity_id", "as_of", "event_id", "value")


def top_asof(spark, d, n: int = 20) -> DataFrame:
    """The best scores of the newest day that has any, the last one of each entity."""
    s = score_log(spark, d)
    day = s.agg(F.max("as_of").alias("as_of"))
    last = tables.latest(s.join(F.broadcast(day), "as_of"), ["entity_id"], [F.col("computed").desc(), F.col("event_id").desc()])  # one row
    return last.orderBy(F.col("value").desc(), "entity_id").limit(clamped(n)).select("entity_id", "as_of", "value")


def admin_scores(spark, d) -> DataFrame:
    """Latest score of each entity, those of 50 or more of them: the level is looked at after the latest is chosen."""
    last = tables.latest(score_log(spark, d), ["entity_id"], [F.col("computed").desc(), F.col("event_id").desc()])
    return last.where("k >= 50").select("entity_id", "event_id", "k")


def product_scores(spark, d) -> DataFrame:
    """Risk of the registration of every product, null for a product of none."""
    s = risk_score(spark, d).select("registration_id", "lri_total", "risk_level")
    return lines(spark, d).select("registration_id", "line", "part_id").join(s, "registration_id", "left").groupBy("part_id").agg(F.max("lri_total").alias("worst"), F.count_if(F.col("risk_level").isin("HIGH", "CRITICAL")).alias("high"), F.count("*").alias("n"))


def signal_levels(spark, d) -> DataFrame:
    """One run of all signals: how many registrations, tracks and companies have each level."""
    each = {"registration": registration_signal, "track": track_signal, "company": company_signal}
    out = None
    for name, signal in each.items():
        one = signal(spark, d).groupBy("level").agg(F.count("*").alias("n")).select(F.lit(name).alias("entity"), "level", "n")
        out = one if out is None else out.unionByName(one)
    return out


def signal_context(spark, d) -> DataFrame:
    """Signals with the registration's number, its dominant product and that one's company, null where there is none."""
    order = [F.col("updated_date").desc_nulls_first(), *[F.col(c).desc() for c in ("line", "part_id", "company_id", "quantity")]]
    top = tables.latest(lines(spark, d), ["registration_id"], order).select("registration_id", "part_id", "company_id")
    s = scores_asof(spark, d).withColumnRenamed("entity_id", "registration_id")
    r = registrations(spark, d).select("registration_id", "registration_no")
    c = companies(spark, d).select("company_id", "company")
    return s.join(r, "registration_id", "left").join(top, "registration_id", "left").join(c, "company_id", "left").select("registration_id", "value", "registration_no", "part_id", "company")


def variants(spark, d) -> DataFrame:
    """Product variants: one row a line, of a registration by key, or by number alone where quantity is a multiple of seven."""
    legacy = F.col("quantity").cast("int") % 7 == 0
    number = F.concat(F.lit("REG"), F.lpad(F.col("registration_id").cast("string"), 10, "0"))
    return lines(spark, d).select(F.when(~legacy, F.col("registration_id")).alias("variant_of"), number.alias("registry_no"), "line", "part_id", "company_id", "quantity", "updated_date")


VARIANT_SQL = "variants as (select case when cast(quantity as integer) % 7 <> 0 then registration_id end variant_of, 'REG' || lpad(cast(registration_id as varchar), 10, '0') registry_no, line, part_id, company_id, quantity, updated_date from products)"


def registration_variants(spark, d) -> DataFrame:
    """Variants of every registration, anchored or by number: two equi-joins of parts that can't overlap."""
    r, v = registrations(spark, d).select("registration_id", "registration_no"), variants(spark, d)
    anchored = r.join(v.where("variant_of is not null"), F.col("registration_id") == F.col("variant_of"))
    legacy = r.join(v.where("variant_of is null"), F.col("registration_no") == F.col("registry_no"))
    return anchored.unionByName(legacy).groupBy("registration_id").agg(F.count("*").alias("n"), F.count_if(F.col("variant_of").isNull()).alias("legacy"), F.max("updated_date").alias("newest"))


def named_products(spark, d) -> DataFrame:
    """Products of each registration by key or by the number they carry, each once; a product carries the number of its part's registration."""
    r = registrations(spark, d).select(F.col("registration_id").alias("rid"), F.col("registration_no").alias("rno"))
    p = lines(spark, d).select("registration_id", F.concat(F.lit("REG"), F.lpad(F.col("part_id").cast("string"), 10, "0")).alias("reg_no"), "line", "part_id", "company_id", "quantity")
    both = tables.join_either(r, p, [("rid", "registration_id"), ("rno", "reg_no")])
    return both.groupBy("rid").agg(F.count("*").alias("n"), F.count_if(F.col("rid") == F.col("registration_id")).alias("by_key"))


def device_products(spark, d) -> DataFrame:
    """Devices with the registrations of their number and those one's products in scope: every device meets every product."""
    udi = variants(spark, d).where("variant_of is not null").select(F.col("registry_no"), F.col("part_id").alias("di"))
    r = registrations(spark, d).select("registration_id", F.col("registration_no").alias("registry_no"))
    p = lines(spark, d).where("is_ivd").select("registration_id", "part_id")
    return udi.join(r, "registry_no").join(p, "registration_id").groupBy("di").agg(F.count("*").alias("pairs"), F.count_distinct("part_id").alias("products"))


def pending_links(spark, d) -> DataFrame:
    """Registrations with the customer that they name: the owner, or for cancelled ones the one of the same number."""
    r = registrations(spark, d).withColumn("key", F.coalesce(F.when(F.coalesce(F.col("status") != "cancelled", F.lit(True)), F.col("owner_id")), F.col("registration_id")))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("segment"))
    return r.join(c, "key", "left").groupBy("segment").agg(F.count("*").alias("n"))


def anchor_context(spark, d) -> DataFrame:
    """Snapshots, events and the latest event of every registration."""
    e = changes(spark, d).groupBy(F.col("entity_id").alias("registration_id")).agg(F.count("*").alias("events"), F.max(F.struct("ts", "event_id", "kind")).alias("last"))
    s = table(spark, d, "lineitem").where("l_returnflag = 'R' and l_linestatus = 'O'").groupBy(F.col("l_orderkey").alias("registration_id")).agg(F.count("*").alias("snapshots"))
    wide = registrations(spark, d).join(e, "registration_id", "left").join(s, "registration_id", "left")
    return wide.select("registration_id", F.coalesce("snapshots", F.lit(0)).alias("snapshots"), F.coalesce("events", F.lit(0)).alias("events"), F.col("last.kind").alias("latest"))


def timelines(spark, d) -> DataFrame:
    """The ten newest changes of each entity, newest first."""
    order = [F.col("ts").desc(), F.col("event_id").desc()]
    return tables.numbered(changes(spark, d), ["entity_id"], order, "place").where("place <= 10").select("entity_id", "place", "event_id", "kind", "day")


def due(spark, d) -> DataFrame:
    """Whether the day's scores are still to be computed: none is there of the day."""
    return score_log(spark, d).agg((F.count_if(F.col("as_of") == F.lit(ASOF)) == 0).alias("due"), F.max("as_of").alias("last"))


def level_counts(spark, d) -> DataFrame:
    """All four levels with their counts in one text, zero where there is none."""
    n = risk_score(spark, d).agg(*[F.count_if(F.col("risk_level") == k).alias(k) for k in ("LOW", "MID", "HIGH", "CRITICAL")])
    pairs = F.map_from_arrays(F.array(*[F.lit(k) for k in n.columns]), F.array(*n.columns))
    return n.select(F.to_json(pairs).alias("distribution"))


def ratio(n, of):
    """n of `of` within 0 and 1, six decimals; 0 of nothing."""
    return F.when(of > 0, F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), n / of)), 6)).otherwise(0.0)


def value_added(spark, d) -> DataFrame:
    """Counts and rates of each day's runs."""
    n, good = F.count("*"), F.count_if(F.col("k") >= 50)
    return changes(spark, d).groupBy("day").agg(n.alias("records"), good.alias("matched"), ratio(good, n).alias("rate"), F.count_distinct(F.when(F.col("k") >= 50, F.col("entity_id"))).alias("entities"))


def optional_window(spark, d, since=None, upto=ASOF) -> DataFrame:
    """Changes by kind within a window whose ends may be left open: a condition is in the plan only if it is given."""
    e = changes(spark, d)
    e = e if since is None else e.where(F.col("day") >= F.lit(since))
    e = e if upto is None else e.where(F.col("day") <= F.lit(upto))
    return e.groupBy("kind").agg(F.count("*").alias("n"))


def sample_rows(spark, d, n: int = 25) -> DataFrame:
    """Any n products, always the same."""
    return products(spark, d).orderBy("registration_id", "line", "part_id", "company_id", "quantity").limit(n).select("registration_id", "line", "part_id", "name")


SORTS = {"updated": "updated_date", "name": "name", "quantity": "quantity"}


def sorted_page(spark, d, by: str = "updated", descending: bool = True, page: int = 1, size: int = 500) -> DataFrame:
    """A page in one of the orders of SORTS (by date if it is none), unknown values first when descending; a page has 1 to 100 rows."""
    c = F.col(SORTS.get(by, "updated_date"))
    order = [c.desc_nulls_first() if descending else c.asc_nulls_last(), *[F.col(x).desc() for x in ("registration_id", "line", "part_id", "company_id", "quantity")]]
    size = clamped(size)
    return products(spark, d).where("is_ivd").orderBy(*order).offset((max(1, page) - 1) * size).limit(size).select("registration_id", "line", "part_id", "company_id", "updated_date")


def newest_times(spark, d) -> DataFrame:
    """When a registration or its newest product was last touched, whichever is later."""
    p = tables.latest(lines(spark, d), ["registration_id"], newest()).select("registration_id", "updated_date")
    epoch = F.lit("1970-01-01").cast("date")
    wide = registrations(spark, d).join(p, "registration_id", "left")
    return wide.select("registration_id", F.greatest(F.coalesce("approval_date", epoch), F.coalesce("updated_date", epoch)).alias("touched"))


def status_trio(spark, d) -> DataFrame:
    """Products of each company by the word of their registration's state, and its share of domestic ones."""
    status = F.when(F.col("expiry_date") < F.lit(ASOF), "过期").when(F.col("status") == "cancelled", "Cancelled").otherwise(F.col("status"))
    r = registrations(spark, d).select("registration_id", fields.tracked_state(status).alias("state"), fields.active(status).alias("is_active"))
    return lines(spark, d).join(r, "registration_id").groupBy("company_id").agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("active", "expired", "cancelled")], F.count_if("is_active").alias("alive"))


def run_list(spark, d, page: int = 1, size: int = 40) -> DataFrame:
    """Runs that began by the day, newest first; those still open after 30 days are failed."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").cast("date").alias("started"), "o_orderstatus")
    late = F.col("started") < F.date_sub(F.lit(ASOF), 30)
    state = F.when((F.col("o_orderstatus") == "O") & late, "failed").when(F.col("o_orderstatus") == "O", "running").when(F.col("o_orderstatus") == "F", "success").otherwise("partial")
    return o.where(F.col("started") <= F.lit(ASOF)).orderBy(F.col("started").desc(), F.col("run_id").desc()).offset((page - 1) * size).limit(clamped(size)).select("run_id", "started", state.alias("state"))


def stale_runs(spark, d) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderstatus", F.col("o_orderdate").cast("date").alias("started"))
    late = (F.col("o_orderstatus") == "O") & (F.col("started") < F.date_sub(F.lit(ASOF), 30))
    return o.groupBy(F.when(late, "failed").otherwise(F.col("o_orderstatus")).alias("state")).agg(F.count("*").alias("n"))


def active_grants(spark, d) -> DataFrame:
    """Each owner's grant that holds on the day, the one that ends last, and the plan that follows from it and the balance."""
    day = F.col("o_orderdate").cast("date")
    g = table(spark, d, "orders").where((day <= F.lit(ASOF)) & (F.date_add(day, 365) > F.lit(ASOF)))
    last = g.groupBy(F.col("o_custkey").alias("owner_id")).agg(F.max(F.struct(F.date_add(day, 365).alias("ends"), F.col("o_orderkey").alias("grant_id"))).alias("g"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("owner_id"), "c_acctbal", "c_mktsegment")
    plan = F.when(F.col("c_mktsegment") == "MACHINERY", "admin").when(F.col("c_acctbal") >= 5000, "pro").when(F.col("g").isNotNull(), "grant").otherwise("free")
    return c.join(last, "owner_id", "left").select("owner_id", "g.grant_id", "g.ends", plan.alias("plan"))


def source_policies(spark, d) -> DataFrame:
    """Grade and priority of each supplier as a source: the grade as defined, else C; a priority below zero counts as 100."""
    s = table(spark, d, "supplier").select("s_suppkey", F.substring(F.lit("ABCDx"), (F.col("s_suppkey") % 5 + 1).cast("int"), F.lit(1)).alias("defined"), F.floor("s_acctbal").cast("int").alias("config"))
    return s.select("s_suppkey", fields.grade(F.col("defined")).alias("grade"), F.when(F.col("config") >= 0, F.col("config")).otherwise(100).alias("priority"))


def source_audit(spark, d) -> DataFrame:
    """Rows, keys and newest day of each source table."""
    def one(name, key, day):
        t = table(spark, d, name)
        return t.agg(F.lit(name).alias("source"), F.count("*").alias("n"), F.count_distinct(key).alias("keys"), F.max(F.col(day).cast("date")).alias("newest"))

    return one("orders", "o_custkey", "o_orderdate").unionByName(one("lineitem", "l_partkey", "l_shipdate")).unionByName(one("events", "user_id", "ts"))


def error_logs(spark, d, most: int = 50) -> DataFrame:
    """The last errors of each entity, oldest first, fifty at most."""
    e = tables.numbered(changes(spark, d).where("kind = 'cancel'"), ["entity_id"], [F.col("ts").desc(), F.col("event_id").desc()], "back").where(F.col("back") <= most)
    return e.groupBy("entity_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id"))), lambda x: x["event_id"].cast("string")), ",").alias("log"), F.count("*").cast("long").alias("n"))


def monthly_codes(spark, d) -> DataFrame:
    """One row a code and month, the newest value of it; months are checked for their form."""
    e = changes(spark, d).withColumn("month", F.date_format("day", "yyyy-MM")).where(fields.month_valid(F.col("month")))
    return tables.latest(e, ["k", "month"], [F.col("ts").desc(), F.col("event_id").desc()]).select("k", "month", "value", "event_id")


def daily_quota(spark, d, most: int = 3) -> DataFrame:
    """How often each entity exported on each day, and how many of these were over its quota."""
    return changes(spark, d).where("kind = 'change'").groupBy("entity_id", "day").agg(F.count("*").alias("used"), F.greatest(F.lit(0).cast("long"), F.count("*") - most).alias("refused"))


_KEYS = "registration_id, line, part_id, company_id, quantity"
_S = SIGNAL_SQL[len(RISK_SQL):]
_C = COMPANY_SQL[len(f"{RISK_SQL} {START_SQL}"):]
QUERIES = {
    "w2_part_methods": (part_methods, "select l_partkey part_id, method, confidence, created from (select l_partkey, 'M' || (l_suppkey % 7) method, l_discount confidence, cast(l_shipdate as date) created, row_number() over (partition by l_partkey order by l_discount desc, l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_quantity) rn from lineitem) where rn = 1"),
    "w5_scores_asof": (scores_asof, f"{SQL} select entity_id, day as_of, event_id, value from (select *, row_number() over (partition by entity_id order by (day = d) desc, day desc, ts desc, event_id desc) rn from changes, today) where rn = 1"),
    "q75_top_asof": (top_asof, f"{SQL} select entity_id, day as_of, value from (select *, row_number() over (partition by entity_id order by ts desc, event_id desc) rn from changes where day = (select max(day) from changes)) where rn = 1 order by value desc, entity_id limit 20"),
    "q5_admin_scores": (admin_scores, f"{SQL} select entity_id, event_id, k from (select *, row_number() over (partition by entity_id order by ts desc, event_id desc) rn from changes) where rn = 1 and k >= 50"),
    "q6_product_scores": (product_scores, f"{RISK_SQL} select part_id, max(lri_total) worst, count(*) filter (where risk_level in ('HIGH', 'CRITICAL')) high, count(*) n from products left join score using (registration_id) group by 1"),
    "q12_signal_levels": (signal_levels, f"{TRACK_SQL} {_C} {_S} select 'registration' entity, level, count(*) n from signal group by 2 union all select 'track', level, count(*) from track group by 2 union all select 'company', level, count(*) from company group by 2"),
    "jn6_signal_context": (signal_context, f"{SQL}, s as (select * from (select *, row_number() over (partition by entity_id order by (day = d) desc, day desc, ts desc, event_id desc) rn from changes, today) where rn = 1), t as (select * from (select *, row_number() over (partition by registration_id order by updated_date desc nulls first, line desc, part_id desc, company_id desc, quantity desc) rn from products) where rn = 1) select s.entity_id registration_id, s.value, r.registration_no, t.part_id, c.company from s left join registrations r on r.registration_id = s.entity_id left join t on t.registration_id = s.entity_id left join companies c on c.company_id = t.company_id"),
    "jn12_registration_variants": (registration_variants, f"{SQL}, {VARIANT_SQL} select r.registration_id, count(*) n, count(*) filter (where variant_of is null) legacy, max(updated_date) newest from registrations r join variants v on v.variant_of = r.registration_id or (v.variant_of is null and v.registry_no = r.registration_no) group by 1"),
    "jn11_named_products": (named_products, f"{SQL}, p as (select *, 'REG' || lpad(cast(part_id as varchar), 10, '0') reg_no from products), u as (select distinct r.registration_id rid, {', '.join('p.' + c.strip() for c in _KEYS.split(','))} from registrations r join p on p.registration_id = r.registration_id union select distinct r.registration_id rid, {', '.join('p.' + c.strip() for c in _KEYS.split(','))} from registrations r join p on p.reg_no = r.registration_no) select rid, count(*) n, count(*) filter (where rid = registration_id) by_key from u group by 1"),
    "jn8_device_products": (device_products, f"{SQL}, {VARIANT_SQL} select v.part_id di, count(*) pairs, count(distinct p.part_id) products from variants v join registrations r on r.registration_no = v.registry_no join products p on p.registration_id = r.registration_id and p.is_ivd where variant_of is not null group by 1"),
    "jn9_pending_links": (pending_links, f"{SQL} select c_mktsegment segment, count(*) n from registrations left join customer on c_custkey = coalesce(case when coalesce(status <> 'cancelled', true) then owner_id end, registration_id) group by 1"),
    "q25_anchor_context": (anchor_context, f"{SQL}, e as (select entity_id, count(*) n, arg_max(kind, (ts, event_id)) latest from changes group by 1), s as (select registration_id, count(*) n from snapshots group by 1) select r.registration_id, coalesce(s.n, 0) snapshots, coalesce(e.n, 0) events, latest from registrations r left join e on e.entity_id = r.registration_id left join s on s.registration_id = r.registration_id"),
    "q23_timelines": (timelines, f"{SQL} select entity_id, cast(rn as integer) place, event_id, kind, day from (select *, row_number() over (partition by entity_id order by ts desc, event_id desc) rn from changes) where rn <= 10"),
    "q2_due": (due, f"{SQL} select count(*) filter (where day = d) = 0 due, max(day) as last from changes, today"),
    "ag17_level_counts": (level_counts, f"{RISK_SQL} select '{{\"LOW\":' || count(*) filter (where risk_level = 'LOW') || ',\"MID\":' || count(*) filter (where risk_level = 'MID') || ',\"HIGH\":' || count(*) filter (where risk_level = 'HIGH') || ',\"CRITICAL\":' || count(*) filter (where risk_level = 'CRITICAL') || '}}' distribution from score"),
    "q16_value_added": (value_added, f"{SQL} select day, count(*) records, count(*) filter (where k >= 50) matched, round(cast(count(*) filter (where k >= 50) as double) / count(*), 6) rate, count(distinct case when k >= 50 then entity_id end) entities from changes group by 1"),
    "fil13_optional_window": (optional_window, f"{SQL} select kind, count(*) n from changes, today where day <= d group by 1"),
    "tk9_sample": (sample_rows, f"{SQL} select registration_id, line, part_id, name from products order by {_KEYS} limit 25"),
    "tk2_sorted_page": (sorted_page, f"{SQL} select registration_id, line, part_id, company_id, updated_date from products where is_ivd order by updated_date desc nulls first, {_KEYS.replace(',', ' desc,')} desc limit 100"),
    "prj2_newest_times": (newest_times, f"{SQL} select r.registration_id, greatest(coalesce(approval_date, date '1970-01-01'), coalesce(max(updated_date), date '1970-01-01')) touched from registrations r left join products p using (registration_id) group by r.registration_id, approval_date"),
    "fil9_status_trio": (status_trio, f"{SQL}, r as (select registration_id, case when expiry_date < d then '过期' when status = 'cancelled' then 'Cancelled' else status end s from registrations, today) select company_id, count(*) filter (where coalesce(s, '') not in ('过期', 'Cancelled')) active, count(*) filter (where s = '过期') expired, count(*) filter (where s = 'Cancelled') cancelled, count(*) filter (where coalesce(s, '') not in ('过期', 'Cancelled')) alive from products join r using (registration_id) group by 1"),
    "q71_run_list": (run_list, f"select o_orderkey run_id, cast(o_orderdate as date) started, case when o_orderstatus = 'O' and cast(o_orderdate as date) < date '{ASOF}' - 30 then 'failed' when o_orderstatus = 'O' then 'running' when o_orderstatus = 'F' then 'success' else 'partial' end state from orders where cast(o_orderdate as date) <= date '{ASOF}' order by 2 desc, 1 desc limit 40"),
    "up17_stale_runs": (stale_runs, f"select case when o_orderstatus = 'O' and cast(o_orderdate as date) < date '{ASOF}' - 30 then 'failed' else o_orderstatus end state, count(*) n from orders group by 1"),
    "q76_active_grants": (active_grants, f"with g as (select o_custkey, o_orderkey, cast(o_orderdate as date) + 365 ends, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) rn from orders where cast(o_orderdate as date) <= date '{ASOF}' and cast(o_orderdate as date) + 365 > date '{ASOF}') select c_custkey owner_id, o_orderkey grant_id, ends, case when c_mktsegment = 'MACHINERY' then 'admin' when c_acctbal >= 5000 then 'pro' when o_orderkey is not null then 'grant' else 'free' end plan from customer left join (select * from g where rn = 1) on o_custkey = c_custkey"),
    "q67_source_policies": (source_policies, "select s_suppkey, case s_suppkey % 5 when 0 then 'A' when 1 then 'B' when 3 then 'D' else 'C' end grade, cast(case when floor(s_acctbal) >= 0 then floor(s_acctbal) else 100 end as integer) priority from supplier"),
    "q54_source_audit": (source_audit, "select 'orders' source, count(*) n, count(distinct o_custkey) keys, max(cast(o_orderdate as date)) newest from orders union all select 'lineitem', count(*), count(distinct l_partkey), max(cast(l_shipdate as date)) from lineitem union all select 'events', count(*), count(distinct user_id), max(cast(ts as date)) from events"),
    "up27_error_logs": (error_logs, f"{SQL} select entity_id, string_agg(cast(event_id as varchar), ',' order by ts, event_id) log, count(*) n from (select *, row_number() over (partition by entity_id order by ts desc, event_id desc) back from changes where kind = 'cancel') where back <= 50 group by 1"),
    "q51_monthly_codes": (monthly_codes, f"{SQL} select k, strftime(day, '%Y-%m') as month, value, event_id from (select *, row_number() over (partition by k, strftime(day, '%Y-%m') order by ts desc, event_id desc) rn from changes) where rn = 1"),
    "up26_daily_quota": (daily_quota, f"{SQL} select entity_id, day, count(*) used, greatest(0, count(*) - 3) refused from changes where kind = 'change' group by 1, 2"),
}
