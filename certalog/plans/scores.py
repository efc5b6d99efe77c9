"""Lifecycle risk, start dates and signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from certalog.functions import fields as fn
from certalog.functions.text import bin_score, ladder
from certalog.operators.tables import latest
from certalog.operators.matching import best_rounded
from certalog.plans.binding import ASOF, SQL, changes, companies, lines, products, registrations, snapshots

#: Scores by the first upper end that holds the value (fixed values: days to expiry, renewals, competitors, newcomers).
TTE = ((0, 60), (30, 45), (90, 30), (180, 18), (365, 8), (99999, 0))
RENEWALS = ((0, 25), (1, 15), (2, 8), (99999, 0))
DENSITY = ((3, 0), (10, 10), (30, 20), (100, 30), (999999, 40))
GROWTH = ((0, 0), (5, 6), (20, 14), (80, 22), (999999, 28))
#: Risk levels by the least norm, and the largest total that norms are shares of (fixed values).
LEVELS = ((40.0, "MID"), (60.0, "HIGH"), (80.0, "CRITICAL"))
TOP = 130.0
_ORDER_SQL = "updated_date desc nulls last, line, part_id, company_id, quantity"


def _rows(pairs, value: str) -> str:
    return "case " + " ".join(f"when {value} <= {u} then {s}" for u, s in pairs) + " else 0 end"


def newest() -> list:
    """Newest product first; the rest of the columns break ties."""
    return [F.col("updated_date").desc_nulls_last(), *[F.col(c).asc() for c in ("line", "part_id", "company_id", "quantity")]]


def representatives(spark, d) -> DataFrame:
    """The newest product in scope of each registration."""
    return latest(products(spark, d).where("is_ivd"), ["registration_id"], newest()).select("registration_id", "category", "methodology", "company_id")


def risk_score(spark, d) -> DataFrame:
    """One row a registration: days to expiry, renewals, competition and growth in its methodology and track, scored and levelled."""
    rep = representatives(spark, d)
    regs = registrations(spark, d)
    dim = regs.join(rep, "registration_id", "left")
    since = F.date_sub(F.lit(ASOF), 365)
    by = ["methodology", "category"]
    crowd = dim.where("methodology is not null").groupBy(*by).agg(
        F.count("*").alias("competitive_count"), F.count_if(F.col("approval_date").between(since, F.lit(ASOF))).alias("gp_new_12m")  # one row a registration
    )
    renewals = changes(spark, d).where("kind = 'renew'").groupBy(F.col("entity_id").alias("registration_id")).agg(F.count("*").alias("renewals"))
    tte = F.datediff("expiry_date", F.lit(ASOF))
    wide = dim.join(crowd, by, "left").join(renewals, "registration_id", "left").select(
        "registration_id", tte.alias("tte_days"), *by,
        *[F.coalesce(c, F.lit(0)).cast("long").alias(n) for c, n in (("renewals", "renewal_count"), ("competitive_count", "competitive_count"), ("gp_new_12m", "gp_new_12m"))],
    )
    scored = wide.withColumns(
        {
            "tte_score": bin_score(F.coalesce("tte_days", F.lit(99999)), TTE),
            "rh_score": bin_score(F.col("renewal_count"), RENEWALS),
            "cd_score": bin_score(F.col("competitive_count"), DENSITY),
            "gp_score": bin_score(F.col("gp_new_12m"), GROWTH),
        }
    ).withColumn("lri_total", F.expr("tte_score + rh_score + cd_score + gp_score"))
    norm = F.col("lri_total") / TOP * 100.0
    return scored.withColumn("lri_norm", norm).withColumn("risk_level", ladder(norm, LEVELS, "LOW"))


RISK_SQL = f"""{SQL},
rep as (select * from (select *, row_number() over (partition by registration_id order by {_ORDER_SQL}) rn from products where is_ivd) where rn = 1),
dim as (select r.*, p.category, p.methodology, p.company_id from registrations r left join rep p using (registration_id)),
crowd as (select methodology, category, count(distinct registration_id) competitive_count,
  count(distinct case when approval_date between d - 365 and d then registration_id end) gp_new_12m
  from dim, today where methodology is not null group by 1, 2),
renewals as (select entity_id registration_id, count(*) renewals from changes where kind = 'renew' group by 1),
wide as (select registration_id, cast(date_diff('day', d, expiry_date) as integer) tte_days, dim.methodology, dim.category,
  cast(coalesce(renewals, 0) as bigint) renewal_count, cast(coalesce(competitive_count, 0) as bigint) competitive_count,
  cast(coalesce(gp_new_12m, 0) as bigint) gp_new_12m
  from dim left join crowd on dim.methodology = crowd.methodology and dim.category = crowd.category
  left join renewals using (registration_id), today),
scored as (select *, cast({_rows(TTE, 'coalesce(tte_days, 99999)')} as integer) tte_score, cast({_rows(RENEWALS, 'renewal_count')} as integer) rh_score,
  cast({_rows(DENSITY, 'competitive_count')} as integer) cd_score, cast({_rows(GROWTH, 'gp_new_12m')} as integer) gp_score from wide),
risk as (select *, cast(tte_score + rh_score + cd_score + gp_score as integer) lri_total,
  cast(tte_score + rh_score + cd_score + gp_score as double) / {TOP}::double * 100.0::double lri_norm from scored),
score as (select *, case when lri_norm >= 80 then 'CRITICAL' when lri_norm >= 60 then 'HIGH' when lri_norm >= 40 then 'MID' else 'LOW' end risk_level from risk)
"""


def risk_top(spark, d, n: int = 50) -> DataFrame:
    return risk_score(spark, d).where("methodology is not null").orderBy(F.col("lri_norm").desc_nulls_last(), "registration_id").limit(n).select(
        "registration_id", "lri_norm", "risk_level", "methodology", "category"
    )


def risk_map(spark, d, n: int = 200) -> DataFrame:
    """Scores by methodology and category, null a group of its own: how many, how many high, mean norm and most new products."""
    each = risk_score(spark, d).groupBy("methodology", "category").agg(
        F.count("*").alias("total_count"), F.count_if(F.col("risk_level").isin("HIGH", "CRITICAL")).alias("high_count"),
        best_rounded(F.coalesce(F.avg("lri_norm"), F.lit(0.0)), 9).alias("avg_norm"), F.coalesce(F.max("gp_new_12m"), F.lit(0)).alias("max_gp"),
    )
    return each.orderBy(*[F.col(c).desc() for c in ("high_count", "avg_norm", "total_count")], F.asc_nulls_last("category"), F.asc_nulls_last("methodology")).limit(n)


def risk_distribution(spark, d) -> DataFrame:
    return risk_score(spark, d).groupBy("risk_level").agg(F.count("*").alias("n"))


SOURCES = ("registrations.approval_date", "nmpa_snapshots.first_observed", "registration_events.first_create_issue_approve", "products.approved_date", "registrations.created_at")


def start_dates(spark, d) -> DataFrame:
    """Start of each registration and where it is from: approval, else first snapshot, first approve event, first product approval, creation.

    Snapshots, events and products count up to the day; a chosen date after the day is missing and nothing stands in for it.
    """
    first = lambda df, key, day, name: df.where(F.col(day) <= F.lit(ASOF)).groupBy(F.col(key).alias("registration_id")).agg(F.min(day).alias(name))
    wide = registrations(spark, d)
    for part in (
        first(snapshots(spark, d), "registration_id", "snapshot_date", "snapshot_day"),
        first(changes(spark, d).where("kind = 'approve'"), "entity_id", "day", "event_day"),
        first(lines(spark, d), "registration_id", "approved_date", "product_day"),
    ):
        wide = wide.join(part, "registration_id", "left")
    columns = ("approval_date", "snapshot_day", "event_day", "product_day", "created_date")
    chosen = F.coalesce(*columns)
    source = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(n)) for c, n in zip(columns, SOURCES)])
    late = chosen > F.lit(ASOF)
    return wide.select("registration_id", F.when(~late, chosen).alias("start_date"), F.when(late, F.lit("missing")).otherwise(source).alias("source"))


START_SQL = f""",
sn as (select registration_id, min(snapshot_date) snapshot_day from snapshots, today where snapshot_date <= d group by 1),
ev as (select entity_id registration_id, min(day) event_day from changes, today where kind = 'approve' and day <= d group by 1),
pr as (select registration_id, min(approved_date) product_day from products, today where approved_date <= d group by 1),
chosen as (select registration_id, coalesce(approval_date, snapshot_day, event_day, product_day, created_date) c,
  case when approval_date is not null then '{SOURCES[0]}' when snapshot_day is not null then '{SOURCES[1]}' when event_day is not null then '{SOURCES[2]}'
    when product_day is not null then '{SOURCES[3]}' else '{SOURCES[4]}' end s, d
  from registrations left join sn using (registration_id) left join ev using (registration_id) left join pr using (registration_id), today),
starts as (select registration_id, case when c <= d then c end start_date, case when c > d then 'missing' else s end source from chosen)
"""


def start_audit(spark, d) -> DataFrame:
    """How often each source gives the start date, the share of all registrations, and the three first numbers of each as samples."""
    s = start_dates(spark, d).join(registrations(spark, d).select("registration_id", "registration_no"), "registration_id")
    n = s.groupBy("source").agg(F.count("*").alias("n"))
    first = s.withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy("registration_no"))).where("r <= 3")  # three a task before the exchange
    samples = first.groupBy("source").agg(F.array_join(F.sort_array(F.collect_list("registration_no")), ",").alias("samples"))
    return n.join(samples, "source").select("source", "n", "samples", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("rate"))


def anchors(spark, d) -> DataFrame:
    """The one track and company that each registration is counted for: those of its newest product in scope."""
    return representatives(spark, d).select("registration_id", "category", "company_id")


def registration_signal(spark, d, asked: DataFrame | None = None) -> DataFrame:
    """Level by days to expiry, one step down if renewed in the year to the day, one step up in a track of 300 active registrations or more.

    asked: only the registrations that it has (registration_id); density counts all.
    """
    own = anchors(spark, d)
    regs = registrations(spark, d)
    density = regs.where(fn.active(F.col("status"))).join(own, "registration_id").groupBy("category").agg(F.count("*").alias("density"))
    year = F.col("day").between(F.date_sub(F.lit(ASOF), 365), F.lit(ASOF))
    renewed = changes(spark, d).where((F.col("kind") == "renew") & year).select(F.col("entity_id").alias("registration_id")).distinct().withColumn("renewed", F.lit(True))
    if asked is not None:
        regs = regs.join(asked, "registration_id", "left_semi")
    wide = regs.join(own, "registration_id", "left").join(density, "category", "left").join(renewed, "registration_id", "left")
    days = F.datediff("expiry_date", F.lit(ASOF))
    level, score = fn.registration_ladder(days, F.coalesce("renewed", F.lit(False)), F.coalesce("density", F.lit(0)))
    return wide.select(
        "registration_id", days.alias("days"), F.coalesce("density", F.lit(0)).cast("long").alias("density"), F.coalesce("renewed", F.lit(False)).alias("renewed"),
        level.alias("level"), score.alias("score"), fn.lifecycle_summary(days, F.coalesce("renewed", F.lit(False)), F.coalesce("density", F.lit(0)).cast("long")).alias("summary"),
    )


SIGNAL_SQL = f"""{RISK_SQL},
density as (select category, count(*) density from dim where (status is null or status = 'active') and category is not null group by 1),
renewed as (select distinct entity_id registration_id from changes, today where kind = 'renew' and day between d - 365 and d),
steps as (select dim.registration_id, cast(date_diff('day', d, expiry_date) as integer) as days, cast(coalesce(density, 0) as bigint) density,
  renewed.registration_id is not null renewed,
  case when expiry_date is null then 1 when date_diff('day', d, expiry_date) <= 90 then 2 when date_diff('day', d, expiry_date) <= 180 then 1 else 0 end b
  from dim left join density on dim.category = density.category left join renewed on dim.registration_id = renewed.registration_id, today),
final as (select *, least(2, greatest(0, b - renewed::int) + (density >= 300)::int) s from steps),
signal as (select registration_id, days, density, renewed, case s when 0 then 'low' when 1 then 'medium' else 'high' end as level,
  cast(case s when 0 then 25 when 1 then 55 else 85 end as double) score,
  concat_ws('; ', 'expiry:' || coalesce(days || 'd', 'unknown'), 'renew:' || cast(renewed as varchar), 'density:' || density) summary from final)"""


def distribution(counts: DataFrame, keys: list[str], label: str, n: str) -> DataFrame:
    """(keys, dist): the shares of the labels as 'label:12.3%', largest first, ties by label, joined by ', '; 'missing:100%' if nothing is counted.

    Halves of a tenth go to the even neighbour, as the shares' own doubles lie.
    """
    total = F.sum(n).over(Window.partitionBy(*keys))
    tenths = F.rint(F.col(n) / total * 100 * 10).cast("long")
    told_share = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))
    item = F.struct((-F.col(n)).alias("o"), F.col(label).alias("label"), told_share.alias("p"))
    told = F.transform(F.array_sort(F.collect_list(F.when(F.col("_t") > 0, F.col("item")))), lambda x: F.concat(x["label"], F.lit(":"), x["p"], F.lit("%")))
    each = counts.withColumns({"_t": total}).withColumn("item", F.when(F.col("_t") > 0, item))
    return each.groupBy(*keys).agg(F.coalesce(F.nullif(F.array_join(told, ", "), F.lit("")), F.lit("missing:100%")).alias("dist"))


def track_signal(spark, d) -> DataFrame:
    """Active registrations of each track, those that began in the last year, domestic makers, where starts are from, level and score."""
    rep = anchors(spark, d).join(companies(spark, d), "company_id", "left")
    wide = registrations(spark, d).where(fn.active(F.col("status"))).join(rep, "registration_id").join(start_dates(spark, d), "registration_id")
    new = F.coalesce(F.col("start_date").between(F.date_sub(F.lit(ASOF), 365), F.lit(ASOF)), F.lit(False))
    parts = wide.groupBy("category", "source").agg(F.count("*").alias("n"), F.count_if(new).alias("fresh"), F.count_if(fn.domestic(F.col("country"))).alias("home"))
    total = parts.groupBy("category").agg(F.sum("n").alias("active"), F.sum("fresh").alias("fresh"), F.sum("home").alias("home"))
    level, score = fn.track_ladder(F.col("active"), F.col("fresh") / F.col("active"))
    out = total.join(distribution(parts, ["category"], "source", "n"), "category")
    return out.select("category", "active", "fresh", (F.col("fresh") / F.col("active")).alias("new_rate"), (F.col("home") / F.col("active")).alias("domestic_ratio"), "dist", level.alias("level"), score.alias("score"))


def company_signal(spark, d) -> DataFrame:
    """New registrations and tracks of every company in the year to the day, registrations with a cancel event, slope, level and score.

    A registration counts for its anchor company alone; companies without any are zero.
    """
    year = lambda c: F.col(c).between(F.date_sub(F.lit(ASOF), 365), F.lit(ASOF))
    gone = changes(spark, d).where((F.col("kind") == "cancel") & year("day")).select(F.col("entity_id").alias("registration_id")).distinct().withColumn("gone", F.lit(True))
    own = anchors(spark, d).join(start_dates(spark, d), "registration_id").join(gone, "registration_id", "left")
    new = F.coalesce(year("start_date"), F.lit(False))
    each = own.groupBy("company_id").agg(F.count_if(new).alias("new"), F.count_distinct(F.when(new, F.col("category"))).alias("tracks"), F.count_if("gone").alias("cancels"))
    wide = companies(spark, d).join(each, "company_id", "left").na.fill(0, ["new", "tracks", "cancels"])
    level, score = fn.company_ladder(F.col("new"), F.col("tracks"))
    return wide.select("company_id", "new", "tracks", "cancels", F.round((F.col("new") - F.col("cancels")) / 12, 4).alias("slope"), level.alias("level"), score.alias("score"))


_TENTHS = "cast(round_even({n} / t * 100 * 10, 0) as bigint)"
DIST = lambda keys, n, label, source: f"select {keys}, coalesce(string_agg({label} || ':' || ({_TENTHS.format(n=n)} // 10) || '.' || ({_TENTHS.format(n=n)} % 10) || '%', ', ' order by {n} desc, {label}) filter (where t > 0), 'missing:100%') dist from (select *, sum({n}) over (partition by {keys}) t from {source}) group by {keys}"
TRACK_SQL = f"""{RISK_SQL} {START_SQL},
w as (select dim.category, s.source, coalesce(s.start_date between d - 365 and d, false) fresh, c.country from dim join starts s using (registration_id)
  left join companies c on dim.company_id = c.company_id, today where (status is null or status = 'active') and dim.category is not null),
parts as (select category, source, count(*) n from w group by 1, 2),
dist as ({DIST('category', 'n', 'source', 'parts')}),
total as (select category, count(*) active, count(*) filter (where fresh) fresh, count(*) filter (where lower(trim(country)) = 'cn' or lower(country) like '%china%') home from w group by 1),
track as (select category, active, fresh, cast(fresh as double) / active new_rate, cast(home as double) / active domestic_ratio, dist,
  case when active > 200 or cast(fresh as double) / active > 0.5 then 'red' when active >= 50 or cast(fresh as double) / active >= 0.2 then 'moderate' else 'blue' end as level,
  case when active > 200 or cast(fresh as double) / active > 0.5 then 85.0::double when active >= 50 or cast(fresh as double) / active >= 0.2 then 55.0::double else 25.0::double end score
  from total join dist using (category))"""
COMPANY_SQL = f"""{RISK_SQL} {START_SQL},
g as (select distinct entity_id registration_id from changes, today where kind = 'cancel' and day between d - 365 and d),
o as (select company_id, category, coalesce(start_date between d - 365 and d, false) n, g.registration_id is not null gone
  from rep join starts using (registration_id) left join g using (registration_id), today),
e as (select company_id, count(*) filter (where n) n, count(distinct case when n then category end) t, count(*) filter (where gone) g from o group by 1),
company as (select company_id, coalesce(n, 0) as new, coalesce(t, 0) tracks, coalesce(g, 0) cancels, round(cast(coalesce(n, 0) - coalesce(g, 0) as double) / 12, 4) slope,
  case when coalesce(n, 0) >= 30 or coalesce(t, 0) >= 3 then 'strong' when coalesce(n, 0) >= 10 or coalesce(t, 0) >= 1 then 'medium_growth' else 'weak' end as level,
  case when coalesce(n, 0) >= 30 or coalesce(t, 0) >= 3 then 85.0::double when coalesce(n, 0) >= 10 or coalesce(t, 0) >= 1 then 55.0::double else 25.0::double end score
  from companies left join e using (company_id))"""


def top_risk(spark, d, n: int = 20) -> DataFrame:
    """Registrations by score, nearest expiry first; of score above zero."""
    s = registration_signal(spark, d).where("score > 0")
    return s.orderBy(F.col("score").desc(), F.col("days").asc_nulls_last(), "registration_id").limit(n).select("registration_id", "level", "score", "days", "summary")


def top_tracks(spark, d, n: int = 20) -> DataFrame:
    return track_signal(spark, d).orderBy(F.col("score").desc(), F.col("active").desc(), "category").limit(n).select("category", "level", "score", "active", "new_rate")


def top_growth(spark, d, n: int = 20) -> DataFrame:
    """Companies by growth; the entity is text at the source, so the key is cast before the join."""
    s = company_signal(spark, d).withColumn("entity_id", F.col("company_id").cast("string")).drop("company_id")
    named = s.join(companies(spark, d).withColumn("entity_id", F.col("company_id").cast("string")), "entity_id")
    return named.orderBy(F.col("score").desc(), F.col("new").desc(), "company_id").limit(n).select("entity_id", "company", "level", "score", "new", "slope")


QUERIES = {
    "q1_risk_score": (risk_score, f"{RISK_SQL} select * from score"),
    "q3_risk_top": (risk_top, f"{RISK_SQL} select registration_id, lri_norm, risk_level, methodology, category from score where methodology is not null order by lri_norm desc nulls last, registration_id limit 50"),
    "q4_risk_map": (risk_map, f"{RISK_SQL} select methodology, category, count(*) total_count, count(*) filter (where risk_level in ('HIGH', 'CRITICAL')) high_count, round_even(coalesce(avg(lri_norm), 0) * 1e9, 0) / 1e9 avg_norm, coalesce(max(gp_new_12m), 0) max_gp from score group by 1, 2 order by high_count desc, avg_norm desc, total_count desc, category nulls last, methodology nulls last limit 200"),
    "q17_risk_distribution": (risk_distribution, f"{RISK_SQL} select risk_level, count(*) n from score group by 1"),
    "q7_start_dates": (start_dates, f"{SQL} {START_SQL} select * from starts"),
    "q8_start_sources": (lambda s, d: start_dates(s, d).groupBy("source").agg(F.count("*").alias("n")), f"{SQL} {START_SQL} select source, count(*) n from starts group by 1"),
    "q8_start_audit": (start_audit, f"{SQL} {START_SQL}, a as (select *, row_number() over (partition by source order by registration_no) r from starts join registrations using (registration_id)) select source, count(*) n, string_agg(registration_no, ',' order by registration_no) filter (where r <= 3) samples, round(cast(count(*) as double) / (select count(*) from a), 6) rate from a group by 1"),
    "q9_registration_signal": (registration_signal, f"{SIGNAL_SQL} select * from signal"),
    "q10_track_signal": (track_signal, f"{TRACK_SQL} select * from track"),
    "q11_company_signal": (company_signal, f"{COMPANY_SQL} select * from company"),
    "q13_top_risk": (top_risk, f"{SIGNAL_SQL} select registration_id, level, score, days, summary from signal where score > 0 order by score desc, days nulls last, registration_id limit 20"),
    "q13_top_tracks": (top_tracks, f"{TRACK_SQL} select category, level, score, active, new_rate from track order by score desc, active desc, category limit 20"),
    "q13_top_growth": (top_growth, f"{COMPANY_SQL} select cast(company_id as varchar) entity_id, company, level, score, new, slope from company join companies using (company_id) order by score desc, new desc, company_id limit 20"),
}
