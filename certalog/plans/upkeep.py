"""Upkeep of the tables: partial and key-wise merges, archives, rollbacks, fills, reclassification, audits and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from certalog.functions import classifier, fields
from certalog.functions.text import once
from certalog.operators import tables
from certalog.plans.binding import ASOF, SQL, changes, lines, products, registrations
from certalog.plans.ingest import COLUMNS, CODES, MAPPED_SQL, OUTCOME_SQL, RAW_SQL, _case, _mapped, _class_sql, _DEVICE, mapped_records, outcomes, raw_rows
from certalog.plans.reads import VARIANT_SQL, ratio, variants
from certalog.plans.scores import newest
from certalog.session import spread, table

_CUT = "1998-06-01"


def active_merge(spark, d) -> DataFrame:
    """Owners' newest registrations after the cut merged into those before, where the old one is active; closed ones stay beside the new."""
    r = registrations(spark, d)
    order = [F.col("created_date").desc(), F.col("registration_id").desc()]
    pick = lambda x: tables.latest(x, ["owner_id"], order).select("owner_id", "registration_id", "status")
    old, new = pick(r.where(F.col("created_date") < F.lit(_CUT))), pick(r.where(F.col("created_date") >= F.lit(_CUT)))
    alive = F.coalesce(F.col("status") == "active", F.lit(False))
    return old.where(~alive).unionByName(tables.merge(old.where(alive), new, ["owner_id"], "overwrite"))


def replaced_params(spark, d) -> DataFrame:
    """Parameters by part and code where those that came in anew replace all of their key: delete by key, insert."""
    p = lines(spark, d)
    make = lambda x: x.groupBy("part_id", F.when(F.col("is_ivd"), "ivd").otherwise("other").alias("code"))
    old = make(p.where(F.col("updated_date") < F.lit(ASOF))).agg(F.count("*").alias("n"), F.max("updated_date").alias("newest"))
    new = make(p.where(F.col("updated_date") >= F.lit(ASOF))).agg(F.count("*").alias("n"), F.max("updated_date").alias("newest"))
    return tables.replace_part(old, new, ["part_id", "code"])


def restored(spark, d) -> DataFrame:
    """Archived products that come back: those whose registration and whose part nobody has taken since, by two anti-joins."""
    p = lines(spark, d)
    kept, gone = tables.archive(p, ~F.col("is_ivd"))
    taken = kept.where(F.col("updated_date") >= F.lit(ASOF))
    back = gone.join(taken.select("registration_id").distinct(), "registration_id", "left_anti").join(taken.select("part_id").distinct(), "part_id", "left_anti")
    return back.select("registration_id", "line", "part_id", "company_id", "quantity")


def archive_counts(spark, d) -> DataFrame:
    """Whether an archive run is sound: the rows of the tables that it leaves and fills, against those before, by count and content.

    What is left is told by the scope, what is taken by the return flag that the archive's source goes by.
    """
    p = lines(spark, d)
    flag = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("registration_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part_id"), "l_returnflag").where("l_returnflag = 'R'")
    taken = p.join(flag.select("registration_id", "line", "part_id").distinct(), ["registration_id", "line", "part_id"], "left_semi").select(*p.columns)
    kept, _ = tables.archive(p, ~F.col("is_ivd"))
    return tables.checked_archive(kept, taken, p)


def rollback(spark, d) -> DataFrame:
    """What a rollback of one run would delete, leaves first: products, registrations, owners left without any."""
    run = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("registration_id"), F.col("o_custkey").alias("owner_id"))
    rest = table(spark, d, "orders").where("o_orderpriority <> '1-URGENT'").select(F.col("o_custkey").alias("owner_id"))
    leaves = lines(spark, d).join(run, "registration_id", "left_semi")
    roots = run.select("owner_id").distinct().join(rest, "owner_id", "left_anti")
    count = lambda name, df: df.agg(F.lit(name).alias("part"), F.count("*").alias("n"))
    return count("products", leaves).unionByName(count("registrations", run)).unionByName(count("owners", roots))


def merged_candidates(spark, d) -> DataFrame:
    """Candidates of each registration's queue entry: every source, value and day once, oldest first."""
    p = lines(spark, d).select("registration_id", F.struct("updated_date", F.col("company_id").alias("source"), "is_ivd").alias("x")).distinct()
    told = F.transform(F.array_sort(F.collect_list("x")), lambda x: F.concat_ws(":", x["updated_date"].cast("string"), x["source"].cast("string"), x["is_ivd"].cast("string")))
    return p.groupBy("registration_id").agg(F.array_join(told, "|").alias("candidates"), F.count("*").alias("n"))


def reclassified(spark, d) -> DataFrame:
    """Parts whose scope changes under the present rules; before, the class code alone decided."""
    p = table(spark, d, "part").select("p_partkey", _mapped(F.col("p_type"), CODES, "").alias("code"), F.concat(F.lit(""), _name()).alias("name"))
    none = F.lit(None).cast("string")
    v = classifier.classify(p, F.col("code"), F.col("name"), none, none, none)
    old = F.col("code").startswith("22") | F.col("code").startswith("6840")
    return v.select("p_partkey", old.alias("was"), F.col("v.is_ivd").alias("now"), F.col("v.category").alias("category")).where(~F.col("was").eqNullSafe(F.col("now")))


def _name():
    from certalog.plans.ingest import ADJECTIVES, NOUNS

    return F.concat(_mapped(F.split("p_name", " ")[0], ADJECTIVES, ""), _mapped(F.split("p_name", " ")[1], NOUNS, "器械"))


def enriched(spark, d) -> DataFrame:
    """The newest product in scope of each registration with the fields that are blank or placeholders filled from its device row.

    What differs from a field that is there is kept as an alias.
    """
    p = tables.latest(lines(spark, d).where("is_ivd"), ["registration_id"], newest())
    own = F.when(F.col("quantity") < 10, "-").when(F.col("quantity") < 20, " ").when(F.col("quantity") < 40, F.concat(F.lit("model "), (F.col("part_id") % 3).cast("string")))
    device = F.concat(F.lit("model "), (F.col("part_id") % 5).cast("string"))
    there = once(p, own=own, device=device, bare=fields.blank(own).isNull() | fields.without_number(own))
    return there.select("registration_id", F.when(F.col("bare"), F.col("device")).otherwise(F.col("own")).alias("model"), F.when(~F.col("bare") & (F.col("own") != F.col("device")), F.col("device")).alias("alias"))


def param_candidates(spark, d, samples: int = 3) -> DataFrame:
    """How full each source field is, and the first of its values: one row a field, the fullest first, fifty at most."""
    raw = raw_rows(spark, d)
    names = [c for c in raw.columns if c not in ("registration_id", "line", "part_id", "company_id", "quantity")]
    each = tables.first_values(raw.select(*[fields.blank(F.col(c)).alias(c) for c in names]), names, samples)
    told = F.when(F.size("least") > 0, F.array_join("least", "|")).alias("samples")
    out = each.select("field", "total", "filled", F.round(1 - F.col("filled") / F.col("total"), 6).alias("empty_rate"), told)
    return out.orderBy(F.col("filled").desc(), "field").limit(50)


def bound_variants(spark, d) -> DataFrame:
    """Variants by whether their number is a registration's, and those that carry no key of it."""
    v = variants(spark, d).withColumn("registry_no", F.when(F.col("line") == 7, F.concat(F.col("registry_no"), F.lit("X"))).otherwise(F.col("registry_no")))
    r = registrations(spark, d).select(F.col("registration_no").alias("registry_no"), F.col("registration_id").alias("found"))
    return v.join(r, "registry_no", "left").groupBy("part_id").agg(F.count("*").alias("n"), F.count("found").alias("bound"), F.count_if(F.col("variant_of").isNull() & F.col("found").isNotNull()).alias("back_filled"))


def promoted(spark, d) -> DataFrame:
    """Shares of all scanned rows by what became of them, in per cent of two decimals."""
    o = outcomes(spark, d).agg(F.count("*").alias("n"), *[F.count_if(F.col("outcome") == k).alias(k) for k in ("accepted", "pending", "filtered", "invalid_name", "failed")])
    return o.select(F.col("n").alias("scanned"), *[F.round(F.col(k) * 100 / F.col("n"), 2).alias(f"{k}_pct") for k in o.columns[1:]])


def pending_reasons(spark, d) -> DataFrame:
    """Backlog by reason, and how much of it is of the newest registrations."""
    p = outcomes(spark, d).where("outcome = 'pending'")
    return p.groupBy("reason").agg(F.count("*").alias("n"), F.count_if(F.col("approved_date") >= F.date_sub(F.lit(ASOF), 365)).alias("year"), F.min("source_key").alias("first_key"))


def queue_page(spark, d, reason: str = "E_CANONICAL_KEY_CONFLICT", page: int = 2, size: int = 20) -> DataFrame:
    p = outcomes(spark, d).where((F.col("outcome") == "pending") & (F.col("reason") == reason))
    order = [F.col(c).desc() for c in ("registration_id", "line", "part_id", "company_id", "quantity")]
    return p.orderBy(*order).offset((page - 1) * size).limit(size).select("registration_id", "line", "source_key", "reason")


def quality_counters(spark, d) -> DataFrame:
    """What is wrong with the mapped records: names, numbers, companies, dates."""
    m = mapped_records(spark, d)
    return m.agg(
        F.count("*").alias("total"), F.count_if(fields.blank(F.col("name")).isNull()).alias("name_blank"), F.count_if(fields.punctuation_only(F.col("name"))).alias("name_punctuation"),
        F.count_if(~fields.valid_name(F.col("name"))).alias("name_invalid"), F.count_if(fields.without_number(F.col("reg_no"))).alias("number_missing"),
        F.count_if(F.col("company_name").isNull()).alias("company_missing"), F.count_if(F.col("approved_date").isNull()).alias("date_missing"), F.count_if(F.col("status") == "expired").alias("expired"),
    )


def anchor_audit(spark, d) -> DataFrame:
    """Products by how they hang on registrations: by key as their number says, by number alone, against it, or not at all."""
    v = variants(spark, d).withColumn("registry_no", F.when(F.col("line") == 6, F.concat(F.lit("REG"), F.lpad((F.col("part_id") + 1).cast("string"), 10, "0"))).otherwise(F.col("registry_no")))
    r = registrations(spark, d).select(F.col("registration_no").alias("registry_no"), F.col("registration_id").alias("found"))
    j = v.join(r, "registry_no", "left")
    state = (
        F.when(F.col("found").isNull(), "unmatched").when(F.col("variant_of").isNull(), "back_fillable")
        .when(F.col("variant_of") == F.col("found"), "matched").otherwise("mismatched")
    )
    return j.groupBy(state.alias("state")).agg(F.count("*").alias("n"), F.min("registry_no").alias("first_number"))


def admin_home(spark, d) -> DataFrame:
    """Queue counts and the newest day's metrics in one row."""
    q = outcomes(spark, d).agg(F.count_if(F.col("outcome") == "pending").alias("pending"), F.count_if(F.col("outcome").isin("invalid_name", "filtered")).alias("rejected"))
    m = changes(spark, d).groupBy("day").agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "cancel").alias("cancels"))
    last = m.agg(F.max("day").alias("day"), F.max_by("n", "day").alias("changes"), F.max_by("cancels", "day").alias("cancels"))
    return q.crossJoin(last).withColumn("cancel_rate", ratio(F.col("cancels"), F.col("changes")))  # one row each


def register_diffs(spark, d) -> DataFrame:
    """Field by field, what differs between an owner's two newest registrations, nine fields, with change type and severity."""
    order = [F.col("created_date").desc(), F.col("registration_id").desc()]
    p = tables.latest(products(spark, d), ["registration_id"], newest()).select("registration_id", F.col("name").alias("product_name"), F.col("category").alias("class"), F.col("methodology").alias("model"))
    r = registrations(spark, d).join(p, "registration_id", "left")
    r = r.withColumns({"filing_no": F.lit(None).cast("string"), "specification": F.concat_ws(" ", "class", "model")})
    names = ["registration_no", "filing_no", "approval_date", "expiry_date", "status", "product_name", "class", "model", "specification"]
    diffs = tables.newest_changes(r, ["owner_id"], order, names)
    kind = fields.register_change(F.lit(True), *[F.col(c) for c in ("before.status", "after.status", "before.expiry_date", "after.expiry_date")])
    return diffs.select("owner_id", "field", "old", "new", fields.severity(F.col("field")).alias("severity"), kind.alias("change_type"))


def diff_report(spark, d) -> DataFrame:
    return register_diffs(spark, d).groupBy("change_type", "severity", "field").agg(F.count("*").alias("n"))


def scalar_rules(spark, d) -> DataFrame:
    """Field rules over every customer: keys, booleans, units, grades, hashes, months, words of status."""
    c = spread(table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), "c_custkey")
    k = F.col("c_custkey").cast("int")
    pick = lambda *words: F.element_at(F.array(*[F.lit(w).cast("string") for w in words]), k % len(words) + 1)
    text = F.concat(F.lit(" （"), F.col("c_name"), F.lit("） "))
    raw = F.concat(F.lit('{"_stub":{"source_hint":"'), pick("UDI", "WEB"), F.lit('","verified_by_nmpa":"'), pick("true", "no", "1"), F.lit('"},"maker":"'), F.col("c_mktsegment"), F.lit('"}'))
    return c.select(
        "c_custkey", fields.norm_key(text).alias("norm_key"), fields.norm_token(text).alias("norm_token"), fields.local_key(text).alias("local_key"),
        fields.said_yes(pick("是", "N", "YES", "yes", None, "0")).alias("yes"), fields.unit(pick("小时", "μL", "ML", "℃", "foo", "copies/ml")).alias("unit"),
        fields.grade(pick("a", "E", None, " B ")).alias("grade"), fields.parse_status(pick("1", None), pick("d", "d", None), pick(None, None, None, "x")).alias("parsed"),
        fields.month_valid(pick("2001-01", "2001-13", "2001-1")).alias("month_ok"), fields.looks_cancelled(pick("已注销", "有效", "停止使用")).alias("gone"),
        fields.model_spec(pick("A", " ", None), pick("7", None)).alias("model_spec"), fields.checksum_matches(F.lit("AB"), pick("ab", "cd", None)).alias("sum_ok"),
        fields.whole_number(pick("7.9", " -3.2 ", "x")).alias("number"), fields.event_hash(F.col("c_custkey"), F.lit("renew"), F.lit("2001-01-01"), F.lit(None)).alias("event_hash"),
        fields.payload_hash(name=F.col("c_name"), area=F.col("c_mktsegment")).alias("payload_hash"), fields.company_raw_name(pick(" ", "Acme"), raw, ["maker"]).alias("maker"),
        fields.shown(raw).alias("shown"), fields.stub_state(raw)["verified"].alias("verified"), fields.reject_key(pick(None, "1"), pick(None, None, "2"), F.lit(None), F.lit("r")).alias("rejected_as"),
        fields.whole_date(pick("2001-02-03", "20010203", "2001/02/03x")).alias("whole_date"), fields.found_date(pick("from 2001-2-3 on", "none")).alias("found_date"),
    )


def _pick(*words) -> str:
    return "([" + ", ".join("null" if w is None else f"'{w}'" for w in words) + f"])[cast(c_custkey % {len(words)} as integer) + 1]"


_SCALARS = f"""with c as (select *, ' （' || c_name || '） ' t, {_pick('UDI', 'WEB')} hint, {_pick('true', 'no', '1')} ver, {_pick('1', None)} num, {_pick('d', 'd', None)} di, {_pick(None, None, None, 'x')} err,
  nullif(trim({_pick('A', ' ', None)}), '') md, {_pick('7', None)} sku, {_pick(None, '1')} r1, {_pick(None, None, '2')} r2, {_pick('a', 'E', None, ' B ')} gr from customer)
select c_custkey, regexp_replace(upper(c_name), '[^0-9A-Z]', '', 'g') norm_key, '(' || lower(c_name) || ')' norm_token, '(' || replace(c_name, ' ', '') || ')' local_key,
  case {_pick('是', 'N', 'YES', 'yes', None, '0')} when '是' then true when 'YES' then true when 'N' then false when '0' then false end yes,
  {_pick('h', 'uL', 'mL', 'C', 'foo', 'copies/mL')} unit, case when upper(trim(gr)) in ('A', 'B', 'C', 'D') then upper(trim(gr)) else 'C' end grade,
  case when err is not null or di is null then 'FAILED' when num is not null then 'PARSED' else 'PENDING_REG_NO' end parsed,
  c_custkey % 3 = 0 month_ok, c_custkey % 3 <> 1 gone, case when md is null then sku when sku is null then md else md || ' / ' || sku end model_spec, c_custkey % 3 <> 1 sum_ok,
  cast(([7, -3, null])[cast(c_custkey % 3 as integer) + 1] as integer) number, sha256(c_custkey || '|renew|2001-01-01|') event_hash,
  sha256('{{"area":"' || c_mktsegment || '","name":"' || c_name || '"}}') payload_hash, case c_custkey % 2 when 1 then 'Acme' else c_mktsegment end maker,
  hint <> 'UDI' or ver = 'true' shown, ver in ('true', '1') verified, case when r1 is not null then 'di:' || r1 when r2 is not null then 'reg:' || r2 else 'rawsha:' || sha256('r') end rejected_as,
  ([date '2001-02-03', date '2001-02-03', null])[cast(c_custkey % 3 as integer) + 1] whole_date, ([date '2001-02-03', null])[cast(c_custkey % 2 as integer) + 1] found_date from c"""

_FIELDS = ("registration_no", "filing_no", "approval_date", "expiry_date", "status", "product_name", "class", "model", "specification")
_DIFFS = f"""{SQL}, p as (select * from (select *, row_number() over (partition by registration_id order by updated_date desc nulls last, line, part_id, company_id, quantity) rn from products) where rn = 1),
r as (select r.*, row_number() over (partition by owner_id order by created_date desc, r.registration_id desc) rn, null::varchar filing_no, p.name product_name, p.category class, p.methodology model,
  concat_ws(' ', p.category, p.methodology) specification from registrations r left join p using (registration_id)),
b as (select o.owner_id, {", ".join(f"cast(o.{f} as varchar) o_{f}, cast(n.{f} as varchar) n_{f}" for f in _FIELDS)},
  case when lower(coalesce(o.status, '')) <> 'cancelled' and lower(coalesce(n.status, '')) = 'cancelled' then 'CANCEL' when n.expiry_date > o.expiry_date then 'RENEW' else 'MODIFY' end change_type
  from r o join r n on o.owner_id = n.owner_id and o.rn = 2 and n.rn = 1),
diffs as ({" union all ".join(f"select owner_id, '{f}' field, o_{f} as old, n_{f} as new, '{fields.SEVERITY[f]}' severity, change_type from b where o_{f} is distinct from n_{f}" for f in _FIELDS)})"""
_RECLASS = _class_sql(f"select p_partkey, {_case('p_type', CODES, '')} code, lower({_DEVICE}) as name from part")
_PLACED = [(n, f, k, len(names)) for f, names in COLUMNS.items() for k, n in enumerate(names)]
_CANDIDATES = " union all ".join(f"select '{n}' field, case when line % {of} = {k} then {f} end as value from record" for n, f, k, of in _PLACED) + " union all select 'registry_no', registry_no from record"

QUERIES = {
    "up4_active_merge": (active_merge, f"{SQL}, o as (select * from (select *, row_number() over (partition by owner_id order by created_date desc, registration_id desc) rn from registrations where created_date < date '{_CUT}') where rn = 1), n as (select * from (select *, row_number() over (partition by owner_id order by created_date desc, registration_id desc) rn from registrations where created_date >= date '{_CUT}') where rn = 1) select owner_id, registration_id, status from o where status is distinct from 'active' or owner_id not in (select owner_id from n) union all select owner_id, registration_id, status from n"),
    "up6_replaced_params": (replaced_params, f"{SQL}, o as (select part_id, case when is_ivd then 'ivd' else 'other' end code, updated_date >= d late, updated_date from products, today), g as (select part_id, code, late, count(*) n, max(updated_date) newest from o group by 1, 2, 3) select part_id, code, n, newest from g where late or not exists (select 1 from g x where x.late and x.part_id = g.part_id and x.code = g.code)"),
    "up11_restored": (restored, f"{SQL}, t as (select * from products, today where is_ivd and updated_date >= d) select registration_id, line, part_id, company_id, quantity from products p where not is_ivd and not exists (select 1 from t where t.registration_id = p.registration_id) and not exists (select 1 from t where t.part_id = p.part_id)"),
    "up10_archive_counts": (archive_counts, f"{SQL}, taken as (select p.* from lineitem p where exists (select 1 from lineitem f where f.l_returnflag = 'R' and (f.l_orderkey, f.l_linenumber, f.l_partkey) = (p.l_orderkey, p.l_linenumber, p.l_partkey))), kept as (select * from lineitem where l_returnflag <> 'R') select (select count(*) from lineitem) as \"before\", (select count(*) from kept) kept, (select count(*) from taken) archived, not exists ((select * from taken union all select * from kept) except all select * from lineitem) and (select count(*) from lineitem) = (select count(*) from kept) + (select count(*) from taken) sound"),
    "up12_rollback": (rollback, "with run as (select * from orders where o_orderpriority = '1-URGENT') select 'products' part, count(*) n from lineitem where l_orderkey in (select o_orderkey from run) union all select 'registrations', count(*) from run union all select 'owners', count(distinct o_custkey) from run where o_custkey not in (select o_custkey from orders where o_orderpriority <> '1-URGENT')"),
    "up13_merged_candidates": (merged_candidates, f"{SQL}, u as (select distinct registration_id, updated_date, company_id, is_ivd from products) select registration_id, string_agg(updated_date || ':' || company_id || ':' || cast(is_ivd as varchar), '|' order by updated_date, company_id, is_ivd) candidates, count(*) n from u group by 1"),
    "up14_reclassified": (reclassified, f"with {_RECLASS}, w as (select *, code like '22%' or code like '6840%' was from classified) select p_partkey, was, is_ivd as now, cat category from w where was <> is_ivd"),
    "q43_enriched": (enriched, f"{SQL}, p as (select *, case when quantity < 10 then '-' when quantity < 20 then ' ' when quantity < 40 then 'model ' || part_id % 3 end own, 'model ' || part_id % 5 device from (select *, row_number() over (partition by registration_id order by updated_date desc nulls last, line, part_id, company_id, quantity) rn from products where is_ivd) where rn = 1) select registration_id, case when quantity >= 20 and own is not null then own else device end model, case when quantity >= 20 and own <> device then device end alias from p"),
    "q44_param_candidates": (param_candidates, f"{RAW_SQL}, e as ({_CANDIDATES}), s as (select field, string_agg(value, '|' order by value) samples from (select *, row_number() over (partition by field order by value) r from (select distinct field, value from e where value is not null)) where r <= 3 group by 1) select field, count(*) total, count(value) filled, round(1 - cast(count(value) as double) / count(*), 6) empty_rate, any_value(samples) samples from e left join s using (field) group by 1 order by filled desc, field limit 50"),
    "q41_bound_variants": (bound_variants, f"{SQL}, {VARIANT_SQL}, v as (select part_id, variant_of, case when line = 7 then registry_no || 'X' else registry_no end no from variants) select part_id, count(*) n, count(registration_id) bound, count(*) filter (where variant_of is null and registration_id is not null) back_filled from v left join registrations on registration_no = no group by 1"),
    "q69_promoted": (promoted, f"{OUTCOME_SQL} select count(*) scanned, " + ", ".join(f"round(cast(count(*) filter (where outcome = '{k}') as double) * 100 / count(*), 2) {k}_pct" for k in ("accepted", "pending", "filtered", "invalid_name", "failed")) + " from outcomes"),
    "q58_pending_reasons": (pending_reasons, f"{OUTCOME_SQL} select reason, count(*) n, count(*) filter (where approved_date >= date '{ASOF}' - 365) as year, min(source_key) first_key from outcomes where outcome = 'pending' group by 1"),
    "q59_queue_page": (queue_page, f"{OUTCOME_SQL} select registration_id, line, source_key, reason from outcomes where outcome = 'pending' and reason = 'E_CANONICAL_KEY_CONFLICT' order by registration_id desc, line desc, part_id desc, company_id desc, quantity desc limit 20 offset 20"),
    "q53_quality_counters": (quality_counters, f"{MAPPED_SQL} select count(*) total, count(*) filter (where name is null) name_blank, count(*) filter (where name = '/') name_punctuation, count(*) filter (where name is null or name in ('/', 'N/A')) name_invalid, count(*) filter (where reg_no is null) number_missing, count(*) filter (where company_name is null) company_missing, count(*) filter (where approved_date is null) date_missing, count(*) filter (where status = 'expired') expired from mapped"),
    "q61_anchor_audit": (anchor_audit, f"{SQL}, {VARIANT_SQL}, v as (select variant_of, case when line = 6 then 'REG' || lpad(cast(part_id + 1 as varchar), 10, '0') else registry_no end no from variants) select case when registration_id is null then 'unmatched' when variant_of is null then 'back_fillable' when variant_of = registration_id then 'matched' else 'mismatched' end state, count(*) n, min(no) first_number from v left join registrations on registration_no = no group by 1"),
    "q74_admin_home": (admin_home, f"{OUTCOME_SQL}, m as (select day, count(*) n, count(*) filter (where kind = 'cancel') c from changes group by 1) select count(*) filter (where outcome = 'pending') pending, count(*) filter (where outcome in ('invalid_name', 'filtered')) rejected, (select max(day) from m) as day, (select arg_max(n, day) from m) changes, (select arg_max(c, day) from m) cancels, (select round(cast(arg_max(c, day) as double) / arg_max(n, day), 6) from m) cancel_rate from outcomes"),
    "q36_register_diffs": (register_diffs, f"{_DIFFS} select * from diffs"),
    "q56_diff_report": (diff_report, f"{_DIFFS} select change_type, severity, field, count(*) n from diffs group by 1, 2, 3"),
    "f_scalar_rules": (scalar_rules, _SCALARS),
}
