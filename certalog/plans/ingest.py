"""Source rows to registrations: mapping, validity, classification, anchor gate, rejects, companies, variants, contract writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from certalog.functions import classifier, fields
from certalog.functions.text import first_text, once, registration_key
from certalog.operators import policy, tables
from certalog.plans.binding import ASOF, SQL, companies, lines, registrations
from certalog.session import table

#: What the binding calls parts: device words by the last word of a part's name, method words by the first, class codes by its type.
NOUNS = {
    "ring": "检测试剂盒", "widget": "生化分析仪", "bolt": "骨科分析仪", "gear": "诊断软件", "gizmo": "采血管", "plate": "抗原校准品", "anvil": "注射器", "rod": "POCT系统",
}
ADJECTIVES = {"hot": "qPCR", "cold": "NGS", "red": "elisa", "old": "核酸扩增"}
CODES = {"ECONOMY": "22", "SMALL": "6840-1", "MEDIUM": "07", "PROMO": "21", "LARGE": "14"}
#: The source names of each field, the first that has text counts (fixed values).
ALIASES = {
    "name": ("name", "product_name", "产品名称", "产品名", "cpmctymc", "spmc"),
    "reg_no": ("reg_no", "registration_no", "注册证编号", "注册号", "zczbhhzbapzbh"),
    "udi_di": ("udi_di", "UDI_DI", "primary_di", "产品标识DI", "zxxsdycpbs"),
    "status": ("status", "registration_status", "状态", "reg_status", "versionStauts"),
    "approved_date": ("approved_date", "approval_date", "批准日期", "批准时间", "cpbsfbrq"),
    "expiry_date": ("expiry_date", "expire_date", "有效期至", "失效日期", "tsrq"),
    "company_name": ("company_name", "manufacturer", "注册人名称", "生产企业名称", "ylqxzcrbarmc"),
    "company_country": ("company_country", "country", "国家地区"),
    "class_name": ("class", "class_name", "管理类别", "类别", "flbm", "cplb"),
}
#: Those that differ as columns do, whose names are met without regard to case.
COLUMNS = {f: tuple({n.lower(): n for n in reversed(names)}[k] for k in dict.fromkeys(n.lower() for n in names)) for f, names in ALIASES.items()}
LAST_YEAR = ASOF.year + 2
_KEY = ("registration_id", "line", "part_id", "company_id", "quantity")


def _mapped(c: Column, names: dict[str, str], default: str) -> Column:
    out = F.lit(default)
    for k, v in names.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def raw_rows(spark, d) -> DataFrame:
    """One raw row an order line, under a source name of each field that goes by the line, with what sources get wrong."""
    p = table(spark, d, "part").select(
        F.col("p_partkey").alias("part_id"), "p_type",
        F.concat(_mapped(F.split("p_name", " ")[0], ADJECTIVES, ""), _mapped(F.split("p_name", " ")[1], NOUNS, "器械")).alias("device"),
    )
    c = companies(spark, d).select("company_id", "company", "country")
    r = registrations(spark, d).select("registration_id", "registration_no", "approval_date", "expiry_date", F.col("status").alias("reg_status"))
    rows = lines(spark, d).join(p, "part_id").join(c, "company_id").join(r, "registration_id")
    q = F.col("quantity").cast("int")
    name = F.when(q == 13, " / ").when(q == 14, "N/A").when(q == 15, None).otherwise(F.concat(F.lit(" "), "device"))
    number = F.when(q == 16, None).when(q == 17, "——").when(q % 5 == 0, F.concat(F.lit("国械注准"), F.col("registration_id").cast("string"), F.lit("-2001"))).otherwise(F.col("registration_no"))
    di = F.when(q == 18, "IVD-0001").when(q % 4 == 0, None).otherwise(F.format_string("%08d", "part_id"))
    status = F.when(q == 19, "已注销").when(q == 20, " Cancelled ").otherwise(F.col("reg_status"))
    values = {
        "name": name, "reg_no": number, "udi_di": di, "status": status, "approved_date": F.date_format("approval_date", "yyyy/MM/dd"),
        "expiry_date": F.col("expiry_date").cast("string"), "company_name": F.col("company"), "company_country": F.col("country"), "class_name": _mapped(F.col("p_type"), CODES, ""),
    }
    registry = F.when(q % 11 == 0, F.lit("国械注准20200001")).when(q % 3 == 0, F.col("registration_no")).alias("registry_no")
    rows = rows.select(*_KEY, registry, *[v.cast("string").alias(f"_value_{f}") for f, v in values.items()])
    cells = [F.when(F.col("line") % len(names) == k, F.col(f"_value_{f}")).alias(f"_raw_{n}") for f, names in COLUMNS.items() for k, n in enumerate(names)]
    return rows.select(*_KEY, *cells, "registry_no").withColumnsRenamed({f"_raw_{n}": n for names in COLUMNS.values() for n in names})


def _case(c: str, names: dict[str, str], default: str) -> str:
    return f"case {c} " + " ".join(f"when '{k}' then '{v}'" for k, v in names.items()) + f" else '{default}' end"


_DEVICE = f"{_case('string_split(p_name, chr(32))[1]', ADJECTIVES, '')} || {_case('string_split(p_name, chr(32))[2]', NOUNS, '器械')}"
_VALUES = {
    "name": "case q when 13 then ' / ' when 14 then 'N/A' when 15 then null else ' ' || device end",
    "reg_no": "case when q = 16 then null when q = 17 then '——' when q % 5 = 0 then '国械注准' || registration_id || '-2001' else registration_no end",
    "udi_di": "case when q = 18 then 'IVD-0001' when q % 4 = 0 then null else lpad(cast(part_id as varchar), 8, '0') end",
    "status": "case q when 19 then '已注销' when 20 then ' Cancelled ' else reg_status end",
    "approved_date": "strftime(approval_date, '%Y/%m/%d')",
    "expiry_date": "cast(expiry_date as varchar)",
    "company_name": "company",
    "company_country": "country",
    "class_name": _case("p_type", CODES, ""),
}
RAW_SQL = f"""{SQL},
wide as (select p.registration_id, p.line, p.part_id, p.company_id, p.quantity, cast(p.quantity as integer) q, {_DEVICE} device, p_type, c.company, c.country,
  r.registration_no, r.approval_date, r.expiry_date, r.status reg_status
  from products p join part on part_id = p_partkey join companies c on p.company_id = c.company_id join registrations r on p.registration_id = r.registration_id),
record as (select registration_id, line, part_id, company_id, quantity, {", ".join(f"nullif(trim({e}), '') {f}" for f, e in _VALUES.items())},
  case when q % 11 = 0 then '国械注准20200001' when q % 3 = 0 then registration_no end registry_no from wide)
"""


def records(raw: DataFrame) -> DataFrame:
    """Rows as records: the first source name that has text, dates read, status told, and what is wrong with the row (error, null if nothing)."""
    there = {c.lower() for c in raw.columns}
    text = {f: first_text(*[F.col(n) for n in names if n.lower() in there]) for f, names in COLUMNS.items()}
    told = {n for names in COLUMNS.values() for n in names}
    made, names = raw, list(text)
    for k in range(0, len(names), 2):  # two at a time: a generated method of more than 8,000 bytes stays interpreted by the JVM
        made = once(made, **{f"_{f}": text[f] for f in names[k : k + 2]})
    made = made.drop(*told)
    expiry = fields.record_date(F.col("_expiry_date"), LAST_YEAR + 10)
    error = (
        F.when(F.col("_name").isNull(), "Missing required field: name")
        .when(F.col("_udi_di").isNull() & F.col("_reg_no").isNull(), "Missing required identifier: udi_di/reg_no")
        .when(F.lower("_udi_di").startswith("ivd-"), "Invalid placeholder udi_di")
    )
    return made.select(
        *[c for c in made.columns if not c.startswith("_")], F.col("_name").alias("name"), fields.clip(F.col("_reg_no"), 120).alias("reg_no"),
        F.coalesce("_udi_di", F.concat(F.lit("reg:"), "_reg_no")).alias("udi_di"), fields.status_of(F.col("_status"), expiry, F.lit(ASOF)).alias("status"),
        fields.record_date(F.col("_approved_date"), LAST_YEAR).alias("approved_date"), expiry.alias("expiry_date"), fields.clip(F.col("_company_name"), 255).alias("company_name"),
        fields.clip(F.col("_company_country"), 80).alias("company_country"), fields.clip(F.col("_class_name"), 120).alias("class_name"), error.alias("error"),
    )


def mapped_records(spark, d) -> DataFrame:
    return records(raw_rows(spark, d)).drop("registry_no")


MAPPED_SQL = f"""{RAW_SQL},
mapped as (select registration_id, line, part_id, company_id, quantity, name, substr(reg_no, 1, 120) reg_no, coalesce(udi_di, 'reg:' || reg_no) udi_di,
  case when contains(lower(coalesce(status, '')), '注销') or contains(lower(coalesce(status, '')), 'cancel') then 'cancelled' when try_cast(expiry_date as date) < d then 'expired'
    else coalesce(lower(status), 'active') end status,
  case when year(try_cast(replace(approved_date, '/', '-') as date)) <= {LAST_YEAR} then try_cast(replace(approved_date, '/', '-') as date) end approved_date,
  try_cast(expiry_date as date) expiry_date, substr(company_name, 1, 255) company_name, substr(company_country, 1, 80) company_country, class_name,
  case when name is null then 'Missing required field: name' when udi_di is null and reg_no is null then 'Missing required identifier: udi_di/reg_no'
    when lower(udi_di) like 'ivd-%' then 'Invalid placeholder udi_di' end error, registry_no from record, today)
"""


def classified(spark, d) -> DataFrame:
    """Every part by the rules of the classifier."""
    p = table(spark, d, "part").select("p_partkey", _mapped(F.col("p_type"), CODES, "").alias("code"), F.concat(_mapped(F.split("p_name", " ")[0], ADJECTIVES, ""), _mapped(F.split("p_name", " ")[1], NOUNS, "器械")).alias("name"), F.col("p_brand").alias("model"))
    v = classifier.classify(p, F.col("code"), F.col("name"), F.col("model"), F.lit(None).cast("string"), F.lit(""))
    return v.select("p_partkey", "v.is_ivd", F.col("v.category").alias("ivd_category"), F.array_join("v.subtypes", ",").alias("subtypes"), "v.confidence", "v.rule", F.array_join("v.hits", ",").alias("hits"), "v.needs_review")


def scoped(spark, d) -> DataFrame:
    """Every part by the older rules of scope, which read its name, class code and brand."""
    p = table(spark, d, "part")
    name = F.concat(_mapped(F.split("p_name", " ")[0], ADJECTIVES, ""), _mapped(F.split("p_name", " ")[1], NOUNS, "器械"))
    v = F.col("v")
    read = once(p, v=classifier.scope_by_words(classifier.scope_text(name, _mapped(F.col("p_type"), CODES, ""), F.col("p_brand"))))
    return read.select("p_partkey", v["is_ivd"].alias("is_ivd"), v["reason"].alias("reason"), F.array_join(v["matched"], ",").alias("matched"))


def _hits(name: str, words) -> str:
    test = lambda w: f"regexp_matches({name}, '(^|[^a-z0-9]){w}([^a-z0-9]|$)')" if w.isascii() and " " not in w else f"contains({name}, '{w}')"
    return "list_filter([" + ", ".join(f"case when {test(w)} then '{w}' end" for w in words) + "], lambda x: x is not null)"


def _class_sql(source: str) -> str:
    lists = {
        "nv": classifier.NEVER, "i": classifier.INSTRUMENT, "i0": classifier.INSTRUMENT_WITHOUT_CODE, "ni": classifier.NOT_INSTRUMENT, "s": classifier.SOFTWARE,
        "s0": classifier.SOFTWARE_WITHOUT_CODE, "ns": classifier.NOT_SOFTWARE, "r0": classifier.REAGENT_WITHOUT_CODE, **{f"k{k}": w for k, w in classifier.SUBTYPES.items()},
    }
    tests = (
        ("len(nv) > 0", "global_exclude", "null", "nv", 0.99), ("code like '22%' or code like '6840%'", "class_code", "'reagent'", "[]", 0.95),
        ("code like '07%' and len(i) > 0 and len(ni) = 0", "class_code+keyword", "'instrument'", "i", 0.85), ("code like '07%'", "class_code+keyword", "null", "ni", 0.8),
        ("code like '21%' and len(s) > 0 and len(ns) = 0", "class_code+keyword", "'software'", "s", 0.85), ("code like '21%'", "class_code+keyword", "null", "ns", 0.8),
        ("code <> ''", "fallback", "null", "[]", 0.8), ("len(r0) > 0", "keyword_fallback", "'reagent'", "r0", 0.85),
        ("len(i0) > 0 and len(ni) = 0", "keyword_fallback", "'instrument'", "i0", 0.85), ("len(s0) > 0 and len(ns) = 0", "keyword_fallback", "'software'", "s0", 0.85),
    )
    pick = lambda k, last: "case " + " ".join(f"when {t[0]} then {t[k] if k in (2, 3) else repr(t[k])}" for t in tests) + f" else {last} end"
    kinds = "concat_ws(',', " + ", ".join(f"case when cat is not null and len(k{k}) > 0 then '{k}' end" for k in classifier.SUBTYPES) + ")"
    return f"""h0 as ({source}), h as (select *, {", ".join(f"{_hits('name', w)} {k}" for k, w in lists.items())} from h0),
v as (select *, {pick(1, "'fallback'")} as rule, {pick(2, "null")} cat, {pick(3, "[]")} hits, cast({pick(4, "0.5")} as double) confidence from h),
classified as (select *, cat is not null is_ivd, {kinds} subtypes, cat is null and code = '' and rule <> 'global_exclude' needs_review from v)"""


_WORDS = lambda words: "regexp_matches(t, '" + "|".join(words) + "')"
_SURE = ", ".join(f"case when regexp_matches(t, '{'(^|[^_0-9a-z一-鿿])ivd($|[^_0-9a-z一-鿿])' if w.startswith(chr(92)) else w}') then 'strong:{w}' end" for w in classifier.SCOPE_SURE)
SCOPE_SQL = f"""with x as (select p_partkey, lower(concat_ws(' | ', nullif({_DEVICE}, ''), nullif({_case("p_type", CODES, "")}, ''), p_brand)) t from part),
y as (select *, list_filter([{_SURE}], lambda w: w is not null) s, {_WORDS(classifier.SCOPE_CONTEXT)} c, {_WORDS(classifier.SCOPE_INSTRUMENT)} i, {_WORDS(classifier.SCOPE_SOFTWARE)} f, {_WORDS(classifier.SCOPE_NEGATIVE)} n from x)
select p_partkey, contains(t, '6840') or len(s) > 0 or c and (i or f) is_ivd,
  case when contains(t, '6840') then 'matched_category_code_6840' when len(s) > 0 then 'matched_strong_ivd_keyword' when c and i then 'matched_diag_context_plus_instrument' when c and f then 'matched_diag_context_plus_software' when n then 'matched_negative_non_ivd_keyword' else 'no_ivd_signal' end reason,
  case when contains(t, '6840') then 'category_code:6840' when len(s) > 0 then array_to_string(s, ',') when c and i then 'diag_context,instrument' when c and f then 'diag_context,software' else '' end matched from y
"""


CLASS_SQL = _class_sql(f"select p_partkey, {_case('p_type', CODES, '')} code, lower({_DEVICE}) as name from part")


def anchor(first: Column, second: Column, first_key: Column, second_key: Column, di: Column, source: str) -> Column:
    """(number, error): the key of a row's registration number, or why there is none.

    first and second are the numbers that the row gives (null for blank ones), with their keys; two numbers must not contradict.
    """
    number = F.when(first.isNotNull(), first_key).otherwise(second_key)
    device = F.when(di.isNotNull(), "E_UDI_DI_WITHOUT_REG").otherwise("E_CANONICAL_KEY_MISSING")
    missing = device if source in ("UDI", "UDI_DI") else F.lit("E_CANONICAL_KEY_MISSING")
    error = F.when(first.isNull() & second.isNull(), missing).when(number.isNull(), "E_REG_NO_NORMALIZE_FAILED").when(first_key != second_key, "E_CANONICAL_KEY_CONFLICT")
    return F.struct(F.when(error.isNull(), number).alias("number"), error.alias("error"))


def outcomes(spark, d) -> DataFrame:
    """What becomes of every raw row: failed, invalid name, filtered out of scope, held back by the anchor gate, or accepted."""
    r = records(raw_rows(spark, d))
    none = F.lit(None).cast("string")
    a, b = fields.blank(F.col("reg_no")), fields.blank(F.col("registry_no"))
    r = once(once(r, a=a, b=b), k1=registration_key(F.col("a")), k2=registration_key(F.col("b")))
    v = classifier.classify(r, F.col("class_name"), F.col("name"), none, none, none)
    v = once(v, g=anchor(F.col("a"), F.col("b"), F.col("k1"), F.col("k2"), F.col("udi_di"), "UDI"))
    outcome = (
        F.when(F.col("error").isNotNull(), "failed").when(~fields.valid_name(F.col("name")), "invalid_name").when(~F.col("v.is_ivd"), "filtered")
        .when(F.col("g.error").isNotNull(), "pending").otherwise("accepted")
    )
    v = once(v, outcome=outcome)
    outcome = F.col("outcome")
    reason = F.when(outcome == "failed", F.col("error")).when(outcome == "filtered", F.col("v.rule")).when(outcome == "pending", F.col("g.error"))
    key = fields.reject_key(F.col("udi_di"), F.col("reg_no"), F.col("name"), F.lit(None).cast("string"))
    return v.select(
        *_KEY, "name", "udi_di", "status", "approved_date", "expiry_date", "company_name", "company_country", F.col("v.category").alias("ivd_category"),
        "outcome", reason.alias("reason"), F.when(outcome.isin("invalid_name", "filtered", "pending"), key).alias("source_key"), F.col("g.number").alias("number"),
    )


_ANCHOR = "[一-鿿]{1,6}械"
OUTCOME_SQL = f"""{MAPPED_SQL},
{_class_sql("select *, coalesce(class_name, '') code, name as plain from (select * replace (lower(coalesce(name, '')) as name), name as told from mapped)")},
n as (select *, nullif(regexp_replace(upper(regexp_replace(coalesce(reg_no, registry_no), '\\s+', '', 'g')), '[^0-9A-Z一-鿿]+', '', 'g'), '') k,
  nullif(regexp_replace(upper(registry_no), '[^0-9A-Z一-鿿]+', '', 'g'), '') k2, nullif(regexp_replace(upper(reg_no), '[^0-9A-Z一-鿿]+', '', 'g'), '') k1 from classified),
g as (select *, case when coalesce(reg_no, registry_no) is null then 'E_UDI_DI_WITHOUT_REG' when k is null then 'E_REG_NO_NORMALIZE_FAILED' when k1 <> k2 then 'E_CANONICAL_KEY_CONFLICT' end gate from n),
o as (select *, case when error is not null then 'failed' when told in ('/', 'N/A') then 'invalid_name' when not is_ivd then 'filtered' when gate is not null then 'pending' else 'accepted' end outcome from g),
outcomes as (select registration_id, line, part_id, company_id, quantity, told as name, udi_di, status, approved_date, expiry_date, company_name, company_country, cat ivd_category, outcome,
  case outcome when 'failed' then error when 'filtered' then rule when 'pending' then gate end reason,
  case when outcome in ('invalid_name', 'filtered', 'pending') then 'di:' || udi_di end source_key, case when gate is null then k end number from o)
"""


def ingest_counts(spark, d) -> DataFrame:
    return outcomes(spark, d).groupBy("outcome", "reason").agg(F.count("*").alias("n"))


def rejected_list(spark, d, like: str = "di:0000001%", n: int = 50) -> DataFrame:
    """A page of rejected rows, one a source key, by key pattern."""
    r = outcomes(spark, d).where(F.col("outcome").isin("invalid_name", "filtered") & F.col("source_key").ilike(like))
    return r.groupBy("source_key").agg(F.count("*").alias("n"), F.max("reason").alias("reason")).orderBy("source_key").limit(n)


def new_companies(spark, d) -> DataFrame:
    """Companies of accepted rows by exact name, made where there is none; the country is filled in where it is empty.

    Known are the companies of even number, every third of them without a country.
    """
    known = companies(spark, d).where("company_id % 2 = 0").select(F.col("company").alias("name"), F.when(F.col("company_id") % 3 > 0, F.col("country")).alias("country"))
    told = outcomes(spark, d).where("outcome = 'accepted' and company_name is not null").groupBy(F.col("company_name").alias("name")).agg(F.max("company_country").alias("country"))
    return tables.merge(known, told, ["name"], "fill")


def devices(spark, d) -> DataFrame:
    """The device master after the write: of each device its newest accepted row, by registration, line, company and quantity."""
    a = outcomes(spark, d).where("outcome = 'accepted' and udi_di not like 'reg:%'")
    order = [F.col(c).desc_nulls_last() for c in ("registration_id", "line", "company_id", "quantity")]
    return tables.latest(a, ["udi_di"], order).select("udi_di", "number", "name", "status", "ivd_category")


def mapping(spark, d) -> DataFrame:
    """Which registration each device is mapped to: a device of several numbers is pointed at the newest alone, the others go."""
    a = outcomes(spark, d).where("outcome = 'accepted' and udi_di not like 'reg:%'").select("udi_di", "number", "registration_id", "line", "company_id", "quantity")
    order = [F.col(c).desc_nulls_last() for c in ("registration_id", "line", "company_id", "quantity")]
    return tables.latest(a, ["udi_di"], order).select("udi_di", "number", F.lit("direct").alias("match_type"))


def pending_queue(spark, d) -> DataFrame:
    """Open rows of the queue after a run: a row seen again opens its closed entry anew, active ones alone conflict.

    Closed before the run are the entries of devices with an odd last digit.
    """
    seen = outcomes(spark, d).where("outcome = 'pending'").groupBy("source_key").agg(F.max("reason").alias("reason"), F.count("*").alias("n"))
    closed = F.right("source_key", F.lit(1)).isin("1", "3", "5", "7", "9")
    return seen.withColumn("state", F.when(closed, "reopened").otherwise("open"))


def contract_observations(spark, d) -> DataFrame:
    """Observations of registration fields: status and expiry of every product line, with grade, priority and year."""
    p = lines(spark, d)
    grade = F.element_at(F.array(*[F.lit(g) for g in "ABCD"]), F.pmod("company_id", F.lit(4)).cast("int") + 1)
    value = F.create_map(F.lit("status"), F.when(F.col("is_ivd"), "active").otherwise("cancelled"), F.lit("expiry_date"), F.date_add("updated_date", 1825).cast("string"))
    seq = F.struct("line", "part_id", "company_id", "quantity")
    return p.select("registration_id", F.explode(value).alias("field", "value"), grade.alias("grade"), (F.col("line") % 3).alias("priority"), F.year("updated_date").cast("long").alias("observed_at"), seq.alias("seq"))


def contract_fields(spark, d) -> DataFrame:
    """Field values that registrations end with under the conflict policy, and how many observations were applied, kept out or in conflict."""
    return policy.resolve(contract_observations(spark, d), ["registration_id", "field"])


CONTRACT_SQL = f"""{SQL.replace('with', 'with recursive', 1)},
obs as (select registration_id, unnest(['status', 'expiry_date']) as field, unnest([case when is_ivd then 'active' else 'cancelled' end, cast(updated_date + 1825 as varchar)]) as value,
  4 - company_id % 4 g, -(line % 3) p, year(updated_date) t, line, part_id, company_id, quantity from products, today),
o as (select *, row_number() over (partition by registration_id, field order by t, line, part_id, company_id, quantity) rn from obs),
f as (select distinct registration_id, field, 0::bigint rn, null::varchar as value, null::bigint g, null::bigint p, null::bigint t, 0 applied, 0 kept, 0 conflicts from o
  union all
  select registration_id, field, rn, case when step = 2 then n else value end, case when step = 2 then ng else g end, case when step = 2 then np else p end,
    case when step = 2 then nt else t end, applied + (step = 2)::int, kept + (step = 3)::int, conflicts + (step = 1)::int
  from (select f.registration_id, f.field, o.rn, f.value, f.g, f.p, f.t, o.value n, o.g ng, o.p np, o.t nt, applied, kept, conflicts,
    case when o.value is not distinct from f.value then 0 when f.g = o.g and f.p = o.p and f.t = o.t then 1
      when f.g is null or (o.g, o.p, o.t) >= (f.g, f.p, f.t) then 2 else 3 end step
    from f join o on o.registration_id = f.registration_id and o.field = f.field and o.rn = f.rn + 1)),
contract as (select registration_id, field, value, applied, kept, conflicts from (select *, row_number() over (partition by registration_id, field order by rn desc) last from f) where last = 1)"""


def contract_summary(spark, d) -> DataFrame:
    """Decisions by field: how many were applied, kept out, in conflict, and how many registrations have a conflict."""
    return contract_fields(spark, d).groupBy("field").agg(*[F.sum(c).cast("long").alias(c) for c in ("applied", "kept", "conflicts")], F.count_if(F.col("conflicts") > 0).alias("disputed"))


def conflict_queue(spark, d) -> DataFrame:
    """One entry a registration in dispute: its fields, and the grades of the sources that speak of them, each once."""
    late = contract_fields(spark, d).where("conflicts > 0").select("registration_id", "field")
    o = contract_observations(spark, d).join(late, ["registration_id", "field"])
    each = o.groupBy("registration_id").agg(F.sort_array(F.collect_set("field")).alias("f"), F.sort_array(F.collect_set("grade")).alias("g"), F.count("*").alias("candidates"))
    return each.select("registration_id", F.array_join("f", ",").alias("fields"), F.array_join("g", ",").alias("grades"), "candidates")


WINDOWS = {"1d": 1, "7d": 7, "30d": 30}


def report_conflicts(queue: DataFrame, today: Column, window: str = "7d", top_n: int = 10) -> DataFrame:
    """(part, name, conflict_count) of the queue's entries of a window: the fields most in dispute, the sources of their candidates, and each day.

    queue: field_name, created_at, candidates (array of structs with source_key). Candidates are unnested; those without source count as
    UNKNOWN, entries without candidates for no source. Ties go by name.
    """
    if window not in WINDOWS:
        raise ValueError(f"window must be one of {'/'.join(WINDOWS)}")
    recent = queue.where(F.col("created_at") >= F.date_sub(today, WINDOWS[window]))
    count = lambda df, part, name, top: _top(df.groupBy(name.cast("string").alias("name")).agg(F.count("*").alias("conflict_count")), top).select(F.lit(part).alias("part"), "name", "conflict_count")
    source = F.coalesce(F.nullif(F.col("c.source_key"), F.lit("")), F.lit("UNKNOWN"))
    sources = recent.select(F.explode("candidates").alias("c"))
    return count(recent, "field", F.col("field_name"), top_n).unionByName(count(sources, "source", source, top_n)).unionByName(count(recent, "day", F.to_date("created_at"), None))


def _top(df: DataFrame, n: int | None) -> DataFrame:
    return df if n is None else df.orderBy(F.desc("conflict_count"), "name").limit(n)


def conflict_report(spark, d) -> DataFrame:
    """The thirty days to the day: an entry a field in dispute, since its registration came, with all that was said of it."""
    late = contract_fields(spark, d).where("conflicts > 0").select("registration_id", "field")
    said = contract_observations(spark, d).join(late, ["registration_id", "field"])
    key = F.when(F.col("seq.company_id") % 5 > 0, F.concat(F.lit("S"), (F.col("seq.company_id") % 5).cast("string"))).otherwise("")
    each = said.groupBy("registration_id", F.col("field").alias("field_name")).agg(F.collect_list(F.struct(key.alias("source_key"), "value")).alias("candidates"))
    r = registrations(spark, d).select("registration_id", F.col("created_date").alias("created_at"))
    return report_conflicts(each.join(r, "registration_id"), F.lit(ASOF), "30d", 3)


_DI = "from outcomes where outcome = 'accepted' and udi_di not like 'reg:%'"
_LAST = "row_number() over (partition by udi_di order by registration_id desc, line desc, company_id desc, quantity desc) rn"
QUERIES = {
    "f39_mapped_records": (mapped_records, f"{MAPPED_SQL} select * exclude (registry_no) from mapped"),
    "q33_classified": (classified, f"with {CLASS_SQL} select p_partkey, is_ivd, cat ivd_category, subtypes, confidence, rule, array_to_string(hits, ',') hits, needs_review from classified"),
    "q34_scope_by_words": (scoped, SCOPE_SQL),
    "q31_ingest": (outcomes, f"{OUTCOME_SQL} select * from outcomes"),
    "q31_ingest_counts": (ingest_counts, f"{OUTCOME_SQL} select outcome, reason, count(*) n from outcomes group by 1, 2"),
    "q73_rejected_list": (rejected_list, f"{OUTCOME_SQL} select source_key, count(*) n, max(reason) reason from outcomes where outcome in ('invalid_name', 'filtered') and source_key ilike 'di:0000001%' group by 1 order by 1 limit 50"),
    "up23_companies": (new_companies, f"{OUTCOME_SQL}, t as (select company as name, case when company_id % 3 > 0 then country end country from companies where company_id % 2 = 0), s as (select company_name as name, max(company_country) country from outcomes where outcome = 'accepted' and company_name is not null group by 1) select coalesce(t.name, s.name) as name, coalesce(t.country, s.country) country from t full join s on t.name = s.name"),
    "q29_devices": (devices, f"{OUTCOME_SQL} select udi_di, number, name, status, ivd_category from (select *, {_LAST} {_DI}) where rn = 1"),
    "up7_device_mapping": (mapping, f"{OUTCOME_SQL} select udi_di, number, 'direct' match_type from (select *, {_LAST} {_DI}) where rn = 1"),
    "up20_pending_queue": (pending_queue, f"{OUTCOME_SQL} select source_key, max(reason) reason, count(*) n, case when right(source_key, 1) in ('1', '3', '5', '7', '9') then 'reopened' else 'open' end state from outcomes where outcome = 'pending' group by 1"),
    "q28_contract_fields": (contract_fields, f"{CONTRACT_SQL} select * from contract"),
    "q30_contract_summary": (contract_summary, f"{CONTRACT_SQL} select field, cast(sum(applied) as bigint) applied, cast(sum(kept) as bigint) kept, cast(sum(conflicts) as bigint) conflicts, count(*) filter (where conflicts > 0) disputed from contract group by 1"),
    "q57_conflict_report": (conflict_report, f"""{CONTRACT_SQL}, late as (select c.*, created_date from contract c join registrations using (registration_id) where conflicts > 0 and created_date >= date '{ASOF}' - 30),
      s as (select case when company_id % 5 > 0 then 'S' || (company_id % 5) else 'UNKNOWN' end as name from o join late using (registration_id, field))
      select 'field' part, field as name, count(*) conflict_count from late group by 2 union all select * from (select 'source', name, count(*) n from s group by 2 order by n desc, name limit 3) union all select 'day', cast(created_date as varchar), count(*) from late group by 2"""),
    "ag19_conflict_queue": (conflict_queue, f"{CONTRACT_SQL} select registration_id, string_agg(distinct o.field, ',' order by o.field) fields, string_agg(distinct chr(cast(69 - g as integer)), ',' order by chr(cast(69 - g as integer))) grades, count(*) candidates from o join (select registration_id, field from contract where conflicts > 0) x using (registration_id, field) group by 1"),
}
