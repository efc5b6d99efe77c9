"""Field rules of register records as column expressions: status, dates, units, packings, hashes, ladders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from certalog.functions.text import CJK, first_text, half_width

#: Words and codes that must match the source's (fixed values).
INACTIVE = ("cancelled", "canceled", "expired", "inactive", "注销", "已注销", "失效", "过期", "作废")
PLACEHOLDERS = ("na", "n/a", "null", "none", "unknown", "test", "demo", "-", "--", "/", "_")
NO_NUMBER = ("", "-", "--", "/", "n/a", "na", "null", "none", "unknown")
CANCEL_WORDS = ("注销", "撤销", "失效", "停止", "取消", "不予注册")
YES, NO = ("是", "Y", "YES", "True", "TRUE", "1"), ("否", "N", "NO", "False", "FALSE", "0")
UNITS = {
    "h": ("hours", "hour", "hrs", "hr", "小时", "时"),
    "min": ("minutes", "minute", "mins", "min", "分钟", "分"),
    "day": ("days", "day", "天"),
    "month": ("months", "month", "月"),
    "year": ("years", "year", "年"),
    "C": ("°c", "℃", "c", "摄氏度"),
    "mL": ("ml",),
    "uL": ("ul",),
    "IU/mL": ("iu/ml",),
    "copies/mL": ("copies/ml",),
    "ng/mL": ("ng/ml",),
}
SEVERITY = {
    "registration_no": "HIGH", "status": "HIGH", "expiry_date": "HIGH", "approval_date": "MED", "filing_no": "MED", "product_name": "MED",
    "class": "MED", "model": "LOW", "specification": "LOW",
}


def blank(c: Column) -> Column:
    """Null for a text that is null or blank, else the text without white space at its ends."""
    return F.nullif(F.btrim(c, F.lit(" \t\n\x0b\f\r")), F.lit(""))


def clip(c: Column, most: int) -> Column:
    return F.substring(blank(c), 1, most)


def norm_key(c: Column) -> Column:
    """Half-width, without white space, in capitals; letters, digits and Han characters only; null if nothing is left."""
    return F.nullif(F.regexp_replace(F.upper(F.regexp_replace(half_width(c), r"\s+", "")), f"[^0-9A-Z{CJK}]+", ""), F.lit(""))


def norm_token(c: Column) -> Column:
    return F.lower(F.trim(F.translate(c, "（）", "()")))


def local_key(c: Column) -> Column:
    """Number of a local register: white space dropped, parentheses half-width, case kept."""
    return F.translate(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", ""), "（）", "()")


def active(status: Column) -> Column:
    """No status, or one that doesn't say otherwise."""
    return ~F.lower(F.trim(F.coalesce(status, F.lit("")))).isin(*INACTIVE)


def status_of(status: Column, expiry: Column, asof: Column) -> Column:
    """cancelled if the text says so, else expired if past the day, else the text; active if there is none."""
    text = F.lower(F.trim(F.coalesce(status, F.lit(""))))
    return F.when(text.contains("注销") | text.contains("cancel"), "cancelled").when(expiry < asof, "expired").when(text != "", text).otherwise("active")


def tracked_state(status: Column) -> Column:
    """expired, cancelled or active by the status word alone."""
    low = F.lower(F.coalesce(status, F.lit("")))
    return F.when((low == "expired") | (low == "过期"), "expired").when((low == "cancelled") | (low == "注销"), "cancelled").otherwise("active")


def domestic(country: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(country, F.lit(""))))
    return (low == "cn") | low.contains("china") | low.contains("中国")


def valid_name(c: Column) -> Column:
    """Not blank, no placeholder, and with a letter, digit or Han character."""
    text = F.coalesce(blank(c), F.lit(""))
    return (text != "") & ~F.lower(text).isin(*PLACEHOLDERS) & text.rlike(r"[\p{L}\p{N}]")


def punctuation_only(c: Column) -> Column:
    text = F.coalesce(blank(c), F.lit(""))
    return (text != "") & ~text.rlike(r"[\p{L}\p{N}]")


def without_number(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c, F.lit("")))).isin(*NO_NUMBER)


def record_date(c: Column, last_year: int) -> Column:
    """Date from ISO text, slashes as hyphens, of the first ten characters; none of a year after last_year."""
    day = F.try_to_date(F.substring(F.replace(F.trim(c), F.lit("/"), F.lit("-")), 1, 10), "yyyy-MM-dd")
    return F.when(F.year(day) <= last_year, day)


def whole_date(c: Column) -> Column:
    """Date from the whole text in one of four spellings."""
    text = F.trim(c)
    return F.coalesce(*[F.when(F.length(text) == len(f), F.try_to_date(text, f)) for f in ("yyyy-MM-dd", "yyyy/MM/dd", "yyyy.MM.dd", "yyyyMMdd")])


def found_date(c: Column) -> Column:
    """The first date of this century within a text, months and days of one digit or two."""
    return F.try_to_date(F.nullif(F.regexp_extract(c, r"(20\d\d-\d{1,2}-\d{1,2})", 1), F.lit("")), "yyyy-M-d")


def whole_number(c: Column) -> Column:
    """Integer part of a number in any spelling; null if it is none."""
    return F.trim(c).try_cast("double").cast("int")


def said_yes(c: Column) -> Column:
    """True or false for the spellings of yes and no; null for all else."""
    text = blank(c)
    return F.when(text.isin(*YES), True).when(text.isin(*NO), False)


def unit(c: Column) -> Column:
    """One spelling for each unit; others as they are, with u for micro."""
    plain = F.translate(F.nullif(F.trim(c), F.lit("")), "μµ", "uu")
    out = F.when(F.lower(plain).isin(*next(iter(UNITS.values()))), next(iter(UNITS)))
    for name, words in list(UNITS.items())[1:]:
        out = out.when(F.lower(plain).isin(*words), name)
    return out.otherwise(plain)


_NUMBER, _UNIT = r"(\d+(?:\.\d+)?)", r"([a-zA-Zμµ°℃/%]+)"
_RANGE = _NUMBER + r"\s*(?:-|~|－|—|至|到)\s*" + _NUMBER


def extracted_value(line: Column) -> Column:
    """(value_num, value_text, unit, range_low, range_high) from the first that the line has: range with unit, per cent, number with unit, else its text."""
    spread, share, single = _RANGE + r"\s*" + _UNIT, _NUMBER + r"\s*%", _NUMBER + r"\s*" + _UNIT
    number = lambda p, g: F.regexp_extract(line, p, g).try_cast("double")

    def value(num=None, text=None, of=None, low=None, high=None) -> Column:
        parts = ((num, "value_num", "double"), (text, "value_text", "string"), (of, "unit", "string"), (low, "range_low", "double"), (high, "range_high", "double"))
        return F.struct(*[(F.lit(None) if c is None else c).cast(kind).alias(name) for c, name, kind in parts])

    return (
        F.when(line.rlike(spread), value(of=unit(F.regexp_extract(line, spread, 3)), low=number(spread, 1), high=number(spread, 2)))
        .when(line.rlike(share), value(num=number(share, 1), of=F.lit("%")))
        .when(line.rlike(single), value(num=number(single, 1), of=unit(F.regexp_extract(line, single, 2))))
        .otherwise(value(text=F.substring(F.trim(line), 1, 500)))
    )


def storage_range(low: Column, high: Column, of: Column) -> Column:
    """'low-highunit' of text values, or the one side that is there."""
    both = low.isNotNull() & high.isNotNull()
    return F.when(both, F.concat(low, F.lit("-"), high, F.coalesce(of, F.lit("")))).otherwise(blank(F.concat(F.coalesce(low, high, F.lit("")), F.coalesce(of, F.lit("")))))


def storages(items: Column) -> Column:
    """Storage items without those that say nothing, each with its range."""
    named = F.transform(items, lambda x: F.struct(*[blank(x[c]).alias(c) for c in ("type", "min", "max", "unit", "range")]))
    some = F.filter(named, lambda x: F.coalesce(x["type"], x["min"], x["max"], x["unit"], x["range"]).isNotNull())
    return F.transform(some, lambda x: F.struct(x["type"].alias("type"), x["min"].try_cast("double").alias("min"), x["max"].try_cast("double").alias("max"), x["unit"].alias("unit"), F.coalesce(x["range"], storage_range(x["min"], x["max"], x["unit"])).alias("range")))


def storage_summary(items: Column) -> Column:
    """The ranges of up to a hundred storages, ten different ones at most, joined by '; '; null of none."""
    of = lambda x: F.coalesce(x["unit"], F.lit(""))
    told = F.transform(
        F.slice(items, 1, 100),
        lambda x: F.coalesce(
            blank(x["range"]),
            F.concat(blank(x["min"]), F.lit("~"), blank(x["max"]), of(x)),
            F.concat(F.lit(">="), blank(x["min"]), of(x)),
            F.concat(F.lit("<="), blank(x["max"]), of(x)),
            blank(x["type"]),
        ),
    )
    return F.nullif(F.array_join(F.slice(F.array_distinct(F.array_compact(told)), 1, 10), "; "), F.lit(""))


def packings(items: Column) -> Column:
    """Packing items that have a device number."""
    named = F.transform(items, lambda x: F.struct(*[blank(x[c]).alias(c) for c in ("package_di", "package_level", "contains_qty", "child_di")]))
    return F.filter(named, lambda x: x["package_di"].isNotNull())


def payload_hash(**fields: Column) -> Column:
    """SHA-256 of the fields as compact JSON with sorted keys, nulls kept."""
    body = F.struct(*[fields[k].alias(k) for k in sorted(fields)])
    return F.sha2(F.to_json(body, {"ignoreNullFields": "false"}), 256)


def event_hash(registration: Column, kind: Column, day: Column, upto: Column) -> Column:
    """Key of an event: registration, type, day and end, empty where there is none."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in (registration, kind, day, upto)]), 256)


def reject_key(di: Column, number: Column, name: Column, raw: Column) -> Column:
    """What a rejected row is known by: device number, else registration number, else name, else a hash of the row."""
    told = [F.concat(F.lit(p), blank(c)) for p, c in (("di:", di), ("reg:", number), ("name:", name))]
    return F.coalesce(*told, F.concat(F.lit("rawsha:"), F.sha2(F.coalesce(raw, F.lit("")), 256)))


def _steps(low: Column, mid: Column, names: Sequence[str]) -> tuple[Column, Column]:
    """(level, score) of a ladder of three: the last name where low is met, then mid, then the first."""
    return F.when(low, names[2]).when(mid, names[1]).otherwise(names[0]), F.when(low, 85.0).when(mid, 55.0).otherwise(25.0)


def registration_ladder(days: Column, renewed: Column, density: Column) -> tuple[Column, Column]:
    """(level, score): by days to expiry (unknown: medium), one step down if renewed, one step up in a crowd of 300."""
    base = F.when(days.isNull(), 1).when(days <= 90, 2).when(days <= 180, 1).otherwise(0)
    step = F.least(F.lit(2), F.greatest(F.lit(0), base - renewed.cast("int")) + (density >= 300).cast("int"))
    return _steps(step == 2, step == 1, ("low", "medium", "high"))


def track_ladder(total: Column, new_rate: Column) -> tuple[Column, Column]:
    return _steps((total > 200) | (new_rate > 0.5), (total >= 50) | (new_rate >= 0.2), ("blue", "moderate", "red"))


def company_ladder(new: Column, tracks: Column) -> tuple[Column, Column]:
    return _steps((new >= 30) | (tracks >= 3), (new >= 10) | (tracks >= 1), ("weak", "medium_growth", "strong"))


def factor(factors: Column, name: str) -> Column:
    """Value of the first factor of a name; null if there is none."""
    return F.get(F.filter(factors, lambda x: x["name"] == name), 0)["value"]


def lifecycle_summary(days: Column, renewed: Column, density: Column) -> Column:
    left = F.coalesce(F.concat(days.cast("string"), F.lit("d")), F.lit("unknown"))
    return F.concat_ws("; ", F.concat(F.lit("expiry:"), left), F.concat(F.lit("renew:"), renewed.cast("string")), F.concat(F.lit("density:"), density.cast("string")))


def change_type(status: Column, changed: Column) -> Column:
    """cancel over expire over update over noop."""
    return F.when(status == "cancelled", "cancel").when(status == "expired", "expire").when(changed, "update").otherwise("noop")


def register_change(known: Column, old_status: Column, new_status: Column, old_expiry: Column, new_expiry: Column) -> Column:
    """REGISTER, CANCEL, RENEW or MODIFY of two states of a registration."""
    was, now = (F.lower(F.coalesce(c, F.lit(""))) for c in (old_status, new_status))
    return F.when(~known, "REGISTER").when((was != "cancelled") & (now == "cancelled"), "CANCEL").when(new_expiry > old_expiry, "RENEW").otherwise("MODIFY")


def severity(field: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for p in SEVERITY.items() for x in p])[field], F.lit("LOW"))


def looks_cancelled(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike("|".join(CANCEL_WORDS))


def month_valid(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^\d{4}-(0[1-9]|1[0-2])$"), F.lit(False))


def checksum_matches(found: Column, expected: Column) -> Column:
    """Compared without regard to case; nothing expected passes."""
    return F.coalesce(F.lower(found) == F.lower(blank(expected)), F.lit(True))


def grade(c: Column, default: str = "C") -> Column:
    up = F.upper(F.trim(F.coalesce(c, F.lit(default))))
    return F.when(up.isin("A", "B", "C", "D"), up).otherwise(default)


def parse_status(number: Column, di: Column, error: Column) -> Column:
    return F.when((F.coalesce(error, F.lit("")) != "") | (F.coalesce(di, F.lit("")) == ""), "FAILED").when(F.coalesce(number, F.lit("")) != "", "PARSED").otherwise("PENDING_REG_NO")


def model_spec(model: Column, sku: Column) -> Column:
    """'model / sku', or whichever is there."""
    return F.nullif(F.concat_ws(" / ", blank(model), blank(sku)), F.lit(""))


def class_hint(*codes: Column) -> Column:
    return first_text(*codes)


def company_raw_name(linked: Column, raw: Column, keys: Sequence[str]) -> Column:
    """The linked company's name, else the first of some keys of the raw record."""
    return first_text(linked, *[F.get_json_object(raw, f"$.{k}") for k in keys])


def text_blob(parts: Column, most: int = 20_000) -> Column:
    return F.left(F.array_join(parts, " "), F.lit(most))


def candidates(*sources: tuple[Column, Column, Column]) -> Column:
    """Conflict candidates as (source, value, observed) of those that have a value."""
    made = [F.when(blank(v).isNotNull(), F.struct(s.alias("source"), blank(v).alias("value"), o.alias("observed"))) for s, v, o in sources]
    return F.array_compact(F.array(*made))


def stub_state(raw: Column) -> Column:
    """(is_stub, hint, verified) of a raw record's _stub part; verified in any spelling of true."""
    there = F.get_json_object(raw, "$._stub")
    verified = F.lower(F.coalesce(F.get_json_object(raw, "$._stub.verified_by_nmpa"), F.lit(""))).isin("1", "true", "yes", "y")
    return F.struct(there.isNotNull().alias("is_stub"), F.get_json_object(raw, "$._stub.source_hint").alias("hint"), verified.alias("verified"))


def shown(raw: Column) -> Column:
    """Not an unverified stub of the device register."""
    hint = F.coalesce(F.get_json_object(raw, "$._stub.source_hint"), F.lit(""))
    return (hint != "UDI") | (F.coalesce(F.get_json_object(raw, "$._stub.verified_by_nmpa"), F.lit("true")) == "true")
