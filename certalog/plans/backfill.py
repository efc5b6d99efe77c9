"""Parameters of devices taken over in batches, and registration anchors filled in where that is unambiguous."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from certalog.functions import fields
from certalog.functions.text import registration_key
from certalog.operators import tables
from certalog.plans.binding import SQL, lines, registrations
from certalog.session import table
from certalog.streaming.ledger import Ledger, key_ranges

#: Parameters that devices give, and the device field of each (fixed values).
ALLOWED = {
    "STORAGE": "storages", "STERILIZATION_METHOD": "mjfs", "SPECIAL_STORAGE_COND": "tscchcztj", "SPECIAL_STORAGE_NOTE": "tsccsm",
    "LABEL_SERIAL_NO": "scbssfbhxlh", "LABEL_PROD_DATE": "scbssfbhscrq", "LABEL_EXP_DATE": "scbssfbhsxrq", "LABEL_LOT": "scbssfbhph",
}
PARAM_KEYS = ["product_id", "param_code"]


def device_params(devices: DataFrame, bound: DataFrame, allow: Sequence[str] = tuple(ALLOWED)) -> DataFrame:
    """(product_id, param_code, value_text, di, registry_no, observed_at): of each product and allowed code the newest value of its devices.

    devices: di, registry_no, observed_at and the fields of ALLOWED (storages an array, the others texts; missing columns have nothing to
    say); bound: registry_no, product_id of the products in scope. Values that are null or blank don't count; ties go to the larger di, then text.
    """
    there = set(devices.columns)
    value = {c: fields.storage_summary(F.col(f)) if c == "STORAGE" else fields.blank(F.col(f)) for c, f in ALLOWED.items() if c in allow and f in there}
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("param_code"), v.alias("value_text")) for c, v in value.items()])).alias("e")
    told = devices.where(fields.blank(F.col("di")).isNotNull()).select("di", "registry_no", "observed_at", each).select("di", "registry_no", "observed_at", "e.*").where("value_text is not null")
    return newest(told.join(bound.select("registry_no", "product_id"), "registry_no").select(*PARAM_KEYS, "value_text", "di", "registry_no", "observed_at"))


def newest(params: DataFrame) -> DataFrame:
    return tables.latest(params, PARAM_KEYS, [F.col(c).desc_nulls_last() for c in ("observed_at", "di", "value_text")])


def write_params(ledger: Ledger, devices: DataFrame, bound: DataFrame, size: int = 50_000, allow: Sequence[str] = tuple(ALLOWED), most: int | None = None) -> int:
    """device_params into a ledger, size devices at a time in the order of di, the cursor published with each version: how many batches ran.

    A run that ends anywhere goes on after the last batch that was published. A batch's values win over published ones only if
    they are newer, so that the cut makes no difference: in the end the table is device_params of all devices.
    """
    apply = lambda old, batch: device_params(batch, bound, allow) if old is None else newest(old.unionByName(device_params(batch, bound, allow)))
    return ledger.advance(key_ranges(devices, "di", size), apply, lambda batch: batch.agg(F.max("di")).first()[0], most)


def fill_anchors(products: DataFrame, known: DataFrame, variants: DataFrame) -> DataFrame:
    """(product_id, reg_no, registration_id, how): the anchor of every product after the backfill.

    products: product_id, reg_no, registration_id; known: registration_id, registration_no; variants: variant_id, product_id, registry_no. Numbers become keys. A key that one
    registration has anchors products without anchor (filled); one that several have is ambiguous and never does; one that none has makes a registration, whose
    id is 'new:' and the key (created). Products without number take their variants' number, the first by variant_id that is known and not
    ambiguous (variant). kept: had an anchor; none: nothing to go by. Each step takes by equi-joins on keys what the one before left.
    """
    key = lambda c: registration_key(F.col(c))
    owners = known.select(key("registration_no").alias("k"), F.col("registration_id").cast("string").alias("rid")).where("k is not null").groupBy("k").agg(F.min("rid").alias("rid"), F.count_distinct("rid").alias("n"))
    p = products.select("product_id", key("reg_no").alias("k"), F.col("registration_id").cast("string").alias("own"))
    p = p.join(owners, "k", "left")
    made = F.col("k").isNotNull() & F.col("n").isNull()
    anchor = F.when(made, F.concat(F.lit("new:"), "k")).when(F.col("n") == 1, F.col("rid"))
    p = p.withColumns({"anchor": F.coalesce("own", anchor), "made": made})
    bare = p.where("anchor is null and k is null").select("product_id")
    new = p.where("made").select("k", F.concat(F.lit("new:"), "k").alias("rid"), F.lit(1).cast("long").alias("n")).distinct()
    v = variants.select("product_id", "variant_id", key("registry_no").alias("k")).join(bare, "product_id", "left_semi").join(owners.unionByName(new), "k").where("n = 1")
    v = v.groupBy("product_id").agg(F.min_by("rid", "variant_id").alias("by_variant"))
    out = p.join(v, "product_id", "left")
    how = (
        F.when(F.col("own").isNotNull(), "kept").when(F.col("made"), "created").when(F.col("anchor").isNotNull(), "filled").when(F.col("n") > 1, "ambiguous")
        .when(F.col("by_variant").isNotNull(), "variant").otherwise("none")
    )
    return out.select("product_id", F.col("k").alias("reg_no"), F.coalesce("anchor", "by_variant").alias("registration_id"), how.alias("how"))


# The given tables


def devices(spark, d) -> DataFrame:
    """A device row an order line: storage by the part's size, label and sterilisation by its words."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("part_id"), "p_type", "p_brand", "p_size")
    q = F.col("quantity").cast("int")
    item = F.struct(F.lit(None).cast("string").alias("type"), F.col("p_size").cast("string").alias("min"), (F.col("p_size") + F.col("line")).cast("string").alias("max"), F.lit("C").alias("unit"), F.lit(None).cast("string").alias("range"))
    return lines(spark, d).join(p, "part_id").select(
        F.format_string("%08d", "part_id").alias("di"), F.col("registration_id").alias("registry_no"), F.col("updated_date").alias("observed_at"), F.array(item).alias("storages"),
        F.when(q % 3 == 0, F.concat(F.lit(" "), "p_type")).when(q % 3 == 1, " ").alias("mjfs"), F.when(q % 5 > 0, F.col("p_brand")).alias("scbssfbhph"),
    )


def products_in_scope(spark, d) -> DataFrame:
    return lines(spark, d).where("is_ivd").select(F.col("registration_id").alias("registry_no"), F.concat_ws("-", "registration_id", "line", "part_id").alias("product_id")).distinct()


def allowed_params(spark, d) -> DataFrame:
    return device_params(devices(spark, d), products_in_scope(spark, d))


def anchors_filled(spark, d) -> DataFrame:
    """Order lines as products with numbers spelt in several ways; every fiftieth registration has a twin of another spelling."""
    r = registrations(spark, d).select("registration_id", "registration_no")
    dashed = lambda c: F.concat(F.lit("REG-"), F.substring(c, 4, 10))
    known = r.unionByName(r.where("registration_id % 50 = 0").select((-1 - F.col("registration_id")).alias("registration_id"), dashed("registration_no").alias("registration_no")))
    q = F.col("quantity").cast("int")
    rows = lines(spark, d).join(r, "registration_id").withColumn("product_id", F.concat_ws("-", "registration_id", "line", "part_id", "company_id", q.cast("string"))).distinct()
    number = F.when(q % 4 == 0, F.col("registration_no")).when(q % 4 == 1, dashed("registration_no")).when(q % 4 == 3, F.concat(F.lit("NEW "), (F.col("part_id") % 100).cast("string")))
    p = rows.select("product_id", F.when(q % 4 == 3, F.replace(number, F.lit(" "), F.lit("/"))).otherwise(number).alias("reg_no"), F.when(q % 3 > 0, F.col("registration_id")).alias("registration_id"))
    v = rows.where(q % 8 == 2).select(F.col("product_id").alias("variant_id"), "product_id", F.col("registration_no").alias("registry_no"))
    return fill_anchors(p, known, v)


PARAM_SQL = f"""{SQL},
dev as (select lpad(cast(l_partkey as varchar), 8, '0') di, l_orderkey registry_no, cast(l_shipdate as date) observed_at, p_size || '~' || (p_size + l_linenumber) || 'C' s, case when cast(l_quantity as integer) % 3 = 0 then p_type end m, case when cast(l_quantity as integer) % 5 > 0 then p_brand end b from lineitem join part on l_partkey = p_partkey),
bound as (select distinct l_orderkey registry_no, l_orderkey || '-' || l_linenumber || '-' || l_partkey product_id from lineitem where l_returnflag <> 'R'),
e as (select product_id, unnest(['STORAGE', 'STERILIZATION_METHOD', 'LABEL_LOT']) param_code, unnest([s, m, b]) value_text, di, registry_no, observed_at from dev join bound using (registry_no)),
r as (select *, row_number() over (partition by product_id, param_code order by observed_at desc, di desc, value_text desc) rn from e where value_text is not null)
select product_id, param_code, value_text, di, registry_no, observed_at from r where rn = 1
"""
ANCHOR_SQL = f"""{SQL},
known as (select registration_id, registration_no k from registrations union all select -1 - registration_id, registration_no from registrations where registration_id % 50 = 0),
own as (select k, min(cast(registration_id as varchar)) rid, count(*) n from known group by 1),
l as (select distinct l_orderkey o, l_linenumber, l_partkey p, l_suppkey, cast(l_quantity as integer) q from lineitem),
p as (select o || '-' || l_linenumber || '-' || p || '-' || l_suppkey || '-' || q product_id, case q % 4 when 2 then null when 3 then 'NEW' || (p % 100) else registration_no end k, case when q % 3 > 0 then cast(o as varchar) end mine, q, registration_no from l join registrations on registration_id = o),
j as (select p.*, own.rid, own.n, vo.rid vrid, vo.n vn from p left join own on own.k = p.k left join own vo on vo.k = p.registration_no and q % 8 = 2)
select product_id, k reg_no, coalesce(mine, case when k is not null and n is null then 'new:' || k when n = 1 then rid end, case when k is null and vn = 1 then vrid end) registration_id,
  case when mine is not null then 'kept' when k is not null and n is null then 'created' when n = 1 then 'filled' when n > 1 then 'ambiguous' when k is null and vn = 1 then 'variant' else 'none' end how from j
"""
QUERIES = {"q45_allowed_params": (allowed_params, PARAM_SQL), "q72_anchors_filled": (anchors_filled, ANCHOR_SQL)}
