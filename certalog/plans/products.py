"""Accepted records written into products."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from certalog.operators import tables
from certalog.operators.upsert import TRACKED, upsert_products
from certalog.plans.binding import registrations
from certalog.plans.ingest import OUTCOME_SQL, outcomes
from certalog.session import staged

_STATE = "status, cast(expiry_date as varchar) expiry_date, cast(approved_date as varchar) approved_date, company_id, registration_id, name, number as reg_no, udi_di"


def records(spark, d) -> DataFrame:
    """Accepted rows with all that a product keeps, as they come: by registration, line, part, company and quantity."""
    a = outcomes(spark, d).where("outcome = 'accepted'")
    seq = F.format_string("%012d-%02d-%010d-%010d-%05d", "registration_id", "line", "part_id", "company_id", F.col("quantity").cast("int"))
    return a.select(
        seq.alias("seq"), "line", "part_id", "status", F.col("expiry_date").cast("string").alias("expiry_date"), F.col("approved_date").cast("string").alias("approved_date"), "company_id",
        "registration_id", "name", F.col("number").alias("reg_no"), "udi_di", F.lit(None).cast("string").alias("class_name"),
    ).distinct()


def known_products(spark, d, rows: DataFrame) -> DataFrame:
    """Products before the run: of each device of even number its newest row of an even line, every fifth from a source that ranks above the
    run, and one without device for every third registration."""
    r = rows.where("line % 2 = 0 and part_id % 2 = 0 and udi_di not like 'reg:%'")
    own = tables.latest(r, ["udi_di"], [F.desc("seq")]).select(F.concat(F.lit("di"), "udi_di").alias("product_id"), F.lit("2000").alias("updated_at"), (F.col("part_id") % 10 == 0).alias("locked"), *TRACKED)
    bare = registrations(spark, d).where("registration_id % 3 = 0")
    empty = lambda f: F.lit(None).cast(dict(own.dtypes)[f]).alias(f)
    cells = {"registration_id": F.col("registration_id"), "reg_no": F.col("registration_no").alias("reg_no"), "status": F.lit("active").alias("status")}
    return own.unionByName(bare.select(F.concat(F.lit("reg"), F.col("registration_id").cast("string")).alias("product_id"), F.lit("2100").alias("updated_at"), F.lit(False).alias("locked"), *[cells.get(f, empty(f)) for f in TRACKED]))


def product_upsert(spark, d) -> DataFrame:
    """What the rows of odd lines do to the products, row by row."""
    rows = staged(records(spark, d))
    return upsert_products(known_products(spark, d, rows), rows.where("line % 2 = 1").drop("line", "part_id"))


_BEFORE = ", ".join(f"case when locked then o_{f} else coalesce(last_value({f} ignore nulls) over (partition by product order by seq rows between unbounded preceding and 1 preceding), o_{f}) end b_{f}" for f in TRACKED)
_AFTER = ", ".join(f"case when locked then o_{f} else coalesce(last_value({f} ignore nulls) over (partition by product order by seq rows between unbounded preceding and current row), o_{f}) end a_{f}" for f in TRACKED)
SQL = f"""{OUTCOME_SQL},
rec as (select distinct printf('%012d-%02d-%010d-%010d-%05d', registration_id, line, part_id, company_id, cast(quantity as integer)) seq, line, part_id, {_STATE}, null::varchar class_name from outcomes where outcome = 'accepted'),
batch as (select * from rec where line % 2 = 1),
own as (select 'di' || udi_di product_id, part_id % 10 = 0 locked, {", ".join(TRACKED)} from (select *, row_number() over (partition by udi_di order by seq desc) rn from rec where line % 2 = 0 and part_id % 2 = 0 and udi_di not like 'reg:%') where rn = 1),
old as (select * from own union all select 'reg' || registration_id, false, 'active', null, null, null, registration_id, null, registration_no, null, null from registrations where registration_id % 3 = 0),
k as (select b.*, o.product_id known, case when o.locked then o.registration_id else b.registration_id end at_r, case when o.locked then o.reg_no else b.reg_no end at_n,
  coalesce(lead(b.seq) over (partition by b.udi_di order by b.seq), '~') upto, row_number() over (partition by b.udi_di order by b.seq) = 1 is_first from batch b left join own o on o.udi_di = b.udi_di),
busy as (select *, coalesce(max(upto) over (partition by at_r, at_n order by seq rows between unbounded preceding and 1 preceding) > seq, false) here,
  coalesce(max(upto) over (partition by at_r order by seq rows between unbounded preceding and 1 preceding) > seq, false) near from k),
touched as (select udi_di, min(seq) seq from batch group by 1),
free as (select *, row_number() over (partition by registration_id order by seq) rn from busy f where is_first and known is null and not here and registration_id % 3 = 0
  and (reg_no = (select registration_no from registrations r where r.registration_id = f.registration_id)
    or not near and not exists (select 1 from own o left join touched t on t.udi_di = o.udi_di where o.registration_id = f.registration_id and o.reg_no = f.reg_no and coalesce(t.seq, '~') > f.seq))),
product as (select b.*, coalesce(b.known, 'reg' || f.registration_id, 'new:' || b.udi_di) product from busy b left join free f on f.udi_di = b.udi_di and f.rn = 1),
joined as (select p.*, o.product_id is null fresh, coalesce(o.locked, false) locked, {", ".join(f"o.{f} o_{f}" for f in TRACKED)} from product p left join old o on o.product_id = p.product),
states as (select *, {_BEFORE}, {_AFTER}, row_number() over (partition by product order by seq) n from joined),
judged as (select *, array_to_string(list_filter([{", ".join(f"case when b_{f} is distinct from a_{f} then '{f}' end" for f in TRACKED)}], lambda x: x is not null), ',') changed, fresh and n = 1 is_new from states)
select seq, product, case when is_new then 'added' when changed = '' then 'unchanged' when a_status in ('cancelled', 'expired') then 'removed' else 'updated' end as action,
  case when is_new then 'new' when changed = '' then 'noop' when a_status = 'cancelled' then 'cancel' when a_status = 'expired' then 'expire' else 'update' end change_type, changed,
  {", ".join(f"a_{f} {f}" for f in TRACKED)} from judged
"""
QUERIES = {"q32_product_upsert": (product_upsert, SQL)}
