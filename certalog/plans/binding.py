"""Domain tables over the given ones, as plans and as the SQL that states the same."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from certalog.session import table

#: The day that the queries look from; nothing reads the clock.
ASOF = DAY = datetime.date(2001, 1, 1)
#: Days by which events come before their time, so that they lie around the day and among the registrations.
SHIFT = 8419


def registrations(spark: SparkSession, d: str) -> DataFrame:
    """One row an order: approval unknown for status P; expiry five years on."""
    o = table(spark, d, "orders")
    day = F.col("o_orderdate").cast("date")
    return o.select(
        F.col("o_orderkey").alias("registration_id"),
        F.concat(F.lit("REG"), F.lpad(F.col("o_orderkey").cast("string"), 10, "0")).alias("registration_no"),
        F.when(F.col("o_orderstatus") != "P", day).alias("approval_date"),
        F.date_add(day, 1825).alias("expiry_date"),
        F.when(F.col("o_orderstatus") == "F", "active").when(F.col("o_orderstatus") == "O", "cancelled").alias("status"),
        day.alias("created_date"),
        F.col("o_custkey").alias("owner_id"),
    )


def lines(spark: SparkSession, d: str) -> DataFrame:
    """One row a product: an order line, without what only its part knows."""
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("registration_id"),
        F.col("l_linenumber").alias("line"),
        F.col("l_partkey").alias("part_id"),
        F.col("l_suppkey").alias("company_id"),
        (F.col("l_returnflag") != "R").alias("is_ivd"),
        F.col("l_shipdate").cast("date").alias("updated_date"),
        F.col("l_quantity").alias("quantity"),
        F.when(F.col("l_linestatus") == "F", F.col("l_shipdate").cast("date")).alias("approved_date"),
    )


def products(spark: SparkSession, d: str) -> DataFrame:
    """One row a product with its part: name, track and methodology."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("part_id"), F.col("p_name").alias("name"), F.col("p_type").alias("category"), F.col("p_brand").alias("methodology"))
    return lines(spark, d).join(p, "part_id").select(
        "registration_id", "line", "part_id", "company_id", "name", "category", "methodology", "is_ivd", "updated_date", "quantity", "approved_date"
    )


def snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Register snapshots: one row a returned line, ten days after it was shipped."""
    r = table(spark, d, "lineitem").where((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O"))
    return r.select(F.col("l_orderkey").alias("registration_id"), F.date_add(F.col("l_shipdate").cast("date"), 10).alias("snapshot_date"))


def companies(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    return table(spark, d, "supplier").join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).select(  # 25 nations
        F.col("s_suppkey").alias("company_id"), F.col("s_name").alias("company"), F.col("n_name").alias("country"), F.col("s_acctbal").alias("balance")
    )


KINDS = {"signup": "approve", "purchase": "renew", "error": "cancel", "click": "change"}


def changes(spark: SparkSession, d: str) -> DataFrame:
    """Registration events and change log: one row an event, of its user as entity; views are no change."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts") - F.expr(f"interval {SHIFT} days"))
    kind = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])[F.col("event_type")]
    return e.select(
        "event_id", "ts", F.col("ts").cast("date").alias("day"), F.col("user_id").alias("entity_id"), kind.alias("kind"), "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    ).where("kind is not null")


SQL = f"""
with registrations as (
  select o_orderkey registration_id, 'REG' || lpad(cast(o_orderkey as varchar), 10, '0') registration_no,
    case when o_orderstatus <> 'P' then cast(o_orderdate as date) end approval_date,
    cast(cast(o_orderdate as date) + interval 1825 day as date) expiry_date,
    case o_orderstatus when 'F' then 'active' when 'O' then 'cancelled' end status,
    cast(o_orderdate as date) created_date, o_custkey owner_id
  from orders),
products as (
  select l_orderkey registration_id, l_linenumber line, l_partkey part_id, l_suppkey company_id, p_name as name, p_type category,
    p_brand methodology, l_returnflag <> 'R' is_ivd, cast(l_shipdate as date) updated_date, l_quantity quantity,
    case when l_linestatus = 'F' then cast(l_shipdate as date) end approved_date
  from lineitem join part on l_partkey = p_partkey),
snapshots as (
  select l_orderkey registration_id, cast(l_shipdate as date) + 10 snapshot_date from lineitem where l_returnflag = 'R' and l_linestatus = 'O'),
companies as (
  select s_suppkey company_id, s_name company, n_name country, s_acctbal balance from supplier join nation on s_nationkey = n_nationkey),
changes as (
  select event_id, ts - interval {SHIFT} day ts, cast(ts - interval {SHIFT} day as date) as day, user_id entity_id,
    case event_type when 'signup' then 'approve' when 'purchase' then 'renew' when 'error' then 'cancel' when 'click' then 'change' end kind,
    value, cast(json_extract_string(props, '$.k') as integer) k
  from events where event_type in ('signup', 'purchase', 'error', 'click')),
today as (select date '{ASOF}' d, date '{DAY}' e)
"""
