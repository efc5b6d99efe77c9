"""Upsert of records into products: a cascade of keys in which the rows of a batch see the earlier ones, and what each row changes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fields whose changes are logged, in the order of a product's state.
TRACKED = ("status", "expiry_date", "approved_date", "company_id", "registration_id", "name", "reg_no", "udi_di", "class_name")


def _attached(records: list[dict], products: list[dict]) -> list[tuple[str, str]]:
    """(udi_di, product_id) of one registration: which records, in order, take over a product without device.

    A record looks at the newest product of its number that is still there, else of the registration; one that has a device stays another's.
    """
    out, rest = [], sorted(products, key=lambda p: (p["updated_at"] is not None, p["updated_at"] or "", p["product_id"]), reverse=True)
    for r in sorted(records, key=lambda r: r["seq"]):
        there = [p for p in rest if p["touched"] is None or p["touched"] > r["seq"]]
        same = [p for p in there if p["reg_no"] == r["reg_no"]]
        newest = same[0] if same else None if r["busy"] else there[0] if there else None
        if newest is not None and newest["udi_di"] is None:
            out.append((r["udi_di"], newest["product_id"]))
            rest.remove(newest)
    return out


def _attach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = [x for records, products in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for x in _attached(records, products)]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in pairs], pa.string()) for k in (0, 1)], names=["udi_di", "product_id"])


def find_products(existing: DataFrame, records: DataFrame) -> DataFrame:
    """records with product_id: the product that each row meets, null for those of a product that the batch makes (one a device).

    existing: product_id, udi_di (null or blank for rows without device; else unique), registration_id, reg_no, updated_at, locked. records: seq
    (text, unique, in order), udi_di, registration_id, reg_no, none of them null. A record's product is that of its device, else the newest of its
    registration and number, else of its registration; but never one with another device. Records move a device's product to
    their registration and number, so that later ones of the batch find it there, until it moves on; not one that is locked, whose
    provenance ranks above the run.

    Devices, numbers and registrations are windows of their own: a device, or number, is met in a window's order and never gathered. Only
    products without device, and the first records of new devices in registrations with such products, are looked at together.
    """
    blank = F.nullif(F.trim("udi_di"), F.lit(""))
    old = existing.select(F.col("product_id").cast("string").alias("product_id"), blank.alias("udi_di"), "registration_id", "reg_no", F.col("updated_at").cast("string").alias("updated_at"), F.coalesce("locked", F.lit(False)).alias("locked"))
    device = Window.partitionBy("udi_di").orderBy("seq")
    known = old.where("udi_di is not null").select("udi_di", F.col("product_id").alias("_known"), *[F.when(F.col("locked"), F.col(c)).alias(f"_{c}") for c in ("registration_id", "reg_no")])
    r = records.join(known, "udi_di", "left")
    r = r.withColumns({f"_{c}": F.coalesce(f"_{c}", c) for c in ("registration_id", "reg_no")})
    r = r.withColumns({"_until": F.lead("seq").over(device), "_first": F.row_number().over(device) == 1})

    def busy(*keys: str):
        """Another device's product, of an earlier record, is there still."""
        before = Window.partitionBy(*keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.max(F.coalesce("_until", F.lit("\U0010ffff"))).over(before) > F.col("seq"), F.lit(False))

    r = r.withColumns({"_here": busy("_registration_id", "_reg_no"), "_near": busy("_registration_id")})
    bare = old.where("udi_di is null").select("registration_id").distinct()
    free = r.where("_first and _known is null and not _here").select("registration_id", "seq", "udi_di", "reg_no", F.col("_near").alias("busy")).join(bare, "registration_id", "left_semi")
    touched = records.groupBy("udi_di").agg(F.min("seq").alias("touched"))
    mine = free.groupBy("registration_id").agg(F.collect_list(F.struct("seq", "udi_di", "reg_no", "busy")).alias("records"))
    theirs = old.join(bare, "registration_id", "left_semi").join(touched, "udi_di", "left")
    theirs = theirs.groupBy("registration_id").agg(F.collect_list(F.struct("product_id", "udi_di", "reg_no", "updated_at", "touched")).alias("products"))
    taken = mine.join(theirs, "registration_id").select("records", "products").mapInArrow(_attach, "udi_di string, product_id string")
    return r.drop("_until", "_first", "_here", "_near", "_registration_id", "_reg_no").join(taken, "udi_di", "left").withColumn("product_id", F.coalesce("_known", "product_id")).drop("_known")


def upsert_products(existing: DataFrame, records: DataFrame) -> DataFrame:
    """What becomes of every record: seq, product (its id, or 'new:' and the device), action, change_type, changed, and the state after it.

    A record's values win where they are not null, but not over a product whose provenance ranks above the run (locked). action is
    added, unchanged, removed (a change that leaves it cancelled or expired) or updated; changed names the fields that differ, null-safe.
    """
    found = find_products(existing, records).withColumn("product", F.coalesce("product_id", F.concat(F.lit("new:"), "udi_di")))
    old = existing.select(F.col("product_id").cast("string").alias("product"), F.coalesce("locked", F.lit(False)).alias("_locked"), *[F.col(f).alias(f"_{f}") for f in TRACKED], F.lit(True).alias("_old"))
    rows = found.join(old, "product", "left")
    order = Window.partitionBy("product").orderBy("seq")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    locked = F.coalesce("_locked", F.lit(False))
    state = lambda f, w: F.when(locked, F.col(f"_{f}")).otherwise(F.coalesce(F.last(f, ignorenulls=True).over(w), F.col(f"_{f}")))
    rows = rows.withColumns({f"before_{f}": state(f, before) for f in TRACKED} | {f"after_{f}": state(f, upto) for f in TRACKED} | {"_n": F.row_number().over(order)})
    changed = F.array_compact(F.array(*[F.when(~F.col(f"before_{f}").eqNullSafe(F.col(f"after_{f}")), F.lit(f)) for f in TRACKED]))
    added = F.col("_old").isNull() & (F.col("_n") == 1)
    gone = F.when(F.col("after_status") == "cancelled", "cancel").when(F.col("after_status") == "expired", "expire")
    rows = rows.withColumn("_changed", changed)
    action = F.when(added, "added").when(F.size("_changed") == 0, "unchanged").when(gone.isNotNull(), "removed").otherwise("updated")
    kind = F.when(added, "new").when(F.size("_changed") == 0, "noop").otherwise(F.coalesce(gone, F.lit("update")))
    return rows.select("seq", "product", action.alias("action"), kind.alias("change_type"), F.array_join("_changed", ",").alias("changed"), *[F.col(f"after_{f}").alias(f) for f in TRACKED])
