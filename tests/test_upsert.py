import random

import pytest

from certalog.operators.upsert import TRACKED, upsert_products

PRODUCT = "product_id string, udi_di string, registration_id int, reg_no string, updated_at string, status string, expiry_date string, approved_date string, company_id int, name string, class_name string, locked boolean"
RECORD = "seq string, udi_di string, registration_id int, reg_no string, status string, expiry_date string, approved_date string, company_id int, name string, class_name string"


def one_by_one(existing, records):
    """The rule applied to each record in order."""
    products, clock, out = [dict(p) for p in existing], 0, []
    for p in products:
        p["_at"] = (p["updated_at"] is not None, p["updated_at"] or "", p["product_id"])
    for r in sorted(records, key=lambda r: r["seq"]):
        clock += 1
        di = lambda p: (p["udi_di"] or "").strip()
        hit = next((p for p in products if di(p) == r["udi_di"]), None)
        if hit is None:
            mine = sorted((p for p in products if p["registration_id"] == r["registration_id"]), key=lambda p: p["_at"], reverse=True)
            hit = next((p for p in mine if p["reg_no"] == r["reg_no"]), None) or next(iter(mine), None)
            if hit is not None and di(hit):
                hit = None
        added = hit is None
        if added:
            hit = {"product_id": "new:" + r["udi_di"], "locked": False} | dict.fromkeys(TRACKED)
            products.append(hit)
        before = {f: hit[f] for f in TRACKED}
        if not hit["locked"]:
            for f in TRACKED:
                hit[f] = r[f] if r[f] is not None else hit[f]
        hit["_at"] = (True, "~", f"{clock:09d}")
        changed = [f for f in TRACKED if before[f] != hit[f]]
        gone = {"cancelled": "cancel", "expired": "expire"}.get(hit["status"])
        action = "added" if added else "unchanged" if not changed else "removed" if gone else "updated"
        kind = "new" if added else "noop" if not changed else gone or "update"
        out.append((r["seq"], hit["product_id"], action, kind, ",".join(changed), *(hit[f] for f in TRACKED)))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_as_one_by_one(spark, seed):
    rng = random.Random(seed)
    regs, numbers = range(rng.choice((2, 6, 15))), ["A", "B", "C"]
    word = lambda *more: rng.choice((None, "x", "y", *more))
    existing = []
    for k in range(30):
        di = None if rng.random() < 0.5 else f"d{k}"
        existing.append({
            "product_id": f"p{k:03d}", "udi_di": di if di else rng.choice((None, "", "  ")), "registration_id": rng.choice(regs), "reg_no": rng.choice(numbers), "updated_at": rng.choice((None, f"2020-01-{k % 28 + 1:02d}")),
            "status": word("cancelled"), "expiry_date": word(), "approved_date": word(), "company_id": rng.choice((None, 1, 2)), "name": word(), "class_name": word(), "locked": seed > 2 and rng.random() < 0.3,
        })
    records = []
    for k in range(120):
        records.append({
            "seq": f"{k:05d}", "udi_di": f"d{rng.randrange(60)}", "registration_id": rng.choice(regs), "reg_no": rng.choice(numbers), "status": word("cancelled", "expired"), "expiry_date": word(),
            "approved_date": word(), "company_id": rng.choice((None, 1, 2)), "name": word(), "class_name": word(),
        })
    frame = lambda rows, schema: spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in rows], schema)
    got = upsert_products(frame(existing, PRODUCT), frame(records, RECORD)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(one_by_one(existing, records), key=repr)


def test_unlike_device_gives_a_new_row_and_higher_provenance_stays(spark):
    old = [("p1", "d1", 1, "A", "2020", "active", None, None, 7, "old", None, False), ("p2", "d9", 2, "B", "2020", "active", None, None, 7, "kept", None, True)]
    new = [("1", "d2", 1, "A", "active", None, None, None, "n", None), ("2", "d1", 1, "A", "cancelled", None, None, None, None, None), ("3", "d9", 2, "B", "cancelled", None, None, 8, "n", None), ("4", "d2", 1, "A", "active", None, None, None, "n", None)]
    got = {r.seq: r for r in upsert_products(spark.createDataFrame(old, PRODUCT), spark.createDataFrame(new, RECORD)).collect()}
    assert (got["1"].product, got["1"].action) == ("new:d2", "added")
    assert (got["2"].product, got["2"].action, got["2"].change_type, got["2"].changed, got["2"].name) == ("p1", "removed", "cancel", "status", "old")
    assert (got["3"].action, got["3"].name, got["3"].status) == ("unchanged", "kept", "active")
    assert (got["4"].product, got["4"].action) == ("new:d2", "unchanged")
    empty = spark.createDataFrame([], PRODUCT)
    assert {r.action for r in upsert_products(empty, spark.createDataFrame(new, RECORD)).collect()} == {"added", "unchanged"}
    assert upsert_products(spark.createDataFrame(old, PRODUCT), spark.createDataFrame([], RECORD)).collect() == []
