import pytest

from certalog.plans import backfill
from certalog.streaming.ledger import Ledger


@pytest.mark.parametrize("cut", [1, 3])
def test_params_of_a_cut_run(spark, tmp_path, cut):
    rows = [(f"d{k % 9}", k % 4, k % 5, None if k % 3 else f"m{k}", " " if k % 2 else f"lot{k}") for k in range(40)] + [(None, 1, 9, "x", "x"), (" ", 1, 9, "x", "x")]
    devices = spark.createDataFrame(rows, "di string, registry_no int, observed_at int, mjfs string, scbssfbhph string")
    bound = spark.createDataFrame([(0, "p0"), (0, "p1"), (1, "p2"), (2, None), (9, "p9")], "registry_no int, product_id string").where("product_id is not null")
    want = sorted(map(tuple, backfill.device_params(devices, bound).collect()))
    best = {}
    for di, reg, at, m, lot in rows:
        for product in {0: ("p0", "p1"), 1: ("p2",)}.get(reg, ()) if di and di.strip() else ():
            for code, v in (("STERILIZATION_METHOD", m), ("LABEL_LOT", lot)):
                if v and v.strip():
                    best[product, code] = max(best.get((product, code), (-1, "", "")), (at, di, v))
    assert {(p, c): (at, di, v) for p, c, v, di, _, at in want} == best
    ledger = Ledger(spark, str(tmp_path / "t"))
    known = devices.where("di is not null")
    assert backfill.write_params(ledger, known, bound, size=2, most=cut) == cut
    ran = backfill.write_params(Ledger(spark, str(tmp_path / "t")), known, bound, size=2)
    assert ran + cut == 5 and sorted(map(tuple, ledger.read().select("product_id", "param_code", "value_text", "di", "registry_no", "observed_at").collect())) == want
    assert {r.param_code for r in backfill.device_params(devices, bound, ["LABEL_LOT"]).collect()} == {"LABEL_LOT"}


def test_ambiguous_numbers_are_never_filled(spark):
    known = spark.createDataFrame([(1, "国械注准20200001"), (2, "国械注准2020-0001"), (3, "国械注准20200003")], "registration_id int, registration_no string")
    rows = [("a", "国械注准 20200001", None), ("b", "国械注准２０２００００３", None), ("c", "国械注准20209999", None), ("d", None, None), ("e", None, None), ("f", "国械注准20200001", 7), ("g", "  ", None), ("h", None, None)]
    products = spark.createDataFrame(rows, "product_id string, reg_no string, registration_id int")
    variants = spark.createDataFrame([(1, "d", "国械注准20200001"), (2, "d", "国械注准20200003"), (1, "e", "国械注准20209999"), (1, "h", "国械注准20208888"), (1, "a", "国械注准20200003")], "variant_id int, product_id string, registry_no string")
    got = {r.product_id: (r.registration_id, r.how) for r in backfill.fill_anchors(products, known, variants).collect()}
    assert got == {
        "a": (None, "ambiguous"), "b": ("3", "filled"), "c": ("new:国械注准20209999", "created"), "d": ("3", "variant"), "e": ("new:国械注准20209999", "variant"), "f": ("7", "kept"), "g": (None, "none"), "h": (None, "none"),
    }
