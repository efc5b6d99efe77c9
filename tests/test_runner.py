import datetime

import pytest

from certalog.streaming.ledger import Ledger
from certalog.streaming.runner import SourceRunner

NOW = datetime.datetime(2026, 1, 5, tzinfo=datetime.timezone.utc)
SHAPE = "reg_no string, registry_no string, udi_di string, status string, expiry_date string, extra int"


def everything(runner):
    read = lambda name: runner.tables[name].read()
    return {n: sorted(map(tuple, read(n).drop("taken_at").collect()), key=repr) if read(n) is not None else None for n in runner.tables}


def test_a_second_run_changes_nothing_and_a_dead_one_is_taken_up(spark, tmp_path, monkeypatch):
    rows = [
        ("国械注准20200001", None, "d1", "active", "2030-01-01", 1), ("国械注准20200001", None, "d1", "active", "2030-01-01", 1), ("国械注准 20200002", "国械注准20200002", None, " ", None, 2),
        ("国械注准20200003", "国械注准20200004", None, "active", None, 3), (None, None, "d5", "active", None, 4), (None, None, None, None, None, None), ("——", None, None, "x", None, 6),
    ]
    df = spark.createDataFrame(rows, SHAPE)
    once = SourceRunner(spark, str(tmp_path / "once"))
    got = once.run("UDI", df, 10, "B", 5, lambda: NOW, kind="UDI")
    assert got == {"total": 7, "duplicates": 1, "pending": 4, "observations": 2, "conflicts": 0}
    assert {r.reason for r in once.tables["pending"].read().collect()} == {"E_CANONICAL_KEY_CONFLICT", "E_UDI_DI_WITHOUT_REG", "E_CANONICAL_KEY_MISSING", "E_REG_NO_NORMALIZE_FAILED"}
    before, versions = everything(once), {n: t.current()["version"] for n, t in once.tables.items()}
    assert once.run("UDI", df, 10, "B", 5, lambda: NOW, kind="UDI") == {"total": 7, "duplicates": 7, "pending": 0, "observations": 0, "conflicts": 0}
    assert everything(once) == before and {n: t.current()["version"] for n, t in once.tables.items()} == versions
    cut = SourceRunner(spark, str(tmp_path / "cut"))
    publish = Ledger.publish

    def dies(self, frame, *args, **kw):
        if self.root.endswith("observations"):
            raise OSError("gone")
        return publish(self, frame, *args, **kw)

    with monkeypatch.context() as m:
        m.setattr(Ledger, "publish", dies)
        with pytest.raises(OSError):
            cut.run("UDI", df, 10, "B", 5, lambda: NOW, kind="UDI")
    assert cut.tables["evidence"].read() is None
    cut.run("UDI", df, 10, "B", 5, lambda: NOW, kind="UDI")
    assert everything(cut) == before and sorted(r.status for r in cut.runs.runs().collect()) == ["FAILED", "SUCCESS"]


def test_sources_in_conflict(spark, tmp_path):
    runner = SourceRunner(spark, str(tmp_path))
    one = lambda status: spark.createDataFrame([("国械注准20200001", None, None, status, "2030-01-01", 1)], SHAPE)
    runner.run("A", one("active"), 10, "B", 5, lambda: NOW)
    assert runner.run("B", one("cancelled"), 10, "B", 5, lambda: NOW)["conflicts"] == 1
    runner.run("C", one("expired"), 1, "A", 9, lambda: NOW)  # older, of a higher grade
    got = {r.field: (r.value, r.conflicts) for r in runner.contract().collect()}
    assert got["status"][0] == "expired" and got["expiry_date"] == ("2030-01-01", 0)
