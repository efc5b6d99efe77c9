import datetime
import random

import pytest
from pyspark.sql import functions as F

from certalog.operators import policy
from certalog.plans.records import resolved
from certalog.streaming.ledger import Ledger, key_ranges
from certalog.streaming.policy import fold, resolve_stream

DAY = datetime.datetime(2026, 1, 5, 23, 30, tzinfo=datetime.timezone.utc)
SCHEMA = "k string, value string, grade string, priority int, observed_at long, seq long"


@pytest.mark.parametrize("seed", [1, 2])
def test_policy_over_shuffled_batches(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [(f"k{rng.randrange(12)}", rng.choice(("a", "b", "c", " a", "", None)), rng.choice(("A", "b", "C", "D", "X", None)), rng.randrange(3), rng.randrange(6), s) for s in range(300)]
    want = {tuple(r) for r in policy.resolve(spark.createDataFrame(rows, SCHEMA), ["k"]).collect()}
    arrived = rows + rng.sample(rows, 40)  # some come twice
    rng.shuffle(arrived)
    at = 0
    while at < len(arrived):
        n = rng.choice((1, 30, 90))
        spark.createDataFrame(arrived[at : at + n], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        at += n
    now: dict = {}

    def keep(batch, number):
        now.update({r.k: tuple(r) for r in batch.collect()})

    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = resolve_stream(stream, ["k"]).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(600)
    assert set(now.values()) == want


def test_fold_is_the_batch_fold(spark):
    d = "/root/testdata/sf0.001"
    from certalog.plans.binding import changes

    e = changes(spark, d).select("entity_id", "kind", "event_id", F.date_diff("day", F.lit("2000-12-13")).alias("t")).collect()
    by: dict = {}
    for r in e:
        by.setdefault(r.entity_id, []).append((r.t, r.event_id, r.kind, 4 - r.event_id % 4, r.event_id % 3))
    for x in by.values():
        random.Random(1).shuffle(x)
    assert {(k, *fold(x)) for k, x in by.items()} == {tuple(r) for r in resolved(spark, d).collect()}


def test_a_run_that_dies_leaves_the_version_before(spark, tmp_path, monkeypatch):
    ledger = Ledger(spark, str(tmp_path / "t"))
    assert ledger.read() is None and ledger.current()["cursor"] is None
    ledger.publish(spark.range(3), cursor=3)
    with monkeypatch.context() as m:
        m.setattr(Ledger, "_put", lambda self, name, content: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            ledger.publish(spark.range(7), cursor=7)
    again = Ledger(spark, str(tmp_path / "t"))
    assert again.read().count() == 3 and again.current() == {"version": 1, "cursor": 3, "meta": {}}
    assert again.publish(again.read().union(spark.range(5)), cursor=8, rows=8) == 2
    assert again.read().count() == 8 and again.current()["meta"] == {"rows": 8}


@pytest.mark.parametrize("cut", [0, 1, 2, 4])
def test_a_run_cut_anywhere_and_resumed_is_one_run(spark, tmp_path, monkeypatch, cut):
    source = spark.createDataFrame([(k % 11, k) for k in range(60)], "key int, v int")
    take = key_ranges(source, "key", 3)
    apply = lambda old, batch: batch if old is None else old.unionByName(batch)
    last = lambda batch: batch.agg(F.max("key")).first()[0]
    ledger = Ledger(spark, str(tmp_path / "t"))
    assert ledger.advance(take, apply, last, most=cut) == cut
    with monkeypatch.context() as m:  # the next batch is written and then lost
        m.setattr(Ledger, "_put", lambda self, name, content: (_ for _ in ()).throw(OSError("gone")))
        if cut < 4:
            with pytest.raises(OSError):
                ledger.advance(take, apply, last)
    assert Ledger(spark, str(tmp_path / "t")).advance(take, apply, last) == 4 - cut
    assert sorted(map(tuple, ledger.read().collect())) == sorted(map(tuple, source.collect()))
    assert ledger.advance(take, apply, last) == 0


def test_when_to_run(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path))
    every = datetime.timedelta(hours=24)
    assert ledger.due("job", DAY, every, enabled=False) == "disabled" and ledger.due("job", DAY, every) == "first_run" and not ledger.done_on("job", DAY)
    ledger.ran("job", DAY)
    assert ledger.due("job", DAY + datetime.timedelta(hours=23), every) == "cooldown" and ledger.due("job", DAY + every, every) == "due"
    assert ledger.done_on("job", DAY) and not ledger.done_on("job", DAY + datetime.timedelta(hours=1)) and not ledger.done_on("other", DAY)
    zone = datetime.timezone(datetime.timedelta(hours=8))
    assert ledger.done_on("job", DAY.astimezone(zone))  # the UTC day counts


def test_rows_of_runs(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path))
    assert ledger.runs().count() == 0
    times = iter([DAY + datetime.timedelta(seconds=s) for s in (0, 5, 10, 12, 20, 30)])
    with ledger.source_run("UDI", lambda: next(times)) as counts:
        counts |= {"total": 10, "failed": 1, "message": "fine"}
    with pytest.raises(RuntimeError), ledger.source_run("NMPA", lambda: next(times)) as counts:
        counts["total"] = 3
        raise RuntimeError("source is away")
    died = ledger.source_run("X", lambda: next(times))
    died.__enter__()  # and no word more
    got = {r.source: r for r in ledger.runs().collect()}
    assert (got["UDI"].status, got["UDI"].seconds, got["UDI"].message, got["UDI"].counts) == ("SUCCESS", 5.0, "fine", {"total": 10, "failed": 1})
    assert (got["NMPA"].status, got["NMPA"].message, got["NMPA"].counts) == ("FAILED", "RuntimeError: source is away", {"total": 3})
    assert got["X"].status == "RUNNING" and got["X"].finished_at is None and died
