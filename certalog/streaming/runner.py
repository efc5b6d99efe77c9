"""A source's run: its rows read once, then evidence, pending rows and observations of fields, each a published table that takes a row once."""

from __future__ import annotations

import datetime
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from certalog.functions import fields
from certalog.functions.text import registration_key
from certalog.operators import policy
from certalog.plans.ingest import anchor
from certalog.session import staged
from certalog.streaming.ledger import Ledger

#: Fields of a registration that sources speak of (fixed values).
CONTRACT = ("filing_no", "approval_date", "expiry_date", "status")


class SourceRunner:
    """Tables below root: evidence (source_key, row_hash, run_id, payload), pending (source_key, row_hash, reason), observations
    (registration_no, field, value, grade, priority, observed_at, seq, source_key, row_hash), and the rows of runs."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.runs = Ledger(spark, root)
        self.tables = {name: Ledger(spark, f"{root}/{name}") for name in ("evidence", "pending", "observations")}

    def _add(self, name: str, rows: DataFrame, keys: Sequence[str], run: str) -> int:
        """Rows whose keys the table lacks come in: how many. Nothing is published if there are none."""
        ledger = self.tables[name]
        old = ledger.read()
        new = staged(rows if old is None else rows.join(old.select(*keys), list(keys), "left_anti").select(*rows.columns))
        n = new.count()
        if n:
            ledger.publish(new if old is None else old.unionByName(new), run=run)
        return n

    def run(self, source_key: str, rows: DataFrame, observed_at: int, grade: str, priority: int, clock: Callable[[], datetime.datetime], kind: str = "OTHER") -> dict:
        """Take over a source's rows: reg_no, registry_no and udi_di, those of CONTRACT that it has, and whatever else; all are kept as evidence.

        A row is known by the hash of all its columns. Repeats within the run, and rows that the source gave before, count as duplicates and do nothing. A
        row without a clear registration number is pending; the others are observations of their fields, blank values of none. Evidence is published last: a run
        that dies before that is taken up by running it again, and one that ended changes nothing when it runs again.
        """
        with self.runs.source_run(source_key, clock) as counts:
            blank = lambda c: fields.blank(F.col(c).cast("string")) if c in rows.columns else F.lit(None).cast("string")
            payload = F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"})
            a, b = blank("reg_no"), blank("registry_no")
            gate = anchor(a, b, registration_key(a), registration_key(b), blank("udi_di"), kind)
            read = rows.select(payload.alias("payload"), gate.alias("g"), *[blank(f).alias(f) for f in CONTRACT]).withColumn("row_hash", F.sha2("payload", 256)).withColumn("source_key", F.lit(source_key))
            counts["total"] = rows.count()
            stage = staged(read.dropDuplicates(["row_hash"]))
            seen = self.tables["evidence"].read()
            keys = ["source_key", "row_hash"]
            fresh = stage if seen is None else staged(stage.join(seen.select(*keys), keys, "left_anti"))
            counts["duplicates"] = counts["total"] - fresh.count()
            held = fresh.where("g.error is not null").select("source_key", "row_hash", F.col("g.error").alias("reason"))
            each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in CONTRACT])).alias("e")
            told = fresh.where("g.number is not null").select(F.col("g.number").alias("registration_no"), each, "source_key", "row_hash").where("e.value is not null")
            told = told.select(
                "registration_no", "e.field", "e.value", F.lit(grade).alias("grade"), F.lit(priority).alias("priority"), F.lit(observed_at).cast("long").alias("observed_at"),
                F.xxhash64("source_key", "row_hash").alias("seq"), "source_key", "row_hash",
            )
            counts["pending"] = self._add("pending", held, keys, source_key)
            counts["observations"] = self._add("observations", told, ["registration_no", "field", "source_key", "row_hash"], source_key)
            self._add("evidence", fresh.select("source_key", "row_hash", F.lit(clock().isoformat()).alias("taken_at"), "payload"), keys, source_key)
            result = self.contract()
            counts["conflicts"] = 0 if result is None else result.where("conflicts > 0").count()
        return counts

    def contract(self) -> DataFrame | None:
        """(registration_no, field, value, applied, kept, conflicts) of all that sources have said."""
        told = self.tables["observations"].read()
        return None if told is None else policy.resolve(told, ["registration_no", "field"])
