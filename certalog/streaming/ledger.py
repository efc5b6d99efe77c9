"""A ledger of runs: versions of a table published by one pointer, with the cursor in it; guards of when to run; rows of runs."""

from __future__ import annotations

import contextlib
import datetime
import json
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUN = "run_id string, source string, status string, started_at timestamp, finished_at timestamp, seconds double, message string, counts map<string,long>"


class Ledger:
    """Files below root, on any file system that Spark writes to; one writer at a time.

    versions/<n> hold the table, CURRENT names the version that counts with the cursor that belongs to it. A version is written whole
    before CURRENT is replaced by a rename, so that a run that dies leaves the version before, and its cursor, as they were.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._files = self._jvm.Path(self.root).getFileSystem(self._conf)

    def _path(self, *parts: str):
        return self._jvm.Path("/".join((self.root, *parts)))

    def _put(self, name: str, content: dict) -> None:
        """A small file, replaced at once."""
        new = self._path(f".{name.replace('/', '-')}-{uuid.uuid4().hex}")
        out = self._files.create(new, True)
        out.write(json.dumps(content).encode())
        out.close()
        gateway = self.spark.sparkContext._gateway
        kind = self._jvm.Options.Rename
        how = gateway.new_array(kind, 1)
        how[0] = kind.OVERWRITE
        self._files.mkdirs(self._path(name).getParent())
        context = self._jvm.FileContext.getFileContext(self._files.getUri(), self._conf)
        context.rename(context.makeQualified(new), context.makeQualified(self._path(name)), how)

    def _get(self, name: str) -> dict | None:
        path = self._path(name)
        if not self._files.exists(path):
            return None
        return json.loads("\n".join(r.value for r in self.spark.read.text(path.toString()).collect()))  # one small file

    # Versions and cursors

    def current(self) -> dict:
        """version (0: none yet), cursor, meta."""
        return self._get("CURRENT") or {"version": 0, "cursor": None, "meta": {}}

    def read(self) -> DataFrame | None:
        """The published table; None before the first."""
        now = self.current()["version"]
        return self.spark.read.parquet(f"{self.root}/versions/{now}") if now else None

    def publish(self, df: DataFrame, cursor=None, **meta) -> int:
        """df as the next version, with a cursor and what else there is to say; df may read the version before. Older ones but that go."""
        now = self.current()["version"]
        df.write.mode("overwrite").parquet(f"{self.root}/versions/{now + 1}")  # what a run that died left there goes
        self._put("CURRENT", {"version": now + 1, "cursor": cursor, "meta": meta})
        self._files.delete(self._path("versions", str(now - 1)), True)
        return now + 1

    def advance(self, batches: Callable[[object], DataFrame | None], apply: Callable[[DataFrame | None, DataFrame], DataFrame], cursor_of: Callable[[DataFrame], object], most: int | None = None) -> int:
        """Take batches after the cursor until there are none, publishing each with its cursor: how many were taken.

        A run that is cut and taken up again, at any place, ends as one that is not: a batch counts once, with its version.
        """
        taken = 0
        while most is None or taken < most:
            batch = batches(self.current()["cursor"])
            cursor = None if batch is None else cursor_of(batch)
            if cursor is None:
                break
            self.publish(apply(self.read(), batch), cursor)
            taken += 1
        return taken

    # When to run

    def _mark(self, job: str) -> dict:
        return self._get(f"jobs/{job}") or {}

    def due(self, job: str, now: datetime.datetime, every: datetime.timedelta, enabled: bool = True) -> str:
        """disabled, first_run, due or cooldown; forced runs don't ask."""
        if not enabled:
            return "disabled"
        last = self._mark(job).get("finished_at")
        if last is None:
            return "first_run"
        return "due" if now - datetime.datetime.fromisoformat(last) >= every else "cooldown"

    def done_on(self, job: str, now: datetime.datetime) -> bool:
        """Whether the job has had its run on this UTC day."""
        return self._mark(job).get("day") == now.astimezone(datetime.timezone.utc).date().isoformat()

    def ran(self, job: str, now: datetime.datetime) -> None:
        self._put(f"jobs/{job}", {"finished_at": now.isoformat(), "day": now.astimezone(datetime.timezone.utc).date().isoformat()})

    # Rows of runs

    @contextlib.contextmanager
    def source_run(self, source: str, clock: Callable[[], datetime.datetime]) -> Iterator[dict]:
        """A run's row, opened as running, closed as success with the counts that the body leaves in the dict, or as failed with the error, which goes on."""
        began, row = clock(), {"run_id": uuid.uuid4().hex, "source": source}
        name = f"runs/{row['run_id']}"
        row |= {"status": "RUNNING", "started_at": began.isoformat(), "finished_at": None, "seconds": None, "message": None, "counts": {}}
        self._put(name, row)
        counts: dict = {}

        def close(status: str, message: str | None) -> None:
            ended = clock()
            numbers = {k: v for k, v in counts.items() if k != "message"}
            self._put(name, row | {"status": status, "finished_at": ended.isoformat(), "seconds": (ended - began).total_seconds(), "message": message, "counts": numbers})

        try:
            yield counts
        except BaseException as error:
            close("FAILED", f"{type(error).__name__}: {error}"[:2000])
            raise
        close("SUCCESS", counts.get("message"))

    def runs(self) -> DataFrame:
        """All runs' rows."""
        if not self._files.exists(self._path("runs")):
            return self.spark.createDataFrame([], RUN)
        return self.spark.read.schema(RUN).json(f"{self.root}/runs")


def key_ranges(source: DataFrame, key: str, size: int) -> Callable[[object], DataFrame | None]:
    """Batches of advance: the rows of the next size keys after the cursor, in the order of the key; None after the last."""

    def batch(cursor) -> DataFrame | None:
        rest = source if cursor is None else source.where(F.col(key) > F.lit(cursor))
        last = rest.select(key).distinct().orderBy(key).limit(size).agg(F.max(key)).first()[0]
        return None if last is None else rest.where(F.col(key) <= F.lit(last))

    return batch
