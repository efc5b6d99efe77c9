"""The conflict policy over a stream: late observations lose or win by their rank, never by their arrival."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from certalog.operators.policy import GRADES

STATE = "seq array<long>, observed_at array<long>, value array<string>, grade array<int>, priority array<int>"


def fold(observations: list[tuple]) -> tuple:
    """(value, applied, kept, conflicts) of (observed_at, seq, value, grade, priority) in any order: as operators.policy.resolve folds them."""
    value, meta, counts = None, None, [0, 0, 0]
    for at, _, new, grade, priority in sorted(observations, key=lambda x: x[:2]):
        rank = (grade, -priority, at)
        if new is None or new == value:
            continue
        if meta == rank:
            counts[2] += 1
        elif meta is None or rank >= meta:
            value, meta, counts[0] = new, rank, counts[0] + 1
        else:
            counts[1] += 1
    return value, *counts


def rank_of(grade: str | None) -> int:
    """Place of a grade among GRADES; unknown ones rank below all, none as C."""
    return 2 if grade is None else GRADES.index(grade.upper()) + 1 if grade.upper() in GRADES else 0


def resolve_stream(observations: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, value, applied, kept, conflicts) of every key that a micro-batch has observations of, after all that has arrived so far.

    observations: a stream with keys, value, grade, priority, observed_at (long), seq (unique within a key). A key's state is its
    observations, each once however often it is delivered; that is bounded by how often sources report one field, as in the batch
    fold, to which the result is equal whatever the order and the cut of arrival. No watermark: nothing is too late.
    """
    kinds = dict(observations.dtypes)

    def update(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = {s: (at, s, v, g, p) for s, at, v, g, p in zip(*state.get)} if state.exists else {}
        for f in frames:
            for r in f.itertuples(index=False):
                text = r.value.strip(" ") if isinstance(r.value, str) else None
                held.setdefault(int(r.seq), (int(r.observed_at), int(r.seq), text or None, rank_of(r.grade if isinstance(r.grade, str) else None), int(r.priority)))
        rows = sorted(held.values())
        state.update(tuple([r[k] for r in rows] for k in (1, 0, 2, 3, 4)))
        yield pd.DataFrame([(*key, *fold(rows))], columns=[*keys, "value", "applied", "kept", "conflicts"])

    out = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", value string, applied int, kept int, conflicts int"
    return observations.select(*keys, "value", "grade", "priority", "observed_at", "seq").groupBy(*keys).applyInPandasWithState(update, out, STATE, "update", "NoTimeout")
