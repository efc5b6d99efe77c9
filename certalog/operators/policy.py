"""Conflict policy: an ordered fold over the observations of a field."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRADES = ("D", "C", "B", "A")


def resolve(observations: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, value, applied, kept, conflicts): the value each key's field ends with.

    observations: keys, value, grade, priority (less is better), observed_at (long), seq (unique within a key), taken in
    the order of (observed_at, seq). An empty or equal value changes nothing; one of equal grade, priority and time but another value is
    a conflict and keeps the old; one that ranks at least as high by (grade, priority, time) is applied; a lower one is not.
    """
    rank = F.coalesce(F.array_position(F.array(*[F.lit(g) for g in GRADES]), F.upper("grade")).cast("int"), F.lit(2))
    item = F.struct("observed_at", "seq", F.nullif(F.trim("value"), F.lit("")).alias("value"), rank.alias("grade"), (-F.col("priority")).cast("int").alias("priority"))
    folded = observations.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("items"))
    zero = F.struct(
        F.lit(None).cast("string").alias("value"), F.lit(None).cast("int").alias("grade"), F.lit(None).cast("int").alias("priority"),
        F.lit(None).cast("long").alias("at"), F.lit(0).alias("applied"), F.lit(0).alias("kept"), F.lit(0).alias("conflicts"),
    )

    def step(s, x):
        same = x["value"].isNull() | x["value"].eqNullSafe(s["value"])
        tie = (s["grade"] == x["grade"]) & (s["priority"] == x["priority"]) & (s["at"] == x["observed_at"])
        better = s["grade"].isNull() | (F.struct(x["grade"], x["priority"], x["observed_at"]) >= F.struct(s["grade"], s["priority"], s["at"]))
        out = lambda applied, kept, conflict: [
            (s["applied"] + F.lit(applied)).alias("applied"), (s["kept"] + F.lit(kept)).alias("kept"), (s["conflicts"] + F.lit(conflict)).alias("conflicts")
        ]
        old = [s["value"].alias("value"), s["grade"].alias("grade"), s["priority"].alias("priority"), s["at"].alias("at")]
        new = [x["value"].alias("value"), x["grade"].alias("grade"), x["priority"].alias("priority"), x["observed_at"].alias("at")]
        return (
            F.when(same, F.struct(*old, *out(0, 0, 0)))
            .when(F.coalesce(tie, F.lit(False)), F.struct(*old, *out(0, 0, 1)))
            .when(better, F.struct(*new, *out(1, 0, 0)))
            .otherwise(F.struct(*old, *out(0, 1, 0)))
        )

    state = folded.withColumn("s", F.aggregate("items", zero, step))
    return state.select(*keys, F.col("s.value").alias("value"), *[F.col(f"s.{c}").alias(c) for c in ("applied", "kept", "conflicts")])
