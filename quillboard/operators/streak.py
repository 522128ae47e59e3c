"""Streaks: runs of completed scheduled days of each entity."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillboard.plans import spec as Q
from quillboard.schema import FieldType, SourceDef


def key_text(column: Column, t: FieldType) -> Column:
    """An entity key as text: dates in ISO form with milliseconds, or microseconds where they matter."""
    if t is not FieldType.dateTime:
        return column.cast("string")
    ts = column.cast("timestamp")
    fine = F.unix_micros(ts) % 1000 != 0
    return F.when(fine, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS"))


def streaks(df: DataFrame, m: Q.Streak, source: SourceDef, as_of: datetime, order: Column | None = None) -> DataFrame:
    """entityId, entityLabel, currentStreak, longestStreak of every entity, not ordered.

    Rows meet once, by entity, pre-aggregated to the distinct days of each; a fold over an entity's days
    does the rest. order: the rows' input order, for the choice of a label (their place in the input files
    by default).
    """
    entity = key_text(F.col(f"`{m.entity.field_id}`"), source.field(m.entity.field_id).field_type)
    day = F.col(f"`{m.scheduled.field_id}`").cast("date")
    late = F.lit(as_of.date())
    # what lies after as_of, or on no day, counts for nothing
    mark = F.when(day <= late, F.struct(day.alias("day"), (~F.col(f"`{m.status.field_id}`").eqNullSafe(F.lit(m.completed))).alias("open")))
    found = [F.collect_set(mark).alias("days")]
    rows = df.withColumn("__entity", entity)
    if m.entity_label:
        label = F.col(f"`{m.entity_label.field_id}`")
        rows = rows.withColumn("__place", order if order is not None else F.monotonically_increasing_id())
        found.append(F.min(F.when(F.coalesce(F.length(label), F.lit(0)) > 0, F.struct(F.col("__place").alias("place"), label.alias("label")))).alias("named"))
    days = rows.where("__entity IS NOT NULL").groupBy("__entity").agg(*found)

    def step(at: Column, x: Column) -> Column:
        """A completed day adds one; an open day before as_of ends the run. Of a day's marks the completed one is first."""
        again = x["day"] == at["day"]
        run = F.when(again, at["run"]).when(~x["open"], at["run"] + 1).when(x["day"] < late, F.lit(0).cast("bigint")).otherwise(at["run"])
        return F.struct(run.alias("run"), F.greatest(at["best"], run).alias("best"), x["day"].alias("day"))

    zero = F.lit(0).cast("bigint")
    start = F.struct(zero.alias("run"), zero.alias("best"), F.lit("0001-01-01").cast("date").alias("day"))
    out = days.withColumn("__streak", F.aggregate(F.array_sort("days"), start, step))
    label = F.coalesce("named.label", "__entity") if m.entity_label else F.col("__entity")
    return out.select(F.col("__entity").alias("entityId"), label.alias("entityLabel"), F.col("__streak.run").alias("currentStreak"), F.col("__streak.best").alias("longestStreak"))


ORDER = (F.desc, "currentStreak"), (F.desc, "longestStreak"), (F.asc, "entityLabel"), (F.asc, "entityId")


def ordering() -> list[Column]:
    return [f(c) for f, c in ORDER]
