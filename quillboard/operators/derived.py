"""Running sums, differences and moving averages over an ordered series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from quillboard.operators import prefix as P
from quillboard.plans import spec as Q
from quillboard.schema import FieldType


def output_type(op: Q.DerivedOp, t: FieldType) -> FieldType:
    return FieldType.double if op.kind is Q.Derive.movingAverage and t is FieldType.integer else t


def derive(df: DataFrame, measure: str, op: Q.DerivedOp, t: FieldType, order: list[Column], out: str, short: bool) -> DataFrame:
    """The operation over the series' order, as the column `out`; nulls count as 0, a series of nulls stays null.

    short: the series is known to be short; one window takes it. Others are worked on in parts.
    """
    some = F.col(f"`{measure}`").isNotNull()
    value = F.coalesce(F.col(f"`{measure}`"), F.lit(0))

    def over(line: WindowSpec) -> Column:
        if op.kind is Q.Derive.delta:
            return F.coalesce(value - F.lag(value).over(line), F.lit(0))
        mean = F.avg(value).over(line.rowsBetween(1 - op.window, 0))
        return F.round(mean).cast("bigint") if t is FieldType.duration else mean

    if short or P.small(df):
        line = Window.orderBy(*order)
        found = F.sum(value).over(line.rowsBetween(Window.unboundedPreceding, 0)) if op.kind is Q.Derive.cumulativeSum else over(line)
        whole = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return df.withColumn(out, F.when(F.max(some).over(whole), found))
    any_value = df.agg(F.max(some).alias("__some"))  # one row
    if op.kind is Q.Derive.cumulativeSum:
        done = P.running(df, order, {"__found": value})
    else:
        done = P.moving(df, order, 1 if op.kind is Q.Derive.delta else op.window - 1, "__found", over)
    return done.crossJoin(F.broadcast(any_value)).withColumn(out, F.when(F.col("__some"), F.col("__found"))).drop("__found", "__some")
