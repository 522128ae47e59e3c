"""Grid completion of an aggregated frame."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillboard.functions.grain import TimeGrain
from quillboard.operators.prefix import small

SYNTHETIC = "is_synthetic"
_HIT = "__hit"


#: Buckets up to which a time axis is broadcast; their number is known from the range and the grain.
BROADCAST_BUCKETS = 100_000


@dataclass(frozen=True)
class Axis:
    """The time key's place among the keys, and the range that sets its buckets."""

    place: int
    grain: TimeGrain
    start: datetime
    end: datetime

    def rows(self, spark: SparkSession, key: str) -> DataFrame:
        line, n = self.grain.axis(spark, self.start, self.end, key)
        return F.broadcast(line) if n <= BROADCAST_BUCKETS else line


def fill(df: DataFrame, keys: list[str], zeros: dict[str, Column | None], axis: Axis | None) -> DataFrame:
    """Every combination of the axes' keys, with zeros (or nulls) and a marker where nothing was observed.

    axis: the time key and its buckets, if a range replaces what was observed; a null key stays. The frame is aggregated already, so all of this works on buckets, not on rows.
    """
    if len(keys) == 1 and axis is None:
        return df.withColumn(SYNTHETIC, F.lit(False))
    observed = df.withColumn(_HIT, F.lit(True))
    if len(keys) == 1:  # one pass: what lies outside the axis goes, a null key stays
        line = axis.rows(df.sparkSession, "__axis")
        joined = observed.join(line, F.col(keys[0]) == F.col("__axis"), "full").where(F.col("__axis").isNotNull() | F.col(keys[0]).isNull())
        grid = joined.withColumn(keys[0], F.coalesce(keys[0], "__axis")).drop("__axis")
    else:
        few = small(df)
        cells = _listed(df, keys) if axis is None and few else _crossed(df, keys, axis)
        match = reduce(lambda a, b: a & b, [F.col(f"__axis{i}").eqNullSafe(F.col(k)) for i, k in enumerate(keys)])
        joined = cells.join(F.broadcast(observed) if few else observed, match, "left")
        grid = joined.select(*[F.col(f"__axis{i}").alias(k) for i, k in enumerate(keys)], *zeros, _HIT)
    filled = {name: F.coalesce(F.col(name), z) for name, z in zeros.items() if z is not None}
    return grid.withColumns({**filled, SYNTHETIC: F.col(_HIT).isNull()}).drop(_HIT)


def _alive(df: DataFrame) -> Column:
    """Always true; it keeps all aggregates alive, so that the axes reuse the same exchange."""
    return F.size(F.array(*[F.col(c).cast("string") for c in df.columns])) >= 0


def _listed(df: DataFrame, keys: list[str]) -> DataFrame:
    """All combinations of the observed keys of a small source, null keys too: one row of key sets, unfolded."""
    cells = df.where(_alive(df)).agg(*[F.collect_set(F.struct(k)).alias(f"__axis{i}") for i, k in enumerate(keys)])
    for i, k in enumerate(keys):
        cells = cells.withColumn(f"__axis{i}", F.explode(f"__axis{i}")).withColumn(f"__axis{i}", F.col(f"__axis{i}")[k])
    return cells


def _crossed(df: DataFrame, keys: list[str], axis: Axis | None) -> DataFrame:
    """The same for any number of keys, and for a time axis."""
    axes = []
    for i, key in enumerate(keys):
        seen = df.where(_alive(df)).select(key).distinct()
        if axis is not None and i == axis.place:
            seen = axis.rows(df.sparkSession, key).unionByName(seen.where(F.col(key).isNull()))
        axes.append(seen.withColumnRenamed(key, f"__axis{i}"))
    return reduce(lambda a, b: a.crossJoin(b), axes)
