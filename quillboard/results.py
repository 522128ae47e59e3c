"""Results: one lazy frame with the shape, labels and types that its query implies."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import cached_property
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillboard.operators.densify import SYNTHETIC
from quillboard.operators.prefix import placed as place_rows
from quillboard.plans.spec import Shape
from quillboard.schema import FieldType, Value

POS = "__pos"


@dataclass(frozen=True)
class ResultColumn:
    label: str
    field_type: FieldType
    is_key: bool


@dataclass(frozen=True)
class BucketKey:
    """A bucket's typed key; equal by type and value. Null keys come last in either direction."""

    field_type: FieldType
    value: Any

    @property
    def label(self) -> str:
        return "null" if self.value is None else self.value.isoformat(sep=" ") if hasattr(self.value, "isoformat") else str(self.value)

    def typed(self) -> Value:
        return Value(self.field_type, self.value)

    def compare(self, other: BucketKey) -> int:
        """-1, 0 or 1, nulls last; keys of different types do not compare."""
        if self.field_type is not other.field_type:
            raise TypeError(f"{self.field_type.value} and {other.field_type.value} do not compare")
        a, b = (self.value is None, self.value), (other.value is None, other.value)
        if a[0] or b[0]:
            return a[0] - b[0]
        return (a[1] > b[1]) - (a[1] < b[1])


@dataclass(frozen=True)
class Bucket:
    """One row of a result: its keys, its measures' values, and whether it was made up to fill a grid."""

    keys: tuple[BucketKey, ...]
    values: tuple[Any, ...]
    is_synthetic: bool = False


@dataclass(frozen=True)
class Result:
    """frame: the rows (not ordered); order: how they are; columns: keys, then measures.

    Grouped results carry `is_synthetic`. Nothing has run yet: `df` is a plan.
    """

    shape: Shape
    frame: DataFrame
    columns: tuple[ResultColumn, ...]
    order: tuple[Column, ...] = ()
    group_kind: str | None = None  # categorical or temporal, of a series
    truncation: tuple[DataFrame, int] | None = field(default=None, repr=False)
    semantic_tag: str | None = None

    @property
    def keys(self) -> list[str]:
        return [c.label for c in self.columns if c.is_key]

    @property
    def measures(self) -> list[str]:
        return [c.label for c in self.columns if not c.is_key]

    def column(self, label: str) -> ResultColumn | None:
        return next((c for c in self.columns if c.label == label), None)

    @property
    def df(self) -> DataFrame:
        """Key and measure columns (and is_synthetic), in order."""
        names = [c.label for c in self.columns]
        if SYNTHETIC in self.frame.columns:
            names.append(SYNTHETIC)
        ordered = self.frame.orderBy(*self.order) if self.order else self.frame
        return ordered.select(*[F.col(f"`{n}`") for n in names])

    @cached_property
    def truncated_count(self) -> int:
        """Rows that a streak's top_n left out; runs a count. A limit does not count here."""
        if self.truncation is None:
            return 0
        whole, kept = self.truncation
        return max(0, whole.count() - kept)

    def collect(self, most: int = 100_000) -> list[Bucket]:
        """The rows as typed values, in order; runs the query. More than `most` rows raise."""
        rows = self.df.limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"the result has more than {most} rows")
        n = len(self.keys)
        marked = SYNTHETIC in self.frame.columns
        kinds = [c.field_type for c in self.columns if c.is_key]
        return [Bucket(tuple(BucketKey(t, v) for t, v in zip(kinds, r[:n], strict=True)), tuple(r[n : len(self.columns)]), bool(marked and r[SYNTHETIC])) for r in rows]

    def scalar(self) -> Any:
        """The value of a scalar result; runs the query."""
        return self.frame.first()[0]

    def to_table(self) -> Result:
        """The same rows as a table; two-dimensional series are expanded to their full grid, gaps null."""
        if self.shape is not Shape.multiSeries:
            return replace(self, shape=Shape.table, group_kind=None)
        placed = self.positioned()
        x, s = self.keys
        first = [placed.groupBy(k).agg(F.min(POS).alias(f"__p{i}")).withColumnRenamed(k, f"__k{i}") for i, k in enumerate((x, s))]
        cells = first[0].crossJoin(first[1])
        joined = cells.join(placed, F.col("__k0").eqNullSafe(F.col(f"`{x}`")) & F.col("__k1").eqNullSafe(F.col(f"`{s}`")), "left")
        measure = self.measures[0]
        grid = joined.select(F.col("__k0").alias(x), F.col("__k1").alias(s), F.col(f"`{measure}`"), F.coalesce(SYNTHETIC, F.lit(False)).alias(SYNTHETIC), "__p0", "__p1")
        return replace(self, shape=Shape.table, frame=grid, order=(F.asc("__p0"), F.asc("__p1")), group_kind=None)

    def pivot(self, most: int = 10_000) -> DataFrame:
        """One row for each x key, one column for each series key: the wide form of a two-dimensional series.

        Columns are named by the keys as text; the null key's is "null", or "null_" with as many more
        underscores as make it new, where a key reads so too. Reading the series keys runs a job; more than
        `most` raise.
        """
        if self.shape is not Shape.multiSeries:
            raise ValueError("only a multiSeries result is pivoted")
        x, s = self.keys
        placed = self.positioned()
        found = placed.groupBy(F.col(f"`{s}`").cast("string").alias("k")).agg(F.min(POS).alias("p")).orderBy("k").limit(most + 1).collect()
        if len(found) > most:
            raise ValueError(f"more than {most} series keys")
        names = sorted(r.k for r in found if r.k is not None)
        empty = "null"
        while empty in names or empty == x:
            empty += "_"
        held = [(n, n if n != x else f"{n}_") for n in names] + ([(None, empty)] if any(r.k is None for r in found) else [])
        key, measure = F.col(f"`{s}`").cast("string"), F.col(f"`{self.measures[0]}`")
        columns = [F.first(F.when(key.eqNullSafe(F.lit(value)), measure), ignorenulls=True).alias(name) for value, name in held]
        return placed.groupBy(x).agg(F.min(POS).alias(POS), *columns).orderBy(POS).drop(POS)

    def positioned(self) -> DataFrame:
        """The frame with its rows' place in the order, from 1."""
        return self.frame if POS in self.frame.columns else place_rows(self.frame, list(self.order), POS, len(self.keys) > 1)
