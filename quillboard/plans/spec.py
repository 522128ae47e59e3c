"""Query specifications: plain frozen data, compared by value."""

from __future__ import annotations

import dataclasses
from collections.abc import Sequence
from dataclasses import dataclass, field
from enum import Enum

from quillboard.functions.grain import TimeGrain
from quillboard.schema import NUMERIC, ORDERED, FieldRef, FieldType, SourceDef, Value


class Op(str, Enum):
    """Filter and HAVING operators."""

    equals = "equals"
    notEquals = "notEquals"
    lessThan = "lessThan"
    lessThanOrEqual = "lessThanOrEqual"
    greaterThan = "greaterThan"
    greaterThanOrEqual = "greaterThanOrEqual"
    inList = "inList"


ORDER_OPS = frozenset({Op.lessThan, Op.lessThanOrEqual, Op.greaterThan, Op.greaterThanOrEqual})


class Aggregate(str, Enum):
    sum = "sum"
    average = "average"
    min = "min"
    max = "max"
    distinctCount = "distinctCount"
    percentile = "percentile"


#: Field types that each aggregate takes.
TAKES = {
    Aggregate.sum: NUMERIC,
    Aggregate.average: NUMERIC,
    Aggregate.percentile: NUMERIC,
    Aggregate.min: ORDERED,
    Aggregate.max: ORDERED,
    Aggregate.distinctCount: frozenset(FieldType),
}
#: Those whose empty bucket is a typed zero; of the others it is null.
ADDITIVE = frozenset({Aggregate.sum, Aggregate.distinctCount})


@dataclass(frozen=True)
class Aggregation:
    kind: Aggregate
    p: float | None = None

    def output(self, t: FieldType) -> FieldType:
        if self.kind is Aggregate.distinctCount:
            return FieldType.integer
        if self.kind in (Aggregate.average, Aggregate.percentile) and t is FieldType.integer:
            return FieldType.double
        return t


SUM, AVERAGE, MIN, MAX, DISTINCT = (Aggregation(k) for k in (Aggregate.sum, Aggregate.average, Aggregate.min, Aggregate.max, Aggregate.distinctCount))


def percentile(p: float) -> Aggregation:
    return Aggregation(Aggregate.percentile, p)


class Combination(str, Enum):
    sum = "sum"
    difference = "difference"
    product = "product"
    ratio = "ratio"

    @property
    def identity(self) -> int | None:
        return {"sum": 0, "difference": 0, "product": 1}.get(self.value)

    def output(self, a: FieldType, b: FieldType) -> FieldType | None:
        """None where the two cannot be combined."""
        if a not in NUMERIC or b not in NUMERIC:
            return None
        if self in (Combination.product, Combination.ratio):
            return FieldType.double
        if (a is FieldType.duration) != (b is FieldType.duration):
            return None
        return a if a is b else FieldType.double


class Scalar(str, Enum):
    negate = "negate"
    abs = "abs"
    fillNull = "fillNull"


@dataclass(frozen=True)
class ScalarOp:
    kind: Scalar
    fill: float | int | None = None


@dataclass(frozen=True)
class Measure:
    label: str | None = field(default=None, kw_only=True)

    def output(self, source: SourceDef) -> FieldType | None:
        raise NotImplementedError

    @property
    def supports_date_range(self) -> bool:
        return True


@dataclass(frozen=True)
class Count(Measure):
    def output(self, source: SourceDef) -> FieldType:
        return FieldType.integer


@dataclass(frozen=True)
class FieldMeasure(Measure):
    field: FieldRef
    aggregation: Aggregation

    def output(self, source: SourceDef) -> FieldType | None:
        found = source.field(self.field.field_id)
        return self.aggregation.output(found.field_type) if found else None


@dataclass(frozen=True)
class Streak(Measure):
    entity: FieldRef
    scheduled: FieldRef
    status: FieldRef
    completed: str
    entity_label: FieldRef | None = None
    top_n: int | None = None

    def output(self, source: SourceDef) -> None:
        return None

    @property
    def supports_date_range(self) -> bool:
        return False


@dataclass(frozen=True)
class Transformed(Measure):
    operand: Measure
    op: ScalarOp

    def output(self, source: SourceDef) -> FieldType | None:
        return self.operand.output(source)

    @property
    def supports_date_range(self) -> bool:
        return self.operand.supports_date_range


@dataclass(frozen=True)
class Calculated(Measure):
    a: Measure
    b: Measure
    combination: Combination

    def output(self, source: SourceDef) -> FieldType | None:
        a, b = self.a.output(source), self.b.output(source)
        return self.combination.output(a, b) if a and b else None

    @property
    def supports_date_range(self) -> bool:
        return self.a.supports_date_range and self.b.supports_date_range


def measure_labels(measures: Sequence[Measure]) -> list[str]:
    return [f"measure_{i}" if m.label is None else m.label for i, m in enumerate(measures)]


@dataclass(frozen=True)
class Filter:
    field: FieldRef
    op: Op
    value: Value


@dataclass(frozen=True)
class Having:
    op: Op
    threshold: Value
    measure_label: str | None = None


@dataclass(frozen=True)
class FieldGroupBy:
    field: FieldRef
    label: str | None = field(default=None, compare=False)

    @property
    def column(self) -> str:
        return self.field.field_id if self.label is None else self.label


@dataclass(frozen=True)
class TimeGroupBy:
    field: FieldRef
    grain: TimeGrain
    label: str | None = field(default=None, compare=False)

    @property
    def column(self) -> str:
        return self.field.field_id if self.label is None else self.label


GroupBy = FieldGroupBy | TimeGroupBy


class Direction(str, Enum):
    ascending = "ascending"
    descending = "descending"


@dataclass(frozen=True)
class ByGroup:
    field: FieldRef


@dataclass(frozen=True)
class ByMeasure:
    measure_label: str | None = None


@dataclass(frozen=True)
class Sort:
    target: ByGroup | ByMeasure
    direction: Direction = Direction.ascending
    force_nulls_last: bool = False


class Derive(str, Enum):
    none = "none"
    cumulativeSum = "cumulativeSum"
    delta = "delta"
    movingAverage = "movingAverage"


@dataclass(frozen=True)
class DerivedOp:
    kind: Derive = Derive.none
    window: int | None = None


NO_DERIVED, CUMULATIVE_SUM, DELTA = DerivedOp(), DerivedOp(Derive.cumulativeSum), DerivedOp(Derive.delta)


def moving_average(window: int) -> DerivedOp:
    return DerivedOp(Derive.movingAverage, window)


@dataclass(frozen=True)
class Query:
    source: str
    measures: tuple[Measure, ...]
    filters: tuple[Filter, ...] = ()
    group_bys: tuple[GroupBy, ...] = ()
    having: Having | None = None
    sort: Sort | None = None
    limit: int | None = None
    derived: DerivedOp = NO_DERIVED

    def __post_init__(self) -> None:
        for name in ("measures", "filters", "group_bys"):
            object.__setattr__(self, name, tuple(getattr(self, name)))

    def with_filters(self, *extra: Filter) -> Query:
        return dataclasses.replace(self, filters=(*self.filters, *extra))


@dataclass(frozen=True)
class Single:
    query: Query


@dataclass(frozen=True)
class Paired:
    x: Query
    y: Query


class Unmatched(str, Enum):
    """What becomes of keys that only one of two series has."""

    drop = "drop"
    fillIdentity = "fillIdentity"


class Shape(str, Enum):
    scalar = "scalar"
    series = "series"
    multiSeries = "multiSeries"
    multiMeasureSeries = "multiMeasureSeries"
    table = "table"
    pairedSeries = "pairedSeries"


def shape_of(spec: Query | Single | Paired) -> Shape:
    if isinstance(spec, Paired):
        return Shape.pairedSeries
    query = spec.query if isinstance(spec, Single) else spec
    if any(isinstance(m, Streak) for m in query.measures):
        return Shape.table
    one = len(query.measures) == 1
    by_groups = {0: Shape.scalar if one else Shape.table, 1: Shape.series if one else Shape.multiMeasureSeries, 2: Shape.multiSeries if one else Shape.table}
    return by_groups.get(len(query.group_bys), Shape.table)
