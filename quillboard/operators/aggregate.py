"""Predicates, leaf aggregates and expression measures as column expressions."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillboard.plans import spec as Q
from quillboard.schema import SPARK_TYPE, FieldType, SourceDef


def predicate(f: Q.Filter) -> Column:
    """Null-aware filter: equals null is IS NULL, notEquals x keeps null rows, order and lists drop them."""
    column = F.col(f"`{f.field.field_id}`")
    if f.op is Q.Op.inList:
        return column.isin(list(f.value.value)) if f.value.value else F.lit(False)
    return compare(column, f.op, f.value.lit())


def compare(column: Column, op: Q.Op, bound: Column) -> Column:
    return {
        Q.Op.equals: lambda: column.eqNullSafe(bound),
        Q.Op.notEquals: lambda: ~column.eqNullSafe(bound),
        Q.Op.lessThan: lambda: column < bound,
        Q.Op.lessThanOrEqual: lambda: column <= bound,
        Q.Op.greaterThan: lambda: column > bound,
        Q.Op.greaterThanOrEqual: lambda: column >= bound,
    }[op]()


def all_of(filters: tuple[Q.Filter, ...]) -> Column:
    return reduce(lambda a, b: a & b, map(predicate, filters), F.lit(True))


def leaves(m: Q.Measure) -> list[Q.Measure]:
    if isinstance(m, Q.Transformed):
        return leaves(m.operand)
    if isinstance(m, Q.Calculated):
        return leaves(m.a) + leaves(m.b)
    return [m]


def leaf_key(m: Q.Measure) -> tuple:
    """Equal for leaves that are one aggregate."""
    return ("count",) if isinstance(m, Q.Count) else (m.field.field_id, m.aggregation)


def zero(m: Q.Measure, source: SourceDef) -> Column | None:
    """The value of an additive leaf over no rows; None where that is null."""
    if isinstance(m, Q.Count):
        return F.lit(0).cast("bigint")
    return F.lit(0).cast(SPARK_TYPE[m.output(source)]) if m.aggregation.kind in Q.ADDITIVE else None


def aggregate(m: Q.Measure, source: SourceDef) -> Column:
    """The leaf over the rows of a bucket."""
    if isinstance(m, Q.Count):
        return F.count(F.lit(1))
    column, kind = F.col(f"`{m.field.field_id}`"), m.aggregation.kind
    span = source.field(m.field.field_id).field_type is FieldType.duration
    if kind is Q.Aggregate.sum:
        return F.coalesce(F.sum(column), zero(m, source))
    if kind is Q.Aggregate.average:
        return F.expr(f"sum(`{m.field.field_id}`) div nullif(count(`{m.field.field_id}`), 0)") if span else F.avg(column)
    if kind is Q.Aggregate.percentile:
        return percentile_value(F.percentile(column, m.aggregation.p), m, source)
    return {Q.Aggregate.min: F.min, Q.Aggregate.max: F.max, Q.Aggregate.distinctCount: F.count_distinct}[kind](column)


def is_percentile(m: Q.Measure) -> bool:
    return not isinstance(m, Q.Count) and m.aggregation.kind is Q.Aggregate.percentile


def percentile_value(exact: Column, m: Q.Measure, source: SourceDef) -> Column:
    """An interpolated number as a value of the measure's type."""
    return F.round(exact).cast("bigint") if source.field(m.field.field_id).field_type is FieldType.duration else exact


def half_away(x: float) -> int:
    return int(math.copysign(math.floor(abs(x) + 0.5), x))


def boxed(number: float, t: FieldType) -> Column:
    """A plain number as a value of the measure's type."""
    return F.lit(float(number)) if t is FieldType.double else F.lit(half_away(number)).cast("bigint")


def transform(column: Column, op: Q.ScalarOp, t: FieldType) -> Column:
    if op.kind is Q.Scalar.negate:
        return -column
    if op.kind is Q.Scalar.abs:
        return F.abs(column)
    return F.coalesce(column, boxed(op.fill, t))


def combine(a: Column, b: Column, how: Q.Combination, ta: FieldType, tb: FieldType) -> Column:
    """Null if an operand is; a ratio also where the divisor is 0."""
    if how.output(ta, tb) is FieldType.double:
        a, b = a.cast("double"), b.cast("double")
    return {
        Q.Combination.sum: lambda: a + b,
        Q.Combination.difference: lambda: a - b,
        Q.Combination.product: lambda: a * b,
        Q.Combination.ratio: lambda: F.try_divide(a, b),
    }[how]()


def expression(m: Q.Measure, names: dict[tuple, str], source: SourceDef) -> Column:
    """A measure over the leaf columns of an aggregated frame."""
    if isinstance(m, Q.Transformed):
        return transform(expression(m.operand, names, source), m.op, m.operand.output(source))
    if isinstance(m, Q.Calculated):
        return combine(expression(m.a, names, source), expression(m.b, names, source), m.combination, m.a.output(source), m.b.output(source))
    return F.col(names[leaf_key(m)])
