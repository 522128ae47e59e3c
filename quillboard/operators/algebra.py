"""Operations on held series: derived operations, per-value transforms, combination of two series."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from quillboard.errors import Err, ErrorKind, Failure, Ok, attempt
from quillboard.operators import aggregate as A
from quillboard.operators import derived as D
from quillboard.operators.densify import SYNTHETIC
from quillboard.plans import spec as Q
from quillboard.plans.validate import check_derived
from quillboard.results import POS, Result, ResultColumn
from quillboard.schema import NUMERIC


def _series(result: Result) -> ResultColumn:
    """The measure column of a series."""
    if result.shape is not Q.Shape.series:
        raise Failure(ErrorKind.preconditionViolation, "only series take part in series algebra")
    return result.columns[1]


def apply(series: Result, op: Q.DerivedOp) -> Ok | Err:
    """The derived operation over the series in its order; parameters are checked before types."""

    def work() -> Result:
        measure = _series(series)
        if op.kind is Q.Derive.none:
            return series
        check_derived(op)
        if measure.field_type not in NUMERIC:
            raise Failure(ErrorKind.derivedOpRequiresNumericMeasure, "derived operations need numbers")
        frame = D.derive(series.positioned(), measure.label, op, measure.field_type, [F.asc(POS)], "__derived", False)
        frame = frame.withColumn(measure.label, F.col("__derived")).drop("__derived")
        changed = replace(measure, field_type=D.output_type(op, measure.field_type))
        return replace(series, frame=frame, columns=(series.columns[0], changed), order=(F.asc(POS),))

    return attempt(work)


def transform(series: Result, op: Q.ScalarOp) -> Ok | Err:
    def work() -> Result:
        measure = _series(series)
        if measure.field_type not in NUMERIC:
            raise Failure(ErrorKind.incompatibleSeriesCombination, "the series holds no numbers")
        frame = series.positioned()
        column = A.transform(F.col(f"`{measure.label}`"), op, measure.field_type)
        return replace(series, frame=frame.withColumn(measure.label, column), order=(F.asc(POS),))

    return attempt(work)


def combine(x: Result, y: Result, how: Q.Combination, policy: Q.Unmatched = Q.Unmatched.drop, measure_label: str | None = None, key_label: str | None = None, semantic_tag: str | None = None) -> Ok | Err:
    """x and y matched by key, null keys too.

    drop keeps common keys in x's order. fillIdentity keeps all, keys ascending, an absent side standing
    for the operation's identity (a present null stays null); a ratio has none and keeps common keys.
    """

    def work() -> Result:
        bad = ErrorKind.incompatibleSeriesCombination
        mx, my = _series(x), _series(y)
        kx, ky = x.columns[0], y.columns[0]
        if mx.field_type not in NUMERIC or my.field_type not in NUMERIC:
            raise Failure(bad, "both series must hold numbers")
        if x.group_kind != y.group_kind or kx.field_type is not ky.field_type:
            raise Failure(bad, "the series have different axes")
        out = how.output(mx.field_type, my.field_type)
        if out is None:
            raise Failure(bad, "a duration adds to durations only")
        left = x.positioned().select(F.col(f"`{kx.label}`").alias("kx"), F.col(f"`{mx.label}`").alias("vx"), F.col(SYNTHETIC).alias("sx"), F.col(POS).alias("px"), F.lit(True).alias("hx"))
        right = y.frame.select(F.col(f"`{ky.label}`").alias("ky"), F.col(f"`{my.label}`").alias("vy"), F.col(SYNTHETIC).alias("sy"), F.lit(True).alias("hy"))
        outer = policy is Q.Unmatched.fillIdentity and how.identity is not None
        joined = left.join(right, F.col("kx").eqNullSafe(F.col("ky")), "full" if outer else "inner")
        a, b = F.col("vx"), F.col("vy")
        if outer:
            a = F.when(F.col("hx"), a).otherwise(A.boxed(how.identity, mx.field_type))
            b = F.when(F.col("hy"), b).otherwise(A.boxed(how.identity, my.field_type))
        key = key_label or kx.label
        label = measure_label or mx.label
        frame = joined.select(
            F.when(F.col("hx"), F.col("kx")).otherwise(F.col("ky")).alias(key),
            A.combine(a, b, how, mx.field_type, my.field_type).alias(label),
            (F.coalesce("sx", F.lit(True)) & F.coalesce("sy", F.lit(True))).alias(SYNTHETIC),
            F.col("px"),
        )
        order = (F.asc("px"),) if policy is Q.Unmatched.drop else (F.col(f"`{key}`").asc_nulls_last(),)
        return Result(Q.Shape.series, frame, (ResultColumn(key, kx.field_type, True), ResultColumn(label, out, False)), order, x.group_kind, semantic_tag=semantic_tag)

    return attempt(work)


class Fluent:
    """Chained operations on a series; `result` is Ok(Result) or the first Err."""

    def __init__(self, result: Result | Ok | Err):
        self.result = result if isinstance(result, (Ok, Err)) else Ok(result)

    def _then(self, f) -> Fluent:
        return Fluent(self.result.and_then(f))

    def cumulative_sum(self) -> Fluent:
        return self._then(lambda s: apply(s, Q.CUMULATIVE_SUM))

    def delta(self) -> Fluent:
        return self._then(lambda s: apply(s, Q.DELTA))

    def moving_average(self, window: int) -> Fluent:
        return self._then(lambda s: apply(s, Q.moving_average(window)))

    def negated(self) -> Fluent:
        return self._then(lambda s: transform(s, Q.ScalarOp(Q.Scalar.negate)))

    def absolute(self) -> Fluent:
        return self._then(lambda s: transform(s, Q.ScalarOp(Q.Scalar.abs)))

    def fill_null(self, number: float) -> Fluent:
        return self._then(lambda s: transform(s, Q.ScalarOp(Q.Scalar.fillNull, number)))

    def combine_with(self, other: Result, how: Q.Combination, policy: Q.Unmatched = Q.Unmatched.drop, **labels: str) -> Fluent:
        return self._then(lambda s: combine(s, other, how, policy, **labels))
