"""Checks of a query against its source, before any plan is made. The first violation is reported."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

from quillboard.errors import Err, ErrorKind, Failure, Ok, attempt
from quillboard.functions.dates import DateRangeMode, NoDateRange
from quillboard.plans import spec as Q
from quillboard.schema import LISTABLE, NUMERIC, ORDERED, FieldDef, FieldRef, FieldType, SourceDef, Value, find_source

MAX_DEPTH = 8
MAX_MEASURES = 5
MAX_GROUPS = 3


def _fail_if(bad: bool, kind: ErrorKind, message: str, ref: FieldRef | None = None) -> None:
    if bad:
        raise Failure(kind, message, ref)


def _resolve(ref: FieldRef, source: SourceDef, foreign: ErrorKind = ErrorKind.unknownField) -> FieldDef:
    _fail_if(ref.source_id != source.source_id, foreign, f"{ref.field_id} belongs to {ref.source_id}, the query reads {source.source_id}", ref)
    found = source.field(ref.field_id)
    _fail_if(found is None, ErrorKind.unknownField, f"{source.source_id} has no field {ref.field_id}", ref)
    return found


def validate_query(query: Q.Query, sources: Sequence[SourceDef], max_depth: int = MAX_DEPTH) -> Ok | Err:
    return attempt(lambda: check_query(query, sources, max_depth))


def check_query(query: Q.Query, sources: Sequence[SourceDef], max_depth: int = MAX_DEPTH) -> SourceDef:
    """The query's source; raises Failure. The order of the checks is part of the contract."""
    pre = ErrorKind.preconditionViolation
    source = find_source(sources, query.source)
    _fail_if(source is None, ErrorKind.unknownSource, f"no source {query.source}")
    _fail_if(not query.measures, ErrorKind.measuresEmpty, "a query needs a measure")
    _fail_if(len(query.measures) > MAX_MEASURES, ErrorKind.tooManyMeasures, f"{len(query.measures)} measures, at most {MAX_MEASURES}")
    for m in query.measures:
        _fail_if(depth(m) > max_depth, pre, f"an expression is nested deeper than {max_depth}")
        check_measure(m, source)
    streak = any(isinstance(m, Q.Streak) for m in query.measures)
    _fail_if(streak and len(query.measures) > 1, ErrorKind.streakNotCombinable, "a streak stands alone")
    labels = Q.measure_labels(query.measures)
    _distinct(labels, ErrorKind.duplicateMeasureLabel)
    if streak:
        for clause in ("sort", "limit", "having"):
            _fail_if(getattr(query, clause) is not None, pre, f"a streak takes no {clause}")
    for f in query.filters:
        check_filter(f, source)
    _fail_if(len(query.group_bys) > MAX_GROUPS, ErrorKind.tooManyGroupBys, f"{len(query.group_bys)} group-bys, at most {MAX_GROUPS}")
    _fail_if(sum(isinstance(g, Q.TimeGroupBy) for g in query.group_bys) > 1, ErrorKind.multipleTemporalGroupBys, "one time axis at most")
    _fail_if(streak and bool(query.group_bys), ErrorKind.streakWithExplicitGrouping, "a streak groups by its entity")
    for g in query.group_bys:
        check_group_by(g, source)
    _fail_if(len(set(query.group_bys)) < len(query.group_bys), pre, "two group-bys are the same dimension")
    _distinct([*(g.column for g in query.group_bys), *labels], ErrorKind.duplicateColumnLabel)
    derives = query.derived.kind is not Q.Derive.none
    _fail_if(derives and len(query.group_bys) != 1, pre, "a derived operation needs one group-by")
    _fail_if(derives and len(query.measures) != 1, pre, "a derived operation needs one measure")
    if query.sort is not None:
        check_sort(query, source)
    if query.having is not None:
        check_having(query, source)
    if derives:
        check_derived(query.derived)
        _fail_if(query.measures[0].output(source) not in NUMERIC, ErrorKind.derivedOpRequiresNumericMeasure, "derived operations need numbers")
    _fail_if(query.limit is not None and query.limit < 0, pre, "the limit is negative")
    return source


def _distinct(labels: Iterable[str], kind: ErrorKind) -> None:
    seen: set[str] = set()
    for label in labels:
        _fail_if(label in seen, kind, f"label {label!r} is used twice")
        seen.add(label)


def depth(m: Q.Measure) -> int:
    """Expression levels above the deepest leaf."""
    levels, deepest = [(m, 0)], 0
    while levels:
        at, d = levels.pop()
        deepest = max(deepest, d)
        if isinstance(at, Q.Transformed):
            levels.append((at.operand, d + 1))
        elif isinstance(at, Q.Calculated):
            levels += [(at.a, d + 1), (at.b, d + 1)]
    return deepest


def check_measure(m: Q.Measure, source: SourceDef) -> None:
    pre, mixed = ErrorKind.preconditionViolation, ErrorKind.incompatibleSeriesCombination
    if isinstance(m, Q.FieldMeasure):
        f = _resolve(m.field, source)
        _fail_if(not f.aggregatable, ErrorKind.fieldNotAggregatable, f"{f.field_id} is not aggregatable", m.field)
        agg = m.aggregation
        _fail_if(f.field_type not in Q.TAKES[agg.kind], ErrorKind.incompatibleAggregation, f"{agg.kind.value} of {f.field_type.value}", m.field)
        if agg.kind is Q.Aggregate.percentile:
            _fail_if(agg.p is None or math.isnan(agg.p) or not 0 <= agg.p <= 1, ErrorKind.invalidAggregationParameter, f"p = {agg.p}", m.field)
    elif isinstance(m, Q.Streak):
        scheduled = _resolve(m.scheduled, source)
        _fail_if(scheduled.field_type is not FieldType.dateTime, ErrorKind.timeGrainOnNonDateField, "a streak's schedule is a dateTime", m.scheduled)
        _resolve(m.entity, source)
        status = _resolve(m.status, source)
        _fail_if(status.field_type not in (FieldType.string, FieldType.enumeration), pre, "a streak's status is a string or enumeration", m.status)
        if m.entity_label is not None:
            label = _resolve(m.entity_label, source)
            _fail_if(label.field_type is not FieldType.string, pre, "a streak's label is a string", m.entity_label)
        _fail_if(m.top_n is not None and m.top_n < 0, pre, "top_n is negative")
    elif isinstance(m, (Q.Transformed, Q.Calculated)):
        operands = (m.operand,) if isinstance(m, Q.Transformed) else (m.a, m.b)
        _fail_if(any(isinstance(x, Q.Streak) for x in operands), ErrorKind.streakNotCombinable, "a streak is no operand")
        for x in operands:
            check_measure(x, source)
        types = [x.output(source) for x in operands]
        _fail_if(any(t not in NUMERIC for t in types), mixed, "operands must be numbers")
        if isinstance(m, Q.Calculated):
            _fail_if(m.combination.output(*types) is None, mixed, "a duration adds to durations only")


def check_filter(f: Q.Filter, source: SourceDef) -> None:
    found = _resolve(f.field, source)
    bad = ErrorKind.incompatibleOperator
    _fail_if(not found.filterable, ErrorKind.fieldNotFilterable, f"{found.field_id} is not filterable", f.field)
    allowed = LISTABLE if f.op is Q.Op.inList else ORDERED if f.op in Q.ORDER_OPS else frozenset(FieldType)
    _fail_if(found.field_type not in allowed, bad, f"{f.op.value} on {found.field_type.value}", f.field)
    value: Value = f.value
    _fail_if(value.is_list != (f.op is Q.Op.inList), bad, f"{f.op.value} with {'a list' if value.is_list else 'a scalar'}", f.field)
    if value.is_null:
        _fail_if(f.op in Q.ORDER_OPS, bad, "nothing is ordered against null", f.field)
    else:
        _fail_if(value.field_type is not found.field_type, bad, f"{value.field_type.value} against {found.field_type.value}", f.field)


def check_group_by(g: Q.GroupBy, source: SourceDef) -> None:
    found = _resolve(g.field, source)
    if isinstance(g, Q.TimeGroupBy):
        _fail_if(found.field_type is not FieldType.dateTime, ErrorKind.timeGrainOnNonDateField, f"{found.field_id} is no dateTime", g.field)
    else:
        _fail_if(not found.groupable, ErrorKind.fieldNotGroupable, f"{found.field_id} is not groupable", g.field)
        _fail_if(found.field_type is FieldType.dateTime, ErrorKind.preconditionViolation, "a dateTime is grouped by a grain", g.field)


def check_sort(query: Q.Query, source: SourceDef) -> None:
    target, bad = query.sort.target, ErrorKind.incompatibleSortTarget
    _fail_if(not query.group_bys, bad, "a sort needs a group-by")
    if isinstance(target, Q.ByGroup):
        found = _resolve(target.field, source, foreign=bad)
        _fail_if(not found.sortable, bad, f"{found.field_id} is not sortable", target.field)
        _fail_if(all(g.field != target.field for g in query.group_bys), bad, "the sort field is no group-by", target.field)
    else:
        target_measure(query, target.measure_label)


def target_measure(query: Q.Query, label: str | None) -> int:
    """Place of the measure that a sort or HAVING clause means."""
    if label is None:
        _fail_if(len(query.measures) > 1, ErrorKind.preconditionViolation, "with several measures the label is required")
        return 0
    labels = Q.measure_labels(query.measures)
    _fail_if(label not in labels, ErrorKind.unknownMeasureLabel, f"no measure {label!r}")
    return labels.index(label)


def check_having(query: Q.Query, source: SourceDef) -> None:
    having, bad = query.having, ErrorKind.incompatibleOperator
    _fail_if(not query.group_bys, ErrorKind.havingRequiresGrouping, "HAVING needs a group-by")
    output = query.measures[target_measure(query, having.measure_label)].output(source)
    _fail_if(having.threshold.is_null, bad, "the threshold is null")
    _fail_if(having.threshold.field_type is not output, bad, f"threshold {having.threshold.field_type.value}, measure {output.value if output else None}")


def check_derived(op: Q.DerivedOp) -> None:
    _fail_if(op.kind is Q.Derive.movingAverage and (op.window is None or op.window <= 0), ErrorKind.invalidDerivedOperationParameter, f"window {op.window}")


def validate_payload(payload: Q.Single | Q.Paired, sources: Sequence[SourceDef], mode: DateRangeMode, max_depth: int = MAX_DEPTH) -> Ok | Err:
    return attempt(lambda: check_payload(payload, sources, mode, max_depth))


def check_payload(payload: Q.Single | Q.Paired, sources: Sequence[SourceDef], mode: DateRangeMode, max_depth: int = MAX_DEPTH) -> None:
    queries = (payload.query,) if isinstance(payload, Q.Single) else (payload.x, payload.y)
    for query in queries:
        check_query(query, sources, max_depth)
    if isinstance(payload, Q.Paired):
        _fail_if(any(Q.shape_of(q) is not Q.Shape.series for q in queries), ErrorKind.incompatiblePairedQueryShapes, "both halves must be series")
        check_alignable(payload.x, payload.y, sources)
    for m in (m for q in queries for m in q.measures):
        ranged = not isinstance(mode, NoDateRange)
        _fail_if(m.supports_date_range and not ranged, ErrorKind.dateRangeRequiredForMeasure, "the measure needs a date range")
        _fail_if(ranged and not m.supports_date_range, ErrorKind.dateRangeNotSupportedForMeasure, "the measure takes no date range")


def check_alignable(x: Q.Query, y: Q.Query, sources: Sequence[SourceDef]) -> None:
    """One source: equal group-bys. Two sources: time axes of one grain, and primary dates on both."""
    bad = ErrorKind.incompatiblePairedQueryShapes
    if x.source == y.source:
        _fail_if(x.group_bys != y.group_bys, bad, "the halves have different axes")
        return
    gx, gy = x.group_bys[0], y.group_bys[0]
    _fail_if(not (isinstance(gx, Q.TimeGroupBy) and isinstance(gy, Q.TimeGroupBy)), bad, "two sources align on time only")
    _fail_if(gx.grain != gy.grain, bad, "the halves have different grains")
    missing = any(find_source(sources, q.source).primary_date_field is None for q in (x, y))
    _fail_if(missing, ErrorKind.primaryDateFieldRequiredForOperation, "both sources need a primary date")
