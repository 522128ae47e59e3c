"""JSON form of saved queries, date-range modes and display specs. Malformed text raises FormatError."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, replace
from datetime import datetime, timedelta
from enum import Enum
from typing import Any

from quillboard.functions import dates
from quillboard.functions.grain import TimeGrain, TimeUnit
from quillboard.plans import spec as Q
from quillboard.schema import FieldRef, FieldType, Value

SCHEMA_VERSION = 1
_MISSING = object()


class FormatError(ValueError):
    """The text is no saved object of the expected kind."""


def ensure_can_decode(version: int) -> None:
    if version > SCHEMA_VERSION:
        raise FormatError(f"schema version {version}; this library reads up to {SCHEMA_VERSION}")


class Reader:
    """Typed access to a decoded JSON object."""

    def __init__(self, data: Any):
        if not isinstance(data, dict):
            raise FormatError(f"expected an object, got {type(data).__name__}")
        self.data = data

    def _get(self, key: str, ok: Callable[[Any], bool], what: str, default: Any = _MISSING) -> Any:
        value = self.data.get(key)
        if value is None and default is not _MISSING:
            return default
        if not ok(value):
            raise FormatError(f"{key}: expected {what}, got {value!r}")
        return value

    def text(self, key: str, default: Any = _MISSING) -> Any:
        return self._get(key, lambda v: isinstance(v, str), "a string", default)

    def whole(self, key: str, default: Any = _MISSING) -> Any:
        return self._get(key, lambda v: type(v) is int, "an integer", default)

    def number(self, key: str) -> Any:
        return self._get(key, lambda v: type(v) in (int, float), "a number")

    def flag(self, key: str, default: Any = _MISSING) -> Any:
        return self._get(key, lambda v: isinstance(v, bool), "a boolean", default)

    def items(self, key: str, default: Any = _MISSING) -> Any:
        return self._get(key, lambda v: isinstance(v, list), "a list", default)

    def inner(self, key: str) -> Reader:
        return Reader(self._get(key, lambda v: isinstance(v, dict), "an object"))

    def maybe(self, key: str, read: Callable[[Reader], Any], default: Any = None) -> Any:
        return default if self.data.get(key) is None else read(self.inner(key))

    def each(self, key: str, read: Callable[[Reader], Any], default: Any = _MISSING) -> tuple:
        return tuple(read(Reader(x)) for x in self.items(key, default))

    def name(self, key: str, names: type[Enum]) -> Any:
        try:
            return names(self.text(key))
        except ValueError as error:
            raise FormatError(f"{key}: {error}") from None

    def moment(self, key: str) -> datetime:
        try:
            return datetime.fromisoformat(self.text(key)).replace(tzinfo=None)
        except ValueError as error:
            raise FormatError(f"{key}: {error}") from None

    def kind(self, readers: dict[str, Callable[[Reader], Any]], what: str) -> Any:
        kind = self.text("kind", None)
        if kind not in readers:
            raise FormatError(f"unknown {what} {kind!r}")
        return readers[kind](self)


def _load(text: str) -> Reader:
    try:
        return Reader(json.loads(text))
    except json.JSONDecodeError as error:
        raise FormatError(str(error)) from None


def _built(make: Callable[[], Any]) -> Any:
    """A constructor's complaint is a malformed payload here."""
    try:
        return make()
    except FormatError:
        raise
    except (ValueError, TypeError) as error:
        raise FormatError(str(error)) from None


def _set(**pairs: Any) -> dict[str, Any]:
    """Only the keys that are set."""
    return {k: v for k, v in pairs.items() if v is not None}


def iso(x: datetime) -> str:
    """ISO 8601 with milliseconds, or microseconds where they matter."""
    return x.isoformat(timespec="microseconds" if x.microsecond % 1000 else "milliseconds")


# values: the tag of each type in JSON (fixed values)
_SCALAR_TAG = {
    FieldType.string: "string",
    FieldType.enumeration: "enum",
    FieldType.integer: "int",
    FieldType.double: "double",
    FieldType.boolean: "bool",
    FieldType.dateTime: "dateTime",
    FieldType.duration: "duration",
}
_LIST_TAG = {FieldType.string: "stringList", FieldType.enumeration: "enumList", FieldType.integer: "intList"}
_TICK = timedelta(microseconds=1)


def value_json(v: Value) -> dict:
    if v.is_list:
        return {"kind": _LIST_TAG[v.field_type], "values": list(v.value)}
    if v.is_null:
        return {"kind": "null", "fieldType": v.field_type.value}
    plain = {FieldType.dateTime: iso, FieldType.duration: lambda d: d // _TICK}.get(v.field_type, lambda x: x)
    return {"kind": _SCALAR_TAG[v.field_type], "value": plain(v.value)}


_READ_SCALAR: dict[FieldType, Callable[[Reader], Any]] = {
    FieldType.string: lambda r: r.text("value"),
    FieldType.enumeration: lambda r: r.text("value"),
    FieldType.integer: lambda r: r.whole("value"),
    FieldType.double: lambda r: float(r.number("value")),
    FieldType.boolean: lambda r: r.flag("value"),
    FieldType.dateTime: lambda r: r.moment("value"),
    FieldType.duration: lambda r: r.whole("value") * _TICK,
}


def read_value(r: Reader) -> Value:
    readers: dict[str, Callable[[Reader], Value]] = {"null": lambda r: Value(r.name("fieldType", FieldType), None)}
    for t, tag in _SCALAR_TAG.items():
        readers[tag] = lambda r, t=t: Value(t, _READ_SCALAR[t](r))
    for t, tag in _LIST_TAG.items():
        readers[tag] = lambda r, t=t: Value(t, r.items("values"), True)
    return _built(lambda: r.kind(readers, "value"))


def ref_json(ref: FieldRef) -> dict:
    return {"sourceId": ref.source_id, "fieldId": ref.field_id}


def read_ref(r: Reader) -> FieldRef:
    return FieldRef(r.text("sourceId"), r.text("fieldId"))


def measure_json(m: Q.Measure) -> dict:
    label = _set(label=m.label)
    if isinstance(m, Q.Count):
        return {"kind": "count", **label}
    if isinstance(m, Q.FieldMeasure):
        return {"kind": "field", "fieldRef": ref_json(m.field), "aggregation": {"kind": m.aggregation.kind.value, **_set(p=m.aggregation.p)}, **label}
    if isinstance(m, Q.Transformed):
        return {"kind": "transformed", "op": {"kind": m.op.kind.value, **_set(fill=m.op.fill)}, "operand": measure_json(m.operand), **label}
    if isinstance(m, Q.Calculated):
        return {"kind": "calculated", "combination": m.combination.value, "operandA": measure_json(m.a), "operandB": measure_json(m.b), **label}
    return {
        "kind": "streak",
        "entityIdField": ref_json(m.entity),
        "scheduledDateField": ref_json(m.scheduled),
        "statusField": ref_json(m.status),
        "completedStatusValue": m.completed,
        **_set(entityLabelField=m.entity_label and ref_json(m.entity_label), topN=m.top_n),
        **label,
    }


def _read_aggregation(r: Reader) -> Q.Aggregation:
    kind = r.name("kind", Q.Aggregate)
    return Q.Aggregation(kind, float(r.number("p")) if kind is Q.Aggregate.percentile else None)


def _read_scalar_op(r: Reader) -> Q.ScalarOp:
    kind = r.name("kind", Q.Scalar)
    return Q.ScalarOp(kind, r.number("fill") if kind is Q.Scalar.fillNull else None)


_MEASURES: dict[str, Callable[[Reader], Q.Measure]] = {
    "count": lambda r: Q.Count(),
    "field": lambda r: Q.FieldMeasure(read_ref(r.inner("fieldRef")), _read_aggregation(r.inner("aggregation"))),
    "transformed": lambda r: Q.Transformed(read_measure(r.inner("operand")), _read_scalar_op(r.inner("op"))),
    "calculated": lambda r: Q.Calculated(read_measure(r.inner("operandA")), read_measure(r.inner("operandB")), r.name("combination", Q.Combination)),
    "streak": lambda r: Q.Streak(
        read_ref(r.inner("entityIdField")),
        read_ref(r.inner("scheduledDateField")),
        read_ref(r.inner("statusField")),
        r.text("completedStatusValue"),
        r.maybe("entityLabelField", read_ref),
        r.whole("topN", None),
    ),
}


def read_measure(r: Reader) -> Q.Measure:
    return replace(r.kind(_MEASURES, "measure"), label=r.text("label", None))


def grain_json(g: TimeGrain) -> dict:
    return {"count": g.count, "unit": g.unit.value, "anchor": iso(g.anchor), **_set(weekStartDay=g.week_start)}


def read_grain(r: Reader) -> TimeGrain:
    return _built(lambda: TimeGrain(r.whole("count"), r.name("unit", TimeUnit), r.moment("anchor"), r.whole("weekStartDay", None)))


def group_by_json(g: Q.GroupBy) -> dict:
    if isinstance(g, Q.TimeGroupBy):
        return {"kind": "time", "dateFieldRef": ref_json(g.field), "grain": grain_json(g.grain), **_set(label=g.label)}
    return {"kind": "field", "fieldRef": ref_json(g.field), **_set(label=g.label)}


_GROUP_BYS: dict[str, Callable[[Reader], Q.GroupBy]] = {
    "field": lambda r: Q.FieldGroupBy(read_ref(r.inner("fieldRef")), r.text("label", None)),
    "time": lambda r: Q.TimeGroupBy(read_ref(r.inner("dateFieldRef")), read_grain(r.inner("grain")), r.text("label", None)),
}


def _filter_json(f: Q.Filter) -> dict:
    return {"fieldRef": ref_json(f.field), "operator": f.op.value, "value": value_json(f.value)}


def _read_filter(r: Reader) -> Q.Filter:
    return Q.Filter(read_ref(r.inner("fieldRef")), r.name("operator", Q.Op), read_value(r.inner("value")))


def _having_json(h: Q.Having) -> dict:
    return {"operator": h.op.value, "threshold": value_json(h.threshold), **_set(measureLabel=h.measure_label)}


def _read_having(r: Reader) -> Q.Having:
    op = r.name("operator", Q.Op)
    if op is Q.Op.inList:
        raise FormatError("HAVING has no inList")
    return Q.Having(op, read_value(r.inner("threshold")), r.text("measureLabel", None))


def _sort_json(s: Q.Sort) -> dict:
    target = {"kind": "groupField", "fieldRef": ref_json(s.target.field)} if isinstance(s.target, Q.ByGroup) else {"kind": "measureValue", **_set(measureLabel=s.target.measure_label)}
    return {"target": target, "direction": s.direction.value, **_set(forceNullsLast=s.force_nulls_last or None)}


_TARGETS: dict[str, Callable[[Reader], Any]] = {
    "groupField": lambda r: Q.ByGroup(read_ref(r.inner("fieldRef"))),
    "measureValue": lambda r: Q.ByMeasure(r.text("measureLabel", None)),
}


def _read_sort(r: Reader) -> Q.Sort:
    return Q.Sort(r.inner("target").kind(_TARGETS, "sort target"), r.name("direction", Q.Direction), r.flag("forceNullsLast", False))


def _read_derived(r: Reader) -> Q.DerivedOp:
    kind = r.name("kind", Q.Derive)
    return Q.DerivedOp(kind, r.whole("window") if kind is Q.Derive.movingAverage else None)


def query_json(q: Q.Query) -> dict:
    return {
        "source": q.source,
        "measures": [measure_json(m) for m in q.measures],
        "filters": [_filter_json(f) for f in q.filters],
        "groupBys": [group_by_json(g) for g in q.group_bys],
        **_set(having=q.having and _having_json(q.having), sort=q.sort and _sort_json(q.sort), limit=q.limit),
        "derivedOperation": {"kind": q.derived.kind.value, **_set(window=q.derived.window)},
    }


def read_query(r: Reader) -> Q.Query:
    return Q.Query(
        r.text("source"),
        r.each("measures", read_measure, ()),
        r.each("filters", _read_filter, ()),
        r.each("groupBys", lambda g: g.kind(_GROUP_BYS, "group-by"), ()),
        r.maybe("having", _read_having),
        r.maybe("sort", _read_sort),
        r.whole("limit", None),
        r.maybe("derivedOperation", _read_derived, Q.NO_DERIVED),
    )


def encode_payload(p: Q.Single | Q.Paired) -> str:
    if isinstance(p, Q.Single):
        return json.dumps({"kind": "single", "query": query_json(p.query)})
    return json.dumps({"kind": "paired", "xQuery": query_json(p.x), "yQuery": query_json(p.y)})


def decode_payload(text: str) -> Q.Single | Q.Paired:
    kinds: dict[str, Callable[[Reader], Any]] = {
        "single": lambda r: Q.Single(read_query(r.inner("query"))),
        "paired": lambda r: Q.Paired(read_query(r.inner("xQuery")), read_query(r.inner("yQuery"))),
    }
    return _load(text).kind(kinds, "payload")


def _range_json(r: dates.DateRange) -> dict:
    if isinstance(r, dates.PresetRange):
        return {"kind": "preset", "preset": r.preset.value}
    return {"kind": "custom", "start": iso(r.start), "end": iso(r.end_exclusive - timedelta(days=1))}


_RANGES: dict[str, Callable[[Reader], dates.DateRange]] = {
    "preset": lambda r: dates.PresetRange(r.name("preset", dates.Preset)),
    "custom": lambda r: _built(lambda: dates.CustomRange(r.moment("start"), r.moment("end"))),
}


def encode_range(r: dates.DateRange) -> str:
    return json.dumps(_range_json(r))


def decode_range(text: str) -> dates.DateRange:
    return _load(text).kind(_RANGES, "date range")


def encode_mode(mode: dates.DateRangeMode) -> str:
    if isinstance(mode, dates.FixedOverride):
        return json.dumps({"kind": "fixedOverride", "range": _range_json(mode.range)})
    return json.dumps({"kind": "usePageRange" if isinstance(mode, dates.UsePageRange) else "noDateRange"})


def decode_mode(text: str) -> dates.DateRangeMode:
    kinds: dict[str, Callable[[Reader], dates.DateRangeMode]] = {
        "usePageRange": lambda r: dates.UsePageRange(),
        "noDateRange": lambda r: dates.NoDateRange(),
        "fixedOverride": lambda r: dates.FixedOverride(r.inner("range").kind(_RANGES, "date range")),
    }
    return _load(text).kind(kinds, "date-range mode")


@dataclass(frozen=True)
class DisplaySpec:
    display_type: str


def encode_display(d: DisplaySpec) -> str:
    return json.dumps({"displayType": d.display_type})


def decode_display(text: str) -> DisplaySpec:
    return DisplaySpec(_load(text).text("displayType"))


@dataclass(frozen=True, eq=False)
class WidgetSpec:
    """A saved widget; two are equal if their ids are."""

    id: str
    title: str
    query_json: str
    display_json: str
    date_range_mode_json: str
    sort_order: int
    created_at: datetime
    updated_at: datetime
    schema_version: int = SCHEMA_VERSION

    def copy_with(self, **changes: Any) -> WidgetSpec:
        return replace(self, **changes)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, WidgetSpec) and other.id == self.id

    def __hash__(self) -> int:
        return hash(self.id)
