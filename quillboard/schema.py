"""Sources, fields, values: the declared side of a table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from enum import Enum
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class FieldType(str, Enum):
    string = "string"
    enumeration = "enumeration"
    integer = "integer"
    double = "double"
    boolean = "boolean"
    dateTime = "dateTime"
    duration = "duration"


NUMERIC = frozenset({FieldType.integer, FieldType.double, FieldType.duration})
ORDERED = NUMERIC | {FieldType.dateTime}
LISTABLE = frozenset({FieldType.string, FieldType.enumeration, FieldType.integer})
#: Column types of the compiled plan; durations are microseconds, dates have no zone.
SPARK_TYPE = {
    FieldType.string: "string",
    FieldType.enumeration: "string",
    FieldType.integer: "bigint",
    FieldType.double: "double",
    FieldType.boolean: "boolean",
    FieldType.dateTime: "timestamp_ntz",
    FieldType.duration: "bigint",
}
_ACCEPTED = {
    FieldType.string: (T.StringType,),
    FieldType.enumeration: (T.StringType,),
    FieldType.integer: (T.ByteType, T.ShortType, T.IntegerType, T.LongType),
    FieldType.double: (T.FloatType, T.DoubleType),
    FieldType.boolean: (T.BooleanType,),
    FieldType.dateTime: (T.TimestampNTZType, T.TimestampType, T.DateType),
    FieldType.duration: (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DayTimeIntervalType),
}
_PYTHON = {
    FieldType.string: str,
    FieldType.enumeration: str,
    FieldType.integer: int,
    FieldType.double: float,
    FieldType.boolean: bool,
    FieldType.dateTime: datetime,
    FieldType.duration: timedelta,
}


@dataclass(frozen=True)
class FieldRef:
    source_id: str
    field_id: str


@dataclass(frozen=True)
class FieldDef:
    field_id: str
    source_id: str
    display_name: str
    field_type: FieldType
    filterable: bool = True
    groupable: bool = True
    aggregatable: bool = True
    sortable: bool = True

    @property
    def ref(self) -> FieldRef:
        return FieldRef(self.source_id, self.field_id)


@dataclass(frozen=True)
class SourceDef:
    source_id: str
    display_name: str
    fields: tuple[FieldDef, ...]
    primary_date: str | None = None
    _by_id: dict[str, FieldDef] = field(default_factory=dict, repr=False, compare=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "fields", tuple(self.fields))
        for f in self.fields:
            if f.source_id != self.source_id:
                raise ValueError(f"field {f.field_id} belongs to source {f.source_id}")
            if f.field_id in self._by_id:
                raise ValueError(f"field {f.field_id} is declared twice")
            self._by_id[f.field_id] = f
        if self.primary_date is not None:
            primary = self._by_id.get(self.primary_date)
            if primary is None or primary.field_type is not FieldType.dateTime:
                raise ValueError("the primary date must be a dateTime field of the source")

    def field(self, field_id: str) -> FieldDef | None:
        return self._by_id.get(field_id)

    @property
    def primary_date_field(self) -> FieldDef | None:
        return self._by_id.get(self.primary_date) if self.primary_date else None

    def ref(self, field_id: str) -> FieldRef:
        return FieldRef(self.source_id, field_id)


def find_source(sources: Sequence[SourceDef], source_id: str) -> SourceDef | None:
    return next((s for s in sources if s.source_id == source_id), None)


def column_of(f: FieldDef, schema: T.StructType) -> Column | None:
    """The field as the plan's type; a typed null if the column is absent; None if its type does not fit."""
    if f.field_id not in schema.fieldNames():
        return F.lit(None).cast(SPARK_TYPE[f.field_type]).alias(f.field_id)
    have = schema[f.field_id].dataType
    column = F.col(f"`{f.field_id}`")
    if isinstance(have, T.NullType):
        return F.lit(None).cast(SPARK_TYPE[f.field_type]).alias(f.field_id)
    if not isinstance(have, _ACCEPTED[f.field_type]):
        return None
    if f.field_type is FieldType.duration and isinstance(have, T.DayTimeIntervalType):
        return F.unix_micros(F.lit("1970-01-01 00:00:00").cast("timestamp") + column).alias(f.field_id)
    if have.simpleString() == SPARK_TYPE[f.field_type]:
        return column
    return column.cast(SPARK_TYPE[f.field_type]).alias(f.field_id)


@dataclass(frozen=True)
class Value:
    """A typed literal: a scalar, a list (for inList), or a typed null."""

    field_type: FieldType
    value: Any
    is_list: bool = False

    def __post_init__(self) -> None:
        if self.is_list:
            object.__setattr__(self, "value", tuple(self.value))
            items = self.value
            if self.field_type not in LISTABLE:
                raise TypeError(f"no lists of {self.field_type.value}")
        else:
            items = () if self.value is None else (self.value,)
        kind = _PYTHON[self.field_type]
        for x in items:
            if type(x) is not kind and not (kind is datetime and isinstance(x, datetime)):
                raise TypeError(f"{x!r} is no {self.field_type.value}")

    @property
    def is_null(self) -> bool:
        return not self.is_list and self.value is None

    def lit(self) -> Column:
        return literal(self.field_type, self.value)


def literal(field_type: FieldType, value: Any) -> Column:
    if value is not None and field_type is FieldType.dateTime:
        value = value.replace(tzinfo=None).isoformat(sep=" ")
    if value is not None and field_type is FieldType.duration and isinstance(value, timedelta):
        value = value // timedelta(microseconds=1)
    return F.lit(value).cast(SPARK_TYPE[field_type])


def string(x: str) -> Value:
    return Value(FieldType.string, x)


def enum(x: str) -> Value:
    return Value(FieldType.enumeration, x)


def integer(x: int) -> Value:
    return Value(FieldType.integer, x)


def double(x: float) -> Value:
    return Value(FieldType.double, float(x))


def boolean(x: bool) -> Value:
    return Value(FieldType.boolean, x)


def date_time(x: datetime) -> Value:
    return Value(FieldType.dateTime, x)


def duration(x: timedelta) -> Value:
    return Value(FieldType.duration, x)


def null(field_type: FieldType) -> Value:
    return Value(field_type, None)


def strings(xs: Sequence[str]) -> Value:
    return Value(FieldType.string, xs, True)


def enums(xs: Sequence[str]) -> Value:
    return Value(FieldType.enumeration, xs, True)


def integers(xs: Sequence[int]) -> Value:
    return Value(FieldType.integer, xs, True)
