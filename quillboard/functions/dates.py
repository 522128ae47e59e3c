"""Date ranges: presets, custom ranges, modes, and their projection into query filters."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta
from enum import Enum

from quillboard.errors import Err, ErrorKind, Failure, Ok, attempt
from quillboard.plans import spec as Q
from quillboard.schema import SourceDef, date_time, find_source


class Preset(str, Enum):
    last7Days = "last7Days"
    last14Days = "last14Days"
    last30Days = "last30Days"
    last90Days = "last90Days"
    thisWeek = "thisWeek"
    thisMonth = "thisMonth"
    lastMonth = "lastMonth"
    quarterToDate = "quarterToDate"
    allTime = "allTime"


_LAST = {Preset.last7Days: 7, Preset.last14Days: 14, Preset.last30Days: 30, Preset.last90Days: 90}


@dataclass(frozen=True)
class Range:
    """Resolved, day-aligned, half-open."""

    start: datetime
    end: datetime


@dataclass(frozen=True)
class PresetRange:
    preset: Preset


@dataclass(frozen=True, init=False)
class CustomRange:
    """Given by its first and last day; kept half-open."""

    start: datetime
    end_exclusive: datetime

    def __init__(self, start: datetime, end: datetime):
        first, last = _midnight(start), _midnight(end)
        if first > last:
            raise ValueError("the range ends before it starts")
        object.__setattr__(self, "start", first)
        object.__setattr__(self, "end_exclusive", last + timedelta(days=1))


DateRange = PresetRange | CustomRange


@dataclass(frozen=True)
class UsePageRange:
    pass


@dataclass(frozen=True)
class FixedOverride:
    range: DateRange


@dataclass(frozen=True)
class NoDateRange:
    pass


DateRangeMode = UsePageRange | FixedOverride | NoDateRange


def _midnight(x: datetime) -> datetime:
    return datetime(x.year, x.month, x.day)


def resolve(range_: DateRange, today: datetime, earliest: datetime | None = None, week_start: int = 7, quarter_start: int = 1) -> Range:
    """The days of a range, seen from `today`."""
    if not 1 <= week_start <= 7 or not 1 <= quarter_start <= 12:
        raise ValueError("week_start is 1 to 7, quarter_start 1 to 12")
    if isinstance(range_, CustomRange):
        return Range(range_.start, range_.end_exclusive)
    today = _midnight(today)
    tomorrow, first = today + timedelta(days=1), today.replace(day=1)
    preset = range_.preset
    if preset in _LAST:
        return Range(tomorrow - timedelta(days=_LAST[preset]), tomorrow)
    if preset is Preset.thisWeek:
        return Range(today - timedelta(days=(today.isoweekday() - week_start) % 7), tomorrow)
    if preset is Preset.thisMonth:
        return Range(first, tomorrow)
    if preset is Preset.lastMonth:
        return Range((first - timedelta(days=1)).replace(day=1), first)
    if preset is Preset.quarterToDate:
        back = (today.month - quarter_start) % 3
        months = 12 * today.year + today.month - 1 - back
        return Range(datetime(months // 12, months % 12 + 1, 1), tomorrow)
    return Range(_midnight(earliest) if earliest else today - timedelta(days=365), tomorrow)


def resolve_mode(mode: DateRangeMode, page: DateRange | None, today: datetime, earliest: datetime | None = None, week_start: int = 7, quarter_start: int = 1) -> Range | None:
    if isinstance(mode, NoDateRange):
        return None
    chosen = mode.range if isinstance(mode, FixedOverride) else page
    if chosen is None:
        raise ValueError("the page has no range")
    return resolve(chosen, today, earliest, week_start, quarter_start)


def project(query: Q.Query, mode: DateRangeMode, sources: Sequence[SourceDef], page: DateRange | None, today: datetime, earliest: datetime | None = None, week_start: int = 7, quarter_start: int = 1) -> Ok | Err:
    """The query with two more filters that keep its source's primary date inside the range."""

    def work() -> Q.Query:
        found = resolve_mode(mode, page, today, earliest, week_start, quarter_start)
        if found is None:
            return query
        source = find_source(sources, query.source)
        if source is None:
            raise Failure(ErrorKind.unknownSource, f"no source {query.source}")
        if source.primary_date_field is None:
            raise Failure(ErrorKind.primaryDateFieldRequiredForOperation, f"{source.source_id} has no primary date")
        ref = source.primary_date_field.ref
        return query.with_filters(Q.Filter(ref, Q.Op.greaterThanOrEqual, date_time(found.start)), Q.Filter(ref, Q.Op.lessThan, date_time(found.end)))

    return attempt(work)
