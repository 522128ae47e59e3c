"""Anchored time grains: bucket arithmetic in Python for axes, as column expressions for data.

A grain is `count` units from an anchor; dates are wall clocks without a zone. Day and coarser units
step on the calendar: month and year buckets start at the anchor's day of the month, counted from the
first of their month, so day 31 runs over into the next month where the month is shorter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta
from enum import Enum

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class TimeUnit(str, Enum):
    microsecond = "microsecond"
    millisecond = "millisecond"
    second = "second"
    minute = "minute"
    hour = "hour"
    day = "day"
    week = "week"
    month = "month"
    year = "year"


#: Microseconds of the units that are plain lengths of time.
MICROS = {TimeUnit.microsecond: 1, TimeUnit.millisecond: 1_000, TimeUnit.second: 1_000_000, TimeUnit.minute: 60_000_000, TimeUnit.hour: 3_600_000_000}
#: Days and months of the calendar units.
DAYS = {TimeUnit.day: 1, TimeUnit.week: 7}
MONTHS = {TimeUnit.month: 1, TimeUnit.year: 12}
_TICK = timedelta(microseconds=1)
_EPOCH = datetime(1970, 1, 1)


@dataclass(frozen=True)
class TimeGrain:
    count: int
    unit: TimeUnit
    anchor: datetime
    week_start: int | None = None  # 1 Monday to 7 Sunday; weeks only

    def __post_init__(self) -> None:
        if self.count <= 0:
            raise ValueError("count must be positive")
        if self.week_start is not None:
            if self.unit is not TimeUnit.week:
                raise ValueError("week_start needs the unit week")
            if not 1 <= self.week_start <= 7:
                raise ValueError("week_start is 1 to 7")

    @property
    def origin(self) -> datetime:
        """The anchor, moved forward to the week's first day where one is given."""
        if self.week_start is None:
            return self.anchor
        return self.anchor + timedelta(days=(self.week_start - self.anchor.isoweekday()) % 7)

    def start_of(self, instant: datetime) -> datetime:
        """Start of the bucket that holds the instant."""
        a = self.origin
        if self.unit in MICROS:
            step = self.count * MICROS[self.unit]
            passed = (instant - a) // _TICK
            return a + (passed - passed % step) * _TICK
        early = (instant - datetime(instant.year, instant.month, instant.day)) < (a - datetime(a.year, a.month, a.day))
        if self.unit in DAYS:
            step = self.count * DAYS[self.unit]
            days = (instant.date() - a.date()).days - early
            return a + timedelta(days=days - days % step)
        step = self.count * MONTHS[self.unit]
        months = 12 * (instant.year - a.year) + instant.month - a.month
        months -= instant.day < a.day or (instant.day == a.day and early)
        return self._months_on(a, months - months % step)

    def next_start(self, start: datetime) -> datetime:
        if self.unit in MICROS:
            return start + self.count * MICROS[self.unit] * _TICK
        if self.unit in DAYS:
            return start + timedelta(days=self.count * DAYS[self.unit])
        return self._months_on(start, self.count * MONTHS[self.unit])

    @staticmethod
    def _months_on(a: datetime, months: int) -> datetime:
        total = 12 * a.year + a.month - 1 + months
        first = a.replace(year=total // 12, month=total % 12 + 1, day=1)
        return first + timedelta(days=a.day - 1)

    def starts(self, start: datetime, end: datetime) -> Iterator[datetime]:
        """Bucket starts from the one that holds `start` up to, not including, `end`."""
        at = self.start_of(start)
        while at < end:
            yield at
            at = self.next_start(at)

    def axis(self, spark: SparkSession, start: datetime, end: datetime, key: str) -> tuple[DataFrame, int]:
        """The same starts as rows in one column, and how many there are.

        Only month and year buckets are listed on the driver (a few thousand at most); others are counted
        and generated on the executors.
        """
        first = self.start_of(start)
        span = max(timedelta(0), end - first)
        if self.unit in MONTHS:
            starts = list(self.starts(start, end))
            micros = F.from_json(F.lit(str([(s - _EPOCH) // _TICK for s in starts])), "array<bigint>")
            rows, n = spark.range(1).select(F.explode(micros).alias("m")), len(starts)
        else:
            step = self.count * (timedelta(days=DAYS[self.unit]) if self.unit in DAYS else MICROS[self.unit] * _TICK)
            n = -(-span // step)
            rows = spark.range(n).select((F.lit((first - _EPOCH) // _TICK) + F.col("id") * F.lit(step // _TICK)).alias("m"))
        return rows.select(F.timestamp_micros("m").cast("timestamp_ntz").alias(key)), n

    def column(self, ts: Column) -> Column:
        """Start of the bucket that holds each value of a zone-less timestamp column."""
        a = self.origin
        anchor = F.lit(a.isoformat(sep=" ")).cast("timestamp_ntz")
        if self.count == 1 and self._natural(a):
            return F.date_trunc(self.unit.value, ts).cast("timestamp_ntz")
        if self.unit in MICROS:
            start = (a - _EPOCH) // _TICK
            passed = F.unix_micros(ts.cast("timestamp")) - F.lit(start)
            return F.timestamp_micros(F.lit(start) + passed - F.pmod(passed, F.lit(self.count * MICROS[self.unit]))).cast("timestamp_ntz")
        day = datetime(a.year, a.month, a.day)
        clock = F.unix_micros(ts.cast("timestamp")) - F.unix_micros(F.date_trunc("day", ts).cast("timestamp"))
        early = clock < F.lit((a - day) // _TICK)
        if self.unit in DAYS:
            days = F.datediff(ts.cast("date"), F.lit(day.date())) - early.cast("int")
            return F.timestamp_add("DAY", days - F.pmod(days, F.lit(self.count * DAYS[self.unit])), anchor)
        months = (F.year(ts) - a.year) * 12 + F.month(ts) - a.month
        months = months - ((F.dayofmonth(ts) < a.day) | ((F.dayofmonth(ts) == a.day) & early)).cast("int")
        first = F.lit(a.replace(day=1).isoformat(sep=" ")).cast("timestamp_ntz")
        stepped = F.timestamp_add("MONTH", months - F.pmod(months, F.lit(self.count * MONTHS[self.unit])), first)
        return F.timestamp_add("DAY", F.lit(a.day - 1), stepped)

    def _natural(self, a: datetime) -> bool:
        """Whether date_trunc gives the same buckets."""
        midnight = a == datetime(a.year, a.month, a.day)
        return midnight and (self.unit is TimeUnit.day or (self.unit is TimeUnit.month and a.day == 1) or (self.unit is TimeUnit.year and a.day == 1 and a.month == 1))


_ANCHOR, _SUNDAY = datetime(2000, 1, 1), datetime(2000, 1, 2)
MICROSECOND = TimeGrain(1, TimeUnit.microsecond, _ANCHOR)
MILLISECOND = TimeGrain(1, TimeUnit.millisecond, _ANCHOR)
SECOND = TimeGrain(1, TimeUnit.second, _ANCHOR)
MINUTE = TimeGrain(1, TimeUnit.minute, _ANCHOR)
HOUR = TimeGrain(1, TimeUnit.hour, _ANCHOR)
DAY = TimeGrain(1, TimeUnit.day, _ANCHOR)
WEEK = TimeGrain(1, TimeUnit.week, _SUNDAY)
MONTH = TimeGrain(1, TimeUnit.month, _ANCHOR)
YEAR = TimeGrain(1, TimeUnit.year, _ANCHOR)
