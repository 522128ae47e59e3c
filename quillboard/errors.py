"""Typed failures and a small result type."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from enum import Enum
from typing import Any


class ErrorKind(str, Enum):
    # fixed values: the closed set of error names
    unknownSource = "unknownSource"
    unknownField = "unknownField"
    unknownMeasureLabel = "unknownMeasureLabel"
    fieldNotGroupable = "fieldNotGroupable"
    fieldNotFilterable = "fieldNotFilterable"
    fieldNotAggregatable = "fieldNotAggregatable"
    incompatibleAggregation = "incompatibleAggregation"
    incompatibleSeriesCombination = "incompatibleSeriesCombination"
    incompatibleOperator = "incompatibleOperator"
    timeGrainOnNonDateField = "timeGrainOnNonDateField"
    streakWithExplicitGrouping = "streakWithExplicitGrouping"
    measuresEmpty = "measuresEmpty"
    tooManyMeasures = "tooManyMeasures"
    duplicateMeasureLabel = "duplicateMeasureLabel"
    duplicateColumnLabel = "duplicateColumnLabel"
    streakNotCombinable = "streakNotCombinable"
    dateRangeNotSupportedForMeasure = "dateRangeNotSupportedForMeasure"
    dateRangeRequiredForMeasure = "dateRangeRequiredForMeasure"
    invalidDerivedOperationParameter = "invalidDerivedOperationParameter"
    invalidAggregationParameter = "invalidAggregationParameter"
    incompatiblePairedQueryShapes = "incompatiblePairedQueryShapes"
    incompatibleSortTarget = "incompatibleSortTarget"
    tooManyGroupBys = "tooManyGroupBys"
    multipleTemporalGroupBys = "multipleTemporalGroupBys"
    havingRequiresGrouping = "havingRequiresGrouping"
    derivedOpRequiresNumericMeasure = "derivedOpRequiresNumericMeasure"
    primaryDateFieldRequiredForOperation = "primaryDateFieldRequiredForOperation"
    preconditionViolation = "preconditionViolation"
    sourceRecordTypeMismatch = "sourceRecordTypeMismatch"
    unexpected = "unexpected"


@dataclass(frozen=True)
class AnalyticsError:
    kind: ErrorKind
    message: str
    field: Any = None  # the field reference that is at fault, if one is


class Failure(Exception):
    """Carries an AnalyticsError out of nested checks; never leaves the public functions."""

    def __init__(self, kind: ErrorKind, message: str, field: Any = None):
        super().__init__(message)
        self.error = AnalyticsError(kind, message, field)


@dataclass(frozen=True)
class Ok:
    value: Any = None
    is_ok, is_err = True, False

    def and_then(self, f: Callable[[Any], Any]) -> Any:
        return f(self.value)

    @property
    def ok_or_none(self) -> Any:
        return self.value

    @property
    def err_or_none(self) -> None:
        return None


@dataclass(frozen=True)
class Err:
    error: AnalyticsError
    is_ok, is_err = False, True

    def and_then(self, f: Callable[[Any], Any]) -> Err:
        return self

    @property
    def ok_or_none(self) -> None:
        return None

    @property
    def err_or_none(self) -> AnalyticsError:
        return self.error


def attempt(f: Callable[[], Any]) -> Ok | Err:
    """Ok of what f returns, or Err of the Failure that it raises."""
    try:
        return Ok(f())
    except Failure as failure:
        return Err(failure.error)
