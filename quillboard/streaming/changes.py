"""Change events that tell a host what to refresh."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum


class ChangeKind(str, Enum):
    dateRange = "dateRange"
    widgetSet = "widgetSet"
    widgetOrder = "widgetOrder"
    sourceData = "sourceData"
    restore = "restore"


@dataclass(frozen=True)
class AnalyticsChange:
    kind: ChangeKind
    widget_id: str | None = None
    source_ids: frozenset[str] | None = None  # None: all sources
