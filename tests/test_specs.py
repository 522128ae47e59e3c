"""Validation, date ranges, codec and cache: no Spark job runs here."""

import json
import threading
from datetime import datetime, timedelta

import pytest

from quillboard import codec
from quillboard.errors import Err, ErrorKind, Ok
from quillboard.functions import dates
from quillboard.functions import grain as G
from quillboard.plans import spec as Q
from quillboard.plans.validate import validate_payload, validate_query
from quillboard.schema import FieldDef, FieldRef, FieldType, SourceDef, Value, boolean, date_time, double, duration, enum, enums, integer, integers, null, string, strings
from quillboard.sources.cache import SnapshotCache
from quillboard.sources.catalog import source
from quillboard.streaming.changes import AnalyticsChange, ChangeKind

T = FieldType
K = ErrorKind
TASKS = source("tasks", None, status=T.enumeration, priority=T.integer, title=T.string, cost=T.duration, done=T.boolean)
EVENTS = source("events", "at", at=T.dateTime, kind=T.enumeration, amount=T.integer, span=T.duration)
OTHER = source("other", "when", when=T.dateTime, x=T.integer)
CLOSED = SourceDef("closed", "closed", (FieldDef("f", "closed", "f", T.integer, False, False, False, False), FieldDef("at", "closed", "at", T.dateTime, True, False, False, False)))
SOURCES = (TASKS, EVENTS, OTHER, CLOSED)
COUNT = Q.Count()
DAY = Q.TimeGroupBy(EVENTS.ref("at"), G.DAY)
KIND = Q.FieldGroupBy(EVENTS.ref("kind"))
STREAK = Q.Streak(EVENTS.ref("kind"), EVENTS.ref("at"), EVENTS.ref("kind"), "done")


def field(src, name, agg=Q.SUM, label=None):
    return Q.FieldMeasure(src.ref(name), agg, label=label)


def q(*measures, src="events", **how):
    return Q.Query(src, measures or (COUNT,), **how)


def nested(depth):
    at = COUNT
    for _ in range(depth):
        at = Q.Transformed(at, Q.ScalarOp(Q.Scalar.negate))
    return at


def flt(ref, op, value):
    return q(filters=(Q.Filter(ref, op, value),), src=ref.source_id)


BAD = [
    (q(src="nowhere"), K.unknownSource),
    (Q.Query("events", ()), K.measuresEmpty),
    (q(*[Q.Count(label=str(i)) for i in range(6)]), K.tooManyMeasures),
    (q(nested(9)), K.preconditionViolation),
    (q(field(TASKS, "priority")), K.unknownField),
    (q(Q.FieldMeasure(FieldRef("events", "none"), Q.SUM)), K.unknownField),
    (q(field(CLOSED, "f"), src="closed"), K.fieldNotAggregatable),
    (q(field(EVENTS, "kind")), K.incompatibleAggregation),
    (q(field(EVENTS, "kind", Q.MIN)), K.incompatibleAggregation),
    (q(field(EVENTS, "at", Q.AVERAGE)), K.incompatibleAggregation),
    (q(field(EVENTS, "amount", Q.percentile(1.5))), K.invalidAggregationParameter),
    (q(field(EVENTS, "amount", Q.percentile(float("nan")))), K.invalidAggregationParameter),
    (q(STREAK, COUNT), K.streakNotCombinable),
    (q(Q.Transformed(STREAK, Q.ScalarOp(Q.Scalar.abs))), K.streakNotCombinable),
    (q(Q.Transformed(field(EVENTS, "at", Q.MIN), Q.ScalarOp(Q.Scalar.abs))), K.incompatibleSeriesCombination),
    (q(Q.Calculated(field(EVENTS, "span"), COUNT, Q.Combination.sum)), K.incompatibleSeriesCombination),
    (q(Q.Count(label="x"), field(EVENTS, "amount", label="x")), K.duplicateMeasureLabel),
    (q(Q.Count(label="measure_1"), field(EVENTS, "amount")), K.duplicateMeasureLabel),
    (q(STREAK, sort=Q.Sort(Q.ByMeasure())), K.preconditionViolation),
    (q(STREAK, limit=3), K.preconditionViolation),
    (q(STREAK, having=Q.Having(Q.Op.equals, integer(1))), K.preconditionViolation),
    (q(Q.Streak(EVENTS.ref("kind"), EVENTS.ref("kind"), EVENTS.ref("kind"), "d")), K.timeGrainOnNonDateField),
    (q(Q.Streak(EVENTS.ref("kind"), EVENTS.ref("at"), EVENTS.ref("amount"), "d")), K.preconditionViolation),
    (q(Q.Streak(EVENTS.ref("kind"), EVENTS.ref("at"), EVENTS.ref("kind"), "d", EVENTS.ref("kind"))), K.preconditionViolation),
    (q(Q.Streak(EVENTS.ref("kind"), EVENTS.ref("at"), EVENTS.ref("kind"), "d", top_n=-1)), K.preconditionViolation),
    (flt(CLOSED.ref("f"), Q.Op.equals, integer(1)), K.fieldNotFilterable),
    (flt(EVENTS.ref("kind"), Q.Op.lessThan, enum("a")), K.incompatibleOperator),
    (flt(EVENTS.ref("amount"), Q.Op.equals, double(1.0)), K.incompatibleOperator),
    (flt(EVENTS.ref("kind"), Q.Op.equals, string("a")), K.incompatibleOperator),
    (flt(EVENTS.ref("amount"), Q.Op.inList, integer(1)), K.incompatibleOperator),
    (flt(EVENTS.ref("amount"), Q.Op.inList, strings(["a"])), K.incompatibleOperator),
    (flt(EVENTS.ref("amount"), Q.Op.equals, integers([1])), K.incompatibleOperator),
    (flt(EVENTS.ref("span"), Q.Op.inList, integers([1])), K.incompatibleOperator),
    (flt(EVENTS.ref("amount"), Q.Op.lessThan, null(T.integer)), K.incompatibleOperator),
    (q(src="tasks", group_bys=[Q.FieldGroupBy(TASKS.ref(f)) for f in ("status", "priority", "title", "done")]), K.tooManyGroupBys),
    (q(group_bys=(DAY, Q.TimeGroupBy(EVENTS.ref("at"), G.MONTH))), K.multipleTemporalGroupBys),
    (q(STREAK, group_bys=(KIND,)), K.streakWithExplicitGrouping),
    (q(src="closed", group_bys=(Q.FieldGroupBy(CLOSED.ref("f")),)), K.fieldNotGroupable),
    (q(group_bys=(Q.FieldGroupBy(EVENTS.ref("at")),)), K.preconditionViolation),
    (q(group_bys=(Q.TimeGroupBy(EVENTS.ref("kind"), G.DAY),)), K.timeGrainOnNonDateField),
    (q(group_bys=(KIND, Q.FieldGroupBy(EVENTS.ref("kind"), "again"))), K.preconditionViolation),
    (q(Q.Count(label="kind"), group_bys=(KIND,)), K.duplicateColumnLabel),
    (q(derived=Q.DELTA), K.preconditionViolation),
    (q(COUNT, field(EVENTS, "amount"), group_bys=(DAY,), derived=Q.DELTA), K.preconditionViolation),
    (q(group_bys=(DAY,), derived=Q.moving_average(0)), K.invalidDerivedOperationParameter),
    (q(field(EVENTS, "at", Q.MAX), group_bys=(KIND,), derived=Q.DELTA), K.derivedOpRequiresNumericMeasure),
    (q(sort=Q.Sort(Q.ByMeasure())), K.incompatibleSortTarget),
    (q(group_bys=(DAY,), sort=Q.Sort(Q.ByGroup(EVENTS.ref("kind")))), K.incompatibleSortTarget),
    (q(group_bys=(DAY,), sort=Q.Sort(Q.ByGroup(TASKS.ref("status")))), K.incompatibleSortTarget),
    (q(COUNT, field(EVENTS, "amount"), group_bys=(DAY,), sort=Q.Sort(Q.ByMeasure())), K.preconditionViolation),
    (q(group_bys=(DAY,), sort=Q.Sort(Q.ByMeasure("nope"))), K.unknownMeasureLabel),
    (q(having=Q.Having(Q.Op.equals, integer(1))), K.havingRequiresGrouping),
    (q(COUNT, field(EVENTS, "amount"), group_bys=(DAY,), having=Q.Having(Q.Op.equals, integer(1))), K.preconditionViolation),
    (q(group_bys=(DAY,), having=Q.Having(Q.Op.equals, integer(1), "nope")), K.unknownMeasureLabel),
    (q(group_bys=(DAY,), having=Q.Having(Q.Op.equals, null(T.integer))), K.incompatibleOperator),
    (q(group_bys=(DAY,), having=Q.Having(Q.Op.equals, double(1.0))), K.incompatibleOperator),
    (q(group_bys=(DAY,), limit=-1), K.preconditionViolation),
]


@pytest.mark.parametrize(("query", "kind"), BAD, ids=lambda x: x.value if isinstance(x, K) else "")
def test_first_violation(query, kind):
    assert validate_query(query, SOURCES).error.kind is kind


@pytest.mark.parametrize(
    "query",
    [q(), q(STREAK), q(group_bys=(DAY, KIND), limit=0), q(nested(8)), flt(EVENTS.ref("amount"), Q.Op.equals, null(T.integer)), q(src="closed", group_bys=(Q.TimeGroupBy(CLOSED.ref("at"), G.DAY),)), q(group_bys=(DAY,), having=Q.Having(Q.Op.equals, integers([1])))],
)
def test_valid(query):
    assert validate_query(query, SOURCES).is_ok


def test_order_of_violations():
    query = q(field(EVENTS, "kind"), src="events", filters=(Q.Filter(EVENTS.ref("none"), Q.Op.equals, integer(1)),), limit=-1)
    assert validate_query(query, SOURCES).error.kind is K.incompatibleAggregation


def test_payload_rules():
    ranged, none = dates.FixedOverride(dates.PresetRange(dates.Preset.allTime)), dates.NoDateRange()
    daily = q(group_bys=(DAY,))
    kind = lambda p, mode=ranged: validate_payload(p, SOURCES, mode).err_or_none and validate_payload(p, SOURCES, mode).error.kind
    assert kind(Q.Single(daily)) is None
    assert kind(Q.Single(daily), none) is K.dateRangeRequiredForMeasure
    assert kind(Q.Single(q(STREAK))) is K.dateRangeNotSupportedForMeasure
    assert kind(Q.Paired(daily, q())) is K.incompatiblePairedQueryShapes
    assert kind(Q.Paired(daily, q(group_bys=(KIND,)))) is K.incompatiblePairedQueryShapes
    other = q(src="other", group_bys=(Q.TimeGroupBy(OTHER.ref("when"), G.DAY),))
    assert kind(Q.Paired(daily, other)) is None
    assert kind(Q.Paired(daily, q(src="other", group_bys=(Q.TimeGroupBy(OTHER.ref("when"), G.WEEK),)))) is K.incompatiblePairedQueryShapes
    assert kind(Q.Paired(daily, q(src="closed", group_bys=(Q.TimeGroupBy(CLOSED.ref("at"), G.DAY),)))) is K.primaryDateFieldRequiredForOperation
    assert kind(Q.Paired(q(group_bys=(Q.TimeGroupBy(EVENTS.ref("at"), G.DAY, "a"),)), daily)) is None  # labels do not count


def test_shapes():
    two = (COUNT, field(EVENTS, "amount"))
    shapes = [Q.shape_of(x) for x in (q(), q(*two), q(group_bys=(DAY,)), q(*two, group_bys=(DAY,)), q(group_bys=(DAY, KIND)), q(*two, group_bys=(DAY, KIND)), q(STREAK), Q.Paired(q(), q()))]
    S = Q.Shape
    assert shapes == [S.scalar, S.table, S.series, S.multiMeasureSeries, S.multiSeries, S.table, S.table, S.pairedSeries]


def test_source_and_value_construction():
    with pytest.raises(ValueError):
        SourceDef("a", "a", (FieldDef("f", "b", "f", T.integer),))
    with pytest.raises(ValueError):
        SourceDef("a", "a", (FieldDef("f", "a", "f", T.integer), FieldDef("f", "a", "f", T.double)))
    with pytest.raises(ValueError):
        SourceDef("a", "a", (FieldDef("f", "a", "f", T.integer),), "f")
    for make in (lambda: integer(True), lambda: Value(T.string, 1), lambda: Value(T.double, ["x"], True), lambda: Value(T.double, 1)):
        with pytest.raises(TypeError):
            make()
    assert enum("x") != string("x")


TODAY = datetime(2026, 5, 15, 13)


@pytest.mark.parametrize(
    ("preset", "start", "end"),
    [
        ("last7Days", (2026, 5, 9), (2026, 5, 16)),
        ("last30Days", (2026, 4, 16), (2026, 5, 16)),
        ("thisMonth", (2026, 5, 1), (2026, 5, 16)),
        ("lastMonth", (2026, 4, 1), (2026, 5, 1)),
        ("quarterToDate", (2026, 4, 1), (2026, 5, 16)),
        ("thisWeek", (2026, 5, 10), (2026, 5, 16)),
        ("allTime", (2025, 5, 15), (2026, 5, 16)),
    ],
)
def test_presets(preset, start, end):
    assert dates.resolve(dates.PresetRange(dates.Preset(preset)), TODAY) == dates.Range(datetime(*start), datetime(*end))


def test_ranges_and_modes():
    week = dates.PresetRange(dates.Preset.thisWeek)
    assert dates.resolve(week, TODAY, week_start=1).start == datetime(2026, 5, 11)
    assert dates.resolve(dates.PresetRange(dates.Preset.allTime), TODAY, datetime(2020, 1, 1, 14, 30)).start == datetime(2020, 1, 1)
    assert dates.resolve(dates.PresetRange(dates.Preset.quarterToDate), TODAY, quarter_start=2).start == datetime(2026, 5, 1)
    custom = dates.CustomRange(datetime(2026, 1, 1, 5), datetime(2026, 1, 31))
    assert dates.resolve(custom, TODAY) == dates.Range(datetime(2026, 1, 1), datetime(2026, 2, 1))
    with pytest.raises(ValueError):
        dates.CustomRange(datetime(2026, 1, 2), datetime(2026, 1, 1))
    with pytest.raises(ValueError):
        dates.resolve_mode(dates.UsePageRange(), None, TODAY)
    assert dates.resolve_mode(dates.NoDateRange(), custom, TODAY) is None


def test_projection():
    found = dates.project(q(), dates.UsePageRange(), SOURCES, dates.PresetRange(dates.Preset.last7Days), TODAY).value
    assert [(f.field, f.op, f.value) for f in found.filters] == [(EVENTS.ref("at"), Q.Op.greaterThanOrEqual, date_time(datetime(2026, 5, 9))), (EVENTS.ref("at"), Q.Op.lessThan, date_time(datetime(2026, 5, 16)))]
    page = dates.PresetRange(dates.Preset.allTime)
    assert dates.project(q(src="tasks"), dates.UsePageRange(), SOURCES, page, TODAY).error.kind is K.primaryDateFieldRequiredForOperation
    assert dates.project(q(src="no"), dates.UsePageRange(), SOURCES, page, TODAY).error.kind is K.unknownSource
    assert dates.project(q(), dates.NoDateRange(), SOURCES, page, TODAY) == Ok(q())


FULL = Q.Query(
    "events",
    (
        Q.Count(label="n"),
        field(EVENTS, "amount", Q.percentile(0.5)),
        Q.Calculated(Q.Transformed(COUNT, Q.ScalarOp(Q.Scalar.fillNull, 1.5)), Q.Transformed(COUNT, Q.ScalarOp(Q.Scalar.negate)), Q.Combination.ratio, label="r"),
    ),
    tuple(Q.Filter(EVENTS.ref("amount"), Q.Op.equals, v) for v in (integer(1), double(1.5), string("s"), enum("e"), boolean(True), date_time(datetime(2026, 1, 1, 1, 2, 3, 4)), duration(timedelta(microseconds=7)), strings(["a"]), enums(["b"]), integers([1, 2]), null(T.duration))),
    (Q.TimeGroupBy(EVENTS.ref("at"), G.TimeGrain(2, G.TimeUnit.week, datetime(2026, 1, 1), 1), "week"), KIND),
    Q.Having(Q.Op.greaterThan, integer(3), "n"),
    Q.Sort(Q.ByMeasure("n"), Q.Direction.descending, True),
    5,
)


@pytest.mark.parametrize(
    "payload",
    [
        Q.Single(FULL),
        Q.Single(q(Q.Streak(EVENTS.ref("kind"), EVENTS.ref("at"), EVENTS.ref("kind"), "d", EVENTS.ref("kind"), 3))),
        Q.Single(q(STREAK)),
        Q.Paired(q(group_bys=(DAY,), derived=Q.moving_average(7)), q(group_bys=(DAY,), sort=Q.Sort(Q.ByGroup(EVENTS.ref("at"))))),
    ],
)
def test_codec_round_trip(payload):
    text = codec.encode_payload(payload)
    assert codec.decode_payload(text) == payload
    assert codec.encode_payload(codec.decode_payload(text)) == text


def test_codec_omits_what_is_not_set():
    data = json.loads(codec.encode_payload(Q.Single(q())))["query"]
    assert sorted(data) == ["derivedOperation", "filters", "groupBys", "measures", "source"]
    assert data["measures"] == [{"kind": "count"}]


@pytest.mark.parametrize(
    "text",
    ["", "[]", "{}", '{"kind": "single"}', '{"kind": "x"}', '{"kind": "single", "query": {"source": 1}}', '{"kind": "single", "query": {"source": "a", "measures": [1]}}', '{"kind": "single", "query": {"source": "a", "limit": "x"}}', '{"kind": "single", "query": {"source": "a", "limit": true}}', '{"kind": "single", "query": {"source": "a", "measures": [{"kind": "field"}]}}'],
)
def test_codec_rejects(text):
    with pytest.raises(codec.FormatError):
        codec.decode_payload(text)


def test_codec_rejects_what_constructors_reject():
    broken = json.loads(codec.encode_payload(Q.Single(q(group_bys=(DAY,)))))
    broken["query"]["groupBys"][0]["grain"]["count"] = 0
    with pytest.raises(codec.FormatError):
        codec.decode_payload(json.dumps(broken))
    for text in ('{"kind": "preset", "preset": "custom"}', '{"kind": "custom", "start": "2026-01-02", "end": "2026-01-01"}'):
        with pytest.raises(codec.FormatError):
            codec.decode_range(text)


def test_codec_ranges_modes_display_and_version():
    custom = dates.CustomRange(datetime(2026, 1, 1), datetime(2026, 1, 31))
    assert json.loads(codec.encode_range(custom))["end"].startswith("2026-01-31")
    for r in (custom, dates.PresetRange(dates.Preset.allTime)):
        assert codec.decode_range(codec.encode_range(r)) == r
        assert codec.decode_mode(codec.encode_mode(dates.FixedOverride(r))) == dates.FixedOverride(r)
    for mode in (dates.UsePageRange(), dates.NoDateRange()):
        assert codec.decode_mode(codec.encode_mode(mode)) == mode
    assert codec.decode_display(codec.encode_display(codec.DisplaySpec("bar"))) == codec.DisplaySpec("bar")
    codec.ensure_can_decode(1)
    with pytest.raises(codec.FormatError):
        codec.ensure_can_decode(2)


def test_widgets_are_equal_by_id():
    at = datetime(2026, 1, 1)
    w = codec.WidgetSpec("1", "t", "{}", "{}", "{}", 0, at, at)
    assert w == w.copy_with(title="u") and w != w.copy_with(id="2") and len({w, w.copy_with(title="u")}) == 1


def test_results_of_checks():
    assert Ok(1).and_then(lambda x: Ok(x + 1)) == Ok(2) and Ok(1).ok_or_none == 1 and Ok(1).err_or_none is None
    found = validate_query(q(src="no"), SOURCES)
    assert isinstance(found, Err) and found.and_then(lambda x: Ok(x)) is found and found.ok_or_none is None
    assert AnalyticsChange(ChangeKind.sourceData, source_ids=frozenset({"a"})) == AnalyticsChange(ChangeKind.sourceData, None, frozenset({"a"}))


class Frame:
    def __init__(self):
        self.held = None

    def persist(self):
        self.held = True
        return self

    def unpersist(self):
        self.held = False


def test_cache_keys_and_invalidation():
    calls = []

    def fetch(source_id, bound):
        calls.append((source_id, bound))
        return Frame()

    cache = SnapshotCache(fetch)
    day = dates.Range(datetime(2026, 1, 1, 5), datetime(2026, 1, 2, 7))
    same = dates.Range(datetime(2026, 1, 1), datetime(2026, 1, 2))
    a = cache.get("x", day)
    assert cache.get("x", same) is a and a.held and len(calls) == 1
    b = cache.get("y")
    cache.invalidate(["x"])
    assert not a.held and cache.get("y") is b and cache.get("x", day) is not a
    cache.clear()
    assert len(cache) == 0 and not b.held


def test_cache_shares_flights_and_forgets_failures():
    gate, started, calls = threading.Event(), threading.Event(), []

    def fetch(source_id, bound):
        calls.append(source_id)
        started.set()
        gate.wait(5)
        if source_id == "bad":
            raise RuntimeError("no")
        return Frame()

    cache = SnapshotCache(fetch)
    got = []
    threads = [threading.Thread(target=lambda: got.append(cache.get("x"))) for _ in range(3)]
    for t in threads:
        t.start()
    started.wait(5)
    cache.invalidate(["x"])  # the flight's callers still get its frame; it is not kept
    gate.set()
    for t in threads:
        t.join()
    assert len(got) == 3 and len(cache) == 0
    for _ in range(2):
        with pytest.raises(RuntimeError):
            cache.get("bad")
    assert calls.count("bad") == 2
