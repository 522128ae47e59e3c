"""Small executions with hand-computed results."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillboard.errors import ErrorKind
from quillboard.functions import dates
from quillboard.functions import grain as G
from quillboard.operators import algebra
from quillboard.plans import spec as Q
from quillboard.plans.compile import execute
from quillboard.schema import FieldType, Value, date_time, enum, integer, null
from quillboard.sources.catalog import source

T = FieldType
TASKS = source("tasks", None, status=T.enumeration, priority=T.integer, title=T.string)
EVENTS = source("events", "at", at=T.dateTime, kind=T.enumeration, amount=T.integer)
MIXED = source("mixed", None, i=T.integer, d=T.double, dur=T.duration, dt=T.dateTime)
FINANCE = source("finance", "month", month=T.dateTime, region=T.enumeration, revenue=T.integer, cost=T.integer, a=T.duration, b=T.duration)
HABITS = source("habits", None, habit=T.string, day=T.dateTime, status=T.enumeration, label=T.string)
SOURCES = (TASKS, EVENTS, MIXED, FINANCE, HABITS)


def may(d, h=0):
    return datetime(2026, 5, d, h)


def day_range(a, b):
    return dates.Range(may(a), may(b))


@pytest.fixture
def run(spark):
    def go(query, rows, schema, **how):
        found = execute(query, spark.createDataFrame(rows, schema), SOURCES, **how)
        assert found.is_ok, found
        return found.value

    return go


def rows_of(result):
    return [tuple(r) for r in result.df.collect()]


TASK_SCHEMA = "status string, priority bigint, title string"
EVENT_SCHEMA = "at timestamp_ntz, kind string, amount bigint"
FINANCE_SCHEMA = "month timestamp_ntz, region string, revenue bigint, cost bigint, a bigint, b bigint"
MONEY = [(may(1), "north", 100, 60, 900, 300), (may(1), "north", 20, 10, 0, 0), (may(2), "south", 50, 70, 100, 460)]


def m(src, field, agg, label=None):
    return Q.FieldMeasure(src.ref(field), agg, label=label)


def by(src, *fields):
    return tuple(Q.FieldGroupBy(src.ref(f)) for f in fields)


def test_aggregations_keep_types_and_skip_nulls(run):
    rows = [(1, 1.5, 100, may(1)), (2, 2.5, 200, may(2)), (3, 3.5, 300, may(3)), (None, None, None, None)]
    schema = "i bigint, d double, dur bigint, dt timestamp_ntz"
    q = Q.Query("mixed", (m(MIXED, "i", Q.AVERAGE), m(MIXED, "dur", Q.AVERAGE), m(MIXED, "dt", Q.MIN), m(MIXED, "dt", Q.MAX), m(MIXED, "i", Q.percentile(0.5))))
    assert rows_of(run(q, rows, schema)) == [(2.0, 200, may(1), may(3), 2.0)]
    q = Q.Query("mixed", (Q.Count(), m(MIXED, "i", Q.SUM), m(MIXED, "d", Q.MIN), m(MIXED, "d", Q.MAX), m(MIXED, "i", Q.DISTINCT)))
    assert rows_of(run(q, rows, schema)) == [(4, 6, 1.5, 3.5, 3)]
    assert rows_of(run(q, [], schema)) == [(0, 0, None, None, 0)]


def test_percentile_interpolates(run):
    q = Q.Query("mixed", (m(MIXED, "i", Q.percentile(0.25)),))
    assert rows_of(run(q, [(x, None, None, None) for x in (1, 2, 3, 4)], "i bigint, d double, dur bigint, dt timestamp_ntz")) == [(1.75,)]


def test_duration_average_truncates_towards_zero(run):
    q = Q.Query("mixed", (m(MIXED, "dur", Q.AVERAGE),))
    assert rows_of(run(q, [(None, None, x, None) for x in (-3, -4)], "i bigint, d double, dur bigint, dt timestamp_ntz")) == [(-3,)]


@pytest.mark.parametrize(
    ("op", "value", "n"),
    [
        (Q.Op.equals, integer(5), 1),
        (Q.Op.notEquals, integer(5), 3),  # null rows stay
        (Q.Op.equals, null(T.integer), 2),
        (Q.Op.notEquals, null(T.integer), 2),
        (Q.Op.lessThan, integer(6), 1),
        (Q.Op.greaterThanOrEqual, integer(5), 2),
        (Q.Op.inList, Value(T.integer, [5, 7], True), 2),
        (Q.Op.inList, Value(T.integer, [], True), 0),
    ],
)
def test_filters(run, op, value, n):
    q = Q.Query("tasks", (Q.Count(),), (Q.Filter(TASKS.ref("priority"), op, value),))
    assert rows_of(run(q, [("todo", 5, "a"), ("done", 7, "b"), ("done", None, "c"), ("x", None, "d")], TASK_SCHEMA)) == [(n,)]


def test_undeclared_columns_are_ignored_and_missing_ones_null(run):
    q = Q.Query("tasks", (Q.Count(), m(TASKS, "priority", Q.SUM)), group_bys=by(TASKS, "status"))
    assert rows_of(run(q, [("todo", [1])], "status string, more array<int>")) == [("todo", 1, 0, False)]


def test_wrong_column_type_is_an_error(spark):
    found = execute(Q.Query("tasks", (Q.Count(),)), spark.createDataFrame([("a", 1.5)], "status string, priority double"), SOURCES)
    assert found.error.kind is ErrorKind.sourceRecordTypeMismatch and found.error.field == TASKS.ref("priority")


def test_grid_has_synthetic_cells(run):
    q = Q.Query("tasks", (Q.Count(), m(TASKS, "priority", Q.AVERAGE)), group_bys=by(TASKS, "status", "title"))
    got = rows_of(run(q, [("A", 1, "X"), ("B", 3, None)], TASK_SCHEMA))
    assert got == [("A", "X", 1, 1.0, False), ("A", None, 0, None, True), ("B", "X", 0, None, True), ("B", None, 1, 3.0, False)]
    assert len(rows_of(run(q, [("A", 1, "X"), ("B", 3, None)], TASK_SCHEMA, densify=False))) == 2


def test_time_axis_is_replaced_by_the_range(run):
    q = Q.Query("events", (Q.Count(), m(EVENTS, "amount", Q.SUM)), group_bys=(Q.TimeGroupBy(EVENTS.ref("at"), G.DAY),))
    data = [(may(1, 5), "a", 10), (may(5), "a", 7), (may(9), "a", 1), (None, "a", 2)]
    got = rows_of(run(q, data, EVENT_SCHEMA, date_range=day_range(1, 6)))
    assert got == [(may(1), 1, 10, False), (may(2), 0, 0, True), (may(3), 0, 0, True), (may(4), 0, 0, True), (may(5), 1, 7, False), (None, 1, 2, False)]
    assert [r[3] for r in rows_of(run(q, [], EVENT_SCHEMA, date_range=day_range(1, 3)))] == [True, True]


def test_two_dimensional_time_grid_of_nothing_is_empty(run):
    q = Q.Query("events", (Q.Count(),), group_bys=(Q.TimeGroupBy(EVENTS.ref("at"), G.DAY), *by(EVENTS, "kind")))
    assert rows_of(run(q, [], EVENT_SCHEMA, date_range=day_range(1, 3))) == []


def test_range_may_start_inside_a_bucket(run):
    grain = G.TimeGrain(3, G.TimeUnit.day, may(1))
    q = Q.Query("events", (Q.Count(),), group_bys=(Q.TimeGroupBy(EVENTS.ref("at"), grain),))
    assert [r[0] for r in rows_of(run(q, [], EVENT_SCHEMA, date_range=day_range(2, 5)))] == [may(1), may(4)]


def test_having_works_on_the_grid_and_before_the_limit(run):
    time = (Q.TimeGroupBy(EVENTS.ref("at"), G.DAY),)
    q = Q.Query("events", (m(EVENTS, "amount", Q.SUM),), group_bys=time, having=Q.Having(Q.Op.greaterThan, integer(0)), limit=1, sort=Q.Sort(Q.ByMeasure()))
    assert rows_of(run(q, [(may(1), "a", 10), (may(5), "a", 7)], EVENT_SCHEMA, date_range=day_range(1, 7))) == [(may(5), 7, False)]


@pytest.mark.parametrize(("direction", "force", "expected"), [(Q.Direction.ascending, False, [5, 10, None]), (Q.Direction.descending, False, [None, 10, 5]), (Q.Direction.descending, True, [10, 5, None])])
def test_sort_nulls(run, direction, force, expected):
    q = Q.Query("events", (m(EVENTS, "amount", Q.MAX),), group_bys=(Q.TimeGroupBy(EVENTS.ref("at"), G.DAY),), sort=Q.Sort(Q.ByMeasure(), direction, force))
    got = rows_of(run(q, [(may(1), "a", 10), (may(3), "a", 5)], EVENT_SCHEMA, date_range=day_range(1, 4)))
    assert [r[1] for r in got] == expected


def test_derived_operations_follow_the_final_order(run):
    data = [(may(1), "a", 10), (may(3), "a", 4)]
    base = Q.Query("events", (m(EVENTS, "amount", Q.MAX),), group_bys=(Q.TimeGroupBy(EVENTS.ref("at"), G.DAY),))
    for op, expected in ((Q.CUMULATIVE_SUM, [10, 10, 14]), (Q.DELTA, [0, -10, 4]), (Q.moving_average(2), [10.0, 5.0, 2.0])):
        result = run(Q.Query(**{**vars(base), "derived": op}), data, EVENT_SCHEMA, date_range=day_range(1, 4))
        assert [r[1] for r in rows_of(result)] == expected
        assert [r[2] for r in rows_of(result)] == [False, True, False]
    sort = Q.Sort(Q.ByMeasure(), Q.Direction.descending, True)
    result = run(Q.Query(**{**vars(base), "derived": Q.CUMULATIVE_SUM, "sort": sort, "limit": 2}), [(may(1), "a", 4), (may(2), "a", 10), (may(3), "a", 1)], EVENT_SCHEMA)
    assert rows_of(result) == [(may(2), 10, False), (may(1), 14, False)]


def test_derived_operation_over_nulls_only_stays_null(run):
    q = Q.Query("events", (m(EVENTS, "amount", Q.AVERAGE),), group_bys=(Q.TimeGroupBy(EVENTS.ref("at"), G.DAY),), derived=Q.CUMULATIVE_SUM)
    assert [r[1] for r in rows_of(run(q, [], EVENT_SCHEMA, date_range=day_range(1, 3)))] == [None, None]


def test_expressions(run):
    rev, cost = m(FINANCE, "revenue", Q.SUM), m(FINANCE, "cost", Q.SUM)
    C = Q.Combination
    diff = Q.Calculated(rev, cost, C.difference, label="diff")
    measures = (diff, Q.Calculated(rev, cost, C.product, label="prod"), Q.Calculated(rev, cost, C.ratio, label="ratio"), Q.Calculated(diff, rev, C.ratio, label="nested"), Q.Transformed(diff, Q.ScalarOp(Q.Scalar.abs), label="abs"))
    got = rows_of(run(Q.Query("finance", measures, group_bys=by(FINANCE, "region")), MONEY, FINANCE_SCHEMA))
    assert got == [("north", 50, 8400.0, 120 / 70, 50 / 120, 50, False), ("south", -20, 3500.0, 50 / 70, -0.4, 20, False)]
    spans = Q.Calculated(m(FINANCE, "a", Q.SUM), m(FINANCE, "b", Q.SUM), C.difference)
    result = run(Q.Query("finance", (spans,), group_bys=by(FINANCE, "region")), MONEY, FINANCE_SCHEMA)
    assert rows_of(result) == [("north", 600, False), ("south", -360, False)]
    assert result.columns[1].field_type is T.duration


def test_ratio_by_zero_is_null(run):
    q = Q.Query("finance", (Q.Calculated(m(FINANCE, "revenue", Q.SUM), m(FINANCE, "cost", Q.SUM), Q.Combination.ratio),))
    assert rows_of(run(q, [(may(1), "west", 5, 0, 0, 0)], FINANCE_SCHEMA)) == [(None,)]


def test_expression_on_a_synthetic_day_sees_no_rows(run):
    diff = Q.Calculated(m(FINANCE, "revenue", Q.SUM), m(FINANCE, "cost", Q.SUM), Q.Combination.difference)
    fill = Q.Transformed(m(FINANCE, "revenue", Q.AVERAGE), Q.ScalarOp(Q.Scalar.fillNull, 2.5), label="f")
    q = Q.Query("finance", (diff, fill), group_bys=(Q.TimeGroupBy(FINANCE.ref("month"), G.DAY),))
    data = [(may(1), "n", 100, 60, 0, 0), (may(3), "s", 50, 70, 0, 0)]
    assert rows_of(run(q, data, FINANCE_SCHEMA, date_range=day_range(1, 4))) == [(may(1), 40, 100.0, False), (may(2), 0, 2.5, True), (may(3), -20, 50.0, False)]


def habits(entity, done, missed, label=None):
    return [(entity, may(d, 9), "done", label) for d in done] + [(entity, may(d), "missed", label) for d in missed]


HABIT_SCHEMA = "habit string, day timestamp_ntz, status string, label string"


def streak(**how):
    return Q.Query("habits", (Q.Streak(HABITS.ref("habit"), HABITS.ref("day"), HABITS.ref("status"), "done", entity_label=HABITS.ref("label"), **how),))


@pytest.mark.parametrize(("done", "missed", "as_of", "expected"), [([1, 2, 3, 4, 5, 8, 9, 10], [6, 7], 10, (3, 5)), ([1, 2], [3], 3, (2, 2)), ([1], [2], 3, (0, 1)), ([20], [21], 10, (0, 0))])
def test_streaks(run, done, missed, as_of, expected):
    assert rows_of(run(streak(), habits("h", done, missed), HABIT_SCHEMA, as_of=may(as_of)))[0][2:] == expected


def test_streak_labels_order_and_top(run):
    data = [("b", None, "done", ""), *habits("a", [1], [], "Alpha"), *habits("b", [1, 2], [], "Beta"), (None, may(1), "done", "x"), ("c", None, None, None)]
    result = run(streak(), data, HABIT_SCHEMA, as_of=may(2))
    assert rows_of(result) == [("b", "Beta", 2, 2), ("a", "Alpha", 1, 1), ("c", "c", 0, 0)]
    result = run(streak(top_n=1), data, HABIT_SCHEMA, as_of=may(2))
    assert rows_of(result) == [("b", "Beta", 2, 2)] and result.truncated_count == 2


def test_streak_ignores_filters_and_needs_as_of(run, spark):
    q = streak().with_filters(Q.Filter(HABITS.ref("status"), Q.Op.equals, enum("missed")))
    assert rows_of(run(q, habits("h", [1, 2], []), HABIT_SCHEMA, as_of=may(2)))[0][2:] == (2, 2)
    found = execute(streak(), spark.createDataFrame([], HABIT_SCHEMA), SOURCES)
    assert found.error.kind is ErrorKind.preconditionViolation


def series(run, values, field="amount"):
    q = Q.Query("events", (m(EVENTS, "amount", Q.MAX, "v"),), group_bys=by(EVENTS, "kind"))
    return run(q, [(may(1), k, v) for k, v in values], EVENT_SCHEMA)


def test_combine_policies(run):
    x, y = series(run, [("a", 1), ("b", 2), ("c", 3)]), series(run, [("b", 10), ("c", 20), ("d", 30)])
    assert rows_of(algebra.combine(x, y, Q.Combination.difference).value) == [("b", -8, False), ("c", -17, False)]
    x, y = series(run, [("a", 5)]), series(run, [("b", 7)])
    for how, expected in ((Q.Combination.difference, [5, -7]), (Q.Combination.sum, [5, 7]), (Q.Combination.product, [5.0, 7.0]), (Q.Combination.ratio, [])):
        got = rows_of(algebra.combine(x, y, how, Q.Unmatched.fillIdentity).value)
        assert [r[1] for r in got] == expected
    x, y = series(run, [("a", None), ("b", 5)]), series(run, [("a", 7), ("b", 2)])
    for policy in Q.Unmatched:
        assert [r[1] for r in rows_of(algebra.combine(x, y, Q.Combination.difference, policy).value)] == [None, 3]


def test_combine_drop_keeps_the_order_of_x(run):
    q = Q.Query("events", (m(EVENTS, "amount", Q.MAX, "v"),), group_bys=by(EVENTS, "kind"), sort=Q.Sort(Q.ByMeasure(), Q.Direction.descending))
    x = run(q, [(may(1), "a", 1), (may(1), "b", 9)], EVENT_SCHEMA)
    y = series(run, [("a", 1), ("b", 1)])
    assert [r[0] for r in rows_of(algebra.combine(x, y, Q.Combination.ratio, Q.Unmatched.drop).value)] == ["b", "a"]
    assert [r[0] for r in rows_of(algebra.combine(x, y, Q.Combination.ratio, Q.Unmatched.fillIdentity).value)] == ["a", "b"]


def test_series_operations_and_errors(run):
    x = series(run, [("a", 1), ("b", None), ("c", 3)])
    chain = algebra.Fluent(x)
    assert [r[1] for r in rows_of(chain.cumulative_sum().result.value)] == [1, 1, 4]
    assert [r[1] for r in rows_of(chain.negated().fill_null(7.5).result.value)] == [-1, 8, -3]
    assert chain.moving_average(0).delta().result.error.kind is ErrorKind.invalidDerivedOperationParameter
    assert algebra.combine(x, run(Q.Query("events", (Q.Count(),), group_bys=(Q.TimeGroupBy(EVENTS.ref("at"), G.DAY),)), [], EVENT_SCHEMA), Q.Combination.sum).error.kind is ErrorKind.incompatibleSeriesCombination
    first = run(Q.Query("events", (m(EVENTS, "at", Q.MIN),), group_bys=by(EVENTS, "kind")), [], EVENT_SCHEMA)
    assert algebra.apply(first, Q.DELTA).error.kind is ErrorKind.derivedOpRequiresNumericMeasure


def test_shapes_and_pivot(run):
    q = Q.Query("tasks", (Q.Count(label="n"),), group_bys=by(TASKS, "status", "title"), sort=Q.Sort(Q.ByMeasure(), Q.Direction.descending), limit=2)
    result = run(q, [("A", 1, "X"), ("A", 1, "X"), ("B", 3, "Y")], TASK_SCHEMA)
    assert result.shape is Q.Shape.multiSeries
    assert rows_of(result.to_table()) == [("A", "X", 2, False), ("A", "Y", None, False), ("B", "X", None, False), ("B", "Y", 1, False)]
    wide = [r.asDict() for r in result.pivot().collect()]
    assert wide[0]["status"] == "A" and wide[0]["X"] == 2
    assert run(Q.Query("tasks", (Q.Count(),)), [("A", 1, "X")], TASK_SCHEMA).scalar() == 1


def test_pushdown_one_scan_and_column_pruning(spark, sf_dir):
    from quillboard.sources.catalog import TABLES, tables

    orders = TABLES[1]
    q = Q.Query("orders", (Q.Count(),), (Q.Filter(orders.ref("o_orderstatus"), Q.Op.equals, enum("F")), Q.Filter(orders.ref("o_orderdate"), Q.Op.lessThan, date_time(datetime(1997, 1, 1)))), by(orders, "o_orderstatus", "o_orderpriority"))
    df = tables(sf_dir).run(spark, q).value.df
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan.split("Initial Plan")[0]
    assert "EqualNullSafe(o_orderstatus,F)" in plan and "LessThan(o_orderdate" in plan
    assert "o_totalprice" not in plan
    assert final.count("FileScan") == 1, final  # the axes reuse the aggregate's exchange


def test_grain_columns_agree_with_python(spark):
    anchors = [datetime(2000, 1, 1), datetime(2000, 1, 31), datetime(2024, 2, 29, 6, 30, 0, 5), datetime(2026, 1, 1, 15, 30)]
    instants = [datetime(1999, 12, 31, 23, 59, 59, 999999), datetime(2024, 2, 29), datetime(2026, 5, 15, 14, 22), datetime(2025, 12, 30), datetime(2030, 3, 1, 15, 30), datetime(1995, 7, 4, 6, 29, 59)]
    grains = [G.TimeGrain(n, u, a) for n in (1, 3) for u in G.TimeUnit for a in anchors] + [G.TimeGrain(2, G.TimeUnit.week, a, w) for a in anchors for w in (1, 7)]
    df = spark.createDataFrame([(x,) for x in instants], "ts timestamp_ntz")
    got = df.select(*[g.column(F.col("ts")).alias(str(i)) for i, g in enumerate(grains)]).collect()
    assert [list(r) for r in got] == [[g.start_of(x) for g in grains] for x in instants]


def test_grain_literals():
    start = lambda g, *x: g.start_of(datetime(*x))
    three = G.TimeGrain(3, G.TimeUnit.day, datetime(2026, 1, 1))
    assert start(three, 2026, 1, 5) == datetime(2026, 1, 4) and start(three, 2025, 12, 30) == datetime(2025, 12, 29)
    week = lambda w: G.TimeGrain(1, G.TimeUnit.week, datetime(2026, 1, 1), w)
    assert [start(week(w), 2026, 5, 15) for w in (7, 1, None)] == [datetime(2026, 5, 10), datetime(2026, 5, 11), datetime(2026, 5, 14)]
    assert start(G.TimeGrain(3, G.TimeUnit.month, datetime(2000, 1, 1)), 2026, 5, 15) == datetime(2026, 4, 1)
    assert start(G.TimeGrain(15, G.TimeUnit.minute, datetime(2000, 1, 1)), 2026, 5, 15, 14, 22) == datetime(2026, 5, 15, 14, 15)
    with pytest.raises(ValueError):
        G.TimeGrain(0, G.TimeUnit.day, datetime(2000, 1, 1))
    with pytest.raises(ValueError):
        G.TimeGrain(1, G.TimeUnit.day, datetime(2000, 1, 1), 1)


def test_durations_from_intervals(spark):
    df = spark.createDataFrame([(timedelta(seconds=1.5),)], "dur interval day to second")
    q = Q.Query("mixed", (m(MIXED, "dur", Q.SUM),))
    assert rows_of(execute(q, df, SOURCES).value) == [(1_500_000,)]




# -- typed values, wide form, shared snapshots ----------------------------------------------------------------
def test_buckets_and_keys(spark, sf_dir):
    from quillboard.results import BucketKey
    from quillboard.sources.catalog import TABLES, tables

    orders = TABLES[1]
    query = Q.Query("orders", (Q.Count(label="n"),), group_bys=(Q.FieldGroupBy(orders.ref("o_orderpriority")),))
    result = tables(sf_dir).run(spark, query).value
    found = result.collect()
    assert [b.keys[0].value for b in found] == sorted(b.keys[0].value for b in found)
    assert sum(b.values[0] for b in found) == spark.read.parquet(f"{sf_dir}/orders.parquet").count() and not any(b.is_synthetic for b in found)
    with pytest.raises(ValueError):
        result.collect(most=2)
    a, b, none = (BucketKey(FieldType.integer, x) for x in (1, 2, None))
    assert a == BucketKey(FieldType.integer, 1) != BucketKey(FieldType.duration, 1)
    assert (a.compare(b), b.compare(a), a.compare(a), a.compare(none), none.compare(b), none.compare(none)) == (-1, 1, 0, -1, 1, 0)
    assert a.typed().value == 1 and none.typed().is_null
    with pytest.raises(TypeError):
        a.compare(BucketKey(FieldType.string, "1"))


def test_pivot_tells_null_from_its_name(spark):
    t = source("t", x=FieldType.string, s=FieldType.string)
    df = spark.createDataFrame([("a", "null"), ("a", "null"), ("a", None), ("b", None), ("b", "x"), ("a", None), ("a", None)], "x string, s string")
    query = Q.Query("t", (Q.Count(label="n"),), group_bys=(Q.FieldGroupBy(t.ref("x")), Q.FieldGroupBy(t.ref("s"))))
    wide = execute(query, df, (t,)).value.pivot()
    assert wide.columns == ["x", "null", "x_", "null_"]
    assert [tuple(r) for r in wide.collect()] == [("a", 2, 0, 3), ("b", 0, 1, 1)]


def test_both_halves_of_a_pair_share_a_snapshot(spark, sf_dir):
    from datetime import datetime

    from quillboard.functions import dates
    from quillboard.functions import grain as G
    from quillboard.sources.catalog import TABLES, tables

    events = TABLES[0]
    half = Q.Query("events", (Q.Count(),), group_bys=(Q.TimeGroupBy(events.ref("ts"), G.DAY),))
    catalog, loads = tables(sf_dir), []
    catalog.register(events, lambda s, bound: loads.append(bound) or s.read.parquet(f"{sf_dir}/events.parquet"))
    cache = catalog.snapshots(spark, persist=False)
    mode = dates.FixedOverride(dates.CustomRange(datetime(2024, 1, 5), datetime(2024, 1, 6)))
    for _ in range(2):
        assert catalog.run_payload(spark, Q.Paired(half, half), mode, None, datetime(2024, 2, 1), cache=cache).is_ok
    assert len(loads) == 1


def test_a_streak_takes_one_exchange_and_long_axes_stay_off_the_driver(spark, sf_dir):
    from datetime import datetime

    from quillboard.functions import dates
    from quillboard.functions import grain as G
    from quillboard.sources.catalog import TABLES, tables

    events = TABLES[0]
    streak = Q.Query("events", (Q.Streak(events.ref("user_id"), events.ref("ts"), events.ref("event_type"), "purchase"),))
    plan = tables(sf_dir).run(spark, streak, as_of=datetime(2024, 1, 25)).value.frame._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    year = dates.Range(datetime(2024, 1, 1), datetime(2025, 1, 1))
    line, n = G.SECOND.axis(spark, year.start, year.end, "t")
    assert n == 366 * 86400 and len(line._jdf.queryExecution().logical().toString()) < 2000
    for g in (G.HOUR, G.DAY, G.WEEK, G.MONTH, G.TimeGrain(1, G.TimeUnit.month, datetime(2000, 1, 31)), G.TimeGrain(7, G.TimeUnit.hour, datetime(2030, 5, 5, 3))):
        line, n = g.axis(spark, datetime(2024, 1, 3, 5), datetime(2024, 5, 2), "t")
        assert [r.t for r in line.orderBy("t").collect()] == sorted(g.starts(datetime(2024, 1, 3, 5), datetime(2024, 5, 2))) and n == line.count()
