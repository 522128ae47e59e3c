"""The registered dashboard queries over the star-schema tables, each beside its SQL.

Doubles are rounded to 4 digits on both sides: sums depend on the order of addition.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillboard import codec
from quillboard.functions import dates
from quillboard.functions import grain as G
from quillboard.operators import algebra
from quillboard.plans import spec as Q
from quillboard.plans.compile import execute
from quillboard.plans.validate import validate_query
from quillboard.results import Result
from quillboard.schema import FieldDef, FieldType, SourceDef, date_time, double, enum, enums, integer, integers, null
from quillboard.sources.catalog import TABLES, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
EVENTS, ORDERS, LINES, CUSTOMERS, PARTS = TABLES[:5]
Op, Agg = Q.Op, Q


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(f"`{c}`", 4).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def register(name: str, sql: str | None, run: Callable[[SparkSession, str], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf_dir: rounded(run(spark, sf_dir))
    if sql:
        SQL[name] = sql


def ok(found) -> Result:
    if found.is_err:
        raise ValueError(found.error)
    return found.value


def add(name: str, query: Q.Query, sql: str, **how) -> None:
    register(name, sql, lambda spark, sf_dir: ok(tables(sf_dir).run(spark, query, **how)).df)


def count(label: str = "n") -> Q.Count:
    return Q.Count(label=label)


def measure(source: SourceDef, field: str, agg: Q.Aggregation, label: str) -> Q.FieldMeasure:
    return Q.FieldMeasure(source.ref(field), agg, label=label)


def by(source: SourceDef, *fields: str) -> tuple[Q.FieldGroupBy, ...]:
    return tuple(Q.FieldGroupBy(source.ref(f)) for f in fields)


def at(source: SourceDef, field: str, grain: G.TimeGrain) -> Q.TimeGroupBy:
    return Q.TimeGroupBy(source.ref(field), grain)


def where(source: SourceDef, field: str, op: Op, value) -> Q.Filter:
    return Q.Filter(source.ref(field), op, value)


def day(y: int, m: int, d: int, h: int = 0) -> datetime:
    return datetime(y, m, d, h)


# -- aggregation ---------------------------------------------------------------------------------
add("count_by_category", Q.Query("events", (count(),), group_bys=by(EVENTS, "event_type")), "SELECT event_type, count(*) AS n, false AS is_synthetic FROM events GROUP BY 1")
add("scalar_sum", Q.Query("events", (measure(EVENTS, "value", Q.SUM, "total"),)), "SELECT round(sum(value), 4) AS total FROM events")
add(
    "scalar_multi",
    Q.Query("events", (count(), measure(EVENTS, "value", Q.AVERAGE, "mean"), measure(EVENTS, "user_id", Q.DISTINCT, "users"))),
    "SELECT count(*) AS n, round(avg(value), 4) AS mean, count(DISTINCT user_id) AS users FROM events",
)
add(
    "scalar_empty",
    Q.Query(
        "events",
        (count(), measure(EVENTS, "value", Q.SUM, "total"), measure(EVENTS, "value", Q.AVERAGE, "mean"), measure(EVENTS, "value", Q.MAX, "top"), measure(EVENTS, "user_id", Q.DISTINCT, "users")),
        (where(EVENTS, "event_id", Op.lessThan, integer(-1)),),
    ),
    "SELECT count(*) AS n, round(coalesce(sum(value), 0.0), 4) AS total, round(avg(value), 4) AS mean, max(value) AS top, count(DISTINCT user_id) AS users FROM events WHERE event_id < -1",
)
add(
    "agg_all_double",
    Q.Query(
        "events",
        (measure(EVENTS, "value", Q.SUM, "total"), measure(EVENTS, "value", Q.AVERAGE, "mean"), measure(EVENTS, "value", Q.MIN, "low"), measure(EVENTS, "value", Q.MAX, "high"), measure(EVENTS, "value", Q.percentile(0.9), "p90")),
        group_bys=by(EVENTS, "event_type"),
    ),
    "SELECT event_type, round(sum(value), 4) AS total, round(avg(value), 4) AS mean, round(min(value), 4) AS low, round(max(value), 4) AS high, round(quantile_cont(value, 0.9), 4) AS p90, false AS is_synthetic FROM events GROUP BY 1",
)
add(
    "agg_int_types",
    Q.Query(
        "lineitem",
        (measure(LINES, "l_linenumber", Q.SUM, "total"), measure(LINES, "l_linenumber", Q.AVERAGE, "mean"), measure(LINES, "l_linenumber", Q.MIN, "low"), measure(LINES, "l_linenumber", Q.MAX, "high"), measure(LINES, "l_linenumber", Q.percentile(0.25), "p25")),
        group_bys=by(LINES, "l_returnflag"),
    ),
    "SELECT l_returnflag, CAST(sum(l_linenumber) AS BIGINT) AS total, round(avg(l_linenumber), 4) AS mean, CAST(min(l_linenumber) AS BIGINT) AS low, CAST(max(l_linenumber) AS BIGINT) AS high, round(quantile_cont(l_linenumber, 0.25), 4) AS p25, false AS is_synthetic FROM lineitem GROUP BY 1",
)
add(
    "agg_distinct",
    Q.Query("lineitem", (measure(LINES, "l_suppkey", Q.DISTINCT, "suppliers"), measure(LINES, "l_shipdate", Q.DISTINCT, "days")), group_bys=by(LINES, "l_linestatus")),
    "SELECT l_linestatus, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_shipdate) AS days, false AS is_synthetic FROM lineitem GROUP BY 1",
)
add(
    "agg_datetime_minmax",
    Q.Query("orders", (measure(ORDERS, "o_orderdate", Q.MIN, "first"), measure(ORDERS, "o_orderdate", Q.MAX, "last")), group_bys=by(ORDERS, "o_orderstatus")),
    "SELECT o_orderstatus, CAST(min(o_orderdate) AS TIMESTAMP) AS first, CAST(max(o_orderdate) AS TIMESTAMP) AS last, false AS is_synthetic FROM orders GROUP BY 1",
)
add("group_by_integer", Q.Query("lineitem", (count(),), group_bys=by(LINES, "l_linenumber")), "SELECT CAST(l_linenumber AS BIGINT) AS l_linenumber, count(*) AS n, false AS is_synthetic FROM lineitem GROUP BY 1")

# -- derived columns: durations and nulls ----------------------------------------------------------
SPANS = SourceDef(
    "spans",
    "spans",
    (
        FieldDef("event_type", "spans", "event_type", FieldType.enumeration),
        FieldDef("ts", "spans", "ts", FieldType.dateTime),
        FieldDef("clock", "spans", "clock", FieldType.duration),
        FieldDef("spent", "spans", "spent", FieldType.double),
        FieldDef("late", "spans", "late", FieldType.boolean),
    ),
    "ts",
)
SPANS_SQL = "(SELECT event_type, ts, epoch_us(ts) - epoch_us(date_trunc('day', ts)) AS clock, CASE WHEN event_type = 'view' THEN NULL ELSE value END AS spent, hour(ts) >= 18 AS late FROM events)"


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the time of day as an interval, and a value that views lack."""
    ts = F.col("ts").cast("timestamp_ntz")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_type",
        ts.alias("ts"),
        (ts - F.date_trunc("day", ts).cast("timestamp_ntz")).alias("clock"),
        F.when(F.col("event_type") != "view", F.col("value")).alias("spent"),
        (F.hour(ts) >= 18).alias("late"),
    )


def add_spans(name: str, query: Q.Query, sql: str, **how) -> None:
    register(name, sql.replace("spans", SPANS_SQL), lambda spark, sf_dir: ok(execute(query, spans(spark, sf_dir), (SPANS,), **how)).df)


add_spans(
    "duration_agg",
    Q.Query(
        "spans",
        (measure(SPANS, "clock", Q.SUM, "total"), measure(SPANS, "clock", Q.AVERAGE, "mean"), measure(SPANS, "clock", Q.MIN, "low"), measure(SPANS, "clock", Q.MAX, "high"), measure(SPANS, "clock", Q.percentile(0.5), "half")),
        group_bys=by(SPANS, "event_type"),
    ),
    "SELECT event_type, CAST(sum(clock) AS BIGINT) AS total, CAST(sum(clock) // count(clock) AS BIGINT) AS mean, min(clock) AS low, max(clock) AS high, CAST(round(quantile_cont(clock, 0.5)) AS BIGINT) AS half, false AS is_synthetic FROM spans GROUP BY 1",
)
add_spans("group_by_boolean", Q.Query("spans", (count(),), group_bys=by(SPANS, "late")), "SELECT late, count(*) AS n, false AS is_synthetic FROM spans GROUP BY 1")
add_spans("group_by_null_key", Q.Query("spans", (count(),), group_bys=by(SPANS, "spent")), "SELECT round(spent, 4) AS spent, count(*) AS n, false AS is_synthetic FROM spans GROUP BY spent")
add_spans("nulls_in_aggregates", Q.Query("spans", (count(), measure(SPANS, "spent", Q.SUM, "total"), measure(SPANS, "spent", Q.AVERAGE, "mean")), group_bys=by(SPANS, "event_type")), "SELECT event_type, count(*) AS n, round(coalesce(sum(spent), 0.0), 4) AS total, round(avg(spent), 4) AS mean, false AS is_synthetic FROM spans GROUP BY 1")
add_spans("filter_is_null", Q.Query("spans", (count(),), (where(SPANS, "spent", Op.equals, null(FieldType.double)),)), "SELECT count(*) AS n FROM spans WHERE spent IS NULL")
add_spans("filter_not_null", Q.Query("spans", (count(),), (where(SPANS, "spent", Op.notEquals, null(FieldType.double)),)), "SELECT count(*) AS n FROM spans WHERE spent IS NOT NULL")
add_spans("filter_ne_keeps_null", Q.Query("spans", (count(),), (where(SPANS, "spent", Op.notEquals, double(10.0)),)), "SELECT count(*) AS n FROM spans WHERE spent IS DISTINCT FROM 10.0")
add_spans("filter_order_drops_null", Q.Query("spans", (count(),), (where(SPANS, "spent", Op.lessThanOrEqual, double(50.0)),)), "SELECT count(*) AS n FROM spans WHERE spent <= 50.0")

# -- filters -----------------------------------------------------------------------------------------
add("filter_eq", Q.Query("orders", (count(),), (where(ORDERS, "o_orderstatus", Op.equals, enum("F")),)), "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F'")
add("filter_ne", Q.Query("orders", (count(),), (where(ORDERS, "o_orderstatus", Op.notEquals, enum("F")),), by(ORDERS, "o_orderpriority")), "SELECT o_orderpriority, count(*) AS n, false AS is_synthetic FROM orders WHERE o_orderstatus IS DISTINCT FROM 'F' GROUP BY 1")
add("filter_in", Q.Query("lineitem", (count(),), (where(LINES, "l_returnflag", Op.inList, enums(["A", "R"])), where(LINES, "l_linenumber", Op.inList, integers([1, 3, 5])))), "SELECT count(*) AS n FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_linenumber IN (1, 3, 5)")
add("filter_in_empty", Q.Query("orders", (count(),), (where(ORDERS, "o_orderpriority", Op.inList, enums([])),)), "SELECT count(*) AS n FROM orders WHERE false")
add("filter_range", Q.Query("orders", (count(), measure(ORDERS, "o_totalprice", Q.SUM, "total")), (where(ORDERS, "o_orderdate", Op.greaterThanOrEqual, date_time(day(1996, 1, 1))), where(ORDERS, "o_orderdate", Op.lessThan, date_time(day(1997, 1, 1))), where(ORDERS, "o_totalprice", Op.greaterThan, double(1000.0)))), "SELECT count(*) AS n, round(coalesce(sum(o_totalprice), 0.0), 4) AS total FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' AND o_totalprice > 1000.0")

# -- grids -------------------------------------------------------------------------------------------
#: Prices that few rows are above or below: grids over them have gaps in small tables.
DEAR, CHEAP = 499_700.0, 1_000.0
_SPARSE = (where(ORDERS, "o_totalprice", Op.greaterThan, double(DEAR)),)
_GRID = f"""WITH d AS (SELECT * FROM orders WHERE o_totalprice > {DEAR}),
a AS (SELECT DISTINCT o_orderstatus FROM d), b AS (SELECT DISTINCT o_orderpriority FROM d),
g AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n, avg(o_totalprice) AS mean FROM d GROUP BY 1, 2)
"""
add("group2_grid", Q.Query("orders", (count(), measure(ORDERS, "o_totalprice", Q.AVERAGE, "mean")), _SPARSE, by(ORDERS, "o_orderstatus", "o_orderpriority")), _GRID + "SELECT a.o_orderstatus, b.o_orderpriority, coalesce(g.n, 0) AS n, round(g.mean, 4) AS mean, g.n IS NULL AS is_synthetic FROM a CROSS JOIN b LEFT JOIN g ON g.o_orderstatus IS NOT DISTINCT FROM a.o_orderstatus AND g.o_orderpriority IS NOT DISTINCT FROM b.o_orderpriority")
add("group2_sparse", Q.Query("orders", (count(),), _SPARSE, by(ORDERS, "o_orderstatus", "o_orderpriority")), "SELECT o_orderstatus, o_orderpriority, count(*) AS n, false AS is_synthetic FROM orders WHERE o_totalprice > " + str(DEAR) + " GROUP BY 1, 2", densify=False)
add(
    "group3_grid",
    Q.Query("lineitem", (measure(LINES, "l_quantity", Q.SUM, "qty"),), (where(LINES, "l_extendedprice", Op.lessThan, double(CHEAP)),), by(LINES, "l_returnflag", "l_linestatus", "l_linenumber")),
    f"""WITH d AS (SELECT l_returnflag AS r, l_linestatus AS s, CAST(l_linenumber AS BIGINT) AS k, l_quantity FROM lineitem WHERE l_extendedprice < {CHEAP}),
    c AS (SELECT * FROM (SELECT DISTINCT r FROM d) CROSS JOIN (SELECT DISTINCT s FROM d) CROSS JOIN (SELECT DISTINCT k FROM d)),
    g AS (SELECT r, s, k, sum(l_quantity) AS q FROM d GROUP BY 1, 2, 3)
    SELECT c.r AS l_returnflag, c.s AS l_linestatus, c.k AS l_linenumber, round(coalesce(g.q, 0.0), 4) AS qty, g.q IS NULL AS is_synthetic FROM c LEFT JOIN g ON c.r = g.r AND c.s = g.s AND c.k = g.k""",
)
add("multi_measure_series", Q.Query("events", (count(), measure(EVENTS, "value", Q.SUM, "total"), measure(EVENTS, "value", Q.AVERAGE, "mean"), measure(EVENTS, "user_id", Q.DISTINCT, "users")), group_bys=by(EVENTS, "event_type")), "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 4) AS mean, count(DISTINCT user_id) AS users, false AS is_synthetic FROM events GROUP BY 1")

# -- time --------------------------------------------------------------------------------------------
_GRAINS = {
    "time_day": (G.DAY, "date_trunc('day', ts)"),
    "time_hour": (G.HOUR, "date_trunc('hour', ts)"),
    "time_week_sun": (G.WEEK, "time_bucket(INTERVAL '7 days', ts, TIMESTAMP '2000-01-02')"),
    "time_week_mon": (G.TimeGrain(1, G.TimeUnit.week, day(2000, 1, 2), 1), "time_bucket(INTERVAL '7 days', ts, TIMESTAMP '2000-01-03')"),
    "time_15min": (G.TimeGrain(15, G.TimeUnit.minute, day(2000, 1, 1)), "time_bucket(INTERVAL '15 minutes', ts, TIMESTAMP '2000-01-01')"),
    "time_3day": (G.TimeGrain(3, G.TimeUnit.day, day(2026, 1, 1)), "time_bucket(INTERVAL '3 days', ts, TIMESTAMP '2026-01-01')"),
    "time_noon_day": (G.TimeGrain(1, G.TimeUnit.day, day(2000, 1, 1, 12)), "time_bucket(INTERVAL '24 hours', ts, TIMESTAMP '2000-01-01 12:00:00')"),
}
for _name, (_grain, _sql) in _GRAINS.items():
    add(_name, Q.Query("events", (count(),), group_bys=(at(EVENTS, "ts", _grain),)), f"SELECT CAST({_sql} AS TIMESTAMP) AS ts, count(*) AS n, false AS is_synthetic FROM events GROUP BY 1")
_LONG = {
    "time_month": (G.MONTH, "date_trunc('month', o_orderdate)"),
    "time_quarter": (G.TimeGrain(3, G.TimeUnit.month, day(2000, 1, 1)), "date_trunc('quarter', o_orderdate)"),
    "time_year": (G.YEAR, "date_trunc('year', o_orderdate)"),
    "time_mid_month": (G.TimeGrain(1, G.TimeUnit.month, day(2000, 1, 15)), "date_trunc('month', o_orderdate - INTERVAL '14 days') + INTERVAL '14 days'"),
}
for _name, (_grain, _sql) in _LONG.items():
    add(_name, Q.Query("orders", (count(), measure(ORDERS, "o_totalprice", Q.SUM, "total")), group_bys=(at(ORDERS, "o_orderdate", _grain),)), f"SELECT CAST({_sql} AS TIMESTAMP) AS o_orderdate, count(*) AS n, round(sum(o_totalprice), 4) AS total, false AS is_synthetic FROM orders GROUP BY 1")
_RANGE = dates.Range(day(2024, 1, 10), day(2024, 1, 13))
_AXIS = "generate_series(TIMESTAMP '2024-01-10', TIMESTAMP '2024-01-12 23:00:00', INTERVAL '1 hour') AS s(t)"
_RARE = (where(EVENTS, "value", Op.greaterThan, double(90.0)),)
_HOURS = f"""WITH g AS (SELECT date_trunc('hour', ts) AS t, count(*) AS n, avg(value) AS mean FROM events WHERE value > 90.0 GROUP BY 1),
h AS (SELECT CAST(s.t AS TIMESTAMP) AS ts, coalesce(g.n, 0) AS n, round(g.mean, 4) AS mean, g.n IS NULL AS is_synthetic FROM {_AXIS} LEFT JOIN g ON g.t = s.t)
"""
_HOURLY = Q.Query("events", (count(), measure(EVENTS, "value", Q.AVERAGE, "mean")), _RARE, (at(EVENTS, "ts", G.HOUR),))
add("time_densified", _HOURLY, _HOURS + "SELECT ts, n, mean, is_synthetic FROM h", date_range=_RANGE)
add("time_out_of_range", Q.Query("events", (count(),), group_bys=(at(EVENTS, "ts", G.DAY),)), "SELECT CAST(s.t AS TIMESTAMP) AS ts, count(e.ts) AS n, count(e.ts) = 0 AS is_synthetic FROM generate_series(TIMESTAMP '2024-01-10', TIMESTAMP '2024-01-12', INTERVAL '1 day') AS s(t) LEFT JOIN events e ON date_trunc('day', e.ts) = s.t GROUP BY s.t", date_range=_RANGE)
add(
    "time_grid_2d",
    Q.Query("events", (count(),), _RARE, (at(EVENTS, "ts", G.DAY), *by(EVENTS, "event_type"))),
    """WITH d AS (SELECT date_trunc('day', ts) AS t, event_type FROM events WHERE value > 90.0),
    c AS (SELECT * FROM generate_series(TIMESTAMP '2024-01-10', TIMESTAMP '2024-01-12', INTERVAL '1 day') AS s(t) CROSS JOIN (SELECT DISTINCT event_type FROM d)),
    g AS (SELECT t, event_type, count(*) AS n FROM d GROUP BY 1, 2)
    SELECT CAST(c.t AS TIMESTAMP) AS ts, c.event_type, coalesce(g.n, 0) AS n, g.n IS NULL AS is_synthetic FROM c LEFT JOIN g ON c.t = g.t AND c.event_type = g.event_type""",
    date_range=_RANGE,
)
add("time_sparse", _HOURLY, "SELECT date_trunc('hour', ts) AS ts, count(*) AS n, round(avg(value), 4) AS mean, false AS is_synthetic FROM events WHERE value > 90.0 GROUP BY 1", date_range=_RANGE, densify=False)

# -- HAVING, sort, limit -------------------------------------------------------------------------------
_SIGNS = {"eq": (Op.equals, "="), "ne": (Op.notEquals, "<>"), "lt": (Op.lessThan, "<"), "le": (Op.lessThanOrEqual, "<="), "gt": (Op.greaterThan, ">"), "ge": (Op.greaterThanOrEqual, ">=")}
for _name, (_op, _sign) in _SIGNS.items():
    add(f"having_{_name}", Q.Query("events", (count(), measure(EVENTS, "value", Q.AVERAGE, "mean")), _RARE, (at(EVENTS, "ts", G.HOUR),), having=Q.Having(_op, integer(1), "n")), _HOURS + f"SELECT ts, n, mean, is_synthetic FROM h WHERE n {_sign} 1", date_range=_RANGE)
add("having_null_measure", Q.Query("events", (count(), measure(EVENTS, "value", Q.AVERAGE, "mean")), _RARE, (at(EVENTS, "ts", G.HOUR),), having=Q.Having(Op.notEquals, double(0.0), "mean")), _HOURS + "SELECT ts, n, mean, is_synthetic FROM h WHERE mean <> 0.0", date_range=_RANGE)
_SORTS = {"asc": (Q.Direction.ascending, False, "ASC NULLS LAST"), "desc": (Q.Direction.descending, False, "DESC NULLS FIRST"), "forced": (Q.Direction.descending, True, "DESC NULLS LAST")}
for _name, (_dir, _force, _sign) in _SORTS.items():
    add(f"sort_nulls_{_name}", Q.Query("events", (count(), measure(EVENTS, "value", Q.AVERAGE, "mean")), _RARE, (at(EVENTS, "ts", G.HOUR),), sort=Q.Sort(Q.ByMeasure("mean"), _dir, _force), limit=20), _HOURS + f"SELECT ts, n, mean, is_synthetic FROM h ORDER BY mean {_sign}, ts LIMIT 20", date_range=_RANGE)
add("sort_group", Q.Query("orders", (count(),), _SPARSE, by(ORDERS, "o_orderstatus", "o_orderpriority"), sort=Q.Sort(Q.ByGroup(ORDERS.ref("o_orderpriority")), Q.Direction.descending), limit=4), _GRID + "SELECT a.o_orderstatus, b.o_orderpriority, coalesce(g.n, 0) AS n, g.n IS NULL AS is_synthetic FROM a CROSS JOIN b LEFT JOIN g ON g.o_orderstatus = a.o_orderstatus AND g.o_orderpriority = b.o_orderpriority ORDER BY 2 DESC, 1 LIMIT 4")
add("topk", Q.Query("orders", (measure(ORDERS, "o_totalprice", Q.SUM, "total"),), group_bys=by(ORDERS, "o_custkey"), sort=Q.Sort(Q.ByMeasure(), Q.Direction.descending), limit=10), "SELECT CAST(o_custkey AS BIGINT) AS o_custkey, round(sum(o_totalprice), 4) AS total, false AS is_synthetic FROM orders GROUP BY 1 ORDER BY sum(o_totalprice) DESC, 1 LIMIT 10")

# -- derived operations --------------------------------------------------------------------------------
_DAYS = "WITH d AS (SELECT date_trunc('day', ts) AS ts, count(*) AS n, sum(value) AS v FROM events GROUP BY 1)\n"
_DERIVED = {
    "cumsum": (Q.CUMULATIVE_SUM, "CAST(sum(n) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS BIGINT)"),
    "delta": (Q.DELTA, "coalesce(n - lag(n) OVER (ORDER BY ts), 0)"),
    "moving_avg_7": (Q.moving_average(7), "round(avg(n) OVER (ORDER BY ts ROWS 6 PRECEDING), 4)"),
}
for _name, (_derive, _sql) in _DERIVED.items():
    add(_name, Q.Query("events", (count(),), group_bys=(at(EVENTS, "ts", G.DAY),), derived=_derive), _DAYS + f"SELECT ts, {_sql} AS n, false AS is_synthetic FROM d")
add("cumsum_nulls", Q.Query("events", (measure(EVENTS, "value", Q.AVERAGE, "mean"),), _RARE, (at(EVENTS, "ts", G.HOUR),), derived=Q.CUMULATIVE_SUM), _HOURS.replace("round(g.mean, 4)", "g.mean") + "SELECT ts, round(sum(coalesce(mean, 0)) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING), 4) AS mean, is_synthetic FROM h", date_range=_RANGE)
add("derived_after_limit", Q.Query("events", (count(),), group_bys=(at(EVENTS, "ts", G.DAY),), sort=Q.Sort(Q.ByMeasure(), Q.Direction.descending), limit=10, derived=Q.CUMULATIVE_SUM), _DAYS + "SELECT ts, CAST(sum(n) OVER (ORDER BY n DESC, ts ROWS UNBOUNDED PRECEDING) AS BIGINT) AS n, false AS is_synthetic FROM (SELECT * FROM d ORDER BY n DESC, ts LIMIT 10)")

# -- expressions ---------------------------------------------------------------------------------------
_PRICE, _QTY = measure(LINES, "l_extendedprice", Q.SUM, None), measure(LINES, "l_quantity", Q.SUM, None)
_LINES, _NUMS = measure(LINES, "l_linenumber", Q.SUM, None), Q.Count()
_CALC = {
    "calc_sum": (Q.Calculated(_LINES, _NUMS, Q.Combination.sum, label="x"), "CAST(sum(l_linenumber) + count(*) AS BIGINT)"),
    "calc_difference": (Q.Calculated(_PRICE, _QTY, Q.Combination.difference, label="x"), "round(sum(l_extendedprice) - sum(l_quantity), 4)"),
    "calc_product": (Q.Calculated(_NUMS, _LINES, Q.Combination.product, label="x"), "round(CAST(count(*) AS DOUBLE) * CAST(sum(l_linenumber) AS DOUBLE), 4)"),
    "calc_ratio": (Q.Calculated(_PRICE, _QTY, Q.Combination.ratio, label="x"), "round(sum(l_extendedprice) / nullif(sum(l_quantity), 0), 4)"),
    "calc_nested": (Q.Calculated(Q.Calculated(_PRICE, _QTY, Q.Combination.difference), _PRICE, Q.Combination.ratio, label="x"), "round((sum(l_extendedprice) - sum(l_quantity)) / nullif(sum(l_extendedprice), 0), 4)"),
    "negate": (Q.Transformed(_LINES, Q.ScalarOp(Q.Scalar.negate), label="x"), "CAST(-sum(l_linenumber) AS BIGINT)"),
    "absolute": (Q.Transformed(Q.Transformed(_PRICE, Q.ScalarOp(Q.Scalar.negate)), Q.ScalarOp(Q.Scalar.abs), label="x"), "round(abs(-sum(l_extendedprice)), 4)"),
}
for _name, (_m, _sql) in _CALC.items():
    add(_name, Q.Query("lineitem", (_m,), group_bys=by(LINES, "l_returnflag")), f"SELECT l_returnflag, {_sql} AS x, false AS is_synthetic FROM lineitem GROUP BY 1")
add("fill_null", Q.Query("events", (Q.Transformed(measure(EVENTS, "value", Q.AVERAGE, None), Q.ScalarOp(Q.Scalar.fillNull, -1), label="mean"),), _RARE, (at(EVENTS, "ts", G.HOUR),)), _HOURS + "SELECT ts, coalesce(mean, -1.0) AS mean, is_synthetic FROM h", date_range=_RANGE)
add("calc_synthetic", Q.Query("events", (Q.Calculated(Q.Count(), measure(EVENTS, "user_id", Q.DISTINCT, None), Q.Combination.difference, label="x"), Q.Calculated(measure(EVENTS, "value", Q.SUM, None), Q.Count(), Q.Combination.ratio, label="y")), _RARE, (at(EVENTS, "ts", G.HOUR),)), f"WITH g AS (SELECT date_trunc('hour', ts) AS t, count(*) - count(DISTINCT user_id) AS x, sum(value) / count(*) AS y FROM events WHERE value > 90.0 GROUP BY 1) SELECT CAST(s.t AS TIMESTAMP) AS ts, coalesce(g.x, 0) AS x, round(g.y, 4) AS y, g.x IS NULL AS is_synthetic FROM {_AXIS} LEFT JOIN g ON g.t = s.t", date_range=_RANGE)

# -- streaks -------------------------------------------------------------------------------------------
_STREAK_SQL = """WITH d AS (SELECT CAST(user_id AS VARCHAR) AS e, CAST(ts AS DATE) AS day, max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS done FROM events GROUP BY 1, 2),
f AS (SELECT *, CASE WHEN day <= DATE '2024-01-25' THEN done ELSE 0 END AS won, CASE WHEN done = 0 AND day < DATE '2024-01-25' THEN 1 ELSE 0 END AS lost FROM d),
r AS (SELECT *, sum(lost) OVER (PARTITION BY e ORDER BY day ROWS UNBOUNDED PRECEDING) AS run FROM f),
n AS (SELECT e, run, CAST(sum(won) AS BIGINT) AS n FROM r GROUP BY 1, 2)
SELECT e AS "entityId", e AS "entityLabel", arg_max(n, run) AS "currentStreak", max(n) AS "longestStreak" FROM n GROUP BY 1"""


def _streak(top: int | None) -> Q.Query:
    return Q.Query("events", (Q.Streak(EVENTS.ref("user_id"), EVENTS.ref("ts"), EVENTS.ref("event_type"), "purchase", top_n=top),))


add("streak_users", _streak(None), _STREAK_SQL, as_of=day(2024, 1, 25))
add("streak_topn", _streak(7), _STREAK_SQL + ' ORDER BY "currentStreak" DESC, "longestStreak" DESC, "entityLabel" LIMIT 7', as_of=day(2024, 1, 25))

# -- alignment of two series -----------------------------------------------------------------------------


def _daily(kind: str, low: float) -> Q.Query:
    return Q.Query("events", (count(),), (where(EVENTS, "event_type", Op.equals, enum(kind)), where(EVENTS, "value", Op.greaterThan, double(low))), (at(EVENTS, "ts", G.DAY),))


def add_pair(name: str, how: Q.Combination, policy: Q.Unmatched, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        catalog = tables(sf_dir)
        x, y = (ok(catalog.run(spark, _daily(k, low))) for k, low in (("purchase", 97.0), ("signup", 97.0)))
        return ok(algebra.combine(x, y, how, policy)).df

    register(name, _PAIR + sql, run)


_PAIR = """WITH x AS (SELECT date_trunc('day', ts) AS ts, count(*) AS n FROM events WHERE event_type = 'purchase' AND value > 97.0 GROUP BY 1),
y AS (SELECT date_trunc('day', ts) AS ts, count(*) AS n FROM events WHERE event_type = 'signup' AND value > 97.0 GROUP BY 1)
"""
add_pair("combine_drop", Q.Combination.difference, Q.Unmatched.drop, "SELECT x.ts, x.n - y.n AS n, false AS is_synthetic FROM x JOIN y ON x.ts = y.ts")
add_pair("combine_fill_sum", Q.Combination.sum, Q.Unmatched.fillIdentity, "SELECT coalesce(x.ts, y.ts) AS ts, coalesce(x.n, 0) + coalesce(y.n, 0) AS n, false AS is_synthetic FROM x FULL JOIN y ON x.ts = y.ts")
add_pair("combine_fill_product", Q.Combination.product, Q.Unmatched.fillIdentity, "SELECT coalesce(x.ts, y.ts) AS ts, CAST(coalesce(x.n, 1) * coalesce(y.n, 1) AS DOUBLE) AS n, false AS is_synthetic FROM x FULL JOIN y ON x.ts = y.ts")
add_pair("combine_fill_ratio", Q.Combination.ratio, Q.Unmatched.fillIdentity, "SELECT x.ts, round(x.n / y.n, 4) AS n, false AS is_synthetic FROM x JOIN y ON x.ts = y.ts")


def _fluent(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = ok(tables(sf_dir).run(spark, Q.Query("events", (count(),), group_bys=(at(EVENTS, "ts", G.DAY),))))
    return ok(algebra.Fluent(x).delta().negated().absolute().moving_average(3).result).df


register("series_algebra_chain", _DAYS + "SELECT ts, round(avg(x) OVER (ORDER BY ts ROWS 2 PRECEDING), 4) AS n, false AS is_synthetic FROM (SELECT ts, abs(coalesce(n - lag(n) OVER (ORDER BY ts), 0)) AS x FROM d)", _fluent)


def _paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    payload = Q.Paired(_daily("purchase", 0.0), _daily("view", 0.0))
    mode = dates.FixedOverride(dates.CustomRange(day(2024, 1, 5), day(2024, 1, 14)))
    x, y = ok(tables(sf_dir).run_payload(spark, payload, mode, None, day(2024, 2, 1)))
    return ok(algebra.combine(x, y, Q.Combination.ratio)).df


register(
    "paired_rate",
    """WITH s AS (SELECT CAST(t AS TIMESTAMP) AS ts FROM generate_series(TIMESTAMP '2024-01-05', TIMESTAMP '2024-01-14', INTERVAL '1 day') AS g(t)),
    x AS (SELECT date_trunc('day', ts) AS t, count(*) AS n FROM events WHERE event_type = 'purchase' AND value > 0.0 GROUP BY 1),
    y AS (SELECT date_trunc('day', ts) AS t, count(*) AS n FROM events WHERE event_type = 'view' AND value > 0.0 GROUP BY 1)
    SELECT s.ts, round(coalesce(x.n, 0) / nullif(y.n, 0), 4) AS n, x.n IS NULL AND y.n IS NULL AS is_synthetic FROM s LEFT JOIN x ON x.t = s.ts LEFT JOIN y ON y.t = s.ts""",
    _paired,
)

# -- date ranges and shapes ------------------------------------------------------------------------------
_TODAY = day(2024, 1, 20)
_PRESETS = {
    "project_last7": (dates.Preset.last7Days, "2024-01-14", "2024-01-20"),
    "project_this_month": (dates.Preset.thisMonth, "2024-01-01", "2024-01-20"),
    "project_qtd": (dates.Preset.quarterToDate, "2024-01-01", "2024-01-20"),
    "project_last_month": (dates.Preset.lastMonth, "2023-12-01", "2023-12-31"),
    "project_this_week": (dates.Preset.thisWeek, "2024-01-14", "2024-01-20"),
}


def _projected(preset: dates.Preset) -> Callable[[SparkSession, str], DataFrame]:
    payload = Q.Single(Q.Query("events", (count(),), group_bys=(at(EVENTS, "ts", G.DAY),)))
    return lambda spark, sf_dir: ok(tables(sf_dir).run_payload(spark, payload, dates.UsePageRange(), dates.PresetRange(preset), _TODAY)).df


for _name, (_preset, _first, _last) in _PRESETS.items():
    register(_name, f"SELECT CAST(s.t AS TIMESTAMP) AS ts, count(e.ts) AS n, count(e.ts) = 0 AS is_synthetic FROM generate_series(TIMESTAMP '{_first}', TIMESTAMP '{_last}', INTERVAL '1 day') AS s(t) LEFT JOIN events e ON date_trunc('day', e.ts) = s.t GROUP BY s.t", _projected(_preset))


def _pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ok(tables(sf_dir).run(spark, Q.Query("orders", (count(),), group_bys=by(ORDERS, "o_orderpriority", "o_orderstatus")))).pivot()


register("pivot_multiseries", "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS \"F\", count(*) FILTER (o_orderstatus = 'O') AS \"O\", count(*) FILTER (o_orderstatus = 'P') AS \"P\" FROM orders GROUP BY 1", _pivot)


def _table_of_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = Q.Query("orders", (count(),), group_bys=by(ORDERS, "o_orderpriority", "o_orderstatus"), sort=Q.Sort(Q.ByMeasure(), Q.Direction.descending), limit=6)
    return ok(tables(sf_dir).run(spark, query)).to_table().df


register(
    "multiseries_to_table",
    """WITH k AS (SELECT o_orderpriority AS a, o_orderstatus AS b, count(*) AS n FROM orders GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 6)
    SELECT x.a AS o_orderpriority, y.b AS o_orderstatus, k.n, false AS is_synthetic FROM (SELECT DISTINCT a FROM k) x CROSS JOIN (SELECT DISTINCT b FROM k) y LEFT JOIN k ON k.a = x.a AND k.b = y.b""",
    _table_of_limited,
)
add("customers_by_segment", Q.Query("customer", (count(), measure(CUSTOMERS, "c_acctbal", Q.AVERAGE, "mean")), group_bys=by(CUSTOMERS, "c_mktsegment")), "SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal), 4) AS mean, false AS is_synthetic FROM customer GROUP BY 1")
add("parts_by_size", Q.Query("part", (measure(PARTS, "p_retailprice", Q.percentile(0.5), "half"),), group_bys=by(PARTS, "p_size")), "SELECT CAST(p_size AS BIGINT) AS p_size, round(quantile_cont(p_retailprice, 0.5), 4) AS half, false AS is_synthetic FROM part GROUP BY 1")

# -- finer grains, late anchors, more presets ------------------------------------------------------------
for _unit, _grain in (("second", G.SECOND), ("millisecond", G.MILLISECOND), ("microsecond", G.MICROSECOND)):
    add(f"time_{_unit}", Q.Query("events", (count(),), group_bys=(at(EVENTS, "ts", _grain),)), f"SELECT date_trunc('{_unit}', ts) AS ts, count(*) AS n, false AS is_synthetic FROM events GROUP BY 1")
for _day in (29, 30, 31):
    _start = f"TIMESTAMP '2000-01-01' + to_months(CAST(12 * (year(o_orderdate) - 2000) + month(o_orderdate) - 1 - CASE WHEN day(o_orderdate) < {_day} THEN 1 ELSE 0 END AS INTEGER)) + INTERVAL {_day - 1} DAY"
    add(f"time_month_from_{_day}", Q.Query("orders", (count(),), group_bys=(at(ORDERS, "o_orderdate", G.TimeGrain(1, G.TimeUnit.month, day(2000, 1, _day))),)), f"SELECT {_start} AS o_orderdate, count(*) AS n, false AS is_synthetic FROM orders GROUP BY 1")
add("time_hour_axis", Q.Query("events", (count(),), group_bys=(at(EVENTS, "ts", G.TimeGrain(90, G.TimeUnit.minute, day(2000, 1, 1))),)), "SELECT CAST(s.t AS TIMESTAMP) AS ts, count(e.ts) AS n, count(e.ts) = 0 AS is_synthetic FROM generate_series(TIMESTAMP '2024-01-10', TIMESTAMP '2024-01-12 23:00:00', INTERVAL '90 minutes') AS s(t) LEFT JOIN events e ON time_bucket(INTERVAL '90 minutes', e.ts, TIMESTAMP '2000-01-01') = s.t GROUP BY s.t", date_range=_RANGE)
_MORE = {
    "project_last14": (dates.Preset.last14Days, "2024-01-07", "2024-01-20"),
    "project_last30": (dates.Preset.last30Days, "2023-12-22", "2024-01-20"),
    "project_last90": (dates.Preset.last90Days, "2023-10-23", "2024-01-20"),
    "project_all_time": (dates.Preset.allTime, "2023-01-20", "2024-01-20"),
}
_DAILY = "SELECT CAST(s.t AS TIMESTAMP) AS ts, count(e.ts) AS n, count(e.ts) = 0 AS is_synthetic FROM generate_series(TIMESTAMP '{first}', TIMESTAMP '{last}', INTERVAL '1 day') AS s(t) LEFT JOIN events e ON date_trunc('day', e.ts) = s.t GROUP BY s.t"
for _name, (_preset, _first, _last) in _MORE.items():
    register(_name, _DAILY.format(first=_first, last=_last), _projected(_preset))

# -- streaks with labels, and of dates ---------------------------------------------------------------------
PEOPLE = SourceDef("people", "people", tuple(FieldDef(n, "people", n, t) for n, t in (("user_id", FieldType.integer), ("ts", FieldType.dateTime), ("event_type", FieldType.enumeration), ("name", FieldType.string))))
_LABELLED = Q.Query("people", (Q.Streak(PEOPLE.ref("user_id"), PEOPLE.ref("ts"), PEOPLE.ref("event_type"), "purchase", PEOPLE.ref("name")),))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streaks of users named by their first view or signup; those without keep their id."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    name = F.when(F.col("event_type") == "view", F.concat(F.lit("viewer "), F.col("event_id").cast("string"))).when(F.col("event_type") == "signup", "")
    people = events.select("user_id", "ts", "event_type", name.alias("name"))
    return ok(execute(_LABELLED, people, (PEOPLE,), as_of=day(2024, 1, 25), input_order=F.col("ts"))).df


register(
    "streak_labels",
    f"""SELECT s."entityId", coalesce(b.label, s."entityId") AS "entityLabel", s."currentStreak", s."longestStreak" FROM ({_STREAK_SQL}) s
    LEFT JOIN (SELECT CAST(user_id AS VARCHAR) AS e, arg_min('viewer ' || event_id, (ts, 'viewer ' || event_id)) AS label FROM events WHERE event_type = 'view' GROUP BY 1) b ON s."entityId" = b.e""",
    _labelled,
)
add(
    "streak_of_dates",
    Q.Query("orders", (Q.Streak(ORDERS.ref("o_orderdate"), ORDERS.ref("o_orderdate"), ORDERS.ref("o_orderstatus"), "F"),)),
    """WITH d AS (SELECT strftime(CAST(o_orderdate AS TIMESTAMP), '%Y-%m-%dT%H:%M:%S.000') AS e, CAST(max(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS n FROM orders GROUP BY 1)
    SELECT e AS "entityId", e AS "entityLabel", n AS "currentStreak", n AS "longestStreak" FROM d""",
    as_of=day(2030, 1, 1),
)
_VIEWS = (where(SPANS, "event_type", Op.equals, enum("view")),)
add_spans("derived_of_nulls", Q.Query("spans", (measure(SPANS, "spent", Q.MAX, "top"),), _VIEWS, (at(SPANS, "ts", G.DAY),), derived=Q.CUMULATIVE_SUM), "SELECT date_trunc('day', ts) AS ts, CAST(NULL AS DOUBLE) AS top, false AS is_synthetic FROM spans WHERE event_type = 'view' GROUP BY 1")

# -- stored payloads: written as JSON, read again, run through the snapshot cache ----------------------------


def add_stored(name: str, payload: Q.Single | Q.Paired, mode: dates.DateRangeMode, sql: str, combine: Q.Combination | None = None, page: dates.DateRange | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        catalog = tables(sf_dir)
        stored, stored_mode = codec.encode_payload(payload), codec.encode_mode(mode)
        found = ok(catalog.run_payload(spark, codec.decode_payload(stored), codec.decode_mode(stored_mode), page, _TODAY, as_of=day(2024, 1, 25), cache=catalog.snapshots(spark, persist=False)))
        return found.df if combine is None else ok(algebra.combine(*found, combine)).df

    register(name, sql, run)


_CUSTOM = dates.CustomRange(day(2024, 1, 5), day(2024, 1, 14))
add_stored("stored_daily_custom", Q.Single(Q.Query("events", (count(),), group_bys=(at(EVENTS, "ts", G.DAY),))), dates.FixedOverride(_CUSTOM), _DAILY.format(first="2024-01-05", last="2024-01-14"))
add_stored("stored_daily_page", Q.Single(Q.Query("events", (count(),), group_bys=(at(EVENTS, "ts", G.DAY),))), dates.UsePageRange(), _DAILY.format(first="2024-01-05", last="2024-01-14"), page=_CUSTOM)
add_stored(
    "stored_table",
    Q.Single(
        Q.Query(
            "lineitem",
            (
                count(),
                Q.Transformed(measure(LINES, "l_quantity", Q.SUM, None), Q.ScalarOp(Q.Scalar.fillNull, 0), label="qty"),
                Q.Calculated(_PRICE, _QTY, Q.Combination.ratio, label="price"),
                measure(LINES, "l_discount", Q.percentile(0.75), "p75"),
            ),
            (where(LINES, "l_returnflag", Op.inList, enums(["A", "N"])), where(LINES, "l_quantity", Op.greaterThan, double(10.0))),
            by(LINES, "l_linestatus", "l_linenumber"),
            sort=Q.Sort(Q.ByMeasure("qty"), Q.Direction.descending),
            limit=5,
            having=Q.Having(Op.greaterThan, integer(0), "n"),
        )
    ),
    dates.FixedOverride(dates.CustomRange(day(1996, 3, 1), day(1999, 2, 28))),
    """SELECT l_linestatus, CAST(l_linenumber AS BIGINT) AS l_linenumber, count(*) AS n, round(sum(l_quantity), 4) AS qty, round(sum(l_extendedprice) / sum(l_quantity), 4) AS price, round(quantile_cont(l_discount, 0.75), 4) AS p75, false AS is_synthetic
    FROM lineitem WHERE l_returnflag IN ('A', 'N') AND l_quantity > 10.0 AND l_shipdate >= TIMESTAMP '1996-03-01' AND l_shipdate < TIMESTAMP '1999-03-01' GROUP BY 1, 2 ORDER BY sum(l_quantity) DESC, 1, 2 LIMIT 5""",
)
add_stored("stored_pair", Q.Paired(_daily("purchase", 0.0), _daily("view", 0.0)), dates.FixedOverride(dates.CustomRange(day(2024, 1, 5), day(2024, 1, 14))), SQL["paired_rate"], Q.Combination.ratio)
add_stored("stored_streak", Q.Single(_streak(None)), dates.NoDateRange(), _STREAK_SQL)

# -- checks, shapes and ranges as rows -----------------------------------------------------------------------


def add_rows(name: str, columns: Sequence[str], rows: Callable[[], list[tuple]], expected: list[tuple]) -> None:
    """What plain functions give, as a table of text beside the values that they should give."""
    values = ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in row) + ")" for row in expected)
    schema = ", ".join(f"{c} string" for c in columns)
    register(name, f"SELECT * FROM (VALUES {values}) AS t({', '.join(columns)})", lambda spark, sf_dir: spark.createDataFrame(rows(), schema))


_BY_DAY = (at(EVENTS, "ts", G.DAY),)
_BAD: dict[str, tuple[Q.Query, str]] = {
    "no measure": (Q.Query("events", ()), "measuresEmpty"),
    "unknown source": (Q.Query("nowhere", (count(),)), "unknownSource"),
    "sum of text": (Q.Query("events", (measure(EVENTS, "event_type", Q.SUM, "x"),)), "incompatibleAggregation"),
    "percentile above 1": (Q.Query("events", (measure(EVENTS, "value", Q.percentile(1.5), "x"),)), "invalidAggregationParameter"),
    "same label twice": (Q.Query("events", (count("x"), measure(EVENTS, "value", Q.SUM, "x"))), "duplicateMeasureLabel"),
    "order of text": (Q.Query("events", (count(),), (where(EVENTS, "event_type", Op.lessThan, enum("a")),)), "incompatibleOperator"),
    "two time axes": (Q.Query("events", (count(),), group_bys=(*_BY_DAY, at(EVENTS, "ts", G.MONTH))), "multipleTemporalGroupBys"),
    "four groups": (Q.Query("orders", (count(),), group_bys=by(ORDERS, "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")), "tooManyGroupBys"),
    "grain of a number": (Q.Query("events", (count(),), group_bys=(at(EVENTS, "value", G.DAY),)), "timeGrainOnNonDateField"),
    "window of 0": (Q.Query("events", (count(),), group_bys=_BY_DAY, derived=Q.moving_average(0)), "invalidDerivedOperationParameter"),
    "delta of dates": (Q.Query("events", (measure(EVENTS, "ts", Q.MAX, "x"),), group_bys=_BY_DAY, derived=Q.DELTA), "derivedOpRequiresNumericMeasure"),
    "sort of a scalar": (Q.Query("events", (count(),), sort=Q.Sort(Q.ByMeasure())), "incompatibleSortTarget"),
    "sort by no measure": (Q.Query("events", (count(),), group_bys=_BY_DAY, sort=Q.Sort(Q.ByMeasure("nope"))), "unknownMeasureLabel"),
    "having of a scalar": (Q.Query("events", (count(),), having=Q.Having(Op.equals, integer(1))), "havingRequiresGrouping"),
    "negative limit": (Q.Query("events", (count(),), group_bys=_BY_DAY, limit=-1), "preconditionViolation"),
    "streak beside a count": (Q.Query("events", (_streak(None).measures[0], count())), "streakNotCombinable"),
    "streak by day": (Q.Query("events", _streak(None).measures, group_bys=_BY_DAY), "streakWithExplicitGrouping"),
    "sum of days and number": (Q.Query("spans", (Q.Calculated(measure(SPANS, "clock", Q.SUM, None), Q.Count(), Q.Combination.sum, label="x"),)), "incompatibleSeriesCombination"),
}


def _verdicts() -> list[tuple]:
    return [(name, validate_query(query, (*TABLES, SPANS)).error.kind.value) for name, (query, _) in _BAD.items()]


add_rows("validation_errors", ("fault", "kind"), _verdicts, [(name, kind) for name, (_, kind) in _BAD.items()])
_SHAPED = {
    "scalar": Q.Query("events", (count(),)),
    "series": Q.Query("events", (count(),), group_bys=_BY_DAY),
    "multiSeries": Q.Query("events", (count(),), group_bys=(*_BY_DAY, *by(EVENTS, "event_type"))),
    "table": _streak(None),
}
add_rows("shapes", ("shape",), lambda: [(Q.shape_of(query).value,) for query in _SHAPED.values()], [(name,) for name in _SHAPED])
_RANGES = {
    "last7Days": ("2024-01-14", "2024-01-21"),
    "last14Days": ("2024-01-07", "2024-01-21"),
    "last30Days": ("2023-12-22", "2024-01-21"),
    "last90Days": ("2023-10-23", "2024-01-21"),
    "thisWeek": ("2024-01-14", "2024-01-21"),
    "thisMonth": ("2024-01-01", "2024-01-21"),
    "lastMonth": ("2023-12-01", "2024-01-01"),
    "quarterToDate": ("2024-01-01", "2024-01-21"),
    "allTime": ("2023-01-20", "2024-01-21"),
}


def _resolved() -> list[tuple]:
    """Each preset as a stored range, resolved on the 20th of January 2024."""
    found = {p.value: dates.resolve(codec.decode_range(codec.encode_range(dates.PresetRange(p))), _TODAY) for p in dates.Preset}
    return [(name, r.start.date().isoformat(), r.end.date().isoformat()) for name, r in found.items()]


add_rows("presets_resolved", ("preset", "first", "after"), _resolved, [(name, *ends) for name, ends in _RANGES.items()])
