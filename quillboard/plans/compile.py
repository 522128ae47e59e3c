"""Compiles a checked query to one lazy frame.

Filter, aggregate the distinct leaves of all measures once, complete the grid on the aggregated frame,
then project measures, HAVING, sort, limit and the derived operation. Expressions are projected after
the grid, so that a synthetic cell holds the value that they have over no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillboard.errors import Err, ErrorKind, Failure, Ok, attempt
from quillboard.functions.dates import Range
from quillboard.functions.grain import DAYS, MICROS, MONTHS
from quillboard.operators import aggregate as A
from quillboard.operators import derived as D
from quillboard.operators import prefix as P
from quillboard.operators import streak as S
from quillboard.operators.densify import SYNTHETIC, Axis, fill
from quillboard.plans import spec as Q
from quillboard.plans.validate import MAX_DEPTH, check_query, target_measure
from quillboard.results import Result, ResultColumn
from quillboard.schema import FieldType, SourceDef, column_of


def declared(df: DataFrame, source: SourceDef) -> DataFrame:
    """The source's declared columns in the plan's types; others are not read."""
    columns = []
    for f in source.fields:
        column = column_of(f, df.schema)
        if column is None:
            raise Failure(ErrorKind.sourceRecordTypeMismatch, f"{f.field_id} is {df.schema[f.field_id].dataType.simpleString()}, declared {f.field_type.value}", f.ref)
        columns.append(column)
    return df.select(*columns)


def execute(
    query: Q.Query,
    df: DataFrame,
    sources: Sequence[SourceDef],
    as_of: datetime | None = None,
    date_range: Range | None = None,
    densify: bool = True,
    max_depth: int = MAX_DEPTH,
    input_order: Column | None = None,
) -> Ok | Err:
    """Ok(Result) or Err(AnalyticsError); starts no job.

    date_range sets the buckets of a time axis; it does not filter rows (see `dates.project`).
    """
    return attempt(lambda: build(query, df, sources, as_of, date_range, densify, max_depth, input_order))


def build(query: Q.Query, df: DataFrame, sources: Sequence[SourceDef], as_of: datetime | None, date_range: Range | None, densify: bool, max_depth: int, input_order: Column | None) -> Result:
    source = check_query(query, sources, max_depth)
    rows = declared(df, source)
    if isinstance(query.measures[0], Q.Streak):
        return _streak(query.measures[0], rows, source, as_of, input_order)
    leaves = {A.leaf_key(leaf): leaf for m in query.measures for leaf in A.leaves(m)}
    names = {key: f"__l{i}" for i, key in enumerate(leaves)}
    rows = rows.where(A.all_of(query.filters)) if query.filters else rows
    labels = Q.measure_labels(query.measures)
    types = [m.output(source) for m in query.measures]
    measured = [A.expression(m, names, source).alias(label) for m, label in zip(query.measures, labels, strict=True)]
    columns = [ResultColumn(label, t, False) for label, t in zip(labels, types, strict=True)]
    shape = Q.shape_of(query)
    if not query.group_bys:
        return Result(shape, _aggregated(rows, {}, leaves, names, source).select(*measured), tuple(columns))

    keys = [f"__k{i}" for i in range(len(query.group_bys))]
    grouped = _aggregated(rows, {k: _key(g) for g, k in zip(query.group_bys, keys, strict=True)}, leaves, names, source)
    if densify:
        axis = next((Axis(i, g.grain, date_range.start, date_range.end) for i, g in enumerate(query.group_bys) if isinstance(g, Q.TimeGroupBy)), None) if date_range else None
        grid = fill(grouped, keys, {names[key]: A.zero(leaf, source) for key, leaf in leaves.items()}, axis)
    else:
        grid = grouped.withColumn(SYNTHETIC, F.lit(False))
    named = [F.col(k).alias(g.column) for g, k in zip(query.group_bys, keys, strict=True)]
    out = grid.select(*named, *measured, SYNTHETIC)
    key_columns = [ResultColumn(g.column, source.field(g.field.field_id).field_type, True) for g in query.group_bys]
    if query.having is not None:
        label = labels[target_measure(query, query.having.measure_label)]
        out = out.where(_having(F.col(f"`{label}`"), query.having))
    order = _order(query, labels)
    if query.limit is not None:
        out = out.orderBy(*order).limit(query.limit)
    kind = None
    if len(query.group_bys) == 1:
        kind = "temporal" if isinstance(query.group_bys[0], Q.TimeGroupBy) else "categorical"
    if query.derived.kind is not Q.Derive.none:
        t = D.output_type(query.derived, types[0])
        out = D.derive(out, labels[0], query.derived, types[0], order, "__derived", _short(query, date_range if densify else None))
        out = out.withColumn("__before", F.col(f"`{labels[0]}`"))
        out = out.withColumn(labels[0], F.col("__derived"))
        if isinstance(query.sort and query.sort.target, Q.ByMeasure):  # the order is that of the values before
            order = _order(query, ["__before"])
        columns = [ResultColumn(labels[0], t, False)]
    return Result(shape, out, (*key_columns, *columns), tuple(order), kind)


def _aggregated(rows: DataFrame, keys: dict[str, Column], leaves: dict[tuple, Q.Measure], names: dict[tuple, str], source: SourceDef) -> DataFrame:
    """The leaves over the rows of each combination of keys: one aggregation.

    Percentiles of a source that is not known to be small are taken apart, by ranks, as a buffer would have to
    hold all distinct values of a group.
    """
    apart = {key: leaf for key, leaf in leaves.items() if A.is_percentile(leaf)}
    if apart and P.small(rows):
        apart = {}
    plain = [A.aggregate(leaf, source).alias(names[key]) for key, leaf in leaves.items() if key not in apart]
    found = rows.groupBy(*[c.alias(k) for k, c in keys.items()]).agg(*(plain or [F.count(F.lit(1)).alias("__n")]))
    for field_id in dict.fromkeys(leaf.field.field_id for leaf in apart.values()):
        mine = {key: leaf for key, leaf in apart.items() if leaf.field.field_id == field_id}
        values = rows.select(*[c.alias(k) for k, c in keys.items()], F.col(f"`{field_id}`").alias("__value"))
        ranked = P.percentiles(values, list(keys), "__value", {names[key]: leaf.aggregation.p for key, leaf in mine.items()})
        ranked = ranked.select(*[F.col(k).alias(f"{k}_p") for k in keys], *[A.percentile_value(F.col(names[key]), leaf, source).alias(names[key]) for key, leaf in mine.items()])
        if keys:
            match = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{k}_p")) for k in keys])
            found = found.join(ranked, match, "left").drop(*[f"{k}_p" for k in keys])
        else:
            found = found.crossJoin(ranked)  # one row each
    return found


#: Buckets of a series up to which one window takes it.
SHORT = 4_000_000


def _short(query: Q.Query, date_range: Range | None) -> bool:
    """Is the number of buckets bounded beforehand: by a limit, a range, or a grain of a day or more?"""
    if query.limit is not None and query.limit <= SHORT:
        return True
    g = query.group_bys[0]
    if not isinstance(g, Q.TimeGroupBy):
        return False
    if g.grain.unit in DAYS or g.grain.unit in MONTHS:
        return True  # 9,999 years have 3.7 million days
    return date_range is not None and (date_range.end - date_range.start) // (g.grain.count * MICROS[g.grain.unit] * timedelta(microseconds=1)) < SHORT


def _key(g: Q.GroupBy) -> Column:
    column = F.col(f"`{g.field.field_id}`")
    return g.grain.column(column) if isinstance(g, Q.TimeGroupBy) else column


def _having(measure: Column, having: Q.Having) -> Column:
    if having.threshold.is_list:  # passes the type check, then matches nothing
        return F.lit(False)
    bound = having.threshold.lit()
    plain = {Q.Op.equals: lambda: measure == bound, Q.Op.notEquals: lambda: measure != bound}
    return plain[having.op]() if having.op in plain else A.compare(measure, having.op, bound)


def _order(query: Q.Query, labels: list[str]) -> list[Column]:
    """The user's sort, then all keys ascending with nulls last."""
    order = []
    if query.sort is not None:
        target = query.sort.target
        if isinstance(target, Q.ByGroup):
            name = next(g.column for g in query.group_bys if g.field == target.field)
        else:
            name = labels[target_measure(query, target.measure_label)] if len(labels) == len(query.measures) else labels[0]
        column = F.col(f"`{name}`")
        if query.sort.direction is Q.Direction.ascending:
            order.append(column.asc_nulls_last())
        else:
            order.append(column.desc_nulls_last() if query.sort.force_nulls_last else column.desc_nulls_first())
    return [*order, *(F.col(f"`{g.column}`").asc_nulls_last() for g in query.group_bys)]


def _streak(m: Q.Streak, rows: DataFrame, source: SourceDef, as_of: datetime | None, input_order: Column | None) -> Result:
    """A streak reads all rows of its source: filters do not apply to it."""
    if as_of is None:
        raise Failure(ErrorKind.preconditionViolation, "a streak needs as_of")
    found = S.streaks(rows, m, source, as_of, input_order)
    columns = (
        ResultColumn("entityId", FieldType.string, True),
        ResultColumn("entityLabel", FieldType.string, False),
        ResultColumn("currentStreak", FieldType.integer, False),
        ResultColumn("longestStreak", FieldType.integer, False),
    )
    kept = found if m.top_n is None else found.orderBy(*S.ordering()).limit(m.top_n)
    return Result(Q.Shape.table, kept, columns, tuple(S.ordering()), truncation=None if m.top_n is None else (found, m.top_n))
