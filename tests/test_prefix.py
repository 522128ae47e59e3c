"""Series and percentiles too large for one task: equal to the short way, whatever the parts."""

import random

import pytest
from pyspark.sql import functions as F

from quillboard.operators import algebra, prefix
from quillboard.plans import spec as Q
from quillboard.plans.compile import execute
from quillboard.schema import FieldType as T
from quillboard.sources.catalog import source

SALES = source("sales", None, shop=T.enumeration, n=T.integer, x=T.double, span=T.duration)
SCHEMA = "shop string, n bigint, x double, span bigint"
OPS = [Q.CUMULATIVE_SUM, Q.DELTA, Q.moving_average(1), Q.moving_average(50)]


@pytest.fixture(scope="module")
def sales(spark, tmp_path_factory):
    rng = random.Random(5)
    shops = [f"s{i:03}" for i in range(120)] + [None]
    rows = [(rng.choice(shops), rng.choice([None, *range(40)]), rng.choice([None, 0.25, rng.randrange(4000) / 8]), rng.randrange(10**7)) for _ in range(1500)]
    rows += [("hot", i % 7, float(i % 900), 5) for i in range(3000)]
    path = str(tmp_path_factory.mktemp("prefix") / "sales")
    spark.createDataFrame(rows, SCHEMA).write.parquet(path)  # files have a known size
    return spark.read.parquet(path)


@pytest.fixture
def both(monkeypatch):
    """What `make` gives by the short way, then by parts of few rows."""

    def go(make):
        def rows(df):
            return [tuple(float(f"{v:.12g}") if isinstance(v, float) else v for v in r) for r in df.collect()]

        short = rows(make())
        monkeypatch.setattr(prefix, "SMALL", -1)
        monkeypatch.setattr(prefix, "BLOCK", 7)
        long = make()
        assert rows(long) == short and short
        return long

    return go


def measure(field, agg, label):
    return Q.FieldMeasure(SALES.ref(field), agg, label=label)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("op", OPS, ids=lambda op: f"{op.kind.value}{op.window or ''}")
@pytest.mark.parametrize("field, sort", [("span", None), ("n", Q.Sort(Q.ByMeasure("m"), Q.Direction.descending))], ids=["by_key", "by_value"])
def test_derived_operations_by_parts(sales, both, op, field, sort):
    query = Q.Query("sales", (measure(field, Q.MAX, "m"),), group_bys=(Q.FieldGroupBy(SALES.ref("shop")),), sort=sort, derived=op)
    long = both(lambda: execute(query, sales, (SALES,)).value.df)
    assert "Window" in plan_of(long) and "__qb_part" in plan_of(long)


def test_no_window_holds_all_rows(spark, sales, monkeypatch):
    monkeypatch.setattr(prefix, "SMALL", -1)
    query = Q.Query("sales", (measure("n", Q.SUM, "m"),), group_bys=(Q.FieldGroupBy(SALES.ref("shop")),), derived=Q.CUMULATIVE_SUM)
    frame = execute(query, sales, (SALES,)).value.frame
    whole = plan_of(frame).split("Initial Plan")[0].splitlines()
    for i, line in enumerate(whole):
        if "SinglePartition" in line:  # one row of each task: does the series hold a value
            assert "partial_max" in whole[i + 1] or "HashAggregate" in whole[i + 1]


def test_held_series_by_parts(sales, both):
    query = Q.Query("sales", (measure("n", Q.SUM, "m"),), group_bys=(Q.FieldGroupBy(SALES.ref("shop")),), sort=Q.Sort(Q.ByMeasure("m"), Q.Direction.descending))

    def make():
        held = execute(query, sales, (SALES,)).value
        return algebra.Fluent(held).moving_average(3).cumulative_sum().combine_with(held, Q.Combination.difference, measure_label="gap").result.value.df

    both(make)


def test_percentiles_by_ranks(sales, both):
    wanted = [measure("n", Q.percentile(0.3), "a"), measure("x", Q.percentile(0.5), "b"), measure("span", Q.percentile(0.99), "d"), measure("x", Q.percentile(1.0), "e"), Q.Count(label="rows")]
    for keys in ((), (Q.FieldGroupBy(SALES.ref("shop")),)):
        short = execute(Q.Query("sales", tuple(wanted), group_bys=keys), sales, (SALES,)).value
        assert "percentile(" in plan_of(short.frame)
    both(lambda: execute(Q.Query("sales", tuple(wanted), group_bys=(Q.FieldGroupBy(SALES.ref("shop")),)), sales, (SALES,)).value.df)


@pytest.mark.parametrize("rows", ["all", "none", "nulls"])
def test_percentile_of_everything(sales, both, rows):
    given = sales if rows == "all" else sales.where("false") if rows == "none" else sales.withColumn("x", F.lit(None).cast("double"))
    query = Q.Query("sales", (measure("x", Q.percentile(0.75), "p"), measure("x", Q.percentile(0.0), "low")))
    long = both(lambda: execute(query, given, (SALES,)).value.df)
    assert "percentile(" not in plan_of(long)


def test_running_totals_of_ties_and_of_nothing(spark):
    rows = spark.range(500).select("id", (F.col("id") % 3).alias("v")).repartition(5)
    got = prefix.running(rows, [F.desc("id")], {"upto": F.col("v")}).collect()
    assert {r.id: r.upto for r in got} == {i: sum(j % 3 for j in range(i, 500)) for i in range(500)}
    assert prefix.running(rows.where("false"), [F.asc("id")], {"upto": F.col("v")}).count() == 0
