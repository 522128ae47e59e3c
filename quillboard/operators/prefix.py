"""Running totals, places, percentiles and halos over a total order, none of which needs one task for all rows.

The rows are dealt by ranges of the order. Each range's last row carries the range's totals to all later
ranges, where they are added; so ranges are cut once, and results do not depend on where.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Estimated bytes up to which one task or one buffer takes a whole series or column. Both ways are exact.
SMALL = 64 << 20
#: Ranges at most; the carried rows are half of the square of their number.
RANGES = 1_000
#: Rows of a block that a lag or a moving frame works on.
BLOCK = 1 << 16

_ID, _PART, _SEEN, _OWN = "__qb_id", "__qb_part", "__qb_seen", "__qb_own"


def small(df: DataFrame, product: bool = False) -> bool:
    """Is the estimated size of what the plan reads within SMALL? No job runs; without an estimate, no.

    product: the plan multiplies rows, so the estimate of its result counts, which multiplies over all joins.
    """
    jvm = getattr(df, "_jdf", None)
    if jvm is None:
        return False
    plan = jvm.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves()
    read = [plan] if product else [leaves.apply(i) for i in range(leaves.size())]
    return sum(int(str(p.stats().sizeInBytes())) for p in read) <= SMALL


def running(df: DataFrame, order: list[Column], totals: dict[str, Column]) -> DataFrame:
    """The rows with each total's sum over all rows up to theirs. The order must tell all rows apart.

    Totals are sums of non-null numbers. Three exchanges of the rows, none of them by a key of the data.
    """
    ranges = max(1, min(RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    local = {name: f"__qb_local_{i}" for i, name in enumerate(totals)}
    dealt = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    placed = dealt.select("*", *[totals[n].alias(c) for n, c in local.items()], F.monotonically_increasing_id().alias(_ID))
    placed = placed.withColumn(_PART, F.shiftright(_ID, 33).cast("int"))
    line = Window.partitionBy(_PART).orderBy(_ID)
    upto = line.rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.select("*", *[F.sum(c).over(upto).alias(f"{c}_upto") for c in local.values()], F.lead(_ID).over(line).isNull().alias("__qb_last"))
    part = F.col(_PART)
    later = F.when(F.col("__qb_last") & (part < ranges - 1), F.sequence(part + 1, F.lit(ranges - 1))).otherwise(F.array().cast("array<int>"))
    sent = summed.withColumn(_SEEN, F.explode(F.concat(F.array(part), later))).withColumn(_OWN, F.col(_SEEN) == part)
    whole = Window.partitionBy(_SEEN)
    before = [F.sum(F.when(~F.col(_OWN), F.col(f"{c}_upto"))).over(whole).alias(f"{c}_before") for c in local.values()]
    kept = sent.select("*", *before).where(_OWN)
    found = [(F.coalesce(F.col(f"{c}_before"), F.lit(0)) + F.col(f"{c}_upto")).alias(n) for n, c in local.items()]
    return kept.select(*[F.col(f"`{c}`") for c in df.columns if c not in totals], *found)


def placed(df: DataFrame, order: list[Column], name: str, product: bool = False) -> DataFrame:
    """The rows with their place in the total order, from 1."""
    if small(df, product):
        return df.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("bigint"))
    return running(df, order, {name: F.lit(1).cast("bigint")})


def moving(df: DataFrame, order: list[Column], back: int, name: str, of) -> DataFrame:
    """`of(window)` as a column, over windows that hold at least `back` rows before each row.

    Blocks of rows are worked on apart; each also gets the last `back` rows of the block before it.
    """
    block = max(BLOCK, back)
    ranked = running(df, order, {"__qb_place": F.lit(1).cast("bigint")})
    at = F.col("__qb_place") - 1
    home = F.floor(at / block).cast("bigint")
    tail = at % block >= block - back
    sent = ranked.withColumn(_SEEN, F.explode(F.when(tail, F.array(home, home + 1)).otherwise(F.array(home)))).withColumn(_OWN, F.col(_SEEN) == home)
    found = sent.withColumn(name, of(Window.partitionBy(_SEEN).orderBy("__qb_place"))).where(_OWN)
    return found.drop("__qb_place", _SEEN, _OWN)


def percentiles(rows: DataFrame, keys: list[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """For each combination of keys, exact interpolated percentiles of the non-null values, by name.

    Equal values are counted first; what is ordered is distinct values, whatever the rows of a group.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__qb_n"))
    order = [*(F.asc(k) for k in keys), F.asc(value)]
    upto = running(counted, order, {"__qb_upto": F.col("__qb_n")})
    first = F.col("__qb_upto") - F.col("__qb_n")
    spans = upto.groupBy(*[F.col(k).alias(f"{k}_g") for k in keys]).agg(F.min(first).alias("__qb_start"), F.sum("__qb_n").alias("__qb_rows"))
    if keys:
        match = F.lit(True)
        for k in keys:
            match = match & F.col(k).eqNullSafe(F.col(f"{k}_g"))
        joined = upto.join(spans, match)
    else:
        joined = upto.crossJoin(F.broadcast(spans))  # one row
    begin, end = first - F.col("__qb_start"), F.col("__qb_upto") - F.col("__qb_start")
    sides, ends = [], []
    for i, p in enumerate(wanted.values()):
        place = (F.col("__qb_rows") - 1) * F.lit(float(p))
        for side, rank in (("low", F.floor(place)), ("high", F.ceil(place))):
            sides.append((begin <= rank) & (rank < end))
            ends.append(F.max(F.when(sides[-1], F.col(value).cast("double"))).alias(f"__qb_{side}{i}"))
        ends.append(F.max(place).alias(f"__qb_at{i}"))
    hit = sides[0]
    for s in sides[1:]:
        hit = hit | s
    found = joined.where(hit).groupBy(*keys).agg(*ends)
    columns = []
    for i, name in enumerate(wanted):
        low, high, at = F.col(f"__qb_low{i}"), F.col(f"__qb_high{i}"), F.col(f"__qb_at{i}")
        between = (F.ceil(at) - at) * low + (at - F.floor(at)) * high
        columns.append(F.when(low.eqNullSafe(high), low).otherwise(between).alias(name))
    return found.select(*keys, *columns)
