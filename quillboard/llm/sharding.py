"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

The rows stand in physical partitions, gathered into at most `max_groups` groups. From the groups'
row counts and the shards' exact sizes (at most one row apart) a communication matrix is drawn: how
many rows each group sends to each shard, jointly hypergeometric, just as the counts of a uniform
permutation would be. Each group permutes its rows and deals them out by its row of the matrix (the
exchange); each shard then permutes what it received. Rows, shard and slot together are a uniform
random permutation of the table.

Draws follow the exact law at every size, as far as doubles resolve it: from 10^9 rows on, where numpy's
sampler ends, the distribution is inverted. Only (group, counts) reaches the driver: about `max_cells`
integers at most, whatever the input. Both permutations are split: the first by group, that is by
physical partition, the second into `pieces` of a shard by a keyed hash of the row's place, with prefix
sums over the pieces' counts. Since places, and not values, are dealt, no key, source or group of copies
makes one task larger than another.

The rows are written once to the shared checkpoint folder, so that a task that is run again sees the
same places. Edge cases: an empty table gives an empty result; nulls, ties and repeated rows are
rows like any other; more shards than rows leaves some shards empty; columns named shard or slot are
replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillboard.llm.common import cut

G, P, R, S, Q = "__qb_group", "__qb_place", "__qb_rank", "__qb_shard", "__qb_piece"


def communication_matrix(group_rows: list[int], shard_rows: list[int], seed: int) -> list[list[int]]:
    """Exact counts from each group to each shard; rows and columns sum to the two arguments."""
    rng = np.random.default_rng(seed)
    left = np.array(shard_rows, dtype=np.int64)
    matrix = []
    for n in group_rows:
        drawn = np.zeros_like(left)
        total, need = int(left.sum()), int(n)
        for j, have in enumerate(left.tolist()):  # one conditional hypergeometric draw for each shard
            if not need:
                break
            total -= have
            drawn[j] = _hypergeometric(rng, have, total, need)
            need -= int(drawn[j])
        left -= drawn
        matrix.append(drawn.tolist())
    return matrix


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """numpy takes fewer than 10^9 of each kind; beyond that, the distribution is inverted."""
    if bad == 0:
        return draws
    if good == 0:
        return 0
    if good < 10**9 and bad < 10**9:
        return int(rng.hypergeometric(good, bad, draws))
    return _inverted(rng, good, bad, draws)


def _inverted(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """A hypergeometric draw in double precision: a uniform number against the summed probabilities.

    They are built from the ratios of neighbours around the mean, as far as 12 standard deviations and 60
    more: beyond, Bernstein's bound is below 2^-53, which no uniform double resolves.
    """
    total = good + bad
    mean = draws * good / total
    wide = int(12 * (mean * (bad / total) * ((total - draws) / max(1, total - 1))) ** 0.5) + 60
    low = max(0, draws - bad, int(mean) - wide)
    k = np.arange(low, min(good, draws, int(mean) + wide), dtype=np.int64)
    steps = np.log((good - k) / (k + 1) * ((draws - k) / (bad - draws + k + 1)))
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    below = np.cumsum(np.exp(logs - logs.max()))
    return low + min(int(np.searchsorted(below, rng.random() * below[-1], side="right")), len(k))


def hypergeometric_shards(df: DataFrame, shards: int, seed: int = 0, max_groups: int = 2048, max_cells: int = 1 << 20, rows_per_piece: int = 200_000) -> DataFrame:
    """`df` with two more columns: shard (0..shards-1) and slot (gapless from 0 in each shard).

    The matrix has `max_groups` rows and about `max_cells` cells at most: with many shards, groups are fewer.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    most = max(1, min(max_groups, max_cells // shards))
    placed = cut(df.withColumn(P, F.monotonically_increasing_id()).withColumn(G, F.spark_partition_id()))
    # AQE may read the written rows in other partitions: the place that was written with a row holds
    placed = placed.withColumn(G, (F.col(G) % F.lit(most)).cast("int"))
    counted = {r[G]: r["n"] for r in placed.groupBy(G).agg(F.count(F.lit(1)).alias("n")).collect()}  # `most` rows
    groups = sorted(counted)
    n = sum(counted.values())
    sizes = [n // shards + (j < n % shards) for j in range(shards)]
    matrix = communication_matrix([counted[g] for g in groups], sizes, seed)
    # one row for each group meets rows that are dealt by group for their permutation anyway
    sent = df.sparkSession.createDataFrame([(g, np.cumsum(row).tolist()) for g, row in zip(groups, matrix, strict=True)], f"{G} int, __qb_ends array<bigint>")

    shuffled = Window.partitionBy(G).orderBy(F.xxhash64(F.lit(seed), F.lit(1), P), P)
    dealt = placed.withColumn(R, F.row_number().over(shuffled)).join(sent, G)
    dealt = dealt.withColumn(S, F.size(F.filter("__qb_ends", lambda end: end < F.col(R)))).drop("__qb_ends", R, G)

    pieces = max(1, -(-n // (shards * rows_per_piece)), -(-len(groups) * 2 // shards))
    dealt = dealt.withColumn(Q, F.pmod(F.xxhash64(F.lit(seed), F.lit(2), P), F.lit(pieces)).cast("int"))
    held = dealt.groupBy(S, Q).agg(F.count(F.lit(1)).alias("__qb_n"))
    before = Window.partitionBy(S).orderBy(Q).rowsBetween(Window.unboundedPreceding, -1)
    offsets = held.select(S, Q, F.coalesce(F.sum("__qb_n").over(before), F.lit(0)).alias("__qb_before"))
    final = Window.partitionBy(S, Q).orderBy(F.xxhash64(F.lit(seed), F.lit(3), P), P)
    out = dealt.withColumn(R, F.row_number().over(final)).join(offsets, [S, Q])
    columns = [F.col(f"`{c}`") for c in df.columns if c not in ("shard", "slot")]
    return out.select(*columns, F.col(S).cast("int").alias("shard"), (F.col("__qb_before") + F.col(R) - 1).cast("bigint").alias("slot"))
