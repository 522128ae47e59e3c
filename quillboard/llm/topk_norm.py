"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are grouped by length: a range exchange on (dimension, length, place) sorts them, longest first,
and each run of at most `bucket_rows` vectors of one dimension, no shorter than 0.9 of the run's first,
is a bucket. A query needs a product of at least its running k-th best, theta; in a bucket whose longest
vector is l that is a cosine of at least theta / (|q| l), its local threshold:

- above 1, or where the bucket's box of coordinates holds no product of theta, no vector can matter;
- below `switch`, the bucket is pruned by length: only its first vectors, with |p| >= theta / |q|;
- else by coordinates: a unit vector of cosine >= t to q has its coordinate f within
  q_f t +- sqrt((1 - t^2)(1 - q_f^2)); sorted lists of q's largest coordinates give the feasible ranges,
  the shortest is read and the others are tested on it.

What is left is verified by its integer product. Bounds carry a slack above the rounding error, so the
result is exact, ties included (smaller id first).

Queries are a stated set; they are taken in blocks of bounded size, one broadcast each, against all rows:
the work of an exact search grows with queries times rows, less what the bounds prune.
theta starts from the k-th best product with a bounded sample of rows and rises as buckets are read; the
k best of each partition and query meet in a window. Nothing else leaves the executors.

Components are floor(scale * x), x as double. Vectors that are null or hold null or non-finite
components take no part. Only vectors of equal dimension are compared. A query's own row is no
candidate, but another row with its id is; rows that repeat a query id are queries of their own. A
query with fewer candidates than k returns all. Products beyond 64 bits are cut to the nearest long. An
empty table, or one without queries, gives an empty result. Extra columns are not read, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillboard.llm.common import cut, small_batches

EXACT = float(1 << 53)


def integer_vectors(column: pa.Array, scale: float) -> list[np.ndarray | None]:
    """floor(scale * x) of each vector as doubles; None where a vector takes no part."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    out: list[np.ndarray | None] = []
    offsets = column.offsets.to_numpy()
    flat = column.values
    null_at = np.asarray(flat.is_null()) if flat.null_count else None
    values = np.floor(scale * flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False))
    valid = np.asarray(column.is_valid())
    for i in range(len(column)):
        part = values[offsets[i] : offsets[i + 1]]
        ok = valid[i] and np.isfinite(part).all() and (null_at is None or not null_at[offsets[i] : offsets[i + 1]].any())
        out.append(part if ok else None)
    return out


def products(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Exact integer inner products as int64, one row for each query."""
    if not rows.size or not queries.size or np.abs(rows).max() * np.abs(queries).max() * rows.shape[1] < EXACT:
        return (queries @ rows.T).astype(np.int64)
    top = (1 << 63) - 1
    left = [[int(x) for x in q] for q in queries]
    right = [[int(x) for x in row] for row in rows]
    return np.array([[max(-top - 1, min(top, sum(x * y for x, y in zip(row, q, strict=True)))) for row in right] for q in left], dtype=np.int64).reshape(len(left), len(right))


def at_most(theta: np.ndarray) -> np.ndarray:
    """Doubles not above the integers they were rounded from."""
    return np.where(np.abs(theta) < EXACT, theta, np.nextafter(theta, -np.inf))


class Best:
    """The k best (score, id, place) of every query of a block."""

    def __init__(self, k: int, theta: np.ndarray):
        self.k, self.theta, self.held = k, theta.copy(), [None] * len(theta)

    def add(self, i: int, score: np.ndarray, ids: np.ndarray, places: np.ndarray) -> None:
        ok = score >= self.theta[i]
        if not ok.any():
            return
        score, ids, places = score[ok], ids[ok], places[ok]
        if self.held[i] is not None:
            score, ids, places = (np.concatenate(x) for x in zip(self.held[i], (score, ids, places), strict=True))
        order = np.lexsort((places, ids, -score.astype(np.float64), np.negative(score)))[: self.k]
        self.held[i] = score[order], ids[order], places[order]
        if len(order) == self.k:
            self.theta[i] = max(self.theta[i], float(at_most(np.float64(score[order[-1]]))))


def search_bucket(best: Best, queries: np.ndarray, lengths: np.ndarray, own: np.ndarray, rows: np.ndarray, norms: np.ndarray, ids: np.ndarray, places: np.ndarray, switch: float, focus: int) -> None:
    """One bucket (rows by falling norm) against all queries of its dimension."""
    longest = float(norms[0])
    with np.errstate(divide="ignore", invalid="ignore"):
        local = np.where(lengths * longest > 0, best.theta / (lengths * longest), np.where(best.theta > 0, np.inf, -1.0))
    alive = np.flatnonzero(local <= 1 + 1e-9)
    if not len(alive):
        return
    # a product is at most that with the corner of the bucket's box that the query points to
    corner = np.maximum(queries[alive], 0) @ rows.max(axis=0) + np.minimum(queries[alive], 0) @ rows.min(axis=0)
    alive = alive[corner + 1e-9 * np.abs(corner) + 1 >= best.theta[alive]]
    _verify_prefixes(best, alive[local[alive] < switch], queries, lengths, local, own, rows, norms, ids, places)
    late = alive[local[alive] >= switch]
    if not len(late):
        return
    unit = rows / np.where(norms > 0, norms, 1.0)[:, None]
    sorted_lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    wide = []
    for i in late:
        t, u = min(1.0, float(local[i])) * (1 - 1e-9), queries[i] / lengths[i]
        ranges = []
        for f in np.argsort(-np.abs(u))[:focus]:
            if f not in sorted_lists:
                order = np.argsort(unit[:, f], kind="stable")
                sorted_lists[f] = order, unit[order, f]
            reach = np.sqrt(max(0.0, (1 - t * t) * (1 - u[f] * u[f]))) + 1e-7
            values = sorted_lists[f][1]
            # a vector shorter than the bucket's first needs a higher cosine, so these bounds hold for it too;
            # at cosines above t the range's near end does not move inwards past u_f itself
            lo, hi = u[f] * t - reach, u[f] * t + reach
            if u[f] >= t:
                hi = 1.0 + 1e-7
            if -u[f] >= t:
                lo = -1.0 - 1e-7
            a, b = np.searchsorted(values, (lo, hi))
            ranges.append((int(b - a), int(a), int(b), int(f), lo, hi))
        ranges.sort()
        many, a, b, f, _, _ = ranges[0]
        if many > len(rows) // 8:  # reading so many rows one by one costs more than all products
            wide.append(i)
            continue
        take = sorted_lists[f][0][a : b + 1]
        for _, _, _, g, lo, hi in ranges[1:]:
            if not len(take):
                break
            value = unit[take, g]
            take = take[(value >= lo) & (value <= hi)]
        take = take[places[take] != own[i]]
        if len(take):
            best.add(i, products(rows[take], queries[i : i + 1])[0], ids[take], places[take])
    _verify_prefixes(best, np.array(wide, dtype=np.int64), queries, lengths, local, own, rows, norms, ids, places)


def _verify_prefixes(best: Best, some: np.ndarray, queries: np.ndarray, lengths: np.ndarray, local: np.ndarray, own: np.ndarray, rows: np.ndarray, norms: np.ndarray, ids: np.ndarray, places: np.ndarray) -> None:
    """Queries pruned by length: the products with the rows that are long enough, many queries together."""
    for at in range(0, len(some), 256):
        part = some[at : at + 256]
        least = np.where(local[part] > 0, best.theta[part] / np.where(lengths[part] > 0, lengths[part], 1.0), 0.0) * (1 - 1e-9)
        many = np.where(local[part] > 0, np.searchsorted(-norms, -least, "right"), len(norms))
        found = products(rows[: many.max()], queries[part])
        one, row = np.nonzero(found >= best.theta[part, None])
        ok = (row < many[one]) & (places[row] != own[part[one]])
        one, row = one[ok], row[ok]
        edges = np.searchsorted(one, np.arange(len(part) + 1))
        for i in np.flatnonzero(np.diff(edges)):
            take = row[edges[i] : edges[i + 1]]
            best.add(part[i], found[i, take], ids[take], places[take])


def buckets(dims: np.ndarray, norms: np.ndarray, bucket_rows: int) -> Iterator[tuple[int, int]]:
    start = 0
    while start < len(norms):
        stop = start + 1
        limit = min(len(norms), start + bucket_rows)
        same = (dims[start:limit] == dims[start]) & (norms[start:limit] >= 0.9 * norms[start])
        stop = start + int(same.argmin()) if not same.all() else limit
        yield start, stop
        start = stop


def query_blocks(asked: DataFrame, n: int, block_queries: int, block_bytes: int) -> tuple[DataFrame, int]:
    """The queries (id, place, dim, v) with their block, and how many blocks there are.

    Blocks go by a hash of the place and are made smaller until the largest holds less than 1.2 times
    `block_queries` and `block_bytes`, or a single query.
    """
    blocks = -(-n // block_queries)
    while True:
        dealt = asked.withColumn("block", F.pmod(F.xxhash64(F.lit(31), "place"), F.lit(blocks)))
        sizes = dealt.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.sum(8 * F.col("dim").cast("bigint")).alias("bytes"))
        rows, size = sizes.where("n > 1").agg(F.max("n"), F.max("bytes")).first()
        if (rows or 0) <= 1.2 * block_queries and (size or 0) <= 1.2 * block_bytes:
            return cut(dealt.select("block", "id", "place", "v")), blocks
        blocks *= 2


def top_k(
    df: DataFrame,
    is_query: Column,
    k: int = 5,
    scale: float = 256.0,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    block_queries: int = 2048,
    bucket_rows: int = 8192,
    block_bytes: int = 1 << 26,
    sample_rows: int = 4096,
    switch: float = 0.8,
    focus: int = 4,
) -> DataFrame:
    """query_id, rank (from 1), `id_col`, score of the k best rows for every row where is_query holds."""
    spark = df.sparkSession
    source = df.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{vector_col}`").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).where("id IS NOT NULL")

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1):
            found = integer_vectors(batch.column(1), scale)
            keep = np.array([x is not None for x in found], dtype=bool)
            kept = [x for x in found if x is not None]
            sizes = np.array([len(x) for x in kept], dtype=np.int32)
            flat = np.concatenate(kept) if kept else np.zeros(0)
            vectors = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat))
            norms = np.array([np.sqrt(np.dot(x, x)) for x in kept])
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(2).filter(mask), pa.array(sizes), pa.array(norms, pa.float64()), vectors], names=["id", "q", "dim", "norm", "v"])

    parsed = source.mapInArrow(prepare, "id bigint, q boolean, dim int, norm double, v array<double>")
    placed = cut(parsed.withColumn("place", F.monotonically_increasing_id()))
    n, n_queries = placed.agg(F.count(F.lit(1)), F.count(F.when(F.col("q"), 1))).first()
    empty = spark.createDataFrame([], "query_id bigint, rank int, id bigint, score bigint").withColumnRenamed("id", id_col)
    if not n_queries:
        return empty
    parts = max(spark.sparkContext.defaultParallelism * 2, -(-n // 50_000))
    ranged = cut(placed.repartitionByRange(parts, "dim", F.col("norm").desc(), "place").sortWithinPartitions("dim", F.col("norm").desc(), "place"))
    share = min(1.0, sample_rows / n)
    sample = placed.where(F.pmod(F.xxhash64(F.lit(23), "place"), F.lit(1_000_000)) < share * 1_000_000).select("id", "place", "v").toArrow()
    by_dim: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    if sample.num_rows:
        vectors = [np.asarray(x) for x in sample.column("v").to_pylist()]
        places = np.array(sample.column("place").to_pylist(), dtype=np.int64)
        for dim in {len(x) for x in vectors}:
            at = [i for i, x in enumerate(vectors) if len(x) == dim]
            by_dim[dim] = np.stack([vectors[i] for i in at]).reshape(len(at), dim), places[at]

    asked, n_blocks = query_blocks(placed.where("q"), n_queries, block_queries, block_bytes)

    def one_block(b: int) -> DataFrame:
        got = asked.where(F.col("block") == b).select("id", "place", "v").toArrow()  # at most block_queries and block_bytes, as measured
        vectors = [np.asarray(x, dtype=np.float64) for x in got.column("v").to_pylist()]
        q_ids, q_places = got.column("id").to_numpy().copy(), got.column("place").to_numpy().copy()
        groups = {}
        for dim in {len(x) for x in vectors}:
            at = np.array([i for i, x in enumerate(vectors) if len(x) == dim])
            rows = np.stack([vectors[i] for i in at]).reshape(len(at), dim)
            theta = np.full(len(at), -np.inf)
            if dim in by_dim:
                known, known_places = by_dim[dim]
                if len(known) > k:  # one of them may be the query itself
                    for a in range(0, len(at), 256):
                        found = products(known, rows[a : a + 256]).astype(np.float64)
                        found[known_places == q_places[at[a : a + 256], None]] = -np.inf
                        theta[a : a + 256] = at_most(np.partition(found, len(known) - k, axis=1)[:, len(known) - k])
            groups[dim] = q_ids[at], q_places[at], rows, np.sqrt((rows * rows).sum(axis=1)), theta
        shared = spark.sparkContext.broadcast(groups)

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = {dim: Best(k, g[4]) for dim, g in shared.value.items()}
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids, places, norms = (batch.column(c).to_numpy() for c in (0, 1, 2))
                column = batch.column(3)
                offsets, flat = column.offsets.to_numpy(), column.values.to_numpy()
                dims = np.diff(offsets)
                for a, z in buckets(dims, norms, bucket_rows):
                    dim = int(dims[a])
                    if dim in best:
                        _, own, queries, lengths, _ = shared.value[dim]
                        rows = flat[offsets[a] : offsets[z]].reshape(z - a, dim)
                        search_bucket(best[dim], queries, lengths, own, rows, norms[a:z], ids[a:z], places[a:z], switch, focus)
            for dim, found in best.items():
                asked_ids, own, _, _, _ = shared.value[dim]
                some = [i for i, x in enumerate(found.held) if x is not None]
                if some:
                    many = [len(found.held[i][0]) for i in some]
                    columns = [np.repeat(asked_ids[some], many), np.repeat(own[some], many), *(np.concatenate([found.held[i][c] for i in some]) for c in (1, 2, 0))]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["query_id", "query_place", "id", "place", "score"])

        rows = ranged.select("id", "place", "norm", "v")
        return rows.mapInArrow(search, "query_id bigint, query_place bigint, id bigint, place bigint, score bigint")

    done = []
    for first in range(0, n_blocks, 8):
        some = reduce(DataFrame.unionAll, [one_block(b) for b in range(first, min(first + 8, n_blocks))])
        done.append(some if n_blocks <= 8 else cut(some))
    order = Window.partitionBy("query_place").orderBy(F.col("score").desc(), "id", "place")
    ranked = reduce(DataFrame.unionAll, done).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")
