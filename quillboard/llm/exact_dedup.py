"""Exact deduplication: group by a 128-bit content hash, compare bytes inside groups, keep one row.

Texts are equal when their normalised UTF-8 bytes are equal; null counts as the empty text. The
keeper of a group is its smallest or largest id. Rows are narrowed to (id, hash, digest) before the
first shuffle and pre-aggregated per task, so a group holding a third of all rows costs one partial
row per task. Only texts of groups with two or more rows are read again, to compare bytes: a group
whose smallest and largest text differ is a hash collision and is split by the texts themselves.

Edge cases: null text = empty text; a null id is dropped in favour of any non-null id and stays only
where its whole group has none; rows that repeat both id and text carry the same decision (and
`survivors` returns one of them); an empty table gives an empty result; extra columns are ignored by
`exact_groups` and carried unchanged by `survivors`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillboard.llm.common import cut, maybe_broadcast

H, T, I = "__qb_hash", "__qb_text", "__qb_id"


def content_hash(text: Column) -> Column:
    """The default 128-bit content hash, as 16 bytes."""
    return F.unhex(F.md5(text.cast("binary")))


def _groups(df: DataFrame, id_col: str, text_col: str, keep: str, hashed: Callable, normalise: Callable):
    """(rows with hash, narrow rows, repeated groups, their number, split groups of collided hashes or None)."""
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    pick = F.min if keep == "smallest" else F.max
    text = normalise(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    rows = df.select(F.col(f"`{id_col}`").alias(I), text.alias(T)).withColumn(H, hashed(F.col(T)))
    narrow = cut(rows.select(I, H, F.sha2(F.col(T).cast("binary"), 256).alias("text_sha256")))
    groups = cut(narrow.groupBy(H).agg(F.count(F.lit(1)).alias("group_size"), pick(I).alias("keep_id")).where("group_size > 1"))
    n = groups.count()
    split = None
    if n:
        repeated = rows.join(maybe_broadcast(groups.select(H), n), H)
        bounds = repeated.groupBy(H).agg(F.min(T).alias("lo"), F.max(T).alias("hi"))
        collided = cut(bounds.where("lo <> hi").select(H))
        if not collided.isEmpty():
            split = cut(rows.join(collided, H).groupBy(H, T).agg(F.count(F.lit(1)).alias("group_size"), pick(I).alias("keep_id")))
            groups = cut(groups.join(collided, H, "left_anti"))
    return rows, narrow, groups, n, split


def exact_groups(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    hashed: Callable[[Column], Column] = content_hash,
    normalise: Callable[[Column], Column] = lambda text: text,
) -> DataFrame:
    """One row per input row: `id_col`, keep_id, group_size, kept, text_sha256."""
    rows, narrow, groups, n, split = _groups(df, id_col, text_col, keep, hashed, normalise)
    if split is not None:
        heads = split.select(H).distinct()
        apart = rows.join(heads, H).join(split, [H, T]).select(I, "keep_id", "group_size", F.sha2(F.col(T).cast("binary"), 256).alias("text_sha256"))
        narrow = narrow.join(heads, H, "left_anti")
    out = narrow.join(maybe_broadcast(groups, n), H, "left").select(
        I,
        F.when(F.col("group_size").isNull(), F.col(I)).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"),
        "text_sha256",
    )
    if split is not None:
        out = out.unionByName(apart)
    return out.select(F.col(I).alias(id_col), "keep_id", "group_size", F.col("keep_id").eqNullSafe(F.col(I)).alias("kept"), "text_sha256")


def survivors(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    hashed: Callable[[Column], Column] = content_hash,
    normalise: Callable[[Column], Column] = lambda text: text,
) -> DataFrame:
    """The input's columns, one row for each distinct text."""
    _, narrow, groups, n, split = _groups(df, id_col, text_col, keep, hashed, normalise)
    if not n:
        return df
    text = normalise(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    heads = groups.select(H, F.col("keep_id").alias("__qb_keep"), F.lit(True).alias("__qb_in"))
    rows = df.withColumn(H, hashed(text)).withColumn(T, text).withColumn(I, F.col(f"`{id_col}`"))
    rows = rows.join(maybe_broadcast(heads, n), H, "left")
    stays = F.col("__qb_in").isNull() | F.col("__qb_keep").eqNullSafe(F.col(I))
    # keepers that the table holds several times over: one of those rows is enough
    again = narrow.join(maybe_broadcast(heads, n), H).where(F.col("__qb_keep").eqNullSafe(F.col(I))).groupBy(H).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(H)
    if split is not None:
        parts = split.select(H, T, F.col("keep_id").alias("__qb_split"), F.lit(True).alias("__qb_cut"))
        rows = rows.join(parts, [H, T], "left")
        stays = F.when(F.col("__qb_cut"), F.col("__qb_split").eqNullSafe(F.col(I))).otherwise(stays)
        again = again.unionByName(split.select(H).distinct())
    again = cut(again)
    kept = rows.where(stays)
    if not again.isEmpty():
        kept = kept.join(again, H, "left_anti").unionByName(kept.join(again, H, "left_semi").dropDuplicates([H, T, I]))
    return kept.select(*[F.col(f"`{c}`") for c in df.columns])
