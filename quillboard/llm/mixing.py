"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of (source, language, topic). Token counts of the cells are raked: each
dimension in turn scales its values' rates so that the expected tokens meet that dimension's target
share of the budget, until all three hold. A document is kept with its cell's rate (at most 1, counted
as capped while fitting), decided by a hash of seed and document: the same on every executor and retry.

Only cell totals take part in the fitting. Up to `driver_cells` cells are raked in numpy on the driver;
more are raked by the same updates as DataFrame aggregations over the cell table (one pre-aggregated
group-by and join for each dimension and sweep), so nothing unbounded is collected.

Targets are shares by value for each dimension; without them, the tokens' own shares to the power
`alpha`, normalised: below 1 it lifts rare values. Values without a target where some are given get rate
0; a target whose value has no tokens is spread over the others. A target that asks for more tokens than
there are is met as far as rates of 1 allow; targets that are missed by more than 0.001 of the budget
after all sweeps are named in a warning. The topic is a given column, or else a content class that is
counted from the characters of the whole text (`describe_text`).

Null values of a dimension form a value of their own (key None in targets). Null and empty texts have no
tokens; they are kept at their cell's rate, which is scaled by the dimensions whose value has tokens only;
where no text has tokens, it is 1 but for values that the targets leave out. Rows that repeat id and text share one decision. An empty
table gives an empty result. Extra columns are carried by `sample`.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillboard.llm.common import cut, maybe_broadcast
from quillboard.llm.textnp import map_texts

DIMS = ("source", "lang", "topic")
KEYS = tuple(f"__qb_{d}" for d in DIMS)


#: Classes of bytes: blanks (space, U+0009 to U+000D), bars, symbols, capitals, and bytes within a character.
_PLAIN, _BLANK, _BAR, _SYMBOL, _CAPITAL, _INNER = range(6)
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[[32, *range(9, 14)]] = _BLANK
_CLASS[ord("|")] = _BAR
_CLASS[list(b"#$%&*@")] = _SYMBOL
_CLASS[65:91] = _CAPITAL
_CLASS[128:192] = _INNER
_STRETCH = 1 << 20


def describe_text(text: str | None) -> tuple[str, int]:
    """(topic, tokens) of a text.

    Tokens are runs of characters that are not blank. The topic is a content class from shares of
    characters: empty, table, symbols, capitals, note, prose or long.
    """
    data = np.frombuffer((text or "").encode(), dtype=np.uint8)
    counts, words, before = np.zeros(6, np.int64), 0, True
    for at in range(0, len(data), _STRETCH):
        kind = _CLASS[data[at : at + _STRETCH]]
        counts += np.bincount(kind, minlength=6)
        blank = kind == _BLANK
        words += int(np.count_nonzero(~blank[1:] & blank[:-1])) + int(before and not blank[0])
        before = bool(blank[-1])
    size = len(data) - int(counts[_INNER])
    if size == 0:
        return "empty", 0
    if counts[_BAR] * 100 > size:
        topic = "table"
    elif counts[_SYMBOL] * 20 > size:
        topic = "symbols"
    elif counts[_CAPITAL] * 4 > size:
        topic = "capitals"
    else:
        topic = "note" if size < 400 else "prose" if size < 8000 else "long"
    return topic, words


def described(df: DataFrame, text_col: str) -> DataFrame:
    """`df` with __qb_kind and __qb_tokens, from whole texts."""

    def start():
        return lambda texts: list(zip(*map(describe_text, texts), strict=True)) if texts else [[], []]

    return map_texts(df, text_col, [T.StructField("__qb_kind", T.StringType()), T.StructField("__qb_tokens", T.LongType())], start)


def _key(value: Column) -> Column:
    """A join key without nulls."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit("-"))


def _name(value) -> str:
    return "-" if value is None else f"={value}"


def rake(codes: list[np.ndarray], tokens: np.ndarray, targets: list[np.ndarray], budget: float, sweeps: int = 200, tolerance: float = 1e-6, barred: list[np.ndarray] | None = None) -> np.ndarray:
    """Rates (0 to 1) of cells so that expected tokens meet budget * target of every value of every dimension.

    A value without tokens scales nothing, unless it is `barred`: then its rate is 0.
    """
    barred = barred or [np.zeros(len(t), dtype=bool) for t in targets]
    total = tokens.sum()
    rate = np.full(len(tokens), budget / total if total else 1.0)
    for _ in range(sweeps):
        worst = 0.0
        for code, target, bar in zip(codes, targets, barred, strict=True):
            now = np.bincount(code, weights=tokens * np.minimum(rate, 1.0), minlength=len(target))
            with np.errstate(divide="ignore", invalid="ignore"):
                factor = np.where(now > 0, target * budget / np.where(now > 0, now, 1), np.where(bar, 0.0, 1.0))
            worst = max(worst, float(np.abs(factor[now > 0] - 1).max(initial=0.0)))
            rate = np.clip(rate * factor[code], 0.0, 1e6)
        if worst < tolerance:
            break
    return np.minimum(rate, 1.0)


def unmet(names: list[list[str]], codes: list[np.ndarray], tokens: np.ndarray, targets: list[np.ndarray], budget: float, rate: np.ndarray, tolerance: float = 1e-3) -> list[tuple[str, str, float, float]]:
    """(dimension, value, target share, reached share) of the targets that the rates miss by more than `tolerance`."""
    missed = []
    for dim, values, code, target in zip(DIMS, names, codes, targets, strict=True):
        share = np.bincount(code, weights=tokens * rate, minlength=len(target)) / (budget or 1.0)
        missed += [(dim, values[i][1:], float(target[i]), float(share[i])) for i in np.flatnonzero(np.abs(share - target) > tolerance)]
    return missed


def shares(values: list[str], tokens: np.ndarray, code: np.ndarray, given: Mapping | None, alpha: float) -> np.ndarray:
    """Target share of each value; adds to 1."""
    held = np.bincount(code, weights=tokens, minlength=len(values))
    if given is not None:
        named = {_name(k): float(v) for k, v in given.items()}
        target = np.array([named.get(v, 0.0) for v in values])
        target[held <= 0] = 0.0
    else:
        target = np.where(held > 0, held, 0.0) / max(held.sum(), 1e-300)
        target = np.where(target > 0, np.power(np.where(target > 0, target, 1.0), alpha), 0.0)
    return target / target.sum() if target.sum() > 0 else target


def left_out(values: list[str], given: Mapping | None) -> np.ndarray:
    """The values that given targets leave out or set to 0."""
    named = {_name(k) for k, v in (given or {}).items() if v > 0}
    return np.array([given is not None and v not in named for v in values], dtype=bool)


def _frame(spark, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def cell_rates(cells: DataFrame, targets: Mapping[str, Mapping] | None, budget_share: float, alpha: float, driver_cells: int, sweeps: int = 200) -> tuple[DataFrame, int]:
    """(key columns, rate) of every cell, and how many there are."""
    targets = targets or {}
    n = cells.count()
    if n <= driver_cells:
        rows = cells.select(*KEYS, "tokens").toArrow()
        names, codes = [], []
        for key in KEYS:
            values, code = np.unique(np.array(rows.column(key).to_pylist(), dtype=object).astype(str), return_inverse=True) if n else (np.zeros(0, str), np.zeros(0, np.int64))
            names.append(values.tolist())
            codes.append(code)
        tokens = rows.column("tokens").to_numpy().astype(np.float64)
        goal = [shares(v, tokens, c, targets.get(d), alpha) for d, v, c in zip(DIMS, names, codes, strict=True)]
        barred = [left_out(v, targets.get(d)) for d, v in zip(DIMS, names, strict=True)]
        rate = rake(codes, tokens, goal, budget_share * tokens.sum(), sweeps, barred=barred)
        if missed := unmet(names, codes, tokens, goal, budget_share * float(tokens.sum()), rate):
            told = ", ".join(f"{d} {v!r}: {t:.4f} wanted, {r:.4f} reached" for d, v, t, r in missed[:20])
            warnings.warn(f"{len(missed)} mixing targets are not met: {told}", stacklevel=2)
        found = [(*(v[c[i]] for v, c in zip(names, codes, strict=True)), float(rate[i])) for i in range(n)]
        return _frame(cells.sparkSession, found, ", ".join(f"{k} string" for k in KEYS) + ", rate double"), n
    return _rake_frames(cells, targets, budget_share, alpha, sweeps), n


def _rake_frames(cells: DataFrame, targets: Mapping[str, Mapping], budget_share: float, alpha: float, sweeps: int, tolerance: float = 1e-6) -> DataFrame:
    """The same updates as `rake`, as aggregations over the cell table."""
    spark = cells.sparkSession
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    budget = budget_share * total
    goals = []
    for dim, key in zip(DIMS, KEYS, strict=True):
        held = cells.groupBy(key).agg(F.sum("tokens").cast("double").alias("held"))
        if dim in targets:
            named = _frame(spark, [(_name(k), float(v)) for k, v in targets[dim].items()], f"{key} string, raw double")
            held = held.join(named, key, "left").withColumn("barred", F.coalesce(F.col("raw") <= 0, F.lit(True))).withColumn("raw", F.when(F.col("held") > 0, F.coalesce("raw", F.lit(0.0))).otherwise(0.0))
        else:
            held = held.withColumn("barred", F.lit(False)).withColumn("raw", F.when(F.col("held") > 0, F.pow(F.col("held") / F.lit(total or 1.0), F.lit(alpha))).otherwise(0.0))
        whole = float(held.agg(F.sum("raw")).first()[0] or 0) or 1.0
        goals.append(cut(held.select(key, "barred", (F.col("raw") / whole * budget).alias("goal"))))
    rated = cut(cells.select(*KEYS, F.col("tokens").cast("double").alias("tokens"), F.lit(budget_share if total else 1.0).alias("rate")))
    for _ in range(sweeps):
        worst = 0.0
        for key, goal in zip(KEYS, goals, strict=True):
            now = rated.groupBy(key).agg(F.sum(F.col("tokens") * F.least("rate", F.lit(1.0))).alias("now"))
            factor = F.when(F.col("now") > 0, F.col("goal") / F.col("now")).otherwise(F.when(F.col("barred"), 0.0).otherwise(1.0))
            step = cut(now.join(goal, key).select(key, factor.alias("factor"), (F.col("now") > 0).alias("live")))
            worst = max(worst, float(step.where("live").agg(F.max(F.abs(F.col("factor") - 1))).first()[0] or 0))
            rated = rated.join(step.select(key, "factor"), key).withColumn("rate", F.least(F.col("rate") * F.col("factor"), F.lit(1e6))).drop("factor")
        rated = cut(rated)
        if worst < tolerance:
            break
    else:
        warnings.warn(f"mixing targets are not met: the last sweep changed a rate by a factor of {1 + worst:.4f}", stacklevel=2)
    return rated.select(*KEYS, F.least("rate", F.lit(1.0)).alias("rate"))


def with_probability(
    df: DataFrame,
    source: Column,
    lang: Column,
    topic: Column,
    tokens: Column,
    targets: Mapping[str, Mapping] | None = None,
    budget_share: float = 0.6,
    alpha: float = 0.85,
    driver_cells: int = 200_000,
    sweeps: int = 200,
) -> DataFrame:
    """`df` with __qb_rate, the probability of every row."""
    keyed = df.withColumns({k: _key(c) for k, c in zip(KEYS, (source, lang, topic), strict=True)})
    cells = cut(keyed.groupBy(*KEYS).agg(F.sum(tokens).cast("bigint").alias("tokens")))
    rates, n = cell_rates(cells, targets, budget_share, alpha, driver_cells, sweeps)
    return keyed.join(maybe_broadcast(rates.withColumnRenamed("rate", "__qb_rate"), n), list(KEYS)).drop(*KEYS)


def chosen(seed: int, *identity: Column) -> Column:
    """A uniform number below 1 for every row, from a hash of its identity."""
    return F.pmod(F.xxhash64(F.lit(seed), *identity), F.lit(1 << 53)).cast("double") / float(1 << 53)


def sample(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic_col: str | None = None, seed: int = 29, **how) -> DataFrame:
    """The kept rows of `df`, with its columns."""
    topic = F.col(f"`{topic_col}`") if topic_col else F.col("__qb_kind")
    rated = with_probability(described(df, text_col), F.col(f"`{source_col}`"), F.col(f"`{lang_col}`"), topic, F.col("__qb_tokens"), **how)
    kept = rated.where(chosen(seed, F.col(f"`{id_col}`"), F.col(f"`{text_col}`")) < F.col("__qb_rate"))
    return kept.select(*[F.col(f"`{c}`") for c in df.columns])


def decisions(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic_col: str | None = None, seed: int = 29, **how) -> DataFrame:
    """One row per input row: `id_col`, source, lang, topic, tokens, probability, kept."""
    text = F.col(f"`{text_col}`")
    given = F.col(f"`{topic_col}`").cast("string") if topic_col else F.lit(None).cast("string")
    rows = df.select(
        F.col(f"`{id_col}`").alias("__qb_id"),
        F.col(f"`{source_col}`").alias("source"),
        F.col(f"`{lang_col}`").alias("lang"),
        given.alias("topic"),
        chosen(seed, F.col(f"`{id_col}`"), text).alias("__qb_u"),
        text.alias("__qb_text"),
    )
    topic = F.col("topic") if topic_col else F.col("__qb_kind")
    narrow = cut(described(rows, "__qb_text").select("__qb_id", "source", "lang", topic.alias("topic"), F.col("__qb_tokens").alias("tokens"), "__qb_u"))
    rated = with_probability(narrow, F.col("source"), F.col("lang"), F.col("topic"), F.col("tokens"), **how)
    return rated.select(F.col("__qb_id").alias(id_col), "source", "lang", "topic", "tokens", F.col("__qb_rate").alias("probability"), (F.col("__qb_u") < F.col("__qb_rate")).alias("kept"))


def margins(decided: DataFrame) -> DataFrame:
    """dimension, value, tokens, expected: what the probabilities of `decisions` reach, by value of each dimension."""
    tall = decided.select(F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in DIMS])).alias("of"), "tokens", (F.col("tokens") * F.col("probability")).alias("expected"))
    return tall.groupBy("of").agg(F.sum("tokens").alias("tokens"), F.sum("expected").alias("expected")).select("of.dimension", "of.value", "tokens", "expected")
