"""Bounded samples of labelled rows for fitting, and calibration of raw scores."""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillboard.llm.common import cut, maybe_broadcast


def _share(rows: DataFrame, label_col: str, max_rows: int, text_col: str | None = None, max_chars: int = 0) -> Column | None:
    """For each label, which of a million hash values to take so that about `max_rows` rows are left.

    With a text column, so that about `max_chars` characters are left too: each text has the same chance,
    whatever its length.
    """
    chars = F.sum(F.length(text_col)) if text_col else F.lit(0)
    sizes = {r[0]: (r[1], r[2]) for r in rows.groupBy(label_col).agg(F.count(F.lit(1)), chars).collect()}  # two labels
    if not sizes:
        return None
    shares = {k: min(1.0, max_rows / n, max_chars / size if size else 1.0) for k, (n, size) in sizes.items()}
    return F.create_map(*[F.lit(x) for k, share in shares.items() for x in (k, share * 1_000_000)])[F.col(label_col)]


def labelled(docs: DataFrame, labels: DataFrame, label_col: str, max_rows: int, allowed: Column, id_col: str = "doc_id", text_col: str = "text", seed: int = 11) -> DataFrame:
    """Texts and labels of a sample of labelled ids: about `max_rows` of each label 0 and 1 at most.

    The ids are drawn first, so that no text is shuffled: the drawn ids are counted and broadcast, or
    joined by a shuffle where repeated ids make them many. Null ids and labels are left out; an id that
    several rows bear brings all their texts, each with each distinct label of the id.
    """
    rows = labels.select(F.col(f"`{id_col}`").alias("__qb_id"), F.col(f"`{label_col}`").cast("int").alias(label_col)).where(F.col(label_col).isin(0, 1) & F.col("__qb_id").isNotNull())
    rows = rows.where(allowed if allowed is not None else F.lit(True))
    share = _share(rows, label_col, max_rows)
    if share is None:
        return docs.sparkSession.createDataFrame([], f"{text_col} string, {label_col} int")
    ids = cut(rows.where(F.pmod(F.xxhash64(F.lit(seed), "__qb_id"), F.lit(1_000_000)) < share).dropDuplicates())
    texts = docs.select(F.col(f"`{id_col}`").alias("__qb_id"), F.col(f"`{text_col}`").alias(text_col))
    return texts.join(maybe_broadcast(ids, ids.count()), "__qb_id").select(text_col, label_col)


def platt(x: np.ndarray, y: np.ndarray, steps: int = 60, balanced: bool = True) -> tuple[float, float]:
    """Slope (not negative) and shift of a logistic curve through (x, y), by damped Newton steps.

    balanced: both classes weigh the same, however many texts of each there are.
    """
    mu, sd = float(x.mean()), float(x.std()) or 1.0
    z = (x - mu) / sd
    a, b = 1.0, 0.0
    n1, n0 = float((y == 1).sum()), float((y == 0).sum())
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    c = np.where(y == 1, max(1.0, n0 / max(n1, 1.0)), max(1.0, n1 / max(n0, 1.0))) if balanced else np.ones(len(y))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -40, 40)))
        w = c * p * (1 - p) + 1e-9
        g = np.array([(c * (p - t) * z).sum() + 1e-3 * a, (c * (p - t)).sum()])
        h = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-6]])
        move = np.linalg.solve(h, g)
        move *= min(1.0, 2.0 / (np.abs(move).max() + 1e-12))
        a, b = a - move[0], b - move[1]
    a = max(a, 1e-6)
    return a / sd, b - a * mu / sd


def logistic(x: np.ndarray, y: np.ndarray, rising: int = 0, ridge: float = 0.3, steps: int = 60) -> np.ndarray:
    """Weights of a logistic curve over the columns of x (the last is a constant); both classes weigh the same.

    Columns are scaled, the ridge draws weights (not the constant) to 0. Of the first `rising` columns,
    those whose weight would be negative are left out, one after another.
    """
    use = list(range(x.shape[1]))
    while True:
        w = np.zeros(x.shape[1])
        w[use] = _newton(x[:, use], y, ridge, steps)
        low = [k for k in use if k < rising and w[k] < 0]
        if not low:
            return w
        use.remove(min(low, key=lambda k: w[k]))


def _newton(x: np.ndarray, y: np.ndarray, ridge: float, steps: int) -> np.ndarray:
    mu, sd = x.mean(axis=0), x.std(axis=0)
    mu[-1], sd = 0.0, np.where(sd > 1e-9, sd, 1.0)
    z = (x - mu) / sd
    n1, n0 = float((y == 1).sum()), float((y == 0).sum())
    cost = np.where(y == 1, max(1.0, n0 / max(n1, 1.0)), max(1.0, n1 / max(n0, 1.0)))
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    pull = np.full(x.shape[1], ridge)
    pull[-1] = 1e-3
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        g = z.T @ (cost * (p - t)) + pull * w
        h = (z * (cost * (p * (1 - p) + 1e-9))[:, None]).T @ z + np.diag(pull)
        move = np.linalg.solve(h, g)
        w = w - move * min(1.0, 2.0 / (np.abs(move).max() + 1e-12))
    w = w / sd
    w[-1] -= float(mu @ w)
    return w


def draw(df: DataFrame, text_col: str, label_col: str, max_rows: int, max_chars: int, seed: int) -> tuple[list[str], list[int]]:
    """About `max_rows` labelled texts and `max_chars` characters of each class at most, by a hash of the text.

    Texts are whole; null texts and labels other than 0 and 1 are left out. Warns where a class is empty.
    """
    rows = df.select(F.col(f"`{text_col}`").alias("text"), F.col(f"`{label_col}`").cast("int").alias("label")).where(F.col("text").isNotNull() & F.col("label").isin(0, 1))
    share = _share(rows, "label", max_rows, "text", max_chars)
    pairs = []
    if share is not None:
        got = rows.where(F.pmod(F.xxhash64(F.lit(seed), "text"), F.lit(1_000_000)) < share).toArrow()
        pairs = sorted(zip(got.column("text").to_pylist(), got.column("label").to_pylist(), strict=True))
    if len({k for _, k in pairs}) < 2:
        warnings.warn(f"{label_col}: not both classes have texts to learn from", stacklevel=2)
    return [t for t, _ in pairs], [k for _, k in pairs]
