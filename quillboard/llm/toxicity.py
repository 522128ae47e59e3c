"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word that repeats the one before it counts once, and a window shorter than half of `window` is averaged
as if it were that long. A word's vector is the mean of the vectors of its hashed character 3- to 6-grams (boundaries included)
and of the word itself, so unseen spellings share the vectors of their parts. The words of a window of
`window` words are averaged and go through a linear softmax of two classes; a small logistic
curve over a text's four highest window logits and its number of windows gives the score, so a few words
count in a long text as in a short one. Embeddings and softmax are
trained together by stochastic gradients on each training text's most toxic windows (and, for clean
texts, a random one more); they start from the grams' log-odds in toxic and clean texts.

For scoring, each embedding is multiplied by the softmax weights beforehand: averages are linear, so
the scalar of a bucket gives the same logit as its vector.

Learning draws about `max_rows` labelled texts and `max_chars` characters of each class at most, by a
hash of the text and whatever its length; drawn texts are used whole. Scoring takes long texts in pieces
that words and windows run across. Null, empty and letterless texts have no window and score as a
text of neutral windows. Without both classes in training every score is 0. Repeated rows score alike; extra
columns are carried; a column named score is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quillboard.llm.fitting import draw, logistic
from quillboard.llm.textnp import PIECE_CHARS, gram_hashes, joined, letter_table, map_texts, text_blocks

ORDERS = (3, 4, 5, 6)
#: Windows of a text that its score is made of.
TOP = 4
#: Toxic texts that the held-back part must hold for the curve to be fitted on it alone.
FEW = 30
BITS = 16
WORDS = 1 << BITS  # word buckets follow the gram buckets


@dataclass
class ToxicityModel:
    scalars: np.ndarray  # gram buckets, then word buckets; float64
    bias: float
    window: int
    pooling: np.ndarray | None  # weights of the TOP highest logits, of log(1 + windows), and a constant
    neutral: float = 0.0  # the logit in place of a window that a short text lacks


def word_cuts(text: str) -> Iterator[str]:
    """Pieces of a long text, cut before a character that is no letter or digit: words stay whole."""
    start = 0
    while len(text) - start > PIECE_CHARS:
        found = BETWEEN.search(text, start + PIECE_CHARS)
        if found is None:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:] if start else text


def text_words(texts: Iterable[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """(row of each word; 64-bit hash of each word; the layout that `grams_of` reads), block by block.

    A word that repeats the word before it does not count again.
    """
    last = None
    for rows, pieces in text_blocks(texts, PIECE_CHARS, word_cuts):
        codes, owner = joined(pieces)
        codes = letter_table(True)[codes]
        inside = codes != 0
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        starts = np.flatnonzero(begins)
        if not len(starts):
            continue
        at = np.flatnonzero(inside)
        first = np.searchsorted(at, starts)
        length = np.diff(first, append=len(at))
        place = (np.arange(len(at)) - np.repeat(first, length)) & 63
        whole = np.add.reduceat(codes[at].astype(np.uint64) * POWERS[place], first)
        whole ^= whole >> np.uint64(29)
        whole *= np.uint64(0xBF58476D1CE4E5B9)
        row = rows[owner[starts]]
        new = np.ones(len(starts), dtype=bool)
        new[1:] = (whole[1:] != whole[:-1]) | (row[1:] != row[:-1])
        new[0] = (row[0], whole[0]) != last
        last = row[-1], whole[-1]
        if new.any():
            yield row[new], whole[new], (codes, starts[new], length[new])


BETWEEN = re.compile(r"[\W_]")
POWERS = np.array([pow(0x9E3779B97F4A7C15, i, 1 << 64) for i in range(64)], dtype=np.uint64)


def grams_of(layout: tuple[np.ndarray, np.ndarray, np.ndarray], whole: np.ndarray, which: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(word of each gram, bucket of each gram) of the words in `which` (all if None), numbered from 0."""
    codes, starts, length = layout
    if which is not None:
        starts, length, whole = starts[which], length[which], whole[which]
    shift = np.uint32(32 - BITS)
    of, bucket = [np.arange(len(starts))], [(whole >> np.uint64(64 - BITS)).astype(np.int32) + WORDS]
    for n in ORDERS:
        h, ok = gram_hashes(codes, n)
        many = np.maximum(length + 3 - n, 0)  # a word of m letters has m + 2 places with its boundaries
        word = np.repeat(np.arange(len(starts)), many)
        at = np.arange(len(word)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(starts - 1, many)
        of.append(word)
        bucket.append((h[at] >> shift).astype(np.int32))
    return np.concatenate(of), np.concatenate(bucket)


def windows(row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First word of each window (windows end with their text), and the text of each window."""
    if not len(row):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.diff(row, prepend=-1))
    rank = np.arange(len(row)) - np.repeat(first, np.diff(first, append=len(row)))
    starts = np.flatnonzero(rank % size == 0)
    return starts, row[starts]


def window_logits(texts: list[str | None], scalars: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, mean word scalar) of each window, block by block; windows run over the pieces of a long text."""

    def means(row: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, of = windows(row, size)
        return of, np.add.reduceat(word, starts) / np.maximum(np.diff(starts, append=len(row)), size // 2)

    rows, words = np.zeros(0, np.int64), np.zeros(0)
    for row, whole, layout in text_words(texts):
        of, bucket = grams_of(layout, whole)
        word = np.bincount(of, weights=scalars[bucket], minlength=len(row)) / np.bincount(of, minlength=len(row))
        rows, words = np.concatenate([rows, row]), np.concatenate([words, word])
        ended = int(np.searchsorted(rows, rows[-1]))  # the last text may go on in the next block
        if ended:
            yield means(rows[:ended], words[:ended])
            rows, words = rows[ended:], words[ended:]
    if len(rows):
        yield means(rows, words)


def highest(row: np.ndarray, value: np.ndarray, n: int, into: np.ndarray) -> None:
    """Merge values of rows 0..n-1 into `into` (n x TOP, descending)."""
    order = np.lexsort((-value, row))
    row, value = row[order], value[order]
    first = np.searchsorted(row, np.arange(n))
    rank = np.arange(len(row)) - first[row]
    take = rank < TOP
    new = np.full((n, TOP), -np.inf)
    new[row[take], rank[take]] = value[take]
    into[:] = -np.sort(-np.concatenate([into, new], axis=1), axis=1)[:, :TOP]


def pool(model: ToxicityModel, top: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Features of texts: the highest window logits, the number of windows, a constant."""
    z = np.where(np.isfinite(top), top + model.bias, model.neutral)
    return np.column_stack([np.clip(z, -30, 30), np.log1p(many), np.ones(len(z))])


def score_texts(model: ToxicityModel, texts: list[str | None]) -> np.ndarray:
    if model.pooling is None:
        return np.zeros(len(texts))
    top, many = np.full((len(texts), TOP), -np.inf), np.zeros(len(texts))
    for rows, mean in window_logits(texts, model.scalars, model.window):
        highest(rows, mean, len(texts), top)
        many += np.bincount(rows, minlength=len(texts))
    return 1 / (1 + np.exp(-np.clip(pool(model, top, many) @ model.pooling, -60, 60)))


@dataclass
class _Words:
    """The words of all training texts: of each, its text and number; of each distinct word, its grams."""

    row: np.ndarray
    word: np.ndarray
    bucket: np.ndarray
    per_word: np.ndarray

    def __post_init__(self) -> None:
        self.first_gram = np.concatenate([[0], np.cumsum(self.per_word)])

    def grams(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(grams of each word in a row, how many each word has)."""
        many = self.per_word[words]
        return self.bucket[np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.first_gram[words], many)], many


def _words(texts: list[str]) -> _Words | None:
    rows, wholes, words, buckets, counts = [], [], [], [], []
    known = np.zeros(0, np.uint64)
    for row, whole, layout in text_words(texts):
        distinct, at = np.unique(whole, return_index=True)
        place = np.searchsorted(known, distinct)
        new = np.append(known, distinct[-1] + np.uint64(1))[place] != distinct
        of, bucket = grams_of(layout, whole, at[new])
        buckets.append(bucket[np.argsort(of, kind="stable")])
        counts.append(np.bincount(of, minlength=int(new.sum())).astype(np.int32))
        rows.append(row.astype(np.int32))
        wholes.append(whole)
        words.append(distinct[new])
        known = np.insert(known, place[new], distinct[new])
    if not rows:
        return None
    names = np.concatenate(words)
    by_name = np.argsort(names)
    number = np.concatenate([by_name[np.searchsorted(names, x, sorter=by_name)].astype(np.int32) for x in wholes])
    return _Words(np.concatenate(rows), number, np.concatenate(buckets), np.concatenate(counts))


def _embed(data: _Words, y: np.ndarray, learn: np.ndarray, starts: np.ndarray, doc: np.ndarray, window: int, dim: int, epochs: int, rate: float, shrink: float, rng: np.random.Generator) -> tuple[np.ndarray, float]:
    """Scalars of all buckets and the bias, from embeddings and softmax trained on the texts in `learn`."""
    size, ends = 2 * WORDS, np.append(starts[1:], len(data.word))
    divisor = np.maximum(ends - starts, window // 2)
    # log-odds of a bucket: in how many toxic and clean texts it occurs, drawn to 0 where few hold it
    seen = np.full((2, size), 0.5)
    edges = np.searchsorted(data.row, np.arange(len(y) + 1))
    for d in np.flatnonzero(learn):
        held = np.zeros(size, dtype=bool)
        held[data.grams(data.word[edges[d] : edges[d + 1]])[0]] = True
        seen[y[d]] += held
    n = np.array([(learn & (y == k)).sum() for k in (0, 1)])[:, None] + 1.0
    odds = np.log(seen[1] / n[1]) - np.log(seen[0] / n[0])
    known = seen.sum(axis=0) - 1
    trust = known / (known + shrink)
    direction = rng.normal(size=dim)
    direction /= np.linalg.norm(direction)
    vectors = (rng.normal(scale=0.05, size=(size, dim)) + odds[:, None] * direction) * trust[:, None]
    softmax = np.stack([-direction, direction], axis=1)  # dim x 2
    bias = np.zeros(2)
    squares_v, squares_w, squares_b = np.full(size, 1e-6), np.full_like(softmax, 1e-6), np.full(2, 1e-6)
    by_doc = np.searchsorted(doc, np.arange(len(y) + 1))
    has = np.flatnonzero(learn & (np.diff(by_doc) > 0))
    weight = np.where(y == 1, min(4.0, 0.5 / max(1e-9, float((y[has] == 1).mean()))), 1.0)
    for epoch in range(epochs):
        mean = _means(data, vectors @ (softmax[:, 1] - softmax[:, 0]), starts, divisor)
        order = np.lexsort((-mean, doc))  # windows of a text stand together, highest first
        rank = np.arange(len(order)) - by_doc[doc[order]]
        best = order[(rank < TOP) & learn[doc[order]]]
        rank = rank[(rank < TOP) & learn[doc[order]]]
        toxic, many = y[doc[best]] == 1, np.minimum(np.diff(by_doc), TOP)[doc[best]]
        # the first window of a toxic text counts in full, the others as far as they look toxic already
        belief = np.where(rank == 0, 1.0, 1 / (1 + np.exp(-np.clip(mean[best] + bias[1] - bias[0], -30, 30))))
        clean = has[y[has] == 0]
        some = rng.integers(by_doc[clean], by_doc[clean + 1])
        pick, label = np.concatenate([best, some]), np.concatenate([toxic.astype(np.int64), np.zeros(len(some), np.int64)])
        share = np.concatenate([weight[doc[best]] * np.where(toxic, belief, 1 / many), weight[clean] / 2])
        shuffle = rng.permutation(len(pick))
        step = rate / (1 + epoch / 4)
        for i in range(0, len(shuffle), 256):
            take = shuffle[i : i + 256]
            w, t = pick[take], label[take]
            n_words = ends[w] - starts[w]
            at = data.word[np.arange(n_words.sum()) - np.repeat(np.cumsum(n_words) - n_words, n_words) + np.repeat(starts[w], n_words)]
            in_window = np.repeat(np.arange(len(w)), n_words)
            grams, many = data.grams(at)
            coef, of = np.repeat(1 / (many * divisor[w][in_window]), many), np.repeat(in_window, many)
            x = np.add.reduceat(vectors[grams] * coef[:, None], np.searchsorted(of, np.arange(len(w))))
            z = x @ softmax + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(t)), t] -= 1
            p *= share[take][:, None] / len(t)
            by_gram = np.argsort(grams, kind="stable")
            first = np.flatnonzero(np.diff(grams[by_gram], prepend=-1))
            ids = grams[by_gram[first]]
            g_v = np.add.reduceat(((p @ softmax.T)[of] * coef[:, None])[by_gram], first)
            g_w, g_b = x.T @ p + 1e-5 * softmax, p.sum(axis=0)
            squares_w += g_w**2
            squares_b += g_b**2
            squares_v[ids] += (g_v**2).mean(axis=1)
            softmax -= step * 0.1 * g_w / np.sqrt(squares_w)
            bias -= step * 0.1 * g_b / np.sqrt(squares_b)
            vectors[ids] -= step * trust[ids, None] * g_v / np.sqrt(squares_v[ids])[:, None]
    return vectors @ (softmax[:, 1] - softmax[:, 0]), float(bias[1] - bias[0])


def _means(data: _Words, scalar: np.ndarray, starts: np.ndarray, divisor: np.ndarray) -> np.ndarray:
    word = np.add.reduceat(scalar[data.bucket], data.first_gram[:-1]) / data.per_word
    return np.add.reduceat(word[data.word], starts) / divisor


def train(texts: list[str], toxic: list[int], window: int = 2, dim: int = 12, epochs: int = 10, rate: float = 0.3, shrink: float = 4.0, seed: int = 5) -> ToxicityModel:
    """Fit embeddings, softmax and the curve of the score.

    The curve is fitted on a quarter of the texts, which the embeddings do not see; where that quarter
    holds fewer than FEW toxic texts, it is fitted on all texts.
    """
    rng = np.random.default_rng(seed)
    y = np.asarray(toxic, dtype=np.int64)
    nothing = ToxicityModel(np.zeros(2 * WORDS), 0.0, window, None)
    data = _words(texts) if len(y) and y.min() != y.max() else None
    if data is None:
        return nothing
    starts, doc = windows(data.row, window)
    divisor = np.maximum(np.diff(starts, append=len(data.word)), window // 2)
    held = rng.random(len(y)) < 0.25
    if y[held].sum() < FEW or len(set(y[held].tolist())) < 2 or len(set(y[~held].tolist())) < 2:
        held[:] = False
    scalars, bias = _embed(data, y, ~held, starts, doc, window, dim, epochs, rate, shrink, rng)
    mean = _means(data, scalars, starts, divisor)
    neutral = float(np.median(mean[y[doc] == 0]) + bias) if (y[doc] == 0).any() else bias
    model = ToxicityModel(scalars, bias, window, None, neutral)
    on = np.flatnonzero(held if held.any() else ~held)
    top = np.full((len(y), TOP), -np.inf)
    highest(doc, mean, len(y), top)
    many = np.diff(np.searchsorted(doc, np.arange(len(y) + 1)))
    model.pooling = logistic(pool(model, top[on], many[on]), y[on], rising=TOP)
    return model


def fit(df: DataFrame, text_col: str = "text", label_col: str = "toxic", max_rows: int = 4000, max_chars: int = 10_000_000, seed: int = 5, **how) -> ToxicityModel:
    """Learn from about `max_rows` whole texts and `max_chars` characters of each class at most."""
    texts, labels = draw(df, text_col, label_col, max_rows, max_chars, seed)
    return train(texts, labels, seed=seed, **how)


def predict(df: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """`df` with score."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def start():
        held = shared.value
        return lambda texts: [score_texts(held, texts)]

    return map_texts(df, text_col, [T.StructField("score", T.DoubleType())], start)
