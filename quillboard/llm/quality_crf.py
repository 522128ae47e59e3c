"""Document quality from a linear-chain conditional random field over lines.

Every line gets a label, good or bad. A line's evidence is one weight for each binned feature of its
own and of the lines before and after it; neighbouring labels are tied by transition weights.
Forward-backward gives each line's marginal of being good; the document's raw quality is their mean,
weighted by the lines' lengths, and a logistic curve fitted on training documents makes it a score.

With two labels the recursions run on log-odds: one number for each line, for all documents of a block
at once. Training maximises the conditional likelihood by full-batch gradient steps; lines take their
document's label (labels exist for documents only). About `max_rows` labelled documents and `max_chars`
characters of each class at most are drawn by a hash of the text, whatever their length, and used whole;
lines, documents and texts are otherwise unbounded.

Null and empty texts have no line with content and take the training documents' mean raw quality.
Without both classes in training every score is the share of good documents, or 1 if there are none.
Repeated rows score alike; extra columns are carried; columns named score, good_lines or lines are
replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillboard.llm.fitting import draw, platt
from quillboard.llm.textnp import code_points, map_texts

BLOCK = 1 << 17
#: Upper edges of the bins of each line feature.
EDGES = {
    "length": (0, 5, 20, 60, 150, 400, 1200),
    "upper": (0.0, 0.02, 0.06, 0.15, 0.4, 0.8),
    "digit": (0.0, 0.01, 0.05, 0.15, 0.4),
    "space": (0.05, 0.1, 0.14, 0.18, 0.25, 0.4),
    "stop": (0.0, 0.01, 0.03, 0.06, 0.12),
    "symbol": (0.0, 0.005, 0.02, 0.06, 0.15, 0.4),
    "bar": (0.0, 0.005, 0.02, 0.08),
    "doubled": (0.0, 0.005, 0.02, 0.06, 0.15),
    "repeated": (0.0, 0.02, 0.06, 0.15, 0.4, 0.8),
    "fresh": (0.1, 0.25, 0.4, 0.55, 0.7, 0.85, 0.95),
    "word": (2.0, 3.5, 4.5, 5.5, 7.0, 10.0),
    "opening": (0.5, 1.5, 2.5),
    "closing": (0.5, 1.5, 2.5),
}
WIDTH = max(map(len, EDGES.values())) + 1
FEATURES = len(EDGES)
COLUMNS = FEATURES * WIDTH

LOWER, UPPER, DIGIT, SPACE, STOP, SYMBOL = range(1, 7)


def _classes() -> np.ndarray:
    """Character class of the first 64k code points; what lies beyond counts as a symbol."""
    table = np.full(0x10000, SYMBOL, dtype=np.uint8)
    for c in range(0x10000):
        ch = chr(c)
        if ch.isalpha():
            table[c] = UPPER if ch.isupper() else LOWER
        elif ch.isdigit():
            table[c] = DIGIT
        elif ch.isspace():
            table[c] = SPACE
        elif ch in ".,;:?'\"-()«»¿¡’“”":
            table[c] = STOP
    return table


CLASSES = _classes()


@dataclass
class QualityModel:
    weights: np.ndarray  # 3 x COLUMNS: the line itself, the one before, the one after
    bias: float
    transition: np.ndarray  # 2 x 2, from bad/good to bad/good
    slope: float
    shift: float
    empty: float


SUMS = ("length", "upper", "digit", "space", "stop", "symbol", "bar", "doubled", "words", "inside")
BREAK = re.compile("[ \n]")


def _pieces(text: str, most: int) -> Iterator[str]:
    """Pieces of about `most` characters, cut behind a space or line end; a run without one stays whole."""
    start = 0
    while len(text) - start > most:
        found = BREAK.search(text, start + most)
        if found is None:
            break
        yield text[start : found.end()]
        start = found.end()
    if start < len(text):
        yield text[start:] if start else text


def _piece_sums(codes: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ends of lines; SUMS of each line, that of the open line last; word names; line of each word)."""
    ends = np.flatnonzero(codes == 10)
    edges = np.append(ends, len(codes))
    starts = np.concatenate([[0], ends + 1])

    def per_line(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int32)])
        return total[edges] - total[starts]

    inside = kind != SPACE
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    doubled = np.zeros(len(codes), dtype=bool)
    doubled[1:] = (codes[1:] == codes[:-1]) & (kind[1:] >= STOP)
    flags = (kind == UPPER, kind == DIGIT, kind == SPACE, kind == STOP, kind == SYMBOL, codes == 124, doubled, begins, inside)
    sums = np.stack([edges - starts, *map(per_line, flags)])
    word_at = np.flatnonzero(begins)
    name = np.zeros(0, np.uint64)
    if len(word_at):
        at = np.flatnonzero(inside)
        index = np.searchsorted(at, word_at)
        place = np.arange(len(at)) - np.repeat(index, np.diff(index, append=len(at)))
        mixed = codes[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + place.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
        mixed ^= mixed >> np.uint64(31)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        name = np.add.reduceat(mixed, index)
    return ends, sums, name, np.searchsorted(ends, word_at)


def line_features(texts: list[str], piece: int = 2 * BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first line of each text and the end, bin columns of each line, characters of each line).

    Long texts are read in pieces whose sums are added line by line: the result does not depend on `piece`.
    """
    parts, names, lines, opening, closing = [], [], [], [], []
    done, before = 0, SPACE  # lines that have ended, and the class of the character before the piece
    open_line = False
    for part in _pieces("\n".join(texts) + "\n", piece):
        codes = code_points(part)
        kind = CLASSES[np.minimum(codes, 0xFFFF)]
        ends, sums, name, line = _piece_sums(codes, kind)
        whole = not len(ends) or int(ends[-1]) < len(codes) - 1  # the last line goes on in the next piece
        parts.append((done, sums if whole else sums[:, :-1]))
        names.append(name)
        lines.append(line + done)
        starts = np.concatenate([[0], ends + 1])[int(open_line) :]
        starts = starts if whole else starts[:-1]
        opening.append(np.where(codes[starts] == 10, 0, kind[starts]))
        last = np.concatenate([[before], kind])[ends]
        empty = np.diff(ends, prepend=-1) == 1
        if open_line and len(ends):
            empty[0] = False
        closing.append(np.where(empty, 0, last))
        done, before, open_line = done + len(ends), int(kind[-1]), whole
    n = done
    total = np.zeros((len(SUMS), n))
    for at, sums in parts:
        total[:, at : at + sums.shape[1]] += sums
    of = dict(zip(SUMS, total, strict=True))
    name, line = np.concatenate(names), np.concatenate(lines)
    chars, many = np.maximum(of["length"], 1), np.maximum(of["words"], 1)
    same = (name[1:] == name[:-1]) & (line[1:] == line[:-1])
    repeated = np.bincount(line[1:][same], minlength=n) / many
    fresh = np.ones(n)
    if len(name):
        _, once = np.unique(name ^ line.astype(np.uint64) * np.uint64(0x94D049BB133111EB), return_index=True)
        fresh = np.bincount(line[once], minlength=n) / many
    group = np.array([0, 1, 2, 3, 3, 0, 3])  # of classes: letter case, digit or symbol, nothing or a stop
    values = {k: of[k] / chars for k in SUMS[1:8]} | {
        "length": of["length"],
        "repeated": repeated,
        "fresh": fresh,
        "word": of["inside"] / many,
        "opening": group[np.concatenate(opening)],
        "closing": group[np.concatenate(closing)],
    }
    bins = np.empty((n, FEATURES), dtype=np.int32)
    for k, (feature, edges) in enumerate(EDGES.items()):
        bins[:, k] = np.searchsorted(edges, values[feature], "left") + k * WIDTH
    rows = np.array([t.count("\n") + 1 for t in texts], dtype=np.int64)
    return np.concatenate([[0], np.cumsum(rows)]), bins, of["length"].astype(np.int64)


def _neighbours(first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether each line has one before and one after it in its text."""
    before, after = np.ones(n, dtype=bool), np.ones(n, dtype=bool)
    full = first[:-1] < first[1:]
    before[first[:-1][full]] = False
    after[first[1:][full] - 1] = False
    return before, after


def evidence(weights: np.ndarray, bias: float, first: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """Log-odds of good of each line, without its neighbours' labels."""
    before, after = _neighbours(first, len(bins))
    own = weights[0][bins].sum(axis=1) + bias
    prev, following = weights[1][bins].sum(axis=1), weights[2][bins].sum(axis=1)
    own[1:] += np.where(before[1:], prev[:-1], 0)
    own[:-1] += np.where(after[:-1], following[1:], 0)
    return own


def forward_backward(odds: np.ndarray, first: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds messages from the left (own evidence included) and from the right, of each line."""
    lines = np.diff(first)
    order = np.argsort(-lines, kind="stable")
    start, lines = first[:-1][order], lines[order]
    left, right = odds.copy(), np.zeros_like(odds)
    (t00, t01), (t10, t11) = transition
    most = int(lines[0]) if len(lines) else 0
    alive = np.searchsorted(-lines, -np.arange(1, most + 1), "right")  # documents with so many lines
    for k in range(1, most):
        at = start[: alive[k]] + k
        a = left[at - 1]
        left[at] += np.logaddexp(t11 + a, t01) - np.logaddexp(t10 + a, t00)
    for k in range(most - 2, -1, -1):
        at = start[: alive[k + 1]] + k
        b = odds[at + 1] + right[at + 1]
        right[at] = np.logaddexp(t11 + b, t10) - np.logaddexp(t01 + b, t00)
    return left, right


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def document_quality(model: QualityModel, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(length-weighted mean marginal log-odds clipped to a score's scale, good lines, lines) of each text."""
    first, bins, length = line_features(texts)
    odds = evidence(model.weights, model.bias, first, bins)
    left, right = forward_backward(odds, first, model.transition)
    good = _sigmoid(left + right)
    weight = np.concatenate([[0.0], np.cumsum(length)])
    mass = np.concatenate([[0.0], np.cumsum(good * length)])
    wins = np.concatenate([[0], np.cumsum((good >= 0.5) & (length > 0))])
    full = np.concatenate([[0], np.cumsum(length > 0)])
    chars = weight[first[1:]] - weight[first[:-1]]
    raw = np.where(chars > 0, (mass[first[1:]] - mass[first[:-1]]) / np.maximum(chars, 1), np.nan)
    return raw, wins[first[1:]] - wins[first[:-1]], full[first[1:]] - full[first[:-1]]


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _blocks(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    held, size, start = [], 0, 0
    for i, text in enumerate(texts):
        text = text or ""
        if held and size + len(text) > BLOCK:
            yield start, held
            held, size, start = [], 0, i
        held.append(text)
        size += len(text) + 1
    if held:
        yield start, held


def score_texts(model: QualityModel, texts: list[str | None]) -> list[np.ndarray]:
    """score, good_lines, lines of each text."""
    score, wins, lines = np.zeros(len(texts)), np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for start, held in _blocks(texts):
        raw, good, many = document_quality(model, held)
        at = slice(start, start + len(held))
        raw = np.where(np.isnan(raw), model.empty, raw)
        score[at] = _sigmoid(model.slope * _logit(raw) + model.shift)
        wins[at], lines[at] = good, many
    return [score, wins, lines]


def train(texts: list[str], labels: list[int], steps: int = 150, rate: float = 0.15, l2: float = 2e-4, seed: int = 3) -> QualityModel:
    y = np.asarray(labels, dtype=np.float64)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 1.0
        return QualityModel(np.zeros((3, COLUMNS)), 0.0, np.zeros((2, 2)), 0.0, float(_logit(np.array([share]))[0]) if len(y) else 40.0, 0.5)
    held = np.random.default_rng(seed).random(len(y)) < 0.25
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held[:] = False
    learn = np.flatnonzero(~held)
    firsts, bins, base = [np.array([0])], [], 0
    for _, part in _blocks([texts[i] for i in learn]):
        first, b, _ = line_features(part)
        firsts.append(first[1:] + base)
        bins.append(b)
        base += len(b)
    first, bins = np.concatenate(firsts), np.concatenate(bins)
    lines = np.diff(first)
    label = np.repeat(y[learn], lines)
    cost = np.repeat(np.where(y[learn] == 1, 0.5 / y[learn].mean(), 0.5 / (1 - y[learn].mean())) / lines, lines)
    before, after = _neighbours(first, base)
    flat = np.zeros(3 * COLUMNS + 1 + 4)
    m, v = np.zeros_like(flat), np.zeros_like(flat)
    inner = np.flatnonzero(after)  # lines with a next line
    for step in range(1, steps + 1):
        weights, bias, transition = flat[: 3 * COLUMNS].reshape(3, COLUMNS), flat[3 * COLUMNS], flat[-4:].reshape(2, 2)
        odds = evidence(weights, bias, first, bins)
        left, right = forward_backward(odds, first, transition)
        gap = (label - _sigmoid(left + right)) * cost / len(learn)
        grad = np.zeros_like(flat)
        for k in range(FEATURES):
            column = bins[:, k]
            grad[:COLUMNS] += np.bincount(column, gap, COLUMNS)
            grad[COLUMNS : 2 * COLUMNS] += np.bincount(column[:-1], np.where(before[1:], gap[1:], 0), COLUMNS)
            grad[2 * COLUMNS : 3 * COLUMNS] += np.bincount(column[1:], np.where(after[:-1], gap[:-1], 0), COLUMNS)
        grad[3 * COLUMNS] = gap.sum()
        a, b = left[inner], odds[inner + 1] + right[inner + 1]
        z = np.stack([np.full(len(inner), transition[0, 0]), transition[0, 1] + b, transition[1, 0] + a, transition[1, 1] + a + b])
        z = np.exp(z - z.max(axis=0))
        z /= z.sum(axis=0)
        truth = np.zeros_like(z)
        truth[0], truth[3] = 1 - label[inner], label[inner]
        grad[-4:] = ((truth - z) * cost[inner] / len(learn)).sum(axis=1)
        grad -= l2 * flat
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad**2
        flat = flat + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    model = QualityModel(flat[: 3 * COLUMNS].reshape(3, COLUMNS).copy(), float(flat[3 * COLUMNS]), flat[-4:].reshape(2, 2).copy(), 1.0, 0.0, 0.5)
    on = np.flatnonzero(held) if held.any() else learn
    raw = np.concatenate([document_quality(model, part)[0] for _, part in _blocks([texts[i] for i in on])])
    known = ~np.isnan(raw)
    model.empty = float(np.mean(raw[known]))
    model.slope, model.shift = platt(_logit(raw[known]), y[on][known].astype(int))
    return model


def fit(df: DataFrame, text_col: str = "text", label_col: str = "quality", max_rows: int = 3000, max_chars: int = 12_000_000, seed: int = 3, **how) -> QualityModel:
    """Learn from about `max_rows` whole texts and `max_chars` characters of each class at most."""
    texts, labels = draw(df.where(F.length(F.trim(F.col(f"`{text_col}`"))) > 0), text_col, label_col, max_rows, max_chars, seed)
    return train(texts, labels, seed=seed, **how)


def predict(df: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """`df` with score, good_lines, lines."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def start():
        held = shared.value
        return lambda texts: score_texts(held, texts)

    fields = [T.StructField("score", T.DoubleType()), T.StructField("good_lines", T.LongType()), T.StructField("lines", T.LongType())]
    return map_texts(df, text_col, fields, start)
