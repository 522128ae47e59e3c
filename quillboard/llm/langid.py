"""Language identification: multinomial naive Bayes over hashed character n-grams.

Letters are lower-cased, everything else is a word boundary; 1-, 2- and 3-grams (with boundaries) are
hashed into `buckets`. Counts are summed on the executors from a sample of at most about
`docs_per_lang` training texts of each language (whole texts; drawn by a hash of the text, so the same
rows give the same model). The log-probability matrix, buckets x languages, is broadcast: its size is
bounded by `buckets` and `max_languages`. A batch of texts is scored as one sparse count matrix times
that matrix. Whole texts are counted, whatever their length.

Result: lang_pred, a language seen in training, or `und` if the text is null or has no letter (or if
training saw no language); score, the posterior of that language (0 for `und`). Equal posteriors go to
the alphabetically first language. Empty texts and tables, repeated rows and extra columns need no
care; columns named lang_pred or score are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillboard.llm.common import small_batches
from quillboard.llm.textnp import PIECE_CHARS, gram_hashes, joined, letter_table, map_texts, text_blocks

ORDERS = (1, 2, 3)
AHEAD = max(ORDERS) - 1


@dataclass
class LanguageModel:
    languages: list[str]
    log_prior: np.ndarray
    log_prob: np.ndarray  # buckets x languages, float32


def sparse_counts(texts: list[str | None], buckets: int, piece: int = PIECE_CHARS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """CSR rows of hashed n-gram counts: (row of each piece, indptr, indices, counts), block by block.

    A long text is counted in pieces that look AHEAD characters into the next one: each gram is counted
    in the piece where it begins, so the counts do not depend on `piece`.
    """
    table, shift = letter_table(False), np.uint32(32 - (buckets.bit_length() - 1))

    def split(text: str) -> Iterator[str]:
        return (text[at : at + piece + AHEAD] for at in range(0, max(1, len(text)), piece))

    done, seen = -1, 0  # the row counted last, and how many of its characters were
    for rows, pieces in text_blocks(texts, piece, split):
        codes, owner = joined(pieces)
        codes = table[codes]
        first = np.searchsorted(owner, np.arange(len(pieces) + 1), "left")
        counted = np.ones(len(codes), dtype=bool)
        place = 0  # of the boundary before a piece
        for row, part in zip(rows.tolist(), pieces, strict=True):
            seen = seen if row == done else 0
            if seen:
                counted[place] = False  # no word begins here
            whole = len(texts[row] or "")
            own = len(part) if seen + len(part) >= whole and len(part) <= piece else min(piece, len(part))
            if seen + own < whole:
                counted[place + 1 + own : place + 1 + len(part)] = False
            done, seen = row, seen + own
            place += len(part) + 1
        grams, at = [], []
        for n in ORDERS:
            h, ok = gram_hashes(codes, n)
            ok = np.flatnonzero(ok & counted[: len(ok)])
            grams.append((h[ok] >> shift).astype(np.int32))
            at.append(np.searchsorted(ok + (n > 1), first))  # a gram that begins on a boundary is the next word's
        indptr, indices, counts = [0], [], []
        for i in range(len(pieces)):
            row = np.bincount(np.concatenate([g[a[i] : a[i + 1]] for g, a in zip(grams, at, strict=True)]), minlength=buckets)
            held = np.flatnonzero(row)
            indices.append(held)
            counts.append(row[held])
            indptr.append(indptr[-1] + len(held))
        yield rows, np.array(indptr), np.concatenate(indices), np.concatenate(counts)


def fit(df: DataFrame, text_col: str = "text", lang_col: str = "lang", docs_per_lang: int = 2000, buckets: int = 1 << 15, alpha: float = 0.2, seed: int = 7, max_languages: int = 1000) -> LanguageModel:
    """Learn from the rows of `df` with a language; null texts and languages are left out.

    More than `max_languages` distinct values raise: the matrix is broadcast.
    """
    rows = df.select(F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(max_languages + 1).collect()}
    if len(sizes) > max_languages:
        raise ValueError(f"{lang_col} holds more than {max_languages} languages")
    if not sizes:
        return LanguageModel([], np.zeros(0), np.zeros((buckets, 0), np.float32))
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, docs_per_lang / n))])
    drawn = rows.where(F.pmod(F.xxhash64(F.lit(seed), "text"), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in small_batches(batches, 0):
            langs = batch.column(1).to_pylist()
            for which, indptr, indices, counts in sparse_counts(batch.column(0).to_pylist(), buckets):
                for i, row in enumerate(which):
                    into = total.setdefault(langs[row], np.zeros(buckets, np.int64))
                    into[indices[indptr[i] : indptr[i + 1]]] += counts[indptr[i] : indptr[i + 1]]
        for lang, into in total.items():
            held = np.flatnonzero(into)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(held)), pa.array(held.astype(np.int32)), pa.array(into[held])], names=["lang", "bucket", "n"])

    counted = drawn.mapInArrow(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(sizes)
    place = {lang: j for j, lang in enumerate(languages)}
    matrix = np.full((buckets, len(languages)), alpha)
    at = np.array([place[x] for x in counted.column("lang").to_pylist()], dtype=np.int64)
    np.add.at(matrix, (counted.column("bucket").to_numpy(), at), counted.column("n").to_numpy())
    prior = np.array([sizes[x] for x in languages], dtype=float)
    return LanguageModel(languages, np.log(prior / prior.sum()), np.log(matrix / matrix.sum(axis=0)).astype(np.float32))


def score_texts(model: LanguageModel, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Predicted language and its posterior for each text."""
    k = len(model.languages)
    total = np.zeros((len(texts), k))
    grams = np.zeros(len(texts), dtype=np.int64)
    for rows, indptr, indices, counts in sparse_counts(texts, len(model.log_prob)):
        full = np.flatnonzero(np.diff(indptr))
        if k and len(full):
            part = np.add.reduceat(counts[:, None] * model.log_prob[indices].astype(np.float64), indptr[full], axis=0)
            np.add.at(total, rows[full], part)
            np.add.at(grams, rows[full], np.diff(indptr)[full])
    if not k:
        return ["und"] * len(texts), np.zeros(len(texts))
    total += model.log_prior
    best = total.argmax(axis=1)
    post = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
    known = grams > 0
    return [model.languages[b] if ok else "und" for b, ok in zip(best, known, strict=True)], np.where(known, post, 0.0)


def predict(df: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """`df` with lang_pred and score."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def start():
        held = shared.value
        return lambda texts: list(score_texts(held, texts))

    return map_texts(df, text_col, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())], start)
