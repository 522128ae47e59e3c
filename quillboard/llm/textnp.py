"""Texts as numpy arrays: code points, pieces of bounded size, hashed character n-grams."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quillboard.llm.common import release_memory, small_batches

#: Characters that a kernel works on at once, and of the pieces of longer texts. No result depends on either.
BLOCK_CHARS = 1 << 17
PIECE_CHARS = 1 << 17


@functools.cache
def letter_table(digits: bool) -> np.ndarray:
    """For every code point: its lower-case code point if it is a letter (or digit), else 0."""
    table = np.zeros(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha() or (digits and ch.isdigit()):
            low = ch.lower()
            table[c] = ord(low[0]) if len(low) >= 1 else c
    return table


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def text_blocks(texts: Iterable[str | None], most: int = BLOCK_CHARS, split: Callable[[str], Iterable[str]] = lambda text: (text,)) -> Iterator[tuple[np.ndarray, list[str]]]:
    """(row of each piece, pieces): whole texts, those beyond `most` characters as `split` cuts them, about `most` together."""
    rows, held, size = [], [], 0
    for i, text in enumerate(texts):
        for part in split(text or "") if len(text or "") > most else (text or "",):
            if held and size + len(part) > most:
                yield np.array(rows), held
                rows, held, size = [], [], 0
            rows.append(i)
            held.append(part)
            size += len(part) + 1
    if held:
        yield np.array(rows), held


def joined(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the pieces with a 0 before the first and after each; the piece of each place."""
    codes = code_points("\0" + "\0".join(pieces) + "\0")
    ends = np.cumsum([len(p) + 1 for p in pieces])
    owner = np.repeat(np.arange(len(pieces), dtype=np.int32), np.diff(ends, prepend=0))
    return codes, np.concatenate([[0], owner]).astype(np.int32)


def gram_hashes(codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of the n-grams of letters, 0 standing for one word boundary; and which are valid.

    A gram may begin or end on a boundary but hold none inside. Place i is the gram from i to i+n-1.
    """
    m = len(codes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint32), np.zeros(0, bool)
    h = np.full(m, n * 0x85EBCA6B & 0xFFFFFFFF, dtype=np.uint32)
    for k in range(n):
        h *= np.uint32(0x01000193)
        h += codes[k : k + m]
        h ^= h >> np.uint32(15)
    h *= np.uint32(0x9E3779B1)
    if n == 1:
        return h, codes[:m] != 0
    if n == 2:
        return h, (codes[:m] | codes[1 : m + 1]) != 0
    ok = codes[1 : m + 1] != 0
    for k in range(2, n - 1):
        ok &= codes[k : k + m] != 0
    return h, ok


def map_texts(df: DataFrame, text_col: str, fields: list[T.StructField], start: Callable[[], Callable[[list], list]]) -> DataFrame:
    """`df` with more columns that a function of whole texts gives, batch by batch in Arrow.

    start() runs once in a task and returns the function: texts of a batch -> one list or array for each
    field. Columns of `df` that are named like a new one are replaced.
    """
    new = {f.name for f in fields}
    keep = [c for c in df.columns if c not in new]
    drop_text = text_col in new
    source = df.select(*[f"`{c}`" for c in keep], *([df[f"`{text_col}`"].alias("__qb_src")] if drop_text else []))
    place = len(keep) if drop_text else keep.index(text_col)
    schema = T.StructType([df.schema[c] for c in keep] + fields)
    names = [*keep, *(f.name for f in fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in fields]
        score = start()
        for i, batch in enumerate(small_batches(batches, place)):
            if i % 16 == 15:
                release_memory()
            found = score(batch.column(place).to_pylist())
            columns = [*batch.columns[: len(keep)], *(x if isinstance(x, pa.Array) else pa.array(x, kind) for x, kind in zip(found, kinds, strict=True))]
            del batch, found
            yield pa.RecordBatch.from_arrays(columns, names=names)
            del columns
        del score
        release_memory()

    return source.mapInArrow(run, schema)
