"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

The pieces come from a public model file (read on the driver, never copied; no tokenizer is trained). A
unigram model's log scores are taken as they are. A merge model (BPE) holds places in its merge order
instead of scores; there, piece of place r has the log probability of Zipf's law, -log(r) - log(H), H the
harmonic number of all places: frequent pieces are merged first, and the law needs no training.

A text gets a dummy prefix, spaces become the marker U+2581, and the segmentation of the highest total
score wins; where scores tie, the longer last piece does. A character that no piece begins with costs
`min score - 10` and is spelled in byte pieces, and so is a marker that the text itself holds: the C++
library makes it a space, here decode(encode(x)) = x for every text. Decoding joins pieces, markers as
spaces, turns byte runs into text, and drops the dummy prefix.

No piece has a marker behind another character, so the best segmentation of a text is that of its
words, each with the markers before it; only a piece that starts with a marker can follow a word. Where no
piece holds a line end, words end there too. Texts are cut there, every distinct word of a batch is solved and decoded once, all words together, position by
position in numpy, and remembered up to `REMEMBER` words. A word's byte runs hold whole characters, so a
text decodes to its decoded words in a row: `round_trip` tells whether each of them is the word. Words
beyond LONG characters are solved one by one with a rolling window, in time proportional to their
length; long texts are taken in pieces that divide no word. Scores add in double precision (the C++
library adds in single precision, where long texts may round ties another way).

The trie is built on the driver and broadcast: its size depends on the vocabulary alone.

Null text gives null ids; the empty text has no ids. Lone surrogates do not occur in Spark strings.
Repeated rows encode alike; extra columns are carried; columns named like the new ones are replaced.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quillboard.llm.textnp import PIECE_CHARS, code_points, map_texts

MARK = "▁"
#: What stands for a marker of the text itself, before a word that has no marker before it, and for a line
#: end that is a word of its own: lone surrogates, which no text holds.
LITERAL, BARE, LINE = "\ud800", "\ud801", "\ud802"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
REMEMBER = 300_000
LONG = 256
UNKNOWN_PENALTY = 10.0
#: Places of the trie that its construction looks through at once.
STRETCH = 2048


def _varint(data: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[i]
        i += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, i


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protocol-buffer message."""
    i = 0
    while i < len(data):
        key, i = _varint(data, i)
        wire = key & 7
        if wire == 0:
            value, i = _varint(data, i)
        elif wire == 2:
            n, i = _varint(data, i)
            value, i = data[i : i + n], i + n
        else:
            n = 4 if wire == 5 else 8
            value, i = data[i : i + n], i + n
        yield key >> 3, value


def read_model(path: str) -> tuple[list[str], list[float], list[int], bool, bool]:
    """(pieces, scores, types, add dummy prefix, is a unigram model) of a SentencePiece model file.

    Only models that keep text as it is (identity normaliser, all blanks kept, blanks escaped) are taken.
    """
    pieces, scores, kinds, prefix, unigram = [], [], [], True, True
    with open(path, "rb") as f:
        data = f.read()
    for field, value in _fields(data):
        if field == 1:
            piece, score, kind = "", 0.0, NORMAL
            for k, v in _fields(value):
                if k == 1:
                    piece = v.decode()
                elif k == 2:
                    score = struct.unpack("<f", v)[0]
                elif k == 3:
                    kind = v
            pieces.append(piece)
            scores.append(score)
            kinds.append(kind)
        elif field == 2:
            unigram = dict(_fields(value)).get(3, 1) == 1
        elif field == 3:
            norm = dict(_fields(value))
            prefix = bool(norm.get(3, 1))
            if norm.get(2) or norm.get(4, 1) or not norm.get(5, 1):
                raise ValueError("the model normalises text; only identity models are supported")
    return pieces, scores, kinds, prefix, unigram


@dataclass
class Unigram:
    base: np.ndarray
    check: np.ndarray
    leaf: np.ndarray  # piece id of a trie state, or -1
    score: np.ndarray  # of every piece id, float64
    alphabet: np.ndarray  # code point -> trie symbol, 0 for none
    longest: int
    unknown: float
    byte_ids: np.ndarray
    pieces: list[str]
    kinds: list[int]
    prefix: bool


def zipf(merge_scores: np.ndarray) -> np.ndarray:
    """Log probabilities by Zipf's law of pieces whose scores fall with their place in the merge order."""
    place = np.empty(len(merge_scores))
    place[np.argsort(-merge_scores, kind="stable")] = np.arange(1, len(merge_scores) + 1)
    return -np.log(place) - np.log((1 / place).sum())


def build(path: str) -> Unigram:
    pieces, scores, kinds, prefix, unigram = read_model(path)
    normal = [i for i, k in enumerate(kinds) if k == NORMAL]
    values = np.array(scores, dtype=np.float64)
    if not unigram:
        values[normal] = zipf(values[normal])
    byte_ids = np.full(256, -1, dtype=np.int32)
    for i, k in enumerate(kinds):
        if k == BYTE:
            byte_ids[int(pieces[i][3:5], 16)] = i
    if (byte_ids < 0).any():
        raise ValueError("the model has no byte fallback")
    used = [i for i, k in enumerate(kinds) if k in (NORMAL, USER) and pieces[i]]
    for i in used:
        if kinds[i] == USER:
            values[i] = len(pieces[i].encode()) * max(values[normal]) - 0.1
    inner = [pieces[i] for i in used if MARK in pieces[i].lstrip(MARK)]
    if inner:
        raise ValueError(f"pieces hold a marker behind other characters: {inner[:3]}")
    base, check, leaf, alphabet = double_array({pieces[i]: i for i in used})
    return Unigram(base, check, leaf, values, alphabet, max(len(pieces[i]) for i in used), float(values[normal].min()) - UNKNOWN_PENALTY, byte_ids, pieces, kinds, prefix)


def double_array(words: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Double-array trie: state s and symbol c lead to base[s] + c, if check there is s.

    Symbols are numbered by how many pieces use them, so that frequent ones lie close together.
    """
    count: dict[str, int] = {}
    for word in words:
        for ch in word:
            count[ch] = count.get(ch, 0) + 1
    symbols = {ch: i + 1 for i, ch in enumerate(sorted(count, key=lambda c: (-count[c], c)))}
    children: list[dict[int, int]] = [{}]
    values = [-1]
    for word, value in words.items():
        node = 0
        for ch in word:
            c = symbols[ch]
            if c not in children[node]:
                children[node][c] = len(children)
                children.append({})
                values.append(-1)
            node = children[node][c]
        values[node] = value
    size = len(children) + len(symbols) * 2 + 16
    base, check, leaf = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    taken = np.zeros(size, dtype=bool)
    taken[0] = True
    low = 1  # no free place below
    order, state_of = [0], {0: 0}
    while order:
        nodes, order = order, []
        for node in sorted(nodes, key=lambda x: -len(children[x])):
            kids = sorted(children[node])
            if not kids:
                continue
            while low < len(taken) and taken[low]:
                low += int(taken[low : low + STRETCH].argmin()) or STRETCH
            at = max(1, low - kids[0])
            while True:  # the first base from `at` on whose places for all children are free, 2048 at a time
                if at + kids[-1] + 2 * STRETCH >= len(taken):
                    more = len(taken) + 2 * STRETCH + kids[-1]
                    base, check, leaf = np.append(base, np.zeros(more, np.int32)), np.append(check, np.full(more, -1, np.int32)), np.append(leaf, np.full(more, -1, np.int32))
                    taken = np.append(taken, np.zeros(more, dtype=bool))
                busy = taken[at + kids[0] : at + kids[0] + STRETCH]
                for c in kids[1:]:
                    busy = busy | taken[at + c : at + c + STRETCH]
                free = int(busy.argmin())
                if not busy[free]:
                    at += free
                    break
                at += STRETCH
            state = state_of.pop(node)
            base[state] = at
            for c in kids:
                child, place = children[node][c], at + c
                taken[place] = True
                check[place] = state
                leaf[place] = values[child]
                state_of[child] = place
                order.append(child)
    alphabet = np.zeros(max(map(ord, symbols)) + 1, dtype=np.int32)
    for ch, c in symbols.items():
        alphabet[ord(ch)] = c
    end = int(np.flatnonzero(taken)[-1]) + len(symbols) + 2  # every base + symbol stays inside
    grow = max(0, end - len(base))
    return np.append(base, np.zeros(grow, np.int32))[:end], np.append(check, np.full(grow, -1, np.int32))[:end], np.append(leaf, np.full(grow, -1, np.int32))[:end], alphabet


def matches(model: Unigram, symbols: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, piece) of every piece at every place; ends: where the word of each place ends.

    All places walk the trie together, one character a step.
    """
    starts, lengths, pieces = [], [], []
    live, state = np.arange(len(symbols)), np.zeros(len(symbols), dtype=np.int64)
    for k in range(model.longest):
        inside = live + k < ends[live]
        live, state = live[inside], state[inside]
        c = symbols[live + k]
        to = model.base[state] + c
        ok = (c > 0) & (model.check[to] == state)
        live, state = live[ok], to[ok]
        if not len(live):
            break
        piece = model.leaf[state]
        full = piece >= 0
        starts.append(live[full])
        lengths.append(np.full(int(full.sum()), k + 1, dtype=np.int32))
        pieces.append(piece[full])
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)
    return np.concatenate(starts), np.concatenate(lengths), np.concatenate(pieces)


def viterbi(model: Unigram, words: list[str]) -> list[bytes]:
    """Piece ids of each word, as the bytes of an int32 array; words of similar length together."""
    out: list[bytes] = [b""] * len(words)
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    order = np.argsort(lengths, kind="stable")
    ranked = lengths[order]
    i = int(np.searchsorted(ranked, 0, "right"))
    while i < len(order):
        n = int(ranked[i])
        if n > LONG:
            out[order[i]] = _solve_long(model, words[order[i]])
            i += 1
            continue
        top = next(x for x in (12, 24, 64, LONG) if n <= x)
        j = min(int(np.searchsorted(ranked, top, "right")), i + max(1, 2_000_000 // top))
        for at, ids in zip(order[i:j].tolist(), _solve(model, [words[x] for x in order[i:j]], ranked[i:j]), strict=True):
            out[at] = ids
        i = j
    return out


def _symbols(model: Unigram, codes: np.ndarray) -> np.ndarray:
    known = codes < len(model.alphabet)
    return np.where(known, model.alphabet[np.where(known, codes, 0)], 0)


def _solve(model: Unigram, words: list[str], lengths: np.ndarray) -> list[bytes]:
    """Best segmentations, position by position, vectorised over the words."""
    m, n = len(words), int(lengths.max())
    codes = code_points("".join(words))
    first = np.cumsum(lengths) - lengths
    symbols = _symbols(model, codes)
    start, length, piece = matches(model, symbols, np.repeat(first + lengths, lengths))
    word = np.repeat(np.arange(m), lengths)
    single = np.zeros(len(codes), dtype=bool)
    single[start[length == 1]] = True
    lone = np.flatnonzero(~single)  # characters that are no piece of their own
    start, length, piece = np.concatenate([start, lone]), np.concatenate([length, np.ones(len(lone), np.int32)]), np.concatenate([piece, np.full(len(lone), -1, np.int32)])
    value = np.where(piece >= 0, model.score[piece], model.unknown)
    of = word[start]
    offset = start - first[of]
    order = np.argsort(offset, kind="stable")
    of, length, piece, value = of[order], length[order], piece[order], value[order]
    edge = np.searchsorted(offset[order], np.arange(n + 1))
    best = np.full((n + 1, m), -np.inf)
    best[0] = 0
    back_len, back_id = np.zeros((n + 1, m), np.int32), np.full((n + 1, m), -1, np.int32)
    flat, flat_len, flat_id = best.ravel(), back_len.ravel(), back_id.ravel()
    for t in range(n):  # a word has one piece of each length at a place, so no two targets are equal
        a, z = edge[t], edge[t + 1]
        w = of[a:z]
        score = best[t, w] + value[a:z]
        to = (length[a:z] + t) * m + w
        better = score > flat[to]
        to = to[better]
        flat[to], flat_len[to], flat_id[to] = score[better], length[a:z][better], piece[a:z][better]
    ids = np.full((m, n), -1, np.int32)
    spelled = np.zeros(m, dtype=bool)
    at, many = lengths.copy(), np.zeros(m, dtype=np.int64)
    live = np.arange(m)
    while len(live):
        got = back_id[at[live], live]
        ids[live, n - 1 - many[live]] = got
        spelled[live[got < 0]] = True
        many[live] += 1
        at[live] -= back_len[at[live], live]
        live = live[at[live] > 0]
    found = [row[n - k :].tobytes() for row, k in zip(ids, many.tolist(), strict=True)]
    for w in np.flatnonzero(spelled).tolist():
        found[w] = _trace(model, codes[first[w] : first[w] + lengths[w]], back_len[:, w], back_id[:, w], int(lengths[w]))
    return found


def _trace(model: Unigram, codes: np.ndarray, back_len: np.ndarray, back_id: np.ndarray, n: int) -> bytes:
    """Piece ids of one word, unknown characters spelled in bytes."""
    ids, at = [], n
    lens, pieces = back_len.tolist(), back_id.tolist()
    while at > 0:
        if pieces[at] >= 0:
            ids.append(pieces[at])
        else:
            char = chr(codes[at - 1])
            ids.extend(model.byte_ids[list((MARK if char == LITERAL else char).encode("utf-8", "surrogatepass"))][::-1].tolist())
        at -= lens[at]
    return np.array(ids[::-1], dtype=np.int32).tobytes()


def _solve_long(model: Unigram, word: str) -> bytes:
    """One long word: the same recursion over its places, STRETCH places at a time."""
    codes = code_points(word)
    n, score = len(codes), model.score
    symbols = _symbols(model, codes)
    back_len, back_id = np.zeros(n + 1, np.int32), np.full(n + 1, -1, np.int32)
    ahead = [0.0] + [-np.inf] * (STRETCH + model.longest)  # best scores from place `a` on
    for a in range(0, n, STRETCH):
        z = min(n, a + STRETCH)
        end = min(n, z + model.longest)
        start, length, piece = matches(model, symbols[a:end], np.full(end - a, end - a))
        mine = np.flatnonzero(start < z - a)
        order = mine[np.lexsort((length[mine], start[mine]))]
        start, length, piece, j = start[order].tolist(), length[order].tolist(), piece[order].tolist(), 0
        for t in range(z - a):
            here, single = ahead[t], False
            while j < len(start) and start[j] == t:
                to, value = t + length[j], here + score[piece[j]]
                single |= length[j] == 1
                if value > ahead[to]:
                    ahead[to], back_len[a + to], back_id[a + to] = value, length[j], piece[j]
                j += 1
            if not single and here + model.unknown > ahead[t + 1]:
                ahead[t + 1], back_len[a + t + 1], back_id[a + t + 1] = here + model.unknown, 1, -1
        ahead = ahead[z - a :] + [-np.inf] * (z - a)
    return _trace(model, codes, back_len, back_id, n)


def split_words(text: str, prefix: bool, lines: bool = False) -> list[str]:
    """Names of a text's words, in order: without the marker before them, further blanks before it as MARK.

    A word without a marker before it (the first, where the model adds no prefix) starts with BARE. lines:
    no piece holds a line end, so words may be divided there, which leaves fewer different ones.
    """
    if MARK in text:
        text = text.replace(MARK, LITERAL)
    if prefix:
        parts = (text.replace("\n", f" {LINE} {BARE}") if lines else text).split(" ")
        if "" not in parts:
            return parts
    parts, words = text.split(" "), []
    run = 1 if prefix else 0
    for part in parts:
        if part:
            words.append(MARK * (run - 1) + part if run else BARE + part)
            run = 0
        run += 1
    if not parts[-1] and run > 1:
        words.append(MARK * (run - 2))
    return words


def text_pieces(text: str) -> Iterator[str]:
    """Pieces of a long text, cut at the first blank behind a word; that blank is in neither."""
    start = 0
    while len(text) - start > PIECE_CHARS:
        cut = text.find(" ", start + PIECE_CHARS)
        if cut < 0 or text[cut - 1] == " " or cut + 1 >= len(text):
            cut = next((m.start() + 1 for m in AFTER_WORD.finditer(text, start + PIECE_CHARS)), -1)
            if cut < 0 or cut + 1 >= len(text):
                break
        yield text[start:cut]
        start = cut + 1
    yield text[start:] if start else text


AFTER_WORD = re.compile("[^ ] ")


class Coder:
    """Encodes and decodes texts; remembers the words it has solved."""

    def __init__(self, model: Unigram):
        self.model = model
        self.surface = ["" if k == CONTROL else p.replace(MARK, " ") for p, k in zip(model.pieces, model.kinds, strict=True)]
        self.is_byte = np.zeros(len(model.pieces), dtype=bool)
        self.is_byte[model.byte_ids] = True
        self.byte_value = np.zeros(len(model.pieces), dtype=np.uint8)
        self.byte_value[model.byte_ids] = np.arange(256)
        self.lines = len(model.alphabet) <= 10 or model.alphabet[10] == 0
        self._forget()

    def _forget(self) -> None:
        self.ids = {BARE: b"", LINE: self.model.byte_ids[[10]].astype(np.int32).tobytes()}
        self.lost: set[str] = set()  # words that do not decode to themselves

    def code(self, texts: list[str]) -> list[tuple[bytes, bool]]:
        """Piece ids of each text, as the bytes of an int32 array, and whether they decode to it."""
        if len(self.ids) > REMEMBER:
            self._forget()
        split = [[] if not t else split_words(t, self.model.prefix, self.lines) for t in texts]
        new = [w for w in set().union(*split) if w not in self.ids]
        words = [w[1:] if w[:1] == BARE else MARK + w for w in new]
        solved = viterbi(self.model, words)
        self.ids.update(zip(new, solved, strict=True))
        self.lost.update(name for name, word, said in zip(new, words, self._said(solved), strict=True) if said != word.replace(MARK, " ").replace(LITERAL, MARK))
        ids, lost = self.ids, self.lost
        return [(b"".join([ids[w] for w in names]), lost.isdisjoint(names) if lost else True) for names in split]

    def code_long(self, text: str) -> tuple[bytes, bool]:
        """The same, piece by piece."""
        if len(text) <= PIECE_CHARS or not self.model.prefix:  # each piece of a text gets the blank before it as its prefix
            return self.code([text])[0]
        parts = [self.code([part])[0] for part in text_pieces(text)]
        return b"".join([x for x, _ in parts]), all(same for _, same in parts)

    def encode(self, texts: list[str | None]) -> list[np.ndarray | None]:
        return [None if t is None else np.frombuffer(self.code_long(t)[0], dtype=np.int32) for t in texts]

    def _said(self, solved: list[bytes]) -> list[str]:
        """What each row of piece ids decodes to."""
        flat = np.frombuffer(b"".join(solved), dtype=np.int32)
        many = np.array([len(x) // 4 for x in solved], dtype=np.int64)
        ends = np.cumsum(many)
        first, spelled = ends - many, np.concatenate([[0], np.cumsum(self.is_byte[flat])])
        mixed = (spelled[ends] > spelled[first]).tolist()
        surface, join = self.surface, "".join
        parts = [surface[i] for i in flat.tolist()]
        return [self._spelled(flat[a:z]) if odd else join(parts[a:z]) for a, z, odd in zip(first.tolist(), ends.tolist(), mixed, strict=True)]

    def _spelled(self, ids: np.ndarray) -> str:
        """The same for ids of which some are bytes."""
        parts, done, at = [], 0, np.flatnonzero(self.is_byte[ids])
        for run in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1):
            parts.extend(self.surface[i] for i in ids[done : run[0]].tolist())
            parts.append(self.byte_value[ids[run]].tobytes().decode("utf-8", "replace"))
            done = run[-1] + 1
        parts.extend(self.surface[i] for i in ids[done:].tolist())
        return "".join(parts)

    def decode(self, ids: np.ndarray) -> str:
        """The text of any piece ids."""
        text = self._said([ids.astype(np.int32).tobytes()])[0]
        return text[1:] if self.model.prefix and text[:1] == " " else text


def encode_column(df: DataFrame, model: Unigram, text_col: str = "text", batch_chars: int = 1 << 18) -> DataFrame:
    """`df` with ids (int array), n_tokens, n_byte_tokens, round_trip (does decoding give the text back)."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def start():
        coder = Coder(shared.value)

        def score(texts: list[str | None]) -> list:
            found: list[tuple[bytes, bool]] = []
            first = 0
            while first < len(texts):
                size, stop = 0, first
                while stop < len(texts) and (stop == first or size < batch_chars):
                    size += len(texts[stop] or "")
                    stop += 1
                some = [t or "" for t in texts[first:stop]]
                found += [coder.code_long(some[0])] if len(some) == 1 else coder.code(some)
                first = stop
            missing = np.array([t is None for t in texts], dtype=bool)
            flat = np.frombuffer(b"".join([x for x, _ in found]), dtype=np.int32)
            many = np.array([len(x) // 4 for x, _ in found], dtype=np.int64)
            ends = np.concatenate([[0], np.cumsum(many)])
            spelled = np.concatenate([[0], np.cumsum(coder.is_byte[flat])])[ends]
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat), type=pa.list_(pa.field("element", pa.int32(), False)), mask=pa.array(missing))
            return [lists, pa.array(many, mask=missing), pa.array(np.diff(spelled), mask=missing), pa.array(np.array([same for _, same in found], dtype=bool), mask=missing)]

        return score

    fields = [T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("n_tokens", T.LongType()), T.StructField("n_byte_tokens", T.LongType()), T.StructField("round_trip", T.BooleanType())]
    return map_texts(df, text_col, fields, start)
