"""Near-duplicates against brute force over full sets."""

import itertools
import random
import re

import numpy as np
import pytest

from quillboard.llm import common, minhash
from quillboard.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, size):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def expected(rows, size, percent=80):
    sets = [shingle_set(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            parent[root(i)] = root(j)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        component = min(ids) if ids else None
        out.append((doc_id, len(sets[i]), component if sets[i] else doc_id, doc_id == (component if sets[i] else doc_id)))
    return sorted(out, key=repr)


def words(rng, n):
    return ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n)]


def edited(rng, text, changes):
    out = list(text)
    for _ in range(changes):
        out[rng.randrange(len(out))] = words(rng, 1)[0] + "x"
    return out


def family(rng, n, length, most):
    base = words(rng, length)
    return [" ".join(edited(rng, base, rng.randint(0, most))) for _ in range(n)]


def corpus(seed):
    rng = random.Random(seed)
    shared = " ".join(words(rng, 60))
    texts = [*family(rng, 25, 120, 9), *family(rng, 10, 40, 3), *[" ".join(words(rng, 80)) + " " + shared for _ in range(12)]]
    texts += [" ".join(words(rng, rng.randint(1, 60))) for _ in range(20)]
    texts += [None, "", " \t\n", "one", "ONE", "One", "one two", "two one", "É É É É É", "é É É É É", "a b c", "a b c d", "a b c d", "a b c d", " ".join(words(rng, 4000))]
    texts.append(texts[-1] + " tail")
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return [*rows, (None, "a b c d"), (None, "alone and without id"), rows[0], rows[0]]


def got(spark, rows, **how):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, kept string").repartition(4)
    return sorted((tuple(r) for r in minhash.components(df, **how).collect()), key=repr)


@pytest.mark.parametrize("size", [4, 5])
def test_components_equal_brute_force(spark, size):
    rows = corpus(size)
    assert got(spark, rows, size=size) == expected(rows, size)


def test_large_components_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "LARGE", 3)
    monkeypatch.setattr(minhash, "LIST", 2)
    monkeypatch.setattr(minhash, "BLOCK_ELEMENTS", 300)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    rng = random.Random(8)
    base = words(rng, 100)
    rows = [(i, " ".join(edited(rng, base, i % 8))) for i in range(60)]
    rows += [(100 + i, t) for i, t in enumerate(family(rng, 12, 100, 5))]
    assert got(spark, rows, size=4) == expected(rows, 4)


def test_chains_end_in_the_smallest_id(spark):
    rng = random.Random(2)
    at, rows = words(rng, 100), []
    for i in range(12):
        rows.append((50 - i, " ".join(at)))
        at = edited(rng, at, 2)
    assert got(spark, rows, size=4) == expected(rows, 4)


def test_empty_table_and_survivors(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert minhash.components(empty).count() == 0
    rng = random.Random(4)
    rows = [(i, t) for i, t in enumerate(family(rng, 6, 60, 1))] + [(90, None), (91, "q w e r t y")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = {r[2] for r in expected(rows, 5)}
    assert {r.doc_id for r in minhash.survivors(df, size=5).collect()} == kept


def test_rows_without_id_are_linked(spark, monkeypatch):
    rng = random.Random(9)
    near, bridge = words(rng, 100), words(rng, 100)
    start, end = words(rng, 16), words(rng, 16)
    left, right = " ".join([*start, *bridge]), " ".join([*bridge, *end])
    rows = [(1, " ".join(near)), (None, " ".join(edited(rng, near, 2))), (3, left), (None, " ".join(bridge)), (4, right)]
    alone = words(rng, 100)
    rows += [(None, " ".join(alone)), (None, " ".join(edited(rng, alone, 2))), (None, " ".join(words(rng, 50)))]
    want = expected(rows, 5)
    assert [r[2] for r in want if r[0] == 4] == [3] and len(shingle_set(left, 5) & shingle_set(right, 5)) * 100 < 80 * len(shingle_set(left, 5) | shingle_set(right, 5))
    assert got(spark, rows, size=5) == want
    monkeypatch.setattr(minhash, "BROADCAST_IDS", 0)
    assert got(spark, rows, size=5) == want


def test_survivors_are_decided_by_row_and_not_by_id(spark):
    rng = random.Random(6)
    first, clean, other = (" ".join(words(rng, 60)) for _ in range(3))
    near = first + " tail"
    rows = [(1, first), (None, first.upper()), (None, clean), (None, None), (7, near), (7, other), (8, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    left = [(1, first), (None, clean), (None, None), (7, other), (8, None)]
    assert sorted(map(repr, map(tuple, minhash.survivors(df, size=5).collect()))) == sorted(map(repr, left))


def test_signature_agreement_estimates_similarity():
    rng = random.Random(0)
    base = words(rng, 400)
    a, b = " ".join(base), " ".join(edited(rng, base, 15))
    sa, sb = shingle_set(a, 4), shingle_set(b, 4)
    truth = len(sa & sb) / len(sa | sb)
    hashes, ends = minhash.shingles([a.encode(), b.encode()], 4)
    sig = minhash.signatures(hashes, ends, minhash.multipliers(4096, 1))
    assert abs((sig[0] == sig[1]).mean() - truth) < 0.03
    assert len(np.unique(hashes[: ends[1]])) == len(sa)


def test_threshold_of_matches():
    t = minhash.least_matches(64, 80, 1e-5)
    rng = np.random.default_rng(0)
    assert 30 <= t <= 40 and (rng.binomial(64, 0.8, 200_000) < t).mean() < 1e-4


def test_components_of_an_edge_table(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)] + [(7, 7)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            ra, rb = root(a), root(b)
            parent[max(ra, rb)] = min(ra, rb)
    out = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src bigint, dst bigint")).collect()}
    assert out == {x: root(x) for x in list(parent)}
