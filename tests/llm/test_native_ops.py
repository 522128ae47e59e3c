"""Sharding, exact dedup, URL rules, mixing."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillboard.llm import common, exact_dedup, mixing, queries, sharding, unigram, url_rules

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


# -- sharding ------------------------------------------------------------------------------------------
def test_communication_matrix_has_exact_margins():
    rows, shards = [100, 0, 7, 250], [90, 89, 89, 89]
    matrix = np.array(sharding.communication_matrix(rows, shards, 3))
    assert matrix.sum(axis=1).tolist() == rows and matrix.sum(axis=0).tolist() == shards and (matrix >= 0).all()


def test_matrix_cells_have_the_hypergeometric_mean():
    cells = [sharding.communication_matrix([30, 70], [50, 50], seed)[0][0] for seed in range(400)]
    assert abs(np.mean(cells) - 15) < 0.5 and 1.8 < np.var(cells) < 8  # variance 30*.5*.5*(70/99) = 5.3


def test_draws_from_many_rows_are_hypergeometric():
    rng = np.random.default_rng(3)
    few = [sharding._hypergeometric(rng, 2 * 10**9, 4 * 10**12 - 2 * 10**9, 1000) for _ in range(6000)]  # all but Poisson of mean 0.5
    assert np.allclose(np.bincount(few, minlength=3)[:3] / 6000, np.exp(-0.5) * np.array([1, 0.5, 0.125]), atol=0.03)
    many = np.array([sharding._hypergeometric(rng, 10**9, 3 * 10**9, 10**6) for _ in range(2000)])
    assert abs(many.mean() - 250_000) < 60 and 0.85 < many.var() / 187_453 < 1.15
    assert sharding._hypergeometric(rng, 10**9, 5, 10**9 + 2) in range(10**9 - 3, 10**9 + 1)


def test_inverted_draws_have_the_law_of_small_ones():
    rng = np.random.default_rng(4)
    a = [sharding._inverted(rng, 9, 5, 6) for _ in range(8000)]
    b = rng.hypergeometric(9, 5, 6, 8000)
    assert min(a) >= 1 and max(a) <= 6 and np.allclose(np.bincount(a, minlength=7) / 8000, np.bincount(b, minlength=7) / 8000, atol=0.03)


@pytest.mark.parametrize("n", [0, 3, 40, 1003])
def test_shards_are_exact_and_gapless(spark, n):
    df = spark.range(n).repartition(7).withColumn("shard", F.lit("clash"))
    out = sharding.hypergeometric_shards(df, 40, seed=5, rows_per_piece=10).collect()
    assert sorted(r.id for r in out) == list(range(n))
    slots = collections.defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    sizes = [len(slots[j]) for j in range(40)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_many_shards_have_fewer_groups(spark):
    out = sharding.hypergeometric_shards(spark.range(500).repartition(9), 50, seed=5, max_cells=100).collect()
    slots = collections.Counter(r.shard for r in out)
    assert sorted(r.id for r in out) == list(range(500)) and set(slots.values()) == {10}


def test_shuffle_is_uniform_and_survives_ties_and_nulls(spark):
    df = spark.createDataFrame([(None, "x")] * 300 + [(1, "x")] * 300, "doc_id bigint, text string").repartition(5)
    out = sharding.hypergeometric_shards(df, 4, seed=1).collect()
    nulls = collections.Counter(r.shard for r in out if r.doc_id is None)
    assert len(out) == 600 and sum(nulls.values()) == 300 and all(45 <= nulls[j] <= 105 for j in range(4))
    first = [r.shard for r in sharding.hypergeometric_shards(spark.range(2000).repartition(8), 2, seed=2).orderBy("id").collect()]
    runs = sum(a != b for a, b in zip(first, first[1:], strict=False))
    assert 850 < runs < 1150  # neighbours are independent


# -- exact dedup ---------------------------------------------------------------------------------------
TEXTS = [(1, "a"), (2, "a"), (3, "b"), (4, None), (5, ""), (None, "b"), (7, "A"), (8, "a"), (8, "a"), (None, "z"), (None, "z"), (9, "é" * 5000)]


def expected_groups(rows, keep):
    by_text = collections.defaultdict(list)
    for i, t in rows:
        by_text[t or ""].append(i)
    out = []
    for i, t in rows:
        ids = [x for x in by_text[t or ""] if x is not None]
        head = (max(ids) if keep == "largest" else min(ids)) if ids else None
        out.append((i, head, len(by_text[t or ""]), i == head, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("keep", ["largest", "smallest"])
@pytest.mark.parametrize("hashed", [exact_dedup.content_hash, lambda t: F.substring(exact_dedup.content_hash(t), 1, 0), lambda t: F.length(t).cast("string").cast("binary")])
def test_groups_even_when_hashes_collide(spark, keep, hashed):
    df = spark.createDataFrame([(i, t, "k") for i, t in TEXTS], "doc_id bigint, text string, keep_id string").repartition(3)
    got = [tuple(r) for r in exact_dedup.exact_groups(df, keep=keep, hashed=hashed).collect()]
    assert sorted(got, key=repr) == expected_groups(TEXTS, keep)
    left = [(r.doc_id, r.text) for r in exact_dedup.survivors(df, keep=keep, hashed=hashed).collect()]
    assert len(left) == len({t or "" for _, t in left}) == len({t or "" for _, t in TEXTS})
    heads = {(i, s) for i, head, _, kept, s in expected_groups(TEXTS, keep) if kept}
    assert {(i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in left} == heads


def test_exact_dedup_of_nothing(spark):
    empty = spark.createDataFrame([], DOCS)
    assert exact_dedup.exact_groups(empty).count() == 0 and exact_dedup.survivors(empty).columns == empty.columns


# -- URL rules -----------------------------------------------------------------------------------------
RULES = ["allow org/", "block example.org/es/", "block example.org/en/1", "allow com/fr/", "block com/de/"]
URLS = [
    None, "", "no-scheme", "http://", "http://org", "http://org/", "HTTPS://Sub.EXAMPLE.org/es/x?y#z", "https://example.org/es", "https://example.org/en/1234",
    "https://example.org/en/2", "https://notexample.org/es/", "http://a.com/fr/", "http://a.com/de/x", "http://a.com/fr", "http://com/de/", "http://a.comx/de/",
    "http://x.org?q=http://a.com/de/", "http://é.org/ü", "http://a.org:80/x", "x://y://z.org/", "http://example.org/ES/", "http://a.b.example.org/en/1#x", "a\nb://org/x\ny", "http://org/" + "x" * 20000,
]


def judged(url, rules, default="allow"):
    """The same by reading every rule."""
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    best = None
    for line in rules:
        verdict, text = line.split(" ")
        h, _, p = text.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(text) > len(best[0])):
            best = text, verdict
    return host, path, best and best[0], best[1] if best else default


@pytest.mark.parametrize("rules", [RULES, [], ["block com/", "allow b.com/x", "block a+b.com/(x)/", "block net/"]])
def test_urls_against_every_rule(spark, rules):
    urls = [*URLS, "http://a+b.com/(x)/y", "http://c.b.com/xyz", "http://net/"]
    df = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(urls)], "page_id bigint, url string, verdict string")
    out = url_rules.judge(df, [url_rules.parse_rule(x) for x in rules]).collect()
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out} == {i: judged(u, rules) for i, u in enumerate(urls)}


def test_only_candidates_run_and_rules_are_filed_under_rare_tokens(spark):
    df = spark.createDataFrame([(i, f"http://s{i}.example.org/en/{i}") for i in range(20)] + [(99, "http://a.example.org/es/")], "page_id bigint, url string")
    out = {r.page_id: r.n_candidates for r in url_rules.judge(df, [url_rules.parse_rule("block example.org/es/")]).collect()}
    assert out[99] == 1 and set(out[i] for i in range(20)) == {0}  # filed under path:es, not under example or org
    with pytest.raises(ValueError):
        url_rules.parse_rule("maybe org/")


def test_many_rules_are_joined_and_give_the_same(spark, monkeypatch):
    rules = [*RULES, *[f"block s{i}.net/a/{i}/" for i in range(30)], "allow net/"]
    urls = [*URLS, *[f"http://x.s{i}.net/a/{i % 7}/b" for i in range(40)], URLS[5], URLS[6]]
    df = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(urls)], "page_id bigint, url string, verdict string")
    parsed = [url_rules.parse_rule(x) for x in rules]
    inline = sorted(map(tuple, url_rules.judge(df, parsed).collect()), key=repr)
    joined = url_rules.judge(df, parsed, inline_rules=0)
    assert sorted(map(tuple, joined.collect()), key=repr) == inline and "Python" not in joined._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, url_rules.judge(df, parsed, inline_rules=0).collect()), key=repr) == inline
    assert {(r[-2], r[0], r[1], r[2], r[3]) for r in inline} == {(i, *judged(u, rules)) for i, u in enumerate(urls)}


def test_url_plan_is_native_and_narrow(spark):
    df = spark.createDataFrame([(1, "http://a.org/")], "page_id bigint, url string")
    plan = url_rules.judge(df, [url_rules.parse_rule(x) for x in RULES])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


# -- mixing --------------------------------------------------------------------------------------------
def test_raking_meets_all_margins():
    rng = np.random.default_rng(0)
    codes = [np.repeat(np.arange(4), 6), np.tile(np.repeat(np.arange(3), 2), 4), np.tile(np.arange(2), 12)]
    tokens = rng.integers(500, 2000, 24).astype(float)
    targets = [np.array([0.3, 0.3, 0.2, 0.2]), np.array([0.5, 0.3, 0.2]), np.array([0.6, 0.4])]
    rate = mixing.rake(codes, tokens, targets, 0.3 * tokens.sum())
    for code, target in zip(codes, targets, strict=True):
        assert np.allclose(np.bincount(code, weights=tokens * rate) / (0.3 * tokens.sum()), target, atol=1e-4)


def docs(spark, n=4000):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(["word"] * int(rng.integers(1, 120))), ["en", "de", None][int(rng.choice(3, p=[0.6, 0.3, 0.1]))], f"s{int(rng.choice(4, p=[0.7, 0.1, 0.1, 0.1]))}", 0) for i in range(n)]
    return spark.createDataFrame([*rows, (None, None, None, None, None), (n, "", "en", "s0", 0)], DOCS)


def test_sampled_tokens_come_close_to_the_targets(spark):
    df = docs(spark).cache()
    out = mixing.decisions(df, targets={"source": {"s0": 0.4, "s1": 0.2, "s2": 0.2, "s3": 0.2}, "lang": {"en": 0.5, "de": 0.4, None: 0.1}}, budget_share=0.3).toPandas()
    assert len(out) == df.count() and out.probability.between(0, 1).all()
    expected = (out.tokens * out.probability).groupby(out.source).sum()
    assert np.allclose(expected / expected.sum(), [0.4, 0.2, 0.2, 0.2], atol=1e-3)
    assert abs((out.tokens * out.probability).sum() / out.tokens.sum() - 0.3) < 1e-3
    kept = out[out.kept].groupby("source").tokens.sum()
    assert np.allclose(kept / kept.sum(), [0.4, 0.2, 0.2, 0.2], atol=0.05)
    assert sorted(r.doc_id for r in mixing.sample(df, targets={"source": {"s0": 0.4, "s1": 0.2, "s2": 0.2, "s3": 0.2}, "lang": {"en": 0.5, "de": 0.4, None: 0.1}}, budget_share=0.3).where("doc_id IS NOT NULL").collect()) == sorted(out[out.kept & out.doc_id.notna()].doc_id)


def test_raking_by_frames_gives_the_same_rates(spark):
    df = docs(spark, 600).cache()
    a, b = (mixing.decisions(df, driver_cells=n).toPandas().set_index("doc_id").probability.sort_index() for n in (1000, 0))
    assert np.allclose(a, b, atol=1e-6)


def test_mixing_of_nothing_and_of_no_tokens(spark):
    assert mixing.decisions(spark.createDataFrame([], DOCS)).count() == 0
    assert mixing.sample(spark.createDataFrame([(1, None, None, None, None), (1, None, None, None, None)], DOCS)).columns == DOCS.replace(" bigint", "").replace(" string", "").split(", ")


@pytest.mark.parametrize("driver_cells", [1000, 0])
def test_documents_without_tokens_are_kept_at_their_cells_rate(spark, driver_cells):
    texts = [(i, "word " * 20, ["en", "de"][i % 2], "s0", 0) for i in range(40)]
    empty = [(100, None, "en", "s0", 0), (101, "", "en", "s0", 0), (102, "", "xx", "s0", 0), (103, " ", "en", "s9", 0)]
    df = spark.createDataFrame([*texts, *empty], DOCS)
    rate = {r.doc_id: r.probability for r in mixing.decisions(df, driver_cells=driver_cells).collect()}
    assert np.allclose([rate[i] for i in (0, 1, 100, 101, 102, 103)], 0.6, atol=1e-4)
    barred = {r.doc_id: r.probability for r in mixing.decisions(df, targets={"source": {"s0": 1.0}}, driver_cells=driver_cells).collect()}
    assert barred[103] == 0 and abs(barred[102] - 0.6) < 1e-4
    nothing = mixing.sample(spark.createDataFrame(empty, DOCS), driver_cells=driver_cells)
    assert sorted(r.doc_id for r in nothing.collect()) == [100, 101, 102, 103]


def test_topics():
    texts = {"": "empty", None: "empty", "a | b | c": "table", "x### y$$$ z***": "symbols", "SHOUTING OUT LOUD": "capitals", "hello there": "note", "word " * 200: "prose", "word " * 3000: "long", "é" * 399: "note", "é" * 400: "prose"}
    assert {t: mixing.describe_text(t)[0] for t in texts} == texts


@pytest.mark.parametrize("stretch", [1, 3, 1 << 20])
def test_tokens_are_runs_of_what_is_not_blank(monkeypatch, stretch):
    monkeypatch.setattr(mixing, "_STRETCH", stretch)
    for text in ["", " ", "a", " a", "a ", "a b\tc\n\nd", "é 日本\x0b😀  x\r\ny", "\u00a0 \u2003"]:
        assert mixing.describe_text(text)[1] == len([w for w in re.split("[ \t\n\x0b\f\r]+", text) if w])


def test_a_given_topic_and_margins(spark):
    rows = [(i, "word " * 10, "en", f"s{i % 2}", 0, ["x", "y", None][i % 3]) for i in range(600)]
    df = spark.createDataFrame(rows, DOCS + ", topic string")
    out = mixing.decisions(df, topic_col="topic", targets={"topic": {"x": 0.5, "y": 0.3, None: 0.2}}, budget_share=0.5)
    got = {(r.dimension, r.value): r.expected for r in mixing.margins(out).collect()}
    assert np.allclose([got["topic", v] / 3000 for v in ("x", "y", None)], [0.5, 0.3, 0.2], atol=1e-3)
    assert mixing.sample(df, topic_col="topic", targets={"topic": {"y": 1.0}}, budget_share=0.2).where("topic <> 'y' OR topic IS NULL").count() == 0


def test_targets_that_cannot_be_met_are_named(spark):
    df = spark.createDataFrame([(i, "word " * 10, "en", "big" if i % 10 else "small", 0) for i in range(200)], DOCS)
    with pytest.warns(UserWarning, match="small"):
        mixing.decisions(df, targets={"source": {"big": 0.5, "small": 0.5}}, budget_share=0.6)
    with pytest.warns(UserWarning, match="not met"):
        mixing.decisions(df, targets={"source": {"big": 0.5, "small": 0.5}}, budget_share=0.6, driver_cells=0, sweeps=2)


# -- registered queries -----------------------------------------------------------------------------------
def test_registered_sharding(spark, sf_dir):
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    out = queries.op3_sharding(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in out) == sorted(docs)
    assert all(r["size"] == len(docs[r.doc_id]) + 16 and r.text_crc32 == zlib.crc32(docs[r.doc_id]) and r.law == "rows" and r.grown_shard is None for r in out)
    slots = collections.defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    assert set(slots) == set(range(40)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert "Python" not in queries.op3_sharding(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


def test_registered_mixing(spark, sf_dir):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    out = queries.op5_mixing(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in out) == sorted(docs)
    assert all((r.topic, r.tokens) == mixing.describe_text(docs[r.doc_id].text) and (r.lang, r.source) == (docs[r.doc_id].lang, docs[r.doc_id].source) for r in out)
    total = sum(r.tokens for r in out)
    assert sum(r.tokens * r.probability for r in out) == pytest.approx(0.6 * total, rel=5e-3)  # a few short texts are all taken
    for dim in ("source", "lang", "topic"):
        held, reached = collections.Counter(), collections.Counter()
        for r in out:
            held[r[dim]] += r.tokens
            reached[r[dim]] += r.tokens * r.probability
        goal = {v: (n / total) ** 0.85 for v, n in held.items() if n}
        assert all(reached[v] / (0.6 * total) == pytest.approx(g / sum(goal.values()), abs=2e-3) for v, g in goal.items())


def test_registered_sentencepiece(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    coder = unigram.Coder(unigram.build(queries.MODEL_PATH))
    out = queries.op6_sentencepiece(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in out) == sorted(docs)
    for r in out:
        if docs[r.doc_id] is None:
            assert r.ids is None and r.round_trip is None
        else:
            ids = np.array(r.ids, dtype=np.int32)
            assert r.round_trip and coder.decode(ids) == docs[r.doc_id] and r.n_tokens == len(ids) and r.n_byte_tokens == coder.is_byte[ids].sum()
