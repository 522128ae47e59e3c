"""The corpus pipeline: each stage on all that the stage before it kept, against plain Python."""

import hashlib
import random

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from quillboard.llm import minhash, queries, toxicity
from tests.llm.test_minhash import expected as near_components
from tests.test_entry import matches

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def tables(spark, sf_dir, tmp_path_factory):
    """The smallest tables, with planted copies, near copies and toxic texts."""
    rng = random.Random(3)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    planted = []
    for k, d in enumerate(docs[:10]):
        planted.append((10_000 + k, d.text, d.lang, d.source, d.n_chars))
        words = d.text.split(" ")
        if len(words) > 80:
            words[rng.randrange(len(words))] = "altered"
            planted.append((20_000 + k, " ".join(words), d.lang, d.source, d.n_chars))
    planted += [(30_000, None, None, None, None), (30_001, "", "en", "src0", 0), (None, "no id at all", "en", "src0", 3)]
    near = [" ".join(f"w{rng.randrange(500)}" for _ in range(60)) for _ in range(4)]
    planted += [(None, near[0], "en", "src0", 1), (None, near[0] + " tail", "en", "src0", 1), (40_000, near[1], "en", "src0", 1), (None, near[1].upper(), "en", "src0", 1)]
    planted += [(40_001, near[1] + " tail", "en", "src0", 1), (40_001, near[2], "en", "src0", 1), (40_001, near[3], "en", "src0", 1), (40_002, near[2] + " end", None, None, 1), (None, None, "en", None, 1)]
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([tuple(d) for d in docs] + planted, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    return folder


def one_of_each(rows):
    """One row of each component of near copies (texts told apart by row, not by id), and every row without words."""
    found = near_components([(k, r[1]) for k, r in enumerate(rows)], 5)
    groups, kept = {}, []
    for k, size, component, _ in found:
        if size:
            groups.setdefault(component, []).append(rows[k])
        else:
            kept.append(rows[k])
    return kept + [min(group, key=lambda r: (r[0] is None, r[0] or 0, hashlib.sha256(r[1].encode()).digest())) for group in groups.values()]


def test_survivors_of_repeated_rows(spark):
    base = " ".join(f"w{i}" for i in range(40))
    rows = [(1, base)] * 3 + [(1, base + " x"), (2, base + " y"), (None, "q w e r t y"), (None, "q w e r t y"), (None, None), (None, None), (5, " ")]
    out = [tuple(r) for r in minhash.survivors(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()]
    assert sorted(map(repr, out)) == sorted(map(repr, one_of_each(rows)))


def test_stages_of_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    with pytest.warns(UserWarning):
        assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_every_stage(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    model = queries.toxicity_model(docs, queries.table(spark, tables, "labels"))
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        out = stage(spark, docs, tables)
        after = out.collect()
        if name != "sentencepiece":
            assert out.columns == COLUMNS
            assert {tuple(r) for r in after} <= {tuple(r) for r in before}
        if name == "toxicity":
            scores = toxicity.score_texts(model, [r.text for r in before])
            assert sorted(map(repr, after)) == sorted(repr(r) for r, s in zip(before, scores, strict=True) if s < queries.TOXIC)
        elif name == "exact_dedup":
            assert sorted((r.text or "") for r in after) == sorted({r.text or "" for r in before})
            top = {}
            for r in before:
                top[r.text or ""] = max(top.get(r.text or "", -1), -1 if r.doc_id is None else r.doc_id)
            assert all(r.doc_id is None or r.doc_id == top[r.text or ""] for r in after)
        elif name == "minhash_near_dedup":
            assert sorted(map(repr, map(tuple, after))) == sorted(map(repr, one_of_each([tuple(r) for r in before]))) and len(after) < len(before)
        elif name == "mixing":
            assert 0 < len(after) < len(before)
        else:
            assert sorted(map(repr, (r.doc_id for r in after))) == sorted(map(repr, (r.doc_id for r in before))) and all(r.round_trip is not False for r in after)
        docs = spark.createDataFrame(after, out.schema) if after else out


def test_run_and_registration(spark, tables):
    first = corpus_pipeline.run(spark, tables)
    assert first.count() > 0 and entry.queries()["pipeline"] is corpus_pipeline.run
    again = corpus_pipeline.run(spark, tables)
    assert sorted(map(repr, first.select("doc_id", "n_tokens").collect())) == sorted(map(repr, again.select("doc_id", "n_tokens").collect()))


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_with_sql(spark, sf_dir, name):
    connection = duckdb.connect()
    for table in ("documents", "embeddings", "pages"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    matches(spark, connection, sf_dir, queries.QUERIES[name], queries.SQL[name])


@pytest.mark.parametrize("name", ["op1_language_id", "op2_quality", "op7_toxicity"])
def test_classifiers_give_a_row_for_each_document(spark, sf_dir, name):
    import zlib

    fold = {"op1_language_id": (4, 2)}.get(name, (3, 1))
    got = queries.QUERIES[name](spark, sf_dir).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert len(got) == len(docs) and {r.doc_id for r in got} == set(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % fold[0] == fold[1]) and 0 <= r.score <= 1 for r in got)
    if name == "op1_language_id":
        held = [r for r in got if r.held_out]
        assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) > 0.9 * len(held)
    else:
        assert all(r.predicted == (r.score >= (0.5 if name == "op2_quality" else 0.7)) for r in got)


def test_labels_language_source_and_ids_do_not_reach_a_score(spark, sf_dir, tmp_path):
    """Held-out texts score the same under other ids' labels, languages and sources."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = "crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 3 = 1"
    docs.selectExpr("doc_id", "text", f"CASE WHEN {held} THEN 'xx' ELSE lang END AS lang", "'s' AS source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/labels.parquet").selectExpr("doc_id", f"CASE WHEN {held} THEN 1 - quality ELSE quality END AS quality", f"CASE WHEN {held} THEN 1 - toxic ELSE toxic END AS toxic").write.parquet(f"{tmp_path}/labels.parquet")
    for name in ("op2_quality", "op7_toxicity"):
        a, b = ({r.doc_id: r.score for r in queries.QUERIES[name](spark, d).collect()} for d in (sf_dir, str(tmp_path)))
        assert a == b
