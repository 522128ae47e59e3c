"""The corpus pipeline: toxicity, exact dedup, MinHash near-dedup, mixing, SentencePiece encoding.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the last
return the columns of documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillboard.llm import exact_dedup, minhash, mixing, queries, toxicity, unigram
from quillboard.llm.common import checkpoint_dir, delete, scratch


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; labels come from the labels table.

    Null, empty and letterless texts score as clean and stay, rows of equal text are decided alike, and rows
    without id or with a repeated one go by their own text. Without labels of both classes all stay.
    """
    model = queries.toxicity_model(docs, queries.table(spark, sf_dir, "labels"))
    scored = toxicity.predict(docs.withColumnRenamed("score", "__qb_score") if "score" in docs.columns else docs, model)
    kept = scored.where(F.col("score") < queries.TOXIC).drop("score")
    return kept.select(*[F.col(f"`{'__qb_score' if c == 'score' else c}`").alias(c) for c in docs.columns])


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text: that of the largest id, as in the operator's query.

    Null counts as the empty text; a row without id stays only where no copy has one; of rows equal in id
    and text one stays. An empty table stays empty.
    """
    return exact_dedup.survivors(docs, keep="largest")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component: five-word shingles, similarity 0.8 or more.

    Texts without words stay, each. Decisions go by row: of a component the row of the smallest id stays,
    and one without id only where none has one; other texts under the same id, or none, are left alone.
    """
    return minhash.survivors(docs, size=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn to the target weights of source, language and topic.

    Null sources and languages are values of their own; texts without tokens are drawn at their cell's rate;
    rows equal in id and text are decided alike. An empty table stays empty.
    """
    return mixing.sample(docs, budget_share=0.6, alpha=0.85)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document that is left: null for a null text, none for an empty one; one row for each row."""
    coded = unigram.encode_column(docs.select("doc_id", "text", "lang", "source"), unigram.build(queries.MODEL_PATH))
    return coded.select("doc_id", "lang", "source", "n_tokens", "n_byte_tokens", "round_trip", "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("exact_dedup", drop_copies),
    ("minhash_near_dedup", drop_near_copies),
    ("mixing", mix),
    ("sentencepiece", encode),
]

#: A trained classifier, hashed signatures and Viterbi segmentation have no SQL form: see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`, each written to the shared folder and read again.

    What a stage and its predecessor wrote for it is deleted once its own rows are written.
    """
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        with scratch(spark):
            stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{folder}/{i}-{name}")
        docs = spark.read.parquet(f"{folder}/{i}-{name}")
        if i:
            delete(spark, f"{folder}/{i - 1}-{STAGES[i - 1][0]}")
    return docs
