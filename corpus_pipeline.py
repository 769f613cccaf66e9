"""Training corpus pipeline: language ID, near-dedup, personal data, mixing, tokens.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but
the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.llm import bpe, langid
from chronofold.llm.common import BROADCAST_IDS, materialize, read
from chronofold.llm.minhash import NearDuplicates
from chronofold.llm.mixing import Raking
from chronofold.llm.pii import ContextualPII

#: Posterior under which a document's language counts as unknown.
LEAST_SCORE = 0.5
#: Power of the corpus's own shares that the mixture aims at.
TEMPER = 0.95


def _row(docs: DataFrame) -> Column:
    """All columns of a row as one, so that no name of theirs meets one of an operator."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def _columns(docs: DataFrame) -> list[Column]:
    return [F.col(f"row.`{c}`").alias(c) for c in docs.columns]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; without letters, or between languages, they go.

    A null, empty or letterless text goes; a null lang is not learned from but may be recognised.
    Repeated rows and rows of equal texts fare alike. An empty table stays empty. All columns stay.
    """
    model = langid.fit(docs, ~langid.held_out())
    scored = langid.predict(docs.select(_row(docs), F.col("text").cast("string").alias("text")), model)
    return scored.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*_columns(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five words, 0.8), the one with the smallest id.

    Rows without an id of their own (a null or repeated doc_id) are documents by their text: they
    are numbered after all others, so of copies one stays. Texts without words are no copies of
    each other and stay. An empty table stays empty. All columns stay.
    """
    rows = docs.select(_row(docs), F.col("doc_id").cast("long").alias("uid"), F.col("text").cast("string").alias("text"))
    again = materialize(rows.groupBy("uid").count().where("count > 1 OR uid IS NULL").select(F.col("uid").alias("own")))
    if not again.isEmpty():
        top = rows.agg(F.max("uid")).first()[0] or 0
        same = F.col("uid").eqNullSafe(F.col("own"))
        odd = materialize(rows.join(again, same, "left_semi").withColumn("uid", F.lit(top) + 1 + F.monotonically_increasing_id()))
        rows = rows.join(again, same, "left_anti").unionByName(odd)
    found = materialize(NearDuplicates(width=5, num=80, den=100).transform(rows.select("uid", "text"), id_col="uid"))
    gone = found.where("NOT kept").select(F.col("doc_id").alias("uid"))
    few = gone.count() <= BROADCAST_IDS
    return rows.join(F.broadcast(gone) if few else gone, "uid", "left_anti").select(*_columns(docs))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind, and n_chars counted anew.

    Every row stays, in number and columns; null and empty texts stay as they are, repeated rows
    change alike. An empty table stays empty.
    """
    masked = ContextualPII().mask(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else masked


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose sources, languages and topics have the target weights.

    A null source or lang is a value of its own; documents without tokens are not sampled; rows that
    repeat an id share their draw. An empty table stays empty. All columns stay as they are.
    """
    needed = ["doc_id", "text", "source", "lang", *(["topic"] if "topic" in docs.columns else [])]
    return Raking(temper=TEMPER).transform(docs.select(_row(docs), *needed)).where("sampled").select(*_columns(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, lossless) of every document that is left; a null text has no ids. An empty table stays empty."""
    return bpe.tokenised(docs, bpe.tokenizer_path("byte_bpe_50k.json"))


STAGES = [("language ID", language), ("MinHash near-dedup", near_dedup), ("PII", personal_data), ("mixing", mixture), ("BPE", tokens)]

#: Signatures, naive Bayes and merges are beyond SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage before it is written as Parquet and read again."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
