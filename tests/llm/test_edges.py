"""Repeated rows, ties, very long texts and clashing names in the text operators."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from chronofold.llm import bpe, langid, mixing
from chronofold.llm.htmltree import SiteStyleTree
from chronofold.llm.pii import ContextualPII
from chronofold.llm.quality import SiteQuality

LONG = "some words in a row " * 40000
ROWS = [(1, "one two three", "s", "en"), (1, "one two three", "s", "en"), (2, "mail a@b.cc", None, "en"), (3, LONG, "s", None), (None, "no id", "s", "en"), (None, "no id", "s", "en"), (4, None, None, None), (5, "", "s", "en")]


def twins_agree(rows):
    """Every input row has one row, and rows of one id and text are alike."""
    assert Counter(r["doc_id"] for r in rows) == Counter(r[0] for r in ROWS)
    for doc_id in (1, None):
        assert len({str(r) for r in rows if r["doc_id"] == doc_id}) == 1


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, source string, lang string")


def test_raking(docs):
    rows = mixing.Raking().transform(docs).collect()
    twins_agree(rows)
    by = {r["doc_id"]: r for r in rows}
    assert by[3]["tokens"] >= 200000 and by[4]["tokens"] == by[5]["tokens"] == 0


def test_round_trip(docs):
    rows = bpe.round_trip(docs, bpe.tokenizer_path("byte_bpe_50k.json")).collect()
    twins_agree(rows)
    assert {r["doc_id"]: r["n_tokens"] for r in rows}[4] == 0


def test_personal_data(docs):
    rows = ContextualPII().transform(docs).collect()
    twins_agree(rows)
    assert sum(r["n_email"] for r in rows) == 1


def test_quality(spark, docs):
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (None, 1), (5, None)], "doc_id long, quality int")
    named = docs.withColumn("score", F.lit("mine")).withColumn("quality", F.lit("mine"))
    rows = SiteQuality().transform(named, labels).collect()
    twins_agree(rows)
    assert all(0 < r["score"] < 1 for r in rows)


def test_language_ties_go_to_one_language(spark):
    rows = [(k, "abc abd", "xx" if k % 2 else "aa") for k in range(40)] + [(k, "abc abd", "xx" if k % 2 else "aa") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, F.lit(True))
    got = langid.predict(docs, model).collect()
    assert len(got) == 80 and {r["lang_pred"] for r in got} == {"aa"}
    assert all(r["score"] == pytest.approx(0.5) for r in got)


def test_repeated_pages(spark):
    page = "<html><body><nav>Home</nav><article><p>Body &amp; soul</p></article></body></html>"
    pages = spark.createDataFrame([(1, "http://h.example/1", page)] * 3 + [(None, None, page), (2, "http://h.example/2", "<p>" + LONG)], "page_id long, url string, html string")
    got = SiteStyleTree().transform(pages).collect()
    assert len(got) == 5
    assert {r["text"] for r in got if r["page_id"] != 2} == {"Body & soul"}
    assert [r["n_chars"] for r in got if r["page_id"] == 2] == [len(LONG.strip())]
