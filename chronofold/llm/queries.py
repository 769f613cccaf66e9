"""The operators as queries over the test tables, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, langid, mixing, quality, token_orc
from .common import read, scratch_path
from .divergence import SourceDivergence, oracle as divergence_oracle
from .htmltree import SiteStyleTree
from .minhash import NearDuplicates
from .pii import ContextualPII
from .pstable import EmbeddingDuplicates
from .sharding import ExternalShuffle, place
from .topk import ExactTopK
from .whitening import Whitening, long_form

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return NearDuplicates(width=3, num=85, den=100).transform(read(spark, sf_dir, "documents"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.Raking(temper=0.7, rounds=8, seed=11).transform(read(spark, sf_dir, "documents"))
    unknown = [F.coalesce(F.col(c), F.lit("unknown")).alias(c) for c in ("source", "lang")]
    return mixed.select("doc_id", *unknown, "topic", "tokens", F.round("factor", 6).alias("factor"), F.round("probability", 6).alias("probability"), "sampled")


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read(spark, sf_dir, "documents"), bpe.tokenizer_path(BYTE_BPE))


def op4_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SiteStyleTree().transform(read(spark, sf_dir, "pages"))


def op5_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens-")
    token_orc.write(read(spark, sf_dir, "documents"), path, bpe.tokenizer_path(WORD_BPE), end_id=2)
    return token_orc.digests(spark, path)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = langid.fit(docs, ~langid.held_out())
    return langid.predict(docs, model).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op7_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ContextualPII().transform(read(spark, sf_dir, "documents"))


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ExactTopK(k=10, scale=1024).transform(read(spark, sf_dir, "embeddings"), "vec_id % 100 = 0")


def op9_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.SiteQuality().transform(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return scored.select("doc_id", "host", "path", *[F.round(c, 6).alias(c) for c in ("prior", "evidence", "score")], "keep")


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return EmbeddingDuplicates(cosine=0.9).transform(read(spark, sf_dir, "embeddings"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SourceDivergence(least=10, top=10).transform(read(spark, sf_dir, "documents"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_form(Whitening(components=32, scale=64, offset=1_000_000).transform(read(spark, sf_dir, "embeddings")))


def op13_shuffled_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ExternalShuffle(shards=24).digests(read(spark, sf_dir, "documents"), scratch_path(spark, "shards-"), place())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_minhash_near_dedup, op2_source_mixing, op3_bpe_round_trip, op4_html_main_text, op5_token_orc,
        op6_language_id, op7_contextual_pii, op8_exact_topk, op9_site_quality, op10_embedding_near_dedup,
        op11_source_divergence, op12_embedding_whitening, op13_shuffled_shards,
    )
}

_REACH = """, both_ AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT a, b FROM both_ UNION SELECT r.a, e.b FROM reach r JOIN both_ e ON e.a = r.b),
low AS (SELECT a, min(b) AS b FROM reach GROUP BY a)"""

ORACLE_SQL: dict[str, str] = {
    "op1_minhash_near_dedup": """WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c))"""
    + _REACH
    + """
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(low.b, doc_id)) AS component_id, doc_id <= coalesce(low.b, doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN low ON low.a = doc_id""",
    "op2_source_mixing": mixing.oracle(0.7, 8, 11),
    "op8_exact_topk": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op9_site_quality": quality.oracle(),
    "op11_source_divergence": divergence_oracle(10, 10),
    "op10_embedding_near_dedup": """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
link AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id < y.vec_id
  WHERE list_dot_product(x.e, y.e) / sqrt(list_dot_product(x.e, x.e)) / sqrt(list_dot_product(y.e, y.e)) >= 0.9)"""
    + _REACH
    + """,
n AS (SELECT a, count(*) AS n FROM both_ GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(low.b, vec_id)) AS component_id, vec_id <= coalesce(low.b, vec_id) AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN low ON low.a = vec_id""",
}
