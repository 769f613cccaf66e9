"""Queries over the test tables, from which logs and claims are derived."""

from __future__ import annotations

import itertools
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..engine import Engine
from ..functions import constants as C
from ..functions import scalars as X
from ..operators import claims as ops
from ..operators import consolidate, lexical, vectors, writes
from ..operators.cells import CellIndex
from ..operators.replay import replay
from ..session import scratch_path, ship
from ..sources import schemas
from ..sources.lake import Lake

NOW = "2024-04-01T00:00:00Z"
PHRASE = "the thing and the other"
#: Similarity thresholds that separate pairs of the test vectors.
REVIEW, MERGE = 0.40, 0.45


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def derived_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations from events: the first of a user asserts, others act on the latest claim."""
    e = read(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), "user_id", "event_type", F.get_json_object("props", "$.k").cast("int").alias("k"), F.date_format("ts", C.TIME_FORMAT).alias("ts")
    )
    w = Window.partitionBy("user_id").orderBy("seq")
    root = F.concat(F.lit("c"), F.col("user_id").cast("string"))
    e = e.withColumn("rn", F.row_number().over(w))
    e = e.withColumn("nid", F.when((F.col("rn") > 1) & (F.col("event_type") == "purchase") & (F.col("k") % 5 == 0), F.concat(root, F.lit("_"), F.col("seq").cast("string"))))
    e = e.withColumn("tgt", F.coalesce(F.last("nid", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), root))
    kind, k, first = F.col("event_type"), F.col("k"), F.col("rn") == 1
    op = (
        F.when(first, "assert").when(kind.isin("click", "view"), "touch").when((kind == "error") & (k % 2 == 0), "supersede").when(kind == "error", "forget")
        .when(kind == "signup", "restore").when(F.col("nid").isNotNull(), "supersede").otherwise("confidence")
    )
    none = F.lit(None).cast("string")
    return e.select(
        F.col("seq").cast("long").alias("seq"), root.alias("lineage_id"), op.alias("op"), F.when(first, root).alias("id"), F.when(~first, F.col("tgt")).alias("target"), F.col("nid").alias("new_id"),
        F.when(first | F.col("nid").isNotNull(), F.concat(F.lit("t"), F.col("seq").cast("string"))).alias("text"), (F.col("nid").isNotNull() & (k % 2 == 0)).alias("carry"), F.lit(None).cast("boolean").alias("hard"),
        F.when(k % 3 == 0, "low").when(k % 3 == 1, "mid").otherwise("high").alias("to"), "ts", none.alias("key"), kind.alias("kind"), F.concat(F.lit("u"), (F.col("user_id") % 10).cast("string")).alias("entity"),
        none.alias("source"), F.lit("low").alias("confidence"), F.col("ts").alias("created"), F.lit(0).cast("long").alias("hits"), none.alias("last_accessed"), none.alias("extra"),
    )


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay(derived_log(spark, sf_dir))


def document_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims from documents: language as kind, source as entity, label as confidence."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels").select("doc_id", "quality")
    level = F.when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low").otherwise("mid")
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").cast("string").alias("id"), "text", F.col("lang").alias("kind"), F.col("source").alias("entity"), level.alias("confidence"), (F.col("doc_id") % 7).alias("hits"),
        F.lit("2024-01-01T00:00:00Z").alias("created"), F.lit("active").alias("status"), F.col("doc_id").alias("birth_seq"),
    )


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("vec_id").alias("ord"), "embedding", "label")


def _vector(spark: SparkSession, sf_dir: str, vec_id: int) -> list[float]:
    return _vectors(spark, sf_dir).where(F.col("id") == vec_id).first()["embedding"]


def recall_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Through a stored index of cells."""
    index = CellIndex.build(_vectors(spark, sf_dir), scratch_path(spark, "cells-"))
    return index.search(_vector(spark, sf_dir, 0), 5).select(F.col("id").cast("long").alias("id"), F.round("score", 4).alias("score"))


def recall_topk_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    asked = rows.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("q"))
    return vectors.topk_batch(rows, asked, 5).select("query_id", "id", F.col("rank").cast("long").alias("rank"), F.round("score", 4).alias("score"))


def find_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir).where("id <> 7")
    return vectors.topk(rows, _vector(spark, sf_dir, 7), 1).select("id", F.round("score", 4).alias("score"), (F.round("score", 4) >= C.DEDUP).alias("is_duplicate"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.similar_pairs(_vectors(spark, sf_dir), REVIEW)


def sim_pairs_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consolidate.bands(_pairs(spark, sf_dir), MERGE)[1].select(F.col("a_ord").alias("a"), F.col("b_ord").alias("b"), "score")


def sim_pairs_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consolidate.bands(_pairs(spark, sf_dir), MERGE)[0].select(F.col("a_ord").alias("a"), F.col("b_ord").alias("b"), "score")


def greedy_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merges at REVIEW, with hits and creation derived from ids."""
    rows = _vectors(spark, sf_dir).select(F.col("id").cast("string").alias("id"), (F.col("id") % 5).alias("hits"), F.lit("2024-01-01T00:00:00Z").alias("created"))
    got = consolidate.greedy(consolidate.with_keeper(_pairs(spark, sf_dir), rows))
    return got.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), "score", F.col("kept").cast("long").alias("kept"), F.col("loser").cast("long").alias("loser"))


def nn_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For entries (label 0, the first 20) the nearest claim among the other labels."""
    rows = _vectors(spark, sf_dir)
    left = rows.where("label = 0").orderBy("ord").limit(C.EPISODIC_LIMIT)
    return vectors.nearest(left, rows.where("label <> 0"))


def replay_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims(spark, sf_dir).select("id", "status")


def _home(spark: SparkSession) -> str:
    return scratch_path(spark, "home-")


def log_on_disk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole log appended to a home's JSON table, scanned again and replayed."""
    lake = Lake(spark, _home(spark))
    lake.append_log(derived_log(spark, sf_dir))
    return replay(lake.oplog()).select("id", "text", "status", "confidence", "hits", "last_accessed")


def index_of_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors saved to a home's index and read back; the best of those whose claim is active."""
    lake = Lake(spark, _home(spark))
    rows = read(spark, sf_dir, "embeddings").select(F.concat(F.lit("c"), F.col("vec_id").cast("string")).alias("id"), F.lit("table").alias("model"), F.col("vec_id").alias("ord"), "embedding")
    lake.save_vectors(rows)
    live = lake.vectors("table").join(ops.active(claims(spark, sf_dir)).select("id"), "id")
    return vectors.topk(live, _vector(spark, sf_dir, 0), 5).select("id", F.round("score", 4).alias("score"))


def _engine(spark: SparkSession, provider=None) -> Engine:
    names, now = (f"m{k}" for k in itertools.count(1)), datetime.strptime(NOW, "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=timezone.utc)
    return Engine(spark, _home(spark), provider, clock=lambda: now, new_id=lambda: next(names))


def _event_home(spark: SparkSession, sf_dir: str) -> Engine:
    """A home with the log derived from events."""
    engine = _engine(spark)
    engine.lake.append_log(derived_log(spark, sf_dir))
    return engine


def command_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commands on a home with a long log: touch, restate, correct and forget the first four active claims, restore the first forgotten one, write twice under a key."""
    engine = _event_home(spark, sf_dir)
    touched, restated, corrected, gone = [r["id"] for r in ops.query(engine.claims()).select("id").limit(4).collect()]
    back = ops.query(engine.claims(), status="forgotten").first()["id"]
    engine.touch([touched])
    engine.restate(restated, "said again")
    engine.correct(corrected, "put right")
    engine.forget(gone)
    engine.restore(back)
    engine.remember("tea at nine", key="drink")
    engine.remember("coffee at ten", key="drink")
    return engine.claims().select("id", "text", "key", "status", "confidence", "hits", "last_accessed", "created", "lineage_id")


def hard_forget_in_home(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first active claim is taken out of the log; all others are as they were."""
    engine = _event_home(spark, sf_dir)
    engine.forget(ops.query(engine.claims()).first()["id"], hard=True)
    return engine.claims().select("id", "text", "status", "confidence", "hits", "created")


def snapshot_in_home(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log's first half, a compaction with its snapshot, then the second half: claims from the snapshot and what follows it."""
    engine, log = _engine(spark), derived_log(spark, sf_dir)
    half = log.agg(F.expr("(min(seq) + max(seq)) div 2")).first()[0]
    engine.lake.append_log(log.where(F.col("seq") <= half))
    engine.compact()
    engine.lake.append_log(log.where(F.col("seq") > half))
    return engine.claims().select("id", "text", "status", "confidence", "hits", "last_accessed", "created", "birth_seq", "lineage_id")


def import_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Restatements without end: each user's events, written as lines of JSON, restate the one before; the home that imports them knows each lineage."""
    e, w = read(spark, sf_dir, "events"), Window.partitionBy("user_id").orderBy("event_id")
    own, before = F.concat(F.lit("e"), F.col("event_id")), F.concat(F.lit("e"), F.lag("event_id").over(w))
    rows = e.withColumns({"own": own, "before": before}).select(
        "event_id", F.when(F.col("before").isNull(), "assert").otherwise("supersede").alias("op"), F.when(F.col("before").isNull(), F.col("own")).alias("id"), F.col("before").alias("target"),
        F.when(F.col("before").isNotNull(), F.col("own")).alias("new_id"), F.concat(F.lit("t"), F.col("event_id")).alias("text"), F.lit(True).alias("carry"), F.date_format("ts", C.TIME_FORMAT).alias("ts"), F.date_format("ts", C.TIME_FORMAT).alias("created"),
    )
    engine, path = _engine(spark), _home(spark)
    rows.orderBy("event_id").drop("event_id").write.option("lineSep", "\n").json(path)
    engine.import_log(path)
    return engine.claims().where("status = 'active'").select("id", "text", "created", "lineage_id")


class _Given:
    """A provider that has one vector for any text: the queries' vectors come from the table."""

    def __init__(self, vector: list[float]):
        self.vector, self.name = vector, "table"

    def __call__(self, texts: list[str]) -> list[list[float]]:
        return [self.vector for _ in texts]


def _vector_home(spark: SparkSession, sf_dir: str, vec_id: int) -> Engine:
    """A home with a claim and a stored vector for each row of embeddings."""
    v = read(spark, sf_dir, "embeddings")
    engine, n, id_ = _engine(spark, _Given(_vector(spark, sf_dir, vec_id))), F.col("vec_id"), F.concat(F.lit("v"), F.col("vec_id"))
    known = {
        "seq": n, "lineage_id": id_, "op": F.lit("assert"), "id": id_, "text": F.concat(F.lit("text "), n), "kind": F.lit("fact"), "entity": F.concat(F.lit("e"), F.col("label")), "hits": n % 5,
        "confidence": F.when(n % 2 == 0, "low").otherwise("high"), "created": F.when(n % 3 == 0, "2024-01-01T00:00:00Z").otherwise("2024-03-20T00:00:00Z"),
    }
    kinds = {f.name: f.dataType for f in spark.createDataFrame([], schemas.OPLOG).schema}
    engine.lake.append_log(v.select(*[known.get(c, F.lit(None)).cast(t).alias(c) for c, t in kinds.items()]))
    engine.lake.save_vectors(v.select(id_.alias("id"), F.lit("table").alias("model"), n.alias("ord"), F.col("embedding").cast("array<float>").alias("embedding"), F.lit(None).cast("string").alias("digest")))
    return engine


def context_in_home(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the context command prints: of the twenty claims recalled, those that fit the budget."""
    got = _vector_home(spark, sf_dir, 3).context("a task", 60)
    return spark.createDataFrame([(i["id"], i["text"], i["score"], i["hits"]) for i in got["items"]], "id string, text string, score double, hits long")


def recall_in_home(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims after a recall of ten and a keyless write of what a claim says already: all these are touched."""
    engine = _vector_home(spark, sf_dir, 7)
    engine.recall("anything", 10)
    engine.remember("anything")
    return engine.claims().select("id", "status", "confidence", "hits", "last_accessed")


def status_in_home(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The status command after a claim is forgotten: what the index counts is active."""
    engine = _vector_home(spark, sf_dir, 0)
    engine.forget(ops.query(engine.claims()).first()["id"])
    got = engine.status()
    return spark.createDataFrame([(got["total_claims"], got["active_claims"], got["pressure"], got["index"]["count"])], "total long, active_claims long, pressure double, indexed long")


def sleep_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims after a consolidation that forgets, merges and reviews."""
    engine = _vector_home(spark, sf_dir, 0)
    engine.consolidate(review=REVIEW, merge=MERGE)
    return engine.claims().select("id", "status", "hits")


def sleep_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report that a consolidation leaves in its home: clusters, forgotten, merged and reviewed claims."""
    engine = _vector_home(spark, sf_dir, 0)
    _, report = engine.consolidate(review=REVIEW, merge=MERGE)
    part = lambda name, rows, a, b, x: rows.select(F.lit(name).alias("part"), F.expr(a).alias("a"), F.expr(b).alias("b"), F.expr(x).alias("score"))
    found = part("cluster", report["merge_suggestions"].select("entity", "count").distinct(), "entity", "CAST(count AS STRING)", "CAST(0 AS DOUBLE)")
    found = found.unionByName(part("forget", report["forget_candidates"], "id", "CAST(days_idle AS STRING)", "retention"))
    return found.unionByName(part("merge", report["near_duplicates"], "kept", "merged", "score")).unionByName(part("review", report["review_pairs"], "a.id", "b.id", "score"))


def sleep_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit rows of a consolidation's operations."""
    engine = _vector_home(spark, sf_dir, 0)
    engine.consolidate(review=REVIEW, merge=MERGE)
    rows = engine.lake.table("audit", schemas.AUDIT).where("action IN ('forget', 'supersede')")
    return rows.select("action", F.get_json_object("detail", "$.target").alias("target"), F.get_json_object("detail", "$.ts").alias("ts"))


def episodic_in_home(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as entries of a home's log by months; a range of days of one topic is read from it."""
    lake = Lake(spark, _home(spark))
    e = read(spark, sf_dir, "events")
    lake.append_entries(e.select(F.concat(F.lit("ep_"), F.col("event_id")).alias("id"), F.date_format("ts", C.TIME_FORMAT).alias("ts"), F.concat(F.lit("saw "), F.col("event_type")).alias("text"), F.col("event_type").alias("topic"), F.col("user_id").cast("string").alias("entity"), F.col("event_id").alias("ord")))
    return ops.episodic_range(lake.episodic(), "2024-01-03", "2024-01-12", topic="error").select("id", "ts", "text", "entity")


def deep_recall_in_home(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as entries of a home: the first half of the conversations is in its index of bigrams, the others came since."""
    engine, talk = _engine(spark), read(spark, sf_dir, "conversations")
    half = talk.agg(F.expr("(min(conv_id) + max(conv_id)) div 2")).first()[0]
    name, place = F.concat(F.col("conv_id"), F.lit("/"), F.col("turn")), F.col("conv_id") * 100_000 + F.col("turn")
    rows = talk.select("conv_id", name.alias("id"), F.lit(NOW).alias("ts"), "text", F.col("role").alias("entity"), F.lit(None).cast("string").alias("topic"), place.cast("long").alias("ord"))
    engine.lake.append_entries(rows.where(F.col("conv_id") <= half).drop("conv_id"))
    engine.lake.index_entries()
    engine.lake.append_entries(rows.where(F.col("conv_id") > half).drop("conv_id"))
    return spark.createDataFrame([(r["id"], r["score"]) for r in engine.recall(PHRASE, 5, deep=True)], "id string, score double")


def sleep_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of a home after a consolidation that forgets what has faded; no pair reaches its thresholds."""
    engine = _event_home(spark, sf_dir)
    engine.consolidate(review=2.0, merge=2.0)
    return engine.claims().select("id", "status", "confidence", "hits")


def replay_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims(spark, sf_dir).select("id", "hits", "last_accessed")


def replay_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims(spark, sf_dir).select("id", "confidence")


def replay_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims(spark, sf_dir).select("id", "text", "kind", "entity", "created", "birth_seq", "lineage_id")


def query_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.query(claims(spark, sf_dir), entity="u3", status="all").select("id", "text", "status")


def query_min_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.query(claims(spark, sf_dir), min_confidence=0.6).select("id", "confidence")


def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.show(claims(spark, sf_dir), "c1").select("id", "text", "status", "hits")


def episodic_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("event_id", F.date_format("ts", C.TIME_FORMAT).alias("ts"), F.col("event_type").alias("topic"), F.col("user_id").cast("string").alias("entity"), F.col("event_id").alias("ord"))
    return ops.episodic_range(e.withColumn("month", F.substring("ts", 1, 7)), "2024-01-05", "2024-01-09", topic="click").select("event_id", "ts", "topic", "entity")


def _talk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.col("role").alias("entity"))


def deep_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Through a stored table of bigrams."""
    return lexical.BigramIndex.build(_talk(spark, sf_dir), scratch_path(spark, "bigrams-"), ["conv_id", "turn"]).search(PHRASE, 5)


def recall_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both layers, without re-ranking across them."""
    first = recall_topk(spark, sf_dir).select(F.lit(0).alias("layer"), F.col("id").cast("string").alias("id"), "score")
    second = deep_search(spark, sf_dir).select(F.lit(1).alias("layer"), F.concat(F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string")).alias("id"), "score")
    return first.unionByName(second)


def context_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One budget per source, all sources at once; earlier documents first."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    got = ops.pack(docs, C.CONTEXT_BUDGET, [F.asc("doc_id")], ["source"])
    return got.select("doc_id", "source", F.col("rn").cast("long").alias("rn"), F.col("used").cast("long").alias("used"))


def profile_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.profile_items(document_claims(spark, sf_dir), 2000).select("id", F.col("rn").cast("long").alias("rn"), "confidence", "hits", F.col("used").cast("long").alias("used"))


def forget_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.forget_candidates(claims(spark, sf_dir), F.lit(NOW)).select("id", "days_idle", "retention")


def retention_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.with_retention(claims(spark, sf_dir), F.lit(NOW)).select("id", "days_idle", F.round("retention", 6).alias("retention"))


def entity_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ops.clusters(claims(spark, sf_dir)).groupBy("entity", "count", "first_seq").agg(F.sort_array(F.collect_list(F.struct("birth_seq", "id"))).alias("x"))
    return rows.select("entity", "count", "first_seq", F.concat_ws(",", "x.id").alias("ids"))


def pressure_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.status(claims(spark, sf_dir)).select("total", "active_claims", "pressure")


def promotions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.promotions(claims(spark, sf_dir))


def render_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = document_claims(spark, sf_dir)
    return rows.select("id", F.md5(X.render(F.col("kind"), F.col("entity"), F.col("created"), F.col("text")).cast("binary")).alias("rendered_md5"))


def bigram_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _talk(spark, sf_dir).select("conv_id", "turn", F.size(X.bigrams(F.col("text"))).cast("long").alias("n_bigrams"))


def supersede_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest order of each customer, as keyed writes leave it."""
    orders = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return writes.latest_by_key(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


def exact_dup_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = writes.copies(read(spark, sf_dir, "documents"), F.md5(F.col("text").cast("binary")), "doc_id")
    return found.where("copies > 1").select(F.col("same").alias("text_md5"), F.col("first").alias("first_id"), "copies")


def keyed_writes_in_home(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written under their customer's key in two tables, those before 1998 first: of each key the last order's claim is active."""
    engine, o = _engine(spark), read(spark, sf_dir, "orders")
    rows = o.select(F.concat(F.lit("o"), "o_orderkey").alias("id"), F.concat(F.lit("c"), "o_custkey").alias("key"), F.concat(F.lit("price "), F.col("o_totalprice").cast("string")).alias("text"), F.col("o_orderdate").alias("day"), "o_orderkey")
    for part in (rows.where("day < TIMESTAMP '1998-01-01'"), rows.where("day >= TIMESTAMP '1998-01-01'")):
        engine.remember_all(part, ["day", "o_orderkey"])
    return engine.claims().select("id", "key", "status", "hits", "created")


def copies_in_home(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written without keys, even ids first: copies touch the claim that says the same."""
    engine = _engine(spark)
    rows = read(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), "text", F.col("lang").alias("kind"), F.col("source").alias("entity"), "doc_id")
    for odd in (0, 1):
        engine.remember_all(rows.where(F.col("doc_id") % 2 == odd), ["doc_id"], near=False)
    return engine.claims().select("id", "status", "confidence", "hits", "last_accessed")


def reindex_in_home(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index after a claim is put right, another forgotten, and the index built anew: vectors of active claims, old ones taken over."""
    engine = _vector_home(spark, sf_dir, 5)
    first, second = [r["id"] for r in ops.query(engine.claims()).select("id").limit(2).collect()]
    engine.correct(first, "put right")
    engine.forget(second)
    engine.reindex()
    return engine.lake.vectors("table").select("id", "model", F.col("digest").isNotNull().alias("made_here"))


def profile_in_home(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of the profile that a home keeps: active claims by confidence, hits and age within a budget."""
    engine = _vector_home(spark, sf_dir, 0)
    engine.profile(100, write=True)
    return spark.read.text(engine.lake.path("profile.md")).select(F.col("value").alias("line"))


def sleep_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A consolidation's recent entries, each with its nearest claim: events of the last days, moved to the report's month, as entries."""
    engine = _vector_home(spark, sf_dir, 9)
    e = read(spark, sf_dir, "events").select("event_id", F.date_format(F.expr("timestampadd(DAY, CAST(event_id % 40 AS INT), TIMESTAMP '2024-02-25 00:00:00')"), C.TIME_FORMAT).alias("ts"))
    engine.lake.append_entries(e.select(F.concat(F.lit("ep_"), "event_id").alias("id"), "ts", F.lit("saw it").alias("text"), F.lit(None).cast("string").alias("topic"), F.lit(None).cast("string").alias("entity"), F.col("event_id").alias("ord")))
    _, report = engine.consolidate(dry_run=True, review=2.0, merge=2.0)
    return report["best_matches"].select(F.col("id").alias("entry"), F.col("nearest").alias("claim"), "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        recall_topk, recall_topk_batch, find_similar, sim_pairs_review, sim_pairs_merge, greedy_merge, nn_join, replay_status, log_on_disk, index_of_active, command_session, hard_forget_in_home, snapshot_in_home, import_chain,
        context_in_home, recall_in_home, status_in_home, sleep_applied, sleep_merged, sleep_report, sleep_audit, sleep_entries, episodic_in_home, deep_recall_in_home, keyed_writes_in_home, copies_in_home, reindex_in_home, profile_in_home, replay_hits, replay_confidence, replay_lineage,
        query_filter, query_min_confidence, point_lookup, episodic_range, deep_search, recall_deep, context_pack, profile_pack, forget_candidates, retention_scores, entity_clusters,
        pressure_status, promotions, render_view, bigram_sets, supersede_by_key, exact_dup_text,
    )
}
