"""The note store: every command over the tables of one home.

Reads are DataFrames; a command collects only its own answer (k rows, a budget's worth, a report that is printed).
Results are taken before anything is appended, so a command never reads its own writes.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime, timedelta, timezone
from itertools import groupby

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import constants as C
from .functions import scalars as X
from .functions.embedder import HashedBigrams, embedder
from .operators import claims as ops
from .operators import consolidate, lexical, vectors
from .operators import writes as bulk
from .operators.replay import replay, with_lineage
from .session import materialize, release, ship
from .sources import schemas
from .sources.lake import ENTRY, Lake, ModelMismatch, import_jsonl

__all__ = ["Engine", "ModelMismatch", "NotFound"]


#: Views that lie upon each other at most.
LAYERS = 8


class NotFound(LookupError):
    """No claim with this id, or not in the state that the command needs."""


class Engine:
    """home: folder of the tables; provider: embedding function with a `name`; clock and ids for tests."""

    def __init__(self, spark: SparkSession, home: str | None = None, provider=None, clock: Callable[[], datetime] | None = None, new_id: Callable[[], str] | None = None):
        self.spark, self.lake = spark, Lake(spark, home)
        self.provider = provider or HashedBigrams()
        self.clock = clock or (lambda: datetime.now(timezone.utc))
        self.new_id = new_id or (lambda: uuid.uuid4().hex)
        self._view: tuple[int, dict, DataFrame, int] | None = None

    # time and ids
    def now(self) -> str:
        return self.clock().strftime("%Y-%m-%dT%H:%M:%SZ")

    def _embed(self, text: str) -> list[float]:
        return [float(x) for x in self.provider([text])[0]]

    # views
    def claims(self) -> DataFrame:
        """The claims after the newest commit, replayed once for it.

        Where commits have only added to the log that the former view knows, that view is replayed on by what they
        added; else by all that follows the snapshot. A view of LAYERS such steps is written as one table.
        """
        number, content = self.lake.commits()
        if self._view is None or self._view[0] != number:
            self._view = number, content, *self._viewed(content)
        return self._view[2]

    def _viewed(self, content: dict) -> tuple[DataFrame, int]:
        """The claims, and how many views they lie upon."""
        old = self._view[1] if self._view else None
        if old is None or old["snapshot"] != content["snapshot"] or old["log"] != content["log"][: len(old["log"])]:
            base, last = self.lake.snapshot(content)
            return replay(self.lake.oplog(last, content), base), 0
        view, layers = self._view[2:]
        if len(old["log"]) == len(content["log"]):
            return view, layers
        added = self.lake.oplog(content=content | {"log": content["log"][len(old["log"]) :]})
        view = replay(added, view)
        return (view, layers + 1) if layers + 1 < LAYERS else (materialize(view), 0)

    def import_log(self, path: str, strict: bool = False) -> int:
        """Append a log of JSON lines to this home, which may hold one already; lineages are found on the way."""
        rows = with_lineage(import_jsonl(self.spark, path, strict))
        return self.lake.append_frame(rows.orderBy("seq").drop("seq"), self.now())

    def compact(self) -> int:
        """One folder for the log's many, and a snapshot of the claims, so that later reads replay what follows only; one index of all entries for deep recalls."""
        _, seen = self.lake.commits()
        base, last = self.lake.snapshot(seen)
        log = self.lake.oplog(content=seen)
        self.lake.rewrite_ops(log.orderBy("seq"), seen, replay(self.lake.oplog(last, seen), base))
        self.lake.index_entries(whole=True)
        return len(seen["log"])

    def _active(self, claim_id: str) -> dict:
        row = ops.show(self.claims(), claim_id).where("status = 'active'").first()
        if row is None:
            raise NotFound(f"no active claim {claim_id}")
        return row.asDict()

    @staticmethod
    def _rows(df: DataFrame) -> list[dict]:
        return [r.asDict(recursive=True) for r in df.collect()]

    # index
    def _embedded(self, claims: DataFrame) -> DataFrame:
        ship(self.spark)
        text = X.render(F.col("kind"), F.col("entity"), F.col("created"), F.col("text"))
        return claims.select("id", F.lit(self.provider.name).alias("model"), F.col("birth_seq").alias("ord"), embedder(self.provider)(text).alias("embedding"), self._digest().alias("digest"))

    def _digest(self) -> Column:
        """Of the model and a claim's rendered text: a vector with another digest is out of date."""
        return F.md5(F.concat(F.lit(f"{self.provider.name}|"), X.render(F.col("kind"), F.col("entity"), F.col("created"), F.col("text"))).cast("binary"))

    def _current(self, live: DataFrame, found: DataFrame) -> DataFrame:
        """Vectors of active claims as they are now. One without a digest was made elsewhere and counts as current."""
        now = live.select(F.col("id").alias("live"), self._digest().alias("now"))
        same = (F.col("id") == F.col("live")) & (F.col("digest").isNull() | (F.col("digest") == F.col("now")))
        return found.join(now, same).drop("live", "now")

    def _missing(self, live: DataFrame, found: DataFrame | None) -> DataFrame:
        """Active claims whose rendered text has no vector."""
        return live if found is None else live.join(self._current(live, found).select("id"), "id", "left_anti")

    def reindex(self) -> int:
        """A new index of the active claims. Vectors that are up to date are taken over, retired claims' go."""
        try:
            found = self.lake.vectors(self.provider.name)
        except ModelMismatch:
            found = None
        live = ops.active(self.claims())
        made = self._embedded(self._missing(live, found))
        if found is not None:
            kept = self._current(live, found)
            made = kept.select(*made.columns).unionByName(made)
        self.lake.save_vectors(made)
        n = self.lake.vectors(self.provider.name).count()
        self.lake.audit("reindex", {"count": n, "model": self.provider.name}, self.now())
        return n

    def _index(self, write: bool = True) -> DataFrame:
        """Vectors of the active claims; claims without one are embedded now, and added unless write is false."""
        found = self.lake.vectors(self.provider.name)
        live = ops.active(self.claims())
        missing = self._missing(live, found)
        if not missing.isEmpty():
            made = materialize(self._embedded(missing))
            if write:
                self.lake.append_vectors(made)
            found = made if found is None else found.unionByName(made.select(*found.columns))
        if found is None:
            found = self.spark.createDataFrame([], schemas.VECTORS)
        return self._current(live, found).drop("digest").join(live, "id", "inner")

    # writes
    def touch(self, ids: list[str]) -> None:
        """One touch per id, and a confidence operation where hits earn it, in one append."""
        if not ids:
            return
        now, rows = self.now(), []
        known = {r["id"]: r for r in self.claims().where(F.col("id").isin(ids)).withColumn("after", F.coalesce("hits", F.lit(0)) + F.when(F.col("status") == "active", 1).otherwise(0)).withColumn("to", X.promoted(F.col("confidence"), F.col("after"))).collect()}
        for i in (i for i in ids if i in known):
            rows.append({"op": "touch", "target": i, "ts": now, "lineage_id": known[i]["lineage_id"]})
            if known[i]["to"]:
                rows.append({"op": "confidence", "target": i, "to": known[i]["to"], "ts": now, "lineage_id": known[i]["lineage_id"]})
        self.lake.append_ops(rows, now)

    def _pressure(self) -> dict:
        row = ops.status(self.claims()).first()
        out = {"pressure": row["pressure"], "active_claims": row["active_claims"]}
        if row["pressure"] >= C.PRESSURE_WARN:
            out["warning"] = f"{row['active_claims']} of {C.WARM_LIMIT} claims"
        return out

    def find_similar(self, text: str, kind: str | None = None, entity: str | None = None) -> dict | None:
        """The most similar active claim to a rendered text, with its score (4 places)."""
        shown = f"[{kind or ''}|{entity or ''}|{self.now()[:7]}] {text}"
        best = vectors.topk(self._index(), self._embed(shown), 1).withColumn("score", F.round("score", 4)).first()
        return best.asDict() if best else None

    def remember(self, text: str, key: str | None = None, kind: str | None = None, entity: str | None = None, source: str | None = None, confidence: str = "low") -> dict:
        """Without a key, a claim that says the same is touched instead. With one, it supersedes the key's claims."""
        if not key:
            best = self.find_similar(text, kind, entity)
            if best and best["score"] >= C.DEDUP:
                self.touch([best["id"]])
                return {"merged_into": best["id"], "score": best["score"], "hits": best["hits"] + 1, **self._pressure()}
        now, claim = self.now(), self.new_id()
        rows = [{"op": "supersede", "target": r["id"], "ts": now, "lineage_id": r["lineage_id"]} for r in ops.by_key(self.claims(), key).collect()]
        rows.append({"op": "assert", "id": claim, "text": text, "key": key, "kind": kind, "entity": entity, "source": source, "confidence": confidence, "created": now, "hits": 0, "lineage_id": claim})
        self.lake.append_ops(rows, now)
        return {"id": claim, **self._pressure()}

    def remember_all(self, writes: DataFrame, order: list[str], near: bool = True) -> dict:
        """remember() for a table of writes (text, and any of id, key, kind, entity, source, confidence), in the given order.

        Writes with a key come first: a key's last write stays active. Then a write without a key whose text, kind and
        entity an active claim or an earlier write has already touches that claim; with near, so does one whose nearest
        active claim is as similar as remember() asks. Writes that are new and only similar to each other all become
        claims, for sleep() to merge. Ids, where given, are distinct and new; writes without text are left out.
        """
        now, made = self.now(), materialize(bulk.prepared(writes, order))
        # Texts are joined to the operations last, by row; until then they need not travel.
        rows, texts = bulk.placed(made), made.select("row", "text")
        keyed = rows.where("key <> ''").drop("text")
        done = {"keyed": 0, "keyless": 0}
        if not keyed.isEmpty():
            done["keyed"] = self._append_bulk(bulk.keyed_ops(keyed, ops.active(self.claims()), now), texts, now)
        plain = rows.where("coalesce(key, '') = ''")
        if not plain.isEmpty():
            digest = bulk.said(F.col("kind"), F.col("entity"), F.col("text"))
            plain = materialize(plain.select(digest.alias("digest"), "row", "id", *bulk.FIELDS, "at"))
            firsts = materialize(plain.groupBy("digest").agg(F.min_by(F.struct("row", "id", *bulk.FIELDS, "at"), "at").alias("x")).select("digest", "x.*"))
            live = ops.active(self.claims())
            exact = live.select(digest.alias("digest"), "birth_seq", F.struct(F.col("id").alias("claim"), "lineage_id", "hits", "confidence").alias("c"))
            known = materialize(exact.groupBy("digest").agg(F.min_by("c", "birth_seq").alias("c")).join(firsts.select("digest"), "digest", "left_semi").select("digest", "c.*"))
            if near:
                rest = firsts.join(known.select("digest"), "digest", "left_anti").join(texts, "row")
                known = known.unionByName(self._nearby(rest, now))
            done["keyless"] = self._append_bulk(bulk.keyless_ops(plain.select("digest", "id", "at"), firsts, known, now), texts, now)
            release(plain)
            release(firsts)
        release(made)
        return {"operations": done["keyed"] + done["keyless"], **self._pressure()}

    def _append_bulk(self, made: DataFrame, texts: DataFrame, now: str) -> int:
        return self.lake.append_frame(made.orderBy("step", "at").drop("step", "at"), now, texts)

    def _nearby(self, rows: DataFrame, now: str) -> DataFrame:
        """(digest, claim, lineage_id, hits, confidence) of the rows whose nearest active claim is a duplicate by its vector."""
        index = self._index().select("id", "embedding", F.col("birth_seq").alias("ord"))
        live = self.claims().select(F.col("id").alias("claim"), "lineage_id", "hits", "confidence")
        if index.isEmpty():
            return live.limit(0).select(F.lit("").alias("digest"), *live.columns)
        shown = X.render(F.col("kind"), F.col("entity"), F.lit(now), F.col("text"))
        best = vectors.topk_batch(index, rows.select(F.col("digest").alias("query_id"), embedder(self.provider)(shown).alias("q")), 1, order="ord")
        return best.where(F.round("score", 4) >= C.DEDUP).select(F.col("query_id").alias("digest"), F.col("id").alias("claim")).join(live, "claim").select("digest", *live.columns)

    def _succeed(self, claim_id: str, text: str, carry: bool) -> dict:
        if not text:
            raise ValueError("the text is empty")
        old, now, name = self._active(claim_id), self.now(), self.new_id()
        self.lake.append_ops([{"op": "supersede", "target": claim_id, "text": text, "carry": carry, "new_id": name, "ts": now, "lineage_id": old["lineage_id"]}], now)
        return {"id": name, "supersedes": claim_id, "hits": old["hits"] if carry else 0}

    def correct(self, claim_id: str, text: str) -> dict:
        """A successor that starts afresh: no hits, created now."""
        return self._succeed(claim_id, text, carry=False)

    def restate(self, claim_id: str, text: str) -> dict:
        """A successor that keeps hits, last access and creation."""
        return self._succeed(claim_id, text, carry=True)

    def forget(self, claim_id: str, hard: bool = False) -> dict:
        """Mark as forgotten; hard also takes the claim's operations out of the log.

        A successor's birth is cut to its plain effect on the target, and a successor of the
        deleted claim keeps its state as an assert of its own.
        """
        old, now = self._active(claim_id), self.now()
        self.lake.append_ops([{"op": "forget", "target": claim_id, "hard": hard, "ts": now, "lineage_id": old["lineage_id"]}], now)
        if hard:
            _, seen = self.lake.commits()
            log = self.lake.oplog(content=seen)
            born = {r["seq"]: r.asDict() for r in log.where((F.col("target") == claim_id) & (F.col("op") == "supersede") & (F.coalesce("text", F.lit("")) != "")).collect()}
            keep = log.where(~(F.coalesce(F.col("id") == claim_id, F.lit(False)) | F.coalesce(F.col("target") == claim_id, F.lit(False))))
            mine = F.coalesce(F.col("new_id") == claim_id, F.lit(False))
            keep = keep.withColumns({"text": F.when(~mine, F.col("text")), "carry": F.when(~mine, F.col("carry")), "new_id": F.when(~mine, F.col("new_id"))})
            if born:
                state = {r["id"]: r.asDict() for r in replay(log.where(F.col("seq") <= max(born))).where(F.col("id").isin([b["new_id"] for b in born.values()])).collect()}
                names = log.columns
                rows = [tuple({**{n: None for n in names}, **{n: state[b["new_id"]][n] for n in ("id", "text", "key", "kind", "entity", "source", "confidence", "created", "hits", "last_accessed", "lineage_id")}, "op": "assert", "seq": s}[n] for n in names) for s, b in born.items() if b["new_id"] in state]
                keep = keep.unionByName(self.spark.createDataFrame(rows, log.schema)) if rows else keep
            self.lake.rewrite_ops(keep, seen)
            self.lake.audit("hard_delete", {"id": claim_id}, now)
        return {"id": claim_id, "forgotten": True, "hard": hard}

    def restore(self, claim_id: str) -> dict:
        row, now = ops.show(self.claims(), claim_id).first(), self.now()
        if row is None or row["status"] == "active":
            raise NotFound(f"no inactive claim {claim_id}")
        self.lake.append_ops([{"op": "restore", "target": claim_id, "ts": now, "lineage_id": row["lineage_id"]}], now)
        return {"id": claim_id, "restored": True}

    # reads
    def recall(self, text: str, k: int = 5, deep: bool = False) -> list[dict]:
        """The k most similar active claims, as they were before this recall touches them.

        deep adds entries of the episodic log that share bigrams, after the claims.
        """
        best = vectors.topk(self._index(), self._embed(text), k).withColumn("score", F.round("score", 4)).drop("embedding", "model", "ord")
        hits = self._rows(best)
        self.touch([h["id"] for h in hits])
        if deep:
            hits += [r | {"layer": "episodic"} for r in self._rows(self._deep(text, k))]
        return hits

    def _deep(self, text: str, k: int) -> DataFrame:
        """The k entries that share most bigrams: from the index what it knows, by a scan what came since."""
        index, late = self.lake.entries_index()
        found = lexical.deep_search(late, text, k, ENTRY)
        if index is None:
            return found
        best = index.search(text, k).collect()  # k rows
        if not best:
            return found
        named = self.spark.createDataFrame([tuple(r[n] for n in (*ENTRY, "score")) for r in best], "month string, ord long, id string, score double")
        texts = self.lake.episodic().where(F.col("month").isin([r["month"] for r in best]) & F.col("ord").isin([r["ord"] for r in best]))
        return found.unionByName(texts.join(F.broadcast(named), ENTRY)).orderBy(F.desc("score"), *ENTRY).limit(k)

    def context(self, task: str, budget: float = C.CONTEXT_BUDGET) -> dict:
        """Recalled claims that fit a token budget. All recalled ones are touched."""
        hits = self.recall(task, C.CONTEXT_RECALL)
        if not hits:
            return {"task": task, "budget": budget, "used_tokens": 0, "items": []}
        rows = self.spark.createDataFrame([(h["id"], h["text"], float(h["score"]), n, h["hits"], h["kind"], h["entity"]) for n, h in enumerate(hits)], "id string, text string, score double, rank int, hits long, kind string, entity string")
        kept = ops.context_items(rows, budget).orderBy("rn").collect()
        return {"task": task, "budget": budget, "used_tokens": int(kept[-1]["used"]), "items": [{n: r[n] for n in ("id", "kind", "entity", "text", "score", "hits")} for r in kept]}

    def profile(self, budget: float = C.PROFILE_BUDGET, write: bool = False) -> dict:
        kept = ops.profile_items(self.claims(), budget).orderBy("rn").collect()
        items = [{n: r[n] for n in ("id", "kind", "entity", "confidence", "hits", "text")} for r in kept]
        if write:
            self.lake.write_text(self.lake.path("profile.md"), "".join(f"- [{i['kind'] or 'fact'}] {i['text']}\n" for i in items))
            self.lake.audit("profile", {"items": len(items)}, self.now())
        return {"budget": budget, "used_tokens": int(kept[-1]["used"]) if kept else 0, "items": items}

    def query(self, **filters) -> list[dict]:
        return self._rows(ops.query(self.claims(), **filters))

    def show(self, claim_id: str) -> dict:
        row = ops.show(self.claims(), claim_id).first()
        if row is None:
            raise NotFound(f"no claim {claim_id}")
        return row.asDict()

    def log_write(self, text: str, topic: str | None = None, entity: str | None = None) -> dict:
        row = {"id": f"ep_{self.new_id()}", "ts": self.now(), "text": text, "topic": topic, "entity": entity}
        self.lake.append_episodic([row])
        self.lake.audit("log", row, row["ts"])
        return row

    def log_query(self, since: str | None = None, until: str | None = None, topic: str | None = None, entity: str | None = None) -> list[dict]:
        return self._rows(ops.episodic_range(self.lake.episodic(), since, until, topic, entity).drop("month", "ord"))

    def status(self) -> dict:
        row = ops.status(self.claims()).first()
        try:
            found = self.lake.vectors(self.provider.name)
            index = {"exists": found is not None, "model": self.provider.name, "count": found.join(ops.active(self.claims()), "id", "left_semi").count() if found is not None else 0}
        except ModelMismatch as e:
            index = {"exists": True, "error": str(e)}
        profile = self.lake.read_text(self.lake.path("profile.md"))
        return {
            "home": self.lake.home, "total_claims": row["total"], **self._pressure(), "warm_limit": C.WARM_LIMIT, "index": index, "claims_file_bytes": self.lake.log_bytes(),
            "profile": {"exists": False} if profile is None else {"exists": True, "count": len([x for x in profile.split("\n") if x.strip()]), "updated": self.lake.modified(self.lake.path("profile.md"))},
        }

    # consolidation
    def sleep(self, dry_run: bool = False, review: float = C.REVIEW, merge: float = C.MERGE) -> dict:
        """consolidate(), with the whole report read into lists for a command to print."""
        report, parts = self.consolidate(dry_run, review, merge)
        near = {r["id"]: r for r in self._rows(parts["best_matches"])}
        match = lambda e: {n: near[e["id"]][m] for n, m in (("id", "nearest"), ("text", "text"), ("entity", "entity"), ("score", "score"))} if e["id"] in near else None
        found = groupby(self._rows(parts["merge_suggestions"].orderBy("first_seq", "birth_seq")), lambda r: (r["entity"], r["count"]))
        lists = {
            "merge_suggestions": [{"entity": entity, "count": count, "claims": [{"id": c["id"], "text": c["text"]} for c in rows]} for (entity, count), rows in found],
            "forget_candidates": self._rows(parts["forget_candidates"].orderBy("retention", "birth_seq").drop("birth_seq")),
            "near_duplicates": self._rows(parts["near_duplicates"].orderBy(F.desc("score"), "a", "b").drop("a", "b")),
            "review_pairs": self._rows(parts["review_pairs"].orderBy(F.desc("score"), "a_ord", "b_ord").drop("a_ord", "b_ord")),
            "episodic_candidates": [{"ep": e, "best_match": match(e)} for e in self._rows(parts["entries"].orderBy("month", "ord").drop("month", "ord"))],
        }
        return {"ts": report["ts"], "dry_run": dry_run, **lists, **{n: report[n] for n in ("applied", "report_file") if n in report}}

    def consolidate(self, dry_run: bool = False, review: float = C.REVIEW, merge: float = C.MERGE) -> tuple[dict, dict[str, DataFrame]]:
        """Clusters, claims to forget, pairs to merge and to review, and recent entries with their nearest claim: a summary, and a table of each.

        A dry run writes nothing. Else forgets are appended before merges, the report is saved under
        its day, a small file that names the folders of its tables, and the index follows by itself. Recent entries are those of whole days.
        Only counts come to the driver: the tables hold a row for each claim or pair that they report.
        """
        now, claims = self.now(), self.claims()
        index = materialize(self._index(write=not dry_run).select("id", "embedding", F.col("birth_seq").alias("ord")))
        brief = claims.select("id", "text", "entity", "lineage_id")
        as_side = lambda n: brief.select(F.col("id").alias(n), F.col("text").alias(f"{n}_text"), F.col("lineage_id").alias(f"{n}_lineage"))
        weak = materialize(ops.forget_candidates(claims, F.lit(now)))
        pairs = materialize(consolidate.with_keeper(vectors.similar_pairs(index, review), claims))
        strong, mild = consolidate.bands(pairs, merge)
        merged = materialize(consolidate.greedy(strong).join(as_side("kept"), "kept").join(as_side("loser"), "loser"))
        side = lambda n: F.struct(F.col(n).alias("id"), F.col(f"{n}_text").alias("text")).alias(n)
        since = (self.clock() - timedelta(days=C.EPISODIC_DAYS)).strftime("%Y-%m-%d")
        entries = materialize(ops.episodic_range(self.lake.episodic(), since=since).limit(C.EPISODIC_LIMIT))
        best = vectors.nearest(entries.select("id", embedder(self.provider)(F.col("text")).alias("embedding")), index)
        parts = {
            "merge_suggestions": ops.clusters(claims),
            "forget_candidates": weak.select("id", "text", "retention", "days_idle", "hits", "birth_seq"),
            "near_duplicates": merged.select("kept", F.col("loser").alias("merged"), "score", "kept_text", F.col("loser_text").alias("merged_text"), "a", "b"),
            "review_pairs": mild.join(as_side("a"), "a").join(as_side("b"), "b").select(side("a"), side("b"), "score", "a_ord", "b_ord"),
            "entries": entries,
            "best_matches": best.join(brief.select(F.col("id").alias("nearest"), "text", "entity"), "nearest").select("id", "nearest", "text", "entity", "score"),
        }
        report: dict = {"ts": now, "dry_run": dry_run}
        if not dry_run:
            report["applied"] = {"forgotten": weak.count(), "merged": merged.count()}
            report["tables"] = names = {n: self.lake.report_path(now[:10], n) for n in parts}
            for n, rows in parts.items():
                rows.write.mode("overwrite").option("lineSep", "\n").json(names[n])
            parts = {n: self.spark.read.schema(rows.schema).option("lineSep", "\n").json(names[n]) for n, rows in parts.items()}
            op = lambda name, target, extra: [F.lit(name).alias("op"), F.col(target).alias("target"), F.lit(now).alias("ts"), F.col("lineage_id" if target == "id" else "loser_lineage").alias("lineage_id"), extra.alias("extra")]
            forgets = weak.select(F.lit(0).alias("o"), F.col("retention").alias("x"), F.col("birth_seq").alias("y"), F.lit("").alias("z"), *op("forget", "id", F.lit(None).cast("string")))
            merges = merged.select(F.lit(1).alias("o"), (-F.col("score")).alias("x"), F.lit(0).cast("long").alias("y"), F.concat_ws(" ", "a", "b").alias("z"), *op("supersede", "loser", F.to_json(F.struct("kept"))))
            self.lake.append_frame(forgets.unionByName(merges).orderBy("o", "x", "y", "z").drop("o", "x", "y", "z"), now)
            self.lake.index_entries()
            file = self.lake.save_report(report, now[:10])
            self.lake.audit("sleep", report["applied"] | {"report_file": file}, now)
            report = report | {"report_file": file}
        return report, parts
