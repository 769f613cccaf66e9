"""Tables of one home: operation log, episodic log, vectors, audit log, reports, profile.

The operation log, the vectors and a snapshot of the claims are folders that a numbered commit names.
A commit is a small file, written whole and never twice; readers use the newest. So a rewrite that
dies half-way changes nothing, and of two writers one has to look again before it deals out its seq.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.lexical import BigramIndex
from ..session import materialize, release
from . import schemas

#: monotonically_increasing_id has the partition above this many bits, and the row's number below.
_ROW_BITS = 33


#: How tables of many operations are written as JSON lines: a file is one task's rows, and read by one task.
_BULK = {"lineSep": "\n", "compression": "gzip"}

#: What names an entry of the episodic log, in the order of the log.
ENTRY = ["month", "ord", "id"]


class ModelMismatch(RuntimeError):
    """The vectors on disk come from another model."""


class Lake:
    def __init__(self, spark: SparkSession, home: str | None = None):
        self.spark = spark
        self.home = (home or spark.conf.get("spark.chronofold.home", None) or os.path.join(os.path.expanduser("~"), ".chronofold")).rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.home}/{name}"

    # Hadoop's file system, so that a home may be anywhere Spark can read.
    def _fs(self, path: str):
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def exists(self, path: str) -> bool:
        fs, where = self._fs(path)
        return fs.exists(where)

    def size(self, path: str) -> int:
        fs, where = self._fs(path)
        return fs.getContentSummary(where).getLength() if fs.exists(where) else 0

    def write_text(self, path: str, text: str) -> None:
        fs, where = self._fs(path)
        out = fs.create(where, True)
        try:
            out.write(bytearray(text.encode("utf-8")))
        finally:
            out.close()

    def read_text(self, path: str) -> str | None:
        if not self.exists(path):
            return None
        return "".join(r[0] for r in self.spark.read.text(path, wholetext=True).collect())

    def table(self, name: str, schema: str) -> DataFrame:
        """A JSON table; without files it is empty. Blank lines are skipped, U+2028 and the like stay in texts."""
        if not self.exists(self.path(name)):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("lineSep", "\n").json(self.path(name))

    def append(self, name: str, rows: list[dict], schema: str) -> None:
        if rows:
            frame = self.spark.createDataFrame([tuple(r.get(f.name) for f in self.spark.createDataFrame([], schema).schema) for r in rows], schema)
            frame.coalesce(1).write.mode("append").option("lineSep", "\n").json(self.path(name))

    # commits
    def commits(self) -> tuple[int, dict]:
        """Number and content of the newest commit: folders of the log with their first and last seq, of vectors, and a snapshot of the claims up to a seq."""
        fs, where = self._fs(self.path("commits"))
        names = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
        numbers = [int(n.removesuffix(".json")) for n in names if n.endswith(".json")]
        if not numbers:
            return 0, {"log": [], "vectors": None, "snapshot": None}
        text = self.read_text(self.path(f"commits/{max(numbers):012d}.json"))
        return max(numbers), json.loads(text)

    def _publish(self, number: int, content: dict) -> bool:
        """Whether this commit came first. The file is complete before it has its name."""
        draft, final = self.path(f"commits/{uuid.uuid4().hex}.draft"), self.path(f"commits/{number:012d}.json")
        self.write_text(draft, json.dumps(content))
        fs, where = self._fs(draft)
        there = self._fs(final)[1]
        if fs.getScheme() == "file":  # a rename would replace the file of another writer, a link does not
            try:
                os.link(where.toUri().getPath(), there.toUri().getPath())
                return True
            except FileExistsError:
                return False
            finally:
                fs.delete(where, False)
        try:
            done = fs.rename(where, there)
        except Exception:  # some stores raise where others say no
            done = False
        if not done:
            fs.delete(where, False)
        return done

    def commit(self, change: Callable[[dict], dict]) -> dict:
        """Publish change(newest content), again on newer content if another writer was first."""
        while True:
            number, content = self.commits()
            fresh = change(content)
            if self._publish(number + 1, fresh):
                return fresh

    def drop(self, folders: list[str]) -> None:
        """Delete folders that the newest commit doesn't name any more."""
        for name in folders:
            fs, where = self._fs(self.path(name))
            fs.delete(where, True)

    @staticmethod
    def _last(content: dict) -> int:
        return max([f["last"] for f in content["log"]], default=-1)

    # operation log
    def oplog(self, after: int | None = None, content: dict | None = None) -> DataFrame:
        """The log, or its operations with a seq above `after`: folders that end before it are not read."""
        content = content or self.commits()[1]
        folders = [self.path(f["name"]) for f in content["log"] if after is None or f["last"] > after]
        if not folders:
            return self.spark.createDataFrame([], schemas.OPLOG)
        rows = self.spark.read.schema(schemas.OPLOG).option("lineSep", "\n").json(folders)
        return rows if after is None else rows.where(F.col("seq") > after)

    def log_bytes(self) -> int:
        return sum(self.size(self.path(f["name"])) for f in self.commits()[1]["log"])

    def _write_log(self, rows: DataFrame) -> dict | None:
        """A folder of the log that no commit names yet."""
        name = f"oplog/{uuid.uuid4().hex}"
        rows.write.options(**_BULK).json(self.path(name))
        ends = self.spark.read.schema(schemas.OPLOG).json(self.path(name)).agg(F.min("seq"), F.max("seq")).first()
        return None if ends[0] is None else {"name": name, "first": ends[0], "last": ends[1]}

    def append_log(self, log: DataFrame) -> None:
        """Append a whole log (schema OPLOG), in parallel; its seq must follow what is there."""
        made = self._write_log(log)
        if made is None:
            return

        def change(content: dict) -> dict:
            if made["first"] <= self._last(content):
                self.drop([made["name"]])
                raise ValueError(f"seq {made['first']} does not follow {self._last(content)}")
            return content | {"log": [*content["log"], made]}

        self.commit(change)

    def append_ops(self, rows: list[dict], now: str) -> None:
        """Append a command's few operations after the last seq, and one audit row for each."""
        if not rows:
            return
        names = [f.name for f in self.spark.createDataFrame([], schemas.OPLOG).schema]
        dealt: list[dict] = []

        def change(content: dict) -> dict:
            first = self._last(content) + 1
            dealt[:] = [r | {"seq": first + k} for k, r in enumerate(rows)]
            name = f"oplog/{uuid.uuid4().hex}"
            self.spark.createDataFrame([tuple(r.get(n) for n in names) for r in dealt], schemas.OPLOG).coalesce(1).write.option("lineSep", "\n").json(self.path(name))
            return content | {"log": [*content["log"], {"name": name, "first": first, "last": first + len(rows) - 1}]}

        self.commit(change)
        self.append("audit", [{"ts": now, "action": r["op"], "detail": json.dumps({k: v for k, v in r.items() if v is not None}, ensure_ascii=False)} for r in dealt], schemas.AUDIT)

    def append_frame(self, ops: DataFrame, now: str, texts: DataFrame | None = None) -> int:
        """Append the operations of an ordered DataFrame (OPLOG's columns, or some, without seq), with an audit row each; returns how many.

        Places are dealt out where the rows are: a row's number in its partition, after the counts of the partitions before.
        With texts (row, text), the operations have a column row instead of a text, which is null where they need none.
        """
        table = materialize(ops.withColumn("__at", F.monotonically_increasing_id()))
        part = F.shiftright("__at", _ROW_BITS).alias("__part")
        before = F.coalesce(F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        starts = materialize(table.groupBy(part).count().select("__part", "count", before.alias("__start")))
        total = starts.agg(F.sum("count")).first()[0] or 0
        if total:
            made: dict = {}

            def change(content: dict) -> dict:
                first = self._last(content) + 1
                place = (F.lit(first) + F.col("__start") + F.col("__at").bitwiseAND((1 << _ROW_BITS) - 1)).alias("seq")
                rows = table.withColumn("__part", part).join(starts.drop("count"), "__part").select(place, *[c for c in table.columns if c != "__at"])
                if texts is not None:
                    # A table of texts that is small as a file may still be too large to send around.
                    rows = rows.where("row IS NOT NULL").join(texts.hint("merge"), "row").unionByName(rows.where("row IS NULL"), allowMissingColumns=True)
                made.update({"name": f"oplog/{uuid.uuid4().hex}", "first": first, "last": first + total - 1})
                rows = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.spark.createDataFrame([], schemas.OPLOG).schema])
                rows.write.options(**_BULK).json(self.path(made["name"]))
                return content | {"log": [*content["log"], dict(made)]}

            self.commit(change)
            rows = self.spark.read.schema(schemas.OPLOG).option("lineSep", "\n").json(self.path(made["name"]))
            audit = rows.select(F.lit(now).alias("ts"), F.col("op").alias("action"), F.to_json(F.struct(*rows.columns)).alias("detail"))
            audit.write.mode("append").options(**_BULK).json(self.path("audit"))
        release(table)
        release(starts)
        return total

    def audit(self, action: str, detail: dict, now: str) -> None:
        self.append("audit", [{"ts": now, "action": action, "detail": json.dumps(detail, ensure_ascii=False)}], schemas.AUDIT)

    def rewrite_ops(self, keep: DataFrame, seen: dict, snapshot: DataFrame | None = None) -> None:
        """Replace the folders of the commit content `seen` by `keep`; what others have appended since stays.

        snapshot: claims after all of keep, from which later reads go on. Old folders go after the commit.
        """
        made, view = self._write_log(keep), None
        if snapshot is not None:
            view = {"name": f"snapshots/{uuid.uuid4().hex}", "last": self._last(seen)}
            snapshot.write.parquet(self.path(view["name"]))
        old = {f["name"] for f in seen["log"]}

        def change(content: dict) -> dict:
            return content | {"log": [*([made] if made else []), *(f for f in content["log"] if f["name"] not in old)], "snapshot": view}

        self.commit(change)
        self.drop([*old, *([seen["snapshot"]["name"]] if seen["snapshot"] else [])])

    def snapshot(self, content: dict) -> tuple[DataFrame | None, int | None]:
        """The claims of a snapshot and the last seq that they know, if there is one."""
        found = content["snapshot"]
        return (self.spark.read.schema(schemas.CLAIMS).parquet(self.path(found["name"])), found["last"]) if found else (None, None)

    def episodic(self) -> DataFrame:
        """Month folders are partitions, so a range of months reads those only."""
        path = self.path("episodic")
        if not self.exists(path):
            return self.spark.createDataFrame([], schemas.EPISODIC)
        return self.spark.read.schema(schemas.EPISODIC).option("lineSep", "\n").json(path)

    def entry_files(self) -> list[str]:
        """Files of the episodic log; a file has its name once it is whole, and never changes."""
        fs, where = self._fs(self.path("episodic/month=*/part-*"))
        return sorted(f"{s.getPath().getParent().getName()}/{s.getPath().getName()}" for s in fs.globStatus(where) or [])

    def _entries_in(self, files: list[str]) -> DataFrame:
        base = self.path("episodic")
        if not files:
            return self.spark.createDataFrame([], schemas.EPISODIC)
        return self.spark.read.schema(schemas.EPISODIC).option("basePath", base).option("lineSep", "\n").json([f"{base}/{f}" for f in files])

    def entries_index(self) -> tuple[BigramIndex | None, DataFrame]:
        """The index of bigrams of entries, if there is one, and the entries that it doesn't know."""
        found = self.commits()[1].get("bigrams")
        if not found:
            return None, self.episodic()
        first, *more = [self.path(n) for n in found["names"]]
        return BigramIndex(self.spark, first, ENTRY, *more), self._entries_in(self._unknown(found))

    def _unknown(self, found: dict | None) -> list[str]:
        known = set((self.read_text(self.path(found["list"])) or "").split("\n")) if found else set()
        return [f for f in self.entry_files() if f not in known]

    def index_entries(self, whole: bool = False) -> int:
        """Add the entries of files that the index of bigrams doesn't know; whole: one new folder of all. Returns how many files it read.

        The index knows files, not places, so an entry that a slow writer finishes late is found later. If another
        writer has changed the index meanwhile, its index stays.
        """
        old = self.commits()[1].get("bigrams")
        fresh = self._unknown(None if whole else old)
        if not fresh:
            return 0
        name = f"bigrams/{uuid.uuid4().hex}"
        BigramIndex.build(self._entries_in(fresh), self.path(name), ENTRY)
        kept = [] if whole or not old else old["names"]
        known = fresh if not kept else sorted({*fresh, *(self.read_text(self.path(old["list"])) or "").split("\n")})
        made = {"names": [*kept, name], "list": f"{name}.files"}
        self.write_text(self.path(made["list"]), "\n".join(known))
        now = self.commit(lambda content: content | {"bigrams": made} if content.get("bigrams") == old else content)
        if now["bigrams"] != made:
            self.drop([name, made["list"]])
            return 0
        if old:
            self.drop([n for n in (*old["names"], old["list"]) if n not in kept])
        return len(fresh)

    def append_entries(self, entries: DataFrame) -> None:
        """Append entries of the episodic log (its columns but the month), in parallel; ord must follow what is there."""
        if self.commits()[1].get("entries") is not None:
            self.commit(lambda content: {k: v for k, v in content.items() if k != "entries"})
        entries.withColumn("month", F.substring("ts", 1, 7)).write.mode("append").partitionBy("month").option("lineSep", "\n").json(self.path("episodic"))

    def append_episodic(self, rows: list[dict]) -> None:
        """Append a few entries. A commit deals out their places; the log is read for the last one only if no commit knows it."""
        dealt = []

        def change(content: dict) -> dict:
            last = self.episodic().agg(F.max("ord")).first()[0] if content.get("entries") is None else content["entries"]
            dealt[:] = [-1 if last is None else last]
            return content | {"entries": dealt[0] + len(rows)}

        self.commit(change)
        first = dealt[0] + 1
        data = [(r["id"], r["ts"], r["text"], r.get("topic"), r.get("entity"), first + k, r["ts"][:7]) for k, r in enumerate(rows)]
        self.spark.createDataFrame(data, schemas.EPISODIC).coalesce(1).write.mode("append").partitionBy("month").option("lineSep", "\n").json(self.path("episodic"))

    def _write_vectors(self, vectors: DataFrame) -> str:
        name = f"vectors/{uuid.uuid4().hex}"
        vectors.write.parquet(self.path(name))
        return name

    def save_vectors(self, vectors: DataFrame) -> None:
        """Replace the index in one commit."""
        name, old = self._write_vectors(vectors), []

        def change(content: dict) -> dict:
            old[:] = content["vectors"] or []
            return content | {"vectors": [name]}

        self.commit(change)
        self.drop(old)

    def append_vectors(self, vectors: DataFrame) -> None:
        name = self._write_vectors(vectors)
        self.commit(lambda content: content | {"vectors": [*(content["vectors"] or []), name]})

    def vectors(self, model: str) -> DataFrame | None:
        """None without an index; another model's index is an error."""
        folders = self.commits()[1]["vectors"]
        if folders is None:
            return None
        found = self.spark.read.schema(schemas.VECTORS).parquet(*[self.path(f) for f in folders])
        names = [r[0] for r in found.select("model").distinct().limit(2).collect()]
        if names and names != [model]:
            raise ModelMismatch(f"vectors are of {names}, not {model}; rebuild the index")
        return found

    def modified(self, path: str) -> str | None:
        """Time of the last change of a file, in UTC."""
        fs, where = self._fs(path)
        if not fs.exists(where):
            return None
        return datetime.fromtimestamp(fs.getFileStatus(where).getModificationTime() / 1000, tz=timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def report_path(self, day: str, table: str) -> str:
        """Folder of a table of a day's report: rows of JSON."""
        return self.path(f"reports/{day}/{table}")

    def save_report(self, report: dict, day: str) -> str:
        path = self.path(f"reports/{day}.json")
        self.write_text(path, json.dumps(report, ensure_ascii=False, indent=2))
        return path


def import_jsonl(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Operations of a log of JSON lines, with seq from the line number; files follow each other in name order.

    A file is read in splits. A line's number is its rank in its split plus the lines of all splits
    before, whose counts are a row each, sent to all tasks.

    Blank lines and records of no operation are skipped; a malformed line is skipped, or with
    strict is an error. Unknown fields of a record are kept as JSON in extra.
    """
    place = ["file", "block"]
    text = spark.read.option("lineSep", "\n").text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    # A task reads a split's lines one after the other, so lines need not be sorted, nor leave their task.
    text = text.withColumn("at", F.monotonically_increasing_id())
    counts = text.groupBy(*place).agg(F.count("*").alias("count"), F.min("at").alias("start"))
    before = counts.select(*place, "start", F.coalesce(F.sum("count").over(Window.orderBy(*place).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    numbered = text.join(F.broadcast(before), place).withColumn("rank", F.col("at") - F.col("start"))
    lines = numbered.select((F.col("before") + F.col("rank")).alias("seq"), "line").where("trim(line) <> ''")
    names = [f.name for f in spark.createDataFrame([], schemas.OPLOG).schema if f.name not in ("seq", "lineage_id", "extra")]
    fields = ", ".join(x.strip() for x in schemas.OPLOG.split(",") if x.split()[0] in names)
    parsed = lines.withColumn("r", F.from_json("line", f"{fields}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    if strict:
        parsed = parsed.withColumn("r", F.when(F.col("r._bad").isNull(), F.col("r")).otherwise(F.raise_error(F.concat(F.lit("malformed line "), F.col("seq").cast("string")))))
    every = F.map_filter(F.from_json("line", "map<string,string>"), lambda k, v: ~k.isin(*names))
    good = parsed.where("r._bad IS NULL AND r.op IS NOT NULL")
    return good.select(F.col("seq").cast("long").alias("seq"), F.lit(None).cast("string").alias("lineage_id"), *[F.col(f"r.{n}").alias(n) for n in names], F.when(F.size(every) > 0, F.to_json(every)).alias("extra"))
