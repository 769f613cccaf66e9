"""Replay: the ordered operation log to the present state of every claim.

A lineage is an assert and all successors born from it. Successors inherit their target's fields as
they were at that moment. `replay` works on the whole log at once; `fold` says the same row by row, for one
lineage whose operations arrive bit by bit.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, release
from ..sources import schemas

FIELDS = ["id", "text", "key", "kind", "entity", "source", "confidence", "created", "hits", "last_accessed", "status", "birth_seq", "lineage_id"]


def plain(x):
    return None if x is None or x is pd.NA or (isinstance(x, float) and x != x) else x


def apply(claims: dict[str, dict], op: dict) -> None:
    """Change claims by one operation; only get and item assignment are used of them."""
    kind, target = op["op"], claims.get(op["target"])
    if kind == "assert":
        old = claims.get(op["id"])
        born = old["birth_seq"] if old else op["seq"]
        claims[op["id"]] = {f: op.get(f) for f in FIELDS} | {"status": "active", "birth_seq": born, "hits": int(op["hits"] or 0), "lineage_id": op["lineage_id"]}
    elif target is None:
        return
    elif kind == "supersede":
        if op["text"]:
            name = op["new_id"] or f"{op['target']}@{op['seq']}"
            kept = {f: target[f] for f in ("created", "hits", "last_accessed")} if op["carry"] else {"created": op["ts"], "hits": 0, "last_accessed": None}
            old = claims.get(name)
            born = old["birth_seq"] if old else op["seq"]
            claims[name] = target | {"id": name, "text": op["text"], "status": "active", "birth_seq": born} | kept
        target["status"] = "superseded"
    elif kind == "forget":
        target["status"] = "forgotten"
    elif kind == "restore":
        target["status"] = "active"
    elif kind == "touch" and target["status"] == "active":
        target["hits"], target["last_accessed"] = target["hits"] + 1, op["ts"]
    elif kind == "confidence":
        target["confidence"] = op["to"]


def fold(ops: pd.DataFrame) -> pd.DataFrame:
    """Claims of one lineage from its operations (any order; seq orders them)."""
    claims: dict[str, dict] = {}
    for op in ops.sort_values("seq", kind="stable").to_dict("records"):
        apply(claims, {k: plain(v) for k, v in op.items()})
    out = pd.DataFrame(list(claims.values()), columns=FIELDS)
    return out.astype({"hits": "int64", "birth_seq": "int64"}) if len(out) else out


#: Operations of one claim that a task orders at a time; a claim with more is cut into ranges of seq.
HOT = 100_000
#: Least width of such a range.
RANGE = 4096

_STATUS = {"supersede": "superseded", "forget": "forgotten", "restore": "active"}
_FIXED = ["text", "carry", "ts", "key", "kind", "entity", "source", "confidence", "created", "hits", "last_accessed", "lineage_id"]
_EVER, _BEFORE = (Window.unboundedPreceding, 0), (Window.unboundedPreceding, -1)


def _succeeds() -> Column:
    return (F.col("op") == "supersede") & (F.coalesce("text", F.lit("")) != "") & F.col("target").isNotNull()


def _births(log: DataFrame) -> DataFrame:
    """(e, name, parent, fields): e is the seq of an assert, or of a supersede with text, which has its target as parent."""
    named = F.coalesce(F.when(F.col("new_id") != "", F.col("new_id")), F.concat("target", F.lit("@"), F.col("seq").cast("string")))
    name = F.when(F.col("op") == "assert", F.col("id")).when(_succeeds(), named)
    return log.select(F.col("seq").alias("e"), name.alias("name"), F.when(_succeeds(), F.col("target")).alias("parent"), *_FIXED, F.lit(None).cast("string").alias("status")).where("name IS NOT NULL")


def pointed(table: DataFrame, functions: dict[str, Column], steps: int = 3) -> DataFrame:
    """Follow the pointers `ptr` of a table (e, ptr, functions) to their ends, four times as far in each round.

    A row whose ptr is the e of another gets that row's ptr and its functions composed with the
    other's, named b_ (null once a row has come to its end). Each round is a table; a chain
    of n pointers takes log4(n) + 1 of them.
    """
    left = table
    while not left.where("ptr IS NOT NULL").isEmpty():
        ahead = left.select(F.col("e").alias("b_e"), F.col("ptr").alias("b_ptr"), *[F.col(c).alias(f"b_{c}") for c in functions])
        moved = left.where("ptr IS NOT NULL")
        for _ in range(steps):
            # Rows at their end have a key of their own, so that they don't meet in one task.
            key = F.coalesce("ptr", -1 - F.col("e"))
            moved = moved.join(ahead, key == F.col("b_e"), "left").select("e", F.col("b_ptr").alias("ptr"), *[f.alias(c) for c, f in functions.items()])
        further = materialize(moved.unionByName(left.where("ptr IS NULL")))
        if left is not table:
            release(left)
        left = further
    return left


def _effective(births: DataFrame) -> DataFrame:
    """The births whose target was there at that time; asserts always are.

    A birth points at the latest birth of its target before it. Chains that end in an assert
    are sound. Where one ends at an unknown target, its last birth is void, and so are
    all above it up to the first that has another birth to come from; they go, and the rest
    points anew. Only births are looked at, and only in logs that name unknown targets.
    """
    while True:
        asks = births.where("parent IS NOT NULL").select(F.col("parent").alias("of"), F.col("e").alias("at"), F.lit(None).cast("long").alias("b"))
        both = asks.unionByName(births.select(F.col("name").alias("of"), F.col("e").alias("at"), F.col("e").alias("b")))
        before = Window.partitionBy("of").orderBy("at", F.col("b").isNotNull()).rowsBetween(*_BEFORE)
        asked = both.select("at", "b", F.last("b", ignorenulls=True).over(before).alias("ptr"), (F.count("b").over(before) > 1).alias("other")).where("b IS NULL")
        roots = births.where("parent IS NULL").select("e", F.lit(None).cast("long").alias("ptr"), F.lit(False).alias("other"), F.lit(True).alias("sound"))

        functions = {"other": F.coalesce(F.col("other") | F.col("b_other"), "other"), "sound": F.coalesce("b_sound", "sound")}
        ended = pointed(materialize(roots.unionByName(asked.select(F.col("at").alias("e"), "ptr", "other", F.lit(False).alias("sound")))), functions)
        void = ended.where("NOT sound AND NOT other").select("e")
        if void.isEmpty():
            release(ended)
            return births
        fewer = materialize(births.join(void, "e", "left_anti"))
        release(births)
        release(ended)
        births = fewer


def with_lineage(log: DataFrame) -> DataFrame:
    """Fill lineage_id of a log that lacks it, by pointers from a claim's first birth to its target's.

    A chain of n births takes log2(n) + 1 rounds. An id that is born twice belongs to the lineage of its first
    birth. Operations whose target was never born keep a null lineage.
    """
    births = materialize(_births(log).select("e", "name", "parent"))
    first = materialize(births.groupBy("name").agg(F.min_by("parent", "e").alias("parent"), F.min("e").alias("e")))
    up = lambda: first.select(F.col("name").alias("parent"), F.col("e").alias("ptr"))
    # Where every target was first born before its successors, all births took place, and no chain need be followed to see it.
    early = births.join(up(), "parent", "left").where("parent IS NOT NULL AND (ptr IS NULL OR ptr >= e)")
    if not early.isEmpty():
        release(first)
        births = _effective(births)
        first = materialize(births.groupBy("name").agg(F.min_by("parent", "e").alias("parent"), F.min("e").alias("e")))
    table = materialize(first.join(up(), "parent", "left").select("e", "ptr", F.when(F.col("parent").isNull(), F.col("e")).alias("root")))

    # Chains are followed by places alone; names are joined to both ends.
    ended = pointed(table, {"root": F.coalesce("root", "b_root")}).select("e", "root")
    tops = first.where("parent IS NULL").select(F.col("e").alias("root"), F.col("name").alias("lineage_id"))
    named = materialize(ended.join(tops, "root").join(first.select("e", F.col("name").alias("__id")), "e").select("__id", "lineage_id"))
    release(ended)
    release(births)
    release(first)
    about = F.when(F.col("op") == "assert", F.col("id")).otherwise(F.col("target"))
    return log.drop("lineage_id").withColumn("__id", about).join(named, "__id", "left").drop("__id")


def _marks(log: DataFrame, births: DataFrame, hot: DataFrame | None, width: int) -> DataFrame:
    """The state of claims after their last operation in a range, and after those that bear a successor.

    of is the claim. A claim's range (block) is the whole of seq, or for hot ones a part of it. Within a
    range, e is the birth that the state goes back to, null while the range has seen none; st, cf
    and la are the last status, confidence and access (structs, null while there is none); act
    counts the touches while active, unk those before the range's first status, which count if
    the claim comes into the range active.
    """
    status = F.create_map(*[F.lit(x) for kv in _STATUS.items() for x in kv])[F.col("op")]
    wrapped = lambda x: F.struct(x.cast("string").alias("x"))
    acts = log.where(F.col("op").isin(*_STATUS, "touch", "confidence") & F.col("target").isNotNull()).select(
        F.col("target").alias("of"), "seq", F.lit(None).cast("long").alias("b"), _succeeds().alias("succ"), F.when(status.isNotNull(), wrapped(status)).alias("st"),
        F.when(F.col("op") == "confidence", wrapped(F.col("to"))).alias("cf"), F.when(F.col("op") == "touch", wrapped(F.col("ts"))).alias("touch"),
    )
    none = lambda c: F.lit(None).cast("struct<x:string>").alias(c)
    born = births.select(F.col("name").alias("of"), F.col("e").alias("seq"), F.col("e").alias("b"), F.lit(False).alias("succ"), F.when(F.col("status") != "active", wrapped(F.col("status"))).alias("st"), none("cf"), none("touch"))
    rows = acts.unionByName(born)
    rows = rows.withColumn("hot", F.lit(None).cast("boolean")) if hot is None else rows.join(hot, "of", "left")
    rows = rows.withColumn("block", F.when(F.col("hot"), F.floor(F.col("seq") / width)).otherwise(0))
    # A claim that is born by an operation on itself is born after it.
    order = ("seq", F.col("b").isNotNull())
    rows = rows.withColumn("e", F.last("b", ignorenulls=True).over(Window.partitionBy("of", "block").orderBy(*order).rowsBetween(*_EVER)))
    since = Window.partitionBy("of", "block", "e").orderBy(*order)
    run = since.rowsBetween(*_EVER)
    rows = rows.withColumns({"st": F.last("st", ignorenulls=True).over(run), "cf": F.last("cf", ignorenulls=True).over(run), "last": F.lead("seq").over(since).isNull()})
    known = F.coalesce(F.col("st.x"), F.when(F.col("e").isNotNull(), F.lit("active")))
    hit, maybe = F.when(known == "active", F.col("touch")), F.when(known.isNull(), F.col("touch"))
    rows = rows.withColumns({"act": F.count(hit).over(run), "unk": F.count(maybe).over(run), "la": F.last(hit, ignorenulls=True).over(run), "la_unk": F.last(maybe, ignorenulls=True).over(run)})
    return rows.where("last OR succ").select("of", "block", "hot", "seq", "e", "succ", "last", "st", "cf", "act", "unk", "la", "la_unk")


def _composed(marks: DataFrame) -> DataFrame:
    """Marks of hot claims with the state that their range began with: (of, seq, e, succ, last, st, cf, hits, la).

    A range is a function of the state before it. Summaries, a row per claim, range and birth, are
    put in order, and the marks of a range are joined with what came before it.
    """
    order = Window.partitionBy("of").orderBy("block", F.col("e").isNotNull(), "e")
    ends = marks.where("last").withColumn("life", F.last("e", ignorenulls=True).over(order.rowsBetween(*_EVER))).where("life IS NOT NULL")
    before = Window.partitionBy("of", "life").orderBy("block").rowsBetween(*_BEFORE)
    ends = ends.withColumns({"st0": F.coalesce(F.last("st", ignorenulls=True).over(before)["x"], F.lit("active")), "cf0": F.last("cf", ignorenulls=True).over(before)})
    live = F.col("st0") == "active"
    touches, seen = F.col("act") + F.when(live, F.col("unk")).otherwise(0), F.coalesce("la", F.when(live, F.col("la_unk")))
    ends = ends.withColumns({"h0": F.coalesce(F.sum(touches).over(before), F.lit(0)), "la0": F.last(seen, ignorenulls=True).over(before)})
    side = ends.select(F.col("of").alias("of0"), F.col("block").alias("block0"), F.col("e").alias("e0"), "life", "st0", "cf0", "h0", "la0")
    met = marks.join(side, (F.col("of") == F.col("of0")) & (F.col("block") == F.col("block0")) & F.col("e").eqNullSafe(F.col("e0")))
    came = F.when(F.col("e").isNull(), F.struct(F.col("st0").alias("x")))
    return met.select("of", "seq", F.col("life").alias("e"), "succ", "last", F.coalesce("st", came).alias("st"), F.coalesce("cf", "cf0").alias("cf"), (F.col("h0") + touches).alias("hits"), F.coalesce(seen, "la0").alias("la"))


def replay(log: DataFrame, base: DataFrame | None = None, hot: int | None = None) -> DataFrame:
    """Claims in the schema CLAIMS; birth_seq gives their order.

    With base, claims as they were before the log's first operation: only those that the log names
    are worked on, the rest is passed through.

    The state of a claim after an operation is a running value since its birth, and a
    successor's is a function of its target's at that moment. Functions compose, so chains of births
    are followed by pointers that double, in log2 of their length rounds. A claim with more than
    HOT operations is cut into ranges of seq, each a function of the state before it, which are
    put together in order; so one claim or one lineage of any length spreads over all tasks.

    Operations of an unknown kind, or on a target that does not exist yet, change nothing; nor does an
    assert without an id. lineage_id is that of the assert that a claim descends from, or else that
    claim's id. An empty log has no claims. The result is a table: reading or sorting it replays nothing.
    """
    names = [x.split()[0] for x in schemas.OPLOG.split(", ")]
    log = log.select(*[n for n in names if n not in ("extra", "hard")])
    births = of_log = materialize(_births(log))
    named = there = None
    if base is not None:
        # Only ids meet here: of the base, what the log doesn't name need not travel.
        named = log.select(F.col("target").alias("id")).unionByName(births.select(F.col("name").alias("id"))).where("id IS NOT NULL").distinct()
        named = materialize(base.select("id").join(named, "id", "left_semi"))
        there = base.join(named, "id", "left_semi").withColumns({"carry": F.lit(None).cast("boolean"), "ts": F.lit(None).cast("string"), "parent": F.lit(None).cast("string")})
        there = materialize(there.select(F.col("birth_seq").alias("e"), F.col("id").alias("name"), "parent", *_FIXED, "status"))
        births = of_log.unionByName(there)
    touched = log.select(F.col("target").alias("of")).unionByName(births.select(F.col("name").alias("of"))).where("of IS NOT NULL")
    crowded = touched.groupBy("of").count().where(F.col("count") > (hot or HOT))
    rows = crowded.agg(F.sum("count")).first()[0]
    crowded = materialize(crowded.select("of", F.lit(True).alias("hot"))) if rows else None
    wrapped = lambda c: F.struct(F.col(c).alias("x"))
    carry = F.coalesce("carry", F.lit(False))
    while True:
        marks = materialize(_marks(log, births, crowded, max(RANGE, int((rows or 0) ** 0.5))))
        state = marks.where("hot IS NULL AND e IS NOT NULL").select("of", "seq", "e", "succ", "last", "st", "cf", F.col("act").alias("hits"), "la")
        if rows:
            state = materialize(state.unionByName(_composed(marks.where("hot"))))
        roots = births.where("parent IS NULL").select(
            "e", F.lit(None).cast("long").alias("ptr"), F.col("e").alias("root"), wrapped("created").alias("created"), wrapped("last_accessed").alias("la"), wrapped("confidence").alias("cf"),
            F.lit(True).alias("h_set"), F.coalesce("hits", F.lit(0)).cast("long").alias("h_add"),
        )
        met = state.where("succ").select(F.col("seq").alias("e"), F.col("e").alias("ptr"), F.col("cf").alias("t_cf"), F.col("hits").alias("t_hits"), F.col("la").alias("t_la"))
        below = births.where("parent IS NOT NULL").join(met, "e", "left").select(
            "e", "ptr", F.lit(None).cast("long").alias("root"), F.when(~carry, wrapped("ts")).alias("created"), F.when(carry, F.col("t_la")).otherwise(F.struct(F.lit(None).cast("string").alias("x"))).alias("la"),
            F.col("t_cf").alias("cf"), (~carry).alias("h_set"), F.when(carry, F.col("t_hits")).otherwise(0).cast("long").alias("h_add"),
        )
        chains = materialize(roots.unionByName(below))
        if chains.where("ptr IS NULL AND root IS NULL").isEmpty():
            break
        # Some targets were not there: their successors are no births, and the states are made without them.
        release(chains)
        release(marks)
        births = _effective(births)
    functions = {c: F.coalesce(c, f"b_{c}") for c in ("root", "created", "la", "cf")}
    functions |= {"h_set": F.coalesce(F.col("h_set") | F.col("b_h_set"), "h_set"), "h_add": F.col("h_add") + F.when(F.col("h_set"), 0).otherwise(F.coalesce("b_h_add", F.lit(0)))}
    bases = pointed(chains, functions)
    last = state.where("last").groupBy("of").agg(F.max_by(F.struct("e", "st", "cf", "hits", "la"), F.struct("e", "seq")).alias("x"), F.min("e").alias("birth_seq"))
    last = last.select("birth_seq", "x.e", F.col("x.st.x").alias("l_st"), F.col("x.cf").alias("l_cf"), F.col("x.hits").alias("l_hits"), F.col("x.la").alias("l_la"))
    top = births.where("parent IS NULL").select(F.col("e").alias("root"), F.coalesce("lineage_id", "name").alias("lineage_id"), "key", "kind", "entity", "source")
    # Texts come last, so that they travel once.
    full = last.join(bases.drop("ptr").join(top, "root"), "e").join(births.select("e", F.col("name").alias("id"), "text"), "e")
    out = materialize(
        full.select(
            "id", "text", "key", "kind", "entity", "source", F.coalesce("l_cf", "cf")["x"].alias("confidence"), F.col("created.x").alias("created"), (F.col("h_add") + F.col("l_hits")).cast("long").alias("hits"),
            F.coalesce("l_la", "la")["x"].alias("last_accessed"), F.coalesce("l_st", F.lit("active")).alias("status"), "birth_seq", "lineage_id",
        )
    )
    for table in (births, of_log, there, crowded, marks, state, chains, bases):
        release(table)
    return out if base is None else out.unionByName(base.join(named, "id", "left_anti").select(*out.columns))
