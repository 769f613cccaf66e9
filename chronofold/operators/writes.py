"""Many writes at once: a table of texts becomes operations of the log, by grouping and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as X

#: What a write may say of its claim besides its text.
FIELDS = ["key", "kind", "entity", "source", "confidence"]


def latest_by_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Each key's last row in order, later columns of it deciding ties. Rows with a null key form a group as well.

    A maximum, so a task sends one row per key, however many rows a key has.
    """
    rest = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("x"))
    return last.select(*[F.col(k) if k in keys else F.col(f"x.{k}").alias(k) for k in rows.columns])


def copies(rows: DataFrame, same: Column, order: str) -> DataFrame:
    """(same, first, copies): for each value of `same`, the least `order` and how many rows have it. One row per value leaves a task."""
    return rows.groupBy(same.alias("same")).agg(F.min(order).alias("first"), F.count("*").alias("copies"))


def said(kind: Column, entity: Column, text: Column) -> Column:
    """A digest of what a claim says; nulls count as empty."""
    part = lambda x: F.base64(F.coalesce(x, F.lit("")).cast("binary"))
    return F.md5(F.concat_ws("|", part(kind), part(entity), part(text)).cast("binary"))


def prepared(writes: DataFrame, order: list[str]) -> DataFrame:
    """Rows (row, id, text, FIELDS, at) of the writes with a text; row names one, at gives their order. Columns that the writes lack are null, ids are made."""
    text = lambda n: F.col(n).cast("string") if n in writes.columns else F.lit(None).cast("string")
    fields = [F.coalesce(text(n), F.lit("low")).alias(n) if n == "confidence" else text(n).alias(n) for n in FIELDS]
    name = F.coalesce(text("id"), F.replace(F.expr("uuid()"), F.lit("-"), F.lit("")))
    rows = writes.where("text <> ''").select(F.monotonically_increasing_id().alias("row"), name.alias("id"), text("text").alias("text"), *fields, *[F.col(c).alias(f"__{c}") for c in order])
    return rows.select("row", "id", "text", *FIELDS, F.struct(*[f"__{c}" for c in order], "id").alias("at"))


def placed(rows: DataFrame) -> DataFrame:
    """Prepared rows whose at goes by the text before the id, where at's other parts leave the order of any two open."""
    given = [F.col(f"at.{n}") for n in rows.schema["at"].dataType.names[:-1]]
    if rows.groupBy(*given).count().where(F.col("count") > 1).isEmpty():
        return rows
    return rows.withColumn("at", F.struct(*given, "text", "id"))


def _ops(rows: DataFrame, step: int, op: str, at: Column, now: str, row: Column | None = None, **fields: Column) -> DataFrame:
    """Operations of one kind, without texts: step and at are their order, row is that of the write that an assert's text comes from."""
    given = {n: fields.get(n, F.lit(None).cast("string")) for n in ("id", "target", *FIELDS, "to", "created", "lineage_id")}
    given["row"] = F.lit(None).cast("long") if row is None else row
    hits = F.lit(0 if op == "assert" else None).cast("long").alias("hits")
    return rows.select(F.lit(step).alias("step"), at.alias("at"), F.lit(op).alias("op"), *[c.alias(n) for n, c in given.items()], hits, F.lit(now if op != "assert" else None).cast("string").alias("ts"))


def _asserts(rows: DataFrame, now: str) -> DataFrame:
    return _ops(rows, 0, "assert", F.col("at"), now, F.col("row"), **{n: F.col(n) for n in ("id", *FIELDS)}, created=F.lit(now), lineage_id=F.col("id"))


def _after(rows: DataFrame) -> Column:
    """A place after all asserts: of operations that change different claims, the order doesn't matter."""
    return F.lit(None).cast(rows.schema["at"].dataType)


def keyed_ops(rows: DataFrame, live: DataFrame, now: str) -> DataFrame:
    """Operations of writes under keys: each asserts a claim, and the last of a key supersedes the key's active claims and the writes before it.

    The last ids, one per key, are joined to the writes; where one key has a large part of these, the join is a
    skewed one that adaptive execution splits.
    """
    last = latest_by_key(rows.select("key", "id", "at"), ["key"], ["at"]).select("key", F.col("id").alias("last"))
    old = live.join(last, "key").select("id", "lineage_id")
    passed = rows.join(last, "key").where(F.col("id") != F.col("last")).select("id", F.col("id").alias("lineage_id"))
    gone = old.unionByName(passed)
    return _asserts(rows, now).unionByName(_ops(gone, 1, "supersede", _after(rows), now, target=F.col("id"), lineage_id=F.col("lineage_id")))


def keyless_ops(rows: DataFrame, firsts: DataFrame, known: DataFrame, now: str) -> DataFrame:
    """Operations of writes without keys.

    rows: (digest, id, at) of all writes; firsts: the first write of each digest, with its fields; known: (digest, claim)
    of digests that an active claim says already, with the claim's lineage_id, hits and confidence. A digest that is
    not known is asserted by its first write. Every other write touches the claim, whose confidence follows its hits.
    """
    new = firsts.join(known.select("digest"), "digest", "left_anti")
    holds = known.select("digest", "claim", "lineage_id", "hits", "confidence").unionByName(
        new.select("digest", F.col("id").alias("claim"), F.col("id").alias("lineage_id"), F.lit(0).cast("long").alias("hits"), "confidence")
    )
    again = rows.join(holds, "digest").where(F.col("id") != F.col("claim"))
    touches = _ops(again, 1, "touch", F.col("at"), now, target=F.col("claim"), lineage_id=F.col("lineage_id"))
    counted = again.groupBy("claim").agg(F.first("lineage_id").alias("lineage_id"), F.first("confidence").alias("confidence"), (F.coalesce(F.first("hits"), F.lit(0)) + F.count("*")).alias("after"))
    raised = counted.withColumn("to", X.promoted(F.col("confidence"), F.col("after"))).where("to IS NOT NULL")
    risen = _ops(raised, 2, "confidence", _after(rows), now, target=F.col("claim"), to=F.col("to"), lineage_id=F.col("lineage_id"))
    return _asserts(new, now).unionByName(touches).unionByName(risen)
