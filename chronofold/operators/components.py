"""Connected components by contraction, without collecting links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, release

#: Pointers (16 bytes each) up to which a table of them is broadcast, and rows of one key that a task of a shuffled join takes.
SMALL, HOT = 1_000_000, 100_000


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): component is the smallest node reachable over edges.

    Only nodes with an edge are returned. Each round points every node at its smallest
    neighbour, follows the pointers two steps, and contracts the edges; a node that has an edge
    left is merged or is a local minimum, so at least half of them vanish per round. All steps
    are aggregates and joins with map-side combination; the state of each round is a table in the
    shared folder. Null ends and self-loops are ignored; no edges give an empty table.
    """
    left = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))
    left = materialize(left.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    labels = None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        first = materialize(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("p")))
        step = first
        for _ in range(2):
            # Pointers of a node that points at itself change nothing and stay out of the join.
            further = pointed(step, step.where("u <> p"), "p", "q").select("u", F.coalesce("q", "p").alias("p"))
            further = materialize(further)
            if step is not first:
                release(step)
            step = further
        release(first)
        ends = pointed(pointed(left, step, "u", "pu"), step, "v", "pv").where("pu <> pv")
        new_left = materialize(ends.select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct())
        if labels is None:
            labels = step.select(F.col("u").alias("node"), F.col("p").alias("component"))
            labels._scratch_path = step._scratch_path
        else:
            after = materialize(pointed(labels, step, "component", "p").select("node", F.coalesce("p", "component").alias("component")))
            release(labels)
            release(step)
            labels = after
        release(left)
        left = new_left
    release(left)
    if labels is None:
        return left.sparkSession.createDataFrame([], "node long, component long")
    return labels


def pointed(rows: DataFrame, pointers: DataFrame, key: str, name: str, small: int = SMALL, hot: int = HOT) -> DataFrame:
    """rows with `name`: where the pointers (u, p) send the column `key`, or null.

    Few pointers are broadcast. Many go through a shuffle, in which the rows of a key with more
    than `hot` of them are dealt out, with copies of that key's one pointer.
    """
    side = pointers.select(F.col("u").alias(key), F.col("p").alias(name))
    if pointers.count() <= small:
        return rows.join(F.broadcast(side), key, "left")
    crowded = materialize(rows.groupBy(key).count().where(F.col("count") > hot).select(key, F.ceil(F.col("count") / hot).cast("int").alias("__parts")))
    if crowded.isEmpty():
        return rows.join(side, key, "left")
    # A crowded key stands for more than `hot` rows, so there are few of them.
    near = F.broadcast(crowded) if crowded.count() <= small else crowded
    other = next(c for c in rows.columns if c != key)
    dealt = rows.join(near, key, "left").withColumn("__part", F.coalesce(F.pmod(F.xxhash64(other), F.col("__parts")).cast("int"), F.lit(0)))
    copied = side.join(near, key, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1)))
    return dealt.drop("__parts").join(copied.drop("__parts"), [key, "__part"], "left").drop("__part")
