"""Vector search and similarity joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..session import materialize, release, scratch_path
from . import metric
from .cells import CellIndex

#: Rows of a block of the self-join, groups that blocks form, and blocks that a group has at most.
BLOCK, GROUPS, HELD = 1024, 24, 32
#: Left rows of a nearest join that are broadcast, or make a group.
LEFT = 10_000


def topk(vectors: DataFrame, query: list[float], k: int, id_col: str = "id", order: str = "ord") -> DataFrame:
    """The k best rows by cosine with one query, ties in table order; k must be 1 or more.

    A literal query and a sorted limit: every task keeps k rows, nothing else moves.
    """
    if k < 1:
        raise ValueError("k must be 1 or more")
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.withColumn("score", X.cosine(F.col("embedding"), q))
    return scored.orderBy(F.desc("score"), F.asc(order)).limit(k)


def topk_batch(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "id", order: str | None = None) -> DataFrame:
    """(query_id, id, score, rank): the k best rows for each row of queries (query_id, q), ties in order (by default of the id).

    The vectors are put into an index of cells first, so that a query meets those cells only that can hold its best.
    """
    path = scratch_path(vectors.sparkSession, "cells-")
    found = CellIndex.build(vectors, path, id_col, order or id_col).batch(queries, k)
    return found.select("query_id", F.col("id").cast(vectors.schema[id_col].dataType).alias("id"), "score", "rank")


def tiles(vectors: DataFrame, floor: float, id_col: str = "id", order: str = "ord") -> tuple[DataFrame, DataFrame]:
    """Blocks of vectors (packed, in cells of pivots) and the pairs of blocks that may hold pairs with a cosine of floor."""
    # Up to a floor of 0, zero vectors match as well, and no angle rules anything out.
    reach = float(np.arccos(min(floor, 1.0))) if floor > 0 else float(np.pi)
    rows = metric.sample(vectors, order)
    pivots = metric.join_pivots(rows, reach) if len(rows) and floor > 0 else np.ones((1, max(1, rows.shape[-1])))
    homes = materialize(metric.in_cells(vectors, pivots, id_col, order))
    radius = np.zeros(len(pivots))
    for r in homes.groupBy("cell").agg(F.max("angle").alias("r")).collect():  # a row per pivot
        radius[r["cell"]] = r["r"]
    blocks = materialize(metric.packed(metric.with_guests(homes, pivots, radius, reach), BLOCK))
    release(homes)
    return blocks, metric.meetings(blocks, reach)


def similar_pairs(vectors: DataFrame, floor: float, id_col: str = "id", order: str = "ord") -> DataFrame:
    """(a, b, a_ord, b_ord, score): pairs with a before b whose cosine is at least floor.

    Each vector is at home in the cell of its nearest pivot and visits the cells after it that
    may hold partners; only blocks that share a cell and a range of angles meet, each pair of vectors once. The
    test is of the cosine itself: pivots only decide what needn't be looked at.
    score is rounded to 4 places, the floor is held to the raw one. Null vectors have no pairs.
    """
    blocks, met = tiles(vectors, floor, id_col, order)

    def unit(data: bytes, n: int) -> np.ndarray:
        m = np.frombuffer(data, dtype="<f8").reshape(n, -1)
        return m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-12)

    def meet(one: tuple, two: tuple, same: bool) -> pd.DataFrame:
        s = one[2] @ two[2].T
        i, j = np.nonzero(s >= floor)
        a, b = one[1][i], two[1][j]
        keep = a < b if same else a != b
        i, j, swap = i[keep], j[keep], (a > b)[keep]
        ids, ids2, a, b = one[0][i], two[0][j], a[keep], b[keep]
        return pd.DataFrame({"a": np.where(swap, ids2, ids), "b": np.where(swap, ids, ids2), "a_ord": np.where(swap, b, a), "b_ord": np.where(swap, a, b), "raw": s[i, j]})

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come by place: the blocks of one are held until the next begins."""
        place, held, asked = None, {}, []
        for pdf in batches:
            for r in pdf.itertuples():
                if (r.g, r.h) != place:
                    yield from (meet(held[x], held[y], x == y) for x, y in asked)
                    place, held, asked = (r.g, r.h), {}, []
                held[r.block] = np.asarray(r.ids, dtype=object), np.asarray(r.ords), unit(r.data, len(r.ids))
                asked += [(r.block, y) for y in r.others]
        yield from (meet(held[x], held[y], x == y) for x, y in asked)

    dealt = at_places(blocks, met).mapInPandas(compare, "a string, b string, a_ord long, b_ord long, raw double")
    return dealt.select("a", "b", "a_ord", "b_ord", F.round("raw", 4).alias("score"))


def at_places(blocks: DataFrame, met: DataFrame) -> DataFrame:
    """(g, h, block, others, ids, ords, data): blocks at the places where their groups meet, sorted by place.

    Neighbouring blocks form at most GROUPS groups, unless these would hold more than HELD blocks, and a place is a pair
    of groups: a block travels once to each place instead of once to each other block. `others` are those that it is compared with there.
    """
    total = blocks.count()
    size = max(1, min(HELD, -(-total // GROUPS)))
    # A row for each block, without what it holds.
    number = F.row_number().over(Window.orderBy("block")) - 1
    group = blocks.select("block", F.floor(number / size).cast("int").alias("g"))
    placed = met.select("block", "other").join(group, "block").join(group.select(F.col("block").alias("other"), F.col("g").alias("h")), "other")
    asks = placed.groupBy("g", "h", "block").agg(F.collect_list("other").alias("others"))
    asked = placed.select("g", "h", F.col("other").alias("block")).distinct().select("*", F.array().cast("array<long>").alias("others"))
    stops = materialize(asks.unionByName(asked).groupBy("g", "h", "block").agg(F.flatten(F.collect_list("others")).alias("others")))
    parts = max(1, min(stops.select("g", "h").distinct().count(), 4 * int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return stops.join(blocks.select("block", "ids", "ords", "data"), "block").repartition(parts, "g", "h").sortWithinPartitions("g", "h")


def nearest(left: DataFrame, right: DataFrame, left_id: str = "id", right_id: str = "id", right_order: str = "ord") -> DataFrame:
    """(id, nearest, score): for each left row the best right row, ties in right order.

    Left rows without any right row stay, with nulls. The left side is the small one (it is cut to
    a fixed number of entries before) and is broadcast. Beyond LEFT rows it is dealt into groups
    of about so many, and both sides are joined by group and a share of the right side.
    """
    count = left.count()
    groups, shares = max(1, -(-count // LEFT)), 1 if count <= LEFT else int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    l_rows = left.select(F.col(left_id).alias("id"), F.col("embedding").alias("l"), F.pmod(F.xxhash64(left_id), F.lit(groups)).cast("int").alias("j"))
    l_side = l_rows.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    r_rows = right.select(F.col(right_id).alias("nearest"), F.col(right_order).alias("o"), F.col("embedding").alias("r"), F.pmod(F.xxhash64(right_id), F.lit(shares)).cast("int").alias("share"))
    r_rows = r_rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    best = r_rows.join(F.broadcast(l_side) if count <= LEFT else l_side, ["j", "share"]).withColumn("score", X.cosine(F.col("l"), F.col("r")))
    best = best.groupBy("id").agg(F.max_by(F.struct("nearest", "score"), F.struct(F.col("score"), -F.col("o"))).alias("x"))
    return l_rows.select("id").join(best, "id", "left").select("id", F.col("x.nearest").alias("nearest"), F.round("x.score", 4).alias("score"))
