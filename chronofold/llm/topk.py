"""Exact top-k inner products: norm-sorted blocks, rotated partial sums, residual bounds.

Components become the integers floor(scale * x). Candidates are sorted by descending length and
packed in blocks. A query's tenth best score among the longest rows is a floor for its result, and
floors rise while blocks are scanned. A block that the product of lengths excludes for a whole group
of queries never leaves its place. Within a block, leading coordinates of an SVD rotation give
partial products, in a few steps, and Cauchy-Schwarz bounds the rest by the product of the residual
lengths; pairs under the floor go at each step. Survivors are scored exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, materialize, range_parts, release, shuffle_parts, tidy
from .vectors import packed, stack

_EXACT = float(1 << 53)
_LONG = (1 << 63) - 1
#: Shares of the spectrum that the steps of the partial sums hold.
STEPS = (0.5, 0.75, 0.9)
#: Blocks of either side that a task holds, 32 MB each at 64 components and 1,024 rows.
HELD = 64


def exact_scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products of rows with rows at the same place, as int64; beyond the range of a long they stop at its ends."""
    top = np.abs(queries).max(initial=0) * np.abs(rows).max(initial=0) * max(1, rows.shape[1])
    if top < _EXACT:
        return np.rint(np.einsum("ij,ij->i", queries, rows)).astype(np.int64)
    big = np.array([sum(int(x) * int(y) for x, y in zip(q, r, strict=True)) for q, r in zip(queries, rows, strict=True)], dtype=object)
    return np.clip(big, -_LONG - 1, _LONG).astype(np.int64) if len(big) else np.zeros(0, dtype=np.int64)


def steps(spectrum: np.ndarray) -> list[int]:
    """Leading coordinates after which the partial sums are bounded, from the descending spectrum."""
    share = np.cumsum(spectrum) / max(float(spectrum.sum()), 1e-300)
    return sorted({p for p in (int(np.searchsorted(share, x) + 1) for x in STEPS) if p < len(spectrum)})


class Rotated:
    """Rows of a block: as they are, their lengths, and rotated, with the residual length after each step."""

    def __init__(self, rows: np.ndarray, turn: np.ndarray, at: list[int]):
        self.rows, self.turned, self.length = rows, rows @ turn, np.linalg.norm(rows, axis=1)
        self.rest = [np.linalg.norm(self.turned[:, p:], axis=1) for p in at]


def survivors(q: Rotated, c: Rotated, low: np.ndarray, at: list[int], high: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (query, row) of the pairs that no bound puts under the query's floor."""
    some = np.flatnonzero(~(q.length * high * (1 + 1e-9) + 1 < low))  # what overflows stays
    if not len(some) or not len(c.rows):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    slack = lambda x, y: 1 + 1e-9 * x * y
    p = at[0] if at else 0
    bound = np.outer(q.length[some], c.length)
    if p:
        bound = q.turned[some, :p] @ c.turned[:, :p].T + np.outer(q.rest[0][some], c.rest[0])
    x, row = np.nonzero(~(bound + slack(q.length[some, None], c.length[None, :]) < low[some, None]))
    x = some[x]
    done = np.einsum("ij,ij->i", q.turned[x, :p], c.turned[row, :p]) if len(at) > 1 else None
    for k in range(1, len(at)):
        done = done + np.einsum("ij,ij->i", q.turned[x, at[k - 1] : at[k]], c.turned[row, at[k - 1] : at[k]])
        live = ~(done + q.rest[k][x] * c.rest[k][row] + slack(q.length[x], c.length[row]) < low[x])
        x, row, done = x[live], row[live], done[live]
    return x, row


def best(at: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best entries of each query, ties to the smaller id, in order."""
    order = np.lexsort((ids, ~score, at))
    own = at[order]
    start = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, dtype=int)
    return order[np.arange(len(own)) - np.repeat(start, np.diff(np.append(start, len(own)))) < k]


class ExactTopK:
    """k best candidates of each query. lead: rotated coordinates of the first partial sum (else by the
    spectrum); block, query_block: rows of a block; seeds: longest rows that give the first floors."""

    def __init__(self, k: int = 10, scale: int = 1024, lead: int | None = None, block: int = 1024, query_block: int = 1024, seeds: int = 128):
        self.k, self.scale, self.lead, self.block, self.query_block, self.seeds = k, scale, lead, block, query_block, max(seeds, 2 * k)

    def _rotation(self, rows: DataFrame) -> dict[int, tuple[np.ndarray, list[int]]]:
        """Right singular vectors and steps per vector length, from the Gram matrix of all rows."""

        def gram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums: dict[int, np.ndarray] = {}
            for pdf in batches:
                for width, part in pdf.groupby(pdf["vec"].str.len()):
                    m = stack(part["vec"])
                    m = m / np.maximum(np.linalg.norm(m, axis=1), 1e-300)[:, None]
                    sums[width] = sums.get(width, 0) + m.T @ m
            for width, g in sums.items():
                d = len(g)
                yield pd.DataFrame({"d": d, "cell": np.arange(d * d), "x": g.ravel()})

        cells = rows.select("vec").mapInPandas(gram, "d int, cell int, x double").groupBy("d", "cell").agg(F.sum("x").alias("x")).toPandas()
        out = {}
        for d, part in cells.groupby("d"):
            g = np.zeros(d * d)
            g[part["cell"]] = part["x"]
            g = g.reshape(d, d)
            values, turn = np.linalg.eigh((g + g.T) / 2)
            at = steps(np.maximum(values[::-1], 0))
            if self.lead is not None and self.lead < d:
                at = [self.lead, *(p for p in at if p > self.lead)]
            out[int(d)] = np.ascontiguousarray(turn[:, ::-1]), at
        return out

    def _blocks(self, rows: DataFrame, count: int, size: int) -> DataFrame:
        """Blocks of rows in order of descending length: (d, block, high, rows, ids, vecs)."""
        parts = range_parts(rows.sparkSession, count, least=size, most=50 * size)
        ordered = rows.repartitionByRange(parts, "d", F.desc("norm"), "vec_id").sortWithinPartitions("d", F.desc("norm"), "vec_id")

        def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: pd.DataFrame | None = None
            number = TaskContext.get().partitionId() << 32
            for pdf in batches:
                pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
                held = None
                for d, part in pdf.groupby("d"):
                    last = d == pdf["d"].iloc[-1]
                    for i in range(0, len(part), size):
                        cut = part.iloc[i : i + size]
                        if last and len(cut) < size:
                            held = cut
                        else:
                            yield emit(cut, number)
                            number += 1
            if held is not None:
                yield emit(held, number)

        def emit(cut: pd.DataFrame, number: int) -> pd.DataFrame:
            ids = cut["vec_id"].to_numpy(dtype="<i8")
            return pd.DataFrame({"d": [int(cut["d"].iloc[0])], "block": [number], "high": [float(cut["norm"].max())], "rows": [len(cut)], "ids": [ids.tobytes()], "vecs": [b"".join(cut["vec"])]})

        return materialize(ordered.mapInPandas(tidy(pack), "d int, block long, high double, rows int, ids binary, vecs binary"))

    def transform(self, vectors: DataFrame, queries: str, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
        """(query_id, rank, vec_id, score): for each row that satisfies `queries` (SQL over vec_id)
        the k highest scores among all other rows, ties to the smaller vec_id.

        Null vectors and those with a null or non-finite component take no part, nor do rows
        without an id; vectors are compared with those of equal length only. A row is no candidate
        of a query with its own vec_id. Repeated rows are candidates each, and a repeated query
        is answered once. An empty table gives an empty result.
        """
        k, scale, seeds = self.k, float(self.scale), self.seeds

        def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                vecs, norms = [], []
                for raw in pdf["vec"]:
                    v = np.floor(np.frombuffer(raw, dtype="<f8") * scale)
                    vecs.append(v.tobytes() if np.isfinite(v).all() else None)
                    norms.append(float(np.linalg.norm(v)))
                yield pd.DataFrame({"vec_id": pdf["vec_id"], "d": pdf["vec"].str.len() // 8, "norm": norms, "vec": vecs}).dropna(subset=["vec"])

        spark = vectors.sparkSession
        base = packed(vectors, id_col, vec_col).where("vec IS NOT NULL AND vec_id IS NOT NULL")
        rows = materialize(base.mapInPandas(tidy(whole), "vec_id long, d int, norm double, vec binary"))
        rotation = self._rotation(rows)
        asked = rows.where(queries).dropDuplicates(["vec_id", "vec"])
        cand, ask = self._blocks(rows, rows.count(), self.block), self._blocks(asked, asked.count(), self.query_block)

        def opened(r) -> tuple[np.ndarray, np.ndarray]:
            ids = np.frombuffer(r.ids, dtype="<i8")
            return ids, np.frombuffer(r.vecs, dtype="<f8").reshape(len(ids), -1)

        # First floors: the k-th score among the longest rows, of the first block of each vector length.
        first = cand.select("d", "block", "high").groupBy("d").agg(F.max_by("block", F.struct("high", -F.col("block"))).alias("block"))
        seed = cand.join(first, ["d", "block"]).select("d", F.col("ids").alias("s_ids"), F.col("vecs").alias("s_vecs"), F.col("rows").alias("s_rows"))  # a row per vector length

        def floors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for r in pdf.itertuples():
                    (q_ids, q), n = opened(r), min(seeds, r.s_rows)
                    c_ids, c = np.frombuffer(r.s_ids, dtype="<i8")[:n], np.frombuffer(r.s_vecs, dtype="<f8").reshape(r.s_rows, r.d)[:n]
                    low, length = np.full(len(q), -np.inf), np.linalg.norm(q, axis=1)
                    for i in range(len(q)):
                        others = c[c_ids != q_ids[i]]
                        if len(others) >= k:
                            scores = exact_scores(np.broadcast_to(q[i], others.shape), others)
                            low[i] = float(np.partition(scores, len(scores) - k)[len(scores) - k])
                    # The shortest row that may still reach a floor of this block; what can't be told needs every row.
                    need = float(np.where(length > 0, (low - 1) / np.maximum(length, 1e-300) * (1 - 1e-9), np.where(low > 0, np.inf, -np.inf)).min())
                    yield pd.DataFrame({"d": [r.d], "block": [r.block], "rows": [r.rows], "ids": [r.ids], "vecs": [r.vecs], "low": [low.tobytes()], "need": [need]})

        ask_full = materialize(ask.join(F.broadcast(seed), "d").select("d", "block", "rows", "ids", "vecs", "s_ids", "s_vecs", "s_rows").mapInPandas(tidy(floors), "d int, block long, rows int, ids binary, vecs binary, low binary, need double"))
        # Query blocks that need rows of like length make a group.
        number = F.row_number().over(Window.partitionBy("d").orderBy(F.desc("need"), "block"))  # a row per block
        groups = ask_full.select("d", "block", "need").withColumn("group", F.floor((number - 1) / HELD).cast("int"))
        groups = materialize(groups)
        headers = groups.groupBy("d", "group").agg(F.min("need").alias("need"))
        lanes = max(1, -(-cand.count() // HELD), min(cand.count(), shuffle_parts(spark)))
        # A row per HELD blocks of queries, joined by vector length and bound only: beyond the count it is shuffled.
        near = F.broadcast(headers) if headers.count() <= BROADCAST_IDS // 8 else headers
        left = cand.join(near, "d").where(F.col("high") >= F.col("need")).drop("need").withColumn("lane", F.pmod(F.xxhash64("block"), F.lit(lanes)).cast("int"))
        right = ask_full.join(groups.select("d", "block", "group"), ["d", "block"]).withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
        right = right.select(F.col("d").alias("q_d"), F.col("group").alias("q_group"), F.col("lane").alias("q_lane"), "rows", "ids", "vecs", "low")

        def scan(key, blocks: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
            out = []
            if len(blocks) and len(asked):
                turn, at = rotation[int(key[0])]
                queries = [(*opened(r), np.frombuffer(r.low, dtype="<f8").copy()) for r in asked.itertuples()]
                queries = [(ids, Rotated(q, turn, at), low, [np.zeros(0, dtype=np.int64)] * 3) for ids, q, low in queries]
                for r in blocks.sort_values(["high", "block"], ascending=[False, True]).itertuples():
                    c_ids, c = opened(r)
                    c = Rotated(c, turn, at)
                    for ids, q, low, kept in queries:
                        x, row = survivors(q, c, low, at, r.high)
                        other = ids[x] != c_ids[row]
                        x, row = x[other], row[other]
                        if not len(x):
                            continue
                        score = exact_scores(q.rows[x], c.rows[row])
                        every = [np.concatenate([a, b]) for a, b in zip(kept, (x, c_ids[row], score), strict=True)]
                        top = best(*every, k)
                        kept[:] = [a[top] for a in every]
                        full = np.flatnonzero(np.bincount(kept[0], minlength=len(ids)) == k)
                        low[full] = np.maximum(low[full], kept[2][np.searchsorted(kept[0], full, side="right") - 1])
                out = [pd.DataFrame({"query_id": ids[x], "vec_id": c, "score": s}) for ids, _, _, (x, c, s) in queries]
            return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")

        found = left.groupBy("d", "group", "lane").cogroup(right.groupBy("q_d", "q_group", "q_lane")).applyInPandas(scan, "query_id long, vec_id long, score long")
        ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        found = found.withColumn("rank", F.row_number().over(ranked)).where(f"rank <= {k}")
        out = materialize(found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
        for x in (rows, cand, ask, ask_full, groups):
            release(x)
        return out
