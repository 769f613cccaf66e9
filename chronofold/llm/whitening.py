"""Whitening by merged singular value decompositions."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release, ship

#: Rows that are decomposed at once, and summaries that one task merges.
BLOCK, FAN = 4096, 8
#: Entries beyond this cannot be counted in longs.
LARGEST = 2.0**53
#: Singular values under the largest one's share of this, per dimension, are rounding.
RANK_EPS = 1e-14
_SUMMARY = "part long, n long, sums array<string>, sigma array<double>, basis binary"

#: n rows with sums per dimension, and the singular values and vectors (as rows) of the rows less their mean.
Summary = tuple[int, list, np.ndarray, np.ndarray]


def _svd(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    _, s, vt = np.linalg.svd(np.linalg.qr(m, mode="r"), full_matrices=False)
    return s, vt


def summary(x: np.ndarray) -> Summary:
    """Of rows of integers or doubles. The sums of integers are exact, and their mean is taken off in whole and rest."""
    n = len(x)
    if x.dtype.kind != "i":
        sums = x.sum(axis=0)
        return n, sums.tolist(), *_svd(x - sums / n)
    fits = float(np.abs(x).max(initial=0)) * n < 2.0**62
    sums = [int(v) for v in (x if fits else x.astype(object)).sum(axis=0)]
    low = [v // n for v in sums]
    rest = np.array([(v - w * n) / n for v, w in zip(sums, low, strict=True)])
    return n, sums, *_svd((x - np.array(low, dtype=np.int64)).astype(float) - rest)


def merged(a: Summary, b: Summary) -> Summary:
    """Of both sets of rows: one row for the distance of the means, and no dimension is dropped."""
    (na, sa, da, va), (nb, sb, db, vb) = a, b
    gap = np.array([(x * nb - y * na) / (na * nb) for x, y in zip(sa, sb, strict=True)])
    rows = np.vstack([da[:, None] * va, db[:, None] * vb, np.sqrt(na * nb / (na + nb)) * gap])
    return na + nb, [x + y for x, y in zip(sa, sb, strict=True)], *_svd(rows)


def _row(part: int, s: Summary) -> tuple:
    return part, s[0], [str(x) for x in s[1]], s[2].tolist(), s[3].astype("<f8").tobytes()


def _summary(row, kind: type) -> Summary:
    sigma = np.asarray(row.sigma, dtype=float)
    return int(row.n), [kind(x) for x in row.sums], sigma, np.frombuffer(row.basis, dtype="<f8").reshape(len(sigma), -1)


def summarised(df: DataFrame, matrices, kind: type) -> DataFrame:
    """One summary (or none) of all rows. matrices: from batches to matrices of rows.

    Every task sums up its rows, then tasks merge FAN summaries each, round by round; a summary
    has at most d * d values whatever the rows.
    """

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = None
        for m in matrices(batches):
            for k in range(0, len(m), BLOCK):
                s = summary(m[k : k + BLOCK])
                found = s if found is None else merged(found, s)
        if found is not None:
            row = _row(TaskContext.get().partitionId(), found)
            types = (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.float64()), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=["part", "n", "sums", "sigma", "basis"])

    def further(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        got = reduce(merged, (_summary(r, kind) for r in rows.sort_values("part").itertuples()))
        return pd.DataFrame([_row(key[0], got)], columns=["part", "n", "sums", "sigma", "basis"])

    table = materialize(df.mapInArrow(first, _SUMMARY))
    while table.count() > 1:
        fewer = materialize(table.groupBy(F.floor(F.col("part") / FAN).alias("to")).applyInPandas(further, _SUMMARY))
        release(table)
        table = fewer
    return table


class Whitening:
    """transform(vectors): (vec_id, n, deviation, explained, whitened, identity_error), a row per vector.

    Entries become whole numbers floor(scale * c) + offset. Every task keeps sums, singular
    values and singular vectors of its centred rows in full rank; summaries are merged with a row for the
    distance of their means and decomposed again, so nothing is lost and the offset costs no digits.
    whitened has the first `components` principal components over their deviation, explained
    their shares of the variance, deviation the exact squared distance from the mean (times n * n), and
    identity_error tells how far the covariance of the whitened rows, summed up in the same way, is from the identity.

    Vectors that are null or empty, hold null or non-finite entries, or entries beyond 2**53 / scale, take no
    part, nor do those of another length than the commonest one (of ties the longest). Repeated rows, ids
    and null ids count like others. Without any variance there are no components (so whitened is
    empty); no vectors give an empty table. Other columns are not read.
    """

    def __init__(self, components: int = 32, scale: int = 64, offset: int = 1_000_000, id_col: str = "vec_id", vec_col: str = "embedding"):
        self.components, self.scale, self.offset, self.id_col, self.vec_col = components, scale, offset, id_col, vec_col

    def _reader(self, width: int):
        scale, offset = self.scale, self.offset

        def rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
            """Places in the batch of the rows that take part, and their whole numbers."""
            col = batch.column("v")
            flat = np.asarray(col.values.cast(pa.float64()).fill_null(np.nan), dtype=float)
            offsets = np.asarray(col.offsets)
            at = np.flatnonzero((np.diff(offsets) == width) & np.asarray(col.is_valid()))
            m = flat[offsets[at][:, None] + np.arange(width)] * scale
            good = (np.abs(m) <= LARGEST).all(axis=1)
            return at[good], np.floor(m[good]).astype(np.int64) + offset

        return rows

    def fit(self, rows: DataFrame, width: int) -> dict | None:
        """n, sums, eigenvalues, trace and components (at most components * width doubles reach the driver)."""
        read, most = self._reader(width), self.components

        def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for r in pdf.itertuples():
                    n, sums, sigma, basis = _summary(r, int)
                    k = int((sigma[:most] > sigma[0] * RANK_EPS * width).sum())
                    yield pd.DataFrame([(n, [str(x) for x in sums], (sigma[:k] ** 2 / n).tolist(), float((sigma**2).sum() / n), basis[:k].astype("<f8").tobytes())], columns=["n", "sums", "e", "trace", "basis"])

        table = summarised(rows, lambda batches: (x for b in batches if len(x := read(b)[1])), int)
        row = table.mapInPandas(finish, "n long, sums array<string>, e array<double>, trace double, basis binary").first()
        release(table)
        if row is None:
            return None
        return {"n": row.n, "sums": [int(x) for x in row.sums], "e": list(row.e), "trace": row.trace, "basis": np.frombuffer(row.basis, dtype="<f8").reshape(len(row.e), width)}

    def transform(self, vectors: DataFrame) -> DataFrame:
        spark = vectors.sparkSession
        ship(spark)
        rows = vectors.select(F.col(self.id_col).cast("long").alias("vec_id"), F.col(self.vec_col).alias("v")).where(F.size("v") > 0)
        lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
        schema = "vec_id long, deviation decimal(38, 0), whitened array<double>"
        found = None if lengths is None else self.fit(rows, lengths["d"])
        if found is None:
            empty = spark.createDataFrame([], schema)
            return empty.select("vec_id", F.lit(0).cast("long").alias("n"), "deviation", F.array().cast("array<double>").alias("explained"), "whitened", F.lit(0.0).alias("identity_error"))
        read, n, sums = self._reader(lengths["d"]), found["n"], found["sums"]
        low = np.array([s // n for s in sums], dtype=np.int64)
        left = np.array([s - n * (s // n) for s in sums], dtype=np.int64)
        turn = (found["basis"] / np.sqrt(np.array(found["e"]))[:, None]).T if found["e"] else np.zeros((lengths["d"], 0))
        rest = sum(int(x) ** 2 for x in left)

        def white(x: np.ndarray) -> np.ndarray:
            return ((x - low).astype(float) - left / n) @ turn

        def deviation(x: np.ndarray) -> list[Decimal]:
            """sum (n * x - S)^2, with S = n * low + left: squares and products fit longs, their sum need not."""
            y = x - low
            top = float(np.abs(y).max(initial=0))
            if top * top * y.shape[1] >= 2.0**62 or top * float(n) * y.shape[1] >= 2.0**62:
                y = y.astype(object)
            return [Decimal(n * n * int(a) - 2 * n * int(b) + rest) for a, b in zip((y * y).sum(axis=1), (y * left).sum(axis=1), strict=True)]

        def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at, x = read(b)
                if len(at):
                    flat = pa.array(white(x).ravel(), pa.float64())
                    listed = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * turn.shape[1], pa.int32()), flat)
                    yield pa.RecordBatch.from_arrays([b.column("vec_id").take(pa.array(at)), pa.array(deviation(x), pa.decimal128(38, 0)), listed], names=["vec_id", "deviation", "whitened"])

        error = 0.0
        if found["e"]:
            checked = summarised(rows, lambda batches: (white(x) for b in batches if len(x := read(b)[1])), float)
            error = checked.mapInPandas(_from_identity, "error double").first()[0]
            release(checked)
        explained = F.array(*[F.lit(e / found["trace"]) for e in found["e"]]).cast("array<double>")
        return rows.mapInArrow(out, schema).select("vec_id", F.lit(n).cast("long").alias("n"), "deviation", explained.alias("explained"), "whitened", F.lit(error).alias("identity_error"))


def _from_identity(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for r in pdf.itertuples():
            n, _, sigma, basis = _summary(r, float)
            m = sigma[:, None] * basis
            yield pd.DataFrame({"error": [float(np.abs(m.T @ m / n - np.eye(m.shape[1])).max())]})


def long_form(whitened: DataFrame) -> DataFrame:
    """A row per vector and component, numbered from 1."""
    each = whitened.select("*", F.posexplode("whitened").alias("at", "x"))
    return each.select(
        "vec_id", (F.col("at") + 1).alias("component"), "n", F.col("deviation").cast("long").alias("deviation"), F.col("x").alias("whitened"), F.element_at("explained", F.col("at") + 1).alias("explained"), "identity_error"
    )
