"""Angles to pivots: cells of vectors, and what the triangle inequality lets a join or a search leave out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

#: Rows that pivots are chosen from and a choice is judged by, and the most pivots.
SAMPLE, PIVOTS = 2048, 256
#: Angles (radians) are trusted to this much, scores to its size too.
SLACK = 1e-6


def units(m: np.ndarray) -> np.ndarray:
    """Rows of length one; a zero row stays zero."""
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


def angles(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units(rows) @ pivots.T, -1.0, 1.0))


def matrix(col: pa.Array) -> np.ndarray:
    """A list column without nulls, all of one length, as doubles."""
    return np.asarray(col.flatten().cast(pa.float64()), dtype="<f8").reshape(len(col), -1)


def sample(vectors: DataFrame, order: str, most: int = SAMPLE) -> np.ndarray:
    """At most `most` vectors, the same ones each time, for choices that only cost time if they are bad."""
    rows = vectors.where("embedding IS NOT NULL").orderBy(F.xxhash64(order), order).limit(most).select(F.col("embedding").cast("array<double>")).collect()
    return np.array([r[0] for r in rows], dtype=float)


def chosen(rows: np.ndarray, count: int) -> np.ndarray:
    """count pivots: sampled rows, moved twice to the middle of those that are nearest."""
    pivots = units(rows[: max(1, min(count, len(rows)))])
    for _ in range(2):
        near = angles(rows, pivots).argmin(axis=1)
        sums = np.zeros_like(pivots)
        np.add.at(sums, near, units(rows))
        moved = units(sums)
        pivots = np.where(np.linalg.norm(moved, axis=1, keepdims=True) > 0, moved, pivots)
    return pivots


def join_pivots(rows: np.ndarray, reach: float, most: int = PIVOTS) -> np.ndarray:
    """Pivots for a join within an angle: as many as make for the least work on the sample.

    Work is the share of pairs that meet in a cell, and a little for each copy of a border row. Where angles
    tell nothing apart, one pivot is best and no row is copied.
    """
    best, least = chosen(rows, 1), np.inf
    count = 1
    while count <= min(most, max(1, len(rows) // 8)):
        pivots = chosen(rows, count)
        far = angles(rows, pivots)
        home = far.argmin(axis=1)
        radius = np.array([far[home == c, c].max(initial=0.0) for c in range(len(pivots))])
        guest = guests(far, home, radius, reach)
        at_home = np.bincount(home, minlength=len(pivots)).astype(float)
        work = (at_home * (at_home / 2 + guest.sum(axis=0))).sum() / len(rows) ** 2 + 0.002 * guest.sum() / len(rows)
        if work < least:
            best, least = pivots, work
        count *= 4
    return best


def guests(far: np.ndarray, home: np.ndarray, radius: np.ndarray, reach: float) -> np.ndarray:
    """Which rows visit which cells: those after their own that may hold a partner within reach.

    A partner lies in its own cell, so it is nearer to that pivot than to the row's, and no farther than the cell's radius.
    """
    own = far[np.arange(len(far)), home][:, None]
    near = (far <= own + 2 * reach + SLACK) & (far <= radius + reach + SLACK)
    return near & (np.arange(far.shape[1])[None, :] > home[:, None])


def in_cells(vectors: DataFrame, pivots: np.ndarray, id_col: str, order: str) -> DataFrame:
    """(id, ord, cell, angle, data): every vector with its nearest pivot; data are its doubles."""
    ship(vectors.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                m = matrix(b.column("v"))
                far = angles(m, pivots)
                cell = far.argmin(axis=1)
                data = pa.array([r.tobytes() for r in m], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("ord"), pa.array(cell, pa.int32()), pa.array(far[np.arange(len(m)), cell]), data], names=["id", "ord", "cell", "angle", "data"])

    rows = vectors.where("embedding IS NOT NULL").select(F.col(id_col).cast("string").alias("id"), F.col(order).cast("long").alias("ord"), F.col("embedding").alias("v"))
    return rows.mapInArrow(run, "id string, ord long, cell int, angle double, data binary")


def stacked(col) -> np.ndarray:
    data = [x.as_py() if isinstance(x, pa.Scalar) else x for x in col]
    return np.frombuffer(b"".join(data), dtype="<f8").reshape(len(data), -1)


def with_guests(homes: DataFrame, pivots: np.ndarray, radius: np.ndarray, reach: float) -> DataFrame:
    """(id, ord, cell, guest, angle, data): the rows at home, and once more in every cell that they visit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                far, home = angles(stacked(b.column("data")), pivots), np.asarray(b.column("cell"))
                row, cell = np.nonzero(guests(far, home, radius, reach))
                at = np.concatenate([np.arange(len(home)), row])
                cells = np.concatenate([home, cell]).astype(np.int32)
                took = b.take(pa.array(at))
                guest = pa.array(np.arange(len(at)) >= len(home))
                yield pa.RecordBatch.from_arrays([took.column("id"), took.column("ord"), pa.array(cells), guest, pa.array(far[at, cells]), took.column("data")], names=["id", "ord", "cell", "guest", "angle", "data"])

    return homes.mapInArrow(run, "id string, ord long, cell int, guest boolean, angle double, data binary")


def packed(rows: DataFrame, size: int) -> DataFrame:
    """(block, cell, guest, lo, hi, n, ids, ords, data): up to size rows of one cell and kind, of neighbouring angles.

    The rows are dealt out by ranges of (cell, guest, angle), so a crowded cell is many tasks' work.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, count = TaskContext.get().partitionId() << 32, 0
        held: list[tuple] = []

        def block() -> pa.RecordBatch:
            nonlocal count
            count += 1
            cell, guest, ids, ords, far, data = zip(*held, strict=True)
            out = [(first + count, cell[0], guest[0], min(far), max(far), len(ids), list(ids), list(ords), b"".join(data))]
            held.clear()
            return pa.RecordBatch.from_pylist([dict(zip(names, out[0], strict=True))], schema=kind)

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("cell", "guest", "id", "ord", "angle", "data")), strict=True):
                if held and (held[0][:2] != row[:2] or len(held) >= size):
                    yield block()
                held.append(row)
        if held:
            yield block()

    names = ["block", "cell", "guest", "lo", "hi", "n", "ids", "ords", "data"]
    kind = pa.schema(list(zip(names, [pa.int64(), pa.int32(), pa.bool_(), pa.float64(), pa.float64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary()], strict=True)))
    dealt = rows.repartitionByRange("cell", "guest", "angle").sortWithinPartitions("cell", "guest", "angle", "ord")
    return dealt.mapInArrow(run, "block long, cell int, guest boolean, lo double, hi double, n long, ids array<string>, ords array<long>, data binary")


def meetings(blocks: DataFrame, reach: float) -> DataFrame:
    """(block, other, compared): the blocks of a cell that have to be compared, without what they hold.

    Rows whose angles to the pivot differ by more than the reach are farther apart than that.
    """
    side = blocks.select("cell", "block", "guest", "lo", "hi", "n")
    other = side.where("NOT guest").select("cell", F.col("block").alias("other"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), F.col("n").alias("n2"))
    met = side.join(other, "cell").where(F.col("guest") | (F.col("block") <= F.col("other")))
    met = met.where((F.col("lo") <= F.col("hi2") + reach + SLACK) & (F.col("lo2") <= F.col("hi") + reach + SLACK))
    same = F.col("block") == F.col("other")
    return met.select("block", "other", F.when(same, (F.col("n") * (F.col("n") - 1) / 2).cast("long")).otherwise(F.col("n") * F.col("n2")).alias("compared"))
