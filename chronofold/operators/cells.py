"""A stored index of vectors in cells, searched exactly in order of what a cell can offer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..session import materialize, release
from . import metric

#: Vectors that a cell has at least, on average, and rows of a block of vectors and of queries.
CELL, BLOCK, QUERIES = 64, 2048, 64


class Cells:
    """Names, middles, radii and numbers of rows of cells: what tasks need to know of an index."""

    def __init__(self, rows: list):
        found = sorted(rows, key=lambda r: r["cell"])
        self.names = np.array([r["cell"] for r in found], dtype=np.int32)
        self.counts = np.array([r["n"] for r in found], dtype=np.int64)
        self.radius = np.array([r["radius"] for r in found], dtype=float)
        self.middles = np.array([r["middle"] for r in found], dtype=float).reshape(len(found), len(found[0]["middle"]) if found else 0)

    def offers(self, queries: np.ndarray) -> np.ndarray:
        """The best score that each cell can have for each query; a score of vectors without length is 0."""
        near = np.maximum(metric.angles(queries, self.middles) - self.radius - metric.SLACK, 0.0)
        return np.maximum(np.cos(np.minimum(near, np.pi)), 0.0)

    def first(self, offers: np.ndarray, k: int) -> np.ndarray:
        """Which cells each query looks at first: the most promising ones that hold k rows together."""
        best = np.argsort(-offers, axis=1, kind="stable")
        before = np.cumsum(self.counts[best], axis=1) - self.counts[best]
        out = np.zeros(offers.shape, dtype=bool)
        np.put_along_axis(out, best, before < k, axis=1)
        return out


class CellIndex:
    """Folder with rows (id, ord, angle, embedding, by cell) and cells (their middle, radius and number of rows).

    A cell's scores are at most the cosine of the angle to its middle less its radius, so cells that
    cannot reach the k-th best score found so far are never read. The result is exact, whatever
    the middles are: they are chosen from a bounded sample and only decide how much is read.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.rows = spark.read.schema("id string, ord long, angle double, embedding array<double>, cell int").parquet(f"{path}/rows")
        self.cells = Cells(spark.read.parquet(f"{path}/cells").collect())  # at most metric.PIVOTS rows

    @classmethod
    def build(cls, vectors: DataFrame, path: str, id_col: str = "id", order: str = "ord") -> CellIndex:
        """Write the index of all vectors that are not null; ids are kept as strings."""
        spark = vectors.sparkSession
        seen = metric.sample(vectors, order)
        middles = metric.chosen(seen, min(metric.PIVOTS, max(1, vectors.count() // CELL))) if len(seen) else np.zeros((1, 1))
        homes = metric.in_cells(vectors, middles, id_col, order)
        values = vectors.select(F.col(order).cast("long").alias("ord"), F.col("embedding").cast("array<double>").alias("embedding"))
        homes = homes.drop("data").join(values, "ord")
        homes.repartitionByRange("cell", "angle").sortWithinPartitions("cell", "angle").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
        rows = spark.read.schema("id string, angle double, cell int").parquet(f"{path}/rows")
        known = spark.createDataFrame([(k, [float(x) for x in m]) for k, m in enumerate(middles)], "cell int, middle array<double>")
        rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).join(known, "cell").coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")
        return cls(spark, path)

    def cells_for(self, query: list[float], k: int) -> list[int]:
        """Cells that a search reads: those looked at first, and all others that can match the k-th score there."""
        if not len(self.cells.names):
            return []
        offers = self.cells.offers(np.array([query], dtype=float))
        mine = self.cells.names[self.cells.first(offers, k)[0]].tolist()
        q = F.array(*[F.lit(float(x)) for x in query])
        found = self.rows.where(F.col("cell").isin(mine)).select(X.cosine(F.col("embedding"), q).alias("s")).orderBy(F.desc("s")).limit(k).collect()
        floor = found[-1]["s"] if len(found) == k else -np.inf
        return sorted({*mine, *self.cells.names[offers[0] >= floor - metric.SLACK].tolist()})

    def search(self, query: list[float], k: int) -> DataFrame:
        """(id, ord, angle, embedding, cell, score): the k best rows by cosine, ties in order; k must be 1 or more."""
        if k < 1:
            raise ValueError("k must be 1 or more")
        q = F.array(*[F.lit(float(x)) for x in query])
        some = self.rows.where(F.col("cell").isin(self.cells_for(query, k)))
        return some.withColumn("score", X.cosine(F.col("embedding"), q)).orderBy(F.desc("score"), F.asc("ord")).limit(k)

    def batch(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, id, ord, score, rank): the k best rows for each row of queries (query_id, q), ties in order.

        Rows are packed once, by cell. Queries go to the cells they look at first, which gives each a floor, then
        to those that can still match it. A task scores a block of queries against a block of
        rows and keeps, per query, what may be among the k best; these few are scored again as a search does.
        """
        if k < 1:
            raise ValueError("k must be 1 or more")
        cells = self.cells

        def visits(late: bool):
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    if b.num_rows and len(cells.names):
                        offers = cells.offers(metric.matrix(b.column("q")))
                        go = cells.first(offers, k)
                        if late:
                            floors = np.asarray(b.column("floor").fill_null(-np.inf))[:, None]
                            go = ~go & (offers >= floors - metric.SLACK)
                        row, cell = np.nonzero(go)
                        took = b.take(pa.array(row))
                        yield pa.RecordBatch.from_arrays([took.column("query_id"), took.column("q"), pa.array(cells.names[cell])], names=["query_id", "q", "cell"])

            return run

        rows = self.rows.select("id", "ord", "cell", F.lit(False).alias("guest"), "angle", "embedding")
        blocks = materialize(self._packed(rows))
        kind = queries.schema["query_id"].dataType.simpleString()
        asked = materialize(queries.where("q IS NOT NULL").select("query_id", F.col("q").cast("array<double>").alias("q")))
        score = lambda late, of: self._scored(blocks, of.mapInArrow(visits(late), f"query_id {kind}, q array<double>, cell int"), k, kind)
        early = materialize(score(False, asked))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("near")))
        floors = early.select("query_id", "near", rank.alias("r")).where(F.col("r") == k).select("query_id", F.col("near").alias("floor"))
        late = score(True, asked.join(floors, "query_id", "left"))
        every = early.unionByName(late).join(asked, "query_id").withColumn("score", X.cosine(F.col("embedding"), F.col("q")))
        best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("ord")))
        out = materialize(every.select("query_id", "id", "ord", "score", best.alias("rank")).where(F.col("rank") <= k))
        for table in (blocks, asked, early):
            release(table)
        return out

    def _packed(self, rows: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                data = pa.array([r.tobytes() for r in metric.matrix(b.column("embedding"))] if b.num_rows else [], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(c) for c in ("id", "ord", "cell", "guest", "angle")] + [data], names=["id", "ord", "cell", "guest", "angle", "data"])

        return metric.packed(rows.mapInArrow(run, "id string, ord long, cell int, guest boolean, angle double, data binary"), BLOCK)

    def _scored(self, blocks: DataFrame, visits: DataFrame, k: int, kind: str) -> DataFrame:
        """(query_id, id, ord, embedding, near) of rows that may be among the k best of their block."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for r in pdf.itertuples():
                    m = np.frombuffer(r.data, dtype="<f8").reshape(len(r.ids), -1)
                    q = np.stack([np.asarray(x["q"], dtype=float) for x in r.qs])
                    s = metric.units(q) @ metric.units(m).T
                    least = np.sort(s, axis=1)[:, -k][:, None] if s.shape[1] > k else -np.inf
                    i, j = np.nonzero(s >= least - metric.SLACK)
                    yield pd.DataFrame({"query_id": [r.qs[x]["query_id"] for x in i], "id": [r.ids[x] for x in j], "ord": [r.ords[x] for x in j], "embedding": list(m[j]), "near": s[i, j]})

        # Queries of a cell are dealt into groups of about QUERIES by hash, as many as the cell has of them.
        crowd = visits.groupBy("cell").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("groups"))
        dealt = visits.join(crowd, "cell").withColumn("g", F.pmod(F.xxhash64("query_id"), F.col("groups")))
        groups = dealt.groupBy("cell", "g").agg(F.collect_list(F.struct("query_id", "q")).alias("qs"))
        met = blocks.select("cell", "ids", "ords", "data").join(groups, "cell").select("ids", "ords", "data", "qs")
        return met.mapInPandas(run, f"query_id {kind}, id string, ord long, embedding array<double>, near double")
