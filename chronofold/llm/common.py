"""Helpers shared by the training-data operators: session settings, partition counts, checked joins."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, release, scratch_path, ship

#: Rows of whole texts that travel to a Python worker at once; the largest text bounds the batch.
TEXT_BATCH_ROWS = 500
#: A table of ids is broadcast up to this many rows (8 bytes each); beyond it the join shuffles.
BROADCAST_IDS = 2_000_000

__all__ = ["BROADCAST_IDS", "materialize", "only_ids", "range_parts", "read", "release", "scratch_path", "shuffle_parts", "text_batches", "tidy"]


def give_back() -> None:
    """Return memory that a Python worker no longer uses to the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over batches, after which the worker is back at its own size: later stages share its executor."""

    def inner(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return inner


def text_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that carry whole texts."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_BATCH_ROWS))


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def range_parts(spark: SparkSession, rows: int, least: int = 1000, most: int = 200_000) -> int:
    """Partitions of a range sort: never so many that one is smaller than a window of rows."""
    return max(1, min(shuffle_parts(spark), rows // least), -(-rows // most))


def only_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of df whose key is in ids (distinct, one column of the same name).

    The id side is counted first: a small one is broadcast so that df does not move; a large one
    goes through a shuffled semi-join. Both give the same rows.
    """
    side = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return df.join(side, key, "left_semi")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
