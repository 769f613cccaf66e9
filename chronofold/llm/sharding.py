"""Shards of shuffled documents: a scatter into buckets that fit in memory, then a shuffle of each bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, release, shuffle_parts

#: Bytes of text of a bucket, whose rows one task holds at a time.
BUCKET_BYTES = 16 << 20
SHARDS, SEED = 24, 20_011


def place() -> Column:
    """A number for each row of a table read straight from files: the same in every scan, whatever the splits."""
    return F.xxhash64("_metadata.file_name", "_metadata.row_index")


class ExternalShuffle:
    """write(docs, path): all documents in random order, cut into shards of which counts are at most one apart.

    First pass: a seeded hash of each row's ticket deals the rows evenly into buckets of about
    bucket_bytes of text. Second pass: a task gathers a bucket, shuffles it (Spark's `shuffle` is a
    seeded Fisher-Yates) and writes it. Buckets follow each other in the order of all rows,
    so a count of tickets per bucket tells where each begins, and a shard is a run of that order.
    Texts move once. Tickets belong to rows, not to ids or texts, so copies and a hot
    source are spread like anything else, and a bucket's size follows the law of large numbers.

    ticket: a column that every scan gives the same value for a row, as place() does for files.
    Without one, the rows are numbered in a table of their own first. The same seed, tickets and
    number of partitions give the same order.

    The shards are Parquet: folders shard=0 to shard=N-1, with slot (gapless from 0) and document
    (all columns of docs as one struct, so that no name clashes). Null ids and texts, repeated rows
    and ties are rows like others; an empty table writes no rows. With fewer rows than shards, some stay empty.
    """

    def __init__(self, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, text_col: str = "text"):
        self.shards, self.seed, self.bucket_bytes, self.text_col = shards, seed, bucket_bytes, text_col

    def write(self, docs: DataFrame, path: str, ticket: Column | None = None) -> None:
        spark = docs.sparkSession
        whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document")
        own = None if ticket is not None else materialize(docs.select(whole, F.monotonically_increasing_id().alias("ticket")))
        rows = docs.select(whole, ticket.alias("ticket")) if own is None else own
        total, size = rows.agg(F.count("*"), F.sum(F.octet_length(F.col(f"document.`{self.text_col}`")))).first()
        # At least a bucket per task, so that small tables use all of them too.
        buckets = max(-(-(size or 0) // self.bucket_bytes), min(shuffle_parts(spark), total), 1)
        rows = rows.withColumn("bucket", F.pmod(F.xxhash64(F.lit(self.seed), "ticket"), F.lit(buckets)).cast("int"))
        # A row of 16 bytes per bucket.
        before = F.coalesce(F.sum("count").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        starts = materialize(rows.groupBy("bucket").count().select("bucket", before.alias("start")))
        scattered = rows.repartition(buckets, "bucket").sortWithinPartitions("bucket", "ticket")
        gathered = scattered.groupBy("bucket").agg(F.collect_list("document").alias("documents"))
        shuffled = gathered.select("bucket", F.shuffle("documents", self.seed).alias("documents")).join(starts, "bucket")
        placed = shuffled.select("start", F.posexplode("documents").alias("at", "document")).select((F.col("start") + F.col("at")).alias("at"), "document")
        shard = F.expr(f"CAST(at * {self.shards} div {max(total, 1)} AS INT)")
        slot = F.expr(f"at - (CAST(shard AS LONG) * {total} + {self.shards - 1}) div {self.shards}")
        out = placed.withColumn("shard", shard).select("shard", slot.alias("slot"), "document")
        out.sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)
        release(starts)
        release(own)

    def read(self, spark: SparkSession, path: str, schema: str) -> DataFrame:
        """(shard, slot, document) of a folder of shards; schema is that of the documents (simpleString)."""
        return spark.read.schema(f"slot long, document {schema}, shard int").parquet(path).select("shard", "slot", "document")

    def digests(self, docs: DataFrame, path: str, ticket: Column | None = None) -> DataFrame:
        """What the shards hold, read back from them, without the texts."""
        self.write(docs, path, ticket)
        text = F.coalesce(F.col(f"document.`{self.text_col}`").cast("string"), F.lit(""))
        return self.read(docs.sparkSession, path, docs.schema.simpleString()).select(
            F.col("document.doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"),
            "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
        )
