"""Search by shared character bigrams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as X


def _asked(spark: SparkSession, text: str) -> list[str]:
    return spark.range(1).select(X.bigrams(F.lit(text))).first()[0]


def deep_search(log: DataFrame, text: str, k: int, order: list[str]) -> DataFrame:
    """The k entries whose bigrams overlap most with the query's, by a scan of the log; no overlap is no hit."""
    if k < 1:
        raise ValueError("k must be 1 or more")
    asked = _asked(log.sparkSession, text)
    scored = log.withColumn("grams", X.bigrams(F.col("text"))).withColumn("overlap", X.jaccard(F.col("grams"), F.array(*[F.lit(x) for x in asked]))).drop("grams")
    scored = scored.where("overlap > 0").withColumn("score", F.round("overlap", 4)).drop("overlap")
    return scored.orderBy(F.desc("score"), *order).limit(k)


class BigramIndex:
    """A stored table of postings (gram, n, keys): n is the number of bigrams of an entry, keys are the columns that name it.

    Postings are sorted by gram, so that a search reads the parts of the files that hold its own
    bigrams and no text. append() adds files; entries of a log that only grows are added as they come.
    Several folders, each with entries of its own, make one index.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], *more: str):
        self.spark, self.path, self.keys, self.paths = spark, path, keys, [path, *more]

    @classmethod
    def build(cls, log: DataFrame, path: str, keys: list[str]) -> BigramIndex:
        made = cls(log.sparkSession, path, keys)
        made.append(log, "overwrite")
        return made

    def append(self, log: DataFrame, mode: str = "append") -> None:
        """Add entries (keys, text); repeated keys are entries of their own only if the keys say so."""
        grams = log.select(*self.keys, X.bigrams(F.col("text")).alias("grams"))
        rows = grams.select(F.explode("grams").alias("gram"), F.size("grams").alias("n"), *self.keys)
        rows.repartitionByRange("gram", "n").sortWithinPartitions("gram", "n").write.mode(mode).parquet(self.path)

    def postings(self, grams: list[str], least: float = 0.0, asked: int = 0) -> DataFrame:
        """Postings of these bigrams, of entries whose size alone allows a score of `least` with so many asked."""
        some = self.spark.read.parquet(*self.paths).where(F.col("gram").isin(grams))
        return some.where((F.col("n") >= least * asked) & (F.col("n") * least <= asked)) if least > 0 else some

    def _scored(self, found: DataFrame, asked: int) -> DataFrame:
        shared = F.count("*")
        return found.groupBy(*self.keys).agg((shared / (asked + F.first("n") - shared + F.lit(1e-12))).alias("overlap"))

    def rare(self, grams: list[str]) -> list[str]:
        """The bigrams by how many entries hold them, the rarest first; those that none holds come before all."""
        counts = {r["gram"]: r["count"] for r in self.postings(grams).groupBy("gram").count().collect()}
        return sorted(grams, key=lambda g: (counts.get(g, 0), g))

    def search(self, text: str, k: int) -> DataFrame:
        """(keys, score): the k entries that overlap most, ties in order of the keys.

        Entries with the rarer half of the bigrams are scored first. The k-th score s bounds the
        rest: an entry of at least that score holds s of the bigrams asked, so it holds one
        of the (1 - s) share that is rarest, and its size lies within a factor s of the query's. Only
        entries named by that share are scored, from postings within these sizes.
        """
        if k < 1:
            raise ValueError("k must be 1 or more")
        grams = self.rare(_asked(self.spark, text))
        size = len(grams)
        half = grams[: -(-size // 2)]
        first = self._candidates(half, grams, 0.0).orderBy(F.desc("overlap")).limit(k).collect()
        # Ties in four places are told apart by the keys, so a score that rounds alike stays in.
        least = max(0.0, first[-1]["overlap"] - 1e-4) if len(first) == k else 0.0
        prefix = grams[: min(size, size - int(-(-least * size // 1)) + 1)] if least > 0 else grams
        found = self._candidates(prefix, grams, least).where("overlap > 0").withColumn("score", F.round("overlap", 4))
        return found.orderBy(F.desc("score"), *self.keys).select(*self.keys, "score").limit(k)

    def _candidates(self, prefix: list[str], grams: list[str], least: float) -> DataFrame:
        """Scores of the entries that hold one of the prefix's bigrams."""
        every = self.postings(grams, least, len(grams))
        if len(prefix) < len(grams):
            named = self.postings(prefix, least, len(grams)).select(*[F.col(c).alias(f"__{c}") for c in self.keys]).distinct()
            same: Column = F.lit(True)
            for c in self.keys:
                same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
            every = every.join(named, same, "left_semi")
        return self._scored(every, len(grams))
