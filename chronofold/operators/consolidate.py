"""Bands of similar pairs and the greedy merge."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import scalars as X
from ..session import materialize, release


def with_keeper(pairs: DataFrame, claims: DataFrame) -> DataFrame:
    """pairs with kept and loser, by hits, then later creation, then the first."""
    side = lambda n: claims.select(F.col("id").alias(n), F.col("hits").alias(f"{n}_hits"), F.col("created").alias(f"{n}_created"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    first = X.first_kept(F.col("a_hits"), F.col("a_created"), F.col("b_hits"), F.col("b_created"))
    return both.withColumn("kept", F.when(first, F.col("a")).otherwise(F.col("b"))).withColumn("loser", F.when(first, F.col("b")).otherwise(F.col("a")))


def greedy(pairs: DataFrame) -> DataFrame:
    """Merges (a, b, score, kept, loser) among pairs (a, b, a_ord, b_ord, score, kept, loser), as a walk in order of score, a_ord, b_ord makes them.

    The walk takes a pair if neither claim is retired by then, and retires the loser. So a claim's
    fate hangs on the pairs that it would lose only, and on its rivals' fates: its first pair that
    is left is taken if the one kept has no pair left to lose before that. Each round takes
    all such pairs at once and drops those that a retired claim was in later, or would still lose. A
    claim that keeps against any number of others merges with all of them in one round;
    the first pair of all is always taken, so rounds end. No task holds more than a row per claim.
    """
    order = F.struct((-F.col("score")).alias("s"), F.col("a_ord").alias("x"), F.col("b_ord").alias("y"))
    left = materialize(pairs.select("a", "b", "score", "kept", "loser", order.alias("at")))
    taken = []
    while not left.isEmpty():
        first = materialize(left.groupBy("loser").agg(F.min("at").alias("first")))
        rival = first.select(F.col("loser").alias("kept"), F.col("first").alias("risk"))
        won = left.join(first, "loser").where(F.col("at") == F.col("first")).drop("first").join(rival, "kept", "left")
        won = materialize(won.where(F.col("risk").isNull() | (F.col("risk") > F.col("at"))).select("a", "b", "score", "kept", "loser", "at"))
        taken.append(won)
        gone = won.select(F.col("loser").alias("kept"), F.col("at").alias("end"))
        fewer = left.join(won.select("loser"), "loser", "left_anti").join(gone, "kept", "left")
        fewer = materialize(fewer.where(F.col("end").isNull() | (F.col("at") < F.col("end"))).select(*left.columns))
        release(left)
        release(first)
        left = fewer
    release(left)
    every = reduce(DataFrame.unionByName, taken) if taken else left.sparkSession.createDataFrame([], left.schema)
    return every.select("a", "b", "score", "kept", "loser")


def bands(pairs: DataFrame, merge: float = C.MERGE) -> tuple[DataFrame, DataFrame]:
    """Pairs to merge and pairs to review, by the rounded score."""
    return pairs.where(F.col("score") >= merge), pairs.where(F.col("score") < merge)
