"""Operators on the claim view: filters, clusters, decay, reinforcement, packing, profile, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import scalars as X


def active(claims: DataFrame) -> DataFrame:
    return claims.where("status = 'active'")


def query(claims: DataFrame, entity: str | None = None, kind: str | None = None, status: str = "active", min_confidence: float | None = None) -> DataFrame:
    """Equality filters, in order of birth. An empty or null filter, or status `all`, lets everything pass."""
    out = claims
    if status and status != "all":
        out = out.where(F.col("status") == status)
    if entity:
        out = out.where(F.col("entity") == entity)
    if kind:
        out = out.where(F.col("kind") == kind)
    if min_confidence is not None:
        out = out.where(X.confidence_rank(F.col("confidence")) >= min_confidence)
    return out.orderBy("birth_seq")


def show(claims: DataFrame, claim_id: str) -> DataFrame:
    return claims.where(F.col("id") == claim_id)


def by_key(claims: DataFrame, key: str | None) -> DataFrame:
    """Active claims that a new claim with this key supersedes; no key, none."""
    return active(claims).where(F.col("key") == key if key else F.lit(False))


def episodic_range(log: DataFrame, since: str | None = None, until: str | None = None, topic: str | None = None, entity: str | None = None) -> DataFrame:
    """Entries of whole days, both ends included. Months outside the range are not read."""
    day, out = F.substring("ts", 1, 10), log
    if since:
        out = out.where((day >= since) & (F.col("month") >= since[:7]))
    if until:
        out = out.where((day <= until) & (F.col("month") <= until[:7]))
    if topic:
        out = out.where(F.col("topic") == topic)
    if entity:
        out = out.where(F.col("entity") == entity)
    return out.orderBy("month", "ord")


def clusters(claims: DataFrame, least: int = C.CLUSTER_MIN) -> DataFrame:
    """(entity, count, first_seq, birth_seq, id, text): active claims of entities with at least `least` of them, a row each.

    Sizes are counted and joined to the claims, so no entity's claims gather in one row. Entities come by their first claim.
    """
    some = active(claims).where("entity <> ''").select("entity", "birth_seq", "id", "text")
    sizes = some.groupBy("entity").agg(F.count("*").alias("count"), F.min("birth_seq").alias("first_seq")).where(F.col("count") >= least)
    return sizes.join(some, "entity").select("entity", "count", "first_seq", "birth_seq", "id", "text").orderBy("first_seq", "birth_seq")


def with_retention(claims: DataFrame, now: Column) -> DataFrame:
    out = claims.withColumn("days_idle", X.days_idle(F.col("last_accessed"), F.col("created"), now))
    return out.withColumn("retention", X.retention(F.col("days_idle"), F.col("hits")))


def forget_candidates(claims: DataFrame, now: Column) -> DataFrame:
    """Active claims of low confidence whose retention is under the floor, weakest first by three places, as shown."""
    low = with_retention(active(claims).where("confidence = 'low'"), now).where(F.col("retention") < C.RETENTION_FLOOR)
    return low.withColumn("retention", F.round("retention", 3)).orderBy("retention", "birth_seq")


def promotions(claims: DataFrame) -> DataFrame:
    """(id, hits, to): claims whose hits earn a higher confidence."""
    return claims.withColumn("to", X.promoted(F.col("confidence"), F.col("hits"))).where("to IS NOT NULL").select("id", "hits", "to")


def pack(items: DataFrame, budget: float, order: list[Column], partition: list[str] | None = None) -> DataFrame:
    """Items in order while their tokens fit the budget; the first always does. Adds rn and used.

    With `partition`, every group has its own budget and they run in parallel; without, the
    running sum is global, so items should be cut to a bounded number before.
    """
    window = Window.partitionBy(*(partition or [])).orderBy(*order)
    counted = items.withColumn("rn", F.row_number().over(window)).withColumn("used", F.sum(X.est_tokens(F.col("text"))).over(window.rowsBetween(Window.unboundedPreceding, 0)))
    return counted.where((F.col("rn") == 1) | (F.col("used") <= budget))


def profile_items(claims: DataFrame, budget: float = C.PROFILE_BUDGET) -> DataFrame:
    """Active claims by weight of confidence, hits and age, while they fit the budget.

    A claim has at least one character, bar the empty ones, so only the first 1.5 x budget + 1
    claims with text can be kept; the global order is cut there before the running sum.
    """
    order = [F.desc(X.confidence_weight(F.col("confidence"))), F.desc(F.coalesce("hits", F.lit(0))), F.asc("created"), F.asc("birth_seq")]
    texts = active(claims).where("text <> ''")
    items = texts.orderBy(*order).limit(int(budget * C.CHARS_PER_TOKEN) + 2)
    return pack(items, budget, order).select("rn", "id", "kind", "entity", "confidence", "hits", "text", "used")


def context_items(hits: DataFrame, budget: float = C.CONTEXT_BUDGET) -> DataFrame:
    """Recalled claims (score, rank, text) by rounded score, while they fit the budget."""
    return pack(hits, budget, [F.desc(F.round("score", 4)), F.asc("rank")])


def status(claims: DataFrame) -> DataFrame:
    """(total, active_claims, pressure) in one row."""
    return claims.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "active").alias("active_claims")).withColumn("pressure", F.round(F.col("active_claims") / F.lit(C.WARM_LIMIT), 4))
