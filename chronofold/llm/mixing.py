"""Mixing by iterative proportional fitting, in DataFrame functions only.

Token counts by (source, language, topic) are raked to target marginals; a document's probability
is its cell's raked weight per token, scaled so that the largest is one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, release

DIMS = ["source", "lang", "topic"]


def token_count(text: Column) -> Column:
    """Blank-separated tokens, as blanks plus one; none in a null or empty text."""
    return F.when(F.length(text) > 0, F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1).otherwise(0).cast("long")


def topic_of(text: Column) -> Column:
    """Coarse topic by the look of the text: symbols, tables, capitals or prose."""
    t = F.coalesce(text, F.lit(""))
    return F.when(t.rlike("[#$%&*]{3}"), "symbols").when(F.contains(t, F.lit(" | ")), "tables").when(t.rlike("[A-ZÀ-Þ]{4}"), "capitals").otherwise("prose")


def uniform(id_col: Column, text: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the id (the text, if it is null) and the seed only."""
    name = F.coalesce(id_col.cast("string"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), name).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)


class Raking:
    """Targets: the corpus's own shares to the power `temper`, per dimension, unless `targets` gives
    a table (value, share) for it. rounds: sweeps over the three dimensions."""

    def __init__(self, temper: float = 0.7, rounds: int = 8, seed: int = 11, targets: dict[str, DataFrame] | None = None):
        self.temper, self.rounds, self.seed, self.targets = temper, rounds, seed, targets or {}

    def cells(self, docs: DataFrame) -> DataFrame:
        """(source, lang, topic, tokens, factor) of every cell that holds tokens."""
        start = materialize(docs.groupBy(*DIMS).agg(F.sum("tokens").alias("tokens")).where("tokens > 0").withColumn("w", F.col("tokens").cast("double")))
        for dim in DIMS:
            if dim in self.targets:
                given = self.targets[dim].select(F.col("value").alias(dim), F.col("share").cast("double").alias(f"t_{dim}"))
                start = start.join(given, dim)
            else:
                powers = start.groupBy(dim).agg(F.pow(F.sum("w"), F.lit(self.temper)).alias("p"))
                whole = materialize(powers)
                total = whole.agg(F.sum("p")).first()[0] or 1.0
                start = start.join(whole.select(F.col(dim).alias("x"), (F.col("p") / total).alias(f"t_{dim}")), F.col(dim) == F.col("x")).drop("x")
        cells = materialize(start)
        total = cells.agg(F.sum("tokens")).first()[0] or 0
        for k in range(self.rounds):
            step = cells
            for dim in DIMS:
                step = step.withColumn("w", F.col("w") * F.col(f"t_{dim}") * float(total) / F.sum("w").over(Window.partitionBy(dim)))
            step = materialize(step) if k % 2 or k == self.rounds - 1 else step
            if k % 2 or k == self.rounds - 1:
                release(cells)
            cells = step
        return cells.withColumn("factor", F.col("w") / F.col("tokens"))

    def transform(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """docs with tokens, topic, factor, probability and sampled.

        docs needs source and lang; a null in either counts as the value `unknown`. A topic column
        of docs is used if there is one. Documents without tokens weigh nothing: factor 0, not
        sampled, as are documents of a value for which given targets have no row. Rows that
        repeat an id share their draw. An empty table gives an empty result. Existing columns of
        the added names, but for topic, are replaced.
        """
        topic = F.coalesce(F.col("topic").cast("string"), F.lit("unknown")) if "topic" in docs.columns else topic_of(F.col(f"`{text_col}`"))
        rows = docs.withColumn("__tokens", token_count(F.col(f"`{text_col}`"))).withColumn("topic", topic)
        dims = [F.coalesce(F.col(d).cast("string"), F.lit("unknown")).alias(d) for d in ("source", "lang")]
        cells = self.cells(rows.select(*dims, "topic", F.col("__tokens").alias("tokens")))
        factors = materialize(cells.select(*[F.col(d).alias(f"__{d}") for d in DIMS], F.col("factor").alias("__factor")))
        top = factors.agg(F.max("__factor")).first()[0] or 1.0
        same = [F.coalesce(F.col(d).cast("string"), F.lit("unknown")) == F.col(f"__{d}") for d in DIMS]
        # The cells are grouped counts; Spark broadcasts them where they are small and shuffles else.
        out = rows.join(factors, same, "left").drop(*[f"__{d}" for d in DIMS])
        factor = F.when(F.col("__tokens") > 0, F.coalesce("__factor", F.lit(0.0))).otherwise(0.0)
        out = out.withColumns({"tokens": F.col("__tokens"), "factor": factor}).drop("__factor", "__tokens").withColumn("probability", F.col("factor") / float(top))
        return out.withColumn("sampled", uniform(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), self.seed) < F.col("probability"))


def oracle(temper: float, rounds: int, seed: int) -> str:
    """The same rows in DuckDB's SQL for documents, with the sweeps written out."""
    steps = [
        """d AS (SELECT doc_id, coalesce(source, 'unknown') AS source, coalesce(lang, 'unknown') AS lang,
  CASE WHEN regexp_matches(coalesce(text, ''), '[#$%&*]{3}') THEN 'symbols' WHEN contains(coalesce(text, ''), ' | ') THEN 'tables'
    WHEN regexp_matches(coalesce(text, ''), '[A-ZÀ-Þ]{4}') THEN 'capitals' ELSE 'prose' END AS topic,
  CASE WHEN length(text) > 0 THEN length(text) - length(replace(text, ' ', '')) + 1 ELSE 0 END AS tokens,
  coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, ''))) AS name FROM documents)""",
        "c AS (SELECT source, lang, topic, CAST(sum(tokens) AS DOUBLE) AS tokens FROM d GROUP BY ALL HAVING sum(tokens) > 0)",
    ]
    for x in DIMS:
        steps.append(f"p_{x} AS (SELECT {x}, pow(sum(tokens), {temper}) AS p FROM c GROUP BY {x})")
        steps.append(f"t_{x} AS (SELECT {x}, p / (SELECT sum(p) FROM p_{x}) AS t FROM p_{x})")
    steps.append("w0 AS (SELECT *, tokens AS w FROM c)")
    k = 0
    for _ in range(rounds):
        for x in DIMS:
            steps.append(f"w{k + 1} AS MATERIALIZED (SELECT a.source, a.lang, a.topic, a.tokens, a.w * t.t * (SELECT sum(tokens) FROM c) / sum(a.w) OVER (PARTITION BY a.{x}) AS w FROM w{k} a JOIN t_{x} t USING ({x}))")
            k += 1
    steps.append(f"f AS (SELECT source, lang, topic, w / tokens AS factor, max(w / tokens) OVER () AS top FROM w{k})")
    return "WITH " + ",\n".join(steps) + f"""
SELECT doc_id, source, lang, topic, CAST(tokens AS BIGINT) AS tokens, round(CASE WHEN tokens > 0 THEN coalesce(factor, 0) ELSE 0 END, 6) AS factor,
  round(CASE WHEN tokens > 0 THEN coalesce(factor / top, 0) ELSE 0 END, 6) AS probability,
  CAST(CAST(concat('0x', substring(md5(concat('{seed}:', name)), 1, 8)) AS BIGINT) AS DOUBLE) / 4294967296.0 < CASE WHEN tokens > 0 THEN coalesce(factor / top, 0) ELSE 0 END AS sampled
FROM d LEFT JOIN f USING (source, lang, topic)"""
