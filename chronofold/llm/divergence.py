"""Divergence of sources: joint histograms of term counts, one evaluation per distinct combination."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, release

#: What parts terms: ASCII but its letters. Only A to Z are lower-cased.
NO_TERM = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SCALE = 1_000_000_000


def share(n: str, total: str, terms: str) -> Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 * terms)); decimals keep it exact whatever the counts."""
    big = lambda x: f"CAST({x} AS DECIMAL(20, 0))"
    return F.expr(f"1 + (CAST({SCALE} AS DECIMAL(10, 0)) * ({big(n)} + 2)) div ({big(total)} + 2 * {big(terms)})")


def apart(p: str, q: str) -> Column:
    """floor((p - q)^2 / (p + q)); shares are at most SCALE + 1, so the square fits a long."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


class SourceDivergence:
    """transform(docs): (lang, source, part, item, value, rank).

    Part `pair` holds the divergence of a source from every other one of its language, part `term`
    the `top` terms that a source uses more than its language does.

    Terms are counted once: a document's distinct terms go before its terms, and (lang, source,
    term) sums to documents and occurrences before anything moves. A
    term's counts in all sources meet in one short array, at most as long as its language has
    sources. From these arrays, every two sources' combinations (count, count) are tallied.
    Combinations with a zero are not visited: they are a source's own histogram less what the
    tallies hold, and what is left of the vocabulary is (0, 0). f is taken once per combination,
    times its multiplicity. The result itself has a row for each ordered pair of a language's sources.

    Null text, lang and source count as ''. Repeated rows and ids are documents of their own, a
    group without terms has its pairs (with value 0 where the language keeps no term), ties are in
    order of UTF-8. An empty table has no groups. Other columns are not read.
    """

    def __init__(self, least: int = 10, top: int = 10):
        self.least, self.top = least, top

    def vocabulary(self, docs: DataFrame) -> DataFrame:
        """(lang, term, total, profile) of the kept terms; profile is [(source, n)] by source."""
        lower = F.translate("text", UPPER, LOWER)
        words = docs.select("lang", "source", F.split(lower, NO_TERM).alias("w")).withColumn("u", F.array_distinct("w"))
        # The distinct terms come before all occurrences, so that a place tells which of the two a term counts for.
        terms = words.select("lang", "source", F.size("u").alias("k"), F.posexplode(F.concat("u", "w")).alias("i", "term")).where("term <> ''")
        counts = terms.groupBy("lang", "source", "term").agg(F.count_if(F.col("i") >= F.col("k")).alias("n"), F.count_if(F.col("i") < F.col("k")).alias("docs"))
        kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("profile"))
        return kept.where(F.col("docs") >= self.least).drop("docs")

    def groups(self, docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
        """(lang, source, n, terms, all_n): a group's and its language's sums of counts, and the number of kept terms."""
        langs = vocabulary.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("all_n"))
        own = vocabulary.select("lang", F.explode("profile").alias("x")).groupBy("lang", F.col("x.source").alias("source")).agg(F.sum("x.n").alias("n"))
        some = docs.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(langs, "lang", "left")
        return some.select("lang", "source", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n", "terms", "all_n")])

    def tallies(self, vocabulary: DataFrame, groups: DataFrame) -> DataFrame:
        """(lang, a, b, na, nb, m): how many kept terms have na occurrences in a and nb in b, for sources a < b."""
        zero = F.lit(0).cast("long")
        cell = lambda na, nb, m: F.struct(na.alias("na"), nb.alias("nb"), m.alias("m"))
        first = vocabulary.select("lang", "profile", F.posexplode("profile").alias("i", "x"))
        both = first.select("lang", "x", F.explode(F.slice("profile", F.col("i") + 2, F.size("profile"))).alias("y"))
        met = both.groupBy("lang", F.col("x.source").alias("a"), F.col("y.source").alias("b"), F.col("x.n").alias("na"), F.col("y.n").alias("nb")).agg(F.count("*").alias("m"))
        na, nb, m = F.col("na"), F.col("nb"), F.col("m")
        met = met.select("lang", "a", "b", F.explode(F.array(cell(na, nb, m), cell(na, zero, -m), cell(zero, nb, -m), cell(zero, zero, m))).alias("c"))
        own = vocabulary.select("lang", F.explode("profile").alias("x")).groupBy("lang", F.col("x.source").alias("source"), F.col("x.n").alias("k")).agg(F.count("*").alias("m"))
        side = lambda n: groups.where("terms > 0").select("lang", F.col("source").alias(n), "terms")
        pairs = side("a").join(side("b").drop("terms"), "lang").where("a < b")
        k = F.col("k")
        left = pairs.join(own.withColumnRenamed("source", "a"), ["lang", "a"]).select("lang", "a", "b", F.explode(F.array(cell(k, zero, m), cell(zero, zero, -m))).alias("c"))
        right = pairs.join(own.withColumnRenamed("source", "b"), ["lang", "b"]).select("lang", "a", "b", F.explode(F.array(cell(zero, k, m), cell(zero, zero, -m))).alias("c"))
        every = pairs.select("lang", "a", "b", cell(zero, zero, F.col("terms")).alias("c"))
        cells = met.unionByName(left).unionByName(right).unionByName(every)
        return cells.groupBy("lang", "a", "b", F.col("c.na").alias("na"), F.col("c.nb").alias("nb")).agg(F.sum("c.m").alias("m")).where("m > 0")

    def pairs(self, tallies: DataFrame, groups: DataFrame) -> DataFrame:
        """(lang, source, item, value) of all ordered pairs; f is symmetric, so each is worked out once."""
        side = lambda n: groups.select("lang", F.col("source").alias(n), F.col("n").alias(f"all_{n}"), "terms")
        known = tallies.join(side("a"), ["lang", "a"]).join(side("b").drop("terms"), ["lang", "b"])
        known = known.withColumns({"p": share("na", "all_a", "terms"), "q": share("nb", "all_b", "terms")})
        value = known.groupBy("lang", "a", "b").agg(F.sum(F.col("m") * apart("p", "q")).alias("value"))
        both = side("a").join(side("b").drop("terms"), "lang").where("a < b").select("lang", "a", "b").join(value, ["lang", "a", "b"], "left")
        found = both.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x"), F.coalesce("value", F.lit(0).cast("long")).alias("value"))
        return found.select("lang", "x.source", "x.item", "value")

    def terms(self, vocabulary: DataFrame, groups: DataFrame) -> DataFrame:
        """(lang, source, item, value) of the terms that a group uses more than its language."""
        cells = vocabulary.select("lang", F.col("term").alias("item"), "total", F.explode("profile").alias("x")).select("lang", "item", "total", "x.source", F.col("x.n").alias("c"))
        cells = cells.join(groups, ["lang", "source"]).withColumns({"p": share("c", "n", "terms"), "q": share("total", "all_n", "terms")})
        return cells.where("p > q").select("lang", "source", "item", apart("p", "q").alias("value"))

    def transform(self, docs: DataFrame) -> DataFrame:
        docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
        vocabulary = materialize(self.vocabulary(docs))
        groups = materialize(self.groups(docs, vocabulary))
        rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item")))
        ranked = lambda rows, part: rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", rank.alias("rank"))
        pairs = ranked(self.pairs(self.tallies(vocabulary, groups), groups), "pair")
        terms = ranked(self.terms(vocabulary, groups), "term").where(F.col("rank") <= self.top)
        out = materialize(pairs.unionByName(terms))
        release(vocabulary)
        release(groups)
        return out


def oracle(least: int = 10, top: int = 10) -> str:
    p = lambda n, total: f"1 + (CAST({SCALE} AS HUGEINT) * ({n} + 2)) // ({total} + 2 * v)"
    return f"""WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS t FROM documents),
x AS (SELECT id, lang, source, unnest(t) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT id) AS df FROM x GROUP BY lang, source, term),
k AS (SELECT lang, term, sum(n) AS total FROM c GROUP BY lang, term HAVING sum(df) >= {least}),
l AS (SELECT lang, count(*) AS v, sum(total) AS all_n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
f AS (SELECT g.lang, g.source, k.term, k.total, coalesce(c.n, 0) AS n, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS own_n
  FROM g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT f.*, {p("f.n", "f.own_n")} AS p, {p("f.total", "l.all_n")} AS q FROM f JOIN l ON l.lang = f.lang),
s AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, CAST(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS BIGINT) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
  UNION ALL SELECT x.lang, x.source, 'pair', y.source, 0 FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source WHERE x.lang NOT IN (SELECT lang FROM l)
  UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // (p + q) AS BIGINT) FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM s)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= {top}"""
