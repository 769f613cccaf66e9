"""Document quality by hierarchical empirical Bayes.

Evidence of a document is the sum of log-likelihood ratios of its binned style features, learned
from labelled documents. Labels also give each host a posterior rate, shrunk toward the global
rate, and each path of a host one shrunk toward its host; how strongly follows from the spread
between sites. The path's rate is the prior of its documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, materialize

#: Feature: SQL expression of its bin, over t (text, null: empty), n (length), w (words), in both engines' syntax.
FEATURES = {
    "size": "CAST(least(14, floor(log2(greatest(n, 1)))) AS INT)",
    "upper": "CAST(floor(10 * (n - length(regexp_replace(t, '[A-ZÀ-Þ]', ''{g}))) / greatest(n, 1)) AS INT)",
    "symbols": "CAST(least(10, floor(50 * (n - length(regexp_replace(t, '[^A-Za-z0-9À-ÿ .,\\n]', ''{g}))) / greatest(n, 1))) AS INT)",
    "digits": "CAST(least(10, floor(50 * (n - length(regexp_replace(t, '[0-9]', ''{g}))) / greatest(n, 1))) AS INT)",
    "variety": "CAST(floor(10 * {distinct} / greatest({words}, 1)) AS INT) * 100 + CAST(least(9, floor(log2(greatest({words}, 1)))) AS INT)",
}


def _spark(expr: str) -> Column:
    return F.expr(expr.replace("\\n", "\\\\n").format(g="", words="size(w)", distinct="size(array_distinct(w))").replace("floor(", "floor(1D * ").replace("log2(", "log2(1D * "))


class SiteQuality:
    """smooth: added to every bin's counts; lowest and highest: limits of the prior's weight in documents."""

    def __init__(self, smooth: float = 1.0, lowest: float = 1.0, highest: float = 10000.0, cut: float = 0.5):
        self.smooth, self.lowest, self.highest, self.cut = smooth, lowest, highest, cut

    def features(self, docs: DataFrame, id_col: str, text_col: str, host: str, path: str) -> DataFrame:
        rows = docs.select(
            F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{host}`").cast("string"), F.lit("unknown")).alias("host"),
            F.coalesce(F.col(f"`{path}`").cast("string"), F.lit("unknown")).alias("path"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("t"),
        )
        rows = rows.withColumns({"n": F.length("t"), "w": F.split("t", " ")})
        return rows.select("doc_id", "host", "path", *[_spark(e).alias(f) for f, e in FEATURES.items()])

    def _weight(self, sites: DataFrame, mean: Column) -> float:
        """Documents that a site's prior counts for, by the method of moments over sites (n, good)."""
        got = sites.agg(
            F.sum("n").alias("n"), F.count("*").alias("sites"), F.sum(mean * (1 - mean)).alias("within"), F.sum(F.col("n") * F.pow(F.col("good") / F.col("n") - mean, 2)).alias("spread"), F.sum(F.col("n") * mean * (1 - mean)).alias("noise")
        ).first()
        if not got["n"] or not got["noise"]:
            return self.highest
        between = got["spread"] / got["n"] - got["within"] / got["n"]
        return min(self.highest, max(self.lowest, got["noise"] / got["n"] / max(between, 1e-9) - 1))

    def transform(self, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host: str = "source", path: str = "lang", label_col: str = "quality") -> DataFrame:
        """(doc_id, host, path, prior, evidence, score, keep), one row per input row.

        labels: (doc_id, label 0 or 1); null labels are left out, several labels of a document
        count each. A null text counts as empty, a null host or path as `unknown`. Without labels
        the score is 0.5 and everything is kept. An empty table gives an empty result.
        """
        rows = materialize(self.features(docs, id_col, text_col, host, path))
        marks = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
        known = materialize(rows.join(marks, "doc_id"))

        pairs = known.select("label", F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("bin")) for f in FEATURES])).alias("x")).select("label", "x.*")
        counts = pairs.groupBy("feature", "bin").agg(F.sum("label").alias("good"), F.sum(1 - F.col("label")).alias("bad")).collect()  # features x bins, fixed by FEATURES
        n_good, n_bad = (known.agg(F.sum("label"), F.sum(1 - F.col("label"))).first() or (0, 0))
        n_good, n_bad = n_good or 0, n_bad or 0
        rate = (n_good + 1) / (n_good + n_bad + 2)
        evidence = F.lit(0.0)
        for f in FEATURES:
            own = [c for c in counts if c["feature"] == f]
            good, bad, none = (n_good + self.smooth * (len(own) + 1)), (n_bad + self.smooth * (len(own) + 1)), F.log(F.lit(1.0))
            ratio = {c["bin"]: ((c["good"] + self.smooth) / good) / ((c["bad"] + self.smooth) / bad) for c in own}
            if ratio:
                pick = F.create_map(*[F.lit(v) for b, r in sorted(ratio.items()) for v in (b, r)])
                evidence = evidence + F.log(F.coalesce(F.try_element_at(pick, F.col(f)), F.lit(bad / good)))
            else:
                evidence = evidence + none

        paths = materialize(known.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("label").alias("good")))
        hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
        k_host = self._weight(hosts, F.lit(rate))
        hosts = hosts.select("host", ((F.col("good") + k_host * rate) / (F.col("n") + k_host)).alias("host_rate"))
        inner = materialize(paths.join(hosts, "host"))
        k_path = self._weight(inner, F.col("host_rate"))
        inner = inner.select("host", "path", ((F.col("good") + k_path * F.col("host_rate")) / (F.col("n") + k_path)).alias("path_rate"))

        small = paths.count() <= BROADCAST_IDS // 8
        side = F.broadcast if small else (lambda x: x)
        out = rows.join(side(inner), ["host", "path"], "left").join(side(hosts), "host", "left").withColumn("prior", F.coalesce("path_rate", "host_rate", F.lit(rate)))
        out = out.withColumn("evidence", evidence).withColumn("score", 1 / (1 + F.exp(-(F.log(F.col("prior") / (1 - F.col("prior"))) + F.col("evidence")))))
        return out.select("doc_id", "host", "path", "prior", "evidence", "score", (F.col("score") >= self.cut).alias("keep"))


def oracle(smooth: float = 1.0, lowest: float = 1.0, highest: float = 10000.0, cut: float = 0.5) -> str:
    """The same rows in DuckDB's SQL for documents and labels."""
    exprs = {f: e.format(g=", 'g'", words="len(w)", distinct="len(list_distinct(w))").replace("floor(", "floor(1.0::DOUBLE * ").replace("log2(", "log2(1.0::DOUBLE * ") for f, e in FEATURES.items()}
    weight = lambda noise, n, spread, within: f"least({highest}, greatest({lowest}, {noise} / {n} / greatest({spread} / {n} - {within} / {n}, 1e-9) - 1))"
    joins = "\n".join(f"LEFT JOIN llr {f}_ ON {f}_.feature = '{f}' AND {f}_.bin = r.{f} LEFT JOIN none {f}_n ON {f}_n.feature = '{f}'" for f in FEATURES)
    total = " + ".join(f"ln(coalesce({f}_.ratio, {f}_n.ratio))" for f in FEATURES)
    unions = " UNION ALL ".join(f"SELECT label, '{f}' AS feature, {f} AS bin FROM known" for f in FEATURES)
    return f"""WITH base AS (SELECT doc_id, coalesce(source, 'unknown') AS host, coalesce(lang, 'unknown') AS path, coalesce(text, '') AS t FROM documents),
b2 AS (SELECT *, length(t) AS n, string_split(t, ' ') AS w FROM base),
r AS (SELECT doc_id, host, path, {", ".join(f"{e} AS {f}" for f, e in exprs.items())} FROM b2),
known AS (SELECT r.*, l.quality AS label FROM r JOIN labels l USING (doc_id) WHERE l.quality IN (0, 1)),
tot AS (SELECT CAST(sum(label) AS DOUBLE) AS good, CAST(sum(1 - label) AS DOUBLE) AS bad, (sum(label) + 1.0::DOUBLE) / (count(*) + 2) AS rate FROM known),
cnt AS (SELECT feature, bin, sum(label) AS good, sum(1 - label) AS bad FROM ({unions}) GROUP BY ALL),
bins AS (SELECT feature, count(*) AS k FROM cnt GROUP BY feature),
llr AS (SELECT feature, bin, ((cnt.good + {smooth}::DOUBLE) / (tot.good + {smooth} * (k + 1))) / ((cnt.bad + {smooth}::DOUBLE) / (tot.bad + {smooth} * (k + 1))) AS ratio FROM cnt JOIN bins USING (feature), tot),
none AS (SELECT feature, (tot.bad + {smooth}::DOUBLE * (k + 1)) / (tot.good + {smooth} * (k + 1)) AS ratio FROM bins, tot),
paths AS (SELECT host, path, CAST(count(*) AS DOUBLE) AS n, CAST(sum(label) AS DOUBLE) AS good FROM known GROUP BY ALL),
h AS (SELECT host, sum(n) AS n, sum(good) AS good FROM paths GROUP BY host),
kh AS (SELECT {weight("sum(n * rate * (1 - rate))", "sum(n)", "sum(n * pow(good / n - rate, 2))", "sum(rate * (1 - rate))")} AS k FROM (SELECT h.n, h.good, tot.rate FROM h, tot)),
hosts AS (SELECT host, (h.good + k * rate) / (n + k) AS host_rate FROM h, kh, tot),
pj AS (SELECT * FROM paths JOIN hosts USING (host)),
kp AS (SELECT {weight("sum(n * host_rate * (1 - host_rate))", "sum(n)", "sum(n * pow(good / n - host_rate, 2))", "sum(host_rate * (1 - host_rate))")} AS k FROM pj),
inn AS (SELECT host, path, (good + k * host_rate) / (n + k) AS path_rate FROM pj, kp),
s AS (SELECT r.doc_id, r.host, r.path, coalesce(path_rate, host_rate, rate) AS prior, {total} AS evidence FROM r {joins} LEFT JOIN inn ON inn.host = r.host AND inn.path = r.path LEFT JOIN hosts ON hosts.host = r.host, tot)
SELECT doc_id, host, path, round(prior, 6) AS prior, round(evidence, 6) AS evidence, round(1 / (1 + exp(-(ln(prior / (1 - prior)) + evidence))), 6) AS score,
  1 / (1 + exp(-(ln(prior / (1 - prior)) + evidence))) >= {cut} AS keep FROM s"""
