"""Source divergence, whitening and shards against plain versions."""

import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronofold.llm.common import scratch_path
from chronofold.llm.divergence import SourceDivergence
from chronofold.llm.sharding import ExternalShuffle, place
from chronofold.llm.whitening import Whitening, long_form, merged, summary

ALPHA = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def plain_divergence(rows, least, top):
    """rows: (lang, source, text). All sources' counts of all terms, one pair and term after the other."""
    rows = [tuple(x or "" for x in r) for r in rows]
    words = [[w.translate({ord(c): c.lower() for c in ALPHA}) for w in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", t)] for *_, t in rows]
    out = []
    for lang in {r[0] for r in rows}:
        here = [(s, w) for (g, s, _), w in zip(rows, words) if g == lang]
        docs = Counter(w for _, ws in here for w in set(ws))
        kept = sorted(w for w, n in docs.items() if n >= least)
        count = {s: Counter(w for t, ws in here if t == s for w in ws) for s, _ in here}
        whole = Counter(w for _, ws in here for w in ws)

        def shares(c):
            total = sum(c[w] for w in kept)
            return {w: 1 + (10**9 * (c[w] + 2)) // (total + 2 * len(kept)) for w in kept}

        ps, q = {s: shares(c) for s, c in count.items()}, shares(whole)
        f = lambda x, y: int(Fraction((x - y) ** 2, x + y))
        for s in count:
            pairs = [(t, sum(f(ps[s][w], ps[t][w]) for w in kept)) for t in count if t != s]
            terms = [(w, f(ps[s][w], q[w])) for w in kept if count[s][w] and ps[s][w] > q[w]]
            for part, found in (("pair", pairs), ("term", terms)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, k) for k, (i, v) in enumerate(ranked, 1) if part == "pair" or k <= top]
    return sorted(out)


def divergences(spark, rows, **kw):
    docs = spark.createDataFrame([(*r, "mine", 7) for r in rows], "lang string, source string, text string, term string, n int")
    got = SourceDivergence(**kw).transform(docs)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(tuple(r) for r in got.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_divergence_equals_a_plain_version(spark, seed):
    rng = random.Random(seed)
    words = ["Tea", "tea", "straße", "STRASSE", "né", "ÉTÉ", "x", "zz", "a1b", "語", "𝒳", "it's", "-"]
    rows = [(rng.choice(["en", "de", None]), rng.choice(["a", "a", "a", "b", "ç", "Z", None]), " ".join(rng.choices(words, range(1, 14), k=rng.randrange(12)))) for _ in range(150)]
    rows += [("en", "only", None), ("en", "empty", ""), ("fr", "one", "tea"), ("fr", "two", "tea"), ("fr", "two", "tea"), ("it", "alone", "tea")]
    assert divergences(spark, rows, least=3, top=4) == plain_divergence(rows, 3, 4)


def test_divergence_of_odd_tables(spark):
    assert divergences(spark, []) == []
    rows = [("en", "b", "tea"), ("en", "a", None)]
    assert divergences(spark, rows) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]
    long = [("en", "a", "tea coffee " * 100_000), ("en", "b", "tea")]
    assert divergences(spark, long, least=1) == plain_divergence(long, 1, 10)


def plain_whitening(rows, components=32):
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for _, v in rows], dtype=object)
    n, sums = len(x), [sum(col) for col in x.T]
    z = np.array([[n * a - s for a, s in zip(r, sums)] for r in x], dtype=object)
    y = z.astype(float) / n
    e, u = np.linalg.eigh(y.T @ y / n)
    order = np.argsort(-e)[:components]
    return n, [sum(a * a for a in r) for r in z], y @ u[:, order] / np.sqrt(e[order]), e[order] / e.sum(), u[:, order]


@pytest.mark.parametrize("n,width", [(300, 5), (300, 40), (3, 8)])
def test_whitening_equals_eigenvectors(spark, n, width):
    rng = np.random.default_rng(n + width)
    data = rng.normal(size=(n, width)) * np.geomspace(9, 0.3, width) + 40
    rows = [(k % 290, [float(v) for v in r]) for k, r in enumerate(data)]
    bad = [(900, None), (901, []), (902, [1.0] * (width - 1) + [None]), (903, [1.0] * (width - 1) + [float("nan")]), (904, [float("inf")] * width), (905, [1.0] * (width + 1)), (906, [1e300] * width)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows + bad], "vec_id long, embedding array<double>, whitened string, n int").repartition(7)
    got = Whitening().transform(df).collect()
    m, deviation, white, explained, _ = plain_whitening(rows)
    k = min(32, width, n - 1)
    assert len(got) == n and {r["n"] for r in got} == {m}
    assert sorted(int(r["deviation"]) for r in got) == sorted(deviation)
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], []).append(r["whitened"])
    assert all(len(v) == k for vs in by.values() for v in vs)
    seen = [k2 for k2, c in Counter(i for i, _ in rows).items() if c == 1]
    mine = np.array([by[i][0] for i in seen])
    theirs = np.array([white[[j for j, r in enumerate(rows) if r[0] == i][0]][:k] for i in seen])
    assert np.allclose(np.abs(mine), np.abs(theirs), atol=1e-6)
    sign = np.sign((mine * theirs).sum(axis=0))
    assert np.allclose(mine, theirs * sign, atol=1e-6)
    assert np.allclose(got[0]["explained"], explained[:k], rtol=1e-6)
    assert max(r["identity_error"] for r in got) < 1e-8
    long = long_form(Whitening().transform(df))
    assert long.count() == n * k and long.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_merging_loses_nothing():
    rng = np.random.default_rng(5)
    x = rng.integers(-(10**6), 10**6, size=(500, 12))
    whole, parts = summary(x), merged(merged(summary(x[:3]), summary(x[3:200])), summary(x[200:]))
    assert whole[:2] == parts[:2] and np.allclose(whole[2], parts[2], rtol=1e-10)
    assert np.allclose(np.abs((whole[3] * parts[3]).sum(axis=1)), 1)


def test_whitening_without_rows_or_variance(spark):
    kind = "vec_id long, embedding array<float>"
    assert Whitening().transform(spark.createDataFrame([], kind)).count() == 0
    assert Whitening().transform(spark.createDataFrame([(1, None)], kind)).count() == 0
    got = Whitening().transform(spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [1.0, 2.0])], kind)).collect()
    assert [(r["n"], int(r["deviation"]), r["whitened"]) for r in got] == [(3, 0, [])] * 3


def test_deviation_beyond_longs(spark):
    rows = [(k, [float(v * 10**9), 0.5]) for k, v in enumerate((1, -2, 5, 7))]
    got = Whitening().transform(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted(int(r["deviation"]) for r in got) == sorted(plain_whitening(rows)[1])


def shards_of(spark, docs, tmp, **kw):
    ticket = kw.pop("ticket", None)
    maker = ExternalShuffle(**kw)
    maker.write(docs, str(tmp), ticket)
    return maker.read(spark, str(tmp), docs.schema.simpleString())


def held(rows, shards):
    """Every slot once, counts at most one apart, shards in folders of their own."""
    places = Counter((r["shard"], r["slot"]) for r in rows)
    sizes = Counter(r["shard"] for r in rows)
    assert all(n == 1 for n in places.values()) and set(sizes) <= set(range(shards))
    counts = [sizes[s] for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    assert all((s, k) in places for s, n in sizes.items() for k in range(n))


def test_shards_hold_every_row(spark, tmp_path):
    rows = [(k if k % 3 else 0, "same text" if k % 2 else f"text {k}", k, {"a": k}) for k in range(1000)] + [(None, None, None, None)] * 5 + [(7, "", 1, None), (8, "long " * 300_000, 2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, slot long, shard map<string,int>").repartition(5)
    got = shards_of(spark, docs, tmp_path / "a", shards=24, bucket_bytes=4000).collect()
    held(got, 24)
    assert Counter((r["document"]["doc_id"], r["document"]["text"], r["document"]["slot"]) for r in got) == Counter((a, b, c) for a, b, c, _ in rows)


def test_shards_of_few_and_no_rows(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "doc_id long, text string")
    held(shards_of(spark, docs, tmp_path / "few").collect(), 24)
    assert shards_of(spark, docs.where("false"), tmp_path / "none").count() == 0


def test_the_order_is_the_seeds(spark, tmp_path):
    table = str(tmp_path / "table")
    spark.range(5000).selectExpr("id AS doc_id", "CAST(id AS STRING) AS text").repartition(3).write.parquet(table)
    docs = spark.read.parquet(table)

    def order(name, seed):
        got = shards_of(spark, docs, tmp_path / name, shards=4, seed=seed, bucket_bytes=2000, ticket=place()).orderBy("shard", "slot")
        return [r[0] for r in got.select("document.doc_id").collect()]

    first, second, other = order("x", 3), order("y", 3), order("z", 4)
    assert first == second and first != other and sorted(first) == sorted(other) == list(range(5000))
    # No run of the input survives: neighbours in the order are as far apart as chance has it.
    near = sum(abs(a - b) == 1 for a, b in zip(first, first[1:]))
    assert near < 15
    assert abs(np.corrcoef(range(5000), first)[0, 1]) < 0.06


def test_digests_come_from_the_files(spark):
    docs = spark.createDataFrame([(k, None if k == 3 else "é" * k) for k in range(60)], "doc_id int, text string")
    got = ExternalShuffle().digests(docs, scratch_path(spark, "shards-")).collect()
    held(got, 24)
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in got} == {k: (8 + (0 if k == 3 else 2 * k), zlib.crc32(b"" if k == 3 else ("é" * k).encode())) for k in range(60)}
    assert {(r["law"], r["grown_shard"]) for r in got} == {("rows", None)}


def test_no_python_in_the_shuffle(spark, tmp_path):
    spark.range(100).selectExpr("id AS doc_id", "'x' AS text").write.parquet(str(tmp_path / "t"))
    docs = spark.read.parquet(str(tmp_path / "t"))
    rows = docs.select(F.struct("*").alias("document"), place().alias("ticket")).withColumn("bucket", F.lit(1) + F.col("ticket") % 3)
    plan = rows.repartition(8, "bucket").sortWithinPartitions("bucket", "ticket").groupBy("bucket").agg(F.collect_list("document"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Python" not in plan


def test_terms_are_counted_without_lambdas(spark):
    """Sorting and pairing the words of a text by interpreted lambdas took most of the time."""
    from chronofold.llm.divergence import SourceDivergence

    docs = spark.createDataFrame([("en", "a", "The the cat"), ("en", "b", "cat, CAT"), ("en", "a", "")], "lang string, source string, text string")
    got = SourceDivergence(least=2).vocabulary(docs)
    assert "lambda" not in got._jdf.queryExecution().executedPlan().toString()
    assert [(r["term"], r["total"], [tuple(x) for x in r["profile"]]) for r in got.collect()] == [("cat", 3, [("a", 1), ("b", 2)])]
