"""Operators on claims, vectors and texts, with the cases that are easy to get wrong."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronofold.functions import scalars as X
from chronofold.operators import claims as ops
from chronofold.operators import consolidate, lexical, vectors


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'long' if isinstance(v, int) else 'string'}" for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text,expected", [("", {""}), ("a", {"a"}), ("aaaa", {"aa"}), ("a　b\x1cc", {"ab", "bc"}), ("\U0001f600\U0001f601x", {"\U0001f600\U0001f601", "\U0001f601x"}), ("中文字", {"中文", "文字"})])
def test_bigrams(spark, text, expected):
    assert set(one(spark, X.bigrams(F.col("t")), t=text)) == expected


def test_jaccard_and_search(spark):
    rows = spark.createDataFrame([(0, "abcd"), (1, "bcd"), (2, "xyz"), (3, "abcd"), (4, None)], "ord int, text string")
    got = lexical.deep_search(rows, "abc", 5, ["ord"]).collect()
    assert [(r["ord"], r["score"]) for r in got] == [(0, 0.6667), (3, 0.6667), (1, 0.3333)]
    with pytest.raises(ValueError):
        lexical.deep_search(rows, "abc", 0, ["ord"])


@pytest.mark.parametrize("seed", [1, 2])
def test_search_by_postings_equals_a_scan(spark, tmp_path, seed):
    rng = np.random.default_rng(seed)
    rows = [(int(k // 9), int(k % 9), "".join(rng.choice(list("aaabbcd "), rng.integers(0, 30)))) for k in range(400)] + [(90, 0, None), (90, 1, ""), (None, 2, "abab"), (91, 0, "q")]
    log = spark.createDataFrame(rows, "conv int, turn int, text string")
    index = lexical.BigramIndex.build(log.where("conv < 20"), str(tmp_path / "grams"), ["conv", "turn"])
    index.append(log.where("conv >= 20 OR conv IS NULL"))
    for text in ("abcabd", "ab", "", "q", "zzz", "dcdcba abc ddd", rows[17][2]):
        for k in (1, 5):
            want = lexical.deep_search(log, text, k, ["conv", "turn"]).collect()
            assert [tuple(r) for r in index.search(text, k).collect()] == [(r["conv"], r["turn"], r["score"]) for r in want]
    with pytest.raises(ValueError):
        index.search("ab", 0)


def test_rare_bigrams_name_the_candidates(spark, tmp_path):
    rows = [(k, "common words here " * 3) for k in range(500)] + [(500 + k, "xyzzy common") for k in range(6)]
    index = lexical.BigramIndex.build(spark.createDataFrame(rows, "ord int, text string"), str(tmp_path / "grams"), ["ord"])
    grams = index.rare(["co", "xy", "qq"])
    assert grams == ["qq", "xy", "co"]
    assert [r["ord"] for r in index.search("xyzzy common", 6).collect()] == list(range(500, 506))
    # At a score of 0.6, only entries of 0.6 to 1.67 times the size asked are looked at: ten bigrams are too few for twenty.
    assert [r["n"] for r in index.postings(["co"], 0.6, 20).select("n").distinct().collect()] == [15]


def test_cosine_of_zero_vector(spark):
    rows = spark.createDataFrame([(0, [0.0, 0.0]), (1, [3.0, 4.0])], "ord int, embedding array<float>")
    got = vectors.topk(rows, [3.0, 4.0], 2).collect()
    assert [(r["ord"], round(r["score"], 9)) for r in got] == [(1, 1.0), (0, 0.0)]


def test_topk_ties_in_order(spark):
    rows = spark.createDataFrame([(k, [1.0, 0.0]) for k in range(5)], "ord int, embedding array<float>")
    assert [r["ord"] for r in vectors.topk(rows, [1.0, 0.0], 3).collect()] == [0, 1, 2]


@pytest.mark.parametrize("since,now,days", [("2024-01-01T00:00:00Z", "2024-02-19T00:00:00Z", 49), ("2024-01-01T00:00:00Z", "2024-02-18T23:59:59Z", 48), ("2024-01-02T12:00:00Z", "2024-01-01T00:00:00Z", -2)])
def test_days_idle_rounds_down(spark, since, now, days):
    assert one(spark, X.days_idle(F.col("a"), F.col("c"), F.lit(now)), a="", c=since) == days


def test_first_forgettable_day():
    assert [next(d for d in range(400) if math.exp(-d / (30 * (1 + h))) < 0.2) for h in (0, 1, 2)] == [49, 97, 145]


def test_promotion(spark):
    rows = spark.createDataFrame([("low", 2), ("low", 3), (None, 8), ("high", 8), ("mid", 3)], "confidence string, hits int")
    assert [r[0] for r in rows.select(X.promoted(F.col("confidence"), F.col("hits"))).collect()] == [None, "mid", "high", None, None]


def test_pack_is_a_prefix(spark):
    rng = np.random.default_rng(5)
    data = [(int(g), int(i), "x" * int(n)) for g in range(40) for i, n in enumerate(rng.integers(0, 40, 12))]
    got = ops.pack(spark.createDataFrame(data, "g int, i int, text string"), 60, [F.asc("i")], ["g"]).collect()
    expected = set()
    for g in range(40):
        used = 0.0
        for _, i, text in (r for r in data if r[0] == g):
            if i and used + len(text) / 1.5 > 60:
                break
            used += len(text) / 1.5
            expected.add((g, i))
    assert {(r["g"], r["i"]) for r in got} == expected


def test_first_item_over_budget_is_kept(spark):
    rows = spark.createDataFrame([(0, "x" * 100), (1, "y")], "i int, text string")
    assert [r["i"] for r in ops.pack(rows, 10, [F.asc("i")]).collect()] == [0]


def test_pairs_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    m = rng.standard_normal((60, 8)).astype(np.float32)
    rows = spark.createDataFrame([(str(k), k, [float(x) for x in v]) for k, v in enumerate(m)], "id string, ord long, embedding array<float>")
    d = m.astype(float)
    d /= np.linalg.norm(d, axis=1)[:, None]
    expected = {(i, j) for i in range(60) for j in range(i + 1, 60) if d[i] @ d[j] >= 0.5}
    vectors.BLOCK, old = 16, vectors.BLOCK
    try:
        assert {(r["a_ord"], r["b_ord"]) for r in vectors.similar_pairs(rows, 0.5).collect()} == expected
    finally:
        vectors.BLOCK = old


@pytest.mark.parametrize("kind", ["random", "clustered"])
def test_cells_find_the_best(spark, tmp_path, monkeypatch, kind):
    from chronofold.operators import cells

    monkeypatch.setattr(cells, "BLOCK", 50)
    monkeypatch.setattr(cells, "QUERIES", 8)
    rng = np.random.default_rng(9)
    m = clustered(rng, 700, d=6) if kind == "clustered" else rng.standard_normal((700, 6)).astype(np.float32)
    m[3], m[40], m[41], m[300] = 0, m[5], m[5], m[5]
    rows = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(m)] + [(900, None)], "id long, embedding array<float>")
    asked = rows.selectExpr("id AS query_id", "embedding AS q")
    d = m.astype(float)
    d /= np.linalg.norm(d, axis=1)[:, None] + 1e-12
    best = np.argsort(-np.round(d @ d.T, 12), axis=1, kind="stable")[:, :3]
    got = {(r["query_id"], r["rank"]): r["id"] for r in vectors.topk_batch(rows, asked, 3).collect()}
    assert got == {(q, k + 1): int(best[q, k]) for q in range(700) for k in range(3)}
    index = cells.CellIndex.build(rows, str(tmp_path / "index"), "id", "id")
    for q in (5, 3, 77):
        assert [int(r["id"]) for r in index.search([float(x) for x in m[q]], 3).collect()] == [int(x) for x in best[q]]
    with pytest.raises(ValueError):
        index.search([1.0] * 6, 0)
    assert index.search([1.0] * 6, 2000).count() == 700


def test_cells_that_cannot_match_are_not_read(spark, tmp_path):
    from chronofold.operators.cells import CellIndex

    rng = np.random.default_rng(2)
    m = clustered(rng, 4000, centres=40)
    rows = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(m)], "ord long, embedding array<float>")
    index = CellIndex.build(rows, str(tmp_path / "index"), "ord")
    read = index.cells_for([float(x) for x in m[17]], 5)
    share = index.cells.counts[np.isin(index.cells.names, read)].sum() / 4000
    assert len(index.cells.names) > 20 and share < 0.15
    plan = index.search([float(x) for x in m[17]], 5)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan


def test_cells_without_vectors(spark, tmp_path):
    rows = spark.createDataFrame([(1, None)], "id long, embedding array<float>")
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, q array<double>")
    assert vectors.topk_batch(rows, asked, 2).count() == 0


def clustered(rng, n, d=16, centres=12, spread=0.05):
    c = rng.standard_normal((centres, d))
    return (c[rng.integers(0, centres, n)] + spread * rng.standard_normal((n, d))).astype(np.float32)


@pytest.mark.parametrize("floor", [0.4, 0.75, 0.95, -0.1])
@pytest.mark.parametrize("kind", ["clustered", "random"])
def test_pivots_lose_no_pair(spark, monkeypatch, floor, kind):
    monkeypatch.setattr(vectors, "BLOCK", 24)
    rng = np.random.default_rng(3)
    m = clustered(rng, 300) if kind == "clustered" else rng.standard_normal((300, 6)).astype(np.float32)
    m[7], m[8], m[200] = 0, m[9], m[9]
    rows = spark.createDataFrame([(f"v{k}", k, [float(x) for x in v]) for k, v in enumerate(m)] + [("none", 900, None)], "id string, ord long, embedding array<float>")
    d = m.astype(float)
    d /= np.linalg.norm(d, axis=1)[:, None] + 1e-12
    expected = {(i, j) for i in range(300) for j in range(i + 1, 300) if d[i] @ d[j] >= floor}
    got = vectors.similar_pairs(rows, floor).collect()
    assert len(got) == len(expected) and {(r["a_ord"], r["b_ord"]) for r in got} == expected
    assert all(r["a"] == f"v{r['a_ord']}" and r["b"] == f"v{r['b_ord']}" for r in got)


def test_pivots_leave_out_most_of_what_is_apart(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 64)
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(str(k), k, [float(x) for x in v]) for k, v in enumerate(clustered(rng, 3000, centres=40))], "id string, ord long, embedding array<float>")
    blocks, met = vectors.tiles(rows, 0.95)
    compared = met.agg(F.sum("compared")).first()[0] / (3000 * 2999 / 2)
    copies = blocks.agg(F.sum("n")).first()[0] / 3000
    assert compared < 0.05 and copies < 1.5
    # Where nothing is apart, nothing is copied.
    apart = spark.createDataFrame([(str(k), k, [float(x) for x in v]) for k, v in enumerate(rng.standard_normal((500, 32)))], "id string, ord long, embedding array<double>")
    assert vectors.tiles(apart, 0.4)[0].agg(F.sum("n")).first()[0] == 500


def walk(pairs):
    """The merge as a sequential walk."""
    gone, out = set(), set()
    for a, b, a_ord, b_ord, score, kept, loser in sorted(pairs, key=lambda p: (-p[4], p[2], p[3])):
        if a not in gone and b not in gone:
            gone.add(loser)
            out.add((a, b, score, kept, loser))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_greedy_rounds_equal_the_walk(spark, seed):
    rng = np.random.default_rng(seed)
    pairs, n = [], 60
    for a in range(n):
        for b in range(a + 1, n):
            if rng.random() < (0.06 if seed < 3 else 0.4):
                kept = a if rng.random() < 0.5 else b
                pairs.append((f"c{a}", f"c{b}", a, b, float(rng.integers(90, 100)) / 100, f"c{kept}", f"c{a + b - kept}"))
    kind = "a string, b string, a_ord long, b_ord long, score double, kept string, loser string"
    got = consolidate.greedy(spark.createDataFrame(pairs, kind)).collect()
    assert len(got) == len({tuple(r) for r in got}) and {tuple(r) for r in got} == walk(pairs)
    assert consolidate.greedy(spark.createDataFrame([], kind)).count() == 0


def test_a_keeper_of_many_takes_one_round(spark, monkeypatch):
    rounds, plain = [], consolidate.materialize
    monkeypatch.setattr(consolidate, "materialize", lambda df: rounds.append(1) or plain(df))
    pairs = [("c0", f"c{k}", 0, k, 1.0, "c0", f"c{k}") for k in range(1, 2000)]
    got = consolidate.greedy(spark.createDataFrame(pairs, "a string, b string, a_ord long, b_ord long, score double, kept string, loser string"))
    assert got.count() == 1999 and len(rounds) == 4


def test_greedy_merge_and_keeper(spark):
    claims = spark.createDataFrame([("a", 1, "2024-01-01"), ("b", 1, "2024-01-02"), ("c", 5, "2024-01-01"), ("d", 0, "x")], "id string, hits long, created string")
    pairs = spark.createDataFrame([("a", "b", 0, 1, 0.99), ("b", "c", 1, 2, 0.97), ("a", "c", 0, 2, 0.98), ("c", "d", 2, 3, 0.96)], "a string, b string, a_ord long, b_ord long, score double")
    got = consolidate.greedy(consolidate.with_keeper(pairs, claims)).collect()
    assert {(r["a"], r["b"], r["loser"]) for r in got} == {("a", "b", "a"), ("b", "c", "b"), ("c", "d", "d")}


def test_filters(spark):
    rows = spark.createDataFrame([("a", "e", "k", "active", "mid", 1), ("b", None, "k", "active", None, 0), ("c", "e", "k", "forgotten", "high", 2)], "id string, entity string, kind string, status string, confidence string, birth_seq long")
    ids = lambda **f: [r["id"] for r in ops.query(rows, **f).collect()]
    assert ids() == ["b", "a"]
    assert ids(status="all", entity="e") == ["a", "c"]
    assert ids(min_confidence=0.6) == ["a"]
    assert ids(min_confidence=0.0, entity="") == ["b", "a"]


def test_nearest_without_right_rows(spark):
    left = spark.createDataFrame([("x", [1.0, 0.0])], "id string, embedding array<float>")
    right = spark.createDataFrame([], "id string, ord long, embedding array<float>")
    assert [tuple(r) for r in vectors.nearest(left, right).collect()] == [("x", None, None)]


def test_nearest_in_groups_equals_broadcast(spark, monkeypatch):
    from chronofold.operators import vectors

    rows = spark.createDataFrame([(k, k, [float(k % 7 + 1), float(k % 5), 1.0]) for k in range(60)], "id long, ord long, embedding array<double>")
    left, right = rows.where("id % 3 = 0"), rows.where("id % 3 <> 0")
    want = sorted(map(tuple, vectors.nearest(left, right).collect()))
    monkeypatch.setattr(vectors, "LEFT", 4)
    assert sorted(map(tuple, vectors.nearest(left, right).collect())) == want


def test_forget_order_is_by_three_places(spark):
    from pyspark.sql import functions as F

    from chronofold.operators import claims as ops

    # 49 days idle without hits (0.195...), and 98 with one: equal in three places, so birth decides.
    rows = [("b", "low", "2024-02-12T00:00:00Z", 0, "active", 2), ("a", "low", "2023-12-25T00:00:00Z", 1, "active", 1)]
    got = ops.forget_candidates(spark.createDataFrame(rows, "id string, confidence string, created string, hits long, status string, birth_seq long").withColumn("last_accessed", F.lit(None).cast("string")), F.lit("2024-04-01T00:00:00Z")).collect()
    assert [(r["id"], r["retention"]) for r in got] == [("a", 0.195), ("b", 0.195)]


def test_blocks_travel_by_places(spark, monkeypatch):
    """Each block goes to as many places as there are groups, not to each block that it meets; the pairs are those of all cosines."""
    import numpy as np
    from chronofold.operators import vectors

    for name, value in (("BLOCK", 4), ("GROUPS", 3), ("HELD", 50)):
        monkeypatch.setattr(vectors, name, value)
    m = np.random.default_rng(4).standard_normal((120, 6))
    rows = spark.createDataFrame([(str(k), k, [float(x) for x in v]) for k, v in enumerate(m)], "id string, ord long, embedding array<double>")
    blocks, met = vectors.tiles(rows, 0.05)
    assert met.count() > 100 and vectors.at_places(blocks, met).count() <= 4 * blocks.count()
    u = m / np.linalg.norm(m, axis=1)[:, None]
    want = {(i, j) for i in range(120) for j in range(i + 1, 120) if u[i] @ u[j] >= 0.05}
    for held in (50, 2):
        monkeypatch.setattr(vectors, "HELD", held)
        got = [(r["a_ord"], r["b_ord"]) for r in vectors.similar_pairs(rows, 0.05).collect()]
        assert len(got) == len(want) and set(got) == want
