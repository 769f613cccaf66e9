"""Near-duplicate operators against brute force."""

import math
import random

import numpy as np
import pytest

from chronofold.llm import minhash
from chronofold.llm.common import materialize
from chronofold.llm.minhash import NearDuplicates, forest_pairs, meetings, shingle_set
from chronofold.llm.pstable import EmbeddingDuplicates, settings
from chronofold.llm.topk import ExactTopK
from chronofold.operators.components import connected_components

BLANKS = " \t\n\x0b\x0c\r"


def words_of(text):
    out, word = [], ""
    for c in text or "":
        if c in BLANKS:
            if word:
                out.append(word)
            word = ""
        else:
            word += c.lower() if "A" <= c <= "Z" else c
    return [*out, word] if word else out


def plain_set(text, width):
    w = words_of(text)
    return {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()


def closure(ids, linked):
    comp = {i: i for i in ids}
    again = True
    while again:
        again = False
        for a, b in linked:
            low = min(comp[a], comp[b])
            again |= comp[a] != low or comp[b] != low
            comp[a] = comp[b] = low
    return comp


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + k, 101 + k) for k in range(50)] + [(7, None), (9, 9)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and b is not None and a != b]
    assert got == closure({x for e in real for x in e}, real)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("text", ["", None, " \n\t", "One", "one TWO", "a b c a b c a b c", "É É é x", "x\x0by\x0cz w", "word " * 3000])
@pytest.mark.parametrize("width", [3, 5])
def test_shingle_count(text, width):
    assert len(shingle_set(text, width)) == len(plain_set(text, width))


def corpus():
    rng = random.Random(1)
    vocab = [f"w{k}" for k in range(400)]
    rows, common = [], " ".join(rng.choices(vocab, k=40))
    for k in range(30):
        words = rng.choices(vocab, k=rng.randrange(20, 120))
        rows.append(" ".join(words))
        for _ in range(rng.randrange(0, 4)):
            copy = list(words)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            rows.append(" ".join(copy).upper() if rng.random() < 0.3 else "\n".join(copy))
    base = rng.choices(vocab, k=150)
    for _ in range(80):  # a crowd of near copies, larger than a bucket
        copy = list(base)
        for _ in range(rng.randrange(0, 6)):
            copy[rng.randrange(len(copy))] = rng.choice(vocab)
        rows.append(" ".join(copy))
    rows += [common + " " + " ".join(rng.choices(vocab, k=60)) for _ in range(40)]  # a shared passage
    rows += [None, "", "  ", "one", "one", "one two", "ONE two", "long " * 20000]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_minhash_equals_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, comp string, n int")
    got = {r["doc_id"]: r for r in NearDuplicates(width=3, num=85, den=100).transform(docs).collect()}
    sets = {i: plain_set(t, 3) for i, t in rows}
    linked = [(a, b) for a, x in sets.items() for b, y in sets.items() if a < b and x and y and 100 * len(x & y) >= 85 * len(x | y)]
    comp = closure(sets, linked)
    assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert {i: r["component_id"] for i, r in got.items()} == comp
    assert all(r["kept"] == (i == comp[i]) for i, r in got.items())


def test_minhash_edges(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (None, None), (3, None)], "doc_id long, text string")
    got = sorted(map(tuple, NearDuplicates(width=3, num=85, den=100).transform(docs).collect()), key=repr)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (None, 2, 1, False), (None, 0, None, True), (3, 0, 3, True)], key=repr)
    assert NearDuplicates().transform(docs.limit(0)).count() == 0


def test_short_ranges_are_filled_up_at_borders(spark, monkeypatch):
    assert meetings([(0, 3)], 3) == []
    assert meetings([(0, 3), (1, 1), (4, 3)], 3) == [(0, 0, 1), (1, 1, 1), (4, 1, 1), (1, 0, 2), (0, 0, 2), (4, 1, 2)]
    op = NearDuplicates(width=3, num=85, den=100)
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    some = op.sketch(docs, "doc_id", "text").where("digest IS NOT NULL").dropDuplicates(["digest"]).selectExpr("*", "doc_id AS comp")
    classes = materialize(some)
    found = {}
    for parts in (1, 60):  # 60 ranges of 4 orders hold fewer rows than the window of 32
        monkeypatch.setattr(minhash, "range_parts", lambda *_, parts=parts: parts)
        found[parts] = {tuple(r) for r in op.candidates(classes, classes.count(), 4, adaptive=True).collect()}
    assert found[1] and found[1] <= found[60]


class OneRun(NearDuplicates):
    """Signatures that agree in the first tree only, whatever the sets are."""

    def sketch(self, docs, id_col, text_col):
        other = "unhex(repeat(sha2(cast(doc_id AS string), 256), 27))"
        return super().sketch(docs, id_col, text_col).selectExpr("doc_id", "n", "digest", f"concat(unhex(repeat('07', 56)), substring({other}, 1, 840)) AS sig", f"substring({other}, 1, 96) AS bits")


@pytest.mark.parametrize("salted, shingles", [(1024, 4 << 20), (5, 4 << 20), (1024, 300)])
def test_large_runs_are_compared_on_full_sets(spark, salted, shingles):
    rng = random.Random(11)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(50)]
    texts[49], texts[41] = texts[0] + " end", "begin " + texts[3]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in OneRun(width=3, num=85, den=100, salted=salted, shingles=shingles).transform(docs).collect()}
    assert got == {i: {49: 0, 41: 3}.get(i, i) for i in range(50)}


@pytest.mark.parametrize("num", [80, 85])
def test_estimates_within_six_deviations_stay(num):
    share = num / 100
    bits = np.zeros((2, 96), dtype=np.uint8)
    bits[1, : 96 - int(np.ceil(96 * (share - 5.8 * (share * (1 - share) / 96) ** 0.5)))] = 1
    rows = np.zeros(2, dtype=np.int64), np.zeros((2, 14), dtype=np.uint32), bits, np.array([100, 100]), np.array([0, 1])
    for adaptive in (False, True):
        assert [x.tolist() for x in forest_pairs(*rows, 32, num, 100, adaptive)] == [[0], [1]]


def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, n int").select("vec_id", "embedding", "n")


def test_embedding_links_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((40, 16))
    m = np.concatenate([base, base[:10] + 0.2 * rng.standard_normal((10, 16)), base[0] + 0.05 * rng.standard_normal((60, 16)), base[5:8], 2 * base[9:10]]).astype(np.float32)
    rows = [(k, [float(x) for x in v], 1) for k, v in enumerate(m)]
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [0.0] * 16, 1), (n + 2, [float("nan")] + [1.0] * 15, 1), (n + 3, [1.0, 0.0], 1), (n + 4, [], 1), (n + 5, [None, 1.0], 1)]
    d = m.astype(float)
    d /= np.linalg.norm(d, axis=1)[:, None]
    linked = [(i, j) for i in range(n) for j in range(i + 1, n) if d[i] @ d[j] >= 0.9]
    comp = closure(range(n + 6), linked)
    counts = [sum(i in p for p in linked) for i in range(n + 6)]
    for chunk in (2048, 16):
        got = {r["vec_id"]: r for r in EmbeddingDuplicates(chunk=chunk).transform(vectors_of(spark, rows)).collect()}
        assert [got[i]["n_links"] for i in range(n + 6)] == counts
        assert [got[i]["component_id"] for i in range(n + 6)] == [comp[i] for i in range(n + 6)]
    assert EmbeddingDuplicates().transform(vectors_of(spark, [])).count() == 0


def test_settings_grow_with_rows():
    small, large = settings(1000, 0.9, 2.0, 1e-5, 64), settings(10**9, 0.9, 2.0, 1e-5, 64)
    assert small[0] < large[0] and small[1] < large[1]


@pytest.mark.parametrize("scale_up", [1.0, 1e9])
def test_topk_equals_brute_force(spark, scale_up):
    rng = np.random.default_rng(8)
    m = (rng.standard_normal((230, 12)) * rng.uniform(0.1, 3, (230, 1)) * scale_up).astype(np.float32)
    m[50] = m[40]
    m[60:70] = 0
    rows = [(k, [float(x) for x in v], 1) for k, v in enumerate(m)] + [(300, None, 1), (400, [float("inf")] * 12, 1), (500, [1.0, 2.0], 1)]
    got = ExactTopK(k=10, block=32, query_block=2, lead=4).transform(vectors_of(spark, rows), "vec_id % 10 = 0").collect()
    q = np.floor(m.astype(float) * 1024)
    ints = [[int(x) for x in v] for v in q]
    want = set()
    for a in range(0, 230, 10):
        every = sorted((-max(min(sum(x * y for x, y in zip(ints[a], ints[b])), 2**63 - 1), -(2**63)), b) for b in range(230) if b != a)[:10]
        want |= {(a, r + 1, b, -s) for r, (s, b) in enumerate(every)}
    assert {tuple(r) for r in got} == want
    assert ExactTopK().transform(vectors_of(spark, []), "vec_id % 10 = 0").count() == 0


def test_bounds_leave_most_pairs_out():
    """More rows than a block, of skewed lengths: what is scored exactly is a small share, and the result is whole."""
    from chronofold.llm.topk import Rotated, best, exact_scores, steps, survivors

    rng = np.random.default_rng(9)
    m = np.floor(rng.standard_normal((6000, 32)) * (rng.pareto(2.0, (6000, 1)) + 1) * 40)
    u = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1)
    values, turn = np.linalg.eigh(u.T @ u)
    turn, at = turn[:, ::-1], steps(np.maximum(values[::-1], 0))
    length = np.linalg.norm(m, axis=1)
    order, asked, k, scored = np.argsort(-length), np.arange(0, 6000, 100), 10, 0
    q = Rotated(m[asked], turn, at)
    low = np.sort(m[asked] @ m[order[:128]].T, axis=1)[:, -k - 1].astype(float)
    kept = [np.zeros(0, dtype=np.int64)] * 3
    for i in range(0, 6000, 512):
        rows = order[i : i + 512]
        x, row = survivors(q, Rotated(m[rows], turn, at), low, at, length[rows].max())
        scored += len(x)
        every = [np.concatenate(z) for z in zip(kept, (x, rows[row], exact_scores(m[asked[x]], m[rows[row]])), strict=True)]
        top = best(*every, k)
        kept = [a[top] for a in every]
    assert scored < 0.1 * len(asked) * len(m)
    for n, one in enumerate(asked):
        scores = (m @ m[one]).astype(np.int64)
        assert kept[1][kept[0] == n].tolist() == sorted(range(6000), key=lambda j: (-scores[j], j))[:k]


def test_sketches_drop_no_pair_at_the_threshold():
    from chronofold.llm.pstable import near_in_runs, unit

    rng = np.random.default_rng(10)
    op = EmbeddingDuplicates(cosine=0.9)
    a = unit(rng.standard_normal((4000, 64)))
    side = rng.standard_normal(a.shape)
    side = unit(side - (side * a).sum(axis=1, keepdims=True) * a)
    b = 0.9 * a + np.sqrt(1 - 0.81) * side
    sketch = np.stack([op.sketches(a), op.sketches(b)], axis=1).reshape(8000, -1)
    none, yes = np.zeros(8000, dtype=np.int64), np.ones(8000, dtype=bool)
    assert near_in_runs(np.repeat(np.arange(4000), 2), none, yes, np.ascontiguousarray(sketch), op.most).all()
    far = op.sketches(unit(rng.standard_normal((3000, 64))))
    assert near_in_runs(np.repeat(np.arange(1500), 2), none, yes, far, op.most).mean() < 0.01
    both = np.concatenate([far[:200], far[:100]])
    long_run, part = np.zeros(300, dtype=np.int64), np.repeat([0, 1], [200, 100])
    live = near_in_runs(long_run, part, np.zeros(300, dtype=bool), both, 0)
    assert live[:100].all() and live[200:].all() and not live[100:200].any()


def test_extreme_lengths(spark):
    rows = [(1, [1e-200, 1e-200], 0), (2, [1e200, 1e200], 0), (3, [1.0, -1.0], 0), (4, [5e-324, 0.0], 0)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in EmbeddingDuplicates().transform(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (0, 4)}


def test_crowded_keys_are_dealt(spark):
    from chronofold.operators.components import pointed

    rows = spark.range(500).selectExpr("id AS v", "CASE WHEN id < 400 THEN 1 ELSE id END AS u")
    pointers = spark.createDataFrame([(1, 7), (450, 8)], "u long, p long")
    want = [(v, 7 if v < 400 else 8 if v == 450 else None) for v in range(500)]
    for small, hot in ((10, 10), (0, 50), (0, 1000)):
        assert sorted((r["v"], r["q"]) for r in pointed(rows, pointers, "u", "q", small, hot).collect()) == want


def test_links_that_an_earlier_bucket_sifted_out(spark, monkeypatch):
    """A pair whose sketches look far apart in one table's bucket still counts in the next where both stay for others' sake."""
    from chronofold.llm import pstable

    calls, sift = [], pstable.near_in_runs

    rows = [(1, [1.0, 0.0, 0.0]), (2, [1.0, 0.1, 0.0])]
    op = EmbeddingDuplicates()
    classes = spark.createDataFrame([(k, 1, np.array(v).tobytes()) for k, v in rows], "rep long, copies long, vec binary").coalesce(1)

    def first_table_drops(run, part, within, sketch, most):
        live = sift(run, part, within, sketch, most)
        live[run == 0] = False
        return live

    monkeypatch.setattr(pstable, "near_in_runs", first_table_drops)
    monkeypatch.setattr(pstable, "shuffle_parts", lambda spark: 1)
    monkeypatch.setattr(op, "hashes", lambda m, per, tables: np.zeros((len(m), tables), dtype=np.uint32))
    assert sorted((r["a"], r["n"]) for r in op.links(classes, 1, 3).collect()) == [(1, 1), (2, 1)]


def test_threshold_and_repeated_ids(spark):
    """Cosines of exactly 0.9 link, by the formula of the SQL; different vectors of one vec_id do as well."""
    from chronofold.llm.pstable import cosines

    rng = np.random.default_rng(5)
    pairs = []
    for _ in range(200):
        a, b = np.zeros(25), np.zeros(25)
        at = rng.permutation(25)
        a[at[:25]], b[at[:25]] = 1.0, 1.0
        a, b = a * rng.integers(1, 9), b * rng.integers(1, 9)
        b[at[0]] = 0.0
        pairs.append((a, b))
    a, b = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
    plain = lambda x, y: float(x @ y) / math.sqrt(float(x @ x)) / math.sqrt(float(y @ y))
    assert cosines(a, b).tolist() == [max(plain(x, y), plain(y, x)) for x, y in pairs]
    one, nine = [1.0] * 100, [1.0] * 81 + [0.0] * 19
    assert 81 / math.sqrt(81) / math.sqrt(100) >= 0.9
    schema = "vec_id long, embedding array<double>, label int"
    got = {r["vec_id"]: r["n_links"] for r in EmbeddingDuplicates().transform(spark.createDataFrame([(k, [x * s for x in v], 0) for k, (v, s) in enumerate([(one, 1.0), (nine, 1.0), (one, 3.0), (nine, 7.0)])], schema)).collect()}
    assert got == {0: 3, 1: 3, 2: 3, 3: 3}
    twice = EmbeddingDuplicates().transform(spark.createDataFrame([(5, [1.0, 0.0], 0), (5, [1.0, 0.1], 0), (6, [0.0, 1.0], 0)], schema)).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in twice) == [(5, 1, 5), (5, 1, 5), (6, 0, 6)]
