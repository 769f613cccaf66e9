"""Many writes at once against one remember() after the other."""

import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from chronofold.engine import Engine
from chronofold.operators import writes

FIELDS = "n long, id string, text string, key string, kind string, entity string, confidence string"


def engine(spark, path):
    return Engine(spark, f"file://{path}", clock=lambda: datetime(2024, 5, 1, tzinfo=timezone.utc))


def one_by_one(rows, start):
    """What the calls leave behind, in a dict of claims: keyed writes first, then those without a key, each in order."""
    claims = {i: dict(c) for i, c in start.items()}
    rows = sorted((r for r in rows if r[2]), key=lambda r: (r[0], r[2], r[1]))
    for n, i, text, key, kind, entity, level in (r for r in rows if r[3]):
        for c in claims.values():
            if c["key"] == key and c["status"] == "active":
                c["status"] = "superseded"
        claims[i] = {"text": text, "key": key, "kind": kind, "entity": entity, "status": "active", "confidence": level or "low", "hits": 0}
    for n, i, text, key, kind, entity, level in (r for r in rows if not r[3]):
        same = [c for c in claims.values() if c["status"] == "active" and (c["text"], c["kind"] or "", c["entity"] or "") == (text, kind or "", entity or "")]
        if not same:
            claims[i] = {"text": text, "key": key, "kind": kind, "entity": entity, "status": "active", "confidence": level or "low", "hits": 0}
            continue
        c = same[0]
        c["hits"] += 1
        earned = "high" if c["hits"] >= 8 else "mid" if c["hits"] >= 3 else "low"
        c["confidence"] = max(c["confidence"], earned, key=["low", "mid", "high"].index)
    return claims


@pytest.mark.parametrize("seed", [1, 2])
def test_random_writes_equal_single_ones(spark, tmp_path, seed):
    rnd, made, claims = random.Random(seed), engine(spark, tmp_path), {}
    for batch in range(2):
        rows = [
            (rnd.randrange(40), f"w{batch}_{k}", rnd.choice(["red", "green", "blue and red", "", None]), rnd.choice([None, None, "", "a", "b"]), rnd.choice([None, "", "fact"]), rnd.choice(["e", None]), rnd.choice([None, "mid"]))
            for k in range(60)
        ]
        made.remember_all(spark.createDataFrame(rows, FIELDS).repartition(3), ["n"], near=False)
        claims = one_by_one(rows, claims)
    got = {r["id"]: r for r in made.claims().collect()}
    assert set(got) == set(claims)
    for i, c in claims.items():
        assert {n: got[i][n] for n in ("text", "key", "kind", "entity", "status", "confidence", "hits")} == c, i


def test_similar_texts_touch_the_claim(spark, tmp_path):
    made = engine(spark, tmp_path)
    made.remember("the cat sat on the mat in the sun", kind="fact")
    rows = [("the  cat sat on the mat in the sun", "fact"), ("something else altogether", "fact"), ("The cat sat on the mat in the sun", "fact")]
    made.remember_all(spark.createDataFrame(rows, "text string, kind string"), ["text"])
    assert sorted((r["text"], r["hits"]) for r in made.claims().collect()) == [("something else altogether", 0), ("the cat sat on the mat in the sun", 2)]


def test_empty_tables_and_a_first_write_with_vectors(spark, tmp_path):
    made = engine(spark, tmp_path)
    none = spark.createDataFrame([], "text string, key string")
    assert made.remember_all(none, ["text"])["operations"] == 0 and made.query() == []
    assert made.remember_all(spark.createDataFrame([("a b c", None)], none.schema), ["text"])["active_claims"] == 1
    assert len(made.query()[0]["id"]) == 32


def test_audit_and_order(spark, tmp_path):
    made = engine(spark, tmp_path)
    rows = [(k, f"w{k}", f"text {k}", "k", None, None, None) for k in range(5)]
    made.remember_all(spark.createDataFrame(rows, FIELDS), ["n"])
    log = made.lake.oplog().orderBy("seq").collect()
    assert [r["op"] for r in log] == ["assert"] * 5 + ["supersede"] * 4
    assert [r["id"] for r in log[:5]] == [f"w{k}" for k in range(5)]
    assert made.lake.table("audit", "action string").count() == 9


def test_latest_and_copies_with_ties_nulls_and_repeats(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "x"), ("a", 2, "y"), ("a", 2, "y"), (None, 5, "x"), ("b", None, "z")], "k string, n int, v string")
    assert sorted(map(tuple, writes.latest_by_key(rows, ["k"], ["n", "v"]).collect()), key=repr) == [("a", 2, "y"), ("b", None, "z"), (None, 5, "x")]
    found = writes.copies(rows, F.col("v"), "n").collect()
    assert sorted(map(tuple, found)) == [("x", 1, 3), ("y", 2, 2), ("z", None, 1)]
    assert writes.copies(rows.limit(0), F.col("v"), "n").collect() == []


def test_texts_travel_once_and_stay_with_their_writes(spark, tmp_path, monkeypatch):
    made, sorted_columns = engine(spark, tmp_path), []
    plain = made.lake.append_frame
    monkeypatch.setattr(made.lake, "append_frame", lambda ops, *a: sorted_columns.extend(f.simpleString() for f in ops.schema) or plain(ops, *a))
    texts = {f"w{k}": f"{k} " + "the same long text again " * 200 for k in range(200)}
    rows = [(k // 2, i, t, "k" if k % 3 == 0 else None, None, None, None) for k, (i, t) in enumerate(texts.items())]
    made.remember_all(spark.createDataFrame(rows, FIELDS).repartition(4), ["n"], near=False)
    assert sorted_columns and not any(c.startswith("text:") for c in sorted_columns)
    assert made.lake.log_bytes() + made.lake.size(made.lake.path("audit")) < sum(map(len, texts.values())) / 4
    assert {r["id"]: r["text"] for r in made.claims().collect()} == texts
    assert sorted(r["seq"] for r in made.lake.oplog().collect()) == list(range(200 + 66))
    audit = made.lake.table("audit", "action string, detail string").where("action = 'assert'")
    assert {r[0] for r in audit.select(F.get_json_object("detail", "$.text")).collect()} == set(texts.values())
