"""Replay against an independent fold, on random logs and on cases made by hand."""

import json
import random

import pandas as pd
import pytest

from chronofold.operators import replay as module
from chronofold.operators.replay import fold, replay, with_lineage
from chronofold.sources import schemas
from chronofold.sources.lake import import_jsonl

NAMES = [x.split()[0] for x in schemas.OPLOG.split(", ")]


def frame(spark, ops):
    return spark.createDataFrame([tuple(o.get(n) for n in NAMES) for o in ops], schemas.OPLOG)


def model(ops):
    """State by id, in the plainest form."""
    out = {}
    for o in ops:
        t = out.get(o.get("target"))
        if o["op"] == "assert":
            out[o["id"]] = {"text": o["text"], "created": o["created"], "hits": o.get("hits") or 0, "last": None, "conf": o.get("confidence"), "status": "active"}
        elif t is None:
            pass
        elif o["op"] == "supersede":
            if o.get("text"):
                new = dict(t, text=o["text"], status="active")
                if not o.get("carry"):
                    new.update(created=o["ts"], hits=0, last=None)
                out[o["new_id"]] = new
            t["status"] = "superseded"
        elif o["op"] == "forget":
            t["status"] = "forgotten"
        elif o["op"] == "restore":
            t["status"] = "active"
        elif o["op"] == "touch":
            if t["status"] == "active":
                t["hits"] += 1
                t["last"] = o["ts"]
        elif o["op"] == "confidence":
            t["conf"] = o["to"]
    return {k: (v["text"], v["created"], v["hits"], v["last"], v["conf"], v["status"]) for k, v in out.items()}


def random_log(seed, lineages=6, length=30):
    rng, ops, seq = random.Random(seed), [], 0
    for g in range(lineages):
        root = f"g{g}"
        ids = [root]
        ops.append({"seq": seq, "op": "assert", "id": root, "text": f"t{seq}", "created": f"d{seq}", "confidence": "low", "hits": 0, "lineage_id": root})
        for _ in range(length):
            seq += 1
            kind = rng.choice(["touch", "touch", "supersede", "supersede", "forget", "restore", "confidence", "other"])
            o = {"seq": seq, "op": kind, "target": rng.choice([*ids, "ghost"]), "ts": f"s{seq}", "lineage_id": root}
            if kind == "supersede":
                o |= {"text": rng.choice([f"t{seq}", f"t{seq}", "", None]), "carry": rng.choice([True, False, None]), "new_id": f"n{seq}"}
                if o["text"] and o["target"] != "ghost":
                    ids.append(o["new_id"])
            if kind == "confidence":
                o["to"] = rng.choice(["mid", "high"])
            ops.append(o)
        seq += 1
    return ops


def state(df):
    return {r["id"]: (r["text"], r["created"], r["hits"], r["last_accessed"], r["confidence"], r["status"]) for r in df.collect()}


def folded(ops):
    """The row-by-row fold over the whole log."""
    rows = fold(pd.DataFrame([{n: o.get(n) for n in NAMES} for o in ops]).astype(object)).to_dict("records") if ops else []
    return {r["id"]: tuple(None if x != x else x for x in (r["text"], r["created"], r["hits"], r["last_accessed"], r["confidence"], r["status"], r["birth_seq"], r["key"], r["entity"])) for r in rows}


def whole(df):
    return {r["id"]: (r["text"], r["created"], r["hits"], r["last_accessed"], r["confidence"], r["status"], r["birth_seq"], r["key"], r["entity"]) for r in df.collect()}


def wild_log(seed, length=220, names=9):
    """Few names: claims are born again, by themselves, by unknown targets and by chains of such."""
    rng, ops = random.Random(seed), []
    for k in range(length):
        seq, name = 3 * k + rng.randrange(3), lambda: f"c{rng.randrange(names)}"  # noqa: B023
        kind = rng.choice(["assert"] + ["supersede"] * 4 + ["touch"] * 4 + ["forget", "restore", "restore", "confidence", "other"])
        o = {"seq": seq, "op": kind, "ts": rng.choice([f"s{seq}", None]), "lineage_id": "one"}
        if kind == "assert":
            if rng.random() < 0.6 and k > 20:
                continue
            o |= {"id": name(), "text": f"t{seq}", "created": f"d{seq}", "confidence": rng.choice(["low", None]), "hits": rng.choice([None, 0, 4]), "last_accessed": rng.choice([None, "x"]), "key": f"k{seq}", "entity": f"e{seq % 3}"}
        else:
            o["target"] = rng.choice([name(), name(), name(), f"ghost{rng.randrange(3)}", None])
        if kind == "supersede":
            o |= {"text": rng.choice([f"t{seq}", f"t{seq}", "", None]), "carry": rng.choice([True, False, None]), "new_id": rng.choice([name(), name(), f"n{seq}", f"ghost{rng.randrange(3)}", "", None])}
        if kind == "confidence":
            o["to"] = rng.choice(["mid", "high", None])
        ops.append(o)
    return ops


def test_replay_equals_model(spark):
    ops = random_log(1)
    assert state(replay(frame(spark, ops))) == model(ops)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_replay_equals_fold(spark, seed):
    ops = wild_log(seed)
    assert whole(replay(frame(spark, ops))) == folded(ops)


@pytest.mark.parametrize("seed", [4, 5, 6])
def test_ranges_compose(spark, seed, monkeypatch):
    monkeypatch.setattr(module, "RANGE", 40)
    ops = wild_log(seed, length=300, names=3)
    assert whole(replay(frame(spark, ops), hot=25)) == folded(ops)


def test_one_claim_spreads_over_tasks(spark):
    """A claim with nearly all operations: no task orders more than a range of them, and the state is that of the fold."""
    n = 60_000
    log = spark.range(1, n).selectExpr(
        "id AS seq", "'one' AS lineage_id", "CASE WHEN id % 997 = 0 THEN 'forget' WHEN id % 997 = 5 THEN 'restore' WHEN id % 5000 = 3 THEN 'confidence' ELSE 'touch' END AS op", "'c' AS target", "concat('s', id) AS ts", "concat('l', id) AS `to`"
    )
    for name in NAMES:
        if name not in log.columns:
            log = log.selectExpr("*", f"CAST(NULL AS {'boolean' if name in ('carry', 'hard') else 'long' if name == 'hits' else 'string'}) AS `{name}`")
    born = frame(spark, [{"seq": 0, "op": "assert", "id": "c", "text": "t", "created": "d", "confidence": "low", "lineage_id": "one"}])
    log = born.unionByName(log)
    crowded = spark.createDataFrame([("c", True)], "of string, hot boolean")
    marks = module._marks(log, module._births(log), crowded, module.RANGE)
    assert marks.where("last").count() == -(-n // module.RANGE)
    plan = marks._jdf.queryExecution().executedPlan().toString()
    assert "Pandas" not in plan and "Python" not in plan
    (row,) = replay(log, hot=1000).collect()
    hits, last, conf, live = 0, None, "low", True
    for k in range(1, n):
        if k % 997 in (0, 5):
            live = k % 997 == 5
        elif k % 5000 == 3:
            conf = f"l{k}"
        elif live:
            hits, last = hits + 1, f"s{k}"
    assert (row["hits"], row["last_accessed"], row["confidence"], row["status"]) == (hits, last, conf, "active" if live else "forgotten")


def chain(n, ghost=False):
    ops = [] if ghost else [{"seq": 0, "op": "assert", "id": "c0", "text": "t0", "created": "d", "confidence": "low"}]
    return ops + [{"seq": k, "op": "supersede", "target": f"c{k - 1}", "new_id": f"c{k}", "text": f"t{k}", "carry": True, "ts": f"s{k}"} for k in range(1, n + 1)]


def test_a_chain_of_restatements(spark, monkeypatch):
    rounds, plain = [], module.materialize
    monkeypatch.setattr(module, "materialize", lambda df: rounds.append(1) or plain(df))
    log = frame(spark, chain(10_000))
    named = with_lineage(log)
    assert len(rounds) <= 4 + 2 * 8
    assert {tuple(r) for r in named.select("lineage_id").distinct().collect()} == {("c0",)}
    rounds.clear()
    got = replay(log).where("status = 'active'").collect()
    assert len(rounds) <= 4 + 8
    assert [(r["id"], r["created"], r["lineage_id"], r["birth_seq"]) for r in got] == [("c10000", "d", "c0", 10_000)]


def test_an_import_follows_chains_once_and_numbers_lines_in_their_splits(spark, tmp_path, monkeypatch):
    rounds, plain = [], module.materialize
    monkeypatch.setattr(module, "materialize", lambda df: rounds.append(1) or plain(df))
    ops = [{k: v for k, v in o.items() if k != "seq"} for o in chain(300)]
    (tmp_path / "log.jsonl").write_text("\n".join(map(json.dumps, ops)) + "\n\n", encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        log = import_jsonl(spark, f"file://{tmp_path}/log.jsonl")
        named = with_lineage(log)
        assert log.rdd.getNumPartitions() > 10
        assert "row_number" not in log._jdf.queryExecution().toString()
        got = sorted((r["seq"], r["target"], r["lineage_id"]) for r in named.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rounds) <= 4 + 6
    assert got == [(0, None, "c0")] + [(k, f"c{k - 1}", "c0") for k in range(1, 301)]


def test_a_chain_from_nowhere(spark):
    ops = chain(500, ghost=True) + [{"seq": 900, "op": "assert", "id": "c3", "text": "late", "created": "d"}]
    assert {r["id"]: r["text"] for r in replay(frame(spark, ops)).collect()} == {"c3": "late"}
    named = with_lineage(frame(spark, ops))
    assert named.where("lineage_id IS NOT NULL").count() == 2  # the assert, and what names it as target


def test_lineage_is_found(spark):
    ops = random_log(3, lineages=3, length=12)
    bare = [{k: v for k, v in o.items() if k != "lineage_id"} for o in ops]
    named = with_lineage(frame(spark, bare)).select(*NAMES)
    assert state(replay(named)) == model(ops)


def test_empty_log(spark):
    assert replay(frame(spark, [])).count() == 0


def test_repeated_assert_keeps_its_place(spark):
    ops = [{"seq": k, "op": "assert", "id": "a", "text": f"t{k}", "created": "d", "lineage_id": "a"} for k in range(2)]
    (row,) = replay(frame(spark, ops)).collect()
    assert (row["text"], row["birth_seq"]) == ("t1", 0)


@pytest.mark.parametrize("carry,expected", [(True, (2, "s2", "d")), (False, (0, None, "s3"))])
def test_inheritance(spark, carry, expected):
    ops = [{"seq": 0, "op": "assert", "id": "a", "text": "t", "created": "d", "confidence": "low", "lineage_id": "a"}]
    ops += [{"seq": k, "op": "touch", "target": "a", "ts": f"s{k}", "lineage_id": "a"} for k in (1, 2)]
    ops += [{"seq": 3, "op": "supersede", "target": "a", "text": "u", "new_id": "b", "carry": carry, "ts": "s3", "lineage_id": "a"}]
    got = {r["id"]: r for r in replay(frame(spark, ops)).collect()}
    assert (got["b"]["hits"], got["b"]["last_accessed"], got["b"]["created"]) == expected
    assert (got["a"]["status"], got["b"]["status"], got["b"]["confidence"]) == ("superseded", "active", "low")
