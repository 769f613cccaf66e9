"""Commits, snapshots, imports and the upkeep of the index."""

import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from chronofold import cli
from chronofold.engine import Engine
from chronofold.operators.replay import replay
from chronofold.sources.lake import Lake
from tests.test_replay import frame, wild_log, whole


@pytest.fixture
def home(tmp_path):
    return f"file://{tmp_path}/home"


def made(spark, home, **kw):
    ids = iter(range(1, 100))
    return Engine(spark, home, clock=lambda: datetime(2024, 5, 1, tzinfo=timezone.utc), new_id=lambda: f"m{next(ids)}", **kw)


def op(seq, **kw):
    return {"seq": seq, "op": "assert", "id": f"c{seq}", "text": f"t{seq}", "created": "2024-01-01T00:00:00Z", "lineage_id": f"c{seq}"} | kw


@pytest.mark.parametrize("seed,cut", [(11, 200), (12, 420)])
def test_a_base_and_what_follows_it(spark, seed, cut):
    log = frame(spark, wild_log(seed))
    base = replay(log.where(F.col("seq") < cut))
    assert whole(replay(log.where(F.col("seq") >= cut), base)) == whole(replay(log))


def test_a_rewrite_that_dies_loses_nothing(spark, home, monkeypatch):
    lake = Lake(spark, home)
    lake.append_log(frame(spark, [op(k) for k in range(5)]))
    for step in ("_write_log", "_publish"):
        with monkeypatch.context() as m:
            m.setattr(Lake, step, lambda *a, **k: (_ for _ in ()).throw(RuntimeError("the driver is gone")))
            with pytest.raises(RuntimeError):
                lake.rewrite_ops(lake.oplog().where("seq <> 2"), lake.commits()[1])
        assert [r["seq"] for r in Lake(spark, home).oplog().orderBy("seq").collect()] == list(range(5))
    with monkeypatch.context() as m:
        m.setattr(Lake, "drop", lambda *a: (_ for _ in ()).throw(RuntimeError("gone before the old files are deleted")))
        with pytest.raises(RuntimeError):
            lake.rewrite_ops(lake.oplog().where("seq <> 2"), lake.commits()[1])
    assert [r["seq"] for r in Lake(spark, home).oplog().orderBy("seq").collect()] == [0, 1, 3, 4]


def test_two_writers_get_different_places(spark, home, monkeypatch):
    one, two = Lake(spark, home), Lake(spark, home)
    publish, raced = Lake._publish, []

    def late(self, number, content):
        if self is one and not raced:  # the other writer commits while the first has its data written, not published
            raced.append(number)
            two.append_ops([{"op": "assert", "id": "b", "text": "two"}], "now")
        return publish(self, number, content)

    monkeypatch.setattr(Lake, "_publish", late)
    one.append_ops([{"op": "assert", "id": "a", "text": "one"}, {"op": "touch", "target": "a"}], "now")
    rows = one.oplog().orderBy("seq").collect()
    assert [(r["seq"], r["op"], r["id"]) for r in rows] == [(0, "assert", "b"), (1, "assert", "a"), (2, "touch", None)]
    assert one.table("audit", "ts string, action string, detail string").count() == 3
    with pytest.raises(ValueError):
        one.append_log(frame(spark, [op(1)]))


def test_a_rewrite_keeps_what_came_meanwhile(spark, home):
    lake = Lake(spark, home)
    lake.append_log(frame(spark, [op(k) for k in range(4)]))
    _, seen = lake.commits()
    lake.append_log(frame(spark, [op(4)]))
    lake.rewrite_ops(lake.oplog(content=seen).where("seq > 0"), seen)
    assert [r["seq"] for r in lake.oplog().orderBy("seq").collect()] == [1, 2, 3, 4]


def test_places_of_a_frame_follow_its_order(spark, home):
    lake = Lake(spark, home)
    lake.append_ops([{"op": "assert", "id": "first", "text": "x"}], "now")
    ops = spark.range(1000).select(F.lit("touch").alias("op"), F.concat(F.lit("c"), F.col("id")).alias("target"), (-F.col("id")).alias("o")).repartition(7)
    assert lake.append_frame(ops.orderBy("o").drop("o"), "now") == 1000
    assert lake.append_frame(ops.where("false").drop("o"), "now") == 0
    got = lake.oplog(after=0).orderBy("seq").collect()
    assert [(r["seq"], r["target"]) for r in got] == [(1 + k, f"c{999 - k}") for k in range(1000)]
    assert lake.table("audit", "ts string, action string, detail string").where("action = 'touch'").count() == 1000


def test_import_compact_and_go_on(spark, home, tmp_path, capsys):
    path = tmp_path / "log.jsonl"
    lines = [{"op": "assert", "id": "a", "text": "x", "created": "2024-01-01T00:00:00Z", "hits": 0}, {"op": "supersede", "target": "a", "new_id": "b", "text": "y", "carry": True, "ts": "t"}, {"op": "touch", "target": "b", "ts": "2024-02-01T00:00:00Z"}]
    path.write_text("\n".join(map(json.dumps, lines)) + "\n", encoding="utf-8")
    engine = made(spark, home)
    engine.remember("there before", key="k")
    assert cli.main(["import", str(path)], engine) == 0 and json.loads(capsys.readouterr().out)["imported"] == 3
    assert cli.main(["compact"], engine) == 0 and json.loads(capsys.readouterr().out)["compacted"] == 2
    number, content = engine.lake.commits()
    assert len(content["log"]) == 1 and content["snapshot"]["last"] == 3
    engine.restate("b", "z")
    assert len(engine.lake.commits()[1]["log"]) == 2
    assert engine.lake.oplog(after=3).count() == 1  # the folder of the tail only
    assert len(engine.lake.oplog(after=3).inputFiles()) == 1
    got = {r["id"]: (r["text"], r["hits"], r["status"], r["lineage_id"]) for r in made(spark, home).claims().collect()}
    assert got == {"m1": ("there before", 0, "active", "m1"), "a": ("x", 0, "superseded", "a"), "b": ("y", 1, "superseded", "a"), "m2": ("z", 1, "active", "a")}


def test_a_view_is_replayed_once_per_commit(spark, home, monkeypatch):
    from chronofold import engine as module

    runs, plain = [], module.replay
    monkeypatch.setattr(module, "replay", lambda *a: runs.append(1) or plain(*a))
    engine = made(spark, home)
    engine.remember("one text", entity="e")
    runs.clear()
    engine.remember("one text", entity="e")
    assert len(runs) <= 2
    engine.query(), engine.show("m1"), engine.profile()
    assert len(runs) <= 2


def test_a_command_replays_only_what_it_added(spark, home, monkeypatch):
    from chronofold import engine as module

    sizes, plain = [], module.replay
    monkeypatch.setattr(module, "replay", lambda log, *a: sizes.append(log.count()) or plain(log, *a))
    monkeypatch.setattr(module, "LAYERS", 3, raising=False)
    engine = made(spark, home)
    for k in range(3):
        engine.remember(f"text {k}", key=f"k{k}")
    engine.restate("m1", "again")
    engine.touch(["m4", "m2"])
    engine.remember("new", key="k1")
    engine.forget("m4")
    engine.restore("m4")
    names = ("id", "text", "status", "hits", "birth_seq", "lineage_id")
    state = lambda e: sorted(tuple(r[n] for n in names) for r in e.claims().collect())
    got = state(engine)
    assert max(sizes) <= 2 and sum(sizes) <= engine.lake.oplog().count()
    assert got == state(made(spark, home))
    engine.forget("m3", hard=True)
    assert state(engine) == state(made(spark, home)) == [r for r in got if r[0] != "m3"]
    made(spark, home).compact()
    assert state(engine) == [r for r in got if r[0] != "m3"]


class Counting:
    name = "counting"

    def __init__(self, folder):
        self.folder = folder

    def __call__(self, texts):
        with open(f"{self.folder}/embedded", "a") as f:
            f.write("x\n" * len(texts))
        return [[float(len(t)), 1.0] for t in texts]


def test_the_index_is_kept_up(spark, home, tmp_path):
    engine = made(spark, home, provider=Counting(str(tmp_path)))
    count = lambda: len((tmp_path / "embedded").read_text().split()) if (tmp_path / "embedded").exists() else 0
    for k in range(3):
        engine.remember(f"text {k}", key=f"k{k}")
    assert engine.reindex() == 3 and count() == 3
    assert engine.reindex() == 3 and count() == 3  # nothing is embedded again
    engine.correct("m1", "another text")
    assert engine.status()["index"]["count"] == 2  # the retired claim's vector doesn't count
    assert engine.reindex() == 3 and count() == 4
    assert engine.lake.vectors("counting").count() == 3
    assert engine.status()["index"]["count"] == 3
