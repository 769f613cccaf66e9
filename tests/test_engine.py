"""Commands end to end on a temporary home."""

import json
from datetime import datetime, timedelta, timezone

import pytest

from chronofold import cli
from chronofold.engine import Engine, NotFound
from chronofold.sources import schemas
from chronofold.sources.lake import ModelMismatch, import_jsonl


@pytest.fixture
def engine(spark, tmp_path):
    state = {"t": datetime(2024, 5, 1, tzinfo=timezone.utc), "n": 0}

    def clock():
        return state["t"]

    def new_id():
        state["n"] += 1
        return f"m{state['n']}"

    made = Engine(spark, f"file://{tmp_path}/home", clock=clock, new_id=new_id)
    made.forward = lambda days: state.update(t=state["t"] + timedelta(days=days))
    return made


def test_write_recall_and_reinforce(engine):
    first = engine.remember("the cat sat on the mat", entity="pets", kind="fact")
    assert first["id"] == "m1" and first["active_claims"] == 1
    again = engine.remember("the cat sat on the mat", entity="pets", kind="fact")
    assert again["merged_into"] == "m1" and again["hits"] == 1
    assert [h["id"] for h in engine.recall("cat on the mat", 1)] == ["m1"]
    assert engine.recall("cat on the mat", 1)[0]["hits"] == 2
    row = engine.show("m1")
    assert (row["hits"], row["confidence"]) == (3, "mid")


def test_keys_supersede(engine):
    engine.remember("blue", key="colour")
    engine.remember("green", key="colour")
    assert [r["text"] for r in engine.query()] == ["green"]
    assert engine.show("m1")["status"] == "superseded"


def test_correct_restate_forget_restore(engine):
    engine.remember("one two three", key="k")
    engine.recall("one two three", 1)
    assert engine.restate("m1", "one two four")["hits"] == 1
    assert engine.correct("m2", "one two five")["hits"] == 0
    with pytest.raises(NotFound):
        engine.correct("m1", "no")
    with pytest.raises(ValueError):
        engine.correct("m3", "")
    engine.forget("m3")
    assert engine.query() == []
    engine.restore("m3")
    assert [r["id"] for r in engine.query()] == ["m3"]
    with pytest.raises(NotFound):
        engine.restore("m3")


def test_hard_forget_of_a_successor_and_of_a_predecessor(engine):
    engine.remember("first text", key="k")
    engine.correct("m1", "second text")
    engine.forget("m2", hard=True)
    assert [(r["id"], r["status"]) for r in engine.query(status="all")] == [("m1", "superseded")]
    engine.restore("m1")
    engine.correct("m1", "third text")
    engine.restore("m1")
    engine.forget("m1", hard=True)
    assert [(r["id"], r["text"]) for r in engine.query(status="all")] == [("m3", "third text")]


def test_episodic_profile_and_status(engine):
    engine.log_write("met the team", topic="work")
    engine.forward(1)
    engine.log_write("wrote the report", topic="work")
    assert len(engine.log_query(topic="work")) == 2
    assert [r["text"] for r in engine.log_query(since="2024-05-02", until="2024-05-02")] == ["wrote the report"]
    engine.remember("likes tea", kind="taste", confidence="high")
    deep = engine.recall("wrote the report", 1, deep=True)
    assert deep[-1]["layer"] == "episodic"
    assert engine.profile(write=True)["items"][0]["text"] == "likes tea"
    got = engine.status()
    assert got["active_claims"] == 1 and got["total_claims"] == 1
    assert got["profile"]["exists"] and got["profile"]["count"] == 1 and got["profile"]["updated"].endswith("Z")
    item = engine.context("tea", 100)["items"][0]
    assert item["text"] == "likes tea" and {"kind", "entity"} <= set(item)


def test_sleep(engine):
    for k, text in enumerate(["alpha beta gamma", "alpha beta gamma!", "quite another thing"]):
        engine.remember(text, key=f"k{k}", entity="e")
    engine.log_write("alpha beta gamma again")
    seen = engine.sleep(dry_run=True, review=0.5, merge=0.9)
    assert [c["entity"] for c in seen["merge_suggestions"]] == ["e"] and len(seen["near_duplicates"]) == 1
    assert {"id", "text", "kept_text", "merged_text", "kept", "merged", "score"} >= set(seen["near_duplicates"][0])
    assert not engine.lake.exists(engine.lake.path("vectors"))  # a dry run writes nothing
    assert len(engine.query()) == 3
    assert seen["episodic_candidates"][0]["best_match"]["id"] in ("m1", "m2") and seen["episodic_candidates"][0]["best_match"]["entity"] == "e"
    assert cli.pretty(seen).startswith("# preview: ")
    done = engine.sleep(review=0.5, merge=0.9)
    assert done["applied"]["merged"] == 1 and len(engine.query()) == 2
    assert json.loads(engine.lake.read_text(done["report_file"]))["applied"] == done["applied"]
    engine.forward(100)
    assert engine.sleep()["applied"]["forgotten"] == 2


def test_other_model_is_refused(engine):
    engine.remember("some text", key="k")
    engine.reindex()
    engine.provider.name = "another"
    with pytest.raises(ModelMismatch):
        engine.recall("some text")
    assert "error" in engine.status()["index"]


def test_cli(engine, capsys):
    assert cli.main(["query"], engine) == 2
    assert cli.main(["remember", "hello world", "--key", "k"], engine) == 0
    assert json.loads(capsys.readouterr().out.strip().split("\n")[-1])["id"] == "m1"
    assert cli.main(["--pretty", "show", "m1"], engine) == 0
    assert cli.main(["show", "nothing"], engine) == 1
    with pytest.raises(SystemExit) as e:
        cli.main(["no-such-command"], engine)
    assert e.value.code == 2


def test_import_of_json_lines(spark, tmp_path):
    path = tmp_path / "log.jsonl"
    path.write_text('{"op": "assert", "id": "a", "text": "x y", "mood": "fine"}\n\n{bad\n{"op": "touch", "target": "a", "ts": "t"}\n', encoding="utf-8")
    got = import_jsonl(spark, str(path)).orderBy("seq").collect()
    assert [(r["seq"], r["op"], r["extra"]) for r in got] == [(0, "assert", '{"mood":"fine"}'), (3, "touch", None)]
    assert got[0]["text"] == "x y"
    with pytest.raises(Exception, match="malformed"):
        import_jsonl(spark, str(path), strict=True).collect()


def test_import_numbers_lines_over_files(spark, tmp_path):
    for name, ids in (("a.jsonl", "pqr"), ("b.jsonl", "st")):
        (tmp_path / name).write_text("\n".join(f'{{"op": "assert", "id": "{i}", "text": "x\u2028y"}}' for i in ids) + "\n", encoding="utf-8")
    got = import_jsonl(spark, str(tmp_path)).orderBy("seq").collect()
    assert [(r["seq"], r["id"]) for r in got] == list(enumerate("pqrst"))


@pytest.mark.parametrize("wait", [1, 12, 1000])
def test_streamed_replay_equals_batch(spark, tmp_path, wait):
    """Batches whose rows come late by less than the wait; what a batch doesn't change isn't sent again."""
    from chronofold.streaming.replay_stream import STORE, replay_stream
    from tests.test_replay import folded, frame, whole, wild_log

    ops = wild_log(9, length=120)
    rows = ops if wait == 1 else sorted(ops, key=lambda o: (o["seq"] + (9 if o["seq"] % 5 == 0 else 0), o["seq"]))
    folder, seen, sent = str(tmp_path / "in"), {}, []
    old = spark.conf.get(STORE[0], None)
    spark.conf.set(*STORE)

    def take(df, _):
        got = whole(df)
        assert all(seen.get(k) != v for k, v in got.items())
        seen.update(got)
        sent.append(len(got))

    try:
        for k in range(3):
            frame(spark, rows[len(rows) * k // 3 : len(rows) * (k + 1) // 3]).coalesce(1).write.mode("append").parquet(folder)
            query = replay_stream(spark.readStream.schema(schemas.OPLOG).parquet(folder), wait).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(take).trigger(availableNow=True).start()
            query.awaitTermination()
    finally:
        spark.conf.set(STORE[0], old) if old else spark.conf.unset(STORE[0])
    assert seen == folded(ops) and len(sent) == 3


class _Kept(dict):
    """A keyed state in memory that counts what is read."""

    def __init__(self):
        super().__init__()
        self.reads = 0

    def containsKey(self, key):
        self.reads += 1
        return key in self

    def getValue(self, key):
        return self[key]

    def updateValue(self, key, value):
        self[key] = value

    def removeKey(self, key):
        del self[key]

    def iterator(self):
        return iter(list(self.items()))


class _One:
    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def test_a_batch_reads_only_the_claims_it_names():
    import pandas as pd

    from chronofold.streaming.replay_stream import _NAMES, _Replay

    class Handle:
        def getMapState(self, *_):
            return _Kept()

        def getValueState(self, *_):
            return _One()

    table = lambda ops: pd.DataFrame([{n: o.get(n) for n in _NAMES} for o in ops]).astype(object)
    made = _Replay(wait=10)
    made.init(Handle())
    list(made.handleInputRows(("a",), iter([table([{"seq": k, "op": "assert", "id": f"c{k}", "text": "t", "lineage_id": "a"} for k in range(3000)])]), None))
    reads = []
    for batch in range(20):
        made.claims.reads = 0
        ops = [{"seq": 3000 + 5 * batch + k, "op": "touch", "target": f"c{7 * batch + k}", "ts": "s", "lineage_id": "a"} for k in range(5)]
        (got,) = made.handleInputRows(("a",), iter([table(ops)]), None)
        assert sorted(got["id"]) == sorted(o["target"] for o in ops) and set(got["hits"]) == {1}
        reads.append(made.claims.reads)
    assert max(reads[2:]) <= 3 * 15 and len(made.waiting) == 10
    with pytest.raises(ValueError, match="late"):
        list(made.handleInputRows(("a",), iter([table([{"seq": 3000, "op": "forget", "target": "c1", "lineage_id": "a"}])]), None))


def test_consolidation_collects_no_rows(engine, spark, monkeypatch):
    """Only counts reach the driver, however many claims are clustered, forgotten, merged and reviewed."""
    from pyspark.sql.classic.dataframe import DataFrame

    words = spark.range(60).selectExpr("concat('w', id) AS id", "concat('same words here ', id % 30) AS text", "'e' AS entity", "concat('k', id) AS key", "id AS n")
    engine.remember_all(words, ["n"])
    engine.forward(100)
    most, collect = [], DataFrame.collect

    def counted(self):
        rows = collect(self)
        most.append(len(rows))
        return rows

    monkeypatch.setattr(DataFrame, "collect", counted)
    report, parts = engine.consolidate(review=0.5, merge=0.99)
    assert sorted(most)[-2] < 10  # beside the sample of vectors that pivots are chosen from, which is bounded
    monkeypatch.undo()
    assert report["applied"]["forgotten"] == 60 and report["applied"]["merged"] >= 30
    assert parts["merge_suggestions"].count() == 60 and parts["review_pairs"].count() > 100 and "tables" in json.loads(engine.lake.read_text(report["report_file"]))
