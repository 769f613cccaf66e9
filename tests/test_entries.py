"""The index of bigrams that a home keeps of its entries."""

from datetime import datetime, timezone

import pytest

from chronofold.engine import Engine
from chronofold.operators import lexical
from chronofold.sources.lake import ENTRY, Lake


@pytest.fixture
def home(spark, tmp_path):
    ids = iter(range(1000))
    return Engine(spark, f"file://{tmp_path}/home", clock=lambda: datetime(2024, 5, 1, tzinfo=timezone.utc), new_id=lambda: f"m{next(ids)}")


def rows(spark, first, count, month="04"):
    words = ["met", "the", "team", "wrote", "a", "report", "lunch", "again", ""]
    data = [(f"e{k}", f"2024-{month}-{1 + k % 28:02d}T00:00:00Z", " ".join(words[(k * j + j) % 9] for j in range(k % 5)), k) for k in range(first, first + count)]
    return spark.createDataFrame([(i, ts, t, None, None, o) for i, ts, t, o in data], "id string, ts string, text string, topic string, entity string, ord long")


def same(home, text, k):
    got = [(r["id"], r["score"]) for r in home._deep(text, k).collect()]
    want = [(r["id"], r["score"]) for r in lexical.deep_search(home.lake.episodic(), text, k, ENTRY).collect()]
    assert got == want
    return got


def test_index_and_what_came_since_equal_a_scan(spark, home):
    assert same(home, "the team", 3) == [] and home.lake.index_entries() == 0
    home.lake.append_entries(rows(spark, 0, 40))
    assert home.lake.index_entries() > 0 and home.lake.index_entries() == 0
    assert len(same(home, "wrote a report", 5)) == 5
    home.lake.append_entries(rows(spark, 40, 30, "05"))
    same(home, "wrote a report", 5)
    home.lake.index_entries()
    index, late = home.lake.entries_index()
    assert len(index.paths) == 2 and late.isEmpty()
    for text in ("wrote a report", "team", "x", "", "lunch again"):
        same(home, text, 7)
    home.compact()
    assert len(home.lake.entries_index()[0].paths) == 1
    same(home, "met the team", 100)


def test_an_entry_that_is_written_late_is_found(spark, home):
    home.lake.append_entries(rows(spark, 10, 5))
    home.lake.index_entries()
    home.lake.append_entries(rows(spark, 3, 2))  # places before those that the index knows
    assert {"e3", "e4"} <= {i for i, _ in same(home, "met the team wrote a report lunch again", 10)}


def test_of_two_that_index_one_counts(spark, home, monkeypatch):
    home.lake.append_entries(rows(spark, 0, 10))
    other, publish, raced = Lake(spark, home.lake.home), Lake._publish, []

    def late(self, number, content):
        if self is home.lake and not raced:
            raced.append(other.index_entries())
        return publish(self, number, content)

    monkeypatch.setattr(Lake, "_publish", late)
    assert home.lake.index_entries() == 0 and raced[0] > 0
    assert len(home.lake.entries_index()[0].paths) == 1
    same(home, "the team", 5)


def test_places_are_dealt_by_commits(spark, home, monkeypatch):
    home.lake.append_entries(rows(spark, 0, 3))
    home.log_write("one")
    with monkeypatch.context() as m:  # the last place is known, nothing is read
        m.setattr(Lake, "episodic", lambda self: pytest.fail("the log was read"))
        home.log_write("two")
    home.lake.append_entries(rows(spark, 20, 2))
    home.log_write("three")
    assert [r["ord"] for r in home.lake.episodic().orderBy("ord").collect()] == [0, 1, 2, 3, 4, 20, 21, 22]
