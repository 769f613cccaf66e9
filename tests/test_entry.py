"""The driver's contract, with and without the training-data operators."""

import os
import subprocess
import sys

import pytest

from chronofold.plans import queries as plans

SF = "/root/testdata/sf0.001"


def test_names_match():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(plans.QUERIES) <= set(e.oracle_sql())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query_equals_sql(spark, name):
    import duckdb

    import __spark_entry__ as e

    got = e.queries()[name](spark, SF)
    con = duckdb.connect()
    for t in ("customer", "orders", "events", "documents", "embeddings", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    names = sorted(got.columns)
    want = con.sql(f"SELECT {', '.join(chr(34) + n + chr(34) for n in names)} FROM ({e.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in got.select(*names).collect()))) == sorted(map(repr, want))


def test_imports_without_the_operators(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import sys; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'pipeline' not in e.queries(); assert 'recall_topk' in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
