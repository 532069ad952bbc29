from collections import Counter
from pathlib import Path

import pytest

import __spark_entry__ as entry
from chatlake.plans import core

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings mapping parsed thread_meta manifest raw_records eval_items".split()

pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def db():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_query_equals_its_sql(spark, db, name):
    df = core.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    result = db.execute(core.SQL[name])
    names = [x[0] for x in result.description]
    assert sorted(names) == columns
    want = Counter(tuple(dict(zip(names, r))[c] for c in columns) for r in result.fetchall())
    assert Counter(tuple(r[c] for c in columns) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.SQL)))
def test_query_without_sql_runs(spark, name):
    assert core.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_does_not_import_the_llm_folder():
    for p in Path(core.__file__).parents[1].rglob("*.py"):
        if "llm" not in p.parts:
            assert "chatlake.llm" not in p.read_text("utf-8"), p
