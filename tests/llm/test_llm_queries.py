from collections import Counter
from pathlib import Path

import pytest

from chatlake.llm import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for t in ("mapping", "parsed", "documents", "eval_items"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = queries.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    result = db.execute(queries.SQL[name])
    names = [x[0] for x in result.description]
    assert sorted(names) == columns
    want = Counter(tuple(dict(zip(names, r))[c] for c in columns) for r in result.fetchall())
    assert Counter(tuple(r[c] for c in columns) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_without_sql_runs(spark, name):
    assert queries.QUERIES[name](spark, DATA).count() > 0
