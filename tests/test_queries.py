"""Every query against its statement in SQL, on the same tables."""

import os
from collections import Counter

import duckdb
import pytest

from auditlake.plans.catalogue import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle(sf):
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        at = f"{sf}/{name}.parquet"
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{at}/*.parquet')" if os.path.isdir(at) else f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{at}')")
    return db


def kinds(types):
    same = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}
    return {c: same[t] for c, t in types}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_sql(spark, sf, oracle, name):
    got = QUERIES[name](spark, sf)
    want = oracle.execute(ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert kinds(got.dtypes) == {d[0]: str(d[1]) for d in want.description}
    rows, expected = Counter(map(tuple, got.select(*columns).collect())), Counter(want.fetchall())
    assert list((rows - expected).items())[:5] == list((expected - rows).items())[:5] == []
    assert rows


def test_a_long_text_comes_back_whole(spark, tmp_path):
    text = " ".join(f"w{i % 1000}" for i in range(1_000_003)) + " end"
    spark.createDataFrame([(1, 0, text)], "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    [row] = QUERIES["inverted_index_text"](spark, str(tmp_path)).collect()
    assert row.text == text


def test_every_query_has_its_statement():
    assert set(QUERIES) == set(ORACLE_SQL)
