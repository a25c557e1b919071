from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from check import TYPES, rows_of
from statloom.operators import lookup, neighbors, tree
from statloom.plans import catalog
from statloom.plans.oracles import ORACLES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="tables not present")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in sorted(Path(FOLDER).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


NAMES = [query.__name__ for query in catalog.QUERIES]


def test_every_query_has_its_sql():
    assert set(NAMES) <= set(contract.queries())
    assert set(NAMES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(NAMES))
def test_query_equals_sql(spark, duck, name):
    frame = contract.queries()[name](spark, FOLDER)
    sql = contract.oracle_sql()[name]
    types = {c: TYPES[t] for c, t in frame.dtypes}
    assert types == dict(row[:2] for row in duck.execute("DESCRIBE " + sql).fetchall())
    assert rows_of(frame.toPandas()) == rows_of(duck.execute(sql).df())


LARGE_PATHS = [
    "set_of_words", "nb_score", "nb_stream_score", "local_words_error_rate", "knn_topk", "knn_scaled_error_rate",
    "bitmap_error_rate", "id3_nodes", "id3_classify",
]


@pytest.mark.parametrize("name", LARGE_PATHS)
def test_paths_for_large_tables_give_the_same(spark, duck, monkeypatch, name):
    """Nothing counts as small: no broadcast joins, hot keys apart, stored levels, cells and blocks."""
    monkeypatch.setattr(lookup, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(lookup, "HOT_KEYS", 20)
    monkeypatch.setattr(tree, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(tree, "DRIVER_NODES", 0)
    monkeypatch.setattr(tree, "COMPILED_NODES", 0)
    monkeypatch.setattr(neighbors, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(neighbors, "MAX_BLOCK_ROWS", 64)
    monkeypatch.setattr(neighbors, "COPY_COST", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        test_query_equals_sql(spark, duck, name)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_entry(spark):
    assert tuple(contract.entry(spark).first())[:2] == (18, 17)
