from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
import corpus_pipeline
from check import TYPES, rows_of
from statloom.llm import packing, pii, queries
from tests.llm import plain

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(docs, no_labels, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    docs.write.parquet(str(path / "documents.parquet"))
    no_labels.coalesce(1).write.parquet(str(path / "labels.parquet"))
    return str(path)


def test_stages_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "minhash_near_dedup", "substring_dedup", "pii", "best_fit_packing"]


def test_every_stage_equals_brute_force(spark, folder, doc_rows, docs):
    """Each stage on its own input, as the stage before left it."""
    now = spark.read.parquet(f"{folder}/documents.parquet")
    texts = dict(doc_rows)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, folder)
        if name != "best_fit_packing":
            assert out.columns == docs.columns
            rows = {r["doc_id"]: r["text"] for r in out.collect()}
        if name == "quality_rules":
            assert rows == {d: t for d, t in texts.items() if not plain.statistics(t)[-1]}
        elif name == "minhash_near_dedup":
            assert rows == {d: texts[d] for d, (_, _, kept) in plain.near_duplicates(list(texts.items())).items() if kept}
        elif name == "substring_dedup":
            listed = list(texts.items())
            for (d, text), (n, gone, _) in zip(listed, plain.substrings(listed)):
                assert len(plain.WORD.findall(rows[d])) == n - gone and (gone or rows[d] == text)
        elif name == "pii":
            assert set(rows) == set(texts) and not any(any(plain.fixed_formats(t).values()) for t in rows.values())
        else:
            packed = out.collect()
            assert {r["doc_id"] for r in packed} == set(texts) and max(r["offset"] + r["length"] for r in packed) <= packing.CAPACITY
            break
        texts = rows
        path = f"{folder}/after-{name}"
        out.write.parquet(path)
        now = spark.read.parquet(path)


def test_run_equals_its_stages(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    assert rows and len({(r["doc_id"], r["piece"]) for r in rows}) == len(rows)


def test_registered():
    names = [q for q in contract.queries() if q.startswith("op") and q[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in contract.queries()


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="tables not present")
@pytest.mark.parametrize("name", [q for q in contract.queries() if q.startswith("op") and q[2].isdigit()])
def test_queries_run_over_whole_tables(spark, name):
    if name == "op12_filter_audit":  # all documents are kept or removed at the first step of each order
        frame = contract.queries()[name](spark, FOLDER).where("step = 1 AND filter_order = 'EDCBA'")
        assert sum(r["kept"] + r["removed"] for r in frame.collect()) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
        return
    table, key = {"op2": ("pages", "page_id"), "op6": ("embeddings", "vec_id")}.get(name.split("_")[0], ("documents", "doc_id"))
    frame = contract.queries()[name](spark, FOLDER)
    got = {r[0] for r in frame.select(key).collect()}
    assert got == {r[0] for r in spark.read.parquet(f"{FOLDER}/{table}.parquet").select(key).collect()}
    assert frame.columns and pii.KINDS


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="tables not present")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_sql(spark, name):
    duck = duckdb.connect()
    for file in sorted(Path(FOLDER).glob("*.parquet")):
        duck.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    frame = contract.queries()[name](spark, FOLDER)
    sql = contract.oracle_sql()[name]
    assert {c: TYPES[t] for c, t in frame.dtypes} == dict(row[:2] for row in duck.execute("DESCRIBE " + sql).fetchall())
    assert rows_of(frame.toPandas()) == rows_of(duck.execute(sql).df())
