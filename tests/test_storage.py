import pytest
from pyspark.sql import functions as F

from statloom.operators import naive_bayes as nb
from statloom.storage import current_version, load_model, remove_old_versions, save_model, save_version
from statloom.streaming.scoring import document_stream, score_stream, scored_documents, train_stream

POSTS = [(0, "the cat sat with the dog", 0), (1, "bad bad stupid dog", 1), (2, "stupid worthless cat food", 1), (3, "please help the lovely cat", 0), (4, "", None), (5, None, 1)]
SCHEMA = "doc_id BIGINT, text STRING, label INT"


def numbers(df):
    return sorted(r["id"] for r in df.collect())


def test_a_model_can_be_saved_over_the_one_it_is_made_of(spark, tmp_path):
    path = str(tmp_path / "m")
    save_model(spark.range(5), path)
    loaded = load_model(spark, path, "id BIGINT")
    save_model(loaded.select(F.col("id") + 10).toDF("id"), path)
    assert numbers(load_model(spark, path, "id BIGINT")) == [10, 11, 12, 13, 14]
    assert numbers(loaded) == [0, 1, 2, 3, 4]


def test_a_save_that_fails_midway_leaves_the_model(spark, tmp_path):
    path = str(tmp_path / "m")
    save_version(path, {"one": spark.range(2), "two": spark.range(3)})
    before = current_version(spark, path)
    wrong = spark.range(4).select(F.raise_error(F.lit("stop")).cast("bigint").alias("id"))
    with pytest.raises(Exception, match="stop"):
        save_version(path, {"one": spark.range(9), "two": wrong})
    assert current_version(spark, path) == before
    assert numbers(spark.read.parquet(f"{before}/one")) == [0, 1]


def test_versions_are_numbered_and_old_ones_removed_on_request(spark, tmp_path):
    path = str(tmp_path / "m")
    with pytest.raises(FileNotFoundError):
        load_model(spark, path, "id BIGINT")
    for n in range(12):
        save_model(spark.range(n), path)
    assert load_model(spark, path, "id BIGINT").count() == 11
    remove_old_versions(spark, path, keep=2)
    assert load_model(spark, path, "id BIGINT").count() == 11
    assert len(list((tmp_path / "m").glob("version-*"))) == 2
    save_model(spark.range(40), path)
    assert load_model(spark, path, "id BIGINT").count() == 40


def model_rows(model):
    return sorted(map(tuple, model.words.collect())), model.prior.first()


@pytest.mark.parametrize("options", [{}, {"bag": False}])
def test_merged_statistics_train_as_all_documents(spark, tmp_path, options):
    docs = spark.createDataFrame([(*r, r[0] == 3) for r in POSTS], f"{SCHEMA}, is_test BOOLEAN")
    path = str(tmp_path / "s")
    for batch, part in enumerate([docs.where("doc_id < 2"), docs.where("doc_id in (2, 3)"), docs.where("false"), docs.where("doc_id > 3")]):
        known = nb.statistics(part, batch=batch, **options).add_to(path)
    for denominator in ("plus2", "vocab"):
        assert model_rows(nb.from_statistics(known, denominator, 1)) == model_rows(nb.train(docs, denominator=denominator, drop_top=1, **options))
    again = nb.statistics(docs.where("doc_id < 2"), batch=0, **options).add_to(path)
    assert again.docs.first() == known.docs.first()
    with pytest.raises(ValueError):
        nb.train(docs, denominator="other")


def test_stream_adds_to_the_statistics(spark, tmp_path):
    docs = spark.createDataFrame([(*r, False) for r in POSTS], f"{SCHEMA}, is_test BOOLEAN")
    folder, path = str(tmp_path / "in"), str(tmp_path / "s")
    for part in ("doc_id < 3", "doc_id >= 3"):
        docs.where(part).coalesce(1).write.mode("append").parquet(folder)
        stream = document_stream(spark, folder, docs.schema)
        train_stream(stream, path, str(tmp_path / "c")).awaitTermination()
    assert model_rows(nb.from_statistics(nb.Statistics.load(spark, path))) == model_rows(nb.train(docs))


def test_a_document_in_two_files_is_scored_once(spark, tmp_path):
    docs = spark.createDataFrame([(*r, False) for r in POSTS], f"{SCHEMA}, is_test BOOLEAN")
    model = nb.train(docs)
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in ("doc_id < 4", "doc_id > 1"):
        docs.where(part).coalesce(1).write.mode("append").parquet(folder)
    stream = document_stream(spark, folder, docs.schema, files_per_batch=1)
    score_stream(stream, model, out, str(tmp_path / "c"), once=("arrived", "1 day")).awaitTermination()
    scored = scored_documents(spark, out, "doc_id BIGINT, score1 DOUBLE, score0 DOUBLE, predicted INT, batch_id INT").collect()
    assert sorted(r["doc_id"] for r in scored) == [0, 1, 2, 3, 4, 5]
    assert len({r["batch_id"] for r in scored}) > 1
