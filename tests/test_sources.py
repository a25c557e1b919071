from pathlib import Path

import pytest
from pyspark.sql import functions as F

from statloom import storage
from statloom.operators import naive_bayes as nb
from statloom.plans import catalog
from statloom.plans.documents import spam_evaluation
from statloom.plans.points import bitmap_evaluation
from statloom.sources import files
from statloom.sources.feeds import paired_feeds
from statloom.streaming.scoring import document_stream, score_stream, scored_documents


def test_labelled_folders_to_spam_evaluation(spark, tmp_path):
    for name, word in (("good", "meeting agenda"), ("bad", "casino viagra")):
        (tmp_path / name).mkdir()
        for i in range(12):
            (tmp_path / name / f"{i}.txt").write_bytes(f"Hello\r\n{word} number{i}\r\n".encode())
    mails = files.labelled_folders(spark, str(tmp_path / "bad"), str(tmp_path / "good"))
    assert mails.groupBy("label").count().orderBy("label").collect() == [(0, 12), (1, 12)]
    assert "Hello\r\ncasino" in mails.where("label = 1").first()["text"]
    mails = mails.withColumn("doc_id", F.xxhash64("path"))
    assert tuple(spam_evaluation(mails).report.first()) == (10, 0, 0.0)


def bitmap(digit, n, size=32):
    """A filled box whose width depends on the digit, one corner bit set by n."""
    rows = [["1" if r < 4 * (digit + 1) and c < 8 else "0" for c in range(size)] for r in range(size)]
    rows[31][n % 32] = "1"
    return "\r\n".join("".join(r) for r in rows) + "\r\n"


def test_bitmap_folder(spark, tmp_path):
    for digit in range(4):
        for n in range(6):
            (tmp_path / f"{digit}_{n}.txt").write_bytes(bitmap(digit, n).encode())
    bitmaps = files.bitmap_folder(spark, str(tmp_path))
    row = bitmaps.where("file = '2_5.txt'").first()
    assert (row["label"], row["n"], len(row["v"]), len(row["rows"])) == (2, 5, 1024, 32)
    assert sum(row["v"]) == 12 * 8 + 1 and row["v"][31 * 32 + 5] == 1
    assert row["rows"][0] == 0xFF000000 and row["rows"][31] == 1 << 26
    report = bitmap_evaluation(bitmaps.where("n % 2 = 0"), bitmaps.where("n % 2 = 1"))
    assert tuple(report.first()) == (12, 0, 0.0)


def test_numeric_rows(spark, tmp_path):
    path = tmp_path / "dating.txt"
    path.write_text("40920\t8.3\t0.9\tlargeDoses\n14488\t7.1\t1.6\t2\n  26052\t1.4\t0.8\tdidntLike  \n1\t2\t3\tunknown\n")
    rows = files.numeric_rows(spark, str(path)).collect()
    assert [tuple(r) for r in rows] == [(40920.0, 8.3, 0.9, 3), (14488.0, 7.1, 1.6, 2), (26052.0, 1.4, 0.8, 1), (1.0, 2.0, 3.0, None)]


def test_categorical_rows(spark, tmp_path):
    path = tmp_path / "lenses.txt"
    path.write_text('young\tmyope\tno\treduced\tno lenses\n"young"\t\tno\tnormal\tsoft')
    rows = files.categorical_rows(spark, str(path))
    assert rows.columns == ["age", "prescript", "astigmatic", "tearRate", "label"]
    assert [r["label"] for r in rows.collect()] == ["no lenses", "soft"]
    assert tuple(rows.where("label = 'soft'").first())[:2] == ('"young"', "")


def test_paired_feeds_take_as_many_as_the_shorter(spark):
    rows = [(i, "long", "t") for i in range(10, 30)] + [(i, "short", "t") for i in range(5)] + [(99, "other", "t")]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, source STRING, text STRING")
    got = sorted((r["doc_id"], r["label"]) for r in paired_feeds(docs, "long", "short").collect())
    assert got == [(i, 0) for i in range(5)] + [(i, 1) for i in range(10, 15)]
    assert paired_feeds(docs, "long", "absent").count() == 0


def test_intermediate_tables_go_to_the_sessions_folder_and_can_be_removed(spark, monkeypatch):
    assert storage.work_folder(spark).startswith(spark.conf.get("spark.checkpoint.dir"))
    own = storage.work_folder(spark) + "-removed"
    monkeypatch.setattr(storage, "work_folder", lambda _: own)
    assert storage.materialize(spark.range(3), "probe").count() == 3
    assert Path(own).exists()
    storage.remove_intermediate(spark)
    assert not Path(own).exists()


@pytest.fixture
def arriving(spark, posts, tmp_path):
    folder = tmp_path / "in"
    posts.where("doc_id < 3").coalesce(1).write.parquet(str(folder / "a"))
    return folder


def test_stream_scores_equal_batch_scores(spark, posts, arriving, tmp_path):
    model = nb.train(posts.withColumn("is_test", F.lit(False)))
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    schema = "doc_id BIGINT, score1 DOUBLE, score0 DOUBLE, predicted INT, batch_id INT"

    def run():
        stream = document_stream(spark, str(arriving / "*"), posts.schema)
        score_stream(stream, model, out, checkpoint).awaitTermination()
        return scored_documents(spark, out, schema)

    assert run().count() == 3
    posts.where("doc_id >= 3").coalesce(1).write.parquet(str(arriving / "b"))
    scored = run()
    assert {r["batch_id"] for r in scored.select("batch_id").distinct().collect()} == {0, 1}
    want = {r["doc_id"]: r for r in nb.score(posts, model).collect()}
    for r in scored.collect():
        same = want.pop(r["doc_id"])
        assert r["score1"] == pytest.approx(same["score1"]) and r["predicted"] == same["predicted"]
    assert not want


def test_redelivered_batch_replaces_itself(spark, posts, arriving, tmp_path):
    model = nb.train(posts.withColumn("is_test", F.lit(False)))
    out = str(tmp_path / "out")
    for attempt in ("first", "again"):
        stream = document_stream(spark, str(arriving / "*"), posts.schema)
        score_stream(stream, model, out, str(tmp_path / attempt)).awaitTermination()
    assert spark.read.parquet(out).count() == 3


@pytest.fixture
def tables(spark, posts, tmp_path):
    """Documents and labels as folders of several part files."""
    posts.select("doc_id", "text").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    posts.select("doc_id", F.col("label").alias("toxic")).repartition(2).write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_streams_read_tables_that_are_folders(spark, posts, tables):
    """As a folder of parts and as one file the same scores."""
    scores = sorted(catalog.nb_stream_score(spark, tables).collect())
    want = {r["doc_id"]: r["predicted"] for r in nb.score(posts, nb.train(catalog.toxic_split(spark, tables))).collect()}
    assert {r["doc_id"]: r["predicted"] for r in scores} == want and len(scores) == len(posts.collect())
    (Path(tables) / "documents.parquet").rename(Path(tables) / "parts")
    one = spark.read.parquet(f"{tables}/parts").toPandas()
    one.to_parquet(f"{tables}/documents.parquet")
    assert sorted(catalog.nb_stream_score(spark, tables).collect()) == scores


def test_a_delivery_of_many_files_is_one_batch(spark, tables, monkeypatch):
    outs = []
    monkeypatch.setattr(catalog, "scored_documents", lambda spark, out, schema: outs.append(out) or scored_documents(spark, out, schema))
    assert sorted(catalog.nb_stream_score_once(spark, tables).collect()) == sorted(catalog.nb_stream_score(spark, tables).collect())
    # Three files twice: two batches, and one without files that moves the watermark.
    assert len(list(Path(outs[0]).glob("batch_id=*"))) <= 3


def test_delimited_rows_survive_the_round_trip(spark, tmp_path):
    rows = [("a", "", "x"), (None, 'a"b', "y"), ("", None, "z"), ("c d", "\\", "w")]
    table = spark.createDataFrame(rows, "p STRING, q STRING, label STRING")
    files.write_delimited(table, str(tmp_path / "rows"))
    back = files.categorical_rows(spark, str(tmp_path / "rows"), "p STRING, q STRING, label STRING")
    assert sorted(back.collect(), key=str) == sorted(table.collect(), key=str)
