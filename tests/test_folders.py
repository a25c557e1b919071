import shutil

from statloom.sources.files import bitmap_folder
from statloom.streaming import folders
from tests.test_sources import bitmap


def run(spark, tmp_path, checkpoint="checkpoint", per_batch=1000):
    stream = folders.text_stream(spark, str(tmp_path / "in"), per_batch)
    folders.gather(stream, str(tmp_path / "out"), str(tmp_path / checkpoint)).awaitTermination()
    rows = folders.gathered(spark, str(tmp_path / "out")).collect()
    return sorted((r["path"].rsplit("/", 1)[1], r["text"]) for r in rows)


def put(tmp_path, **texts):
    (tmp_path / "in").mkdir(exist_ok=True)
    for name, text in texts.items():
        (tmp_path / "in" / name).write_bytes(text.encode())


def test_a_file_added_later_is_read_once(spark, tmp_path):
    put(tmp_path, a="one\r\ntwo", b="", c="same", d="same")
    first = [("a", "one\r\ntwo"), ("c", "same"), ("d", "same")]
    assert run(spark, tmp_path, per_batch=2) == first
    put(tmp_path, e="late")
    assert run(spark, tmp_path) == run(spark, tmp_path) == [*first, ("e", "late")]
    entries = {r["path"].rsplit("/", 1)[1]: r for r in folders.manifest(spark, str(tmp_path / "out")).collect()}
    assert {n: r["size"] for n, r in entries.items()} == {"a": 8, "c": 4, "d": 4, "e": 4}
    assert entries["c"]["sha256"] == entries["d"]["sha256"] and entries["e"]["batch_id"] == 2


def test_a_lost_checkpoint_reads_nothing_twice(spark, tmp_path):
    put(tmp_path, a="x", b="y")
    run(spark, tmp_path)
    put(tmp_path, c="z")
    assert run(spark, tmp_path, "another") == [("a", "x"), ("b", "y"), ("c", "z")]
    assert folders.manifest(spark, str(tmp_path / "out")).count() == 3


def test_a_batch_that_failed_before_its_manifest_is_read_again(spark, tmp_path):
    put(tmp_path, a="x", b="y")
    run(spark, tmp_path)
    shutil.rmtree(tmp_path / "out" / "manifest")
    assert folders.gathered(spark, str(tmp_path / "out")).count() == 0
    assert run(spark, tmp_path, "another") == [("a", "x"), ("b", "y")]


def test_nothing_read_yet(spark, tmp_path):
    assert folders.manifest(spark, str(tmp_path / "none")).count() == folders.gathered(spark, str(tmp_path / "none")).count() == 0


def test_bitmaps_arrive(spark, tmp_path):
    put(tmp_path, **{f"{d}_{n}.txt": bitmap(d, n) for d in range(2) for n in range(2)})
    run(spark, tmp_path)
    put(tmp_path, **{"3_1.txt": bitmap(3, 1)})
    run(spark, tmp_path)
    got = folders.gathered_bitmaps(spark, str(tmp_path / "out"))
    want = bitmap_folder(spark, str(tmp_path / "in"))
    assert got.columns == want.columns and sorted(got.collect(), key=str) == sorted(want.collect(), key=str)
