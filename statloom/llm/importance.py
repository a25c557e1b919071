"""Importance resampling towards a target distribution, with features counted once for each distinct line.

1. No word holds a newline, so texts fall into lines.  Lines are counted, and the
   hashed features (runs of words) of each distinct line are found once and
   stored beside its occurrences.  Runs that go over a line's end (only where runs
   may have two words or more) belong to no line; they are found for each document.
2. A bucket's count in the corpus is the sum over distinct lines of count times
   occurrences, and what goes over line ends.  Buckets are a fixed number, so
   their gains (how much likelier a bucket is in the target) are broadcast.
3. A line's gains are summed once; a document adds up those of its lines.  Lines
   that make up 1/4096 of all lines or more, of which there are at most as
   many, are broadcast; the others meet the documents by digest.
4. The mean gain plus Gumbel noise of the id is the score, and the highest are
   drawn: the cut is found by counting scores, and only what lies above is sorted.

Defined cases: a null text has no words; a document without features weighs 0;
rows that repeat an id are documents of their own with the same noise, and those
that tie in score and id take ranks in any order; a row without an id has no score, isn't drawn and doesn't count among
those to draw from; without a target every gain compares with nothing seen.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.operators.split import nth_smallest
from statloom.storage import literal_table, materialize

#: Runs of up to so many words, hashed into so many buckets.
LONGEST_RUN = 1
BUCKETS = 10_000
SEED = 2024
MIN_WORDS = 20
DRAWN_PERCENT = 10
#: A line is frequent if it makes up this share of all lines; so there are at most that many frequent ones.
FREQUENT_LINES = 4096
#: Lines are handled in batches of so many.
BATCH_LINES = 4096
#: Words of lower-cased UTF-8: digits, letters and every byte beyond ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xFF]+")


def _words(text: str) -> list[bytes]:
    return WORD.findall(text.encode("utf-8", "surrogatepass").lower())


def _buckets(features: list[bytes], buckets: int) -> np.ndarray:
    return (np.fromiter(map(zlib.crc32, features), np.uint32, len(features)) % np.uint32(buckets)).astype(np.int32)


def line_buckets(line: str, longest: int, buckets: int) -> tuple[int, np.ndarray]:
    """Number of words of a line, and the buckets of all its runs of up to ``longest`` words."""
    words = _words(line)
    runs = list(words)
    for size in range(2, longest + 1):
        runs += [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)]
    return len(words), _buckets(runs, buckets)


def crossing_buckets(text: str, longest: int, buckets: int) -> np.ndarray:
    """Buckets of the runs of up to ``longest`` words that go over a line's end."""
    lines = [_words(line) for line in text.split("\n")]
    words = [w for line in lines for w in line]
    at = np.repeat(np.arange(len(lines)), [len(line) for line in lines])
    runs = []
    for size in range(2, longest + 1):
        starts = np.flatnonzero(at[size - 1 :] != at[: max(0, len(at) - size + 1)])
        runs += [b" ".join(words[i : i + size]) for i in starts]
    return _buckets(runs, buckets)


def _int_lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*arrays, np.empty(0, np.int32)])))


def _lines(text: str = "text") -> Column:
    """Lines of a text that hold anything."""
    return F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda line: line != "")


def _digest(line: Column) -> Column:
    return F.unhex(F.md5(line))


def distinct_lines(docs: DataFrame, longest: int, buckets: int, name: str) -> DataFrame:
    """``(digest, n, words, buckets)``: each distinct line with words, its occurrences, and the buckets of its features."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_LINES):
                part = batch.slice(at, BATCH_LINES)
                made = [line_buckets(line, longest, buckets) for line in part.column("line").to_pylist()]
                rows = pa.RecordBatch.from_arrays(
                    [part.column("digest"), part.column("n"), pa.array([n for n, _ in made], pa.int64()), _int_lists([b for _, b in made])],
                    ["digest", "n", "words", "buckets"],
                )
                yield rows.filter(pa.array([n > 0 for n, _ in made], pa.bool_()))

    counted = docs.select(F.explode(_lines()).alias("line")).groupBy("line").agg(F.count("*").alias("n"))
    keyed = counted.select(_digest(F.col("line")).alias("digest"), "n", "line")
    return materialize(keyed.mapInArrow(found, "digest binary, n long, words long, buckets array<int>"), f"importance-lines-{name}")


def documents_by_line(docs: DataFrame, longest: int, buckets: int, name: str) -> DataFrame:
    """``(row, doc_id, digests, crossing)``: every row's number, its lines, and the buckets of what goes over line ends."""
    digests = F.transform(_lines(), _digest)
    if longest < 2:
        rows = docs.select("doc_id", digests.alias("digests"), F.array().cast("array<int>").alias("crossing"))
    else:

        def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                made = [crossing_buckets(t or "", longest, buckets) for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digests"), _int_lists(made)], ["doc_id", "digests", "crossing"])

        kind = docs.schema["doc_id"].dataType.simpleString()
        rows = docs.select("doc_id", digests.alias("digests"), "text").mapInArrow(cross, f"doc_id {kind}, digests array<binary>, crossing array<int>")
    # The number holds as it is written with its row, once.
    return materialize(rows.select(F.monotonically_increasing_id().alias("row"), "*"), f"importance-rows-{name}")


def bucket_counts(lines: DataFrame, rows: DataFrame, longest: int, buckets: int) -> DataFrame:
    """``(bucket, n)`` over all documents; a task sends one sum for each bucket that it met."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            lists = batch.column("buckets")
            sizes = np.diff(lists.offsets.to_numpy())
            times = np.repeat(batch.column("n").to_numpy(), sizes)
            total += np.bincount(lists.flatten().to_numpy(zero_copy_only=False), times, buckets).astype(np.int64)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(total[met])], ["bucket", "n"])

    told = lines.select("n", "buckets")
    if longest > 1:
        told = told.union(rows.where(F.size("crossing") > 0).select(F.lit(1).cast("bigint"), "crossing"))
    return told.mapInArrow(summed, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(corpus: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """A gain for each bucket: how much likelier it is in the target, smoothed by one, in thousandths of a natural logarithm."""
    spark = corpus.sparkSession
    both = (
        spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
        .join(corpus.withColumnRenamed("n", "s"), "bucket", "left")
        .join(target.withColumnRenamed("n", "t"), "bucket", "left")
        .fillna(0)
    )
    table = both.select("bucket", F.col("s").cast("double"), F.col("t").cast("double")).toArrow().sort_by("bucket")
    s, t = (table[c].to_numpy() for c in ("s", "t"))
    return np.floor(1000.0 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def _summed_gains(gains: np.ndarray, column: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Replaces a column of bucket lists by the sum of their gains and their number."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(column)
            ends = lists.offsets.to_numpy().astype(np.int64)
            sums = np.concatenate(([0], np.cumsum(gains[lists.values.to_numpy(zero_copy_only=False)])))
            names = [c for c in batch.schema.names if c != column]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(sums[ends[1:]] - sums[ends[:-1]]), pa.array(np.diff(ends))], [*names, "gain", "features"]
            )

    return add


def weighted(docs: DataFrame, target: DataFrame, longest: int = LONGEST_RUN, buckets: int = BUCKETS) -> DataFrame:
    """``(doc_id, n_words, n_features, weight)``, one row per row of ``docs (doc_id, text)``, against ``target (text)``."""
    texts = docs.select("doc_id", "text")
    lines = distinct_lines(texts, longest, buckets, "corpus")
    rows = documents_by_line(texts, longest, buckets, "corpus")
    items = target.select(F.lit(None).cast("bigint").alias("doc_id"), "text")
    wanted = bucket_counts(
        distinct_lines(items, longest, buckets, "target"), documents_by_line(items, longest, buckets, "target") if longest > 1 else items, longest, buckets
    )
    gains = bucket_gains(bucket_counts(lines, rows, longest, buckets), wanted, buckets)
    kind = texts.schema["doc_id"].dataType.simpleString()
    scored = lines.mapInArrow(_summed_gains(gains, "buckets"), "digest binary, n long, words long, gain long, features long")
    total = lines.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    is_frequent = F.col("n") * FREQUENT_LINES >= total
    frequent = F.broadcast(scored.where(is_frequent).select("digest", "words", "gain", "features"))
    sums = ["words", "gain", "features"]
    placed = rows.select("row", F.explode("digests").alias("digest"))
    parts = [
        placed.join(frequent, "digest").select("row", *sums),
        placed.join(frequent, "digest", "left_anti").join(scored.where(~is_frequent), "digest").select("row", *sums),
    ]
    own = rows.select("row", "doc_id", "crossing").mapInArrow(_summed_gains(gains, "crossing"), f"row long, doc_id {kind}, gain long, features long")
    no_id = F.lit(None).cast(kind).alias("doc_id")
    told = own.select("row", "doc_id", F.lit(0).cast("bigint").alias("words"), "gain", "features")
    for part in parts:
        told = told.union(part.select("row", no_id, *sums))
    found = told.groupBy("row").agg(F.max("doc_id").alias("doc_id"), *(F.sum(c).alias(c) for c in sums))
    mean = F.when(F.col("features") == 0, 0).otherwise(F.expr("(gain - pmod(gain, features)) div features"))
    return found.select("doc_id", F.col("words").alias("n_words"), F.col("features").alias("n_features"), mean.alias("weight"))


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise of an id in thousandths, from the first 32 bits of its seeded digest."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0))))


def ranked(scored: DataFrame, may_draw: Column, percent: int) -> DataFrame:
    """Add ``rank`` to ``percent`` of the rows that may be drawn, by descending ``score`` and then ``doc_id``."""
    spark = scored.sparkSession
    rows = materialize(scored.withColumn("open", F.coalesce(may_draw, F.lit(False))), "importance-scored")
    quota = rows.where("open").count() * percent // 100
    low = nth_smallest(rows.where("open").select((-F.col("score")).alias("key")), "key", quota)
    above = F.col("open") & (F.col("score") >= F.lit(None if low is None else -low).cast("bigint"))
    above = F.coalesce(above, F.lit(False))
    rest = rows.where(~above).withColumn("rank", F.lit(None).cast("bigint"))
    # Sorted by ranges: a row's number is its place in its range after all rows of the ranges before.
    placed = rows.where(above).orderBy(F.desc("score"), "doc_id").withColumn("at", F.monotonically_increasing_id())
    placed = materialize(placed, "importance-sorted")
    part = F.shiftrightunsigned("at", 33)
    sizes = sorted((p, n) for p, n in placed.groupBy(part).count().collect())
    starts, before = [], 0
    for p, n in sizes:
        starts.append((p, before))
        before += n
    numbered = placed.withColumn("part", part).join(F.broadcast(literal_table(spark, starts, "part BIGINT, start BIGINT")), "part")
    rank = F.col("start") + F.col("at").bitwiseAND((1 << 33) - 1) + 1
    drawn = numbered.withColumn("rank", F.when(rank <= quota, rank)).select(*rest.columns)
    return rest.union(drawn).drop("open")


def resampled(
    docs: DataFrame, target: DataFrame, longest: int = LONGEST_RUN, buckets: int = BUCKETS,
    percent: int = DRAWN_PERCENT, min_words: int = MIN_WORDS, seed: int = SEED,
) -> DataFrame:
    """``(doc_id, n_words, n_features, weight, score, rank)``: a rank for each drawn document, null for the others."""
    found = weighted(docs, target, longest, buckets)
    scored = found.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    return ranked(scored, (F.col("n_words") >= min_words) & F.col("doc_id").isNotNull(), percent)


def drawn_documents(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn rows of ``docs`` with their columns, by id."""
    ids = resampled(docs, target, **options).where("rank IS NOT NULL").select("doc_id").distinct()
    return docs.join(ids, "doc_id", "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))
