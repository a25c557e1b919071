"""Exact k nearest bitmaps by differing bits, over packed 64-bit words.

A training table within a checked size is broadcast, 8 bytes for 64 bits.  A
larger one is indexed by its 16-bit chunks (multi-index hashing): a query looks
up its own chunks, then its chunks with one bit changed.  A bitmap found under
none of the ``g`` chunks that were looked up whole differs in each of them, by
``g`` bits at least, or ``2 g`` once single changes were looked up as well; so a
query whose k-th distance is smaller is answered.  Chunks that too many bitmaps
share are not looked up and don't count towards ``g``.  Queries that are still
open meet the packed table in blocks.  Order is by differing bits, then training id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statloom.functions.vectors import bitmap_distance, word_chunks
from statloom.operators import neighbors as nb
from statloom.partitioning import spread
from statloom.storage import materialize

#: A chunk that more training bitmaps share is not looked up.
BUCKET_ROWS = 256
CHUNK_BITS = 16
#: Words compared at a time.
TILE = 1 << 20


def nearest(queries: np.ndarray, train: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query index, training index and differing bits of the ``k`` nearest rows of 64-bit words."""
    k, parts = min(k, len(train)), []
    if k == 0 or len(queries) == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    step = max(1, TILE // len(train))
    for start in range(0, len(queries), step):
        q = queries[start : start + step]
        bits = np.zeros((len(q), len(train)), np.int64)
        for word in range(train.shape[1]):
            bits += np.bitwise_count(q[:, word, None] ^ train[None, :, word])
        kth = np.partition(bits, k - 1, axis=1)[:, k - 1]
        qi, ti = np.nonzero(bits <= kth[:, None])
        d = bits[qi, ti]
        order = np.lexsort((ids[ti], d, qi))
        qi, ti, d = qi[order], ti[order], d[order]
        best = np.arange(len(qi)) - np.searchsorted(qi, qi) < k
        parts.append((qi[best] + start, ti[best], d[best]))
    return tuple(np.concatenate(p) for p in zip(*parts))


def _words(column: pa.Array, n_words: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, n_words).view(np.uint64)


def _scan(queries: DataFrame, train: DataFrame, k: int, n_words: int, schema: T.StructType, rows: int, broadcast: bool, block_rows: int) -> DataFrame:
    def answer(qids, asked, tids, labels, points) -> pa.RecordBatch:
        qi, ti, d = nearest(asked, points, nb._sort_key(tids), k)
        return pa.RecordBatch.from_arrays([qids.take(pa.array(qi)), tids.take(pa.array(ti)), labels.take(pa.array(ti)), pa.array(d)], schema.names)

    if broadcast:
        table = train.select("tid", "label", "words").toArrow().combine_chunks()
        whole = [nb._whole(table[c]) for c in ("tid", "label", "words")]
        shared = train.sparkSession.sparkContext.broadcast((*whole[:2], _words(whole[2], n_words)))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tids, labels, points = shared.value
            for batch in batches:
                yield answer(batch.column("qid"), _words(batch.column("words"), n_words), tids, labels, points)

        return queries.select("qid", "words").mapInArrow(scan, schema)
    blocks, q_blocks = max(1, -(-rows // block_rows)), max(1, -(-queries.count() // block_rows))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    copies = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = train.select(block("tid", blocks).alias("t"), copies(q_blocks).alias("q"), "tid", "label", "words")
    right = queries.select(block("qid", q_blocks).alias("q"), copies(blocks).alias("t"), "qid", "words")

    def meet(points: pa.Table, asked: pa.Table) -> pa.Table:
        tids, labels, qids = (nb._whole(c) for c in (points["tid"], points["label"], asked["qid"]))
        if len(points) == 0 or len(asked) == 0:
            found = answer(qids, np.empty((0, n_words), np.uint64), tids, labels, np.empty((0, n_words), np.uint64))
        else:
            found = answer(qids, _words(nb._whole(asked["words"]), n_words), tids, labels, _words(nb._whole(points["words"]), n_words))
        return pa.Table.from_batches([found])

    return left.groupBy("t", "q").cogroup(right.groupBy("t", "q")).applyInArrow(meet, schema)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("qid").orderBy("d", "tid")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def _looked_up(queries: DataFrame, train: DataFrame, buckets: DataFrame, k: int, n_chunks: int, flips: bool) -> tuple[DataFrame, DataFrame]:
    """Best rows of the answered queries, and the queries that are still open."""
    chunks = queries.select("qid", "words", F.posexplode(word_chunks("words")).alias("chunk", "own"))
    changes = [0, *(1 << i for i in range(CHUNK_BITS))] if flips else [0]
    probes = chunks.select("qid", "chunk", F.explode(F.array(*[F.col("own").bitwiseXOR(F.lit(c)) for c in changes])).alias("value"))
    asked = probes.join(buckets, ["chunk", "value"], "left")
    # A chunk counts if none of its probes meets a bucket that is too large.
    whole = asked.groupBy("qid", "chunk").agg(F.max(F.coalesce("rows", F.lit(0))).alias("most")).where(F.col("most") <= BUCKET_ROWS)
    bound = whole.groupBy("qid").agg((F.count("*") * (2 if flips else 1)).alias("beyond"))
    index = train.select("tid", F.posexplode(word_chunks("words")).alias("chunk", "value"))
    pairs = asked.where(F.col("rows") <= BUCKET_ROWS).select("qid", "chunk", "value").join(index, ["chunk", "value"]).select("qid", "tid").distinct()
    near = pairs.join(train.select("tid", "label", F.col("words").alias("known")), "tid").join(queries.select("qid", "words"), "qid")
    best = _best(near.select("qid", "tid", "label", bitmap_distance("words", "known").alias("d")), k)
    done = best.groupBy("qid").agg(F.count("*").alias("n"), F.max("d").alias("kth")).join(bound, "qid")
    done = materialize(done.where((F.col("n") == k) & (F.col("kth") < F.col("beyond"))).select("qid"), "hamming-done")
    return materialize(best.join(done, "qid", "left_semi"), "hamming-best"), materialize(queries.join(done, "qid", "left_anti"), "hamming-open")


def neighbors(queries: DataFrame, train: DataFrame, k: int = 3, method: str = "auto", block_rows: int = 1 << 15) -> DataFrame:
    """The ``k`` nearest training bitmaps of every query: ``(qid, tid, label, d, place)``.

    ``queries(qid, words, n_bits)`` and ``train(tid, words, n_bits, label)`` as from
    :func:`with_bitmap`; ids are unique.  Bitmaps of different sizes are an error;
    a row without a bitmap has no neighbours and is none.  ``method`` is
    ``broadcast`` (an error beyond the limits), ``indexed`` or ``auto``.
    """
    if method not in ("auto", "broadcast", "indexed"):
        raise ValueError(f"unknown method: {method}")
    queries = spread(queries.select("qid", "words", "n_bits").where("words IS NOT NULL"), "qid")
    train = train.select("tid", "words", "n_bits", "label").where("words IS NOT NULL")
    texts = F.coalesce(F.octet_length(F.col("tid").cast("string")), F.lit(0)) + F.coalesce(F.octet_length(F.col("label").cast("string")), F.lit(0))
    rows, least, bits, text_bytes = train.agg(F.count("*"), F.min("n_bits"), F.max("n_bits"), F.sum(texts.cast("bigint"))).first()
    if least != bits:
        raise ValueError(f"training bitmaps have between {least} and {bits} bits")
    schema = T.StructType([
        T.StructField("qid", queries.schema["qid"].dataType), T.StructField("tid", train.schema["tid"].dataType),
        T.StructField("label", train.schema["label"].dataType), T.StructField("d", T.LongType()),
    ])
    if not rows:
        return _best(train.sparkSession.createDataFrame([], schema), k)
    wrong = F.raise_error(F.concat(F.lit(f"a query bitmap does not have {bits} bits: "), F.col("n_bits").cast("string")))
    queries = queries.withColumn("words", F.when(F.col("n_bits") == bits, F.col("words")).otherwise(wrong.cast("array<bigint>")))
    n_words = max(1, -(-bits // 64))
    if bits == 0:
        queries, train = (t.withColumn("words", F.array(F.lit(0).cast("bigint"))) for t in (queries, train))
    fits = rows <= nb.BROADCAST_ROWS and rows * n_words * 8 + (text_bytes or 0) <= nb.BROADCAST_BYTES
    if method == "broadcast" and not fits:
        raise ValueError(f"{rows} training rows are too large to broadcast")
    if method == "broadcast" or (method == "auto" and fits):
        return _best(_scan(queries, train, k, n_words, schema, rows, fits, block_rows), k)
    buckets = train.select(F.posexplode(word_chunks("words")).alias("chunk", "value")).groupBy("chunk", "value").agg(F.count("*").alias("rows"))
    buckets = materialize(buckets, "hamming-buckets")
    parts, left = [], queries
    for flips in (False, True):
        found, left = _looked_up(left, train, buckets, k, 4 * n_words, flips)
        parts.append(found.select(*schema.names))
    if not left.isEmpty():
        parts.append(_scan(left, train, k, n_words, schema, rows, False, block_rows))
    told = parts[0]
    for part in parts[1:]:
        told = told.union(part)
    return _best(told, k)
