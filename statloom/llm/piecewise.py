"""Document fingerprints by context-triggered piecewise hashing.

1. A rolling hash of the last seven UTF-8 bytes ends a piece wherever its low
   bits are all ones; ``block`` (a power of two) says how many bits that are, so a
   piece holds about ``block`` bytes.  Ends depend on the bytes around them alone:
   an edit moves the ends near it and no others.
2. ``block`` follows the text's length (64 pieces or fewer are expected), but is
   halved where a text that repeats itself has under 16 and doubled where it has
   over 256.  Each piece becomes one of 64 characters, and the fingerprint is
   ``block:signature:signature at twice the block``; it covers the whole text.
3. Fingerprints are compared at block sizes that both have: one less the edit
   distance of the signatures as a share of the longer one; 0 if they have none in
   common.  Equal fingerprints are alike by 1.

Every text is compared with its edited text (the last half replaced by the start
of the next document's text) and with the next document.  Documents follow each
other by descending id: they are dealt out by ranges of it and sorted, each task
walks along its range, and only the first and last texts of the ranges meet again.
So every text moves once.

Defined cases: a null text is empty, and an empty text's fingerprint has empty
signatures; rows that repeat an id follow each other by a hash of the text and
the text; rows without an id come last; the only row of a table is its own next one;
a table without rows has no fingerprints.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statloom.storage import literal_table, materialize

#: Bytes that the rolling hash sees.
WINDOW = 7
#: A block size suits a text if about so many pieces, or fewer, are expected.
TYPICAL_PIECES = 64
#: Texts that repeat themselves have other numbers of pieces; beyond these the block size is doubled or halved.
FEWEST_PIECES, MOST_PIECES = 16, 256
LARGEST_BLOCK = 1 << 30
#: So many possible ends are held while a text is read.
MOST_HELD = 1 << 14
ALPHABET = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
#: Long texts are hashed in slices of so many bytes.
SLICE_BYTES = 1 << 20
_ROLL = np.random.default_rng(7).integers(0, 1 << 32, (WINDOW, 256), dtype=np.uint32)


def _rolling(data: np.ndarray) -> np.ndarray:
    """For each byte after the first six, a hash of it and the six before."""
    n = len(data) - WINDOW + 1
    out = np.zeros(n, np.uint32)
    for k in range(WINDOW):
        out += _ROLL[k][data[k : n + k]]
    out ^= out >> np.uint32(15)
    out *= np.uint32(0x2C1B3C6D)
    return out ^ (out >> np.uint32(13))


def _ends(data: bytes) -> tuple[int, np.ndarray, np.ndarray]:
    """The block size, the ends of its pieces (the text's end left out), and the rolling hashes there."""
    lowest, ends, hashes = 1, np.empty(0, np.int64), np.empty(0, np.uint32)
    before = bytes(WINDOW - 1)

    def ending(block: int) -> np.ndarray:
        return (hashes & np.uint32(block - 1)) == block - 1

    for at in range(0, len(data), SLICE_BYTES):
        part = before + data[at : at + SLICE_BYTES]
        before = part[-(WINDOW - 1) :]
        rolled = _rolling(np.frombuffer(part, np.uint8))
        hits = np.flatnonzero((rolled & np.uint32(lowest - 1)) == lowest - 1)
        ends, hashes = np.concatenate((ends, hits + at + 1)), np.concatenate((hashes, rolled[hits]))
        while len(ends) > MOST_HELD and lowest < LARGEST_BLOCK:
            lowest *= 2
            keep = ending(lowest)
            ends, hashes = ends[keep], hashes[keep]
    block = lowest
    while block * TYPICAL_PIECES < len(data):
        block *= 2
    while block < LARGEST_BLOCK and np.count_nonzero(ending(block)) > MOST_PIECES:
        block *= 2
    while block > lowest and np.count_nonzero(ending(block)) < FEWEST_PIECES and np.count_nonzero(ending(block // 2)) <= MOST_PIECES:
        block //= 2
    if block == LARGEST_BLOCK:  # a repeated window that ends pieces at every size
        return block, ends[:0], hashes[:0]
    keep = ending(block)
    return block, ends[keep], hashes[keep]


def _signature(data: bytes, ends: np.ndarray) -> str:
    cuts = [0, *ends.tolist()]
    if cuts[-1] < len(data):
        cuts.append(len(data))
    view = memoryview(data)
    # The checksum's bits are mixed: short pieces would differ in few of them.
    return bytes(ALPHABET[(zlib.crc32(view[a:b]) * 0x9E3779B1 & 0xFFFFFFFF) >> 26] for a, b in zip(cuts, cuts[1:])).decode()


def fingerprint(text: str) -> str:
    """``block:signature:signature at twice the block`` of a whole text."""
    data = text.encode("utf-8", "surrogatepass")
    block, ends, hashes = _ends(data)
    fewer = ends[(hashes & np.uint32(2 * block - 1)) == 2 * block - 1]
    return f"{block}:{_signature(data, ends)}:{_signature(data, fewer)}"


def likeness(one: Column, two: Column) -> Column:
    """How much two fingerprints are alike, from 0 to 1."""

    def parts(fp: Column) -> tuple[Column, Column, Column]:
        field = lambda i: F.split(fp, ":").getItem(i)
        return field(0).cast("bigint"), field(1), field(2)

    (b1, s1, d1), (b2, s2, d2) = parts(one), parts(two)
    alike = lambda a, b: F.lit(1.0) - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))
    return (
        F.when(one == two, 1.0)
        .when(b1 == b2, F.greatest(alike(s1, s2), alike(d1, d2)))
        .when(b1 == 2 * b2, alike(s1, d2))
        .when(b2 == 2 * b1, alike(d1, s2))
        .otherwise(0.0)
    )


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by the start of ``following``."""
    n = len(text)
    return text[: n - n // 2] + following[: n // 2]


def _compared(doc_id, text: str, print_: str, following: str, print_after: str) -> tuple:
    changed = edited(text, following)
    digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
    return doc_id, len(text), digest, print_, fingerprint(changed), print_after


def _walk(batches: Iterator[pa.RecordBatch], fields: T.StructType, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows of one range in order: each with the one after it; the first and the last leave their texts as well."""
    names = fields.names
    made: list[tuple] = []
    before = None

    def batch() -> pa.RecordBatch:
        columns = list(zip(*made)) if made else [[] for _ in names]
        made.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, schema.field(n).type) for c, n in zip(columns, names)], names)

    for rows in batches:
        for doc_id, text, part in zip(*(rows.column(c).to_pylist() for c in ("doc_id", "text", "part"))):
            now = (doc_id, text, fingerprint(text), part)
            if before is None:
                made.append((doc_id, len(text), None, now[2], None, None, part, "first", text))
            else:
                made.append((*_compared(*before[:3], text, now[2]), part, None, None))
            before = now
            if len(made) >= 1000:
                yield batch()
    if before is not None:
        doc_id, text, print_, part = before
        made.append((doc_id, len(text), None, print_, None, None, part, "last", text))
    yield batch()


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)`` per row of ``docs (doc_id, text)``."""
    spark = docs.sparkSession
    id_type = docs.schema["doc_id"].dataType
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    keys = [F.desc("doc_id"), F.xxhash64("text")]
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys, "text").withColumn("part", F.spark_partition_id())
    fields = T.StructType([
        T.StructField("doc_id", id_type), T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()),
        T.StructField("fingerprint", T.StringType()), T.StructField("edited_fingerprint", T.StringType()),
        T.StructField("next_fingerprint", T.StringType()), T.StructField("part", T.IntegerType()), T.StructField("edge", T.StringType()),
        T.StructField("text", T.StringType()),
    ])
    arrow = pa.schema([(f.name, {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[f.dataType.simpleString()]) for f in fields])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _walk(batches, fields, arrow)

    walked = materialize(ranged.mapInArrow(walk, fields), "piecewise")
    # Ranges follow each other by number; the last row of one meets the first row of the next, one pair for each range.
    edges = walked.where("edge IS NOT NULL")
    parts = sorted(row["part"] for row in edges.where("edge = 'last'").select("part").collect())
    after = F.broadcast(literal_table(spark, [(p, q) for p, q in zip(parts, [*parts[1:], *parts[:1]])], "part INT, after INT"))
    firsts = edges.where("edge = 'first'").select(F.col("part").alias("after"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fingerprint"))
    lasts = edges.where("edge = 'last'").select("doc_id", "text", "fingerprint", "part").join(after, "part").join(firsts, "after")
    result = T.StructType(fields.fields[:6])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                _compared(row["doc_id"], row["text"], row["fingerprint"], row["next_text"], row["next_fingerprint"])
                for row in batch.to_pylist()
            ]
            columns = list(zip(*found)) if found else [[] for _ in result]
            yield pa.RecordBatch.from_arrays([pa.array(c, arrow.field(f.name).type) for c, f in zip(columns, result)], result.names)

    whole = walked.where("edge IS NULL").select(*result.names).union(lasts.mapInArrow(meet, result))
    return whole.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
