"""Embedding near-dedup by sorted projection passes.

1. Equal vectors of a label become one row with a count, so copies cost nothing
   more.  Null, zero and non-finite vectors and null labels take no part.
2. In each pass, vectors are ordered by label and then by their signs at 62 random
   hyperplanes (other hyperplanes each pass), and each is compared with the
   ``WINDOW`` before it.
3. Where vectors have a common direction, more rows than the window agree on the
   leading signs.  Stretches of more than ``WINDOW`` rows with the same ``depth``
   leading signs are compared whole instead, in blocks of bounded size.  So all
   rows with those signs in common are compared either way.  A sign
   differs with chance ``angle / pi`` wherever two vectors lie, so the passes that
   a depth needs do not depend on the data: a pair at the threshold shares the
   leading signs in no pass with a chance below ``MISSED``.
4. Depth only decides about cost: each label, of whatever size, takes the one that is
   cheapest by the stretches measured on a sample of its keys.
5. Verified pairs of all passes are united to components, and the members of each
   are compared in blocks: no link inside a component is lost.

Similarity is the cosine in double precision, of vectors scaled by their largest
entry.  Labels are compared as they are, by number or by 64-bit hash.  Repeated
ids are separate rows.  An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.llm.common import components
from statloom.storage import materialize

THRESHOLD = 0.98
BITS = 62
#: Rows of the order that each row is compared with.
WINDOW = 32
MISSED = 1e-6
#: Rows of a bucket or component that are compared with as many others at a time.
BLOCK_ROWS = 2048
#: Bits of a bucket that are considered, rows of a label read to choose, comparisons that cost as much as moving a row.
DEPTHS = (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 18, 20, 22, 24, 28, 32, 40, 48)
SAMPLE = 8192
MOVE = 256
SEED = 20240517


def passes_at(depth: float, threshold: float = THRESHOLD) -> int:
    """Passes after which a pair at the threshold has shared ``depth`` signs in one with a chance of ``1 - MISSED``."""
    near = (1 - math.acos(threshold) / math.pi) ** depth
    return 1 if near >= 1 else math.ceil(math.log(MISSED) / math.log(1 - near))


def _matrix(column: pa.Array) -> np.ndarray:
    """A column of equally long lists as unit vectors in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    x = x / np.abs(x).max(1, initial=0.0)[:, None]  # squares of very large or small entries would leave the range
    return x / np.sqrt((x * x).sum(1))[:, None]


def _signs(x: np.ndarray, turn: int, depth: int = BITS) -> np.ndarray:
    planes = np.random.default_rng([SEED, turn]).standard_normal((x.shape[1], BITS))[:, :depth]
    return (((x @ planes) >= 0) @ (np.int64(1) << np.arange(depth, dtype=np.int64)[::-1])).astype(np.int64)


def _sample_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The signs of a pass, for measuring how many rows share them."""
    for batch in batches:
        sizes = batch.column("size").to_numpy()
        for size in np.unique(sizes):  # usually one
            rows = batch.filter(pa.array(sizes == size))
            keys = pa.array(_signs(_matrix(rows.column("embedding")), 0))
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("label", "size", "n")), keys], ["label", "size", "n", "key"])


BUCKET = "turn int, label long, size int, bucket long"
_BUCKET = ["turn", "label", "size", "bucket"]


def _buckets(kept: list[str]):
    """The leading signs of each row in each of its label's passes as ``bucket``, all signs as ``key``, and the columns ``kept``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = np.stack([batch.column(c).to_numpy() for c in ("size", "depth", "turns")], 1)
            for kind in np.unique(kinds, axis=0):  # few: labels share them
                rows = batch.filter(pa.array((kinds == kind).all(1)))
                x = _matrix(rows.column("embedding"))
                for turn in range(kind[2]):
                    key = _signs(x, turn)
                    columns = [pa.array(np.full(len(x), turn), pa.int32()), rows.column("label"), rows.column("size"), pa.array(key >> (BITS - int(kind[1]))), pa.array(key)]
                    yield pa.RecordBatch.from_arrays([*columns, *(rows.column(c) for c in kept)], [*_BUCKET, "key", *kept])

    return run


def _window_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of rows, in order of pass, label and key, to the ``WINDOW`` rows before them."""
    kept: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows, old = pa.Table.from_batches([batch]), 0
        if kept is not None:
            rows, old = pa.concat_tables([kept, rows]), kept.num_rows
        group = np.stack([rows.column(c).to_numpy() for c in ("turn", "label", "size")], 1)
        bounds = [0, *(np.flatnonzero((np.diff(group, axis=0) != 0).any(1)) + 1).tolist(), len(group)]
        ids = rows.column("id").to_numpy()
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for low, high in zip(bounds, bounds[1:]):
            if high <= old or high - low < 2:
                continue
            x = _matrix(rows.column("embedding").slice(low, high - low))
            for step in range(1, min(WINDOW, high - low - 1) + 1):
                later = np.arange(max(old - low, step), high - low)
                near = later[np.einsum("ij,ij->i", x[later - step], x[later]) >= THRESHOLD]
                a.append(ids[low + near - step])
                b.append(ids[low + near])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])
        kept = rows.slice(max(0, rows.num_rows - WINDOW))


def _forest(x: np.ndarray, y: np.ndarray | None) -> tuple[list[int], list[int]]:
    """Near pairs inside ``x``, or between ``x`` and ``y``, that connect what all near pairs connect: fewer than rows."""
    a, b = [], []
    other = x if y is None else y
    group = np.arange(len(other))
    for first in range(0, len(x), 256):
        near = x[first : first + 256] @ other.T >= THRESHOLD
        if y is None:  # each row with those before it
            near &= np.arange(len(x)) < first + np.arange(len(near))[:, None]
        for i in np.flatnonzero(near.any(1)):
            partners = np.flatnonzero(near[i])
            found, at = np.unique(group[partners], return_index=True)
            a += [first + int(i)] * len(found)
            b += partners[at].tolist()
            if len(found) > 1:
                group[np.isin(group, found)] = found[0]
            if y is None:
                group[first + i] = found[0]
    return a, b


_BLOCK = [*_BUCKET, "low", "high"]


def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links inside a block of a bucket (one side) or between two of its blocks, from rows sorted by block."""

    def links(rows: pa.Table, last: bool) -> tuple[pa.RecordBatch, pa.Table]:
        group = np.stack([rows.column(c).to_numpy() for c in _BLOCK], 1)
        bounds = [0, *(np.flatnonzero((np.diff(group, axis=0) != 0).any(1)) + 1).tolist(), len(group)]
        ids, side = rows.column("id").to_numpy(), rows.column("side").to_numpy()
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for low, high in zip(bounds, bounds[1:] if last else bounds[1:-1]):
            middle = low + int((side[low:high] == 0).sum())
            own = group[low][-2] == group[low][-1]
            if (high - low < 2) if own else (middle in (low, high)):
                continue
            x = _matrix(rows.column("embedding").slice(low, high - low))
            i, j = _forest(x, None) if own else _forest(x[: middle - low], x[middle - low :])
            a.append(ids[low + np.array(i, np.int64)])
            b.append(ids[(low if own else middle) + np.array(j, np.int64)])
        found = pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])
        return found, rows.slice(len(group) if last else bounds[-2])

    kept: pa.Table | None = None
    for batch in batches:
        if batch.num_rows:
            rows = pa.Table.from_batches([batch])
            rows = rows if kept is None else pa.concat_tables([kept, rows])
            found, kept = links(rows, False)
            yield found
    if kept is not None:
        yield links(kept, True)[0]


def _block_links(rows: pa.Table) -> pa.Table:
    """Links inside a block of a component (one side), or between two of its blocks; copies count each."""
    side, ids, copies = (rows.column(c).to_numpy() for c in ("side", "id", "copies"))
    vectors = rows.column("embedding").combine_chunks()
    mine, other = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    same_block = not len(other)
    other = mine if same_block else other
    x, y = _matrix(vectors.take(pa.array(mine))), _matrix(vectors.take(pa.array(other)))
    of_mine, of_other = np.zeros(len(mine), np.int64), np.zeros(len(other), np.int64)
    for first in range(0, len(mine), 256):
        near = x[first : first + 256] @ y.T >= THRESHOLD
        if same_block:
            near[np.arange(len(near)), first + np.arange(len(near))] = False
        of_mine[first : first + 256] = near @ copies[other]
        of_other += near.T @ copies[mine[first : first + 256]]
    if same_block:
        return pa.table({"id": ids[mine], "links": of_mine})
    return pa.table({"id": np.concatenate([ids[mine], ids[other]]), "links": np.concatenate([of_mine, of_other])})


def _usable() -> Column:
    """Vectors that can be compared: with an id, a label, and finite numbers that are not all zero."""
    broken = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    known = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
    return F.coalesce(known & ~broken & F.exists("embedding", lambda v: v != 0), F.lit(False))


def _settled(classes: DataFrame) -> DataFrame:
    """``classes`` with the ``depth`` and ``turns`` that cost their label least."""
    sizes = materialize(classes.groupBy("label", "size").agg(F.count("*").alias("n")), "vectors-sizes")
    some = classes.join(sizes, ["label", "size"]).where(F.expr(f"pmod(xxhash64(id), n) < {SAMPLE}"))
    keys = some.select("label", "size", "n", "embedding").mapInArrow(_sample_keys, "label long, size int, n long, key long")
    offers = F.array(*(F.struct(F.lit(d).alias("depth"), F.lit(passes_at(d)).alias("turns")) for d in DEPTHS))
    group = ["label", "size", "n", "offer"]
    met = keys.withColumn("offer", F.explode(offers)).groupBy(*group, F.expr(f"shiftright(key, {BITS} - offer.depth)").alias("shared")).agg(F.count("*").cast("double").alias("c"))
    scale = F.greatest(F.col("n") / SAMPLE, F.lit(1.0))
    whole = F.when(F.col("c") * scale > WINDOW, F.col("c") * (F.col("c") - 1) / 2).otherwise(0.0)
    pairs = met.groupBy(*group).agg((F.sum(whole) * scale * scale).alias("pairs"))
    cost = F.col("offer.turns") * ((MOVE + WINDOW) * F.col("n") + F.col("pairs"))
    chosen = pairs.groupBy("label", "size").agg(F.min_by("offer", cost).alias("offer")).select("label", "size", "offer.*")
    return classes.join(materialize(chosen, "vectors-depths"), ["label", "size"])


def _spread(rows: DataFrame, key: list[str], *columns: str) -> DataFrame:
    """Rows of groups of ``blocks`` blocks, once for each block that their own meets (also itself)."""
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    spread = rows.withColumn("own", own).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return spread.select(
        *key,
        F.least("own", "with").alias("low"),
        F.greatest("own", "with").alias("high"),
        F.when(F.col("own") <= F.col("with"), 0).otherwise(1).alias("side"),
        "id",
        *columns,
    )


def near_duplicate_vectors(vectors: DataFrame) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row per row of ``vectors (vec_id, embedding, label)``."""
    entry = "float" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
    by_number = vectors.schema["label"].dataType.typeName() in ("byte", "short", "integer", "long")
    label = F.col("label").cast("long") if by_number else F.when(F.col("label").isNotNull(), F.xxhash64("label"))
    rows = vectors.select("vec_id", F.col("embedding").cast(f"array<{entry}>").alias("embedding"), label.alias("label"))
    rows = rows.withColumn("embedding", F.when(_usable(), F.col("embedding"))).withColumns({"x": F.xxhash64("embedding"), "y": F.hash("embedding")})
    classes = materialize(
        rows.where("embedding IS NOT NULL")
        .groupBy("label", "x", "y")
        .agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"))
        .withColumn("size", F.size("embedding")),
        "vectors-classes",
    )
    settled = _settled(classes)
    counted = settled.mapInArrow(_buckets([]), f"{BUCKET}, key long").groupBy(*_BUCKET).agg(F.count("*").alias("rows")).where(F.col("rows") > WINDOW)
    large = materialize(counted.select(*_BUCKET, F.ceil(F.col("rows") / BLOCK_ROWS).cast("int").alias("blocks")), "vectors-large")
    turned = settled.mapInArrow(_buckets(["id", "embedding"]), f"{BUCKET}, key long, id long, embedding array<{entry}>")
    # Ranges of whole stretches: none is cut, and none has more rows than the window.
    order = ["turn", "label", "size"]
    short = turned.join(large, _BUCKET, "left_anti").repartitionByRange(*_BUCKET).sortWithinPartitions(*order, "key", "id")
    windows = short.select(*order, "key", "id", "embedding").mapInArrow(_window_links, "a long, b long")
    dealt = _spread(turned.join(large, _BUCKET), _BUCKET, "embedding").repartition(*_BLOCK).sortWithinPartitions(*_BLOCK, "side", "id")
    links = windows.union(dealt.mapInArrow(_bucket_links, "a long, b long")).distinct()
    found = materialize(components(links, "vectors"), "vectors-components")

    blocks = found.groupBy("component").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    members = found.join(materialize(blocks, "vectors-blocks"), "component").join(classes.withColumnRenamed("id", "node"), "node")
    spread = _spread(members.withColumnRenamed("node", "id"), ["component"], "copies", "embedding")
    counted = spread.groupBy("component", "low", "high").applyInArrow(_block_links, "id long, links long")
    counted = counted.groupBy("id").agg(F.sum("links").alias("links"))
    named = classes.select("label", "x", "y", "id", "copies").join(found.withColumnRenamed("node", "id"), "id", "left").join(counted, "id", "left")
    named = materialize(named.select("label", "x", "y", "copies", F.coalesce("component", "id").alias("component"), F.coalesce("links", F.lit(0)).alias("links")), "vectors-named")
    joined = rows.select("vec_id", F.when(F.col("embedding").isNotNull(), F.col("label")).alias("label"), "x", "y").join(named, ["label", "x", "y"], "left")
    component = F.coalesce("component", "vec_id")
    return joined.select(
        "vec_id",
        (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).cast("long").alias("n_links"),
        component.alias("component_id"),
        component.eqNullSafe(F.col("vec_id")).alias("kept"),
    )
