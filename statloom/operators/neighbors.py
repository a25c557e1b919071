"""Exact k-nearest-neighbour join and vote.

A training table within a checked size is broadcast and every query row is
answered where it is.  A larger one is cut into cells around sampled pivots and
queries only meet the cells that can hold a neighbour; cells are split into
blocks of bounded size, so a dense region is shared by many tasks.  Either way a
block of distances exists only inside a task and only the ``k`` best per query
leave it.  Long vectors meet as codes of a byte per entry first, and only what
their bounds leave is measured.  Order is by squared distance, then training id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statloom.operators.split import draw_key, drawn
from statloom.partitioning import spread
from statloom.storage import literal_table, materialize

BROADCAST_ROWS = 50_000
BROADCAST_BYTES = 32 << 20
# Share of a core's part of the task memory that a block of points may take.
BLOCK_SHARE = 1 / 64
MAX_BLOCK_ROWS = 1 << 16
# Whatever the memory, no block and no batch of copied vectors holds more bytes of vectors: Python workers hold a few times that.
MAX_BLOCK_BYTES = 8 << 20
MAX_PIVOTS = 1 << 14
PIVOT_BYTES = 8 << 20
PIVOT_SEED = 1
# Sending a copy of a row to a block costs about as much as this many distances.
COPY_COST = 500
# Distances held at a time.
TILE = 1 << 20
# Vectors longer than this meet as codes of one byte per entry before any exact distance.
CODED_DIMS = 16


def nearest(
    queries: np.ndarray, train: np.ndarray, ids: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query index, training index and squared distance of the ``k`` nearest rows.

    A matrix product proposes candidates within its rounding error of the k-th
    distance; these are measured again by plain differences, which makes the
    result independent of how rows were put into blocks.
    """
    k = min(k, len(train))
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if k == 0 or len(queries) == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    dims = train.shape[1]
    train_sq = np.einsum("ij,ij->i", train, train)
    step = max(1, TILE // len(train))
    for start in range(0, len(queries), step):
        q = queries[start : start + step]
        q_sq = np.einsum("ij,ij->i", q, q)
        rough = q_sq[:, None] + train_sq[None, :] - 2.0 * (q @ train.T)
        error = 8.0 * (dims + 8) * np.finfo(float).eps * (q_sq + train_sq.max())
        kth = np.partition(rough, k - 1, axis=1)[:, k - 1]
        qi, ti = np.nonzero(rough <= (kth + 2.0 * error)[:, None])
        exact = np.zeros(len(qi))
        for j in range(dims):
            gap = q[qi, j] - train[ti, j]
            exact += gap * gap
        order = np.lexsort((ids[ti], exact, qi))
        qi, ti, exact = qi[order], ti[order], exact[order]
        place = np.arange(len(qi)) - np.searchsorted(qi, qi)
        best = place < k
        parts.append((qi[best] + start, ti[best], exact[best]))
    return tuple(np.concatenate(p) for p in zip(*parts))


def _matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _sort_key(ids: pa.Array) -> np.ndarray:
    """Numbers that order like the ids; text is ranked by its bytes."""
    if pa.types.is_integer(ids.type):
        return ids.to_numpy(zero_copy_only=False)
    return pc.rank(ids, sort_keys="ascending", tiebreaker="dense").to_numpy(zero_copy_only=False)


def _answer(query_ids, train_ids, labels, qi, ti, d2) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [query_ids.take(pa.array(qi)), train_ids.take(pa.array(ti)), labels.take(pa.array(ti)), pa.array(d2)],
        names=["qid", "tid", "label", "d2"],
    )


def _whole(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _broadcast_neighbors(queries: DataFrame, train: DataFrame, k: int, dims: int, schema: T.StructType) -> DataFrame:
    table = train.toArrow()
    shared = train.sparkSession.sparkContext.broadcast(
        (_whole(table["tid"]), _whole(table["label"]), _matrix(table["x"], dims))
    )

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tids, labels, points = shared.value
        ids = _sort_key(tids)
        for batch in batches:
            found = nearest(_matrix(batch.column("x"), dims), points, ids, k)
            yield _answer(batch.column("qid"), tids, labels, *found)

    return queries.mapInArrow(answer, schema)


def _pivots(train: DataFrame, rows: int, k: int, dims: int) -> np.ndarray:
    """A bounded, seeded sample of training points."""
    most = min(MAX_PIVOTS, PIVOT_BYTES // (8 * dims))
    count = max(1, min(most, rows, 2 * int(math.sqrt(rows)) + k))
    few = train.where(drawn("tid", min(1.0, 2 * (count + 50) / rows), PIVOT_SEED))
    chosen = few.orderBy(draw_key("tid", PIVOT_SEED), "tid").limit(count)
    return np.unique(_matrix(chosen.select("x").toArrow()["x"], dims), axis=0)


def _pivot_distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squares = np.einsum("ij,ij->i", points, points)[:, None] + np.einsum("ij,ij->i", pivots, pivots)[None, :]
    return np.sqrt(np.maximum(squares - 2.0 * (points @ pivots.T), 0.0))


def _with_cell(train: DataFrame, pivots: np.ndarray, dims: int) -> DataFrame:
    """Add each point's nearest pivot ``cell`` and its distance ``r``."""
    schema = T.StructType(train.schema.fields + [T.StructField("cell", T.IntegerType()), T.StructField("r", T.DoubleType())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = _matrix(batch.column("x"), dims)
            cell, r = np.empty(len(points), np.int32), np.empty(len(points))
            step = max(1, TILE // len(pivots))
            for start in range(0, len(points), step):
                far = _pivot_distances(points[start : start + step], pivots)
                cell[start : start + step] = far.argmin(axis=1)
                r[start : start + step] = far.min(axis=1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell), pa.array(r)], names=[*batch.schema.names, "cell", "r"]
            )

    return train.mapInArrow(assign, schema)


def _candidate_cells(
    queries: DataFrame, pivots: np.ndarray, cells: np.ndarray, radius: np.ndarray, k: int, dims: int, counts_only: bool = False
) -> DataFrame:
    """Pair every query with the cells that can hold one of its ``k`` nearest.

    With ``counts_only``, ``(cell, n)`` instead: parts of the number of queries
    that each cell will get, without any copy of a query.

    Pivots are training points, so the k-th nearest pivot bounds the k-th
    distance from above.  A cell is out when its ball, or the plane halfway
    between its pivot and the query's own, lies beyond that bound.  Bounds are
    widened by more than the rounding error of the distances.
    """
    schema = T.StructType([*queries.schema.fields, T.StructField("cell", T.IntegerType())])
    size = float(np.sqrt(np.einsum("ij,ij->i", pivots, pivots).max()))
    copies = max(1, MAX_BLOCK_BYTES // (8 * dims))

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = np.zeros(len(cells), np.int64)
        for batch in batches:
            points = _matrix(batch.column("x"), dims)
            step = max(1, TILE // len(pivots))
            for start in range(0, len(points), step):
                q = points[start : start + step]
                far = _pivot_distances(q, pivots)
                slack = 1e-6 * (1.0 + size + radius.max() + np.sqrt(np.einsum("ij,ij->i", q, q)))[:, None]
                if len(pivots) >= k:
                    reach = np.partition(far, k - 1, axis=1)[:, k - 1 : k]
                else:
                    reach = np.full((len(q), 1), np.inf)
                own = far.argmin(axis=1)
                gap = _pivot_distances(pivots[own], pivots)
                nearer = far[np.arange(len(q)), own][:, None]
                with np.errstate(divide="ignore", invalid="ignore"):
                    plane = np.where(gap > 0, (far**2 - nearer**2) / (2.0 * gap), 0.0)
                ball = far - radius[None, :]
                # The plane bound loses accuracy when two pivots almost coincide.
                plane_slack = slack * (1.0 + (far + nearer) / np.maximum(gap, 1e-300))
                near = (ball <= reach + slack) & (plane <= reach + plane_slack)
                if counts_only:
                    asked += near[:, cells].sum(axis=0)
                    continue
                qi, ci = np.nonzero(near[:, cells])
                for at in range(0, len(qi), copies):
                    own, met = pa.array(qi[at : at + copies] + start), cells[ci[at : at + copies]].astype(np.int32)
                    yield pa.RecordBatch.from_arrays([*(c.take(own) for c in batch.columns), pa.array(met)], names=[*batch.schema.names, "cell"])
        if counts_only:
            yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(asked)], names=["cell", "n"])

    return queries.mapInArrow(pair, "cell int, n long" if counts_only else schema)


def _blocks(rows: int, block_rows: int) -> int:
    return math.ceil(int(rows) / block_rows)


def _cost(sizes: list[tuple[int, int, int]], block_rows: int) -> float:
    """Distances to compute plus rows to copy, for ``(cell, points, queries)``."""
    return sum(
        float(n) * float(asked) + COPY_COST * (n * _blocks(asked, block_rows) + asked * _blocks(n, block_rows))
        for _, n, asked in sizes
    )


def _pruned_neighbors(
    queries: DataFrame, train: DataFrame, rows: int, k: int, dims: int, schema: T.StructType, block_rows: int
) -> DataFrame:
    spark = train.sparkSession
    pivots = _pivots(train, rows, k, dims)
    placed = _with_cell(train, pivots, dims).withColumns({"home": F.col("cell"), "row": F.monotonically_increasing_id()})
    placed = materialize(placed, "knn-cells")
    cells = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("r").alias("radius")).toPandas()
    radius = np.full(len(pivots), -np.inf)
    radius[cells["cell"]] = cells["radius"]
    radius[radius < 0] = 0.0
    if k < int(spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000")) and (cells["n"] > block_rows).any():
        # In a cell too large for a block, only the k smallest ids of equal points can be neighbours.  Spark drops the
        # other copies before the shuffle as long as k is below that setting.
        large = F.col("cell").isin([int(c) for c in cells["cell"][cells["n"] > block_rows]])
        same = Window.partitionBy("cell", "x").orderBy("tid")
        fewer = placed.where(large).withColumn("copy", F.row_number().over(same)).where(F.col("copy") <= k).drop("copy")
        placed = materialize(placed.where(~large).unionByName(fewer), "knn-cells")
        cells = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("r").alias("radius")).toPandas()
    found_cells = (pivots, cells["cell"].to_numpy(), radius, k, dims)
    # How many queries each cell gets is counted first: vectors are only copied to cells that rule out enough.
    counted = _candidate_cells(queries, *found_cells, counts_only=True).groupBy("cell").agg(F.sum("n").alias("wanted")).where("wanted > 0")
    wanted = counted.toPandas()
    n_queries = queries.count()
    sizes = list(cells.merge(wanted, on="cell")[["cell", "n", "wanted"]].itertuples(index=False))
    if _cost(sizes, block_rows) > _cost([(0, cells["n"].sum(), n_queries)], block_rows):
        # Cells rule out too little to be worth their copies: one cell, blocks only.
        sizes = [(0, cells["n"].sum(), n_queries)]
        placed, pairs = placed.withColumn("cell", F.lit(0)), queries.withColumn("cell", F.lit(0))
    else:
        pairs = materialize(_candidate_cells(queries, *found_cells), "knn-pairs")
    plan = [(int(cell), _blocks(points, block_rows), _blocks(asked, block_rows)) for cell, points, asked in sizes]
    # At most MAX_PIVOTS rows: how many blocks each side of a cell is cut into.
    blocks = F.broadcast(literal_table(spark, plan, "cell INT, t_blocks INT, q_blocks INT"))
    key = ["cell", "t_block", "q_block"]
    if dims > CODED_DIMS:
        return _coded_neighbors(queries, placed, pairs, blocks, pivots, k, dims, schema)

    left, right = _dealt(placed.select("cell", "tid", "label", "x"), pairs, blocks, key)

    def answer(points: pa.Table, asked: pa.Table) -> pa.Table:
        tids, labels, qids = (_whole(c) for c in (points["tid"], points["label"], asked["qid"]))
        if len(points) == 0 or len(asked) == 0:
            found = nearest(np.empty((0, dims)), np.empty((0, dims)), np.empty(0), k)
        else:
            found = nearest(_matrix(asked["x"], dims), _matrix(points["x"], dims), _sort_key(tids), k)
        return pa.Table.from_batches([_answer(qids, tids, labels, *found)])

    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(answer, schema)


def _dealt(points: DataFrame, pairs: DataFrame, blocks: DataFrame, key: list[str], by: str = "tid") -> tuple[DataFrame, DataFrame]:
    """Points and queries by block: each point goes to every block of its cell's queries, each query to every block of its points."""

    def block(value: str, count: str):
        return F.pmod(F.xxhash64(value), F.col(count)).cast("int")

    def copies(count: str):
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    left = points.join(blocks, "cell").withColumn("t_block", block(by, "t_blocks")).withColumn("q_block", copies("q_blocks"))
    right = pairs.join(blocks, "cell").withColumn("q_block", block("qid", "q_blocks")).withColumn("t_block", copies("t_blocks"))
    return left.select(*key, *(c for c in points.columns if c != "cell")), right.select(*key, "qid", "x")


def _codes(placed: DataFrame, pivots: np.ndarray, dims: int) -> DataFrame:
    """Each point's approximation: its offset from its pivot in one byte per entry, the unit, and how far off that is.

    The distance from a query to the decoded point is off by no more than
    ``err``, the distance between point and decoded point, rounded up.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points, home = _matrix(batch.column("x"), dims), batch.column("home").to_numpy()
            offset = points - pivots[home]
            unit = np.abs(offset).max(axis=1, initial=0.0) / 127.0
            code = np.rint(offset / np.where(unit > 0, unit, 1.0)[:, None]).astype(np.int8)
            gap = points - (pivots[home] + code * unit[:, None])
            err = np.sqrt(np.einsum("ij,ij->i", gap, gap)) * (1 + 1e-9) + 1e-12 * (1 + np.abs(points).max(axis=1, initial=0.0))
            data = pa.py_buffer(code.tobytes())
            codes = pa.FixedSizeBinaryArray.from_buffers(pa.binary(dims), len(points), [None, data]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("cell", "row", "home")), codes, pa.array(unit), pa.array(err)], ["cell", "row", "home", "code", "unit", "err"]
            )

    return placed.mapInArrow(encode, "cell int, row long, home int, code binary, unit double, err double")


def _between(queries: np.ndarray, decoded: np.ndarray, err: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Query index, point index, lower and upper bound of the distance, of the points that can be among the ``k`` nearest."""
    return tuple(np.concatenate(p) for p in zip(*_between_tiles(queries, decoded, err, k)))


def _between_tiles(queries: np.ndarray, decoded: np.ndarray, err: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """What :func:`_between` finds, from no more than ``TILE`` distances (or one query's) at a time."""
    squares = np.einsum("ij,ij->i", decoded, decoded)
    step = max(1, TILE // len(decoded))
    for start in range(0, len(queries), step):
        q = queries[start : start + step]
        own = np.einsum("ij,ij->i", q, q)
        rough = np.sqrt(np.maximum(own[:, None] + squares[None, :] - 2.0 * (q @ decoded.T), 0.0))
        # A rounding error of a square may show as its root.
        slack = np.sqrt(16.0 * (q.shape[1] + 8) * np.finfo(float).eps * (own + squares.max()))[:, None]
        low, high = rough - err[None, :] - slack, rough + err[None, :] + slack
        reach = np.partition(high, min(k, len(decoded)) - 1, axis=1)[:, min(k, len(decoded)) - 1]
        if len(decoded) < k:
            reach = np.full(len(q), np.inf)
        qi, ti = np.nonzero(low <= reach[:, None])
        yield qi + start, ti, low[qi, ti], high[qi, ti]


def _coded_neighbors(
    queries: DataFrame, placed: DataFrame, pairs: DataFrame, blocks: DataFrame, pivots: np.ndarray, k: int, dims: int, schema: T.StructType
) -> DataFrame:
    """Neighbours of long vectors: codes an eighth the size meet the queries, whole vectors only where bounds leave a doubt.

    Every block keeps the points whose lower bound is within the k-th upper bound; of these, only those within the
    k-th upper bound over all blocks are measured.
    """
    key = ["cell", "t_block", "q_block"]
    codes = materialize(_codes(placed, pivots, dims), "knn-codes")
    left, right = _dealt(codes, pairs, blocks, key, "row")
    qid_type = queries.schema["qid"].dataType
    bounds = T.StructType([
        T.StructField("qid", qid_type), T.StructField("row", T.LongType()), T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType()),
    ])

    names = ["qid", "x", "row", "home", "code", "unit", "err"]
    both = right.select(*key, "qid", "x").unionByName(left, allowMissingColumns=True)

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A block holds few points and few queries; what they find may be more, and leaves tile by tile.
        block = pa.Table.from_batches([batch.select(names) for batch in batches])
        is_point = pc.is_valid(block["row"])
        points, asked = block.filter(is_point), block.filter(pc.invert(is_point))
        del block
        if len(points) == 0 or len(asked) == 0:
            return
        code = np.frombuffer(b"".join(points["code"].to_pylist()), np.int8).reshape(-1, dims)
        home, unit, err = (points[c].to_numpy() for c in ("home", "unit", "err"))
        qids, rows = _whole(asked["qid"]), _whole(points["row"])
        for qi, ti, low, high in _between_tiles(_matrix(asked["x"], dims), pivots[home] + code * unit[:, None], err, k):
            yield pa.RecordBatch.from_arrays([qids.take(pa.array(qi)), rows.take(pa.array(ti)), pa.array(low), pa.array(high)], bounds.names)

    kept = both.groupBy(*key).applyInArrow(bounded, bounds)
    by_query = Window.partitionBy("qid")
    kth = F.nth_value("high", k).over(by_query.orderBy("high").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    candidates = kept.withColumn("reach", kth).where(F.col("reach").isNull() | (F.col("low") <= F.col("reach"))).select("qid", "row")
    candidates = materialize(candidates, "knn-candidates")
    told = candidates.join(placed.select("row", "tid", "label", F.col("x").alias("tx")), "row").join(queries.select("qid", "x"), "qid")

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q, p = _matrix(batch.column("x"), dims), _matrix(batch.column("tx"), dims)
            d2 = np.zeros(len(q))
            for j in range(dims):
                gap = q[:, j] - p[:, j]
                d2 += gap * gap
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("qid", "tid", "label")), pa.array(d2)], schema.names)

    return told.mapInArrow(measured, schema)


def _block_bytes(spark: SparkSession) -> int:
    """Bytes of points in a block: a share of the memory that a core has."""
    local = spark.conf.get("spark.master", "").startswith("local[")
    memory = spark.conf.get("spark.driver.memory" if local else "spark.executor.memory", "1g").lower().removesuffix("b")
    units = {"k": 10, "m": 20, "g": 30, "t": 40}
    size = int(memory[:-1]) << units[memory[-1]] if memory[-1] in units else int(memory)
    cores = spark.sparkContext.defaultParallelism if local else int(spark.conf.get("spark.executor.cores", "1"))
    return min(MAX_BLOCK_BYTES, max(1 << 20, int(size * BLOCK_SHARE / max(1, cores))))


def neighbors(
    queries: DataFrame,
    train: DataFrame,
    k: int = 3,
    method: str = "auto",
    skip_same_id: bool = False,
    block_rows: int | None = None,
) -> DataFrame:
    """The ``k`` nearest training rows of every query: ``(qid, tid, label, d2, place)``.

    ``queries(qid, x)`` and ``train(tid, x, label)`` are scans or stored tables,
    as they are read more than once, with numeric arrays of one length (else an
    error).  A row without a vector, or with a missing entry in it, has no
    neighbours and is none.  With ``skip_same_id`` a row is not its own
    neighbour.  ``method`` is ``broadcast`` (an error beyond the limits),
    ``pruned``, or ``auto``: broadcast when the training rows, with their ids and
    labels, fit the limits.  With fewer than ``k`` training rows all are neighbours.
    """
    if method not in ("auto", "broadcast", "pruned"):
        raise ValueError(f"unknown method: {method}")
    whole = F.col("x").isNotNull() & ~F.exists("x", lambda v: v.isNull())
    queries = spread(queries.select("qid", F.col("x").cast("array<double>").alias("x")).where(whole), "qid")
    train = train.select("tid", F.col("x").cast("array<double>").alias("x"), "label").where(whole)
    texts = F.coalesce(F.octet_length(F.col("tid").cast("string")), F.lit(0)) + F.coalesce(F.octet_length(F.col("label").cast("string")), F.lit(0))
    rows, shortest, dims, text_bytes = train.agg(F.count("*"), F.min(F.size("x")), F.max(F.size("x")), F.sum(texts.cast("bigint"))).first()
    if shortest != dims:
        raise ValueError(f"training vectors have between {shortest} and {dims} entries")
    wrong_size = F.raise_error(F.concat(F.lit(f"a query vector does not have {dims} entries: "), F.size("x").cast("string")))
    if rows:
        queries = queries.withColumn("x", F.when(F.size("x") == dims, F.col("x")).otherwise(wrong_size.cast("array<double>")))
    fits = rows <= BROADCAST_ROWS and rows * (dims or 0) * 8 + (text_bytes or 0) <= BROADCAST_BYTES
    if method == "broadcast" and not fits:
        raise ValueError(f"{rows} training rows are too large to broadcast")
    wanted = k + 1 if skip_same_id else k
    schema = T.StructType(
        [
            T.StructField("qid", queries.schema["qid"].dataType),
            T.StructField("tid", train.schema["tid"].dataType),
            T.StructField("label", train.schema["label"].dataType),
            T.StructField("d2", T.DoubleType()),
        ]
    )
    if rows == 0:
        found = train.sparkSession.createDataFrame([], schema)
    elif method == "broadcast" or (method == "auto" and fits):
        found = _broadcast_neighbors(queries, train, wanted, dims, schema)
    else:
        size = block_rows or max(256, min(MAX_BLOCK_ROWS, _block_bytes(train.sparkSession) // (8 * dims)))
        found = _pruned_neighbors(queries, train, rows, wanted, dims, schema, size)
    if skip_same_id:
        found = found.where(F.col("qid") != F.col("tid"))
    order = Window.partitionBy("qid").orderBy("d2", "tid")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def vote(found: DataFrame) -> DataFrame:
    """Label with most votes per query, ties to the nearer, then the smaller label."""
    votes = found.groupBy("qid", "label").agg(F.count("*").alias("votes"), F.min("place").alias("first"))
    best = F.min(F.struct((-F.col("votes")).alias("minus_votes"), "first", "label"))
    return votes.groupBy("qid").agg(best.alias("best")).select("qid", F.col("best.label").alias("predicted"))


def classify(queries: DataFrame, train: DataFrame, k: int = 3, **options) -> DataFrame:
    """``(qid, predicted)`` for every query."""
    return vote(neighbors(queries, train, k, **options))
