"""Reproducible holdouts, positional cuts and labelled unions.

All splits end as a comparison with a literal: no join against a list of drawn
ids, no sort of the whole table, no window over all rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.functions import sql
from statloom.storage import materialize

# Slots per pass: few where many tasks each hold them, more where rows are few.
BINS = 4096
FINE_BINS = 1 << 16
FEW_ROWS = 1 << 20
# Cuts of the sketch that brackets a rank, and its error as a share of the rows.
STEPS = 1024
ACCURACY = 10_000
# Keys between the brackets that the driver looks through; more are stored.
SMALL_BRACKET = 100_000


def drawn(row_id: Column | str, fraction: float, seed: int = 42) -> Column:
    """True for about ``fraction`` of the ids, decided by each id alone."""
    row_id = F.col(row_id) if isinstance(row_id, str) else row_id
    digest = F.md5(F.concat(F.lit(f"{seed}:"), row_id.cast("string")))
    if fraction >= 1:
        return F.lit(True)
    return F.substring(digest, 1, 8) < F.lit(f"{int(fraction * 2**32):08x}")


def draw_key(row_id: Column | str, seed: int = 42) -> Column:
    """60 bits of the seeded digest: a shuffled order of the ids."""
    row_id = F.col(row_id) if isinstance(row_id, str) else row_id
    digest = F.md5(F.concat(F.lit(f"{seed}:"), row_id.cast("string")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def _nth_in(df: DataFrame, n: int, low: int, high: int, total: int) -> int:
    """The ``n``-th smallest ``key`` of a stored table ``(key, n)``: counts in equal slots of the value range, then in the right slot."""
    bins = FINE_BINS if total <= FEW_ROWS else BINS
    while low < high:
        width = (high - low) // bins + 1
        slots = (
            df.where(F.col("key").between(low, high))
            .groupBy(F.expr(f"key div {width}L").alias("slot"))
            .agg(F.sum("n").alias("rows"), F.min("key").alias("low"), F.max("key").alias("high"))
            .collect()
        )
        for slot in sorted(slots, key=lambda s: s["low"]):
            if n <= slot["rows"]:
                low, high = slot["low"], slot["high"]
                break
            n -= slot["rows"]
    return low


def _nth_text(df: DataFrame, n: int, low: str, high: str) -> str:
    """As :func:`_nth_in` for text: slots are the next two bytes after what all remaining keys share."""
    data = F.col("key").cast("binary")
    while low < high:
        first, last = low.encode(), high.encode()
        shared = next((i for i, (a, b) in enumerate(zip(first, last)) if a != b), min(len(first), len(last)))
        slots = (
            df.where(F.col("key").between(low, high))
            .groupBy(F.substring(data, shared + 1, 2).alias("slot"))
            .agg(F.sum("n").alias("rows"), F.min("key").alias("low"), F.max("key").alias("high"))
            .collect()
        )
        for slot in sorted(slots, key=lambda s: s["low"].encode()):
            if n <= slot["rows"]:
                low, high = slot["low"], slot["high"]
                break
            n -= slot["rows"]
    return low


def _nth_stored(counted: DataFrame, n: int):
    low, high, total = counted.agg(F.min("key"), F.max("key"), F.sum("n")).first()
    return _nth_text(counted, n, low, high) if isinstance(low, str) else _nth_in(counted, n, low, high, total)


def _number(df: DataFrame, key: str) -> Column:
    """A number in the order of the keys: integers themselves, or the first seven bytes of a text."""
    kind, column = df.schema[key].dataType.typeName(), F.col(sql.name(key))
    if kind == "string":
        return F.conv(F.rpad(F.hex(F.substring(column.cast("binary"), 1, 7)), 14, "0"), 16, 10).cast("bigint")
    if kind not in ("byte", "short", "integer", "long"):
        raise ValueError(f"keys are integers or text, not {kind}: {key}")
    return column


def _widened(value: int, sign: int) -> int:
    """A value of the sketch, which works on doubles, moved out by what that may have rounded off."""
    return max(-(1 << 63), min((1 << 63) - 1, value + sign * ((abs(value) >> 51) + 1)))


def _nth(df: DataFrame, key: str, rank: Callable[[int, int], int], tie: str | None = None) -> tuple | None:
    """The key, and the ``tie`` in the order of equal keys, of the row with rank ``rank(rows, rows with a key)``; two scans.

    The first scan merges quantile sketches into two values that have the rank
    between them; the second counts the keys up to the upper one, those below
    the lower one as one number.
    """
    number, column = _number(df, key), F.col(sql.name(key))
    cuts = F.percentile_approx(number, [i / STEPS for i in range(STEPS + 1)], ACCURACY)
    rows, total, grid = df.agg(F.count("*"), F.count(column), cuts).first()
    n = rank(rows, total)
    if n < 1 or total == 0:
        return None
    n, error = min(n, total), 2 / ACCURACY
    first, last = math.floor((n / total - error) * STEPS), math.ceil((n / total + error) * STEPS)
    low = _widened(grid[first], -1) if first > 0 else None
    high = _widened(grid[last], 1) if last < STEPS else None
    while True:
        inside = F.lit(True) if low is None else number >= low
        known = df.where(column.isNotNull() if high is None else number <= high)
        keys = [F.when(inside, column).alias("key"), F.when(inside, F.col(sql.name(tie)) if tie else None).alias("tie")]
        counted = known.groupBy(*keys).agg(F.count("*").alias("n"))
        # Numbers are this close together by the sketch; texts may all begin alike.
        expected = total if df.schema[key].dataType.typeName() == "string" else total * (2 * error + 2 / STEPS)
        few = counted.limit(SMALL_BRACKET + 1).collect() if expected < SMALL_BRACKET else None
        if few is not None and len(few) <= SMALL_BRACKET:
            left = n - sum(r["n"] for r in few if r["key"] is None)
            order = lambda v: v.encode() if isinstance(v, str) else v
            if left > 0:
                for r in sorted((r for r in few if r["key"] is not None), key=lambda r: (order(r["key"]), order(r["tie"]) if tie else 0)):
                    left -= r["n"]
                    if left <= 0:
                        return r["key"], r["tie"]
        else:
            stored = materialize(counted, "rank")
            below, within = stored.agg(F.coalesce(F.sum(F.when(F.col("key").isNull(), F.col("n"))), F.lit(0)), F.count("key")).first()
            bracket = stored.where("key IS NOT NULL")
            if below < n and within and n <= below + bracket.agg(F.sum("n")).first()[0]:
                value = _nth_stored(bracket.select("key", "n"), n - below)
                if not tie:
                    return value, None
                before = bracket.where(F.col("key") < F.lit(value)).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
                return value, _nth_stored(bracket.where(F.col("key") == F.lit(value)).select(F.col("tie").alias("key"), "n"), n - below - before)
        if low is None and high is None:
            return None
        low = high = None  # not between the brackets: the sketch's error was larger than it says


def nth_smallest(df: DataFrame, key: str, n: int):
    """The ``n``-th smallest value of an integer or text column, counted from 1; nulls don't count; the last one if there are fewer.

    Two scans, however many rows: see :func:`_nth`.  Text is in the order of its bytes.
    """
    found = _nth(df, key, lambda rows, total: n)
    return found and found[0]


def first_rows(df: DataFrame, key: str, n: int) -> Column:
    """True for the ``n`` rows with the smallest ``key`` (unique integers)."""
    cut = nth_smallest(df, key, n)
    return F.lit(False) if cut is None else F.col(key) <= F.lit(cut)


def positional_holdout(df: DataFrame, key: str, ratio: float) -> DataFrame:
    """``is_test`` for the first ``floor(rows * ratio)`` rows in ``key`` order, integers or text.

    Rows without a key come last and are never test rows.
    """
    cut = _nth(df, key, lambda rows, total: min(total, int(rows * ratio)))
    is_test = F.lit(False) if cut is None else F.coalesce(F.col(key) <= F.lit(cut[0]), F.lit(False))
    return df.withColumn("is_test", is_test)


def counted_holdout(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``is_test`` for exactly ``n`` rows drawn without replacement.

    No more than half of the rows are drawn.  The draw order is the seeded
    digest, then the id (an integer or text); the last drawn row becomes the
    literal cut.  Rows without an id are never drawn.
    """
    keys = df.select(F.col(key).alias("id"), draw_key(key, seed).alias("draw")).where("id IS NOT NULL")
    last = _nth(keys, "draw", lambda rows, total: min(n, rows // 2), "id")
    if last is None:
        return df.withColumn("is_test", F.lit(False))
    draw = draw_key(key, seed)
    is_test = (draw < last[0]) | ((draw == last[0]) & (F.col(key) <= last[1]))
    return df.withColumn("is_test", F.coalesce(is_test, F.lit(False)))


def labelled_union(positive: DataFrame, negative: DataFrame, name: str = "y", codes=(1, -1)) -> DataFrame:
    """Two sources in one table, each tagged with its class."""
    return positive.withColumn(name, F.lit(codes[0])).unionByName(negative.withColumn(name, F.lit(codes[1])))
