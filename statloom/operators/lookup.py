"""Join many rows to a keyed table without one hot key filling a task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.functions import sql

BROADCAST_BYTES = 32 << 20
HOT_KEYS = 4096
HOT_KEY_BYTES = 1024
ROW_OVERHEAD = 64
SALTS = 16


def measure(right: DataFrame, weight: str) -> tuple[int, int]:
    """Stored bytes and total weight of a keyed table, for :func:`lookup_join`."""
    widths = [
        F.coalesce(F.octet_length(sql.name(f.name)), F.lit(0)) if f.dataType.typeName() == "string" else F.lit(8)
        for f in right.schema.fields
    ]
    found = right.agg(
        F.coalesce(F.sum(sum(widths, F.lit(ROW_OVERHEAD)).cast("bigint")), F.lit(0)),
        F.coalesce(F.sum(weight), F.lit(0)),
    )
    return tuple(found.first())


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    on: str,
    weight: str,
    how: str = "inner",
    broadcast_bytes: int | None = None,
    hot_keys: int | None = None,
    measured: tuple[int, int] | None = None,
    gathered: Sequence[str] = (),
    salt_by: str | None = None,
) -> DataFrame:
    """Join ``left`` to ``right`` (one row per ``on``) as inner, left or left_semi.

    ``weight`` in ``right`` tells about how many left rows carry the key.  A
    table within ``broadcast_bytes`` (BROADCAST_BYTES) is broadcast.  Beyond
    that both sides are shuffled by key and salt.  Every key has ``SALTS``
    salts, as the weight may be an estimate and left keys missing in ``right``
    have none; keys with at least 1/``hot_keys`` of the weight have more, in
    proportion.  There can be no more than ``hot_keys`` of those and each is
    short, so the list of them that is broadcast is bounded whatever the data.
    ``left`` is read once; ``right`` more than once, so pass a stored table.
    ``measured`` may bring what :func:`measure` gives.  Columns ``gathered``
    are listed per key and salt before the shuffle and taken apart after the
    join; ``salt_by`` then names a column, such as the task, that keeps rows
    together which can be listed.
    """
    broadcast_bytes = BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes
    hot_keys = HOT_KEYS if hot_keys is None else hot_keys
    size, total = measured or measure(right, weight)
    table = right if how != "left_semi" else right.select(on)
    columns = [sql.name(c) for c in [*left.columns, *(c for c in table.columns if c != on)]]
    if size <= broadcast_bytes:
        return left.join(F.broadcast(table), on, how).select(columns)
    is_hot = (F.col(weight) * hot_keys >= total) & (F.octet_length(on) <= HOT_KEY_BYTES) & (F.col(weight) > 0)
    more = F.when(is_hot, F.ceil(F.col(weight) * hot_keys / total)).otherwise(0).cast("int")
    salts = F.lit(SALTS) + F.coalesce(more, F.lit(0))
    hot = right.where(is_hot).select(on, salts.alias("_salts"))
    hashed = [sql.name(f.name) for f in left.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    salt = F.pmod(F.xxhash64(*([salt_by] if salt_by else hashed)), F.coalesce("_salts", F.lit(SALTS))).cast("int")
    salted = left.join(F.broadcast(hot), on, "left").withColumn("_salt", salt).drop("_salts")
    if gathered:
        salted = salted.groupBy(on, "_salt").agg(F.collect_list(F.struct(*map(sql.name, gathered))).alias("_rows"))
    counted = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    copies = counted if how != "left_semi" else counted.select(on, "_salt")
    # Keys are unique on the right, so a semi join is an inner one; Spark would move the former below the listing.
    joined = salted.join(copies.hint("merge"), [on, "_salt"], "inner" if gathered and how == "left_semi" else how)
    if gathered:
        joined = joined.select("*", F.inline("_rows"))
    return joined.select([c for c in columns if not gathered or c != sql.name(salt_by or "")])
