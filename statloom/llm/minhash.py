"""MinHash near-dedup with bottom-k sketches of one hash function.

1. Every document's set of word shingles is hashed; documents with equal sets
   (128-bit digest) become one class, so copies cost one row each.
2. A class keeps the smallest hashes as its sketch.  Inverted lists of the
   retained values, rarest first, bring together classes that can overlap
   enough: if two sketches share ``least`` values, their first ``size - least +
   1`` rarest values meet.  Two sets of Jaccard 0.75 share fewer with a chance
   of about one in a million.  Short sketches find the few classes that meet
   anyone; for these, longer sketches repeat the step with less to spare.
3. What is left in a sketch after the first value that it shares with another
   bounds what the two have in common, and so, with the sizes, which pairs can be
   similar at all.  The sketch of the union estimates the similarity and filters;
   the exact Jaccard of the full sets decides.
4. First each list is tried against one member only, its pivot, the one whose
   values are the most common.  What that already joins needs no further pair.
   Of members of other components, two that are similar have many differences
   from the pivot in common, and so meet in inverted lists of these; edits are
   mostly private, so the lists are short.  Large groups of near copies thus cost
   rows in proportion to their members, and no link between components is lost.

Defined cases: a text that is null or has no words has an empty set and links
with nothing; fewer than five words make one shingle; rows that repeat a
document share its component; a row without an id links with nothing and stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.llm.common import components
from statloom.llm.hashing import hash_words, mixed, text_slices, window_hashes
from statloom.storage import materialize

SHINGLE = 5
#: Similarity in hundredths.
ALIKE = 75
#: Sketch size, and how many values the sketches of two similar sets share at least: first of all classes, then of those
#: that meet others.
K, LEAST = 64, 28
K_LONG, LEAST_LONG = 512, 336
#: How much two long sketches may understate the share of common values (with that same chance).
MARGIN = 0.08


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for first, end, data, offsets in text_slices(column):
        words = hash_words(data, offsets, lower=True)
        runs = words.runs(end - first)
        for a, b in zip(runs, runs[1:]):
            h = words.hash[a:b]
            if b - a >= SHINGLE:
                yield np.unique(window_hashes(h, SHINGLE).view(np.int64))
            elif b > a:
                yield window_hashes(h, int(b - a), 1).view(np.int64)
            else:
                yield np.empty(0, np.int64)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*arrays, np.empty(0, np.int64)])))


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, ones, twos, sketches = [], [], [], []
        for s in shingle_sets(batch.column("text")):
            u = s.view(np.uint64)
            sizes.append(len(s))
            ones.append(int(mixed(u, 11).sum(dtype=np.uint64).astype(np.int64)))
            twos.append(int(mixed(u, 12).sum(dtype=np.uint64).astype(np.int64)))
            sketches.append(s[:K].copy())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(ones, pa.int64()), pa.array(twos, pa.int64()), _lists(sketches)],
            ["doc_id", "n", "one", "two", "sketch"],
        )


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        while at < batch.num_rows:  # sets leave in small batches: a text may be very long
            part = batch.slice(at, 256)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), _lists(list(shingle_sets(part.column("text"))))], ["doc_id", "shingles"])
            at += 256


def _prefix(sketches: DataFrame, k: int, least: int, name: str) -> DataFrame:
    """``(value, doc_id, n, left, weight)``: the rarest values of each sketch, as many as similar sets must share one of.

    ``left`` values of the sketch, this one and more frequent ones, are in other
    sketches, too.  ``weight`` is how often others have a value on average.
    """
    values = sketches.select("doc_id", "n", F.explode("sketch").alias("value"))
    shared = materialize(values.groupBy("value").agg(F.count("*").alias("df")).where("df > 1"), f"minhash-values-{name}")
    size = F.least("n", F.lit(k))
    # Up to three quarters of the sketch size, partners' sketches are their whole sets; a union that the sketches hold
    # whole has no fewer common values than the similarity asks for, a larger one ``least``.
    whole = F.ceil(F.col("n") * ALIKE / 100)
    needed = F.when(F.col("n") <= k * ALIKE // 100, whole).otherwise(F.least(whole, F.lit(least)))
    rare = F.array_distinct(F.sort_array(F.collect_list(F.struct("df", "value"))))
    kept = values.join(shared, "value").groupBy("doc_id", "n").agg(rare.alias("kept"))
    # Values of one document only come first in the order and meet nobody.
    slots = (size - needed + 1) - (size - F.size("kept"))
    weight = F.aggregate("kept", F.lit(0.0), lambda total, v: total + v["df"]) / size
    some = kept.withColumns({"slots": slots.cast("int"), "weight": weight, "met": F.size("kept")}).where("slots > 0")
    places = some.select("doc_id", "n", "met", "weight", F.posexplode(F.slice("kept", F.lit(1), F.col("slots")).getField("value")).alias("place", "value"))
    return places.select("value", "doc_id", "n", (F.col("met") - F.col("place")).alias("left"), "weight")


def _possible(na: Column, left_a: Column, nb: Column, left_b: Column) -> Column:
    """Whether sets of these sizes can be similar if this value is the first that their sketches share.

    Then no more than what is left in either order can be common.  Sketches that
    are whole sets bound the intersection exactly.  Otherwise the larger set's
    sketch is a sample of it, and both sketches hold what of the intersection is
    in that sample, so that share bounds it but for chance.
    """
    larger, left = F.greatest(na, nb), F.least(left_a, left_b)
    common = F.when(larger > K_LONG, larger * (left / K_LONG + MARGIN)).otherwise(left)
    return (F.least(na, nb) * 100 >= larger * ALIKE) & (common * (100 + ALIKE) >= (na + nb) * ALIKE)


def _estimated(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs whose union sketch does not rule out the similarity."""
    side = lambda s: sketches.select(F.col("doc_id").alias(s), F.col("sketch").alias(f"s{s}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    union = F.slice(F.sort_array(F.array_union("sa", "sb")), 1, K_LONG)
    common = F.size(F.array_intersect(F.array_intersect("sa", "sb"), union))
    return both.where(common * K_LONG >= F.size(union) * LEAST_LONG).select("a", "b")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs whose full sets are similar."""
    side = lambda s: sets.select(F.col("doc_id").alias(s), F.col("shingles").alias(f"s{s}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - common
    return both.where(common * 100 >= union * ALIKE).select("a", "b")


def _across(around: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of members of one pivot, from two components, that can be similar; each pair once.

    ``around`` has each member (but the pivot) with size, pivot, the pivot's size and its component.  Similar sets x and y
    differ in no more than (n_x + n_y) / 7 values, and in D(x) + D(y) - 2 |common differences from the pivot|, D being
    the number of differences from it.  So they have at least

        (D(x) + D(y) - (n_x + n_y) / 7) / 2

    differences in common, which is more than none unless both are similar to the pivot (and so in one component).
    Inverted lists of the differences thus bring all of them together, and a member needs to be in the lists of its
    rarest ones only.  How many follows from the smallest number above over all partners: D(x) exceeds D(y) by no more
    than (n_x + n_y) / 7, so for a member farther from the pivot than its partner this is at least D - n / 3, for one
    nearer D - n / 6, and for one similar to the pivot, whose partner is not, over (D + (n_p - n) / 7) / 2.  Differences
    that one component only has come first in the order, and meet nobody.
    """
    side = lambda s, name: sets.select(F.col("doc_id").alias(s), F.col("shingles").alias(name))
    both = around.join(side("pivot", "sp"), "pivot").join(side("doc_id", "sx"), "doc_id")
    apart = F.concat(F.array_except("sx", "sp"), F.array_except("sp", "sx"))
    far = materialize(both.select("pivot", "np", "doc_id", "n", "component", apart.alias("apart")), "minhash-apart")
    each = far.select("pivot", "np", "doc_id", "n", "component", F.size("apart").alias("d"), F.explode("apart").alias("value"))
    shared = each.groupBy("pivot", "value").agg(F.count("*").alias("df"), F.min("component").alias("low"), F.max("component").alias("high"))
    shared = materialize(shared.where("low < high").select("pivot", "value", "df"), "minhash-apart-values")
    rare = F.sort_array(F.collect_list(F.struct("df", "value")))
    kept = each.join(shared, ["pivot", "value"]).groupBy("pivot", "np", "doc_id", "n", "component", "d").agg(rare.alias("kept"))
    similar = (100 + ALIKE) * F.col("d") <= (100 - ALIKE) * (F.col("n") + F.col("np"))
    least = F.when(similar, F.floor((F.col("d") + (F.col("np") - F.col("n")) / 7) / 2) + 1).otherwise(1)
    slots = lambda share: (F.size("kept") - F.greatest(least, F.ceil(F.col("d") - F.col("n") / share)) + 1).cast("int")
    slotted = kept.withColumns({"farther": slots(3), "nearer": slots(6), "met": F.size("kept")}).where("farther > 0")
    # A slice's places: the first ones hold for either role.
    places = slotted.select("*", F.posexplode(F.slice("kept", F.lit(1), F.greatest("farther", "nearer")).getField("value")).alias("place", "value"))
    rows = places.select("pivot", "value", "doc_id", "n", "component", "d", (F.col("met") - F.col("place")).alias("left"), (F.col("place") < F.col("nearer")).alias("near"))
    rows = materialize(rows, "minhash-apart-lists")
    role = lambda s: [F.col(c).alias(f"{c}_{s}") for c in ("doc_id", "n", "component", "d", "left")]
    met = rows.select("pivot", "value", *role("x")).join(rows.where("near").select("pivot", "value", *role("y")), ["pivot", "value"])
    nearer = F.struct("d_y", "doc_id_y") < F.struct("d_x", "doc_id_x")
    sizes = F.least("n_x", "n_y") * 100 >= F.greatest("n_x", "n_y") * ALIKE
    common = F.least("left_x", "left_y")
    enough = 2 * common * (100 + ALIKE) >= (F.col("d_x") + F.col("d_y")) * (100 + ALIKE) - (100 - ALIKE) * (F.col("n_x") + F.col("n_y"))
    pairs = met.where(nearer & sizes & enough & (F.col("component_x") != F.col("component_y")))
    return pairs.select(F.least("doc_id_x", "doc_id_y").alias("a"), F.greatest("doc_id_x", "doc_id_y").alias("b")).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, one row per row of ``docs (doc_id, text)``."""
    texts = docs.select("doc_id", "text")
    rows = materialize(texts.mapInArrow(_sketched, "doc_id long, n long, one long, two long, sketch array<long>"), "minhash-rows")
    classes = materialize(
        rows.where("n > 0 AND doc_id IS NOT NULL")
        .groupBy("n", "one", "two")
        .agg(F.min("doc_id").alias("doc_id"), F.first("sketch").alias("sketch")),
        "minhash-classes",
    )
    short = materialize(_prefix(classes, K, LEAST, "short"), "minhash-short")
    lists = short.groupBy("value").agg(F.count("*").alias("members")).where("members > 1")
    meeting = materialize(short.join(lists, "value", "left_semi").select("doc_id").distinct(), "minhash-meeting")
    sets = materialize(
        texts.join(meeting, "doc_id", "left_semi").mapInArrow(_full_sets, "doc_id long, shingles array<long>"), "minhash-sets"
    )
    sketches = materialize(
        sets.select("doc_id", F.size("shingles").cast("long").alias("n"), F.slice("shingles", 1, K_LONG).alias("sketch")), "minhash-sketches"
    )
    prefix = materialize(_prefix(sketches, K_LONG, LEAST_LONG, "long"), "minhash-prefix")

    # Each list against one member: the one whose values are the most common, as the text is that the others derive from.
    best = F.max(F.struct("weight", (-F.col("doc_id")).alias("minus"), "n", "left"))
    pivots = prefix.groupBy("value").agg(best.alias("best"), F.count("*").alias("members")).where("members > 1")
    pivots = materialize(
        pivots.select("value", "members", (-F.col("best.minus")).alias("pivot"), F.col("best.n").alias("np"), F.col("best.left").alias("lp")), "minhash-pivots"
    )
    members = prefix.join(pivots, "value")
    possible = _possible(F.col("np"), F.col("lp"), F.col("n"), F.col("left"))
    pair = [F.least("pivot", "doc_id").alias("a"), F.greatest("pivot", "doc_id").alias("b")]
    first = materialize(members.where((F.col("doc_id") != F.col("pivot")) & possible).select(*pair).distinct(), "minhash-stars")
    links = materialize(_verified(_estimated(first, sketches), sets), "minhash-links")
    found = materialize(components(links, "minhash"), "minhash-components")

    # Members of lists that still hold two components or more, a pivot's lists taken together.
    placed = members.where("members > 2").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    placed = placed.select("value", "pivot", "np", "doc_id", "n", F.coalesce("component", "doc_id").alias("component"))
    placed = materialize(placed, "minhash-placed")
    mixed_lists = placed.groupBy("value").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    still_mixed = placed.join(mixed_lists.select("value"), "value", "left_semi").where("doc_id <> pivot")
    around = materialize(still_mixed.select("pivot", "np", "doc_id", "n", "component").distinct(), "minhash-around")
    across = _across(around, sets)
    more = materialize(_verified(_estimated(materialize(across, "minhash-across"), sketches), sets), "minhash-more")
    if not more.isEmpty():
        found = materialize(components(links.union(more), "minhash"), "minhash-components")

    named = classes.select("n", "one", "two", F.col("doc_id").alias("node")).join(found, "node", "left")
    named = materialize(named.select("n", "one", "two", F.coalesce("component", "node").alias("component")), "minhash-named")
    joined = rows.select("doc_id", "n", "one", "two").join(named, ["n", "one", "two"], "left")
    component = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component", "doc_id"))
    return joined.select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept")
    )


def first_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with their columns, that no smaller id is linked to; of rows that repeat an id, all stay."""
    kept = materialize(near_duplicates(docs).where("NOT kept").select("doc_id").distinct(), "minhash-dropped")
    return docs.join(kept, "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
