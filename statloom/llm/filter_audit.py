"""Filter interaction audit: what each of five filters removes, alone and in every order.

1. Every document gets a mask of the filters that it fails.  Documents with the
   same mask, part and labels count the same in every order, so the corpus
   shrinks to cells ``(part, mask)`` with their document counts: 32 for a part.
2. A cell folds across the array of all orders: for each order one ``aggregate``
   carries whether the cell is still there through the filters, and ``transform``
   makes 120 x 5 = 600 structs of counts out of it, weighted by the cell.
3. The 600 structs of a part's cells are summed element by element; Shapley sums
   are folds over the result.

Filters: ``A`` under 100 words; ``B`` distinct words under 80 % of the words;
``C`` over 10 % of the code points in A-Z; ``D`` holds any of ``#$%&*|``; ``E``
the text is that of a smaller id, anywhere in the table.  Words are runs without
ASCII white space, case-sensitive.

Defined cases: a null text is empty; a null ``lang`` belongs to the part ``''``;
equal empty texts are copies like any other; rows that repeat an id with the same
text count one by one, and none of them is a copy of the other; a row without an
id is never a copy and makes no row one; labels that repeat an id count if any of
them says 1; a table without rows has no parts.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.llm.common import let, words_of

FILTERS = "ABCDE"
MIN_WORDS = 100
MIN_DISTINCT_PERCENT = 80
MAX_UPPER_PERCENT = 10
SYMBOLS = "[#$%&*|]"
#: What is counted at each step, and of which documents of a cell.
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_failures(text: Column) -> Column:
    """Bits of the filters that need the text alone: 1 for A, 2 for B, 4 for C, 8 for D."""

    def of(words: Column) -> Column:
        n = F.size(words)
        few = F.when(n < MIN_WORDS, 1).otherwise(0)
        return few + F.when(100 * F.size(F.array_distinct(words)) < MIN_DISTINCT_PERCENT * n, 2).otherwise(0)

    upper = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    shouting = F.when(100 * upper > MAX_UPPER_PERCENT * F.length(text), 4).otherwise(0)
    return let(words_of(text), of) + shouting + F.when(text.rlike(SYMBOLS), 8).otherwise(0)


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, mask, n, good, toxic)``: documents of ``docs (doc_id, text, lang)`` by the filters that they fail.

    Texts are read once and leave their task as a digest only.  Rows without an
    id meet no label; they are dealt out by their text instead of all together.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id",
        F.coalesce("lang", F.lit("")).alias("part"),
        F.unhex(F.md5(text)).alias("digest"),
        F.length(text).alias("n_chars"),
        text_failures(text).alias("fails"),
        F.when(F.col("doc_id").isNull(), F.xxhash64(text)).otherwise(F.lit(0)).alias("dealt"),
    )
    marks = (
        labels.where("doc_id IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.max(F.col("quality").eqNullSafe(1)).alias("good"), F.max(F.col("toxic").eqNullSafe(1)).alias("toxic"))
        .withColumn("dealt", F.lit(0).cast("bigint"))
    )
    # Copies with one id and one label are one row from here on; so a large group of copies is as many rows as it has ids.
    same = ["digest", "n_chars", "part", "fails", "good", "toxic"]
    marked = rows.join(marks, ["doc_id", "dealt"], "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    # Of each kind of row of a text: all rows, those with its smallest id, and that id.
    by_id = marked.groupBy(*same, "doc_id").agg(F.count("*").alias("n"))
    kinds = by_id.groupBy(*same).agg(
        F.sum("n").alias("n"),
        F.min("doc_id").alias("first"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("least"),
        F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("without_id"),
    )
    # A text has few kinds: its parts and labels.  Where its smallest id is, rows with that id are no copies.
    entry = F.struct("part", "fails", "good", "toxic", "n", "first", F.coalesce("least.n", F.lit(0)).alias("n_first"), "without_id")
    texts = kinds.groupBy("digest", "n_chars").agg(F.min("first").alias("smallest"), F.collect_list(entry).alias("kinds"))
    kind = texts.select("smallest", F.inline("kinds"))
    originals = F.col("without_id") + F.when(F.col("first") == F.col("smallest"), F.col("n_first")).otherwise(0)
    both = kind.select(
        "part", "good", "toxic",
        F.explode(F.array(
            F.struct(F.col("fails").alias("mask"), originals.alias("n")),
            F.struct((F.col("fails") + 16).alias("mask"), (F.col("n") - originals).alias("n")),
        )).alias("cell"),
    )
    weight = lambda c: F.coalesce(F.sum(F.when(F.col(c), F.col("cell.n"))), F.lit(0)).alias(c)
    return both.groupBy("part", F.col("cell.mask").alias("mask")).agg(F.sum("cell.n").alias("n"), weight("good"), weight("toxic"))


def all_orders() -> Column:
    """The 120 orders of the filters as an array of arrays of bit values, a constant of the plan."""
    return F.lit([[1 << FILTERS.index(f) for f in order] for order in permutations(FILTERS)])


def _step(there: Column, bit: Column) -> Column:
    """Counts of one cell at one step: ``there`` says whether it has passed all filters before."""
    mask = F.col("mask")
    fails = mask.bitwiseAND(bit) != 0
    count = lambda when, n: F.when(when, F.col(n)).otherwise(F.lit(0)).cast("bigint")
    return F.struct(
        count(there & ~fails, "n").alias("kept"),
        count(there & fails, "n").alias("removed"),
        count(~there & fails, "n").alias("redundant"),
        count(mask == bit, "n").alias("unique_fails"),
        count(there & fails, "good").alias("good_lost"),
        count(there & fails, "toxic").alias("toxic_lost"),
    )


def _steps(order: Column) -> Column:
    """One struct for each step of an order: the fold carries the filters applied so far."""
    start = F.struct(F.lit(0).alias("before"), F.array().cast(f"array<struct<{', '.join(f'{c}: bigint' for c in COUNTS)}>>").alias("steps"))

    def apply(state: Column, bit: Column) -> Column:
        there = F.col("mask").bitwiseAND(state["before"]) == 0
        return F.struct(
            state["before"].bitwiseOR(bit).alias("before"), F.concat(state["steps"], F.array(_step(there, bit))).alias("steps")
        )

    return F.aggregate(order, start, apply, lambda state: state["steps"])


def _added(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda a, b: F.struct(*((a[c] + b[c]).alias(c) for c in COUNTS)))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, filter_order, step)`` with COUNTS and ``shapley``: 600 rows for each part."""
    folded = cells(docs, labels).select("part", F.flatten(F.transform(all_orders(), _steps)).alias("steps"))
    # At most 32 cells of 600 structs for a part.
    zeros = F.array_repeat(F.struct(*(F.lit(0).cast("bigint").alias(c) for c in COUNTS)), 600)
    merged = folded.groupBy("part").agg(F.collect_list("steps").alias("cells"))
    merged = merged.select("part", F.aggregate("cells", zeros, _added).alias("steps"))
    at_step = F.lit([FILTERS.index(letter) for order in permutations(FILTERS) for letter in order])
    none = F.array_repeat(F.lit(0).cast("bigint"), len(FILTERS))
    removed = F.zip_with("steps", at_step, lambda s, i: F.struct(i.alias("filter"), s["removed"].alias("n")))
    add = lambda sums, s: F.transform(sums, lambda total, i: total + F.when(i == s["filter"], s["n"]).otherwise(0))
    merged = merged.withColumn("shapley", F.aggregate(removed, none, add))
    orders = F.lit(["".join(order) for order in permutations(FILTERS)])
    place = F.col("place")
    rows = merged.select("part", "shapley", F.posexplode("steps").alias("place", "at"))
    named = rows.withColumns({
        "filter_order": F.get(orders, F.floor(place / 5).cast("int")), "step": (place % 5 + 1).cast("int"),
    })
    letter = F.substring(F.col("filter_order"), F.col("step"), F.lit(1))
    own = F.get("shapley", F.instr(F.lit(FILTERS), letter) - 1)
    return named.select("part", "filter_order", "step", *(F.col(f"at.{c}").alias(c) for c in COUNTS), own.alias("shapley"))
