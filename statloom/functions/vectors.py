"""Vector and bitmap expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


def components(x: str, dims: int) -> list[Column]:
    """The first ``dims`` entries of an array column as separate doubles."""
    return [F.col(x)[j].cast("double") for j in range(dims)]


def linear_score(xs: Sequence[Column], w: Sequence[float], b: float) -> Column:
    """``w . x + b`` with the weights as literals, so it stays in generated code."""
    return reduce(add, [x * F.lit(float(v)) for x, v in zip(xs, w, strict=True)]) + F.lit(float(b))


def misclassified(xs: Sequence[Column], y: Column, w: Sequence[float], b: float) -> Column:
    """On the wrong side of the plane, or on it."""
    return y * linear_score(xs, w, b) <= 0


def minmax_scaled(x: Column, low: float | None, high: float | None) -> Column:
    """``(x - low) / (high - low)``; a constant column gives NULL."""
    low = F.lit(low).cast("double")
    return F.try_divide(x - low, F.lit(high).cast("double") - low)


def squared_distance(a: Column | str, b: Column | str) -> Column:
    gaps = F.zip_with(a, b, lambda p, q: (p - q).cast("double"))
    return F.aggregate(gaps, F.lit(0.0), lambda total, g: total + g * g)


def bitmap_bits(text: Column | str) -> Column:
    """The 0/1 characters of a bitmap in reading order; line ends fall away."""
    digits = F.regexp_replace(text, "[^01]", "")
    return F.transform(F.filter(F.split(digits, ""), lambda c: c != ""), lambda c: c.cast("int"))


def bitmap_rows(text: Column | str, width: int = 32) -> Column:
    """One integer per bitmap line: its 0/1 characters read as a binary number."""
    lines = F.regexp_extract_all(text, F.lit(f"[01]{{{width}}}"), F.lit(0))
    return F.transform(lines, lambda s: F.conv(s, 2, 10).cast("bigint"))


def bitmap_distance(a: Column | str, b: Column | str) -> Column:
    """Differing bits of two ``bitmap_rows``; equals the squared distance of the bits."""
    gaps = F.zip_with(a, b, lambda p, q: F.bit_count(p.bitwiseXOR(q)).cast("bigint"))
    return F.aggregate(gaps, F.lit(0).cast("bigint"), lambda total, g: total + g)


def bitmap_words(text: Column | str) -> Column:
    """The 0/1 characters of a bitmap in reading order as 64-bit numbers; the last one is filled up with zeros."""
    digits = F.regexp_replace(text, "[^01]", "")
    halves = F.transform(F.regexp_extract_all(digits, F.lit("[01]{1,32}"), F.lit(0)), lambda s: F.conv(F.rpad(s, 32, "0"), 2, 10).cast("bigint"))
    pair = lambda h: F.transform(
        F.filter(F.sequence(F.lit(0), F.size(h)), lambda i: (i % 2 == 0) & (i < F.size(h))),
        lambda i: F.shiftleft(F.get(h, i), 32).bitwiseOR(F.coalesce(F.get(h, i + 1), F.lit(0))),
    )
    return F.transform(F.array(halves), pair)[0]


def bitmap_size(text: Column | str) -> Column:
    """Number of 0/1 characters of a bitmap."""
    return F.length(F.regexp_replace(text, "[^01]", ""))


def word_chunks(words: Column | str) -> Column:
    """The 16-bit quarters of each 64-bit number, in order."""
    quarters = lambda w: F.array(*[F.shiftrightunsigned(w, 48 - 16 * i).bitwiseAND(0xFFFF).cast("int") for i in range(4)])
    return F.flatten(F.transform(words, quarters))
