"""Label encoding, decoding and the two-way sign."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label texts and their codes in delimited dating files, and the
# text shown for codes 1, 2, 3.
DATING_CODES = {"largeDoses": 3, "smallDoses": 2, "didntLike": 1}
DATING_NAMES = ["not at all", "in small doses", "in large doses"]


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def encode_label(label: Column | str, codes: Mapping[str, int]) -> Column:
    """Digit strings become their number, known texts their code, others NULL."""
    label = _column(label)
    table = F.create_map(*[F.lit(v) for pair in codes.items() for v in pair])
    return F.when(label.rlike("^[0-9]+$"), label.try_cast("int")).otherwise(table[label])


def decode_label(code: Column | str, names: Sequence[str]) -> Column:
    """Code 1 is the first name; a code outside the list is NULL."""
    return F.get(F.array(*[F.lit(n) for n in names]), _column(code) - 1)


def sign_label(value: Column | str) -> Column:
    """+1 for zero and above, -1 below; unlike ``signum`` zero counts as +1."""
    value = _column(value)
    return F.when(value >= 0, 1).when(value < 0, -1)
