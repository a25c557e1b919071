"""Quality rules: decision lists learned from labelled text statistics.

Statistics are column expressions over the whole text.  Sequential covering
learns, from a bounded sample of labelled rows, an ordered list of conjunctions
of thresholds that reject a document; the list is applied as one ordered
``CASE WHEN``.  Scoring runs in the JVM only.

Defined cases: a null or empty text has no words and fails the base rule;
without labels the list is empty and only the base rule rejects; rows with the
same text get the same verdict; other columns of the input are kept out of the
way, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.llm.common import BLANKS, let, words_of

#: Labelled rows read for learning, at most (those with the smallest hashed ids).
TRAINING_ROWS = 4_000
#: A rule must be right on this share of the documents it rejects.
PRECISION = 0.98
MAX_RULES = 12
MAX_TERMS = 4
THRESHOLDS = 40
WINDOW = 5
SYMBOLS = "#*$%&|<>"

SHARES = ["symbols", "shouted", "marks", "repeated", "echoed", "varied", "word_size", "digits", "lines", "same_lines", "words"]


def _repeat_words(hashes: Column) -> Column:
    """Words covered by windows of five words that occur twice or more in the text."""

    def covered(windows: Column) -> Column:
        placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(
            placed,
            lambda s: F.sort_array(
                F.transform(
                    F.filter(
                        s,
                        lambda x, k: F.coalesce(x["h"] == F.get(s, k - 1)["h"], F.lit(False))
                        | F.coalesce(x["h"] == F.get(s, k + 1)["h"], F.lit(False)),
                    ),
                    lambda x: x["i"],
                )
            ),
        )
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        total = F.aggregate(
            twice,
            start,
            lambda acc, i: F.struct(
                (acc["n"] + i + WINDOW - F.greatest(i, acc["end"])).alias("n"), (i + WINDOW).alias("end")
            ),
        )
        return total["n"].cast("long")

    windows = F.transform(
        F.sequence(F.lit(0), F.size(hashes) - WINDOW), lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(WINDOW)))
    )
    counted = let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(covered(w)))
    return F.when(F.size(hashes) < WINDOW, F.lit(0).cast("long")).otherwise(counted)


def _removed(text: Column, characters: str) -> Column:
    """How many of ``characters`` the text holds; most texts hold none, which one search tells."""
    some = F.length(text) - F.length(F.translate(text, characters, ""))
    return F.when(text.rlike("[" + characters.replace("&", "\\&") + "]"), some).otherwise(0).cast("long")


def statistics(text: Column) -> Column:
    """A struct of counts over a whole text.  A null text counts as empty."""
    body = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda line: line.rlike(f"[^{BLANKS}]"))

    def counts(words: Column, h: Column) -> Column:
        return F.struct(
            F.size(h).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            _removed(body, SYMBOLS).alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            _repeat_words(h).alias("n_repeat_words"),
            F.size(lines).cast("long").alias("n_lines"),
            F.size(F.array_distinct(h)).cast("long").alias("n_distinct"),
            F.size(F.filter(h, lambda x, i: F.coalesce(x == F.get(h, i - 1), F.lit(False)))).cast("long").alias("n_echoes"),
            F.size(F.regexp_extract_all(body, F.lit("\\p{Lu}{2}"), 0)).cast("long").alias("n_upper"),
            _removed(body, "!?").alias("n_marks"),
            _removed(body, "0123456789").alias("n_digits"),
        )

    hashed = lambda words: let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: counts(words, h))
    return let(words_of(body), hashed)


def shares(s: Column) -> dict[str, Column]:
    """What the rules look at: statistics made independent of the text's length, and its words."""
    words = F.greatest(s["n_words"], F.lit(1)).cast("double")
    chars = F.greatest(s["word_chars"], F.lit(1)).cast("double")
    lines = F.greatest(s["n_lines"], F.lit(1)).cast("double")
    return {
        "symbols": s["n_symbols"] / words,
        "shouted": s["n_upper"] / chars,
        "marks": s["n_marks"] / words,
        "repeated": s["n_repeat_words"] / words,
        "echoed": s["n_echoes"] / words,
        "varied": s["n_distinct"] / words,
        "word_size": s["word_chars"] / words,
        "digits": s["n_digits"] / chars,
        "lines": s["n_lines"] / words,
        "same_lines": s["n_dup_lines"] / lines,
        "words": s["n_words"].cast("double"),
    }


def base_failed(s: Column) -> Column:
    """The fixed rule: under ten words, or over a fifth of them repeated."""
    return (s["n_words"] < 10) | (100 * s["n_repeat_words"] > 20 * s["n_words"])


@dataclass(frozen=True)
class Term:
    share: str
    above: bool
    threshold: float

    def holds(self, columns: dict[str, Column]) -> Column:
        return columns[self.share] > self.threshold if self.above else columns[self.share] <= self.threshold

    def mask(self, x: np.ndarray) -> np.ndarray:
        values = x[:, SHARES.index(self.share)]
        return values > self.threshold if self.above else values <= self.threshold


Rule = tuple[Term, ...]


def _mask(rule: Rule, x: np.ndarray) -> np.ndarray:
    found = np.ones(len(x), bool)
    for term in rule:
        found &= term.mask(x)
    return found


def _grow(x: np.ndarray, bad: np.ndarray) -> Rule:
    """Add the term with the largest information gain until no good row is covered."""
    rule: Rule = ()
    covered = np.ones(len(x), bool)
    while len(rule) < MAX_TERMS and (covered & ~bad).any():
        p0, n0 = (covered & bad).sum(), (covered & ~bad).sum()
        best, gain = None, 1e-9
        for j, share in enumerate(SHARES):
            values = x[covered, j]
            cuts = np.unique(np.quantile(values, np.linspace(0, 1, THRESHOLDS + 1)))
            cuts = (cuts[:-1] + cuts[1:]) / 2
            if not len(cuts):
                continue
            p_le = (values[bad[covered]][:, None] <= cuts).sum(0)
            n_le = (values[~bad[covered]][:, None] <= cuts).sum(0)
            for above, p, n in ((False, p_le, n_le), (True, p0 - p_le, n0 - n_le)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gains = np.where(p > 0, p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))), 0.0)
                k = int(gains.argmax())
                if gains[k] > gain + 1e-9:
                    best, gain = Term(share, above, float(cuts[k])), float(gains[k])
        if best is None:
            break
        rule += (best,)
        covered &= best.mask(x)
    return rule


def _prune(rule: Rule, x: np.ndarray, bad: np.ndarray) -> Rule:
    """Drop last terms as long as that doesn't lower the rule's worth on rows it wasn't grown on."""

    def worth(r: Rule) -> float:
        m = _mask(r, x)
        p, n = (m & bad).sum(), (m & ~bad).sum()
        return (p - 4.0 * n) / max(1, p + n)

    best = rule
    while len(best) > 1 and worth(best[:-1]) >= worth(best):
        best = best[:-1]
    return best


def learn_rules(x: np.ndarray, bad: np.ndarray) -> list[Rule]:
    """An ordered list of rejecting rules.  A third of the rows, by place, serves for pruning and testing."""
    rules: list[Rule] = []
    test = np.arange(len(x)) % 3 == 0
    while len(rules) < MAX_RULES and (bad & ~test).any():
        rule = _prune(_grow(x[~test], bad[~test]), x[test], bad[test])
        covered = _mask(rule, x)
        right, wrong = (covered & bad).sum(), (covered & ~bad).sum()
        right_test, wrong_test = (covered & bad & test).sum(), (covered & ~bad & test).sum()
        if not rule or right < 3 or right < PRECISION * (right + wrong) or right_test < PRECISION * (right_test + wrong_test):
            break
        rules.append(rule)
        x, bad, test = x[~covered], bad[~covered], test[~covered]
    return rules


def training_rows(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shares and badness of at most ``TRAINING_ROWS`` labelled documents, in the order of their hashed ids.

    Rows that the base rule rejects anyway teach nothing and are left out.
    """
    chosen = (
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .select(F.col("doc_id").alias("_id"), F.col("quality").alias("_quality"), F.xxhash64("doc_id").alias("_at"))
        .orderBy("_at", "_id")
        .limit(TRAINING_ROWS)
    )
    known = docs.select(F.col("doc_id").alias("_id"), F.col("text")).join(F.broadcast(chosen), "_id")
    measured = known.select("_at", "_id", "_quality", statistics(F.col("text")).alias("s"))
    columns = shares(F.col("s"))
    shown = measured.select("_at", "_id", "_quality", base_failed(F.col("s")).alias("failed"), *(columns[c].alias(c) for c in SHARES))
    rows = sorted(tuple(r) for r in shown.dropDuplicates(["_id"]).collect() if not r["failed"])
    x = np.array([r[4:] for r in rows], float).reshape(-1, len(SHARES))
    return x, np.array([r[2] == 0 for r in rows], bool)


def rejected_by(rules: list[Rule], s: Column) -> Column:
    """The list as one ordered conditional: the number of the first rule that holds, or null."""
    columns = shares(s)
    found = F.lit(None).cast("int")
    for i, rule in reversed(list(enumerate(rules))):
        condition = rule[0].holds(columns)
        for term in rule[1:]:
            condition &= term.holds(columns)
        found = F.when(condition, F.lit(i)).otherwise(found)
    return found


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: base statistics, ``base_failed``, ``kept`` and ``rule``, the first rule that rejects."""
    rules = learn_rules(*training_rows(docs, labels))
    s = F.col("s")
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    rule = rejected_by(rules, s)
    return docs.select("doc_id", statistics(F.col("text")).alias("s")).select(
        "doc_id",
        *(s[c].alias(c) for c in base),
        base_failed(s).alias("base_failed"),
        (~base_failed(s) & rule.isNull()).alias("kept"),
        rule.alias("rule"),
    )


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, with their columns, that no rule rejects."""
    rules = learn_rules(*training_rows(docs, labels))
    # One expression, so that the statistics are computed once for it.
    return docs.where(let(statistics(F.col("text")), lambda s: ~base_failed(s) & rejected_by(rules, s).isNull()))
