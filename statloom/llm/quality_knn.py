"""Quality classifier: nearest-neighbour voting among latent-semantic vectors.

A text's terms are its hashed words, the shapes of its words and of word pairs,
and a few soft-binned shares (repetition, symbols, capitals, lengths).  Term
weights and the latent space (leading right singular vectors) come from a
bounded sample of labelled documents; the sample's vectors, a few hundred
kilobytes, are broadcast.  Every document is compared with all of them in
blocks of exact cosine products; its nearest neighbours vote for their labels,
weighted by similarity.

Labels are learnt only from documents whose ``crc32(doc_id as text) mod 5`` is
not 0; the rest is held out.  Labels, language, source and id are no inputs of
a score.  Defined cases: null and empty texts are scored by what an empty text
has in common with the sample; without labels every score is 0.5; equal texts
get equal scores; ties among neighbours at the edge of the vote are broken by place in the sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.llm.hashing import Words, hash_words, mixed, text_slices, window_hashes

#: Labelled documents that are learnt from, at most (those with the smallest hashed ids).
SAMPLE = 4_000
DIMENSIONS, NEIGHBOURS, SHARPNESS = 64, 15, 6
WORD_TERMS, SHAPE_TERMS, BINS = 512, 512, 8
#: Weights of the three groups of terms.
GROUPS = (0.25, 1.0, 1.5)
THRESHOLD = 0.3
BLOCK = 512

#: Soft bins: for each share the value of the last bin.
RANGES = {
    "repeated": 1.0, "distinct": 1.0, "same_lines": 1.0, "symbols": 2.0, "capitals": 0.6, "marks": 1.5, "size": 10.0, "echoes": 1.0,
    "digits": 0.3, "words": 9.0, "symbols_small": 0.2, "lone": 0.5,
}
TERMS = WORD_TERMS + SHAPE_TERMS + len(RANGES) * BINS

_CLASS = np.zeros(256, np.uint8)  # 0: letters and the rest
_CLASS[48:58] = 1
_CLASS[65:91] = 2
for _c in b"#*$%&|<>":
    _CLASS[_c] = 3
for _c in b".,;:!?":
    _CLASS[_c] = 4


def _capped(x: np.ndarray, most: int) -> np.ndarray:
    return np.minimum(x, most).astype(np.int64)


def _soft_bins(out: np.ndarray, values: np.ndarray, most: float) -> None:
    """Spread each value over its two nearest bins."""
    at = np.clip(values / most, 0, 1) * (BINS - 1)
    low = np.minimum(at.astype(int), BINS - 2)
    rows = np.arange(len(values))
    out[rows, low] = 1 - (at - low)
    out[rows, low + 1] = at - low


def _line_shares(data: np.ndarray, offsets: np.ndarray, words: Words, texts: int) -> np.ndarray:
    """Share of each text's lines with a word that equal an earlier one."""
    first, last = offsets[0], offsets[-1]
    breaks = np.flatnonzero(data[first:last] == 10) + first
    line = np.searchsorted(breaks, words.start)  # lines of neighbouring texts differ by the text
    key = line + words.text * (len(breaks) + 1)
    if not len(key):
        return np.zeros(texts)
    heads = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    place = np.arange(len(key)) - np.repeat(heads, np.diff(np.append(heads, len(key))))
    with np.errstate(over="ignore"):
        sums = np.add.reduceat(mixed(words.hash + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 21), heads)
    text = words.text[heads]
    same = mixed(sums ^ mixed(text.astype(np.uint64), 22), 23)
    n_lines = np.bincount(text, minlength=texts)
    distinct = np.bincount(text[np.unique(same, return_index=True)[1]], minlength=texts)
    return (n_lines - distinct) / np.maximum(1, n_lines)


def term_vectors(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of term weights per text, before inverse document frequencies."""
    texts = len(offsets) - 1
    words = hash_words(data, offsets, lower=False)
    n = np.bincount(words.text, minlength=texts)
    out = np.zeros((texts, TERMS), np.float32)
    first = int(offsets[0])
    kinds = _CLASS[data[first : int(offsets[-1])]]
    counts = {}
    for kind, name in ((1, "digits"), (2, "capitals"), (3, "symbols"), (4, "points")):
        sums = np.concatenate(([0], np.cumsum(kinds == kind)))
        counts[name] = sums[words.end - first] - sums[words.start - first]
    size = words.end - words.start
    letters = size - counts["symbols"] - counts["points"] - counts["digits"]
    shouted = (counts["capitals"] >= 2) & (counts["capitals"] * 2 > letters)
    shape = (
        _capped(size // 3, 5) + 6 * _capped(counts["capitals"], 1) + 12 * shouted + 24 * _capped(counts["symbols"], 2)
        + 72 * _capped(counts["points"], 2) + 216 * _capped(counts["digits"], 1)
    )
    same_text = words.text[1:] == words.text[:-1]
    echo = np.concatenate(([False], same_text & (words.hash[1:] == words.hash[:-1]))) if len(size) else np.empty(0, bool)
    pair = np.concatenate(([0], np.where(same_text, shape[:-1], 0))) if len(size) else shape
    unigram = mixed((shape * 2 + echo).astype(np.uint64), 31) % np.uint64(SHAPE_TERMS)
    bigram = mixed((shape * 1024 + pair).astype(np.uint64), 32) % np.uint64(SHAPE_TERMS)

    def counted(bucket: np.ndarray, width: int) -> np.ndarray:
        found = np.bincount(words.text * width + bucket.astype(np.int64), minlength=texts * width).reshape(texts, width)
        return np.log1p(found).astype(np.float32)

    out[:, :WORD_TERMS] = counted(words.hash % np.uint64(WORD_TERMS), WORD_TERMS)
    out[:, WORD_TERMS : WORD_TERMS + SHAPE_TERMS] = counted(unigram, SHAPE_TERMS) + 0.5 * counted(bigram, SHAPE_TERMS)

    def share(flags: np.ndarray, of: np.ndarray) -> np.ndarray:
        return np.bincount(words.text, weights=flags, minlength=texts) / np.maximum(1, of)

    own = mixed(words.hash ^ mixed(words.text.astype(np.uint64), 33), 34)
    distinct = np.bincount(words.text[np.unique(own, return_index=True)[1]], minlength=texts)
    windows = window_hashes(words.hash, 5, 5)
    inside = words.text[4:] == words.text[: len(windows)] if len(windows) else np.empty(0, bool)
    at = words.text[: len(windows)][inside]
    _, back, times = np.unique(mixed(windows[inside] ^ mixed(at.astype(np.uint64), 35), 36), return_inverse=True, return_counts=True)
    twice = np.bincount(at[times[back] > 1], minlength=texts) / np.maximum(1, np.bincount(at, minlength=texts))
    chars = np.bincount(words.text, weights=size, minlength=texts)
    values = {
        "repeated": twice,
        "distinct": distinct / np.maximum(1, n),
        "same_lines": _line_shares(data, offsets, words, texts),
        "symbols": share(counts["symbols"], n),
        "capitals": share(counts["capitals"], chars),
        "marks": share(counts["points"], n),
        "size": chars / np.maximum(1, n),
        "echoes": share(echo, n),
        "digits": share(counts["digits"], chars),
        "words": np.log1p(n),
        "symbols_small": share(counts["symbols"], n),
        "lone": share(letters == 0, n),
    }
    for i, (name, most) in enumerate(RANGES.items()):
        start = WORD_TERMS + SHAPE_TERMS + i * BINS
        _soft_bins(out[:, start : start + BINS], values[name], most)
    return out


@dataclass
class Voters:
    """What is broadcast: term weights, latent axes, the sample's unit vectors and labels."""

    weights: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def place(self, terms: np.ndarray) -> np.ndarray:
        """Unit vectors in the latent space."""
        x = _grouped(terms) * self.weights @ self.axes
        return x / np.maximum(1e-9, np.sqrt((x * x).sum(1)))[:, None]

    def scores(self, terms: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(terms), 0.5)
        near = self.place(terms) @ self.vectors.T
        k = min(NEIGHBOURS, near.shape[1])
        top = np.argpartition(-near, k - 1, axis=1)[:, :k]
        weight = np.maximum(0, np.take_along_axis(near, top, 1)).astype(np.float64) ** SHARPNESS + 1e-12
        return (weight * self.labels[top]).sum(1) / weight.sum(1)


def _grouped(terms: np.ndarray) -> np.ndarray:
    """Each group of terms scaled to its weight, so that long texts do not outweigh the shares."""
    out = terms.copy()
    bounds = (0, WORD_TERMS, WORD_TERMS + SHAPE_TERMS, TERMS)
    for weight, a, b in zip(GROUPS, bounds, bounds[1:]):
        out[:, a:b] *= weight / np.maximum(1e-9, np.sqrt((out[:, a:b] ** 2).sum(1)))[:, None]
    return out


def fit(terms: np.ndarray, labels: np.ndarray) -> Voters:
    if not len(terms):
        return Voters(np.ones(TERMS, np.float32), np.eye(TERMS, 1, dtype=np.float32), np.empty((0, 1), np.float32), labels)
    frequency = (terms > 0).mean(0)
    weights = np.sqrt(np.log((1 + 1.0) / (frequency + 1.0 / len(terms))) + 0.1).astype(np.float32)
    weights[WORD_TERMS + SHAPE_TERMS :] = 1.0
    x = _grouped(terms) * weights
    values, axes = np.linalg.eigh((x.T @ x).astype(np.float64))
    model = Voters(weights, axes[:, ::-1][:, :DIMENSIONS].astype(np.float32), np.empty((0, 1), np.float32), labels.astype(float))
    model.vectors = model.place(terms)
    return model


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, data, offsets in text_slices(batch.column("text")):
            rows = [term.tobytes() for term in term_vectors(data, offsets)]
            some = batch.slice(first, end - first)
            yield pa.RecordBatch.from_arrays([some.column("at"), some.column("quality"), pa.array(rows, pa.binary())], ["at", "quality", "terms"])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame) -> Voters:
    """Voters from at most ``SAMPLE`` labelled documents that are not held out."""
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("quality").cast("int").alias("quality"))
        .withColumn("at", F.xxhash64("doc_id"))
        .orderBy("at", "doc_id")
        .limit(SAMPLE)
    )
    known = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("at", "quality", "text")
    # Rows that repeat an id count once.
    found = known.mapInArrow(_terms, "at long, quality int, terms binary").groupBy("at", "quality").agg(F.min("terms").alias("terms"))
    rows = sorted((r["at"], r["quality"], bytes(r["terms"])) for r in found.collect())
    terms = np.array([np.frombuffer(r[2], np.float32) for r in rows[:SAMPLE]], np.float32).reshape(-1, TERMS)
    return fit(terms, np.array([r[1] == 1 for r in rows[:SAMPLE]], float))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, score, predicted)``, one row per row of ``docs (doc_id, text)``."""
    found = learn(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast((found.weights, found.axes, found.vectors, found.labels))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters = Voters(*shared.value)
        for batch in batches:
            for first, end, data, offsets in text_slices(batch.column("text")):
                scores = np.concatenate([voters.scores(term_vectors(data, offsets[a : a + BLOCK + 1])) for a in range(0, end - first, BLOCK)])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, end - first), pa.array(np.clip(scores, 0, 1))], ["doc_id", "score"])

    rows = docs.select("doc_id", "text").mapInArrow(scored, "doc_id long, score double")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
