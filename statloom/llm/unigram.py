"""Unigram tokens over a sentencepiece vocabulary: counts, ids, and text from ids.

The most probable segmentation is found by one pass over a word: an Aho-Corasick
automaton over the pieces reports, at each position, every piece that ends there
(its output links lead from the longest to the shortest), and each one relaxes
the best score at that position.  Counting carries only the score and the number
of pieces; encoding also remembers the piece.

Rules of the tokenizer that are kept: white space becomes the mark U+2581 and one
stands before the text; a score replaces another only if it is greater, longer
pieces being tried first; scores are single-precision numbers; a character
without a piece costs the least score less ten and is written as its bytes.
No piece goes on across a mark that follows another character (checked when the
vocabulary is loaded), so texts fall into words whose best segmentations are
independent; scores start anew at each word, and a worker keeps those it met.

Defined cases: null and empty texts have no tokens; a mark U+2581 in a text is
decoded as a blank, as the tokenizer does; equal texts have equal tokens.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm.common import kept_by_worker

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Words kept by a worker, and the longest kept.
CACHED_WORDS, CACHED_CHARS = 400_000, 32
#: Up to here whole numbers are exact in single precision.
EXACT = float(1 << 24)

_WORD = re.compile(f"{MARK}+[^{MARK}]*")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _single(x: float) -> float:
    return struct.unpack("f", struct.pack("f", x))[0]


class Unigram:
    """Pieces of a sentencepiece model file, their scores taken as log-probabilities."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.automaton = ahocorasick.Automaton()
        self.bytes_of: list[bytes] = []
        self.byte_ids = [-1] * 256
        self.single: set[str] = set()
        least = 0.0
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[1:-1], 16)
                self.byte_ids[value] = i
                self.bytes_of.append(bytes([value]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.bytes_of.append(b"")
            else:
                if MARK in piece.lstrip(MARK):
                    raise ValueError(f"a piece goes on across a word boundary: {piece!r}")
                score = model.get_score(i)
                least = min(least, score)
                self.bytes_of.append(piece.replace(MARK, " ").encode())
                self.automaton.add_word(piece, (len(piece), score, i))
                if len(piece) == 1:
                    self.single.add(piece)
        if min(self.byte_ids) < 0:
            raise ValueError("the vocabulary lacks pieces for single bytes")
        self.automaton.make_automaton()
        self.unknown = _single(least - UNKNOWN_PENALTY)
        self.counts: dict[str, int] = {}
        self.ids: dict[str, array] = {}

    def _relax(self, word: str) -> tuple[list[float], list[int], list[int]]:
        """Best score, last piece (-1: a character without one) and its length, for each end in ``word``."""
        n = len(word)
        best, last, size = [0.0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        single, unknown = self.single, self.unknown
        at = 0
        for end, (length, score, piece) in chain(self.automaton.iter(word), [(n, (0, 0.0, 0))]):
            end += 1
            while at < end - 1 or (at < n and end > n):  # ends that no further piece reaches
                at += 1
                if word[at - 1] not in single:
                    self._without_piece(at, best, last, size, unknown)
            if end > n:
                break
            score += best[end - length]
            if score < -EXACT:
                score = _single(score)
            if not size[end] or score > best[end]:
                best[end], last[end], size[end] = score, piece, length
        return best, last, size

    @staticmethod
    def _without_piece(at: int, best: list[float], last: list[int], size: list[int], unknown: float) -> None:
        score = _single(best[at - 1] + unknown)
        if not size[at] or score > best[at]:
            best[at], last[at], size[at] = score, -1, 1

    def count_word(self, word: str) -> int:
        """Pieces of the best segmentation, carried along with the scores."""
        n = len(word)
        best, count, reached = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        at = 0
        for end, (length, score, _) in chain(self.automaton.iter(word), [(n, (0, 0.0, 0))]):
            end += 1
            while at < end - 1 or (at < n and end > n):
                at += 1
                if word[at - 1] not in self.single:
                    score_at = _single(best[at - 1] + self.unknown)
                    if not reached[at] or score_at > best[at]:
                        best[at], reached[at] = score_at, True
                        count[at] = count[at - 1] + len(word[at - 1].encode())
            if end > n:
                break
            score += best[end - length]
            if score < -EXACT:
                score = _single(score)
            if not reached[end] or score > best[end]:
                best[end], reached[end] = score, True
                count[end] = count[end - length] + 1
        return count[n]

    def encode_word(self, word: str) -> array:
        _, last, size = self._relax(word)
        out: list[int] = []
        at = len(word)
        while at > 0:
            if last[at] < 0:
                out += [self.byte_ids[b] for b in reversed(word[at - 1].encode())]
            else:
                out.append(last[at])
            at -= size[at]
        return array("i", reversed(out))

    @staticmethod
    def words(text: str | None) -> list[str]:
        return _WORD.findall(MARK + text.replace(" ", MARK)) if text else []

    def count(self, text: str | None) -> int:
        known, total = self.counts, 0
        if len(known) > CACHED_WORDS:
            known.clear()
        for word in self.words(text):
            n = known.get(word)
            if n is None:
                n = self.count_word(word)
                if len(word) <= CACHED_CHARS:
                    known[word] = n
            total += n
        return total

    def encode(self, text: str | None) -> np.ndarray:
        known, out = self.ids, array("i")
        if len(known) > CACHED_WORDS:
            known.clear()
        for word in self.words(text):
            ids = known.get(word)
            if ids is None:
                ids = self.encode_word(word)
                if len(word) <= CACHED_CHARS:
                    known[word] = ids
            out.extend(ids)
        return np.frombuffer(out, np.int32) if len(out) else np.empty(0, np.int32)

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no text become U+FFFD."""
        text = b"".join([self.bytes_of[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def _model(path: str) -> Unigram:
    return kept_by_worker(("unigram", path), lambda: Unigram(path))


def token_counts(docs: DataFrame, model: str | None = None) -> DataFrame:
    """``(doc_id, n_tokens)``, one row per row of ``docs (doc_id, text)``."""
    path = model or default_model()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unigram = _model(path)
        for batch in batches:
            counts = [unigram.count(text.as_py()) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64())], ["doc_id", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(counted, "doc_id long, n_tokens long")


def encoded(docs: DataFrame, model: str | None = None) -> DataFrame:
    """``(doc_id, text, ids)``, one row per row of ``docs (doc_id, text)``."""
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unigram = _model(path)
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                some = batch.slice(first, 256)
                ids = [unigram.encode(text.as_py()) for text in some.column("text")]
                offsets = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(x) for x in ids], out=offsets[1:])
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("text"), lists], ["doc_id", "text", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, text string, ids array<int>")


def decoded(tokens: DataFrame, model: str | None = None) -> DataFrame:
    """``(doc_id, text, ids, decoded)`` for rows ``(doc_id, text, ids)``; null ids give an empty text."""
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unigram = _model(path)
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                some = batch.slice(first, 256)
                texts = [unigram.decode(ids.values.to_numpy().tolist() if ids.is_valid else []) for ids in some.column("ids")]
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("text"), some.column("ids"), pa.array(texts, pa.string())], ["doc_id", "text", "ids", "decoded"])

    return tokens.select("doc_id", "text", "ids").mapInArrow(run, "doc_id long, text string, ids array<int>, decoded string")


def round_trips(docs: DataFrame, model: str | None = None) -> DataFrame:
    """``(doc_id, n_tokens, ids_hash, same_text)``: every document encoded and decoded again."""
    rows = decoded(encoded(docs, model), model)
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.xxhash64("ids").alias("ids_hash"),
        (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("same_text"),
    )
