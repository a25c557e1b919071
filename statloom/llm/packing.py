"""Best-fit packing of tokenised documents into sequences of bounded length.

1. Documents become token ids (an end token follows each); only what is longer
   than a sequence is cut.  Per piece one small row is kept: no ids move.
2. The histogram of piece lengths, at most ``CAPACITY`` numbers, is all that
   the driver sees.  Over it a configuration linear program is solved: how many
   sequences of each configuration (multiset of lengths that fits) cover all
   pieces with the fewest sequences.  Multiplicative weights keep a price per
   length, falling as the length gets covered; a knapsack dynamic program over
   the capacity prices the best configurations of each round.
3. The solution is rounded down; what that leaves is a bounded number of
   pieces, packed by best fit, longest first, also into gaps of the rounded part.
4. Every piece has a place among the pieces of its length (a number within its
   task, plus the counts of the tasks before), and the plan says which sequence
   and offset that place has.  No group of pieces is gathered anywhere.

Defined cases: a null text is empty and still packs its end token; equal texts
are separate pieces; an empty table gives no sequences.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statloom.llm.common import kept_by_worker
from statloom.storage import materialize

CAPACITY = 4096
END_ID = 1
#: Rounds of the linear program, share of a length that a round covers, how fast covered lengths lose their price, how
#: far below the best a configuration may be priced, lengths priced in a round.
ROUNDS, STEP, FALL, SLACK, BLOCK = 100, 0.4, 0.5, 0.01, 256
#: Parts of the solution that are tried; best fit packs the rest, and needs some short pieces for its gaps.
PARTS = (1.0, 0.8, 0.5, 0.25, 0.1, 0.0)
#: Configurations kept for rounding; the rest of the fractional solution goes to best fit.
SUPPORT = 16_384
#: Encoded words kept by a worker, and the longest kept; bytes of text that are encoded at once, or one text.
CACHED_WORDS, CACHED_CHARS, BLOCK_BYTES = 900_000, 64, 4 << 20
#: Letters whose forms in Unicode are fixed, and words of them with ASCII marks at their end.
SMALL = "".join(map(chr, [*range(0x61, 0x7B), *range(0xDF, 0xF7), *range(0xF8, 0x100)]))
LARGE = "".join(map(chr, [*range(0xC0, 0xD7), *range(0xD8, 0xDF)]))
MARKED = re.compile(rf"([{SMALL}{LARGE}]+)([!-/:-@\[-`{{-~]*)")

Config = tuple[tuple[int, int], ...]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Ids of texts for a tokenizer whose tokens never span white space: each distinct word is encoded once."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, self._letters()
        self.known: dict[str, bytes] = {}

    def _letters(self) -> dict[int, str] | None:
        """What the model is given for each letter, if a word of letters goes to it whole and apart from marks behind it."""
        normal, pieces = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        added = self.tokenizer.get_added_tokens_decoder().values()
        if not normal or not pieces or not all("<|" in t.content for t in added) or normal.normalize_str(LARGE + SMALL) != LARGE.lower() + SMALL:
            return None
        found = {c: "".join(p for p, _ in pieces.pre_tokenize_str(c)) for c in SMALL}
        whole = [p for p, _ in pieces.pre_tokenize_str(SMALL + ".'")]
        return str.maketrans(found) if whole == ["".join(found.values()), ".'"] else None

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        return self.encoded(pa.array(texts, pa.string()))

    def encoded(self, texts: pa.Array) -> list[bytes]:
        """``ids`` of an Arrow array of texts."""
        texts = pc.fill_null(texts, "")
        # The tokenizer folds case, but for its special tokens.
        folded = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        split = pc.ascii_split_whitespace(folded)
        words = split.flatten().dictionary_encode()
        # Each word's ids as one value, so that taking them by the words of a text joins that text's ids.
        joined = pa.array(self._word_ids(words.dictionary.to_pylist()), pa.large_binary()).take(words.indices)
        at = np.frombuffer(joined.buffers()[1], np.int64)[: len(joined) + 1] if len(joined) else np.zeros(1, np.int64)
        data = memoryview(joined.buffers()[2] or b"")
        ends = at[np.cumsum(pc.list_value_length(split).to_numpy())].tolist()
        return [bytes(data[first:end]) for first, end in zip([0, *ends], ends)]

    def _word_ids(self, words: list[str]) -> list[bytes]:
        known = self.known
        if len(known) > CACHED_WORDS:
            known.clear()
        new = [word for word in words if word not in known]
        asked, marked = set(), []
        for word in new:
            found = MARKED.fullmatch(word) if self.letters else None
            if not found:
                asked.add(word)
                continue
            stem, marks = found.groups()
            if marks:
                marked.append((word, stem, marks))
                if marks not in known:
                    asked.add(marks)
            if stem not in known:
                known[stem] = self._stem_ids(stem)
        rest = list(asked)
        for first in range(0, len(rest), 4096):
            part = rest[first : first + 4096]
            for word, found in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                known[word] = struct.pack(f"<{len(found.ids)}I", *found.ids)
        for word, stem, marks in marked:
            known[word] = known[stem] + known[marks]
        out = [known[word] for word in words]
        for word in new:
            if len(word) > CACHED_CHARS:
                found = MARKED.fullmatch(word)
                for part in (word, *(found.groups() if found else ())):
                    known.pop(part, None)
        return out

    def _stem_ids(self, stem: str) -> bytes:
        """Ids of a word of letters, which the tokenizer gives to its model as it is."""
        found = self.model.tokenize(stem.lower().translate(self.letters))
        return struct.pack(f"<{len(found)}I", *[token.id for token in found])


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, place long"


def _blocks(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have ``BLOCK_BYTES`` at most, or one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(), dtype=np.int64)
    first, before = 0, 0
    while first < len(ends):
        end = max(first + 1, int(np.searchsorted(ends, before + BLOCK_BYTES, "right")))
        yield first, end
        first, before = end, int(ends[end - 1])


def _pieces(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept_by_worker(("words", path), lambda: WordEncoder(path))
        part = TaskContext.get().partitionId()
        places = np.zeros(capacity + 1, np.int64)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            for first, last in _blocks(batch.column("text")):
                some = batch.slice(first, last - first)
                doc, piece, start, length, crc, place = [], [], [], [], [], []
                for doc_id, ids in zip(some.column("doc_id").to_pylist(), encoder.encoded(some.column("text"))):
                    ids += end
                    for i, at in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[at : at + 4 * capacity]
                        n = len(own) // 4
                        doc.append(doc_id), piece.append(i), start.append(at // 4), length.append(n), crc.append(zlib.crc32(own)), place.append(places[n])
                        places[n] += 1
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                columns = [doc, piece, start, length, crc, [part] * len(doc), place]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "place"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return run


def _knapsack(lengths: np.ndarray, price: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each room: the best total price of lengths that fit, and the length taken last (-1: leave one token free).

    ``lengths`` ascend.  Lengths may be taken any number of times.
    """
    best, taken = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        k = fits[room]
        if k:
            offers = best[room - lengths[:k]] + price[:k]
            i = k - 1 - int(offers[::-1].argmax())  # of equals the longest
            if offers[i] > best[room]:
                best[room], taken[room] = offers[i], i
    return best, taken


def fractional(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> dict[Config, float]:
    """A fractional solution of the configuration linear program; no length is covered more than once.

    Each round prices the ``BLOCK`` least covered lengths and a draw of others.
    """
    covered = np.zeros(len(lengths))
    solution: dict[Config, float] = {}
    draw = np.random.default_rng(4096)
    for _ in range(ROUNDS):
        if covered.min() >= 1:
            break
        block = np.argsort(covered, kind="stable")[:BLOCK]
        block = np.unique(np.concatenate([block, draw.integers(0, len(lengths), BLOCK // 4)]))
        size, number, done = lengths[block], counts[block], covered[block]
        price = size / capacity * np.exp(-FALL * (done - done.min()))
        best, taken = _knapsack(size, price, capacity)
        worth = price + best[capacity - size]
        limit = done.min() + STEP
        for i in np.flatnonzero(worth >= (1 - SLACK) * best[capacity])[::-1]:
            if done[i] >= limit:
                continue
            config, room = {int(i): 1}, int(capacity - size[i])
            while room > 0:
                j = int(taken[room])
                if j < 0:
                    room -= 1
                else:
                    config[j] = config.get(j, 0) + 1
                    room -= int(size[j])
            members = np.array(list(config))
            share = np.array(list(config.values())) / number[members]
            # A step that takes no length much beyond this round's share.
            amount = float(((limit + STEP - done[members]) / share).min())
            if amount <= 0:
                continue
            done[members] += amount * share
            key = tuple(sorted((int(size[j]), t) for j, t in config.items()))
            solution[key] = solution.get(key, 0.0) + amount
        covered[block] = done
    most = covered.max(initial=0.0)
    return {c: v / most for c, v in solution.items()} if most > 0 else {}


def _best_fit(left: dict[int, int], open_bins: list[tuple[Config, int]], capacity: int) -> list[tuple[Config, int]]:
    """Pack the pieces ``left`` (length: number), longest first, each where it leaves least room; equal bins are one entry."""
    by_room: dict[int, list[tuple[Config, int]]] = {}
    has = np.zeros(capacity + 1, bool)

    def add(config: Config, times: int) -> None:
        room = capacity - sum(n * t for n, t in config)
        by_room.setdefault(room, []).append((config, times))
        has[room] = True

    for config, times in open_bins:
        add(config, times)
    for length in sorted(left, reverse=True):
        n = left[length]
        while n > 0:
            at = int(has[length:].argmax()) + length
            if has[at]:
                config, times = by_room[at].pop()
                if not by_room[at]:
                    has[at] = False
            else:
                at, config, times = capacity, (), n
            each = min(at // length, n)
            bins = min(times, n // each)
            if config and times > bins:
                add(config, times - bins)
            add((*config, (length, each)), bins)
            n -= each * bins
    return [entry for entries in by_room.values() for entry in entries]


def _rounded(solution: dict[Config, float], left: dict[int, int], part: float) -> list[tuple[Config, int]]:
    """``part`` of the solution in whole numbers: first rounded down, then once more each where pieces remain."""
    kept = sorted(solution.items(), key=lambda e: (-e[1], e[0]))[:SUPPORT]
    used: dict[Config, int] = {}
    for whole in (True, False):
        for config, amount in kept:
            times = int(amount * part) if whole else int(amount * part >= 0.5 or part == 1)
            times = min(times, *(left[n] // t for n, t in config))
            if times > 0:
                used[config] = used.get(config, 0) + times
                for n, t in config:
                    left[n] -= t * times
    return list(used.items())


def pack_histogram(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Config, int]]:
    """Configurations and how often each is used; together they hold every piece of the histogram."""
    full = histogram.get(capacity, 0)
    rest = {n: c for n, c in histogram.items() if n < capacity and c > 0}
    plan: list[tuple[Config, int]] = [(((capacity, 1),), full)] if full else []
    if rest:
        lengths = np.array(sorted(rest))
        counts = np.array([rest[n] for n in sorted(rest)], float)
        solution = fractional(lengths, counts, capacity)
        tries = []
        for part in PARTS:
            left = dict(rest)
            tries.append(_best_fit(left, _rounded(solution, left, part), capacity))
        plan += min(tries, key=lambda p: sum(t for _, t in p))  # of equals the one that keeps most of the solution
    return plan


def _layout(plan: list[tuple[Config, int]]) -> dict[str, np.ndarray]:
    """For each length and run of places: the first sequence, pieces of that length in it, and where they begin."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for config, times in plan:
        at = 0
        for length, each in config:
            lo = used.get(length, 0)
            rows.append((length << 40 | lo, lo, sequence, each, at))
            used[length] = lo + each * times
            at += each * length
        sequence += times
    rows.sort()
    columns = np.array(rows, np.int64).reshape(-1, 5).T
    return dict(zip(("key", "lo", "sequence", "each", "at"), columns))


def _placed(layout: dict[str, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, place = batch.column("length").to_numpy(), batch.column("place").to_numpy()
            i = np.searchsorted(layout["key"], (length << 40) | place, "right") - 1
            k = place - layout["lo"][i]
            sequence = layout["sequence"][i] + k // layout["each"][i]
            offset = layout["at"][i] + k % layout["each"][i] * length
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())],
                [*names, "sequence_id", "offset"],
            )

    return run


PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def packed(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of ``docs (doc_id, text)``: its place in a sequence of at most ``capacity`` tokens."""
    texts = docs.select("doc_id", "text")
    pieces = materialize(texts.mapInArrow(_pieces(tokenizer or default_tokenizer(), capacity), PIECES), "packing-pieces")
    # Counts by task and length are a small table; they serve the histogram and the places.
    counts = materialize(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "packing-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    layout = _layout(pack_histogram(histogram, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    numbered = pieces.join(shifts, ["part", "length"]).withColumn("place", F.col("place") + F.col("shift"))
    return numbered.select("doc_id", "piece", "start", "length", "ids_crc32", "place").mapInArrow(_placed(layout), PACKED)
