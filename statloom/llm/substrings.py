"""Substring dedup: repeated passages found in prefix-partitioned suffix trees.

A suffix starts at every word that has ``WINDOW`` words from it on, and is read
as five symbols of seven words each (32-bit hashes; 160 bits in all).  A node of
the suffix tree that lies five symbols deep and has two leaves or more is a
passage of 35 words that occurs more than once: every word under it goes.

1. Suffixes that cannot share such a node never leave their task.  Equal
   windows hold the same smallest eight-word hash ("anchor"); only windows
   whose anchor occurs elsewhere go on.  A seventh of the words are anchors or
   fewer, and only their hashes are counted across the corpus.
2. The rest is split by prefix: seven words, or twenty-one for prefixes that
   hold over ``HOT_SHARE`` of all suffixes, or the whole window for those that
   are still as frequent.  The lists of frequent prefixes have at most
   ``2 / HOT_SHARE`` entries each, as shares add up to one.
3. Suffixes of one prefix meet in one task in sorted order.  The lengths of the
   common prefixes of neighbours are the depths of the tree's internal nodes;
   the tree is walked as the rows stream by, so no group is held in memory.

Hot passages and copies are combined before the shuffle: windows that occur
twice within a task's slice are decided there and travel as one row without
their places, and of equal texts one stands for all.

Words are compared unchanged, on the input, not on what is left.  Defined
cases: a null text has no words; texts under 35 words stay whole; repeated rows
count as occurrences of each other's windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.llm.hashing import hash_words, mixed, text_slices, window_hashes
from statloom.storage import materialize

WINDOW = 35
SYMBOL = 7
GRAM = 8
SPAN = WINDOW - GRAM + 1
#: A prefix is split further if it has more than this share of all suffixes.
HOT_SHARE = 1e-4
LEVELS = (7, 21)
#: Windows that a task combines at a time.
SLICE_WINDOWS = 1 << 19

_NO_ID = -(1 << 63)


def _sliding(x: np.ndarray, size: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` over every ``size`` consecutive values, by doubling."""
    out, width = x, 1
    while width * 2 <= size:
        out, width = pick(out[: len(out) - width], out[width:]), width * 2
    rest = size - width
    return pick(out[: len(out) - rest], out[rest:]) if rest else out


def _anchors(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(grams, smallest gram of each window, places of grams that are the smallest of a window)``."""
    grams = window_hashes(h, GRAM, 3)
    least = _sliding(grams, SPAN, np.minimum)
    padded = np.concatenate([np.zeros(SPAN - 1, np.uint64), least, np.zeros(SPAN - 1, np.uint64)])
    places = np.flatnonzero(_sliding(padded, SPAN, np.maximum) == grams)
    return grams, least, places


def _prefixes(h: np.ndarray, level: int) -> np.ndarray:
    return window_hashes(h, level, 4 + level)[: len(h) - WINDOW + 1].view(np.int64)


SURVEYED = "kind int, value long, d long, t int, p int"


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kind 0: anchors with their places.  Kind ``level``: prefixes frequent in a slice, ``p`` times.  Kind -1: ``p`` suffixes."""
    for batch in batches:
        ids, tags = batch.column("d").to_numpy(), batch.column("t").to_numpy(zero_copy_only=False)
        for first, end, data, offsets in text_slices(batch.column("text")):
            words = hash_words(data, offsets, lower=False)
            runs = words.runs(end - first)
            out: list[tuple] = []
            starts: dict[int, list[np.ndarray]] = {level: [] for level in LEVELS}
            for row, (a, b) in enumerate(zip(runs, runs[1:]), first):
                if b - a < WINDOW:
                    continue
                h = words.hash[a:b]
                grams, _, places = _anchors(h)
                n = len(places)
                out.append((np.zeros(n, np.int32), grams[places].view(np.int64), np.full(n, ids[row]), np.full(n, tags[row]), places.astype(np.int32)))
                for level in LEVELS:
                    starts[level].append(_prefixes(h, level))
            for level, parts in starts.items():
                if not parts:
                    continue
                value, times = np.unique(np.concatenate(parts), return_counts=True)
                # A prefix over HOT_SHARE of the corpus is over half of it in slices that hold most of its suffixes.
                often = times > max(1.0, HOT_SHARE / 2 * times.sum())
                n = int(often.sum())
                zeros = np.zeros(n, np.int64)
                out.append((np.full(n, level, np.int32), value[often], zeros, zeros.astype(np.int32), times[often].astype(np.int32)))
            if out:
                total = np.array([sum(len(x) for x in starts[LEVELS[0]])], np.int32)
                zero = np.zeros(1, np.int64)
                out.append((np.full(1, -1, np.int32), zero, zero, zero.astype(np.int32), total))
                columns = [np.concatenate(c) for c in zip(*out)]
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["kind", "value", "d", "t", "p"])


SUFFIXES = "key long, a long, b long, c int, n int, d long, at long"


def _tagged(tag: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (np.int64(tag) << np.int64(32)) | place.astype(np.int64)


def _suffix_rows(hot: dict[int, np.ndarray]):
    """A task that turns candidate documents into rows for the trees; ``n = 0`` marks a decided run of ``c`` windows."""

    def combined(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        """``parts``: symbols (5 columns), key, id, tag and place, weight of each window."""
        symbols, key, ids, at, weight = (np.concatenate(c) for c in zip(*parts))
        a = (symbols[:, 0].astype(np.int64) << np.int64(32)) | symbols[:, 1].astype(np.int64)
        b = (symbols[:, 2].astype(np.int64) << np.int64(32)) | symbols[:, 3].astype(np.int64)
        c = symbols[:, 4].view(np.int32)
        order = np.lexsort((c, b, a, key))
        key, a, b, c, ids, at, weight = (x[order] for x in (key, a, b, c, ids, at, weight))
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])
        heads = np.flatnonzero(new)
        total = np.minimum(np.add.reduceat(weight, heads), 2)
        decided = (total >= 2)[np.cumsum(new) - 1]
        yield rows(key[heads], a[heads], b[heads], c[heads], total, ids[heads], np.where(total == 1, at[heads], -1))
        # Decided windows that have a place: as runs, keyed by their document.
        chosen = np.flatnonzero(decided & (at >= 0))
        if len(chosen):
            chosen = chosen[np.lexsort((at[chosen], ids[chosen]))]
            ids, at = ids[chosen], at[chosen]
            cut = np.flatnonzero((np.diff(at) != 1) | (ids[1:] != ids[:-1])) + 1
            first = np.concatenate(([0], cut))
            length = np.diff(np.concatenate((first, [len(at)])))
            yield decided_rows(ids[first], at[first], length)

    def rows(key, a, b, c, n, ids, at) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((key, a, b, c, n, ids, at), kinds)], ["key", "a", "b", "c", "n", "d", "at"])

    def decided_rows(ids, at, length) -> pa.RecordBatch:
        key = mixed(np.asarray(ids, np.int64).view(np.uint64) ^ np.asarray(at, np.int64).view(np.uint64), 5).view(np.int64)
        zeros = np.zeros(len(key), np.int64)
        return rows(key, zeros, zeros, np.asarray(length, np.int32), zeros.astype(np.int32), ids, at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            ids, tags = batch.column("d").to_numpy(), batch.column("t").to_numpy(zero_copy_only=False)
            roles, lists = batch.column("role").to_pylist(), batch.column("places")
            ends = lists.offsets.to_numpy()
            flat = lists.values.to_numpy(zero_copy_only=False)
            for first, end, data, offsets in text_slices(_texts(batch)):
                words = hash_words(data, offsets, lower=False)
                runs = words.runs(end - first)
                for row, (lo, hi) in enumerate(zip(runs, runs[1:]), first):
                    n = hi - lo - WINDOW + 1
                    if n < 1:
                        continue
                    role = roles[row] or 0
                    if role:  # one of several equal texts: all its windows are decided
                        yield decided_rows([ids[row]], [int(tags[row]) << 32], [n])
                    if role == 2:
                        continue
                    h = words.hash[lo:hi]
                    grams, least, _ = _anchors(h)
                    shared = np.unique(grams[flat[ends[row] : ends[row + 1]]])
                    near = np.minimum(np.searchsorted(shared, least), len(shared) - 1)
                    places = np.flatnonzero(shared[near] == least)
                    if not len(places):
                        continue
                    blocks = window_hashes(h, SYMBOL, 9).astype(np.uint32)
                    symbols = np.stack([blocks[places + SYMBOL * k] for k in range(5)], 1)
                    key, longer = _prefixes(h, LEVELS[0])[places], _prefixes(h, LEVELS[1])[places]
                    often = np.isin(key, hot[LEVELS[0]])
                    key = np.where(often, longer, key)
                    often &= np.isin(longer, hot[LEVELS[1]])
                    key = np.where(often, _prefixes(h, WINDOW)[places], key)
                    m = len(places)
                    at = np.full(m, -1) if role else _tagged(tags[row], places)
                    parts.append((symbols, key, np.full(m, ids[row]), at, np.full(m, 2 if role else 1, np.int32)))
                    held += m
                    if held >= SLICE_WINDOWS:
                        yield from combined(parts)
                        parts, held = [], 0
        if parts:
            yield from combined(parts)

    return run


PASSAGES = "d long, at long, length int"


def _walk_trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted suffixes in, places under deep internal nodes out.

    Two neighbours that share all five symbols hang under one node of depth 35;
    where neighbours share fewer, the node ends.  Only the open node is carried
    from batch to batch: its symbols, its leaves so far and its one undecided place.
    """
    open_node: tuple = ()
    leaves, waiting = 0, None
    for batch in batches:
        names = ("key", "a", "b", "c", "n", "d", "at")
        key, a, b, c, n, d, at = (batch.column(x).to_numpy(zero_copy_only=False) for x in names)
        ready = n == 0
        out_d, out_at, out_len = [d[ready]], [at[ready]], [c[ready]]
        s = np.flatnonzero(~ready)
        if len(s):
            key, a, b, c, n, d, at = (x[s] for x in (key, a, b, c, n, d, at))
            shallow = np.ones(len(s), bool)  # shares fewer than five symbols with the suffix before
            shallow[1:] = (key[1:] != key[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])
            shallow[0] = open_node != (key[0], a[0], b[0], c[0])
            node = np.cumsum(shallow)  # 0: the open node goes on
            counts = np.bincount(node, weights=n, minlength=int(node[-1]) + 1).astype(np.int64)
            counts[0] += leaves
            if counts[0] >= 2 and waiting is not None:
                out_d.append(np.array([waiting[0]])), out_at.append(np.array([waiting[1]])), out_len.append(np.ones(1, np.int32))
                waiting = None
            deep = (counts[node] >= 2) & (at >= 0)
            out_d.append(d[deep]), out_at.append(at[deep]), out_len.append(np.ones(int(deep.sum()), np.int32))
            last = int(node[-1])
            if last:
                waiting = None
            leaves = int(min(2, counts[last]))
            mine = node == last
            if leaves == 1 and at[mine].size and at[mine][-1] >= 0:
                waiting = (d[mine][-1], at[mine][-1])
            open_node = (key[-1], a[-1], b[-1], c[-1])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(out_d), pa.int64()), pa.array(np.concatenate(out_at), pa.int64()), pa.array(np.concatenate(out_len).astype(np.int32), pa.int32())],
            ["d", "at", "length"],
        )


def _covered(runs: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` words the windows cover.  A run is ``length << 32 | first window`` and covers ``length + 34`` words."""
    step = np.zeros(n + 1, np.int64)
    first = np.minimum(runs & 0xFFFFFFFF, n)
    np.add.at(step, first, 1)
    np.add.at(step, np.minimum(first + (runs >> 32) + WINDOW - 1, n), -1)
    return np.cumsum(step[:n]) > 0


def _key() -> dict[str, Column]:
    """A row's key: its id and a hash of its text, as ids may repeat or lack."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return {"d": F.coalesce(F.col("doc_id"), F.lit(_NO_ID)), "t": F.hash(text).bitwiseAND(F.lit(0x7FFFFFFF))}


def _keyed(docs: DataFrame) -> DataFrame:
    """``(original, d, t)``.  Both joins below move exactly these columns, so that Spark moves the texts once."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    return docs.select(row.alias("original"), *(key.alias(name) for name, key in _key().items()))


def _texts(batch: pa.RecordBatch) -> pa.Array:
    return pc.struct_field(batch.column("original"), "text")


def _passages(docs: DataFrame) -> DataFrame:
    """``(d, t, runs)``: runs of repeated windows by document."""
    slim = docs.select("doc_id", "text").where("text IS NOT NULL").withColumns(_key()).select("text", "d", "t")
    survey = materialize(slim.mapInArrow(_survey, SURVEYED), "suffix-survey")
    anchors = survey.where("kind = 0")
    suffixes = survey.where("kind = -1").agg(F.sum("p").alias("n")).first()["n"] or 0
    often = survey.where("kind > 0").groupBy("kind", "value").agg(F.sum("p").alias("p")).where(F.col("p") > HOT_SHARE / 2 * suffixes)
    frequent = often.select("kind", "value").collect()
    hot = {level: np.array([r["value"] for r in frequent if r["kind"] == level], np.int64) for level in LEVELS}
    # Equal texts: 1 stands for the rest, 2 is one of the rest.
    digests = materialize(
        slim.select("d", "t", F.xxhash64("text").alias("x"), F.xxhash64(F.lit(7), "text").alias("y"), F.length("text").alias("z")), "suffix-texts"
    )
    same = digests.groupBy("x", "y", "z").agg(F.count("*").alias("copies"), F.min(F.struct("d", "t")).alias("one")).where("copies > 1")
    first = (F.col("d") == F.col("one.d")) & (F.col("t") == F.col("one.t"))
    roles = digests.join(materialize(same, "suffix-copies"), ["x", "y", "z"]).select("d", "t", F.when(first, 1).otherwise(2).alias("role"))
    roles = roles.groupBy("d", "t").agg(F.min("role").alias("role"))
    repeated = materialize(anchors.groupBy("value").agg(F.count("*").alias("n")).where("n > 1").select("value"), "suffix-anchors")
    places = anchors.join(repeated, "value", "left_semi").groupBy("d", "t").agg(F.collect_list("p").alias("places"))
    wanted = materialize(places.join(roles, ["d", "t"], "left"), "suffix-places")

    rows = _keyed(docs).join(wanted, ["d", "t"]).mapInArrow(_suffix_rows(hot), SUFFIXES)
    trees = rows.repartition("key").sortWithinPartitions("key", "a", "b", "c")
    found = trees.mapInArrow(_walk_trees, PASSAGES)
    run = F.shiftleft(F.col("length").cast("long"), 32).bitwiseOR(F.col("at").bitwiseAND(F.lit(0xFFFFFFFF)))
    return found.select("d", F.shiftright("at", 32).cast("int").alias("t"), run.alias("run")).groupBy("d", "t").agg(F.collect_list("run").alias("runs"))


def _cut(kept_text: bool):
    """A task that removes the covered words; returns counts and the digest, or the text that is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, results = [], [], []
            column, runs = _texts(batch), batch.column("runs")
            for row in range(batch.num_rows):
                text = column[row].as_py()
                words = (text or "").encode().split()
                gone, kept = 0, words
                if runs[row].is_valid:
                    covered = _covered(runs[row].values.to_numpy(), len(words))
                    gone = int(covered.sum())
                    kept = [words[i] for i in np.flatnonzero(~covered)]
                total.append(len(words))
                removed.append(gone)
                if kept_text:
                    results.append(b" ".join(kept).decode() if gone else text)
                else:
                    results.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            arrays = [batch.column("original"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(results, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["original", "n_words", "n_removed", "result"])

    return run


def _cut_rows(docs: DataFrame, kept_text: bool) -> DataFrame:
    joined = _keyed(docs).join(_passages(docs), ["d", "t"], "left").select("original", "runs")
    kind = joined.schema["original"].dataType.simpleString()
    return joined.mapInArrow(_cut(kept_text), f"original {kind}, n_words long, n_removed long, result string")


def substring_dedup(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256)``, one row per row of ``docs``."""
    cut = _cut_rows(docs.select("doc_id", "text"), kept_text=False)
    return cut.select("original.doc_id", "n_words", "n_removed", F.col("result").alias("kept_sha256"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated passages cut from ``text``; texts that lose nothing stay as they are.

    A cut text is its kept words joined by one space.  Where ``docs`` has
    ``n_chars``, it follows the text.
    """
    cut = _cut_rows(docs, kept_text=True)
    original = {c: F.col("original").getField(c) for c in docs.columns}
    original["text"] = F.col("result")
    if "n_chars" in original:
        n_chars = F.when(F.col("n_removed") > 0, F.length("result")).otherwise(original["n_chars"])
        original["n_chars"] = n_chars.cast(dict(docs.dtypes)["n_chars"])
    return cut.select(*(column.alias(c) for c, column in original.items()))
