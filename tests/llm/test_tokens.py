import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from statloom.llm import packing, unigram

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def raised(tmp_path_factory):
    """The vocabulary as a unigram model of the library itself.

    Its pieces of marks alone are scored like rare words: at -1e9 the library's
    own sums lose the last digits.
    """
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(unigram.default_model(), "rb") as file:
        model.ParseFromString(file.read())
    model.trainer_spec.model_type = 1
    for piece in model.pieces:
        if set(piece.piece) == {unigram.MARK}:
            piece.score = -40000.0 - len(piece.piece)
    path = tmp_path_factory.mktemp("model") / "unigram.model"
    path.write_bytes(model.SerializeToString())
    return str(path), sentencepiece.SentencePieceProcessor(model_file=str(path))


def plain_best(unit, word):
    """All segmentations by plain dynamic programming over starts."""
    pieces = {p: v for p, v in ((k, unit.automaton.get(k)) for k in unit.automaton.keys())}
    n = len(word)
    best = [None] * (n + 1)
    best[0] = (0.0, 0)
    for i in range(n):
        if best[i] is None:
            continue
        for j in range(n, i, -1):
            if word[i:j] in pieces:
                s, c = best[i][0] + pieces[word[i:j]][1], best[i][1] + 1
                if best[j] is None or s > best[j][0]:
                    best[j] = (s, c)
        if word[i] not in pieces:
            s, c = best[i][0] + unit.unknown, best[i][1] + len(word[i].encode())
            if best[i + 1] is None or s > best[i + 1][0]:
                best[i + 1] = (s, c)
    return best[n][1]


def test_words_equal_the_library(raised, doc_rows):
    path, library = raised
    unit = unigram.Unigram(path)
    draw = random.Random(3)
    texts = [t for _, t in doc_rows if t] + ["".join(draw.choices("abe \nø日🙂1.,<the", k=draw.randint(1, 14))) for _ in range(1500)]
    words = {w for t in texts for w in unit.words(t)}
    for word in words:
        text = word[1:].replace(unigram.MARK, " ")
        if text:
            want = library.encode(text)
            assert list(unit.encode_word(word)) == want and unit.count_word(word) == len(want), word


def test_counts_equal_plain_search(doc_rows):
    unit = unigram.Unigram(unigram.default_model())
    for word in sorted({w for _, t in doc_rows if t for w in unit.words(t)})[::40]:
        if len(word) < 30:
            assert unit.count_word(word) == plain_best(unit, word), word


def test_counts_ids_and_round_trips(docs, doc_rows, no_docs):
    unit = unigram.Unigram(unigram.default_model())
    counts = {r["doc_id"]: r["n_tokens"] for r in unigram.token_counts(docs).collect()}
    rows = {r["doc_id"]: r for r in unigram.round_trips(docs).collect()}
    for d, text in doc_rows:
        assert counts[d] == rows[d]["n_tokens"] == len(unit.encode(text))
        assert rows[d]["same_text"]
    assert unigram.token_counts(no_docs).count() == 0 and unigram.round_trips(no_docs).count() == 0


def test_decoding(spark):
    unit = unigram.Unigram(unigram.default_model())
    for text in (" a", "a ", "a  b\n\nc", "日本🙂", "\x00\x01", "x" * 5000):
        assert unit.decode(unit.encode(text).tolist()) == text
    assert unit.decode([unit.byte_ids[0xFF]]) == "�"
    rows = spark.createDataFrame([(1, None, None), (2, "x", [])], "doc_id BIGINT, text STRING, ids ARRAY<INT>")
    assert [r["decoded"] for r in unigram.decoded(rows).collect()] == ["", ""]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.default_tokenizer())


def test_word_ids_equal_whole_texts(tokenizer, doc_rows):
    draw = random.Random(8)
    odd = ["".join(draw.choices("aB'st 1é́İß<|endoftext|>  \x1c\x85\n\t", k=40)) for _ in range(300)]
    texts = [t for _, t in doc_rows] + odd + ["<|endoftext|> it's x<|startoftext|>y", "a" * 300, "don't I'LL we've"]
    encoder = packing.WordEncoder(packing.default_tokenizer())
    for _ in range(2):  # the second time from what is known
        got = [np.frombuffer(b, "<u4").tolist() for b in encoder.ids(texts)]
        assert got == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_words_of_letters_go_to_the_model_alone(tokenizer):
    draw = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyzABCZßàéöøýþÿÀÉÖØÞ"
    words = ["".join(draw.choices(letters, k=draw.randrange(1, 12))) + draw.choice(["", ".", "'", "!?", "***"]) for _ in range(3000)]
    other = ["it's", "i̇İ", "7th", "naı̈ve", "a×b", "слово.", "x" * 90 + "é;", "a<|", "<|endoftext|>."]
    text = " ".join(words)
    encoder, asked = packing.WordEncoder(packing.default_tokenizer()), []

    class Asked:
        def encode_batch_fast(self, batch, **options):
            asked.extend(batch)
            return tokenizer.encode_batch_fast(batch, **options)

    encoder.tokenizer = Asked()
    for _ in range(2):  # the second time from what is known
        assert np.frombuffer(encoder.ids([text])[0], "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
        assert sorted(asked) == ["!?", "'", "***", "."]
    for word in other:
        assert np.frombuffer(encoder.ids([word])[0], "<u4").tolist() == tokenizer.encode(word, add_special_tokens=False).ids
    assert max(map(len, encoder.known)) <= packing.CACHED_CHARS


def test_blocks_hold_every_row_once():
    texts = pa.array([None, "", "ab", "x" * packing.BLOCK_BYTES, "é" * packing.BLOCK_BYTES, None, "c"] + ["y" * 1000] * 10_000)
    for some in (texts, texts.slice(2), texts.slice(0, 0), texts.slice(0, 1)):
        found = list(packing._blocks(some))
        assert [i for first, last in found for i in range(first, last)] == list(range(len(some)))
        for first, last in found:
            assert last == first + 1 or sum(len((t or "").encode()) for t in some[first:last].to_pylist()) <= packing.BLOCK_BYTES


def check_packed(rows, tokenizer, texts, capacity):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    total = 0
    for doc_id, text in texts:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        total += len(ids)
        want = [(i, at, len(ids[at : at + capacity]), zlib.crc32(ids[at : at + capacity].tobytes())) for i, at in enumerate(range(0, len(ids), capacity))]
        assert sorted(by_doc[doc_id]) == want
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence), -(-total // capacity)


@pytest.mark.parametrize("capacity", [4096, 256, 64])
def test_packing(docs, doc_rows, no_docs, tokenizer, capacity):
    used, least = check_packed(packing.packed(docs, capacity=capacity).collect(), tokenizer, doc_rows, capacity)
    assert used <= least * 1.02 + 1
    assert packing.packed(no_docs).count() == 0


def test_plans_hold_every_piece_once():
    draw = np.random.default_rng(1)
    for n in (1, 50, 5000, 200_000):
        lengths = np.minimum(4096, draw.lognormal(6, 1, n).astype(int) + 1)
        histogram = dict(Counter(lengths.tolist()))
        plan = packing.pack_histogram(histogram)
        held = Counter()
        for config, times in plan:
            assert sum(length * each for length, each in config) <= 4096 and times > 0
            for length, each in config:
                held[length] += each * times
        assert held == Counter(histogram)
        assert sum(t for _, t in plan) <= -(-int(lengths.sum()) // 4096) * 1.01 + 1


def test_lengths_that_never_share_a_sequence():
    assert sum(t for _, t in packing.pack_histogram({3000: 7, 2500: 5})) == 12
    assert sum(t for _, t in packing.pack_histogram({2048: 7, 4096: 2})) == 6


def test_the_linear_program_covers_no_length_twice():
    draw = np.random.default_rng(2)
    counted = Counter(np.minimum(4095, draw.lognormal(6.5, 0.8, 30_000).astype(int) + 1).tolist())
    lengths = np.array(sorted(counted))
    solution = packing.fractional(lengths, np.array([counted[n] for n in sorted(counted)], float), 4096)
    covered = Counter()
    for config, amount in solution.items():
        assert sum(n * t for n, t in config) <= 4096
        for n, t in config:
            covered[n] += t * amount
    shares = np.array([covered[n] / counted[n] for n in sorted(counted)])
    assert shares.max() <= 1 + 1e-9 and np.median(shares) > 0.5
    assert sum(solution.values()) <= 1.03 * sum(n * c for n, c in covered.items()) / 4096


def test_one_length_holds_most_pieces(spark, tokenizer):
    rows = [(i, "the same text") for i in range(300)] + [(1000 + i, "word " * i) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").repartition(5)
    used, least = check_packed(packing.packed(df, capacity=128).collect(), tokenizer, rows, 128)
    assert used <= least + 2
