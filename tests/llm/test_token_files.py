import heapq
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm import token_files as tf
from tessera.llm import vocab

PATH = public_tokenizers.path("word_bpe_49k.json")


def plain_huffman_bits(counts):
    heap = [int(c) for c in counts if c]
    heapq.heapify(heap)
    total = 0
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        total += a + b
        heapq.heappush(heap, a + b)
    return total


def test_lengths_are_optimal_and_limited():
    rng = np.random.default_rng(1)
    for n in (2, 3, 10, 500):
        counts = rng.integers(0, 50, n + 3)
        counts[0] = 1
        counts[1] = 2
        lengths = tf.code_lengths(counts)
        assert (lengths > 0).tolist() == (counts > 0).tolist()
        assert int((counts * lengths).sum()) == plain_huffman_bits(counts)
    fib = [1, 1]
    while len(fib) < 40:
        fib.append(fib[-1] + fib[-2])
    lengths = tf.code_lengths(np.array(fib))
    assert lengths.max() == tf.MAX_BITS and sum(2.0 ** -int(x) for x in lengths) <= 1
    assert tf.code_lengths(np.array([0, 5, 0])).tolist() == [0, 1, 0]


@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 64, 65, 2048 * 3, 8 * 256, 8 * 256 + 1, 5000])
def test_bits_round_trip(n):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.3, n) % 3000).astype(np.uint32)
    lengths = tf.code_lengths(np.bincount(ids, minlength=3000))
    raw, points = tf.encode_bits(ids, tf.canonical_codes(lengths), lengths, 8)
    assert len(points) == -(-n // 8) + 1
    assert int(points[-1]) == int(lengths[ids].astype(np.int64).sum())
    assert tf.decode_bits(raw, points, n, 8, lengths).tolist() == ids.tolist()


def test_files_round_trip(spark):
    rnd = random.Random(2)
    rows = [(i * 3 % 101, " ".join(rnd.choice(["Das", "the", "Ünï", "\n", "42", "x" * 40]) for _ in range(rnd.randint(0, 60))), 1) for i in range(101)]
    rows += [(None, "none", 1), (500, None, 1), (501, "", 1), (7, "again", 1), (7, "again", 1), (502, "long " * 20000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int")
    got = tf.round_trip(docs, PATH, chunk_tokens=300, block_tokens=16).collect()
    library = Tokenizer.from_file(PATH)
    want = sorted(((i, library.encode(t or "", add_special_tokens=False).ids + [1]) for i, t, _ in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    got.sort(key=lambda r: r.start)
    assert [r.doc_id for r in got] == [i for i, _ in want]
    at = 0
    for r in got:
        ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert r.start == at
        at += len(ids)
        assert (r.doc_id, ids) in want
    assert zlib.crc32(b"".join(bytes(r.ids) for r in got if r.doc_id != 7)) == zlib.crc32(b"".join(np.array(x, "<u4").tobytes() for i, x in want if i != 7))
    assert tf.round_trip(docs.limit(0), PATH).count() == 0


def test_an_id_of_many_rows_fills_several_ranges(spark):
    rows = [(i if i % 3 else 7, f"text {i}") for i in range(600)] + [(None, f"none {i}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tf.round_trip(docs, PATH).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    assert [r.start for r in got] == np.cumsum([0, *(len(r.ids) // 4 for r in got)])[:-1].tolist()
    ids = np.full(1000, 7)
    hashes = np.random.default_rng(1).integers(0, 1 << 63, 1000, np.uint64) * np.uint64(2)
    part = tf.place(ids, np.ones(1000, bool), hashes, np.array([3, 7, 7, 7, 9]))
    assert set(part.tolist()) == {2, 3, 4}
    order = np.argsort(hashes.view(np.int64))
    assert (np.diff(part[order]) >= 0).all()
    assert tf.place(np.array([6, 8, 9]), np.ones(3, bool), hashes[:3], np.array([3, 7, 7, 7, 9])).tolist() == [1, 4, 5]


def test_unbroken_runs(spark):
    rows = [(1, " " * 1_000_001), (2, "a" * 300_000 + "b." * 600_000), (3, "\n" * 50_000 + "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    library = Tokenizer.from_file(PATH)
    got = {r.doc_id: np.frombuffer(bytes(r.ids), "<u4").tolist() for r in tf.round_trip(docs, PATH).collect()}
    assert got == {i: library.encode(t, add_special_tokens=False).ids + [1] for i, t in rows}


def test_words_of_plain_texts_equal_the_library():
    rnd = random.Random(6)
    encoder, library = vocab.encoder(vocab.WordEndEncoder, PATH), Tokenizer.from_file(PATH)
    library.encode_special_tokens = True
    plain = [c for c in map(chr, range(0x250)) if encoder.PLAIN.fullmatch(c)]
    signs = ["'s", "'t", "'re", "'ve", "'m", "'ll", "'d", "'S", "'LL", "'", "''", ",'", "r", "l", "a", "1", "²", "ª", " ", "\n", "İ", "Ⱥ", "Ⱦ", "ǅ", "ŉ"]
    texts = ["", None, "'", "'r", "'l", "'s", " ", "\n", *plain]
    texts += ["".join(rnd.choice(signs if rnd.random() < 0.7 else plain) for _ in range(rnd.randint(0, 40))) for _ in range(3000)]
    texts += ["".join(rnd.choice([*signs, "\t", "漢", "Σ", " x "]) for _ in range(rnd.randint(0, 40))) for _ in range(500)]
    texts.append(" ".join(rnd.choices(["漢", "a", "x'll", ""], k=25000)))
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text or "", add_special_tokens=False).ids, text
    assert encoder.encode([]) == [] and encoder.encode([None, " "]) == [b"", b""]


def test_encoding_takes_less_time_than_finding_words_one_by_one():
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 9))) for _ in range(3000)]
    texts = [" ".join(rnd.choices(words, k=500)) for _ in range(500)]
    encoder = vocab.encoder(vocab.WordEndEncoder, PATH)
    found = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\\sa-z0-9]+")

    def least(run):
        taken = []
        for _ in range(3):
            begun = time.process_time()
            run()
            taken.append(time.process_time() - begun)
        return min(taken)

    assert least(lambda: encoder.encode(texts)) < least(lambda: [found.findall(t.lower()) for t in texts])
