import random
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tessera.llm import packing, vocab

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_vocabularies_equal_the_library():
    rnd = random.Random(3)
    signs = [" ", "  ", "\n", "\t", "a", "The", "é", "\x1c", "\x85", "\xa0", "1", ".", "'s", "\x00", "\x01", "ß", "Ⅷ",
             "<|endoftext|>", "🙂", " ́", "Σ", "\r\n", "İ", "²", "ÿ", " "]
    for kind, name in ((vocab.ByteLevelEncoder, "byte_bpe_50k.json"), (vocab.WordEndEncoder, "word_bpe_49k.json")):
        library = Tokenizer.from_file(public_tokenizers.path(name))
        library.encode_special_tokens = True
        texts = ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 30))) for _ in range(3000)]
        got = vocab.encoder(kind, public_tokenizers.path(name)).encode(texts)
        for text, ids in zip(texts, got, strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_assign_covers_without_padding():
    rnd = random.Random(4)
    for _ in range(50):
        lengths = [rnd.choice([0, 1, 5, 100, 1023, 1024, 1025, 5000, rnd.randint(1, 3000)]) for _ in range(rnd.randint(1, 60))]
        pieces, made = packing.assign(lengths, 1024)
        by_item, by_seq = defaultdict(list), defaultdict(list)
        for item, start, n, seq, offset in pieces:
            assert n > 0
            by_item[item].append((start, n))
            by_seq[seq].append((offset, n))
        for item, n in enumerate(lengths):
            at = 0
            for start, k in sorted(by_item[item]):
                assert start == at
                at += k
            assert at == n
        assert sorted(by_seq) == list(range(made))
        for parts in by_seq.values():
            at = 0
            for offset, k in sorted(parts):
                assert offset == at
                at += k
            assert at == 1024 or at & (at - 1) == 0


def test_costs_are_balanced():
    rnd = random.Random(8)
    lengths = [rnd.randint(50, 400) for _ in range(2000)]
    pieces, made = packing.assign(lengths, 1024)
    cost = np.zeros(made)
    for _, _, n, seq, _ in pieces:
        cost[seq] += n + n * n / 1024
    full = cost[: sum(lengths) // 1024]
    assert full.max() / full.mean() < 1.3


def test_pack_on_odd_rows(spark):
    library = Tokenizer.from_file(PATH)
    rows = [(1, None, "a"), (2, "", "b"), (None, "no id", None), (3, "twice", "c"), (3, "twice", "c"), (4, "word " * 20000, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = packing.pack(docs, PATH, group_tokens=500).collect()
    want = sorted(library.encode(t or "", add_special_tokens=False).ids + [0] for _, t, _ in rows)
    whole = defaultdict(list)
    for r in got:
        assert r.length == len(r.ids) // 4
        if r.doc_id != 3:
            whole[r.doc_id].append((r.start, np.frombuffer(bytes(r.ids), "<u4").tolist()))
    twice = [r for r in got if r.doc_id == 3]
    assert sum(r.length for r in twice) == 2 * twice[0].doc_tokens
    joined = [[i for _, ids in sorted(parts) for i in ids] for parts in whole.values()]
    assert sorted(joined) == sorted(w for w in want if w != library.encode("twice").ids + [0])
    rooms = defaultdict(list)
    for r in got:
        rooms[r.sequence_id].append((r.offset, r.length))
    for parts in rooms.values():
        assert [o for o, _ in sorted(parts)] == list(np.cumsum([0, *(n for _, n in sorted(parts))])[:-1])
    assert packing.pack(docs.limit(0), PATH).count() == 0


def test_a_million_white_spaces(spark):
    rows = [(1, "a " + " " * 1_000_001 + "b"), (2, "\n" * 999_999), (3, "x" * 300_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    library = Tokenizer.from_file(PATH)
    got = defaultdict(list)
    for r in packing.pack(docs, PATH).collect():
        got[r.doc_id].append((r.start, np.frombuffer(bytes(r.ids), "<u4").tolist()))
    for i, text in rows:
        assert [x for _, ids in sorted(got[i]) for x in ids] == library.encode(text, add_special_tokens=False).ids + [0]
