import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import fuzzy_hash as fh


def slow_ends(raw, bits):
    """Chunk ends from the window at each position, without vectors."""
    out = []
    for i in range(len(raw)):
        h = 0
        for k in range(fh.WINDOW - 1, -1, -1):
            h = h * 0x01000193 & 0xFFFFFFFF
            if i - k >= 0:
                h = h + raw[i - k] + 1 & 0xFFFFFFFF
        h ^= h >> 15
        h = h * 0x85EBCA6B & 0xFFFFFFFF
        h ^= h >> 13
        if h & ((1 << bits) - 1) == (1 << bits) - 1:
            out.append(i + 1)
    return out


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=200))
def test_rolling_hash(raw):
    h = fh.rolling(np.frombuffer(raw, np.uint8).astype(np.uint32))
    assert (np.flatnonzero((h & 7) == 7) + 1).tolist() == slow_ends(raw, 3)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abcd", max_size=40), st.text(alphabet="abcd", max_size=40))
def test_common_subsequence(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert fh._common_subsequence(a, b) == table[-1][-1]


def test_likeness_tells_edits_from_strangers():
    rnd = random.Random(1)
    words = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 9))) for _ in range(3000)]
    for size in (30, 200, 3000):
        one, two = (" ".join(rnd.choice(words) for _ in range(size)) for _ in "ab")
        mark = fh.fingerprint(one)
        assert fh.likeness(mark, fh.fingerprint(one)) == 1
        assert fh.likeness(mark, fh.fingerprint(fh.edited(one, two))) > 0.5
        assert fh.likeness(mark, fh.fingerprint(two)) < 0.1


def test_periodic_texts_have_bounded_signatures():
    for text in ("a" * 100_000, "ab" * 100_000, "The " * 50_000):
        assert len(fh.fingerprint(text)) < 2 * fh.MOST + 20
    assert fh.fingerprint("The " * 50_000) != fh.fingerprint("The " * 50_000 + "end")


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    out = []
    for i, (name, text) in enumerate(rows):
        text, other = text or "", rows[(i + 1) % len(rows)][1] or ""
        new = fh.edited(text, other)
        mark, new_mark = fh.fingerprint(text), fh.fingerprint(new)
        out.append((name, len(text), new, mark, new_mark, fh.likeness(mark, new_mark), fh.likeness(mark, fh.fingerprint(other))))
    return out


def test_next_text_likeness(spark):
    rnd = random.Random(4)
    for ids in (range(0, 400, 7), [5], [5, -3], [None, 1, 2], [None]):
        rows = [(i, rnd.choice([None, "", "x", "Ünï " * 40, "word " * rnd.randint(1, 800)])) for i in ids]
        docs = spark.createDataFrame([(*r, "f") for r in rows], "doc_id long, text string, fingerprint string").repartition(3)
        got = sorted((tuple(r) for r in fh.next_text_likeness(docs).collect()), key=str)
        assert got == sorted(brute(rows), key=str)
    assert fh.next_text_likeness(docs.limit(0)).count() == 0


def test_repeated_rows(spark):
    rows = [(1, "one text here"), (1, "one text here"), (2, "another")]
    got = fh.next_text_likeness(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in got) == [1, 1, 2]
    assert [r.near_next for r in got if r.doc_id == 1].count(1.0) == 1


def test_fingerprint_column(spark):
    docs = spark.createDataFrame([("a b c",), (None,)], "text string")
    assert [r.fingerprint for r in fh.fingerprints(docs).collect()] == [fh.fingerprint("a b c"), fh.fingerprint("")]
