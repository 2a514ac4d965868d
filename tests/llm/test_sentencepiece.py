import random

import public_tokenizers
import pytest
import sentencepiece

from tessera.llm import sentencepiece_bpe as bpe

PATH = public_tokenizers.path("piece_bpe_32k.model")
SIGNS = [" ", "  ", "▁", "\n", "\t", "a", "the", "The", "é", "\x00", "1", "12", ".", "ß", "<s>", "</s>", "<unk>",
         "<0x0A>", "🙂", "日本", " ́", "Σ", "zzzzzzz", "aaaaaaaaaaaaaaa", "�"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_ids_and_text_equal_the_library(library):
    model, rnd = bpe.model(PATH), random.Random(5)
    for _ in range(5000):
        text = "".join(rnd.choice(SIGNS) for _ in range(rnd.randint(0, 25)))
        ids = model.encode(text)
        assert ids == library.encode(text)
        assert model.decode(ids) == library.decode(ids)


def test_decoding_any_ids_equals_the_library(library):
    model, rnd = bpe.model(PATH), random.Random(6)
    for _ in range(3000):
        ids = [rnd.choice([0, 1, 2, 3, 35, 130, 131, 200, 230, 259, 300, 1000, 29871, 31999]) for _ in range(rnd.randint(0, 9))]
        assert model.decode(ids) == library.decode(ids)


def test_backtracking_equals_plain_merging():
    model, rnd = bpe.model(PATH), random.Random(7)
    for _ in range(3000):
        part = "▁" + "".join(rnd.choice("aehinorst") for _ in range(rnd.randint(1, 30)))
        assert model.split(part) == model.merged(part)


def test_operator_on_odd_rows(spark, library):
    long = "word " * 30000 + "x" * 3000
    rows = [(1, None, "a"), (2, "", "b"), (None, "no id", None), (3, "twice", "c"), (3, "twice", "c"), (4, long, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(((r.doc_id, r.ids, r.decoded) for r in bpe.encode_and_decode(docs, PATH).collect()), key=str)
    want = [(i, library.encode(t or ""), library.decode(library.encode(t or ""))) for i, t, _ in rows]
    assert got == sorted(want, key=str)
    assert bpe.encode_and_decode(docs.limit(0), PATH).count() == 0
    again = bpe.decode(bpe.encode_and_decode(docs, PATH).select("doc_id", "ids"), PATH)
    assert sorted(r.decoded for r in again.collect()) == sorted(library.decode(library.encode(t or "")) for _, t, _ in rows)
