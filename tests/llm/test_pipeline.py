import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm import queries

DIR = "/root/testdata/sf0.001"


def shingles(text, size=5):
    found = (text or "").encode().lower().split()
    if len(found) < size:
        return {tuple(found)} if found else set()
    return {tuple(found[i : i + size]) for i in range(len(found) - size + 1)}


def test_stages_keep_what_the_operators_keep(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    held = docs
    for name, function in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in held.collect()}
        held = corpus_pipeline.stage(function(spark, held, DIR), "test")
        assert held.schema == docs.schema, name
        after = {r.doc_id: r for r in held.collect()}
        assert all(before[i] == r for i, r in after.items()) and len(after) > 0.5 * len(before)
        if name == "near-dedup":  # brute force: components of pairs at 0.8 or more
            sets = {i: shingles(r.text) for i, r in before.items()}
            root = {i: i for i in sets}

            def find(i, root=root):
                while root[i] != i:
                    i = root[i]
                return i

            for i in sets:
                for j in sets:
                    both = len(sets[i] & sets[j])
                    if i < j and both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                        a, b = sorted((find(i), find(j)))
                        root[b] = a
            assert set(after) == {i for i in sets if find(i) == i}
    kept = {r.doc_id: r.text for r in held.collect()}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    pieces = defaultdict(list)
    for r in corpus_pipeline.STAGES[-1][1](spark, held, DIR).collect():
        pieces[r.doc_id].append((r.start, np.frombuffer(bytes(r.ids), "<u4").tolist()))
    assert set(pieces) == set(kept)
    for i, parts in pieces.items():
        assert [x for _, p in sorted(parts) for x in p] == library.encode(kept[i] or "", add_special_tokens=False).ids + [0]


def test_run_and_registration(spark):
    assert queries.queries()["pipeline"] is corpus_pipeline.run
    got = corpus_pipeline.run(spark, DIR)
    assert got.count() > 0 and "sequence_id" in got.columns


def test_nulls_and_repeats(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    good = docs.where("length(text) > 500 and doc_id < 20")
    odd = spark.createDataFrame([(None, None, None, None, None), (10**9, "", None, "s", 0)], docs.schema)
    nameless = good.withColumn("doc_id", F.lit(None).cast("long"))  # judged like any other row
    held = docs.union(odd).union(good).union(nameless)
    for name, function in corpus_pipeline.STAGES[:-1]:
        held = corpus_pipeline.stage(function(spark, held, DIR), "test")
        if name == "quality rules":  # as for the same text with a name
            named = {r.text for r in held.where("doc_id < 20 and length(text) > 500").collect()}
    rows = held.collect()
    assert named and {r.text for r in rows if r.doc_id is None} == named
    assert all(r.doc_id != 10**9 for r in rows)
    ids = [r.doc_id for r in rows if r.doc_id is not None]
    assert len(ids) == len(set(ids))
    assert zlib.crc32(b"") == 0


def test_empty_clashing_and_long(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    names = ["logp", "signs", "kept", "step", "ids", "component_id", "n_words", "toxic", "score", "_sums"]
    more = docs.where("doc_id < 60").select("*", *(docs.doc_id.alias(n) for n in names))
    long = spark.createDataFrame([(10**9, "a word " + " " * 1_000_001 + "and more of it " * 3, "en", "s", 0, *[1] * len(names))], more.schema)
    for held in (more.union(long), more.limit(0)):
        n, columns = held.count(), held.columns
        for name, function in corpus_pipeline.STAGES[:-1]:
            held = corpus_pipeline.stage(function(spark, held, DIR), "test")
            assert held.columns == columns, name
        pieces = corpus_pipeline.STAGES[-1][1](spark, held, DIR)
        assert (held.count() > 20) == (n > 0) == (pieces.count() > 0)
