import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import ngrams, queries
from tessera.llm import pitman_yor as py


def test_seating_follows_the_process():
    rng, rnd = np.random.default_rng(1), random.Random(1)
    n, parent, d, theta = [1, 3, 12], [0.2, 0.3, 0.5], 0.6, 1.0

    def one_by_one():
        order = [i for i, k in enumerate(n) for _ in range(k)]
        rnd.shuffle(order)
        seated, tables = [0] * 3, [0] * 3
        for i in order:
            new = (theta + d * sum(tables)) * parent[i]
            if rnd.random() < new / (seated[i] - d * tables[i] + new):
                tables[i] += 1
            seated[i] += 1
        return tables

    want = np.mean([one_by_one() for _ in range(4000)], 0)
    got = np.mean([py.seat(np.array(n), np.zeros(3, int), np.array(parent), d, theta, rng) for _ in range(4000)], 0)
    assert np.allclose(got, want, rtol=0.12)
    many = py.seat(np.array([10**7]), np.zeros(1, int), np.array([0.5]), d, theta, rng)
    assert 1 <= many[0] <= 10**6


def test_tree_probabilities_sum_to_one():
    texts = ["the cat sat", "the dog", "a cat"] * 5
    keys, _ = ngrams.gram_keys([ngrams.stream(t) for t in texts], 4)
    grams, n = np.unique(keys, return_counts=True)
    tree = py.Tree(grams, n, 1, 4)
    rng, base = np.random.default_rng(3), np.full(len(tree.grams[0]), 1 / 256)
    for _ in range(3):
        tree.sweep(base, [0.5] * 4, 1.0, rng)
        for k in range(4):
            assert (tree.tables[k] >= 1).all() and (tree.tables[k] <= tree.n[k]).all()
    p, w = tree.predictive(base, [0.5] * 4, 1.0)
    levels = []
    for k in range(4):
        levels.append((tree.grams[k], np.stack([p[k]] * 3, 1).astype(np.float32), tree.contexts[k], np.stack([w[k]] * 3, 1).astype(np.float32)))
    model = py.PitmanYor(levels)
    for context in (b"the", b" ca", b"zzz", b"\n\n\n"):
        at = int.from_bytes(context, "big") << 8
        assert abs((10.0 ** model.log10(at + np.arange(256))).sum() - 1) < 1e-4


def test_lookup():
    rng = np.random.default_rng(2)
    for n in (0, 1, 50, 5000):
        keys = np.unique(rng.integers(0, 1 << 48, n))
        table = py.Lookup(keys)
        wanted = np.concatenate([keys, rng.integers(0, 1 << 48, 100)])
        want = [int(np.flatnonzero(keys == x)[0]) if x in keys else -1 for x in wanted[:200]]
        assert table.find(wanted)[:200].tolist() == want


def brute_base(rows):
    def tokens(t):
        return [*(t or "").encode().lower().split(), "end"]

    counts = {}
    for _, t, trained in rows:
        for w in tokens(t) if trained else []:
            counts[w] = counts.get(w, 0) + 1
    total, below = sum(counts.values()), sum(counts.values()) + 0.5 * (len(counts) + 1)
    return total, {
        i: (len(tokens(t)), sum(w in counts for w in tokens(t)), sum(math.log10((counts.get(w, 0) + 0.5) / below) for w in tokens(t)))
        for i, t, _ in rows
    }


@pytest.mark.parametrize("most", [ngrams.MAX_GRAMS, 300])
def test_scores(spark, most):
    rnd = random.Random(4)
    vocabulary = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 6))) for _ in range(80)]
    rows = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(0, 60))), i % 5 != 1) for i in range(200)]
    rows += [(300, None, True), (301, "", False), (302, "UNSEEN words zzz", None), (303, "x" * 3000, False)]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, trained boolean, score string")
    got = py.score(docs, order=4, most=most).collect()
    assert len(got) == len(rows)
    total, base = brute_base(rows)
    for r in got:
        tokens, known, log = base[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (tokens, known, total)
        assert abs(r.base_score - log) < 1e-9 * max(1, abs(log)) and r.score < 0
    signs = {i: len(ngrams.stream(t)) for i, t, _ in rows}
    assert sum(r.score for r in got if r.doc_id < 200) > sum(signs[i] for i in range(200)) * math.log10(1 / 8)
    again = {r.doc_id: r.score for r in py.score(docs, order=4).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-3 * abs(r.score) for r in got)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a b", False), (2, None, False)], "doc_id long, text string, trained boolean")
    got = {r.doc_id: r for r in py.score(docs).collect()}
    assert got[1].base_score == 0 and got[1].n_known == 0 and abs(got[1].score - 5 * math.log10(1 / 256)) < 1e-6 and got[2].n_tokens == 1
    assert py.score(docs.limit(0)).count() == 0


def test_query_beats_the_base_on_held_out_texts(spark):
    got = queries.op8_pitman_yor(spark, "/root/testdata/sf0.01").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
