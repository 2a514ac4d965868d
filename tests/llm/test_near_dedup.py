import random
from collections import defaultdict

import numpy as np
import pytest

from tessera.llm import near_dedup as nd
from tessera.llm.components import components


def shingles(text, size):
    found = (text or "").encode().lower().split()
    if not found:
        return set()
    return {tuple(found[i : i + size]) for i in range(max(1, len(found) - size + 1))} if len(found) >= size else {tuple(found)}


def brute(rows, size, threshold=80):
    sets = [shingles(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    live = [i for i in range(len(rows)) if rows[i][0] is not None and sets[i]]
    for x, i in enumerate(live):
        for j in live[:x]:
            both = len(sets[i] & sets[j])
            if 100 * both >= threshold * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = {}
    for i in live:
        least[root(i)] = min(least.get(root(i), 1 << 62), rows[i][0])
    return sorted(
        ((rows[i][0], len(sets[i]), least[root(i)] if i in set(live) else rows[i][0]) for i in range(len(rows))), key=str
    )


def corpus(seed, n=160):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 6))) for _ in range(500)]
    passage = [rnd.choice(words) for _ in range(60)]
    texts = []
    for i in range(n):
        if i and rnd.random() < 0.5:
            base = rnd.choice(texts).split(" ")
            for _ in range(rnd.randint(0, 1 + len(base) // 40)):
                base[rnd.randrange(len(base))] = rnd.choice(words)
            texts.append(" ".join(base))
        else:
            own = [rnd.choice(words) for _ in range(rnd.choice([1, 3, 5, 40, 90, 200]))]
            texts.append(" ".join(own + passage if rnd.random() < 0.4 else own))
    return texts


@pytest.mark.parametrize("size,seed", [(4, 1), (5, 2), (4, 3)])
def test_components_equal_brute_force(spark, size, seed):
    rows = [(i * 7 % 1000, t) for i, t in enumerate(corpus(seed))]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, component_id string")
    got = nd.near_duplicates(docs, shingle=size).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows, size)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_blocks_alone_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 7)
    rows = list(enumerate(corpus(4, 100)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = nd.near_duplicates(docs, shingle=4, rounds=0).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows, 4)


def test_odd_rows(spark):
    long = " ".join(f"w{i % 997}" for i in range(40000))
    rows = [(5, None), (4, ""), (3, " \n"), (2, "Only Three words"), (1, "only three WORDS"), (None, "only three words"), (8, long), (9, long + " end"), (6, "a b c d"), (7, "a b c e"), (20, "same row here again ok"), (20, "same row here again ok")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in nd.near_duplicates(docs, shingle=4).collect()}
    assert got == {(5, 0, 5, True), (4, 0, 4, True), (3, 0, 3, True), (2, 1, 1, False), (1, 1, 1, True), (None, 1, None, True),
                   (8, 997, 8, True), (9, 998, 8, False), (6, 1, 6, True), (7, 1, 7, True), (20, 2, 20, True)}
    assert nd.near_duplicates(docs.limit(0)).count() == 0


def test_pruning_bound():
    least = nd.least_matches(80, 1e-6)
    rng = np.random.default_rng(1)
    left = rng.integers(0, 1 << 32, (20000, 192), np.int64).astype(np.uint32)
    for chance, low, high in ((0.8, 0.9999, 1), (0.3, 0, 0.001)):
        right = np.where(rng.random(left.shape) < chance, left, left + np.uint32(1))
        assert low <= nd.sequential(left, right, least).mean() <= high


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(2)
    pool = np.unique(rng.integers(0, 1 << 63, 3000, np.int64).astype(np.uint64))
    sigs = nd.signatures([np.sort(pool[:2000]), np.sort(pool[500:2500]), np.zeros(0, np.uint64)])
    assert abs((sigs[0] == sigs[1]).mean() - 0.6) < 0.12


def test_connected_components(spark):
    rnd = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rnd.randint(100, 400), rnd.randint(100, 400)) for _ in range(150)]
    edges += [(1000, i) for i in range(500, 900)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    near = defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    want = {}
    for n in sorted(near):
        if n not in want:
            todo = [n]
            while todo:
                x = todo.pop()
                if x not in want:
                    want[x] = n
                    todo += near[x]
    assert got == want
