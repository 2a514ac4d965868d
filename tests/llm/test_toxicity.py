import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import queries, toxicity


def brute(scores, trans, start):
    total, on = 0.0, np.zeros(len(scores))
    for states in itertools.product((0, 1), repeat=len(scores)):
        e = start[states[0]] + sum(s * y for s, y in zip(scores, states)) + sum(trans[a][b] for a, b in zip(states, states[1:]))
        w = math.exp(e)
        total += w
        on += w * np.array(states)
    return on / total


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    for sizes in ([1], [2, 1, 5], [7, 3, 8, 1, 1, 6]):
        trans, start = rng.normal(size=(2, 2)), rng.normal(size=2)
        scores = rng.normal(scale=3, size=sum(sizes))
        begins = np.zeros(len(scores), bool)
        begins[np.cumsum([0, *sizes[:-1]])] = True
        got = toxicity.marginals(scores, begins, trans, start)
        want = np.concatenate([brute(part, trans, start) for part in np.split(scores, np.cumsum(sizes)[:-1])])
        assert np.allclose(got, want)


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(3)
    plain = ["".join(rnd.choice("abdefgimnoprtu") for _ in range(rnd.randint(2, 8))) for _ in range(400)]
    bad = ["zhorn" + e for e in ("", "s", "ig", "est", "ung", "lich")]
    docs, labels = [], []
    for i in range(400):
        text = [rnd.choice(plain) for _ in range(rnd.randint(5, 80))]
        if toxic := i % 5 == 0:
            for _ in range(rnd.randint(1, 3)):
                text.insert(rnd.randint(0, len(text)), rnd.choice(bad).capitalize() + ",")
        docs.append((i, " ".join(text), "x"))
        labels.append((i, int(toxic)))
    return docs, labels


def test_held_out_accuracy_and_spans(spark, corpus):
    docs = spark.createDataFrame(corpus[0], "doc_id long, text string, score string")
    labels = spark.createDataFrame(corpus[1], "doc_id long, toxic int")
    model = toxicity.train(docs, labels.where("doc_id % 3 != 1"))
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    texts, truth = {i: t for i, t, _ in corpus[0]}, dict(corpus[1])
    for i in range(1, 400, 3):
        assert (got[i].score >= 0.7) == bool(truth[i])
        assert all("zhorn" in texts[i][s.start : s.end].lower() for s in got[i].spans)
        assert bool(got[i].spans) == bool(truth[i])


def test_odd_rows(spark, corpus):
    labels = spark.createDataFrame([*corpus[1], (None, 1), (5, None), (7, 9)], "doc_id long, toxic int")
    rows = [*corpus[0], (None, "zhorn", "x"), (900, None, "x"), (901, "", "x"), (902, "1 2 3 %%", "x"), (903, "İ zhornig " * 30000, "x"), (904, "twice", "x"), (904, "twice", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[900].score == by[901].score == by[902].score == 0 and by[903].score > 0.7 and by[None].score > 0.7
    assert len(by[903].spans) == 30000
    none = toxicity.train(docs, labels.limit(0))
    assert all(r.score == 0 and not r.spans for r in toxicity.score(docs, none).collect())
    assert toxicity.score(docs.limit(0), none).count() == 0
    assert toxicity.train(docs.limit(0), labels).logistic is None


def test_query_accuracy(spark):
    got = queries.op5_toxicity(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = got.join(labels, "doc_id").where("held_out").groupBy("toxic", "predicted").agg(F.count("*").alias("n")).collect()
    n = {(r.toxic, r.predicted): r.n for r in rows}
    assert n.get((0, 1), 0) <= 1 and n.get((1, 0), 0) <= 3 and n[1, 1] >= 10
