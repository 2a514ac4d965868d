"""Toxic spans by a linear-chain conditional random field, and scores of documents.

Labels are of documents, so tokens are labelled first. Over all labelled
training documents, Spark counts in how many toxic and clean ones each word
and word start (4 to 8 letters that go on) occurs. Starts that occur far more
often in toxic documents, beyond what chance gives among so many starts (a
likelihood ratio test with a Bonferroni bound), mark the toxic tokens of toxic
documents; all other tokens are labelled clean.

A CRF with two states is trained on those labelled tokens of a sample of at
most SAMPLE documents of each class, of at most LONGEST characters (the only
bound here: the fit runs on the driver). Its features are hashed word starts, ends and the word itself, into a
weight table of fixed size, and transitions. Forward and backward messages of
all documents of a batch are computed side by side: 2x2 transfer matrices are
multiplied within segments, documents begin with matrices that forget what came
before, and segments are joined at their ends.

Every document is then tagged over its whole text. Its score is a logistic
function of the three largest marginal logits and the expected number of toxic
tokens, fitted on the same sample; offending spans are runs of tokens with a marginal
of 0.5 or more, as offsets in code points.

Defined results: a null, empty or wordless text scores 0 and has no spans; so
does everything when the training rows lack a class. Rows with null labels or
ids are not trained on. A doc_id with several labels counts once for each; of
several texts with one doc_id the fit takes the least.
Rows are kept one for one. Columns besides the ones named are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import batch, lean, slices

#: Documents of each class that the CRF and the score are fitted on, at most.
SAMPLE = 500
WEIGHTS = 1 << 18
EPOCHS, RATE, DECAY = 40, 0.5, 1e-5
#: Tokens whose messages are computed side by side; a longer document is a chunk of its own.
CHUNK = 200_000
#: A start must be LIFT times as frequent in toxic documents, and unlikely by chance among CHANCE starts a document.
LIFT, CHANCE = 10.0, 10
#: Labels (12 bytes a row) that are sent to all executors rather than shuffled together with the texts.
SMALL_ROWS = 1_000_000
#: Characters of a text beyond which the fit leaves it out; with SAMPLE, the bound of what the driver collects.
LONGEST = 200_000

TOKEN = re.compile(r"[^\W\d_]+")
#: The 256 signs of one byte: letters become small ones, all else a space.
LETTERS = bytes(ord(chr(i).lower()) if TOKEN.fullmatch(chr(i)) else 32 for i in range(256))


def tokens(text: str | None) -> list[bytes]:
    """Lower-cased words of a text: one byte a letter where that can hold it, else UTF-8."""
    if not text:
        return []
    try:
        raw = text.encode("latin-1")
    except UnicodeEncodeError:
        return [_bytes(w.lower()) for w in TOKEN.findall(text)]
    return raw.translate(LETTERS).split()


def _bytes(word: str) -> bytes:
    try:
        return word.encode("latin-1")
    except UnicodeEncodeError:
        return word.encode("utf-8", "surrogatepass")


def starts(word: bytes) -> list[bytes]:
    """What labelling looks at: the word, and its starts of 4 to 8 letters that go on."""
    return [word + b"$", *(word[:n] + b"+" for n in range(4, min(9, len(word))))]


def _slot(values: np.ndarray, kind: int) -> np.ndarray:
    h = (values + np.uint64(kind)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (1 + (h >> np.uint64(33)) % np.uint64(WEIGHTS - 1)).astype(np.int64)


def features(words: list[bytes]) -> np.ndarray:
    """Hashed features of lower-cased words, a row each; the first is common to all, WEIGHTS stands for none."""
    n = np.fromiter(map(len, words), np.int64, len(words))
    whole = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    ends = np.array([w[-3:] for w in words], "S4").view(np.uint32).astype(np.uint64)
    heads = np.array([w + b"$" for w in words], "S9").view(np.uint8).reshape(-1, 9)
    made = [np.zeros(len(words), np.int64), _slot(whole, 1), _slot(ends, 2), _slot(whole, 3)]
    start = np.zeros(len(words), np.uint64)
    for k in range(1, 10):
        start = start * np.uint64(0x100000001B3) + heads[:, k - 1]
        if k >= 3:  # starts, with the end of the word as a sign
            made.append(np.where(k <= n + 1, _slot(start, 10 + k), WEIGHTS))
        if 4 <= k <= 8:  # starts that go on
            made.append(np.where(k < n, _slot(start, 30 + k), WEIGHTS))
    return np.stack(made, 1)


def marginals(scores: np.ndarray, begins: np.ndarray, trans: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Probability of state 1 at each token.

    scores: state 1 over state 0 at each token; begins: true where a document
    begins; trans: log potentials from state to state; start: of first states.
    """
    n = len(scores)
    if n == 0:
        return np.zeros(0)
    if n > CHUNK:  # in chunks of whole documents, for bounded memory
        first = np.flatnonzero(begins)
        cut = first[np.searchsorted(first, np.arange(0, n, CHUNK))[1:].clip(max=len(first) - 1)]
        cuts = [0, *(int(c) for c in np.unique(cut) if c), n]
        if len(cuts) > 2:
            return np.concatenate([marginals(scores[a:b], begins[a:b], trans, start) for a, b in zip(cuts, cuts[1:])])
    width = max(1, math.isqrt(n))
    segments = -(-n // width)
    emit = np.zeros((2, segments * width))
    emit[1, :n] = np.clip(scores, -60, 60)
    emit = np.exp(emit - emit.max(0))
    fresh = np.ones(segments * width, bool)
    fresh[:n] = begins
    # entries 00, 01, 10, 11 of each token's matrix, by place in the segment and segment
    step = np.empty((4, segments * width))
    for k in range(4):
        i, j = divmod(k, 2)
        step[k] = np.where(fresh, math.exp(start[j]), math.exp(trans[i, j])) * emit[j]
    step = np.ascontiguousarray(step.reshape(4, segments, width).transpose(0, 2, 1))

    ahead, back = np.empty_like(step), np.empty_like(step)
    ahead[:, 0], back[:, -1] = step[:, 0], step[:, -1]
    for t in range(1, width):
        _multiply(ahead[:, t - 1], step[:, t], ahead[:, t])
    for t in range(width - 2, -1, -1):
        _multiply(step[:, t], back[:, t + 1], back[:, t])

    into, out_of = np.full((2, segments), 0.5), np.full((2, segments), 0.5)
    for k in range(1, segments):
        a, b, c, d = ahead[:, -1, k - 1].tolist()
        x, y = into[0, k - 1], into[1, k - 1]
        u, v = x * a + y * c, x * b + y * d
        into[:, k] = u / (u + v), v / (u + v)
    for k in range(segments - 2, -1, -1):
        a, b, c, d = back[:, 0, k + 1].tolist()
        x, y = out_of[0, k + 1], out_of[1, k + 1]
        u, v = a * x + b * y, c * x + d * y
        out_of[:, k] = u / (u + v), v / (u + v)

    off, on = into[0] * ahead[0] + into[1] * ahead[2], into[0] * ahead[1] + into[1] * ahead[3]
    off[-1] *= out_of[0]
    on[-1] *= out_of[1]
    off[:-1] *= back[0, 1:] * out_of[0] + back[1, 1:] * out_of[1]
    on[:-1] *= back[2, 1:] * out_of[0] + back[3, 1:] * out_of[1]
    return (on / (off + on)).T.reshape(-1)[:n]


def _multiply(x: np.ndarray, y: np.ndarray, out: np.ndarray) -> None:
    """Products of 2x2 matrices, one a column, scaled to a sum of one."""
    out[0], out[1] = x[0] * y[0] + x[1] * y[2], x[0] * y[1] + x[1] * y[3]
    out[2], out[3] = x[2] * y[0] + x[3] * y[2], x[2] * y[1] + x[3] * y[3]
    out *= 1 / (out[0] + out[1] + out[2] + out[3])


class ToxicityModel:
    def __init__(self):
        self.weights = np.zeros(WEIGHTS + 1, np.float32)  # the last is that of no feature
        self.trans, self.start = np.zeros((2, 2)), np.zeros(2)
        self.logistic: np.ndarray | None = None

    def fit(self, texts: list[str], labels: list[list[int] | None], toxic: list[int]) -> "ToxicityModel":
        """labels: of each text's tokens, or None where they are not known; toxic: of the texts."""
        types: dict[bytes, int] = {}
        ids, gold, begins = array("i"), array("b"), array("b")
        for text, tags in zip(texts, labels, strict=True):
            if tags:
                ids.extend(types.setdefault(w, len(types)) for w in tokens(text))
                gold.extend(tags)
                begins.extend([1] + [0] * (len(tags) - 1))
        if not ids or len(set(toxic)) < 2:
            return self
        ids, y, first = np.array(ids), np.array(gold, float), np.array(begins, bool)
        rows = features(list(types))
        there = rows < WEIGHTS
        flat, owner = rows[there], np.repeat(np.arange(len(rows)), there.sum(1))
        w, seen = np.zeros(WEIGHTS), np.full(WEIGHTS, 1e-8)
        side, side_seen = np.zeros(6), np.full(6, 1e-8)  # transitions and starts
        pair = 2 * y[:-1] + y[1:]
        inner = ~first[1:]
        told = np.concatenate([np.bincount(pair[inner].astype(int), minlength=4), [(first & (y == 0)).sum(), (first & (y == 1)).sum()]])
        for _ in range(EPOCHS):
            score = np.bincount(owner, w[flat], len(rows))[ids]
            trans, start = side[:4].reshape(2, 2), side[4:]
            p = marginals(score, first, trans, start)
            by_type = np.bincount(ids, y - p, len(rows))
            grad = np.bincount(flat, by_type[owner], WEIGHTS) - DECAY * len(ids) * w
            seen += grad * grad
            w += RATE * grad / np.sqrt(seen)
            hoped = np.zeros(6)
            # expected transitions from neighbouring marginals and the transition weights
            a, b = p[:-1][inner], p[1:][inner]
            hoped[:4] = [((1 - a) * (1 - b)).sum(), ((1 - a) * b).sum(), (a * (1 - b)).sum(), (a * b).sum()]
            hoped[4:] = [(1 - p[first]).sum(), p[first].sum()]
            grad = told - hoped - DECAY * len(ids) * side
            side_seen += grad * grad
            side += 0.1 * grad / np.sqrt(side_seen)
        self.weights, self.trans, self.start = np.append(w, 0).astype(np.float32), side[:4].reshape(2, 2), side[4:]
        self._fit_score([self.facts(own) for own in self.tag(texts)], toxic)
        return self

    def _fit_score(self, facts: list[list[float]], toxic: list[int]) -> None:
        x, y = np.array(facts), np.array(toxic, float)
        theta = np.zeros(x.shape[1])
        for _ in range(60):  # Newton steps with a small penalty
            p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
            grad = x.T @ (y - p) - 0.02 * theta
            curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag([0.02] * len(theta))
            theta += np.clip(np.linalg.solve(curve, grad), -2, 2)
        self.logistic = theta

    def tag(self, texts: list[str | None]):
        """Marginals of each text's tokens."""
        found = [tokens(t) for t in texts]
        sizes = [len(f) for f in found]
        edges = np.concatenate([[0], np.cumsum(sizes)]).astype(int)
        types = list(dict.fromkeys(chain.from_iterable(found)))
        emitted = self.weights[features(types)].sum(1, dtype=float).tolist() if types else []
        get = dict(zip(types, emitted, strict=True)).__getitem__
        scores = np.fromiter(map(get, chain.from_iterable(found)), float, int(edges[-1]))
        begins = np.zeros(len(scores), bool)
        begins[edges[:-1][np.array(sizes, int) > 0]] = True
        p = marginals(scores, begins, self.trans, self.start)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            yield p[a:b]

    @staticmethod
    def facts(own: np.ndarray) -> list[float]:
        """What a document's score is made of: one, three largest logits, expected toxic tokens."""
        top = np.full(3, 1e-4)
        most = np.sort(own)[::-1][:3] if len(own) <= 3 else -np.sort(np.partition(-own, 2)[:3])
        top[: len(most)] = np.clip(most, 1e-4, 1 - 1e-4)
        return [1.0, *np.log(top / (1 - top)).tolist(), math.log1p(float(own.sum()))]

    def judge(self, texts: list[str | None]):
        """(score, spans as (start, end, largest marginal)) of each text."""
        for text, own in zip(texts, self.tag(texts), strict=True):
            if self.logistic is None or not len(own):
                yield 0.0, []
                continue
            z = float(np.dot(self.logistic, self.facts(own)))
            score = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
            yield score, self._spans(text, own) if own.max() >= 0.5 else []

    @staticmethod
    def _spans(text: str, own: np.ndarray):
        out, last = [], -2
        for i, m in enumerate(TOKEN.finditer(text)):
            if own[i] >= 0.5:
                if i == last + 1:
                    start, _, p = out.pop()
                    out.append((start, m.end(), max(p, float(own[i]))))
                else:
                    out.append((m.start(), m.end(), float(own[i])))
                last = i
        return out


def _start_counts(rows: DataFrame) -> DataFrame:
    """rows: text, toxic. For each hashed word start: toxic and clean documents that have it."""

    def run(batches):
        schema = pa.schema([("start", pa.binary()), ("toxic", pa.int64()), ("clean", pa.int64())])
        counts: list[dict[bytes, int]] = [{}, {}]

        def flush():
            keys = list(set(counts[0]) | set(counts[1]))
            yield batch(schema, [keys, [counts[1].get(k, 0) for k in keys], [counts[0].get(k, 0) for k in keys]])
            counts[0].clear()
            counts[1].clear()

        for b in slices(batches):
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = counts[1 if toxic else 0]
                for key in {s for w in set(tokens(text)) for s in starts(w)}:
                    own[key] = own.get(key, 0) + 1
            if len(counts[0]) + len(counts[1]) > 200_000:
                yield from flush()
        yield from flush()

    counted = rows.mapInArrow(lean(run), "start binary, toxic long, clean long")
    return counted.groupBy("start").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def toxic_starts(rows: DataFrame) -> set[bytes]:
    """Word starts that mark toxic tokens; see the module's docstring for the test."""
    sizes = rows.agg(
        F.coalesce(F.sum((F.col("toxic") == 1).cast("long")), F.lit(0)).alias("t"), F.count(F.lit(1)).alias("n")
    ).first()
    n_toxic, n_clean = sizes["t"], sizes["n"] - sizes["t"]
    if not n_toxic or not n_clean:
        return set()
    counted = _start_counts(rows).where("toxic > 1").select("start", "toxic", "clean")
    counted = counted.where(F.col("toxic") / n_toxic >= LIFT * F.col("clean") / n_clean)
    total = F.col("toxic") + F.col("clean")
    share = F.lit(n_toxic / (n_toxic + n_clean))
    gain = 2 * (
        F.col("toxic") * F.log(F.col("toxic") / (total * share))
        + F.when(F.col("clean") > 0, F.col("clean") * F.log(F.col("clean") / (total * (1 - share)))).otherwise(0.0)
    )
    # Bonferroni over the starts of a vocabulary that grows with the documents
    bound = 2 * math.log(CHANCE * (n_toxic + n_clean))
    return {bytes(r["start"]) for r in counted.where(gain >= bound).select("start").collect()}


def train(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="toxic", sample: int = SAMPLE):
    """A model from labelled rows; the caller leaves out rows that must not be learned from."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    labels = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("toxic"))
    labels = labels.where("doc_id is not null and toxic in (0, 1)")
    few = labels.count() <= SMALL_ROWS  # else Spark shuffles both sides
    marks = toxic_starts(docs.join(F.broadcast(labels) if few else labels, "doc_id").select("text", "toxic"))
    picked = None  # the ids of the sample are chosen from the narrow table, and are few enough to be sent
    for value in (0, 1):
        some = labels.where(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        picked = some if picked is None else picked.union(some)
    some = docs.where(F.length("text") <= LONGEST).join(F.broadcast(picked), "doc_id")
    rows = some.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["toxic"], r["text"] or ""))
    texts, tags, toxic = [], [], []
    for r in rows:
        text = r["text"] or ""
        own = [int(not marks.isdisjoint(starts(w))) if r["toxic"] else 0 for w in tokens(text)]
        texts.append(text)
        toxic.append(r["toxic"])
        tags.append(own if not r["toxic"] or any(own) else None)
    return ToxicityModel().fit(texts, tags, toxic)


SCHEMA = "doc_id long, score double, spans array<struct<start:int,end:int,p:double>>"


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score and offending spans of each document's whole text; map-only."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a weight table of fixed size
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())])
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("spans", pa.list_(span))])

    def run(batches):
        for b in slices(batches):
            judged = list(sent.value.judge(b.column(1).to_pylist()))
            spans = [[{"start": s, "end": e, "p": p} for s, e, p in own] for _, own in judged]
            yield batch(schema, [b.column(0), [s for s, _ in judged], spans])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(run), SCHEMA)


def reject(docs: DataFrame, model: ToxicityModel, threshold: float, text_col: str = "text") -> DataFrame:
    """docs, all columns, without the rows whose score reaches the threshold; map-only."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        for b in slices(batches):
            scores = sent.value.judge(b.column(at).to_pylist())
            yield b.filter(pa.array([s < threshold for s, _ in scores]))

    return docs.mapInArrow(lean(run), docs.schema)
