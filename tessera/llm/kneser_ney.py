"""Quality rules by n-gram perplexity: modified Kneser-Ney over byte n-grams.

Spark counts all grams of ORDER bytes of the streams in `ngrams`, and from
their distinct left extensions the continuation counts of every shorter order.
Discounts follow from counts of counts, three to an order. Grams of three bytes
and more that were seen once are pruned and their mass goes to shorter ones: a
text's own oddities would make it look familiar. The model is sorted
arrays, one pair to an order: hashes of grams (an integer mix that keeps them
distinct) and probabilities with the lower orders already added, and hashes of
contexts with their back-off weights; lookups are binary searches. Its parts
have a bound; larger models are scored in several passes over disjoint sets of
last context bytes, with equal results.

A document's perplexity is that of its whole stream for each sign. Over the
documents of a language, quartiles of its logarithm are found from an exact
histogram; the bands are BAND_LOW and BAND_HIGH times the quartile distance
beyond the quartiles, times sqrt(1 + ROUGH / bytes) for the document at hand.
Documents below (repetitive, degenerate) or above (gibberish) are rejected. A
language's quartiles are rough when it has few documents, so they are averaged
with those of all documents, which count as PRIOR documents. The base rules come
first, and documents that fail them are left out of the bands.

Defined results: a null or empty text has no words and fails the base rules. A
null language is a language of its own. Null and repeated ids are carried
along. With no documents there is no model and no row.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import ngrams
from tessera.llm.common import stage

ORDER = 5
#: Singletons are pruned from levels[PRUNED] on.
PRUNED = 2
#: Width of the bands beyond the quartiles, in quartile distances.
BAND_LOW, BAND_HIGH = 4.0, 2.5
#: Documents that the quartiles of all documents count as beside a language's own.
PRIOR = 100
#: Bytes below which a text's perplexity is a rough estimate, so that its bands are wider.
ROUGH = 800
#: Rows of bands, one a language, that are sent to all executors.
MAX_LANGUAGES = 100_000
#: Histogram steps in a unit of log10 perplexity.
STEPS = 1000

SYMBOLS = "#*$%&|<>"


def mix(keys: np.ndarray) -> np.ndarray:
    """A one-to-one hash of 64-bit integers (multiply and shift)."""
    h = keys.astype(np.uint64)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def find(table: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each wanted value in a sorted array, and whether it is there."""
    if not len(table):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.searchsorted(table, wanted)
    at[at == len(table)] = 0
    return at, table[at] == wanted


def discounts(n: list[int]) -> np.ndarray:
    """Discounts for counts 0, 1, 2 and 3 or more from the numbers of grams seen once to four times."""
    n1, n2, n3, n4 = n
    out = np.array([0.0, 0.5, 0.75, 0.75])
    if n1 and n2:
        y = n1 / (n1 + 2 * n2)
        told = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 0.75]
        for i, d in enumerate(told):
            if 0 < d < i + 1:
                out[i + 1] = d
    return out


class KneserNey:
    """Probabilities of one set of last context bytes; levels[k] is for grams of k + 1 bytes."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]], cuts: list[np.ndarray]):
        self.gram_hash, self.gram_p, self.context_hash, self.context_weight = [], [], [], []
        below = None
        for k, (grams, n) in enumerate(levels):
            order = np.argsort(grams)
            grams, n = grams[order], n[order].astype(float)
            lost = cuts[k][np.minimum(n, 3).astype(int)]
            if k >= PRUNED:
                lost[n == 1] = 1.0
            contexts, at = np.unique(grams >> 8, return_inverse=True)
            total = np.bincount(at, n, len(contexts))
            weight = np.bincount(at, lost, len(contexts)) / total if len(contexts) else np.zeros(0)
            if below is None:
                lower = np.full(len(grams), 1 / 256)
            else:
                lower = self._at(k - 1, grams & ((1 << (8 * k)) - 1))
            p = (n - lost) / total[at] + weight[at] * lower
            below = True
            if k >= PRUNED:
                grams, p = grams[n > 1], p[n > 1]
            h = mix(grams)
            by = np.argsort(h)
            self.gram_hash.append(h[by])
            self.gram_p.append(p[by].astype(np.float32))
            h = mix(contexts)
            by = np.argsort(h)
            self.context_hash.append(h[by])
            self.context_weight.append(weight[by].astype(np.float32))

    def _at(self, k: int, grams: np.ndarray) -> np.ndarray:
        """Probability of the last byte of grams of k + 1 bytes."""
        at, hit = find(self.gram_hash[k], mix(grams))
        p = np.zeros(len(grams))
        p[hit] = self.gram_p[k][at[hit]]
        rest = np.flatnonzero(~hit)
        if len(rest):
            lower = self._at(k - 1, grams[rest] & ((1 << (8 * k)) - 1)) if k else np.full(len(rest), 1 / 256)
            at, known = find(self.context_hash[k], mix(grams[rest] >> 8))
            weight = np.ones(len(rest))
            weight[known] = self.context_weight[k][at[known]]
            p[rest] = weight * lower
        return p

    def probability(self, grams: np.ndarray) -> np.ndarray:
        return self._at(len(self.gram_hash) - 1, grams)


def train(docs: DataFrame, text_col: str = "text", order: int = ORDER, most: int = ngrams.MAX_GRAMS):
    """(parts, make): sets of last context bytes, and a function that collects the model of one."""
    levels = [ngrams.count_grams(docs, order, text_col)]
    for k in range(order - 1, 0, -1):
        kept = levels[0].groupBy(ngrams.shorter(F.col("gram"), k).alias("gram")).agg(F.count(F.lit(1)).alias("n"))
        levels.insert(0, stage(kept, "grams"))
    few = [F.sum((F.col("n") == i).cast("long")) for i in range(1, 5)]
    sizes = [t.agg(*(F.coalesce(f, F.lit(0)) for f in few), F.count(F.lit(1))).first() for t in levels]
    cuts = [discounts(list(s)[:4]) for s in sizes]
    parts = ngrams.parts_of(sum(s[4] for s in sizes), most)

    def make(part: np.ndarray) -> KneserNey:
        got = []
        for k, t in enumerate(levels):
            if k > 1 and len(parts) > 1:  # the two shortest orders have at most 65,792 grams and go to every part
                t = t.where(ngrams.last_context(F.col("gram")).isin(part.tolist()))
            rows = t.toArrow()
            got.append((rows["gram"].to_numpy(), rows["n"].to_numpy()))
        return KneserNey(got, cuts)

    return parts, make


def base_facts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    found = raw.split()
    chars = len(b"".join(found).decode("utf-8", "surrogatepass"))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [line for line in raw.split(b"\n") if line.split()]
    n, repeated = len(found), 0
    if n > 5:
        windows = list(zip(found, found[1:], found[2:], found[3:], found[4:]))
        if len(set(windows)) < len(windows):
            seen: dict[tuple, int] = {}
            twice = set()
            for w in windows:
                if w in seen:
                    twice.add(w)
                seen[w] = 1
            last = 0  # words before this one are counted
            for i, w in enumerate(windows):
                if w in twice:
                    repeated += i + 5 - max(i, last)
                    last = i + 5
    return n, chars, symbols, len(lines) - len(set(lines)), repeated


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def measure(rows: DataFrame, parts, make) -> DataFrame:
    """rows (doc_id, text, lang) with logp (log10 of the stream), signs (its bytes) and the base rules' counts."""

    def sender(part):
        model = make(part)
        order = len(model.gram_hash)
        sent = rows.sparkSession.sparkContext.broadcast(model)
        mine = np.zeros(256, bool)
        mine[part] = True

        def run(texts):
            grams, edges = ngrams.gram_keys([ngrams.stream(t) for t in texts], order)
            own = mine[(grams >> 8) & 255]
            logs = np.zeros(len(grams))
            logs[own] = np.log10(sent.value.probability(grams[own]))
            total = np.concatenate([[0.0], np.cumsum(logs)])
            return list((total[edges[1:]] - total[edges[:-1]])[:, None])

        return run

    def finish(texts, sums):
        facts = np.array([(len(ngrams.stream(t)), *base_facts(t)) for t in texts], float).reshape(-1, 6).T
        return [np.concatenate(sums) if sums else [], *map(pa.array, facts)]

    return ngrams.folded(rows, parts, sender, finish, ["logp", "signs", *BASE])


def bands(scored: DataFrame) -> DataFrame:
    """lang, quartiles and their distance (steps of log10 perplexity) over documents that passed the base rules."""
    counted = scored.where(~F.col("base_failed")).groupBy("lang", "step").agg(F.count(F.lit(1)).alias("n"))
    counted = counted.withColumn("all", F.explode(F.array(F.lit(False), F.lit(True))))
    counted = counted.withColumn("lang", F.when(~F.col("all"), F.col("lang"))).groupBy("all", "lang", "step").agg(F.sum("n").alias("n"))
    by = Window.partitionBy("all", "lang")
    upto = by.orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = counted.withColumns({"upto": F.sum("n").over(upto), "total": F.sum("n").over(by)})
    at = [F.min(F.when(F.col("upto") >= q * F.col("total"), F.col("step"))).alias(f"q{i}") for i, q in ((1, 0.25), (3, 0.75))]
    found = run.groupBy("all", "lang").agg(F.first("total").alias("total"), *at)
    wide = F.greatest(F.col("q3") - F.col("q1"), F.lit(STEPS // 100))
    return found.select("all", "lang", "total", "q1", "q3", wide.alias("wide"))


def judge(
    docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", order: int = ORDER, most: int = ngrams.MAX_GRAMS
) -> DataFrame:
    """doc_id, lang, the base rules' counts, base_failed, perplexity and kept of every document."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")
    )
    return _judged(measure(rows, *train(rows, "text", order, most)).drop("text"))


def keep(
    docs: DataFrame, text_col="text", lang_col="lang", order: int = ORDER, most: int = ngrams.MAX_GRAMS
) -> DataFrame:
    """docs, all columns, without the rows that `judge` does not keep; each row has a verdict of its own."""
    inner = ["text" if c == text_col else f"_c{i}" for i, c in enumerate(docs.columns)]
    model = train(docs.select(F.col(text_col).alias("text")), "text", order, most)
    rows = docs.toDF(*inner)
    rows = rows.withColumn("lang", F.col(inner[docs.columns.index(lang_col)]).cast("string"))
    judged = _judged(measure(rows, *model)).where("kept")
    return judged.select(*(F.col(i).alias(c) for i, c in zip(inner, docs.columns, strict=True)))


def _judged(scored: DataFrame) -> DataFrame:
    scored = scored.withColumns({c: F.col(c).cast("long") for c in BASE})
    per_sign = -F.col("logp") / F.col("signs")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    scored = scored.withColumns(
        {"base_failed": failed, "perplexity": F.pow(F.lit(10.0), per_sign), "step": F.round(per_sign * STEPS).cast("long")}
    )
    scored = stage(scored.drop("logp"), "quality")
    edges = bands(scored)
    sides = ["q1", "q3", "wide"]
    own = edges.where(~F.col("all")).select(F.col("lang").alias("of"), "total", *sides)
    every = edges.where("all").first()  # one row: the bands of all documents
    few = own.count() <= MAX_LANGUAGES  # else the join is shuffled
    got = scored.join(F.broadcast(own) if few else own, F.col("lang").eqNullSafe(F.col("of")), "left").drop("of")
    n = F.coalesce("total", F.lit(0))
    q1, q3, wide = ((n * F.coalesce(c, F.lit(0)) + PRIOR * F.lit(every and every[c])) / (n + PRIOR) for c in sides)
    wide = wide * F.sqrt(1 + F.lit(float(ROUGH)) / F.col("signs"))
    inside = F.col("step").between(q1 - BAND_LOW * wide, q3 + BAND_HIGH * wide)
    kept = F.coalesce(~F.col("base_failed") & inside, F.lit(False))
    return got.withColumn("kept", kept).drop("step", "signs", "total", *sides)
