"""Language-model scores by a hierarchical Pitman-Yor process over words and their bytes.

Words can be spelled: a text is the stream of `ngrams`, so a token has the
probability of its bytes and the sign after it, given the ORDER - 1 bytes
before, which reach into earlier words. Every context is a restaurant whose dishes are bytes;
the restaurant of the context without its oldest byte is its parent, down to
the empty context, whose base is uniform. A customer of a restaurant either
joins a table with its dish or opens one, which sends a customer to the parent.

Seating is sampled by blocked Gibbs sweeps: from the longest contexts to the
shortest, all customers of a restaurant are seated anew given the parent's
current predictive probabilities. A dish's customers come spread over TURNS
turns; within one they are seated in blocks of at most half of those already
seated, within which the chance of a new table is held fixed. Restaurants whose last two context bytes agree form a subtree of
their own, so Spark samples subtrees in parallel; the two shortest orders (at
most 65,792 dishes in 257 restaurants) are sampled on the driver between rounds.
SAMPLES states are kept after burn-in, and predictive probabilities are averaged
over them. Seeds follow from the subtree, so a repeated task gives equal results.

Whole words have a restaurant too: its dishes are the training vocabulary and one
for all other words, with a uniform base and a table for each. A token's
probability is the mean of its chances in the word restaurant and as a spelling,
which sees the words before. As in the base score, words outside the vocabulary
are one symbol; as a spelling, such a word counts for itself only, so the chances
of all symbols add up to one at most.

Discounts come from counts of counts for each order; concentrations are fixed.
Model parts have a bound; larger models are scored in several passes (see
`ngrams.folded`), with equal results.

The base score is that of single tokens (words, then one end) with half a count
added. Words are counted by a 64-bit hash.

Defined results: a null or empty text is the end alone. Null ids are carried
along; a null flag of the training column counts as not trained on. Without
training rows every byte has chance 1/256. Rows are kept one for one.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import ngrams
from tessera.llm.common import batch, give_back, lean, slices, stage, words

ORDER = 6
SAMPLES, BURN_IN, ROUNDS = 3, 2, 2
CONCENTRATION = 1.0
TURNS = 16


def seat(n: np.ndarray, at: np.ndarray, parent: np.ndarray, discount: float, theta: float, rng) -> np.ndarray:
    """Tables of each dish after seating all its customers anew.

    n: customers of each dish; at: its restaurant, numbered from 0; parent: the
    dish's predictive probability in the parent restaurant.
    """
    tables, total = np.minimum(n, 1).astype(np.int64), np.zeros(int(at.max(initial=-1)) + 1)
    alone = np.flatnonzero(n == 1)  # one customer, one table: only the turn is random
    turns = rng.integers(0, TURNS, len(alone))
    alone, starts = at[alone[np.argsort(turns, kind="stable")]], np.searchsorted(np.sort(turns), np.arange(TURNS + 1))
    more = np.flatnonzero(n > 1)
    n, at, parent = n[more], at[more], parent[more]
    own, seated, phase = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64), rng.random(len(n))
    for turn in range(1, TURNS + 1):  # every dish's customers come spread over the turns
        total += np.bincount(alone[starts[turn - 1] : starts[turn]], minlength=len(total))
        upto = n if turn == TURNS else np.minimum(n, np.floor(n * (turn / TURNS) + phase).astype(np.int64))
        first = np.flatnonzero((seated == 0) & (upto > 0))
        own[first] = seated[first] = 1
        total += np.bincount(at[first], minlength=len(total))
        live = np.flatnonzero(seated < upto)
        while len(live):
            some = np.minimum(np.maximum(1, seated[live] // 2), upto[live] - seated[live])
            new = (theta + discount * total[at[live]]) * parent[live]
            opened = rng.binomial(some, new / (seated[live] - discount * own[live] + new))
            own[live] += opened
            np.add.at(total, at[live], opened)
            seated[live] += some
            live = live[seated[live] < upto[live]]
    tables[more] = own
    return tables


class Tree:
    """Levels of restaurants; levels[k] has sorted grams of first + k bytes, and places in the level before."""

    def __init__(self, grams: np.ndarray, n: np.ndarray, first: int, last: int):
        self.grams, self.up = [grams], []
        for size in range(last - 1, first - 1, -1):
            short, up = np.unique(self.grams[0] & ((1 << (8 * size)) - 1), return_inverse=True)
            self.grams.insert(0, short)
            self.up.insert(0, up)
        self.contexts, self.at = zip(*(np.unique(g >> 8, return_inverse=True) for g in self.grams))
        self.n = [np.zeros(len(g), np.int64) for g in self.grams]
        self.n[-1] = n.astype(np.int64)
        self.tables = [np.minimum(x, 1) for x in self.n]
        for k in range(len(self.grams) - 1, 0, -1):
            self.n[k - 1] = np.bincount(self.up[k - 1], minlength=len(self.grams[k - 1]))
            self.tables[k - 1] = np.ones(len(self.grams[k - 1]), np.int64)

    def predictive(self, base: np.ndarray, cuts: list[float], theta: float):
        """Probability of every dish, and back-off weight of every restaurant, level by level."""
        p, weights, below = [], [], base
        for k in range(len(self.grams)):
            total = np.bincount(self.at[k], self.n[k]) + theta
            weight = (theta + cuts[k] * np.bincount(self.at[k], self.tables[k])) / total
            own = (self.n[k] - cuts[k] * self.tables[k]) / total[self.at[k]] + weight[self.at[k]] * below
            p.append(own)
            weights.append(weight)
            if k + 1 < len(self.grams):
                below = own[self.up[k]]
        return p, weights

    def sweep(self, base: np.ndarray, cuts: list[float], theta: float, rng) -> None:
        p, _ = self.predictive(base, cuts, theta)
        for k in range(len(self.grams) - 1, -1, -1):
            parent = p[k - 1][self.up[k - 1]] if k else base
            self.tables[k] = seat(self.n[k], self.at[k], parent, cuts[k], theta, rng)
            if k:
                self.n[k - 1] = np.bincount(self.up[k - 1], self.tables[k], len(self.grams[k - 1])).astype(np.int64)


class Lookup:
    """Open addressing over sorted 64-bit keys: home slots by multiplication, then the next free ones."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(len(keys) * 3 // 2).bit_length())
        home = self._home(keys)
        by = np.argsort(home, kind="stable")
        line = np.arange(len(keys))
        slot = line + np.maximum.accumulate(home[by] - line) if len(keys) else line
        self.slots = np.full((1 << self.bits) + (int(slot.max()) - (1 << self.bits) + 2 if len(keys) and slot.max() >= 1 << self.bits else 2), -1, np.int64)
        self.place = np.zeros(len(self.slots), np.int32)
        self.slots[slot] = keys[by]
        self.place[slot] = by

    def _home(self, keys: np.ndarray) -> np.ndarray:
        mixed = (keys.astype(np.uint64) ^ (keys.astype(np.uint64) >> np.uint64(23))) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Place of each key, or -1."""
        out = np.full(len(wanted), -1, np.int64)
        slot, rest = self._home(wanted), None
        keys = wanted
        while len(keys):
            there = self.slots[slot]
            hit = there == keys
            which = np.flatnonzero(hit) if rest is None else rest[hit]
            out[which] = self.place[slot[hit]]
            go = ~hit & (there != -1)
            rest = np.flatnonzero(go) if rest is None else rest[go]
            keys, slot = keys[go], slot[go] + 1
        return out


class PitmanYor:
    """Sampled predictive probabilities of one model part: dishes and back-off weights of every level."""

    def __init__(self, levels):
        self.levels = levels  # (grams, p of each sample, contexts, weight of each sample), shortest first
        self.tables = None

    def __getstate__(self):
        return {"levels": self.levels, "tables": None}

    def log10(self, grams: np.ndarray) -> np.ndarray:
        """Logarithm of the mean over the samples of the chance of each gram's last byte."""
        if self.tables is None:  # the worker's own lookups take the place of the sorted keys
            self.tables = [(Lookup(g), Lookup(c)) for g, _, c, _ in self.levels]
            self.levels = [(None, p, None, w) for _, p, _, w in self.levels]
            self.whole = np.log10(self.levels[-1][1].mean(1)) if self.levels else np.zeros(0, np.float32)
        if not self.levels:
            return np.full(len(grams), -np.log10(256))
        at = self.tables[-1][0].find(grams)
        rest = np.flatnonzero(at < 0)
        out = self.whole[at]
        if len(rest):
            out[rest] = np.log10(self._samples(len(self.levels) - 1, grams[rest]).mean(1))
        return out

    def _samples(self, k: int, grams: np.ndarray) -> np.ndarray:
        if k < 0:
            return np.full((len(grams), SAMPLES), 1 / 256)
        (dishes, rooms), (_, p, _, weight) = self.tables[k], self.levels[k]
        at = dishes.find(grams)
        out = np.empty((len(grams), SAMPLES))
        hit = at >= 0
        out[hit] = p[at[hit]]
        rest = np.flatnonzero(~hit)
        if len(rest):
            lower = self._samples(k - 1, grams[rest] & ((1 << (8 * k)) - 1))
            room = rooms.find(grams[rest] >> 8)
            known = room >= 0
            lower[known] *= weight[room[known]]
            out[rest] = lower
        return out


def _discounts(levels: list[DataFrame]) -> list[float]:
    out = []
    for t in levels:
        row = t.agg(*(F.coalesce(F.sum((F.col("n") == i).cast("long")), F.lit(0)) for i in (1, 2))).first()
        out.append(min(0.95, max(0.1, row[0] / (row[0] + 2 * row[1]))) if row[0] else 0.5)
    return out


_CELL = "size long, gram long, " + ", ".join(f"p{s} double" for s in range(SAMPLES)) + ", " + ", ".join(f"w{s} double" for s in range(SAMPLES))


def _subtrees(top: DataFrame, cuts: list[float], bases: list[np.ndarray], order: int, final: bool) -> DataFrame:
    """Samples all subtrees. The last round gives each dish's probabilities and its restaurant's weights; earlier
    rounds give how many tables each dish of two context bytes has (in p0)."""
    names = [c.split()[0] for c in _CELL.split(", ")]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("gram")
        tree = Tree(rows["gram"].to_numpy(), rows["n"].to_numpy(), 3, order)
        rng = np.random.default_rng([int(tree.grams[0][0]) >> 8, int(final)])
        ends = tree.grams[0] & 0xFFFF
        for _ in range(BURN_IN):
            tree.sweep(bases[0][ends], cuts[2:], CONCENTRATION, rng)
        if not final:
            out = pd.DataFrame({"size": 3, "gram": tree.grams[0], "p0": tree.tables[0].astype(float)})
            return out.reindex(columns=names, fill_value=0.0)
        got = []
        for base in bases:
            tree.sweep(base[ends], cuts[2:], CONCENTRATION, rng)
            got.append(tree.predictive(base[ends], cuts[2:], CONCENTRATION))
        parts = []
        for k, grams in enumerate(tree.grams):
            cols = {"size": np.full(len(grams), 3 + k), "gram": grams}
            cols |= {f"p{s}": p[k] for s, (p, _) in enumerate(got)}
            cols |= {f"w{s}": w[k][tree.at[k]] for s, (_, w) in enumerate(got)}
            parts.append(pd.DataFrame(cols))
        return pd.concat(parts)

    return top.groupBy(F.shiftright("gram", 8).bitwiseAND(F.lit(0xFFFF)).alias("subtree")).applyInPandas(run, _CELL)


def train(docs: DataFrame, text_col: str = "text", order: int = ORDER, most: int = ngrams.MAX_GRAMS):
    """(parts, make): sets of last context bytes, and a function that collects the model of one."""
    top = ngrams.count_grams(docs, order, text_col)
    levels = [top]
    for size in range(order - 1, 0, -1):
        kept = levels[0].groupBy(ngrams.shorter(F.col("gram"), size).alias("gram")).agg(F.count(F.lit(1)).alias("n"))
        levels.insert(0, stage(kept, "grams"))
    cuts = _discounts(levels)
    rng = np.random.default_rng(1)
    rows = levels[1].toArrow()  # at most 65,536 pairs of bytes
    pairs, n = rows["gram"].to_numpy(), rows["n"].to_numpy()
    order_by = np.argsort(pairs)
    pairs, n = pairs[order_by], n[order_by]
    for turn in range(ROUNDS):
        final = turn == ROUNDS - 1
        tree = Tree(pairs, n, 1, 2)
        uniform = np.full(len(tree.grams[0]), 1 / 256)
        bases, short = [], []
        for sweep in range(BURN_IN + SAMPLES):
            tree.sweep(uniform, cuts[:2], CONCENTRATION, rng)
            if sweep >= BURN_IN:
                p, w = tree.predictive(uniform, cuts[:2], CONCENTRATION)
                dense = np.zeros(1 << 16)
                dense[tree.grams[1]] = p[1]
                bases.append(dense)
                short.append((p, w))
        cells = stage(_subtrees(top, cuts, bases, order, final), "restaurants")
        if not final:
            rows = cells.groupBy(ngrams.shorter(F.col("gram"), 2).alias("gram")).agg(F.sum("p0").cast("long").alias("n")).toArrow()
            found = dict(zip(rows["gram"].to_pylist(), rows["n"].to_pylist()))
            n = np.array([found[g] for g in pairs.tolist()], np.int64)
    parts = ngrams.parts_of(cells.count(), most)

    def make(part: np.ndarray) -> PitmanYor:
        if not len(pairs):
            return PitmanYor([])
        got = []
        for k in range(2):
            context, first = np.unique(tree.grams[k] >> 8, return_index=True)
            p = np.stack([s[0][k] for s in short], 1).astype(np.float32)
            w = np.stack([s[1][k] for s in short], 1).astype(np.float32)
            got.append((tree.grams[k], p, context, w))
        for size in range(3, order + 1):
            t = cells.where(F.col("size") == size)
            if len(parts) > 1:
                t = t.where(ngrams.last_context(F.col("gram")).isin(part.tolist()))
            rows = t.select("gram", *(F.col(f"p{s}").cast("float") for s in range(SAMPLES))).toArrow()
            grams = rows["gram"].to_numpy()
            by = np.argsort(grams)
            grams, p = grams[by], np.stack([rows[f"p{s}"].to_numpy()[by] for s in range(SAMPLES)], 1)
            room = F.shiftright("gram", 8).alias("room")  # all dishes of a restaurant have its weights
            rows = t.groupBy(room).agg(*(F.first(f"w{s}").cast("float").alias(f"w{s}") for s in range(SAMPLES))).toArrow()
            context = rows["room"].to_numpy()
            by = np.argsort(context)
            got.append((grams, p, context[by], np.stack([rows[f"w{s}"].to_numpy()[by] for s in range(SAMPLES)], 1)))
            del rows, by
            give_back()
        return PitmanYor(got)

    return parts, make


def count_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """word (a 64-bit hash) and n over all texts; counted within tasks first, then staged."""

    def run(batches):
        schema = pa.schema([("word", pa.int64()), ("n", pa.int64())])
        counts: Counter[bytes] = Counter()

        def flush():
            keys = np.fromiter(map(xxhash.xxh64_intdigest, counts), np.uint64, len(counts)).view(np.int64)
            yield batch(schema, [pa.array(keys), list(counts.values())])
            counts.clear()

        for b in slices(batches):
            for text in b.column(0).to_pylist():
                counts.update(words(text))
            if len(counts) > 1_000_000:
                yield from flush()
        yield from flush()

    parts = docs.select(F.col(text_col).alias("text")).mapInArrow(lean(run), "word long, n long")
    return stage(parts.groupBy("word").agg(F.sum("n").alias("n")), "words")


class _WordCounts(dict):
    """Training count of a word of one part; 0 for others."""

    def __init__(self, keys, n):
        self.keys_sorted, self.n = keys, n

    def __missing__(self, word):
        h = np.uint64(xxhash.xxh64_intdigest(word)).view(np.int64)
        at = int(np.searchsorted(self.keys_sorted, h))
        known = at < len(self.keys_sorted) and self.keys_sorted[at] == h
        value = self[word] = float(self.n[at]) if known else 0.0
        return value


#: Words that a worker keeps with their counts before it starts anew.
MAX_WORDS = 300_000

COLUMNS = ["n_tokens", "n_known", "base_score", "score"]


def score(
    docs: DataFrame, id_col="doc_id", text_col="text", train_col="trained", order: int = ORDER, most: int = ngrams.MAX_GRAMS
) -> DataFrame:
    """doc_id, trained, n_tokens, n_known, train_tokens, base_score and score (log10) of every whole text.

    The rows whose boolean train_col is true are learned from.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.col(train_col), F.lit(False)).alias("trained"))
    learned = rows.where("trained").select("text")
    vocabulary = count_words(learned)
    few = [F.coalesce(F.sum((F.col("n") == i).cast("long")), F.lit(0)) for i in (1, 2)]
    facts = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), *few).first()
    ends = learned.count()
    total, distinct = facts[0] + ends, facts[1] + (ends > 0)
    below = total + 0.5 * (distinct + 1)
    cut = min(0.95, max(0.1, facts[2] / (facts[2] + 2 * facts[3]))) if facts[2] else 0.5
    # of the word restaurant: the chance of a new table that serves a given dish
    fresh = (CONCENTRATION + cut * distinct) / (CONCENTRATION + total) / (distinct + 1)
    parts, make = train(learned, "text", order, most)
    n = max(len(parts), min(256, -(-facts[1] // most)))
    if n > len(parts):
        parts = [np.arange(k, 256, n) for k in range(n)]

    def sender(part):
        model, index = make(part), int(part[0])
        got = vocabulary if n == 1 else vocabulary.where(F.pmod(F.col("word"), F.lit(n)) == index)
        got = got.toArrow()
        keys = got["word"].to_numpy()
        by = np.argsort(keys)
        spark = rows.sparkSession.sparkContext
        sent, listed = spark.broadcast(model), spark.broadcast((keys[by], got["n"].to_numpy()[by]))
        del model, got, keys, by
        give_back()
        mine = np.zeros(256, bool)
        mine[part] = True
        held = {}

        def run(texts):
            """For each text, the log10 of its tokens' spellings, then their training counts."""
            if "counts" not in held or len(held["counts"]) > MAX_WORDS:
                held["counts"] = _WordCounts(*listed.value)
            get, end = held["counts"].__getitem__, float(ends) if index == 0 else 0.0
            streams = [ngrams.stream(t) for t in texts]
            grams, edges = ngrams.gram_keys(streams, order)
            if n == 1:
                logs = sent.value.log10(grams)
            else:
                own, logs = mine[(grams >> 8) & 255], np.zeros(len(grams), np.float32)
                logs[own] = sent.value.log10(grams[own])
            upto = np.concatenate([[0.0], np.cumsum(logs, dtype=float)])
            sign = grams & 255
            closes = np.flatnonzero((sign == 32) | (sign == 10)) + 1
            spelled = np.diff(upto[np.concatenate([[0], closes])])
            cuts = np.searchsorted(closes, edges, side="right").tolist()
            return [
                np.concatenate([spelled[a:b], np.fromiter((*map(get, s.split()), end), float, b - a)])
                for s, a, b in zip(streams, cuts, cuts[1:])
            ]

        return run

    def finish(texts, sums):
        columns = [[], [], [], []]
        for x in sums:
            spelled, counts = x.reshape(2, -1)
            known = counts > 0
            seen = np.where(known, counts - cut, 0.0) / (CONCENTRATION + total)
            logs = np.log10(0.5 * (seen + fresh + 10**spelled)) if distinct else spelled
            for column, value in zip(columns, (len(counts), known.sum(), np.log10((counts + 0.5) / below).sum(), logs.sum()), strict=True):
                column.append(float(value))
        return columns

    done = ngrams.folded(rows, parts, sender, finish, COLUMNS).drop("text")
    whole = {c: F.col(c).cast("long") for c in ("n_tokens", "n_known")}
    return done.withColumns(whole).withColumn("train_tokens", F.lit(total).cast("long"))
