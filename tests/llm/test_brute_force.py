"""Slow twins, written from the docstrings, of what SQL can't express."""

import itertools
import math
import random
import zlib

import numpy as np

from tessera.llm import fuzzy_hash, kneser_ney, packing, pitman_yor, toxicity

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def rolled(raw, i):
    h = 0
    for k in range(6, -1, -1):
        h = h * 0x01000193 & 0xFFFFFFFF
        if i >= k:
            h = h + raw[i - k] + 1 & 0xFFFFFFFF
    h = (h ^ h >> 15) * 0x85EBCA6B & 0xFFFFFFFF
    return h ^ h >> 13


def slow_fingerprint(text):
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return "2::"
    hashes = [rolled(raw, i) for i in range(len(raw))]

    def ends(block):
        return [i + 1 for i, h in enumerate(hashes) if h % block == block - 1]

    def signs(block):
        cuts = ends(block)
        if len(cuts) >= 256:  # the rest is hashed into the last sign
            cuts = cuts[:255]
        cuts = sorted({*cuts, len(raw)})
        return "".join(ALPHABET[zlib.crc32(raw[a:b]) % 64] for a, b in zip([0, *cuts], cuts))

    most = 2
    while most <= len(raw) // 64:
        most *= 2
    block = max([2, *(b for b in (2**k for k in range(2, 30)) if b <= most and len(ends(b)) >= 48)])
    return f"{block}:{signs(block)}:{signs(2 * block)}"


def test_fingerprints():
    rnd = random.Random(2)
    texts = [None, "", "a", "ab" * 2000, " " * 700, "\ud800x", "The " * 900]
    texts += ["".join(rnd.choice("abcdefghij é\n") for _ in range(n)) for n in (1, 7, 50, 63, 64, 65, 129, 500, 3000, 12000)]
    for text in texts:
        assert fuzzy_hash.fingerprint(text) == slow_fingerprint(text)


def slow_assign(lengths, sequence):
    pieces, tails, made = [], [], 0
    for item, n in enumerate(lengths):
        for k in range(n // sequence):
            pieces.append((item, k * sequence, sequence, made, 0))
            made += 1
        if n % sequence:
            tails.append([item, n // sequence * sequence, n % sequence])
    total = sum(t[2] for t in tails)
    rooms = [sequence] * (total // sequence)
    rooms += [2**b for b in range(sequence.bit_length(), -1, -1) if total % sequence & 2**b]
    filled = [[] for _ in rooms]
    for item, start, n in sorted(tails, key=lambda t: (-t[2], t[0])):
        while n:
            free = [r - sum(f) for r, f in zip(rooms, filled)]
            cost = [sum(packing.LINEAR * k + packing.QUADRATIC * k * k for k in f) for f in filled]
            fits = [i for i, x in enumerate(free) if x >= n] or [i for i, x in enumerate(free) if x > 0]
            at = min(fits, key=lambda i: (cost[i], i))
            part = min(n, free[at])
            pieces.append((item, start, part, made + at, sum(filled[at])))
            filled[at].append(part)
            start, n = start + part, n - part
    return pieces, made + len(rooms)


def test_lowest_cost_rule():
    rnd = random.Random(6)
    for sequence in (16, 64):
        for _ in range(60):
            lengths = [rnd.choice([0, 1, 3, sequence, sequence + 1, rnd.randint(1, 4 * sequence)]) for _ in range(rnd.randint(0, 40))]
            assert packing.assign(lengths, sequence) == slow_assign(lengths, sequence)


def slow_toxicity(model, text):
    words = [w.lower() for w in toxicity.TOKEN.findall(text or "")]
    if not words:
        return 0.0, [], []
    emit = [sum(float(model.weights[s]) for s in toxicity.features([w.encode("latin-1")])[0]) for w in words]
    on, total = [0.0] * len(words), 0.0
    for states in itertools.product((0, 1), repeat=len(words)):
        e = model.start[states[0]] + sum(x for x, s in zip(emit, states) if s)
        weight = math.exp(e + sum(model.trans[a][b] for a, b in zip(states, states[1:])))
        total += weight
        on = [x + weight * s for x, s in zip(on, states)]
    on = [x / total for x in on]
    top = [min(max(p, 1e-4), 1 - 1e-4) for p in sorted([*on, 0, 0, 0], reverse=True)[:3]]
    z = model.logistic[0] + sum(t * math.log(p / (1 - p)) for t, p in zip(model.logistic[1:4], top))
    z += model.logistic[4] * math.log(1 + sum(on))
    return 1 / (1 + math.exp(-z)), on, [i for i, p in enumerate(on) if p >= 0.5]


def test_toxicity_given_weights(spark):
    rng, rnd = np.random.default_rng(5), random.Random(5)
    model = toxicity.ToxicityModel()
    model.weights = np.append(rng.normal(scale=0.7, size=toxicity.WEIGHTS), 0).astype(np.float32)
    model.trans, model.start, model.logistic = rng.normal(size=(2, 2)), rng.normal(size=2), rng.normal(size=5)
    vocabulary = ["one", "Two", "süß", "longer", "words", "x", "Überall"]
    texts = [" ".join(rnd.choice(vocabulary) + rnd.choice(["", ",", " 12"]) for _ in range(n)) for n in range(12)] + [None, "42 %"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    for i, text in enumerate(texts):
        want, on, marked = slow_toxicity(model, text)
        assert abs(got[i].score - want) < 1e-6
        places = [m.span() for m in toxicity.TOKEN.finditer(text or "")]
        inside = [k for k, (a, b) in enumerate(places) if any(s.start <= a and b <= s.end for s in got[i].spans)]
        assert inside == marked


def test_bands_and_verdicts(spark):
    rnd = random.Random(9)
    plain = ["".join(rnd.choice("aeionrst") for _ in range(rnd.randint(2, 7))) for _ in range(150)]
    rows = []
    for i in range(260):
        lang = rnd.choice(["en", "en", "de", None]) if i else "alone"
        words = plain[: rnd.choice([30, 150])]
        if i % 40 == 3:
            words = ["".join(rnd.choice("qxzjkvw0123456789#%*") for _ in range(rnd.randint(2, 9))) for _ in range(900)]
        rows.append((i, " ".join(rnd.choice(words) for _ in range(rnd.choice([5, 30, 200, 600]))), lang))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    scored = kneser_ney.measure(docs, *kneser_ney.train(docs)).collect()
    step = {r.doc_id: math.floor(1000 * -r.logp / r.signs + 0.5) for r in scored}
    failed = {r.doc_id: r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words for r in scored}

    def edges(ids):
        found = sorted(step[i] for i in ids if not failed[i])
        at = [found[math.ceil(q * len(found)) - 1] for q in (0.25, 0.75)]
        return [*at, max(at[1] - at[0], 10)]

    every, langs, kept = edges(step), {}, 0
    for lang in {r[2] for r in rows}:
        own = [i for i, _, x in rows if x == lang and not failed[i]]
        n = len(own)
        mixed = [(n * a + 100 * b) / (n + 100) for a, b in zip(edges(own), every)] if own else every
        langs[lang] = mixed
    got = {r.doc_id: r for r in kneser_ney.judge(docs).collect()}
    for r in scored:
        low, high, wide = langs[r.lang]
        wide *= math.sqrt(1 + 800 / r.signs)
        want = not failed[r.doc_id] and low - 4 * wide <= step[r.doc_id] <= high + 2.5 * wide
        assert got[r.doc_id].kept == want and got[r.doc_id].base_failed == failed[r.doc_id]
        kept += want
    assert 100 < kept < sum(not x for x in failed.values())


def test_pitman_yor_scores(spark):
    rnd = random.Random(3)
    vocabulary = ["".join(rnd.choice("abcé") for _ in range(rnd.randint(1, 5))) for _ in range(40)]
    rows = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(0, 30))), i % 3 > 0) for i in range(60)]
    rows += [(100, None, False), (101, "never seen", False)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, trained boolean")
    learned = docs.where("trained").select("text")
    parts, make = pitman_yor.train(learned, order=4)
    assert len(parts) == 1
    levels = [
        (dict(zip(g.tolist(), p.tolist())), dict(zip(c.tolist(), w.tolist()))) for g, p, c, w in make(parts[0]).levels
    ]

    def chance(gram, s):  # gram: bytes, the last one predicted
        if not gram:
            return 1 / 256
        dishes, rooms = levels[len(gram) - 1]
        if (own := dishes.get(int.from_bytes(gram, "big"))) is not None:
            return own[s]
        weight = rooms.get(int.from_bytes(gram[:-1], "big"))
        return (weight[s] if weight else 1.0) * chance(gram[1:], s)

    def tokens(text):
        return [*(w + b" " for w in (text or "").lower().encode().split()), b"\n"] if (text or "").split() else [b"\n"]

    counts = {}
    for _, text, trained in rows:
        for t in tokens(text) if trained else []:
            counts[t] = counts.get(t, 0) + 1
    total, distinct = sum(counts.values()), len(counts)
    once, twice = (sum(n == k and t != b"\n" for t, n in counts.items()) for k in (1, 2))
    cut = min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5
    got = {r.doc_id: r for r in pitman_yor.score(docs, order=4).collect()}
    for i, text, _ in rows:
        before, want = b"\n" * 3, 0.0
        for t in tokens(text):
            spelled = 0.0
            for byte in t:
                gram = before + bytes([byte])
                spelled += math.log10(sum(chance(gram, s) for s in range(pitman_yor.SAMPLES)) / pitman_yor.SAMPLES)
                before = gram[1:]
            own = max(counts.get(t, 0) - cut, 0) / (1 + total) + (1 + cut * distinct) / (1 + total) / (distinct + 1)
            want += math.log10((own + 10**spelled) / 2)
        assert abs(got[i].score - want) < 1e-4 * max(1, abs(want))
