"""Near duplicates by MinHash, with sequential Bayesian verification.

A document's set is its distinct shingles of SHINGLE words (words
[^\\x20\\x09-\\x0D]+, A-Z lower-cased); fewer words are one shingle. Equal sets
are found by a digest and represented by their smallest doc_id. Signatures of
BANDS x ROWS minima are banded; documents that share a band are candidates.

Candidates are verified batch by batch: after m compared minima with k equal,
the similarity has a Beta(k + 1, m - k + 1) posterior under a uniform prior, and
a pair is pruned as soon as its chance to reach the threshold falls below
MISS. Survivors are verified exactly on the full sets.

Only components are asked for, so pairs already known to be connected need no
check. In each band, rounds of hubs come first: the member with most band mates
is verified against the members that are not yet in its component, and
components are joined. What still shares a band across components after ROUNDS
rounds is compared in blocks, without a cap: members of a band are dealt to
pairs of blocks, tested by signatures, verified within the task, and joined
there, so that few links leave it. The last joining of components follows. Hub
and block groups are salted, and what is known of a hot band, hub or set is
broadcast (see `_spread`), so no task meets one whole; texts travel compressed,
and only those that share a band.

The miss rate of the bands for a pair at the threshold is (1 - 0.8^6)^32, about
6e-5; the posterior bound adds about MISS.

Defined results: a null, empty or wordless text has an empty set and is linked
with nothing. Rows with a null doc_id are not linked either, have no component
and are kept. Documents whose sets have the same smallest doc_id count as one
node, so rows that repeat a doc_id with other words join its component. Each
input row gives a row. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Kept, batch, lean, slices, stage, words
from tessera.llm.components import components

SHINGLE, THRESHOLD = 5, 80
BANDS, ROWS = 32, 6
STEP = 32  # minima compared at a time
MISS = 1e-6
ROUNDS = 2
#: Members of a hub or of a band that one task compares at a time.
BLOCK = 500
#: A key with over a HOT_KEYS-th of all rows is hot, so there are fewer hot keys than this.
HOT_KEYS = 1000
#: Bytes of words that a worker keeps with their hashes, and as many from before.
MAX_WORDS = 24 << 20

_SIZE = BANDS * ROWS
_FACTORS = np.random.default_rng(7).integers(0, 1 << 31, _SIZE, np.int64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_OFFSETS = np.random.default_rng(8).integers(0, 1 << 32, _SIZE, np.int64).astype(np.uint32)
_P = np.uint64(0x9E3779B97F4A7C15)


_hashes = Kept(xxhash.xxh64_intdigest, MAX_WORDS)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: list[str | None], size: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles."""
    found = [words(t) for t in texts]
    edges = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(int)
    flat = np.fromiter((h for f in found for h in map(_hashes.__getitem__, f)), np.uint64, int(edges[-1]))
    rolled = flat.copy()
    for k in range(1, size):
        rolled[:-k or None] = rolled[:-k or None] * _P + flat[k:] if k < len(flat) else rolled[:-k or None]
    rolled = _mix(rolled)
    out = []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(rolled[a : b - size + 1]))
        elif b > a:  # the whole sequence as one, apart from all longer shingles
            raw = b"\0".join(found[len(out)])
            out.append(np.array([xxhash.xxh64_intdigest(raw, seed=b - a)], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minima of _SIZE hash functions; empty sets have all ones."""
    out = np.full((len(sets), _SIZE), 0xFFFFFFFF, np.uint32)
    full = [i for i, s in enumerate(sets) if len(s)]
    at = 0
    while at < len(full):
        end, n = at, 0
        while end < len(full) and (n == 0 or n + len(sets[full[end]]) <= 50_000):
            n += len(sets[full[end]])
            end += 1
        some = full[at:end]
        x = (np.concatenate([sets[i] for i in some]) >> np.uint64(17)).astype(np.uint32)
        starts = np.concatenate([[0], np.cumsum([len(sets[i]) for i in some])[:-1]]).astype(int)
        made = np.empty((len(some), _SIZE), np.uint32)
        for k in range(_SIZE):
            made[:, k] = np.minimum.reduceat(x * _FACTORS[k] + _OFFSETS[k], starts)
        out[some] = made
        at = end
    return out


def band_keys(sigs: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band of each signature."""
    parts = sigs.reshape(len(sigs), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(sigs), BANDS)).copy()
    for r in range(ROWS):
        key = key * _P + parts[:, :, r]
        key ^= key >> np.uint64(29)
    return _mix(key).view(np.int64)


def least_matches(threshold: int, miss: float) -> list[int]:
    """For each step, the fewest equal minima with which a pair is not pruned.

    The posterior chance to reach the threshold t after k of m is that of at
    most k successes in m + 1 trials with chance t.
    """
    t, out = threshold / 100, []
    for m in range(STEP, _SIZE + 1, STEP):
        below, k = 0.0, -1
        while below < miss:
            k += 1
            below += math.comb(m + 1, k) * t**k * (1 - t) ** (m + 1 - k)
        out.append(k)
    return out


def sequential(left: np.ndarray, right: np.ndarray, least: list[int]) -> np.ndarray:
    """Which pairs of signature rows survive all steps."""
    alive = np.arange(len(left))
    equal = np.zeros(len(left), np.int64)
    for step, fewest in enumerate(least):
        cut = slice(step * STEP, (step + 1) * STEP)
        equal[alive] += (left[alive, cut] == right[alive, cut]).sum(1)
        alive = alive[equal[alive] >= fewest]
        if not len(alive):
            break
    mask = np.zeros(len(left), bool)
    mask[alive] = True
    return mask


def linked(a: np.ndarray, b: np.ndarray, threshold: int) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= threshold * (len(a) + len(b) - shared) and shared > 0


def _spread(rows: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """rows joined with the facts of their key, one row a key, in whose column n is how many rows have it.

    Hot keys' facts are broadcast, fewer than HOT_KEYS rows; the others' are
    joined by a shuffle in which no key has more than a HOT_KEYS-th of the rows.
    """
    total = facts.agg(F.sum("n")).first()[0] or 0
    hot = facts.where(F.col("n") * HOT_KEYS > total)
    met = rows.join(F.broadcast(hot), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return met.unionByName(rest.join(facts.where(F.col("n") * HOT_KEYS <= total), key)).drop("n")


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set, band keys; narrow, staged."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches):
        for b in slices(batches):
            sets = shingle_sets(b.column(1).to_pylist(), size)
            keys = band_keys(signatures(sets))
            edges = pa.array(np.arange(0, BANDS * len(sets) + 1, BANDS, dtype=np.int32))
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            yield batch(schema, [b.column(0), [len(s) for s in sets], digests, pa.ListArray.from_arrays(edges, pa.array(keys.reshape(-1)))])

    return stage(docs.mapInArrow(lean(run), "doc_id long, n_shingles long, digest binary, bands array<long>"), "shingle-sets")


def _signed_texts(docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """node, signature and compressed text of the documents that are nodes."""
    narrow = pa.schema([("doc_id", pa.int64()), ("z", pa.binary())])

    def squeeze(batches):
        tool = zstandard.ZstdCompressor(level=1)
        for b in slices(batches):
            yield batch(narrow, [b.column(0), [tool.compress((t or "").encode("utf-8", "surrogatepass")) for t in b.column(1).to_pylist()]])

    def sign(batches):
        unzip = zstandard.ZstdDecompressor()
        schema = pa.schema([("node", pa.int64()), ("sig", pa.binary()), ("z", pa.binary())])
        for b in slices(batches, most_bytes=4 << 20):
            z = b.column(1).to_pylist()
            sets = shingle_sets([unzip.decompress(x).decode("utf-8", "surrogatepass") for x in z], size)
            yield batch(schema, [b.column(0), [s.tobytes() for s in signatures(sets)], z])

    small = docs.where("doc_id is not null").mapInArrow(lean(squeeze), "doc_id long, z binary")
    met = small.join(nodes.select(F.col("node").alias("doc_id")), "doc_id")
    return stage(met.mapInArrow(lean(sign), "node long, sig binary, z binary"), "signed-texts")


def _verified(pairs: DataFrame, signed: DataFrame, size: int, threshold: int, least: list[int]) -> DataFrame:
    """The pairs (hub, node) that are links: sequential test of signatures, then full sets.

    A hub's rows are dealt to as many salts as it has blocks of members, and
    stream by in order behind the hub's own row, so only the hub is held.
    """
    salts = F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("salts")
    counts = stage(pairs.groupBy("hub").agg(F.count(F.lit(1)).alias("n"), salts), "hub-sizes")
    members = _spread(pairs, counts, "hub").select(
        "hub", F.pmod(F.xxhash64("node"), "salts").cast("int").alias("salt"), F.lit(1).alias("kind"), "node"
    )
    hubs = counts.select("hub", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), F.col("hub").alias("node"))
    rows = members.union(hubs).join(signed, "node").select("hub", "salt", "kind", "node", "sig", "z")
    rows = rows.repartition("hub", "salt").sortWithinPartitions("hub", "salt", "kind", "node")
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches):
        unzip = zstandard.ZstdDecompressor()

        def set_of(z):
            return shingle_sets([unzip.decompress(z).decode("utf-8", "surrogatepass")], size)[0]

        current, own = None, []  # own: [signature, compressed text, set when needed] of the hub's rows
        for b in slices(batches, most_rows=500):
            cols = [c.to_pylist() for c in b.columns]
            lefts, rights, who = [], [], []
            for i, (hub, salt, kind, _, sig, z) in enumerate(zip(*cols, strict=True)):
                if (hub, salt) != current:
                    current, own = (hub, salt), []
                if kind == 0:
                    own.append([np.frombuffer(sig, np.uint32), z, None])
                else:
                    for entry in own:
                        lefts.append(entry[0])
                        rights.append(np.frombuffer(sig, np.uint32))
                        who.append((entry, i))
            if not who:
                continue
            out = []
            for at in np.flatnonzero(sequential(np.stack(lefts), np.stack(rights), least)).tolist():
                entry, i = who[at]
                if entry[2] is None:
                    entry[2] = set_of(entry[1])
                if linked(entry[2], set_of(cols[5][i]), threshold):
                    out.append((cols[0][i], cols[3][i]))
            if out:
                yield batch(schema, list(zip(*out, strict=True)))

    return stage(rows.mapInArrow(lean(run), "u long, v long"), "links")


class _Sets:
    """Shingle sets of a group's members, made when needed; at most HELD of their hashes are kept."""

    HELD = 4_000_000

    def __init__(self, z: list[bytes], size: int):
        self.z, self.size, self.made, self.held = z, size, {}, 0
        self.unzip = zstandard.ZstdDecompressor()

    def __getitem__(self, i: int) -> np.ndarray:
        got = self.made.get(i)
        if got is None:
            if self.held > self.HELD:
                self.made.clear()
                self.held = 0
            text = self.unzip.decompress(self.z[i]).decode("utf-8", "surrogatepass")
            got = self.made[i] = shingle_sets([text], self.size)[0]
            self.held += len(got)
        return got


def _block_links(mates: DataFrame, signed: DataFrame, size: int, threshold: int, least: list[int]) -> DataFrame:
    """Links between different components that share a band, verified on full sets within the task.

    A pair is looked at in the first band that it shares, and not at all once
    its two components are joined within the task, so a task emits fewer links
    than it has members.
    """
    blocks = F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")
    sizes = stage(mates.groupBy("band").agg(F.count(F.lit(1)).alias("n"), blocks), "band-sizes")
    dealt = _spread(mates, sizes, "band").withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    dealt = dealt.select("band", "node", "component", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    keys = (F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    rows = dealt.select("band", *keys, "own", "node", "component").join(signed, "node")
    rows = rows.select("band", "low", "high", "own", "node", "component", "sig", "z")
    rows = rows.repartition("band", "low", "high").sortWithinPartitions("band", "low", "high", "node")
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def compare(group):
        band, low, high = group[0][:3]
        own = np.array([g[3] for g in group])
        node, comp = [g[4] for g in group], np.array([g[5] for g in group])
        sigs, sets = np.stack([np.frombuffer(g[6], np.uint32) for g in group]), _Sets([g[7] for g in group], size)
        keys = band_keys(sigs)
        here = int(np.flatnonzero(keys[0] == band)[0])  # rows of a key have it in the same band
        right = np.flatnonzero(own == high)
        found = []
        for i in np.flatnonzero(own == low).tolist():
            some = right[right > i] if low == high else right
            some = some[(comp[some] != comp[i]) & ~(keys[some, :here] == keys[i, :here]).any(1)]
            if not len(some):
                continue
            alive = some[sequential(np.broadcast_to(sigs[i], (len(some), _SIZE)), sigs[some], least)]
            for j in alive.tolist():
                if comp[j] != comp[i] and linked(sets[i], sets[j], threshold):
                    found.append((node[i], node[j]))
                    comp[comp == comp[j]] = comp[i]
        return found

    def run(batches):
        group = []
        for b in slices(batches, most_rows=500):
            out = []
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if group and row[:3] != group[0][:3]:
                    out += compare(group) if len(group) > 1 else []
                    group = []
                group.append(row)
            if out:
                yield batch(schema, list(zip(*out, strict=True)))
        if len(group) > 1 and (out := compare(group)):
            yield batch(schema, list(zip(*out, strict=True)))

    return stage(rows.mapInArrow(lean(run), "u long, v long"), "links")


def _labelled(mates: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Band members with their components, of bands that still hold several."""
    if labels is None:
        found = mates.withColumn("component", F.col("node"))
    else:
        named = mates.drop("component").join(labels, "node", "left")
        found = named.withColumn("component", F.coalesce("component", "node"))
    least, most = F.min("component").alias("a"), F.max("component").alias("b")
    mixed = found.groupBy("band").agg(least, most, F.count(F.lit(1)).alias("n")).where("a < b").select("band", "n")
    return stage(_spread(found, stage(mixed, "mixed-bands"), "band"), "band-mates")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    threshold: int = THRESHOLD,
    miss: float = MISS,
    rounds: int = ROUNDS,
) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row; see the module's docstring."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    least = least_matches(threshold, miss)
    found = _sets(docs, shingle)
    named = found.where("doc_id is not null and n_shingles > 0")
    nodes = named.groupBy("digest").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("n"))
    nodes = stage(nodes, "nodes")

    # a set's bands are those of any of its rows: the representative's are taken
    own = named.select(F.col("doc_id").alias("node"), "digest", "bands").join(nodes, ["digest", "node"], "left_semi")
    bands = stage(own.select("node", F.explode("bands").alias("band")).distinct(), "bands")
    shared = stage(bands.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared-bands")
    shared = shared.withColumn("size", F.col("n"))
    mates = stage(_spread(bands, shared, "band"), "band-mates")
    if mates.isEmpty():
        return _result(found, nodes, None)
    signed = _signed_texts(docs, mates.select("node").distinct(), shingle)
    weight = mates.groupBy("node").agg(F.sum("size").alias("weight"))
    mates = stage(mates.join(weight, "node").select("band", "node", "weight"), "band-mates")

    labels, links, used = None, None, None
    for _ in range(rounds):
        mates = _labelled(mates, labels)
        free = mates if used is None else mates.join(used, ["band", "node"], "left_anti")
        best = F.max(F.struct("weight", (-F.col("node")).alias("node"))).alias("best")
        hubs = free.groupBy("band").agg(best, F.count(F.lit(1)).alias("n"))
        hubs = hubs.select("band", (-F.col("best.node")).alias("hub"), "n")
        home = mates.select("band", F.col("node").alias("hub"), F.col("component").alias("home"))
        hubs = stage(hubs.join(home, ["band", "hub"]), "hubs")
        pairs = _spread(mates, hubs, "band").where("component <> home").select("hub", "node").distinct()
        pairs = stage(pairs, "hub-pairs")
        if pairs.isEmpty():
            break
        new = _verified(pairs, signed, shingle, threshold, least)
        links = new if links is None else links.union(new)
        if not new.isEmpty():
            labels = stage(components(links), "labels")
        turn = hubs.select("band", F.col("hub").alias("node"))
        used = turn if used is None else used.union(turn)
    rest = _labelled(mates, labels)
    rest = rest if used is None else stage(rest.join(used, ["band", "node"], "left_anti"), "band-mates")
    new = _block_links(rest, signed, shingle, threshold, least)
    if not new.isEmpty():
        links = new if links is None else links.union(new)
        labels = stage(components(links), "labels")
    return _result(found, nodes, labels)


def _result(found: DataFrame, nodes: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is not None:
        named = nodes.join(labels, "node", "left").select("digest", "n", F.coalesce("component", "node").alias("node"))
        nodes = stage(named, "nodes")
    found, alone = found.drop("bands"), (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    met = _spread(found.where(~alone), nodes, "digest").select("doc_id", "n_shingles", F.col("node").alias("component_id"))
    rest = found.where(alone).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return met.union(rest).select("*", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
