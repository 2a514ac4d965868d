"""Context-triggered piecewise hashes of texts, and their likeness.

A rolling hash over the last seven bytes of the UTF-8 text ends a chunk
wherever its low bits are all ones; a block size of 2^k asks for k bits, so the
ends at twice the block size are among those at the block size. Each chunk
gives one of 64 signs (its CRC-32). The block size is the largest power of two,
from MIN_BLOCK to about a 64th of the text, that gives LEAST signs or more; a
fingerprint is ``block:signs:signs at twice the block``. Chunks beyond MOST signs, which only
periodic texts have, are hashed into the last sign. The whole text counts.

Two fingerprints can be compared at equal or neighbouring block sizes, by the
signatures of the common block size. Likeness is 1 for equal fingerprints.
Otherwise it is one minus the edit distance (insertions and deletions) over
both lengths, and 0 if the signatures share no run of signs as long as chance
would not give.

`next_text_likeness` compares each document with an edited form of its text
and with the next document, in descending doc_id order (after the last: the
first). Texts are dealt once into ranges of doc_id; the one document that a
range needs from its neighbour is sent along, so no task sees more than two
texts at a time.

Defined results: a null text is empty; the empty text has the fingerprint
``2::``, is like itself (1) and unlike any other (0). A null doc_id comes last
in descending order. Rows with one doc_id follow each other in the order of
their texts. A table of one row is its own next document. Extra columns are not
read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import batch, lean, partition_keys, range_count, range_cuts, slices

WINDOW = 7
MIN_BLOCK = 2
LEAST, MOST = 48, 256
SIGNS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_SIGN_BYTES = np.frombuffer(SIGNS.encode(), np.uint8)


def rolling(data: np.ndarray) -> np.ndarray:
    """A mixed hash of the last WINDOW bytes at every position."""
    h = np.zeros(len(data), np.uint32)
    for back in range(WINDOW - 1, -1, -1):
        h *= np.uint32(0x01000193)
        if back:
            h[back:] += data[:-back] + np.uint32(1)
        else:
            h += data + np.uint32(1)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    return h


def signature(raw: bytes, ends: np.ndarray) -> str:
    """A sign for each chunk; what follows the last end is a chunk too."""
    cuts = ends.tolist()
    if len(cuts) >= MOST:
        cuts = cuts[: MOST - 1]
    if not cuts or cuts[-1] < len(raw):
        cuts.append(len(raw))
    start, out, crc = 0, bytearray(), zlib.crc32
    for end in cuts:
        out.append(crc(raw[start:end]) & 63)
        start = end
    return _SIGN_BYTES[np.frombuffer(out, np.uint8)].tobytes().decode()


def fingerprint(text: str | None) -> str:
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return f"{MIN_BLOCK}::"
    h = rolling(np.frombuffer(raw, np.uint8).astype(np.uint32))
    ends = np.flatnonzero((h & np.uint32(MIN_BLOCK - 1)) == MIN_BLOCK - 1)
    block, values, most = MIN_BLOCK, h[ends], max(MIN_BLOCK, 1 << (len(raw) // 64).bit_length())
    while True:
        mask = np.uint32(2 * block - 1)
        keep = (values & mask) == mask
        if block >= most or int(keep.sum()) < LEAST:
            break
        block, ends, values = 2 * block, ends[keep], values[keep]
    return f"{block}:{signature(raw, ends + 1)}:{signature(raw, ends[keep] + 1)}"


def _common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit for each sign of a."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _share_run(a: str, b: str) -> bool:
    n = min(7, max(2, min(len(a), len(b)) // 4))
    if min(len(a), len(b)) < n:
        return a == b
    runs = {a[i : i + n] for i in range(len(a) - n + 1)}
    return any(b[i : i + n] in runs for i in range(len(b) - n + 1))


def _signature_likeness(a: str, b: str) -> float:
    if not a or not b or not _share_run(a, b):
        return 0.0
    return 2 * _common_subsequence(a, b) / (len(a) + len(b))


def likeness(one: str, two: str) -> float:
    """From 0 to 1; 0 too when the block sizes are not compatible."""
    if one == two:
        return 1.0
    (block1, a1, a2), (block2, b1, b2) = one.split(":"), two.split(":")
    block1, block2 = int(block1), int(block2)
    if block1 == block2:
        return max(_signature_likeness(a1, b1), _signature_likeness(a2, b2))
    if block1 == 2 * block2:
        return _signature_likeness(a1, b2)
    if block2 == 2 * block1:
        return _signature_likeness(a2, b1)
    return 0.0


def edited(text: str, following: str) -> str:
    """The last third replaced by as many signs from the start of the next text, or all it has."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


SCHEMA = (
    "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)
_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited", pa.string()), ("fingerprint", pa.string()),
     ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
)


def fingerprints(docs: DataFrame, text_col: str = "text", out_col: str = "fingerprint") -> DataFrame:
    """docs with the fingerprint of a text column."""

    @F.pandas_udf("string")
    def run(texts):
        return texts.map(fingerprint)

    return docs.withColumn(out_col, run(F.col(text_col)))


def next_text_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text, of its edited form, and their likeness; see the module's docstring."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    cuts = np.array(sorted(set(range_cuts(docs, range_count(docs)))), np.int64)
    low = -(1 << 63)

    # ranges in descending order: 0 holds the largest ids; null ids go to the last range, after all others
    def range_of(ids: np.ndarray) -> np.ndarray:
        return len(cuts) - np.searchsorted(cuts, ids, side="right")

    def tops(batches):  # largest id of each range, and whether it has rows
        schema = pa.schema([("r", pa.int64()), ("top", pa.int64()), ("known", pa.bool_())])
        for b in batches:
            ids = b.column(0)
            known = np.array(ids.is_valid())
            r = range_of(np.array(ids.fill_null(low)))
            if len(r):
                for x in np.unique(r):
                    some = known & (r == x)
                    top = int(np.array(ids.fill_null(low))[some].max()) if some.any() else low
                    yield batch(schema, [[int(x)], [top], [bool(some.any())]])

    heads = (
        docs.select("doc_id").mapInArrow(tops, "r long, top long, known boolean")
        .groupBy("r").agg(F.max("top").alias("top"), F.max("known").alias("known")).collect()
    )  # one row a range
    order = sorted((row["r"], row["top"] if row["known"] else None) for row in heads)
    # the head of a range is sent to the range before it as well; the first range's to the last
    before = {r: (order[i - 1][0], top) for i, (r, top) in enumerate(order)}
    # a task for each range
    task = dict(zip((r for r, _ in order), partition_keys(spark, max(1, len(order)))))

    def deal(batches):
        tool = zstandard.ZstdCompressor(level=1)
        schema = pa.schema([("task", pa.int64()), ("r", pa.int64()), ("tail", pa.int32()), ("doc_id", pa.int64()), ("z", pa.binary())])
        for b in slices(batches):
            ids = b.column(0).to_pylist()
            ranges = range_of(np.array(b.column(0).fill_null(low))).tolist()
            rows = []
            for i, r, t in zip(ids, ranges, b.column(1).to_pylist(), strict=True):
                z = tool.compress((t or "").encode("utf-8", "surrogatepass"))
                rows.append((task[r], r, 0, i, z))
                to, top = before[r]
                if i == top:
                    rows.append((task[to], to, 1, i, z))
            yield batch(schema, list(zip(*rows, strict=True)))

    def run(batches):
        unzip = zstandard.ZstdDecompressor()
        held, done = None, []

        def close(following):
            name, text, mark = held
            other, other_mark = following
            new = edited(text, other)
            new_mark = mark if new == text else fingerprint(new)
            done.append((name, len(text), new, mark, new_mark, likeness(mark, new_mark), likeness(mark, other_mark)))

        current, tail_seen = None, False
        for b in slices(batches, most_rows=500):
            for r, tail, name, z in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if r != current:
                    if held is not None:
                        raise AssertionError("a range without its tail")
                    current, tail_seen = r, False
                if tail and tail_seen:
                    continue
                text = unzip.decompress(z).decode("utf-8", "surrogatepass")
                mark = fingerprint(text)
                if held is not None:
                    close((text, mark))
                tail_seen = bool(tail)
                held = None if tail else (name, text, mark)
            if done:
                yield batch(_ARROW, list(zip(*done, strict=True)))
                done = []

    rows = docs.mapInArrow(lean(deal), "task long, r long, tail int, doc_id long, z binary")
    order_by = ["r", "tail", F.col("doc_id").desc_nulls_last(), "z"]
    dealt = rows.repartition(max(1, len(order)), "task").sortWithinPartitions(*order_by)
    return dealt.drop("task").mapInArrow(lean(run), SCHEMA)
