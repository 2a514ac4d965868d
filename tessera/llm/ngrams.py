"""Byte n-grams of word streams: what both language models count and look up.

A text is read as a stream: its words [^\\x20\\x09-\\x0D]+ (A-Z lower-cased, in
UTF-8), each followed by a space, and a line feed as its end. Neither sign can
be part of a word, so the probability of a stream is that of the words and the
end. Before a stream, contexts are filled with line feeds. An n-gram of up to
seven bytes is one integer: the oldest byte highest, the predicted byte lowest;
dropping the oldest byte gives the gram of the shorter context.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, DoubleType, StructField, StructType

from tessera.llm.common import batch, lean, slices, stage, words

#: Grams that one model part may hold on the driver and in a worker (about 30 bytes each).
MAX_GRAMS = 12_000_000


def stream(text: str | None) -> bytes:
    found = words(text)
    return b" ".join(found) + b" \n" if found else b"\n"


def gram_keys(streams: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Grams of `order` bytes that end at each byte of the streams, and where each stream's begin."""
    pad = b"\n" * (order - 1)
    sizes = np.fromiter(map(len, streams), np.int64, len(streams))
    blob = np.frombuffer(pad + pad.join(streams), np.uint8) if streams else np.zeros(0, np.uint8)
    n = len(blob)
    keys = blob.astype(np.int64)
    for back in range(1, order):
        keys[back:] |= blob[: n - back].astype(np.int64) << (8 * back)
    edges = np.concatenate([[0], np.cumsum(sizes)])
    wanted = np.ones(n, bool)
    for back in range(order - 1):
        wanted[edges[:-1] + np.arange(len(sizes)) * (order - 1) + back] = False
    return keys[wanted], edges


def count_grams(docs: DataFrame, order: int, text_col: str = "text") -> DataFrame:
    """gram, n: how often each gram of `order` bytes occurs; counted within tasks first, then staged."""

    def run(batches):
        schema = pa.schema([("gram", pa.int64()), ("n", pa.int64())])
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64)]

        def merge(keys, n):
            every, at = np.unique(np.concatenate([held[0], keys]), return_inverse=True)
            total = np.zeros(len(every), np.int64)
            total[at[: len(held[0])]] = held[1]
            total[at[len(held[0]) :]] += n
            held[:] = every, total

        for b in slices(batches, most_rows=2000, most_bytes=4 << 20):
            keys, _ = gram_keys([stream(t) for t in b.column(0).to_pylist()], order)
            merge(*np.unique(keys, return_counts=True))
            if len(held[0]) > 2_000_000:
                yield batch(schema, [pa.array(x) for x in held])
                held[:] = np.zeros(0, np.int64), np.zeros(0, np.int64)
        yield batch(schema, [pa.array(x) for x in held])

    parts = docs.select(F.col(text_col).alias("text")).mapInArrow(lean(run), "gram long, n long")
    return stage(parts.groupBy("gram").agg(F.sum("n").alias("n")), "grams")


def shorter(gram: Column, order: int) -> Column:
    """The gram of `order` bytes at the end of a longer one."""
    return gram.bitwiseAND(F.lit((1 << (8 * order)) - 1))


def last_context(gram: Column) -> Column:
    """The byte right before the predicted one; all longer contexts of a position share it."""
    return F.shiftright(gram, 8).bitwiseAND(F.lit(255))


def parts_of(total: int, most: int = MAX_GRAMS) -> list[np.ndarray]:
    """Sets of last context bytes, so that a model part for each holds about `most` grams or fewer."""
    n = min(256, max(1, -(-total // most)))
    return [np.arange(k, 256, n) for k in range(n)]


def folded(docs: DataFrame, parts: list, make, finish, columns: list[str]) -> DataFrame:
    """docs (text and others) with columns worked out from sums over all model parts.

    make(part) builds and sends one part and returns a function from texts to an
    array of floats for each; the arrays of all parts are added, and
    finish(texts, sums) gives the columns. One part needs one pass over docs;
    models beyond the bound of a part take a staged pass for each.
    """
    at = docs.columns.index("text")
    for i, part in enumerate(parts):
        first, last = i == 0, i == len(parts) - 1
        fields = [StructField(c, DoubleType()) for c in columns] if last else [StructField("_sums", BinaryType())]
        wanted = StructType([*(f for f in docs.schema.fields if f.name != "_sums"), *fields])

        def run(batches, add=make(part), first=first, last=last, schema=to_arrow_schema(wanted)):
            for b in slices(batches, most_rows=1000, most_bytes=2 << 20):
                texts, kept = b.column(at).to_pylist(), b.columns
                got = add(texts)
                if not first:
                    got = [x + np.frombuffer(y) for x, y in zip(got, kept[-1].to_pylist(), strict=True)]
                    kept = kept[:-1]
                yield batch(schema, [*kept, *(finish(texts, got) if last else [[x.tobytes() for x in got]])])

        docs = docs.mapInArrow(lean(run), wanted)
        if not last:
            docs = stage(docs, "folded")
    return docs
