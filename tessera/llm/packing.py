"""Cost-balanced packing of token ids into fixed-length sequences.

Each document is its token ids and an end id. Full-length pieces become
sequences of their own. What is left of the documents is packed by the cost
model ``linear * n + quadratic * n * n`` (tokens, and attention among a piece's
tokens): in descending length each piece goes to the lowest-cost sequence that
still has room for it; a piece that fits nowhere is cut at the room of the
lowest-cost sequence and its rest goes on. A group's sequences have exactly the
group's tokens as room: as many full sequences as fit, and powers of two for
the remainder, so that padding to the full length or a power of two adds
nothing.

Documents are packed in groups of a bounded number of tokens, each within the
task that tokenized it: no shuffle, memory bounded by the group and the longest
document, and a lost executor only repeats its own tasks. Sequence ids hold the
partition number in their upper half and are not consecutive.

Defined results: a null or empty text is the end id alone. Null or repeated
doc_id values are carried along; each row is a document. Only the id and the
text column are read, so other columns do not matter. No rows give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import vocab
from tessera.llm.common import batch, lean, slices

SEQUENCE = 1024
#: Tokens that are packed together in one task.
GROUP_TOKENS = 4 << 20
LINEAR, QUADRATIC = 1.0, 1.0 / 1024

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
     ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
)


def rooms(tokens: int, sequence: int) -> list[int]:
    """Room of each sequence for so many tokens: full ones, then powers of two."""
    full, rest = divmod(tokens, sequence)
    return [sequence] * full + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def assign(lengths: list[int], sequence: int, linear: float = LINEAR, quadratic: float = QUADRATIC):
    """Pieces (item, start, length, sequence, offset) that cover every token of the items once.

    Items are shorter than a sequence or are cut first: each full-length piece
    fills a sequence alone.
    """
    pieces, tails, made = [], [], 0
    for item, n in enumerate(lengths):
        for start in range(0, n - n % sequence, sequence):
            pieces.append((item, start, sequence, made, 0))
            made += 1
        if n % sequence:
            tails.append((-(n % sequence), item, n - n % sequence))
    tails.sort()
    room = np.array(rooms(-sum(t[0] for t in tails), sequence), np.int64)
    used, cost = np.zeros(len(room), np.int64), np.zeros(len(room))
    for n, item, start in tails:
        n = -n
        while n:
            left = room - used
            open_to = left >= n
            if not open_to.any():
                open_to = left > 0
            at = int(np.where(open_to, cost, np.inf).argmin())
            part = min(n, int(left[at]))
            pieces.append((item, start, part, made + at, int(used[at])))
            used[at] += part
            cost[at] += linear * part + quadratic * part * part
            start, n = start + part, n - part
    return pieces, made + len(room)


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 0,
    sequence: int = SEQUENCE,
    group_tokens: int = GROUP_TOKENS,
) -> DataFrame:
    """One row per piece: its ids (little-endian unsigned 32-bit) and its place in a sequence."""
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        made = TaskContext.get().partitionId() << 32
        encoder = vocab.encoder(vocab.ByteLevelEncoder, tokenizer_path)
        names, ids, held = [], [], 0

        def flush():
            nonlocal made
            pieces, n = assign([len(x) // 4 for x in ids], sequence)
            cols = list(zip(*pieces, strict=True))
            items = cols[0]
            yield batch(_ARROW, [
                [names[i] for i in items], cols[1], cols[2],
                [ids[i][4 * s : 4 * (s + k)] for i, s, k in zip(items, cols[1], cols[2])],
                [len(ids[i]) // 4 for i in items], [made + q for q in cols[3]], cols[4],
            ])
            made += n
            names.clear()
            ids.clear()

        for b in slices(batches):
            for name, got in zip(b.column(0).to_pylist(), encoder.encode(b.column(1).to_pylist()), strict=True):
                names.append(name)
                ids.append(got + end)
                held += len(ids[-1]) // 4
                if held >= group_tokens:
                    yield from flush()
                    held = 0
        if names:
            yield from flush()

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(lean(run), SCHEMA)
