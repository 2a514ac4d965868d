"""Token ids in binary files, coded by a canonical length-limited Huffman code.

Writing: documents are dealt into ranges of ascending doc_id, tokenized once,
and staged as chunks of whole documents with a bounded number of tokens. Counts
of ids over all chunks (at most a row for each id of the vocabulary) give code
lengths by package-merge, limited to MAX_BITS; codes are canonical, so lengths
alone define them. Each chunk becomes a file of its own, in range order.

A file (all integers little-endian):

    8 bytes   magic "TIDHUF01"
    5 x u64   documents, tokens, tokens a block, blocks, vocabulary size
    u8 each   code length of every id of the vocabulary (0: not used)
    i64, u8   doc_id and whether it is null, for every document
    u64 each  tokens of every document
    u64 each  checkpoints: first bit of every block, and the end
    bytes     the codes, most significant bit first, padded with three bytes

Reading: blocks are independent. A table indexed by the next MAX_BITS bits
gives an id and its length; all blocks of a file are decoded side by side, one
symbol each in a step.

A file is committed by its row in a manifest, which Spark's own committer
writes; files of lost or repeated tasks have other names and are never read.

Defined results: a null or empty text is the end id alone. A null doc_id comes
before all others. Rows with the same doc_id follow each other in the order of
a hash of their texts, equal texts side by side; each row is a document. So an id
that very many rows share is dealt over several ranges. An empty table gives no
files and no rows.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import vocab
from tessera.llm.common import batch, drop_path, lean, partition_keys, range_count, range_cuts, scratch_path, slices, stage

MAGIC = b"TIDHUF01"
MAX_BITS = 16
BLOCK_TOKENS = 1024
CHUNK_TOKENS = 2 << 20


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most `limit` bits (package-merge); 0 for ids that do not occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids need more than {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    n, is_leaf, row = len(leaves), [], np.empty(0, np.int64)
    for _ in range(limit):
        packages = row[: len(row) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaves, packages])
        at = np.argsort(both, kind="stable")
        row = both[at]
        is_leaf.append(at < n)
    take, depth = 2 * n - 2, np.zeros(n, np.int64)
    for level in reversed(is_leaf):
        leaf = int(level[:take].sum())  # the chosen leaves of a level are its smallest
        depth[:leaf] += 1
        take = 2 * (take - leaf)
    lengths[order] = depth
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in the order of (length, id)."""
    codes = np.zeros(len(lengths), np.uint32)
    code, before = 0, 0
    for n in range(1, int(lengths.max(initial=0)) + 1):
        code <<= n - before
        before = n
        at = np.flatnonzero(lengths == n)
        codes[at] = code + np.arange(len(at), dtype=np.uint32)
        code += len(at)
    return codes


def decoding_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Id and code length for every value of the next MAX_BITS bits."""
    ids, sizes = np.zeros(1 << MAX_BITS, np.uint32), np.ones(1 << MAX_BITS, np.uint8)
    used = np.flatnonzero(lengths)
    used = used[np.argsort(lengths[used], kind="stable")]
    spans = np.left_shift(1, MAX_BITS - lengths[used].astype(np.int64))
    filled = int(spans.sum())
    ids[:filled], sizes[:filled] = np.repeat(used, spans), np.repeat(lengths[used], spans)
    return ids, sizes


def encode_bits(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray, block: int) -> tuple[bytes, np.ndarray]:
    """The codes' bits, and the first bit of every block with the end."""
    out, points, at = [], [0], 0
    carry = np.zeros(0, np.uint8)
    for start in range(0, len(ids), block * 256):
        some = ids[start : start + block * 256]
        n = lengths[some].astype(np.int64)
        first = np.concatenate([[0], np.cumsum(n)])
        points += (at + first[block::block]).tolist() if len(some) > block else []
        if (len(points) - 1) * block < start + len(some):
            points.append(at + int(first[-1]))
        points[-1] = min(points[-1], at + int(first[-1]))
        size, shift = int(first[-1]), at & 7
        where = first[:-1] + shift
        # a code and its place in a byte span 24 bits at most: three sums of disjoint bits
        word = codes[some].astype(np.int64) << (24 - n - (where & 7))
        byte, room = where >> 3, (shift + size + 7) // 8 + 3
        packed = sum(
            np.bincount(byte + k, weights=(word >> (16 - 8 * k)) & 255, minlength=room)[:room] for k in range(3)
        ).astype(np.uint8)
        if len(carry):
            packed[0] |= carry[0]
        whole = (shift + size) // 8
        out.append(packed[:whole].tobytes())
        carry = packed[whole : whole + 1] if (shift + size) & 7 else carry[:0]
        at += size
    out.append(carry.tobytes() + b"\0\0\0")
    return b"".join(out), np.array(points, "<u8")


def decode_bits(raw: bytes, points: np.ndarray, tokens: int, block: int, lengths: np.ndarray) -> np.ndarray:
    """All ids; each step takes the next id of every block."""
    table, sizes = decoding_table(lengths)
    data = np.frombuffer(raw, np.uint8).astype(np.uint32)
    blocks = len(points) - 1
    out = np.zeros((block, max(blocks, 1)), np.uint32)
    at = points[:-1].astype(np.int64)
    last = tokens - (blocks - 1) * block if blocks else 0
    for step in range(min(block, tokens)):
        live = at if step < last else at[: blocks - 1]
        byte = live >> 3
        window = data[byte] << 16 | data[byte + 1] << 8 | data[byte + 2]
        peek = (window >> (8 - (live & 7)).astype(np.uint32)) & ((1 << MAX_BITS) - 1)
        out[step, : len(live)] = table[peek]
        live += sizes[peek]
    return out.T.reshape(-1)[:tokens]


def _file_bytes(doc_ids, doc_tokens, ids, codes, lengths, block) -> bytes:
    bits, points = encode_bits(ids, codes, lengths, block)
    head = np.array([len(doc_ids), len(ids), block, len(points) - 1, len(lengths)], "<u8").tobytes()
    names = np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes()
    missing = np.array([d is None for d in doc_ids], np.uint8).tobytes()
    sizes = np.array(doc_tokens, "<u8").tobytes()
    return b"".join([MAGIC, head, lengths.tobytes(), names, missing, sizes, points.tobytes(), bits])


def read_file(raw: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """doc_id values, tokens of each document, and all ids."""
    if raw[:8] != MAGIC:
        raise ValueError("not a token file")
    docs, tokens, block, blocks, size = np.frombuffer(raw, "<u8", 5, 8).tolist()
    at = 48

    def take(kind, n):
        nonlocal at
        got = np.frombuffer(raw, kind, n, at)
        at += got.nbytes
        return got

    lengths, names, missing = take(np.uint8, size), take("<i8", docs), take(np.uint8, docs)
    sizes, points = take("<u8", docs), take("<u8", blocks + 1)
    ids = decode_bits(raw[at:], points, tokens, block, lengths)
    return [None if m else d for d, m in zip(names.tolist(), missing.tolist(), strict=True)], sizes.astype(np.int64), ids


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


#: Ranges of the rows without an id, which are dealt by a hash of their texts.
NULL_PARTS = 64

_CHUNK = "part long, seq long, docs array<long>, sizes array<long>, ids binary"
_CHUNK_ARROW = pa.schema(
    [("part", pa.int64()), ("seq", pa.int64()), ("docs", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("ids", pa.binary())]
)


def tokenize_ranges(
    docs: DataFrame, tokenizer_path: str, id_col: str, text_col: str, end_id: int, chunk_tokens: int
) -> DataFrame:
    """Chunks (part, seq) of whole documents in ascending doc_id; ids as compressed unsigned integers."""

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n = range_count(picked)
    cuts = np.array(range_cuts(picked, n), np.int64)
    keys = np.array(partition_keys(docs.sparkSession, n))

    def squeeze(batches):
        tool = zstandard.ZstdCompressor(level=1)
        schema = pa.schema([("task", pa.int64()), ("part", pa.int64()), ("doc_id", pa.int64()), ("hash", pa.int64()), ("z", pa.binary())])
        for b in slices(batches):
            ids, raw = b.column(0), [(t or "").encode("utf-8", "surrogatepass") for t in b.column(1).to_pylist()]
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, raw), np.uint64, len(raw))
            part = place(np.array(ids.fill_null(0)), np.array(ids.is_valid()), hashes, cuts)
            cols = [pa.array(keys[part % n]), pa.array(part), ids, pa.array(hashes.view(np.int64)), [tool.compress(x) for x in raw]]
            yield batch(schema, cols)

    def run(batches):
        part, seq = None, 0
        encoder = vocab.encoder(vocab.WordEndEncoder, tokenizer_path)
        unzip, tool = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
        end = int(end_id).to_bytes(4, "little")
        names, sizes, held = [], [], []

        def chunk():
            ids = np.frombuffer(b"".join(held), "<u4")
            kind = b"\x02" if ids.max() < 1 << 16 else b"\x04"
            body = ids.astype("<u2").tobytes() if kind == b"\x02" else ids.tobytes()
            return batch(_CHUNK_ARROW, [[part], [seq], [names], [sizes], [kind + tool.compress(body)]])

        total = 0
        for b in slices(batches, most_rows=1000, most_bytes=2 << 20):  # compressed
            texts = [unzip.decompress(z).decode("utf-8", "surrogatepass") for z in b.column(2).to_pylist()]
            for own, name, got in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), encoder.encode(texts), strict=True):
                if own != part:
                    if names:
                        yield chunk()
                        names, sizes, held = [], [], []
                    part, seq, total = own, 0, 0
                names.append(name)
                held.append(got + end)
                sizes.append(len(got) // 4 + 1)
                total += sizes[-1]
                if total >= chunk_tokens:
                    yield chunk()
                    seq, total = seq + 1, 0
                    names, sizes, held = [], [], []
        if names:
            yield chunk()

    shuffled = picked.mapInArrow(lean(squeeze), "task long, part long, doc_id long, hash long, z binary")
    dealt = shuffled.repartition(n, "task").sortWithinPartitions("part", "doc_id", "hash", "z")
    return dealt.select("part", "doc_id", "z").mapInArrow(lean(run), _CHUNK)


def place(ids: np.ndarray, known: np.ndarray, hashes: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Range of each row, in the order of (id, hash); rows without an id come first, in ranges of negative numbers."""
    low, high = np.searchsorted(cuts, ids, side="left"), np.searchsorted(cuts, ids, side="right")
    top = (hashes >> np.uint64(32)).astype(np.int64) ^ (1 << 31)  # in the order of the hash as a signed number
    several = high - low > 1  # one id fills all ranges in between: its rows go by their hash
    part = np.where(several, low + 1 + ((top * (high - low)) >> 32), high)
    return np.where(known, part, ((top * NULL_PARTS) >> 32) - NULL_PARTS)


def chunk_ids(raw: bytes) -> np.ndarray:
    body = zstandard.ZstdDecompressor().decompress(raw[1:])
    return np.frombuffer(body, "<u2" if raw[0] == 2 else "<u4")


def count_ids(chunks: DataFrame, vocab_size: int) -> np.ndarray:
    """How often each id occurs in all chunks; a row for each id of the vocabulary at most."""

    def run(batches):
        total = np.zeros(vocab_size, np.int64)
        for b in batches:
            for raw in b.column(0).to_pylist():
                total += np.bincount(chunk_ids(raw), minlength=vocab_size)
        at = np.flatnonzero(total)
        yield batch(pa.schema([("id", pa.int64()), ("n", pa.int64())]), [pa.array(at), pa.array(total[at])])

    rows = chunks.select("ids").mapInArrow(lean(run), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(vocab_size, np.int64)
    for row in rows:
        counts[row["id"]] = row["n"]
    return counts


def write_token_files(
    docs: DataFrame,
    path: str,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 1,
    chunk_tokens: int = CHUNK_TOKENS,
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """Writes the files under `path`; gives the manifest: part, seq, file, documents, tokens, start."""
    spark = docs.sparkSession
    staged = scratch_path(spark, "token-chunks")
    chunks = stage(tokenize_ranges(docs, tokenizer_path, id_col, text_col, end_id, chunk_tokens), "token-chunks", staged)
    known = max(vocab.encoder(vocab.WordEndEncoder, tokenizer_path).ids.values()) + 1
    counts = count_ids(chunks, max(known, end_id + 1))
    sent = spark.sparkContext.broadcast(code_lengths(counts))
    out = pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("file", pa.string()), ("documents", pa.int64()), ("tokens", pa.int64())])

    def run(batches):
        files, root = _filesystem(path)
        files.create_dir(root)
        lengths = sent.value
        codes = canonical_codes(lengths)
        for b in batches:
            for row in b.to_pylist():
                ids = chunk_ids(row["ids"])
                raw = _file_bytes(row["docs"], row["sizes"], ids, codes, lengths, block_tokens)
                name = f"ids-{row['part']:06d}-{row['seq']:06d}-{uuid.uuid4().hex}.tid"
                with files.open_output_stream(f"{root}/{name}") as f:
                    f.write(raw)
                yield batch(out, [[row["part"]], [row["seq"]], [name], [len(row["docs"])], [len(ids)]])

    manifest = chunks.mapInArrow(lean(run), "part long, seq long, file string, documents long, tokens long")
    manifest = stage(manifest, "token-manifest", f"{path}/_manifest")
    drop_path(spark, staged)
    # tokens of the ranges before: a row a range, of which there are as many as the driver gave out
    per = sorted((r["part"], r["n"]) for r in manifest.groupBy("part").agg(F.sum("tokens").alias("n")).collect())
    bases = np.cumsum([0, *(n for _, n in per)]).tolist()
    before = spark.createDataFrame([(p, b) for (p, _), b in zip(per, bases)], "part long, base long")
    order = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    within = manifest.withColumn("start", F.coalesce(F.sum("tokens").over(order), F.lit(0)))
    return within.join(before, "part").withColumn("start", F.col("start") + F.col("base")).drop("base")


def read_token_files(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it) and ids (little-endian unsigned 32-bit) from the files."""
    out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        files, root = _filesystem(path)
        for b in batches:
            for name, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with files.open_input_stream(f"{root}/{name}") as f:
                    names, sizes, ids = read_file(f.read())
                edges = np.concatenate([[0], np.cumsum(sizes)])
                raw = ids.astype("<u4").tobytes()
                for at in range(0, len(names), 2000):
                    cut = edges[at : at + 2001].tolist()
                    cols = [names[at : at + 2000], [base + x for x in cut[:-1]], [raw[4 * x : 4 * y] for x, y in zip(cut, cut[1:])]]
                    yield batch(out, cols)

    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), manifest.count() // 4)
    listed = manifest.select("file", "start").repartition(n)  # one by one, where a hash puts several files in a task
    return listed.mapInArrow(lean(run), "doc_id long, start long, ids binary")


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = 1, **options) -> DataFrame:
    """Writes all documents to files in the shared folder and reads them back."""
    path = scratch_path(docs.sparkSession, "token-files")
    manifest = write_token_files(docs, path, tokenizer_path, end_id=end_id, **options)
    return read_token_files(docs.sparkSession, path, manifest)
