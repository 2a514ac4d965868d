"""WARC archives: writing with identical-payload revisits, and reading by boundary-chain verification.

Writing. Every page is a record of WARC/1.1 whose payload is its html. Of pages
with equal payloads of at least `min_revisit_bytes` bytes, the one with the
smallest page_id becomes a response, the others revisits that refer to it; only
the digests and ids are aggregated, with partial sums before the shuffle.
Spark's text sink writes the records, with the record separator CR LF CR LF as
its line separator, so its committer guards against lost and repeated tasks.

Reading. The text source with the magic line as line separator splits archives
anywhere into segments: what stands between two magics. Each is a candidate
record, and its header gives the offset of its successor; magic may also stand
inside payloads, so candidates may be false. Tasks emit (offset, successor).
Within a block of a file the chains are followed at once, which gives each
candidate its first successor outside the block. Pointer jumping from the start
of every file over those, doubling the jump each round, finds where the true
chain enters each block, and a last local pass marks the records on it. All
else is rejected. Payloads that held magic are put together from their segments
in a second read, which is left out when there are none.

Defined results: a null html is the empty payload. A null page_id makes a
response that nothing refers to; rows that share the smallest page_id are all
responses. A null url has no target line; control characters and spaces in a
url are percent-coded. An empty table gives no records. Extra columns are not
read. A file whose chain breaks gives the records before the break.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import batch, scratch_path, slices, stage

MAGIC = b"WARC/1.1\r\n"
END = b"\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def digest(payload: bytes) -> str:
    """Base32 of the SHA-1, as WARC payload digests have it."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record without the separator after it."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d" % len(payload) + END
    block = http if refers_to is not None else http + payload
    lines = [
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += [
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return MAGIC + "\r\n".join(lines).encode("utf-8", "surrogatepass") + END + block


def write_archives(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    min_revisit_bytes: int = 0,
) -> None:
    """Writes uncompressed archives under `path`, one for each task."""
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).alias("url"),
        F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"),
    ).withColumn("sha", F.sha1("payload"))
    shared = (
        rows.where(F.length("payload") >= min_revisit_bytes).select("sha", "page_id")
        .groupBy("sha").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    )

    def squeeze(batches):  # the payloads cross the network once, compressed
        tool = zstandard.ZstdCompressor(level=6)
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("sha", pa.string()), ("z", pa.binary())])
        for b in slices(batches):
            yield batch(schema, [*b.columns[:3], [tool.compress(x) for x in b.column(3).to_pylist()]])

    def run(batches):
        schema, unzip = pa.schema([("value", pa.binary())]), zstandard.ZstdDecompressor()
        for b in slices(batches):
            out = []
            for page, url, z, first in zip(*(c.to_pylist() for c in b.columns), strict=True):
                to = first if None not in (page, first) and page != first else None
                out.append(record(page, url, unzip.decompress(z), to))
            yield batch(schema, [out])

    small = rows.select("page_id", "url", "sha", "payload").mapInArrow(squeeze, "page_id long, url string, sha string, z binary")
    joined = small.join(shared, "sha", "left").select("page_id", "url", "z", "first")
    text = joined.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    text.write.option("lineSep", END.decode()).text(path)


def parse(raw: bytes):
    """Fields, where the block starts, and its length, of bytes after a magic; None if that is no header."""
    at = raw.find(END)
    if at < 0:
        return None
    fields = {}
    for line in raw[:at].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields.setdefault(name.strip().lower(), value.strip())
    length = fields.get(b"content-length", b"")
    if not length.isdigit() or b"warc-type" not in fields:
        return None
    return fields, at + len(END), int(length)


def _urn(value: bytes | None) -> int | None:
    found = re.fullmatch(rb"<urn:page:(-?\d+)>", value or b"")
    return int(found[1]) if found else None


def describe(raw: bytes):
    """page_id, payload_bytes, payload_digest, record_type, refers_to of a whole record after its magic.

    Length and digest of a response come from its payload; a revisit has none
    and carries those of the payload that it refers to.
    """
    fields, start, length = parse(raw)
    block = raw[start : start + length]
    kind = fields[b"warc-type"].decode("ascii", "replace")
    head, _, payload = block.partition(END)
    name = _urn(fields.get(b"warc-record-id"))
    if kind == "revisit":
        size = re.search(rb"\r\nContent-Length: (\d+)", head)
        told = fields.get(b"warc-payload-digest", b"").decode("ascii", "replace").removeprefix("sha1:")
        return name, int(size[1]) if size else None, told, kind, _urn(fields.get(b"warc-refers-to"))
    return name, len(payload), digest(payload), kind, None


_FACTS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_SEGMENT = f"file string, block long, idx long, size long, step long, whole boolean, {_FACTS}"
_SEGMENT_ARROW = pa.schema(
    [("file", pa.string()), ("block", pa.int64()), ("idx", pa.int64()), ("size", pa.int64()), ("step", pa.int64()),
     ("whole", pa.bool_()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
     ("record_type", pa.string()), ("refers_to", pa.int64())]
)


def _numbered(batches):
    """(file, block, idx, bytes) of the segments; each block is read in order by one task."""
    at, idx = None, 0
    for b in slices(batches):
        rows = []
        for file, block, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if (file, block) != at:
                at, idx = (file, block), 0
            rows.append((file, block, idx, raw))
            idx += 1
        yield rows


def _segments(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.option("lineSep", MAGIC.decode()).text(path)
    return text.select("_metadata.file_path", "_metadata.file_block_start", F.col("value").cast("binary").alias("raw"))


def _candidates(batches):
    """Segments with the bytes each covers (its magic included) and the step to its successor."""
    for rows in _numbered(batches):
        out = []
        for file, block, idx, raw in rows:
            head = block == 0 and idx == 0  # what stands before the first magic
            size, step, whole, facts = len(raw) + (0 if head else len(MAGIC)), None, False, (None,) * 5
            if not head and (found := parse(raw)):
                step = len(MAGIC) + found[1] + found[2] + len(END)
                # the last segment of a file has the separator too
                whole = step == size
                if whole:
                    facts = describe(raw)
            out.append((file, block, idx, size, step, whole, *facts))
        if out:
            yield batch(_SEGMENT_ARROW, list(zip(*out, strict=True)))


def _exits(rows: pd.DataFrame) -> pd.DataFrame:
    """For a block's segments in order: offset, successor, and the first successor that lies outside."""
    rows = rows.sort_values("idx", ignore_index=True)
    offset = rows["base"] + rows["size"].cumsum() - rows["size"]
    at = {int(o): i for i, o in enumerate(offset) if rows["candidate"][i]}
    end = int(rows["base"][0] + rows["size"].sum())
    exits: list[int | None] = [None] * len(rows)
    nexts: list[int | None] = [None] * len(rows)
    for i in range(len(rows) - 1, -1, -1):
        step = rows["step"][i]
        if pd.isna(step):
            continue
        to = int(offset[i] + step)
        nexts[i] = to
        exits[i] = to if to >= end else exits[at[to]] if to in at else None
    kind = "Int64"
    return pd.DataFrame(
        {"file": rows["file"], "block": rows["block"], "idx": rows["idx"], "pos": offset,
         "next": pd.array(nexts, kind), "exit": pd.array(exits, kind)}
    )


def _marked(rows: pd.DataFrame) -> pd.DataFrame:
    """The rows of a block with `owner`: the record of the true chain that covers them."""
    rows = rows.sort_values("idx", ignore_index=True)
    at = {int(p): i for i, p in enumerate(rows["pos"])}
    owner: list[int | None] = [None] * len(rows)
    entries = rows.index[rows["entry"]].tolist()
    i = entries[0] if entries else None
    while i is not None and not pd.isna(rows["next"][i]):
        start, to = int(rows["pos"][i]), int(rows["next"][i])
        while i < len(rows) and rows["pos"][i] < to:
            owner[i] = start
            i += 1
        i = at.get(to)
    return rows[["file", "block", "idx", "pos"]].assign(owner=pd.array(owner, "Int64"))


def _entries(jumps: DataFrame) -> DataFrame:
    """Offsets where the true chains enter blocks: pointer jumping from the start of every file."""
    reached = jumps.where("pos = 0").select("file", "pos")
    jumps = jumps.where("exit is not null").select("file", "pos", F.col("exit").alias("to"))
    # a jump whose target is no candidate leads nowhere: the file's end, or a broken chain
    known = jumps.select("file", F.col("pos").alias("to")).union(reached.select("file", F.col("pos").alias("to")))
    jumps = stage(jumps.join(known.distinct(), ["file", "to"], "left_semi").select("file", "pos", "to"), "warc-jumps")
    while not jumps.isEmpty():
        landed = reached.join(jumps, ["file", "pos"]).select("file", F.col("to").alias("pos"))
        reached = stage(reached.union(landed).distinct(), "warc-reached")
        further = jumps.select("file", F.col("pos").alias("to"), F.col("to").alias("past"))
        jumps = stage(jumps.join(further, ["file", "to"]).select("file", "pos", F.col("past").alias("to")), "warc-jumps")
    return reached


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every true record."""
    found = stage(_segments(spark, path).mapInArrow(_candidates, _SEGMENT), "warc-segments")
    blocks = found.groupBy("file", "block").agg(F.sum("size").alias("bytes"))
    order = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = blocks.select("file", "block", F.coalesce(F.sum("bytes").over(order), F.lit(0)).alias("base"))
    lone = (F.col("block") == 0) & (F.col("idx") == 0)
    narrow = found.select("file", "block", "idx", "size", "step", (~lone).alias("candidate")).join(base, ["file", "block"])
    kept = "file string, block long, idx long, pos long, next long, exit long"
    jumps = stage(narrow.groupBy("file", "block").applyInPandas(_exits, kept), "warc-exits")
    # the segment before the first magic is empty, and so shares offset 0 with the first record
    entries = _entries(jumps.where("next is not null")).withColumn("entry", F.lit(True))
    placed = jumps.select("file", "block", "idx", "pos", "next").join(entries, ["file", "pos"], "left")
    placed = placed.withColumn("entry", F.coalesce("entry", F.lit(False)) & F.col("next").isNotNull())
    marked = placed.groupBy("file", "block").applyInPandas(
        _marked, "file string, block long, idx long, pos long, owner long"
    )
    marked = stage(marked, "warc-marked")

    facts = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    heads = marked.where("pos = owner").join(found, ["file", "block", "idx"])
    done = heads.where("whole").select(*facts)
    parts = heads.where("not whole").select("file", F.col("pos").alias("first"), (F.col("pos") + F.col("step")).alias("end"))
    if parts.isEmpty():
        return done
    return done.union(_assembled(spark, path, marked, parts).select(*facts))


def _assembled(spark: SparkSession, path: str, marked: DataFrame, parts: DataFrame) -> DataFrame:
    """Records whose payload held magic, from all segments between their ends."""
    order = Window.partitionBy("file").orderBy("pos", "idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    covered = marked.withColumn("first", F.last("owner", ignorenulls=True).over(order)).select("file", "block", "idx", "pos", "first")
    covered = covered.join(parts, ["file", "first"]).where("pos >= first and pos < end").drop("end")

    def raw_rows(batches):
        schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("idx", pa.int64()), ("raw", pa.binary())])
        for rows in _numbered(batches):
            if rows:
                yield batch(schema, list(zip(*rows, strict=True)))

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        return pd.DataFrame([describe(MAGIC.join(rows["raw"]))], columns=[f.split()[0] for f in _FACTS.split(", ")]).astype(
            {"page_id": "Int64", "payload_bytes": "Int64", "refers_to": "Int64"}
        )

    again = _segments(spark, path).mapInArrow(raw_rows, "file string, block long, idx long, raw binary")
    return again.join(covered, ["file", "block", "idx"]).groupBy("file", "first").applyInPandas(join, _FACTS)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Writes all pages to archives in the shared folder and reads the records back."""
    path = scratch_path(pages.sparkSession, "warc")
    write_archives(pages, path, **options)
    return read_archives(pages.sparkSession, path)
