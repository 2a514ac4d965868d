"""What the training-data operators share: scratch tables, words, Arrow helpers."""

from __future__ import annotations

import atexit
import ctypes
import functools
import gc
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_own: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    A local master without that setting gets a temporary folder of its own,
    removed when the interpreter ends; any other master without it is an error,
    because a machine-local folder would be invisible to other executors.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, _own["dir"], ignore_errors=True)
    return "file://" + _own["dir"]


_scratch: dict[str, SparkSession] = {}


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new folder for intermediate tables; it goes when the driver ends, or before with drop_path."""
    if not _scratch:
        atexit.register(drop_all)
    path = f"{scratch_root(spark)}/{tag}-{uuid.uuid4().hex}"
    _scratch[path] = spark
    return path


def drop_all() -> None:
    """Removes all scratch folders of this driver; their tables can't be read afterwards."""
    for path, spark in list(_scratch.items()):
        try:
            drop_path(spark, path)
        except Exception:  # the JVM has gone already
            return


def small_batches(spark: SparkSession) -> None:
    """Rows with texts are long: batches of 1,000 rows keep the buffers of the JVM and of Python workers small.

    This is a setting of the session; a value other than Spark's default stays.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, "1000")


def stage(df: DataFrame, tag: str, path: str | None = None) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back.

    This cuts the lineage without tying it to an executor's disk: a lost
    executor costs only the tasks that it ran.
    """
    path = path or scratch_path(df.sparkSession, tag)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Removes a scratch folder through Spark's own file system layer."""
    _scratch.pop(path, None)
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def give_back() -> None:
    """Hands free memory of this process to the system: Python's, Arrow's and the C library's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def lean(run):
    """run (batches to batches) that gives memory back when its rows end; workers are reused by later tasks."""

    @functools.wraps(run)
    def inner(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return inner


class Kept(dict):
    """Values worked out when first asked for, within a bound of bytes: keys, values and about 150 bytes an entry.

    Beyond the bound the entries become the generation before, which is asked
    before a value is worked out anew.
    """

    def __init__(self, make, most_bytes: int):
        super().__init__()
        self.make, self.most, self.held, self.older = make, most_bytes, 0, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        size = len(key) + 150 + (len(value) if hasattr(value, "__len__") else 0)
        if self.held + size > self.most:
            self.older = dict(self) if size <= self.most else {}
            self.clear()
            self.held = 0
            if size > self.most:  # one that would fill the cache alone is not kept
                return value
        self.held += size
        self[key] = value
        return value


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def words(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ of the text in UTF-8, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def strings(column: pa.Array) -> list[str | None]:
    return column.to_pylist()


def batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def slices(batches, most_rows: int = 2000, most_bytes: int = 4 << 20):
    """Cuts Arrow batches so that a slice holds few rows and few bytes; a longer single row is a slice of its own."""
    for b in batches:
        if b.num_rows == 0:
            continue
        per = max(1, b.nbytes // b.num_rows)
        step = max(1, min(most_rows, most_bytes // per))
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)


#: Bytes of input, as the plan's statistics have them, that a range holds at most on average.
RANGE_BYTES = 64 << 20


def range_count(docs: DataFrame) -> int:
    """How many ranges to deal a table into: more for larger tables, by the size that the planner knows."""
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    known = -(-size // RANGE_BYTES) if size < 1 << 60 else 0  # a size that nobody knows is huge
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(known, 1 << 20))


def range_cuts(docs: DataFrame, n: int) -> list[int]:
    """Lower ends of n ranges of doc_id with about as many rows each; an id with more rows than a range comes several times."""
    if n < 2:
        return []
    at = [i / n for i in range(1, n)]
    return docs.select(F.percentile_approx("doc_id", at, max(10000, 10 * n)).alias("q")).first()["q"] or []


def partition_keys(spark: SparkSession, n: int) -> list[int]:
    """A key for each of n partitions that repartition(n, key) deals there, so that ranges do not meet in one task."""
    home = F.pmod(F.hash("id"), F.lit(n)).alias("home")
    rows = spark.range(0, n * (20 + 2 * n.bit_length()), 1, 1).select("id", home).groupBy("home").agg(F.min("id").alias("id")).collect()
    found = {r["home"]: r["id"] for r in rows}
    return [found.get(i, i) for i in range(n)]
