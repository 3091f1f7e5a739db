"""Helpers shared by the training-data operators: staged tables, hashing splits."""

from __future__ import annotations

import contextlib
import ctypes
import json
import sys
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder for staged tables: ``spark.checkpoint.dir``, else one of our own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/staged"
    return root.rstrip("/")


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Lineage ends there, so a lost executor costs a read rather than a recomputation,
    later stages prune columns, and the planner knows the table's true size.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._staged_path = path  # noqa: SLF001  for unstage()
    return back


def unstage(*tables: DataFrame) -> None:
    """Delete staged tables that nothing lazy reads any more."""
    for df in tables:
        path = getattr(df, "_staged_path", None)  # also None for None
        if path:
            jvm = df.sparkSession._jvm  # noqa: SLF001
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)  # noqa: SLF001


def broadcast_if_small(df: DataFrame, rows: int, row_bytes: int, limit: int = 64 << 20) -> DataFrame:
    """Broadcast ``df`` when its counted rows keep it under ``limit`` bytes, else leave it to a shuffle join."""
    return F.broadcast(df) if rows * row_bytes <= limit else df


def id_remainder(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null ids give null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def rows_of(batch: pa.RecordBatch, step: int = 256) -> Iterator[tuple]:
    """The rows of an Arrow batch as tuples, made a few at a time so that a batch of long texts is never held twice."""
    for at in range(0, batch.num_rows, step):
        yield from zip(*(c.to_pylist() for c in batch.slice(at, step).columns))


#: Rows of an Arrow batch at most where texts go to Python workers; Spark's own 10,000 rows of texts take hundreds of MB in each task.
TEXT_ROWS = 1_000


def text_batches(df: DataFrame, rows: int = TEXT_ROWS) -> DataFrame:
    """``df``, with the session's Arrow batches held to ``rows`` rows (a smaller setting stays)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(key)) <= rows:
        df.sparkSession.conf.set(key, rows)
    return df


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], tokenizes: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for a worker process that other operators have used and will use: word tables of the tokenizer go before
    it unless it ``tokenizes``, and memory that it has freed goes back to the system after it."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = sys.modules.get("matchloom.llm.bpe")
        if tokenizer is not None and not tokenizes:
            tokenizer.model.cache_clear()
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
            ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def smallest_hashes(df: DataFrame, order: list[str], most: int) -> DataFrame:
    """The ``most`` rows of ``df`` that come first by ``order``, whose first column is a 64-bit hash.

    Rows are counted, and only those below a bound that leaves about twice as many as wanted are ordered, so that
    tasks need not each send ``most`` rows.
    """
    n = df.count()
    if n > 4 * most:
        bound = -(2**63) + 2**64 * 2 * most // n
        few = df.where(F.col(order[0]) < F.lit(bound))
        if few.count() >= most:
            df = few
    return df.orderBy(*order).limit(most)


def constant(value: object, kind: str) -> Column:
    """A nested literal; the optimizer reads it once."""
    return F.from_json(F.lit(json.dumps({"v": value})), f"struct<v:{kind}>")["v"]


def hashed(values: dict[str, object], kind: str, buckets: int) -> Column:
    """A literal hash table for :func:`found`."""
    rows: list[list[dict]] = [[] for _ in range(buckets)]
    for g, v in values.items():
        h = xxhash.xxh64_intdigest(g.encode("utf-8", "surrogatepass"), seed=42)  # as Spark's xxhash64
        rows[(h - (1 << 64) * (h >> 63)) % buckets].append({"g": g, "v": v})
    return constant(rows, f"array<array<struct<g:string,v:{kind}>>>")


def found(known: Column, key: Column, buckets: int) -> Column:
    """What a :func:`hashed` table of so many buckets holds for ``key``, or null."""
    bucket = F.get(known, F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    return F.get(F.filter(bucket, lambda s: s["g"] == key), F.lit(0))["v"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
