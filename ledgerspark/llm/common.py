"""Shared pieces of the corpus operators: word rules, shared storage, row handling."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

#: A word: a run of code points other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
WORD_RE = re.compile(WORD)


def words_of(text: str | None) -> list[str]:
    """The words of a text.

    str.split() also splits at other Unicode spaces; it is right exactly if
    nothing but the six characters went missing, which is quick to see.
    """
    if not text:
        return []
    words = text.split()
    if len("".join(words)) + sum(map(text.count, SPACES)) == len(text):
        return words
    return WORD_RE.findall(text)


def lower_ascii(text: str) -> str:
    """Lower-case A-Z only, leaving every other code point alone."""
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a local default only on one machine where none is named."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = f"file://{tempfile.gettempdir()}/checkpoints"
    return found.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet to the shared folder and return it read back.

    This cuts the lineage in a form that outlives lost executors, and makes
    row numbers given upstream stable for every later read. The folder goes
    when forget() is told so, at the latest when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    found = spark.read.schema(df.schema).parquet(path)
    found._shared_path = path
    return found


def delete_folder(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def forget(*tables: DataFrame | None) -> None:
    """Delete the folders of materialized tables that no later plan reads."""
    for df in tables:
        if path := getattr(df, "_shared_path", None):
            delete_folder(df.sparkSession, path)


def fold(column: str, modulus: int):
    """crc32 of the id as text, modulo: the fold rule of the contracts. A null id hashes as ''."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def pieces(batch: pa.RecordBatch, rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most `rows` rows and about `size` bytes of text each (one row may be longer)."""
    if batch.num_rows <= 1 or (batch.num_rows <= rows and batch.nbytes <= size):
        yield batch
        return
    length = np.full(batch.num_rows, 8)
    for c in batch.columns:
        if pa.types.is_string(c.type) or pa.types.is_binary(c.type):
            length += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at = np.cumsum(length), 0
    while at < batch.num_rows:
        most = ends[at - 1] + size if at else size
        n = max(1, min(rows, int(np.searchsorted(ends, most, "right")) - at))
        yield batch.slice(at, n)
        at += n


def trim() -> None:
    """Give memory that a task no longer needs back: a Python worker lives on and serves later tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # no glibc
        pass


def map_arrow(df: DataFrame, fn, schema, rows: int = 1000, size: int = 4 << 20) -> DataFrame:
    """mapInArrow with batches bounded by rows and bytes, whatever the session's own batch size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(p for b in batches for p in pieces(b, rows, size))
        finally:
            trim()

    return df.mapInArrow(run, schema)


def drawn(df: DataFrame, total: int, want: int, *columns: str) -> DataFrame:
    """About `want` rows (at most so many) of the `total` rows of df, by hash of the columns.

    The share that can be among them is filtered first, so that no task gathers
    `want` rows from every partition.
    """
    h = F.xxhash64(F.lit(97), *columns)
    share = min(1.0, (want + 10 * want**0.5 + 10) / max(total, 1))
    return df.where(F.pmod(h, F.lit(1 << 31)) <= F.lit(int(share * (1 << 31)))).orderBy(h, *columns).limit(want)
