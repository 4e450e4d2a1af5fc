"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Used where a local session names no shared folder, as in tests.
LOCAL_CHECKPOINTS = "/tmp/checkpoints/textkiln"
#: Python works through Arrow batches in slices of about this many bytes of text.
SLICE_BYTES = 4 << 20
EMPTY_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session may leave it unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = LOCAL_CHECKPOINTS
    return path.rstrip("/")


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path for an intermediate table in the shared folder; what is left there goes when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    fs, p = _hadoop(spark, path)
    fs.mkdirs(p)  # only what exists can be marked
    fs.deleteOnExit(p)
    return path


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _hadoop(spark, path)
    fs.delete(p, True)


def folders(spark: SparkSession, path: str) -> list[str]:
    """The names of the folders in a folder, sorted; none where it does not exist."""
    fs, p = _hadoop(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(p) if x.isDirectory()) if fs.exists(p) else []


def write_table(df: DataFrame, path: str) -> DataFrame:
    """Write df to path and read it back: cuts the lineage at files that outlive any executor."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialise(df: DataFrame, name: str) -> DataFrame:
    path = work_path(df.sparkSession, name)
    out = write_table(df, path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing reads any more."""
    for t in tables:
        remove(t.sparkSession, t.scratch_path)


def schema_with(df: DataFrame, more: str) -> T.StructType:
    """df's schema and more fields, as mapInArrow wants it."""
    return T.StructType([*df.schema.fields, *T._parse_datatype_string(more).fields])


def extended(part: pa.RecordBatch, more: dict[str, pa.Array], drop: tuple[str, ...] = ()) -> pa.RecordBatch:
    cols = {c: part.column(c) for c in part.schema.names if c not in drop} | more
    return pa.RecordBatch.from_arrays(list(cols.values()), list(cols))


def text_key(text: str | Column = "text") -> list[Column]:
    """Two 64-bit hashes that stand for a text (null like empty)."""
    c = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return [F.xxhash64(c).alias("h1"), F.xxhash64(F.lit("second"), c).alias("h2")]


def slices(batch: pa.RecordBatch, col: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the strings in col stay near size bytes a slice; one longer text stands alone."""
    n = pc.fill_null(pc.binary_length(batch.column(col)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part, start = np.cumsum(n) // size, 0
    for cut in [*(np.flatnonzero(np.diff(part)) + 1), len(n)]:
        if cut > start:
            yield batch.slice(start, cut - start)
            start = cut


def texts_of(batch: pa.RecordBatch, col: str = "text") -> list[str]:
    return pc.fill_null(batch.column(col), "").to_pylist()


def raw_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column as one array of UTF-8 bytes and its n+1 offsets; nulls are empty."""
    col = pc.fill_null(col, "").cast(pa.large_string())
    _, offsets, data = col.buffers()
    o = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1]
    b = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None and len(col) else np.zeros(0, np.uint8)
    return b, o - (o[0] if len(o) else 0)


def mix64(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit words (a multiply-xorshift finaliser); in place on a copy."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


#: The least and the most bits of a membership bitmap (128 KB and 64 MB), and bits for each value.
BITMAP_BITS, BITS_EACH = (1 << 20, 1 << 29), 16
_PAGE = 1 << 15


def bits_for(values: int) -> int:
    """Bits of a bitmap for so many values: a power of two within BITMAP_BITS."""
    least, most = BITMAP_BITS
    return min(most, max(least, 1 << max(0, int(values * BITS_EACH) - 1).bit_length()))


def bitmap(df: DataFrame, col: str, bits: int):
    """A broadcast bitmap of the values of a long column, by their low bits.

    Its size is bounded and it only spares work: a value that isn't in df may pass, so whoever uses it checks exactly
    later. The fuller it gets, the less it spares.
    """
    x = F.col(col).bitwiseAND(bits - 1) + 1
    at = df.select(F.bitmap_bucket_number(x).alias("page"), F.bitmap_bit_position(x).alias("bit"))
    # Rows are dealt out first: a page of 4 KB for each few rows of a task would cost more.
    pages = at.repartition("page").groupBy("page").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for r in pages.collect():  # bits / 8 bytes in all
        at = (r["page"] - 1) * _PAGE // 8
        out[at : at + _PAGE // 8] = np.frombuffer(r["bits"], np.uint8)[: len(out) - at]
    return df.sparkSession.sparkContext.broadcast(out)


def in_bitmap(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    x = values.astype(np.uint64, copy=False) & np.uint64(len(bits) * 8 - 1)
    return (bits[(x >> np.uint64(3)).astype(np.int64)] >> (x & np.uint64(7)).astype(np.uint8)) & 1 == 1
