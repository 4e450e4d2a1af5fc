"""Line de-duplication over levelled sorted runs.

Documents come in batches. A run is a table of line keys (128-bit hashes), sorted by key, with the number of documents
that hold them. A new batch is merge-joined with the runs: the keys that no run has yet (the anti-join) enter the
batch's own run as new, the others as counts to add, so each key is new in exactly one run. The run joins level 0; when
a level has FANOUT runs they are merged into one of the next level, so a key is rewritten once a level.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textkiln.llm.common import discard, extended, folders, materialise, remove, schema_with, slices, text_key, texts_of, work_path, write_table

FANOUT = 3
#: Batches that one table is dealt into, by a hash of the text.
BATCHES = 4
#: Sets of up to so many dropped keys (16 bytes each, about 60 MB as a set in a worker) are broadcast; larger ones are
#: joined. Both ways give the same rows.
BROADCAST_KEYS = 1 << 19
BLANK = b" \t\n\x0b\x0c\r"
RUN = "k1 long, k2 long, n long, new boolean"
KEY = ["k1", "k2"]


def line_keys(text: str) -> list[bytes]:
    """The keys of a text's lines: blanks stripped at both ends, A-Z in lower case (bytes.lower leaves others)."""
    return [x.strip(BLANK).lower() for x in text.encode("utf-8", "surrogatepass").split(b"\n")]


def _long(key: bytes, least_chars: int) -> bool:
    return len(key) >= least_chars and (least_chars < 2 or len(key.decode("utf-8", "surrogatepass")) >= least_chars)


def _hashed(keys) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), np.int64).reshape(-1, 2)


def _counts(least_chars: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for part in slices(batch, "text"):
                by: dict[int, dict[bytes, int]] = {}
                for text, number in zip(texts_of(part), part.column("batch").to_pylist(), strict=True):
                    seen = by.setdefault(number, {})
                    for k in {k for k in line_keys(text) if _long(k, least_chars)}:
                        seen[k] = seen.get(k, 0) + 1
                for number, seen in by.items():
                    h = _hashed(seen)
                    yield pa.RecordBatch.from_arrays([pa.array([number] * len(seen), pa.int32()), pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(list(seen.values()), pa.int64())], ["batch", "k1", "k2", "n"])

    return run


def batch_counts(docs: DataFrame, least_chars: int = 1, batches: int = BATCHES) -> DataFrame:
    """batch, k1, k2, n: how many documents of each batch hold a key. Any table is dealt into batches, by its texts."""
    number = F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(batches)).cast("int")
    counts = docs.select("text", number.alias("batch")).mapInArrow(_counts(least_chars), "batch int, k1 long, k2 long, n long")
    return counts.groupBy("batch", *KEY).agg(F.sum("n").alias("n"))


class LineRuns:
    """The runs of one corpus, kept under a path that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str | None = None, fanout: int = FANOUT) -> None:
        self.spark, self.path, self.fanout = spark, path or work_path(spark, "line-runs"), fanout
        self.levels: list[list[str]] = []
        self.made = 0

    def _write(self, rows: DataFrame) -> str:
        self.made += 1
        path = f"{self.path}/run-{self.made}"
        write_table(rows.select(*KEY, "n", "new").sortWithinPartitions(*KEY), path)
        return path

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(RUN).parquet(*paths) if paths else self.spark.createDataFrame([], RUN)

    def rows(self) -> DataFrame:
        return self._read([x for level in self.levels for x in level])

    def unseen(self, counts: DataFrame) -> DataFrame:
        """Of a batch's counts (k1, k2, n) those of keys that no run has: a merge-anti-join with the sorted runs."""
        known = self.rows().filter("new").select(*KEY)
        return counts.join(known.hint("merge"), KEY, "left_anti")

    def add(self, counts: DataFrame) -> None:
        """Take in a batch's counts (k1, k2, n; a key once), then merge the levels that are full."""
        if any(self.levels):
            known = self.rows().filter("new").select(*KEY, F.lit(False).alias("new"))
            counts = counts.join(known.hint("merge"), KEY, "left").withColumn("new", F.col("new").isNull())
        else:
            counts = counts.withColumn("new", F.lit(True))
        run = self._write(counts)
        level = 0
        while True:
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(run)
            if len(self.levels[level]) < self.fanout:
                return
            old, self.levels[level] = self.levels[level], []
            run = self._write(self._read(old).groupBy(*KEY).agg(F.sum("n").alias("n"), F.max("new").alias("new")))
            for x in old:
                remove(self.spark, x)
            level += 1

    def counts(self, least: int = 1) -> DataFrame:
        """k1, k2, n of the keys in `least` documents or more. A key that only its own run has needs no sum."""
        rows = self.rows()
        again = rows.filter("not new").groupBy(*KEY).agg(F.sum("n").alias("more"))
        n = F.col("n") + F.coalesce("more", F.lit(0))
        return rows.filter("new").join(again, KEY, "left").select(*KEY, n.alias("n")).filter(F.col("n") >= least)


def _text_keys(least_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                own, keys = [], []
                for i, text in enumerate(texts_of(part)):
                    new = {k for k in line_keys(text) if _long(k, least_chars)}
                    own += [i] * len(new)
                    keys += new
                h, at = _hashed(keys), pa.array(own, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("h1").take(at), part.column("h2").take(at), pa.array(h[:, 0]), pa.array(h[:, 1])], ["h1", "h2", "k1", "k2"])

    return run


def _cut(broadcast):
    """Give each row its text without the dropped lines; the keys come by broadcast or in the column `dropped`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = None if broadcast is None else set(map(bytes, broadcast.value.reshape(-1, 16)))
        for batch in batches:
            for part in slices(batch, "text"):
                n_lines, n_dropped, kept = [], [], []
                own = [None] * len(part) if shared is not None else part.column("dropped").to_pylist()
                for text, drops in zip(texts_of(part), own, strict=True):
                    lines, keys = text.split("\n"), line_keys(text)
                    gone = shared if shared is not None else {np.array([x["k1"], x["k2"]], np.int64).tobytes() for x in drops or ()}
                    rest = [x for x, k in zip(lines, keys, strict=True) if xxhash.xxh3_128_digest(k) not in gone] if gone else lines
                    n_lines.append(len(lines))
                    n_dropped.append(len(lines) - len(rest))
                    kept.append("\n".join(rest))
                more = {"n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64()), "kept": pa.array(kept, pa.string())}
                yield extended(part, more, ("h1", "h2", "dropped"))

    return run


def drop_frequent_lines(docs: DataFrame, min_docs: int = 10, least_chars: int = 1, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """docs' columns, n_lines, n_dropped and kept: the text without lines whose key is in at least min_docs documents.

    The table is dealt into BATCHES batches, which go through the runs one after another. Keys are counted once a
    document. A null text is one empty line; an empty table stays empty. Every row is a document, repeated rows too; ids are not used. Columns of docs named
    like an output, or h1, h2 and dropped, are replaced. Keys shorter than least_chars code points always stay.
    """
    spark = docs.sparkSession
    runs, path = LineRuns(spark), work_path(spark, "line-counts")
    batch_counts(docs, least_chars).write.mode("overwrite").partitionBy("batch").option("compression", "zstd").parquet(path)
    for name in folders(spark, path):
        runs.add(spark.read.schema("k1 long, k2 long, n long").parquet(f"{path}/{name}"))
    frequent = materialise(runs.counts(min_docs).select(*KEY), "frequent-lines")
    remove(spark, path)
    remove(spark, runs.path)
    docs = docs.drop("n_lines", "n_dropped", "kept", "h1", "h2", "dropped")
    schema = schema_with(docs, "n_lines long, n_dropped long, kept string")
    if frequent.count() <= broadcast_keys:
        keys = frequent.toPandas().to_numpy(np.int64)
        discard(frequent)
        shared = spark.sparkContext.broadcast(np.ascontiguousarray(keys).view(np.uint8).reshape(-1))
        return docs.mapInArrow(_cut(shared), schema)
    hashed = docs.withColumns(dict(zip(("h1", "h2"), text_key(), strict=True)))
    hits = hashed.select("text", "h1", "h2").mapInArrow(_text_keys(least_chars), "h1 long, h2 long, k1 long, k2 long").join(frequent, ["k1", "k2"], "left_semi")
    hits = hits.distinct().groupBy("h1", "h2").agg(F.collect_list(F.struct("k1", "k2")).alias("dropped"))
    return hashed.join(hits, ["h1", "h2"], "left").mapInArrow(_cut(None), schema)


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
