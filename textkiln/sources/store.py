"""Tables that are kept between calls: versions of a state, and logs that grow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from textkiln.operators.ledger import ENTRIES

RUN_LOG = "timestamp timestamp, command string, raw_tokens long, output_tokens long, deduped boolean, compression_ratio double, session_id string, memories_used long, latency_ms long"
TEE = "ref string, raw_output string"


def _folder(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, path: str) -> list[str]:
    """The finished versions under path, oldest first: Spark marks a table that was written to its end."""
    fs, p = _folder(spark, path)
    found = [x.getPath() for x in fs.listStatus(p) if x.getPath().getName().startswith("version-")] if fs.exists(p) else []
    done = [x for x in found if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS"))]
    return sorted(x.toString() for x in done)


def load(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The newest finished version; an empty table where there is none."""
    kept = versions(spark, path)
    return spark.read.schema(schema).parquet(kept[-1]) if kept else spark.createDataFrame([], T._parse_datatype_string(schema))


def save(df: DataFrame, path: str, keep: int = 2) -> None:
    """Write df as the next version, then drop all but the newest `keep`: df may read the one before."""
    spark = df.sparkSession
    kept = versions(spark, path)
    number = int(kept[-1].rsplit("-", 1)[1]) + 1 if kept else 1
    df.write.mode("overwrite").parquet(f"{path}/version-{number:09d}")
    for old in versions(spark, path)[:-keep]:
        fs, p = _folder(spark, old)
        fs.delete(p, True)


def append(df: DataFrame, path: str, schema: str) -> None:
    """Add df's rows to a log, with the log's columns and types."""
    fields = T._parse_datatype_string(schema).fields
    df.select(*(df[f.name].cast(f.dataType).alias(f.name) for f in fields)).write.mode("append").parquet(path)


def log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A log's rows; an empty table before the first append."""
    fs, p = _folder(spark, path)
    return spark.read.schema(schema).parquet(path) if fs.exists(p) else spark.createDataFrame([], T._parse_datatype_string(schema))


def load_entries(spark: SparkSession, path: str) -> DataFrame:
    return load(spark, path, ENTRIES)
