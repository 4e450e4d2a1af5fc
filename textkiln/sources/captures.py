"""Captured command outputs: caps, exit states and errors, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The size above which an output is cut, the notice, exit codes and texts of failures.
MOST_BYTES = 10 * 1024 * 1024
CAP_NOTICE = "\n... [FATAL: Output exceeded 10MiB hard limit. Truncated.]\n"
FAILURES = {"empty": (1, "[Command is empty]"), "timeout": (-1, "[Command timed out after {}s]"), "not_found": (127, None), "permission": (126, None), "os_error": (1, None)}


def capped(text: Column, most: int = MOST_BYTES) -> Column:
    """Texts of more than `most` bytes are cut to so many code points, and say so."""
    return F.when(F.octet_length(text) > most, F.concat(F.substring(text, 1, most), F.lit(CAP_NOTICE))).otherwise(text)


def exceeds(text: Column, most: int = MOST_BYTES) -> Column:
    return F.octet_length(text) > most


def exit_code(kind: Column, code: Column) -> Column:
    out = F
    for k, (c, _) in FAILURES.items():
        out = out.when(kind == k, F.lit(c))
    return out.otherwise(code)


def error_text(kind: Column, message: Column, timeout: int = 30) -> Column:
    return F.when(kind == "empty", F.lit(FAILURES["empty"][1])).when(kind == "timeout", F.lit(FAILURES["timeout"][1].format(timeout))).otherwise(message)


def with_error(stdout: Column, error: Column) -> Column:
    return F.concat(stdout, F.coalesce(F.concat(F.lit("\n"), F.when(error != "", error)), F.lit("")))


def read(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """Captured outputs: parquet or json with a row a run, or text with a file a run (path, raw_output)."""
    if kind == "text":
        return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("raw_output"))
    return spark.read.format(kind).load(path)


def full_command(command: Column, args: Column) -> Column:
    return F.array_join(F.concat(F.array(command), F.coalesce(args, F.array().cast("array<string>"))), " ")


def session(session_id: Column, context: Column) -> Column:
    return F.coalesce(session_id, F.element_at(context, "session_id"), F.lit("default"))
