"""Reversible removal of lines: a token at the end of the text restores them."""

from __future__ import annotations

import base64
import json
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textkiln.functions.text import bound
from textkiln.operators.lines import lines_of

# The longest token that stays in the text, and how tokens are written there.
INLINE_CHARS = 200
MARK = r"\[\.\.\.(\d+) lines compressed: (irc:|ircref:)([a-zA-Z0-9_\-]+)\.\.\.\]"
PAYLOAD = "indices array<int>, lines array<string>"


@F.pandas_udf(T.StringType())
def _encode(payload: pd.Series) -> pd.Series:
    return payload.map(lambda x: None if x is None else base64.urlsafe_b64encode(zlib.compress(x.encode("utf-8", "surrogatepass"), 9)).decode().rstrip("="))


def _decoded(token: str | None) -> str | None:
    try:
        raw = zlib.decompress(base64.urlsafe_b64decode(token + "=" * (-len(token) % 4))).decode("utf-8", "surrogatepass")
        json.loads(raw)
        return raw
    except (TypeError, ValueError, zlib.error):
        return None


# Filters on the token are to stay above its one evaluation; pushed down they would compress anew.
_encode = _encode.asNondeterministic()


@F.pandas_udf(T.StringType())
def _decode(token: pd.Series) -> pd.Series:
    return token.map(_decoded)


def compress(df: DataFrame, text: str, drops: str, output: str = "compressed", token: str = "token") -> DataFrame:
    """df with the text without the lines numbered in `drops` (a mark with a token at its end), and the token.

    Tokens over INLINE_CHARS are replaced by a reference, their hash: store() keeps them. No drops: unchanged.
    """
    t, d = F.col(text), F.col(drops)
    made = bound(lines_of(t), lambda x: bound(_gone(x, d), lambda g: _split(x, g)))
    df = df.withColumn("_parts", F.when(F.size(d) > 0, made))  # null: nothing to drop
    parts = F.col("_parts")
    df = df.withColumn(token, _encode(F.when(parts["n"] > 0, F.to_json(F.struct(parts["indices"].alias("indices"), parts["lines"].alias("lines"))))))
    ref = F.when(F.length(token) > INLINE_CHARS, F.concat(F.lit("ircref:"), F.sha2(F.col(token), 256))).otherwise(F.concat(F.lit("irc:"), F.col(token)))
    mark = F.concat(F.lit("[..."), parts["n"].cast("string"), F.lit(" lines compressed: "), ref, F.lit("...]"))
    body = F.array_join(F.concat(parts["kept"], F.array(mark)), "\n")
    return df.withColumn(output, F.when(parts["n"] > 0, body).otherwise(t)).drop("_parts")


def _gone(lines: Column, drops: Column) -> Column:
    return F.sort_array(F.array_distinct(F.filter(drops, lambda i: (i >= 0) & (i < F.size(lines)))))


def _split(lines: Column, gone: Column) -> Column:
    """n, indices and lines that go, kept lines; both arguments must be bound variables."""
    kept = F.transform(F.array_except(F.transform(lines, lambda _, i: i), gone), lambda i: F.get(lines, i))
    return F.struct(F.size(gone).alias("n"), gone.alias("indices"), F.transform(gone, lambda i: F.get(lines, i)).alias("lines"), kept.alias("kept"))


def store(df: DataFrame, token: str = "token") -> DataFrame:
    """ref_id, token: the side table of tokens that are too long for the text."""
    return df.filter(F.length(token) > INLINE_CHARS).select(F.sha2(F.col(token), 256).alias("ref_id"), F.col(token).alias("token")).distinct()


def expand(df: DataFrame, text: str = "compressed", tokens: DataFrame | None = None, output: str = "expanded") -> DataFrame:
    """df with the restored text. A text whose last line is no mark, or whose token is unknown or broken, stays."""
    t = F.col(text)
    whole = f"^{MARK}$"
    last = F.substring_index(t, "\n", -1)
    # What has no reference is given a key of its own that none is stored under: as nulls they would meet in one task.
    none = F.concat(F.lit("-"), F.xxhash64(*df.columns).cast("string"))
    df = df.withColumn("_kind", F.regexp_extract(last, whole, 2)).withColumn("_token", F.regexp_extract(last, whole, 3))
    if tokens is not None:
        df = df.withColumn("_ref", F.when(F.col("_kind") == "ircref:", F.col("_token")).otherwise(none))
        df = df.join(tokens.select(F.col("ref_id").alias("_ref"), F.col("token").alias("_stored")), "_ref", "left").drop("_ref")
    else:
        df = df.withColumn("_stored", F.lit(None).cast("string"))
    df = df.withColumn("_payload", F.from_json(_decode(F.when(F.col("_kind") == "irc:", F.col("_token")).when(F.col("_kind") == "ircref:", F.col("_stored"))), PAYLOAD))
    p = F.col("_payload")

    def merged(lines: Column) -> Column:
        n = F.size(lines) - 1 + F.size(p["indices"])
        kept = F.array_except(F.sequence(F.lit(0), n - 1), p["indices"])
        pairs = F.concat(F.transform(kept, lambda i, k: F.struct(i.alias("i"), F.get(lines, k).alias("x"))), F.arrays_zip(p["indices"].alias("i"), p["lines"].alias("x")))
        return F.array_join(F.sort_array(pairs)["x"], "\n")

    restored = bound(lines_of(t), merged)
    return df.withColumn(output, F.when(p["indices"].isNotNull(), restored).otherwise(t)).drop("_kind", "_token", "_stored", "_payload")
