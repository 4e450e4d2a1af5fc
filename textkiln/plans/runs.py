"""Captured runs to responses: repeats, profile, selection of lines, token, savings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textkiln.functions.text import token_count
from textkiln.operators import codec, density, facts, lines, savings
from textkiln.operators.ledger import MOST_ENTRIES, TTL_SECONDS, ledger, marker
from textkiln.sources import profiles


def injected(runs: DataFrame, known: DataFrame) -> DataFrame:
    """runs with memories_injected: how many facts about the run's current_file hold at its time (none: 0)."""
    probes = runs.select("current_file", "ts").filter("current_file is not null").distinct()
    n = facts.as_of(known, probes, "current_file", "ts").groupBy(F.col("subject").alias("current_file"), "ts").agg(F.count(F.lit(1)).alias("memories_injected"))
    return runs.join(n, ["current_file", "ts"], "left").withColumn("memories_injected", F.coalesce("memories_injected", F.lit(0).cast("long")))


def respond(runs: DataFrame, user: dict | None = None, order: list[str] | None = None, entries: DataFrame | None = None, ttl: int | None = TTL_SECONDS, most: int | None = MOST_ENTRIES) -> DataFrame:
    """runs (session_id, ts, command, raw_output) with output, deduped, raw_tokens, output_tokens, tokens_saved,
    compression_ratio, truncated, full_output_path, filtered, drops and token.

    Repeats answer with a marker and skip the line program; entries are what the ledgers of earlier calls have left; ttl
    and most are the ledger's. The ledger's windows shuffle; the rest is narrow.
    """
    df = ledger(runs, order=order, ttl=ttl, most=most, entries=entries)
    raw, deduped = F.col("raw_output"), F.col("deduped")
    df = df.withColumn("filtered", F.when(~deduped, profiles.apply(F.col("command"), raw, user)))
    df = df.withColumn("drops", F.when(~deduped, density.drop_indices(F.col("filtered"))))
    df = codec.compress(df, "filtered", "drops", "compressed", "token")
    df = df.withColumn("output", F.when(deduped, marker(F.col("first_turn"), F.col("fingerprint"))).otherwise(F.col("compressed")))
    df = df.withColumns({"raw_tokens": token_count(raw), "output_tokens": token_count(F.col("output"))})
    saved = F.when(deduped, F.col("raw_tokens")).otherwise(F.greatest(F.lit(0).cast("long"), F.col("raw_tokens") - F.col("output_tokens")))
    ratio = F.when(deduped, F.lit(savings.DEDUPED_RATIO)).otherwise(savings.ratio(F.col("raw_tokens"), F.col("output_tokens")))
    cut = F.coalesce(lines.is_cut(F.col("filtered"), raw), F.lit(False))
    return df.withColumns({"tokens_saved": saved, "compression_ratio": ratio, "truncated": cut, "full_output_path": F.when(cut, lines.tee_ref(raw))}).drop("compressed")


def tee(responses: DataFrame) -> DataFrame:
    """ref, raw_output: the full texts that notices of cut outputs point to."""
    return responses.filter("truncated").select(F.col("full_output_path").alias("ref"), "raw_output").dropDuplicates(["ref"])


def run_log(responses: DataFrame) -> DataFrame:
    """The rows to append to the run log."""
    used = F.col("memories_injected") if "memories_injected" in responses.columns else F.lit(0)
    return responses.select(F.col("ts").alias("timestamp"), "command", "raw_tokens", "output_tokens", "deduped", "compression_ratio", "session_id", used.cast("long").alias("memories_used"), F.lit(None).cast("long").alias("latency_ms"))
