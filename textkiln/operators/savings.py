"""Token savings of runs, over periods before a given time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The periods in days (any other name: all runs), and the ratio logged for a repeated output.
PERIODS = {"day": 1, "week": 7, "month": 30}
DEDUPED_RATIO = 0.01


def ratio(raw: Column, out: Column) -> Column:
    return F.when(raw > 0, out / raw).otherwise(F.lit(1.0))


def in_period(ts: Column, as_of: str, period: str) -> Column:
    start = F.expr(f"timestamp_ntz'{as_of}' - interval {24 * PERIODS.get(period, 0)} hours")
    return ts.cast("timestamp_ntz") >= start if period in PERIODS else F.lit(True)


def report(runs: DataFrame, as_of: str, periods: tuple[str, ...] = ("day", "week", "month", "all")) -> DataFrame:
    """One row a period: runs, raw_tokens, output_tokens, saved_tokens (may be negative), memories_used,
    reduction_pct (0 where there are no tokens). All periods come from one scan; empty ones are zeros."""
    aggs = []
    for p in periods:
        hit = in_period(F.col("timestamp"), as_of, p)
        aggs.append(F.count(F.when(hit, F.lit(1))).alias(f"{p}_runs"))
        aggs += [F.coalesce(F.sum(F.when(hit, F.col(c))), F.lit(0)).cast("long").alias(f"{p}_{c}") for c in ("raw_tokens", "output_tokens", "memories_used")]
    one = runs.agg(*aggs)
    row = lambda p: F.struct(F.lit(p).alias("period"), *(F.col(f"{p}_{c}").alias(c) for c in ("runs", "raw_tokens", "output_tokens", "memories_used")))
    rows = one.select(F.explode(F.array(*map(row, periods))).alias("r")).select("r.*")
    saved = F.col("raw_tokens") - F.col("output_tokens")
    pct = F.when(F.col("raw_tokens") > 0, saved / F.col("raw_tokens") * 100).otherwise(F.lit(0.0))
    return rows.withColumn("saved_tokens", saved).withColumn("reduction_pct", pct)


# The columns of the report.
HEAD = "| Period | Runs | Raw Tokens | Output Tokens | Saved Tokens | Reduction % | Memories Used |\n|---|---|---|---|---|---|---|"
TITLE = "# Telemetry Analytics"


def markdown(rows: DataFrame) -> DataFrame:
    """The report as one text: a title, and a table row a period, shortest first.

    Percentages have the fewest digits that two decimals need, and one at least.
    """
    pct = F.regexp_replace(F.format_string("%.2f", "reduction_pct"), "(?<=\\.[0-9])0$", "")
    line = F.format_string("| %s | %d | %,d | %,d | %,d | %s%% | %d |", F.initcap("period"), "runs", "raw_tokens", "output_tokens", "saved_tokens", pct, "memories_used")
    nth = F.expr("array_position(array('day','week','month','all'), period)")
    lines = F.array_sort(F.collect_list(F.struct(nth.alias("n"), line.alias("x"))))  # a row a period
    return rows.agg(F.concat(F.lit(f"{TITLE}\n\n{HEAD}\n"), F.array_join(F.transform(lines, lambda s: s["x"]), "\n"), F.lit("\n")).alias("report"))


def by_command(runs: DataFrame) -> DataFrame:
    """An extension: savings by session and command, with totals."""
    return runs.rollup("session_id", "command").agg(F.count(F.lit(1)).alias("runs"), F.sum("raw_tokens").alias("raw_tokens"), F.sum("output_tokens").alias("output_tokens"))
