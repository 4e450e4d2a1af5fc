"""Repeated outputs of a session, with a sliding expiry and a bounded number of entries, over all runs.

Turns and entries depend on the order of a session's runs, so a session is sorted in one task (which spills); a table
whose runs all share one session gains nothing from more executors. Sessions with at most as many runs as entries can't
evict: windows answer for them. Longer ones go through the entries run by run, in Arrow batches; what a task keeps is one
session's entries.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from textkiln.functions.text import fingerprint

# An entry expires so long after its last use; and the most entries that a session keeps.
TTL_SECONDS, MOST_ENTRIES = 604_800, 10_000


def marker(first_turn: Column, fp: Column) -> Column:
    return F.concat(F.lit("[Output identical to turn #"), first_turn.cast("string"), F.lit("] Fingerprint: "), fp)


ENTRIES = "session_id string, fingerprint string, first_turn int, last_use timestamp, turn int"


class Entries:
    """The live entries of one session: first turn and last use of each fingerprint, the least recently used first."""

    def __init__(self, ttl: int | None, most: int) -> None:
        self.ttl, self.most, self.known = ttl, most, {}

    def use(self, fp, turn: int, now: float | None) -> int:
        """The turn of the first use; a use without a time neither finds an entry nor is found."""
        own = self.known.pop(fp, None)
        if own is not None and self.ttl is not None and (now is None or own[1] is None or now - own[1] >= self.ttl):
            own = None
        first = turn if own is None else own[0]
        self.known[fp] = (first, now)  # a dict keeps the order of last use
        while len(self.known) > self.most:
            del self.known[next(iter(self.known))]
        return first


def _one_by_one(session: str, ttl: int | None, most: int):
    """Rows come sorted by session and turn: adds first_turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, entries = object(), None
        for batch in batches:
            first = []
            for s, fp, turn, now, known in zip(*(batch.column(c).to_pylist() for c in (session, "fingerprint", "turn", "_seconds", "_known")), strict=True):
                if s != current:
                    current, entries = s, Entries(ttl, most)
                if known is not None:  # an entry that an earlier call has left
                    entries.known[fp] = (known, now)
                    first.append(known)
                else:
                    first.append(entries.use(fp, turn, now))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first, pa.int32())], [*batch.schema.names, "first_turn"])

    return run


def ledger(runs: DataFrame, session: str = "session_id", ts: str = "ts", text: str | None = "raw_output", order: list[str] | None = None, ttl: int | None = TTL_SECONDS, most: int | None = MOST_ENTRIES, entries: DataFrame | None = None) -> DataFrame:
    """Adds turn, fingerprint, first_turn and deduped.

    A use refreshes the entry, so it lives while gaps are under ttl seconds; a gap of ttl or more starts anew, and so does
    a use after `most` or more other fingerprints: the least recently used entries make room. With ttl None no entry
    expires and times don't matter; with most None every entry stays, and windows answer for all sessions. Without text,
    the column fingerprint must be there. entries (as entries_after makes them) are what earlier calls have left: turns go
    on from there. Null texts share a fingerprint, null; a run without a time starts anew, and so does the next one like it.
    Two shuffles: by session for turns, by session and fingerprint. Unless most is None, sessions are counted at once, to
    see if any is long.
    """
    fields, out = runs.columns, runs
    if text is not None:
        out = out.withColumn("fingerprint", fingerprint(F.col(text)))
    seconds = F.col(ts).cast("timestamp").cast("double")
    out = out.withColumns({"_seconds": seconds, "_known": F.lit(None).cast("int"), "_old": F.lit(1), "_base": F.lit(0)})
    if entries is not None:
        left = entries.select(F.col("session_id").alias(session), "fingerprint", F.col("last_use").cast("double").alias("_seconds"), F.col("first_turn").alias("_known"), F.lit(0).alias("_old"), F.col("turn").alias("_base"))
        out = out.unionByName(left, allowMissingColumns=True)
    per_session = out.groupBy(session).agg(F.count(F.lit(1)).alias("_n"))
    by = Window.partitionBy(session)
    nth = F.row_number().over(by.orderBy("_old", *[F.when(F.col("_old") == 0, F.col("_seconds"))], *(order or [ts])))
    # Turns go on from the last one that entries tell of; entries stand before all runs, in the order of their last use.
    out = out.withColumn("_nth", nth) if most is None else out.withColumns({"_nth": nth, "_n": F.count(F.lit(1)).over(by)})
    if entries is not None:
        out = out.withColumn("_base", F.max("_base").over(by) - F.sum(F.lit(1) - F.col("_old")).over(by))
    out = out.withColumn("turn", (F.col("_nth") + F.col("_base")).cast("int"))
    same = Window.partitionBy(session, "fingerprint").orderBy("_nth")
    gap = F.col("_seconds") - F.lag("_seconds").over(same)
    few = out if most is None else out.filter(F.col("_n") <= most)
    alike = [session, "fingerprint"]
    if ttl is not None:
        few = few.withColumn("_fresh", F.coalesce((gap >= ttl).cast("int"), F.lit(1))).withColumn("_epoch", F.sum("_fresh").over(same))
        alike.append("_epoch")
    answered = few.withColumn("first_turn", F.min(F.coalesce("_known", "turn")).over(Window.partitionBy(*alike))).drop("_fresh", "_epoch")
    if most is not None and not per_session.filter(F.col("_n") > most).isEmpty():
        many = out.filter(F.col("_n") > most).repartition(session).sortWithinPartitions(session, "_nth")
        answered = answered.unionByName(many.mapInArrow(_one_by_one(session, ttl, most), T.StructType([*many.schema.fields, T.StructField("first_turn", T.IntegerType())])))
    out = answered.filter("_old = 1")
    keep = dict.fromkeys([*fields, "turn", "fingerprint", "first_turn"])
    return out.select(*keep, (F.col("turn") > F.col("first_turn")).alias("deduped"))


def entries_after(ledgered: DataFrame, session: str = "session_id", ts: str = "ts", entries: DataFrame | None = None, ttl: int | None = TTL_SECONDS, most: int | None = MOST_ENTRIES) -> DataFrame:
    """ENTRIES: what sessions keep after the runs of ledger (and, where these are from an earlier call, its entries).

    Of each fingerprint the last use counts. Entries that had expired at the session's last run go, and of more than
    `most` the least recently used; ttl and most None: none go.
    """
    used = ledgered.select(F.col(session).alias("session_id"), "fingerprint", "first_turn", F.col(ts).cast("timestamp").alias("last_use"), "turn")
    if entries is not None:
        used = used.unionByName(entries.withColumn("_old", F.lit(0)), allowMissingColumns=True)
    else:
        used = used.withColumn("_old", F.lit(None).cast("int"))
    by = Window.partitionBy("session_id")
    last = used.groupBy("session_id", "fingerprint").agg(F.max(F.struct(F.coalesce("_old", F.lit(1)).alias("_old"), "turn", "last_use", "first_turn")).alias("s"))
    out = last.select("session_id", "fingerprint", "s.*").withColumns({"_now": F.max("last_use").over(by), "_turn": F.max("turn").over(by)})
    if ttl is not None:
        out = out.filter(F.col("_now").cast("double") - F.col("last_use").cast("double") < ttl)
    if most is not None:
        out = out.withColumn("_rank", F.row_number().over(by.orderBy(F.desc("_old"), F.desc(F.when(F.col("_old") == 1, F.col("turn"))), F.desc("last_use")))).filter(F.col("_rank") <= most)
    return out.select("session_id", "fingerprint", "first_turn", "last_use", F.col("_turn").alias("turn"))


def legacy_entries(files: DataFrame, now: str) -> DataFrame:
    """ENTRIES from files of one JSON object a session (session_id, value): turn, and fingerprints with turn and timestamp
    in seconds, or, in old files, with the turn alone, which count as used now. Broken files hold nothing."""
    raw = files.withColumn("o", F.from_json("value", "turn int, fingerprints map<string,string>"))
    flat = raw.select("session_id", F.col("o.turn").alias("turn"), F.explode("o.fingerprints").alias("fingerprint", "x"))
    new = F.from_json("x", "turn int, timestamp double")
    old = F.try_to_number("x", F.lit("9999999999")).cast("int")
    used = F.when(old.isNotNull(), F.lit(now).cast("timestamp")).otherwise(F.timestamp_seconds(F.coalesce(new["timestamp"], F.lit(0.0))))
    out = flat.select("session_id", "fingerprint", F.coalesce(old, new["turn"], F.lit(0)).alias("first_turn"), used.alias("last_use"), F.coalesce("turn", F.lit(0)).alias("turn"))
    return out.filter(F.lit(now).cast("timestamp").cast("double") - F.col("last_use").cast("double") < TTL_SECONDS)
