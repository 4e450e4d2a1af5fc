"""The ledger of repeated outputs as a stateful stream, in order of arrival."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

from textkiln.operators.ledger import MOST_ENTRIES, TTL_SECONDS, Entries

OUT = "session_id string, run_id long, turn int, fingerprint string, first_turn int, deduped boolean"
STATE = "turn int, entries string"


def stateful_ledger(runs: DataFrame, ttl: int = TTL_SECONDS, most: int = MOST_ENTRIES) -> DataFrame:
    """runs: session_id, run_id, ts, fingerprint. The state of a session is its turn and its live entries: at most
    `most`, the least recently used make room. It is read and written once a batch and session. Append mode.

    Null times and null fingerprints mean what they mean in the batch ledger.
    """

    def update(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        turn, saved = state.get if state.exists else (0, "[]")
        entries = Entries(ttl, most)
        entries.known = {fp: (first, now) for fp, first, now in json.loads(saved)}
        for frame in frames:
            out = []
            for r in frame.sort_values(["ts", "run_id"]).itertuples():
                turn += 1
                fp = None if pd.isna(r.fingerprint) else r.fingerprint
                first = entries.use(fp, turn, None if pd.isna(r.ts) else pd.Timestamp(r.ts).timestamp())
                out.append((key[0], r.run_id, turn, fp, first, turn > first))
            yield pd.DataFrame(out, columns=["session_id", "run_id", "turn", "fingerprint", "first_turn", "deduped"])
        state.update((turn, json.dumps([(fp, *x) for fp, x in entries.known.items()])))

    return runs.groupBy("session_id").applyInPandasWithState(update, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
