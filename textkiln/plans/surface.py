"""One function for each thing a user asks for, over tables kept under one folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textkiln.operators import codec, facts, savings
from textkiln.operators.ledger import entries_after
from textkiln.plans import runs
from textkiln.sources import store

FACTS = "id long, subject string, predicate string, object string, scope string, kind string, valid_from timestamp, valid_until timestamp"
TOKENS = "ref_id string, token string"


class Workspace:
    """The ledger, the run log, full outputs, tokens and facts of a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def run(self, captured: DataFrame, user: dict | None = None, order: list[str] | None = None) -> DataFrame:
        """Responses to captured runs (session_id, ts, command, raw_output and, where facts about a file are to be counted,
        current_file). What later calls need is stored: the ledger,
        the log, the full texts of cut outputs and tokens that are too long for a text. The responses are stored too,
        as the newest version of `responses`, so that each run is answered once."""
        kept = store.load_entries(self.spark, f"{self.path}/ledger")
        if "current_file" in captured.columns:
            captured = runs.injected(captured, self.facts())
        store.save(runs.respond(captured, user, order, kept), f"{self.path}/responses", keep=1)
        out = self.spark.read.parquet(store.versions(self.spark, f"{self.path}/responses")[-1])
        store.save(entries_after(out, entries=kept), f"{self.path}/ledger")
        store.append(runs.run_log(out), f"{self.path}/run_log", store.RUN_LOG)
        store.append(runs.tee(out), f"{self.path}/tee", store.TEE)
        store.append(codec.store(out), f"{self.path}/tokens", TOKENS)
        return out

    def expand(self, outputs: DataFrame, text: str = "output") -> DataFrame:
        """outputs with `expanded`: the lines that tokens stand for are back."""
        tokens = store.log(self.spark, f"{self.path}/tokens", TOKENS).dropDuplicates(["ref_id"])
        return codec.expand(outputs, text, tokens)

    def full_output(self, refs: DataFrame) -> DataFrame:
        """refs (full_output_path) with raw_output, the text before it was cut."""
        kept = store.log(self.spark, f"{self.path}/tee", store.TEE).dropDuplicates(["ref"])
        return refs.join(kept.withColumnRenamed("ref", "full_output_path"), "full_output_path", "left")

    def remember(self, new: DataFrame, at: str) -> DataFrame:
        """Save facts (subject, predicate, object, ...; missing ones get defaults) as of a time, in the order of the
        column id if there is one. Returns all facts."""
        known = store.load(self.spark, f"{self.path}/facts", FACTS)
        last = known.agg(F.coalesce(F.max("id"), F.lit(0).cast("long"))).first()[0]
        order = F.col("id") if "id" in new.columns else F.monotonically_increasing_id()
        told = facts.remembered(new.withColumn("id", order + last + 1)).withColumn("valid_from", F.lit(at).cast("timestamp"))
        columns = ["id", "subject", "predicate", "object", "scope", "kind", "valid_from"]
        closed = known.filter("valid_until is not null")
        every = facts.history(known.filter("valid_until is null").select(*columns).unionByName(told.select(*columns)), order=["id"])
        store.save(closed.unionByName(every), f"{self.path}/facts")
        return self.facts()

    def facts(self) -> DataFrame:
        return store.load(self.spark, f"{self.path}/facts", FACTS)

    def search(self, query: str, kind: str = "keyword", at: str | None = None) -> DataFrame:
        """Lines of a list: the facts that a keyword search finds, or (kind `temporal`) those of a subject at a time."""
        if kind == "semantic":
            return facts.semantic_search(self.facts(), query)
        if kind == "temporal":
            when = F.current_timestamp() if at is None else F.lit(at).cast("timestamp")
            return self.facts().filter((F.col("subject") == query) & facts.holds(when)).select("id", facts.rendered().alias("line"))
        return facts.keyword_search(self.facts(), query).select("id", facts.rendered(True).alias("line"))

    def analytics(self, as_of: str, period: str | None = None) -> DataFrame:
        """One row of savings for a period, or the report of all periods as a text."""
        log = store.log(self.spark, f"{self.path}/run_log", store.RUN_LOG)
        return savings.markdown(savings.report(log, as_of)) if period is None else savings.report(log, as_of, (period,))

    def status(self) -> dict[str, str]:
        return {"status": "healthy", "telemetry": "active"}
