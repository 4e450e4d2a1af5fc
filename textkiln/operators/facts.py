"""A temporal store of subject-predicate-object facts: one open value for each subject and predicate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# What a remembered fact lacks is filled in with these; and how many hits a search shows.
DEFAULTS = {"subject": "unknown", "predicate": "is", "object": "", "scope": "global", "kind": "fact"}
HITS = 5


def remembered(raw: DataFrame) -> DataFrame:
    """raw with missing or null fields of a fact filled in."""
    return raw.withColumns({k: F.coalesce(F.col(k), F.lit(v)) if k in raw.columns else F.lit(v) for k, v in DEFAULTS.items()})


def history(facts: DataFrame, at: str = "valid_from", order: list[str] | None = None) -> DataFrame:
    """Facts as saved one after another: repeats of the open value are dropped, a new value closes the open one.

    Adds valid_until (null: open). Ties in time go by `order`. One shuffle, by subject and predicate.
    """
    w = Window.partitionBy("subject", "predicate").orderBy(at, *(order or []))
    new = facts.withColumn("_before", F.lag("object").over(w)).withColumn("_nth", F.row_number().over(w))
    new = new.filter((F.col("_nth") == 1) | ~F.col("object").eqNullSafe(F.col("_before"))).drop("_before", "_nth")
    return new.withColumn("valid_until", F.lead(at).over(w))


def active(facts: DataFrame) -> DataFrame:
    return facts.filter("valid_until is null")


def holds(at: Column) -> Column:
    """Whether a fact is valid at a time: from valid_from on, until before valid_until."""
    return (F.col("valid_from") <= at) & (F.col("valid_until").isNull() | (F.col("valid_until") > at))


def as_of(facts: DataFrame, probes: DataFrame, subject: str = "subject", at: str = "at") -> DataFrame:
    """Each probe (subject, at, ...) with the facts of its subject that hold then."""
    p = probes.withColumnsRenamed({subject: "_subject", at: "_at"})
    joined = p.join(facts, (p["_subject"] == facts["subject"]) & holds(F.col("_at")))
    return joined.withColumnRenamed("_at", at).drop("_subject")


def keyword_score(query: str) -> Column | None:
    """The share of the query's words found in the fact's text; None for a query without words."""
    words = query.lower().split()
    if not words:
        return None
    text = F.lower(F.concat_ws(" ", "subject", "predicate", "object"))
    return sum((F.contains(text, F.lit(w)).cast("int") for w in words), F.lit(0)).cast("double") / F.lit(float(len(words)))


def keyword_search(facts: DataFrame, query: str, k: int = HITS, order: str = "id") -> DataFrame:
    """The k best open facts with their score; ties by `order`. A query without words finds nothing."""
    s = keyword_score(query)
    if s is None:
        return facts.withColumn("score", F.lit(0.0)).limit(0)
    return active(facts).withColumn("score", s).filter("score > 0").orderBy(F.desc("score"), order).limit(k)


def semantic_search(facts: DataFrame, query: str) -> DataFrame:
    """There is no search by meaning: facts have no embeddings."""
    raise NotImplementedError("facts have no embeddings; use keyword_search")


def rendered(score: bool = False) -> Column:
    """A fact as a line of a list."""
    return F.format_string("- %s %s %s (score: %.2f)", "subject", "predicate", "object", "score") if score else F.format_string("- %s %s %s", "subject", "predicate", "object")
