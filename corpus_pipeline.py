"""From documents to packed training sequences: language, lines, near-duplicates, benchmarks, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again for the
next. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textkiln.llm import decontamination, language_id, line_dedup, minhash_dedup, packing
from textkiln.llm.common import materialise, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document goes if noise makes its n-grams, on average, likelier than its language does by more than a factor of e.
LEAST_FIT = -1.0


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in none of the languages of the corpus go; those without a `lang` get the predicted one.

    The model is fitted on all documents with a `lang`. A document goes if it has no letter (or its text is null), or if
    noise, all n-gram buckets being as likely, explains its text better than the likeliest language does, by LEAST_FIT.
    A `lang` that a document has stays, whatever is predicted. Where no document has one, there is nothing to learn from:
    it stays null, and every document with a letter stays. Ids are not used, so null and repeated ones and repeated rows
    are documents like others; an empty table stays empty; columns beyond those of documents go.
    """
    model = language_id.train(docs)
    docs = docs.select(*COLUMNS)
    if not model.labels:
        return docs.filter(language_id.has_letter(F.col("text")))
    found = language_id.predict(docs, model).filter((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("fit") >= LEAST_FIT))
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in at least ten documents go from all of them; every document stays, n_chars follows its text.

    A null text becomes empty. Ids are not used; every row is a document, repeated ones too. Empty stays empty.
    """
    kept = line_dedup.drop_frequent_lines(docs.select(*COLUMNS)).withColumn("text", F.col("kept"))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays; ids that are null come last.

    Of rows with one id the one whose text has the smaller hash stays, of equal rows any one. Null texts are empty, and
    empty texts are alike. An empty table stays empty.
    """
    return minhash_dedup.representatives(docs.select(*COLUMNS)).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go.

    A null text holds none; null items are left out, and an empty benchmark removes nothing. Ids are not used; repeated
    rows are judged alike; an empty table stays empty.
    """
    found = decontamination.contamination(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    return found.filter(F.size("hits") == 0).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a piece of a document in a sequence, as op2 returns them.

    A null or empty text is its end token alone. Repeated rows and ids are packed each for themselves; null ids stay
    null. An empty table gives no rows.
    """
    p = packing.pack(docs)
    return p.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: Signatures, n-gram models and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, f"pipeline-{name}")
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
