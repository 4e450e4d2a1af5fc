"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts hashed n-grams of all labelled rows by language (partial sums in the tasks, then one sum a language
and bucket). The matrix of log probabilities has BUCKETS rows whatever the corpus and a column a label; it is broadcast
in blocks of LABELS columns. The n-grams of a batch of texts are one sparse list of matrix rows, which numpy looks up
and sums by text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textkiln.llm.common import discard, extended, materialise, schema_with, slices, texts_of

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
#: Labels of a block of the matrix (64 MB); more labels take a pass over the texts for each block.
LABELS = 256
#: Looked-up numbers that are held at a time.
CELLS = 1 << 21
UNDETERMINED = "und"
_LETTER = re.compile(r"[^\W\d_]")


@dataclass(frozen=True)
class Model:
    labels: list[str]
    #: For each block of labels (BUCKETS + 1) x labels, log P(bucket | label), zeros in the last row; and log P(label).
    weights: list[np.ndarray]
    priors: list[np.ndarray]


def _grams(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """Buckets of all n-grams of texts in lower case, ends marked with blanks: for each order an array with a place a
    character (BUCKETS where the n-gram would pass its text's end), and where each text's characters end."""
    marked = [f" {x.lower()} " for x in texts]
    ends = np.cumsum([len(x) for x in marked])
    c = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32)
    left = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(len(c))
    out, h = [], np.zeros(len(c), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        h = h * np.uint32(0x9E3779B1) + np.concatenate([c[n - 1 :], np.zeros(min(n - 1, len(c)), np.uint32)])
        if n in ORDERS:
            x = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
            out.append(np.where(left >= n, (x >> np.uint32(17)) & np.uint32(BUCKETS - 1), BUCKETS).astype(np.int64))
    return out, ends


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}
    for batch in batches:
        for part in slices(batch, "text"):
            own = part.column("label").to_pylist()
            for label in set(own):
                if label not in sums:
                    sums[label], docs[label] = np.zeros(BUCKETS, np.int64), 0
                texts = [t for t, x in zip(texts_of(part), own, strict=True) if x == label]
                docs[label] += len(texts)
                for x in _grams(texts)[0]:
                    sums[label] += np.bincount(x, minlength=BUCKETS + 1)[:BUCKETS]
    for label, s in sums.items():
        at = np.flatnonzero(s)
        buckets, counts = np.append(at, -1), np.append(s[at], docs[label])  # bucket -1 counts documents
        yield pa.RecordBatch.from_arrays([pa.array([label] * len(buckets), pa.string()), pa.array(buckets, pa.int32()), pa.array(counts, pa.int64())], ["label", "bucket", "n"])


def train(docs: DataFrame, label: str | Column = "lang", text: str = "text", block: int = LABELS) -> Model:
    """Fit on all rows with text and label. No such rows: a model without labels, which answers `und`."""
    rows = docs.select(F.col(text).alias("text"), (F.col(label) if isinstance(label, str) else label).alias("label")).filter("text is not null and label is not null")
    counts = rows.mapInArrow(_count, "label string, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n"))
    counts = materialise(counts, "language-counts")
    sizes = {r["label"]: r["n"] for r in counts.filter("bucket = -1").collect()}
    labels, weights, priors = sorted(sizes), [], []
    for a in range(0, len(labels), block):
        own = labels[a : a + block]
        numbers = F.create_map(*(F.lit(x) for i, v in enumerate(own) for x in (v, i)))
        cells = counts.select(F.try_element_at(numbers, "label").alias("k"), "bucket", "n").filter("k is not null and bucket >= 0").toArrow()
        w = np.zeros((BUCKETS, len(own)))
        w[cells.column("bucket").to_numpy(), cells.column("k").to_numpy()] = cells.column("n").to_numpy()
        w = np.log((w + SMOOTHING) / (w.sum(0) + SMOOTHING * BUCKETS))
        weights.append(np.vstack([w, np.zeros(len(own))]))
        priors.append(np.log(np.array([sizes[x] for x in own]) / sum(sizes.values())))
    discard(counts)
    return Model(labels, weights, priors)


def log_likelihoods(weights: np.ndarray, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For each text a row of log P(text | label), and how many n-grams it has."""
    out, n = np.zeros((len(texts), weights.shape[1])), np.zeros(len(texts), np.int64)
    most = max(1, CELLS // weights.shape[1])
    at = 0
    while at < len(texts):
        to, held = at, 0
        while to < len(texts) and (to == at or held + len(texts[to]) <= most):
            held, to = held + len(texts[to]) + 2, to + 1
        orders, ends = _grams(texts[at:to])
        starts = np.concatenate([[0], ends[:-1]])
        for lo in range(0, int(ends[-1]), most):  # a longer text is summed up piece by piece
            piece = [x[lo : lo + most] for x in orders]
            cut = np.clip(starts, lo, lo + most) - lo
            some = np.flatnonzero((np.clip(ends, lo, lo + most) - lo > cut))
            sums = sum(weights[x] for x in piece)
            out[at + some] += np.add.reduceat(sums, cut[some], axis=0)
            n[at + some] += np.add.reduceat(sum((x < BUCKETS).astype(np.int64) for x in piece), cut[some])
        at = to
    return out, n


def has_letter(text: Column) -> Column:
    """What _LETTER finds, as an expression; null text: false."""
    return F.coalesce(text.rlike(r"[\p{L}\p{Nl}\p{No}]"), F.lit(False))


STATE = "lang_pred string, score double, fit double, _best double, _mass double"


def _scored(shared, labels: list[str], text: str):
    """Take in one block of labels: the likeliest label so far, its log probability, and the log of all mass by n-gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, priors = shared.value
        for batch in batches:
            for part in slices(batch, text):
                texts = texts_of(part, text)
                log, n = log_likelihoods(weights, texts)
                grams, at = np.maximum(n, 1), np.argmax(log + priors, axis=1)
                own = (log + priors)[np.arange(len(texts)), at]
                mean = (log + priors) / np.sqrt(grams)[:, None]
                top = mean.max(1)
                mass = top + np.log(np.exp(mean - top[:, None]).sum(1))
                was = {c: part.column(c) for c in ("lang_pred", "fit", "_best", "_mass")}
                old = {c: was[c].to_numpy(zero_copy_only=False) for c in ("fit", "_best", "_mass")}
                better = own > old["_best"]  # ties stay with the label that sorts first
                label = pa.array(np.array(labels, object)[at], pa.string())
                best, mass = np.where(better, own, old["_best"]), np.logaddexp(old["_mass"], mass)
                fit = np.where(better, log[np.arange(len(texts)), at] / grams + np.log(BUCKETS), old["fit"])
                new = {"lang_pred": pc.if_else(pa.array(better), label, was["lang_pred"]), "score": np.minimum(np.exp(best / np.sqrt(grams) - mass), 1.0), "fit": fit, "_best": best, "_mass": mass}
                none = pa.array([not t or not _LETTER.search(t) for t in texts])
                done = {k: v if isinstance(v, (pa.Array, pa.ChunkedArray)) else pa.array(v, pa.float64()) for k, v in new.items()}
                yield extended(part, {k: pc.if_else(none, was[k] if k in was else part.column(k), v) for k, v in done.items()}, tuple(done))

    return run


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs' columns, lang_pred, score and fit. Null texts and texts without a letter: `und`, 0 and null.

    lang_pred is the likeliest label (ties: the one that sorts first). score, from 0 to 1, is its share of all labels'
    probability, with log probabilities divided by the square root of the number of n-grams, since n-grams that
    overlap are no independent witnesses: undivided, it would be 1 for nearly any text. fit is how much likelier an
    n-gram is on average (log) than if all buckets were as likely: below 0, noise explains the text better than any label.
    Columns of docs with these names are replaced; repeated rows each get their own; an empty table stays empty.
    """
    docs = docs.drop("lang_pred", "score", "fit", "_best", "_mass")
    if not model.labels:
        return docs.withColumns({"lang_pred": F.lit(UNDETERMINED), "score": F.lit(0.0), "fit": F.lit(None).cast("double")})
    lowest = F.lit(float("-inf"))
    out = docs.withColumns({"lang_pred": F.lit(UNDETERMINED), "score": F.lit(0.0), "fit": F.lit(None).cast("double"), "_best": lowest, "_mass": lowest})
    at = 0
    for weights, priors in zip(model.weights, model.priors, strict=True):
        shared = docs.sparkSession.sparkContext.broadcast((weights, priors))
        out = out.mapInArrow(_scored(shared, model.labels[at : at + len(priors)], text), schema_with(docs, STATE))
        at += len(priors)
    return out.drop("_best", "_mass")
