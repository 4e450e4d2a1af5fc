"""Exact top-k search by inner product: a Voronoi join.

Pivots are vectors of the table, about the square root of its rows. Every vector and every query joins the group of the
pivot with the smallest angle. A group's summary is a ring: the least and the largest angle between its members and the
pivot, and their least and largest norm. By the triangle inequality of angles it bounds the products of a query with
the members. A query is first solved in its own group; its k-th best score there, or what the lower bounds of all groups
guarantee, is its threshold. Other groups get the query only if their upper bound reaches it, and a vector is sent only
if its own angle is in the range that some query of its group needs. Each task solves a block of vectors and a block of
queries, both of bounded size however large a group is; of its vectors, sorted by angle, a query looks at its range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textkiln.llm.common import materialise

#: The most pivots; the matrix of pivots is broadcast (4096 x 1024 dimensions: 32 MB). More would prune more.
PIVOTS = 4096
DATA_BLOCK, QUERY_BLOCK = 4096, 1024
#: Inner products below this are exact in doubles; above, whole numbers of any size are used.
EXACT = 2.0**53
LONG = 2**63 - 1
#: For rounding: angles, and shares of the largest possible product.
ANGLE_SLACK, SLACK = 1e-5, 1e-9


def integer_vectors(df: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id and v: floor(scale * x) of every component, for rows with an id and only finite components."""
    e = F.col("embedding")
    ok = F.col("vec_id").isNotNull() & e.isNotNull() & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    # From 2^53 on doubles are whole numbers; floor() would cut them to 64 bits.
    floor = lambda x: F.when(F.abs(x) < EXACT, F.floor(x).cast("double")).otherwise(x)
    return df.filter(ok).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(e, lambda x: floor(x.cast("double") * scale)).alias("v"))


def _matrix(vectors: list, dim: int) -> np.ndarray:
    """Rows of equal length; shorter vectors end in zeros."""
    if vectors and all(len(v) == dim for v in vectors):
        return np.array(vectors, np.float64).reshape(len(vectors), dim)
    out = np.zeros((len(vectors), dim))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact products of whole vectors: of type int64, or, where that may not hold them, Python's whole numbers."""
    with np.errstate(over="ignore"):
        most = np.sqrt((q**2).sum(1).max(initial=0)) * np.sqrt((x**2).sum(1).max(initial=0))
    if most < EXACT:
        return (q @ x.T).astype(np.int64)
    exact = np.vectorize(int, otypes=[object])
    return exact(q) @ exact(x).T


def _order_key(score: int) -> str | None:
    """For scores beyond 64 bits a text that sorts like them; among clipped scores it decides."""
    if abs(score) < LONG:
        return None
    digits = str(abs(score))
    if score > 0:
        return f"{len(digits):06d}{digits}"
    return f"{999_999 - len(digits):06d}" + digits.translate(str.maketrans("0123456789", "9876543210"))


def _norms(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.sqrt((x**2).sum(1))


def _angles(x: np.ndarray, norms: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Angles between rows and unit pivots; 0 for zero rows, NaN where numbers are too large."""
    with np.errstate(invalid="ignore", over="ignore"):
        return np.arccos(np.clip((x / np.where(norms > 0, norms, 1)[:, None]) @ pivots.T, -1, 1)) * (norms > 0)[:, None]


def _assign(pivots: np.ndarray, dim: int):
    """Adds each vector's group, its angle from the pivot and its norm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), DATA_BLOCK):
                part = batch.slice(at, DATA_BLOCK)
                x = _matrix(part.column("v").to_pylist(), dim)
                norm = _norms(x)
                angles = _angles(x, norm, pivots)
                group = np.argmin(np.where(np.isnan(angles), np.inf, angles), axis=1)
                own = angles[np.arange(len(x)), group]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(group, pa.int32()), pa.array(own), pa.array(norm)], [*part.schema.names, "grp", "angle", "norm"])

    return run


def upper(norm, angle, low, high, least, most):
    """The largest product of a query (norm, angle from the pivot) with members of a ring (angles low to high, norms
    least to most); NaN where it is not known."""
    with np.errstate(invalid="ignore", over="ignore"):
        c = np.cos(np.maximum(0, np.maximum(angle - high, low - angle) - ANGLE_SLACK))
        return norm * np.where(c >= 0, most, least) * c + SLACK * norm * most + 1e-6


def lower(norm, angle, high, least, most):
    with np.errstate(invalid="ignore", over="ignore"):
        c = np.cos(np.minimum(np.pi, angle + high + ANGLE_SLACK))
        return norm * np.where(c >= 0, least, most) * c - SLACK * norm * most - 1e-6


def _guaranteed(pivots: np.ndarray, rings: np.ndarray, sizes: np.ndarray, k: int, dim: int):
    """Adds the k-th largest product that the lower bounds guarantee a query (-inf if there are fewer vectors)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = _matrix(batch.column("v").to_pylist(), dim)
            norm = _norms(q)
            low = lower(norm[:, None], _angles(q, norm, pivots), rings[1], rings[2], rings[3])
            low = np.where(np.isnan(low) | (sizes == 0), -np.inf, low)
            # Rows with a query's id are none of its candidates, and every group may hold one.
            counts = np.repeat(np.maximum(sizes - 1, 0)[None], len(q), 0)
            order = np.argsort(-low, axis=1, kind="stable")
            reached = np.cumsum(np.take_along_axis(counts, order, 1), axis=1) >= k
            at = order[np.arange(len(q)), np.argmax(reached, axis=1)]
            least = np.where(reached.any(1), low[np.arange(len(q)), at], -np.inf)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least)], [*batch.schema.names, "least"])

    return run


def _needed(pivots: np.ndarray, rings: np.ndarray, sizes: np.ndarray, dim: int):
    """For each query the other groups whose upper bound reaches its threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = _matrix(batch.column("q").to_pylist(), dim)
            norm, least = _norms(q), batch.column("least").to_numpy()
            angles = _angles(q, norm, pivots)
            high = upper(norm[:, None], angles, *(r[None] for r in rings))
            row, group = np.nonzero(~(high < least[:, None]) & (sizes > 0) & (np.arange(len(sizes)) != batch.column("grp").to_numpy()[:, None]))
            # What angles a member must have: its product is at most norm * most * cos(difference).
            with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
                share = (least[row] - 1e-6) / (norm[row] * rings[3][group]) - SLACK
                reach = np.where(share > 0, np.arccos(np.clip(share, -1, 1)), np.pi) + ANGLE_SLACK
                reach = np.where(np.isnan(reach) | np.isnan(angles[row, group]), 2 * np.pi, reach)
            a = np.nan_to_num(angles[row, group])
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch.column("query_id").take(at), batch.column("q").take(at), pa.array(group, pa.int32()), pa.array(a - reach), pa.array(a + reach)], ["query_id", "q", "grp", "from", "to"])

    return run


FOUND = "query_id long, vec_id long, score long, beyond string"


def _local(k: int, dim: int):
    """The k best of one block of vectors for one block of queries; equal rows count once."""

    def run(key, queries: pd.DataFrame, data: pd.DataFrame) -> pd.DataFrame:
        out = {c: [] for c in ("query_id", "vec_id", "score", "beyond")}
        if not queries.empty and not data.empty:
            data = data.sort_values("angle", kind="stable", na_position="first")
            ids, x, angle = data["vec_id"].to_numpy(np.int64), _matrix(data["v"].tolist(), dim), data["angle"].to_numpy()
            known = int(np.isnan(angle).sum())  # vectors without an angle are looked at by all
            asks, q = queries["query_id"].to_numpy(np.int64), _matrix(queries["q"].tolist(), dim)
            once = lambda i, m: np.sort(np.unique(np.column_stack([i.astype(np.float64), m]), axis=0, return_index=True)[1]) if len(np.unique(i)) < len(i) else np.arange(len(i))
            at, by = once(ids, x), once(asks, q)
            ids, x, angle, asks, q = ids[at], x[at], angle[at], asks[by], q[by]
            known = min(known, int(np.isnan(angle).sum()))
            lo = np.searchsorted(angle[known:], queries["from"].to_numpy()[by], "left") + known
            hi = np.searchsorted(angle[known:], queries["to"].to_numpy()[by], "right") + known
            for i, a in enumerate(asks):
                may = np.concatenate([np.arange(known), np.arange(lo[i], hi[i])])
                may = may[ids[may] != a]
                if not len(may):
                    continue
                s = _products(q[i : i + 1], x[may])[0]
                if len(may) > k:
                    best = np.flatnonzero(s >= np.sort(s)[-k])
                    may, s = may[best], s[best]
                order = sorted(range(len(may)), key=lambda j: (-s[j], ids[may[j]]))[:k]
                out["query_id"] += [a] * len(order)
                out["vec_id"] += ids[may[order]].tolist()
                out["score"] += [max(-LONG, min(LONG, int(s[j]))) for j in order]
                out["beyond"] += [_order_key(int(s[j])) for j in order]
        return pd.DataFrame({c: pd.Series(v, dtype=object if c == "beyond" else "int64") for c, v in out.items()})

    return run


def _joined(queries: DataFrame, vectors: DataFrame, sizes: dict[int, int], k: int, dim: int, data_block: int, query_block: int) -> DataFrame:
    """The k best of each query (query_id, q, grp, from, to) in each block of the group it names."""
    spark = queries.sparkSession
    need = queries.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.min("from").alias("from"), F.max("to").alias("to")).collect()  # a row a pivot
    blocks = [(r["grp"], max(1, -(-sizes[r["grp"]] // data_block)), max(1, -(-r["n"] // query_block)), r["from"], r["to"]) for r in need if r["grp"] in sizes]
    blocks = F.broadcast(spark.createDataFrame(blocks, "grp int, nd int, nq int, low double, high double"))
    # Each vector that is needed goes to all blocks of its group's queries, each query to all blocks of the group.
    d = vectors.join(blocks, "grp").filter("isnan(angle) or angle between low and high").withColumn("db", F.pmod(F.xxhash64("vec_id"), F.col("nd")).cast("int"))
    d = d.select("grp", "db", F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("qb"), "vec_id", "v", "angle")
    q = queries.join(blocks, "grp").withColumn("qb", F.pmod(F.xxhash64("query_id", F.lit(1)), F.col("nq")).cast("int"))
    q = q.select("grp", F.explode(F.sequence(F.lit(0), F.col("nd") - 1)).alias("db"), "qb", "query_id", "q", "from", "to")
    keys = ["grp", "db", "qb"]
    return q.groupBy(*keys).cogroup(d.groupBy(*keys)).applyInPandas(_local(k, dim), FOUND)


def top_k(data: DataFrame, queries: DataFrame, k: int = 10, pivots: int | None = None, data_block: int = DATA_BLOCK, query_block: int = QUERY_BLOCK, report: dict | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k largest integer inner products, ties to the smaller vec_id.

    data and queries: vec_id, v (as integer_vectors makes them); queries are rows of data, and a row with a query's id
    is none of its candidates. Equal rows (id and vector) count once. Vectors of fewer dimensions end in zeros. Ranks
    follow the exact products; those beyond 64 bits are clipped for the output. No data or queries: no rows. report
    takes how many pairs of query and group there are, and how many of them the bounds keep.
    """
    spark = data.sparkSession
    out = "query_id long, rank int, vec_id long, score long"
    facts = data.agg(F.max(F.size("v")).alias("dim"), F.count(F.lit(1)).alias("n")).first()
    if not facts["n"]:
        return spark.createDataFrame([], out)
    dim, pivots = facts["dim"] or 1, pivots or max(16, min(PIVOTS, round(facts["n"] ** 0.5)))
    p = _matrix([r["v"] for r in data.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).collect()], dim)
    norms = _norms(p)
    p = np.unique(p[(norms > 0) & np.isfinite(norms)] / norms[(norms > 0) & np.isfinite(norms)][:, None], axis=0)
    p = p if len(p) else np.eye(1, dim)
    grouped = "vec_id long, v array<double>, grp int, angle double, norm double"
    # Of equal vectors only the k + 1 smallest ids can be among a query's best; tasks cut them down before the shuffle.
    nth = F.dense_rank().over(Window.partitionBy("v").orderBy("vec_id"))
    few = data.select("vec_id", "v").withColumn("nth", nth).filter(F.col("nth") <= k + 1).drop("nth")
    vectors = materialise(few.mapInArrow(_assign(p, dim), grouped), "knn-vectors")
    rings, sizes = np.zeros((4, len(p))), np.zeros(len(p), np.int64)
    ring = [F.min("angle"), F.max("angle"), F.min("norm"), F.max("norm"), F.countDistinct("vec_id")]
    for g, *own, n in vectors.groupBy("grp").agg(*ring).collect():  # a row a pivot
        rings[:, g], sizes[g] = ([0, np.pi, 0, np.inf] if np.isnan(own[1]) or not np.isfinite(own[3]) else own), n
    held = {g: int(n) for g, n in enumerate(sizes) if n}
    asking = queries.mapInArrow(_assign(p, dim), grouped).mapInArrow(_guaranteed(p, rings, sizes, k, dim), f"{grouped}, least double")
    asking = materialise(asking.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), "grp", "least").distinct(), "knn-queries")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    at_home = asking.select("query_id", "q", "grp", F.lit(float("-inf")).alias("from"), F.lit(float("inf")).alias("to"))
    home = materialise(ranked(_joined(at_home, vectors, held, k, dim, data_block, query_block)).drop("rank"), "knn-home")
    # A query's threshold: its k-th score at home, if that many are there.
    kth = home.groupBy("query_id").agg(F.min("score").cast("double").alias("kth"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k)
    asked = asking.join(kth.select("query_id", "kth"), "query_id", "left").withColumn("least", F.greatest("least", F.coalesce("kth", "least"))).drop("kth")
    away = materialise(asked.mapInArrow(_needed(p, rings, sizes, dim), "query_id long, q array<double>, grp int, from double, to double"), "knn-away")
    if report is not None:
        report.update(pairs=asking.count() * len(held), kept=asking.count() + away.count(), groups=len(held))
    found = home.unionByName(_joined(away, vectors, held, k, dim, data_block, query_block))
    return ranked(found).select("query_id", "rank", "vec_id", "score")
