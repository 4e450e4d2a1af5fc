"""Near-duplicates by BagMinHash signatures, bands and exact multiset overlap.

A text is the multiset of its word shingles. The weight axis of a shingle is cut into [0, 1), [1, 2), [2, 4), [4, 8)
and so on, each with its own Poisson process of points in time whose rate is its width; a point has a uniform weight
level and a uniform slot. A text with weight w sees the points below w, and each slot keeps its first time: two texts
agree in a slot with the probability of their weighted Jaccard similarity. Processes stop when they pass the text's
last slot, so long texts need few points a shingle.

Texts that agree in all slots of a band share a bucket. In each bucket one member, the pivot, is compared exactly
with the others; linked texts merge into components. Members that cannot be similar to anything else in the bucket
leave it: a shingle that no other open text holds is shared with none, which bounds a text's overlap. What a bucket
still has in different components gets another pivot, the member with most links. After ROUNDS more pivots the texts that
are still open are joined by their rarest shingles: all texts sort their shingles alike, the rarer first, and two
texts whose first common shingle comes late in either have too little left to share. So every link that bands
propose and that would join two components is tested, without the pairs within a bucket or a component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textkiln.llm.common import bitmap, discard, in_bitmap, materialise, mix64, slices, text_key
from textkiln.llm.components import components

WORDS, SIMILARITY = 5, 0.8
#: A pair of similarity 0.8 shares none of 32 bands of 4 slots with a probability of 5e-8.
BANDS, ROWS = 32, 4
ROUNDS = 1
#: The levels by which shingles count as rare: more holders than these among the open texts. Any would be right.
HOLDERS = (1, 3, 8, 32, 256)
#: A pivot's partners are dealt into parts of about this many.
PARTNERS = 512
#: Bits of the bitmap of texts that have candidates; 4 MB.
BITS = 1 << 25
#: Bytes of text that are hashed into shingles at a time.
SLICE = 2 << 20
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_LOW64 = (1 << 64) - 1


def shingles(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle hash, count), by text, then hash. A text of fewer words is one shingle; of none, none."""
    cut = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pc.fill_null(texts, "")))
    n = pc.list_value_length(cut).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = cut.flatten().dictionary_encode()
    codes = np.array([xxhash.xxh64_intdigest(w) for w in flat.dictionary.to_pylist()], np.uint64)
    empty = codes == xxhash.xxh64_intdigest("")
    w = codes[flat.indices.to_numpy()] if len(flat) else np.zeros(0, np.uint64)
    own = np.repeat(np.arange(len(n)), n)
    if empty.any():
        w, own = w[~empty[flat.indices.to_numpy()]], own[~empty[flat.indices.to_numpy()]]
        n = np.bincount(own, minlength=len(n))
    ends = np.cumsum(n)
    h = np.zeros(len(w), np.uint64)
    at = np.arange(len(w))
    left = ends[own] - at if len(w) else at
    for k in range(words):
        x = np.where(left > k, np.concatenate([w[k:], np.zeros(min(k, len(w)), np.uint64)]), np.uint64(0))
        h = mix64(h * GOLDEN + x)
    keep = (left >= words) | (at == (ends - n)[own]) if len(w) else np.zeros(0, bool)
    own, h = own[keep], h[keep]
    order = np.lexsort((h, own))
    own, h = own[order], h[order]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(own) != 0) | (np.diff(h) != 0)])) if len(h) else np.zeros(0, np.int64)
    return own[new], h[new], np.diff(np.append(new, len(h)))


def signatures(own: np.ndarray, items: np.ndarray, counts: np.ndarray, n_texts: int, slots: int = BANDS * ROWS) -> np.ndarray:
    """A row of first times for each text; infinite for texts without items."""
    sig = np.full((n_texts, slots), np.inf)
    levels = np.ceil(np.log2(np.maximum(counts, 1))).astype(np.int64) + 1  # pieces of the weight axis below the count
    level = np.arange(levels.sum()) - np.repeat(np.cumsum(levels) - levels, levels)
    row, seed = np.repeat(own, levels), mix64(np.repeat(items, levels) + mix64(level.astype(np.uint64) + np.uint64(1)))
    low = np.where(level > 0, 1 << np.maximum(level - 1, 0), 0).astype(float)
    width, weight, t = np.maximum(low, 1.0), np.repeat(counts, levels), np.zeros(len(row))
    flat, k = sig.reshape(-1), 0
    while len(row):
        k += 1
        a = mix64(seed + np.uint64(k * int(GOLDEN) & _LOW64))
        b = mix64(a ^ GOLDEN)
        t = t - np.log1p(-(a >> np.uint64(11)).astype(float) * 2.0**-53) / width
        ok = low + width * (b >> np.uint64(32)).astype(float) * 2.0**-32 < weight
        slot = ((b & np.uint64(0xFFFFFFFF)) * np.uint64(slots)) >> np.uint64(32)
        np.minimum.at(flat, (row * slots + slot.astype(np.int64))[ok], t[ok])
        on = t < sig.max(1)[row]
        row, seed, low, width, weight, t = row[on], seed[on], low[on], width[on], weight[on], t[on]
    return sig


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a distinct text of a slice: its hash and its bucket numbers (none without words)."""
    for batch in batches:
        for part in slices(batch, "text", SLICE):
            h1 = part.column("h1").to_numpy()
            distinct, first = np.unique(h1, return_index=True)
            own, items, counts = shingles(part.column("text").take(pa.array(first)))
            sig = signatures(own, items, counts, len(first)).view(np.uint64).reshape(-1, BANDS, ROWS)
            h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(first), BANDS)).copy()
            for r in range(ROWS):
                h = mix64(h * GOLDEN + sig[:, :, r])
            some = np.bincount(own, minlength=len(first)) > 0
            b = [x if s else [] for x, s in zip(h.view(np.int64), some, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(distinct), pa.array(b, pa.list_(pa.int64()))], ["node", "buckets"])


def _fetched(bits):
    """The texts that may have candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            may = in_bitmap(bits.value, batch.column("h1").to_numpy().view(np.uint64))
            if may.any():
                part = batch.filter(pa.array(may))
                _, first = np.unique(part.column("h1").to_numpy(), return_index=True)
                part = part.take(pa.array(first))
                yield pa.RecordBatch.from_arrays([part.column("h1"), part.column("text")], ["node", "text"])

    return run


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by pivot and part, the pivot's own text (other is null) first: similarity of the others."""
    key, pivot = None, None
    for batch in batches:
        for part in slices(batch, "text", SLICE):
            own, items, counts = shingles(part.column("text"))
            cut = np.searchsorted(own, np.arange(len(part) + 1))
            out = []
            for i, (p, s, x) in enumerate(zip(part.column("p").to_pylist(), part.column("part").to_pylist(), part.column("x").to_pylist(), strict=True)):
                mine = items[cut[i] : cut[i + 1]], counts[cut[i] : cut[i + 1]]
                if x is None:
                    key, pivot = (p, s), mine
                elif key == (p, s):
                    at = np.searchsorted(pivot[0], mine[0])
                    at[at == len(pivot[0])] = 0
                    same = pivot[0][at] == mine[0] if len(pivot[0]) else np.zeros(len(mine[0]), bool)
                    both = int(np.minimum(pivot[1][at[same]], mine[1][same]).sum())
                    out.append((p, x, both / max(1, int(pivot[1].sum() + mine[1].sum()) - both)))
            cols = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["p", "x", "sim"])


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", SLICE):
            own, items, counts = shingles(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("node").take(pa.array(own)), pa.array(items.view(np.int64)), pa.array(counts.astype(np.int64))], ["node", "item", "n"])


def _bounds(nodes: DataFrame, texts: DataFrame) -> tuple[DataFrame, list]:
    """node, size (shingles) and most (how many of them another of these texts can share); a bitmap of shingles for
    each of HOLDERS."""
    items = texts.join(nodes, "node", "left_semi").mapInArrow(_items, "node long, item long, n long")
    held = items.groupBy("item").agg(F.count(F.lit(1)).alias("held"), F.min("node").alias("node"), F.min("n").alias("n"))
    held = materialise(held, "shingle-holders")
    lone = held.filter("held = 1").groupBy("node").agg(F.sum("n").alias("lone"))
    sizes = items.groupBy("node").agg(F.sum("n").alias("size"))
    out = sizes.join(lone, "node", "left").select("node", "size", (F.col("size") - F.coalesce("lone", F.lit(0))).alias("most"))
    out, levels = materialise(out, "overlap-bounds"), [bitmap(held.filter(F.col("held") > n), "item", BITS) for n in HOLDERS]
    discard(held)
    return out, levels


def _prefixes(levels: list, similarity: float):
    """The shingles with which an overlap of at least similarity * size can begin, except those no other text holds;
    `rest` is the weight from there on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                own, items, counts = shingles(part.column("text"))
                level = sum((in_bitmap(b.value, items).astype(np.int8) for b in levels), np.zeros(len(items), np.int8))
                order = np.lexsort((items, level, own))
                own, items, counts, level = own[order], items[order], counts[order].astype(np.int64), level[order]
                size = np.bincount(own, counts, minlength=len(part)).astype(np.int64)
                rest = np.cumsum(size)[own] - np.cumsum(counts) + counts
                on = (level > 0) & (rest >= similarity * size[own] - 1e-9)
                yield pa.RecordBatch.from_arrays([part.column("node").take(pa.array(own[on])), pa.array(items[on].view(np.int64)), pa.array(rest[on])], ["node", "item", "rest"])

    return run


def _rarest_pairs(nodes: DataFrame, texts: DataFrame, levels: list, similarity: float) -> DataFrame:
    """p, x of all pairs of nodes (node, comp, size, most) in different components that can be similar.

    `up` is the largest size with which what an entry has left to share is enough; the smaller text of a pair needs
    up >= its own size, so it brings fewer entries.
    """
    begun = texts.join(nodes.select("node"), "node", "left_semi").mapInArrow(_prefixes(levels, similarity), "node long, item long, rest long")
    up = F.least("rest", "most") * (1 + similarity) / similarity - F.col("size") + 1e-6
    entries = materialise(begun.join(nodes, "node").withColumn("up", up).select("item", "node", "comp", "size", "up"), "rarest-shingles")
    smaller = entries.filter("up >= size")
    seen = entries.groupBy("item").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("up").alias("reach")).filter("lo < hi")
    least = smaller.groupBy("item").agg(F.min("size").alias("least"), F.max("up").alias("far"))
    useful = seen.join(least, "item").select("item", "reach", "least", "far")
    left = smaller.join(useful, "item").filter("size <= reach").select("item", *(F.col(c).alias(f"{c}_s") for c in ("node", "comp", "size", "up")))
    right = entries.join(useful, "item").filter("up >= least and size <= far").select("item", "node", "comp", "size", "up")
    both = left.join(right, "item").filter("comp <> comp_s and size <= up_s and size_s <= up and (size_s < size or size_s = size and node_s < node)")
    out = materialise(both.select(F.col("node").alias("p"), F.col("node_s").alias("x")).distinct(), "rarest-pairs")
    discard(entries)
    return out


def _may(similarity: float, size, most, other_size, other_most=None):
    """Whether an overlap of the least of most and other_most can reach the similarity."""
    o = F.least(most, other_size) if other_most is None else F.least(most, other_most)
    return o * (1 + similarity) >= (size + other_size) * similarity - 1e-9


def _verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """p, x, sim of pairs (p, x). Each x is sent once a pair; a pivot once a part, so many partners mean many tasks."""
    n = pairs.groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    dealt = pairs.join(n, "p").withColumn("part", F.pmod(F.xxhash64("x"), F.ceil(F.col("n") / PARTNERS)).cast("int")).select("p", "part", "x")
    heads = dealt.select("p", "part").distinct().join(texts.withColumnRenamed("node", "p"), "p").select("p", "part", F.lit(None).cast("long").alias("x"), "text")
    rest = dealt.join(texts.withColumnRenamed("node", "x"), "x").select("p", "part", "x", "text")
    return heads.unionByName(rest).repartition("p", "part").sortWithinPartitions("p", "part", F.col("x").asc_nulls_first()).mapInArrow(_compared, "p long, x long, sim double")


def text_classes(src: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """For texts (h1, text) that are linked to others: node, comp (a component is named by its smallest node); and node,
    n_links: how many other texts a text was tested to be similar to."""
    banded = src.select("h1", "text").mapInArrow(_banded, "node long, buckets array<long>").dropDuplicates(["node"])
    members = banded.select("node", F.explode("buckets").alias("b"))
    shared = members.groupBy("b").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    many = materialise(members.join(shared, "b"), "shared-buckets")
    # The first pivot is the member that meets most others over all bands: near copies' common source, if there is one.
    meets = many.groupBy("node").agg(F.sum("n").alias("meets"))
    pivots = many.join(meets, "node").groupBy("b").agg(F.max(F.struct("meets", "node")).alias("s")).select("b", F.col("s.node").alias("p"))
    members = materialise(many.select("b", "node").join(pivots, "b"), "bucket-members")
    discard(many)
    wanted = members.select("node").distinct()
    bits = bitmap(wanted, "node", BITS)
    texts = src.select("h1", "text").mapInArrow(_fetched(bits), "node long, text string").join(wanted, "node", "left_semi").dropDuplicates(["node"])
    texts = materialise(texts, "candidate-texts")
    pairs = members.filter("node <> p").select("p", F.col("node").alias("x")).distinct()
    scratch = [members, texts, materialise(_verify(pairs, texts), "tested-pairs")]
    tested = scratch[-1]
    linked = lambda: tested.filter(F.col("sim") >= similarity).select(F.col("p").alias("u"), F.col("x").alias("v"))
    several = lambda rest: rest.groupBy("b").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("b")
    comps, bounds, levels = components(linked()), None, []
    for left in range(ROUNDS, -1, -1):
        # What was the pivot is settled; a bucket goes on while the others are in several components.
        rest = members.filter("node <> p").select("b", "node").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        if bounds is None:
            scratch.append(rest := materialise(rest.join(several(rest), "b"), "open-buckets"))
            if rest.isEmpty():
                break
            bounds, levels = _bounds(rest.select("node").distinct(), texts)
            scratch.append(bounds)
        # A text shares at most `most` shingles, and most with a text of just these; the least one here is nearest.
        rest = rest.join(bounds, "node")
        sizes = rest.groupBy("b").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("size").alias("least")).filter("lo < hi").select("b", "least")
        rest = rest.join(sizes, "b").filter(_may(similarity, F.col("size"), F.col("most"), F.greatest("least", "most"))).drop("least")
        scratch.append(rest := materialise(rest, "open-members"))
        scratch.append(rest := materialise(rest.join(several(rest), "b"), "open-buckets"))
        if rest.isEmpty():
            break
        if left:
            degree = linked().select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("links"))
            rank = F.struct(F.coalesce("links", F.lit(0)).alias("links"), F.xxhash64("node").alias("h"), "node", "comp", "size", "most")
            best = rest.join(degree, "node", "left").groupBy("b").agg(F.max(rank).alias("s"))
            members = rest.join(best.select("b", F.col("s.node").alias("p"), F.col("s.comp").alias("own"), F.col("s.size").alias("p_size"), F.col("s.most").alias("p_most")), "b")
            members = materialise(members, "bucket-members")
            scratch.append(members)
            near = _may(similarity, F.col("size"), F.col("most"), F.col("p_size"), F.col("p_most"))
            pairs = members.filter("comp <> own").filter(near).select("p", F.col("node").alias("x"))
        else:
            pairs = _rarest_pairs(rest.select("node", "comp", "size", "most").distinct(), texts, levels, similarity)
            scratch.append(pairs)
        ordered = {"u": F.least("p", "x"), "v": F.greatest("p", "x")}
        done = tested.withColumns(ordered).select("u", "v").distinct()
        pairs = pairs.withColumns(ordered).dropDuplicates(["u", "v"]).join(done, ["u", "v"], "left_anti").select("p", "x")
        scratch.append(new := materialise(_verify(pairs, texts), "tested-pairs"))
        tested = tested.unionByName(new)
        if not new.filter(F.col("sim") >= similarity).isEmpty():
            comps = components(linked())
    degree = linked().select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    degree = materialise(degree, "text-links")
    discard(*scratch)
    return comps, degree


def _classes(src: DataFrame, similarity: float) -> DataFrame:
    """h1 of every text with its class: class_id, class_size, n_links, the text it is named for (of), the rows of that
    text with that id (same)."""
    comps, degree = text_classes(src, similarity)
    comps = comps.join(degree, "node").withColumnRenamed("node", "h1")
    rows = src.groupBy("h1", "doc_id").agg(F.count(F.lit(1)).alias("n")).groupBy("h1").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "n")).alias("s"), F.sum("n").alias("n"))
    rows = rows.join(comps, "h1", "left").withColumn("comp", F.coalesce("comp", "h1"))
    least = F.min(F.struct("s.none", "s.doc_id", "h1", "s.n"))
    classes = rows.groupBy("comp").agg(least.alias("s"), F.sum("n").alias("class_size"))
    classes = classes.select("comp", F.col("s.doc_id").alias("class_id"), "class_size", F.col("s.h1").alias("of"), F.col("s.n").alias("same"))
    links = F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
    out = materialise(rows.select("h1", "comp", links).join(classes, "comp").drop("comp"), "classes")
    discard(degree)
    return out


def _hashed(docs: DataFrame) -> DataFrame:
    """docs with h1, a number that stands for the text (null like empty).

    It is a 64-bit hash. Different texts that share it are told apart by a second one, and get a number made from both.
    """
    h1, h2 = text_key()
    docs = docs.drop("class_id", "class_size", "n_links", "h1", "h2").withColumns({"h1": h1, "h2": h2})
    clash = docs.groupBy("h1").agg(F.min("h2").alias("lo"), F.max("h2").alias("hi")).filter("lo <> hi").select("h1", F.lit(True).alias("clash"))
    if clash.isEmpty():
        return docs.drop("h2")
    clash = materialise(clash, "hash-clashes")
    return docs.join(clash, "h1", "left").withColumn("h1", F.when(F.col("clash"), F.xxhash64(F.lit("both"), "h1", "h2")).otherwise(F.col("h1"))).drop("h2", "clash")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs' columns and class_id (the smallest doc_id of the class), class_size (its rows), n_links (the other texts
    that the document's was tested to be similar to: at least one unless its class is of one text).

    Equal texts are one class whatever they hold; texts without words are alike only when equal. Words are what white
    space separates. Null text is empty; an empty table stays empty. Ids may repeat or be null; a class without any id
    has a null class_id. Columns of docs named like an output, h1 or h2 are replaced.
    """
    src = _hashed(docs)
    return src.join(_classes(src, similarity).drop("of", "same"), "h1").drop("h1")


def representatives(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row of docs for each class of near_duplicates: its smallest id's (of equal rows, any one)."""
    src = _hashed(docs)
    classes = _classes(src, similarity)
    named = classes.filter("h1 = of").select("h1", F.col("class_id").alias("own_id"), "same")
    kept = src.join(named, "h1").filter(F.col("doc_id").eqNullSafe(F.col("own_id")))
    if not named.filter("same > 1").isEmpty():
        kept = kept.dropDuplicates(["h1"])
    return kept.select(*docs.columns)
