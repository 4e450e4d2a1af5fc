"""Removal of byte strings that occur earlier in the corpus, by longest previous factors.

Two equal strings of `length` bytes hold the same least hash of their GRAM-byte substrings, an anchor, at the same
place. So it is enough to look at each anchor with its context, as far as such a string can reach around it:
1. Of equal texts only the first is looked at; the others are covered wholly.
2. Anchors are counted; a bitmap lets through those met more than once.
3. Where all contexts of an anchor are equal, the first one is the leader, the smallest position of a run of equal
   suffixes; the others have it as an earlier match and are covered.
4. Different contexts of one anchor meet in a task. It puts the suffixes of their contexts in suffix order, marks which neighbours
   share `length` bytes, finds each suffix's previous and next smaller position in that order, and from them its
   longest previous factor. Where that reaches `length`, the string is covered.
An anchor with more contexts than a task takes is halved: the strings that begin in the nearer half before it and those
that begin in the farther one, each with a narrower window of the context and keyed by the bytes that all of its strings
hold. Equal windows fall together again, as in 3. Halves are halved until they fit; in the last ones all are equal.
The covered ranges are then cut out of the documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textkiln.llm.common import bitmap, bits_for, discard, extended, in_bitmap, materialise, mix64, raw_bytes, schema_with, slices, text_key

LENGTH, GRAM = 100, 32
#: Positions that are hashed at a time.
BLOCK = 1 << 18
#: A string of LENGTH bytes begins at most so many bytes before its anchor.
SPAN = LENGTH - GRAM
#: Contexts of one anchor that one task compares (with 70 suffixes each, about 100 MB); and contexts whose suffixes are
#: sorted together.
MOST, CHUNK = 32_768, 8192
FACTOR = 0x9E3779B97F4A7C15
_rng = np.random.default_rng(0x5EED)
BYTE_CODES = _rng.integers(0, 1 << 63, 256, np.uint64)


def gram_hashes(b: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A hash of the gram bytes (a power of two) from each position."""
    h, n = BYTE_CODES[b], 1
    while n < gram:
        h = h[:-n] * np.uint64(pow(FACTOR, n, 1 << 64)) + h[n:] if len(h) > n else h[:0]
        n *= 2
    return h


def _sliding(x: np.ndarray, n: int, least) -> np.ndarray:
    """The least (np.minimum) or largest of each n neighbours."""
    w = 1
    while 2 * w <= n:
        x = least(x[:-w], x[w:])
        w *= 2
    return least(x[: len(x) - (n - w)], x[n - w :]) if n > w else x


def anchors(b: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the anchors in texts laid end to end, their hashes, and the number of their text."""
    span = length - gram  # a string of `length` bytes has span + 1 grams
    at, hs = [], []
    for lo in range(0, len(b), BLOCK):
        start = max(0, lo - span)
        part = b[start : lo + BLOCK + length]
        h = mix64(gram_hashes(part, gram))
        if len(h) <= span:
            continue
        least = _sliding(h, span + 1, np.minimum)
        first = np.arange(start, start + len(least))
        doc_end = offsets[np.searchsorted(offsets, first, "right")]
        least = np.where(first + length <= doc_end, least, 0)
        most = _sliding(np.concatenate([np.zeros(span, np.uint64), least, np.zeros(span, np.uint64)]), span + 1, np.maximum)
        hit = np.flatnonzero(most[: len(h)] == h)
        hit = hit[(hit + start >= lo) & (hit + start < lo + BLOCK)]
        at.append(hit + start)
        hs.append(h[hit])
    pos = np.concatenate(at) if at else np.zeros(0, np.int64)
    return pos, np.concatenate(hs) if hs else np.zeros(0, np.uint64), np.searchsorted(offsets, pos, "right") - 1


def _without(part: pa.RecordBatch, copied) -> pa.RecordBatch:
    """Leaves out the texts that may have copies; these are read from a table of first ones."""
    return part if copied is None else part.filter(pa.array(~in_bitmap(copied.value, part.column("h1").to_numpy(zero_copy_only=False).view(np.uint64))))


def _counts(copied):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(_without(batch, copied), "text"):
                h, n = np.unique(anchors(*raw_bytes(part.column("text")))[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["a", "n"])

    return run


def _occurrences(copied, met, mixed=None, ctx: bool = False):
    """The anchors in the bitmap `met`: hash a, hash c of the context, its place. Without mixed, equal contexts of a slice
    give one row, the first, and their number. With it, only anchors that aren't in that bitmap, or, with ctx, those that
    are, and their contexts' bytes, which only the first of equal ones in a slice has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(_without(batch, copied), "text"):
                b, offsets = raw_bytes(part.column("text"))
                pos, a, doc = anchors(b, offsets)
                may = in_bitmap(met.value, a)
                if mixed is not None:
                    may &= in_bitmap(mixed.value, a) == ctx
                pos, a, doc = pos[may], a[may], doc[may]
                start, end = offsets[doc], offsets[doc + 1]
                lo, hi = np.maximum(pos - (LENGTH - GRAM), start), np.minimum(pos + LENGTH, end)
                h, c = gram_hashes(b), (pos - lo).astype(np.uint64) * np.uint64(FACTOR) + (hi - pos).astype(np.uint64)
                for k, shift in enumerate((*range(GRAM - LENGTH, LENGTH - GRAM, GRAM), LENGTH - GRAM)):  # together they cover it
                    c = mix64(c + h[np.clip(pos + shift, lo, hi - GRAM)] + np.uint64(k)) if len(c) else c
                ids, h1 = part.column("doc").to_numpy(zero_copy_only=False)[doc], part.column("h1").to_numpy(zero_copy_only=False)[doc]
                cols = {"a": a.view(np.int64), "c": c.view(np.int64), "doc": ids, "h1": h1, "lo": lo - start, "len": (hi - lo).astype(np.int32), "at": (pos - lo).astype(np.int32)}
                order = np.lexsort((cols["lo"], h1, ids, cols["c"], cols["a"])) if mixed is None or ctx else np.zeros(0, np.int64)
                new = np.ones(len(order), bool)
                new[1:] = (np.diff(cols["a"][order]) != 0) | (np.diff(cols["c"][order]) != 0)
                if mixed is None:
                    cols = {k: v[order[new]] for k, v in cols.items()} | {"n": np.diff(np.append(np.flatnonzero(new), len(order)))}
                out = {k: pa.array(v) for k, v in cols.items()}
                if ctx:
                    raw, first = b.tobytes(), np.zeros(len(order), bool)
                    first[order[new]] = True
                    out["ctx"] = pa.array([raw[x:y] if f else None for x, y, f in zip(lo.tolist(), hi.tolist(), first.tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    return run


PLACE = "a long, c long, doc long, h1 long, lo long, len int, at int"
RANGES = "doc long, h1 long, start long, end long"


def _maybe_copied(copied):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_bitmap(copied.value, batch.column("h1").to_numpy(zero_copy_only=False).view(np.uint64))))

    return run


def _previous(place: np.ndarray, lcp: np.ndarray, least: int) -> np.ndarray:
    """What each suffix shares with the nearest one before it in suffix order that has a smaller place.

    Pointers start at the neighbour. While what they point to is no smaller, they take over its pointer, and the least
    common prefix on the way; a way that has sunk below `least` is left.
    """
    to, shared = np.arange(len(place)) - 1, lcp.copy()
    on = np.flatnonzero((shared >= least) & (to >= 0))
    while len(on):
        on = on[place[to[on]] >= place[on]]
        via = to[on]
        to[on], shared[on] = to[via], np.minimum(shared[on], shared[via])
        on = on[(shared[on] >= least) & (to[on] >= 0)]
    return np.where((to >= 0) & (place[to] < place), shared, 0)


def previous_factors(place: np.ndarray, lcp: np.ndarray, least: int = LENGTH) -> np.ndarray:
    """The lengths of the longest previous factors of suffixes: place has their positions in suffix order, lcp what each
    shares with the one before it there (the first: 0). Lengths below `least` may be put too low."""
    after = np.concatenate([np.zeros(min(1, len(lcp)), lcp.dtype), lcp[:0:-1]])
    return np.maximum(_previous(place, lcp, least), _previous(place[::-1], after, least)[::-1])


def _frame(ctx: list[bytes], at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Contexts as rows of bytes, their anchors one below the other in column SPAN; zeros where a context has ended."""
    m = np.zeros((len(n), SPAN + LENGTH), np.uint8)
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    m.reshape(-1)[np.repeat(np.arange(len(n)) * (SPAN + LENGTH) + SPAN - at, n) + step] = np.frombuffer(b"".join(ctx), np.uint8)
    return m


def covered(group: np.ndarray, m: np.ndarray, left: np.ndarray, right: np.ndarray, place: np.ndarray) -> np.ndarray:
    """For each context and each number of bytes e before the anchor: whether the string that begins there has a longest
    previous factor of LENGTH or more among its group. left and right: how far contexts reach from the anchor's start.

    Strings that begin e bytes before the anchor can only be equal to such that do so too. Their suffix order follows
    from that of e - 1 by one stable sort by the byte that comes in front.
    """
    k, words = len(group), np.ascontiguousarray(np.pad(m[:, SPAN:], ((0, 0), (0, -LENGTH % 8)))).view(">u8")
    order = np.lexsort((*words.T[::-1], group))  # by what follows the anchor's start
    after = m[order][:, SPAN:]
    differ = after[1:] != after[:-1]
    same = np.where(differ.any(1), differ.argmax(1), LENGTH)
    same = np.concatenate([[0], np.where(group[order][1:] == group[order][:-1], same, 0)])
    rank = np.empty(k, np.int64)
    rank[order] = np.arange(k)
    before, rows, levels, lcps = group, [], [], []
    for e in range(SPAN + 1):
        if e:  # one byte more in front: `before` numbers what is equal in front of the anchor
            key = before * 256 + m[:, SPAN - e]
            order = order[np.argsort((group * 256 + m[:, SPAN - e])[order], kind="stable")]
            before = np.empty(k, np.int64)
            before[order] = np.cumsum(np.concatenate([[0], np.diff(key[order]) != 0]))
        own = order[(left[order] >= e) & (right[order] >= LENGTH - e)]
        if len(own) > 1:
            tail = np.cumsum(same < LENGTH - e)[rank[own]]  # numbers what is equal from the anchor on
            equal = (np.diff(before[own]) == 0) & (np.diff(tail) == 0)
            rows.append(own)
            levels.append(np.full(len(own), e))
            lcps.append(np.concatenate([[0], np.where(equal, LENGTH, 0)]))
    out = np.zeros((k, SPAN + 1), bool)
    if rows:
        row, level = np.concatenate(rows), np.concatenate(levels)
        hit = previous_factors(place[row], np.concatenate(lcps)) >= LENGTH
        out[row[hit], level[hit]] = True
    return out


def _solved(t: pa.Table) -> pa.RecordBatch:
    equal = t.filter(pc.is_null(t.column("ctx")))  # an earlier one of their slice is equal
    t = t.filter(pc.is_valid(t.column("ctx")))
    doc, h1, lo, n, at = (t.column(x).to_numpy().astype(np.int64) for x in ("doc", "h1", "lo", "len", "at"))
    key = t.column("a").to_numpy()
    group = np.cumsum(np.concatenate([np.zeros(min(1, len(key)), np.int64), key[1:] != key[:-1]])).astype(np.int64)
    by = np.lexsort((lo + at, h1, doc))
    place = np.empty(len(by), np.int64)
    place[by] = np.cumsum(np.concatenate([np.zeros(min(1, len(by))), (np.diff((lo + at)[by]) != 0) | (np.diff(h1[by]) != 0) | (np.diff(doc[by]) != 0)]))
    hit = covered(group, _frame(t.column("ctx").to_pylist(), at, n), at, n - at, place) if len(key) else np.zeros((0, SPAN + 1), bool)
    edge = np.diff(np.pad(hit, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, first = np.nonzero(edge == 1)
    _, last = np.nonzero(edge == -1)
    found = (doc[row], h1[row], (lo + at)[row] - (last - 1), (lo + at)[row] - first + LENGTH)
    start = equal.column("lo").to_numpy()
    more = (equal.column("doc").to_numpy(), equal.column("h1").to_numpy(), start, start + equal.column("len").to_numpy())
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(found, more, strict=True)], [x.split()[0] for x in RANGES.split(", ")])


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by anchor; whole anchors are compared together, CHUNK contexts or a little more at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(len(x) for x in held) >= CHUNK:
            t = pa.Table.from_batches(held).combine_chunks()
            a = t.column("a").to_numpy()
            cut = int(np.flatnonzero(a == a[-1])[0])  # the last anchor may go on
            ends, at = np.append(np.flatnonzero(np.diff(a)) + 1, len(a)), 0
            while at < cut:
                to = min(int(ends[np.searchsorted(ends, min(at + CHUNK, cut))]), cut)
                yield _solved(t.slice(at, to - at))
                at = to
            held = t.slice(cut).to_batches()
    if held and sum(len(x) for x in held):
        yield _solved(pa.Table.from_batches(held).combine_chunks())


def halves(low: int, high: int) -> list[tuple[int, int]]:
    middle = (low + high) // 2
    return [(x, y) for x, y in ((low, middle), (middle, high)) if x < y]


def _halved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each half of a context's range of beginnings (low to high - 1 bytes before the anchor) that holds a
    string: the window of the context that its strings lie in, keyed by the bytes that they all hold."""
    for batch in batches:
        out = []
        for a, low, high, doc, h1, lo, at, ctx in zip(*(batch.column(x).to_pylist() for x in ("a", "low", "high", "doc", "h1", "lo", "at", "ctx")), strict=True):
            for x, y in halves(low, high):
                first, last = max(x, LENGTH - (len(ctx) - at)), min(y - 1, at)
                if first > last:
                    continue
                start, end = at - last, min(len(ctx), at + LENGTH - x)
                window = ctx[start:end]
                core = ctx[at - x : at + LENGTH - y + 1]
                key = xxhash.xxh64_intdigest(a.to_bytes(8, "little", signed=True) + bytes([x, y]) + core)
                c = np.frombuffer(xxhash.xxh3_128_digest(bytes([last]) + window), np.int64)
                out.append((key - (key >> 63 << 64), x, y, int(c[0]), int(c[1]), doc, h1, lo + start, len(window), last, window))
        kinds = [pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * 5, pa.int32(), pa.int32(), pa.binary()]
        cols = list(zip(*out, strict=True)) or [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in WINDOWS.split(", ")])


WINDOWS = "a long, low int, high int, c1 long, c2 long, doc long, h1 long, lo long, len int, at int, ctx binary"


def _split(contexts: DataFrame, hot: DataFrame, most: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Contexts of hot anchors (a, contexts: how many different ones, one at least), as (contexts that a task can take, covered ranges).

    Where only the rows were too many, leaving the first one of equal contexts is enough; else ranges are halved.
    """
    place = F.struct("doc", "h1", "lo", "len", "at", "ctx")
    firsts = contexts.groupBy("a", "c").agg(F.min(place).alias("s")).select("a", "s.*").join(hot, "a")
    firsts = materialise(firsts, "hot-contexts")
    fit, done = [firsts.filter(F.col("contexts") <= most).drop("contexts")], []
    open_ = firsts.filter(F.col("contexts") > most).select("a", "doc", "h1", "lo", "len", "at", "ctx", F.lit(0).alias("low"), F.lit(SPAN + 1).alias("high"))
    while not open_.isEmpty():
        windows = materialise(open_.mapInArrow(_halved, WINDOWS), "hot-windows")
        equal = windows.groupBy("a", "low", "high", "c1", "c2").agg(F.min(place).alias("s"), F.count(F.lit(1)).alias("n"))
        equal = materialise(equal.select("a", "low", "high", "c1", "c2", "s.*", "n"), "hot-leaders")
        led = equal.filter("n > 1").select("a", "c1", "c2", F.col("doc").alias("d0"), F.col("h1").alias("h0"), F.col("lo").alias("l0"))
        again = windows.join(led, ["a", "c1", "c2"]).filter("not (doc = d0 and h1 = h0 and lo = l0)")
        done.append(again.select("doc", "h1", F.col("lo").alias("start"), (F.col("lo") + F.col("len")).alias("end")))
        many = equal.groupBy("a").agg(F.count(F.lit(1)).alias("contexts")).filter(F.col("contexts") > most).select("a")
        fit.append(equal.join(many, "a", "left_anti").select("a", "doc", "h1", "lo", "len", "at", "ctx"))
        open_ = materialise(equal.join(many, "a", "left_semi").select("a", "doc", "h1", "lo", "len", "at", "ctx", "low", "high"), "hot-contexts")
    return fit, done


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            n_bytes, n_removed, n_spans, kept = [], [], [], []
            raw, offsets = raw_bytes(part.column("text"))
            for i, ranges in enumerate(part.column("ranges").to_pylist()):
                b = raw[offsets[i] : offsets[i + 1]]
                if ranges:
                    edge = np.zeros(len(b) + 1, np.int32)
                    np.add.at(edge, [r["start"] for r in ranges], 1)
                    np.add.at(edge, [r["end"] for r in ranges], -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    n_spans.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
                    n_removed.append(int(gone.sum()))
                    b = b[~gone] if n_removed[-1] else b
                else:
                    n_spans.append(0)
                    n_removed.append(0)
                n_bytes.append(int(offsets[i + 1] - offsets[i]))
                kept.append(b.tobytes())
            more = {"n_bytes": pa.array(n_bytes, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "n_spans": pa.array(n_spans, pa.int64()), "kept": pa.array(kept, pa.binary())}
            yield extended(part, more, ("doc", "h1", "ranges"))


def remove_repeats(docs: DataFrame, most: int = MOST) -> DataFrame:
    """docs' columns and n_bytes, n_removed, n_spans, kept (bytes: a cut may fall within a character).

    Strings of LENGTH bytes are removed wherever they also start earlier, by doc_id, then place. Null text is empty;
    a null id comes first; rows with one id and different texts are ordered by a hash of the text; rows equal in both
    count as one document and get the same result. An empty table stays empty. Columns of docs named like an output,
    doc, h1, h2 or ranges go.
    """
    docs = docs.drop("n_bytes", "n_removed", "n_spans", "kept", "doc", "h1", "h2", "ranges")
    src = docs.withColumn("doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))).withColumns(dict(zip(("h1", "h2"), text_key(), strict=True)))
    texts = src.select("doc", "h1", "h2", "text").filter(F.octet_length("text") >= LENGTH)
    # Equal texts (by 128 bits): the first one stands for all, the others are covered from end to end.
    equal = texts.groupBy("h1", "h2").agg(F.min("doc").alias("d0"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("h1", "h2", "d0")
    equal = materialise(equal, "equal-texts")
    copied = bitmap(equal, "h1", bits_for(equal.count()))
    maybe = texts.mapInArrow(_maybe_copied(copied), "doc long, h1 long, h2 long, text string").join(equal, ["h1", "h2"], "left")
    heads = materialise(maybe.filter("d0 is null or doc = d0").select("doc", "h1", "h2", "text").dropDuplicates(["doc", "h1", "h2"]).drop("h2"), "first-texts")
    texts = texts.drop("h2")
    whole = src.select("doc", "h1", "h2", F.octet_length("text").cast("long").alias("end")).filter(F.col("end") >= LENGTH).join(equal, ["h1", "h2"]).filter("doc <> d0").select("doc", "h1", F.lit(0).cast("long").alias("start"), "end")

    def over(make, schema: str) -> DataFrame:
        return texts.mapInArrow(make(copied), schema).unionByName(heads.mapInArrow(make(None), schema))

    counts = over(_counts, "a long, n long").groupBy("a").agg(F.sum("n").alias("n"))
    counts = materialise(counts.filter("n > 1").select("a"), "repeated-anchors")
    met = bitmap(counts, "a", bits_for(counts.count()))
    discard(counts)
    found = over(lambda skip: _occurrences(skip, met), f"{PLACE}, n long").groupBy("a", "c")
    leaders = found.agg(F.min(F.struct("doc", "h1", "lo")).alias("s"), F.sum("n").alias("n"))
    leaders = materialise(leaders.select("a", "c", "s.*", "n"), "repeat-leaders")
    led = leaders.filter("n > 1").select("a", "c", F.col("doc").alias("d0"), F.col("h1").alias("h0"), F.col("lo").alias("l0"))
    # Anchors with different contexts, and what else their bitmap lets through, are compared by their contexts.
    several = leaders.groupBy("a").agg(F.count(F.lit(1)).alias("contexts"), F.sum("n").alias("rows"))
    several = materialise(several.filter((F.col("contexts") > 1) | (F.col("rows") > most)).select("a", "contexts", "rows"), "mixed-anchors")
    mixed = several.filter("contexts > 1")
    mixed = bitmap(mixed, "a", bits_for(4 * mixed.count()))
    again = over(lambda skip: _occurrences(skip, met, mixed), PLACE).join(led, ["a", "c"])
    again = again.filter("not (doc = d0 and h1 = h0 and lo = l0)").select("doc", "h1", F.col("lo").alias("start"), (F.col("lo") + F.col("len")).alias("end"))
    contexts = over(lambda skip: _occurrences(skip, met, mixed, True), f"{PLACE}, ctx binary")
    hot, ranges = materialise(several.filter(F.col("rows") > most).select("a", "contexts"), "hot-anchors"), again.unionByName(whole)
    local = contexts.drop("c")
    if not hot.isEmpty():
        local, own = contexts.join(hot, "a", "left_anti").drop("c"), materialise(contexts.join(hot, "a", "left_semi"), "hot-occurrences")
        fit, done = _split(own.filter("ctx is not null"), hot, most)
        firsts = leaders.join(hot, "a", "left_semi").select("a", "c", F.col("doc").alias("d0"), F.col("h1").alias("h0"), F.col("lo").alias("l0"))
        later = own.select("doc", "h1", "lo", "len", "a", "c").join(materialise(firsts, "hot-firsts"), ["a", "c"])
        done.append(later.filter("not (doc = d0 and h1 = h0 and lo = l0)").select("doc", "h1", F.col("lo").alias("start"), (F.col("lo") + F.col("len")).alias("end")))
        for x in done:
            ranges = ranges.unionByName(x)
        for x in fit:
            local = local.unionByName(x)
    ranges = ranges.unionByName(local.repartition("a").sortWithinPartitions("a").mapInArrow(_local, RANGES))
    ranges = ranges.distinct().groupBy("doc", "h1").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))
    return src.join(ranges, ["doc", "h1"], "left").drop("h2").select(*docs.columns, "doc", "h1", "ranges").mapInArrow(_cut, schema_with(docs, "n_bytes long, n_removed long, n_spans long, kept binary"))
