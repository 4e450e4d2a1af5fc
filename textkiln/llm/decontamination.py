"""Benchmark decontamination with one Aho-Corasick automaton.

Test questions and answers are normalised to words; every window of `window` words of an item (all its words, if it
has fewer) is a pattern. A document's text is normalised the same way and scanned once; hits are mapped back to
word numbers and to offsets in the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textkiln.llm.common import discard, extended, materialise, schema_with, slices, texts_of

WINDOW = 10
#: One automaton takes patterns of about so many bytes (0.5 GB in a worker). A larger benchmark is scanned for in
#: blocks, one after another: the rows are written between two passes, so one block is broadcast at a time.
BLOCK_BYTES = 8 << 20

#: Bytes of words stay, A-Z become a-z, other ASCII becomes a blank; bytes from 0x80 on are parts of words.
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
OUT = "n_words long, hits array<struct<start:int,end:int>>, spans array<struct<start:int,end:int>>, items array<long>"
OUTPUTS = ("n_words", "hits", "spans", "items")
_automata: dict[int, tuple[ahocorasick.Automaton, list[list[int]]]] = {}


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split()


def windows_of(text: str, window: int = WINDOW) -> Iterator[bytes]:
    """The windows of a text, one after another: a long item may fill several blocks."""
    w = words_of(text)
    return (b" ".join(w[i : i + window]) for i in range(max(1, len(w) - window + 1))) if w else iter(())


def _blocks(benchmark: DataFrame, window: int, block_bytes: int) -> Iterator[dict[bytes, list]]:
    """The patterns of consecutive items, each with its items' ids, in blocks of bounded size."""
    block, used = {}, 0
    for row in benchmark.select("item_id", "text").filter(F.col("item_id").isNotNull() & F.col("text").isNotNull()).toLocalIterator():
        for w in windows_of(row["text"], window):
            own = block.setdefault(w, [])
            if not own or own[-1] != row["item_id"]:
                own.append(row["item_id"])
                used += len(w)
            if used >= block_bytes:
                yield block
                block, used = {}, 0
    if block:
        yield block


def _automaton(shared) -> tuple[ahocorasick.Automaton, list[list]]:
    """Built once in a worker; the last one is kept."""
    if shared.id not in _automata:
        a, items = ahocorasick.Automaton(), list(shared.value.values())
        for i, w in enumerate(shared.value):
            a.add_word(f" {w.decode('latin-1')} ", (i, w.count(b" ") + 1))
        a.make_automaton()
        _automata.clear()
        _automata[shared.id] = (a, items)
    return _automata[shared.id]


class _Shared:
    def __init__(self, broadcast) -> None:
        self.broadcast, self.id = broadcast, broadcast._jbroadcast.id()

    def __getstate__(self) -> dict:
        return {"broadcast": self.broadcast, "id": self.id}

    @property
    def value(self) -> dict:
        return self.broadcast.value


def _union(intervals: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(intervals):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _char_offsets(text: str, hits: list[list[int]]) -> list[dict]:
    """The code points in text from the first to the last character of each run of words."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    word = np.frombuffer(FOLD, np.uint8)[raw] != 0x20
    starts = np.flatnonzero(word & ~np.concatenate([[False], word[:-1]]))
    ends = np.flatnonzero(word & ~np.concatenate([word[1:], [False]])) + 1
    chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return [{"start": int(chars[starts[a]]), "end": int(chars[ends[b - 1]])} for a, b in hits]


def _scan(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, items = _automaton(shared) if shared is not None else (None, [])
        for batch in batches:
            for part in slices(batch, "text"):
                n_words, hits, spans, found = [], [], [], []
                for text in texts_of(part):
                    flat = b" " + b" ".join(words_of(text)) + b" "
                    n_words.append(flat.count(b" ") - 1 if len(flat) > 2 else 0)
                    at = list(automaton.iter(flat.decode("latin-1"))) if automaton is not None else []
                    if at:  # a match ends at the blank after its last word
                        blanks = np.cumsum(np.frombuffer(flat, np.uint8) == 0x20)
                        own = _union([(int(blanks[end]) - 1 - n, int(blanks[end]) - 1) for end, (_, n) in at])
                        hits.append([{"start": a, "end": b} for a, b in own])
                        spans.append(_char_offsets(text, own))
                        found.append(sorted({x for i in {i for _, (i, _) in at} for x in items[i]}))
                    else:
                        hits.append([])
                        spans.append([])
                        found.append([])
                kinds = {f.name: f.type for f in _ARROW}
                made = {"n_words": n_words, "hits": hits, "spans": spans, "items": found}
                yield extended(part, {k: pa.array(v, kinds[k]) for k, v in made.items()})

    return run


_PAIRS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_ARROW = pa.schema([("n_words", pa.int64()), ("hits", _PAIRS), ("spans", _PAIRS), ("items", pa.list_(pa.int64()))])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs' columns and n_words, hits (runs of hit words), spans (the same in code points), items (ids, ascending).

    Null text has no words; items without id or words are left out; an empty benchmark hits nothing. Hits of several
    blocks are put together. Columns of docs named like an output are replaced.
    """
    docs = docs.drop(*OUTPUTS)
    blocks = _blocks(benchmark, window, block_bytes)
    out = last = shared = None
    for block in blocks:
        src = docs
        if out is not None:
            so_far = materialise(out.withColumnsRenamed({c: f"{c}_so_far" for c in OUTPUTS}), "decontaminated")
            shared.broadcast.destroy()
            if last is not None:
                discard(last)
            src = last = so_far
        shared = _Shared(docs.sparkSession.sparkContext.broadcast(block))
        out = src.mapInArrow(_scan(shared), schema_with(src, OUT))
        if last is not None:
            out = out.withColumns({c: _merged(c) for c in ("hits", "spans")} | {"items": F.array_sort(F.array_union("items_so_far", "items"))})
            out = out.drop(*(f"{c}_so_far" for c in OUTPUTS))
    return docs.mapInArrow(_scan(None), schema_with(docs, OUT)) if out is None else out


def _merged(name: str):
    kind = "array<struct<start:int,end:int>>"

    def step(acc, x):
        last = F.element_at(acc, -1)
        joins = (F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1)["end"] >= x["start"])
        longer = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))))
        return F.when(joins, longer).otherwise(F.concat(acc, F.array(x))).cast(kind)

    return F.aggregate(F.array_sort(F.concat(f"{name}_so_far", name)), F.array().cast(kind), step)


def items_sha256(items: list[int]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
