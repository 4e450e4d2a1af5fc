"""Packing of tokenised documents into sequences by Karmarkar-Karp multiway differencing.

Documents longer than a sequence fill whole ones first. The rests of a block of documents are differenced: partial
partitions into m windows are merged, the fullest window of one with the emptiest of the other, largest imbalance
first, which leaves m nearly equal windows; m starts at the least number that could do and rises until no window is
over capacity. Where cutting is allowed, rests are cut into pieces beforehand, many small ones among them, so that
imbalances cancel out to a few tokens, and a block is cut off SLACK tokens a window short of full, so that m need not
rise. A block is a bounded number of tokens, so a task keeps a bounded number of documents however many it packs.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from textkiln.llm.common import slices
from textkiln.llm.tokens import encoder, vocabulary

CAPACITY = 2048
#: Windows that are differenced together.
WINDOWS = 128
#: Tokens of a piece at most, and tokens that a block leaves free for each window (0.2 %).
PIECE, SLACK = 256, 4
END_ID = 1
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def differenced(sizes: list[int], m: int) -> list[list[int]]:
    """Deal items into m windows of nearly equal sums; returns the items' numbers by window."""
    # A partial partition: its windows that hold something, fullest first, as (sum, members); members form a tree.
    heap = [(-s, i, [(s, i)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    serial = len(sizes)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        shared = len(a) + len(b) - m
        if shared <= 0:
            merged = a + b
        else:  # the emptiest of each meet the fullest of the other
            merged = a[: m - len(b)] + b[: m - len(a)]
            merged += [(x[0] + y[0], (x[1], y[1])) for x, y in zip(a[m - len(b) :], reversed(b[m - len(a) :]), strict=True)]
        merged.sort(key=lambda w: -w[0])
        heapq.heappush(heap, ((merged[-1][0] if len(merged) == m else 0) - merged[0][0], serial, merged))
        serial += 1
    out = []
    for _, tree in heap[0][2] if heap else []:
        members, stack = [], [tree]
        while stack:
            x = stack.pop()
            if isinstance(x, tuple):
                stack += x
            else:
                members.append(x)
        out.append(sorted(members))
    return out


def pieces_of(size: int, piece: int = PIECE) -> list[int]:
    """Lengths that a rest is cut into: whole pieces, then what is left in three quarters and one."""
    left = size % piece
    return [piece] * (size // piece) + [x for x in (left - left // 4, left // 4) if x]


def windows_of(sizes: list[int], capacity: int = CAPACITY, cut: bool = True, piece: int = PIECE) -> list[list[tuple[int, int, int]]]:
    """Windows of (item, start, length), none over capacity. Without cut, no item may be over capacity."""
    parts = []
    for i, size in enumerate(sizes):
        start = 0
        for n in pieces_of(size, min(piece, capacity)) if cut else [size]:
            parts.append((i, start, n))
            start += n
    m = -(-sum(sizes) // capacity)
    while parts:
        windows = [[parts[k] for k in w] for w in differenced([n for _, _, n in parts], m)]
        if max(sum(n for _, _, n in w) for w in windows) <= capacity:
            return [_joined(w) for w in windows]
        m += 1
    return []


def _joined(window: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Neighbouring pieces of one item in a window are one piece."""
    out: list[tuple[int, int, int]] = []
    for i, start, n in sorted(window):
        if out and out[-1][0] == i and out[-1][1] + out[-1][2] == start:
            out[-1] = (i, out[-1][1], out[-1][2] + n)
        else:
            out.append((i, start, n))
    return out


def pack(docs: DataFrame, capacity: int = CAPACITY, cut: bool = True, path: str | None = None, end_id: int = END_ID, windows: int = WINDOWS) -> DataFrame:
    """One row a piece: doc_id, start and length in the document's ids, ids (little-endian 32-bit), doc_tokens,
    sequence_id and offset (gapless from 0 in its sequence).

    A document is its text's ids and end_id; null or empty text: end_id alone. Nothing is shuffled: each task packs
    its own rows, repeated rows each for themselves. An empty table gives no rows; other columns are not read.
    """
    path, full_block = path or vocabulary(), windows * (capacity - SLACK if cut else capacity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = TaskContext.get().partitionId() << 32, 0
        block: list[tuple[object, np.ndarray, int, int]] = []  # a document's id and ids, and what of these is in the block
        held = 0

        def rows(sequences, source):
            nonlocal made
            out = []
            for sequence in sequences:
                offset = 0
                for i, start, n in sequence:
                    doc_id, ids, first, _ = source[i]
                    out.append((doc_id, first + start, n, ids[first + start : first + start + n].tobytes(), len(ids), base + made, offset))
                    offset += n
                made += 1
            cols = list(zip(*out, strict=True)) or [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in SCHEMA.split(", ")])

        def packed():
            return rows(windows_of([to - first for _, _, first, to in block], capacity, cut), block)

        for batch in batches:
            for part in slices(batch, "text", 8 << 20):
                flat, ends = encoder(path).encode(part.column("text"))
                full = []
                for doc_id, a, b in zip(part.column("doc_id").to_pylist(), np.concatenate([[0], ends[:-1]]), ends, strict=True):
                    ids = np.append(flat[a:b], np.uint32(end_id))
                    first = len(ids) // capacity * capacity
                    full += [(doc_id, ids, x, x + capacity) for x in range(0, first, capacity)]
                    while first < len(ids):
                        to = min(len(ids), first + full_block - held) if cut else len(ids)
                        block.append((doc_id, ids, first, to))
                        held, first = held + to - first, to
                        if held >= full_block:
                            yield packed()
                            block, held = [], 0
                if full:
                    yield rows([[(i, 0, capacity)] for i in range(len(full))], full)
        if block:
            yield packed()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
