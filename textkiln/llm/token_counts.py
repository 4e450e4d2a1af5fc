"""Edit-aware token counts.

A document keeps a segment tree over leaves of consecutive pre-tokens: leaf_chars, the code points of each leaf, and
tree, the token counts in heap order (tree[0] is the whole document, the leaves are the last level, filled up with
zeros). Leaves are cut where every text with these characters has a cut between pre-tokens: in front of a blank or line
end after another character, and in front of a stop or bracket after a letter or digit. An edit re-encodes only the
leaves that it touches, with a character of context on either side that keeps the cuts valid, and updates the sums above
them. A leaf that has grown is cut anew.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from textkiln.llm.common import extended, schema_with, slices
from textkiln.llm.tokens import SegmentEncoder, encoder, vocabulary

#: Code points of a leaf, or a little more: up to the next cut. Leaves twice as long are cut anew.
LEAF = 512
TREE = "n_tokens long, leaf_chars array<int>, tree array<int>"
EDITED = "n_edits int, n_reencoded_chars long"


def tree_of(leaves: np.ndarray) -> np.ndarray:
    """Sums in heap order over a power of two of leaves."""
    width = 1 << max(0, int(len(leaves) - 1).bit_length())
    level = np.zeros(width, np.int64)
    level[: len(leaves)] = leaves
    levels = [level]
    while len(levels[-1]) > 1:
        levels.append(levels[-1].reshape(-1, 2).sum(1))
    return np.concatenate(levels[::-1])


#: Where pre-tokens are cut whatever stands around: before a blank or line end that follows a character other than white
#: space, and between a letter or digit of common scripts and a mark that no word contains.
CUT = re.compile(
    r"(?<=[^\s\x1c-\x1f\x85\u180e\u200b\ufeff])(?=[ \n])"
    r"|(?<=[A-Za-z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f\u0410-\u044f\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3])(?=[.,;:!?(){}\[\]<>\"/\u3001\u3002\uff0c\uff01\uff1f\uff1a\uff1b])"
)


def leaves_of(text: str, leaf: int = LEAF) -> list[str]:
    """text in leaves of at least `leaf` code points, but for the last one; an empty text is one leaf."""
    out, start = [], 0
    while len(text) - start > leaf:
        m = CUT.search(text, start + leaf)
        if m is None or m.start() >= len(text):
            break
        out.append(text[start : m.start()])
        start = m.start()
    return [*out, text[start:]]


def build(encode: SegmentEncoder, texts: pa.Array, leaf: int = LEAF) -> list[tuple[np.ndarray, np.ndarray]]:
    """(leaf_chars, leaf token counts) of each text."""
    cut = [leaves_of(t, leaf) for t in texts_of_array(texts)]
    _, ends = encode.encode(pa.array([x for own in cut for x in own], pa.string()))
    tokens, at, out = np.diff(ends, prepend=0), 0, []
    for own in cut:
        out.append((np.array([len(x) for x in own]), tokens[at : at + len(own)]))
        at += len(own)
    return out


def texts_of_array(texts: pa.Array) -> list[str]:
    return pc.fill_null(texts, "").to_pylist()


def valid(edits: list[dict], length: int) -> bool:
    """Whether edits are in order, disjoint and within a text of so many code points."""
    at = 0
    for e in edits:
        if e is None or e["start"] is None or e["end"] is None or not at <= e["start"] <= e["end"] <= length:
            return False
        at = e["end"]
    return True


def edited(encode: SegmentEncoder, text: str, leaf_chars: np.ndarray, tree: np.ndarray, edits: list[dict], leaf: int = LEAF) -> tuple[str, np.ndarray, np.ndarray, int]:
    """Apply valid edits (start, end, replacement; code points of the text as it was) to a document."""
    leaf_chars, tree, spent = leaf_chars.copy(), tree.copy(), 0
    for e in reversed(edits):  # from the back: offsets in front stay as they are
        new = e["replacement"] or ""
        starts = np.concatenate([[0], np.cumsum(leaf_chars)])
        # A cut at p stands on the characters p-1, p and p+1; leaves on both sides of a touched cut go in.
        lo = max(0, int(np.searchsorted(starts, e["start"] - 1, "left")) - 1)
        hi = min(len(leaf_chars), int(np.searchsorted(starts, e["end"], "right")))
        hi = max(hi, lo + 1)
        region = text[starts[lo] : e["start"]] + new + text[e["end"] : starts[hi]]
        text = text[: e["start"]] + new + text[e["end"] :]
        spent += len(region)
        own = leaves_of(region, leaf) if len(region) >= 2 * leaf else [region]
        tokens = [len(encode.merger.encode_ordinary(x)) for x in own]
        if len(own) <= hi - lo:
            leaf_chars[lo:hi] = [len(x) for x in own] + [0] * (hi - lo - len(own))
            _put(tree, lo, tokens + [0] * (hi - lo - len(own)))
        else:  # more leaves than there were: the sums are built anew from the counts, nothing else is encoded
            width = (len(tree) + 1) // 2
            counts = tree[width - 1 : width - 1 + len(leaf_chars)]
            counts = np.concatenate([counts[:lo], tokens, counts[hi:]])
            leaf_chars = np.concatenate([leaf_chars[:lo], [len(x) for x in own], leaf_chars[hi:]])
            some = leaf_chars > 0
            leaf_chars, tree = leaf_chars[some], tree_of(counts[some])
    return text, leaf_chars, tree, spent


def _put(tree: np.ndarray, leaf: int, counts: list[int]) -> None:
    """Set the counts of leaves from `leaf` on, and the sums above them."""
    first = (len(tree) + 1) // 2 - 1 + leaf
    for k, n in enumerate(counts):
        node, change = first + k, n - int(tree[first + k])
        while change:
            tree[node] += change
            if not node:
                break
            node = (node - 1) // 2


def count(docs: DataFrame, path: str | None = None, leaf: int = LEAF) -> DataFrame:
    """docs' columns and n_tokens, leaf_chars, tree; columns with these names are replaced.

    Null text counts as empty: no tokens, one leaf. An empty table stays empty.
    """
    docs, path = docs.drop("n_tokens", "leaf_chars", "tree"), path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 8 << 20):
                built = build(encoder(path), part.column("text"), leaf)
                trees = [tree_of(t) for _, t in built]
                more = {"n_tokens": pa.array([int(t[0]) for t in trees], pa.int64()), "leaf_chars": pa.array([c for c, _ in built], pa.list_(pa.int32())), "tree": pa.array(trees, pa.list_(pa.int32()))}
                yield extended(part, more)

    return docs.mapInArrow(run, schema_with(docs, TREE))


def recount(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Apply the column edits (array<struct<start, end, replacement>>) to counted documents: text, n_tokens,
    leaf_chars and tree become those after the edits; n_edits and n_reencoded_chars are added, edits goes.

    Null or no edits change nothing, and null text with edits counts as empty. A null replacement is empty. Edits must be
    in order, disjoint and within the text: where they are not, the document stays as it is and n_edits is null.
    Repeated rows are edited each for themselves; an empty table stays empty. Columns named like an output are replaced.
    """
    path = path or vocabulary()
    out = docs.drop("edits", "n_edits", "n_reencoded_chars")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts, edits = part.column("text").to_pylist(), part.column("edits").to_pylist()
                chars, trees = part.column("leaf_chars").to_pylist(), part.column("tree").to_pylist()
                n_edits, spent = [], []
                for i, own in enumerate(edits):
                    good = valid(own or [], len(texts[i] or ""))
                    n_edits.append(len(own or ()) if good else None)
                    spent.append(0)
                    if own and good:
                        texts[i], c, t, spent[i] = edited(encoder(path), texts[i] or "", np.array(chars[i]), np.array(trees[i]), own)
                        chars[i], trees[i] = c, t
                more = {"text": pa.array(texts, pa.string()), "n_tokens": pa.array([int(t[0]) for t in trees], pa.int64()), "leaf_chars": pa.array(chars, pa.list_(pa.int32())), "tree": pa.array(trees, pa.list_(pa.int32())), "n_edits": pa.array(n_edits, pa.int32()), "n_reencoded_chars": pa.array(spent, pa.int64())}
                yield extended(part, more, ("edits", "n_edits", "n_reencoded_chars"))

    return docs.mapInArrow(run, schema_with(out, EDITED))
