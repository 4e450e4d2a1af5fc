"""Token ids by a public byte-level BPE vocabulary, with a memo for the segments between blanks.

A byte-level BPE first cuts a text into pre-tokens and encodes each on its own, so a segment that starts and ends at
such a cut has the same ids wherever it stands. In a text whose white space is only single blanks and single line
ends, each in front of another character, every blank starts a pre-token and every line end is one. Such texts are cut
there and the segments' ids are looked up; segments met for the first time are encoded together. Other texts are
encoded whole, by the tokenizer. Segments are encoded by a second implementation of the same merges, read from the
same file, which takes a quarter of the time; it is refused unless ids are in the order of the merges.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A memo is emptied when it has so many segments (about 80 MB in a worker).
MEMO = 300_000
#: Texts that are encoded whole (for RE2; \\s would only be ASCII).
_SPACES = "\\t\\x0b\\x0c\\r\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
_ODD = f"^$|[ \\n]$|[ \\n][ \\n]|[{_SPACES}\\x00]"
#: New segments are encoded in runs of so many.
RUN = 512


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _bytes_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others
    for the characters from U+0100 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


def _merger(path: str, pattern: str):
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    to = _bytes_of()
    ranks = {bytes(to[c] for c in token): i for token, i in model["vocab"].items() if all(c in to for c in token) and token != "<|endoftext|>"}
    made = [model["vocab"]["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
    if made != sorted(made):
        raise ValueError("ids are not in the order of the merges")
    return tiktoken.Encoding("segments", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class SegmentEncoder:
    """Encodes texts with the tokenizer at a path, as little-endian 32-bit ids."""

    def __init__(self, path: str, memo: int = MEMO) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), memo
        self.tokenizer.encode_special_tokens = True
        import public_tokenizers

        self.merger = _merger(path, public_tokenizers.PATTERN)
        self.memo: dict[str, bytes] = {}
        first = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        self.starts = np.array([t[:1] in ("\u0120", "\u010a") for t in first])  # how the vocabulary writes a blank and a line end

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, "<u4") for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _missing(self, segments: list[str]) -> None:
        memo = self.memo
        new = {s for s in segments if s not in memo}
        if len(memo) + 2 * len(new) > self.most:
            memo.clear()
            new = set(segments)
        ids = self.merger.encode_ordinary
        # A stop or comma after a letter is a pre-token of its own: the word may be known already.
        ends = [s for s in new if s[-1] in ".," and s[-2:-1].isalpha()]
        new = new.difference(ends).union({s[:-1] for s in ends}.difference(memo))
        memo.update((s, np.array(ids(s[1:]), "<u4").tobytes()) for s in new if s[0] == "\x00")
        # Other segments start with a blank or line end and have no other: where an id starts so, the next one begins.
        led = [s for s in new if s[0] != "\x00"]
        for i in range(0, len(led), RUN):
            run = led[i : i + RUN]
            raw = np.array(ids("".join([s if s[0] == "\n" else f" {s}" for s in run])), "<u4")
            at = (np.flatnonzero(self.starts[raw]) * 4).tolist()
            raw = raw.tobytes()
            memo.update(zip(run, map(raw.__getitem__, map(slice, at, [*at[1:], len(raw)])), strict=True))
        stop = {c: np.array(ids(c), "<u4").tobytes() for c in ".,"}
        memo.update((s, memo[s[:-1]] + stop[s[-1]]) for s in ends)

    def segments(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Cut texts that can be cut: each distinct segment, its ids, where they end, each segment's number among the
        distinct ones, and where each text's segments end.

        A segment leaves out its leading blank; one without is marked by a leading line end or, at the start, \x00.
        """
        marked = pc.replace_substring(pc.binary_join_element_wise(pa.scalar("\x00"), texts, pa.scalar("")), "\n", " \n")
        cut = pc.split_pattern(marked, " ")
        coded = cut.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        self._missing(distinct)
        ids = list(map(self.memo.__getitem__, distinct))
        ends = np.cumsum([len(x) // 4 for x in ids], dtype=np.int64)
        return coded.dictionary, np.frombuffer(b"".join(ids), "<u4"), ends, coded.indices.to_numpy(), np.cumsum(pc.list_value_length(cut).to_numpy(zero_copy_only=False), dtype=np.int64)

    @staticmethod
    def odd(texts: pa.Array) -> np.ndarray:
        """Which texts must be encoded whole."""
        return pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False).astype(bool)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and where each text's ids end. Nulls have none."""
        texts = pc.fill_null(texts, "")
        odd = self.odd(texts)
        lengths = np.zeros(len(texts), np.int64)
        flat = np.zeros(0, "<u4")
        if not odd.all():
            _, ids, ends, at, text_ends = self.segments(texts.filter(pa.array(~odd)))
            n = np.diff(ends, prepend=0)[at]
            shift = (ends - np.diff(ends, prepend=0))[at] - (np.cumsum(n) - n)
            flat = ids[np.repeat(shift, n) + np.arange(n.sum())]
            lengths[~odd] = np.diff(np.concatenate([[0], np.cumsum(n)])[text_ends], prepend=0)
        if odd.any():
            whole = self.whole(texts.filter(pa.array(odd)).to_pylist())
            lengths[odd] = [len(x) for x in whole]
            own = np.repeat(odd, lengths)
            out = np.empty(len(own), "<u4")
            out[~own], out[own] = flat, np.concatenate(whole)
            flat = out
        return flat, np.cumsum(lengths)


@lru_cache(maxsize=2)
def encoder(path: str) -> SegmentEncoder:
    """One encoder a worker process."""
    return SegmentEncoder(path)
