"""Tokenizer pieces of distinct pre-tokens, looked up by fingerprint: each distinct pre-token is encoded once a worker."""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np

from riskgraph.llm import kernels as K

#: Distinct pre-tokens a worker remembers before it starts anew; bounds its memory, not what it counts.
REMEMBERED = 1_000_000
#: Leading bytes of white space beyond ASCII, and control characters on which libraries differ.
LEADS = np.zeros(256, bool)
LEADS[[0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3, 0xEF]] = True
ODD_SPACE = rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1(?:\x9a\x80|\xa0\x8e)|\xe2(?:\x80[\x80-\x8f\xa8-\xaf]|\x81[\x9f\xa0])|\xe3\x80\x80|\xef\xbb\xbf"


@lru_cache(2)
def tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_padding()
    tok.no_truncation()
    return tok


class Pieces:
    """Pieces of spans of text by fingerprint. keep_ids: remember the ids too, not just how many there are."""

    def __init__(self, path: str, keep_ids: bool) -> None:
        self.tok, self.keep_ids = tokenizer(path), keep_ids
        self.added = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]
        self.forget()

    def forget(self) -> None:
        self.keys, self.codes = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.counts, self.ids = np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def look_up(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pre-tokens of the spans as codes into counts (and ids), and which of these each span is."""
        prints = K.span_prints(data, starts, ends)
        keys, first, which = np.unique(prints, return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > REMEMBERED:
            self.forget()
        at = np.searchsorted(self.keys, keys)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == keys[known]
        new = first[~known]
        if len(new):
            raw = data.tobytes()
            found = self.encode([raw[a:b].decode() for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)])
            fresh = np.arange(len(self.counts), len(self.counts) + len(new))
            self.counts = np.concatenate([self.counts, np.fromiter(map(len, found), np.int64, len(found))])
            if self.keep_ids:
                self.ids = np.concatenate([self.ids, np.fromiter((i for ids in found for i in ids), np.uint32)])
            self.codes = np.insert(self.codes, at[~known], fresh)
            self.keys = np.insert(self.keys, at[~known], keys[~known])
            at = np.searchsorted(self.keys, keys)
        return self.codes[at], which

    def apart(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Rows for which spans between ASCII white space don't do: they hold an added token or other white space."""
        raw, at = data.tobytes(), []
        if LEADS[data].any():
            at += [m.start() for m in re.finditer(ODD_SPACE, raw)]
        for token in self.added:
            if token in raw:
                at += [m.start() for m in re.finditer(re.escape(token), raw)]
        return np.unique(np.searchsorted(offsets, np.array(at, np.int64), "right") - 1)


@lru_cache(2)
def pieces_of(path: str, keep_ids: bool) -> Pieces:
    return Pieces(path, keep_ids)


def pre_tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans (starts, ends, rows) that a byte-level pre-tokenizer never crosses: words, each with the one space
    before it, and the white space that is left over. Of a run of white space before a word the last character
    stands alone unless it is that space; a run at the end of a text is one span."""
    starts, ends, bounds = K.words(data, offsets)
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    before = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    before = np.maximum(before, offsets[rows])
    gap = starts - before
    last = data[np.maximum(starts - 1, 0)]
    joined, alone, run = (gap > 0) & (last == 32), (gap > 0) & (last != 32), gap > 1
    filled = np.diff(bounds) > 0
    tail = offsets[:-1].copy()
    tail[filled] = ends[bounds[1:][filled] - 1]
    left = tail < offsets[1:]
    at = np.concatenate([starts - joined, before[run], starts[alone] - 1, tail[left]])
    to = np.concatenate([ends, starts[run] - 1, starts[alone], offsets[1:][left]])
    row = np.concatenate([rows, rows[run], rows[alone], np.flatnonzero(left)])
    order = np.argsort(at, kind="stable")
    return at[order], to[order], row[order]
