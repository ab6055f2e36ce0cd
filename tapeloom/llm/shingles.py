"""Word shingles of whole texts as sets of 64-bit hashes, computed with numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tapeloom.llm.hashing import FOLDED_CODES, mix, run_hashes

_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
_TERMS = [np.uint64(pow(0xD6E8FEB86659FD93, k + 1, 2**64)) for k in range(64)]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and the offsets of each. Null: no bytes."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if offsets[0] == offsets[-1]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word (a run without ASCII white space, A-Z read as a-z); offsets by text."""
    data, offsets = buffers(texts)
    if not len(data):
        return np.zeros(0, np.uint64), offsets
    blank = _SPACES[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets[:-1]] = True
    starts = ~blank
    starts[1:] &= blank[:-1] | first[1:-1]
    ends = ~blank
    ends[:-1] &= blank[1:] | first[1:-1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return run_hashes(data, starts, ends, FOLDED_CODES), np.searchsorted(starts, offsets)


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Each text's distinct shingles of width words, sorted; a shorter text's words are one shingle."""
    words, offsets = word_hashes(texts)
    n = len(words) - width + 1
    if n > 0:
        grams = words[:n] * _TERMS[0]
        for k in range(1, width):
            grams += words[k : n + k] * _TERMS[k]
        grams = mix(grams)
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(grams[a : b - width + 1]))
        elif b > a:
            short = sum((int(w) * int(_TERMS[k]) for k, w in enumerate(words[a:b])), b - a) % 2**64
            out.append(mix(np.array([short], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
