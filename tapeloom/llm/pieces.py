"""Ids of a SentencePiece model for many texts, with each distinct word encoded once.

Where no piece has a space behind another character, merges never cross from a word into the next
word's space; so a text is cut before its single spaces and the cuts are encoded by themselves.
Texts with two spaces in a row, with U+2581, or for a model without that property, are encoded as
wholes.  The ids are always those of ``SentencePieceProcessor.encode(text)``.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Entries a worker remembers before it starts afresh.
CHUNKS = 100_000
SPACE = "▁"


class PieceEncoder:
    """Encodes Arrow string arrays with the SentencePiece model of a file."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        inner = any(re.search(f"[^{SPACE}]{SPACE}", p) for i, p in enumerate(pieces) if not self._special(i))
        line = self.model.encode("\n")
        #: Ids that a leading line feed gets; they are dropped again.
        self.lead = len(line)
        self.by_words = not inner and len(line) == 2 and self.model.encode("\n x")[:2] == line and not any("\n" in p for p in pieces)
        #: The bytes of each id's token; None for ids that no text yields.
        self.bytes = [self._bytes(i, p) for i, p in enumerate(pieces)]
        self.known: dict[str, bytes] = {}

    def _special(self, i: int) -> bool:
        return self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i)

    def _bytes(self, i: int, piece: str) -> bytes:
        if self.model.is_byte(i):
            return bytes([int(piece[3:5], 16)])
        return b"" if self._special(i) else piece.replace(SPACE, " ").encode()

    def _encoded(self, chunks: list[str]) -> list[bytes]:
        found = list(map(self.known.get, chunks))
        new = [i for i, x in enumerate(found) if x is None]
        if len(self.known) + len(new) > CHUNKS:
            self.known.clear()
        for i, ids in zip(new, self.model.encode(["\n" + chunks[i] for i in new], num_threads=1), strict=True):
            found[i] = array("I", ids[self.lead :]).tobytes()
            if len(self.known) < CHUNKS:
                self.known[chunks[i]] = found[i]
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the offsets of each text in it. Null, empty: no ids."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        none, space = pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())
        spaced = pc.binary_join_element_wise(none, texts, space)
        empty = pc.equal(texts, "")
        odd = pc.or_(pc.match_substring(spaced, "  "), pc.match_substring(spaced, SPACE))
        if not self.by_words:
            odd = pa.array(np.ones(len(texts), bool))
        whole = np.flatnonzero(pc.and_not(odd, empty).to_numpy(zero_copy_only=False))
        lists = pc.split_pattern(pc.if_else(pc.or_(odd, empty), none, texts), " ")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        values = lists.values.slice(offsets[0], int(offsets[-1] - offsets[0])).dictionary_encode()
        offsets = offsets - offsets[0]
        codes = values.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        ids = self._encoded([" " + x for x in values.dictionary.to_pylist()])
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        table = np.frombuffer(b"".join(ids), np.uint32)
        begins = np.cumsum(sizes) - sizes
        counts = sizes[codes]
        blank = np.zeros(len(texts), bool)
        blank[whole] = True
        blank |= empty.to_numpy(zero_copy_only=False)
        counts[np.repeat(blank, np.diff(offsets))] = 0
        ends = np.concatenate(([0], np.cumsum(counts)))
        flat = table[np.repeat(begins[codes] - ends[:-1], counts) + np.arange(ends[-1])]
        places = ends[offsets]
        if not len(whole):
            return flat, places
        parts = [flat[places[i] : places[i + 1]] for i in range(len(texts))]
        for row in whole.tolist():
            parts[row] = np.array(self.model.encode(texts[row].as_py()), np.uint32)
        return np.concatenate(parts).astype(np.uint32), np.concatenate(([0], np.cumsum([len(p) for p in parts])))


_encoders: dict[str, PieceEncoder] = {}


def piece_encoder(path: str) -> PieceEncoder:
    """The worker's encoder for a file."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]
