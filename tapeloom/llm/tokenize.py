"""Exact token ids at columnar speed.

Natural text repeats its words, and a byte-pair model splits every pre-token on its own.  So the
pre-tokens of a slice of texts are found with numpy, made distinct by a 64-bit hash, and only
those that a worker has not met lately reach the BPE model of the ``tokenizers`` library.  That
holds for texts of plain Latin letters, digits and punctuation.  Other texts are cut at spaces
and their distinct chunks encoded; a text whose white space could join two chunks, or which holds
a special token, goes to the tokenizer as a whole.  The ids are always those of
``Tokenizer.encode(text, add_special_tokens=False)``.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

from tapeloom.llm.hashing import run_hashes

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Entries a worker remembers before it starts afresh.
CHUNKS, PIECES = 50_000, 300_000
#: Bytes of text that are encoded at once.
SLICE_BYTES = 1 << 20

#: Classes of the bytes of plain text. 0: none; such a text is not plain.
_SPACE, _NEWLINE, _LETTER, _DIGIT, _PUNCT = 1, 2, 3, 4, 5
_CLASSES = np.zeros(256, np.uint8)
_CLASSES[33:127] = _PUNCT
_CLASSES[48:58] = _DIGIT
for _a in (65, 97):
    _CLASSES[_a : _a + 26] = _LETTER
_CLASSES[32], _CLASSES[10] = _SPACE, _NEWLINE
_CLASSES[0x80:0xC0] = _LETTER  # the second byte of a letter from À to ÿ; the first is 0xC3
_CLASSES[0xC3] = _LETTER
_CLASSES[39] = 0  # an apostrophe may begin a contraction

_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_PLAIN = re.compile(rf"[\n -~{_LETTERS}]+").fullmatch
#: The pre-token patterns of the two tokenizer files, for plain text.
_PATTERNS = {
    "words": rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\s{_LETTERS}0-9]+",
    "bytes": rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s{_LETTERS}0-9]+|\s+(?!\S)|\s+",
}
#: A space that white space or the end follows: there a cut could change pre-tokens.
_LOOSE = r" (?:[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]|\z)"


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level models write for each byte."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in kept]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}


class ChunkEncoder:
    """Encodes Arrow string arrays with the tokenizer of a file.

    plain_specials: the strings of special tokens in a text are ordinary text.
    """

    def __init__(self, path: str, plain_specials: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain_specials
        self.special = [] if plain_specials else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.drops_space = self.tokenizer.normalizer is not None
        self.model = self.tokenizer.model
        self.pieces_of = re.compile(_PATTERNS["words" if self.drops_space else "bytes"]).findall
        self.letters = _byte_letters()
        self.chunks: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.known: dict[int, bytes] = {}

    @cached_property
    def bytes(self) -> list[bytes]:
        """The bytes of each id's token in a byte-level vocabulary; b"" for ids that no plain text yields."""
        back = {ord(letter): byte for byte, letter in self.letters.items()}
        out = [b""] * self.tokenizer.get_vocab_size()
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        for token, i in self.tokenizer.get_vocab().items():
            if token not in special and all(ord(c) in back for c in token):
                out[i] = bytes(back[ord(c)] for c in token)
        return out

    def _piece(self, piece: str) -> bytes:
        if (ids := self.pieces.get(piece)) is None:
            text = piece.encode().decode("latin-1").translate(self.letters)
            ids = array("I", [t.id for t in self.model.tokenize(text)]).tobytes()
            if len(self.pieces) >= PIECES:
                self.pieces.clear()
            self.pieces[piece] = ids
        return ids

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        if (ids := self.chunks.get(chunk)) is None:
            if _PLAIN(chunk) and "<|" not in chunk:
                text = chunk.lower() if self.drops_space else chunk
                ids = b"".join(map(self._piece, self.pieces_of(text)))
            else:
                ids = self._whole(chunk)
            if len(self.chunks) >= CHUNKS:
                self.chunks.clear()
            self.chunks[chunk] = ids
        return ids

    def _plain(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends of the pre-tokens of plain texts, and which texts are not plain."""
        kinds = _CLASSES[data]
        before, here = data[:-1], data[1:]
        tail = here - np.uint8(0x80) < 0x40  # 0x80 to 0xBF
        bad = np.zeros(len(data) + 1, bool)
        bad[: len(data)] = kinds == 0
        bad[1 : len(data)] |= tail != (before == 0xC3)
        bad[1 : len(data)] |= (before == 0xC3) & ((here == 0x97) | (here == 0xB7))
        bad[1 : len(data)] |= (before == 60) & (here == 124)  # <|
        firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
        lasts = offsets[1:][offsets[:-1] < offsets[1:]] - 1
        edge = np.zeros(len(data) + 1, bool)
        edge[1 : len(data)] = kinds[1:] != kinds[:-1]
        if self.drops_space:
            edge[: len(data)] |= kinds == _DIGIT
        else:
            blank = kinds <= _NEWLINE
            bad[1 : len(data)] |= blank[1:] & blank[:-1]
            bad[lasts] |= blank[lasts]
            edge[1 : len(data)] &= before != 32
        edge[firsts] = True
        odd = np.zeros(len(offsets) - 1, bool)
        odd[np.searchsorted(offsets, np.flatnonzero(bad), "right") - 1] = True
        edge[len(data)] = True
        cuts = np.flatnonzero(edge)
        starts, ends = cuts[:-1], cuts[1:]
        if self.drops_space:
            keep = kinds[starts] > _NEWLINE
            starts, ends = starts[keep], ends[keep]
        return starts, ends, odd

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the offsets of each text in it. Null: no ids."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        if offsets[0] == offsets[-1]:
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        starts, ends, odd = self._plain(data, offsets)
        rows = np.flatnonzero(odd)
        if len(rows):
            keep = ~odd[np.searchsorted(offsets, starts, "right") - 1]
            starts, ends = starts[keep], ends[keep]
        codes, hashes = pd.factorize(run_hashes(data, starts, ends))
        if len(self.known) > PIECES:
            self.known.clear()
        ids = list(map(self.known.get, hashes.tolist()))
        if new := [i for i, x in enumerate(ids) if x is None]:
            at = np.empty(len(hashes), np.int64)
            at[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
            raw = data.tobytes()
            tokens, letters = self.model.tokenize, self.letters
            at = at[new]
            for i, h, a, b in zip(new, hashes[new].tolist(), starts[at].tolist(), ends[at].tolist(), strict=True):
                text = raw[a:b]
                if self.drops_space:
                    text = text.decode().lower().encode()
                text = text.decode("latin-1").translate(letters)
                ids[i] = self.known[h] = array("I", [t.id for t in tokens(text)]).tobytes()
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        table = np.frombuffer(b"".join(ids), np.uint32)
        begins = np.cumsum(sizes) - sizes
        counts = sizes[codes]
        done = np.concatenate(([0], np.cumsum(counts)))
        flat = table[np.repeat(begins[codes] - done[:-1], counts) + np.arange(done[-1])]
        places = done[np.searchsorted(starts, offsets)]
        if not len(rows):
            return flat, places
        other, others = self._by_chunks(texts.take(pa.array(rows)))
        parts = [flat[places[i] : places[i + 1]] for i in range(len(texts))]
        for k, row in enumerate(rows.tolist()):
            parts[row] = other[others[k] : others[k + 1]]
        return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))

    def _by_chunks(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As encode(), for any texts."""
        if self.drops_space:
            texts = pc.replace_substring(texts, "\n", " ")
            odd = pa.array(np.zeros(len(texts), bool))
        else:
            odd = pc.match_substring_regex(texts, _LOOSE)
        for token in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, token))
        odd_rows = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        whole = {row: texts[row].as_py() for row in odd_rows.tolist()}
        if whole:
            texts = pc.if_else(odd, "", texts)
        lists = pc.split_pattern(texts, " ")
        starts = lists.offsets.to_numpy().astype(np.int64)
        base = starts[0]
        starts = starts - base
        values = lists.values.slice(base, int(starts[-1])).dictionary_encode()
        codes = values.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        keys = values.dictionary.to_pylist()
        if not self.drops_space:  # all but the first chunk of a text begin with their space
            firsts = starts[:-1][starts[:-1] < starts[1:]]
            bare, at = np.unique(codes[firsts], return_inverse=True)
            bare_keys = [keys[c] for c in bare.tolist()]
            codes[firsts] = len(keys) + at
            keys = [" " + k for k in keys] + bare_keys
        ids = list(map(self._chunk, keys))
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        table = np.frombuffer(b"".join(ids), np.uint32)
        begins = np.cumsum(sizes) - sizes
        counts = sizes[codes]
        ends = np.concatenate(([0], np.cumsum(counts)))
        flat = table[np.repeat(begins[codes] - ends[:-1], counts) + np.arange(ends[-1])]
        offsets = ends[starts]
        if not whole:
            return flat, offsets
        parts = [
            np.frombuffer(self._whole(whole[i]), np.uint32) if i in whole else flat[offsets[i] : offsets[i + 1]]
            for i in range(len(texts))
        ]
        return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))


_encoders: dict[tuple[str, bool], ChunkEncoder] = {}


def encoder(path: str, plain_specials: bool = False) -> ChunkEncoder:
    """The worker's encoder for a file; its memory of chunks lasts as long as the worker."""
    key = path, plain_specials
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = ChunkEncoder(path, plain_specials)
    return _encoders[key]
