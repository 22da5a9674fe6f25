"""Whole-text encoding with a public tokenizer; the ids of pieces met before are kept.

Both vocabularies cut a text at certain places whatever stands around them: the byte-level
one begins a new word at a single space (or line end) between two other characters, the
lower-casing one drops white space, and both cut between an ASCII letter and ASCII punctuation
(``_MARKS``; apostrophes and the characters of special tokens are left out). The ids of a text
are those of the pieces between such cuts, in turn. Pieces are told apart by 64-bit hashes of their bytes, found by array
operations, and only new ones reach the tokenizers library: plain Latin words go straight
to its merge model, everything else through its whole pipeline.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa

from noteloom.llm.shared import KEPT, text_buffers
from noteloom.llm.textscan import SPACE, chunks, span_hashes, spans

#: The byte-level vocabulary's own split of a text, for the letters and digits of ASCII and Latin-1.
_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\s A-Za-z0-9À-ÖØ-öø-ÿ]+|\s+(?!\S)|\s+")
#: The lower-casing vocabulary's split, the same way.
_LOWER_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")
#: Characters for which those two splits and plain lower-casing are the library's own.
_PLAIN = re.compile(r"[ -~À-ÖØ-öø-ÿ]*\Z")
#: Byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on, in turn.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_ALPHABET = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}
_encoders: dict[tuple[str, bool], "TextEncoder"] = {}
KEPT.append(_encoders)
SLICE = 1 << 20
#: 1 for letters, 2 for punctuation that is always cut from a letter beside it.
_MARKS = np.zeros(256, np.int8)
_MARKS[65:91] = _MARKS[97:123] = 1
_MARKS[list(b"!\"#$%&()*+,-./:;=?@[\\]^_`{}~")] = 2


def _inner(data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Where a letter and punctuation meet within a text; ``edges`` are the places between texts."""
    marks = _MARKS[data]
    meet = (marks[1:] + marks[:-1]) == 3
    meet[edges - 1] = False
    return np.flatnonzero(meet) + 1


def _cuts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of the byte-level vocabulary, covering every byte."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    blank = SPACE[data]
    alone = np.zeros(n, bool)
    alone[1:-1] = blank[1:-1] & ~blank[:-2] & ~blank[2:]
    edges = offsets[(offsets > 0) & (offsets < n)]
    alone[edges] = False
    alone[edges - 1] = False
    start = np.zeros(n + 1, bool)
    start[:-1] = alone & ((data == 32) | (data == 10))
    start[1:] |= np.append(alone & (data == 10), False)[:-1]
    start[0] = True
    start[edges] = True
    start[_inner(data, edges)] = True
    s = np.flatnonzero(start[:n])
    return s, np.append(s[1:], n)


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of the lower-casing vocabulary: words, cut at punctuation."""
    s, e = spans(data, offsets)
    cut = _inner(data, offsets[(offsets > 0) & (offsets < len(data))])
    return np.sort(np.concatenate([s, cut])), np.sort(np.concatenate([e, cut]))


class TextEncoder:
    """``encode`` gives the ids of whole texts; at most ``keep`` pieces stay in memory."""

    def __init__(self, path: str, spaces_matter: bool, keep: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.spaces_matter, self.keep = Tokenizer.from_file(path), spaces_matter, keep
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.new: dict[int, bytes] = {}
        self.old: dict[int, bytes] = {}

    def _word(self, word: str) -> bytes:
        shown = "\u0120" + word[1:] if word[0] == " " else word
        if not shown.isascii() and not word.isascii():
            shown = word.encode().decode("latin-1").translate(_ALPHABET)
        return array("I", [t.id for t in self.tokenizer.model.tokenize(shown)]).tobytes()

    def _piece(self, piece: str) -> bytes:
        bare = piece[1:] if self.spaces_matter and piece[0] == " " else piece
        if bare.isalpha() and _PLAIN.match(bare):  # one word
            return self._word(piece if self.spaces_matter else piece.lower())
        if _PLAIN.match(piece) and not ("<" in piece and any(s in piece for s in self.special)):
            found = _WORDS.findall(piece) if self.spaces_matter else _LOWER_WORDS.findall(piece.lower())
            if not self.spaces_matter or piece.count(" ") == piece.startswith(" "):
                return b"".join(map(self._word, found))
        return np.array(self.tokenizer.encode(piece, add_special_tokens=False).ids, "<u4").tobytes()

    def _look_up(self, data: np.ndarray, s: np.ndarray, e: np.ndarray, hashes: list[int]) -> list[bytes]:
        got = list(map(self.new.get, hashes))
        missing = [i for i, x in enumerate(got) if x is None]
        if not missing:
            return got
        if len(self.new) + len(missing) > self.keep // 2:
            self.old, self.new = self.new, {}
        new, old, piece = self.new, self.old.get, self._piece
        where = np.array(missing)
        for i, a, b in zip(missing, s[where].tolist(), e[where].tolist()):
            key = hashes[i]
            x = old(key)
            got[i] = new[key] = piece(data[a:b].tobytes().decode()) if x is None else x
        return got

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in turn as uint32, where each text's begin and the end)."""
        data, offsets = text_buffers(column)
        ids, firsts, base = [], [np.zeros(1, np.int64)], 0
        for i, j in chunks(offsets, SLICE):
            got, at = self._encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            ids.append(got)
            firsts.append(at[1:] + base)
            base += len(got)
        return (np.concatenate(ids) if ids else np.zeros(0, np.uint32)), np.concatenate(firsts)

    def _encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s, e = _cuts(data, offsets) if self.spaces_matter else _words(data, offsets)
        if len(s) == 0:
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        distinct, first, which = np.unique(span_hashes(data, s, e, False), return_index=True, return_inverse=True)
        got = self._look_up(data, s[first], e[first], distinct.tolist())
        size = np.fromiter(map(len, got), np.int64, len(got)) >> 2
        begin = np.cumsum(size) - size
        count = size[which]
        after = np.cumsum(count)
        at = np.repeat(begin[which] - after + count, count)
        at += np.arange(len(at))
        ids = np.frombuffer(b"".join(got), "<u4")[at]
        return ids, np.append(0, after)[np.searchsorted(s, offsets)]


def encoder(path: str, spaces_matter: bool) -> TextEncoder:
    """One encoder per worker process, kept for later tasks."""
    if (path, spaces_matter) not in _encoders:
        _encoders[path, spaces_matter] = TextEncoder(path, spaces_matter)
    return _encoders[path, spaces_matter]


def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size()
