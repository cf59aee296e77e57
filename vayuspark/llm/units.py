"""Exact tokenization by units: runs of bytes that a tokenizer handles without regard to what stands around them.

Texts are cut into units with numpy, each distinct unit of a piece is found once, and a worker keeps the ids of the units it
has met (up to `KNOWN` units; then it starts anew). The libraries themselves encode each new unit, so the ids are theirs.

Where a text may be cut follows from each tokenizer's own rules:

* words (`WordBpe`): white space separates tokens and is dropped. Within a word of ASCII and Latin-1 letters, digits and marks
  (no apostrophe) letters, digits and marks are separate too. Every other word is one unit.
* byte-level (`ByteBpe`): a token starts at the last space before a word, at a word after other white space, and at each run
  of white space; within plain words as above. Texts with white space beyond ASCII are one unit.
* pieces (`Pieces`): no piece has a space after another character (checked on the vocabulary), so a run of spaces and the
  characters up to the next space are a unit.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from vayuspark.llm.bpe import gather
from vayuspark.llm.text import LOWER, buffer_of

MAX_FILE_BYTES = 32 << 20
#: Units and bytes of units that a worker remembers.
KNOWN, KNOWN_BYTES = 200_000, 4 << 20
#: Units handed to a library at once.
AT_ONCE = 2048

_MARKS, _LETTERS, _DIGITS, _WHITE = range(4)
_KIND = np.full(256, _MARKS, np.int8)
_KIND[list(range(0x41, 0x5B)) + list(range(0x61, 0x7B))] = _LETTERS
_KIND[list(range(0x30, 0x3A))] = _DIGITS
_KIND[[0x20, *range(0x09, 0x0E)]] = _WHITE
_LATIN_1 = np.zeros(256, bool)
_LATIN_1[[b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)]] = True
_ONLY_LETTERS = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
#: White space beyond ASCII, generously.
_WIDE_SPACE = "[" + "".join(map(chr, [0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF])) + "]"


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_LETTER_OF = byte_letters()


def _starts(at: np.ndarray, n: int) -> np.ndarray:
    """Marks of the n bytes at which a row starts."""
    marks = np.zeros(n + 1, bool)
    marks[at] = True
    return marks[:n]


def _plain(raw: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each byte its kind, whether a unit may start there inside a plain word, and whether its word is not plain."""
    kind = _KIND[raw]
    pair = np.zeros(len(raw), bool)
    pair[:-1] = (raw[:-1] == 0xC3) & _LATIN_1[raw[1:]]
    kind[pair] = _LETTERS
    kind[1:][pair[:-1]] = _LETTERS
    strange = (raw >= 0x80) & (kind != _LETTERS) | (raw == 0x27)
    strange[:-1] |= (raw[:-1] == 0x3C) & (raw[1:] == 0x7C)  # a special token may start here
    white = kind == _WHITE
    word = np.cumsum(~white & (first | np.append(True, white[:-1]))) if len(raw) else np.zeros(0, np.int64)
    has = np.zeros(int(word[-1]) + 1 if len(raw) else 1, bool)
    has[word[strange & ~white]] = True
    whole = has[word] if len(raw) else np.zeros(0, bool)
    change = np.zeros(len(raw), bool)
    change[1:] = (kind[1:] != kind[:-1]) & ~white[1:] & ~white[:-1] & ~first[1:] & ~whole[1:]
    return kind, change, whole


class Tokens:
    """A tokenizer file; sent to tasks as its bytes, built once in each worker, with the units that the worker knows."""

    _built: dict[tuple, object] = {}

    def __init__(self, path: str):
        if os.path.getsize(path) > MAX_FILE_BYTES:
            raise ValueError(f"{path} is larger than {MAX_FILE_BYTES} bytes, too large to send to every task")
        with open(path, "rb") as file:
            self.data = file.read()

    def _once(self, kind: str, build: Callable):
        key = (type(self).__name__, kind, len(self.data), hash(self.data))
        if key not in self._built:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            self._built[key] = build()
        return self._built[key]

    def cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes, the ends of units in them (they follow each other without gaps), and the row of each unit."""
        raise NotImplementedError

    def fresh(self, units: list[bytes]) -> list[list[int]]:
        """The ids of some units."""
        raise NotImplementedError

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each text has."""
        data, ends, rows = self.cut(texts)
        if not len(ends):
            return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        offsets = np.append(0, ends)
        kind, width = (pa.binary(), np.int32) if offsets[-1] < 2**31 else (pa.large_binary(), np.int64)
        units = pa.Array.from_buffers(kind, len(ends), [None, pa.py_buffer(offsets.astype(width)), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        store: _Known = self._once("known", _Known)
        numbers = store.numbers(units.dictionary.to_pylist(), self.fresh)
        flat, sizes = gather(store.at, store.size, store.flat, numbers[units.indices.to_numpy(zero_copy_only=False)])
        return flat.astype(np.int64), np.bincount(rows, weights=sizes, minlength=len(texts)).astype(np.int64)


class _Known:
    """The ids of the units that this worker has met."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.at, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.bytes = 0

    def numbers(self, units: list[bytes], fresh: Callable) -> np.ndarray:
        if len(self.number) > KNOWN or self.bytes > KNOWN_BYTES:
            self.clear()
        new = [u for u in units if u not in self.number]
        if new:
            found = [x for low in range(0, len(new), AT_ONCE) for x in fresh(new[low : low + AT_ONCE])]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            known = len(self.number)
            self.number.update(zip(new, range(known, known + len(new)), strict=True))
            self.at = np.concatenate([self.at, len(self.flat) + np.cumsum(sizes) - sizes])
            self.size = np.concatenate([self.size, sizes])
            self.flat = np.concatenate([self.flat, np.fromiter((i for x in found for i in x), np.int32, int(sizes.sum()))])
            self.bytes += sum(map(len, new))
        return np.fromiter(map(self.number.__getitem__, units), np.int64, len(units))


class _Json(Tokens):
    plain_special = True

    def library(self):
        def build():
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_str(self.data.decode())
            tokenizer.encode_special_tokens = self.plain_special
            return tokenizer, tokenizer.model

        return self._once("library", build)

    def fresh(self, units: list[bytes]) -> list[list[int]]:
        tokenizer, model = self.library()
        letters = [_ONLY_LETTERS.fullmatch(u) is not None for u in units]
        others = [u.decode() for u, plain in zip(units, letters, strict=True) if not plain]
        rest = iter(tokenizer.encode_batch_fast(others, add_special_tokens=False) if others else [])
        # A run of letters is one word to the tokenizer, which goes to its merges as it is.
        return [[t.id for t in model.tokenize(u.decode("latin-1").translate(_LETTER_OF))] if plain else next(rest).ids for u, plain in zip(units, letters, strict=True)]


class ByteBpe(_Json):
    """Byte-level BPE from a `tokenizers` file, strings of special tokens being plain text."""

    def cut(self, texts):
        raw, at = buffer_of(texts)
        if not len(raw):
            return raw, np.zeros(0, np.int64), np.zeros(0, np.int64)
        first = _starts(at, len(raw))
        kind, start, _ = _plain(raw, first)
        white = kind == _WHITE
        before, after = np.append(False, white[:-1]) & ~first, np.append(~white[1:] & ~first[1:], False)
        space = np.append(False, raw[:-1] == 0x20)
        start |= first | white & ~before | ~white & before & ~space | white & before & after
        wide = pc.fill_null(pc.match_substring_regex(texts, _WIDE_SPACE), False).to_numpy(zero_copy_only=False)
        start &= first | ~np.repeat(wide, np.diff(at))
        begins = np.flatnonzero(start)
        return raw, np.append(begins[1:], len(raw)), np.searchsorted(at, begins, "right") - 1

    def token_bytes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each id where its bytes start, how many there are, and all bytes."""
        back = {c: b for b, c in _LETTER_OF.items()}
        return self._once("bytes", lambda: _table({i: bytes(back[c] for c in token) for token, i in json.loads(self.data)["model"]["vocab"].items()}))


class WordBpe(_Json):
    """BPE with word ends from a `tokenizers` file, white space dropped; strings of special tokens are special, as the file says."""

    plain_special = False

    def cut(self, texts):
        raw, at = buffer_of(texts)
        if not len(raw):
            return raw, np.zeros(0, np.int64), np.zeros(0, np.int64)
        first = _starts(at, len(raw))
        kind, start, whole = _plain(raw, first)
        # Lower case beforehand, so that there are fewer distinct words.
        low = LOWER[raw]
        lead = np.append(False, raw[:-1] == 0xC3)
        low = np.where(lead & (raw >= 0x80) & (raw <= 0x9E) & (raw != 0x97), raw + 0x20, low).astype(np.uint8)
        low = np.where(whole, raw, low)
        white = kind == _WHITE
        start |= ~white & (first | np.append(True, white[:-1]))
        kept = np.cumsum(~white)
        begins = np.flatnonzero(start)
        ends = np.append(kept[begins[1:]] - 1, kept[-1]) if len(begins) else np.zeros(0, np.int64)
        return low[~white], ends, np.searchsorted(at, begins, "right") - 1


class Pieces(Tokens):
    """A `sentencepiece` model with byte pieces that puts a space before a text and changes nothing else."""

    def library(self):
        def build():
            from sentencepiece import SentencePieceProcessor

            model = SentencePieceProcessor(model_proto=self.data)
            pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
            alone = not any(re.search("[^▁]▁", p) for p in pieces) and model.encode("a  b ") == [*model.encode("a"), model.piece_to_id("▁"), *model.encode("b"), model.piece_to_id("▁")]
            return model, alone

        return self._once("library", build)

    def cut(self, texts):
        """The texts already have their space in front."""
        raw, at = buffer_of(texts)
        if not len(raw):
            return raw, np.zeros(0, np.int64), np.zeros(0, np.int64)
        first = _starts(at, len(raw))
        start = first.copy()
        if self.library()[1]:
            space = raw == 0x20
            start[1:] |= space[1:] & ~space[:-1]
        begins = np.flatnonzero(start)
        return raw, np.append(begins[1:], len(raw)), np.searchsorted(at, begins, "right") - 1

    def fresh(self, units):
        model, _ = self.library()
        lone = [model.piece_to_id("▁")]
        found = model.encode([u[1:].decode() for u in units], num_threads=1)
        return [ids if len(u) > 1 else lone for ids, u in zip(found, units, strict=True)]

    def token_bytes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        def build():
            model = self.library()[0]
            pieces = {i: model.id_to_piece(i) for i in range(model.get_piece_size())}
            return _table({i: bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in pieces.items()})

        return self._once("bytes", build)


def _table(token: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(token.get(i, b"")) for i in range(max(token) + 1)], np.int64)
    return np.cumsum(sizes) - sizes, sizes, np.frombuffer(b"".join(token.get(i, b"") for i in range(len(sizes))), np.uint8)
