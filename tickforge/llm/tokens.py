"""Token ids of whole texts inside tasks, with each distinct word encoded once per worker.

Both encoders cut a text only where the tokenizer itself always cuts it, so ids are those of the whole text.
The vocabulary files are those of the installed tokenizer package; their path is a parameter.
Strings of special tokens in a text are ordinary text. Ids are packed as little-endian unsigned integers of 2 bytes, or 4.
"""

from __future__ import annotations

import os
import re
import sys
import unicodedata
from array import array

import numpy as np
import pyarrow as pa

from .common import LOWER, RUN_BYTES, SPACED, bytes_of, runs

#: Words that a worker remembers (some 100 MB); common ones come early.
CACHE = 500_000
#: Runs of marks at words' ends that a worker remembers.
TAILS = 4096
#: White space other than single spaces and line feeds: such texts are encoded whole.
ODD = re.compile(rb"[ \n][ \n]|[\x00\t\x0b\x0c\r\x1c-\x1f]|\xc2[\x85\xa0]|\xe1(?:\x9a\x80|\xa0\x8e)|\xe2(?:\x80[\x80-\x8f\xa8\xa9\xaf]|\x81[\x9f\xa0])|\xe3\x80\x80|\xef\xbb\xbf")
#: Bytes that such white space begins with, in UTF-8.
SUSPECT = np.zeros(256, bool)
SUSPECT[[0x09, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3, 0xEF]] = True
#: A run of these after a letter or digit is one token of both pre-tokenizers (an apostrophe may begin a contraction).
PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum() and b != 0x27)
MARK_BYTES, ALNUM_BYTES, LATIN_LEADS = np.zeros((3, 256), bool)
MARK_BYTES[list(PUNCTUATION)] = True
ALNUM_BYTES[[b for b in range(128) if chr(b).isalnum()]] = True
#: First bytes of U+00C0 to U+017F, which are letters in either case, but for those whose second bytes are 0x97 and 0xB7 (signs) and
#: 0xB0 (lower-casing U+0130 gives a mark).
LATIN_LEADS[[0xC3, 0xC4, 0xC5]] = True
LATIN_NEXT = np.zeros(256, bool)
LATIN_NEXT[0x80:0xC0] = True
LATIN_NEXT[[0x97, 0xB0, 0xB7]] = False
#: Bytes of words, and those that aren't; bytes after which a unit of 'byte' is at its end.
WORD_BYTES = SPACED.copy()
WORD_BYTES[0] = False
BLANKS = bytes(np.flatnonzero(~WORD_BYTES).tolist())
BYTE_ENDS = np.zeros(256, bool)
BYTE_ENDS[[0, 10, 32]] = True


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def of_class(data: bytes, members: np.ndarray) -> np.ndarray:
    """Which bytes belong to a class of bytes (256 booleans); a translation takes a quarter of an index's time."""
    return np.frombuffer(data.translate(members.tobytes()), bool)


def byte_alphabet() -> str:
    """The character that byte-level models use for each byte: itself if printable, else the next one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return "".join(chr(b if b in printable else next(other)) for b in range(256))


class Encoder:
    """Packed ids of texts; `known` has those of the units met so far.

    kind 'word': lower-casing, drops white space; a unit is a word. kind 'byte': byte-level, a word takes the space
    before it; a unit is a word without that space, or a line feed or (at a text's start) a zero byte and a word.
    A run of marks that ends a word is a unit of its own, so that a word is known whatever marks follow it; for 'byte',
    where no space comes before it, its first byte has the high bit set (no other unit has such a byte before none or one below 0x80).
    Letters alone are one token of the pre-tokenizer, so the library's model encodes them directly; all else goes
    through the whole library.
    """

    def __init__(self, path: str, kind: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a task for each core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.tokenize, self.alphabet, self.kind = self.library.model.tokenize, byte_alphabet(), kind
        self.known: dict[bytes, bytes] = {}
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.line = self._library("\n")
        self.space = self.alphabet[32] if kind == "byte" else ""
        self.tails: dict[bytes, bytes] = {}

    def _pack(self, ids: list[int]) -> bytes:
        packed = array(self.code, ids)
        if sys.byteorder == "big":
            packed.byteswap()
        return packed.tobytes()

    def _library(self, text: str) -> bytes:
        return self._pack(self.library.encode(text, add_special_tokens=False).ids)

    def _letters(self, body: bytes) -> str | None:
        """The body in the model's alphabet if the pre-tokenizer leaves it whole and no normalizer changes it."""
        if body.isalpha():
            return body.decode()
        text = body.decode()
        if self.kind == "word" and max(text, default="") < "\u0100":
            text = text.lower()  # as the normalizer does: one letter each, composed
        if text.isalpha() and (self.kind == "byte" or (text.lower() == text and unicodedata.is_normalized("NFC", text))):
            return text.encode().decode("latin-1").translate(self.alphabet)
        return None

    def _learn(self, unit: bytes) -> bytes:
        if self.kind == "byte" and unit[0] >= 0x80 and unit[1:2] < b"\x80":
            return self._tail(bytes([unit[0] & 0x7F]) + unit[1:])
        lead, body, space = b"", unit, self.space
        if self.kind == "byte" and unit[0] in (0, 10):
            lead, body, space = self.line if unit[0] else b"", unit[1:], ""
        letters = self._letters(body)
        if letters is not None:
            return lead + self._pack([t.id for t in self.tokenize(space + letters)])
        if self.kind == "byte":
            return self._library(unit[1:].decode() if unit[:1] == b"\0" else unit.decode() if unit[:1] == b"\n" else " " + unit.decode())
        return self._library(unit.decode())

    def _tail(self, tail: bytes) -> bytes:
        """The ids of a run of marks after a letter."""
        ids = self.tails.get(tail)
        if ids is None:
            ids = self._library(tail.decode())
            if len(self.tails) < TAILS:
                self.tails[tail] = ids
        return ids

    def _learn_all(self, units: list[bytes]) -> list[bytes]:
        """Packed ids of new units; those of plain letters take no call but the model's."""
        out, tokenize, space, code, big = [], self.tokenize, self.space, self.code, sys.byteorder == "big"
        for unit in units:
            if unit.isalpha():
                packed = array(code, [t.id for t in tokenize(space + unit.decode())])
                if big:
                    packed.byteswap()
                out.append(packed.tobytes())
            else:
                out.append(self._learn(unit))
        room = max(CACHE - len(self.known), 0)
        self.known.update(zip(units[:room], out[:room]))
        return out

    def _tails(self, joined: bytes, between: np.ndarray) -> np.ndarray:
        """Where runs of marks begin that follow a letter or digit and end a unit: the pre-tokenizers always cut there."""
        data, marks = np.frombuffer(joined, np.uint8), of_class(joined, MARK_BYTES)
        turns = np.flatnonzero(marks[1:] != marks[:-1]) + 1
        begins, ends = turns[::2], turns[1::2]
        if len(ends) < len(begins):
            ends = np.append(ends, len(data))
        last, lead = data[begins - 1], data[begins - 2]
        letter = ALNUM_BYTES[last] | (LATIN_LEADS[lead] & LATIN_NEXT[last])
        return begins[letter & ((ends == len(data)) | between[data[np.minimum(ends, len(data) - 1)]])]

    def _units(self, joined: bytes, sizes: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """The units of all texts side by side, and where each text's begin; joined: texts of these sizes, a zero byte before each."""
        data = np.frombuffer(joined, np.uint8)
        texts = np.append(0, np.cumsum(sizes + 1))
        if self.kind == "word":
            inside = of_class(joined, WORD_BYTES)
            starts = inside.copy()
            starts[1:] &= ~inside[:-1]
            starts[self._tails(joined, ~WORD_BYTES)] = True
            begins = np.flatnonzero(starts)
            offsets = np.append(np.cumsum(inside, dtype=np.int32 if len(data) < 1 << 31 else np.int64)[begins].astype(np.int64) - 1, 0)
            body = joined.translate(LOWER.tobytes(), BLANKS)
        else:
            starts = (data == 0) | (data == 10)
            starts[1:] |= data[:-1] == 32
            starts[self._tails(joined, BYTE_ENDS)] = True
            begins = np.flatnonzero(starts)
            spaced = data[begins - 1] == 32  # never the last byte, which the first unit looks at
            offsets = np.append(begins - np.cumsum(spaced), 0)
            own = data[begins]
            tails = offsets[:-1][~spaced & (own != 0) & (own != 10)]
            body = np.frombuffer(joined.translate(None, b" "), np.uint8).copy()
            body[tails] |= 0x80
        offsets[-1] = len(body)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(body)])
        return words, np.searchsorted(begins, texts)

    def _odd(self, texts: list[bytes], joined: bytes, sizes: np.ndarray) -> list[bool]:
        """Which texts have to be encoded whole: zero bytes, and for 'byte' white space other than single spaces and line feeds."""
        if joined.count(0) == len(texts) and self.kind == "word":
            return [False] * len(texts)
        if self.kind == "word":
            return [b"\0" in t for t in texts]
        data = np.frombuffer(joined, np.uint8)
        space = (data == 32) | (data == 10)
        look = of_class(joined, SUSPECT).copy()
        look[1:] |= space[1:] & space[:-1]
        suspects = set((np.searchsorted(np.append(0, np.cumsum(sizes + 1)), np.flatnonzero(look), "right") - 1).tolist())
        return [t[-1:] == b" " or (i in suspects and ODD.search(t) is not None) or b"\0" in t for i, t in enumerate(texts)]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The packed ids of each text; a unit that recurs among the texts is looked up once."""
        if not texts:
            return []
        joined, sizes = b"\0" + b"\0".join(texts), np.fromiter(map(len, texts), np.int64, len(texts))
        odd = self._odd(texts, joined, sizes)
        if any(odd):
            plain = [b"" if o else t for t, o in zip(texts, odd)]
            joined, sizes = b"\0" + b"\0".join(plain), np.fromiter(map(len, plain), np.int64, len(plain))
        words, first = self._units(joined, sizes)
        coded = words.dictionary_encode()
        units = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # bytes, ten times as fast as to_pylist
        ids = list(map(self.known.get, units))
        new = [i for i, x in enumerate(ids) if x is None]
        for i, x in zip(new, self._learn_all([units[i] for i in new])):
            ids[i] = x
        offsets = np.append(0, np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids))))
        packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(offsets), pa.py_buffer(b"".join(ids))])
        taken = packed.take(coded.indices)
        flat = taken.buffers()[2].to_pybytes() if len(taken) else b""
        cuts = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1)[first].tolist() if len(taken) else [0] * len(first)
        return [self._library(t.decode()) if o else flat[i:j] for t, o, i, j in zip(texts, odd, cuts[:-1], cuts[1:])]


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, kind: str) -> Encoder:
    """One a worker process, kept from task to task."""
    if (path, kind) not in _ENCODERS:
        _ENCODERS[path, kind] = Encoder(path, kind)
    return _ENCODERS[path, kind]


def forget() -> None:
    """Frees what this worker process has learned, and Arrow's unused memory, for stages that encode no more."""
    _ENCODERS.clear()
    pa.default_memory_pool().release_unused()


def small_batches(batches, rows: int = 2000):
    """Parts of Arrow batches, so that a task holds few encoded texts at a time."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def encoded(texts, path: str, kind: str, end_id: int):
    """(row, packed ids with end_id appended, dtype) for each text of an Arrow column; nulls are empty."""
    e = encoder(path, kind)
    end = np.array([end_id], e.dtype).tobytes()
    _, offsets = bytes_of(texts)
    for i, j in runs(offsets, 8 * RUN_BYTES):
        for k, ids in enumerate(e.encode([t or b"" for t in texts[i:j].to_pylist()])):
            yield i + k, ids + end, e.dtype
