"""Encoding of whole texts by a public tokenizer, one white-space chunk at a time.

The tokenizer drops white space before it looks for words, so no token spans any: a text's ids are the
ids of its chunks in order. Chunks repeat, so each worker keeps the bytes and ids of those it has seen (a bounded
number, then it starts afresh), and the library is asked for new ones only. A hash finds a chunk, its bytes, compared
eight at a time, decide: a chunk whose hash belongs to another one is kept in a dictionary beside. A chunk of plain
characters is cut into the tokenizer's pre-tokens here and the library's model encodes each distinct one once; all
other chunks go through the whole library. Tests hold both against encoding whole texts.
"""

from __future__ import annotations

import functools
import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import mix64, public_tokenizer


#: Chunks of these characters only: each is one code point in normal form that lower-cases to one.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
#: The tokenizer file's own splitting rule, for lower-case plain chunks.
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")


_MARKS = b".,;:!?"


def _byte_letters() -> dict[int, int]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for code points from 256 on, in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return {b: 256 + n for n, b in enumerate(rest)}


@functools.lru_cache(maxsize=1)
def _powers(n: int, base: int = 0x9E3779B97F4A7C15) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def chunk_hashes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """64-bit hashes (never 0) of all chunks of joined bytes at once, from running sums."""
    power, inverse = _powers(1 << max(20, len(data).bit_length()))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.multiply(data, power[: len(data)], out=sums[1:])
    np.cumsum(sums, out=sums)
    begin, end = offsets[:-1], offsets[1:]
    return mix64((sums[end] - sums[begin]) * inverse[begin] + (end - begin).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)


def chunk_words(data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of chunks as 64-bit numbers, the last of each filled with zeros, and how many each chunk has. data: padded by 8 bytes."""
    view = np.ndarray((len(data) - 7,), "<u8", data.data, 0, (1,))
    n = (length + 7) >> 3
    inside = 8 * (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n))
    words = view[np.repeat(begin, n) + inside]
    left = np.repeat(length, n) - inside
    tail = np.flatnonzero(left < 8)
    words[tail] &= (np.uint64(1) << (8 * left[tail]).astype(np.uint64)) - np.uint64(1)
    return words, n


class HashIndex:
    """Numbers of known hashes, by open addressing over arrays: a batch is looked up by a few array operations."""

    def __init__(self, bits: int) -> None:
        self.keys, self.numbers, self.bits, self.size = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32), bits, 0

    def _slots(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The numbers, -1 where unknown."""
        out = np.full(len(hashes), -1, np.int64)
        who, slot = np.arange(len(hashes)), self._slots(hashes)
        while len(who):
            key = self.keys[slot]
            hit = key == hashes[who]
            out[who[hit]] = self.numbers[slot[hit]]
            go = ~hit & (key != 0)
            who, slot = who[go], (slot[go] + 1) & ((1 << self.bits) - 1)
        return out

    def add(self, hashes: np.ndarray, numbers: np.ndarray) -> None:
        """Distinct unknown hashes and their numbers."""
        who, slot = np.arange(len(hashes)), self._slots(hashes)
        while len(who):
            free = np.flatnonzero(self.keys[slot] == 0)
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.keys[slot[put]], self.numbers[slot[put]] = hashes[who[put]], numbers[who[put]]
            rest = np.ones(len(who), bool)
            rest[put] = False
            who, slot = who[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)
        self.size += len(hashes)


class ChunkTokenizer:
    def __init__(self, name: str = "word_bpe_49k.json", end: int = 2, most_chunks: int = 500_000, most_pieces: int = 250_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(public_tokenizer(name))
        self.model, self.letters, self.pieces = self.library.model, _byte_letters(), {}
        self.end, self.most_chunks, self.most_pieces = end, most_chunks, most_pieces
        self._clear()

    def _clear(self) -> None:
        self.index = HashIndex(max(8, (2 * self.most_chunks).bit_length()))
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.starts, self.lengths = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
        # the chunks themselves: words of eight bytes, where each begins, its bytes
        self.words, self.worded = np.zeros(1 << 16, np.uint64), 0
        self.at, self.sizes = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
        self.others: dict[bytes, int] = {}  # chunks whose hash belongs to another one
        self.known = 0

    def _piece(self, piece: str) -> bytes:
        letters = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
        ids = array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()
        self.pieces[piece] = ids
        return ids

    def _ids(self, new: list[bytes]) -> list[bytes]:
        """Ids of chunks: plain ones by their pieces, which repeat far more than chunks do; others by the library as they are."""
        got: list[bytes] = [b""] * len(new)
        odd = []
        pieces, piece = self.pieces, self._piece
        for i, chunk in enumerate(new):
            if chunk.isalpha():  # ASCII letters alone: one pre-token
                word = chunk.decode().lower()
                got[i] = pieces.get(word) or piece(word)
                continue
            if chunk[:-1].isalpha() and chunk[-1] in _MARKS:  # and with one mark behind them: two
                word, mark = chunk[:-1].decode().lower(), chr(chunk[-1])
                got[i] = (pieces.get(word) or piece(word)) + (pieces.get(mark) or piece(mark))
                continue
            text = chunk.decode()
            if _PLAIN.fullmatch(text) and "<|" not in text:
                got[i] = b"".join([pieces.get(p) or piece(p) for p in _PIECES.findall(text.lower())])
            else:
                odd.append(i)
        for i, e in zip(odd, self.library.encode_batch_fast([new[i].decode() for i in odd], add_special_tokens=False), strict=True):
            got[i] = np.array(e.ids, np.uint32).tobytes()
        return got

    def _learn(self, new: list[bytes]) -> np.ndarray:
        """Keeps chunks and their ids under the next numbers."""
        got = self._ids(new)
        padded = np.frombuffer(b"".join(new) + b"\0" * 8, np.uint8)
        bytes_ = np.fromiter(map(len, new), np.int64, len(new))
        words, n_words = chunk_words(padded, np.cumsum(bytes_) - bytes_, bytes_)
        sizes = np.fromiter(map(len, got), np.int64, len(got)) // 4
        total, at = int(sizes.sum()), self.known
        self.known += len(new)
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while self.worded + len(words) > len(self.words):
            self.words = np.concatenate([self.words, np.empty_like(self.words)])
        while self.known > len(self.starts):
            self.starts, self.lengths, self.at, self.sizes = (np.concatenate([a, np.zeros_like(a)]) for a in (self.starts, self.lengths, self.at, self.sizes))
        self.flat[self.used : self.used + total] = np.frombuffer(b"".join(got), np.uint32)
        self.starts[at : self.known] = self.used + np.cumsum(sizes) - sizes
        self.lengths[at : self.known] = sizes
        self.words[self.worded : self.worded + len(words)] = words
        self.at[at : self.known] = self.worded + np.cumsum(n_words) - n_words
        self.sizes[at : self.known] = bytes_
        self.used += total
        self.worded += len(words)
        return np.arange(at, self.known)

    def _differ(self, which: np.ndarray, data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Places of the chunks that are not the ones their hashes found."""
        alike = np.flatnonzero(self.sizes[which] == length)
        words, n = chunk_words(data, begin[alike], length[alike])
        kept = self.words[np.arange(len(words)) + np.repeat(self.at[which[alike]] - (np.cumsum(n) - n), n)]
        wrong = np.repeat(alike, n)[words != kept]
        if not len(wrong) and len(alike) == len(which):
            return wrong
        differ = self.sizes[which] != length
        differ[wrong] = True
        return np.flatnonzero(differ)

    def index_grow(self, more: int) -> None:
        old, bits = self.index, (2 * (self.index.size + more)).bit_length()
        self.index = HashIndex(max(bits, old.bits + 1))
        known = np.flatnonzero(old.keys)
        self.index.add(old.keys[known], old.numbers[known])

    def encode(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, each text's ended by the end id (null and empty texts: only that), and each text's number of ids."""
        if self.known > self.most_chunks or max(self.used, self.worded) > 8 * self.most_chunks:
            self._clear()
        if len(self.pieces) > self.most_pieces:
            self.pieces = {}
        # Arrow cuts the texts; only new chunks become Python objects
        cut = pc.fill_null(pc.ascii_split_whitespace(pc.fill_null(pa.array(texts, pa.large_binary()).cast(pa.large_string()), "")), [])
        flat = cut.flatten()
        _, where, raw = flat.buffers()
        offsets = np.frombuffer(where, np.int64)[flat.offset : flat.offset + len(flat) + 1] if len(flat) else np.zeros(1, np.int64)
        low, high = int(offsets[0]), int(offsets[-1])
        data = np.zeros(high - low + 8, np.uint8)
        if high > low:
            data[:-8] = np.frombuffer(raw, np.uint8, high - low, low)
        offsets = offsets - low
        hashes = chunk_hashes(data[:-8], offsets)
        which = self.index.find(hashes)
        unknown = np.flatnonzero(which < 0)
        if len(unknown):
            new, first = np.unique(hashes[unknown], return_index=True)
            if self.index.size + len(new) > 3 * len(self.index.keys) // 4:  # more new chunks at once than the table is made for
                self.index_grow(len(new))
            begins, ends = offsets[unknown[first]].tolist(), offsets[unknown[first] + 1].tolist()
            view = memoryview(data)
            self.index.add(new, self._learn([bytes(view[i:j]) for i, j in zip(begins, ends, strict=True)]))
            which[unknown] = self.index.find(hashes[unknown])
        if len(differ := self._differ(which, data, offsets[:-1], np.diff(offsets))):
            own = [data[i:j].tobytes() for i, j in zip(offsets[differ].tolist(), offsets[differ + 1].tolist(), strict=True)]
            fresh = [c for c in dict.fromkeys(own) if c not in self.others]
            self.others.update(zip(fresh, self._learn(fresh).tolist(), strict=True))
            which[differ] = [self.others[c] for c in own]
        chunks = np.diff(cut.offsets.to_numpy())
        lengths = self.lengths[which].astype(np.int64)
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        ids = np.full(total + len(texts), self.end, np.uint32)
        owner = np.repeat(np.arange(len(texts)), chunks)  # as many end ids stand before a text's own
        ids[np.arange(total) + np.repeat(owner, lengths)] = self.flat[np.arange(total) + np.repeat(self.starts[which] - (ends - lengths), lengths)]
        upto = np.concatenate([[0], ends])[np.cumsum(chunks)] if len(texts) else np.zeros(0, np.int64)
        return ids, np.diff(upto, prepend=0) + 1


@functools.lru_cache(maxsize=2)
def worker_tokenizer(name: str, end: int) -> ChunkTokenizer:
    """One per Python worker: Spark keeps workers between tasks, and with them the file read and the chunks learned."""
    return ChunkTokenizer(name, end)
