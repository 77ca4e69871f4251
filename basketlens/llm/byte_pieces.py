"""Token ids of many texts by the `tokenizers` library, each distinct piece of text once.

A byte-level BPE first divides a text into pieces by a fixed pattern and then encodes every piece alone. Here the pieces of
a whole batch are found at once from the classes of its characters (letter, number, white space, other), the distinct ones
are numbered, and the library's model encodes those it has not met yet. The class of a character is asked of the library too, so
that both agree on every character. Texts that hold an added token, and tokenizers of another make, go to the library whole.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from basketlens.llm.shingles import powers
from basketlens.llm.wordstream import string_array, text_bytes

#: Bytes of text worked on at a time.
SLICE = 8 << 20
#: Pieces, and bytes of them, that are remembered before all are forgotten.
MEMO_PIECES, MEMO_BYTES = 1 << 20, 32 << 20
#: The letter that stands for each byte in a byte-level vocabulary: its own character where that is printed, else one of 256 on.
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_LETTERS = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in _PRINTED)}

_UNKNOWN, _LETTER, _NUMBER, _OTHER, _SPACE = range(5)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_CUT = re.compile(rb"(?<=[a-z]) (?=[a-z])")
_QUOTE, _BLANK = ord("'"), ord(" ")


def _hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit polynomial of the bytes of each word."""
    starts = np.frombuffer(words.buffers()[1], np.int32)[words.offset: words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[starts[0]: starts[-1]] if len(words) else np.zeros(0, np.uint8)
    terms = (data.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(data))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])[starts - starts[0]]
    return np.diff(sums) * powers(_INVERSE, len(data) + 1)[starts[:-1] - starts[0]]


@cache
def encoder(path: str) -> Encoder:
    """One encoder a worker process, so that later tasks know the pieces of earlier ones."""
    return Encoder(path)


class Encoder:
    """Ids as ``encode(text, add_special_tokens=False)`` gives them."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        split = made.get("pre_tokenizer") or {}
        self.by_piece = (split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
                         and made.get("normalizer") is None and made.get("truncation") is None and made.get("padding") is None
                         and not made["model"].get("dropout"))
        added = self.library.get_added_tokens_decoder().values()
        self.added = [t.content.encode() for t in added]
        self.vocabulary = self.library.get_vocab_size()
        self.classes = np.zeros(0x110000, np.uint8)
        self.model = self.library.model
        self._forget()

    def _forget(self) -> None:
        self.known = pa.array([], pa.string())
        self.hashes, self.order = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.flat, self.first, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text of a column, null as the empty text."""
        raw, starts = text_bytes(column)
        if not self.by_piece or any(token in raw for token in self.added):
            yield from self._whole(raw, starts)
            return
        first = 0
        while first < len(starts) - 1:
            last = max(first + 1, int(np.searchsorted(starts, starts[first] + SLICE, "right")) - 1)
            if starts[last] - starts[first] > 2 * SLICE:
                yield np.concatenate([self._slice(part, np.array([0, len(part)]))[0] for part in _parts(raw[starts[first]: starts[last]])])
            else:
                ids, counts = self._slice(raw[starts[first]: starts[last]], starts[first: last + 1] - starts[first])
                yield from np.split(ids, np.cumsum(counts)[:-1])
            first = last

    def _whole(self, raw: bytes, starts: np.ndarray) -> Iterator[np.ndarray]:
        for a, b in zip(starts.tolist(), starts[1:].tolist()):
            if self.by_piece and not any(token in raw[a:b] for token in self.added):
                yield np.concatenate([self._slice(part, np.array([0, len(part)]))[0] for part in _parts(raw[a:b])])
            else:
                yield np.array(self.library.encode(raw[a:b].decode(), add_special_tokens=False).ids, np.uint32)

    def _slice(self, raw: bytes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a run of texts and how many belong to each."""
        at = self.pieces(raw, starts)
        coded = string_array(np.frombuffer(raw, np.uint8), np.append(at, len(raw))).dictionary_encode()
        numbers = self._numbers(coded.dictionary)[np.asarray(coded.indices)]
        size = self.size[numbers]
        ends = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.repeat(self.first[numbers] - ends[:-1], size) + np.arange(ends[-1])]
        return ids, np.diff(ends[np.searchsorted(at, starts)])

    def _numbers(self, pieces: pa.Array) -> np.ndarray:
        """Which of the known pieces each piece is; the library encodes those not met before."""
        if len(self.known) > MEMO_PIECES or self.known.nbytes > MEMO_BYTES:
            self._forget()
        numbers, hashes = self._looked_up(pieces)
        missing = numbers < 0
        if missing.any():
            new = pieces.filter(pa.array(missing))
            ids, size = self._encoded(new)
            self.first = np.concatenate([self.first, len(self.flat) + np.cumsum(size) - size])
            self.size, self.flat = np.concatenate([self.size, size]), np.concatenate([self.flat, ids])
            numbers[missing] = np.arange(len(self.known), len(self.known) + len(new))
            self.known = pa.concat_arrays([self.known, new])
            every = np.concatenate([self.hashes, hashes[missing]])
            order = np.argsort(every, kind="stable")
            self.hashes, self.order = every[order], np.concatenate([self.order, numbers[missing]])[order]
        return numbers

    def _looked_up(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The number of each known piece, else -1, and the hash of each. Hashes only lead to a piece; texts are compared."""
        hashes = _hashes(pieces)
        numbers = np.full(len(pieces), -1)
        if len(self.known):
            ascending = np.argsort(hashes)
            at = np.empty(len(pieces), np.int64)
            at[ascending] = np.searchsorted(self.hashes, hashes[ascending])
            at = np.minimum(at, len(self.hashes) - 1)
            same = np.flatnonzero(self.hashes[at] == hashes)
            numbers[same] = self.order[at[same]]
            if not pc.all(pc.equal(pieces.take(pa.array(same)), self.known.take(pa.array(numbers[same])))).as_py():
                numbers = pc.index_in(pieces, value_set=self.known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        return numbers, hashes

    def _encoded(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces by the library's model, one after the other, and how many each has."""
        raw, starts = text_bytes(pieces)
        letters = raw.decode("latin-1").translate(BYTE_LETTERS)
        ids, size = [], []
        for a, b in zip(starts.tolist(), starts[1:].tolist()):
            found = self.model.tokenize(letters[a:b])
            size.append(len(found))
            ids += [token.id for token in found]
        return np.array(ids, np.uint32), np.array(size, np.int64)

    def _classified(self, points: np.ndarray) -> np.ndarray:
        found = self.classes[points]
        if not found.all():
            divide = self.library.pre_tokenizer.pre_tokenize_str
            for point in np.unique(points[found == _UNKNOWN]).tolist():
                kinds = [kind for kind, lead in ((_LETTER, "a"), (_NUMBER, "1"), (_OTHER, "!")) if len(divide(lead + chr(point))) == 1]
                self.classes[point] = kinds[0] if kinds else _SPACE
            found = self.classes[points]
        return found

    def pieces(self, raw: bytes, starts: np.ndarray) -> np.ndarray:
        """The byte at which each piece of a run of texts begins.

        Runs of letters, of numbers and of other characters are pieces, with a blank before them. White space is a piece up
        to its last character, which stands alone, or leads the next piece if it is a blank; at the end of a text it is one
        piece. A quote that begins a piece takes s, t, m, d, re, ve or ll from the letters after it.
        """
        if raw.isascii():
            points, place, begins = np.frombuffer(raw, np.uint8), None, starts
        else:
            points = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
            width = np.ones(len(points), np.uint8)
            for least in (0x80, 0x800, 0x10000):
                width += points >= least
            place = np.zeros(len(points) + 1, np.int64)
            np.cumsum(width, out=place[1:])
            begins = np.searchsorted(place, starts)
        n = len(points)
        if not n:
            return np.zeros(0, np.int64)
        kinds = self._classified(points)
        edge = np.zeros(n + 1, bool)
        edge[begins] = True
        edge[n] = True
        space = kinds == _SPACE
        new = edge[:-1].copy()
        new[1:] |= kinds[1:] != kinds[:-1]
        led = np.zeros(n, bool)
        led[1:] = (points[:-1] == _BLANK) & ~edge[1:-1] & ~space[1:]
        first = new & ~led
        first[:-1] |= space[:-1] & ~space[1:] & ~edge[1:-1]
        quotes = np.flatnonzero((points == _QUOTE) & first)
        quotes = quotes[~edge[quotes + 1]]
        after = points[quotes + 1]
        short = np.isin(after, [ord(c) for c in "stmd"])
        second = np.where(edge[quotes + 2 - edge[quotes + 1]] | (quotes + 2 >= n), 0, points[np.minimum(quotes + 2, n - 1)])
        long = ((after == ord("r")) | (after == ord("v"))) & (second == ord("e")) | (after == ord("l")) & (second == ord("l"))
        for taken, length in ((quotes[short], 2), (quotes[long & ~short], 3)):
            first[taken + 1] = False
            end = taken + length
            first[end[end < n]] = True
        at = np.flatnonzero(first)
        return at if place is None else place[at]


def _parts(raw: bytes) -> Iterator[bytes]:
    """A long text in parts that begin at a blank between two letters a-z, where a piece begins whatever surrounds them."""
    a = 0
    while len(raw) - a > SLICE and (found := _CUT.search(raw, a + SLICE)):
        yield raw[a: found.start()]
        a = found.start()
    yield raw[a:]
