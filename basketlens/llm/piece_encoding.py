"""Merge-type subword encoding and decoding, exact, by backtracking.

Instead of replaying the merges of a whole text, tokens are laid from left to right: at each place the longest
vocabulary match (Aho-Corasick) is tried first, and a token may follow its neighbour only if re-merging the two side by
side gives these two again. Where no token fits, the place is marked in a bitfield of failed positions and the previous
token gives way to its next shorter match. Adjacent pairs that all survive re-merging are the encoding of the merges.

No piece has the word mark after another character, so a text is cut into words there (checked when the model is loaded;
else it is encoded in one stretch), and where characters meet that no chain of pieces connects, as letters and punctuation. Equal
words are encoded once per worker.

Defined results: a null text is empty; an empty text has no ids and decodes to an empty text. Characters without a piece
become byte pieces. Very long texts and very long words are encoded whole. Repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Entries of a worker's memo of encoded words; when full it becomes the older one, which is asked second. Checked token
#: pairs are forgotten at as many. Longer words than MEMO_LETTERS are not remembered, which bounds the memo's bytes.
MEMO, MEMO_LETTERS = 200_000, 48
#: Letters up to which merges look for the best neighbours by scanning all of them, not by a queue.
SCANNED = 40
NO_PIECE = float("-inf")
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protobuf message: number, and an integer, four raw bytes or a slice."""
    at, end = 0, len(data)

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < end:
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, data[at: at + size]
            at += size


class PieceEncoder:
    """Encoder and decoder of one merge-type model file with byte fallback and an identity normaliser."""

    def __init__(self, path: str) -> None:
        import struct

        with open(path, "rb") as file:
            model = list(_fields(file.read()))
        pieces: list[tuple[str, float, int]] = []
        for number, value in model:
            if number == 1:
                parts = dict(_fields(value))
                pieces.append((parts[1].decode(), struct.unpack("<f", parts.get(2, bytes(4)))[0], parts.get(3, NORMAL)))
        trainer, normalizer = (dict(_fields(next((v for n, v in model if n == k), b""))) for k in (2, 3))
        if trainer.get(3) != 2 or any(kind == USER_DEFINED for *_, kind in pieces):
            raise ValueError("only merge-type models without user-defined pieces are encoded here")
        if normalizer.get(2) or normalizer.get(4, 1):
            raise ValueError("only an identity normaliser that keeps white space is supported")
        self.prefix = bool(normalizer.get(3, 1))
        self.pieces = [piece for piece, *_ in pieces]
        self.ids = {piece: i for i, (piece, _, kind) in enumerate(pieces) if kind in (NORMAL, UNUSED)}
        self.score = {piece: pieces[i][1] for piece, i in self.ids.items()}
        self.unknown = next(i for i, (*_, kind) in enumerate(pieces) if kind == UNKNOWN)
        byte_ids = {int(piece[3:5], 16): i for i, (piece, _, kind) in enumerate(pieces) if kind == BYTE}
        self.byte_ids = [byte_ids[b] for b in range(256)] if byte_ids else None
        self.byte_of = {i: b for b, i in byte_ids.items()}
        self.plain = set(self.ids.values())
        self.control = {i for i, (*_, kind) in enumerate(pieces) if kind == CONTROL}
        # a piece its own merges never reach is never a token
        self.tokens_of_merges = {piece for piece in self.ids if len(piece) == 1 or self.merge(piece) == [piece]}
        self.longest = max(map(len, self.tokens_of_merges))
        self.matches = ahocorasick.Automaton()
        for piece in self.tokens_of_merges:
            self.matches.add_word(piece, len(piece))
        self.matches.make_automaton()
        crossed = any(MARK in piece.lstrip(MARK) for piece in self.tokens_of_merges)
        joined = re.escape(self._joined_letters())
        self.words = None if crossed else re.compile(f"{MARK}*[{joined}]+|{MARK}*[^{MARK}{joined}]+|{MARK}+" if joined else f"{MARK}*[^{MARK}]+|{MARK}+")
        self.decimal = [str(i) for i in range(len(pieces))]
        self.spaced = [piece.replace(MARK, " ") for piece in self.pieces]
        self.memo: dict[str, str | tuple[str, str]] = {}
        self.older: dict[str, str | tuple[str, str]] = {}
        self.pairs: dict[tuple[str, str], bool] = {}

    def _joined_letters(self) -> str:
        """The most characters that neighbours in pieces connect: beside any other character they are never merged."""
        group: dict[str, set[str]] = {}
        for piece in self.ids:
            for a, b in zip(piece, piece[1:]):
                one, two = (group.setdefault(c, {c}) for c in (a, b))
                if MARK not in (a, b) and one is not two:
                    one, two = sorted((one, two), key=len)
                    two |= one
                    group.update(dict.fromkeys(one, two))
        return "".join(sorted(max(group.values(), key=lambda g: (len(g), min(g)), default=())))

    def merge(self, text: str) -> list[str]:
        """The definition: join the neighbours of the highest score, leftmost first, until none is a piece."""
        if len(text) <= SCANNED:
            parts, score = list(text), self.score.get
            scores = [score(a + b, NO_PIECE) for a, b in zip(parts, parts[1:])]
            while scores and (best := max(scores)) > NO_PIECE:
                i = scores.index(best)
                parts[i: i + 2] = [parts[i] + parts[i + 1]]
                del scores[i]
                if i:
                    scores[i - 1] = score(parts[i - 1] + parts[i], NO_PIECE)
                if i < len(scores):
                    scores[i] = score(parts[i] + parts[i + 1], NO_PIECE)
            return parts
        symbols, left, right = list(text), list(range(-1, len(text) - 1)), [*range(1, len(text)), -1]
        queue: list[tuple[float, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (score := self.score.get(joined := symbols[a] + symbols[b])) is not None:
                heapq.heappush(queue, (-score, a, b, joined))

        for i in range(len(text) - 1):
            offer(i, i + 1)
        while queue:
            _, a, b, joined = heapq.heappop(queue)
            if not symbols[a] or not symbols[b] or symbols[a] + symbols[b] != joined:
                continue
            symbols[a], symbols[b] = joined, ""
            right[a] = right[b]
            if right[a] >= 0:
                left[right[a]] = a
            offer(left[a], a)
            offer(a, right[a])
        return [s for s in symbols if s]

    def compatible(self, a: str, b: str) -> bool:
        """Whether re-merging two tokens side by side leaves them as they are."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= 2 * MEMO:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merge(a + b) == [a, b]
        return known

    def tokens(self, text: str) -> list[str]:
        """Tokens of a stretch of known or unknown characters."""
        n, known, pairs, width = len(text), self.tokens_of_merges, self.pairs, self.longest
        failed, out, last, at = bytearray(n // 8 + 1), [], None, 0
        match = self.matches.longest_prefix
        size = match(text[:width]) or 1
        while at < n:
            while size:
                end, token = at + size, text[at: at + size]
                if (token in known or size == 1) and not failed[end >> 3] >> (end & 7) & 1:
                    fits = last is None or pairs.get((last, token))
                    if fits is None:
                        fits = self.compatible(last, token)
                    if fits:
                        break
                size -= 1
            if size:
                out.append(token)
                last, at = token, end
                size = match(text[at: at + width]) or 1
            else:  # no token fits here: mark the place, shorten the previous token
                failed[at >> 3] |= 1 << (at & 7)
                last = out.pop()
                at -= len(last)
                size = len(last) - 1
                last = out[-1] if out else None
        return out

    def _encode_word(self, word: str) -> list[int]:
        ids: list[int] = []
        for token in self.tokens(word):
            if (known := self.ids.get(token)) is not None:
                ids.append(known)
            elif self.byte_ids:
                ids.extend(self.byte_ids[b] for b in token.encode("utf-8", "surrogatepass"))
            else:
                ids.append(self.unknown)
        return ids

    def _cuts(self, text: str) -> list[str]:
        text = (MARK if self.prefix else "") + text.replace(" ", MARK)
        return self.words.findall(text) if self.words else [text]

    def encode(self, text: str) -> list[int]:
        return [i for word in self._cuts(text) for i in self._encode_word(word)] if text else []

    def decode(self, ids: list[int]) -> str:
        """The text of a list of ids: bytes are read as UTF-8, the dummy prefix goes."""
        first = next((i for i in ids if i not in self.control), self.unknown)
        text = self._decode_inner(ids)
        return text[1:] if self.prefix and self.spaced[first][0] == " " else text

    def _decode_inner(self, ids: list[int]) -> str:
        if self.plain.issuperset(ids):
            return "".join([self.spaced[i] for i in ids])
        out, pending = [], bytearray()

        def flush() -> None:
            if pending:
                out.append(decode_bytes(bytes(pending)))
                pending.clear()

        for i in ids:
            if i in self.byte_of:
                pending.append(self.byte_of[i])
                continue
            flush()
            if i == self.unknown:
                out.append(" ⁇ ")
            elif i not in self.control:
                out.append(self.spaced[i])
        flush()
        return "".join(out)

    def _remembered(self, word: str) -> str | tuple[str, str]:
        """The ids of a word in decimal, joined by commas; with the decoded text where that is not the word itself."""
        row = self.memo.get(word) or self.older.get(word)
        if row is None:
            ids = self._encode_word(word)
            row, back = ",".join([self.decimal[i] for i in ids]), self._decode_inner(ids)
            if back != word.replace(MARK, " "):
                row = row, back
        if len(word) <= MEMO_LETTERS:
            if len(self.memo) >= MEMO:
                self.older, self.memo = self.memo, {}
            self.memo[word] = row
        return row

    def summary(self, text: str) -> tuple[int, str, str]:
        """Count of ids, the ids in decimal joined by commas, and the decoded text; equal words are worked out once."""
        if not text:
            return 0, "", ""
        words = self._cuts(text)
        rows = list(map(self.memo.get, words))
        if None in rows:
            rows = [self._remembered(word) if row is None else row for word, row in zip(words, rows)]
        if tuple in set(map(type, rows)):
            pairs = [row if isinstance(row, tuple) else (row, word.replace(MARK, " ")) for word, row in zip(words, rows)]
            rows, back = [row for row, _ in pairs], "".join([part for _, part in pairs])
        else:
            back = "".join(words).replace(MARK, " ")
        ids = ",".join(rows)
        return ids.count(",") + 1, ids, back[1:] if self.prefix and back[:1] == " " else back


def decode_bytes(data: bytes) -> str:
    """UTF-8 with one replacement character for each byte that is not part of a character."""
    out, at = [], 0
    while at < len(data):
        for size in (1, 2, 3, 4):
            try:
                out.append(data[at: at + size].decode())
            except UnicodeDecodeError:
                continue
            at += size
            break
        else:
            out.append("�")
            at += 1
    return "".join(out)


_LOADED: dict[str, PieceEncoder] = {}


def loaded(path: str) -> PieceEncoder:
    """The encoder of this worker process."""
    if path not in _LOADED:
        _LOADED[path] = PieceEncoder(path)
    return _LOADED[path]


def encoded(text: Column, path: str) -> Column:
    """Ids of each text."""
    @F.arrow_udf("array<int>")
    def run(column: pa.Array) -> pa.Array:
        encoder = loaded(path)
        return pa.array([encoder.encode(t or "") for t in column.to_pylist()], pa.list_(pa.int32()))

    return run(text)


def decoded(ids: Column, path: str) -> Column:
    """Text of each list of ids; null as an empty list."""
    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        encoder = loaded(path)
        return pa.array([encoder.decode(i or []) for i in column.to_pylist()], pa.string())

    return run(ids)


def encode_digests(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``; columns of these names are replaced."""
    @F.arrow_udf("struct<n_tokens: bigint, ids_sha256: string, decoded_sha256: string>")
    def run(column: pa.Array) -> pa.Array:
        encoder, rows = loaded(path), []
        for t in column.to_pylist():
            count, ids, back = encoder.summary(t or "")
            rows.append((count, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest()))
        counts, ids, texts = zip(*rows) if rows else ((), (), ())
        return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], ["n_tokens", "ids_sha256", "decoded_sha256"])

    row = run.asNondeterministic()(F.col(f"`{text}`"))
    names = ("n_tokens", "ids_sha256", "decoded_sha256")
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    return docs.select(*rest, row.alias("_encoded")).select(*rest, "_encoded.*")
