"""SentencePiece encoding and decoding with a unigram model.

A text is cut into vocabulary pieces so that the sum of their log scores is largest
(Viterbi over byte positions, arcs found in a double-array trie). A blank is part of a
piece (the file writes it as U+2581); one is put before the text and taken off again by
decoding. A character that no piece covers becomes its UTF-8 bytes, and so does a real
U+2581, so decoding gives every text back exactly.

No piece goes on after a blank that follows other characters, so the best cut of a text
is the best cuts of its chunks (blanks and what follows up to the next blank). Chunks
that were seen before are looked up; new ones of a batch run through the trie side by
side as arrays.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerloom.llm.common import ddl

MARK = "▁"
UNKNOWN_PENALTY = 10.0
_KNOWN_CHUNKS = 400_000
_SIDE_BY_SIDE = 64  # bytes; longer chunks are cut one by one
_ROWS = 256
_CHUNK = re.compile(rb" +[^ ]*")
_LENGTHS = np.array(
    [1 if b < 0xC0 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4 for b in range(256)], dtype=np.int64
)


@dataclass(frozen=True)
class Vocabulary:
    """Pieces as bytes with their log scores; bytes_ids[b] is the piece of byte b."""

    pieces: tuple[bytes, ...]
    scores: tuple[float, ...]
    normal: tuple[bool, ...]
    byte_ids: tuple[int, ...]

    def double_array(self) -> DoubleArray:
        return _compiled(self)


def load_vocabulary(path: str) -> Vocabulary:
    """Read a SentencePiece file on the driver.

    A unigram file's scores are log probabilities and stay. Files of merge rules only
    rank their pieces (scores 0, -1, -2, ...); a piece's log score is then that of
    Zipf's law at its rank.
    """
    import sentencepiece

    reader = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(reader.get_piece_size())
    kinds = [reader.is_control(i) or reader.is_unknown(i) or reader.is_unused(i) for i in ids]
    raw = [reader.get_score(i) for i in ids]
    ranked = all(s == int(s) for s in raw)
    if ranked:
        whole = math.log(sum(1 / (1 + k) for k in ids))
        raw = [-math.log(1 - s) - whole for s in raw]
    byte_ids = [-1] * 256
    pieces = []
    for i in ids:
        name = reader.id_to_piece(i)
        if reader.is_byte(i):
            byte_ids[int(name[3:5], 16)] = i
            pieces.append(bytes([int(name[3:5], 16)]))
        else:
            pieces.append(b"" if kinds[i] else name.replace(MARK, " ").encode())
    if -1 in byte_ids:
        raise ValueError("the vocabulary has no byte pieces to fall back on")
    normal = tuple(bool(p) and not kinds[i] and not reader.is_byte(i) for i, p in zip(ids, pieces, strict=True))
    return Vocabulary(tuple(pieces), tuple(raw), normal, tuple(byte_ids))


@dataclass(frozen=True)
class DoubleArray:
    """Trie in two arrays: from state s, byte c leads to t = base[s] + c if check[t] == s."""

    base: np.ndarray
    check: np.ndarray
    piece: np.ndarray  # piece that ends in the state, or -1
    longest: int

    @staticmethod
    def build(words: list[tuple[bytes, int]]) -> DoubleArray:
        children: list[dict[int, int]] = [{}]
        ends = [-1]
        for word, number in words:
            at = 0
            for c in word:
                if c not in children[at]:
                    children[at][c] = len(children)
                    children.append({})
                    ends.append(-1)
                at = children[at][c]
            ends[at] = number
        size = 4 * len(children) + 1024
        used = bytearray(size)
        used[0] = 1
        base, check = np.zeros(size, np.int64), np.full(size, -1, np.int64)
        piece = np.full(size, -1, np.int64)
        check[0], tail = 0, 1
        waiting = [(0, 0)]
        for node, place in waiting:  # grows while it is walked: breadth first
            codes = sorted(children[node])
            if not codes:
                continue
            if len(codes) == 1:  # any hole will do
                start = used.index(0, codes[0] + 1) - codes[0]
            else:  # siblings go behind earlier ones; only children fill what stays free
                start = tail
                while any(used[start + c] for c in codes):
                    start += 1
                tail = start
            base[place] = start
            for c in codes:
                child = children[node][c]
                used[start + c] = 1
                check[start + c] = place
                piece[start + c] = ends[child]
                waiting.append((child, start + c))
        last = int(np.flatnonzero(check >= 0).max()) + 512
        base, check, piece = base[:last], check[:last], piece[:last]
        return DoubleArray(base, check, piece, max((len(w) for w, _ in words), default=0))


@lru_cache(maxsize=4)
def _compiled(vocabulary: Vocabulary) -> DoubleArray:
    usable = [(p, i) for i, p in enumerate(vocabulary.pieces) if vocabulary.normal[i]]
    return DoubleArray.build(sorted(usable))


class Segmenter:
    """Cuts texts; lives in a Python worker and keeps the chunks it has cut."""

    def __init__(self, vocabulary: Vocabulary, trie: DoubleArray):
        self.vocabulary, self.trie = vocabulary, trie
        self.scores = np.array(vocabulary.scores)
        usable = [s for s, n in zip(vocabulary.scores, vocabulary.normal, strict=True) if n]
        self.unknown = min(usable, default=0.0) - UNKNOWN_PENALTY
        self.byte_ids = np.array(vocabulary.byte_ids, dtype=np.int32)
        self.known: dict[bytes, bytes] = {}
        inner = any(b" " in p.lstrip(b" ") for p, n in zip(vocabulary.pieces, vocabulary.normal, strict=True) if n)
        self.chunks = (lambda text: [text]) if inner else _CHUNK.findall

    def encode(self, texts: list[str | None]) -> list[np.ndarray | None]:
        cut = [
            self.chunks(b" " + t.encode("utf-8", "surrogatepass")) if t else [] for t in texts
        ]
        fresh = {c for row in cut for c in row} - self.known.keys()
        made: dict[bytes, bytes] = {}
        short = [c for c in fresh if len(c) <= _SIDE_BY_SIDE]
        for start in range(0, len(short), 20_000):
            part = short[start : start + 20_000]
            made.update(zip(part, self._side_by_side(part), strict=True))
        made.update((c, self._one(c)) for c in fresh if len(c) > _SIDE_BY_SIDE)
        if len(self.known) + len(made) <= _KNOWN_CHUNKS:
            self.known.update((c, i) for c, i in made.items() if len(c) <= _SIDE_BY_SIDE)
        get = self.known.get

        def joined(row):
            return np.frombuffer(b"".join([get(c) or made[c] for c in row]), dtype=np.int32)

        return [None if t is None else joined(row) for t, row in zip(texts, cut, strict=True)]

    def _ids(self, chunk: bytes, ends: list[tuple[int, int, int]]) -> bytes:
        out = []
        for start, end, number in reversed(ends):
            out += [number] if number >= 0 else self.byte_ids[list(chunk[start:end])].tolist()
        return np.array(out, dtype=np.int32).tobytes()

    def _one(self, chunk: bytes) -> bytes:
        """Viterbi over the positions of one chunk."""
        base, check, piece = self.trie.base, self.trie.check, self.trie.piece
        n = len(chunk)
        best = [-math.inf] * (n + 1)
        came = [(0, -1)] * (n + 1)
        best[0] = 0.0
        for s in range(n):
            if best[s] == -math.inf:
                continue
            state, whole = 0, False
            character = min(int(_LENGTHS[chunk[s]]), n - s)
            for e in range(s, min(n, s + self.trie.longest)):
                to = int(base[state]) + chunk[e]
                if base[state] == 0 or check[to] != state:
                    break
                state = to
                number = int(piece[state])
                if number >= 0:
                    whole = whole or e + 1 - s == character
                    value = best[s] + self.vocabulary.scores[number]
                    if value > best[e + 1]:
                        best[e + 1], came[e + 1] = value, (s, number)
            if not whole and best[s] + self.unknown > best[s + character]:
                best[s + character] = best[s] + self.unknown
                came[s + character] = (s, -1)
        ends, at = [], n
        while at > 0:
            start, number = came[at]
            ends.append((start, at, number))
            at = start
        return self._ids(chunk, ends)

    def _side_by_side(self, chunks: list[bytes]) -> list[bytes]:
        """The same for many chunks at once: one array element per chunk."""
        base, check, piece = self.trie.base, self.trie.check, self.trie.piece
        sizes = np.array([len(c) for c in chunks])
        order = np.argsort(-sizes, kind="stable")
        sizes = sizes[order]
        width = int(sizes[0]) if len(sizes) else 0
        chars = np.zeros((len(chunks), width + 4), dtype=np.int64)
        for row, k in enumerate(order):
            chars[row, : sizes[row]] = np.frombuffer(chunks[k], dtype=np.uint8)
        best = np.full((len(chunks), width + 5), -np.inf)
        start_of = np.zeros((len(chunks), width + 5), dtype=np.int32)
        number_of = np.full((len(chunks), width + 5), -1, dtype=np.int32)
        best[:, 0] = 0.0

        def offer(rows, s, ends, values, numbers):
            better = values > best[rows, ends]
            rows, ends = rows[better], ends[better] if np.ndim(ends) else ends
            best[rows, ends] = values[better]
            start_of[rows, ends] = s
            number_of[rows, ends] = numbers[better] if np.ndim(numbers) else numbers

        for s in range(width):
            open_rows = int(np.searchsorted(-sizes, -s, side="left"))  # rows longer than s
            rows = np.flatnonzero(best[:open_rows, s] > -np.inf)
            if not len(rows):
                continue
            character = np.minimum(_LENGTHS[chars[rows, s]], sizes[rows] - s)
            whole = np.zeros(len(rows), dtype=bool)
            live, state = np.arange(len(rows)), np.zeros(len(rows), dtype=np.int64)
            for e in range(s, min(width, s + self.trie.longest)):
                inside = sizes[rows[live]] > e
                live, state = live[inside], state[inside]
                to = base[state] + chars[rows[live], e]
                good = (check[to] == state) & (base[state] > 0)
                live, state = live[good], to[good]
                if not len(live):
                    break
                ended = np.flatnonzero(piece[state] >= 0)
                if len(ended):
                    numbers = piece[state[ended]]
                    at = live[ended]
                    whole[at[character[at] == e + 1 - s]] = True
                    offer(rows[at], s, e + 1, best[rows[at], s] + self.scores[numbers], numbers)
            rest = np.flatnonzero(~whole)
            if len(rest):
                value = best[rows[rest], s] + self.unknown
                offer(rows[rest], s, s + character[rest], value, -1)
        out: list[bytes] = [b""] * len(chunks)
        for row, k in enumerate(order):
            ends, at = [], int(sizes[row])
            starts, numbers = start_of[row], number_of[row]
            while at > 0:
                start = int(starts[at])
                ends.append((start, at, int(numbers[at])))
                at = start
            out[k] = self._ids(chunks[k], ends)
        return out


def decode_ids(ids, pieces: tuple[bytes, ...]) -> str | None:
    """The text of the ids: pieces put together, without the blank before the text."""
    if ids is None:
        return None
    joined = b"".join([pieces[i] for i in ids])
    return joined.removeprefix(b" ").decode("utf-8", "replace")


def encode_pieces(
    docs: DataFrame, vocabulary: Vocabulary, text: str = "text", check: bool = False
) -> DataFrame:
    """docs plus ids (array<int>) and n_pieces; with check also exact: whether decoding
    the ids gives the text back.

    Whole texts are cut. A null text has null ids, no pieces and is exact; an empty
    one has no ids. Input columns named like the new ones are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, vocabulary.double_array()))
    base = docs.drop("ids", "n_pieces", *(["exact"] if check else []))
    columns = base.columns
    at = columns.index(text)

    def run(batches):
        cutter = Segmenter(*shared.value)
        pieces = cutter.vocabulary.pieces
        for whole in batches:
            for start in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(start, _ROWS)
                texts = batch.column(at).to_pylist()
                found = cutter.encode(texts)
                ends = np.cumsum([0, *(0 if f is None else len(f) for f in found)])
                flat = [f for f in found if f is not None]
                ids = pa.ListArray.from_arrays(
                    pa.array(ends, pa.int32()),
                    pa.array(np.concatenate(flat) if flat else np.empty(0, np.int32)),
                    mask=pa.array([f is None for f in found]),
                )
                made = [ids, pa.array(np.diff(ends), pa.int64())]
                if check:
                    same = [
                        f is None or decode_ids(f.tolist(), pieces) == t
                        for f, t in zip(found, texts, strict=True)
                    ]
                    made.append(pa.array(same, pa.bool_()))
                names = [*columns, "ids", "n_pieces", *(["exact"] if check else [])]
                yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=names)

    return base.mapInArrow(
        run, ddl(base, "ids array<int>, n_pieces long" + (", exact boolean" if check else ""))
    )


def decode_pieces(rows: DataFrame, vocabulary: Vocabulary, ids: str = "ids") -> DataFrame:
    """rows plus decoded: the text of the ids (null for null). A column of that name is replaced."""
    pieces = rows.sparkSession.sparkContext.broadcast(vocabulary.pieces)
    base = rows.drop("decoded")
    columns = base.columns
    at = columns.index(ids)

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(start, _ROWS)
                texts = [decode_ids(r, pieces.value) for r in batch.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(texts, pa.string())], names=[*columns, "decoded"]
                )

    return base.mapInArrow(run, ddl(base, "decoded string"))
