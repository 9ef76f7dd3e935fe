"""SentencePiece encoding and decoding with a unigram model, from the file of a vocabulary.

The pieces lie in a double-array trie: from state ``s`` the symbol ``c`` leads to
``base[s] + c`` if ``check`` there is ``s``. Encoding finds the segmentation with the largest
sum of scores (Viterbi); of equal sums the one whose last piece starts first, at every place.
A character that begins no one-character piece may stand alone at the lowest score less 10,
and is written as the pieces of its UTF-8 bytes.

A space is written as the marker U+2581, and one is put before the text. No piece of the
vocabulary has a marker after another character (checked when it is read), so a segmentation
never crosses a place before a marker that follows something else: texts are cut there into
chunks, and each distinct chunk is encoded once. All new chunks of a batch go through the
lattice together, as arrays: one step per place and piece length, not per chunk.

Scores are taken from the file as they are. The one given is a BPE model, whose scores are merge
ranks: their sum is no log likelihood, and the best segmentation by it is neither the one that
BPE merges give nor that of a trained unigram model.
"""

import struct
import zlib
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallow.llm.tables import slices

VOCABULARY = "piece_bpe_32k.model"
MARKER = "▁"
_UNKNOWN_PENALTY = 10.0
_NORMAL, _UNKNOWN, _USER, _BYTE = 1, 2, 4, 6  # fixed values: types of pieces in the file
_CACHE = 200_000
_LONG = 64  # chunks longer than this are encoded one by one, in linear time and memory
_BLOCK = 20_000


def _fields(data: bytes):
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, data[at : at + size]
        at += size


@dataclass
class Trie:
    """Double-array trie over characters; ``value`` has a piece's number at its end, or -1."""

    symbols: dict[str, int]
    base: np.ndarray
    check: np.ndarray
    value: np.ndarray

    @classmethod
    def build(cls, pieces: list[tuple[str, int]]) -> "Trie":
        # frequent characters get small numbers, so that nodes lie close together
        counts = Counter(c for p, _ in pieces for c in p)
        symbols = {c: i + 1 for i, c in enumerate(sorted(counts, key=lambda c: (-counts[c], c)))}
        tree: list[dict[int, int]] = [{}]
        ends: dict[int, int] = {}
        for piece, number in pieces:
            node = 0
            for c in piece:
                code = symbols[c]
                if code not in tree[node]:
                    tree[node][code] = len(tree)
                    tree.append({})
                node = tree[node][code]
            ends[node] = number
        size = 2 * (len(tree) + len(symbols) + 1)
        base, check = np.zeros(size, np.int32), np.full(size, -1, np.int32)
        value = np.full(size, -1, np.int32)
        after = list(range(size + 1))  # the next free place, found in ever longer steps

        def free(at: int) -> int:
            while after[at] != at:
                after[at] = after[after[at]]
                at = after[at]
            return at

        after[0] = 1
        place = {0: 0}
        for node in sorted(range(len(tree)), key=lambda n: -len(tree[n])):
            codes = sorted(tree[node])
            if not codes:
                continue
            first = free(codes[0] + 1)
            while any(after[first - codes[0] + c] != first - codes[0] + c for c in codes[1:]):
                first = free(first + 1)
            base[node] = first - codes[0]  # by node for now
            for code in codes:
                at = first - codes[0] + code
                after[at] = at + 1
                place[tree[node][code]] = at
        node_base, base = base[: len(tree)].copy(), np.zeros(size, np.int32)
        for node, children in enumerate(tree):
            at = place[node]
            base[at] = node_base[node]
            value[at] = ends.get(node, -1)
            for child in children.values():
                check[place[child]] = at
        return cls(symbols, base, check, value)


class Vocabulary:
    """Pieces, scores and the trie of a vocabulary file."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            fields = list(_fields(file.read()))
        self.pieces: list[str] = []
        self.scores: list[float] = []
        kinds = []
        for number, value in fields:
            if number == 1:
                own = dict(_fields(value))
                self.pieces.append(own[1].decode())
                self.scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                kinds.append(own.get(3, _NORMAL))
        self.kinds = kinds
        usual = [i for i, k in enumerate(kinds) if k in (_NORMAL, _USER)]
        if any(MARKER in self.pieces[i].lstrip(MARKER) for i in usual):
            raise ValueError("a piece has a marker after another character")
        self.score = np.array(self.scores, np.float64)
        self.longest = max(len(self.pieces[i]) for i in usual)
        lowest = min(self.scores[i] for i in usual if kinds[i] == _NORMAL)
        self.unknown_score = lowest - _UNKNOWN_PENALTY
        self.unknown = kinds.index(_UNKNOWN)
        self.bytes = {int(self.pieces[i][3:5], 16): i for i, k in enumerate(kinds) if k == _BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.trie = Trie.build([(self.pieces[i], i) for i in usual])
        self.code = np.zeros(0x110000, np.int32)  # a character's symbol, 0 if it has none
        for c, symbol in self.trie.symbols.items():
            self.code[ord(c)] = symbol
        self._prepare_decoding(usual)

    def _prepare_decoding(self, usual: list[int]) -> None:
        """Bytes of all pieces in a row; pieces without text have none."""
        texts = [b""] * len(self.pieces)
        for i in usual:
            texts[i] = self.pieces[i].replace(MARKER, " ").encode()
        for i, byte in self.byte_of.items():
            texts[i] = bytes([byte])
        self.text_bytes = np.frombuffer(b"".join(texts), np.uint8)
        self.text_lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.text_starts = np.cumsum(self.text_lengths) - self.text_lengths

    def _codes(self, chunks: list[str], width: int) -> np.ndarray:
        points = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter(map(len, chunks), np.int64, len(chunks))
        codes = np.zeros((len(chunks), width + 1), np.int32)
        row = np.repeat(np.arange(len(chunks)), lengths)
        column = np.arange(len(points)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        codes[row, column] = self.code[points]
        return codes

    def _lattice(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best score, start and number (-1: unknown) of the last piece, by chunk and end."""
        width = max(map(len, chunks), default=0)
        n = len(chunks)
        codes = self._codes(chunks, width)
        lengths = np.fromiter(map(len, chunks), np.int64, n)
        best = np.full((n, width + 1), -np.inf)
        best[:, 0] = 0.0
        start = np.zeros((n, width + 1), np.int32)
        number = np.full((n, width + 1), -1, np.int32)
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        for at in range(width):
            live = np.flatnonzero(lengths > at)
            state = np.zeros(len(live), np.int64)
            lone = live  # rows in which no piece is this one character
            rows = live
            for size in range(1, min(self.longest, width - at) + 1):
                code = codes[rows, at + size - 1]
                to = base[state] + code
                on = (code > 0) & (check[to] == state) & (base[state] > 0)
                rows, state = rows[on], to[on]
                if not len(rows):
                    break
                piece = value[state]
                ends = piece >= 0
                who, what = rows[ends], piece[ends]
                if size == 1:
                    lone = np.setdiff1d(live, who, assume_unique=True)
                total = best[who, at] + self.score[what]
                better = total > best[who, at + size]
                who, what = who[better], what[better]
                best[who, at + size] = total[better]
                start[who, at + size] = at
                number[who, at + size] = what
            total = best[lone, at] + self.unknown_score
            better = total > best[lone, at + 1]
            lone = lone[better]
            best[lone, at + 1] = total[better]
            start[lone, at + 1] = at
            number[lone, at + 1] = -1
        return best, start, number

    def encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all chunks in a row, how many each has, and their scores."""
        best, start, number = self._lattice(chunks)
        n = len(chunks)
        end = np.fromiter(map(len, chunks), np.int64, n)
        totals = best[np.arange(n), end]
        # all chunks are walked back together, a piece a step
        live, steps = np.flatnonzero(end > 0), []
        while len(live):
            at = end[live]
            steps.append((live, number[live, at], start[live, at], at))
            end[live] = start[live, at]
            live = live[end[live] > 0]
        if not steps:
            return np.zeros(0, np.int32), np.zeros(n, np.int64), totals
        row, piece, first, last = (np.concatenate(x) for x in zip(*steps, strict=True))
        order = np.lexsort((first, row))
        row, piece, first, last = row[order], piece[order], first[order], last[order]
        gaps = np.flatnonzero(piece < 0)  # characters without a piece
        if len(gaps):
            own = [self._fallback(chunks[row[i]][first[i] : last[i]]) for i in gaps]
            sizes = np.ones(len(piece), np.int64)
            sizes[gaps] = [len(ids) for ids in own]
            places = np.cumsum(sizes) - sizes
            piece, row = np.repeat(piece, sizes), np.repeat(row, sizes)
            at = np.repeat(places[gaps], sizes[gaps])
            inner = np.arange(len(at)) - np.repeat(np.cumsum(sizes[gaps]) - sizes[gaps], sizes[gaps])
            piece[at + inner] = np.fromiter(chain.from_iterable(own), np.int32)
        return piece.astype(np.int32), np.bincount(row, minlength=n), totals

    def _fallback(self, character: str) -> list[int]:
        if len(self.bytes) < 256:
            return [self.unknown]
        return [self.bytes[b] for b in character.encode("utf-8", "replace")]

    def segment_long(self, chunk: str) -> list[tuple[int, int, int]]:
        """The same for one chunk of any length, place by place."""
        symbols, base, check = self.trie.symbols, self.trie.base, self.trie.check
        value, score = self.trie.value, self.scores
        n = len(chunk)
        codes = [symbols.get(c, 0) for c in chunk]
        best, start, number = [0.0] + [-np.inf] * n, [0] * (n + 1), [-1] * (n + 1)
        for at in range(n):
            state, single, here = 0, False, best[at]
            for end in range(at + 1, min(n, at + self.longest) + 1):
                code = codes[end - 1]
                to = int(base[state]) + code
                if not code or not base[state] or check[to] != state:
                    break
                state = to
                piece = int(value[to])
                if piece >= 0:
                    single = single or end == at + 1
                    if here + score[piece] > best[end]:
                        best[end], start[end], number[end] = here + score[piece], at, piece
            if not single and here + self.unknown_score > best[at + 1]:
                best[at + 1], start[at + 1], number[at + 1] = here + self.unknown_score, at, -1
        path, end = [], n
        while end > 0:
            path.append((number[end], start[end], end))
            end = start[end]
        return path[::-1]

    def encode_long(self, chunk: str) -> tuple[list[int], float]:
        """Ids and score of one chunk of any length."""
        ids, total = [], 0.0
        for piece, a, b in self.segment_long(chunk):
            ids += [piece] if piece >= 0 else self._fallback(chunk[a:b])
            total += self.scores[piece] if piece >= 0 else self.unknown_score
        return ids, total

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids: bytes of all pieces in a row, markers as spaces, the first dropped."""
        ids = np.asarray(ids, np.int64)
        lengths = self.text_lengths[ids]
        shift = np.repeat(self.text_starts[ids] - (np.cumsum(lengths) - lengths), lengths)
        text = self.text_bytes[shift + np.arange(len(shift))].tobytes().decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def chunks_of(text: str) -> list[str]:
    """The marked text, cut before every marker that follows another character."""
    if not text:
        return []
    parts = text.replace(MARKER, " ").split(" ")
    if "" not in parts:
        return [MARKER + part for part in parts]
    out, run = [], 0
    for part in parts:
        run += 1
        if part:
            out.append(MARKER * run + part)
            run = 0
    if run:
        out.append(MARKER * run)
    return out


class Encoder:
    """Ids of whole texts, with a bounded memory of chunks."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.flat = np.zeros(0, np.int32)
        self.starts = self.lengths = np.zeros(0, np.int64)
        self.totals = np.zeros(0)

    def _learn(self, new: list[str]) -> None:
        own = self.vocabulary
        short = sorted((c for c in new if len(c) <= _LONG), key=len)
        found = [own.encode_chunks(short[at : at + _BLOCK]) for at in range(0, len(short), _BLOCK)]
        long = [c for c in new if len(c) > _LONG]
        for ids, total in map(own.encode_long, long):
            found.append((np.array(ids, np.int32), np.array([len(ids)]), np.array([total])))
        self.index.update(zip(short + long, range(len(self.index), len(self.index) + len(new)), strict=True))
        if found:
            flat, lengths, totals = (np.concatenate(x) for x in zip(*found, strict=True))
            self.starts = np.r_[self.starts, len(self.flat) + np.cumsum(lengths) - lengths]
            self.flat = np.r_[self.flat, flat]
            self.lengths, self.totals = np.r_[self.lengths, lengths], np.r_[self.totals, totals]

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, float]]:
        split = [chunks_of(t or "") for t in texts]
        if len(self.index) > _CACHE:
            self._forget()
        self._learn([c for c in dict.fromkeys(chain.from_iterable(split)) if c not in self.index])
        return [self._gather(chunks) for chunks in split]

    def _gather(self, chunks: list[str]) -> tuple[np.ndarray, float]:
        which = np.fromiter(map(self.index.__getitem__, chunks), np.int64, len(chunks))
        own = self.lengths[which]
        shift = np.repeat(self.starts[which] - (np.cumsum(own) - own), own)
        return self.flat[shift + np.arange(len(shift))], float(self.totals[which].sum())


def _encode_batches(own: Vocabulary):
    def encode(batches):
        encoder = Encoder(own)
        for batch in batches:
            for start, texts in slices(batch, "text"):
                found = encoder.encode(texts)
                ids = [i for i, _ in found]
                ends = np.cumsum([0] + [len(i) for i in ids]).astype(np.int32)
                flat = pa.array(np.concatenate([np.zeros(0, np.int32), *ids]), pa.int32())
                back = [own.decode(i) for i in ids]
                same = [b == (t or "") for b, t in zip(back, texts, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(start, len(texts)),
                        pa.ListArray.from_arrays(pa.array(ends), flat),
                        pa.array([len(i) for i in ids], pa.int64()),
                        pa.array([zlib.crc32(i.astype("<u4").tobytes()) for i in ids], pa.int64()),
                        pa.array([s for _, s in found], pa.float64()),
                        pa.array([zlib.crc32(b.encode("utf-8", "replace")) for b in back], pa.int64()),
                        pa.array(same, pa.bool_()),
                    ],
                    ["doc_id", "ids", "n_ids", "ids_crc32", "score", "decoded_crc32", "round_trip"],
                )

    return encode


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Ids of every whole text, their score, and whether decoding them gives the text again.

    A null text counts as empty and has no ids. Equal rows get equal results. The vocabulary
    is read once, on the driver, and goes to the tasks with its trie: a few MB.
    """
    path = str(path or public_tokenizers.path(VOCABULARY))
    narrow = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return narrow.mapInArrow(
        _encode_batches(vocabulary(path)),
        "doc_id bigint, ids array<int>, n_ids bigint, ids_crc32 bigint, score double, "
        "decoded_crc32 bigint, round_trip boolean",
    )
