"""Packing documents into sequences of a fixed number of tokens, best-two-fit.

A bin is first filled greedily, the longest piece that fits each time. If a gap remains, its
smallest piece makes room for two others that fill the widened gap more tightly, as long as
that helps. Only lengths matter, so pieces wait in one stack per length, and a set of bits
tells which lengths are left: no step looks at single pieces.

Pieces of full length are sequences of their own. All others are dealt by a hash into groups
that one task packs, of which each leaves at most a few bins half full.
"""

import re
import zlib
from array import array
from itertools import chain

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallow.llm.tables import runs
from tallow.session import stage

LIMIT = 2048
GROUP = 32_768  # pieces that are packed together
TOKENIZER = "word_bpe_49k.json"
# How the tokenizer cuts lower-cased text into words, for the letters of _PLAIN,
# and the signs that stand for bytes in its vocabulary.
_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
# The same on whole texts: a space on either side of all words that are no run of letters.
_APART = r"('s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^\sa-z0-9ß-öø-ÿ]+)"
_PLAIN_TEXT = r"^[!-~À-ÖØ-öø-ÿ \n]*$"
_SHOWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
_BYTE_SIGNS = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in _SHOWN)}
_MARK, _MARK_ID = "<|endoftext|>", 49407
_CACHE = 200_000
_AT_ONCE = 20_000


class ChunkEncoder:
    """Token ids of whole texts; a chunk between spaces or line ends is encoded once.

    The tokenizer drops white space and no rule of it looks across, so ids of a text are
    those of its chunks in a row. Chunks of printable ASCII and Latin letters, which its
    normalisation only lower-cases, are cut into its words here and go to its model word by
    word; all others go through the whole tokenizer, a special token between them.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {"": 0}
        self.words: dict[str, bytes] = {}
        self.flat = np.zeros(0, np.uint32)
        self.starts = self.lengths = np.zeros(1, np.int64)

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def word(self, word: str) -> bytes:
        """Ids of a lower-cased word of the letters of ``_PLAIN``."""
        signs = word if word.isascii() else word.encode().decode("latin-1").translate(_BYTE_SIGNS)
        return array("I", [t.id for t in self.model.tokenize(signs)]).tobytes()

    def _plain(self, chunk: str) -> bytes:
        ids = []
        for word in _WORD.findall(chunk.lower()):
            own = self.words.get(word)
            if own is None:
                own = self.words[word] = self.word(word)
            ids.append(own)
        return ids[0] if len(ids) == 1 else b"".join(ids)

    def _learn(self, chunks: list[str]) -> None:
        found: list[bytes] = []
        rest: list[str] = []
        for chunk in chunks:
            if _PLAIN.fullmatch(chunk) and "<|" not in chunk:
                self.index[chunk] = len(self.index)
                found.append(self._plain(chunk))
            else:
                rest.append(chunk)
        marked = [c for c in rest if "<|" in c]
        others = [c for c in rest if "<|" not in c]
        for at in range(0, len(others), _AT_ONCE):
            part = others[at : at + _AT_ONCE]
            ids = self._encode(_MARK.join(part))
            cuts = np.flatnonzero(ids == _MARK_ID)
            for chunk, own in zip(part, np.split(ids, cuts), strict=True):
                self.index[chunk] = len(self.index)
                found.append(own[own != _MARK_ID].tobytes())
        for chunk in marked:
            self.index[chunk] = len(self.index)
            found.append(self._encode(chunk).tobytes())
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
        self.starts = np.r_[self.starts, len(self.flat) + np.cumsum(lengths) - lengths]
        self.lengths = np.r_[self.lengths, lengths]
        self.flat = np.r_[self.flat, np.frombuffer(b"".join(found), np.uint32)]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        split = [(t or "").replace("\n", " ").split(" ") for t in texts]
        if len(self.index) > _CACHE:
            self._forget()
        new = [c for c in dict.fromkeys(chain.from_iterable(split)) if c not in self.index]
        if new:
            self._learn(new)
        return [self._gather(chunks) for chunks in split]

    def _gather(self, chunks: list[str]) -> np.ndarray:
        which = np.fromiter(map(self.index.__getitem__, chunks), np.int64, len(chunks))
        lengths = self.lengths[which]
        ends = np.cumsum(lengths)
        shift = np.repeat(self.starts[which] - (ends - lengths), lengths)
        return self.flat[shift + np.arange(len(shift))]


class WordEncoder:
    """Token ids of whole texts, as arrays; each distinct word of a slice is looked up once.

    Texts of printable ASCII and Latin letters are lower-cased and cut into the tokenizer's words
    by Arrow, and a word is encoded when it is new. Texts with other signs go to ``ChunkEncoder``.
    """

    def __init__(self, path: str):
        self.chunks = ChunkEncoder(path)
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {"": 0}
        self.flat = np.zeros(0, np.uint32)
        self.starts = self.lengths = np.zeros(1, np.int64)

    def _places(self, words: list[str]) -> np.ndarray:
        new = [w for w in words if w not in self.index]
        if new:
            found = [self.chunks.word(w) for w in new]
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new)), strict=True))
            lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
            self.starts = np.r_[self.starts, len(self.flat) + np.cumsum(lengths) - lengths]
            self.lengths = np.r_[self.lengths, lengths]
            self.flat = np.r_[self.flat, np.frombuffer(b"".join(found), np.uint32)]
        return np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each has."""
        if len(self.index) > _CACHE:
            self._forget()
        apart = pc.replace_substring_regex(pc.utf8_lower(texts), _APART, r" \1 ")
        split = pc.ascii_split_whitespace(apart)
        coded = split.flatten().dictionary_encode()
        which = self._places(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        lengths = self.lengths[which]
        ends = np.cumsum(lengths)
        shift = np.repeat(self.starts[which] - (ends - lengths), lengths)
        at = np.r_[0, ends][np.r_[0, np.cumsum(split.value_lengths().to_numpy())]]
        return self.flat[shift + np.arange(len(shift))], np.diff(at)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all ``texts`` (no nulls) in a row, and how many each has."""
        marked = pc.match_substring(texts, "<|")
        plain = pc.and_not(pc.match_substring_regex(texts, _PLAIN_TEXT), marked).to_numpy(zero_copy_only=False)
        ids, own = self._plain(texts.filter(pa.array(plain)))
        if plain.all():
            return ids, own
        others = self.chunks.encode(texts.filter(pa.array(~plain)).to_pylist())
        lengths = np.zeros(len(plain), np.int64)
        lengths[plain], lengths[~plain] = own, [len(x) for x in others]
        flat, here = np.zeros(lengths.sum(), np.uint32), np.repeat(plain, lengths)
        flat[here], flat[~here] = ids, np.concatenate(others)
        return flat, lengths


def _cut(names: pa.Array, ids: np.ndarray, lengths: np.ndarray, limit: int, with_ids: bool) -> pa.RecordBatch:
    """Pieces of documents whose ids lie in a row: each ended by id 0, then cut."""
    ids = np.insert(ids, np.cumsum(lengths), 0).astype("<u4")
    lengths = lengths + 1
    parts = -(-lengths // limit)
    owner = np.repeat(np.arange(len(lengths)), parts)
    piece = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    start = piece * limit
    size = np.minimum(limit, lengths[owner] - start)
    bounds = np.r_[0, np.cumsum(size)] * 4
    data = ids.tobytes()
    view = memoryview(data)
    crcs = [zlib.crc32(view[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    columns = [names.take(pa.array(owner)), pa.array(piece, pa.int32()), pa.array(start), pa.array(size), pa.array(crcs, pa.int64())]
    if not with_ids:
        return pa.RecordBatch.from_arrays(columns, _PIECE.names)
    buffers = [None, pa.py_buffer(bounds.astype(np.int32).tobytes()), pa.py_buffer(data)]
    columns.append(pa.Array.from_buffers(pa.binary(), len(owner), buffers))
    return pa.RecordBatch.from_arrays(columns, [*_PIECE.names, "ids"])


def _piece_batches(path: str, limit: int, with_ids: bool):
    def cut(batches):
        encoder = WordEncoder(path)
        for batch in batches:
            for start, n in runs(batch, "text"):
                texts = pc.fill_null(batch.column("text").slice(start, n), "")
                yield _cut(batch.column("doc_id").slice(start, n), *encoder.encode(texts), limit, with_ids)

    return cut


_PIECE = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("piece", pa.int32()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids_crc32", pa.int64()),
    ]
)
_PIECE_DDL = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces(
    docs: DataFrame, tokenizer: str | None = None, limit: int = LIMIT, with_ids: bool = False
) -> DataFrame:
    """Token pieces of at most ``limit`` ids of every document, each ended by id 0.

    A null text counts as empty and gives one piece of one id. ``with_ids`` adds the ids, as
    little-endian unsigned 32-bit numbers.
    """
    path = tokenizer or public_tokenizers.path(TOKENIZER)
    narrow = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    ddl = _PIECE_DDL + (", ids binary" if with_ids else "")
    return narrow.mapInArrow(_piece_batches(str(path), limit, with_ids), ddl)


class _Lengths:
    """Pieces by length, and as bits the lengths that are left, in both directions."""

    def __init__(self, lengths: np.ndarray, limit: int):
        self.limit = limit
        self.stacks: dict[int, list[int]] = {}
        self.up = self.down = 0
        for i in np.argsort(lengths, kind="stable")[::-1]:
            self.put(int(lengths[i]), int(i))

    def put(self, length: int, piece: int) -> None:
        stack = self.stacks.setdefault(length, [])
        if not stack:
            self.up |= 1 << length
            self.down |= 1 << (self.limit - length)
        stack.append(piece)

    def take(self, length: int) -> int:
        stack = self.stacks[length]
        piece = stack.pop()
        if not stack:
            self.up ^= 1 << length
            self.down ^= 1 << (self.limit - length)
        return piece

    def longest(self, room: int) -> int:
        """The longest length left of at most ``room``, or 0."""
        return (self.up & ((2 << room) - 1)).bit_length() - 1 if room > 0 and self.up else 0

    def two(self, room: int, over: int) -> tuple[int, int] | None:
        """Two lengths left whose sum is as near to ``room`` as can be, and above ``over``."""
        for total in range(room, over, -1):
            fitting = self.up & (self.down >> (self.limit - total))
            half = total // 2
            if total % 2 == 0 and fitting >> half & 1 and len(self.stacks[half]) < 2:
                fitting ^= 1 << half
            if fitting:
                longer = fitting.bit_length() - 1
                return longer, total - longer
        return None


def pack_lengths(lengths: np.ndarray, limit: int = LIMIT) -> list[list[int]]:
    """Bins of indexes into ``lengths``, each with a sum of at most ``limit``."""
    left, bins = _Lengths(lengths, limit), []
    while left.up:
        room, bin_ = limit, []
        while (length := left.longest(room)) > 0:
            bin_.append((length, left.take(length)))
            room -= length
        while room and len(bin_) > 1:
            length, piece = bin_[-1]
            two = left.two(room + length, length)
            if two is None:
                break
            bin_.pop()
            bin_ += [(two[0], left.take(two[0])), (two[1], left.take(two[1]))]
            left.put(length, piece)
            room += length - sum(two)
            bin_.sort(reverse=True)
        bins.append([piece for _, piece in bin_])
    return bins


def _pack_group(limit: int):
    def pack(group: pd.DataFrame) -> pd.DataFrame:
        order = ["length", "doc_id", "piece", "ids_crc32"]
        group = group.sort_values(order, ignore_index=True)
        lengths = group["length"].to_numpy()
        sequence, offset = np.zeros(len(group), np.int64), np.zeros(len(group), np.int64)
        for number, bin_ in enumerate(pack_lengths(lengths, limit)):
            sequence[bin_] = number
            offset[bin_] = np.cumsum(lengths[bin_]) - lengths[bin_]
        group["sequence_id"] = sequence + (group.pop("part").to_numpy() << 32)
        group["offset"] = offset
        return group

    return pack


def pack(cut: DataFrame, limit: int = LIMIT, group: int = GROUP) -> DataFrame:
    """``cut`` (the columns of ``pieces`` but ids, written once) with sequence_id and offset.

    Ids of sequences are any numbers; those of full pieces are negative. Equal rows are
    pieces of their own. An empty table gives an empty result. A column ``row`` is carried along.
    """
    extra = ["row"] if "row" in cut.columns else []
    names = [*_PIECE.names, *extra]
    full = cut.where(F.col("length") == limit).select(
        *names,
        (-1 - F.monotonically_increasing_id()).alias("sequence_id"),
        F.lit(0).cast("bigint").alias("offset"),
    )
    rest = cut.where(F.col("length") < limit)
    parts = max(1, -(-rest.count() // group))
    place = F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id())
    dealt = rest.select(*names, F.pmod(place, F.lit(parts)).cast("bigint").alias("part"))
    ddl = f"{_PIECE_DDL}{', row bigint' if extra else ''}, sequence_id bigint, offset bigint"
    return full.unionByName(dealt.groupBy("part").applyInPandas(_pack_group(limit), ddl))


def write_sequences(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every document of (doc_id, text) cut and packed: its pieces and their places, written.

    Pieces are (row, ids and what ``pieces`` gives), places the same without ids but with
    sequence_id and offset. The ids are written once and do not move: packing reads lengths.
    """
    cut = pieces(docs, with_ids=True).withColumn("row", F.monotonically_increasing_id())
    cut = stage(cut, "pieces")
    return cut, stage(pack(cut.drop("ids")), "places")


def pack_sequences(docs: DataFrame) -> DataFrame:
    """Every document of (doc_id, text) cut and packed, with the ids.

    A row has the ids of one piece (little-endian unsigned 32-bit); those of a ``sequence_id`` by
    ``offset`` are the sequence, without gaps. Rows come in no order, which saves moving all ids
    once more.
    """
    cut, placed = write_sequences(docs)
    return placed.join(cut.select("row", "ids"), "row").drop("row")


def pack_documents(docs: DataFrame) -> DataFrame:
    """What is known of each piece of the sequences; their ids are written as well."""
    return write_sequences(docs)[1].drop("row")
