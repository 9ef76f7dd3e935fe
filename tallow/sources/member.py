"""CSV text of a zip's first member as Arrow batches, all columns text.

Nothing is held whole: the member is inflated and parsed block by block.
"""

import csv
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from itertools import islice
from typing import BinaryIO

import pyarrow as pa
from pyarrow import compute as pc
from pyarrow import csv as pacsv

from tallow.schema import CANDLE_COLUMNS, NA_TOKENS, NUMBER_PATTERN

BATCH_ROWS = 10_000
_NUMBER = re.compile(NUMBER_PATTERN)


def _records(member: BinaryIO) -> Iterator[tuple[int, list[str]]]:
    """Non-blank records with the number of the line they end on."""
    reader = csv.reader(io.TextIOWrapper(member, encoding="utf-8", newline=""))
    for record in reader:
        if len(record) > 1 or (record and record[0].strip()):
            yield reader.line_num, record


def _fast(member: BinaryIO, width: int, header_lines: int) -> Iterator[list[pa.Array]]:
    """Arrow's parser; it rejects files with uneven rows."""
    names = [f"c{i}" for i in range(width)]
    blocks = pacsv.open_csv(
        member,
        read_options=pacsv.ReadOptions(column_names=names, skip_rows=header_lines),
        parse_options=pacsv.ParseOptions(newlines_in_values=True),
        convert_options=pacsv.ConvertOptions(
            column_types={name: pa.string() for name in names}, strings_can_be_null=False
        ),
    )
    for block in blocks:
        yield block.columns


def _tolerant(member: BinaryIO, width: int, skip: int) -> Iterator[list[pa.Array]]:
    """Short rows are filled up with nulls; a row wider than the first record is an error."""
    records = islice(_records(member), skip, None)
    while rows := list(islice(records, BATCH_ROWS)):
        padded = []
        for line, row in rows:
            if len(row) > width:
                raise ValueError(f"line {line}: {len(row)} fields, the header has {width}")
            padded.append(row + [None] * (width - len(row)))
        yield [pa.array(column, pa.string()) for column in zip(*padded)]


def _text_columns(
    open_member: Callable[[], BinaryIO], detect_header: bool
) -> Iterator[list[pa.Array]]:
    with open_member() as member:
        first_lines, first = next(_records(member), (0, None))
    if first is None:
        raise ValueError("the first member is empty")
    has_header = not (detect_header and any(map(_NUMBER.fullmatch, first)))
    width, done = len(first), 0
    try:
        with open_member() as member:
            for columns in _fast(member, width, first_lines if has_header else 0):
                yield columns
                done += len(columns[0])
    except pa.ArrowInvalid:
        with open_member() as member:
            yield from _tolerant(member, width, has_header + done)


def _first_present(columns: list[pa.Array]) -> pa.Array:
    """Per row, the first value that is not a missing-value token."""
    tokens = pa.array(NA_TOKENS)
    return pc.coalesce(
        *(pc.if_else(pc.is_in(c, value_set=tokens), pa.scalar(None, pa.string()), c) for c in columns)
    )


def candle_rows(
    archive: BinaryIO, detect_header: bool = False
) -> Iterator[tuple[int, list[pa.Array]]]:
    """Width of the file, and blocks of 11 candle columns plus ``extra``.

    The first line is taken as a header and dropped, whatever it holds; with ``detect_header``
    it stays if one of its fields is a number.
    """
    with zipfile.ZipFile(archive) as z:
        names = z.namelist()
        if not names:
            raise ValueError("the archive has no member")
        for columns in _text_columns(lambda: z.open(names[0]), detect_header):
            missing = pa.nulls(len(columns[0]), pa.string())
            n = len(CANDLE_COLUMNS)
            candle = columns[:n] + [missing] * (n - len(columns))
            extra = _first_present(columns[n:]) if len(columns) > n else missing
            yield len(columns), [*candle, extra]
