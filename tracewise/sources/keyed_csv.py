"""A Spark data source of CSV files that have headers of their own and say by their names what they hold.

One scan reads a folder's files whatever their headers: a task takes byte ranges of large files or many small files.

    spark.dataSource.register(KeyedCsv)
    spark.read.format("keyed_csv").option("pattern", "*_events.csv").load(folder)

Columns: ``file`` (the name), ``keys`` (the first columns, whatever their headers), ``fields`` (the others by header; of
columns of one name the first counts, blank names are left out) and ``row_ord``, which rises with the files by name and with
the rows in a file. Values are text, as keys such as ``57.0`` must stay what they are; an empty value is null. Short rows
lack their last values, further values of long rows are dropped, blank lines are passed over; a value can't hold a line
break. A file without rows gives none; no file that fits is an error.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tracewise.sources.files import filesystem, listed

SCHEMA = "file string, keys array<string>, fields map<string,string>, row_ord bigint"
ARROW = pa.schema([("file", pa.string()), ("keys", pa.list_(pa.string())), ("fields", pa.map_(pa.string(), pa.string())), ("row_ord", pa.int64())])
#: Bits of ``row_ord`` for a line's place in its file.
PLACE = 42
#: Rows of a batch.
BATCH = 8192


@dataclass(frozen=True)
class Piece:
    """Lines of a file that begin in ``[start, stop)``."""

    path: str
    name: str
    index: int
    start: int
    stop: int


@dataclass
class Pieces(InputPartition):
    """What one task reads."""

    held: tuple[Piece, ...]


def packed(pieces: list[Piece], size: int, opening: int) -> list[Pieces]:
    """Pieces in tasks of about ``size`` bytes, where opening a file counts as ``opening`` bytes."""
    tasks: list[list[Piece]] = []
    room = 0
    for piece in pieces:
        cost = piece.stop - piece.start + opening
        if not tasks or cost > room:
            tasks.append([])
            room = size + opening
        tasks[-1].append(piece)
        room -= cost
    return [Pieces(tuple(t)) for t in tasks]


def _values(line: bytes) -> list[str]:
    return next(csv.reader([line.decode("utf-8").rstrip("\r\n")]), [])


def rows_of(piece: Piece) -> Iterator[tuple[int, list[str], list[str]]]:
    """Place, header and values of each row of a piece."""
    store, inner = filesystem(piece.path)
    with store.open_input_file(inner) as raw, io.BufferedReader(raw, 1 << 20) as file:
        top = file.readline()
        header = _values(top.removeprefix(b"\xef\xbb\xbf"))
        at = len(top)
        if piece.start > at:
            # A line that began before the range belongs to the range before.
            file.seek(piece.start - 1)
            at = piece.start - 1 + len(file.readline())
        while at < piece.stop and (line := file.readline()):
            if values := _values(line):
                yield at, header, values
            at += len(line)


class KeyedCsvReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.pattern = options["path"], options.get("pattern", "*.csv")
        self.keys = int(options.get("keys", 1))
        self.size, self.opening = int(options.get("bytes", 64 << 20)), int(options.get("opening", 1 << 20))

    def partitions(self) -> list[Pieces]:
        files = listed(self.folder, self.pattern)
        if not files:
            raise FileNotFoundError(f"no {self.pattern} in {self.folder}")
        if too_large := [f.name for f in files if f.size >= 1 << PLACE]:
            raise ValueError(f"larger than {1 << PLACE} bytes: {too_large}")
        pieces = [Piece(f.path, f.name, i, at, min(at + self.size, f.size)) for i, f in enumerate(files) for at in range(0, f.size, self.size)]
        return packed(pieces, self.size, self.opening)

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for piece in partition.held:
            for at, header, values in rows_of(piece):
                fields: dict[str, str | None] = {}
                for name, value in zip(header[self.keys :], values[self.keys :], strict=False):
                    if name:
                        fields.setdefault(name, value or None)
                keys = [v or None for v in (*values, *[""] * self.keys)[: self.keys]]
                rows.append({"file": piece.name, "keys": keys, "fields": list(fields.items()), "row_ord": (piece.index << PLACE) + at})
                if len(rows) == BATCH:
                    yield pa.RecordBatch.from_pylist(rows, ARROW)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, ARROW)


class KeyedCsv(DataSource):
    """Options: ``pattern`` of file names, ``keys`` (how many columns in front are keys), ``bytes`` of a task, ``opening`` (bytes that opening a file counts as)."""

    @classmethod
    def name(cls) -> str:
        return "keyed_csv"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return KeyedCsvReader(dict(self.options))
