"""SAS7BDAT files as a Spark data source, to read and to write.

``spark.read.format("sas7bdat").load(path)`` reads a file or all ``*.sas7bdat`` of a
folder.  A file is a header and pages of one size; the first pages describe the columns.
The driver reads those alone; each task then gets a range of pages of one file, seeks to
it and parses page after page into Arrow batches, column by column, so memory is bounded
by a page and a batch.  Rows of compressed files are expanded one by one (both of the
format's methods), others never leave numpy.

``df.write.format("sas7bdat").save(folder)`` writes files of at most ``fileBytes`` of rows
from every task to a temporary folder, which the commit moves into place; an overwrite
first removes what was there.  A table without rows is one file without rows.

Text is fixed-width in these files, so blanks at its end are lost and an empty text is
null; numbers are doubles, and whole numbers above 2^53 lose digits; dates and times are
days and seconds since 1960 with a format that says so.  Missing numbers are null.

Options: ``encoding`` (else the header's), ``pages`` (of a task, 1024), and for writing
``pageSize`` (65536), ``fileBytes`` (64 MB), ``compression`` (``none`` or ``rle``).
"""

from __future__ import annotations

import datetime as dt
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

# Fixed values of the format.
MAGIC = bytes.fromhex("000000000000000000000000c2ea8160b31411cfbd92080009c7318c181f1011")
ENCODINGS = {0: "latin-1", 20: "utf-8", 28: "ascii", 29: "latin-1", 33: "latin-5", 60: "cp437", 61: "cp850", 62: "cp1252"}
ROW_SIZE, COLUMN_SIZE, COLUMN_TEXT, COLUMN_NAME, COLUMN_ATTRIBUTES, COLUMN_FORMAT = 0xF7F7F7F7, 0xF6F6F6F6, -3, -1, -4, -1026
META, DATA, MIX, AMENDED = 0x0000, 0x0100, 0x0200, 0x0400
RLE, RDC = b"SASYZCRL", b"SASYZCR2"
TIME_FORMATS = ("DATETIME",)
DATE_FORMATS = ("DATE", "DAY", "DDMMYY", "E8601DA", "JULIAN", "MMDDYY", "MONYY", "WEEKDATE", "WORDDATE", "YYMMDD", "YYMM", "YYQ")

#: Days from the format's first day, in 1960, to Spark's, in 1970.
EPOCH_DAYS = (dt.date(1970, 1, 1) - dt.date(1960, 1, 1)).days
BATCH_ROWS = 65_536


@dataclass
class Column:
    name: str
    text: bool
    offset: int
    size: int
    format: str = ""

    @property
    def kind(self) -> T.DataType:
        if self.text:
            return T.StringType()
        if self.format.startswith(TIME_FORMATS):
            return T.TimestampNTZType()
        return T.DateType() if self.format.startswith(DATE_FORMATS) else T.DoubleType()


@dataclass
class Layout:
    """What header and first pages say."""

    header: int
    page: int
    pages: int
    wide: bool
    order: str
    encoding: str
    row: int = 0
    rows: int = 0
    mixed: int = 0
    columns: list[Column] = field(default_factory=list)
    method: bytes = b""

    @property
    def word(self) -> int:
        return 8 if self.wide else 4

    @property
    def begin(self) -> int:
        """Where a page's own fields begin."""
        return 32 if self.wide else 16

    @property
    def pointer(self) -> int:
        return 24 if self.wide else 12

    def number(self, data: bytes, at: int, size: int, signed: bool = False) -> int:
        return int.from_bytes(data[at : at + size], "little" if self.order == "<" else "big", signed=signed)

    def fields(self, page: bytes) -> tuple[int, int, int]:
        """Type, blocks and subheaders of a page."""
        return tuple(self.number(page, self.begin + k, 2) for k in (0, 2, 4))

    def pointers(self, page: bytes, count: int) -> Iterator[tuple[int, int, int, int]]:
        """offset, length, compression and kind of the subheaders."""
        for k in range(count):
            at = self.begin + 8 + k * self.pointer
            w = self.word
            yield self.number(page, at, w), self.number(page, at + w, w), page[at + 2 * w], page[at + 2 * w + 1]


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it of a URI or an absolute path."""
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else path.replace("file:", "", 1))


def files_of(path: str) -> list[str]:
    """Paths of the files: itself, or what a folder holds, in order."""
    system, inner = opened(path)
    if system.get_file_info(inner).type == fs.FileType.File:
        return [path]
    found = sorted(i.base_name for i in system.get_file_info(fs.FileSelector(inner)) if i.type == fs.FileType.File and i.base_name.lower().endswith(".sas7bdat"))
    return [f"{path.rstrip('/')}/{name}" for name in found]


def layout_of(path: str, encoding: str | None = None) -> Layout:
    """Read the header, and pages until all columns are known."""
    system, inner = opened(path)
    with system.open_input_file(inner) as file:
        head = file.read_at(400, 0)
        if head[: len(MAGIC)] != MAGIC:
            raise ValueError(f"{path} is no SAS7BDAT file")
        order, wide = "<" if head[37] == 1 else ">", head[32] == 0x33
        shift = 4 if head[35] == 0x33 else 0
        size, page, pages = struct.unpack_from(order + "III", head, 196 + shift)
        layout = Layout(size, page, pages, wide, order, encoding or ENCODINGS.get(head[70], "latin-1"))
        texts: list[bytes] = []
        names, attributes, formats, number = [], [], [], None
        for k in range(pages):
            data = file.read_at(page, size + k * page)
            kind, _, subheaders = layout.fields(data)
            if kind not in (META, MIX, AMENDED):
                break
            for at, length, compression, _ in layout.pointers(data, subheaders):
                if length == 0 or compression in (1, 4):
                    continue
                number = _described(layout, data[at : at + length], texts, names, attributes, formats) or number
            if number is not None and len(names) >= number and len(attributes) >= number and len(formats) >= number:
                break
    if number is None or not layout.row:
        raise ValueError(f"{path} doesn't describe its columns")
    said = lambda place: texts[place[0]][place[1] : place[1] + place[2]].decode(layout.encoding, "replace").strip("\0 ") if place[2] else ""
    formats += [(0, 0, 0)] * (number - len(formats))
    layout.columns = [Column(said(n), *a, said(f)) for n, a, f in zip(names[:number], attributes, formats, strict=False)]
    return layout


def _described(layout: Layout, sub: bytes, texts: list, names: list, attributes: list, formats: list) -> int | None:
    """Take in one subheader; the number of columns where it tells it."""
    w = layout.word
    # Signatures of 8 bytes repeat or extend those of 4.
    sign = layout.number(sub, 0 if layout.order == "<" or not layout.wide else 4, 4)
    signed = sign - (1 << 32) if sign >> 31 else sign
    if sign == ROW_SIZE:
        layout.row, layout.rows, layout.mixed = (layout.number(sub, k * w, w) for k in (5, 6, 15))
    elif sign == COLUMN_SIZE:
        return layout.number(sub, w, w)
    elif signed == COLUMN_TEXT:
        texts.append(sub[w:])
        if len(texts) == 1:
            layout.method = next((m for m in (RLE, RDC) if m in sub), b"")
    elif signed == COLUMN_NAME:
        for k in range((len(sub) - 2 * w - 12) // 8):
            at = w + 8 * (k + 1)
            names.append(tuple(layout.number(sub, at + j, 2) for j in (0, 2, 4)))
    elif signed == COLUMN_ATTRIBUTES:
        for k in range((len(sub) - 2 * w - 12) // (w + 8)):
            at = w + 8 + k * (w + 8)
            attributes.append((sub[at + w + 6] == 2, layout.number(sub, at, w), layout.number(sub, at + w, 4)))
    elif signed == COLUMN_FORMAT:
        formats.append(tuple(layout.number(sub, 3 * w + j, 2) for j in (22, 24, 26)))
    return None


def unpacked_rle(row: bytes, size: int) -> bytes:
    """One row of run-length coding: the high half of a control byte is what to do, the low half counts."""
    out, at = bytearray(), 0
    while at < len(row):
        what, low = row[at] >> 4, row[at] & 15
        at += 1
        if what in (0, 4, 6, 7):  # another byte extends the count
            more = row[at]
            at += 1
            if what == 0:
                n = 64 + low * 256 + more
                out += row[at : at + n]
                at += n
            elif what == 4:
                out += row[at : at + 1] * (18 + low * 256 + more)
                at += 1
            else:
                out += (b" " if what == 6 else b"\0") * (17 + low * 256 + more)
        elif 8 <= what <= 11:
            n = 1 + 16 * (what - 8) + low
            out += row[at : at + n]
            at += n
        elif what == 12:
            out += row[at : at + 1] * (low + 3)
            at += 1
        elif what >= 13:
            out += (b"@", b" ", b"\0")[what - 13] * (low + 2)
        else:
            raise ValueError(f"unknown control byte {row[at - 1]:#x} of a compressed row")
    return bytes(out.ljust(size, b"\0")[:size])


def packed_rle(row: bytes) -> bytes:
    """The coding that :func:`unpacked_rle` reads, of the runs of three bytes and more."""
    out, at, plain = bytearray(), 0, 0

    def literal(end: int) -> None:
        nonlocal plain
        while plain < end:
            n = min(end - plain, 64)
            out.append((8 + (n - 1) // 16) << 4 | (n - 1) % 16)
            out.extend(row[plain : plain + n])
            plain += n

    while at < len(row):
        run = 1
        while at + run < len(row) and run < 4000 and row[at + run] == row[at]:
            run += 1
        if run >= 3:
            literal(at)
            byte = row[at]
            if byte in (0, 32) and run >= 17:
                out += bytes([(0x60 if byte == 32 else 0x70) | (run - 17) >> 8, (run - 17) & 255])
            elif byte in (0, 32):
                out.append((0xE0 if byte == 32 else 0xF0) | run - 2)
            elif run >= 18:
                out += bytes([0x40 | (run - 18) >> 8, (run - 18) & 255, byte])
            else:
                out += bytes([0xC0 | run - 3, byte])
            plain = at + run
        at += run
    literal(len(row))
    return bytes(out)


def unpacked_rdc(row: bytes, size: int) -> bytes:
    """One row of dictionary coding: 16 flags, then for each a byte as it is, or a run or an earlier piece."""
    out, at = bytearray(), 0
    while at + 1 < len(row):
        flags = row[at] << 8 | row[at + 1]
        at += 2
        for k in range(15, -1, -1):
            if at >= len(row):
                break
            if not flags >> k & 1:
                out.append(row[at])
                at += 1
                continue
            what, low = row[at] >> 4, row[at] & 15
            at += 1
            if what == 0:
                out += row[at : at + 1] * (low + 3)
                at += 1
            elif what == 1:
                out += row[at + 1 : at + 2] * (19 + low + row[at] * 16)
                at += 2
            else:
                back = low + 3 + row[at] * 16
                n = row[at + 1] + 16 if what == 2 else what
                at += 2 if what == 2 else 1
                for _ in range(n):
                    out.append(out[-back])
    return bytes(out.ljust(size, b"\0")[:size])


def rows_of(layout: Layout, page: bytes) -> np.ndarray:
    """The rows of a page, one after the other, as bytes (rows, width)."""
    kind, blocks, subheaders = layout.fields(page)
    after = layout.begin + 8
    if kind == DATA:
        n = blocks
    elif kind == MIX:
        after += subheaders * layout.pointer
        after += after % 8
        n = min(layout.rows, layout.mixed)
    elif kind in (META, AMENDED):
        expand = unpacked_rdc if layout.method == RDC else unpacked_rle
        found = [page[at : at + length] for at, length, compression, which in layout.pointers(page, subheaders) if compression == 4 and which == 1 and length]
        whole = b"".join(r if len(r) >= layout.row else expand(r, layout.row) for r in found)
        return np.frombuffer(whole, np.uint8).reshape(-1, layout.row)
    else:
        n = 0
    return np.frombuffer(page, np.uint8, n * layout.row, after).reshape(n, layout.row)


def _array(layout: Layout, column: Column, rows: np.ndarray) -> pa.Array:
    cells = np.ascontiguousarray(rows[:, column.offset : column.offset + column.size])
    if column.text:
        if not len(cells) or not column.size:
            return pa.nulls(len(cells), pa.string())
        raw = cells.view(f"S{column.size}")[:, 0]  # numpy drops zeros at the end
        if layout.encoding == "utf-8":
            text = pa.array([x.decode("utf-8", "ignore") for x in raw], pa.string())
        else:
            text = pa.array(np.char.decode(raw, layout.encoding, "replace"), pa.string())
        text = pc.utf8_rtrim(text, " ")
        return pc.if_else(pc.equal(text, ""), pa.scalar(None, pa.string()), text)
    wide = np.zeros((len(rows), 8), dtype=np.uint8)  # short numbers lack their last digits
    if layout.order == "<":
        wide[:, 8 - column.size :] = cells
    else:
        wide[:, : column.size] = cells
    value = wide.view(layout.order + "f8")[:, 0].astype(np.float64)
    missing = np.isnan(value)
    value = np.where(missing, 0.0, value)
    if isinstance(column.kind, T.DateType):
        return pa.array((np.floor(value) - EPOCH_DAYS).astype(np.int32), pa.int32(), mask=missing).cast(pa.date32())
    if isinstance(column.kind, T.TimestampNTZType):
        micros = np.round((value - EPOCH_DAYS * 86_400) * 1e6).astype(np.int64)
        return pa.array(micros, pa.int64(), mask=missing).cast(pa.timestamp("us"))
    return pa.array(value, mask=missing)


class _Pages(InputPartition):
    """Pages ``first`` to before ``last`` of a file."""

    def __init__(self, path: str, layout: Layout, first: int, last: int):
        self.path, self.layout, self.first, self.last = path, layout, first, last


class _Reader(DataSourceReader):
    def __init__(self, path: str, options: dict):
        self.path, self.encoding, self.pages = path, options.get("encoding"), int(options.get("pages", "1024"))

    def partitions(self) -> list[InputPartition]:
        out = []
        for path in files_of(self.path):
            layout = layout_of(path, self.encoding)
            out += [_Pages(path, layout, a, min(a + self.pages, layout.pages)) for a in range(0, layout.pages, self.pages)]
        return out

    def read(self, partition: _Pages) -> Iterator[pa.RecordBatch]:
        layout = partition.layout
        names = [c.name for c in layout.columns]
        system, inner = opened(partition.path)
        held, size = [], 0

        def batch() -> pa.RecordBatch:
            rows = np.concatenate(held)
            return pa.RecordBatch.from_arrays([_array(layout, c, rows) for c in layout.columns], names=names)

        with system.open_input_file(inner) as file:
            for k in range(partition.first, partition.last):
                rows = rows_of(layout, file.read_at(layout.page, layout.header + k * layout.page))
                if len(rows):
                    held.append(rows)
                    size += len(rows)
                if size >= BATCH_ROWS:
                    yield batch()
                    held, size = [], 0
        if held:
            yield batch()


@dataclass
class _Written(WriterCommitMessage):
    names: list[str]


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, schema: T.StructType, options: dict, overwrite: bool):
        self.path, self.schema, self.overwrite = path, schema, overwrite
        self.page, self.most = int(options.get("pagesize", "65536")), int(options.get("filebytes", str(64 << 20)))
        self.rle = options.get("compression", "none") == "rle"
        self.staged = f"_staged-{uuid.uuid4().hex}"
        for f in schema.fields:
            if not isinstance(f.dataType, (T.StringType, T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)):
                raise ValueError(f"a SAS7BDAT file can't hold {f.name} of {f.dataType.simpleString()}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        system, inner = opened(self.path)
        system.create_dir(f"{inner}/{self.staged}", recursive=True)
        held, size, names = [], 0, []

        def save(table: pa.Table) -> None:
            names.append(f"part-{uuid.uuid4().hex}.sas7bdat")
            with system.open_output_stream(f"{inner}/{self.staged}/{names[-1]}") as out:
                for piece in encoded(table, self.schema, self.page, self.rle):
                    out.write(piece)

        for batch in iterator:
            step = max(1, batch.num_rows * self.most // max(batch.nbytes, 1))
            for at in range(0, batch.num_rows, step):
                held.append(batch.slice(at, step))
                size += held[-1].nbytes
                if size >= self.most:
                    save(pa.Table.from_batches(held))
                    held, size = [], 0
        if sum(b.num_rows for b in held):
            save(pa.Table.from_batches(held))
        return _Written(names)

    def commit(self, messages: list) -> None:
        system, inner = opened(self.path)
        system.create_dir(inner, recursive=True)
        if self.overwrite:
            for old in files_of(self.path):
                system.delete_file(opened(old)[1])
        names = [n for m in messages if m is not None for n in m.names]
        if not names and not files_of(self.path):
            with system.open_output_stream(f"{inner}/part-empty.sas7bdat") as out:
                for piece in encoded(None, self.schema, self.page, self.rle):
                    out.write(piece)
        for name in names:
            system.move(f"{inner}/{self.staged}/{name}", f"{inner}/{name}")
        self._clear(system, inner)

    def abort(self, messages: list) -> None:
        self._clear(*opened(self.path))

    def _clear(self, system: fs.FileSystem, inner: str) -> None:
        if system.get_file_info(f"{inner}/{self.staged}").type == fs.FileType.Directory:
            system.delete_dir(f"{inner}/{self.staged}")


def _width(column: pa.ChunkedArray, kind: T.DataType) -> int:
    """Bytes of the column's longest value."""
    if not isinstance(kind, T.StringType):
        return 8
    width = max(1, pc.max(pc.binary_length(column)).as_py() or 0)
    if width > 32_767:
        raise ValueError("a text of a SAS7BDAT file has 32767 bytes at most")
    return width


def _cells(column: pa.ChunkedArray, kind: T.DataType, width: int) -> np.ndarray:
    """The values as bytes (rows, width)."""
    if isinstance(kind, T.StringType):
        raw = np.array([(x or "").encode("utf-8") for x in column.to_pylist()], dtype=bytes)
        cells = raw.astype(f"S{width}").view(np.uint8).reshape(len(raw), width).copy()
        cells[cells == 0] = 32
        return cells
    if isinstance(kind, T.DateType):
        value = np.array(column.cast(pa.int32()).cast(pa.float64()).to_numpy(), dtype="<f8") + EPOCH_DAYS
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        micros = column.cast(pa.timestamp("us", column.type.tz)).cast(pa.int64())
        value = np.array(micros.cast(pa.float64(), safe=False).to_numpy(), dtype="<f8") / 1e6 + EPOCH_DAYS * 86_400
    else:
        value = np.array(column.cast(pa.int8() if isinstance(kind, T.BooleanType) else column.type).cast(pa.float64(), safe=False).to_numpy(), dtype="<f8")
    return np.ascontiguousarray(value).view(np.uint8).reshape(-1, 8)


def _subheaders(schema: T.StructType, widths: list[int], rows: int, method: bytes) -> list[bytes]:
    """The descriptions of a file's columns, for 64-bit little-endian files."""
    names = [f.name.encode("utf-8") for f in schema.fields]
    formats = [b"DATE" if isinstance(f.dataType, T.DateType) else b"DATETIME" if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)) else b"" for f in schema.fields]
    text, places = bytearray(method.ljust(28, b"\0")), []
    for piece in (*names, *formats):
        places.append((len(text) + 2, len(piece)))
        text += piece.ljust(-(-len(piece) // 4) * 4, b"\0")
    sign = lambda n: struct.pack("<q", n) if n < 0 else struct.pack("<Q", n)
    size = bytearray(sign(ROW_SIZE).ljust(808, b"\0"))
    for k, value in ((5, sum(widths)), (6, rows), (9, len(names)), (10, 0), (15, 0)):
        struct.pack_into("<Q", size, k * 8, value)
    column_text = sign(COLUMN_TEXT) + struct.pack("<H", len(text) + 2) + text
    name = sign(COLUMN_NAME) + bytes(8) + b"".join(struct.pack("<HHHH", 0, *places[k], 0) for k in range(len(names))) + bytes(12)
    at = np.append(0, np.cumsum(widths))[:-1]
    text_mark = [2 if isinstance(f.dataType, T.StringType) else 1 for f in schema.fields]
    attributes = sign(COLUMN_ATTRIBUTES) + bytes(8) + b"".join(struct.pack("<QIHBB", int(a), w, 0, t, 0) for a, w, t in zip(at, widths, text_mark, strict=True)) + bytes(12)
    described = []
    for k in range(len(names)):
        sub = bytearray(sign(COLUMN_FORMAT).ljust(64, b"\0"))
        place, length = places[len(names) + k]
        struct.pack_into("<HHH", sub, 46, 0, place if length else 0, length)
        described.append(bytes(sub))
    return [bytes(size), sign(COLUMN_SIZE) + struct.pack("<QQ", len(names), 0), bytes(column_text), name, attributes, *described]


def _page(kind: int, size: int, blocks: int, subheaders: list[tuple[bytes, int, int]] = (), rows: bytes = b"") -> bytes:
    """A page: its subheaders stand at its end, in falling order, their pointers after its own fields."""
    out = bytearray(size)
    struct.pack_into("<HHH", out, 32, kind, blocks, len(subheaders))
    out[40 : 40 + len(rows)] = rows
    end = size
    for k, (data, compression, which) in enumerate(subheaders):
        end -= len(data)
        out[end : end + len(data)] = data
        struct.pack_into("<QQBB", out, 40 + 24 * k, end, len(data), compression, which)
    return bytes(out)


def _paged(subheaders: Iterator[tuple[bytes, int, int]], size: int) -> Iterator[bytes]:
    held, room = [], size - 40
    for sub in subheaders:
        need = -(-len(sub[0]) // 8) * 8
        if need + 24 > size - 40:
            raise ValueError(f"a page of {size} bytes is too small; set pageSize")
        if need + 24 > room:
            yield _page(META, size, len(held), held)
            held, room = [], size - 40
        held.append((sub[0].ljust(need, b"\0") if sub[1] == 0 and len(sub[0]) % 8 else sub[0], *sub[1:]))
        room -= need + 24
    if held:
        yield _page(META, size, len(held), held)


def encoded(table: pa.Table | None, schema: T.StructType, page: int = 65_536, rle: bool = False) -> Iterator[bytes]:
    """The bytes of a file: header and pages, the rows a slice at a time."""
    n = 0 if table is None else table.num_rows
    widths = [_width(table.column(k), f.dataType) if n else 1 if isinstance(f.dataType, T.StringType) else 8 for k, f in enumerate(schema.fields)]
    width = sum(widths)

    def slices(size: int) -> Iterator[np.ndarray]:
        for at in range(0, n, size):
            part = table.slice(at, size)
            yield np.concatenate([_cells(part.column(k), f.dataType, widths[k]) for k, f in enumerate(schema.fields)], axis=1)

    pages = list(_paged(((s, 0, 0) for s in _subheaders(schema, widths, n, RLE if rle else b"")), page))
    count, rest = len(pages), iter(())
    if rle:
        packed = lambda row: min((packed_rle(row), row), key=len)
        pages += _paged(((packed(row.tobytes()), 4, 1) for rows in slices(BATCH_ROWS) for row in rows), page)
        count = len(pages)
    else:
        fit = (page - 40) // width
        if fit == 0:
            raise ValueError(f"a page of {page} bytes is smaller than a row of {width}; set pageSize")
        rest = (_page(DATA, page, len(part), rows=part.tobytes()) for rows in slices(max(1, BATCH_ROWS // fit) * fit) for part in (rows[a : a + fit] for a in range(0, len(rows), fit)))
        count += -(-n // fit)
    head = bytearray(page)
    head[: len(MAGIC)] = MAGIC
    head[32], head[35], head[37], head[39], head[70] = 0x33, 0x33, 1, ord("1"), 20
    head[84:92], head[92:124], head[156:164] = b"SAS FILE", b"PANEL".ljust(32), b"DATA    "
    struct.pack_into("<III", head, 200, page, page, count)
    head[224:232] = b"9.0401M0"
    yield bytes(head)
    yield from pages
    yield from rest


class SasSource(DataSource):
    """The data source ``sas7bdat``."""

    @classmethod
    def name(cls) -> str:
        return "sas7bdat"

    def schema(self) -> T.StructType:
        files = files_of(self.options["path"])
        if not files:
            raise ValueError(f"no SAS7BDAT file in {self.options['path']}")
        return T.StructType([T.StructField(c.name, c.kind) for c in layout_of(files[0], self.options.get("encoding")).columns])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options["path"], self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], schema, self.options, overwrite)


def registered(spark: SparkSession) -> SparkSession:
    """The session, with the data source known to it."""
    spark.dataSource.register(SasSource)
    return spark
