"""Workbooks (XLSX) as a Spark data source, to write and to read.

A workbook is a ZIP of XML files.  Every task writes one: its rows go through as a stream,
cell by cell into a compressed sheet, and a further sheet begins where a sheet's limit of
rows is reached, so memory is bounded by a batch.  Column widths stand before the rows in
a sheet, so they are found in a first pass over the table (:func:`write_workbooks`).
Files are written to a temporary folder and moved into place by the commit.

Reading gives a task to each sheet, which is parsed as a stream; the first row names the
columns, all cells are text, empty ones are null.  Whole numbers and decimals are written
as numbers, everything else as text; characters that XML can't hold become spaces.
"""

from __future__ import annotations

import json
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from strandline.sources.sas import opened
from strandline.sources.sinks import column_widths

#: Rows that a sheet can hold, its header included. A fixed value of the format.
SHEET_ROWS = 1_048_576
BATCH_ROWS = 10_000

_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
_NO_XML = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")
# Style 1 is the header's: bold white on blue, centred.
_STYLES = (
    f'{_HEAD}<styleSheet xmlns="{_MAIN}"><fonts count="2"><font><sz val="11"/></font><font><b/><color rgb="FFFFFFFF"/><sz val="11"/></font></fonts>'
    '<fills count="3"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill><fill><patternFill patternType="solid"><fgColor rgb="FF1A73E8"/></patternFill></fill></fills>'
    '<borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs>'
    '<cellXfs count="2"><xf/><xf fontId="1" fillId="2" applyFont="1" applyFill="1" applyAlignment="1"><alignment horizontal="center"/></xf></cellXfs></styleSheet>'
)


def letters(column: int) -> str:
    """Name of a column, counted from 0."""
    name = ""
    column += 1
    while column:
        column, rest = divmod(column - 1, 26)
        name = chr(65 + rest) + name
    return name


def _cell(value: object, place: str, style: str = "") -> str:
    if value is None:
        return ""
    if isinstance(value, (int, float)) and not isinstance(value, bool) and value == value:
        return f'<c r="{place}"{style}><v>{value!r}</v></c>'
    text = escape(_NO_XML.sub(" ", str(value)))
    return f'<c r="{place}"{style} t="inlineStr"><is><t xml:space="preserve">{text}</t></is></c>'


def _row(number: int, values: list, style: str = "") -> bytes:
    cells = "".join(_cell(v, f"{letters(k)}{number}", style) for k, v in enumerate(values))
    return f'<row r="{number}">{cells}</row>'.encode("utf-8", "replace")


class Book:
    """A workbook that is written to a stream, row after row."""

    def __init__(self, out, names: list[str], widths: list[int], title: str, rows: int):
        self.zip = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)
        self.names, self.widths, self.title, self.rows = names, widths, title, rows
        self.sheets, self.sheet, self.number = 0, None, 0

    def _begin(self) -> None:
        self.sheets += 1
        self.sheet = self.zip.open(f"xl/worksheets/sheet{self.sheets}.xml", "w", force_zip64=True)
        cols = "".join(f'<col min="{k}" max="{k}" width="{w}" customWidth="1"/>' for k, w in enumerate(self.widths, 1))
        pane = '<sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews>'
        self.sheet.write(f'{_HEAD}<worksheet xmlns="{_MAIN}">{pane}<cols>{cols}</cols><sheetData>'.encode())
        self.sheet.write(_row(1, self.names, ' s="1"'))
        self.number = 1

    def _end(self) -> None:
        if self.sheet is not None:
            self.sheet.write(b"</sheetData></worksheet>")
            self.sheet.close()
            self.sheet = None

    def add(self, values: list) -> None:
        if self.sheet is None or self.number >= self.rows:
            self._end()
            self._begin()
        self.number += 1
        self.sheet.write(_row(self.number, values))

    def close(self) -> None:
        if not self.sheets:
            self._begin()
        self._end()
        each = range(1, self.sheets + 1)
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in each)
        sheets = "".join(f'<sheet name="{escape(self.title)}{"" if k == 1 else f" {k}"}" sheetId="{k}" r:id="rId{k}"/>' for k in each)
        links = "".join(f'<Relationship Id="rId{k}" Type="{_OFFICE}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in each)
        files = {
            "[Content_Types].xml": f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
            '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
            f'<Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>{parts}</Types>',
            "_rels/.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
            "xl/workbook.xml": f'<workbook xmlns="{_MAIN}" xmlns:r="{_OFFICE}"><sheets>{sheets}</sheets></workbook>',
            "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_PACKAGE}/relationships">{links}<Relationship Id="rId{self.sheets + 1}" Type="{_OFFICE}/styles" Target="styles.xml"/></Relationships>',
        }
        for name, text in files.items():
            self.zip.writestr(name, _HEAD + text)
        self.zip.writestr("xl/styles.xml", _STYLES)
        self.zip.close()


def books_of(path: str) -> list[str]:
    """Paths of the workbooks: itself, or what a folder holds, in order."""
    system, inner = opened(path)
    if system.get_file_info(inner).type == fs.FileType.File:
        return [path]
    found = sorted(i.base_name for i in system.get_file_info(fs.FileSelector(inner)) if i.base_name.endswith(".xlsx"))
    return [f"{path.rstrip('/')}/{name}" for name in found]


def _rows(path: str, sheet: str) -> Iterator[list[str | None]]:
    """The rows of a sheet, parsed as a stream; cells by the column they name."""
    system, inner = opened(path)
    with system.open_input_file(inner) as file, zipfile.ZipFile(file) as book:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in book.namelist():
            with book.open("xl/sharedStrings.xml") as part:
                shared = ["".join(t.text or "" for t in item.iter(f"{{{_MAIN}}}t")) for item in ElementTree.parse(part).getroot()]
        with book.open(sheet) as part:
            for _, row in ElementTree.iterparse(part):
                if row.tag != f"{{{_MAIN}}}row":
                    continue
                out: list[str | None] = []
                for k, cell in enumerate(row.iter(f"{{{_MAIN}}}c")):
                    name = re.match("[A-Z]+", cell.get("r", ""))
                    at = sum((ord(c) - 64) * 26**p for p, c in enumerate(reversed(name.group()))) - 1 if name else k
                    out += [None] * (at + 1 - len(out))
                    if cell.get("t") == "inlineStr":
                        out[at] = "".join(t.text or "" for t in cell.iter(f"{{{_MAIN}}}t"))
                    else:
                        value = cell.findtext(f"{{{_MAIN}}}v")
                        out[at] = shared[int(value)] if cell.get("t") == "s" and value is not None else value
                row.clear()
                yield out


class _Sheet(InputPartition):
    def __init__(self, path: str, sheet: str):
        self.path, self.sheet = path, sheet


class _Reader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType):
        self.path, self.names = path, schema.names

    def partitions(self) -> list[InputPartition]:
        out = []
        for path in books_of(self.path):
            system, inner = opened(path)
            with system.open_input_file(inner) as file, zipfile.ZipFile(file) as book:
                out += [_Sheet(path, n) for n in sorted(book.namelist()) if n.startswith("xl/worksheets/")]
        return out

    def read(self, partition: _Sheet) -> Iterator[pa.RecordBatch]:
        held: list[list[str | None]] = []
        kinds = [pa.string()] * len(self.names)

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] if k < len(r) else None for r in held], kind) for k, kind in enumerate(kinds)], names=self.names)

        for number, row in enumerate(_rows(partition.path, partition.sheet)):
            if number:
                held.append(row)
            if len(held) >= BATCH_ROWS:
                yield batch()
                held = []
        if held:
            yield batch()


@dataclass
class _Written(WriterCommitMessage):
    name: str


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, schema: T.StructType, options: dict, overwrite: bool):
        self.path, self.names, self.overwrite = path, schema.names, overwrite
        widths = json.loads(options.get("widths", "{}"))
        self.widths = [int(widths.get(n, len(n) + 3)) for n in self.names]
        self.title, self.rows = options.get("title", "Sheet"), min(int(options.get("sheetrows", SHEET_ROWS)), SHEET_ROWS)
        self.staged = f"_staged-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        system, inner = opened(self.path)
        system.create_dir(f"{inner}/{self.staged}", recursive=True)
        name, book = f"part-{uuid.uuid4().hex}.xlsx", None
        with system.open_output_stream(f"{inner}/{self.staged}/{name}") as out:
            for batch in iterator:
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    book = book or Book(out, self.names, self.widths, self.title, self.rows)
                    book.add(row)
            if book:
                book.close()
        return _Written(name if book else "")

    def commit(self, messages: list) -> None:
        system, inner = opened(self.path)
        system.create_dir(inner, recursive=True)
        if self.overwrite:
            for old in books_of(self.path):
                system.delete_file(opened(old)[1])
        names = [m.name for m in messages if m is not None and m.name]
        if not names and not books_of(self.path):
            with system.open_output_stream(f"{inner}/part-empty.xlsx") as out:
                Book(out, self.names, self.widths, self.title, self.rows).close()
        for name in names:
            system.move(f"{inner}/{self.staged}/{name}", f"{inner}/{name}")
        self.abort(messages)

    def abort(self, messages: list) -> None:
        system, inner = opened(self.path)
        if system.get_file_info(f"{inner}/{self.staged}").type == fs.FileType.Directory:
            system.delete_dir(f"{inner}/{self.staged}")


class WorkbookSource(DataSource):
    """The data source ``xlsx``."""

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def schema(self) -> T.StructType:
        books = books_of(self.options["path"])
        if not books:
            raise ValueError(f"no workbook in {self.options['path']}")
        return T.StructType([T.StructField(n or f"column{k}", T.StringType()) for k, n in enumerate(next(_rows(books[0], "xl/worksheets/sheet1.xml"), []))])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options["path"], schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], schema, self.options, overwrite)


def write_workbooks(rows: DataFrame, path: str, title: str = "All Subsidiaries", sheet_rows: int = SHEET_ROWS, mode: str = "overwrite") -> None:
    """Write the rows, in workbooks of a partition each; widths come from a first pass."""
    rows.sparkSession.dataSource.register(WorkbookSource)
    widths = column_widths(rows).first().asDict()
    shown = rows.select(*(F.col(f.name) if isinstance(f.dataType, (T.IntegralType, T.FractionalType)) and not isinstance(f.dataType, T.DecimalType) else F.col(f.name).cast("string") for f in rows.schema))
    shown.write.format("xlsx").option("widths", json.dumps(widths)).option("title", title).option("sheetRows", sheet_rows).mode(mode).save(path)


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(WorkbookSource)
    return spark.read.format("xlsx").load(path)
