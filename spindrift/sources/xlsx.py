"""XLSX sheets as a data source, parsed with the standard library; all cells come as text."""

from __future__ import annotations

import io
import itertools
import os
import re
import zipfile
from xml.etree import ElementTree

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader
from pyspark.sql.types import StringType, StructField, StructType

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"

#: Rows of a workbook; a sheet can have 1 048 576 with its header.
BOOK_ROWS = 1_000_000


def _local(path: str):
    """The file's bytes, through Arrow's file systems for other than local paths."""
    if "://" in path:
        files, place = fs.FileSystem.from_uri(path)
        with files.open_input_file(place) as f:
            return io.BytesIO(f.read())
    return path.removeprefix("file:")


def _texts(node) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_MAIN}t"))


def _column(reference: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", reference).group():
        n = n * 26 + ord(c) - 64
    return n - 1


def read_sheet(path: str, sheet: str = "0"):
    """Rows of a sheet, by name or by number, as lists of texts (None for empty cells)."""
    with zipfile.ZipFile(_local(path)) as book:
        shared = [_texts(s) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")] if "xl/sharedStrings.xml" in book.namelist() else []
        sheets = [(s.get("name"), s.get(f"{_REL}id")) for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        names = [n for n, _ in sheets]
        if sheet not in names and not (sheet.isdigit() and int(sheet) < len(sheets)):
            raise ValueError(f"no sheet {sheet!r}; there are {', '.join(names)}")
        target = targets[dict(sheets)[sheet] if sheet in names else sheets[int(sheet)][1]].lstrip("/")
        with book.open(target if target.startswith("xl/") else f"xl/{target}") as f:
            for _, row in ElementTree.iterparse(f):
                if row.tag != f"{_MAIN}row":
                    continue
                cells: dict[int, str | None] = {}
                for i, c in enumerate(row.iter(f"{_MAIN}c")):
                    kind, value = c.get("t"), c.find(f"{_MAIN}v")
                    text = _texts(c) if kind == "inlineStr" else None if value is None else value.text
                    if text is not None and kind == "s":
                        text = shared[int(text)]
                    elif text is not None and kind == "b":
                        text = "true" if text == "1" else "false"
                    cells[_column(c.get("r")) if c.get("r") else i] = text
                yield [cells.get(i) for i in range(max(cells, default=-1) + 1)]
                row.clear()


class XlsxSource(DataSource):
    """Options: path, sheet (name or number, 0 if not given). The first row has the names."""

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def _header(self) -> list[str]:
        first = next(read_sheet(self.options["path"], self.options.get("sheet", "0")), [])
        return [x if x is not None else f"column_{i}" for i, x in enumerate(first)]

    def schema(self) -> StructType:
        return StructType([StructField(n, StringType()) for n in self._header()])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("sheet", "0"), len(schema.fields))


class _Reader(DataSourceReader):
    def __init__(self, path: str, sheet: str, width: int):
        self.path, self.sheet, self.width = path, sheet, width

    def read(self, partition):
        rows = read_sheet(self.path, self.sheet)
        next(rows, None)
        for row in rows:
            yield tuple((row + [None] * self.width)[: self.width])


def write_xlsx(path: str, header: list[str], rows, sheet: str = "Sheet1") -> None:
    """A small workbook with inline texts and numbers; for exports and tests."""
    from xml.sax.saxutils import escape

    def cell(v) -> str:
        if v is None:
            return "<c/>"
        if isinstance(v, bool):
            return f'<c t="b"><v>{int(v)}</v></c>'
        if isinstance(v, (int, float)):
            return f"<c><v>{v!r}</v></c>"
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    whole = io.BytesIO()
    with zipfile.ZipFile(whole, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr("[Content_Types].xml", '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>')
        book.writestr("_rels/.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        book.writestr("xl/workbook.xml", f'<workbook {space} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="rId1"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        with book.open("xl/worksheets/sheet1.xml", "w") as f:
            f.write(f"<worksheet {space}><sheetData>".encode())
            for row in itertools.chain([header], rows):
                f.write(("<row>" + "".join(map(cell, row)) + "</row>").encode())
            f.write(b"</sheetData></worksheet>")
    files, place = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    files.create_dir(os.path.dirname(place), recursive=True)
    with files.open_output_stream(place) as out:
        out.write(whole.getvalue())


def write_workbooks(df, folder: str, rows_in_each: int = BOOK_ROWS) -> list[str]:
    """The whole table in workbooks of so many rows each, in its order; one without rows for an empty table. The driver holds one workbook."""
    rows, paths = map(tuple, df.toLocalIterator()), []
    while (first := next(rows, None)) is not None or not paths:
        paths.append(f"{folder}/book-{len(paths):05d}.xlsx")
        write_xlsx(paths[-1], df.columns, [] if first is None else itertools.chain([first], itertools.islice(rows, rows_in_each - 1)))
    return paths
