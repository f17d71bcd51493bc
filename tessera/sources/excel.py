"""Workbooks (xlsx), read and written with the standard library: a zip of XML parts.

Workbooks are read by Spark as binary files, so any store and any number of workbooks will do; a
workbook's rows are parsed in one task, as its parts can't be split.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..names import ROW_ID, numbered_duplicates
from .storage import exists, put
from .typeguess import GUESS, ColumnTypes, apply_types

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_CELL = re.compile(r"([A-Z]+)([0-9]+)")


def _column(letters: str) -> int:
    n = 0
    for ch in letters:
        n = n * 26 + ord(ch) - 64
    return n - 1


def _letters(n: int) -> str:
    out = ""
    n += 1
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def _range(text: str) -> tuple[int, int, int, int]:
    """``A1:D10`` as first row, last row, first column, last column, from 0."""
    a, b = (_CELL.fullmatch(p.replace("$", "")) for p in text.upper().split(":"))
    if not a or not b:
        raise ValueError(f"not a range of cells: {text}")
    return int(a[2]) - 1, int(b[2]) - 1, _column(a[1]), _column(b[1])


def _sheet_path(z: zipfile.ZipFile, sheet: int | str) -> str:
    book = ET.fromstring(z.read("xl/workbook.xml"))
    rels = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    sheets = book.findall(f"{_NS}sheets/{_NS}sheet")
    if isinstance(sheet, int):
        if sheet >= len(sheets):
            raise ValueError(f"there are {len(sheets)} sheets")
        found = sheets[sheet]
    else:
        found = next((s for s in sheets if s.get("name") == sheet), None)
        if found is None:
            raise ValueError(f"no sheet {sheet!r}; there are {[s.get('name') for s in sheets]}")
    target = rels[found.get(_REL)]
    return target.lstrip("/") if target.startswith("/") else f"xl/{target}"


def _number(text: str) -> str:
    """Whole numbers without a decimal point."""
    v = float(text)
    return str(int(v)) if v == int(v) and abs(v) < 1e15 else repr(v)


def cells_of(data: bytes, sheet: int | str = 0) -> dict[int, dict[int, str]]:
    """Text of the cells that there are, by row and column from 0."""
    out: dict[int, dict[int, str]] = {}
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            for si in ET.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{_NS}si"):
                shared.append("".join(t.text or "" for t in si.iter(f"{_NS}t")))
        for _, node in ET.iterparse(io.BytesIO(z.read(_sheet_path(z, sheet)))):
            if node.tag != f"{_NS}c":
                continue
            at = _CELL.fullmatch(node.get("r", ""))
            kind, v = node.get("t", "n"), node.find(f"{_NS}v")
            if kind == "inlineStr":
                text = "".join(t.text or "" for t in node.iter(f"{_NS}t"))
            elif v is None or v.text is None:
                continue
            elif kind == "s":
                text = shared[int(v.text)]
            elif kind == "b":
                text = "TRUE" if v.text == "1" else "FALSE"
            elif kind == "n":
                text = _number(v.text)
            else:
                text = v.text
            if at:
                out.setdefault(int(at[2]) - 1, {})[_column(at[1])] = text
    return out


def rows_of(
    data: bytes,
    sheet: int | str = 0,
    cell_range: str | None = None,
    *,
    trim: bool = False,
    na: str = "NA",
    stop_at_blank: bool = True,
    include_blank: bool = False,
) -> tuple[list[str], list[list[str | None]]]:
    """Header and rows. The header ends at its first empty cell. A blank row ends the table, is kept,
    or is passed over; ``na`` and missing cells are missing."""
    cells = cells_of(data, sheet)
    if not cells:
        return [], []
    if cell_range:
        top, bottom, left, right = _range(cell_range)
    else:
        top, bottom = min(cells), max(cells)
        left, right = min(cells[top]), max(cells[top])
    names = []
    for k in range(left, right + 1):
        name = cells.get(top, {}).get(k, "")
        if not name.strip():
            break
        names.append(name.strip() if trim else name)
    rows = []
    for r in range(top + 1, bottom + 1):
        row: list[str | None] = []
        for k in range(left, left + len(names)):
            v = cells.get(r, {}).get(k)
            v = v.strip() if trim and v is not None else v
            row.append(None if v is None or v == na else v)
        if all(v is None for v in row):
            if stop_at_blank:
                break
            if not include_blank:
                continue
        rows.append(row)
    return numbered_duplicates(names), rows


def read_excel(
    spark: SparkSession,
    path: str,
    sheet: int | str = 0,
    cell_range: str | None = None,
    *,
    types: ColumnTypes | dict | str | None = None,
    trim: bool = False,
    guess: int = GUESS,
    na: str = "NA",
    stop_at_blank: bool = True,
    include_blank: bool = False,
    row_id: bool = False,
) -> DataFrame:
    """A sheet by number or name. Several workbooks under one path must have equal headers."""
    options = {"trim": trim, "na": na, "stop_at_blank": stop_at_blank, "include_blank": include_blank}
    books = spark.read.format("binaryFile").load(path)
    names, _ = rows_of(bytes(books.select("content").first()["content"]), sheet, cell_range, **options)
    if not names:
        raise ValueError("the sheet has no header")
    schema = ", ".join(f"c{i} string" for i in range(len(names))) + ", n long"

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                found, rows = rows_of(content.as_py(), sheet, cell_range, **options)
                if found != names:
                    raise ValueError(f"headers differ: {found} and {names}")
                columns = [pa.array([r[i] for r in rows], pa.string()) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(range(len(rows)), pa.int64())], names=[*(f"c{i}" for i in range(len(names))), "n"])

    df = apply_types(books.select("content").mapInArrow(parse, schema).toDF(*names, ROW_ID), types, names, guess)
    return df if row_id else df.drop(ROW_ID)


# ------------------------------------------------------------ writing

_TYPES = """<?xml version="1.0" encoding="UTF-8" standalone="yes"?>
<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>{sheets}</Types>"""
_SHEET_TYPE = '<Override PartName="/xl/worksheets/sheet{n}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>'
_ROOT = """<?xml version="1.0" encoding="UTF-8" standalone="yes"?>
<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>"""
_STYLES = """<?xml version="1.0" encoding="UTF-8" standalone="yes"?>
<styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><fonts count="2"><font/><font><b/></font></fonts><fills count="1"><fill><patternFill patternType="none"/></fill></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf/><xf fontId="1" applyFont="1"/></cellXfs></styleSheet>"""
_XMLNS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
_BAD = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f]")


def _text_cell(ref: str, text: str, style: str = "") -> str:
    return f'<c r="{ref}" t="inlineStr"{style}><is><t xml:space="preserve">{escape(_BAD.sub("", text))}</t></is></c>'


def _sheet_xml(df: DataFrame, headers: bool, bold: bool) -> bytes:
    out = io.StringIO()
    out.write(f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><worksheet {_XMLNS}><sheetData>')
    at = 1
    if headers:
        cells = "".join(_text_cell(f"{_letters(i)}{at}", n, ' s="1"' if bold else "") for i, n in enumerate(df.columns))
        out.write(f'<row r="{at}">{cells}</row>')
        at += 1
    for row in df.toLocalIterator():  # partition by partition
        cells = []
        for i, v in enumerate(row):
            ref = f"{_letters(i)}{at}"
            if v is None:
                continue
            if isinstance(v, bool):
                cells.append(f'<c r="{ref}" t="b"><v>{int(v)}</v></c>')
            elif isinstance(v, (int, float)) and v == v and abs(v) != float("inf"):
                cells.append(f'<c r="{ref}"><v>{v!r}</v></c>')
            else:
                cells.append(_text_cell(ref, str(v)))
        out.write(f'<row r="{at}">{"".join(cells)}</row>')
        at += 1
    out.write("</sheetData></worksheet>")
    return out.getvalue().encode()


def _known_sheets(book_: bytes) -> dict[str, bytes]:
    out = {}
    with zipfile.ZipFile(io.BytesIO(book_)) as z:
        book = ET.fromstring(z.read("xl/workbook.xml"))
        for s in book.findall(f"{_NS}sheets/{_NS}sheet"):
            out[s.get("name")] = z.read(_sheet_path(z, s.get("name")))
    return out


def write_excel(df: DataFrame, path: str, sheet: str = "Sheet1", *, headers: bool = True, erase_file: bool = False, bold_headers: bool = True) -> None:
    """A sheet of a workbook in any store that Spark knows. The sheet is one file, made on the driver; other sheets that are there stay unless the file is erased. Sheets
    that are carried along keep inline texts only, as this module writes them. Missing values are
    missing cells."""
    spark = df.sparkSession
    sheets = {}
    if not erase_file and exists(spark, path):
        sheets = _known_sheets(bytes(spark.read.format("binaryFile").load(path).select("content").first()["content"]))
    sheets[sheet] = _sheet_xml(df, headers, bold_headers)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", _TYPES.format(sheets="".join(_SHEET_TYPE.format(n=i + 1) for i in range(len(sheets)))))
        z.writestr("_rels/.rels", _ROOT)
        listed = "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i + 1}" r:id="rId{i + 1}"/>' for i, n in enumerate(sheets))
        z.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><workbook {_XMLNS}><sheets>{listed}</sheets></workbook>')
        kind = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/"
        rels = "".join(f'<Relationship Id="rId{i + 1}" Type="{kind}worksheet" Target="worksheets/sheet{i + 1}.xml"/>' for i in range(len(sheets)))
        rels += f'<Relationship Id="rIdStyles" Type="{kind}styles" Target="styles.xml"/>'
        z.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rels}</Relationships>')
        z.writestr("xl/styles.xml", _STYLES)
        for i, xml in enumerate(sheets.values()):
            z.writestr(f"xl/worksheets/sheet{i + 1}.xml", xml)
    put(spark, out.getvalue(), path)
