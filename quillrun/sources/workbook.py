"""Workbooks (.xlsx) as a data source, format "workbook": one or more files for each task that writes, rows
in the first sheet under a header. Files are reached through Arrow's file systems, so a path may be any
that all executors and the driver reach; where the driver doesn't see a task's files the commit fails.
Reading gives every cell as a string.

Whole values: characters that XML forbids are written as _xHHHH_, and a text that looks so by itself has its
underscore written so. What a text has beyond the 32,767 UTF-16 units of a cell stands on a second sheet, with
its row and column. Numbers that a cell can't hold (NaN, infinite, over 15 digits) are written as text.
Files are cut at ``rows_each`` rows and at ``UNITS_EACH`` of text, so a task's memory is bounded.
"""

from __future__ import annotations

import io
import math
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StringType, StructField, StructType

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
#: What a sheet and a cell hold at most, by the format.
MOST_ROWS, MOST_COLUMNS, CELL = 1_048_576, 16_384, 32_767
#: Characters of text after which a file is closed; a task holds them several times over, as texts, XML and bytes.
UNITS_EACH = 1 << 22
#: The second sheet's name.
LONGER = "Longer"
#: Characters that XML 1.0 forbids, with the carriage return, which its readers change; texts that look like a code; codes.
NOT_IN_XML = r"\x00-\x08\x0b-\x1f\ufffe\uffff\ud800-\udfff"
FORBIDDEN = re.compile(f"[{NOT_IN_XML}]")
LOOKS_SO, CODED = re.compile(f"_(?=x[0-9A-Fa-f]{{4}}[_{NOT_IN_XML}])"), re.compile("_x([0-9A-Fa-f]{4})_")


def _reached(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:/") else (fs.LocalFileSystem(), path)


def _held(text: str) -> str:
    """The text as a cell holds it."""
    return FORBIDDEN.sub(lambda m: f"_x{ord(m[0]):04X}_", LOOKS_SO.sub("_x005F_", text))


def _said(text: str) -> str:
    return CODED.sub(lambda m: chr(int(m[1], 16)), text)


def _parts(text: str) -> list[str]:
    """The text in pieces that fit a cell as written: no code is cut in two, and characters beyond
    the first plane count twice."""
    held, out, at = _held(text), [], 0
    if len(held) <= CELL // 2:
        return [held]
    while at < len(held):
        end, left = at, CELL
        while end < len(held):
            code = CODED.match(held, end)
            size = 7 if code else 1 + (held[end] > "\uffff")
            if size > left:
                break
            left, end = left - size, end + (7 if code else 1)
        out.append(held[at:end])
        at = end
    return out


def _number(v) -> bool:
    if isinstance(v, bool) or not isinstance(v, (int, float)):
        return False
    return abs(v) < 10**15 if isinstance(v, int) else math.isfinite(v)


def _text_cell(held: str) -> str:
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(held)}</t></is></c>'


def _sheet_xml(body: str) -> str:
    return f'<worksheet xmlns="{MAIN[1:-1]}"><sheetData>{body}</sheetData></worksheet>'


def sheet(header: list[str], rows: list[tuple]) -> bytes:
    """A workbook of the rows under a header, with a second sheet (row, column, text) for what is too long for its cell."""
    if len(rows) >= MOST_ROWS or len(header) > MOST_COLUMNS:
        raise ValueError(f"a sheet holds {MOST_ROWS - 1} rows and {MOST_COLUMNS} columns at most, not {len(rows)} and {len(header)}")
    longer: list[str] = []

    def cell(v, row: int, column: int) -> str:
        if v is None:
            return "<c/>"
        if _number(v):
            return f"<c><v>{v}</v></c>"
        first, *rest = _parts(str(v))
        longer.extend(f"<row><c><v>{row}</v></c><c><v>{column}</v></c>{_text_cell(part)}</row>" for part in rest)
        return _text_cell(first)

    body = "".join(f"<row>{''.join(cell(v, i, j) for j, v in enumerate(r))}</row>" for i, r in enumerate([tuple(header), *rows]))
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package, types = "http://schemas.openxmlformats.org/package/2006/relationships", "http://schemas.openxmlformats.org/package/2006/content-types"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml."
    sheets = {"Sheet1": body} | ({LONGER: "".join(longer)} if longer else {})
    parts = "".join(f'<Override PartName="/xl/worksheets/sheet{n}.xml" ContentType="{kind}worksheet+xml"/>' for n, _ in enumerate(sheets, 1))
    names = "".join(f'<sheet name="{name}" sheetId="{n}" r:id="r{n}"/>' for n, name in enumerate(sheets, 1))
    links = "".join(f'<Relationship Id="r{n}" Type="{rel}/worksheet" Target="worksheets/sheet{n}.xml"/>' for n, _ in enumerate(sheets, 1))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(
            "[Content_Types].xml",
            f'<Types xmlns="{types}"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
            f'<Override PartName="/xl/workbook.xml" ContentType="{kind}sheet.main+xml"/>{parts}</Types>',
        )
        z.writestr("_rels/.rels", f'<Relationships xmlns="{package}"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN[1:-1]}" xmlns:r="{rel}"><sheets>{names}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}">{links}</Relationships>')
        for n, rows_xml in enumerate(sheets.values(), 1):
            z.writestr(f"xl/worksheets/sheet{n}.xml", _sheet_xml(rows_xml))
    return out.getvalue()


def _cells(z: zipfile.ZipFile, n: int) -> Iterator[list[str | None]]:
    with z.open(f"xl/worksheets/sheet{n}.xml") as xml:
        for _, e in ElementTree.iterparse(xml):
            if e.tag == f"{MAIN}row":
                yield ["".join(c.itertext()) if len(c) else None for c in e]
                e.clear()


def rows_of(content: bytes) -> Iterator[list[str | None]]:
    """The rows of a workbook's first sheet, as sheet() makes them: cells in order, strings inline."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        longer: dict[tuple[int, int], list[str]] = {}
        if "xl/worksheets/sheet2.xml" in z.namelist():
            for row, column, text in _cells(z, 2):
                longer.setdefault((int(row), int(column)), []).append(text or "")
        for i, row in enumerate(_cells(z, 1)):
            yield [v if v is None else _said("".join([v, *longer.get((i, j), ())])) for j, v in enumerate(row)]


@dataclass
class Written(WriterCommitMessage):
    files: tuple[str, ...]


class Writer(DataSourceWriter):
    def __init__(self, path: str, names: list[str], rows_each: int):
        if not 0 < rows_each < MOST_ROWS:
            raise ValueError(f"rows_each must be from 1 to {MOST_ROWS - 1}, not {rows_each}")
        self.path, self.names, self.rows_each, self.job = path, names, rows_each, uuid.uuid4().hex

    def write(self, iterator) -> Written:
        system, base = _reached(self.path)
        system.create_dir(base, recursive=True)
        held: list[tuple] = []
        done: list[str] = []
        units = 0

        def flush() -> None:
            name = f"{base}/.{self.job}-{uuid.uuid4().hex}.part"  # readers see a file only when the job is committed
            with system.open_output_stream(name) as out:
                out.write(sheet(self.names, held))
            done.append(name)
            held.clear()

        for row in iterator:
            held.append(tuple(row))
            units += sum(len(v) for v in held[-1] if isinstance(v, str))
            if len(held) >= self.rows_each or units >= UNITS_EACH:
                flush()
                units = 0
        if held:
            flush()
        return Written(tuple(done))

    def commit(self, messages) -> None:
        system, _ = _reached(self.path)
        for name in (f for m in messages if m for f in m.files):
            folder, _, own = name.rpartition("/")
            system.move(name, f"{folder}/part-{own[1:-5]}.xlsx")
        self._sweep()

    def abort(self, messages) -> None:
        self._sweep()

    def _sweep(self) -> None:
        """Deletes what lost tasks of this job have left."""
        from pyarrow import fs

        system, base = _reached(self.path)
        for i in system.get_file_info(fs.FileSelector(base, allow_not_found=True)):
            if i.base_name.startswith(f".{self.job}-"):
                system.delete_file(i.path)


class Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(f) for f in _files(self.path)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        system, _ = _reached(self.path)
        with system.open_input_stream(partition.value) as f:
            rows = rows_of(f.read())
        next(rows, None)
        yield from map(tuple, rows)


def _files(path: str) -> list[str]:
    from pyarrow import fs

    system, base = _reached(path)
    return sorted(i.path for i in system.get_file_info(fs.FileSelector(base)) if i.path.endswith(".xlsx"))


class Workbook(DataSource):
    """Options: path; rows_each, the rows of a file at most."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> StructType:
        files = _files(self.options["path"])
        if not files:
            raise ValueError(f"no workbook in {self.options['path']}")
        system, _ = _reached(self.options["path"])
        with system.open_input_stream(files[0]) as f:
            header = next(rows_of(f.read()), [])
        return StructType([StructField(c or "", StringType()) for c in header])

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        if overwrite:
            raise ValueError("workbooks are appended; write to a new folder")
        return Writer(self.options["path"], schema.fieldNames(), int(self.options.get("rows_each", 100_000)))


def export_workbooks(df, path: str, rows_each: int = 100_000) -> None:
    """df as workbooks in a folder: numbers and strings as they are, other types as strings."""
    SparkSession.getActiveSession().dataSource.register(Workbook)
    flat = df.select(*(df[c] if t in ("bigint", "int", "double", "string") else df[c].cast("string").alias(c) for c, t in df.dtypes))
    flat.write.format("workbook").option("rows_each", rows_each).mode("append").save(path)


def read_workbooks(spark: SparkSession, path: str):
    spark.dataSource.register(Workbook)
    return spark.read.format("workbook").load(path)
