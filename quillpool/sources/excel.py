"""Excel workbooks (.xlsx): zipped XML, read in one task a file and written from small tables, without an engine.

Numbers become BIGINT where all of a column's are whole, else DOUBLE; truth values BOOLEAN; a column of several kinds, and
any other, STRING. Empty cells and errors are null, and rows without any value are left out. Dates are the numbers that
the file holds. The first row names the columns; cells without a name above them are left out.
"""

from __future__ import annotations

import io
import json
import re
from collections.abc import Iterator
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape
from zipfile import ZIP_DEFLATED, ZipFile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

# fixed values: the format's names
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
LINKS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
MOST_ROWS = 1_048_576
LIST = "committed.json"  # in a folder: the names of the workbooks that count


def _texts(node: ET.Element) -> str:
    """The text of a string item, without its phonetic runs."""
    runs = [node] if node.find(f"{{{MAIN}}}t") is not None else node.findall(f"{{{MAIN}}}r")
    return "".join(t.text or "" for r in runs for t in r.findall(f"{{{MAIN}}}t"))


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def _value(cell: ET.Element, shared: list[str]):
    kind, v = cell.get("t", "n"), cell.find(f"{{{MAIN}}}v")
    if kind == "inlineStr":
        return _texts(cell.find(f"{{{MAIN}}}is"))
    if v is None or v.text is None or kind == "e":
        return None
    if kind == "s":
        return shared[int(v.text)]
    if kind == "b":
        return v.text == "1"
    if kind != "n":
        return v.text
    x = float(v.text)
    return int(x) if x.is_integer() and abs(x) < 1 << 53 else x


def sheet_rows(data: bytes, sheet: int | str = 0) -> Iterator[dict[int, object]]:
    """Each row's values by column."""
    book = ZipFile(io.BytesIO(data))
    names = [(s.get("name"), s.get(f"{{{LINKS}}}id")) for s in ET.fromstring(book.read("xl/workbook.xml")).iter(f"{{{MAIN}}}sheet")]
    found = [i for k, (n, i) in enumerate(names) if sheet in (k, n)]
    if not found:
        raise ValueError(f"no sheet {sheet!r}; the workbook has {[n for n, _ in names]}")
    target = next(r.get("Target") for r in ET.fromstring(book.read("xl/_rels/workbook.xml.rels")) if r.get("Id") == found[0])
    shared = []
    if "xl/sharedStrings.xml" in book.namelist():
        shared = [_texts(x) for x in ET.fromstring(book.read("xl/sharedStrings.xml")).findall(f"{{{MAIN}}}si")]
    with book.open(target.lstrip("/") if target.startswith("/") else f"xl/{target}") as part:
        for _, node in ET.iterparse(part):
            if node.tag == f"{{{MAIN}}}row":
                row = {_column(c.get("r")) if c.get("r") else k: _value(c, shared) for k, c in enumerate(node.findall(f"{{{MAIN}}}c"))}
                yield row
                node.clear()


def _table(data: bytes, sheet: int | str) -> tuple[dict[int, str], Iterator[dict[int, object]]]:
    rows = sheet_rows(data, sheet)
    header = next(rows, {})
    return {k: str(v) for k, v in header.items() if v is not None}, (r for r in rows if any(v is not None for v in r.values()))


def read_excel(spark: SparkSession, path: str, sheet: int | str = 0) -> DataFrame:
    """A sheet, by its place or name, of a workbook, or of all in a folder; columns meet by name, and are null where a workbook has none."""
    where: str | list[str] = path
    listed = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{LIST}")
    if listed.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(listed):
        where = [f"{path}/{name}" for name in json.loads(spark.read.option("wholetext", True).text(f"{path}/{LIST}").first().value)]
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[xX][lL][sS][xX]").load(where).select("content")

    def kinds(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for data in frame["content"]:
                header, rows = _table(data, sheet)
                seen = {k: set() for k in header}
                for r in rows:
                    for k, v in r.items():
                        if v is not None and k in seen:
                            seen[k].add(type(v).__name__)
                yield pd.DataFrame([(k, name, kind) for k, name in header.items() for kind in seen[k] or [None]], columns=["place", "name", "kind"])

    found: dict[str, tuple[int, set]] = {}
    for r in files.mapInPandas(kinds, "place int, name string, kind string").distinct().collect():  # a few rows for each column
        place, seen = found.get(r.name, (r.place, set()))
        found[r.name] = (min(place, r.place), seen | ({r.kind} - {None}))
    spark_kind = lambda s: "BIGINT" if s == {"int"} else "DOUBLE" if s and s <= {"int", "float"} else "BOOLEAN" if s == {"bool"} else "STRING"
    columns = [(name, spark_kind(s)) for name, (_, s) in sorted(found.items(), key=lambda x: (x[1][0], x[0]))]

    def values(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for data in frame["content"]:
                header, rows = _table(data, sheet)
                at = {name: k for k, name in sorted(header.items(), reverse=True)}
                held = []
                for r in rows:
                    held.append([r.get(at[n]) if n in at else None for n, _ in columns])
                    if len(held) == 10_000:
                        yield _frame(held, columns)
                        held = []
                if held:
                    yield _frame(held, columns)

    quoted = lambda name: "`" + name.replace("`", "``") + "`"
    return files.mapInPandas(values, ", ".join(f"{quoted(n)} {k}" for n, k in columns))


def _frame(rows: list[list], columns: list[tuple[str, str]]) -> pd.DataFrame:
    cast = {"STRING": str, "DOUBLE": float, "BIGINT": int, "BOOLEAN": bool}
    kinds = {"STRING": object, "DOUBLE": "Float64", "BIGINT": "Int64", "BOOLEAN": "boolean"}
    data = {k: pd.Series([None if r[k] is None else cast[kind](r[k]) for r in rows], dtype=kinds[kind]) for k, (_, kind) in enumerate(columns)}
    out = pd.DataFrame(data)
    out.columns = [n for n, _ in columns]
    return out


def _cell(value) -> str:
    if value is None or value != value:
        return "<c/>"
    if isinstance(value, bool):
        return f'<c t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)) and abs(value) != float("inf"):
        return f"<c><v>{value!r}</v></c>"
    text = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(value))
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


def workbook(columns: list[str], rows: list, sheet: str = "Sheet1") -> bytes:
    xml = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    lines = "".join(f"<row>{''.join(map(_cell, r))}</row>" for r in [columns, *rows])
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    parts = {
        "[Content_Types].xml": f'{xml}<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/></Types>',
        "_rels/.rels": f'{xml}<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="r1" Type="{LINKS}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'{xml}<workbook xmlns="{MAIN}" xmlns:r="{LINKS}"><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'{xml}<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="r1" Type="{LINKS}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'{xml}<worksheet xmlns="{MAIN}"><sheetData>{lines}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with ZipFile(out, "w", ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def write_excel(df: DataFrame, path: str, sheet: str = "Sheet1") -> None:
    """A table as one workbook, such as a history; more rows than a sheet holds are an error."""
    rows = df.limit(MOST_ROWS).collect()
    if len(rows) >= MOST_ROWS:
        raise ValueError(f"a sheet holds {MOST_ROWS - 1} rows")
    spark = df.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(workbook(df.columns, [tuple(r) for r in rows], sheet)))
    finally:
        out.close()
