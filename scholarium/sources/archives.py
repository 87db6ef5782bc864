"""Delimited text and spreadsheets inside ZIP archives, read by members.

An archive comes as one row of Spark's ``binaryFile`` source, so any store that
Spark reads will do.  A first task per archive reads its central directory and
sends each chosen member's *compressed* bytes on; after a shuffle by member, a
task per member inflates it as a stream, so archives with many members are read
by as many tasks, and no member's text is held whole.
"""

from __future__ import annotations

import codecs
import csv
import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarium.sources.files import clean_cell, strip_bom

#: Rows of a batch that a member's task gives out.
BATCH_ROWS = 2000


def chosen_members(names: list[str], prefer: str = "all_csv_v1", suffix: str = ".txt") -> list[str]:
    """The first member with ``prefer`` in its name, else the first of the kind; none if there is none."""
    of_kind = [n for n in names if n.lower().endswith(suffix)]
    return ([n for n in of_kind if prefer in n.lower()] or of_kind)[:1]


def _directory(prefer: str | None, suffix: str, with_data: bool):
    """(file, member, status, method, size, data) of the members to read; an archive that can't be read gives one row that says why."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file", "member", "status", "method", "size", "data"]
        types = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.binary()]
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                file, rows, raw = path.rsplit("/", 1)[-1], [], content.as_buffer()
                try:
                    with zipfile.ZipFile(pa.BufferReader(raw)) as z:
                        of_kind = [n for n in z.namelist() if n.lower().endswith(suffix)]
                        for name in chosen_members(of_kind, prefer, suffix) if prefer is not None else of_kind:
                            info = z.getinfo(name)
                            at = info.header_offset
                            start = at + 30 + int.from_bytes(raw[at + 26 : at + 28].to_pybytes(), "little") + int.from_bytes(raw[at + 28 : at + 30].to_pybytes(), "little")
                            status = "encrypted" if info.flag_bits & 1 else "ok" if info.compress_type in (0, 8) else f"compression method {info.compress_type}"
                            data = raw[start : start + info.compress_size].to_pybytes() if with_data and status == "ok" else None
                            rows.append((file, name, status, info.compress_type, info.file_size, data))
                    if not rows:
                        rows.append((file, None, f"no {suffix} member", None, None, None))
                except (zipfile.BadZipFile, EOFError) as e:
                    rows.append((file, None, f"not an archive: {e}", None, None, None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return run


_MEMBER = "file string, member string, status string, method int, size long, data binary"


def _archives(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def zip_members(spark: SparkSession, path: str | list[str], prefer: str | None = None, suffix: str = ".txt") -> DataFrame:
    """(file, member, status, size) of what would be read; ``prefer`` None lists all members of the kind."""
    return _archives(spark, path).mapInArrow(_directory(prefer, suffix, False), _MEMBER).select("file", "member", "status", "size")


def _lines(data: bytes, method: int, encoding: str, step: int = 1 << 20) -> Iterator[str]:
    """A member's lines with their ends, inflated ``step`` bytes at a time."""
    inflater = zlib.decompressobj(-15) if method == 8 else None

    def pieces() -> Iterator[bytes]:
        for at in range(0, len(data), step):
            piece = data[at : at + step]
            if inflater is None:
                yield piece
                continue
            while piece:
                yield inflater.decompress(piece, step)
                piece = inflater.unconsumed_tail
        if inflater is not None:
            yield inflater.flush()

    decoder, rest = codecs.getincrementaldecoder(encoding)(), ""
    for piece in pieces():
        *whole, rest = (rest + decoder.decode(piece)).split("\n")
        for line in whole:
            yield line + "\n"
    rest += decoder.decode(b"", final=True)
    if rest:
        yield rest


def _cells(sep: str, encoding: str, head: bool):
    """(file, member, row, cells): with ``head`` only the first row of each member, else all others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = ["file", "member", "row", "cells"], [pa.string(), pa.string(), pa.int64(), pa.list_(pa.string())]
        for batch in batches:
            for file, member, method, data in zip(*(batch.column(c).to_pylist() for c in ("file", "member", "method", "data")), strict=True):
                rows: list[tuple] = []
                for number, cells in enumerate(csv.reader(_lines(data, method, encoding), delimiter=sep)):
                    if (number == 0) != head:
                        if head:
                            break
                        continue
                    if cells:  # the csv module gives no cells for an empty line
                        rows.append((file, member, number, cells))
                    if len(rows) == BATCH_ROWS:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return run


_ROW = "file string, member string, row long, cells array<string>"


def by_header(rows: DataFrame, headers: list[tuple[tuple[str, str], list[str]]]) -> DataFrame:
    """Rows of (file, member, cells) as one table with all columns in first-seen order; a file's cells follow its own header.

    Headers come as ((file, member), names).  One projection per shape of
    header, not per file; cells beyond the header are dropped, missing ones null.
    """
    shapes: dict[tuple[str, ...], list[tuple[str, str]]] = {}
    for where, names in headers:
        shapes.setdefault(tuple(names), []).append(where)
    columns = list(dict.fromkeys(n for names in shapes for n in names if n))
    if len({c.lower() for c in columns} & {"_source_file"}):
        raise ValueError("a file has a column _source_file")
    shape = F.create_map(*[F.lit(x) for i, places in enumerate(shapes.values()) for file, member in places for x in (f"{file}\n{member}", i)]) if shapes else F.lit(None).cast("map<string,int>")
    rows = rows.withColumn("_shape", F.try_element_at(shape, F.concat("file", F.lit("\n"), "member")))
    places = [{n: i for i, n in reversed(list(enumerate(names)))} for names in shapes]
    pick = lambda c: F.coalesce(*[F.when(F.col("_shape") == i, F.try_element_at("cells", F.lit(at[c] + 1))) for i, at in enumerate(places) if c in at])
    return rows.select(*[clean_cell(pick(c)).alias(c) for c in columns], F.col("file").alias("_source_file"))


def read_zip(spark: SparkSession, path: str | list[str], sep: str = "^", encoding: str = "ISO-8859-1", prefer: str = "all_csv_v1", suffix: str = ".txt") -> DataFrame:
    """The preferred member of each archive as text columns, headers repaired and united, and ``_source_file``.

    Archives that can't be read, and members that are encrypted or packed by
    another method, give no rows; ``zip_members`` says why.  Quoted cells may
    hold separators and line breaks.
    """
    members = _archives(spark, path).mapInArrow(_directory(prefer, suffix, True), _MEMBER).where("status = 'ok'")
    members = members.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file", "member").select("file", "member", "method", "data")
    heads = members.mapInArrow(_cells(sep, encoding, True), _ROW).select("file", "member", "cells").collect()  # a row an archive
    headers = [((r["file"], r["member"]), [strip_bom(c) if i == 0 else c for i, c in enumerate(r["cells"])]) for r in sorted(heads)]
    return by_header(members.mapInArrow(_cells(sep, encoding, False), _ROW), headers)


# Spreadsheets

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: A header row is among the first rows and has at least so many filled cells.
HEADER_ROWS, HEADER_CELLS = 5, 3


def _text(node) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_MAIN}t"))


def _sheet_rows(z: zipfile.ZipFile, sheet: str | None) -> Iterator[list[str | None]]:
    """Rows of cells of the first sheet whose name holds ``sheet``, else of the last one; numbers as they are written."""
    book = ElementTree.fromstring(z.read("xl/workbook.xml"))
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    sheets = [(s.get("name"), targets[s.get(_REL)]) for s in book.iter(f"{_MAIN}sheet")]
    target = next((t for n, t in sheets if sheet and sheet.lower() in n.lower()), sheets[-1][1])
    shared = [_text(si) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []
    with z.open(target.lstrip("/") if target.startswith("/") else f"xl/{target}") as f:
        for _, row in ElementTree.iterparse(f):
            if row.tag != f"{_MAIN}row":
                continue
            cells: list[str | None] = []
            for c in row.iter(f"{_MAIN}c"):
                at = len(cells)
                if letters := re.match("[A-Z]+", c.get("r") or ""):
                    at = 0
                    for letter in letters[0]:
                        at = at * 26 + ord(letter) - 64
                    at -= 1
                cells += [None] * (at - len(cells))
                value = c.find(f"{_MAIN}v")
                kind = c.get("t")
                text = _text(c) if kind == "inlineStr" else None if value is None else shared[int(value.text)] if kind == "s" else value.text
                cells.append(text if text != "" else None)
            yield cells
            row.clear()


def _workbook(sheet: str | None, head: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = ["file", "member", "row", "cells"], [pa.string(), pa.string(), pa.int64(), pa.list_(pa.string())]
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                file, out, header = path.rsplit("/", 1)[-1], [], None
                try:
                    with zipfile.ZipFile(pa.BufferReader(content.as_buffer())) as z:
                        for number, cells in enumerate(_sheet_rows(z, sheet)):
                            if header is None:
                                if sum(c is not None for c in cells) >= HEADER_CELLS:
                                    header = [strip_bom(c) if c is not None else f"col_{i}" for i, c in enumerate(cells)]
                                    if head:
                                        out.append((file, "", number, header))
                                        break
                                elif number + 1 >= HEADER_ROWS:
                                    break
                            elif any(c is not None for c in cells):
                                out.append((file, "", number, cells))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    continue  # no workbook
                for at in range(0, len(out), BATCH_ROWS):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[at : at + BATCH_ROWS], strict=True), types, strict=True)], names)

    return run


def read_workbooks(spark: SparkSession, path: str | list[str], sheet: str | None = None) -> DataFrame:
    """One sheet of each XLSX workbook as text columns: the first whose name holds ``sheet``, else the last.

    Title rows above the header are skipped: the header is the first of the
    first five rows with three filled cells; a workbook without one gives no
    rows.  Workbooks are small and read whole, a task each.
    """
    books = _archives(spark, path)
    heads = books.mapInArrow(_workbook(sheet, True), _ROW).select("file", "member", "cells").collect()
    return by_header(books.mapInArrow(_workbook(sheet, False), _ROW), [((r["file"], r["member"]), r["cells"]) for r in sorted(heads)])
