"""Text of DOCX, PPTX and XLSX files: zipped XML, read with the standard library.

One small function per file, applied by `mapInArrow` to Spark's binary files. Paragraphs, and cells of a table row, become
lines. Files that can't be read, for whatever reason, give an error in their row, not a failed job.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa

#: Of each type: the list of its parts and the entries in it, in the order in which they are shown; and parts that follow, by number.
LISTS = {"pptx": ("ppt/presentation.xml", "sldId"), "xlsx": ("xl/workbook.xml", "sheet")}
PARTS = {
    "docx": (r"word/document\.xml",),
    "pptx": (r"ppt/slides/slide(\d+)\.xml", r"ppt/notesSlides/notesSlide(\d+)\.xml"),
    "xlsx": (r"xl/worksheets/sheet(\d+)\.xml",),
}
#: Bytes of one unpacked part at most: a larger one is an error, so that a small file can't fill the memory.
PART_BYTES = 256 << 20
#: Columns of a sheet, by the format.
COLUMNS = 16384
#: Elements whose contents aren't text of the paragraph: properties, phonetic guides, what a field is computed from.
_SKIPPED = {"pPr", "rPr", "rPh", "rt", "instrText", "delText", "sectPr", "tblPr", "tcPr", "trPr"}
_MARKS = {"tab": "\t", "br": "\n", "cr": "\n", "noBreakHyphen": "-"}


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _part(archive: zipfile.ZipFile, name: str) -> ElementTree.Element:
    info = archive.getinfo(name)
    if info.file_size > PART_BYTES:
        raise ValueError(f"{name} is too large")
    raw = archive.read(info)
    if b"<!DOCTYPE" in raw[:4096] or b"<!ENTITY" in raw:
        raise ValueError(f"{name} declares entities")
    return ElementTree.fromstring(raw)


def _ordered(archive: zipfile.ZipFile, kind: str) -> list[str]:
    """The names of all parts with text, in the order in which the file shows them; by their numbers where it doesn't say."""
    names = set(archive.namelist())
    listed: list[str] = []
    place, entry = LISTS.get(kind, ("", ""))
    links = posixpath.join(posixpath.dirname(place), "_rels", posixpath.basename(place) + ".rels")
    if place in names and links in names:
        targets = {r.get("Id"): r.get("Target", "") for r in _part(archive, links)}
        for x in _part(archive, place).iter():
            key = next((v for k, v in x.attrib.items() if k.startswith("{") and _local(k) == "id"), None)
            if _local(x.tag) == entry and key in targets:
                # A target is relative to its list's folder, or begins at the archive's root.
                listed.append(posixpath.normpath(posixpath.join("/" + posixpath.dirname(place), targets[key])).lstrip("/"))
    for pattern in PARTS[kind]:
        found = [(int(m[1]) if m.groups() else 0, n) for n in names if (m := re.fullmatch(pattern, n))]
        listed += [n for _, n in sorted(found)]
    return list(dict.fromkeys(n for n in listed if n in names))


def _children(element: ElementTree.Element) -> Iterator[ElementTree.Element]:
    """Children that count: of alternatives for one content only the first."""
    for x in element:
        if _local(x.tag) == "AlternateContent":
            yield from _children(next(iter(x), x))
        elif _local(x.tag) not in _SKIPPED:
            yield x


def _paragraphs(element: ElementTree.Element) -> list[str]:
    """Paragraphs in order; those inside another, as in a text box, follow it."""
    out = []
    for x in _children(element):
        if _local(x.tag) == "p":
            text, inside = _runs(x)
            out += [text, *(line for y in inside for line in _paragraphs(y))]
        else:
            out += _paragraphs(x)
    return out


def _runs(element: ElementTree.Element) -> tuple[str, list[ElementTree.Element]]:
    """A paragraph's own text, and the elements in it that hold paragraphs of their own."""
    text, inside = [], []
    for x in _children(element):
        tag = _local(x.tag)
        if tag in ("txbxContent", "txBody"):
            inside.append(x)
        elif tag == "t":
            text.append(x.text or "")
        elif tag in _MARKS:
            text.append(_MARKS[tag])
        else:
            own, more = _runs(x)
            text.append(own)
            inside += more
    return "".join(text), inside


def _column(cell: ElementTree.Element, following: int) -> int:
    """A cell's column, from 0, by its reference; without one the next."""
    letters = re.match("[A-Z]+", cell.get("r", ""))
    if not letters:
        return following
    n = 0
    for c in letters[0][:4]:
        n = 26 * n + ord(c) - 64
    if n > COLUMNS:
        raise ValueError("column beyond the last")
    return n - 1


def _rows(root: ElementTree.Element, shared: list[str]) -> list[str]:
    """Rows with cells, tabs between columns; empty cells before a row's last one keep their columns."""

    def value(cell: ElementTree.Element) -> str:
        kind = cell.get("t")
        if kind == "inlineStr":
            return _runs(cell)[0]
        text = next((x.text or "" for x in cell if _local(x.tag) == "v"), "")
        if kind == "b":
            return {"1": "TRUE", "0": "FALSE"}.get(text, text)
        return shared[int(text)] if kind == "s" and text else text

    out = []
    for row in (x for x in root.iter() if _local(x.tag) == "row"):
        cells: list[str] = []
        for cell in (c for c in row if _local(c.tag) == "c"):
            at = _column(cell, len(cells))
            cells += [""] * (at - len(cells))
            cells.append(value(cell))
        out.append("\t".join(cells))
    return out


def office_text(content: bytes, kind: str) -> str:
    """All text of the file, in order."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        shared = []
        if kind == "xlsx" and "xl/sharedStrings.xml" in archive.namelist():
            shared = [_runs(si)[0] for si in _part(archive, "xl/sharedStrings.xml") if _local(si.tag) == "si"]
        lines = []
        for name in _ordered(archive, kind):
            root = _part(archive, name)
            lines += _rows(root, shared) if kind == "xlsx" else _paragraphs(root)
        return "\n".join(lines)


def office_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, filename, size, kind, content) -> (path, filename, size, text, error), one file at a time."""
    for batch in batches:
        for k in range(len(batch)):
            try:
                text, error = office_text(batch.column(4)[k].as_py(), batch.column(3)[k].as_py()), None
                pa.array([text], pa.string())
            except Exception as e:  # noqa: BLE001 - whatever a damaged file makes a reader raise is that file's error
                text, error = None, f"unreadable: {type(e).__name__}"
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(j).slice(k, 1) for j in range(3)), pa.array([text], pa.string()), pa.array([error], pa.string())],
                ["path", "filename", "size", "text", "error"],
            )
