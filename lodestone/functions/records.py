"""Structured file formats read to ``(kind, text, metadata)`` units, one file at a time."""

from __future__ import annotations

import html
import io
import re
import shutil
import subprocess
import tempfile
import zipfile
from xml.parsers import expat

from lodestone.functions.text import WHITESPACE

Unit = tuple[str, str, dict[str, str]]
CSV_FIELD = re.compile(r'[^\S\n]*(?:"((?:[^"]|"")*)"|([^",\n]*))(,|\n|\Z)')
TAG = re.compile(r"<[^>]+>")


def _row(text: str, **metadata: str) -> Unit:
    return "row", text, metadata


def csv_units(content: bytes) -> list[Unit]:
    records = list(_csv_records(content.decode("utf-8", "replace").replace("\r\n", "\n")))
    if not records:
        return []
    header, rows = records[0], records[1:]
    if any(len(r) != len(header) for r in rows):
        raise ValueError("csv: wrong number of fields")
    lines = ["\t".join(r) for r in rows]
    return [_row(t, headers="\t".join(header), sheet="csv") for t in lines if t.strip(WHITESPACE)]


def _csv_records(text: str):
    at, record = 0, []
    while at < len(text):
        if not record and text[at] == "\n":
            at += 1
            continue
        m = CSV_FIELD.match(text, at)
        if not m:
            raise ValueError(f"csv: malformed quoting at character {at}")
        quoted, bare, stop = m.groups()
        record.append(bare if quoted is None else quoted.replace('""', '"'))
        at = m.end()
        if stop != ",":
            yield record
            record = []
        elif at == len(text):
            record.append("")
    if record:
        yield record


def _scan_xml(content: bytes, start, end, text) -> None:
    parser = expat.ParserCreate()
    parser.buffer_text = True
    parser.StartElementHandler = lambda name, attrs: start(name.rpartition(":")[2], attrs)
    parser.EndElementHandler = lambda name: end(name.rpartition(":")[2])
    parser.CharacterDataHandler = text
    parser.Parse(content, True)


def xml_units(content: bytes) -> list[Unit]:
    """One unit per child of the root; only text below that child is kept."""
    units, path, lines, words = [], [], [], []

    def start(name, _):
        path.append(name)
        words.clear()
        if len(path) == 2:
            lines.clear()

    def end(name):
        if len(path) > 2:
            leaf = "".join(words).strip(WHITESPACE)
            if leaf:
                lines.append(f"{'.'.join(path[2:])}: {leaf}")
            words.clear()
        elif len(path) == 2 and lines:
            units.append(_row("\n".join(lines), element=name))
        path.pop()

    def text(chunk):
        if len(path) > 2:
            words.append(chunk)

    _scan_xml(content, start, end, text)
    return units


def _paragraphs(content: bytes) -> list[str]:
    """Text runs (``t``) joined with blanks, cut at paragraph ends (``p``)."""
    out, words, inside = [], [], [False]

    def start(name, _):
        if name == "t":
            inside[0] = True

    def end(name):
        if name == "t":
            inside[0] = False
            words.append(" ")
        elif name == "p":
            out.append("".join(words).strip(WHITESPACE))
            words.clear()

    _scan_xml(content, start, end, lambda chunk: inside[0] and words.append(chunk))
    return [p for p in out if p]


def _members(archive: zipfile.ZipFile, prefix: str) -> list[str]:
    return sorted(n for n in archive.namelist() if n.startswith(prefix) and n.endswith(".xml"))


def docx_units(content: bytes) -> list[Unit]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return [("paragraph", p, {}) for p in _paragraphs(z.read("word/document.xml"))]


def pptx_units(content: bytes) -> list[Unit]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        slides = ["\n".join(_paragraphs(z.read(n))) for n in _members(z, "ppt/slides/slide")]
    return [("slide", text, {"slide": str(n)}) for n, text in enumerate(slides, 1) if text]


def xlsx_units(content: bytes) -> list[Unit]:
    units: list[Unit] = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = [s for row in _cells(z.read("xl/sharedStrings.xml"), "sst", "si", {"t"}, []) for s in row]
        for member in _members(z, "xl/worksheets/sheet"):
            try:
                rows = _cells(z.read(member), "row", "c", {"v", "t"}, shared)
            except expat.ExpatError:
                continue
            sheet = member.removeprefix("xl/worksheets/").removesuffix(".xml")
            for row in rows[1:]:
                units.append(_row("\t".join(row), headers="\t".join(rows[0]), sheet=sheet))
    return units


def _cells(content: bytes, row_tag: str, cell_tag: str, text_tags: set[str], shared: list[str]) -> list[list[str]]:
    """Cell texts by row; a cell typed ``s`` is an index into ``shared``."""
    rows, cells, words, state = [], [], [], {"inside": False, "type": None}

    def start(name, attrs):
        if name == row_tag:
            cells.clear()
        elif name == cell_tag:
            words.clear()
            state["type"] = attrs.get("t")
        elif name in text_tags:
            state["inside"] = True

    def end(name):
        if name in text_tags:
            state["inside"] = False
        elif name == cell_tag:
            value = "".join(words)
            if state["type"] == "s" and shared:
                at = int(value) if value.strip().isdigit() else 0
                value = shared[at] if at < len(shared) else value
            cells.append(value)
        elif name == row_tag and cells:
            rows.append(list(cells))

    _scan_xml(content, start, end, lambda chunk: state["inside"] and words.append(chunk))
    return rows


def pdf_units(content: bytes) -> list[Unit]:
    """Paragraphs of a PDF, or of ``pdftohtml`` output that was made beforehand."""
    markup = _pdftohtml(content) if content.startswith(b"%PDF") else content
    lines = [
        html.unescape(TAG.sub("", line)).replace("\n", " ").strip(WHITESPACE)
        for line in markup.decode("utf-8", "replace").split("<br/>")
    ]
    paragraphs = re.split(r"\n{2,}", "\n".join(lines).strip("\n"))
    return [("paragraph", p.replace("\n", " "), {}) for p in paragraphs if p]


def _pdftohtml(content: bytes) -> bytes:
    tool = shutil.which("pdftohtml")
    if tool is None:
        raise RuntimeError("pdftohtml is not installed on this executor")
    with tempfile.NamedTemporaryFile(suffix=".pdf") as f:
        f.write(content)
        f.flush()
        return subprocess.run([tool, "-stdout", "-noframes", "-i", "-q", f.name], check=True, capture_output=True).stdout


READERS = {
    "text/csv": csv_units,
    "application/xml": xml_units,
    "text/xml": xml_units,
    "application/pdf": pdf_units,
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": docx_units,
    "application/vnd.openxmlformats-officedocument.presentationml.presentation": pptx_units,
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": xlsx_units,
}
# Formats whose first unit's first line names the document.
TITLED = {"application/pdf", *(m for m in READERS if m.endswith(("document", "presentation")))}


def document_title(mime: str, units: list[Unit]) -> str | None:
    if mime in TITLED and units:
        return units[0][1].split("\n", 1)[0] if mime.endswith("presentation") else units[0][1]
    return None
