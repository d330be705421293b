"""Readers of single carriers: bytes to text records, child objects and warnings.

All formats are read with the standard library (and PyYAML). Kinds whose
decoder isn't installed yield their carved strings as ``<kind>-fallback``.
"""

from __future__ import annotations

import csv
import gettext
import gzip
import html
import io
import json
import os
import re
import sqlite3
import tempfile
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from html.entities import html5
from html.parser import HTMLParser
from xml.etree import ElementTree

from ..config import Limits
from ..functions.encoding import infer
from .detect import member, tar_of, zip_of

# --- fixed values: archive kinds, kinds whose readers give objects, places of embedded files, runs that count as strings ---
ARCHIVES = ("zip", "tar", "gzip", "7z", "rar", "rpm", "iso", "jar", "apk")
HOLDERS = frozenset({"zip", "jar", "apk", "tar", "gzip", "docx", "xlsx", "pptx", "odf", "epub"})
EMBEDS = ("media/", "embeddings/", "pictures/", "objectreplacements/")
CARVED = ((re.compile(rb"[\x20-\x7e]{6,}"), "ascii", "ascii", 0.8), (re.compile(rb"(?:[\x20-\x7e]\x00){6,}"), "utf16", "utf-16-le", 0.75), (re.compile(rb"(?:\x00[\x20-\x7e]){6,}"), "utf16be", "utf-16-be", 0.75))
AMPERSAND = re.compile(r"&(#?[0-9A-Za-z]*)(;?)")
EXECUTABLE = {"elf": "ELF", "pe": "PE", "mach-o": "Mach-O", "wasm": "WASM"}
# --- end of fixed values ---


@dataclass
class Record:
    location: str
    text: str
    context: str = ""
    kind: str | None = None
    group: str = ""
    field_path: str | None = None
    relationship: str | None = None
    confidence: float = 1.0
    encoding: str | None = None
    byte_offset: int | None = None


@dataclass
class Child:
    name: str
    data: bytes


@dataclass
class Warn:
    code: str
    path: str
    message: str


Found = Record | Child | Warn
Part = Callable[[str], bytes]


class _Text(HTMLParser):
    def __init__(self):
        super().__init__()
        self.parts: list[str] = []

    def handle_data(self, data: str) -> None:
        if data.strip():
            self.parts.append(data.strip())


def html_text(source: str, bare: tuple[str, ...] | None = None) -> str:
    """Text nodes of a page, stripped and joined by spaces.

    References without a semicolon are resolved as browsers do, or, with ``bare``, only where they begin with one of its names.
    """
    mark = ""
    if bare is not None:
        # an ampersand that stays is hidden from the parser behind a character that the page doesn't hold
        mark = next(c for c in map(chr, range(0xE000, 0xF900)) if c not in source)
        source = AMPERSAND.sub(lambda m: m[0] if m[1].startswith(("#", *bare)) or f"{m[1]};" in html5 and m[2] else mark + m[0][1:], source)
    p = _Text()
    p.feed(source)
    p.close()
    text = " ".join(p.parts)
    return text.replace(mark, "&") if mark else text


def rtf_text(source: str) -> str:
    """Plain text of an RTF document, without its tables and pictures."""
    s = re.sub(r"\{\\\*?\\?(?:fonttbl|colortbl|stylesheet|info|pict)(?:[^{}]|\{[^{}]*\})*\}", " ", source)
    s = re.sub(r"\\(?:par|line)\b ?", "\n", s)
    s = re.sub(r"\\tab\b ?", "\t", s)
    s = re.sub(r"\\'([0-9a-fA-F]{2})", lambda m: bytes.fromhex(m[1]).decode("cp1252", "replace"), s)
    s = re.sub(r"\\u(-?\d+) ?\??", lambda m: chr(int(m[1]) % 65536), s)
    s = re.sub(r"\\[a-zA-Z]+-?\d* ?", "", s)
    return re.sub(r"\\([{}\\])", r"\1", re.sub(r"(?<!\\)[{}]", "", s)).strip()


def xml_root(source: str | bytes) -> ElementTree.Element:
    """Parsed XML; document types and entities are refused."""
    head = source if isinstance(source, str) else source.decode("utf-8", "ignore")
    if re.search(r"<!(?:DOCTYPE|ENTITY)", head):
        raise ValueError("document types are not allowed")
    return ElementTree.fromstring(source)


def leaves(value: object, path: str, nested: str) -> Iterator[Record]:
    """Non-null leaves of parsed JSON or YAML, with paths; siblings share their parent's path."""
    if isinstance(value, dict):
        for k, v in value.items():
            yield from leaves(v, f"{path}.{k}", nested)
    elif isinstance(value, list):
        for k, v in enumerate(value):
            yield from leaves(v, f"{path}[{k}]", nested)
    elif value is not None:
        parent, _, name = path.rpartition(".")
        yield Record(path, str(value), name or path, "structured", f"{nested}:{parent or path}", path, "field-sibling")


def carve(data: bytes, nested: str, kind: str = "binary") -> Iterator[Record]:
    """Printable runs of ASCII and UTF-16 with byte offsets."""
    for pattern, label, encoding, confidence in CARVED:
        context = {"ascii": "binary string", "utf16": "binary UTF-16 string", "utf16be": "binary UTF-16BE string"}[label]
        for m in pattern.finditer(data):
            yield Record(f"{label}-offset:{m.start()}", m[0].decode(encoding, "ignore"), context, kind, nested, confidence=confidence, byte_offset=m.start())


def _text(data: bytes, kind: str, nested: str) -> Iterator[Found]:
    encoding, confidence, text, _ = infer(data)
    yield Record("document", text, "", kind, nested, confidence=confidence, encoding=encoding)
    if kind == "json":
        yield from leaves(json.loads(text), "$", nested)
    elif kind == "yaml":
        import yaml

        for k, doc in enumerate(yaml.safe_load_all(text)):
            yield from leaves(doc, f"$[{k}]", nested)
    elif kind == "xml":
        for k, e in enumerate(xml_root(text).iter()):
            if value := (e.text or "").strip():
                yield Record(f"element:{k}", value, e.tag, kind, nested, e.tag, "xml-element")
            for name, v in e.attrib.items():
                yield Record(f"attribute:{k}:{name}", v, f"{e.tag}.{name}", kind, nested, name)
    elif kind == "csv":
        try:
            dialect = csv.Sniffer().sniff(text[:8192])
        except csv.Error:
            dialect = csv.excel
        for r, row in enumerate(csv.DictReader(io.StringIO(text), dialect=dialect), 2):
            for c, v in row.items():
                if v:
                    yield Record(f"row:{r}:column:{c}", v if isinstance(v, str) else ",".join(v), c or "", kind, f"{nested}:row:{r}", c or "")
    else:
        for n, line in enumerate(text.splitlines(), 1):
            if line.strip():
                yield Record(f"line:{n}", line, line[:256], kind, nested, encoding=encoding)


def safe(name: str) -> bool:
    n = name.replace("\\", "/")
    return not n.startswith("/") and ".." not in n.split("/")


def _zip(data: bytes, nested: str, limits: Limits, only: tuple[str, ...] = ()) -> Iterator[Found]:
    z = zip_of(data)
    members = z.infolist()
    if len(members) > limits.max_archive_members:
        yield Warn("archive_member_limit", nested, "too many members")
    for m in members[: limits.max_archive_members]:
        path = f"{nested}!/{m.filename}"
        if m.is_dir() or (only and not any(x in m.filename.lower() for x in only)):
            continue
        if not safe(m.filename):
            yield Warn("archive_path_traversal", path, "unsafe member name")
        elif m.flag_bits & 1:
            yield Warn("encrypted_archive_member", path, "member is encrypted")
        elif m.file_size > limits.max_object_size:
            yield Warn("object_too_large", path, "member is too large")
        elif m.file_size / max(1, m.compress_size) > limits.max_compression_ratio:
            yield Warn("compression_ratio_limit", path, "member is compressed too far")
        else:
            yield Child(m.filename, member(z, m, data, limits.max_object_size + 1))


def _tar(data: bytes, nested: str, limits: Limits) -> Iterator[Found]:
    t = tar_of(data)
    tar_of.cache_clear()  # its members are found while it is read, so an equal object takes a new one
    members = t.getmembers()
    if len(members) > limits.max_archive_members:
        yield Warn("archive_member_limit", nested, "too many members")
    for m in members[: limits.max_archive_members]:
        path = f"{nested}!/{m.name}"
        if not m.isfile():
            continue
        if not safe(m.name):
            yield Warn("archive_path_traversal", path, "unsafe member name")
        elif m.size > limits.max_object_size:
            yield Warn("object_too_large", path, "member is too large")
        elif (f := t.extractfile(m)) is not None:
            yield Child(m.name, f.read(m.size))


def _gunzipped(data: bytes, limit: int) -> bytes:
    """At most ``limit`` bytes of a gzip file. One whole member is read at once; several, broken ones and their errors are left to ``gzip``."""
    one = zlib.decompressobj(31)
    try:
        out = one.decompress(data, limit)
        if len(out) == limit or one.eof and not one.unused_data:
            return out
    except zlib.error:
        pass
    with gzip.GzipFile(fileobj=io.BytesIO(data)) as f:
        return f.read(limit)


def _gzip(data: bytes, nested: str, limits: Limits) -> Iterator[Found]:
    child = _gunzipped(data, limits.max_object_size + 1)
    if len(child) / max(1, len(data)) > limits.max_compression_ratio:
        yield Warn("compression_ratio_limit", nested, "content is compressed too far")
        return
    name = nested.rsplit("/", 1)[-1]
    stem = name.rpartition(".")[0] if name.rpartition(".")[0] else name
    yield Child(stem or "gzip-content", child)


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_O = "{urn:oasis:names:tc:opendocument:xmlns:text:1.0}"


def _joined(e: ElementTree.Element, tag: str) -> str:
    return "".join(t.text or "" for t in e.iter(tag))


def _docx(z: zipfile.ZipFile, part: Part, nested: str) -> Iterator[Record]:
    body = xml_root(part("word/document.xml")).find(f"{_W}body")
    for k, p in enumerate(body.findall(f"{_W}p")):
        if (t := _joined(p, f"{_W}t")).strip():
            yield Record(f"paragraph:{k}", t, "paragraph", "docx", nested)
    for k, table in enumerate(body.findall(f"{_W}tbl")):
        for r, row in enumerate(table.findall(f"{_W}tr")):
            for c, cell in enumerate(row.findall(f"{_W}tc")):
                t = "\n".join(_joined(p, f"{_W}t") for p in cell.findall(f"{_W}p"))
                if t.strip():
                    yield Record(f"table:{k}:row:{r}:column:{c}", t, f"table {k}", "docx", f"{nested}:table:{k}:row:{r}")


def _xlsx(z: zipfile.ZipFile, part: Part, nested: str) -> Iterator[Record]:
    names = set(z.namelist())
    shared = [_joined(si, f"{_S}t") for si in xml_root(part("xl/sharedStrings.xml")).findall(f"{_S}si")] if "xl/sharedStrings.xml" in names else []
    targets = {r.get("Id"): r.get("Target", "") for r in xml_root(part("xl/_rels/workbook.xml.rels"))}
    for sheet in xml_root(part("xl/workbook.xml")).iter(f"{_S}sheet"):
        title, target = sheet.get("name"), targets[sheet.get(f"{_R}id")].lstrip("/")
        for c in xml_root(part(target if target.startswith("xl/") else f"xl/{target}")).iter(f"{_S}c"):
            at, kind, v = c.get("r"), c.get("t"), c.findtext(f"{_S}v")
            v = _joined(c, f"{_S}t") if kind == "inlineStr" else shared[int(v)] if kind == "s" and v is not None else {"1": "True", "0": "False"}.get(v, v) if kind == "b" else v
            if v is not None:
                yield Record(f"sheet:{title}:cell:{at}", v, at, "xlsx", f"{nested}:sheet:{title}:row:{re.sub('[A-Z]', '', at)}", at)


def _pptx(z: zipfile.ZipFile, part: Part, nested: str) -> Iterator[Record]:
    slides = sorted((int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
    for k, (_, name) in enumerate(slides, 1):
        tree = next(xml_root(part(name)).iter(f"{_P}spTree"))
        shapes = [s for s in tree if s.tag in (f"{_P}{x}" for x in ("sp", "pic", "graphicFrame", "grpSp", "cxnSp"))]
        for n, s in enumerate(shapes):
            t = "\n".join(_joined(p, f"{_A}t") for p in s.iter(f"{_A}p"))
            if t.strip():
                yield Record(f"slide:{k}:shape:{n}", t, f"slide {k}", "pptx", f"{nested}:slide:{k}")


def _office(data: bytes, kind: str, nested: str, limits: Limits) -> Iterator[Found]:
    z = zip_of(data)
    part = lambda name: member(z, z.getinfo(name), data)
    if kind == "odf":
        for k, p in enumerate(xml_root(part("content.xml")).iter(f"{_O}p")):
            if (t := "".join(p.itertext())).strip():
                yield Record(f"paragraph:{k}", t, "paragraph", "odf", nested)
    elif kind == "epub":
        pages = [n for n in z.namelist() if n.lower().endswith((".xhtml", ".html", ".htm"))]
        for k, n in enumerate(pages):
            if t := html_text(part(n).decode("utf-8", "replace")):
                yield Record(f"item:{k}", t, n, "epub", nested)
    else:
        yield from {"docx": _docx, "xlsx": _xlsx, "pptx": _pptx}[kind](z, part, nested)
    yield from _zip(data, nested, limits, () if kind == "epub" else EMBEDS)


def _sqlite(data: bytes, nested: str, limits: Limits) -> Iterator[Found]:
    fd, path = tempfile.mkstemp(suffix=".db")
    try:
        with os.fdopen(fd, "wb") as f:
            f.write(data)
        db = sqlite3.connect(f"file:{path}?mode=ro&immutable=1", uri=True)
        try:
            db.execute("PRAGMA query_only=ON")
            steps = iter(range(limits.max_sqlite_vm_steps // 1000))
            db.set_progress_handler(lambda: int(next(steps, None) is None), 1000)
            left = limits.max_sqlite_rows
            for (table,) in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%'").fetchall():
                if left <= 0:
                    break
                quoted = table.replace('"', '""')
                rows = db.execute(f'SELECT * FROM "{quoted}" LIMIT ?', (left,))
                names = [c[0] for c in rows.description]
                for r, row in enumerate(rows, 1):
                    left -= 1
                    for c, v in zip(names, row, strict=True):
                        if v is not None:
                            yield Record(f"table:{table}:row:{r}:column:{c}", str(v), c, "sqlite", f"{nested}:table:{table}:row:{r}", c)
        finally:
            db.close()
        if left <= 0:
            yield Warn("sqlite_row_limit", nested, "row limit reached")
    finally:
        os.unlink(path)


def _gettext(data: bytes, nested: str) -> Iterator[Record]:
    catalog = getattr(gettext.GNUTranslations(io.BytesIO(data)), "_catalog", {})
    for k, (source, value) in enumerate(catalog.items()):
        if isinstance(source, str):
            for n, v in enumerate(value if isinstance(value, tuple) else (value,)):
                yield Record(f"message:{k}:{n}", str(v), source, "gettext", nested, source)


def read(data: bytes, kind: str, nested: str, limits: Limits) -> Iterator[Found]:
    """Everything that one object yields. What was found before an error stays; the object is then carved."""
    try:
        if kind in ("text", "json", "yaml", "xml", "csv"):
            yield from _text(data, kind, nested)
        elif kind in ("zip", "jar", "apk"):
            yield from _zip(data, nested, limits)
        elif kind == "tar":
            yield from _tar(data, nested, limits)
        elif kind == "gzip":
            yield from _gzip(data, nested, limits)
        elif kind in ("docx", "xlsx", "pptx", "odf", "epub"):
            yield from _office(data, kind, nested, limits)
        elif kind == "rtf":
            if t := rtf_text(data.decode("latin-1")):
                yield Record("document", t, "", "rtf", nested)
        elif kind == "sqlite":
            yield from _sqlite(data, nested, limits)
        elif kind == "gettext":
            yield from _gettext(data, nested)
        elif kind in EXECUTABLE:
            head = {"format": EXECUTABLE[kind], "magic": data[:16].hex(), "sections": [], "size": len(data)}
            yield Record("metadata", json.dumps(head, sort_keys=True), "executable header", kind, nested, confidence=0.7)
            yield from carve(data, nested, kind)
        elif kind == "binary":
            yield from carve(data, nested)
        else:
            yield Warn("handler_degraded", nested, f"no decoder for {kind}; strings are carved")
            yield from carve(data, nested, f"{kind}-fallback")
    except Exception as e:  # a broken carrier is data, not an error of the job
        yield Warn("handler_error", nested, f"{type(e).__name__}: {html.escape(str(e)[:200])}")
        yield from carve(data, nested, f"{kind}-fallback")
