"""Carrier detection: signatures first, then structure, then names."""

from __future__ import annotations

import importlib.util
import io
import mimetypes
import shutil
import struct
import tarfile
import zipfile
import zlib
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values: signatures, suffixes and handlers ---
#: (hex signature, offset, kind, MIME type, confidence); the first that fits decides.
SIGNATURES = (
    ("255044462d", 0, "pdf", "application/pdf", 0.99),
    ("53514c69746520666f726d6174203300", 0, "sqlite", "application/vnd.sqlite3", 0.99),
    ("1f8b", 0, "gzip", "application/gzip", 0.99),
    ("377abcaf271c", 0, "7z", "application/x-7z-compressed", 0.99),
    ("526172211a07", 0, "rar", "application/vnd.rar", 0.99),
    ("edabeedb", 0, "rpm", "application/x-rpm", 0.99),
    ("7b5c727466", 0, "rtf", "application/rtf", 0.99),
    ("7f454c46", 0, "elf", "application/x-elf", 0.99),
    ("0061736d", 0, "wasm", "application/wasm", 0.99),
    ("de120495", 0, "gettext", "application/x-gettext-translation", 0.99),
    ("950412de", 0, "gettext", "application/x-gettext-translation", 0.99),
    ("4344303031", 0x8001, "iso", "application/x-iso9660-image", 0.99),
    ("504b0304", 0, "zip", None, 0.98),
    ("504b0506", 0, "zip", None, 0.98),
    ("504b0708", 0, "zip", None, 0.98),
    ("d0cf11e0a1b11ae1", 0, "ole", None, 0.85),
    ("4d5a", 0, "pe", "application/vnd.microsoft.portable-executable", 0.92),
    ("feedface", 0, "mach-o", "application/x-mach-binary", 0.99),
    ("cefaedfe", 0, "mach-o", "application/x-mach-binary", 0.99),
    ("feedfacf", 0, "mach-o", "application/x-mach-binary", 0.99),
    ("cffaedfe", 0, "mach-o", "application/x-mach-binary", 0.99),
    ("cafebabe", 0, "mach-o", "application/x-mach-binary", 0.99),
    ("bebafeca", 0, "mach-o", "application/x-mach-binary", 0.99),
    ("89504e470d0a1a0a", 0, "image", "image/png", 0.99),
    ("ffd8ff", 0, "image", "image/jpeg", 0.99),
    ("474946383761", 0, "image", "image/gif", 0.99),
    ("474946383961", 0, "image", "image/gif", 0.99),
    ("49492a00", 0, "image", "image/tiff", 0.99),
    ("4d4d002a", 0, "image", "image/tiff", 0.99),
    ("38425053", 0, "image", "image/vnd.adobe.photoshop", 0.99),
    ("00000100", 0, "image", "image/x-icon", 0.99),
    ("57454250", 8, "image", "image/webp", 0.99),
    ("00010000", 0, "font", None, 0.95),
    ("4f54544f", 0, "font", None, 0.95),
    ("774f4646", 0, "font", None, 0.95),
    ("774f4632", 0, "font", None, 0.95),
    ("74727565", 0, "font", None, 0.95),
)
STRUCTURED_SUFFIX = {"json": "json", "yaml": "yaml", "yml": "yaml", "xml": "xml", "svg": "xml", "csv": "csv"}
TEXT_SUFFIX = "c cc cfg conf cpp cs css env go h hpp ini java js jsx kt log md pem php properties py rb rs sh sql toml ts tsx txt vue".split()
OTHER_SUFFIX = {
    "7z": "7z", "rar": "rar", "jar": "jar", "apk": "apk", "rpm": "rpm", "iso": "iso", "doc": "doc", "xls": "xls", "ppt": "ppt", "odt": "odf", "ods": "odf", "odp": "odf", "epub": "epub", "rtf": "rtf",
    "msg": "outlook-msg", "wasm": "wasm", "ttf": "font", "otf": "font", "woff": "font", "woff2": "font", "mp3": "audio", "wav": "audio", "flac": "audio", "ogg": "audio", "m4a": "audio",
    "mp4": "video", "mkv": "video", "mov": "video", "avi": "video", "webm": "video", "psd": "image", "ico": "image",
}
OLE_SUFFIX = ("doc", "xls", "ppt", "outlook-msg")
#: Members that tell what a ZIP file is, in order: (member, suffix it needs, kind).
ZIP_MEMBERS = (("word/document.xml", "", "docx"), ("xl/workbook.xml", "", "xlsx"), ("ppt/presentation.xml", "", "pptx"), ("META-INF/container.xml", "", "epub"), ("META-INF/MANIFEST.MF", "jar", "jar"), ("AndroidManifest.xml", "apk", "apk"), ("classes.dex", "apk", "apk"))
ODF_MIME = b"application/vnd.oasis.opendocument"
#: Handlers by priority: (id, kinds, modules and commands that full support needs here, priority).
HANDLERS = (
    ("structured-text", ("text", "json", "yaml", "xml", "csv"), ("yaml",), 10),
    ("zip-family", ("zip", "jar", "apk"), (), 20),
    ("tar-gzip", ("tar", "gzip"), (), 21),
    ("sevenzip", ("7z",), ("py7zr",), 22),
    ("rar", ("rar",), ("rarfile", "unrar"), 23),
    ("rpm", ("rpm",), ("rpmfile",), 24),
    ("iso", ("iso",), ("pycdlib",), 25),
    ("ooxml", ("docx", "xlsx", "pptx"), (), 30),
    ("legacy-office", ("doc", "xls", "ppt", "ole"), ("olefile",), 31),
    ("open-document", ("odf",), (), 32),
    ("epub", ("epub",), (), 33),
    ("rtf", ("rtf",), (), 34),
    ("outlook-msg", ("outlook-msg",), ("extract_msg",), 35),
    ("executable", ("elf", "pe", "mach-o", "wasm"), (), 40),
    ("font", ("font",), ("fontTools",), 41),
    ("audio", ("audio",), ("mutagen",), 42),
    ("video", ("video",), ("pymediainfo",), 43),
    ("image", ("image",), ("PIL", "pytesseract"), 50),
    ("pdf", ("pdf",), ("pypdf", "fitz"), 51),
    ("sqlite", ("sqlite",), (), 52),
    ("gettext", ("gettext",), (), 53),
    ("unknown-binary", ("binary",), (), 999),
)
# --- end of fixed values ---
#: for each first byte the signatures that data beginning with it can have, in order
_STARTS = tuple(tuple((bytes.fromhex(h), at, kind, mime, c) for h, at, kind, mime, c in SIGNATURES if at or bytes.fromhex(h)[0] == first) for first in range(256))
_LOCAL = struct.Struct("<4s2xH18xHH")  # a member's own header: mark, flags, lengths of name and extra field
_SUFFIXES = ((STRUCTURED_SUFFIX, 0.65), (dict.fromkeys(TEXT_SUFFIX, "text"), 0.60), (OTHER_SUFFIX, 0.45))
HANDLER_OF = {kind: h[0] for h in sorted(HANDLERS, key=lambda h: -h[3]) for kind in h[1]}


@dataclass(frozen=True)
class Detection:
    kind: str
    mime: str
    confidence: float
    structural: bool


def suffix_of(name: str) -> str:
    stem, dot, suffix = name.replace("\\", "/").rsplit("/", 1)[-1].rpartition(".")
    return suffix.lower() if dot and stem else ""


_guess = lru_cache(4096)(lambda name: mimetypes.guess_type(name)[0] or "application/octet-stream")


def mime_of(name: str) -> str:
    """The MIME type that a name suggests. Of a file name its last two suffixes decide."""
    parts = name.rsplit("/", 1)[-1].split(".")
    return _guess(name if ":" in name or not parts[0] else ".".join(["x", *parts[1:][-2:]]))


@lru_cache(1)
def zip_of(data: bytes) -> zipfile.ZipFile:
    """``data`` opened as ZIP. Detection and the readers of one object share it, as its directory is read on opening."""
    return zipfile.ZipFile(io.BytesIO(data))


def member(z: zipfile.ZipFile, m: zipfile.ZipInfo, data: bytes, limit: int | None = None) -> bytes:
    """Bytes of a member of ``z``, the opened ``data``, at most ``limit``.

    A stored or deflated member whose headers, size and checksum agree is cut out at once; all others and their errors are left to ``zipfile``.
    """
    at, end = m.header_offset + _LOCAL.size, getattr(m, "_end_offset", None)
    if end is not None and m.orig_filename.isascii() and m.flag_bits & 0x61 == 0 and (limit is None or m.file_size <= limit) and 0 <= m.header_offset and at <= len(data):
        mark, flags, name, extra = _LOCAL.unpack_from(data, m.header_offset)
        start = at + name + extra
        stop = start + m.compress_size
        if mark == b"PK\3\4" and flags & 0x61 == 0 and data[at : at + name] == m.orig_filename.encode() and stop <= min(end, len(data)):
            out = data[start:stop] if m.compress_type == zipfile.ZIP_STORED else None
            if m.compress_type == zipfile.ZIP_DEFLATED:
                one = zlib.decompressobj(-15)
                try:
                    out = one.decompress(data[start:stop], m.file_size + 1)
                    out = out if one.eof else None
                except zlib.error:
                    out = None
            if out is not None and len(out) == m.file_size and zlib.crc32(out) == m.CRC:
                return out
    with z.open(m) as f:
        return f.read() if limit is None else f.read(limit)


def _zip_kind(data: bytes, suffix: str) -> str | None:
    try:
        z = zip_of(data)
        names = set(z.namelist())
        kinds = [kind for member, needs, kind in ZIP_MEMBERS if member in names and (not needs or needs == suffix)]
        if kinds and kinds[0] in ("docx", "xlsx", "pptx", "epub"):
            return kinds[0]
        if "mimetype" in names and member(z, z.getinfo("mimetype"), data).startswith(ODF_MIME):
            return "odf"
        return kinds[0] if kinds else "zip"
    except (OSError, zipfile.BadZipFile):
        return None


def _may_be_packed(data: bytes) -> bool:
    """Whether it can be a bzip2, xz or lzma stream, whose dictionary size has one or two bits."""
    return data.startswith((b"BZh", b"\xfd7zXZ\0")) or 0 < len(data) and (int.from_bytes(data[1:5], "little").bit_count() <= 2 or data[1:5] == b"\xff\xff\xff\xff")


def _may_be_tar(data: bytes) -> bool:
    """Whether ``tarfile`` can open it: a whole header block, or the head of a packed stream."""
    return len(data) >= tarfile.BLOCKSIZE or _may_be_packed(data)


@lru_cache(1)
def tar_of(data: bytes) -> tarfile.TarFile:
    """``data`` opened as TAR, shared as ``zip_of`` is. Decompressors are tried only where one can fit: ``r:*`` tries them all, and first."""
    return tarfile.open(fileobj=io.BytesIO(data), mode="r:*" if data.startswith(b"\x1f\x8b") or _may_be_packed(data) else "r:")


def detect(data: bytes, name: str) -> Detection:
    suffix, mime = suffix_of(name), mime_of(name)
    for magic, at, kind, own_mime, confidence in _STARTS[data[0]] if data else ():
        if data[at : at + len(magic)] != magic or (at == 8 and not data.startswith(b"RIFF")):
            continue
        if kind == "zip":
            found = _zip_kind(data, suffix)
            return Detection(found or "zip", mime, confidence if found else 0.55, found is not None)
        if kind == "ole" and OTHER_SUFFIX.get(suffix) in OLE_SUFFIX:
            kind = OTHER_SUFFIX[suffix]
        return Detection(kind, own_mime or mime, confidence, True)
    try:
        if _may_be_tar(data):
            tar_of(data)
            return Detection("tar", "application/x-tar", 0.95, True)
    except (tarfile.TarError, OSError, EOFError):
        pass
    for table, confidence in _SUFFIXES:
        if suffix in table:
            return Detection(table[suffix], mime, confidence, False)
    head = data[:4096]
    if b"\0" not in head:
        try:
            head.decode("utf-8")
            return Detection("text", "text/plain", 0.75, True)
        except UnicodeDecodeError:
            pass
    return Detection("binary", "application/octet-stream", 0.40, False)


def suffix_kind(name: Column) -> Column:
    """The kind that a file name suggests, or null."""
    suffix = F.lower(F.regexp_extract(name, r"[^/\\]\.([A-Za-z0-9]+)$", 1))
    table = STRUCTURED_SUFFIX | dict.fromkeys(TEXT_SUFFIX, "text") | OTHER_SUFFIX
    pairs = [F.lit(x) for kv in sorted(table.items()) for x in kv]
    return F.try_element_at(F.create_map(*pairs), suffix)


def magic_kind(data: Column) -> Column:
    """The kind that a signature proves, or null; ZIP and OLE subtypes need ``detect``."""
    out = None
    for signature, at, kind, _, _ in SIGNATURES:
        fits = F.substring(data, at + 1, len(signature) // 2) == F.unhex(F.lit(signature))
        if at == 8:
            fits &= F.substring(data, 1, 4) == F.unhex(F.lit("52494646"))
        out = F.when(fits, kind) if out is None else out.when(fits, kind)
    return out


def missing(needs: tuple[str, ...]) -> list[str]:
    return [n for n in needs if importlib.util.find_spec(n) is None and shutil.which(n) is None]


def capabilities(spark: SparkSession) -> DataFrame:
    """handler_id, kinds, status (full, or fallback where a decoder is missing), missing, priority."""
    rows = [(h, list(kinds), "fallback" if h == "unknown-binary" or missing(needs) else "full", missing(needs), priority) for h, kinds, needs, priority in HANDLERS]
    return spark.createDataFrame(rows, "handler_id string, kinds array<string>, status string, missing array<string>, priority int")
