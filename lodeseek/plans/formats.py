"""Small carriers of every readable format, made from a key and a name: what the carrier queries read."""

from __future__ import annotations

import gzip
import io
import json
import sqlite3
import struct
import tarfile
import zipfile
import zlib

_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
_S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
_A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'
_R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_O = "urn:oasis:names:tc:opendocument:xmlns"


def zipped(members: dict[str, str | bytes], method: int = zipfile.ZIP_STORED) -> bytes:
    """A ZIP file as ``zipfile`` writes it; few stored members with plain names are put together here, which takes a tenth of the time."""
    if method == zipfile.ZIP_STORED and len(members) < 1000 and all(n.isascii() and n and "\0" not in n and not n.endswith("/") for n in members):
        out, directory, at = [], [], 0
        for name, data in members.items():
            n, data = name.encode(), data.encode() if isinstance(data, str) else data
            head = struct.pack("<5H3I2H", 20, 0, 0, 0, 33, zlib.crc32(data), len(data), len(data), len(n), 0)
            out += [b"PK\3\4", head, n, data]
            directory += [b"PK\1\2\x14\3", head, struct.pack("<3H2I", 0, 0, 0, 0o600 << 16, at), n]
            at += 30 + len(n) + len(data)
        index = b"".join(directory)
        return b"".join((*out, index, struct.pack("<4s4H2IH", b"PK\5\6", 0, 0, len(members), len(members), len(index), at, 0)))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for name, data in members.items():
            z.writestr(zipfile.ZipInfo(name), data, method)
    return out.getvalue()


def tarred(members: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        for name, data in members.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def database(statements: list[tuple[str, tuple]]) -> bytes:
    db = sqlite3.connect(":memory:")
    for sql, values in statements:
        db.execute(sql, values)
    db.commit()
    data = db.serialize()
    db.close()
    return data


def mo_file(messages: dict[str, str]) -> bytes:
    pairs = sorted((k.encode(), v.encode()) for k, v in messages.items())
    keys, values = b"".join(k + b"\0" for k, _ in pairs), b"".join(v + b"\0" for _, v in pairs)
    at, ko, vo = 28, 0, 0
    base = at + 16 * len(pairs)
    ks, vs = [], []
    for k, v in pairs:
        ks.append(struct.pack("<II", len(k), base + ko))
        vs.append(struct.pack("<II", len(v), base + len(keys) + vo))
        ko, vo = ko + len(k) + 1, vo + len(v) + 1
    return struct.pack("<IIIIIII", 0x950412DE, 0, len(pairs), at, at + 8 * len(pairs), 0, base) + b"".join(ks) + b"".join(vs) + keys + values


def json_file(k: int, name: str) -> bytes:
    return json.dumps({"user": {"name": name, "ids": [k, k + 1]}, "none": None, "on": True}).encode()


def yaml_file(k: int, name: str) -> bytes:
    return f"user:\n  name: '{name}'\n  ids:\n    - {k}\n    - {k + 1}\n---\nkey: v{k}\nempty:\n".encode()


def xml_file(k: int, name: str) -> bytes:
    return f'<r id="{k}"><name>{name}</name><note kind="x"> y{k} </note><none/></r>'.encode()


def csv_file(k: int, name: str) -> bytes:
    return f"name,key\n{name},{k}\nsecond,\n".encode()


def text_file(k: int, name: str) -> bytes:
    return f"{name}\n\n  \nkey {k}\r\nlast".encode()


def zip_file(k: int, name: str) -> bytes:
    return zipped({"docs/a.txt": text_file(k, name), "in.zip": zipped({"deep.json": json_file(k, name)}), "../evil.txt": "x", "/abs.txt": "x", "empty.txt": ""})


def tar_file(k: int, name: str) -> bytes:
    return tarred({"docs/a.txt": text_file(k, name), "table.csv": csv_file(k, name), "../evil.txt": b"x"})


def gzip_file(k: int, name: str) -> bytes:
    return gzip.compress(text_file(k, name), mtime=0)


def bomb_file(k: int, name: str) -> bytes:
    """A member that expands a thousandfold beside one that doesn't."""
    return zipped({"zeros.bin": b"\0" * 300_000, "a.txt": name}, zipfile.ZIP_DEFLATED)


def docx_file(k: int, name: str) -> bytes:
    p = "<w:p><w:r><w:t>{}</w:t></w:r><w:r><w:t>{}</w:t></w:r></w:p>"
    cell = "<w:tc><w:p><w:r><w:t>{}</w:t></w:r></w:p></w:tc>"
    body = p.format(name, " one") + "<w:p/>" + p.format("key ", k) + f"<w:tbl><w:tr>{cell.format(k)}{cell.format(name)}</w:tr></w:tbl>"
    return zipped({"word/document.xml": f"<w:document {_W}><w:body>{body}</w:body></w:document>", "word/media/note.txt": f"media {k}", "word/styles.txt": "not read"})


def xlsx_file(k: int, name: str) -> bytes:
    rel = f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>'
    cells = f'<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1"><v>{k}</v></c></row><row r="2"><c r="A2" t="inlineStr"><is><t>in {k}</t></is></c><c r="B2" t="b"><v>1</v></c><c r="C2"/></row>'
    return zipped(
        {
            "xl/workbook.xml": f'<workbook {_S} xmlns:r="{_R}"><sheets><sheet name="One" sheetId="1" r:id="r1"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": rel,
            "xl/sharedStrings.xml": f"<sst {_S}><si><t>{name}</t></si></sst>",
            "xl/worksheets/sheet1.xml": f"<worksheet {_S}><sheetData>{cells}</sheetData></worksheet>",
        }
    )


def pptx_file(k: int, name: str) -> bytes:
    shape = "<p:sp><p:txBody><a:p><a:r><a:t>{}</a:t></a:r></a:p></p:txBody></p:sp>"
    slide = lambda *t: f"<p:sld {_A}><p:cSld><p:spTree>{''.join(map(shape.format, t))}</p:spTree></p:cSld></p:sld>"
    return zipped({"ppt/presentation.xml": "<x/>", "ppt/slides/slide2.xml": slide(f"key {k}"), "ppt/slides/slide1.xml": slide(name, " ", "third")})


def odf_file(k: int, name: str) -> bytes:
    text = f'<o:c xmlns:o="{_O}:office:1.0" xmlns:t="{_O}:text:1.0"><t:p>{name}</t:p><t:p/><t:p>key <t:span>{k}</t:span></t:p></o:c>'
    return zipped({"mimetype": "application/vnd.oasis.opendocument.text", "content.xml": text, "Pictures/note.txt": f"media {k}"})


def epub_file(k: int, name: str) -> bytes:
    return zipped({"mimetype": "application/epub+zip", "META-INF/container.xml": "<container/>", "a.xhtml": f"<html><body><p>{name}</p> <b> key {k}</b></body></html>", "b.html": "<p> </p>"})


def rtf_file(k: int, name: str) -> bytes:
    return f"{{\\rtf1\\ansi{{\\fonttbl{{\\f0 Arial;}}}}{name}\\par key\\tab {k}\\'21}}".encode()


def sqlite_file(k: int, name: str) -> bytes:
    return database([("CREATE TABLE t (k INTEGER, v TEXT, n TEXT)", ()), ("INSERT INTO t VALUES (?, ?, NULL)", (k, name)), ("INSERT INTO t VALUES (?, 'two', 'x')", (k + 1,))])


def gettext_file(k: int, name: str) -> bytes:
    return mo_file({"": "Content-Type: text/plain; charset=UTF-8\n", "hello": f"hallo {name}", "key": f"k{k}"})


def elf_file(k: int, name: str) -> bytes:
    return b"\x7fELF" + b"\0" * 12 + name.encode() + b"\0\1" + f"wide {k:06d}".encode("utf-16-le") + b"\1\1"


def sevenzip_file(k: int, name: str) -> bytes:
    return bytes.fromhex("377abcaf271c0004") + b"\0" * 8 + name.encode() + b"\0"


def broken_json(k: int, name: str) -> bytes:
    return f'{{"name": "{name}", '.encode()


def nested_gzip(k: int, name: str) -> bytes:
    data = f"{name} {k}".encode()
    for _ in range(8):
        data = gzip.compress(data, mtime=0)
    return data
