"""Text and metadata of office files and PDF text layers, for ``readers.parse``.

``read`` takes the bytes of a file and gives ``(text, metadata)``. Formats are told by content, not by
name: zipped office formats (text, tables, slides; both families), PDF with a text layer, HTML and
plain text in UTF-8. Headers, footers, notes and pictures are left out. What is broken, encrypted or
of another format raises ``ValueError``, which ``readers.parse`` turns into a null text.
"""

from __future__ import annotations

import html
import io
import re
import zipfile
import zlib
from xml.etree import ElementTree

#: Unpacked contents larger than this are refused.
LARGEST = 256 << 20
_PARAGRAPHS = {"p", "h", "row", "table-row", "tr"}
_TEXTS = {"t", "span", "a", "p", "h"}


def read(raw: bytes, path: str = "") -> tuple[str, dict[str, str]]:
    """Text and metadata of a file of any supported format."""
    if raw is None:
        raise ValueError("no content")
    if raw.startswith(b"PK\x03\x04"):
        return _zipped(raw)
    if raw.lstrip()[:5] == b"%PDF-":
        return Pdf(raw).read()
    if b"\x00" in raw[:4096]:
        raise ValueError("a format that is not supported")
    text = raw.decode("utf-8-sig")
    if re.match(r"(?is)\s*<(!doctype html|html)", text):
        return _html(text)
    return text, {}


def _html(text: str) -> tuple[str, dict[str, str]]:
    title = re.search(r"(?is)<title[^>]*>(.*?)</title>", text)
    plain = re.sub(r"(?s)<[^>]*>", " ", re.sub(r"(?is)<(script|style)[^>]*>.*?</\1>|<!--.*?-->", " ", text))
    return " ".join(html.unescape(plain).split()), {"title": html.unescape(title[1]).strip()} if title else {}


# zipped formats ------------------------------------------------------------------------------


def _xml(z: zipfile.ZipFile, name: str) -> ElementTree.Element | None:
    if name not in z.namelist():
        return None
    if z.getinfo(name).file_size > LARGEST:
        raise ValueError("too large")
    data = z.read(name)
    if b"<!DOCTYPE" in data[:4096]:
        raise ValueError("document types are not read")
    return ElementTree.fromstring(data)


def _tag(e: ElementTree.Element) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _lines(root: ElementTree.Element | None) -> list[str]:
    """Text of paragraphs and table rows, one line each."""
    lines: list[str] = []

    def walk(e: ElementTree.Element, parts: list[str]) -> None:
        tag = _tag(e)
        if tag in ("tab", "tc", "table-cell") and parts:
            parts.append("\t")
        elif tag in ("br", "line-break"):
            parts.append("\n")
        elif tag == "s" and "}" in e.tag and "opendocument" in e.tag:
            parts.append(" ")
        block = tag in _PARAGRAPHS and not (tag == "p" and parts)
        own = [] if block else parts
        if tag in _TEXTS and e.text and (tag != "p" or "opendocument" in e.tag) and tag != "h" or tag == "h" and e.text:
            own.append(e.text)
        for child in e:
            walk(child, own)
            if "opendocument" in e.tag and child.tail:
                own.append(child.tail)
        if block and (line := "".join(own).strip()):
            lines.append(line)

    if root is not None:
        walk(root, [])
    return lines


def _sheet_rows(z: zipfile.ZipFile) -> list[str]:
    shared = _xml(z, "xl/sharedStrings.xml")
    strings = ["".join(t.text or "" for t in s.iter() if _tag(t) == "t") for s in shared] if shared is not None else []
    lines = []
    for name in _numbered(z, r"xl/worksheets/sheet(\d+)\.xml"):
        for row in (e for e in _xml(z, name).iter() if _tag(e) == "row"):
            cells = []
            for cell in (e for e in row if _tag(e) == "c"):
                value = "".join(v.text or "" for v in cell.iter() if _tag(v) in ("v", "t"))
                cells.append(strings[int(value)] if cell.get("t") == "s" and value else value)
            if any(cells):
                lines.append("\t".join(cells))
    return lines


def _numbered(z: zipfile.ZipFile, pattern: str) -> list[str]:
    found = [(int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(pattern, n))]
    return [n for _, n in sorted(found)]


def _zipped(raw: bytes) -> tuple[str, dict[str, str]]:
    try:
        z = zipfile.ZipFile(io.BytesIO(raw))
    except zipfile.BadZipFile as e:
        raise ValueError("a broken archive") from e
    names = set(z.namelist())
    if sum(i.file_size for i in z.infolist()) > LARGEST:
        raise ValueError("too large")
    if "word/document.xml" in names:
        lines = _lines(_xml(z, "word/document.xml"))
    elif "xl/workbook.xml" in names:
        lines = _sheet_rows(z)
    elif "ppt/presentation.xml" in names:
        lines = [x for n in _numbered(z, r"ppt/slides/slide(\d+)\.xml") for x in _lines(_xml(z, n))]
    elif "content.xml" in names:
        lines = _lines(_xml(z, "content.xml"))
    else:
        raise ValueError("an archive that is no document")
    meta = {}
    for part in ("docProps/core.xml", "meta.xml"):
        root = _xml(z, part)
        for e in root.iter() if root is not None else ():
            if e.text and e.text.strip() and len(e) == 0:
                meta.setdefault({"creator": "author"}.get(_tag(e), _tag(e)), e.text.strip())
    return "\n".join(lines), meta


# PDF -----------------------------------------------------------------------------------------

_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
_TOKEN = re.compile(rb"\(((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*)\)|<([0-9A-Fa-f\s]*)>|(\[)|(\])|/([^\s/<>\[\]()]+)|([-+]?\d*\.?\d+)|([A-Za-z'\"*]+)", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
#: A gap in a line of so many thousandths of the letter size is a blank.
GAP = -180


class Pdf:
    """The text layer of a PDF: page contents in order, letters by the fonts' own tables."""

    def __init__(self, raw: bytes):
        if b"/Encrypt" in raw:
            raise ValueError("an encrypted document")
        self.raw = raw
        self.objects = {int(m[1]): m[2] for m in _OBJECT.finditer(raw)}
        for body in list(self.objects.values()):
            if b"/ObjStm" in body:
                self._unpack(body)

    def _unpack(self, body: bytes) -> None:
        data, n, first = self._stream(body), self._number(body, b"N"), self._number(body, b"First")
        head = [int(x) for x in data[:first].split()]
        for i in range(n):
            end = head[2 * i + 3] if 2 * i + 3 < len(head) else len(data) - first
            self.objects[head[2 * i]] = data[first + head[2 * i + 1] : first + end]

    @staticmethod
    def _number(body: bytes, key: bytes) -> int:
        m = re.search(rb"/" + key + rb"\s+(\d+)", body)
        if m is None:
            raise ValueError("a broken document")
        return int(m[1])

    @staticmethod
    def _stream(body: bytes) -> bytes:
        m = _STREAM.search(body)
        if m is None:
            return b""
        if b"FlateDecode" not in body[: m.start()]:
            return m[1] if b"/Filter" not in body[: m.start()] else b""
        unpacker = zlib.decompressobj()
        data = unpacker.decompress(m[1], LARGEST)
        if unpacker.unconsumed_tail:
            raise ValueError("too large")
        return data

    def _referred(self, body: bytes, key: bytes) -> list[bytes]:
        """Objects that the key's value names, one or an array."""
        m = re.search(rb"/" + key + rb"\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body)
        return [self.objects[int(n)] for n in re.findall(rb"(\d+)\s+\d+\s+R", m[1]) if int(n) in self.objects] if m else []

    def _dictionary(self, body: bytes, key: bytes) -> bytes:
        """The dictionary of a key, written in place or referred to."""
        m = re.search(rb"/" + key + rb"\s*(?:(\d+)\s+\d+\s+R|(<<))", body)
        if m is None:
            return b""
        if m[1]:
            return self.objects.get(int(m[1]), b"")
        depth, at = 0, m.start(2)
        for t in re.finditer(rb"<<|>>", body[at:]):
            depth += 1 if t.group() == b"<<" else -1
            if depth == 0:
                return body[at : at + t.end()]
        return body[at:]

    def _pages(self) -> list[bytes]:
        root = next((b for b in self.objects.values() if re.search(rb"/Type\s*/Catalog\b", b)), None)
        pages: list[bytes] = []

        def walk(node: bytes, inherited: bytes, depth: int) -> None:
            own = self._dictionary(node, b"Resources") or inherited
            if re.search(rb"/Type\s*/Page\b", node):
                pages.append(node + b"/Inherited " + own)
            for kid in self._referred(node, b"Kids") if depth < 50 else ():
                walk(kid, own, depth + 1)

        for top in self._referred(root, b"Pages") if root else ():
            walk(top, b"", 0)
        return pages or [b for b in self.objects.values() if re.search(rb"/Type\s*/Page\b", b)]

    def _letters(self, font: bytes) -> tuple[int, dict[int, str]]:
        """Bytes of a code, and what codes stand for."""
        table = next((self._stream(b) for b in self._referred(font, b"ToUnicode")), b"")
        wide = 2 if b"/Type0" in font or b"Identity-H" in font else 1
        text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
        out: dict[int, str] = {}
        for block in re.findall(rb"beginbfchar(.*?)endbfchar", table, re.S):
            for code, to in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
                out[int(code, 16)] = text(to)
        for block in re.findall(rb"beginbfrange(.*?)endbfrange", table, re.S):
            for low, high, to in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
                start = text(to)
                for k in range(min(int(high, 16) - int(low, 16), 65_535) + 1):
                    out[int(low, 16) + k] = start[:-1] + chr(ord(start[-1]) + k)
        return wide, out

    @staticmethod
    def _bytes(m: re.Match) -> bytes:
        if m[2] is not None:
            digits = re.sub(rb"\s", b"", m[2])
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        return re.sub(rb"\\([0-7]{1,3}|\r?\n|.)", lambda e: bytes([int(e[1], 8) & 255]) if e[1].isdigit() else b"" if e[1].strip() == b"" else _ESCAPES.get(e[1], e[1]), m[1], flags=re.S)

    def _page_text(self, page: bytes) -> str:
        resources = self._dictionary(page, b"Resources") or page
        fonts = {}
        for name, number in re.findall(rb"/([^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R", self._dictionary(resources, b"Font")):
            fonts[name] = self._letters(self.objects.get(int(number), b""))
        out: list[str] = []
        wide, letters, numbers, held, name = 1, {}, [], [], b""

        def show(data: bytes) -> None:
            codes = [int.from_bytes(data[i : i + wide], "big") for i in range(0, len(data), wide)]
            out.append("".join(letters.get(c) or (bytes([c]).decode("cp1252", "replace") if wide == 1 else "") for c in codes))

        for content in self._referred(page, b"Contents"):
            for m in _TOKEN.finditer(self._stream(content)):
                if m[1] is not None or m[2] is not None:
                    held.append(self._bytes(m))
                elif m[5] is not None:
                    name = m[5]
                elif m[6] is not None:
                    numbers.append(float(m[6]))
                    if held and numbers[-1] < GAP:
                        held.append(None)
                elif m[7] is not None:
                    operator = m[7]
                    if operator == b"Tf":
                        wide, letters = fonts.get(name, (1, {}))
                    elif operator in (b"T*", b"'", b'"', b"Tm") or operator in (b"Td", b"TD") and numbers and abs(numbers[-1]) > 0.01:
                        out.append("\n")
                    elif operator in (b"Td", b"TD"):
                        out.append(" ")
                    if operator in (b"Tj", b"TJ", b"'", b'"'):
                        for part in held:
                            out.append(" ") if part is None else show(part)
                    held, numbers = [], []
        lines = (" ".join(x.split()) for x in "".join(out).split("\n"))
        return "\n".join(x for x in lines if x)

    def read(self) -> tuple[str, dict[str, str]]:
        """Text of all pages, form feeds between them, and the document's own metadata."""
        meta = {}
        trailer = re.findall(rb"/Info\s+(\d+)\s+\d+\s+R", self.raw)
        info = self.objects.get(int(trailer[-1]), b"") if trailer else b""
        for key in ("Title", "Author", "Subject", "Keywords", "Creator", "CreationDate"):
            at = re.search(rb"/" + key.encode() + rb"\s*(?=[(<])", info)
            if at and (m := _TOKEN.match(info, at.end())):
                value = self._bytes(m)
                meta[key.lower()] = value[2:].decode("utf-16-be", "replace") if value[:2] == b"\xfe\xff" else value.decode("cp1252", "replace")
        return "\f".join(self._page_text(p) for p in self._pages()), meta
