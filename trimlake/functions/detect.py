"""Format detection: one rule list, as a column expression over whole tables and as a function for one value."""

from __future__ import annotations

import struct
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from trimlake.functions.codec import Refused, inflate


@dataclass(frozen=True)
class Format:
    name: str
    family: str
    extension: str


#: The formats, their families and default extensions.
FORMATS = tuple(
    Format(*row.split())
    for row in """
DOCX word .docx
DOCM word .docm
DOTX word .dotx
DOTM word .dotm
XLSX sheet .xlsx
XLSM sheet .xlsm
XLTX sheet .xltx
XLTM sheet .xltm
PPTX slides .pptx
PPTM slides .pptm
POTX slides .potx
POTM slides .potm
PPSX slides .ppsx
PPSM slides .ppsm
PDF pdf .pdf
ODT odf .odt
ODS odf .ods
ODP odf .odp
EPUB epub .epub
RTF rtf .rtf
PNG image .png
JPEG image .jpg
WEBP image .webp
SVG image .svg
HTML html .html
FODT fodt .fodt
""".strip().splitlines()
)
BY_NAME = {f.name: f for f in FORMATS}
OOXML = frozenset(("word", "sheet", "slides"))
UNKNOWN = "Unknown"

#: Bytes that a format begins with; texts that tell packages apart, in order; members of the office families.
MAGIC = (("PNG", b"\x89PNG\r\n\x1a\n"), ("JPEG", b"\xff\xd8\xff"), ("PDF", b"%PDF-"), ("RTF", b"{\\rtf"))
ZIP = b"PK\x03\x04"
PACKAGE_MARKS = (
    ("EPUB", "application/epub+zip"), ("ODT", "application/vnd.oasis.opendocument.text"), ("ODS", "application/vnd.oasis.opendocument.spreadsheet"),
    ("ODP", "application/vnd.oasis.opendocument.presentation"), ("EPUB", "META-INF/container.xml"),
)
OFFICE = (
    ("word/", (".docx", ".docm", ".dotx", ".dotm")),
    ("xl/", (".xlsx", ".xlsm", ".xltx", ".xltm")),
    ("ppt/", (".pptx", ".pptm", ".potx", ".potm", ".ppsx", ".ppsm")),
)
#: Most bytes of the entry that names a package's type.
MOST_TYPE = 1 << 12
HTML_MARKS = ("<!doctype html", "<!DOCTYPE html", "<html")
#: Extensions that decide where no content does.
FALLBACK = (
    ("DOCX", (".docx",)), ("XLSX", (".xlsx",)), ("PPTX", (".pptx",)), ("PDF", (".pdf",)), ("ODT", (".odt",)), ("ODS", (".ods",)), ("ODP", (".odp",)),
    ("EPUB", (".epub",)), ("RTF", (".rtf",)), ("PNG", (".png",)), ("JPEG", (".jpg", ".jpeg")), ("WEBP", (".webp",)), ("SVG", (".svg",)),
)


class _Bytes:
    """The tests that the rules need, on one value."""

    def __init__(self, data: bytes, hint: str):
        self.data, self.hint = data, hint.lower()

    def empty(self):
        return not self.data

    def begins(self, x: bytes, at: int = 0):
        return self.data[at : at + len(x)] == x

    def holds(self, x: str):
        return x.encode() in self.data

    def named(self, *ends: str):
        return self.hint.endswith(ends)

    any = staticmethod(lambda *x: any(x))
    all = staticmethod(lambda *x: all(x))

    @staticmethod
    def first(rules, otherwise):
        return next((value for test, value in rules if test), otherwise)


def _listed(data: bytes) -> tuple[list[bytes], bytes] | None:
    """The names in a package's directory, and its mimetype entry (empty if there is none); None if there is no whole directory."""
    end = data.rfind(b"PK\x05\x06", max(0, len(data) - 65_557))
    if end < 0 or end + 22 > len(data):
        return None
    count, _, at = struct.unpack_from("<HII", data, end + 10)
    names, kind = [], b""
    for _ in range(count):
        if data[at : at + 4] != b"PK\x01\x02" or at + 46 > len(data):
            return None
        method, packed = struct.unpack_from("<H8xI", data, at + 10)
        n, extra, note, local = struct.unpack_from("<HHH8xI", data, at + 28)
        name = data[at + 46 : at + 46 + n]
        names.append(name)
        at += 46 + n + extra + note
        if name == b"mimetype" and data[local : local + 4] == ZIP and local + 30 <= len(data):
            start = local + 30 + sum(struct.unpack_from("<HH", data, local + 26))
            kind = data[start : start + min(packed, MOST_TYPE)]
            try:
                kind = inflate(kind, -15, MOST_TYPE) if method == 8 else kind
            except Refused:
                kind = b""
    return names, kind


class _Package(_Bytes):
    """The same tests on a package: marks are looked for in its list of parts and its mimetype entry, as packed contents may hold the same bytes by chance."""

    def __init__(self, data: bytes, hint: str, names: list[bytes], kind: bytes):
        super().__init__(data, hint)
        self.names, self.kind = names, kind

    def holds(self, x: str):
        mark = x.encode()
        return mark in self.kind or any(n.startswith(mark) if x.endswith("/") else n == mark for n in self.names)


class _Columns:
    """The same tests on columns."""

    def __init__(self, content: Column, hint: Column):
        self.content, self.hint = content, F.lower(F.coalesce(hint, F.lit("")))

    def empty(self):
        return F.coalesce(F.octet_length(self.content), F.lit(0)) == 0

    def begins(self, x: bytes, at: int = 0):
        return F.substring(self.content, at + 1, len(x)) == F.lit(bytearray(x))

    def holds(self, x: str):
        return F.contains(self.content, F.lit(bytearray(x.encode())))

    def named(self, *ends: str):
        return self.any(*(F.endswith(self.hint, F.lit(e)) for e in ends))

    @staticmethod
    def any(*x):
        out = x[0]
        for y in x[1:]:
            out = out | y
        return out

    @staticmethod
    def all(*x):
        out = x[0]
        for y in x[1:]:
            out = out & y
        return out

    @staticmethod
    def first(rules, otherwise):
        out = None
        for test, value in rules:
            value = value if isinstance(value, Column) else F.lit(value)
            out = F.when(test, value) if out is None else out.when(test, value)
        return out.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


class _Sql:
    """The same tests as SQL text, for a text column: bytes that no text begins with never match."""

    def __init__(self, content: str, hint: str):
        self.content, self.hint = content, f"lower({hint})"

    def empty(self):
        return f"strlen({self.content}) = 0"

    def begins(self, x: bytes, at: int = 0):
        return f"substr({self.content}, {at + 1}, {len(x)}) = {self._text(x.decode())}" if x.isascii() else "FALSE"

    def holds(self, x: str):
        return f"contains({self.content}, {self._text(x)})"

    def named(self, *ends: str):
        return self.any(*(f"ends_with({self.hint}, {self._text(e)})" for e in ends))

    @staticmethod
    def _text(x: str) -> str:
        return "'" + x.replace("'", "''") + "'" if x.isprintable() else " || ".join(f"chr({ord(c)})" for c in x)

    any = staticmethod(lambda *x: "(" + " OR ".join(x) + ")")
    all = staticmethod(lambda *x: "(" + " AND ".join(x) + ")")

    @classmethod
    def first(cls, rules, otherwise):
        put = lambda v: v if v.startswith("CASE ") else cls._text(v)
        return "CASE " + " ".join(f"WHEN {test} THEN {put(value)}" for test, value in rules) + f" ELSE {put(otherwise)} END"


def _rules(v):
    office = []
    for folder, ends in OFFICE:
        kinds = [(v.named(e), e[1:].upper()) for e in ends[1:]]
        office.append((v.any(v.holds(folder), v.named(*ends)), v.first(kinds, ends[0][1:].upper())))
    packed = v.any(v.holds("[Content_Types].xml"), *(v.holds(folder) for folder, _ in OFFICE))
    listed = v.first([(v.named(".ods"), "ODS"), (v.named(".odp"), "ODP")], "ODT")
    zip_ = v.begins(ZIP)
    return v.first(
        [
            (v.empty(), UNKNOWN),
            *((v.begins(x), name) for name, x in MAGIC),
            (v.all(v.begins(b"RIFF"), v.begins(b"WEBP", 8)), "WEBP"),
            *((v.all(zip_, v.holds(mark)), name) for name, mark in PACKAGE_MARKS),
            (v.all(zip_, v.holds("META-INF/manifest.xml")), listed),
            (v.all(zip_, packed), v.first(office, "DOCX")),
            (v.holds("<svg"), "SVG"),
            (v.any(v.holds("<office:document"), v.named(".fodt")), "FODT"),
            (v.any(*(v.holds(m) for m in HTML_MARKS), v.named(".html", ".htm")), "HTML"),
            *((v.named(*ends), name) for name, ends in FALLBACK),
        ],
        UNKNOWN,
    )


def detect(data: bytes, hint: str = "") -> str:
    """The name of the format of one value; hint is a file name."""
    listed = _listed(data) if data[:4] == ZIP else None
    return _rules(_Package(data, hint, *listed) if listed else _Bytes(data, hint))


def detect_column(content: Column, hint: Column) -> Column:
    """The same for binary and string columns, but that marks of packages are looked for in all their bytes. Null or empty content is Unknown."""
    return _rules(_Columns(content, hint))


def detect_sql(content: str, hint: str) -> str:
    """The same as an SQL expression over text."""
    return _rules(_Sql(content, hint))


def family_column(name: Column) -> Column:
    return _Columns.first([(name == f.name, f.family) for f in FORMATS], "unknown")
