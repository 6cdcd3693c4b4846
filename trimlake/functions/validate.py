"""Whether an optimised file still is one of its format."""

from __future__ import annotations

from trimlake.functions import pdf_bytes, rtf_text
from trimlake.functions.codec import Refused
from trimlake.functions.detect import BY_NAME, OOXML
from trimlake.functions.xml_text import is_balanced
from trimlake.sources.zip_parts import read_zip


def _package(data: bytes, needed: tuple[str, ...], all_xml: bool) -> bool:
    try:
        parts = {p.name: p.data.decode("latin-1") for p in read_zip(data)}
    except Refused:
        return False
    return all(n in parts for n in needed) and (not all_xml or all(is_balanced(x) for n, x in parts.items() if n.endswith((".xml", ".rels"))))


def validate(data: bytes, name: str) -> bool:
    """Structure checks by format; empty is invalid, formats without a check are valid."""
    if not data:
        return False
    family = BY_NAME[name].family if name in BY_NAME else ""
    if family in OOXML:
        return _package(data, ("[Content_Types].xml", "_rels/.rels"), True)
    if family == "odf":
        return _package(data, ("mimetype", "content.xml"), True)
    if family == "epub":
        return _package(data, ("mimetype", "META-INF/container.xml"), False)
    text = data.decode("latin-1")
    checks = {
        "PDF": lambda: pdf_bytes.is_valid(data),
        "PNG": lambda: data.startswith(b"\x89PNG\r\n\x1a\n") and b"IEND" in data,
        "JPEG": lambda: data.startswith(b"\xff\xd8") and data.endswith(b"\xff\xd9"),
        "SVG": lambda: is_balanced(text),
        "FODT": lambda: is_balanced(text),
        "HTML": lambda: any(m in text for m in ("<html", "<!doctype", "<!DOCTYPE")),
        "RTF": lambda: rtf_text.is_valid(text),
    }
    return checks.get(name, lambda: True)()
