"""One document: detect, optimise, validate, keep the smallest valid candidate, report."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

from trimlake.functions.codec import Refused, optimize_image
from trimlake.functions.detect import BY_NAME, OOXML, UNKNOWN, detect
from trimlake.functions.html_text import optimize_html
from trimlake.functions.pdf_bytes import optimize_pdf
from trimlake.functions.rtf_text import optimize_rtf
from trimlake.functions.validate import validate
from trimlake.functions.xml_text import is_balanced, minify
from trimlake.operators import odf_epub, ooxml
from trimlake.operators.ooxml import EMBEDDED, Options
from trimlake.operators.package import Package
from trimlake.sources.zip_parts import read_zip, write_zip

SIGNATURES = ("_xmlsignatures/", "META-INF/documentsignatures.xml")
AS_IT_IS = "Already optimal or no lossless reduction possible"


@dataclass
class Result:
    data: bytes
    format: str
    success: bool
    original_size: int
    optimized_size: int
    candidates: int = 0
    saved: dict[str, int] = field(default_factory=dict)
    message: str = ""

    @property
    def bytes_saved(self) -> int:
        return max(0, self.original_size - self.optimized_size)

    @property
    def percent(self) -> float:
        return 100.0 * self.bytes_saved / self.original_size if self.bytes_saved else 0.0


def _embedded(p: Package, options: Options, office: bool) -> int:
    """Packages inside a package, each optimised as a document of its own, to a bounded depth."""
    saved = 0
    if options.depth > 0:
        inner = Options(options.fast, options.drop_metadata, options.risky, options.subset_fonts, options.depth - 1)
        for n, part in p.parts.items():
            if ("/embeddings/" in f"/{n}" and n.endswith(EMBEDDED)) if office else part.data.startswith(b"PK\x03\x04"):
                new = optimize(part.data, n, inner).data
                if len(new) < len(part.data):
                    saved += len(part.data) - len(new)
                    part.data = new
    return saved


def _packages(data: bytes, name: str, options: Options) -> tuple[list[bytes], dict[str, int], str]:
    family = BY_NAME[name].family
    plain = Package.of(read_zip(data))
    if any(n.startswith(SIGNATURES) for n in plain.parts):
        return [], {}, "Signed package preserved"
    p = plain.copy()
    if family in OOXML:
        runs = {"A", "W" if family == "word" else "X" if family == "sheet" else ""}
        passes = [(k, f) for k, on, needs, f in ooxml.PASSES if on in runs and (not needs or getattr(options, needs))]
    else:
        passes = odf_epub.EPUB_PASSES if family == "epub" else odf_epub.ODF_PASSES
        passes = [(k, f) for k, f in passes if options.drop_metadata or k != "Metadata Cleanup"]
    for key, f in passes:
        p.note(key, f(p) if f else _embedded(p, options, family in OOXML))
    out = [write_zip(list(p.parts.values()))]
    if family in OOXML and not options.fast:
        out.append(write_zip(list(plain.parts.values())))
    return out, p.saved, ""


def candidates(data: bytes, name: str, options: Options) -> tuple[list[bytes], dict[str, int], str]:
    """Rewritten forms in order of preference, what each pass saved, and a message."""
    family = BY_NAME[name].family if name in BY_NAME else ""
    if family in OOXML or family in ("odf", "epub"):
        return _packages(data, name, options)
    text = data.decode("latin-1")
    if name == "PDF":
        new, message = optimize_pdf(data)
        return [new], {"PDF Optimization": len(data) - len(new)}, message
    if name == "RTF":
        new = optimize_rtf(text).encode("latin-1")
        return [new], {"RTF Optimization": len(data) - len(new)}, ""
    if name == "HTML":
        page, saved = optimize_html(text)
        return [page.encode("latin-1")], saved, ""
    if name == "FODT":
        new = odf_epub._minify_odf(text) if is_balanced(text) else text
        return [new.encode("latin-1")], {"XML Minification": len(text) - len(new)}, ""
    if name == "SVG":
        new = minify(text) if is_balanced(text) else text
        return [new.encode("latin-1")], {"Image Optimization": len(text) - len(new)}, ""
    if family == "image":
        new = optimize_image(data, BY_NAME[name].extension)
        return [new], {"Image Optimization": len(data) - len(new)}, ""
    return [], {}, ""


def optimize(data: bytes, hint: str = "", options: Options | None = None) -> Result:
    """The smallest valid candidate that is strictly smaller than the input, the first of equals; else the input.

    Nothing raises: input that can't be read is returned with a message.
    """
    name = detect(data, hint)
    out = Result(data, name, False, len(data), len(data))
    if not data:
        out.message = "Empty input"
        return out
    if name == UNKNOWN:
        out.message = "Unknown format"
        return out
    try:
        tries, saved, message = candidates(data, name, options or Options())
    except (Refused, ValueError, KeyError, IndexError, OverflowError, RecursionError, struct.error) as e:
        out.message = f"Left as it is: {type(e).__name__}"
        return out
    out.candidates, out.saved, out.message = len(tries), {k: v for k, v in saved.items() if v > 0}, message or AS_IT_IS
    for new in tries:
        if len(new) < out.optimized_size and validate(new, name):
            out.data, out.optimized_size, out.success, out.message = new, len(new), True, ""
    return out
