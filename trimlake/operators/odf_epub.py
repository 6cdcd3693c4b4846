"""Passes over OpenDocument packages and e-books."""

from __future__ import annotations

import hashlib
import posixpath
import re
from collections.abc import Callable
from urllib.parse import unquote

from trimlake.functions.xml_text import drop_repeated_namespaces, is_balanced, minify, minify_css
from trimlake.operators.ooxml import images
from trimlake.operators.package import Package, attributes

MANIFEST = "META-INF/manifest.xml"
#: Metadata elements that go.
ODF_META = ("meta:generator", "meta:initial-creator", "dc:creator", "meta:creation-date", "dc:date", "meta:editing-cycles", "meta:editing-duration")
THUMBNAIL = "Thumbnails/thumbnail.png"
#: What an e-book's pages end in.
PAGES = (".xhtml", ".html", ".htm", ".css", ".ncx", ".svg")


def odf_metadata(p: Package) -> int:
    if "meta.xml" not in p.parts:
        return 0
    tags = "|".join([*(rf"<{t}(?:\s[^>]*)?>[^<]*</{t}>" for t in ODF_META), r"<meta:document-statistic\b[^>]*/>"])
    return p.put("meta.xml", re.sub(tags, "", p.text("meta.xml")))


def _unlist(p: Package, names: set[str]) -> None:
    if MANIFEST in p.parts:
        p.force(MANIFEST, re.sub(r"<manifest:file-entry\b[^>]*/>", lambda m: "" if attributes(m[0]).get("manifest:full-path") in names else m[0], p.text(MANIFEST)))


def odf_thumbnail(p: Package) -> int:
    if THUMBNAIL not in p.parts:
        return 0
    n = len(p.parts.pop(THUMBNAIL).data)
    _unlist(p, {THUMBNAIL})
    return n


def odf_empty_folders(p: Package) -> int:
    empty = {n for n in p.names("Configurations2/", "/") if not p.parts[n].data}
    for n in empty:
        del p.parts[n]
    _unlist(p, empty)
    return 0


def odf_hidden(p: Package) -> int:
    """Frames of no size, and annotations without content."""
    if "content.xml" not in p.parts:
        return 0
    zero = r"(?=[^>]*\ssvg:width=\"0cm\")(?=[^>]*\ssvg:height=\"0cm\")"
    rules = rf"<draw:frame\b{zero}[^>]*/>|<draw:frame\b{zero}[^>]*(?<!/)>(?:(?!<draw:frame).)*?</draw:frame>|<office:annotation\b[^>]*(?<!/)>\s*</office:annotation>"
    return p.put("content.xml", re.sub(rules, "", p.text("content.xml"), flags=re.S))


def duplicate_media(p: Package, folders: tuple[str, ...], pages: tuple[str, ...]) -> int:
    """Media with equal bytes: the first stays; links to the others, resolved from the page that has them, lead to it."""
    first: dict[tuple[bytes, int, str], str] = {}
    to: dict[str, str] = {}
    for n in p.parts:
        if n.startswith(folders) or any(f"/{f}" in f"/{n}" for f in folders):
            data = p.parts[n].data
            key = (hashlib.sha256(data).digest(), len(data), n.rpartition(".")[2].lower())
            if data and first.setdefault(key, n) != n:
                to[n] = first[key]
    if not to:
        return 0
    for n in [x for x in p.parts if x.endswith(pages)]:
        home = posixpath.dirname(n)

        def lead(m: re.Match, home: str = home) -> str:
            path = posixpath.normpath(posixpath.join(home, unquote(m[2])))
            return m[1] + posixpath.relpath(to[path], home or ".") + m[3] if path in to else m[0]

        p.force(n, re.sub(r"(\b(?:xlink:href|src|href)=\")([^\"#]+)((?:#[^\"]*)?\")", lead, p.text(n)))
    gone = sum(len(p.parts.pop(n).data) for n in to)
    _unlist(p, set(to))
    for n in p.names(suffix=".opf"):
        home = posixpath.dirname(n)
        seen: set[str] = set()

        def item(m: re.Match, home: str = home, seen: set[str] = seen) -> str:
            path = posixpath.normpath(posixpath.join(home, unquote(attributes(m[0]).get("href", ""))))
            again = path in seen and path in first.values()
            seen.add(path)
            return "" if path in to or again else m[0]

        p.force(n, re.sub(r"<item\b[^>]*/>", item, p.text(n)))
    return gone


def odf_duplicates(p: Package) -> int:
    return duplicate_media(p, ("Pictures/",), ("content.xml", "styles.xml"))


def odf_images(p: Package) -> int:
    return images(p, "/Pictures/")


def odf_markup(p: Package) -> int:
    saved = 0
    for n, x in list(p.texts()):
        if is_balanced(x) and n != MANIFEST:
            saved += p.put(n, _minify_odf(x))
    return saved


def _minify_odf(xml: str) -> str:
    """Blanks between the spans of a paragraph count: only namespaces and tags are shortened there."""
    return drop_repeated_namespaces(xml) if "<text:" in xml else minify(drop_repeated_namespaces(xml))


def epub_orphans(p: Package) -> int:
    """Images of the manifest that nothing refers to, then files that the manifest doesn't list. META-INF stays whole: encryption and rights live there."""
    books = p.names(suffix=".opf")
    if len(books) != 1:
        return 0
    opf, home = books[0], posixpath.dirname(books[0])
    resolve = lambda base, href: posixpath.normpath(posixpath.join(base, unquote(href.partition("#")[0])))
    used = set()
    for n in [x for x in p.parts if x.lower().endswith(PAGES)]:
        x = p.text(n)
        links = [*re.findall(r"\b(?:src|href|xlink:href|poster|data)\s*=\s*[\"']([^\"']+)[\"']", x), *re.findall(r"url\(\s*[\"']?([^\"')]+)", x)]
        used |= {resolve(posixpath.dirname(n), v) for v in links}
        used |= {resolve(posixpath.dirname(n), v.strip().split()[0]) for s in re.findall(r"\bsrcset\s*=\s*[\"']([^\"']+)[\"']", x) for v in s.split(",") if v.strip()}
    xml = p.text(opf)
    cover = set(re.findall(r"<meta\b[^>]*\bname=\"cover\"[^>]*\bcontent=\"([^\"]+)\"", xml)) | set(re.findall(r"<meta\b[^>]*\bcontent=\"([^\"]+)\"[^>]*\bname=\"cover\"", xml))
    gone: set[str] = set()

    def item(m: re.Match) -> str:
        a = attributes(m[0])
        path = resolve(home, a.get("href", ""))
        if a.get("media-type", "").startswith("image/") and path not in used and a.get("id") not in cover and "cover-image" not in a.get("properties", ""):
            gone.add(path)
            return ""
        return m[0]

    new = re.sub(r"<item\b[^>]*/>", item, xml)
    listed = {resolve(home, attributes(t).get("href", "")) for t in re.findall(r"<item\b[^>]*/?>", new)}
    stray = {n for n in p.parts if n != "mimetype" and n != opf and not n.startswith("META-INF/") and not n.endswith("/") and n not in listed}
    if not is_balanced(new):
        return 0
    p.force(opf, new)
    return sum(len(p.parts.pop(n).data) for n in gone | stray if n in p.parts)


def epub_duplicates(p: Package) -> int:
    return duplicate_media(p, ("images/",), PAGES)


def epub_images(p: Package) -> int:
    return sum(images(p, f) for f in ("/images/", "/Images/", "/image/", "/media/"))


def epub_markup(p: Package) -> int:
    """Packages and tables of contents lose layout blanks; pages keep theirs, as blanks between words and in preformatted text count."""
    saved = 0
    for n in list(p.parts):
        x = p.text(n)
        if n.endswith(".css"):
            new = minify_css(x)
            if len(new) < len(x):
                saved += len(x) - len(new)
                p.force(n, new)
        elif n.endswith((".opf", ".ncx", ".xml")) and is_balanced(x):
            saved += p.put(n, minify(x))
        elif n.endswith((".xhtml", ".html", ".htm")) and is_balanced(x):
            saved += p.put(n, drop_repeated_namespaces(re.sub(r"(?s)<!--(?!\[if).*?-->", "", x)))
    return saved


ODF_PASSES: tuple[tuple[str, Callable[[Package], int]], ...] = (
    ("Metadata Cleanup", odf_metadata), ("Thumbnail Removal", odf_thumbnail), ("Empty Folders", odf_empty_folders), ("Hidden Objects Pruning", odf_hidden),
    ("Media Deduplication", odf_duplicates), ("Image Optimization", odf_images), ("Embedded Package Optimization", None), ("XML Minification", odf_markup),
)
EPUB_PASSES: tuple[tuple[str, Callable[[Package], int]], ...] = (
    ("Orphan Asset Pruning", epub_orphans), ("Media Deduplication", epub_duplicates), ("Image Optimization", epub_images), ("Markup Minification", epub_markup),
)
