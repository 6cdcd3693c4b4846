"""Passes over office packages, in the order in which they run. Each takes a package and returns bytes saved (raw, not compressed).

A text change counts only if the part gets smaller and stays balanced. Passes that change what a reader may see, or
drop data, run only where the options ask for them.
"""

from __future__ import annotations

import hashlib
import posixpath
import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

from trimlake.functions.codec import Refused, deobfuscate_font, optimize_image, subset_font
from trimlake.functions.xml_text import drop_repeated_namespaces, is_balanced, merge_runs, minify, remove_attributes
from trimlake.operators.package import TYPES, Package, Relation, attributes


@dataclass(frozen=True)
class Options:
    fast: bool = False  # one candidate instead of two
    drop_metadata: bool = True
    risky: bool = False  # settings, theme, run and paragraph properties
    subset_fonts: bool = False
    depth: int = 3  # of embedded packages


#: Fixed values of the formats: core and application properties that go.
CORE_TAGS = ("dc:creator", "cp:lastModifiedBy", "cp:revision", "dcterms:created", "dcterms:modified", "cp:category", "dc:description")
APP_TAGS = ("TotalTime", "Application", "AppVersion", "Company", "Manager")
#: Revision attributes.
RSIDS = ("w:rsidR", "w:rsidRDefault", "w:rsidP", "w:rsidRPr", "w:rsidTr", "w:rsidDel")
#: Styles that always stay.
BASE_STYLES = ("Normal", "DefaultParagraphFont", "TableNormal", "NoList")
#: Settings that the settings pass deletes.
SETTINGS = (
    "w:proofState", "w:savePreviewPicture", "w:doNotShadeFormData", "w:formsDesign", "w:linkStyles", "w14:docId", "w:useFELayout",
    "w:balanceSingleByteDoubleByteWidth", "w:doNotLeaveBackslashAlone", "w:ulTrailSpace", "w:doNotExpandShiftReturn",
    "w:adjustLineHeightInTable", "w:applyBreakingRules", "w:doNotWrapTextWithPunct", "w:doNotUseEastAsianBreakRules", "w:growAutofit",
    "w:useNormalStyleForList", "w:doNotUseIndentAsNumberingTabStop", "w:useAltKinsokuLineBreakRules", "w:allowSpaceOfSameStyleInTable",
    "w:doNotSuppressIndentation", "w:doNotAutofitConstrainedTables", "w:autofitToFirstFixedWidthCell", "w:underlineTabInNumList",
    "w:displayHangulFixedWidth", "w:splitPgBreakAndParaMark", "w:doNotVertAlignCellWithSp", "w:doNotBreakConstrainedForcedTable",
    "w:doNotVertAlignInTxbx", "w:useAnsiKerningPairs", "w:cachedColBalance",
)
#: on/off elements, and attributes that hold a measure.
ON_OFF = (
    "b", "i", "caps", "smallCaps", "strike", "dstrike", "outline", "shadow", "emboss", "imprint", "vanish", "webHidden", "keepNext", "keepLines",
    "pageBreakBefore", "widowControl", "suppressAutoHyphens", "autoHyphenation", "cantSplit", "tblHeader", "noWrap", "contextualSpacing",
    "mirrorIndents", "suppressOverlap", "kinsoku", "overflowPunct", "topLinePunct", "autoSpaceDE", "autoSpaceDN", "adjustRightInd", "snapToGrid",
)
MEASURES = ("w", "left", "right", "top", "bottom", "before", "after", "line", "firstLine", "hanging", "start", "end", "space", "header", "footer", "gutter")
#: Drawing attributes whose value is the default, and drawing elements that may be written short.
DRAWING_FLAGS = ("flipH", "flipV", "noGrp", "noSelect", "noRot", "noChangeAspect", "noMove", "noResize", "noEditPoints", "noAdjustHandles", "noChangeArrowheads", "noChangeShapeType")
DRAWING_EMPTY = ("a:avLst", "a:extLst", "a:effectLst", "a:spPr")
DRAWING_MARKS = ("<a:", "<wp:", "<xdr:", "<p:sp")
#: What shows that a header or footer isn't empty.
SUBSTANCE = ("<w:drawing", "<w:fldSimple", "<w:fldChar", "<w:instrText", "<w:pict", "<w:object")
MEDIA = ("/media/", "/embeddings/", "/customPayload/")
EMBEDDED = (".xlsx", ".docx", ".pptx", ".xlsm", ".docm", ".pptm")


def _element(name: str) -> str:
    return rf"<{name}(?=[\s/>])[^>]*(?:/>|(?<!/)>.*?</{name}>)"


def _val(xml: str, name: str) -> str | None:
    m = re.search(rf"<{name}(?=[\s/>])[^>]*\bw:val=\"([^\"]*)\"", xml)
    return m[1] if m else None


def thumbnails(p: Package) -> int:
    return p.drop({n for n in p.names("docProps/thumbnail.")})


def metadata(p: Package) -> int:
    saved = 0
    for name, tags in (("docProps/core.xml", CORE_TAGS), ("docProps/app.xml", APP_TAGS)):
        if name in p.parts:
            saved += p.put(name, re.sub("|".join(rf"<{t}(?:\s[^>]*)?>[^<]*</{t}>" for t in tags), "", p.text(name)))
    custom = p.text("docProps/custom.xml")
    if custom is not None and "<property" not in custom:
        saved += p.drop({"docProps/custom.xml"})
    return saved


def rsids(p: Package) -> int:
    saved = 0
    for name, xml in p.texts("word/"):
        new = remove_attributes(xml, RSIDS)
        if name == "word/settings.xml":
            new = re.sub(r"<w:rsids>.*?</w:rsids>", "", new, flags=re.S)
        saved += p.put(name, new)
    return saved


_STYLE = re.compile(r"<w:style(?=[\s>])[^>]*(?:/>|(?<!/)>.*?</w:style>)", re.S)


def styles(p: Package) -> int:
    """Styles that neither the text, nor a default, nor a kept style leads to. A fixpoint over based-on, next and link edges."""
    if "word/styles.xml" not in p.parts:
        return 0
    tables = [n for n in ("word/styles.xml", "word/stylesWithEffects.xml") if n in p.parts]
    used = set(BASE_STYLES)
    for name, xml in p.texts("word/"):
        if name not in tables:
            used |= set(re.findall(r"<w:\w*Style(?:Link)?(?=\s)[^>]*\bw:val=\"([^\"]+)\"", xml))
    saved = 0
    for name in tables:
        xml = re.sub(_element("w:latentStyles"), "", p.text(name), flags=re.S)
        edges: dict[str, set[str]] = {}
        queue = list(used)
        for s in _STYLE.findall(xml):
            a = attributes(s[: s.index(">")])
            own = a.get("w:styleId", "")
            edges[own] = {v for t in ("w:basedOn", "w:next", "w:link") if (v := _val(s, t))}
            if a.get("w:default") in ("1", "true"):
                queue.append(own)
        kept: set[str] = set()
        while queue:
            s = queue.pop()
            if s not in kept:
                kept.add(s)
                queue += edges.get(s, ())
        saved += p.put(name, _STYLE.sub(lambda m, kept=kept: m[0] if attributes(m[0][: m[0].index(">")]).get("w:styleId", "") in kept else "", xml))
    return saved


def numbering(p: Package) -> int:
    """Numbering that no paragraph or style uses: semi joins from numbers used to their definitions."""
    name = "word/numbering.xml"
    if name not in p.parts:
        return 0
    used = {v for n, xml in p.texts("word/") if n != name for v in re.findall(r"<w:numId\b[^>]*\bw:val=\"([^\"]+)\"", xml)}
    if not used:
        return p.drop({name})
    xml = p.text(name)
    num = re.compile(r"<w:num(?=\s)[^>]*>.*?</w:num>", re.S)
    key = lambda s, a: attributes(s[: s.index(">")]).get(a)
    abstract = {_val(s, "w:abstractNumId") for s in num.findall(xml) if key(s, "w:numId") in used}
    xml = num.sub(lambda m: m[0] if key(m[0], "w:numId") in used else "", xml)
    body = re.compile(r"<w:abstractNum(?=\s)[^>]*>.*?</w:abstractNum>", re.S)
    # A definition that takes its levels from a style's numbering is kept: the style leads on from there.
    return p.put(name, body.sub(lambda m: m[0] if key(m[0], "w:abstractNumId") in abstract or "<w:styleLink" in m[0] else "", xml))


_CHILD = re.compile(r"<([\w:]+)((?:\s[^>]*?)?)(?:/>|>(.*?)</\1>)", re.S)


def _children(xml: str) -> list[tuple[str, tuple, str]]:
    """Child elements of an inner text, as (what they say, comparable; name; source)."""
    return [((m[1], tuple(sorted(attributes(m[2]).items())), (m[3] or "").strip()), m[1], m[0]) for m in _CHILD.finditer(xml)]


def _style_children(p: Package, holder: str) -> tuple[dict[str, set], dict[str, str]]:
    """What each style says itself in its pPr or rPr, and the default style of each type."""
    own, default = {}, {}
    for s in _STYLE.findall(p.text("word/styles.xml") or ""):
        a = attributes(s[: s.index(">")])
        m = re.search(rf"<{holder}(?=[\s>])[^>]*(?<!/)>(.*?)</{holder}>", s, re.S)
        own[a.get("w:styleId", "")] = {c[0] for c in _children(m[1])} if m else set()
        if a.get("w:default") in ("1", "true"):
            default[a.get("w:type", "")] = a.get("w:styleId", "")
    return own, default


def paragraph_properties(p: Package) -> int:
    """Paragraph properties that the paragraph's own style says too. Numbering, sections and run properties stay."""
    own, default = _style_children(p, "w:pPr")
    base = default.get("paragraph", "")
    saved = 0

    def lift(m: re.Match) -> str:
        inner = m[1]
        style = _val(inner, "w:pStyle")
        says = own.get(style or base, set())
        for what, name, source in _children(inner):
            if name in ("w:numPr", "w:sectPr", "w:rPr", "w:pPrChange"):
                continue
            if name == "w:pStyle" and style == base or name != "w:pStyle" and what in says:
                inner = inner.replace(source, "", 1)
        return f"<w:pPr>{inner}</w:pPr>" if inner.strip() else ""

    for name, xml in p.texts("word/"):
        if name not in ("word/styles.xml", "word/numbering.xml") and "<w:pPrChange" not in xml:
            saved += p.put(name, re.sub(r"<w:pPr>((?:(?!</w:pPr>).)*)</w:pPr>", lift, xml, flags=re.S))
    return saved


def table_widths(p: Package) -> int:
    """Cell widths that equal their grid column's. Only tables without tables inside are looked at."""
    saved = 0

    def table(t: re.Match) -> str:
        grid = re.findall(r"<w:gridCol\b[^>]*\bw:w=\"(\d+)\"", t[0])

        def row(r: re.Match) -> str:
            at = int(_val(r[0], "w:gridBefore") or 0)

            def cell(c: re.Match) -> str:
                nonlocal at
                span, own = int(_val(c[0], "w:gridSpan") or 1), at
                at += span
                w = re.search(r"<w:tcW\b[^>]*/>", c[0])
                a = attributes(w[0]) if w else {}
                if span == 1 and own < len(grid) and a.get("w:type", "dxa") == "dxa" and a.get("w:w") == grid[own]:
                    return re.sub(r"<w:tcPr>\s*</w:tcPr>", "", c[0].replace(w[0], "", 1), count=1)
                return c[0]

            return re.sub(r"<w:tc(?=[\s>])[^>]*>.*?</w:tc>", cell, r[0], flags=re.S)

        return re.sub(r"<w:tr(?=[\s>])[^>]*>.*?</w:tr>", row, t[0], flags=re.S)

    for name, xml in p.texts("word/"):
        saved += p.put(name, re.sub(r"<w:tbl>(?:(?!<w:tbl>).)*?</w:tbl>", table, xml, flags=re.S))
    return saved


def run_properties(p: Package, least: int = 10, share: float = 0.7) -> int:
    """Run properties that the run's character style says too (on/off ones stay: styles combine them), and the language that most runs state,
    which goes into the default run properties if none is there."""
    own, _ = _style_children(p, "w:rPr")
    pages = [(n, x) for n, x in p.texts("word/") if n not in ("word/styles.xml", "word/numbering.xml") and "<w:rPrChange" not in x]
    langs = Counter(v for _, x in pages for v in re.findall(r"<w:lang w:val=\"([^\"]+)\"/>", x))
    table = p.text("word/styles.xml")
    top = None
    if table and langs:
        lang, n = min(langs.items(), key=lambda kv: (-kv[1], kv[0]))
        holder = re.search(r"<w:rPrDefault>\s*<w:rPr>(.*?)</w:rPr>", table, re.S)
        if n >= least and n >= share * sum(langs.values()) and holder and "<w:lang" not in holder[1]:
            top = lang
    toggles = {f"w:{t}" for t in ON_OFF}

    def strip(m: re.Match) -> str:
        inner = m[1]
        says = own.get(_val(inner, "w:rStyle") or "", set())
        for what, name, source in _children(inner):
            if name not in toggles and name != "w:rStyle" and what in says or top and source == f'<w:lang w:val="{top}"/>':
                inner = inner.replace(source, "", 1)
        return f"<w:rPr>{inner}</w:rPr>" if inner.strip() else ""

    new = {n: re.sub(r"<w:rPr>((?:(?!</w:rPr>).)*)</w:rPr>", strip, x, flags=re.S) for n, x in pages}
    added = f'<w:lang w:val="{top}"/>' if top else ""
    gain = sum(len(x) - len(new[n]) for n, x in pages) - len(added)
    if gain <= 0 or not all(map(is_balanced, new.values())):
        return 0
    for n in new:
        p.force(n, new[n])
    if top:
        p.force("word/styles.xml", re.sub(r"(<w:rPrDefault>\s*<w:rPr>.*?)(</w:rPr>)", lambda m: m[1] + added + m[2], table, count=1, flags=re.S))
    return gain


def custom_xml(p: Package) -> int:
    """Custom data that no content control is bound to."""
    if any("dataBinding" in xml for _, xml in p.texts("word/")):
        return 0
    return p.drop({n for n in p.names("customXml/") if not n.endswith(".rels")})


#: The plainest format scheme that the schema allows: three of each list.
PLAIN_FORMATS = (
    '<a:fmtScheme name="Plain"><a:fillStyleLst>{f}</a:fillStyleLst><a:lnStyleLst>{l}</a:lnStyleLst><a:effectStyleLst>{e}</a:effectStyleLst><a:bgFillStyleLst>{f}</a:bgFillStyleLst></a:fmtScheme>'
).format(f='<a:solidFill><a:schemeClr val="phClr"/></a:solidFill>' * 3, l='<a:ln><a:solidFill><a:schemeClr val="phClr"/></a:solidFill></a:ln>' * 3, e="<a:effectStyle><a:effectLst/></a:effectStyle>" * 3)


def theme(p: Package) -> int:
    """A plain format scheme where nothing refers to the theme's; fonts and colours stay."""
    if any(t in xml for n, xml in p.texts("word/") if "/theme/" not in n for t in ("fillRef", "effectRef", "lnRef")):
        return 0
    return sum(p.put(n, re.sub(r"<a:fmtScheme\b.*?</a:fmtScheme>", lambda m: PLAIN_FORMATS, x, flags=re.S)) for n, x in list(p.texts("word/theme/")))


def empty_headers(p: Package) -> int:
    """Headers and footers without content, with the references to them: by owner and relationship, not by id alone."""
    empty = {
        n for prefix in ("word/header", "word/footer") for n, xml in p.texts(prefix)
        if not any(t in xml for t in SUBSTANCE) and not any(t.strip(" \r\n\t") for t in re.findall(r"<w:t(?:\s[^>]*)?(?<!/)>([^<]*)</w:t>", xml))
    }
    leads = [r for r in p.relations() if r.path in empty]
    # A section without a header of its own shows the one before: only headers that no later section could uncover go.
    for source in {r.source for r in leads}:
        if len(re.findall(r"<w:sectPr\b", p.text(source) or "")) > 1:
            empty -= {r.path for r in leads if r.source == source}
    leads = [r for r in leads if r.path in empty]
    for r in leads:
        xml = p.text(r.source)
        if xml is not None:
            p.force(r.source, re.sub(rf"<w:(?:header|footer)Reference\b[^>]*\br:id=\"{re.escape(r.id)}\"[^>]*/>", "", xml))
    return p.drop(empty)


def font_table(p: Package) -> int:
    """Fonts named twice, or by nothing; descriptions of fonts that aren't embedded."""
    name = "word/fontTable.xml"
    if name not in p.parts:
        return 0
    used = {v for n, x in p.texts("word/") if n != name for v in re.findall(r"\bw:(?:ascii|hAnsi|eastAsia|cs)=\"([^\"]+)\"", x)}
    used |= {v for n, x in p.texts("word/theme/") for v in re.findall(r"\btypeface=\"([^\"]+)\"", x)}
    seen: set[str] = set()

    def one(m: re.Match) -> str:
        font = attributes(m[0][: m[0].index(">")]).get("w:name", "")
        if font in seen or used and font not in used:
            return ""
        seen.add(font)
        if "embed" in m[0]:
            return m[0]
        inner = re.sub(r"<w:(?:panose1|charset|family|pitch|sig)\b[^>]*/>", "", m[1] or "")
        return f'<w:font w:name="{font}">{inner}</w:font>' if inner.strip() else f'<w:font w:name="{font}"/>'

    return p.put(name, re.sub(r"<w:font(?=\s)[^>]*(?:/>|(?<!/)>(.*?)</w:font>)", one, p.text(name), flags=re.S))


def settings(p: Package) -> int:
    name = "word/settings.xml"
    return p.put(name, re.sub(rf"<(?:{'|'.join(SETTINGS)})(?=[\s/])[^>]*/>", "", p.text(name))) if name in p.parts else 0


def bookmarks(p: Package) -> int:
    """Bookmarks that applications set and nothing refers to: an anti join of names on references, then a deletion by id."""
    pages = dict(p.texts("word/"))
    used = {v for x in pages.values() for v in re.findall(r"\b(?:w:)?anchor=\"([^\"]+)\"", x)}
    used |= {v for x in pages.values() for v in re.findall(r"(?:REF|PAGEREF|NOTEREF)\s+(?:\\?[a-zA-Z]\s+)*(?:&quot;|\")?([_a-zA-Z0-9]+)", x)}
    saved = 0
    for name, xml in pages.items():
        starts = [attributes(t) for t in re.findall(r"<w:bookmarkStart\b[^>]*/>", xml)]
        gone = {a.get("w:id") for a in starts if (b := a.get("w:name", "")) == "_GoBack" or b.startswith(("_Toc", "_Ref", "_Hlk")) and b not in used}
        if gone:
            saved += p.put(name, re.sub(r"<w:bookmark(?:Start|End)\b[^>]*/>", lambda m, gone=gone: "" if attributes(m[0]).get("w:id") in gone else m[0], xml))
    return saved


_FLAG = re.compile(rf"<w:({'|'.join(ON_OFF)}) w:val=\"(true|1|on|false|off)\"\s*/>")
_ZERO = re.compile(rf"(?<=\s)(w:(?:{'|'.join(MEASURES)}))=\"(?:-?0(?:\.0+)?(?:pt|px|dxa)?|00+)\"")


def literals(p: Package) -> int:
    short = lambda m: f"<w:{m[1]}/>" if m[2] in ("true", "1", "on") else f'<w:{m[1]} w:val="0"/>'
    return sum(p.put(n, _ZERO.sub(r'\1="0"', _FLAG.sub(short, x))) for n, x in list(p.texts("word/")))


_SI = re.compile(r"<si(?=[\s>])[^>]*(?<!/)>.*?</si>|<si\s*/>", re.S)
_CELL = re.compile(r"(<c(?=\s)[^>]*\bt=\"s\"[^>]*>(?:(?!</c>).)*?<v>)(\d+)(</v>)", re.S)


def shared_strings(p: Package) -> int:
    """Strings that cells use, once each, in first order of the table; cells renumbered. Table and sheets change together or not at all."""
    name = "xl/sharedStrings.xml"
    if name not in p.parts:
        return 0
    table = p.text(name)
    strings = _SI.findall(table)
    sheets = dict(p.texts("xl/worksheets/sheet"))
    uses = [int(m[1]) for x in sheets.values() for m in _CELL.findall(x)]
    if any(k >= len(strings) for k in uses):
        return 0
    kept: dict[str, int] = {}
    for k in sorted(set(uses)):
        kept.setdefault(strings[k], len(kept))
    head, tail = table[: table.index("<si")] if strings else table, table[table.rindex("</sst>") :] if "</sst>" in table else ""
    if not strings or not tail or len(kept) == len(strings):
        return 0
    head = re.sub(r"\buniqueCount=\"\d+\"", f'uniqueCount="{len(kept)}"', re.sub(r"\bcount=\"\d+\"", f'count="{len(uses)}"', head))
    new = {name: head + "".join(kept) + tail}
    new |= {n: _CELL.sub(lambda m: f"{m[1]}{kept[strings[int(m[2])]]}{m[3]}", x) for n, x in sheets.items()}
    gain = sum(len(p.parts[n].data) - len(x) for n, x in new.items())
    if gain <= 0 or not all(map(is_balanced, new.values())):
        return 0
    for n, x in new.items():
        p.force(n, x)
    return gain


def fonts(p: Package) -> int:
    """Embedded fonts reduced to the characters of the text. Each obfuscated font has its own key, found by relationship."""
    held = [*p.names(suffix=".ttf"), *p.names(suffix=".odttf")]
    if not held:
        return 0
    text = " ".join(t for prefix in ("word/", "xl/", "ppt/") for _, x in p.texts(prefix) for t in re.findall(r"<[wa]?:?t(?:\s[^>]*)?(?<!/)>([^<]*)</[wa]?:?t>", x))
    plain = re.sub(r"&#(x?)([0-9A-Fa-f]+);", lambda m: chr(int(m[2], 16 if m[1] else 10)), text.encode("latin-1").decode("utf-8", "replace"))
    points = set(map(ord, set(plain + "&<>\"' ")))
    keys = {}
    for tag in re.findall(r"<w:embed\w+\b[^>]*/>", p.text("word/fontTable.xml") or ""):
        a = attributes(tag)
        for r in p.relations():
            if r.source == "word/fontTable.xml" and r.id == a.get("r:id"):
                keys[r.path] = a.get("w:fontKey", "")
    saved = 0
    for n in held:
        data = p.parts[n].data
        try:
            new = deobfuscate_font(subset_font(deobfuscate_font(data, keys[n]), points), keys[n]) if n.endswith(".odttf") else subset_font(data, points)
        except (Refused, KeyError):
            continue
        if len(new) < len(data):
            saved += len(data) - len(new)
            p.parts[n].data = new
    return saved


def orphans(p: Package) -> int:
    """Media, embeddings and payloads that no relationship leads to: an anti join of parts on resolved targets."""
    meant = {r.path for r in p.relations()}
    return p.drop({n for n in p.parts if any(f in f"/{n}" for f in MEDIA) and not n.endswith(".rels") and n not in meant})


def duplicate_media(p: Package) -> int:
    """Media with equal bytes: the first stays, relationships to the others are led to it by resolved path."""
    first: dict[tuple[bytes, int, str], str] = {}
    to: dict[str, str] = {}
    for n in p.parts:
        if "/media/" in f"/{n}":
            data = p.parts[n].data
            key = (hashlib.sha256(data).digest(), len(data), n.rpartition(".")[2].lower())
            if first.setdefault(key, n) != n:
                to[n] = first[key]
    if not to:
        return 0

    def lead(r: Relation) -> str:
        if r.path not in to:
            return r.target
        if r.target.startswith("/"):
            return f"/{to[r.path]}"
        return posixpath.relpath(to[r.path], posixpath.dirname(r.source) or ".")

    p.edit_relations(lead)
    return p.drop(set(to))


def images(p: Package, folder: str = "/media/") -> int:
    saved = 0
    for n in p.parts:
        if folder in f"/{n}":
            new = optimize_image(p.parts[n].data, n.rpartition(".")[2])
            saved += len(p.parts[n].data) - len(new)
            p.parts[n].data = new
    return saved


_DRAWING = re.compile(rf"\s+(?:rot=\"0\"|(?:{'|'.join(DRAWING_FLAGS)})=\"(?:0|false)\")")


def drawings(p: Package) -> int:
    saved = 0
    for n, x in list(p.texts()):
        if any(m in x for m in DRAWING_MARKS):
            new = _DRAWING.sub("", x)
            for e in DRAWING_EMPTY:
                new = re.sub(rf"<{e}>\s*</{e}>", f"<{e}/>", new)
            saved += p.put(n, new)
    return saved


def hidden(p: Package) -> int:
    """Proofing marks, hidden runs without text, and comment marks where there are no comments."""
    rules = [r"<w:proofErr\b[^>]*/>", r"<w:r(?:\s[^>]*)?><w:rPr>(?:(?!</w:rPr>).)*<w:vanish\s*/>(?:(?!</w:rPr>).)*</w:rPr>\s*(?:<w:t(?:\s[^>]*)?(?:/>|></w:t>))?\s*</w:r>"]
    if "word/comments.xml" not in p.parts:
        rules += [r"<w:commentRange(?:Start|End)\b[^>]*/>", r"<w:r(?:\s[^>]*)?>(?:<w:rPr>(?:(?!</w:rPr>).)*</w:rPr>)?\s*<w:commentReference\b[^>]*/>\s*</w:r>"]
    marks = re.compile("|".join(rules), re.S)
    return sum(p.put(n, marks.sub("", x)) for n, x in list(p.texts()) if any(t in x for t in ("<w:proofErr", "<w:vanish", "<w:comment")))


def short_paths(p: Package) -> int:
    """Media under short names of their own: numbers count only files that are renamed, and no name is taken twice."""
    to: dict[str, str] = {}
    taken = set(p.parts)
    count = 0
    for n in sorted(p.parts):
        folder, _, base = n.rpartition("/")
        if not folder.endswith("/media") and folder != "media" or "." not in base:
            continue
        while (new := f"{folder}/{count + 1}.{base.rpartition('.')[2]}") in taken:
            count += 1
        if len(new) < len(n):
            to[n] = new
            taken.add(new)
            count += 1
    if not to:
        return 0
    p.edit_relations(lambda r: r.target[: -len(r.path.rpartition("/")[2])] + to[r.path].rpartition("/")[2] if r.path in to and r.target.endswith(r.path.rpartition("/")[2]) else (f"/{to[r.path]}" if r.path in to else r.target))
    for old, new in to.items():
        part = p.parts[old]
        part.name = new
    p.parts = {part.name: part for part in p.parts.values()}
    if TYPES in p.parts:
        p.force(TYPES, re.sub(r"(\bPartName=\")/([^\"]*)\"", lambda m: f'{m[1]}/{to.get(m[2], m[2])}"', p.text(TYPES)))
    return sum(2 * (len(a) - len(b)) for a, b in to.items())


def content_types(p: Package) -> int:
    """Overrides that agree, two or more and all of an extension, become its default; those that equal a default, or name no part, go."""
    if TYPES not in p.parts:
        return 0
    xml = p.text(TYPES)
    default = {a["Extension"].lower(): a["ContentType"] for t in re.findall(r"<Default\b[^>]*/>", xml) if {"Extension", "ContentType"} <= (a := attributes(t)).keys()}
    over = [attributes(t) for t in re.findall(r"<Override\b[^>]*/>", xml)]
    by: dict[str, list[str]] = {}
    for a in over:
        base = a.get("PartName", "").rpartition("/")[2]
        if "." in base:
            by.setdefault(base.rpartition(".")[2].lower(), []).append(a.get("ContentType", ""))
    # A part without an override takes the default: an extension counts only if each of its parts has one.
    have = Counter(n.rpartition(".")[2].lower() for n in p.parts if "." in n.rpartition("/")[2])
    new = {e: v[0] for e, v in by.items() if e not in default and len(v) >= 2 and len(set(v)) == 1 and have[e] <= len(v)}
    default |= new

    def keep(m: re.Match) -> str:
        a = attributes(m[0])
        part = a.get("PartName", "").lstrip("/")
        ext = part.rpartition(".")[2].lower()
        return "" if part not in p.parts or default.get(ext) == a.get("ContentType") else m[0]

    xml = re.sub(r"<Override\b[^>]*/>", keep, xml)
    added = "".join(f'<Default Extension="{e}" ContentType="{t}"/>' for e, t in new.items())
    return p.put(TYPES, re.sub(r"(<Types\b[^>]*>)", lambda m: m[1] + added, xml, count=1))


def markup(p: Package) -> int:
    saved = 0
    for n in [*p.names(suffix=".xml"), *p.names(suffix=".rels")]:
        x = p.text(n)
        if is_balanced(x):
            saved += p.put(n, minify(drop_repeated_namespaces(merge_runs(x)) if n.endswith(".xml") else x))
    return saved


#: (report key, families that it runs on, what the options must have, pass). W: word processing, X: spreadsheets, A: all.
PASSES: tuple[tuple[str, str, str, Callable[[Package], int]], ...] = (
    ("Thumbnail Removal", "A", "", thumbnails),
    ("Metadata Cleanup", "A", "drop_metadata", metadata),
    ("RSID Removal", "A", "", rsids),
    ("Style Pruning", "W", "", styles),
    ("Numbering Pruning", "W", "", numbering),
    ("Paragraph Properties Lifting", "W", "risky", paragraph_properties),
    ("Table Normalization", "W", "risky", table_widths),
    ("Run Properties Stripping", "W", "risky", run_properties),
    ("Custom XML Pruning", "W", "", custom_xml),
    ("Theme Minimization", "W", "risky", theme),
    ("Empty Headers/Footers Pruning", "W", "", empty_headers),
    ("Font Table Cleanup", "W", "", font_table),
    ("Settings Cleanup", "W", "risky", settings),
    ("Bookmarks Pruning", "W", "", bookmarks),
    ("Literal Normalization", "W", "", literals),
    ("Shared Strings GC", "X", "", shared_strings),
    ("Font Subsetting", "A", "subset_fonts", fonts),
    ("Orphan Media Pruning", "A", "", orphans),
    ("Media Deduplication", "A", "", duplicate_media),
    ("Embedded Package Optimization", "A", "", None),
    ("Image Optimization", "A", "", images),
    ("DrawingML Normalization", "A", "", drawings),
    ("Hidden Objects Pruning", "A", "", hidden),
    ("Short Path VFS", "A", "", short_paths),
    ("Content Types Normalization", "A", "", content_types),
    ("XML Minification", "A", "", markup),
)
