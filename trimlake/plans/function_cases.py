"""Functions of one text on texts made from the rows of documents, each with what it must return (see package_cases for templates)."""

from __future__ import annotations

import base64
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from trimlake.functions import codec, html_text, pdf_bytes, rtf_text, xml_text
from trimlake.functions.detect import detect
from trimlake.functions.validate import validate
from trimlake.operators.engine import optimize
from trimlake.operators.ooxml import Options
from trimlake.plans.package_cases import RENDERED, W, _column, _sql, rendered
from trimlake.session import ship
from trimlake.sources.zip_parts import Part, read_zip, write_zip


@dataclass(frozen=True)
class TextCase:
    run: Callable[[str], object]
    give: str
    expect: str  # a template, or after "=" an SQL expression over the columns of RENDERED


def _plain_png(text: str) -> bytes:
    """A badly packed true-colour image whose grey pixels are the bytes of a text."""
    raw = text.encode() or b"x"
    grey = np.frombuffer(raw, dtype=np.uint8)
    rows = np.zeros((1, 1 + 3 * len(raw)), np.uint8)
    rows[0, 1:] = np.repeat(grey, 3)
    head = len(raw).to_bytes(4, "big") + (1).to_bytes(4, "big") + bytes((8, 2, 0, 0, 0))
    return codec.png_pack([(b"IHDR", head), (b"tEXt", b"Comment\0x"), (b"IDAT", zlib.compress(rows.tobytes(), 0)), (b"IEND", b"")])


def _png(text: str) -> str:
    """The text read back from the optimised image's pixels, if that is smaller."""
    old = _plain_png(text)
    new = codec.optimize_png(old)
    return codec.png_pixels(new)[0, :, 0].tobytes().decode() if len(new) < len(old) else "not smaller"


def _jpeg(text: str) -> str:
    segment = lambda tag, body: b"\xff" + bytes((tag,)) + (len(body) + 2).to_bytes(2, "big") + body
    note = text.encode()[:1]
    old = b"\xff\xd8" + segment(0xE0, b"JFIF\0\1\2\0\0\1\0\1\0\0") + segment(0xFE, b"comment") + segment(0xED, b"Photoshop") + segment(0xDB, note) + segment(0xDA, b"s") + text.encode() + b"\xff\xd9"
    new = codec.optimize_jpeg(old)
    return new.partition(segment(0xDA, b"s"))[2][:-2].decode() if len(new) == len(old) - 11 - 13 else "wrong length"


def _pdf(text: str) -> bytes:
    body = b"BT (%b) Tj ET q Q " % text.encode()
    objects = [
        b"<</Type/Catalog/Pages 2 0 R>>", b"<</Type/Pages/Kids[3 0 R]/Count 1>>", b"<</Type/Page/Parent 2 0 R/Contents 4 0 R/Rotate 6 0 R>>",
        b"<</Length %d>>\nstream\n%b\nendstream" % (len(body), body), b"<</Lost(%b)>>" % (b"x" * 300), b"0",
    ]
    out = b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%b\nendobj\n" % (i + 1, o) for i, o in enumerate(objects))
    return out + b"xref\n0 1\n0000000000 65535 f \ntrailer\n<</Size 7/Root 1 0 R>>\nstartxref\n%d\n%%%%EOF\n" % len(out)


def _pdf_text(text: str) -> str:
    """The page's text read back from the optimised file."""
    old = _pdf(text)
    new, message = pdf_bytes.optimize_pdf(old)
    if len(new) >= len(old) or not validate(new, "PDF") or b"/Lost" in new:
        return message or "not smaller"
    streams = [o for o in pdf_bytes.scan(new)[0].values() if o.stream is not None and b"/Type" not in o.text]
    data = [codec.inflate(o.stream) if b"/Filter" in o.text else o.stream for o in streams]
    return data[0].decode().partition("(")[2].rpartition(")")[0]


DOCX = {
    "[Content_Types].xml": '<Types><Default Extension="rels" ContentType="r"/><Override PartName="/word/document.xml" ContentType="d"/></Types>',
    "_rels/.rels": '<Relationships><Relationship Id="d" Target="word/document.xml"/></Relationships>',
}


def _docx(text: str) -> str:
    """The text read back from a document that all passes went over, if it got smaller and stayed valid."""
    page = f'<w:document {W}>\n <w:body>\n  <w:p w:rsidR="00A1"><w:r><w:t>{text}</w:t></w:r></w:p>\n <!-- note -->\n</w:body></w:document>'
    old = write_zip([Part(n, d.encode()) for n, d in (DOCX | {"word/document.xml": page, "word/media/lost.png": "\0" * 200}).items()], best=False)
    r = optimize(old, "a.docx", Options(risky=True, subset_fonts=True))
    parts = {p.name: p.data.decode() for p in read_zip(r.data)}
    return parts["word/document.xml"].partition("<w:t>")[2].partition("</w:t>")[0] if r.success and validate(r.data, r.format) and "word/media/lost.png" not in parts else r.message


def _zip(text: str) -> str:
    parts = [Part("b.txt", text.encode()), Part("mimetype", b"m", stored=True), Part("a.txt", b"")]
    back = read_zip(write_zip(parts))
    return back[-1].data.decode() if [p.name for p in back] == ["mimetype", "a.txt", "b.txt"] else "wrong order"


def _hidden_text(png: bytes) -> str:
    return codec.png_pixels(png)[0, :, 0].tobytes().decode()


def _html_image(text: str) -> str:
    """The text read back from the image inside an optimised page."""
    old = "<html><img src='data:image/png;base64," + base64.b64encode(_plain_png(text)).decode() + "'></html>"
    r = optimize(old.encode(), "a.html")
    return _hidden_text(base64.b64decode(r.data.decode().partition("base64,")[2].partition("'")[0])) if r.success and r.saved.get("Image Optimization") else r.message


def _rtf_picture(text: str) -> str:
    """The text read back from the picture inside an optimised rich text."""
    old = "{\\rtf1 {\\pict\\pngblip\\picw9\n" + _plain_png(text).hex() + "}}"
    new = rtf_text.optimize_rtf(old)
    return _hidden_text(bytes.fromhex("".join(new.partition("picw9")[2].rstrip("}").split()))) if len(new) < len(old) else "not smaller"


def _package_image(text: str) -> str:
    """The text read back from a picture inside an optimised document, which another document holds."""
    page = '<w:d xmlns:w="w"/>'
    rels = lambda to: f'<Relationships><Relationship Id="m" Target="{to}"/></Relationships>'.encode()
    base = [Part(n, d.encode()) for n, d in DOCX.items()] + [Part("word/document.xml", page.encode())]
    inner = write_zip([*base, Part("word/media/1.png", _plain_png(text)), Part("word/_rels/document.xml.rels", rels("media/1.png"))], best=False)
    outer = write_zip([*base, Part("word/embeddings/a.docx", inner), Part("word/_rels/document.xml.rels", rels("embeddings/a.docx"))], best=False)
    r = optimize(outer, "a.docx")
    found = {p.name: p.data for p in read_zip(next(p.data for p in read_zip(r.data) if p.name.endswith("a.docx")))}
    return _hidden_text(found["word/media/1.png"]) if r.saved.get("Embedded Package Optimization") and len(found["word/media/1.png"]) < len(_plain_png(text)) else r.message


def _font_key(text: str) -> str:
    key = "{00112233-4455-6677-8899-AABBCCDDEEFF}"
    hidden = codec.deobfuscate_font(text.encode(), key)
    return codec.deobfuscate_font(hidden, key).decode() if hidden != text.encode() else "not hidden"


def _letters_font() -> bytes:
    """A font with an outline for each small letter, each of its own length."""
    glyphs = [b"\0\1" + bytes(8) + bytes([k]) * (2 * k + 2) for k in range(27)]
    at = [0]
    for g in glyphs:
        at.append(at[-1] + len(g))
    sub = struct.pack(">HHHHHHH", 4, 32, 0, 4, 4, 1, 0) + struct.pack(">HHHHHhhHH", 122, 0xFFFF, 0, 97, 0xFFFF, -96, 1, 0, 0)
    head = bytes(50) + struct.pack(">hh", 1, 0)
    tables = {"head": head, "maxp": struct.pack(">IH", 0x00010000, 27), "loca": np.array(at, dtype=">u4").tobytes(), "glyf": b"".join(glyphs), "cmap": struct.pack(">HHHHI", 0, 1, 3, 1, 12) + sub, "DSIG": bytes(400)}
    return codec.pack_font(tables)


def _font_subset(text: str) -> str:
    """The small letters whose outlines are left of a font reduced to a text."""
    t = codec.font_tables(codec.subset_font(_letters_font(), set(map(ord, set(text)))))
    loca = np.frombuffer(t["loca"], dtype=">u4")
    return "".join(chr(96 + g) for g in range(1, 27) if loca[g + 1] > loca[g])


def _pdf_inlined(text: str) -> str:
    """The number that a page holds in place of a reference to an object that nothing else used."""
    number, _, body = text.partition("|")
    old = _pdf(body).replace(b"6 0 obj\n0\n", b"6 0 obj\n%b\n" % number.encode())
    new, message = pdf_bytes.optimize_pdf(old)
    held = [o.text for o in pdf_bytes.scan(new)[0].values()] + [codec.inflate(o.stream) for o in pdf_bytes.scan(new)[0].values() if o.stream is not None and b"/Filter" in o.text]
    return next((m[1].decode() for x in held if (m := re.search(rb"/Rotate\s*([0-9]+)(?!\s+0\s+R)", x))), message)


def _odt(text: str) -> str:
    """The text read back from an optimised OpenDocument text."""
    old = write_zip([Part("mimetype", b"application/vnd.oasis.opendocument.text"), Part("content.xml", f"<o> <text:p>{text}</text:p> </o>".encode()), Part("meta.xml", b"<m><meta:generator>g</meta:generator></m>"), Part("Thumbnails/thumbnail.png", _plain_png(text))], best=False)
    r = optimize(old, "a.odt")
    parts = {p.name: p.data.decode("utf-8", "replace") for p in read_zip(r.data)}
    return parts["content.xml"].partition("<text:p>")[2].partition("</text:p>")[0] if r.success and validate(r.data, "ODT") and len(parts) == 3 else r.message


def _epub(text: str) -> str:
    """The text read back from an optimised e-book."""
    opf = b'<package><item id="p" href="p.xhtml" media-type="application/xhtml+xml"/></package>'
    old = write_zip([Part("mimetype", b"application/epub+zip"), Part("META-INF/container.xml", b"<c/>"), Part("b.opf", opf), Part("p.xhtml", f"<html><!-- {text} --><p>{text}</p></html>".encode()), Part("stray.bin", text.encode())], best=False)
    r = optimize(old, "a.epub")
    parts = {p.name: p.data.decode("utf-8", "replace") for p in read_zip(r.data)}
    return parts["p.xhtml"].partition("<html><p>")[2].partition("</p>")[0] if r.success and validate(r.data, "EPUB") and len(parts) == 4 else r.message


def _engine_text(hint: str) -> Callable[[str], str]:
    """What the engine leaves of a text file."""
    return lambda x: optimize(x.encode(), hint).data.decode()


def _truth(x: bool) -> str:
    return str(x).lower()


def _every_other(odd: Callable[[str], object], even: Callable[[str], object]) -> Callable[[str], object]:
    """One function for texts after an odd id, another one for those after an even id."""

    def run(x: str) -> object:
        number, _, text = x.partition("|")
        return odd(text) if int(number) % 2 else even(text)

    return run


#: The same in SQL, up to what each gives.
ODD = "CASE WHEN doc_id % 2 = 1"


def css_sql(css: str) -> str:
    """What is left of a style sheet: no comments, one blank for white space, none after braces, colons and semicolons."""
    return f"regexp_replace(regexp_replace(regexp_replace({css}, '/\\*.*?(\\*/|\\z)', '', 'gs'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), '(^|[{{}}:;]) ', '\\1', 'g')"


#: Kinds of packages by doc_id, with the parts by which they are told.
FAMILIES = (
    ("DOCX", {"[Content_Types].xml": "<Types/>", "word/document.xml": "<w/>"}), ("XLSX", {"[Content_Types].xml": "<Types/>", "xl/workbook.xml": "<x/>"}), ("PPTX", {"[Content_Types].xml": "<Types/>", "ppt/presentation.xml": "<p/>"}),
    ("ODT", {"mimetype": "application/vnd.oasis.opendocument.text", "content.xml": "<o/>"}), ("EPUB", {"mimetype": "application/epub+zip", "META-INF/container.xml": "<c/>"}),
)


def _family(x: str) -> str:
    """The format found in a package that also holds the text, whatever its name says."""
    number, _, text = x.partition("|")
    parts = FAMILIES[int(number) % len(FAMILIES)][1]
    return detect(write_zip([*(Part(n, d.encode()) for n, d in parts.items()), Part("z.txt", text.encode())], best=False), "")


RTF = "{\\rtf1 "
TEXT_CASES: dict[str, TextCase] = {
    "xml_strip_comments": TextCase(xml_text.strip_comments, "<a><!-- {t} -->{t}<b/><!-- open {id}", "<a>{t}<b/>"),
    "xml_minify": TextCase(xml_text.minify, "<a>\n  <b  x = '1.50pt'>{t}   {id}</b>\n <c xml:space=\"preserve\">  {id} </c><![CDATA[ {t} ]]>\n</a>", "<a><b x=\"1.5pt\">{m} {id}</b><c xml:space=\"preserve\">  {id} </c><![CDATA[ {t} ]]></a>"),
    "xml_trim_numbers": TextCase(xml_text.trim_numbers, "{id}.500cm -0.0 a{id}.50 7.25pt 1.0furlong", "{id}.5cm 0 a{id}.50 7.25pt 1.0furlong"),
    "xml_remove_attributes": TextCase(lambda x: xml_text.remove_attributes(x, ["w:a", "w:b"]), '<x w:a="{id}" w:c="1"><!-- w:a="k" --><y w:b=\'{t}\'/>{t}</x>', '<x w:c="1"><!-- w:a="k" --><y/>{t}</x>'),
    "xml_namespaces": TextCase(xml_text.drop_repeated_namespaces, '<a xmlns:n="u{id}"><b xmlns:n="u{id}"/><c xmlns:n="v"><d xmlns:n="u{id}"/></c>{t}</a>', '<a xmlns:n="u{id}"><b/><c xmlns:n="v"><d xmlns:n="u{id}"/></c>{t}</a>'),
    "xml_merge_runs": TextCase(xml_text.merge_runs, '<w:p><w:r w:rsidR="1"><w:t>x{t}</w:t></w:r><w:r><w:t xml:space="preserve"> {id}</w:t></w:r><w:r><w:rPr><w:b/></w:rPr><w:t>y</w:t></w:r><w:r><w:br/></w:r><w:r><w:t>z</w:t></w:r></w:p>', '<w:p><w:r><w:t xml:space="preserve">x{t} {id}</w:t></w:r><w:r><w:rPr><w:b/></w:rPr><w:t>y</w:t></w:r><w:r><w:br/></w:r><w:r><w:t>z</w:t></w:r></w:p>'),
    "xml_balanced": TextCase(_every_other(lambda x: _truth(xml_text.is_balanced(x)), lambda x: _truth(xml_text.is_balanced(x + "<b>"))), "{id}|<a b=\">\"><?p {t}?><!-- < --><c/>{t}</a>", f"={ODD} THEN 'true' ELSE 'false' END"),
    "xml_unbalanced": TextCase(_every_other(lambda x: _truth(xml_text.is_balanced(x + "</a></b>")), lambda x: _truth(xml_text.is_balanced(x + "</b></a>"))), "{id}|<a>{t}<b>", f"={ODD} THEN 'false' ELSE 'true' END"),
    "css_minify": TextCase(xml_text.minify_css, " /* {w} */ p  {\n a:  {id};\t}\n{w}", "=" + css_sql("' /* ' || w || ' */ p  {' || chr(10) || ' a:  ' || id || ';' || chr(9) || '}' || chr(10) || w")),
    "html_inline_images": TextCase(lambda x: html_text.inline_images(x), '<img src="data:image/png;base64,AAAA">{t}{id}', '<img src="data:image/png;base64,AAAA">{t}{id}'),
    "rtf_groups": TextCase(lambda x: rtf_text.remove_groups(rtf_text.remove_groups(x, "\\info"), "\\*\\generator"), RTF + "{\\info{\\title {r}}}\n{\\*\\generator g{id};}x{r}}", RTF + "x{r}}"),
    "rtf_fonts": TextCase(rtf_text.prune_fonts, RTF + "{\\fonttbl{\\f0 A;}{\\f1{\\*\\panose 1}B;}{\\f22 C{id};}}\\f1 {r}}", RTF + "{\\fonttbl{\\f1{\\*\\panose 1}B;}}\\f1 {r}}"),
    "rtf_states": TextCase(rtf_text.normalize_states, RTF + "\\b\\b x\\ql\\qj {}{r}}", RTF + "\\b x\\qj {r}}"),
    "rtf_valid": TextCase(_every_other(lambda x: _truth(rtf_text.is_valid(x)), lambda x: _truth(rtf_text.is_valid(x + "}"))), "{id}|" + RTF + "\\{ {r} {b}}", f"={ODD} THEN 'true' ELSE 'false' END"),
    "rtf_optimize": TextCase(rtf_text.optimize_rtf, RTF + "{\\info{\\author {r}}}\r\n\r\nx{r}{id}}", RTF + "\nx{r}{id}}"),
    "png_reduce": TextCase(_png, "x{w}{id}", "x{w}{id}"),
    "jpeg_strip": TextCase(_jpeg, "x{w}{id}", "x{w}{id}"),
    "pdf_optimize": TextCase(_pdf_text, "{p}{id}", "{p}{id}"),
    "pdf_signed": TextCase(_every_other(lambda x: pdf_bytes.optimize_pdf(_pdf(x) + b"/ByteRange[0]/Sig")[1], _pdf_text), "{id}|{p}", f"={ODD} THEN 'Signed PDF preserved' ELSE p END"),
    "pdf_encrypted": TextCase(_every_other(lambda x: pdf_bytes.optimize_pdf(_pdf(x) + b"/Encrypt")[1], _pdf_text), "{id}|{p}", f"={ODD} THEN 'Encrypted PDF preserved' ELSE p END"),
    "pdf_content": TextCase(lambda x: pdf_bytes.clean_content(x.encode()).decode(), "q Q 1 0 0 1 0.0 0 cm 1 0 0 rg 1 0 0 rg (a{p}) Tj ({id}) Tj BT ET 2 w", "1 0 0 rg\n(a{p}{id}) Tj\n2 w"),
    "zip_round_trip": TextCase(_zip, "{w}{id}", "{w}{id}"),
    "deflate_round_trip": TextCase(lambda x: codec.inflate(codec.deflate_best(x.encode())).decode(), "{w}{id}", "{w}{id}"),
    "html_image_shrink": TextCase(_html_image, "x{w}{id}", "x{w}{id}"),
    "rtf_picture_shrink": TextCase(_rtf_picture, "x{w}{id}", "x{w}{id}"),
    "embedded_image_shrink": TextCase(_package_image, "x{w}{id}", "x{w}{id}"),
    "font_key": TextCase(_font_key, "font file {w}{id}", "font file {w}{id}"),
    "font_subset": TextCase(_font_subset, "{w}", "=array_to_string(list_sort(list_distinct(regexp_extract_all(w, '[a-z]'))), '')"),
    "pdf_inline": TextCase(_pdf_inlined, "{id}|{p}", "{id}"),
    "odt_optimize": TextCase(_odt, "x{t}{id}", "x{t}{id}"),
    "epub_optimize": TextCase(_epub, "x{t}{id}", "x{t}{id}"),
    "svg_optimize": TextCase(_engine_text("a.svg"), "<svg>\n  <g  x='1.50'/>\n <text>{t}{id}</text>\n</svg>", '<svg><g x="1.5"/><text>{m}{id}</text></svg>'),
    "fodt_optimize": TextCase(_engine_text("a.fodt"), "<office:document  a='1'>\n <x>{t}{id}</x>\n</office:document>", '<office:document a="1"><x>{m}{id}</x></office:document>'),
    "package_family": TextCase(_family, "{id}|{w}", "=CASE doc_id % 5 " + " ".join(f"WHEN {k} THEN '{n}'" for k, (n, _) in enumerate(FAMILIES)) + " END"),
    "unknown_stays": TextCase(_engine_text(""), "{w}{id}", "{w}{id}"),
    "docx_optimize": TextCase(_docx, "x{t}{id}", "x{m}{id}"),
}


def text_query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    """doc_id and result for every document."""
    case = TEXT_CASES[name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([case.run(x) for x in b.column("give").to_pylist()], pa.string())], ["doc_id", "result"])

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return rendered(spark, sf_dir).select("doc_id", _column(case.give).alias("give")).mapInArrow(run, "doc_id long, result string")

    query.__name__ = name
    return query


def text_sql(name: str) -> str:
    return f"SELECT doc_id, {_sql(TEXT_CASES[name].expect)} AS result FROM {RENDERED}"
