"""Package passes on packages made from the rows of documents, each with the text that it must leave.

A template becomes a column in the query and the same text in SQL: {id} is the doc_id, {t} the whole text as XML holds it (ampersands and
angle brackets as entities), {r} and {p} the whole text as rich text and PDF strings hold it (backslashes and brackets escaped), {w} the whole text as it
is; in SQL also {m}, which is {t} with each run of white space as one blank.
The query packs the input, unpacks it, runs the pass, and returns the part; the SQL states what must be in it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trimlake.operators import odf_epub, ooxml
from trimlake.operators.package import Package
from trimlake.session import ship
from trimlake.sources.zip_parts import Part, read_zip, write_zip

W = 'xmlns:w="w"'
TYPES, RELS = "[Content_Types].xml", "word/_rels/document.xml.rels"


@dataclass(frozen=True)
class Case:
    run: Callable[[Package], int]
    parts: dict[str, str]
    watch: str
    expect: str | None  # None: the part is gone


def _doc(inner: str) -> str:
    return f"<w:document {W}><w:body>{inner}</w:body></w:document>"


def _p(text: str, props: str = "") -> str:
    return f"<w:p>{props}<w:r><w:t>{text}</w:t></w:r></w:p>"


BODY = _p("{t}")
_FLAGS = "".join(f' {f}="0"' for f in ooxml.DRAWING_FLAGS)

CASES: dict[str, Case] = {
    "ooxml_thumbnail": Case(ooxml.thumbnails, {"_rels/.rels": '<Relationships><Relationship Id="a{id}" Target="docProps/thumbnail.jpeg"/><Relationship Id="b" Target="word/document.xml"/></Relationships>', "docProps/thumbnail.jpeg": "{t}", "word/document.xml": _doc(BODY)}, "_rels/.rels", '<Relationships><Relationship Id="b" Target="word/document.xml"/></Relationships>'),
    "ooxml_metadata": Case(ooxml.metadata, {"docProps/core.xml": "<cp:p><dc:creator>u{id}</dc:creator><dc:title>{t}</dc:title><cp:revision>{id}</cp:revision><dcterms:created xsi:type=\"x\">2001</dcterms:created></cp:p>"}, "docProps/core.xml", "<cp:p><dc:title>{t}</dc:title></cp:p>"),
    "ooxml_app_metadata": Case(ooxml.metadata, {"docProps/app.xml": "<p><TotalTime>{id}</TotalTime><Application>A</Application><AppVersion>1</AppVersion><Company>{t}</Company><Manager>m</Manager><Pages>{id}</Pages></p>"}, "docProps/app.xml", "<p><Pages>{id}</Pages></p>"),
    "ooxml_rsids": Case(ooxml.rsids, {"word/document.xml": _doc('<w:p w:rsidR="00{id}" w:rsidRDefault="11" w:x="1"><w:r w:rsidRPr="22"><w:t>{t}</w:t></w:r></w:p>')}, "word/document.xml", _doc('<w:p w:x="1"><w:r><w:t>{t}</w:t></w:r></w:p>')),
    "ooxml_rsid_list": Case(ooxml.rsids, {"word/settings.xml": '<w:settings><w:rsids><w:rsid w:val="{id}"/></w:rsids><w:zoom w:percent="{id}"/></w:settings>'}, "word/settings.xml", '<w:settings><w:zoom w:percent="{id}"/></w:settings>'),
    "ooxml_styles": Case(ooxml.styles, {"word/document.xml": _doc(_p("{t}", '<w:pPr><w:pStyle w:val="S{id}"/></w:pPr>')), "word/styles.xml": '<w:styles><w:latentStyles><w:x/></w:latentStyles><w:style w:default="1" w:styleId="Normal"><w:name w:val="n"/></w:style><w:style w:styleId="S{id}"><w:basedOn w:val="B"/><w:link w:val="L"/></w:style><w:style w:styleId="B"><w:next w:val="S{id}"/></w:style><w:style w:styleId="L"/><w:style w:styleId="Unused{id}"><w:basedOn w:val="Unused"/></w:style><w:style w:styleId="Unused"><w:basedOn w:val="Unused{id}"/></w:style></w:styles>'}, "word/styles.xml", '<w:styles><w:style w:default="1" w:styleId="Normal"><w:name w:val="n"/></w:style><w:style w:styleId="S{id}"><w:basedOn w:val="B"/><w:link w:val="L"/></w:style><w:style w:styleId="B"><w:next w:val="S{id}"/></w:style><w:style w:styleId="L"/></w:styles>'),
    "ooxml_numbering": Case(ooxml.numbering, {"word/document.xml": _doc(_p("{t}", '<w:pPr><w:numPr><w:numId w:val="{id}"/></w:numPr></w:pPr>')), "word/numbering.xml": '<w:numbering><w:abstractNum w:abstractNumId="a{id}"><w:lvl/></w:abstractNum><w:abstractNum w:abstractNumId="z"><w:lvl/></w:abstractNum><w:num w:numId="{id}"><w:abstractNumId w:val="a{id}"/></w:num><w:num w:numId="n"><w:abstractNumId w:val="z"/></w:num></w:numbering>'}, "word/numbering.xml", '<w:numbering><w:abstractNum w:abstractNumId="a{id}"><w:lvl/></w:abstractNum><w:num w:numId="{id}"><w:abstractNumId w:val="a{id}"/></w:num></w:numbering>'),
    "ooxml_numbering_unused": Case(ooxml.numbering, {RELS: '<Relationships><Relationship Id="n{id}" Target="numbering.xml"/><Relationship Id="s" Target="styles.xml"/></Relationships>', "word/document.xml": _doc(BODY), "word/numbering.xml": "<w:numbering>{t}</w:numbering>"}, RELS, '<Relationships><Relationship Id="s" Target="styles.xml"/></Relationships>'),
    "ooxml_paragraph_lifting": Case(ooxml.paragraph_properties, {"word/document.xml": _doc(_p("{t}", '<w:pPr><w:pStyle w:val="S"/><w:jc w:val="both"/><w:spacing w:after="{id}"/></w:pPr>') + _p("{t}", '<w:pPr><w:pStyle w:val="D"/></w:pPr>')), "word/styles.xml": '<w:styles><w:style w:type="paragraph" w:default="1" w:styleId="D"><w:name/></w:style><w:style w:type="paragraph" w:styleId="S"><w:pPr><w:jc w:val="both"/></w:pPr></w:style></w:styles>'}, "word/document.xml", _doc(_p("{t}", '<w:pPr><w:pStyle w:val="S"/><w:spacing w:after="{id}"/></w:pPr>') + BODY)),
    "ooxml_table_widths": Case(ooxml.table_widths, {"word/document.xml": _doc('<w:tbl><w:tblGrid><w:gridCol w:w="{id}"/><w:gridCol w:w="7"/></w:tblGrid><w:tr><w:tc><w:tcPr><w:tcW w:w="{id}" w:type="dxa"/></w:tcPr><w:p>{t}</w:p></w:tc><w:tc><w:tcPr><w:tcW w:w="x{id}" w:type="dxa"/></w:tcPr><w:p/></w:tc></w:tr></w:tbl>')}, "word/document.xml", _doc('<w:tbl><w:tblGrid><w:gridCol w:w="{id}"/><w:gridCol w:w="7"/></w:tblGrid><w:tr><w:tc><w:p>{t}</w:p></w:tc><w:tc><w:tcPr><w:tcW w:w="x{id}" w:type="dxa"/></w:tcPr><w:p/></w:tc></w:tr></w:tbl>')),
    "ooxml_run_properties": Case(ooxml.run_properties, {"word/document.xml": _doc('<w:p><w:r><w:rPr><w:rStyle w:val="C"/><w:color w:val="{id}"/><w:b/></w:rPr><w:t>{t}</w:t></w:r></w:p>'), "word/styles.xml": '<w:styles><w:style w:type="character" w:styleId="C"><w:rPr><w:color w:val="{id}"/><w:b/></w:rPr></w:style></w:styles>'}, "word/document.xml", _doc('<w:p><w:r><w:rPr><w:rStyle w:val="C"/><w:b/></w:rPr><w:t>{t}</w:t></w:r></w:p>')),
    "ooxml_custom_xml": Case(ooxml.custom_xml, {"word/document.xml": _doc(BODY), "customXml/item{id}.xml": "<a>{t}</a>", RELS: '<Relationships><Relationship Id="c" Target="../customXml/item{id}.xml"/></Relationships>'}, RELS, "<Relationships></Relationships>"),
    "ooxml_theme": Case(ooxml.theme, {"word/document.xml": _doc(BODY), "word/theme/theme1.xml": "<a:theme><a:fmtScheme><!--{t}{t}--><x y=\"" + "z" * 900 + "\"/></a:fmtScheme><a:n>{id}</a:n></a:theme>"}, "word/theme/theme1.xml", f"<a:theme>{ooxml.PLAIN_FORMATS}<a:n>{{id}}</a:n></a:theme>"),
    "ooxml_empty_headers": Case(ooxml.empty_headers, {"word/document.xml": _doc(BODY + '<w:sectPr><w:headerReference w:type="default" r:id="h{id}"/><w:footerReference w:type="default" r:id="f"/></w:sectPr>'), "word/header1.xml": "<w:hdr><w:p><w:r><w:t> </w:t></w:r></w:p></w:hdr>", "word/footer1.xml": "<w:ftr><w:p><w:r><w:t>x{t}</w:t></w:r></w:p></w:ftr>", RELS: '<Relationships><Relationship Target="header1.xml" Id="h{id}"/><Relationship Id="f" Target="footer1.xml"/></Relationships>'}, "word/document.xml", _doc(BODY + '<w:sectPr><w:footerReference w:type="default" r:id="f"/></w:sectPr>')),
    "ooxml_font_table": Case(ooxml.font_table, {"word/document.xml": _doc('<w:r><w:rFonts w:ascii="F{id}"/><w:t>{t}</w:t></w:r>'), "word/fontTable.xml": '<w:fonts><w:font w:name="F{id}"><w:family w:val="roman"/></w:font><w:font w:name="F{id}"><w:x/></w:font><w:font w:name="Gone"><w:sig w:a="1"/></w:font></w:fonts>'}, "word/fontTable.xml", '<w:fonts><w:font w:name="F{id}"/></w:fonts>'),
    "ooxml_settings": Case(ooxml.settings, {"word/settings.xml": "<w:settings>" + "".join(f'<{s} w:val="1"/>' for s in ooxml.SETTINGS) + '<w:zoom w:percent="{id}"/>{t}</w:settings>'}, "word/settings.xml", '<w:settings><w:zoom w:percent="{id}"/>{t}</w:settings>'),
    "ooxml_bookmarks": Case(ooxml.bookmarks, {"word/document.xml": _doc('<w:bookmarkStart w:id="1" w:name="_GoBack"/><w:bookmarkEnd w:id="1"/><w:bookmarkStart w:id="2" w:name="_Toc{id}"/><w:bookmarkEnd w:id="2"/><w:bookmarkStart w:id="3" w:name="_Ref{id}"/>{t}<w:bookmarkEnd w:id="3"/><w:hyperlink w:anchor="_Toc{id}"/>')}, "word/document.xml", _doc('<w:bookmarkStart w:id="2" w:name="_Toc{id}"/><w:bookmarkEnd w:id="2"/>{t}<w:hyperlink w:anchor="_Toc{id}"/>')),
    "ooxml_literals": Case(ooxml.literals, {"word/document.xml": _doc('<w:b w:val="true"/><w:i w:val="off"/><w:ind w:left="0pt" w:right="00"/><w:color w:val="000000"/><w:n w:val="{id}"/>{t}')}, "word/document.xml", _doc('<w:b/><w:i w:val="0"/><w:ind w:left="0" w:right="0"/><w:color w:val="000000"/><w:n w:val="{id}"/>{t}')),
    "ooxml_shared_strings": Case(ooxml.shared_strings, {"xl/sharedStrings.xml": '<sst count="9" uniqueCount="4"><si><t>gone</t></si><si><t>{t}</t></si><si><t>n{id}</t></si><si><t>{t}</t></si></sst>', "xl/worksheets/sheet1.xml": '<s><c r="A1" t="s"><v>1</v></c><c r="A2" t="s"><v>2</v></c><c r="A3" t="s"><v>3</v></c><c r="A4"><v>3</v></c></s>'}, "xl/sharedStrings.xml", '<sst count="3" uniqueCount="2"><si><t>{t}</t></si><si><t>n{id}</t></si></sst>'),
    "ooxml_shared_cells": Case(ooxml.shared_strings, {"xl/sharedStrings.xml": '<sst count="9" uniqueCount="4"><si><t>gone</t></si><si><t>{t}</t></si><si><t>n{id}</t></si><si><t>{t}</t></si></sst>', "xl/worksheets/sheet1.xml": '<s><c r="A1" t="s"><v>1</v></c><c r="A2" t="s"><v>2</v></c><c r="A3" t="s"><v>3</v></c><c r="A4"><v>3</v></c></s>'}, "xl/worksheets/sheet1.xml", '<s><c r="A1" t="s"><v>0</v></c><c r="A2" t="s"><v>1</v></c><c r="A3" t="s"><v>0</v></c><c r="A4"><v>3</v></c></s>'),
    "ooxml_orphan_media": Case(ooxml.orphans, {"ppt/slides/slide1.xml": "<p>{t}</p>", "ppt/slides/_rels/slide1.xml.rels": '<Relationships><Relationship Id="a" Target="../media/used{id}.png"/></Relationships>', "ppt/media/used{id}.png": "x", "ppt/media/lost{id}.png": "{t}", TYPES: '<Types><Override PartName="/ppt/media/lost{id}.png" ContentType="i"/><Override PartName="/ppt/media/used{id}.png" ContentType="i"/></Types>'}, TYPES, '<Types><Override PartName="/ppt/media/used{id}.png" ContentType="i"/></Types>'),
    "ooxml_media_dedup": Case(ooxml.duplicate_media, {"ppt/slides/_rels/slide1.xml.rels": '<Relationships><Relationship Id="a" Target="../media/a{id}.png"/><Relationship Id="b" Target="/ppt/media/b.png"/><Relationship Id="c" Target="../media/c.png"/></Relationships>', "ppt/media/a{id}.png": "same{t}", "ppt/media/b.png": "same{t}", "ppt/media/c.png": "same{t}"}, "ppt/slides/_rels/slide1.xml.rels", '<Relationships><Relationship Id="a" Target="../media/a{id}.png"/><Relationship Id="b" Target="/ppt/media/a{id}.png"/><Relationship Id="c" Target="../media/a{id}.png"/></Relationships>'),
    "ooxml_drawings": Case(ooxml.drawings, {"word/document.xml": _doc(f'<a:x rot="0"{_FLAGS} id="{{id}}"/><a:avLst> </a:avLst><a:effectLst></a:effectLst>{{t}}')}, "word/document.xml", _doc('<a:x id="{id}"/><a:avLst/><a:effectLst/>{t}')),
    "ooxml_hidden": Case(ooxml.hidden, {"word/document.xml": _doc('<w:p><w:proofErr w:type="x{id}"/><w:r><w:rPr><w:vanish/></w:rPr><w:t></w:t></w:r><w:r><w:rPr><w:vanish/></w:rPr><w:t>kept{t}</w:t></w:r><w:commentRangeStart w:id="1"/></w:p>')}, "word/document.xml", _doc("<w:p><w:r><w:rPr><w:vanish/></w:rPr><w:t>kept{t}</w:t></w:r></w:p>")),
    "ooxml_short_paths": Case(ooxml.short_paths, {RELS: '<Relationships><Relationship Id="a{id}" Target="media/image{id}.png"/></Relationships>', "word/media/image{id}.png": "{t}"}, RELS, '<Relationships><Relationship Id="a{id}" Target="media/1.png"/></Relationships>'),
    "ooxml_content_types": Case(ooxml.content_types, {TYPES: '<Types><Default Extension="xml" ContentType="x"/><Override PartName="/a{id}.png" ContentType="image/png"/><Override PartName="/b.png" ContentType="image/png"/><Override PartName="/c.xml" ContentType="x"/><Override PartName="/d.xml" ContentType="y{id}"/><Override PartName="/none.xml" ContentType="z"/></Types>', "a{id}.png": "{t}", "b.png": "b", "c.xml": "<c/>", "d.xml": "<d/>"}, TYPES, '<Types><Default Extension="png" ContentType="image/png"/><Default Extension="xml" ContentType="x"/><Override PartName="/d.xml" ContentType="y{id}"/></Types>'),
    "ooxml_markup": Case(ooxml.markup, {"word/document.xml": f'<w:document {W}>\n <w:p {W} >\n  <w:r><w:t>{{t}}</w:t></w:r> <w:r><w:t>x{{id}}</w:t></w:r>\n </w:p><!-- {{t}} -->\n</w:document>'}, "word/document.xml", f"<w:document {W}><w:p><w:r><w:t>{{m}}x{{id}}</w:t></w:r></w:p></w:document>"),
    "odf_metadata": Case(odf_epub.odf_metadata, {"meta.xml": '<m><meta:generator>g{id}</meta:generator><dc:title>{t}</dc:title><dc:date>d</dc:date><meta:document-statistic meta:page-count="{id}"/></m>'}, "meta.xml", "<m><dc:title>{t}</dc:title></m>"),
    "odf_thumbnail": Case(odf_epub.odf_thumbnail, {"META-INF/manifest.xml": '<m:m><manifest:file-entry manifest:full-path="Thumbnails/thumbnail.png"/><manifest:file-entry manifest:full-path="a{id}.xml"/></m:m>', "Thumbnails/thumbnail.png": "{t}"}, "META-INF/manifest.xml", '<m:m><manifest:file-entry manifest:full-path="a{id}.xml"/></m:m>'),
    "odf_folders": Case(odf_epub.odf_empty_folders, {"META-INF/manifest.xml": '<m:m><manifest:file-entry manifest:full-path="Configurations2/a{id}/"/><manifest:file-entry manifest:full-path="Configurations2/b.xml"/><manifest:file-entry manifest:full-path="x{id}/"/></m:m>', "Configurations2/a{id}/": "", "Configurations2/b.xml": "{t}", "x{id}/": ""}, "META-INF/manifest.xml", '<m:m><manifest:file-entry manifest:full-path="Configurations2/b.xml"/><manifest:file-entry manifest:full-path="x{id}/"/></m:m>'),
    "odf_hidden": Case(odf_epub.odf_hidden, {"content.xml": '<c><draw:frame draw:name="{id}" svg:width="0cm" svg:height="0cm"><draw:image/></draw:frame><draw:frame svg:width="1cm" svg:height="0cm">{t}</draw:frame><office:annotation> </office:annotation></c>'}, "content.xml", '<c><draw:frame svg:width="1cm" svg:height="0cm">{t}</draw:frame></c>'),
    "odf_dedup": Case(odf_epub.odf_duplicates, {"content.xml": '<c><i xlink:href="Pictures/a{id}.png"/><i xlink:href="Pictures/b.png"/></c>', "Pictures/a{id}.png": "p{t}", "Pictures/b.png": "p{t}"}, "content.xml", '<c><i xlink:href="Pictures/a{id}.png"/><i xlink:href="Pictures/a{id}.png"/></c>'),
    "epub_orphans": Case(odf_epub.epub_orphans, {"OPS/book.opf": '<package><item id="p" href="p.xhtml" media-type="application/xhtml+xml"/><item id="i{id}" href="i.png" media-type="image/png"/><item id="o" href="o{id}.png" media-type="image/png"/></package>', "OPS/p.xhtml": '<html><img src="i.png#x"/>{t}</html>', "OPS/i.png": "i", "OPS/o{id}.png": "{t}", "stray.txt": "{t}"}, "OPS/book.opf", '<package><item id="p" href="p.xhtml" media-type="application/xhtml+xml"/><item id="i{id}" href="i.png" media-type="image/png"/></package>'),
    "epub_stray": Case(odf_epub.epub_orphans, {"OPS/book.opf": '<package><item id="p" href="p.xhtml" media-type="application/xhtml+xml"/></package>', "OPS/p.xhtml": "<html>{t}</html>", "stray.txt": "{t}{id}"}, "stray.txt", None),
    "epub_rights": Case(odf_epub.epub_orphans, {"OPS/book.opf": '<package><item id="p" href="p.xhtml" media-type="application/xhtml+xml"/></package>', "OPS/p.xhtml": "<html>{t}</html>", "META-INF/rights.xml": "<r>{id}</r>"}, "META-INF/rights.xml", "<r>{id}</r>"),
    "epub_css": Case(odf_epub.epub_markup, {"a.css": "/* {t} */ p {\n  margin: {id}px;\n }\n"}, "a.css", "p {margin:{id}px;}"),
}


_NAMES = ("id", "t", "r", "p", "w", "m")


def _pieces(template: str) -> list[str]:
    return [x for x in re.split(r"(\{(?:id|t|r|p|w|m)\})", template) if x]


def _column(template: str) -> Column:
    return F.concat(F.lit(""), *(F.col(x[1:-1]) if x[1:-1] in _NAMES and x[0] == "{" else F.lit(x) for x in _pieces(template)))


def _sql(template: str) -> str:
    """The template in SQL; after "=" it is SQL already, over the columns of RENDERED."""
    if template.startswith("="):
        return template[1:]
    return " || ".join(["''", *(x[1:-1] if x[1:-1] in _NAMES and x[0] == "{" else "'" + x.replace("'", "''") + "'" for x in _pieces(template))])


#: What each escape replaces, in order.
XML_ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"))
RTF_ESCAPES = (("\\", "\\\\"), ("{", "\\{"), ("}", "\\}"))

PDF_ESCAPES = (("\\", "\\\\"), ("(", "\\("), (")", "\\)"))


def _replaced(text: Column, pairs: tuple) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def _replaced_sql(text: str, pairs: tuple) -> str:
    for old, new in pairs:
        text = f"replace({text}, '{old}', '{new}')"
    return text


def rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, id, t, r, p, w of all documents."""
    whole = F.coalesce("text", F.lit(""))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("doc_id").cast("string").alias("id"), _replaced(whole, XML_ESCAPES).alias("t"), _replaced(whole, RTF_ESCAPES).alias("r"), _replaced(whole, PDF_ESCAPES).alias("p"), whole.alias("w"))


_WHOLE = "coalesce(text, '')"
#: The same as a table expression.
RENDERED = f"(SELECT doc_id, CAST(doc_id AS VARCHAR) AS id, {_replaced_sql(_WHOLE, XML_ESCAPES)} AS t, regexp_replace(t, '[ \\t\\n\\r]+', ' ', 'g') AS m, {_replaced_sql(_WHOLE, PDF_ESCAPES)} AS p, {_replaced_sql(_WHOLE, RTF_ESCAPES)} AS r, {_WHOLE} AS w FROM documents)"


def package_query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    """doc_id and result: the watched part after the pass, over a package for each document."""
    case = CASES[name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = b.to_pydict()
            out = []
            for k in range(b.num_rows):
                raw = write_zip([Part(cols[f"n{i}"][k], cols[f"d{i}"][k].encode()) for i in range(len(case.parts))], best=False)
                package = Package.of(sorted(read_zip(raw), key=lambda p: [*cols_order(cols, k, case)].index(p.name)))
                case.run(package)
                watched = package.parts.get(case.watch)
                out.append(None if watched is None else watched.data.decode())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "result"])

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        docs = rendered(spark, sf_dir)
        named = [c for i, (n, d) in enumerate(case.parts.items()) for c in (_column(n).alias(f"n{i}"), _column(d).alias(f"d{i}"))]
        return docs.select("doc_id", *named).mapInArrow(run, "doc_id long, result string")

    query.__name__ = name
    query.__doc__ = f"{name}: {case.run.__doc__ or case.run.__name__}"
    return query


def cols_order(cols: dict[str, list], row: int, case: Case) -> Iterator[str]:
    """Part names in the order of the template, which is that of the package."""
    return (cols[f"n{i}"][row] for i in range(len(case.parts)))


def package_sql(name: str) -> str:
    expect = CASES[name].expect
    value = "CAST(NULL AS VARCHAR)" if expect is None else _sql(expect)
    return f"SELECT doc_id, {value} AS result FROM {RENDERED}"
