"""Whole documents: never larger, stable, valid, and the known traps."""

from __future__ import annotations

import io
import zipfile

import numpy as np
import pytest

from tests.test_functions import pdf, png
from trimlake.operators import odf_epub, ooxml
from trimlake.operators.engine import AS_IT_IS, Options, optimize
from trimlake.operators.package import Package
from trimlake.functions.codec import Refused
from trimlake.sources.zip_parts import Part, read_zip, write_zip

PNG = png(np.zeros((6, 6, 3), np.uint8), 2)
W = 'xmlns:w="w" xmlns:r="r"'


def build(parts: dict[str, bytes | str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z:
        for n, d in parts.items():
            z.writestr(zipfile.ZipInfo(n), d)
    return out.getvalue()


def docx(**more) -> bytes:
    parts = {
        "[Content_Types].xml": '<Types>\n<Default Extension="rels" ContentType="r"/><Default Extension="png" ContentType="image/png"/><Override PartName="/word/document.xml" ContentType="d"/></Types>',
        "_rels/.rels": '<Relationships><Relationship Id="d" Target="word/document.xml"/><Relationship Id="t" Target="docProps/thumbnail.jpeg"/></Relationships>',
        "docProps/thumbnail.jpeg": b"\xff\xd8" + b"t" * 99,
        "word/document.xml": f'<w:document {W}><w:body><w:p w:rsidR="1"><w:pPr><w:pStyle w:val="Used"/></w:pPr><w:r><w:t xml:space="preserve"> kept  blanks </w:t></w:r></w:p><a:blip r:embed="i1"/><a:blip r:embed="i2"/></w:body></w:document>',
        "word/styles.xml": '<w:styles><w:style w:styleId="Used"><w:basedOn w:val="Base"/></w:style><w:style w:styleId="Base"/><w:style w:styleId="Gone"/></w:styles>',
        "word/_rels/document.xml.rels": '<Relationships><Relationship Id="s" Target="styles.xml"/><Relationship Id="i1" Target="media/image1.png"/><Relationship Id="i2" Target="media/image2.png"/></Relationships>',
        "word/media/image1.png": PNG, "word/media/image2.png": PNG, "word/media/orphan.png": PNG + b"x",
    }
    return build(parts | {k.replace("__", "/"): v for k, v in more.items()})


def links_resolve(raw: bytes) -> bool:
    p = Package.of(read_zip(raw))
    return all(r.path in p.parts for r in p.relations() if r.path)


def test_docx():
    old = docx()
    r = optimize(old, "a.docx", Options(risky=True))
    assert r.success and r.format == "DOCX" and r.optimized_size == len(r.data) < len(old) and links_resolve(r.data)
    parts = {p.name: p.data.decode("latin-1") for p in read_zip(r.data)}
    assert not any("thumbnail" in n or "orphan" in n for n in parts) and sum("/media/" in n for n in parts) == 1
    assert " kept  blanks " in parts["word/document.xml"] and "Gone" not in parts["word/styles.xml"] and "Base" in parts["word/styles.xml"]
    assert r.saved["Media Deduplication"] > 0 and r.saved["Orphan Media Pruning"] == len(PNG) + 1
    again = optimize(r.data, "a.docx", Options(risky=True))
    assert again.optimized_size <= r.optimized_size
    assert {p.name: p.data for p in read_zip(again.data)}.keys() == {p.name for p in read_zip(r.data)}
    assert optimize(old, "a.docx", Options(fast=True)).candidates == 1 and r.candidates == 2


def test_signed_package_is_left_alone():
    old = docx(**{"_xmlsignatures__sig1.xml": "<s/>"})
    r = optimize(old, "a.docx")
    assert r.data == old and not r.success and r.message == "Signed package preserved"


def test_slides_do_not_lose_shared_media():
    """Targets that leave their folder are led to the copy that stays."""
    p = Package.of([Part("ppt/slides/slide1.xml", b"<s/>"), Part("ppt/slides/_rels/slide1.xml.rels", b'<Relationships><Relationship Id="a" Target="../media/a.png"/><Relationship Id="b" Target="../media/b.png"/></Relationships>'), Part("ppt/media/a.png", PNG), Part("ppt/media/b.png", PNG)])
    assert ooxml.duplicate_media(p) == len(PNG)
    assert [r.path for r in p.relations()] == ["ppt/media/a.png"] * 2


def test_header_references_are_by_owner():
    """The same relationship id in another part means something else."""
    p = Package.of([
        Part("word/document.xml", b'<w:d><w:sectPr><w:headerReference r:id="x"/></w:sectPr></w:d>'), Part("word/_rels/document.xml.rels", b'<Relationships><Relationship Id="x" Target="header1.xml"/></Relationships>'),
        Part("word/other.xml", b'<w:d><w:headerReference r:id="x"/></w:d>'), Part("word/_rels/other.xml.rels", b'<Relationships><Relationship Id="x" Target="header2.xml"/></Relationships>'),
        Part("word/header1.xml", b"<w:hdr/>"), Part("word/header2.xml", b"<w:hdr><w:t>text</w:t></w:hdr>"),
    ])
    ooxml.empty_headers(p)
    assert "header" not in p.text("word/document.xml") and 'r:id="x"' in p.text("word/other.xml") and "word/header2.xml" in p.parts


def test_shared_strings_commit_both_or_none():
    sheet = b'<s><c t="s"><v>5</v></c></s>'
    p = Package.of([Part("xl/sharedStrings.xml", b'<sst count="1" uniqueCount="1"><si><t>a</t></si></sst>'), Part("xl/worksheets/sheet1.xml", sheet)])
    assert ooxml.shared_strings(p) == 0 and p.parts["xl/worksheets/sheet1.xml"].data == sheet


def test_colours_are_not_measures():
    p = Package.of([Part("word/document.xml", b'<w:d><w:color w:val="000000"/><w:sz w:val="00"/><w:x w:left="0.0pt"/></w:d>')])
    ooxml.literals(p)
    assert 'w:val="000000"' in p.text("word/document.xml") and 'w:left="0"' in p.text("word/document.xml")


def test_bound_custom_xml_stays():
    p = Package.of([Part("word/document.xml", b"<w:d><w:dataBinding/></w:d>"), Part("customXml/item1.xml", b"<a/>")])
    assert ooxml.custom_xml(p) == 0 and "customXml/item1.xml" in p.parts


def test_nested_packages_are_optimised_to_a_depth():
    inner = docx()
    for _ in range(2):
        inner = build({"[Content_Types].xml": "<Types></Types>", "_rels/.rels": '<Relationships><Relationship Id="e" Target="word/embeddings/x.docx"/></Relationships>', "word/document.xml": f"<w:d {W}/>", "word/embeddings/x.docx": inner})
    r = optimize(inner, "a.docx")
    assert r.success and r.saved["Embedded Package Optimization"] > 0
    assert "Embedded Package Optimization" not in optimize(inner, "a.docx", Options(depth=0)).saved


def test_odt():
    old = build({
        "mimetype": "application/vnd.oasis.opendocument.text", "content.xml": '<o><text:p>a <text:span>b</text:span> c</text:p><i xlink:href="Pictures/a.png"/><i xlink:href="Pictures/b.png"/></o>', "meta.xml": "<m><meta:generator>g</meta:generator></m>",
        "Pictures/a.png": PNG, "Pictures/b.png": PNG, "Thumbnails/thumbnail.png": PNG, "Configurations2/x/": "",
        "META-INF/manifest.xml": "<m>" + "".join(f'<manifest:file-entry manifest:full-path="{n}"/>' for n in ("content.xml", "meta.xml", "Pictures/a.png", "Pictures/b.png", "Thumbnails/thumbnail.png")) + "</m>",
    })
    r = optimize(old, "a.odt")
    parts = {p.name: p.data.decode("latin-1") for p in read_zip(r.data)}
    assert r.success and r.format == "ODT" and read_zip(r.data)[0].name == "mimetype" and read_zip(r.data)[0].stored
    assert "Pictures/b.png" not in parts and "b.png" not in parts["META-INF/manifest.xml"] + parts["content.xml"] and "Thumbnails/thumbnail.png" not in parts
    assert "a <text:span>b</text:span> c" in parts["content.xml"]


def test_epub_keeps_what_it_needs():
    opf = '<package><meta name="cover" content="cov"/><item id="p" href="p.xhtml" media-type="application/xhtml+xml"/><item id="cov" href="cover.png" media-type="image/png"/><item id="o" href="orphan.png" media-type="image/png"/></package>'
    old = build({"mimetype": "application/epub+zip", "META-INF/container.xml": "<c/>", "META-INF/encryption.xml": "<e/>", "OPS/b.opf": opf, "OPS/p.xhtml": "<html><p>a <b>b</b> c</p></html>", "OPS/cover.png": PNG, "OPS/orphan.png": PNG + b"1", "OPS/stray.txt": "s" * 99})
    r = optimize(old, "a.epub")
    names = {p.name for p in read_zip(r.data)}
    assert r.success and names == {"mimetype", "META-INF/container.xml", "META-INF/encryption.xml", "OPS/b.opf", "OPS/p.xhtml", "OPS/cover.png"}


@pytest.mark.parametrize("data, hint, message", [(b"", "a.docx", "Empty input"), (b"??", "", "Unknown format"), (b"PK\x03\x04word/", "a.docx", "Left as it is: Refused"), (b"<html></html>", "", AS_IT_IS), (b"RIFF1234WEBPx", "", AS_IT_IS)])
def test_refusals_return_the_input(data, hint, message):
    r = optimize(data, hint)
    assert r.data == data and not r.success and r.message == message and r.bytes_saved == 0 and r.percent == 0.0


@pytest.mark.parametrize("seed", range(40))
def test_damaged_files_never_raise(seed):
    rng = np.random.default_rng(seed)
    whole = [docx(), PNG, pdf([b"<</Type/Catalog>>"]), b"{\\rtf1 {\\fonttbl{\\f0 A;}}x}"][seed % 4]
    bad = bytearray(whole)
    for i in rng.integers(4, len(bad), 12):
        bad[i] = rng.integers(0, 256)
    r = optimize(bytes(bad), "a.docx")
    assert len(r.data) <= len(bad)


@pytest.mark.parametrize("seed", range(60))
def test_packages_cut_or_misplaced_never_raise(seed):
    """Any offset of the directory may point anywhere, and the file may end anywhere."""
    rng = np.random.default_rng(seed)
    raw = bytearray(docx())
    at = raw.index(b"PK\x01\x02")
    raw[at + 42 : at + 46] = int(rng.integers(0, len(raw) + 40)).to_bytes(4, "little")
    raw = bytes(raw) if seed % 2 else bytes(raw[: rng.integers(0, len(raw))])
    assert optimize(raw, "a.docx").data == raw


def test_a_header_inside_the_comment_is_refused():
    entry = b"PK\x01\x02" + bytes(38) + (46 + 22).to_bytes(4, "little")
    raw = entry + b"PK\x05\x06" + bytes(4) + b"\x01\0\x01\0" + len(entry).to_bytes(4, "little") + bytes(4) + b"\x04\0" + b"PK\x03\x04"
    assert optimize(raw, "a.docx").data == raw
    with pytest.raises(Refused):
        read_zip(raw)


def test_sink_is_left_alone_by_a_second_attempt(spark, tmp_path):
    from trimlake.sources.files import write_files

    rows = lambda data: spark.createDataFrame([("a", f"file://{tmp_path}/a.bin", True, data)], "doc_id string, path string, success boolean, content binary")
    for _ in range(2):
        assert write_files(rows(b"one")).first()["output_path"] == f"{tmp_path}/a.slim.bin"
    assert write_files(rows(b"two")).first()["output_path"] == f"{tmp_path}/a.slim.1.bin"
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")) == ["a.slim.1.bin", "a.slim.bin"]


def test_shared_folder_is_refused_on_a_cluster_without_one():
    from types import SimpleNamespace

    from trimlake.session import shared_folder

    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(ValueError):
        shared_folder(SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *_: None)))


def test_tables_of_files(spark, tmp_path):
    from trimlake.plans.optimize import batch_totals, optimize_documents, pass_totals, text_report
    from trimlake.sources.files import repack, scan_files, unpack, write_files
    from trimlake.streaming.ingest import optimize_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.docx").write_bytes(docx())
    (tmp_path / "in" / "b.html").write_bytes(b"<html><!-- x --></html>")
    (tmp_path / "in" / "c.bin").write_bytes(b"??")
    (tmp_path / "in" / "d.docx").write_bytes(b"PK\x03\x04 broken")
    files = scan_files(spark, str(tmp_path / "in"))
    results = optimize_documents(files)
    rows = {r["path"][-6:]: r for r in results.collect()}
    assert rows["a.docx"]["success"] and rows["b.html"]["optimized_size"] == 13 and not rows["/c.bin"]["success"] and not rows["d.docx"]["success"]
    written = write_files(results).collect()
    assert len(written) == 2 and (tmp_path / "in" / "a.slim.docx").exists() and scan_files(spark, str(tmp_path / "in")).count() == 4
    lines = {r["doc_id"][-6:]: r for r in text_report(results).collect()}
    assert "Unknown format" in lines["/c.bin"]["line"] and '"saved_bytes":10' in lines["b.html"]["json"]
    assert {r["format"]: r["optimized"] for r in batch_totals(results).collect()} == {"DOCX": 1, "HTML": 1, "Unknown": 0}
    assert pass_totals(results).where("format IS NULL").first()["raw_saved"] > 0
    parts = unpack(files.where("hint LIKE '%.docx'"))
    assert parts.where("status <> 'ok'").count() == 1
    back = repack(parts).first()["content"]
    assert {p.name: p.data for p in read_zip(back)} == {p.name: p.data for p in read_zip(docx())}
    for _ in range(2):
        optimize_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6


def test_cli(spark, tmp_path, capsys):
    from trimlake.cli import main

    (tmp_path / "b.html").write_bytes(b"<html><!-- x --></html>")
    assert main([]) == 1 and main([str(tmp_path / "none")]) == 1
    assert main([str(tmp_path), "-j"]) == 0
    assert '"format":"HTML"' in capsys.readouterr().out and (tmp_path / "b.slim.html").read_bytes() == b"<html></html>"


def test_reachable_with_cycles(spark):
    from trimlake.operators.relational import reachable

    edges = spark.createDataFrame([(1, "a", "b"), (1, "b", "a"), (1, "c", "d"), (2, "a", "c")], "doc long, src string, dst string")
    roots = spark.createDataFrame([(1, "a"), (2, "x")], "doc long, node string")
    assert sorted(map(tuple, reachable(edges, roots, ["doc"]).collect())) == [(1, "a"), (1, "b"), (2, "x")]


def test_reachable_along_a_chain(spark):
    from trimlake.operators.relational import reachable

    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(59, 3), (100, 101)], "src long, dst long")
    assert sorted(r[0] for r in reachable(edges, spark.createDataFrame([(0,)], "node long")).collect()) == list(range(61))


def test_best_candidate_needs_a_valid_one(spark):
    from trimlake.operators.relational import best_candidate

    df = spark.createDataFrame([(1, 5, 0, True), (1, 3, 1, False), (1, 5, 2, True), (2, 1, 0, False)], "k long, size long, rank int, valid boolean")
    assert sorted(map(tuple, best_candidate(df, ["k"], "size", "rank", "valid", ["size", "rank"]).collect())) == [(1, 5, 0), (2, None, None)]
