"""Functions of one text or file: a case for each edge, with independent decoders as judges."""

from __future__ import annotations

import io
import struct
import xml.etree.ElementTree as ET
import zipfile
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from trimlake.functions import codec, html_text, pdf_bytes, rtf_text, xml_text
from trimlake.functions.codec import Refused
from trimlake.functions.detect import BY_NAME, FORMATS, detect
from trimlake.functions.validate import validate
from trimlake.plans import function_cases
from trimlake.sources.zip_parts import Part, read_zip, write_zip


@pytest.mark.parametrize(
    "xml, ok",
    [
        ("", True), ("text only", True), ("<a/>", True), ("<a><b></b></a>", True), ("<a><b></a></b>", False), ("<a>", False), ("</a>", False), ("<a x='>'/>", True),
        ("<!-- <a> --><b/>", True), ("<![CDATA[<a>]]>", True), ("<?pi <a> ?>", True), ("<!DOCTYPE a><a></a>", True), ("<!-- open", False), ("a < b", False), ("<", False), ("<a", False), ("<a >x</a >", True),
    ],
)
def test_balance(xml, ok):
    assert xml_text.is_balanced(xml) is ok


@pytest.mark.parametrize("old, new", [("1.500", "1.5"), ("1.0cm", "1cm"), ("-0.0", "0"), ("-0.50", "-0.5"), ("a1.50", "a1.50"), ("1:2.50", "1:2.50"), ("1.50/2", "1.50/2"), ("2.50x", "2.50x"), ("100", "100"), ("1.20 3.40pt", "1.2 3.4pt"), ("1.50%", "1.5%"), ("", "")])
def test_trim_numbers(old, new):
    assert xml_text.trim_numbers(old) == new


def test_minify_keeps_what_counts():
    assert xml_text.minify("<a b='say \"x\"'/>") == "<a b='say \"x\"'/>"
    assert xml_text.minify('<a xml:space="preserve"> <b/> </a><c> </c>') == '<a xml:space="preserve"> <b/> </a><c></c>'
    assert xml_text.minify('<a xml:space="preserve"/> <b> x </b>') == '<a xml:space="preserve"/><b> x </b>'
    assert xml_text.minify("<a><![CDATA[ <!-- kept --> ]]></a>") == "<a><![CDATA[ <!-- kept --> ]]></a>"
    assert xml_text.strip_comments("a<!--x-->b<!--open") == "ab"


@settings(max_examples=60, deadline=None)
@given(st.recursive(st.sampled_from(["t", "  u ", ""]), lambda x: st.tuples(st.sampled_from("abc"), st.lists(x, max_size=3)), max_leaves=8))
def test_minify_keeps_elements(tree):
    def text(t):
        return t if isinstance(t, str) else f"<{t[0]}  k = '1.0' >" + "\n".join(map(text, t[1])) + f"</{t[0]}>"

    xml = f"<r>{text(tree)}</r>"
    new = xml_text.minify(xml)
    assert [e.tag for e in ET.fromstring(xml).iter()] == [e.tag for e in ET.fromstring(new).iter()]
    assert "".join("".join(ET.fromstring(xml).itertext()).split()) == "".join("".join(ET.fromstring(new).itertext()).split())
    assert xml_text.minify(new) == new and len(new) <= len(xml)


def test_namespaces_follow_rebinding():
    xml = '<a xmlns:x="1"><b xmlns:x="2"><x:c xmlns:x="1"/></b></a>'
    assert xml_text.drop_repeated_namespaces(xml) == xml


def test_runs_stay_apart():
    apart = "<w:p><w:r><w:t>a</w:t></w:r><w:bookmarkStart/><w:r><w:t>b</w:t></w:r></w:p>"
    assert xml_text.merge_runs(apart) == apart


def test_css():
    assert xml_text.minify_css("a  {\n b : c ;\n}") == "a {b :c ;}"
    assert xml_text.minify_css("a/* open") == "a"


def test_html_keeps_open_comment():
    assert html_text.strip_comments("a<!--x-->b<!--c") == "ab<!--c"


@pytest.mark.parametrize(
    "data, hint, name",
    [
        (b"", "a.pdf", "Unknown"), (b"\x89PNG\r\n\x1a\nx", "", "PNG"), (b"\xff\xd8\xff", "", "JPEG"), (b"%PDF-1", "", "PDF"), (b"{\\rtf1", "", "RTF"), (b"RIFF1234WEBP", "", "WEBP"), (b"RIFF1234WAVE", "", "Unknown"),
        (b"PK\x03\x04application/epub+zip", "", "EPUB"), (b"PK\x03\x04META-INF/manifest.xml", "x.ODS", "ODS"), (b"PK\x03\x04word/", "x.dotx", "DOTX"), (b"PK\x03\x04xl/", "", "XLSX"), (b"PK\x03\x04ppt/", "a.ppsm", "PPSM"),
        (b"PK\x03\x04[Content_Types].xml", "", "DOCX"), (b"PK\x03\x04", "a.html", "HTML"), (b"<html><svg", "", "SVG"), (b"<office:document", "", "FODT"), (b"x", "a.htm", "HTML"), (b"x", "a.JPEG", "JPEG"), (b"x", "", "Unknown"),
    ],
)
def test_detect(data, hint, name):
    assert detect(data, hint) == name


@pytest.mark.parametrize("text", ["xl/", "word/ xl/ ppt/", "META-INF/container.xml", "application/epub+zip", "<svg <html"])
@pytest.mark.parametrize("name, parts", function_cases.FAMILIES)
def test_contents_do_not_decide_a_package(name, parts, text):
    """Bytes of a part, packed or stored, are no names of parts."""
    held = [*(Part(n, d.encode()) for n, d in parts.items()), Part("z.txt", text.encode(), stored=True)]
    assert detect(write_zip(held, best=False)) == name
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:  # a mimetype entry that is packed counts too
        for p in held:
            z.writestr(p.name, p.data)
    assert detect(out.getvalue()) == name
    assert detect(out.getvalue()[:-30], f"a.{name.lower()}") != "Unknown"  # no directory: as bytes
    plain = write_zip([Part("z.txt", text.encode(), stored=True)])
    assert detect(plain) == "Unknown"


def test_format_dimension():
    assert len(FORMATS) == 26 and BY_NAME["JPEG"].extension == ".jpg"


def png(px: np.ndarray, kind: int, table: bytes = b"", extra: list = (), depth: int = 8, lace: int = 0) -> bytes:
    h, w = px.shape[:2]
    rows = np.concatenate([np.zeros((h, 1), np.uint8), px.reshape(h, -1)], axis=1)
    chunks = [(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, kind, 0, 0, lace)), (b"tEXt", b"k\0v")]
    return codec.png_pack([*chunks, *([(b"PLTE", table)] if table else []), *extra, (b"IDAT", zlib.compress(rows.tobytes(), 0)), (b"IEND", b"")])


def plain_pixels(data: bytes) -> tuple[int, int, int, bytes]:
    """Size, colour type and unfiltered rows, decoded apart from the codec."""
    at, idat, head = 8, b"", b""
    while at < len(data):
        n, tag = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + n]
        assert struct.unpack_from(">I", data, at + 8 + n)[0] == zlib.crc32(tag + body)
        idat, head = idat + body * (tag == b"IDAT"), body if tag == b"IHDR" else head
        at += 12 + n
    w, h, _, kind = struct.unpack(">IIBB", head[:10])
    raw, bpp, out, prior = zlib.decompress(idat), codec.CHANNELS[kind], b"", None
    stride = w * bpp
    for y in range(h):
        f, line = raw[y * (stride + 1)], bytearray(raw[y * (stride + 1) + 1 : (y + 1) * (stride + 1)])
        for i in range(stride):
            a, b, c = line[i - bpp] if i >= bpp else 0, prior[i] if prior else 0, prior[i - bpp] if prior and i >= bpp else 0
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            line[i] = (line[i] + (0, a, b, (a + b) // 2, near)[f]) % 256
        prior, out = line, out + bytes(line)
    return w, h, kind, out


@pytest.mark.parametrize("seed", range(3))
def test_png_reductions(seed):
    rng = np.random.default_rng(seed)
    gray = np.repeat(rng.integers(0, 256, (9, 7, 1), dtype=np.uint8), 3, axis=2)
    few = rng.integers(0, 256, (3, 3), dtype=np.uint8)[rng.integers(0, 3, (40, 40))]
    many = rng.integers(0, 256, (30, 30, 3), dtype=np.uint8)
    opaque = np.concatenate([many, np.full((30, 30, 1), 255, np.uint8)], axis=2)
    clear = np.concatenate([many, rng.integers(0, 255, (30, 30, 1), dtype=np.uint8)], axis=2)
    for px, kind, wanted in ((gray, 2, 0), (few, 2, 3), (many, 2, 2), (opaque, 6, 2), (clear, 6, 6)):
        old = png(px, kind)
        new = codec.optimize_png(old)
        assert len(new) < len(old) and np.array_equal(codec.png_pixels(new), codec.png_pixels(old))
        w, h, found, rows = plain_pixels(new)
        assert (w, h) == px.shape[1::-1] and found == wanted
        if wanted == 0:
            assert rows == px[..., 0].tobytes()
        if wanted == 2:
            assert rows == px[..., :3].tobytes()
        assert codec.optimize_png(new) == new or len(codec.optimize_png(new)) < len(new)


def test_png_transparency_is_left_alone():
    px = np.arange(16, dtype=np.uint8).reshape(4, 4, 1) % 4
    old = png(px, 3, bytes(range(12)), [(b"tRNS", b"\0\x80\xff\xff")])
    new = codec.optimize_png(old)
    assert b"PLTE" in new and b"tRNS" in new and np.array_equal(codec.png_pixels(new), codec.png_pixels(old))


def test_png_refusals():
    px = np.zeros((2, 2, 3), np.uint8)
    for old in (b"", b"x", png(px, 2)[:-20]):
        assert codec.optimize_png(old) == old
    for old in (png(px, 2, lace=1), png(np.zeros((2, 4, 3), np.uint8), 2, depth=16)):
        new = codec.optimize_png(old)
        assert len(new) <= len(old) and new[16:29] == old[16:29]


def test_jpeg_keeps_orientation_and_profile():
    seg = lambda tag, body: b"\xff" + bytes((tag,)) + struct.pack(">H", len(body) + 2) + body
    exif = b"Exif\0\0II*\0" + struct.pack("<IHHHIHHI", 8, 1, 0x0112, 3, 1, 6, 0, 0) + b"maker note" * 9
    icc = seg(0xE2, b"ICC_PROFILE\0\1\1data")
    old = b"\xff\xd8" + seg(0xE0, b"JFIF\0\1\2\0\0\1\0\1\2\1" + b"t" * 6) + seg(0xE1, exif) + icc + seg(0xFE, b"note") + seg(0xEE, b"Adobe") + seg(0xDA, b"s") + b"scan\xff\xd9"
    new = codec.optimize_jpeg(old)
    assert len(new) < len(old) and icc in new and b"Adobe" in new and b"note" not in new and new.endswith(b"scan\xff\xd9")
    assert codec._orientation(new[new.index(b"Exif") :]) == 6
    assert codec.optimize_jpeg(new) == new and codec.optimize_jpeg(b"\xff\xd8\xff") == b"\xff\xd8\xff"


def test_inflate_cap():
    with pytest.raises(Refused):
        codec.inflate(zlib.compress(b"\0" * 10_000), cap=100)
    with pytest.raises(Refused):
        codec.inflate(b"junk")


def font() -> bytes:
    """Glyphs 0 to 4; 3 is composed of 2; A to C are glyphs 1, 3 and 4."""
    simple = struct.pack(">hhhhh", 1, 0, 0, 9, 9) + b"outline!" * 4
    glyphs = [simple, simple, simple, struct.pack(">hhhhh", -1, 0, 0, 9, 9) + struct.pack(">HHbb", 2, 2, 0, 0), simple]
    glyf, loca = b"", [0]
    for g in glyphs:
        glyf += g + b"\0" * (-len(g) % 4)
        loca.append(len(glyf))
    segments = [(65, 65, 1 - 65), (66, 67, 3 - 66), (0xFFFF, 0xFFFF, 1)]
    n = len(segments)
    sub = struct.pack(">HHHHHHH", 4, 16 + 8 * n, 0, 2 * n, 4, 1, 2)
    sub += b"".join(struct.pack(">H", e) for _, e, _ in segments) + b"\0\0" + b"".join(struct.pack(">H", s) for s, _, _ in segments)
    sub += b"".join(struct.pack(">h", d) for _, _, d in segments) + b"\0\0" * n
    tables = {"head": b"\0" * 50 + struct.pack(">hh", 1, 0), "maxp": struct.pack(">IH", 0x10000, 5) + b"\0" * 26, "loca": np.array(loca, ">u4").tobytes(), "glyf": glyf, "cmap": struct.pack(">HHHHI", 0, 1, 3, 1, 12) + sub, "GPOS": b"k" * 40}
    return codec.pack_font(tables)


def test_font_subset_keeps_components():
    old = font()
    new = codec.subset_font(old, {ord("B")})
    t = codec.font_tables(new)
    loca = np.frombuffer(t["loca"], ">u4")
    assert [bool(x) for x in np.diff(loca.astype(int))] == [True, False, True, True, False]
    assert "GPOS" not in t and len(new) < len(old)
    assert codec._checksum(new) == 0xB1B0AFBA
    assert codec.subset_font(b"junk", {65}) == b"junk"


def test_font_obfuscation_is_its_own_inverse():
    key = "{01234567-89AB-CDEF-0123-456789ABCDEF}"
    data = bytes(range(100))
    assert codec.deobfuscate_font(codec.deobfuscate_font(data, key), key) == data
    with pytest.raises(Refused):
        codec.deobfuscate_font(data, "no key")


def test_zip_order_and_flags():
    raw = write_zip([Part("b.xml", b"x" * 99), Part("[Content_Types].xml", b"<T/>"), Part("mimetype", b"m"), Part("a.bin", b"\1\2", 7, True), Part("b.xml", b"y" * 99)])
    z = zipfile.ZipFile(io.BytesIO(raw))
    assert z.testzip() is None and z.namelist() == ["mimetype", "[Content_Types].xml", "a.bin", "b.xml"]
    assert z.read("b.xml") == b"y" * 99 and z.infolist()[0].compress_type == 0 and z.getinfo("a.bin").external_attr == 7


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.text(st.characters(min_codepoint=33, max_codepoint=0x2FF, exclude_characters="\\/"), min_size=1, max_size=9), st.binary(max_size=300), max_size=6))
def test_zip_round_trip(parts):
    raw = write_zip([Part(n, d) for n, d in parts.items()])
    assert {p.name: p.data for p in read_zip(raw)} == parts
    z = zipfile.ZipFile(io.BytesIO(raw))
    assert {n: z.read(n) for n in z.namelist()} == parts


def test_zip_refusals():
    raw = write_zip([Part("a", b"hello hello hello hello")])
    broken = raw.replace(b"PK\x01\x02", b"PK\x09\x09")
    for bad in (b"", b"PK\x03\x04", raw[:-5], broken, raw[:31] + bytes((raw[31] ^ 255,)) + raw[32:]):
        with pytest.raises(Refused):
            read_zip(bad)
    other = io.BytesIO()
    with zipfile.ZipFile(other, "w", zipfile.ZIP_LZMA) as z:
        z.writestr("a", b"x")
    with pytest.raises(Refused):
        read_zip(other.getvalue())


@pytest.mark.parametrize("rtf, ok", [("{\\rtf1 a}", True), ("{\\rtf1 \\{ }", True), ("{\\rtf1 {}", False), ("{\\rtf1 }}", False), ("x{\\rtf1}", False), ("", False)])
def test_rtf_valid(rtf, ok):
    assert rtf_text.is_valid(rtf) is ok


@pytest.mark.parametrize(
    "rtf, want",
    [
        ("\\b\\b x\\ql\\qj {}y", "\\b x\\qj y"), ("\\tab\\tab\\par\\par x", "\\tab\\tab\\par\\par x"), ("\\fs20\\b\\fs24 x", "\\b\\fs24 x"), ("\\ql x\\qj y", "\\ql x\\qj y"),
        ("\\ql{\\qj x}", "\\ql{\\qj x}"), ("\\b\r\n\\b0 x", "\r\n\\b0 x"), ("\\{ }", "\\{ }"), ("\\b{}x", "\\b{}x"), ("a{{}\r\n}b", "a\r\nb"), ("{ }", "{ }"), ("\\sa0\\sa0\\sb5 x", "\\sa0\\sb5 x"), ("", ""),
    ],
)
def test_rtf_states(rtf, want):
    """A state set again before anything it applies to goes; words that make something stay, however often they come."""
    assert rtf_text.normalize_states(rtf) == want


def test_rtf_pictures():
    old = png(np.zeros((8, 8, 3), np.uint8), 2)
    rtf = "{\\rtf1 {\\pict\\pngblip\\picw8\n" + old.hex() + "}x}"
    new = rtf_text.optimize_rtf(rtf)
    assert len(new) < len(rtf) and bytes.fromhex("".join(new[new.index("8950") : new.index("}x")].split())) == codec.optimize_png(old)


def test_rtf_keeps_fonts_in_use():
    rtf = "{\\rtf1\\deff2{\\fonttbl{\\f0 A;}{\\f1 B;}{\\f2 C;}}\\af1 x}"
    assert rtf_text.prune_fonts(rtf) == "{\\rtf1\\deff2{\\fonttbl{\\f1 B;}{\\f2 C;}}\\af1 x}"
    assert rtf_text.optimize_rtf("{\\rtf1 \\bin3 }{x}") == "{\\rtf1 \\bin3 }{x}"


def pdf(objects: list[bytes], trailer: bytes = b"<</Root 1 0 R>>") -> bytes:
    body = b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%b\nendobj\n" % (i + 1, o) for i, o in enumerate(objects))
    return body + b"xref\n0 1\n0000000000 65535 f \ntrailer\n" + trailer + b"\nstartxref\n%d\n%%%%EOF\n" % len(body)


def test_pdf_ways_agree():
    data = b"0 0 m 1 1 l S " * 40
    old = pdf([b"<</Type/Catalog/Pages 2 0 R>>", b"<</Type/Pages/Kids[3 0 R]/Count 1>>", b"<</Type/Page/Parent 2 0 R/Contents 4 0 R>>", b"<</Length 5 0 R>>\nstream\n" + data + b"\nendstream", b"%d" % len(data), b"<</Unused true>>", b"<</Title(x 1 0 R)>>"], b"<</Root 1 0 R/Info 7 0 R/ID[<01><02>]>>")
    new, _ = pdf_bytes.optimize_pdf(old)
    assert len(new) < len(old) and validate(new, "PDF") and b"Unused" not in new
    objects, trailer = pdf_bytes.scan(old)
    for packed in (False, True):
        w = pdf_bytes.write_stream(b"%PDF-1.5\n", objects, b"1 0 R", b"", packed)
        start = int(w.rpartition(b"startxref\n")[2].split()[0])
        assert w[start:].split()[2] == b"obj" and b"/XRef" in w[start:]
    w = pdf_bytes.write_table(b"%PDF-1.4\n", objects, b"1 0 R", b"")
    start = int(w.rpartition(b"startxref\n")[2].split()[0])
    rows = w[start:].split(b"\n")
    assert rows[0] == b"xref" and rows[3] == b"1 7"
    for i, row in enumerate(rows[4:11]):
        assert w[int(row[:10]) :].startswith(b"%d 0 obj" % (i + 1))


def test_pdf_inlining_does_not_touch_longer_numbers():
    objects = {1: pdf_bytes.Obj(0, b"<</Type/Catalog/A 2 0 R/B 12 0 R>>"), 2: pdf_bytes.Obj(0, b"7"), 12: pdf_bytes.Obj(0, b"<</C 13 0 R>>"), 13: pdf_bytes.Obj(0, b"[1]")}
    new = pdf_bytes.inline_small(objects, {1})
    assert new[1].text == b"<</Type/Catalog/A  7 /B 12 0 R>>" and new[12].text == b"<</C  [1] >>"


def test_pdf_content_in_strings_stays():
    assert pdf_bytes.clean_content(b"(q Q) Tj 1 w") == b"(q Q) Tj 1 w"
    assert pdf_bytes.clean_content(b"BI /W 1 ID q Q EI") == b"BI /W 1 ID q Q EI"
    assert pdf_bytes.clean_content(b"(a (nested) q Q) Tj") == b"(a (nested) q Q) Tj"


def test_pdf_refusals():
    plain = pdf([b"<</Type/Catalog>>"])
    for more, message in ((b"/ByteRange/Sig", "Signed PDF preserved"), (b"/Encrypt", "Encrypted PDF preserved"), (b"<</Type/ObjStm>>", "compressed")):
        data, said = pdf_bytes.optimize_pdf(plain + more)
        assert data == plain + more and message in said


def test_validate():
    assert not validate(b"", "HTML") and validate(b"x", "WEBP") and validate(b"<html>", "HTML") and not validate(b"x", "HTML")
    assert validate(b"<a/>", "SVG") and not validate(b"<a>", "SVG") and not validate(b"PK", "DOCX") and not validate(b"%PDF-", "PDF")
