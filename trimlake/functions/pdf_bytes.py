"""PDF files: objects, reachability, stream recompression, content clean-up, inlining, and three ways to write them.

Signed and encrypted files, and those with compressed objects, are left alone.
"""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass, replace

import numpy as np

from trimlake.functions.codec import Refused, deflate_best, filter_rows, inflate

_OBJ = re.compile(rb"(?<![0-9])(\d{1,9})\s+(\d{1,5})\s+obj\b")
_REF = re.compile(rb"(?<![0-9.])(\d{1,9})\s+(\d{1,5})\s+R(?![A-Za-z0-9])")
_STREAM = re.compile(rb"(?<=>)\s*stream(\r\n|\n|\r)")
_LENGTH = re.compile(rb"/Length\s+\d+(?:\s+\d+\s+R)?")
#: Bytes below which a bare stream stays bare, and bytes that compressing one must save.
BARE_LEAST, BARE_GAIN = 64, 26
#: Fixed value: bytes of an object that may be written where it is used.
INLINE_MOST = 128
COLOURS = {b"DeviceRGB": 3, b"DeviceGray": 1, b"DeviceCMYK": 4}


@dataclass(frozen=True)
class Obj:
    gen: int
    text: bytes  # the dictionary of a stream, else the whole body
    stream: bytes | None = None


def is_signed(pdf: bytes) -> bool:
    return b"/ByteRange" in pdf and (b"/Sig" in pdf or b"/DocChecksum" in pdf)


def is_encrypted(pdf: bytes) -> bool:
    return b"/Encrypt" in pdf


def is_valid(pdf: bytes) -> bool:
    return len(pdf) >= 30 and pdf.startswith(b"%PDF-") and all(x in pdf for x in (b"%%EOF", b"startxref", b"/Root"))


def scan(pdf: bytes) -> tuple[dict[int, Obj], bytes]:
    """All objects, the last of each number, and the last trailer's dictionary."""
    out: dict[int, Obj] = {}
    at = 0
    while m := _OBJ.search(pdf, at):
        end = pdf.find(b"endobj", m.end())
        s = _STREAM.search(pdf, m.end())
        if end < 0:
            raise Refused("object does not end")
        if s and s.start() < end:
            head = pdf[m.end() : s.start()].strip()
            stated = re.search(rb"/Length\s+(\d+)(?!\s+\d+\s+R)", head)
            stop = -1
            if stated:
                k = s.end() + int(stated[1])
                if pdf[k : k + 12].lstrip().startswith(b"endstream"):
                    stop = k
            if stop < 0:
                stop = pdf.find(b"endstream", s.end())
                if stop < 0:
                    raise Refused("stream does not end")
                stop -= 2 if pdf[stop - 2 : stop] == b"\r\n" else 1 if pdf[stop - 1 : stop] in (b"\n", b"\r") else 0
            out[int(m[1])] = Obj(int(m[2]), head, pdf[s.end() : stop])
            end = pdf.find(b"endobj", stop)
            if end < 0:
                raise Refused("object does not end")
        else:
            out[int(m[1])] = Obj(int(m[2]), pdf[m.end() : end].strip())
        at = end + 6
    t = pdf.rfind(b"trailer")
    if t >= 0:
        trailer = pdf[t + 7 : pdf.find(b"startxref", t)].strip()
    else:
        trailer = next((o.text for o in reversed(out.values()) if o.stream is not None and re.search(rb"/Type\s*/XRef\b", o.text)), b"")
    return out, trailer


def refs(text: bytes) -> list[int]:
    return [int(m[1]) for m in _REF.finditer(text)]


def root_of(objects: dict[int, Obj], trailer: bytes) -> int:
    m = re.search(rb"/Root\s+(\d+)\s+\d+\s+R", trailer)
    if m and int(m[1]) in objects:
        return int(m[1])
    found = [i for i, o in objects.items() if re.search(rb"/Type\s*/Catalog\b", o.text)]
    if not found:
        raise Refused("no catalog")
    return found[0]


def reachable(objects: dict[int, Obj], roots: list[int]) -> set[int]:
    """Closure over references; every object enters once, so cycles end."""
    seen, queue = set(), [r for r in roots if r in objects]
    while queue:
        i = queue.pop()
        if i not in seen:
            seen.add(i)
            queue += [r for r in refs(objects[i].text) if r in objects and r not in seen]
    return seen


_CONTENT = re.compile(rb"\s+|\((?:[^()\\]|\\[\s\S])*+\)|<[0-9A-Fa-f\s]*>|/[^\s()<>\[\]{}/%]*|\[|\]|[^\s()<>\[\]{}/%]+")


def clean_content(data: bytes) -> bytes:
    """Drawing operators without those that do nothing. Strings are single tokens; streams with anything else than simple
    operands (inline images, nested strings, dictionaries, comments) are left alone."""
    tokens, at = [], 0
    while at < len(data):
        m = _CONTENT.match(data, at)
        if not m:
            return data
        at = m.end()
        if not m[0].isspace():
            tokens.append(m[0])
    if b"BI" in tokens:
        return data
    ops: list[tuple[bytes, ...]] = []
    now: list[bytes] = []
    for t in tokens:
        now.append(t)
        if re.fullmatch(rb"[A-Za-z'\"][A-Za-z0-9*'\"]*", t) and t not in (b"true", b"false", b"null"):
            one = tuple(now)
            now = []
            last = ops[-1] if ops else ()
            if one == (b"Q",) and last == (b"q",) or one == (b"ET",) and last == (b"BT",):
                ops.pop()
            elif one[-1] == b"cm" and len(one) == 7 and _identity(one[:-1]):
                pass
            elif one[-1] in (b"rg", b"RG", b"g", b"G", b"w") and one == last:
                pass
            elif one[-1] == b"Tj" and last[-1:] == (b"Tj",) and len(one) == len(last) == 2 and one[0][:1] == last[0][:1] == b"(":
                ops[-1] = (last[0][:-1] + one[0][1:], b"Tj")
            else:
                ops.append(one)
    if now:
        return data
    new = b"\n".join(b" ".join(o) for o in ops)
    return new if len(new) < len(data) else data


def _identity(v: tuple[bytes, ...]) -> bool:
    try:
        return [float(x) for x in v] == [1, 0, 0, 1, 0, 0]
    except ValueError:
        return False


def _set(text: bytes, key: bytes, value: bytes) -> bytes:
    """A dictionary with an entry added before its end."""
    return text[: text.rstrip().rfind(b">>")] + b"/" + key + value + b">>"


def recompress(o: Obj, drawing: bool = False) -> Obj:
    """A stream with its data compressed anew, if that saves."""
    if o.stream is None:
        return o
    whole = re.search(rb"/Filter\s*(?:/FlateDecode|\[\s*/FlateDecode\s*\])(?=[\s/>])", o.text)
    if whole:
        try:
            plain = inflate(o.stream)
        except Refused:
            return o
        text, data = o.text, clean_content(plain) if drawing and b"/DecodeParms" not in o.text else plain
        best = deflate_best(data)
        size = re.search(rb"/Width\s+(\d+)", text), re.search(rb"/Height\s+(\d+)", text)
        colour = re.search(rb"/ColorSpace\s*/(\w+)", text)
        if all(size) and colour and colour[1] in COLOURS and b"/DecodeParms" not in text and re.search(rb"/BitsPerComponent\s+8\b", text):
            w, h, n = int(size[0][1]), int(size[1][1]), COLOURS[colour[1]]
            if len(data) == w * h * n and data:
                rows = deflate_best(filter_rows(np.frombuffer(data, dtype=np.uint8).reshape(h, w * n), n))
                parms = b"<</Predictor 15/Colors %d/BitsPerComponent 8/Columns %d>>" % (n, w)
                if len(rows) + len(parms) + 13 < len(best):
                    best, text = rows, _set(text, b"DecodeParms", parms)
        return replace(o, text=text, stream=best) if len(best) + len(text) < len(o.stream) + len(o.text) else o
    if not re.search(rb"/Filter\b", o.text) and not re.search(rb"/F\s*[(<]", o.text):
        data = clean_content(o.stream) if drawing else o.stream
        best = deflate_best(data) if len(data) > BARE_LEAST else data
        if len(data) > BARE_LEAST and len(best) + BARE_GAIN <= len(data):
            return replace(o, text=_set(o.text, b"Filter", b"/FlateDecode"), stream=best)
        return replace(o, stream=data)
    return o


def inline_small(objects: dict[int, Obj], keep: set[int]) -> dict[int, Obj]:
    """Small objects without references that are used once are written where they are used."""
    uses: dict[int, int] = {}
    for o in objects.values():
        for r in refs(o.text):
            uses[r] = uses.get(r, 0) + 1
    small = {
        i: o.text for i, o in objects.items()
        if o.stream is None and i not in keep and uses.get(i) == 1 and len(o.text) <= INLINE_MOST and not refs(o.text) and not re.search(rb"/Type\s*/(?:Page|Pages|Catalog)\b", o.text)
    }
    put = lambda m: b" " + small[int(m[1])] + b" " if int(m[1]) in small else m[0]
    return {i: replace(o, text=_REF.sub(put, o.text)) for i, o in objects.items() if i not in small}


def _body(i: int, o: Obj) -> bytes:
    if o.stream is None:
        return b"%d %d obj\n%b\nendobj\n" % (i, o.gen, o.text)
    text = _LENGTH.sub(b"/Length %d" % len(o.stream), o.text) if _LENGTH.search(o.text) else _set(o.text, b"Length", b" %d" % len(o.stream))
    return b"%d %d obj\n%b\nstream\n%b\nendstream\nendobj\n" % (i, o.gen, text, o.stream)


def _entries(trailer: bytes) -> bytes:
    """What a trailer says about the document: catalog aside, its information and its id."""
    info = re.search(rb"/Info\s+\d+\s+\d+\s+R", trailer)
    own = re.search(rb"/ID\s*\[[^\]]*\]", trailer)
    return b"".join(m[0] for m in (info, own) if m)


def write_table(header: bytes, objects: dict[int, Obj], root: bytes, more: bytes) -> bytes:
    """With a classic cross-reference table."""
    out, places = bytearray(header), {}
    for i in sorted(objects):
        places[i] = len(out)
        out += _body(i, objects[i])
    start = len(out)
    out += b"xref\n0 1\n0000000000 65535 f \n"
    ids = sorted(objects)
    for k in range(len(ids)):
        if not k or ids[k] != ids[k - 1] + 1:
            run = 1
            while k + run < len(ids) and ids[k + run] == ids[k] + run:
                run += 1
            out += b"%d %d\n" % (ids[k], run)
        out += b"%010d %05d n \n" % (places[ids[k]], objects[ids[k]].gen)
    out += b"trailer\n<</Size %d/Root %b%b>>\nstartxref\n%d\n%%%%EOF\n" % (max(ids) + 1, root, more, start)
    return bytes(out)


def write_stream(header: bytes, objects: dict[int, Obj], root: bytes, more: bytes, packed: bool) -> bytes:
    """With a cross-reference stream; if packed, with the plain objects in an object stream."""
    out, rows = bytearray(header), {0: (0, 0, 65535)}
    inner = [i for i in sorted(objects) if packed and objects[i].stream is None and objects[i].gen == 0]
    top = max(objects) + 1
    outer = {i: o for i, o in objects.items() if i not in inner}
    if inner:
        head, body = b"", b""
        for k, i in enumerate(inner):
            head += b"%d %d " % (i, len(body))
            body += objects[i].text + b"\n"
            rows[i] = (2, top, k)
        outer[top] = Obj(0, b"<</Type/ObjStm/N %d/First %d/Filter/FlateDecode>>" % (len(inner), len(head)), deflate_best(head + body))
        top += 1
    for i in sorted(outer):
        rows[i] = (1, len(out), outer[i].gen)
        out += _body(i, outer[i])
    rows[top] = (1, len(out), 0)
    index, table, last = [], b"", None
    for i in sorted(rows):
        if last is None or i != last + 1:
            index.append([i, 0])
        index[-1][1] += 1
        last = i
        table += struct.pack(">BIH", *rows[i])
    text = b"<</Type/XRef/Size %d/W[1 4 2]/Index[%b]/Root %b%b/Filter/FlateDecode>>" % (top + 1, b" ".join(b"%d %d" % tuple(x) for x in index), root, more)
    start = len(out)
    out += _body(top, Obj(0, text, deflate_best(table)))
    return bytes(out + b"startxref\n%d\n%%%%EOF\n" % start)


def optimize_pdf(pdf: bytes) -> tuple[bytes, str]:
    """The smallest valid of three ways to write the optimised objects, and a message; the input if none is smaller."""
    if is_signed(pdf):
        return pdf, "Signed PDF preserved"
    if is_encrypted(pdf):
        return pdf, "Encrypted PDF preserved"
    try:
        if re.search(rb"/Type\s*/ObjStm\b", pdf):
            raise Refused("compressed objects")
        objects, trailer = scan(pdf)
        root = root_of(objects, trailer)
        info = re.search(rb"/Info\s+(\d+)\s", trailer)
        more = _entries(trailer)
        kept = reachable(objects, [root, *([int(info[1])] if info else []), *refs(more)])
        drawn = {r for i in kept for m in re.finditer(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", objects[i].text) for r in refs(m[1])}
        # Parts of one page's content are cut anywhere: only whole streams are cleaned.
        split = {r for i in kept for m in re.finditer(rb"/Contents\s*\[([^\]]*)\]", objects[i].text) if len(refs(m[1])) > 1 for r in refs(m[1])}
        form = {i for i in kept if re.search(rb"/Subtype\s*/Form\b", objects[i].text)}
        new = {i: recompress(objects[i], i in (drawn | form) - split) for i in kept}
        new = inline_small(new, {root, *([int(info[1])] if info else [])})
        version = re.match(rb"%PDF-(\d\.\d)", pdf)
        top = b"%PDF-" + (version[1] if version else b"1.4") + b"\n%\xe2\xe3\xcf\xd3\n"
        modern = b"%PDF-" + max(version[1] if version else b"1.4", b"1.5") + b"\n%\xe2\xe3\xcf\xd3\n"
        name = b"%d %d R" % (root, objects[root].gen)
        ways = [write_table(top, new, name, more), write_stream(modern, new, name, more, False), write_stream(modern, new, name, more, True)]
    except (Refused, ValueError, struct.error) as e:
        return pdf, f"PDF left as it is: {e}"
    best = min((w for w in ways if is_valid(w)), key=len, default=pdf)
    return (best, "") if len(best) < len(pdf) else (pdf, "")
