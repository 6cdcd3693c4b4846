"""Byte codecs: deflate, PNG, JPEG, obfuscated and TrueType fonts. No Spark here.

Everything that inflates has a cap, and a refusal leaves the input as it is.
"""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np

#: Most bytes that one stream may inflate to, and most pixels of an image that is looked into.
INFLATE_CAP = 256 << 20
MOST_PIXELS = 64 << 20
ONE_TRY = 512


class Refused(ValueError):
    """Input that a codec leaves alone."""


def inflate(data: bytes, wbits: int = 15, cap: int = INFLATE_CAP) -> bytes:
    d = zlib.decompressobj(wbits)
    try:
        out = d.decompress(data, cap)
    except zlib.error as e:
        raise Refused(str(e)) from e
    if d.unconsumed_tail or not d.eof:
        raise Refused("stream is cut short or too long")
    return out


def deflate_best(data: bytes, wbits: int = 15) -> bytes:
    """The shortest of several settings of the standard library's compressor; data of up to ONE_TRY bytes, where they hardly differ, get the first one."""
    tries = ((8, zlib.Z_DEFAULT_STRATEGY), (9, zlib.Z_DEFAULT_STRATEGY), (9, zlib.Z_FILTERED), (9, zlib.Z_RLE))
    best = None
    for mem, strategy in tries if len(data) > ONE_TRY else tries[:1]:
        c = zlib.compressobj(9, zlib.DEFLATED, wbits, mem, strategy)
        out = c.compress(data) + c.flush()
        if best is None or len(out) < len(best):
            best = out
    return best


# PNG

PNG_SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Chunks that stay; channels by colour type.
PNG_KEPT = (b"IHDR", b"PLTE", b"tRNS", b"iCCP", b"IEND")
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def png_chunks(data: bytes) -> list[tuple[bytes, bytes]]:
    if not data.startswith(PNG_SIGNATURE):
        raise Refused("no PNG signature")
    out, at = [], 8
    while at + 12 <= len(data):
        n, tag = struct.unpack_from(">I4s", data, at)
        if at + 12 + n > len(data):
            raise Refused("chunk is cut short")
        out.append((tag, data[at + 8 : at + 8 + n]))
        at += 12 + n
        if tag == b"IEND":
            return out
    raise Refused("no end chunk")


def png_pack(chunks: list[tuple[bytes, bytes]]) -> bytes:
    return PNG_SIGNATURE + b"".join(struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d)) for t, d in chunks)


def _unfilter(raw: bytes, width: int, height: int, bpp: int) -> np.ndarray:
    """Rows of bytes (height, width * bpp), filters undone."""
    stride = width * bpp
    rows = np.frombuffer(raw, dtype=np.uint8).reshape(height, stride + 1)
    out = np.zeros((height, stride), dtype=np.uint8)
    above = np.zeros(stride, dtype=np.uint8)
    for y in range(height):
        kind, line = int(rows[y, 0]), rows[y, 1:]
        if kind == 0:
            now = line.copy()
        elif kind == 1:
            now = np.cumsum(line.reshape(-1, bpp), axis=0, dtype=np.uint64).astype(np.uint8).reshape(-1)
        elif kind == 2:
            now = line + above
        elif kind in (3, 4):
            a, left, up, corner = bytearray(line.tobytes()), 0, above.tobytes(), 0
            for i in range(stride):
                left = a[i - bpp] if i >= bpp else 0
                if kind == 3:
                    a[i] = (a[i] + (left + up[i]) // 2) & 255
                else:
                    corner = up[i - bpp] if i >= bpp else 0
                    p = left + up[i] - corner
                    pa, pb, pc = abs(p - left), abs(p - up[i]), abs(p - corner)
                    a[i] = (a[i] + (left if pa <= pb and pa <= pc else up[i] if pb <= pc else corner)) & 255
            now = np.frombuffer(bytes(a), dtype=np.uint8)
        else:
            raise Refused("unknown filter")
        out[y] = above = now
    return out


def filter_rows(rows: np.ndarray, bpp: int) -> bytes:
    """Rows with, each, the filter whose differences are smallest in sum."""
    height, stride = rows.shape
    x = rows.astype(np.int16)
    left = np.zeros_like(x)
    left[:, bpp:] = x[:, :-bpp] if stride > bpp else left[:, bpp:]
    up = np.zeros_like(x)
    up[1:] = x[:-1]
    corner = np.zeros_like(x)
    if stride > bpp:
        corner[1:, bpp:] = x[:-1, :-bpp]
    p = left + up - corner
    pa, pb, pc = abs(p - left), abs(p - up), abs(p - corner)
    paeth = np.where((pa <= pb) & (pa <= pc), left, np.where(pb <= pc, up, corner))
    coded = np.stack([x, x - left, x - up, x - (left + up) // 2, x - paeth]).astype(np.uint8)
    cost = np.minimum(coded, 256 - coded.astype(np.int32)).sum(axis=2)
    best = cost.argmin(axis=0)
    out = np.empty((height, stride + 1), dtype=np.uint8)
    out[:, 0] = best
    out[:, 1:] = coded[best, np.arange(height)]
    return out.tobytes()


def png_pixels(data: bytes) -> np.ndarray:
    """Pixels of an 8-bit, non-interlaced image as (height, width, 4) RGBA: what a viewer would show."""
    chunks = dict((t, d) for t, d in png_chunks(data) if t != b"IDAT")
    w, h, depth, kind, _, _, lace = struct.unpack(">IIBBBBB", chunks[b"IHDR"])
    if depth != 8 or lace or w * h > MOST_PIXELS:
        raise Refused("not a plain 8-bit image")
    n = CHANNELS[kind]
    raw = inflate(b"".join(d for t, d in png_chunks(data) if t == b"IDAT"), cap=h * (w * n + 1) + 1)
    if len(raw) != h * (w * n + 1):
        raise Refused("wrong amount of pixel data")
    px = _unfilter(raw, w, h, n).reshape(h, w, n)
    alpha = np.full((h, w, 1), 255, np.uint8)
    if kind == 3:
        table = np.frombuffer(chunks[b"PLTE"], dtype=np.uint8).reshape(-1, 3)
        clear = np.frombuffer(chunks.get(b"tRNS", b""), dtype=np.uint8)
        fade = np.full(len(table), 255, np.uint8)
        fade[: len(clear)] = clear[: len(table)]
        return np.concatenate([table[px[..., 0]], fade[px[..., 0]][..., None]], axis=2)
    rgb = np.repeat(px[..., :1], 3, axis=2) if kind in (0, 4) else px[..., :3]
    if kind in (4, 6):
        alpha = px[..., -1:]
    return np.concatenate([rgb, alpha], axis=2)


def _reduced(w: int, h: int, px: np.ndarray) -> list[tuple[bytes, bytes]]:
    """Chunks of the plainest colour type that shows RGBA pixels; transparency, if any, stays as alpha."""
    head = lambda kind: struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)
    body = lambda rows, n: deflate_best(filter_rows(np.ascontiguousarray(rows).reshape(h, -1), n))
    gray = (px[..., 0] == px[..., 1]).all() and (px[..., 1] == px[..., 2]).all()
    if (px[..., 3] != 255).any():
        rows, n, kind = (px[..., [0, 3]], 2, 4) if gray else (px, 4, 6)
        return [(b"IHDR", head(kind)), (b"IDAT", body(rows, n))]
    if gray:
        return [(b"IHDR", head(0)), (b"IDAT", body(px[..., 0], 1))]
    flat = px[..., :3].reshape(-1, 3).astype(np.uint32)
    codes, inverse, count = np.unique(flat[:, 0] << 16 | flat[:, 1] << 8 | flat[:, 2], return_inverse=True, return_counts=True)
    rgb = [(b"IHDR", head(2)), (b"IDAT", body(px[..., :3], 3))]
    if len(codes) > 256:
        return rgb
    order = np.argsort(-count, kind="stable")
    place = np.empty(len(order), np.uint8)
    place[order] = np.arange(len(order))
    table = np.stack([codes[order] >> 16, codes[order] >> 8 & 255, codes[order] & 255], axis=1).astype(np.uint8)
    index = place[inverse].reshape(h, w)
    plain = np.zeros((h, w + 1), np.uint8)
    plain[:, 1:] = index
    coded = min(body(index, 1), deflate_best(plain.tobytes()), key=len)
    indexed = [(b"IHDR", head(3)), (b"PLTE", table.tobytes()), (b"IDAT", coded)]
    return min(rgb, indexed, key=lambda c: sum(len(d) + 12 for _, d in c))


def optimize_png(data: bytes) -> bytes:
    """The smallest of: the image's data compressed anew, and a plainer colour type. The input, if neither is smaller.

    A colour type changes only where no transparency chunk refers to it, and only if all pixels stay the same.
    """
    try:
        chunks = png_chunks(data)
        raw = inflate(b"".join(d for t, d in chunks if t == b"IDAT"))
    except Refused:
        return data
    kept = [(t, d) for t, d in chunks if t in PNG_KEPT]
    again = png_pack([*kept[:-1], (b"IDAT", deflate_best(raw)), kept[-1]])
    best = again if len(again) < len(data) else data
    try:
        px = png_pixels(data)
        names = {t for t, _ in kept}
        if b"tRNS" not in names and b"iCCP" not in names:
            new = png_pack([*_reduced(px.shape[1], px.shape[0], px), (b"IEND", b"")])
            if len(new) < len(best) and np.array_equal(png_pixels(new), px):
                best = new
    except (Refused, KeyError, ValueError, IndexError, struct.error):
        pass
    return best


# JPEG


def _orientation(exif: bytes) -> int:
    """The orientation that an APP1 segment states; 1 if none."""
    if not exif.startswith(b"Exif\0\0") or len(exif) < 14:
        return 1
    tiff = exif[6:]
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    if not order:
        return 1
    try:
        (at,) = struct.unpack_from(order + "I", tiff, 4)
        (n,) = struct.unpack_from(order + "H", tiff, at)
        for k in range(n):
            tag, kind, _, value = struct.unpack_from(order + "HHIH", tiff, at + 2 + 12 * k)
            if tag == 0x0112 and kind == 3:
                return value if 1 <= value <= 8 else 1
    except struct.error:
        pass
    return 1


def _exif_with(orientation: int) -> bytes:
    tiff = b"MM\0*" + struct.pack(">IHHHIHHI", 8, 1, 0x0112, 3, 1, orientation, 0, 0)
    body = b"Exif\0\0" + tiff
    return b"\xff\xe1" + struct.pack(">H", len(body) + 2) + body


def optimize_jpeg(data: bytes) -> bytes:
    """Without comments, metadata and thumbnails; colour profile and orientation stay."""
    if data[:2] != b"\xff\xd8":
        return data
    out, at, turn, n = [b"\xff\xd8"], 2, 1, len(data)
    app0: list[bytes] = []
    while at + 4 <= n:
        if data[at] != 0xFF:
            return data
        tag = data[at + 1]
        if tag == 0xFF:
            at += 1
            continue
        if tag == 0xD9 or tag == 0xDA:
            break
        if 0xD0 <= tag <= 0xD7 or tag == 0x01:
            out.append(data[at : at + 2])
            at += 2
            continue
        size = struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        if size < 2 or at + 2 + size > n:
            return data
        if tag == 0xE0 and body.startswith(b"JFIF\0") and len(body) >= 14:
            short = body[:12] + b"\0\0"  # no thumbnail
            app0.append(b"\xff\xe0" + struct.pack(">H", len(short) + 2) + short)
        elif tag == 0xE1:
            turn = max(turn, _orientation(body))
        elif tag == 0xFE or 0xE3 <= tag <= 0xED or tag == 0xEF or tag == 0xE0 or (tag == 0xE2 and not body.startswith(b"ICC_PROFILE\0")):
            pass
        else:  # tables, frames, the colour profile, and APP14, which says how colours are coded
            out.append(data[at : at + 2 + size])
        at += 2 + size
    else:
        return data
    new = b"".join([out[0], *app0, *([_exif_with(turn)] if turn > 1 else []), *out[1:], data[at:]])
    return new if len(new) < n and new.endswith(b"\xff\xd9") else data


# Fonts

#: Tables that a subset font goes without.
DROPPED_TABLES = ("DSIG", "GDEF", "GPOS", "GSUB", "LTSH", "VDMX", "hdmx", "kern", "gasp", "fvar", "gvar", "avar", "HVAR", "MVAR", "STAT")


def deobfuscate_font(data: bytes, guid: str) -> bytes:
    """An embedded font's first 32 bytes against its reversed key; the same step obfuscates."""
    digits = re.sub(r"[^0-9A-Fa-f]", "", guid)
    if len(digits) != 32:
        raise Refused("key is no GUID")
    key = bytes.fromhex(digits)[::-1]
    return bytes(b ^ key[i % 16] for i, b in enumerate(data[:32])) + data[32:]


def font_tables(data: bytes) -> dict[str, bytes]:
    if len(data) < 12 or data[:4] not in (b"\0\1\0\0", b"true"):
        raise Refused("no TrueType font")
    out = {}
    for k in range(struct.unpack_from(">H", data, 4)[0]):
        tag, _, at, n = struct.unpack_from(">4sIII", data, 12 + 16 * k)
        if at + n > len(data):
            raise Refused("table is cut short")
        out[tag.decode("latin-1")] = data[at : at + n]
    return out


def _checksum(data: bytes) -> int:
    data += b"\0" * (-len(data) % 4)
    return int(np.frombuffer(data, dtype=">u4").sum(dtype=np.uint64)) & 0xFFFFFFFF


def pack_font(tables: dict[str, bytes]) -> bytes:
    tables = dict(sorted(tables.items()))
    tables["head"] = tables["head"][:8] + b"\0\0\0\0" + tables["head"][12:]
    n = len(tables)
    power = max(1, n).bit_length() - 1
    head = struct.pack(">IHHHH", 0x00010000, n, 16 << power, power, 16 * n - (16 << power))
    at, index, body = 12 + 16 * n, b"", b""
    for tag, d in tables.items():
        index += struct.pack(">4sIII", tag.encode("latin-1"), _checksum(d), at + len(body), len(d))
        body += d + b"\0" * (-len(d) % 4)
    font = head + index + body
    adjust = (0xB1B0AFBA - _checksum(font)) & 0xFFFFFFFF
    where = at + sum(len(d) + -len(d) % 4 for t, d in tables.items() if t < "head") + 8
    return font[:where] + struct.pack(">I", adjust) + font[where + 4 :]


def glyphs_of(cmap: bytes, points: set[int]) -> set[int]:
    """Glyphs that a format 4 character map gives code points."""
    table = None
    for k in range(struct.unpack_from(">H", cmap, 2)[0]):
        _, _, at = struct.unpack_from(">HHI", cmap, 4 + 8 * k)
        if struct.unpack_from(">H", cmap, at)[0] == 4:
            table = cmap[at:]
            break
    if table is None:
        raise Refused("no character map of format 4")
    n = struct.unpack_from(">H", table, 6)[0] // 2
    column = lambda at, kind=">u2": np.frombuffer(table, dtype=kind, count=n, offset=at).astype(np.int64)
    ends, starts, deltas, offsets = column(14), column(16 + 2 * n), column(16 + 4 * n), column(16 + 6 * n)
    out = set()
    for p in points:
        k = int(np.searchsorted(ends, p))
        if p > 0xFFFF or k >= n or starts[k] > p:
            continue
        if offsets[k]:
            at = 16 + 6 * n + 2 * k + int(offsets[k]) + 2 * (p - int(starts[k]))
            g = struct.unpack_from(">H", table, at)[0] if at + 2 <= len(table) else 0
            g = (g + int(deltas[k])) & 0xFFFF if g else 0
        else:
            g = (p + int(deltas[k])) & 0xFFFF
        out.add(g)
    return out


def _components(glyph: bytes) -> list[int]:
    """Glyphs that a composite glyph is made of."""
    if len(glyph) < 12 or struct.unpack_from(">h", glyph, 0)[0] >= 0:
        return []
    out, at = [], 10
    while at + 4 <= len(glyph):
        flags, g = struct.unpack_from(">HH", glyph, at)
        out.append(g)
        at += 4 + (4 if flags & 1 else 2) + (8 if flags & 0x80 else 4 if flags & 0x40 else 2 if flags & 8 else 0)
        if not flags & 0x20:
            break
    return out


def subset_font(data: bytes, points: set[int], keep_hints: bool = True) -> bytes:
    """The font with outlines only for some code points and what they are composed of; glyph numbers stay. The input, if that isn't smaller."""
    try:
        t = font_tables(data)
        if not {"head", "maxp", "loca", "glyf", "cmap"} <= t.keys():
            return data
        n = struct.unpack_from(">H", t["maxp"], 4)[0]
        long = struct.unpack_from(">h", t["head"], 50)[0]
        loca = np.frombuffer(t["loca"], dtype=">u4" if long else ">u2", count=n + 1).astype(np.int64) * (1 if long else 2)
        if (np.diff(loca) < 0).any() or loca[-1] > len(t["glyf"]):
            return data
        want = {0, *glyphs_of(t["cmap"], points)}
        queue = [*want]
        while queue:  # every glyph enters once, so cycles end
            g = queue.pop()
            for c in _components(t["glyf"][loca[g] : loca[g + 1]]) if g < n else ():
                if c not in want and c < n:
                    want.add(c)
                    queue.append(c)
        glyf, places = b"", [0]
        for g in range(n):
            if g in want:
                one = t["glyf"][loca[g] : loca[g + 1]]
                glyf += one + b"\0" * (-len(one) % 4)
            places.append(len(glyf))
        t["glyf"], t["loca"] = glyf, np.array(places, dtype=">u4").tobytes()
        t["head"] = t["head"][:50] + struct.pack(">h", 1) + t["head"][52:]
        if "post" in t and len(t["post"]) >= 32:
            t["post"] = struct.pack(">I", 0x00030000) + t["post"][4:32]
        gone = {*DROPPED_TABLES, *(() if keep_hints else ("fpgm", "prep", "cvt "))}
        new = pack_font({k: v for k, v in t.items() if k not in gone})
    except (Refused, struct.error, ValueError, IndexError):
        return data
    return new if len(new) < len(data) else data


def optimize_image(data: bytes, extension: str) -> bytes:
    """By extension; formats without an optimiser stay as they are."""
    ext = extension.lower().lstrip(".")
    if ext == "png":
        return optimize_png(data)
    if ext in ("jpg", "jpeg"):
        return optimize_jpeg(data)
    if ext == "svg":
        from trimlake.functions.xml_text import is_balanced, minify

        new = minify(text := data.decode("latin-1"))
        return new.encode("latin-1") if len(new) < len(text) and is_balanced(new) else data
    return data
