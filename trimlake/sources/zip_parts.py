"""ZIP packages as ordered parts. Times and extra fields are not kept; order, attributes and the stored flag are."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

from trimlake.functions.codec import INFLATE_CAP, Refused, deflate_best, inflate

#: Most bytes that all entries of a package may hold.
MOST_BYTES = 1 << 30
#: Fixed value: the date that entries get, 1 January 1980.
DATE = 0x0021


@dataclass
class Part:
    name: str
    data: bytes
    attributes: int = 0
    stored: bool = False


def read_zip(raw: bytes) -> list[Part]:
    """Entries in the order of the central directory. Any entry that can't be read, or fails its checksum, refuses the whole."""
    end = raw.rfind(b"PK\x05\x06", max(0, len(raw) - 65_557))
    if end < 0 or end + 22 > len(raw):
        raise Refused("no end of central directory")
    count, _, at = struct.unpack_from("<HII", raw, end + 10)
    out: list[Part] = []
    total = 0
    for _ in range(count):
        if raw[at : at + 4] != b"PK\x01\x02" or at + 46 > len(raw):
            raise Refused("central directory is broken")
        flags, method, _, _, crc, packed, plain, n, extra, note = struct.unpack_from("<HHHHIIIHHH", raw, at + 8)
        attributes, local = struct.unpack_from("<II", raw, at + 38)
        name = raw[at + 46 : at + 46 + n]
        at += 46 + n + extra + note
        if flags & 1 or method not in (0, 8) or local + 30 > len(raw) or raw[local : local + 4] != b"PK\x03\x04":
            raise Refused("entry is encrypted, of another method, or misplaced")
        skip = sum(struct.unpack_from("<HH", raw, local + 26))
        body = raw[local + 30 + skip : local + 30 + skip + packed]
        total += plain
        if len(body) != packed or plain > INFLATE_CAP or total > MOST_BYTES:
            raise Refused("entry is cut short or too large")
        data = body if method == 0 else inflate(body, -15, plain + 1)
        if len(data) != plain or zlib.crc32(data) != crc:
            raise Refused("entry fails its checksum")
        out.append(Part(name.decode("utf-8" if flags & 0x800 else "cp437" if not name.isascii() else "ascii", "replace"), data, attributes, method == 0))
    return out


def write_order(part: Part) -> tuple:
    """mimetype, then content types, then by extension and name."""
    return (part.name != "mimetype", part.name != "[Content_Types].xml", part.name.rpartition(".")[2] if "." in part.name else "", part.name)


def write_zip(parts: list[Part], best: bool = True) -> bytes:
    """A package of parts; the last of those with one name counts. Read back before it is returned."""
    last = {p.name: p for p in parts}
    body, directory = [], []
    at = 0
    for p in sorted(last.values(), key=write_order):
        name = p.name.encode("utf-8")
        flags = 0 if name.isascii() else 0x800
        packed, method = p.data, 0
        if p.name != "mimetype" and not p.stored:
            c = zlib.compressobj(6, zlib.DEFLATED, -15)
            short = deflate_best(p.data, -15) if best else c.compress(p.data) + c.flush()
            if len(short) < len(p.data):
                packed, method = short, 8
        fields = struct.pack("<HHHHIIIHH", flags, method, 0, DATE, zlib.crc32(p.data), len(packed), len(p.data), len(name), 0)
        local = b"PK\x03\x04" + struct.pack("<H", 20) + fields + name
        directory.append(b"PK\x01\x02" + struct.pack("<HH", 20, 20) + fields + struct.pack("<HHHII", 0, 0, 0, p.attributes, at) + name)
        body += [local, packed]
        at += len(local) + len(packed)
    listed = b"".join(directory)
    raw = b"".join([*body, listed, b"PK\x05\x06", struct.pack("<HHHHIIH", 0, 0, len(directory), len(directory), len(listed), at, 0)])
    if {p.name: p.data for p in read_zip(raw)} != {n: p.data for n, p in last.items()}:
        raise Refused("package does not read back")
    return raw
