"""HTML: comments and inline images. Texts hold one character a byte."""

from __future__ import annotations

import base64
import binascii
import re

from trimlake.functions.codec import optimize_image

COMMENT = r"(?s)<!--.*?-->"
_INLINE = re.compile(r"(data:image/(png|jpeg|jpg);base64,)([A-Za-z0-9+/=\s]+)")


def strip_comments(html: str) -> str:
    """Without comments; an unclosed one is kept. Comments in scripts and styles go as well."""
    return re.sub(COMMENT, "", html)


def inline_images(html: str) -> str:
    """Inline PNG and JPEG images, each in its smaller form."""

    def one(m: re.Match) -> str:
        try:
            raw = base64.b64decode("".join(m[3].split()).rstrip("=") + "==")
        except (binascii.Error, ValueError):
            return m[0]
        new = optimize_image(raw, m[2])
        return m[1] + base64.b64encode(new).decode() if len(new) < len(raw) else m[0]

    return _INLINE.sub(one, html)


def optimize_html(html: str) -> tuple[str, dict[str, int]]:
    """The smaller page and what each step saved."""
    images = inline_images(html)
    new = strip_comments(images)
    return new, {"Image Optimization": len(html) - len(images), "HTML Minification": len(images) - len(new)}
