"""Markup functions on text. Texts hold one character a byte (Latin-1), so lengths are byte counts and any encoding passes through.

All of them work on the same tokens, found by one regular expression; none depends on Spark.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

_TOKEN = re.compile(
    r"(?P<pi><\?.*?\?>)|(?P<comment><!--.*?-->)|(?P<cdata><!\[CDATA\[.*?\]\]>)|(?P<decl><!(?!--|\[CDATA\[)[^>]*>)"
    r"|(?P<end></[^>]*>)|(?P<start><(?![!?/])(?:[^<>\"']++|\"[^\"]*\"|'[^']*'|<)*+>)|(?P<text>[^<]+)|(?P<bad><)",
    re.S,
)
_ATTR = re.compile(r"\s+([^\s=/>\"']+)\s*=\s*(\"[^\"]*\"|'[^']*')")
_WHOLE_TAG = re.compile(r"<([^\s/>]+)((?:\s+[^\s=/>\"']+\s*=\s*(?:\"[^\"]*\"|'[^']*'))*)\s*(/?)>")
DECLARATION = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'

#: Units that a trimmed number may carry; attributes whose values are kept as they are.
UNITS = frozenset(("", "cm", "mm", "in", "pt", "pc", "px", "%", "em", "rem"))
VERBATIM = frozenset(("version", "encoding", "id", "name"))
_NUMBER = re.compile(r"(?<![0-9A-Za-z])([-+]?[0-9]+)\.([0-9]+)([A-Za-z%]*)")


def tokens(xml: str) -> Iterator[tuple[str, str]]:
    """(kind, text) of every token; the texts joined are the input."""
    for m in _TOKEN.finditer(xml):
        yield m.lastgroup, m[0]


def tag_name(tag: str) -> str:
    return re.match(r"</?\s*([^\s/>]*)", tag)[1]


def is_balanced(xml: str) -> bool:
    """Whether every start tag meets its end tag in order. Texts without tags are balanced; attributes and entities aren't looked at."""
    open_: list[str] = []
    for kind, t in tokens(xml):
        if kind == "bad":
            return False
        if kind == "start" and not t.endswith("/>"):
            open_.append(tag_name(t))
        elif kind == "end" and (not open_ or open_.pop() != tag_name(t)):
            return False
    return not open_


def strip_comments(xml: str) -> str:
    """Without comments; an unclosed one takes the rest with it."""
    return re.sub(r"<!--.*?(?:-->|\Z)", "", xml, flags=re.S)


def trim_numbers(value: str) -> str:
    """Fractions without trailing zeros, in values that hold no colon or slash."""
    if ":" in value or "/" in value:
        return value

    def short(m: re.Match) -> str:
        whole, fraction, unit = m.groups()
        if unit not in UNITS:
            return m[0]
        fraction = fraction.rstrip("0")
        return (("0" if whole == "-0" else whole) if not fraction else f"{whole}.{fraction}") + unit

    return _NUMBER.sub(short, value)


def _short_tag(tag: str) -> str:
    m = _WHOLE_TAG.fullmatch(tag)
    if not m:
        return tag
    out = [f"<{m[1]}"]
    for name, quoted in _ATTR.findall(m[2]):
        value, quote = quoted[1:-1], quoted[0]
        if name not in VERBATIM and not name.startswith("xmlns"):
            value = trim_numbers(value)
        if '"' not in value:
            quote = '"'
        out.append(f" {name}={quote}{value}{quote}")
    return "".join(out) + m[3] + ">"


def minify(xml: str) -> str:
    """Without comments and layout blanks. Blanks count where an element, or one around it, says xml:space="preserve"; CDATA is kept."""
    out: list[str] = []
    keep: list[bool] = [False]
    for kind, t in tokens(xml):
        if kind == "comment":
            continue
        if kind == "bad":
            return strip_comments(xml)
        if kind == "pi" and re.match(r"<\?xml\s", t):
            out.append(DECLARATION)
        elif kind == "start":
            space = re.search(r"\sxml:space\s*=\s*[\"'](\w+)[\"']", t)
            if not t.endswith("/>"):
                keep.append(space[1] == "preserve" if space else keep[-1])
            out.append(_short_tag(t))
        elif kind == "end":
            if len(keep) > 1:
                keep.pop()
            out.append(f"</{tag_name(t)}>")
        elif kind == "text" and not keep[-1]:
            if t.strip(" \t\n\x0b\x0c\r"):
                out.append(re.sub(r"[ \t\n\x0b\x0c\r]+", " ", t))
        else:
            out.append(t)
    return "".join(out)


def remove_attributes(xml: str, names: Iterable[str]) -> str:
    """Without the named attributes of start tags."""
    gone = re.compile(rf"\s+(?:{'|'.join(map(re.escape, names))})\s*=\s*(?:\"[^\"]*\"|'[^']*')")
    return "".join(gone.sub("", t) if kind == "start" else t for kind, t in tokens(xml))


def drop_repeated_namespaces(xml: str) -> str:
    """Without namespace declarations that say again what holds already. Rebinding in between is followed by a stack of scopes."""
    out: list[str] = []
    scopes: list[dict[str, str]] = [{}]
    for kind, t in tokens(xml):
        if kind == "start":
            scope = dict(scopes[-1])

            def once(m: re.Match, scope: dict[str, str] = scope) -> str:
                name, value = m[1], m[2][1:-1]
                if name != "xmlns" and not name.startswith("xmlns:"):
                    return m[0]
                if scope.get(name) == value:
                    return ""
                scope[name] = value
                return m[0]

            out.append(_ATTR.sub(once, t))
            if not t.endswith("/>"):
                scopes.append(scope)
        else:
            if kind == "end" and len(scopes) > 1:
                scopes.pop()
            out.append(t)
    new = "".join(out)
    return new if is_balanced(new) else xml


_PARAGRAPH = re.compile(r"<w:p(?=[\s>])[^>]*(?<!/)>.*?</w:p>", re.S)
_RUN = re.compile(r"<w:r(?:\s[^>]*)?(?<!/)>(.*?)</w:r>", re.S)
_RUN_PARTS = re.compile(r"\s*(<w:rPr(?:\s[^>]*)?/>|<w:rPr(?:\s[^>]*)?(?<!/)>.*?</w:rPr>)?\s*<w:t(\s[^>]*)?(?<!/)>([^<]*)</w:t>\s*", re.S)


def _run_text(parts: re.Match) -> str:
    """A run's text as it shows: blanks at its ends count only where they are preserved."""
    return parts[3] if "preserve" in (parts[2] or "") else parts[3].strip(" \t\r\n")


def merge_runs(xml: str) -> str:
    """Neighbouring text runs of a paragraph with equal properties become one run. A run counts if it holds its properties and one text, nothing else."""

    def paragraph(p: re.Match) -> str:
        text, out, at = p[0], [], 0
        held: list | None = None  # properties, text, preserve, its source

        def flush() -> None:
            nonlocal held
            if held:
                props, words, preserve, source, count = held
                space = preserve or words != words.strip() or "  " in words
                out.append(source if count == 1 else f"<w:r>{props}<w:t{' xml:space=\"preserve\"' if space else ''}>{words}</w:t></w:r>")
                held = None

        for m in _RUN.finditer(text):
            between, parts = text[at : m.start()], _RUN_PARTS.fullmatch(m[1])
            if not parts or between.strip() or not held or held[0] != (parts[1] or ""):
                flush()
                out.append(between)
                if parts:
                    held = [parts[1] or "", _run_text(parts), "preserve" in (parts[2] or ""), m[0], 1]
                else:
                    out.append(m[0])
            else:
                held[1] += _run_text(parts)
                held[2] = held[2] or "preserve" in (parts[2] or "")
                held[4] += 1
            at = m.end()
        flush()
        return "".join([*out, text[at:]])

    new = _PARAGRAPH.sub(paragraph, xml)
    return new if is_balanced(new) else xml


def minify_css(css: str) -> str:
    """Without comments, and without blanks that follow an opening, a closing, a separator, another blank, or nothing."""
    css = re.sub(r"/\*.*?(?:\*/|\Z)", "", css, flags=re.S)
    return re.sub(r"(^|[{}:;])?[ \t\n\x0b\x0c\r]+", lambda m: " " if m[1] is None else m[1], css)
