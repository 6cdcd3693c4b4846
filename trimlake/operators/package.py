"""A package in memory: named parts, their relationships and content types. One document's parts fit in a task."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from trimlake.functions.xml_text import is_balanced
from trimlake.sources.zip_parts import Part

TYPES = "[Content_Types].xml"
_RELATION = re.compile(r"<Relationship\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*?/>|<Relationship\b[^>]*>\s*</Relationship>")
_OVERRIDE = re.compile(r"<Override\b[^>]*/>")
_ATTR = re.compile(r"([\w:.-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")


def attributes(tag: str) -> dict[str, str]:
    return {n: a or b for n, a, b in _ATTR.findall(tag)}


@dataclass(frozen=True)
class Relation:
    source: str  # the part that has the relationship; empty for the package
    id: str
    target: str  # as written
    path: str | None  # the part meant; None if outside the package


@dataclass
class Package:
    parts: dict[str, Part]
    saved: dict[str, int] = field(default_factory=dict)

    @classmethod
    def of(cls, parts: list[Part]) -> Package:
        return cls({p.name: p for p in parts})

    def copy(self) -> Package:
        return Package({n: Part(p.name, p.data, p.attributes, p.stored) for n, p in self.parts.items()}, dict(self.saved))

    def names(self, prefix: str = "", suffix: str = "") -> list[str]:
        return [n for n in self.parts if n.startswith(prefix) and n.endswith(suffix)]

    def text(self, name: str) -> str | None:
        return self.parts[name].data.decode("latin-1") if name in self.parts else None

    def texts(self, prefix: str = "", suffix: str = ".xml") -> Iterator[tuple[str, str]]:
        for n in self.names(prefix, suffix):
            yield n, self.text(n)

    def put(self, name: str, text: str) -> int:
        """Takes a part's new text if it is smaller and balanced. Bytes saved."""
        gain = len(self.parts[name].data) - len(text)
        if gain > 0 and is_balanced(text):
            self.parts[name].data = text.encode("latin-1")
            return gain
        return 0

    def force(self, name: str, text: str) -> None:
        self.parts[name].data = text.encode("latin-1")

    def relations(self) -> list[Relation]:
        out = []
        for name in self.names(suffix=".rels"):
            folder, _, base = name.rpartition("/")
            home = posixpath.dirname(folder)
            source = posixpath.join(home, base[: -len(".rels")]) if base != ".rels" else ""
            for tag in _RELATION.findall(self.text(name)):
                a = attributes(tag)
                target = a.get("Target", "")
                path = None
                if a.get("TargetMode") != "External" and target:
                    plain = target.partition("#")[0]
                    path = posixpath.normpath(plain[1:] if plain.startswith("/") else posixpath.join(home, plain)) if plain else None
                out.append(Relation(source, a.get("Id", ""), target, path))
        return out

    def rels_name(self, source: str) -> str:
        folder, _, base = source.rpartition("/")
        return posixpath.join(folder, "_rels", f"{base}.rels")

    def edit_relations(self, change) -> None:
        """change(relation) returns the new target, the old one, or None to drop the relationship."""
        known = {(r.source, r.id, r.target): r for r in self.relations()}
        for name in self.names(suffix=".rels"):
            folder, _, base = name.rpartition("/")
            source = posixpath.join(posixpath.dirname(folder), base[: -len(".rels")]) if base != ".rels" else ""

            def one(m: re.Match, source: str = source) -> str:
                a = attributes(m[0])
                r = known.get((source, a.get("Id", ""), a.get("Target", "")))
                new = change(r) if r else a.get("Target", "")
                if new is None:
                    return ""
                return m[0] if not r or new == r.target else re.sub(r"(\bTarget\s*=\s*)(\"[^\"]*\"|'[^']*')", lambda t: f'{t[1]}"{new}"', m[0], count=1)

            old = self.text(name)
            new = _RELATION.sub(one, old)
            if new != old:
                self.force(name, new)

    def drop(self, names: set[str]) -> int:
        """Removes parts, with their own relationships, those that lead to them, and their content types. Raw bytes removed."""
        names = {n for n in names if n in self.parts}
        if not names:
            return 0
        gone = sum(len(self.parts[n].data) for n in names)
        for n in names:
            del self.parts[n]
            self.parts.pop(self.rels_name(n), None)
        self.edit_relations(lambda r: None if r.path in names else r.target)
        if TYPES in self.parts:
            old = self.text(TYPES)
            new = _OVERRIDE.sub(lambda m: "" if attributes(m[0]).get("PartName", "").lstrip("/") in names else m[0], old)
            if new != old:
                self.force(TYPES, new)
        return gone

    def note(self, key: str, saved: int) -> None:
        if saved > 0:
            self.saved[key] = self.saved.get(key, 0) + saved
