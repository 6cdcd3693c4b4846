"""Markup functions on columns: those that one or two regular expressions express, and Arrow functions for the rest."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

from trimlake.functions import xml_text
from trimlake.functions.html_text import COMMENT, inline_images


def strip_xml_comments(x: Column) -> Column:
    """An unclosed comment takes the rest with it."""
    return F.regexp_replace(x, r"(?s)<!--.*?(-->|\z)", "")


def strip_html_comments(x: Column) -> Column:
    """An unclosed comment stays."""
    return F.regexp_replace(x, COMMENT, "")


def trim_number(x: Column) -> Column:
    """A decimal number without trailing zeros in its fraction; minus zero is zero."""
    short = F.regexp_replace(F.regexp_replace(x, r"(\.[0-9]*[1-9])0+$", "$1"), r"\.0+$", "")
    return F.when(short == "-0", "0").otherwise(short)


def minify_css(x: Column) -> Column:
    plain = F.regexp_replace(x, r"(?s)/\*.*?(\*/|\z)", "")
    return F.regexp_replace(F.regexp_replace(plain, r"[ \t\n\x0B\f\r]+", " "), r"(^|[{}:;]) ", "$1")


def remove_attribute(x: Column, name: str) -> Column:
    """Text without an attribute, for texts in which its pattern occurs in start tags only."""
    return F.regexp_replace(x, rf"\s+{name}\s*=\s*(\"[^\"]*\"|'[^']*')", "")


def rtf_balanced(x: Column) -> Column:
    """Begins as rich text, and unescaped braces pair up: a fold over the braces alone."""
    braces = F.split(F.regexp_replace(F.regexp_replace(x, r"(?s)\\.", ""), r"[^{}]", ""), "")
    start = F.struct(F.lit(0).alias("depth"), F.lit(True).alias("ok"))
    step = lambda a, c: F.struct((a["depth"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)).alias("depth"), (a["ok"] & ((a["depth"] > 0) | (c != "}"))).alias("ok"))
    end = F.aggregate(braces, start, step)
    return F.startswith(x, F.lit("{\\rtf")) & end["ok"] & (end["depth"] == 0)


def _by_text(f: Callable[[str], object], kind) -> Callable[[Column], Column]:
    """An Arrow function of UTF-8 texts whose f works on one character a byte."""

    @F.arrow_udf(kind)
    def run(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            r = None if t is None else f(t.encode("utf-8").decode("latin-1"))
            out.append(r.encode("latin-1").decode("utf-8", "replace") if isinstance(r, str) else r)
        return pa.array(out, pa.bool_() if isinstance(kind, BooleanType) else pa.string())

    return run


well_formed = _by_text(xml_text.is_balanced, BooleanType())
minify_xml = _by_text(xml_text.minify, StringType())
drop_namespaces = _by_text(xml_text.drop_repeated_namespaces, StringType())
merge_runs = _by_text(xml_text.merge_runs, StringType())
shrink_inline_images = _by_text(inline_images, StringType())


def guarded(old: Column, new: Column, ok: Column) -> Column:
    """The new text where it is smaller and passes a check; else the old."""
    return F.when((F.octet_length(new) < F.octet_length(old)) & ok, new).otherwise(old)
