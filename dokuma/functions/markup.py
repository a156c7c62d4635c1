"""Cleaning of wiki markup, XML entities and subtitle lines.

The cleaners are pattern tables: each kind of markup is one alternative of a scanning pattern, and what is
left of it is the alternative's own rule. Nested braces and brackets are closed by counting their marks.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from dokuma.functions import turkish

# Entity names, link prefixes that are dropped, and marks of credit lines.
ENTITIES = {"lt": "<", "gt": ">", "amp": "&", "quot": '"', "apos": "'", "nbsp": " "}
DROPPED_LINKS = ("Kategori:", "Category:", "Dosya:", "File:", "Resim:", "Image:")
CREDITS = ("Çeviren", "Çeviri", "ÇEVİR", "Altyazı", "ALTYAZI", "www.", "http")

_ENTITY = re.compile("&(?:(" + "|".join(ENTITIES) + r")|#([0-9]+)|#[xX]([0-9a-fA-F]+));")


def _entity(m: re.Match) -> str:
    name, decimal, hexadecimal = m.groups()
    if name:
        return ENTITIES[name]
    code = int(decimal) if decimal else int(hexadecimal, 16)
    return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "�"


def xml_unescape(text: str, nbsp_again: bool = False) -> str:
    """One pass over the entities; what is malformed stays. With nbsp_again, the literal &nbsp; that a
    doubly escaped dump leaves behind becomes a space, too."""
    out = _ENTITY.sub(_entity, text)
    return out.replace("&nbsp;", " ") if nbsp_again else out


_WIKI = re.compile(
    r"(?P<brace>\{\{)|(?P<table>\{\|)|(?P<note><!--)|(?P<ref><ref)|(?P<math><math)|(?P<link>\[\[)"
    r"|(?P<url>\[http)|'''?|=+|(?P<tag><)"
)


def _closed(text: str, at: int, mark: re.Pattern, opening: str) -> tuple[int, int]:
    """Where the nesting that has just been opened at `at` closes: before and after the closing mark.
    The end of the text if it doesn't."""
    depth = 1
    for m in mark.finditer(text, at):
        depth += 1 if m[0] == opening else -1
        if not depth:
            return m.start(), m.end()
    return len(text), len(text)


_BRACES, _BRACKETS = re.compile(r"\{\{|\}\}"), re.compile(r"\[\[|\]\]")


def _after(text: str, mark: str, at: int) -> int:
    found = text.find(mark, at)
    return len(text) if found < 0 else found + len(mark)


def wikitext_clean(text: str) -> str:
    out, at = [], 0
    while m := _WIKI.search(text, at):
        out.append(text[at : m.start()])
        at, kind = m.end(), m.lastgroup
        if kind == "brace":
            at = _closed(text, at, _BRACES, "{{")[1]
        elif kind == "table":
            at = _after(text, "|}", at)
        elif kind == "note":
            at = _after(text, "-->", at)
        elif kind == "ref":
            close = text.find(">", at)
            own = text.find("/>", at, close + 1 if close >= 0 else len(text))
            at = own + 2 if own >= 0 else len(text) if close < 0 else _after(text, "</ref>", close + 1)
        elif kind == "math":
            close = text.find(">", at)
            at = len(text) if close < 0 else _after(text, "</math>", close + 1)
        elif kind == "link":
            stop, end = _closed(text, at, _BRACKETS, "[[")
            body = text[at:stop]
            if not body.startswith(DROPPED_LINKS):
                out.append(body.rpartition("|")[2])
            at = end
        elif kind == "url":
            stop = text.find("]", at)
            body = text[at : stop if stop >= 0 else len(text)]
            out.append(body.partition(" ")[2])
            at = stop + 1 if stop >= 0 else len(text)
        elif kind == "tag":
            at = _after(text, ">", at)
    return "".join([*out, text[at:]])


_STYLE = re.compile(r"<[^<>]*>|[{\[][^{}\[\]]*[}\]]|\{[0-9]+")
_GAP = re.compile(r"[ \t\r]+")
_LETTER = re.compile(turkish.LETTERS)
_MISREAD = re.compile("(?<=[a-zıçöüğş])I+")
_NOTE = re.compile("[♪♫]")


def subtitle_clean(line: str) -> str:
    """A subtitle line without styles, gaps, leading dashes and misread capitals; empty if it is a credit,
    a song or has no letter."""
    if any(mark in line for mark in CREDITS):
        return ""
    line = _STYLE.sub("", line)
    if _NOTE.search(line):
        return ""
    line = _GAP.sub(" ", line).lstrip(" -").rstrip(" ")
    if not _LETTER.search(line):
        return ""
    # a capital I after a small letter inside a word was an l; so are those that follow it
    return _MISREAD.sub(lambda m: "l" * len(m[0]), line)


def subtitle_clean_bytes(line: bytes) -> bytes:
    """The same for bytes of which some may not be UTF-8: these are kept as they are."""
    return subtitle_clean(line.decode("utf-8", "surrogateescape")).encode("utf-8", "surrogateescape")


def _udf(function):
    @F.pandas_udf(StringType())
    def apply(column: pd.Series) -> pd.Series:
        return column.map(function, na_action="ignore")

    # a filter on the result would run a deterministic one again, in workers of its own
    return apply.asNondeterministic()


unescape_col = _udf(xml_unescape)
unescape_twice_col = _udf(lambda t: xml_unescape(t, True))
wikitext_col = _udf(wikitext_clean)
subtitle_col = _udf(subtitle_clean)


def credit_line(line: Column) -> Column:
    found = F.lit(False)
    for mark in CREDITS:
        found = found | line.contains(mark)
    return found


def song_line(line: Column) -> Column:
    return F.regexp_replace(line, r"<[^<>]*>|[{\[][^{}\[\]]*[}\]]", "").rlike("[♪♫]")


def strip_tags(html: Column) -> Column:
    """Tags removed and the basic entities decoded, with built-in functions only."""
    text = F.regexp_replace(html, "<[^>]*>", "")
    for name in ("lt", "gt", "quot", "apos", "nbsp", "amp"):
        text = F.replace(text, F.lit(f"&{name};"), F.lit(ENTITIES[name]))
    return text
