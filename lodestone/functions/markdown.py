"""Markdown into segments, and entities into signs: scanners for Arrow batches.

TAB-07/08, SCA-03/04/05/17. Segments are code, table, quote, rule and text, in order; nothing of the text is lost.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import BREAKING, ENTITIES

_CODE, _RULE, _CELL = re.compile(r"```([^\n`]*)\n(.*?)```", re.S), re.compile(r"^\s{0,3}([-*_])(?:\s*\1){2,}\s*$"), re.compile(r"^:?-{3,}:?$")


def decode_entities(text: str | None) -> str:
    """SCA-04: hexadecimal, then decimal, then named entities, one pass each; unknown names stay, impossible numbers go."""

    def sign(number: int) -> str:
        return chr(number) if number < 0x110000 and not 0xD800 <= number < 0xE000 else ""

    out = re.sub(r"&#x([0-9a-fA-F]+);", lambda m: sign(int(m[1], 16)), text or "")
    out = re.sub(r"&#(\d+);", lambda m: sign(int(m[1])), out)
    return re.sub(r"&([a-zA-Z][a-zA-Z0-9]*);", lambda m: ENTITIES.get(m[1], m[0]), out)


def escape_xml(text: Column) -> Column:
    """SCA-05."""
    out = text
    for sign, name in (("&", "amp"), ("<", "lt"), (">", "gt"), ('"', "quot"), ("'", "apos")):
        out = F.replace(out, F.lit(sign), F.lit(f"&{name};"))
    return out


def strip_tags(x: Column) -> Column:
    """SCA-03: list items as bullets, a line for each block, no other tags."""
    t = F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?i)<li[^>]*>", "• "), rf"(?i)</({BREAKING})>|<br\s*/?>", "\n")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"<[^>]+>", ""), r"\n{3,}", "\n\n"))


def cells(line: str) -> list[str]:
    """A table row's cells; none where there is no bar."""
    bare = line.strip()
    return [c.strip() for c in bare.removeprefix("|").removesuffix("|").split("|")] if "|" in bare else []


def table_at(lines: list[str], at: int) -> int:
    """TAB-08: the end of the table whose header is line `at`; `at` itself if there is none. A ragged row ends it."""
    head, rule = cells(lines[at]), cells(lines[at + 1]) if at + 1 < len(lines) else []
    if len(head) < 2 or len(rule) != len(head) or not all(_CELL.match(c) for c in rule):
        return at
    end = at + 2
    while end < len(lines) and len(cells(lines[end])) == len(head):
        end += 1
    return end


def _prose(text: str) -> Iterator[tuple[str, str]]:
    lines, at, kinds = text.split("\n"), 0, []
    while at < len(lines):
        end = table_at(lines, at)
        if end > at:
            kinds.append(("table", "\n".join(lines[at:end])))
            at = end
            continue
        line = lines[at]
        kinds.append(("rule" if _RULE.match(line) else "quote" if line.lstrip().startswith(">") else "text", line))
        at += 1
    for kind, run in groupby(kinds, key=lambda k: k[0]):
        own = [t for _, t in run]
        if kind in ("table", "rule"):
            yield from ((kind, t) for t in own)
        else:
            body = "\n".join(re.sub(r"^\s*>\s?", "", t) for t in own) if kind == "quote" else "\n".join(own)
            if body.strip():
                yield kind, body


def segments(text: str | None) -> list[tuple[str, str, str]]:
    """TAB-07: (kind, language, text) of a reply. An open fence at the end is text."""
    out, at, text = [], 0, text or ""
    for m in _CODE.finditer(text):
        out += [(k, "", t) for k, t in _prose(text[at : m.start()])]
        out.append(("code", m[1].strip(), m[2]))
        at = m.end()
    return out + [(k, "", t) for k, t in _prose(text[at:])]


def inline_markup(line: str) -> str:
    """SCA-17: bold, italic and code of a line as markup; code is left as it is inside."""
    held: list[str] = []

    def keep(m: re.Match) -> str:
        held.append(f"<tt>{html.escape(m[1])}</tt>")
        return f"\0{len(held) - 1}\0"

    out = html.escape(re.sub(r"`([^`]+)`", keep, line), quote=False)
    out = re.sub(r"\*\*(.+?)\*\*|__(.+?)__", lambda m: f"<b>{m[1] or m[2]}</b>", out)
    out = re.sub(r"(?<![\w*])\*([^*\n]+)\*(?![\w*])", r"<i>\1</i>", out)
    return re.sub("\0(\\d+)\0", lambda m: held[int(m[1])], out)


def segmenter():
    @F.arrow_udf("array<struct<kind:string,language:string,text:string>>")
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("language", pa.string()), ("text", pa.string())]))
        for batch in batches:
            yield pa.array([[dict(zip(("kind", "language", "text"), s, strict=True)) for s in segments(t)] for t in batch.to_pylist()], kind)

    return cut


def entity_decoder():
    @F.arrow_udf("string")
    def decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([decode_entities(t) for t in batch.to_pylist()], pa.string())

    return decoded
