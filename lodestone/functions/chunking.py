"""Chunkers of text: order-dependent packing, so plain Python in Arrow batches.

TAB-02/04/05/06, SCA-13/14/15. Lengths are in characters. A null or blank text has no chunks.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import functions as F

SIZE, OVERLAP, LEAST_SIZE, SNAP = 800, 120, 50, 40
_BLANK_LINE, _AFTER_SENTENCE = re.compile(r"\n\s*\n"), re.compile(r"(?<=[.!?])\s+")
_BEFORE_CAPITAL, _HEADING = re.compile(r"\s+(?=[A-Z])"), re.compile(r"(?m)^#{1,6}[^\S\n]+.+")


def overlap_tail(text: str, n: int) -> str:
    """SCA-13: the last n characters, from the next word on where one starts within forty."""
    if n <= 0:
        return ""
    tail = text[-n:]
    if len(tail) == len(text):
        return text
    gap = tail[:SNAP].find(" ")
    return tail[gap + 1 :]


def strided(text: str, size: int, step: int) -> list[str]:
    """Windows of `size` every `step` characters; the one that reaches the end is the last."""
    last = max(0, -(-(len(text) - size) // step))
    return [w for k in range(last + 1) if (w := text[k * step : k * step + size].strip())]


def _sentences(paragraph: str, size: int, overlap: int) -> Iterator[str]:
    """Runs of whole sentences of up to `size` characters; a longer sentence gives windows."""
    run: list[str] = []
    used = 0
    for sentence in filter(None, map(str.strip, _AFTER_SENTENCE.split(paragraph))):
        if run and used + 1 + len(sentence) > size:
            yield " ".join(run)
            run, used = [], 0
        if len(sentence) > size:
            yield from strided(sentence, size, max(1, size - overlap))
        else:
            used += len(sentence) + bool(run)
            run.append(sentence)
    if run:
        yield " ".join(run)


def chunk_text(text: str | None, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    """TAB-02: chunks at paragraph and sentence ends, each after the first beginning with the tail of the one before.

    The size is at least fifty, the overlap at most half of it. A tail that would make a chunk too long is left out.
    """
    size = max(LEAST_SIZE, int(size or SIZE))
    overlap = min(max(0, int(overlap or 0)), size // 2)
    out: list[str] = []
    for paragraph in filter(None, map(str.strip, _BLANK_LINE.split((text or "").strip()))):
        for segment in [paragraph] if len(paragraph) <= size else _sentences(paragraph, size, overlap):
            if out and len(out[-1]) + 1 + len(segment) <= size:
                out[-1] += " " + segment
                continue
            seeded = f"{overlap_tail(out[-1], overlap)} {segment}".strip() if out else segment
            out.append(seeded if len(seeded) <= size else segment)
    return out


def sliding_windows(text: str | None, size: int = 2000, back: int = 500) -> list[str]:
    """TAB-04: windows of whole sentences, each going back by about `back` characters; a lone sentence is cut by characters."""
    text = (text or "").strip()
    sentences = [s for s in _AFTER_SENTENCE.split(text) if s]
    if len(text) <= size:
        return [text] if text else []
    if len(sentences) == 1:
        return strided(text, size, max(1, size - back))
    out, start = [], 0
    while start < len(sentences):
        end, used = start, 0
        while end < len(sentences) and (end == start or used + 1 + len(sentences[end]) <= size):
            used += len(sentences[end]) + (end > start)
            end += 1
        out.append(" ".join(sentences[start:end]))
        if end == len(sentences):
            break
        again, kept = end, 0
        while again - 1 > start and kept + len(sentences[again - 1]) <= back:
            again -= 1
            kept += len(sentences[again])
        start = again
    return out


def heading_sections(text: str | None) -> list[str]:
    """TAB-05: sections that begin at Markdown headings; what stands before the first is one too."""
    return [s for s in (p.strip() for p in re.split(r"(?m)^(?=#{1,6}\s+)", text or "")) if s]


def bounded_lines(text: str | None, size: int = 6000) -> list[str]:
    """TAB-06: whole lines packed up to `size` characters; a longer line stands alone."""
    out: list[str] = []
    for line in (text or "").splitlines(keepends=True):
        if out and len(out[-1]) + len(line) <= size:
            out[-1] += line
        else:
            out.append(line)
    return out


#: Characters of a page in a prompt and marks of what was left out.
PAGE_CHARS = 15_000
CUT_MARK, MIDDLE_MARK = "\n\n[...content truncated...]\n\n", "\n\n[...middle content trimmed...]\n\n"


def _fitting(parts: Iterable[str], room: int) -> list[str]:
    """Leading parts that fit in `room` when they are joined by spaces."""
    kept, used = [], 0
    for part in parts:
        used += len(part) + (used > 0)
        if used > room:
            break
        kept.append(part)
    return kept


def keep_ends(text: str | None, most: int) -> str:
    """SCA-14: leading sentences up to four fifths of `most` and, if a fifth is over 100, trailing ones within that."""
    text = text or ""
    if len(text) <= most:
        return text
    sentences = _AFTER_SENTENCE.split(text)
    if len(sentences) == 1:
        sentences = _BEFORE_CAPITAL.split(text)
    end = int(most * 0.2)
    if len(sentences) == 1:
        return text[: int(most * 0.8)] + CUT_MARK + text[-end:]
    out = " ".join(_fitting(sentences, most - end))
    tail = " ".join(reversed(_fitting(reversed(sentences), end))).strip() if end > 100 else ""
    if tail and tail not in out:
        out += MIDDLE_MARK + tail
    return (out or text[: most - 3] + "...").strip()


def sections(text: str) -> list[tuple[str, str]]:
    """(heading, body) of a Markdown page; what precedes the first heading has a blank one, and goes if it is blank too."""
    at = [m.start() for m in _HEADING.finditer(text)]
    cuts = [text[a:b] for a, b in zip(at, [*at[1:], len(text)])]
    found = [("", text[: at[0]] if at else text)] + [tuple((c.split("\n", 1) + [""])[:2]) for c in cuts]
    return [(h.strip(), body.strip()) for h, body in found if h or body.strip()]


def for_prompt(text: str | None, most: int = PAGE_CHARS) -> str:
    """SCA-15: whole sections while they fit, the next one by sentences if more than 300 characters are left; else SCA-14."""
    text = text or ""
    if len(text) <= most:
        return text
    out, found = "", sections(text)
    for heading, body in found if len(found) > 1 else ():
        head = heading + "\n" if heading else ""
        if len(out) + len(head) + len(body) + 2 > most:
            left = most - len(out)
            body = keep_ends(body, left - len(head)) if left > 300 else ""
            return "\n\n".join(filter(None, (out, head + body if body else ""))) or keep_ends(text, most)
        out = "\n\n".join(filter(None, (out, head + body)))
    return out or keep_ends(text, most)


def chunker(f, *args):
    """A column function from text to an array of chunks, by one of the functions above."""

    @F.arrow_udf("array<string>")
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([f(t, *args) for t in batch.to_pylist()], pa.list_(pa.string()))

    return cut
