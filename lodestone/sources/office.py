"""Documents to text: delimited files, word processor, spreadsheet, slide and open-document archives, RTF and mail.

SRC-10..20, SCA-25/40/41/42/43, SNK-06, TAB-14. Plain functions from bytes to Markdown or text, for use in Arrow batches;
archives are read with the standard library. What can't be read raises `ReadError` with a short code.
"""

from __future__ import annotations

import csv
import datetime as dt
import email
import email.policy
import html
import io
import re
import zipfile
from xml.etree import ElementTree as ET

MAX_ROWS, MAX_COLUMNS, MAX_CHARS, MAX_REPEAT, MAX_PART = 3000, 100, 200_000, 200, 64 << 20
#: Number formats of dates that have ids instead of patterns.
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}


class ReadError(ValueError):
    def __init__(self, code: str):
        super().__init__(code)
        self.code = code


def decode(data: bytes) -> str:
    """SRC-19: UTF-16 by its mark, else UTF-8, without the mark."""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return data.decode("utf-16", "replace")
    return data.decode("utf-8", "replace").removeprefix("\ufeff")


def markdown_table(rows: list[list[str]]) -> str:
    """SNK-06: the first row heads the table; empty rows and trailing empty columns are left out."""
    clean = [[" ".join(str(c or "").split()).replace("\\", "\\\\").replace("|", "\\|") for c in r] for r in rows]
    clean = [r for r in clean if any(r)]
    width = max((k + 1 for r in clean for k, c in enumerate(r) if c), default=0)
    lines = ["| " + " | ".join((r + [""] * width)[:width]) + " |" for r in clean]
    return "\n".join(lines[:1] + ["| " + " | ".join(["---"] * width) + " |"] * bool(lines) + lines[1:])


def sniff(text: str) -> str:
    """SRC-17: the commonest delimiter outside quotes; a comma wins ties, then semicolon, tab and bar."""
    outside = "".join(text[: 1 << 16].split('"')[::2])
    return max(",;\t|", key=lambda d: (outside.count(d), -",;\t|".index(d)))


def delimited(data: bytes, extension: str = "csv") -> str:
    text = decode(data)
    delimiter = "\t" if extension in ("tsv", "tab") else sniff(text)
    csv.field_size_limit(1 << 30)
    rows, left, cut = [], MAX_CHARS, False
    for row in csv.reader(io.StringIO(text, newline=""), delimiter=delimiter):
        if len(rows) >= MAX_ROWS or left <= 0:
            cut = True
            break
        kept = []
        for cell in row:
            kept.append(cell[: max(0, left)])
            cut |= len(cell) > left
            left -= len(cell)
        rows.append(kept)
    table = markdown_table(rows)
    return f"{table}\n\n[table cut]" if cut and table else table


# archives


def _open(data: bytes) -> zipfile.ZipFile:
    try:
        z = zipfile.ZipFile(io.BytesIO(data))
    except (zipfile.BadZipFile, ValueError) as error:
        raise ReadError("not-an-archive") from error
    if any(i.flag_bits & 1 for i in z.infolist()):
        raise ReadError("encrypted")
    return z


def _xml(z: zipfile.ZipFile, name: str) -> ET.Element | None:
    if name not in z.namelist():
        return None
    if z.getinfo(name).file_size > MAX_PART:
        raise ReadError("too-large")
    try:
        return ET.fromstring(z.read(name))
    except ET.ParseError as error:
        raise ReadError("invalid-xml") from error


def _tag(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def _attr(e: ET.Element, name: str) -> str:
    return next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), "")


def _runs(e: ET.Element) -> str:
    out = []
    for x in e.iter():
        t = _tag(x)
        out.append(x.text or "" if t == "t" else "\t" if t == "tab" else "\n" if t in ("br", "cr") else "")
    return "".join(out)


def _number(name: str) -> tuple[int, str]:
    return int((re.findall(r"(\d+)\.xml$", name) or ["0"])[0]), name


def docx(data: bytes) -> str:
    """SRC-12: headings, list items, tables and notes of a word processor file."""
    z = _open(data)
    body = _xml(z, "word/document.xml")
    if body is None:
        raise ReadError("invalid-document")

    def paragraph(p: ET.Element) -> str:
        text = _runs(p).strip()
        style = next((_attr(s, "val") for s in p.iter() if _tag(s) == "pStyle"), "")
        level = re.match(r"(?i)heading\s*([1-6])$", style)
        listed = any(_tag(x) == "numPr" for x in p.iter())
        return "" if not text else "#" * int(level[1]) + " " + text if level else "# " + text if style.lower() == "title" else "- " + text if listed else text

    def blocks(parent: ET.Element) -> list[str]:
        out = []
        for e in parent:
            if _tag(e) == "p":
                out.append(paragraph(e))
            elif _tag(e) == "tbl":
                rows = [[" ".join(_runs(p).strip() for p in c.iter() if _tag(p) == "p") for c in r if _tag(c) == "tc"] for r in e if _tag(r) == "tr"]
                out.append(markdown_table(rows))
            elif _tag(e) in ("sdt", "sdtContent", "body"):
                out += blocks(e)
        return [b for b in out if b]

    out = blocks(body)
    for part in ("footnotes", "endnotes"):
        notes = _xml(z, f"word/{part}.xml")
        if notes is not None:
            texts = [_runs(n).strip() for n in notes if not _attr(n, "type")]
            out += [f"[{part[:-1]} {k}] {t}" for k, t in enumerate(filter(None, texts), 1)]
    return "\n\n".join(out)


def column_index(reference: str) -> int:
    """SCA-42."""
    n = 0
    for ch in re.match(r"[A-Za-z]*", reference or "")[0].upper():
        n = n * 26 + ord(ch) - 64
    return n - 1


def excel_date(serial: float, from_1904: bool = False) -> str:
    """SCA-40: the 1900 calendar counts a day that never was, so its epoch moves at serial 61."""
    epoch = dt.datetime(1904, 1, 1) if from_1904 else dt.datetime(1899, 12, 30 if serial >= 61 else 31)
    try:
        at = epoch + dt.timedelta(milliseconds=round(serial * 86_400_000))
    except OverflowError:
        return str(serial)
    whole = abs(serial - int(serial)) <= 1e-9
    return at.strftime("%Y-%m-%d") if serial == 0 or (serial >= 1 and whole) else at.strftime("%Y-%m-%d %H:%M") if serial >= 1 else at.strftime("%H:%M")


def excel_number(x: float) -> str:
    """SCA-41: twelve significant digits."""
    x = float(f"{x:.12g}")
    return str(int(x)) if x == int(x) and abs(x) < 1e21 else repr(x)


def is_date_format(pattern: str) -> bool:
    """SCA-43."""
    return bool(re.search(r"(?i)[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", pattern)))


def xlsx(data: bytes) -> str:
    """SRC-13: a table for each sheet."""
    z = _open(data)
    book = _xml(z, "xl/workbook.xml")
    strings = _xml(z, "xl/sharedStrings.xml")
    shared = [_runs(s) for s in strings] if strings is not None else []
    styles = _xml(z, "xl/styles.xml")
    custom = {_attr(f, "numFmtId"): _attr(f, "formatCode") for f in styles.iter() if _tag(f) == "numFmt"} if styles is not None else {}
    cells = next((list(x) for x in styles.iter() if _tag(x) == "cellXfs"), []) if styles is not None else []
    dates = [is_date_format(custom[i]) if (i := _attr(x, "numFmtId")) in custom else i.isdigit() and int(i) in DATE_FORMATS for x in cells]
    from_1904 = book is not None and any(_tag(x) == "workbookPr" and _attr(x, "date1904") in ("1", "true") for x in book.iter())
    relations = {_attr(r, "Id"): _attr(r, "Target") for r in (_xml(z, "xl/_rels/workbook.xml.rels") or ())}
    sheets = [(_attr(s, "name"), relations.get(_attr(s, "id"), "")) for s in (book.iter() if book is not None else ()) if _tag(s) == "sheet"]
    paths = sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=_number)
    found = []
    for k, (name, target) in enumerate(sheets or [("", "")] * len(paths)):
        path = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        path = path if path in z.namelist() else f"xl/worksheets/sheet{k + 1}.xml"
        found.append((name or f"Sheet {k + 1}", path))
    if not found:
        raise ReadError("invalid-workbook")

    def cell(c: ET.Element) -> str:
        kind, style = _attr(c, "t"), _attr(c, "s")
        value = "".join(v.text or "" for v in c if _tag(v) == "v")
        inline = "".join(_runs(v) for v in c if _tag(v) == "is")
        bare = value.strip()
        if kind == "s":
            return shared[int(bare)] if bare.isdigit() and int(bare) < len(shared) else ""
        if kind == "inlineStr":
            return inline
        if kind == "b":
            return "TRUE" if bare == "1" else "FALSE"
        if kind in ("str", "e", "d"):
            return value
        try:
            x = float(bare)
        except ValueError:
            return value if bare else inline
        return excel_date(x, from_1904) if style.isdigit() and int(style) < len(dates) and dates[int(style)] else excel_number(x)

    out = []
    for name, path in found:
        sheet = _xml(z, path)
        rows = []
        for r in (sheet.iter() if sheet is not None else ()):
            if _tag(r) == "row" and len(rows) < MAX_ROWS:
                row: dict[int, str] = {}
                for c in r:
                    at = column_index(_attr(c, "r"))
                    at = len(row) if at < 0 else at
                    if at < MAX_COLUMNS:
                        row[at] = cell(c)
                rows.append([row.get(i, "") for i in range(max(row, default=-1) + 1)])
        if table := markdown_table(rows):
            out.append(f"## Sheet: {name}\n\n{table}")
    return "\n\n".join(out)


def pptx(data: bytes) -> str:
    """SRC-14: the text of each slide in order of presentation."""
    z = _open(data)
    deck = _xml(z, "ppt/presentation.xml")
    relations = {_attr(r, "Id"): "ppt/" + _attr(r, "Target").lstrip("/").removeprefix("ppt/") for r in (_xml(z, "ppt/_rels/presentation.xml.rels") or ())}
    order = [relations.get(v, "") for s in (deck.iter() if deck is not None else ()) if _tag(s) == "sldId" for k, v in s.attrib.items() if k.endswith("}id")]
    order = [p for p in order if p in z.namelist()] or sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=_number)
    if not order:
        raise ReadError("invalid-presentation")
    out = []
    for k, path in enumerate(order, 1):
        parts = []
        for shape in slide.iter() if (slide := _xml(z, path)) is not None else ():
            if _tag(shape) == "tbl":
                parts.append(markdown_table([[" ".join(_runs(p) for p in c.iter() if _tag(p) == "p") for c in r if _tag(c) == "tc"] for r in shape if _tag(r) == "tr"]))
            elif _tag(shape) == "txBody":
                lines = ["".join("\n" if _tag(x) == "br" else _runs(x) for x in p if _tag(x) in ("r", "br")).strip() for p in shape if _tag(p) == "p"]
                parts.append("\n".join(filter(None, lines)))
        out.append("\n\n".join([f"## Slide {k}", *filter(None, parts)]))
    return "\n\n".join(out)


_ODF_SKIP = {"annotation", "tracked-changes", "notes", "forms", "sequence-decls", "scripts"}


def odf(root: ET.Element) -> str:
    """SRC-15: headings, lists, tables and slides of an open document; filler rows and columns are left out."""

    def flat(e: ET.Element) -> str:
        own = e.text or ""
        for x in e:
            t = _tag(x)
            own += "" if t in _ODF_SKIP else " " * int(_attr(x, "c") or 1) if t == "s" else "\t" if t == "tab" else "\n" if t == "line-break" else flat(x)
            own += x.tail or ""
        return own

    def times(e: ET.Element, name: str) -> int:
        return min(MAX_REPEAT, int(_attr(e, name) or 1))

    def table(e: ET.Element) -> list[list[str]]:
        rows = []
        for r in e.iter():
            if _tag(r) == "table-row":
                row = [c for x in r if _tag(x) in ("table-cell", "covered-table-cell") for c in [" ".join(flat(p).strip() for p in x if _tag(p) in ("p", "h"))] * times(x, "number-columns-repeated")]
                rows += [row] * (times(r, "number-rows-repeated") if any(row) else 1)
        return rows[:MAX_ROWS]

    out: list[str] = []

    def walk(e: ET.Element, listed: bool = False) -> None:
        t = _tag(e)
        if t in _ODF_SKIP:
            return
        if t == "table":
            text = markdown_table(table(e))
            out.append(f"## Sheet: {_attr(e, 'name')}\n\n{text}" if text and sheet else text)
        elif t == "page":
            out.append(f"## Slide {sum(o.startswith('## Slide') for o in out) + 1}")
            for x in e:
                walk(x)
        elif t in ("h", "p"):
            text = flat(e).strip()
            out.append("" if not text else "#" * min(6, int(_attr(e, "outline-level") or 1)) + " " + text if t == "h" else "- " + text if listed else text)
        else:
            for x in e:
                walk(x, listed or t == "list-item")

    sheet = any(_tag(x) == "spreadsheet" for x in root.iter())
    for body in root.iter():
        if _tag(body) == "body":
            walk(body)
    return "\n\n".join(filter(None, out))


def odf_archive(data: bytes) -> str:
    content = _xml(_open(data), "content.xml")
    if content is None:
        raise ReadError("invalid-document")
    return odf(content)


def odf_flat(data: bytes) -> str:
    try:
        return odf(ET.fromstring(data))
    except ET.ParseError as error:
        raise ReadError("invalid-xml") from error


_RTF = re.compile(rb"\\([a-z]+)(-?\d+)? ?|\\'([0-9a-f]{2})|\\([^a-z])|([{}])|[\r\n]+|([^\\{}\r\n]+)", re.I)
#: Destinations whose text isn't the document's; control words that stand for signs.
_RTF_SKIP = {b"fonttbl", b"colortbl", b"stylesheet", b"info", b"pict", b"object", b"header", b"footer", b"themedata", b"datastore", b"listtable", b"listoverridetable", b"generator", b"fldinst"}
_RTF_SIGNS = {b"par": "\n", b"line": "\n", b"row": "\n", b"page": "\n", b"tab": "\t", b"cell": "\t", b"emdash": "—", b"endash": "–", b"bullet": "•", b"lquote": "‘", b"rquote": "’", b"ldblquote": "“", b"rdblquote": "”"}


def rtf(data: bytes) -> str:
    """SRC-16: text of control words, Unicode escapes with their fallbacks, code pages and skipped destinations."""
    if not data.lstrip().startswith(b"{\\rtf"):
        raise ReadError("invalid-rtf")
    out: list[str] = []
    stack: list[tuple[bool, int]] = []
    skip, fallback, page, todo, at = False, 1, "cp1252", 0, 0
    while at < len(data):
        m = _RTF.match(data, at)
        if not m:
            at += 1
            continue
        at = m.end()
        word, arg, byte, sign, brace, text = m.groups()
        if brace == b"{":
            stack.append((skip, fallback))
        elif brace == b"}":
            skip, fallback = stack.pop() if stack else (False, 1)
        elif word:
            word = word.lower()
            if word == b"bin":
                at += max(0, int(arg or 0))
            elif word in _RTF_SKIP:
                skip = True
            elif word == b"ansicpg" and arg:
                page = f"cp{int(arg)}" if int(arg) != 65001 else "utf-8"
            elif word == b"uc":
                fallback = int(arg or 1)
            elif word == b"u" and arg and not skip:
                out.append(chr(int(arg) % 65536))
                todo = fallback
            elif word in _RTF_SIGNS and not skip:
                out.append(_RTF_SIGNS[word])
        elif byte or text or (sign and sign in b"\\{}~-_"):
            if sign:
                text = {b"~": b" ", b"-": b"", b"_": b"-"}.get(sign, sign)
            raw = bytes([int(byte, 16)]) if byte else text
            if todo:
                used = min(todo, len(raw))
                raw, todo = raw[used:], todo - used
            if not skip:
                try:
                    out.append(raw.decode(page, "replace"))
                except LookupError:
                    out.append(raw.decode("cp1252", "replace"))
        elif sign == b"*":
            skip = True
    joined = "".join(out).encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", joined)).strip()


def mail_html(text: str) -> str:
    """SCA-02: tags go without a space, unknown entities go too."""
    text = re.sub(r"(?is)<!--.*?-->|<(script|style|head)\b.*?</\1>", "", text)
    text = re.sub(r"(?i)<br\s*/?>|</(p|div|tr|h[1-6]|li)>", "\n", text)
    text = re.sub(r"&[a-zA-Z]\w*;", "", html.unescape(re.sub(r"<[^>]+>", "", text)))
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", text)).strip()


def eml(data: bytes) -> str:
    """SRC-20, TAB-14: headers, the plain text part before the HTML one, and attachments with their sizes."""
    message = email.message_from_bytes(data, policy=email.policy.default)
    head = [f"{k}: {message[k]}" for k in ("From", "To", "Cc", "Date", "Subject") if message[k]]
    plain, rich, attached = [], [], []
    for part in message.walk():
        if part.is_multipart():
            continue
        body = part.get_payload(decode=True) or b""
        if part.get_content_disposition() == "attachment" or part.get_filename():
            attached.append(f"- {part.get_filename() or 'unnamed'} ({part.get_content_type()}, {len(body)} bytes)")
        elif part.get_content_maintype() == "text":
            try:
                text = body.decode(part.get_content_charset() or "utf-8", "replace")
            except LookupError:
                text = body.decode("utf-8", "replace")
            (rich if part.get_content_subtype() == "html" else plain).append(text.replace("\r\n", "\n").strip())
    body = "\n\n".join(plain) or "\n\n".join(map(mail_html, rich))
    return "\n\n".join(filter(None, ["\n".join(head), body, "Attachments:\n" + "\n".join(attached) if attached else ""]))


def plain(data: bytes, most: int = 24_000) -> str:
    """SRC-21: one kind of line end, no NUL, no trailing spaces, two line ends at most, cut at `most`."""
    text = decode(data).replace("\r\n", "\n").replace("\r", "\n").replace("\0", "")
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", text)).strip()[:most]


#: The reader of each extension.
READERS = {
    "docx": docx, "docm": docx, "dotx": docx, "xlsx": xlsx, "xlsm": xlsx, "xltx": xlsx, "pptx": pptx, "pptm": pptx, "ppsx": pptx,
    "odt": odf_archive, "ods": odf_archive, "odp": odf_archive, "odg": odf_archive, "fodt": odf_flat, "fods": odf_flat, "fodp": odf_flat,
    "rtf": rtf, "csv": delimited, "tsv": lambda b: delimited(b, "tsv"), "tab": lambda b: delimited(b, "tab"), "eml": eml, "txt": plain, "md": plain,
}


def extract(data: bytes | None, extension: str) -> tuple[str | None, str | None]:
    """SRC-18: text and no error, or no text and an error's code."""
    reader = READERS.get((extension or "").lower().lstrip("."))
    if reader is None:
        return None, "unsupported-format"
    try:
        return reader(data or b""), None
    except ReadError as error:
        return None, error.code
