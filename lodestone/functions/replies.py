"""Replies of language models and tools made into rows: lenient JSON, tool calls, plans, facts, titles, bibliographies.

SCA-19/23/26/52/60/61/62, TAB-10/11/12/15, FLT-15/16/17/18, SRC-25/26/27, PIP-09. Column functions where regular
expressions can say it; a few scanners in Python, for Arrow batches, where nesting must be counted.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

FACT = "array<struct<claim:string,url:string,anchor_text:string>>"
PLAN = "array<struct<sub_task:string,search_query:string,rationale:string,hypothesis:string,evidence_needed:string>>"


def unfenced(x: Column) -> Column:
    """Text without a surrounding code fence."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), r"^\s*```[a-zA-Z]*\s*\n?", ""), r"\n?```\s*$", ""))


def lenient_json(x: Column, schema: str) -> Column:
    """SCA-60: the whole text, else what is fenced, else its widest array or object, as JSON of the schema; null if none is."""
    wide = F.regexp_extract(F.coalesce(x, F.lit("")), r"(?s)(\[.*\]|\{.*\})" if schema.startswith("array") else r"(?s)(\{.*\})", 1)
    opens = r"^\s*[\[{]" if schema.startswith("array") else r"^\s*\{"

    def good(c: Column) -> Column:
        # what is no JSON would become a struct of nulls
        return F.when(c.rlike(opens) & F.try_parse_json(c).isNotNull(), F.from_json(c, schema))

    return F.coalesce(good(F.trim(x)), good(unfenced(x)), good(wide))


def rerank_scores(answer: Column, expected: int) -> Column:
    """SCA-61: `{"scores": [..]}` or a list, of the expected length, each cut to [0, 1]; else null."""
    keyed, bare = lenient_json(answer, "struct<scores:array<double>>")["scores"], F.from_json(F.regexp_extract(F.coalesce(answer, F.lit("")), r"(?s)(\[[^\]]*\])", 1), "array<double>")
    scores = F.coalesce(keyed, bare)
    return F.when((F.size(scores) == expected) & ~F.exists(scores, lambda s: s.isNull()), F.transform(scores, lambda s: F.greatest(F.lit(0.0), F.least(F.lit(1.0), s))))


def facts(reply: Column, url: Column) -> Column:
    """TAB-15: a JSON array of facts, else up to five bullets as claims of the url."""
    parsed = F.filter(lenient_json(reply, FACT), lambda f: F.coalesce(F.trim(f["claim"]), F.lit("")) != "")
    bullets = F.slice(F.regexp_extract_all(F.coalesce(reply, F.lit("")), F.lit(r"(?m)^\s*[-*•]\s+(.+)$"), 1), 1, 5)
    made = F.transform(bullets, lambda b: F.struct(F.trim(b).alias("claim"), url.alias("url"), F.lit("").alias("anchor_text")))
    return F.when(F.size(parsed) > 0, parsed).otherwise(made)


def plan(reply: Column) -> Column:
    """TAB-11: a JSON array of sub-tasks, else a numbered list of two or more."""
    parsed = F.filter(lenient_json(reply, PLAN), lambda p: F.coalesce(F.trim(F.coalesce(p["sub_task"], p["search_query"])), F.lit("")) != "")
    lines = F.regexp_extract_all(F.coalesce(reply, F.lit("")), F.lit(r"(?m)^\s*\d+[.)]\s+(.+)$"), 1)
    none = F.lit(None).cast("string")
    made = F.transform(lines, lambda s: F.struct(F.trim(s).alias("sub_task"), F.trim(s).alias("search_query"), none.alias("rationale"), none.alias("hypothesis"), none.alias("evidence_needed")))
    return F.when(F.size(parsed) > 0, parsed).when(F.size(lines) >= 2, made)


#: Queries that a gap check, one after a low score and a check of causes may add.
GAP_QUERIES, RETRY_QUERIES, CAUSAL_QUERIES = 2, 4, 3
OUTLINE = "struct<sections:array<struct<title:string,key_claims:array<string>,based_on:array<string>>>>"
CRITIQUE = "struct<sufficient:boolean,contradictions:array<string>,adjustments:array<string>,drop_indices:array<string>,new_branches:array<struct<sub_task:string,search_query:string,rationale:string>>>"
QUALITY = "struct<coverage_score:double,score:double,groundedness_score:double,missing_aspects:array<string>,unsupported_claims:array<string>,unverified_citations:array<string>>"


def follow_ups(reply: Column, most: int = GAP_QUERIES) -> Column:
    """PIP-09: the first queries of a gap or causal check's reply; no plan gives none."""
    none = F.from_json(F.lit("[]"), PLAN)
    return F.slice(F.coalesce(plan(reply), none), 1, most)


def critique(reply: Column) -> Column:
    """PIP-09: a verdict on the plan in the middle of a run. Indices that aren't whole and branches without a query go;
    missing lists are empty. Null where the reply holds no object."""
    c, none = lenient_json(reply, CRITIQUE), F.array().cast("array<string>")
    whole = F.transform(F.filter(F.coalesce(c["drop_indices"], none), lambda i: i.rlike(r"^-?\d+$")), lambda i: i.cast("int"))
    spawned = F.filter(F.coalesce(c["new_branches"], F.from_json(F.lit("[]"), "array<struct<sub_task:string,search_query:string,rationale:string>>")), lambda b: F.coalesce(b["search_query"], F.lit("")) != "")
    return F.when(
        c.isNotNull(),
        F.struct(
            F.coalesce(c["sufficient"], F.lit(False)).alias("sufficient"), F.coalesce(c["contradictions"], none).alias("contradictions"), F.coalesce(c["adjustments"], none).alias("adjustments"),
            whole.alias("drop_indices"), spawned.alias("new_branches"),
        ),
    )


def outline(reply: Column, least: int = 0) -> Column:
    """PIP-09: the sections of an outline; null without a list of them. A refined outline must have one at least."""
    sections = lenient_json(reply, OUTLINE)["sections"]
    return F.when(F.size(sections) >= least, sections)


def quality(reply: Column) -> Column:
    """PIP-09: coverage (or a single score), groundedness and what was flagged; null without a score."""
    q, none = lenient_json(reply, QUALITY), F.array().cast("array<string>")
    filled = lambda c: F.filter(F.coalesce(q[c], none), lambda x: F.coalesce(x, F.lit("")) != "")
    coverage = F.coalesce(q["coverage_score"], q["score"])
    return F.when(
        coverage.isNotNull(),
        F.struct(
            coverage.alias("coverage"), q["groundedness_score"].alias("groundedness"), F.coalesce(q["missing_aspects"], none).alias("missing"),
            filled("unsupported_claims").alias("unsupported"), filled("unverified_citations").alias("unverified"),
        ),
    )


def bibliography(text: Column) -> Column:
    """TAB-12: (number, url) of the lines of a source list, the first url of each number."""
    line = r"(?m)^\s*(?:[-*]\s*)?\[?(\d{1,3})[\].)]*:?\s+.*?(https?://[^\s)>\]]+)"
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(line), 1).alias("number"), F.regexp_extract_all(text, F.lit(line), 2).alias("url"))
    made = F.transform(pairs, lambda p: F.struct(p["number"].cast("int").alias("number"), p["url"].alias("url")))
    return F.filter(made, lambda p, i: ~F.exists(F.slice(made, F.lit(1), i), lambda q: q["number"] == p["number"]))


def title(reply: Column, most: int = 60) -> Column:
    """SCA-19: a clean title: JSON field or first line, without label, bullet, quotes and end mark; null for refusals."""
    said = F.coalesce(lenient_json(reply, "struct<title:string>")["title"], F.regexp_extract(unfenced(reply), r"([^\n]+)", 1))
    bare = F.regexp_replace(F.regexp_replace(F.trim(said), r"(?i)^(title|topic|subject)\s*[:\-]\s*", ""), r"""^[-*#\d.\s"'“”]+|["'“”.\s]+$""", "")
    refused = (bare == "") | bare.rlike(r"(?i)^(i'm sorry|i cannot|i can't|as an ai|untitled|new (chat|conversation))")
    return F.when(~refused, F.substring(bare, 1, most))


def is_pdf(url: Column, content: Column) -> Column:
    """FLT-18: by the path's extension or the first bytes, after a mark and white space."""
    return F.lower(F.regexp_replace(F.coalesce(url, F.lit("")), r"[?#].*$", "")).endswith(".pdf") | F.coalesce(F.decode(F.substring(content, 1, 64), "ISO-8859-1").rlike(r"^(\xEF\xBB\xBF)?\s*%PDF-"), F.lit(False))


#: Codes of failures that are tried again or read without a model, statuses and words likewise.
RETRYABLE_CODES = ("rate-limited", "server-busy", "connection-failed", "network-error")
RETRYABLE_STATUSES = (408, 425, 429)
TRANSIENT_STATUSES = (408, 425, 429, 502, 503, 504)
TRANSIENT_WORDS = ("rate limit", "rate-limit", "too many requests", "requeued", "memory pressure", "service unavailable", "temporarily unavailable")
FALLBACK_CODES = ("bad-response", "no-task-id", "timeout")
FALLBACK_STATUSES = (400, 404, 405, 500, 501)


def retryable(code: Column, status: Column) -> Column:
    """FLT-17: whether a failed request is sent again."""
    http = (code == "http-error") & (status.isin(*RETRYABLE_STATUSES) | status.between(500, 599))
    return F.coalesce(code.isin(*RETRYABLE_CODES) | http, F.lit(False))


def transient(success: Column, status: Column, message: Column) -> Column:
    """FLT-17: whether a page's own failure, in a reply that arrived, is worth another try."""
    said = F.lower(F.coalesce(message, F.lit("")))
    words = F.lit(False)
    for w in TRANSIENT_WORDS:
        words = words | said.contains(w)
    return ~F.coalesce(success, F.lit(False)) & (F.coalesce(status.isin(*TRANSIENT_STATUSES), F.lit(False)) | words)


def fallback_worthy(code: Column, status: Column) -> Column:
    """FLT-17: whether a page that a model couldn't read is read as plain Markdown instead."""
    return F.coalesce(code.isin(*FALLBACK_CODES) | ((code == "http-error") & status.isin(*FALLBACK_STATUSES)), F.lit(False))


def retry_delay(retry_after: Column, attempt: Column, jitter: Column, ladder: tuple[int, ...] = (2, 5, 10), most: int = 60) -> Column:
    """SCA-52: seconds: the server's wish, else the ladder's step and up to a quarter more; a minute at most."""
    step = F.lit(ladder[-1])
    for k in range(len(ladder) - 2, -1, -1):
        step = F.when(attempt <= k, ladder[k]).otherwise(step)
    return F.least(F.lit(float(most)), F.coalesce(retry_after.try_cast("double"), step * (1 + 0.25 * jitter)))


def best_text(fit: Column, structured: Column, reply: Column) -> Column:
    """SRC-27: the first that isn't blank of fitted Markdown, structured JSON and the model's reply."""
    filled = lambda c: F.when(F.trim(c) != "", c)
    return F.coalesce(filled(fit), filled(structured), filled(reply), F.lit(""))


def crawl_text(fit: Column, raw: Column) -> Column:
    """SRC-25: fitted Markdown, or the raw one if that lost over two fifths of two or more code fences."""
    count = lambda c: F.regexp_count(F.coalesce(c, F.lit("")), F.lit("```")) / 2
    return F.when((count(raw) >= 2) & (count(fit) < 0.6 * count(raw)), raw).otherwise(F.coalesce(fit, raw))


def looks_like_tool_calls(text: Column) -> Column:
    """FLT-15: markup, JSON or call syntax of tools, unless it is within long prose."""
    t = F.coalesce(text, F.lit(""))
    hit = t.rlike(r"(?i)<(tool_call|function_call|invoke|function=)") | t.rlike(r"""(?s)\{\s*"(name|tool|function)"\s*:\s*"[\w.]+"\s*,\s*"(arguments|parameters|args)"\s*:""") | t.rlike(r"(?m)^\s*(web_search|read_url|crawl_url|knowledge_search|deep_research)\s*\(")
    return hit & ~((F.length(t) > 2000) & (F.regexp_count(t, F.lit(r"[.!?]\s")) > 20))


#: Signs that are dropped, signs that stand for others, marks of one vendor's format and gaps in tags.
MARKUP_NORMAL = (
    (r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]", ""),
    (r"[\x{AD}\x{600}-\x{605}\x{61C}\x{6DD}\x{70F}\x{8E2}\x{180E}\x{200B}-\x{200F}\x{2028}-\x{202E}\x{2060}-\x{2069}\x{FEFF}\x{FFF9}-\x{FFFB}]", ""),
    (r"[\x{E0000}-\x{E007F}]", ""), (r"[\x{2039}\x{2329}\x{27E8}\x{3008}\x{FE64}\x{FF1C}]", "<"),
    (r"[\x{203A}\x{232A}\x{27E9}\x{3009}\x{FE65}\x{FF1E}]", ">"), (r"[\x{201C}\x{201D}\x{201E}\x{FF02}]", "\""),
    (r"\x{FF5C}+", "|"), (r"(?i)\|DSML\|", ""), (r"\|(?=[a-zA-Z_])", ""),
    (r"(?i)<\s+(?=(?:tool_calls?|function_calls?|invoke|parameter|function|calls)\b)", "<"), (r"(?i)</\s+(?=(?:tool_calls?|function_calls?|invoke|parameter|function|calls)\b)", "</"),
)
#: Tools whose calls are taken out of replies, and what is taken out, in this order.
STRIPPED_TOOLS = "web_search|read_url|crawl_url|python|terminal"
MARKUP_GONE = (
    r"(?is)<function_calls>.*?</function_calls>", r"(?is)<tool_calls>.*?</tool_calls>", r"(?is)<invoke\b[^>]*>.*?</invoke>", r"(?i)<function>\s*\w+\s*</function>",
    r"(?is)<parameter\b[^>]*>.*?</parameter>", r"(?i)<parameter\b[^>]*/>", r"(?is)<invoke\b[^>]*>.*?(?=</?[a-zA-Z_]|\z)", r"(?is)<(?:function_calls|tool_calls)\b[^>]*>.*?(?=</?[a-zA-Z_]|\z)",
    r"(?is)<parameter\b[^>]*>.*?(?=\n|\z)", r"(?i)<function>\s*\w+\s*</function>", rf'(?i)\{{[^{{}}]*"name"\s*:\s*"(?:{STRIPPED_TOOLS})"[^{{}}]*\}}',
    rf"(?i)(?:{STRIPPED_TOOLS})\s*\(\s*\{{[^{{}}]*\}}\s*\)", r"</?[a-zA-Z_][a-zA-Z0-9_]*(?:\s[^>]*)?/?>",
)
#: Signs that markup is still there, and lines that then go.
MARKUP_LEFT = r"<invoke|<tool_call|<function_call|<parameter|web_search\(|read_url\(|crawl_url\("
LINE_OPENS, LINE_ENDS = r"(?i)< *(?:invoke|tool_call|function_call|parameter|function)[ >]", r"(?i)</ *(?:invoke|tool_call|function_call)>"
LINE_CALLS = rf'^\s*(\{{[^}}]*"(?:{STRIPPED_TOOLS})"|(?:{STRIPPED_TOOLS})\s*\()'


def without_tool_markup(text: Column) -> Column:
    """SCA-23: a reply without calls of tools, whole or cut off; lines go one by one where signs of markup are left. '' for null."""
    t = F.coalesce(text, F.lit(""))
    for pattern, to in MARKUP_NORMAL:
        t = F.regexp_replace(t, pattern, to)
    for pattern in MARKUP_GONE:
        t = F.regexp_replace(t, pattern, "")
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"[ \t\f\x0B]+", " "), r"\n{3,}", "\n\n"), r"^\s+|\s+\z", "")
    start = F.struct(F.lit(False).alias("skip"), F.array().cast("array<string>").alias("kept"))

    def step(a: Column, line: Column) -> Column:
        opens, ends = line.rlike(LINE_OPENS), line.rlike(LINE_ENDS)
        keep = ~opens & ~ends & ~a["skip"] & ~F.trim(line).rlike(LINE_CALLS) & (F.trim(line) != "")
        return F.struct((opens | (a["skip"] & ~ends)).alias("skip"), F.when(keep, F.concat(a["kept"], F.array(line))).otherwise(a["kept"]).alias("kept"))

    lines = F.trim(F.array_join(F.aggregate(F.split(t, "\n"), start, step, lambda a: a["kept"]), "\n"))
    return F.when(t.rlike(MARKUP_LEFT), lines).otherwise(t)


#: Commands and the tool that each starts.
COMMANDS = {"search": "web_search", "crawl": "crawl_url", "kb": "knowledge_search", "doc": "document"}


def command(text: Column) -> Column:
    """SCA-26: (tool, argument) of a message that begins with a command, or ends with the search command; else null."""
    t, names = F.trim(F.coalesce(text, F.lit(""))), "|".join(COMMANDS)
    name = F.lower(F.regexp_extract(t, rf"(?i)^/({names})\b", 1))
    tool = F.lit(None).cast("string")
    for k, v in COMMANDS.items():
        tool = F.when(name == k, v).otherwise(tool)
    rest = F.trim(F.regexp_replace(t, rf"(?i)^/({names})\b", ""))
    back = t.rlike(r"(?i)\s/search$")
    return F.when(name != "", F.struct(tool.alias("tool"), rest.alias("argument"))).when(back, F.struct(F.lit("web_search").alias("tool"), F.trim(F.regexp_replace(t, r"(?i)\s/search$", "")).alias("argument")))


def balanced(text: str, start: int) -> int:
    """SCA-62: the end of the JSON value that opens at `start`, strings and escapes minded; -1 if it never closes."""
    depth, quoted, k = 0, False, start
    while k < len(text):
        ch = text[k]
        if quoted:
            k += ch == "\\"
            quoted = ch != '"'
        elif ch == '"':
            quoted = True
        else:
            depth += (ch in "{[") - (ch in "}]")
            if depth == 0:
                return k + 1
        k += 1
    return -1


_CALL, _XML = re.compile(r"(?m)\b([a-z_]+)\(\s*(\{|[a-z_]+\s*=)"), re.compile(r"(?s)<(?:invoke|function)[ =]\"?(?:name=\")?([\w.]+)\"?>(.*?)</(?:invoke|function)>")


def tool_calls(text: str | None) -> list[tuple[str, str]]:
    """TAB-10: (name, arguments as JSON) of calls written as text: JSON objects, else calls, else markup; the first kind with any."""
    text, found = text or "", []
    at = text.find("{")
    while at >= 0:
        end = balanced(text, at)
        try:
            value = json.loads(text[at:end]) if end > 0 else None
        except ValueError:
            value = None
        call = value.get("function", value) if isinstance(value, dict) and isinstance(value.get("function", value), dict) else value
        name = (call.get("name") or call.get("tool")) if isinstance(call, dict) else None
        args = next((call[k] for k in ("arguments", "parameters", "args") if k in call), None) if name else None
        if isinstance(name, str) and args is not None:
            found.append((name, args if isinstance(args, str) else json.dumps(args)))
            at = text.find("{", end)
        else:
            at = text.find("{", at + 1)
    if found:
        return found
    for m in _CALL.finditer(text):
        if m[2] == "{":
            end = balanced(text, m.end() - 1)
            body = text[m.end() - 1 : end] if end > 0 else ""
        else:
            close = text.find(")", m.end())
            pairs = re.findall(r"""([a-z_]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^,\s)]+))""", text[m.start(2) : close if close >= 0 else len(text)])
            body = json.dumps({k: a or b or c for k, a, b, c in pairs})
        try:
            json.loads(body)
            found.append((m[1], body))
        except ValueError:
            pass
    return found or [(m[1], json.dumps(dict(re.findall(r'(?s)<parameter[ =]"?(?:name=")?([\w.]+)"?>(.*?)</parameter>', m[2])))) for m in _XML.finditer(text)]


def tool_call_parser():
    @F.arrow_udf("array<struct<name:string,arguments:string>>")
    def parsed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("name", pa.string()), ("arguments", pa.string())]))
        for batch in batches:
            yield pa.array([[{"name": n, "arguments": a} for n, a in tool_calls(t)] for t in batch.to_pylist()], kind)

    return parsed
