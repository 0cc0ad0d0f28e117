"""Text functions as column expressions: HTML to text, tokens, scores, estimates and classifiers.

SCA-01/02/03/06/07/08/09/10/11/12/13/18/21/27/28/34/49, FLT-02/11/12/14, WIN-12, TAB-13. Whitespace classes are ASCII.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no meaning in link scores.
LINK_STOPWORDS = (
    "the and for are but not you all can had her was one our out has have from they that this with what how when where which will would "
    "about your more than then into only other over such just docs doc documentation html page pages guide guides"
).split()
#: Words that carry no meaning when claims are compared.
CLAIM_STOPWORDS = (
    "the and for are but not you all can had her was one our out has have from they that this with what when where which will would about "
    "there their been more some than then also into only other over such each very just after before between through its his these those them"
).split()
#: Elements that are dropped with their content; elements whose end breaks a line.
DROPPED = ("script", "style", "noscript", "template", "svg", "head")
BREAKING = "p|div|section|article|header|footer|li|h[1-6]|tr|table|ul|ol|blockquote|pre"
#: Named entities and what they stand for.
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "hellip": "…", "mdash": "—", "ndash": "–", "rsquo": "’",
    "lsquo": "‘", "ldquo": "“", "rdquo": "”", "copy": "©", "reg": "®", "trade": "™", "deg": "°",
}
#: The ordered query intents and the words that tell them.
INTENTS = (
    ("code", r"error|bug|crashed?|undefined|syntax|compile|import |function |class |async|await|npm |pip |cargo |rustc|go build|dockerfile|api endpoint|http status|rest api|graphql"),
    ("news", r"when|today|yesterday|this week|this month|202[456789]|breaking|announced|just released|latest news"),
    ("academic", r"paper|doi|arxiv|study|research|journal|conference|proceedings|phd thesis"),
    ("facts", r"define|what is|who is|capital of|population|located in|how old|born|died|founded"),
)
#: Code keywords and symbols.
KEYWORDS = (
    r"\b(function|class|import|export|const|let|var|def|return|async|await|public|private|protected|static|void|struct|enum|interface|typedef|"
    r"#include|#define|npm|yarn|pnpm|pip|docker|cargo|curl|SELECT|INSERT|UPDATE|DELETE|FROM|WHERE)\b"
)
SYMBOLS = r"=>|[{}();]|</|/>"


def _re(x: Column, pattern: str, to: str) -> Column:
    return F.regexp_replace(x, pattern, to)


def bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), with x evaluated once however often f names it."""
    return F.transform(F.array(x), f)[0]


def _numbered(text: Column, mark: str, digits: str, base: int) -> Column:
    """Numeric entities of one kind as signs; numbers that are no code point give nothing."""
    number = rf"^&#{mark}({digits}+);"

    def part(x: Column) -> Column:
        n = F.regexp_extract(x, number, 1)
        code = F.when(F.length(F.ltrim(n, F.lit("0"))) <= 7, F.conv(n, base, 10).cast("long"))
        real = (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        sign = F.when(real, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise("")
        return F.when(n != "", F.concat(F.coalesce(sign, F.lit("")), F.regexp_replace(x, number, ""))).otherwise(x)

    return F.when(text.contains(f"&#{mark}"), F.array_join(F.transform(F.split(text, rf"(?=&#{mark}{digits}+;)"), part), "")).otherwise(text)


def decoded(text: Column) -> Column:
    """SCA-04 in expressions: hexadecimal, then decimal, then named entities, one pass each; unknown names stay."""
    t = bound(bound(text, lambda x: _numbered(x, "x", "[0-9a-fA-F]", 16)), lambda x: _numbered(x, "", "[0-9]", 10))
    for name, sign in ENTITIES.items():
        if name != "amp":
            t = F.replace(t, F.lit(f"&{name};"), F.lit(sign))
    return F.replace(t, F.lit("&amp;"), F.lit("&"))


def html_to_text(html: Column, entities: bool = True) -> Column:
    """SCA-01: visible text of a page, a line for each block and `- ` before list items; '' for null."""
    t = _re(F.coalesce(html, F.lit("")), r"(?s)<!--.*?-->", " ")
    # any dropped element ends at its own end tag, so one alternative each, in the order that they open
    t = _re(t, r"(?is)<(" + "|".join(DROPPED) + r").*?</\1>", " ")
    t = _re(_re(t, r"(?i)<li[^>]*>", "\n- "), r"(?i)<br\s*/?>", "\n")
    t = _re(_re(t, f"(?i)</({BREAKING})>", "\n"), r"<[^>]+>", " ")
    t = decoded(t) if entities else t
    t = _re(_re(_re(t, r"[ \t\f\x0B]+", " "), r" *\n *", "\n"), r"\n{3,}", "\n\n")
    return _re(t, r"^\s+|\s+$", "")


def tokens(text: Column) -> Column:
    """SCA-06: lower-cased runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-z0-9]+"), 0)


def keywords(text: Column, stop: list[str] = LINK_STOPWORDS) -> Column:
    """SCA-07: words of more than two characters that aren't stop words, with repeats."""
    words = F.split(_re(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9\s]", " "), r"\s+")
    held = F.array(*map(F.lit, stop))
    return F.filter(words, lambda w: (F.length(w) > 2) & ~F.array_contains(held, w))


def keyword_set(text: Column, stop: list[str] = CLAIM_STOPWORDS) -> Column:
    """SCA-08: the same as a set."""
    return F.array_distinct(keywords(text, stop))


def occurrences(haystack: Column, words: Column) -> Column:
    """SCA-09: how often the words occur in the text, without overlap, summed over the words with their repeats."""
    return F.aggregate(words, F.lit(0).cast("long"), lambda n, w: n + ((F.length(haystack) - F.length(F.replace(haystack, w, F.lit("")))) / F.length(w)).cast("long"))


def clean(x: Column) -> Column:
    """SCA-10: runs of white space as one space, none at the ends."""
    return F.trim(_re(F.coalesce(x, F.lit("")), r"\s+", " "))


def truncate_words(x: Column, most: int) -> Column:
    """SCA-11: at most `most` characters, cut at the last space if that lies in the second half, and an ellipsis."""
    head = F.substring(x, 1, most)
    back = F.locate(" ", F.reverse(head))
    at = F.when((back > 0) & (most - back > most / 2), most - back).otherwise(most)
    return F.when(F.length(x) <= most, x).otherwise(F.concat(F.rtrim(F.substring(x, F.lit(1), at)), F.lit("…")))


def snippet(x: Column, most: int = 500) -> Column:
    """SCA-12: the first characters and an ellipsis."""
    return F.when(F.length(x) <= most, x).otherwise(F.concat(F.rtrim(F.substring(x, 1, most)), F.lit("…")))


def default_title(first_user_text: Column) -> Column:
    """SCA-18: one line of at most 60 characters."""
    line = F.trim(_re(F.coalesce(first_user_text, F.lit("")), r"\n+", " "))
    return F.when(line == "", "New conversation").when(F.length(line) > 60, F.concat(F.substring(line, 1, 60), F.lit("…"))).otherwise(line)


def intent(query: Column) -> Column:
    """SCA-27: the first intent whose words occur anywhere in the query."""
    q, out = F.lower(F.trim(F.coalesce(query, F.lit("")))), F.lit("general")
    for name, pattern in reversed(INTENTS):
        out = F.when(q.rlike(pattern), name).otherwise(out)
    return out


def needs_expansion(query: Column) -> Column:
    """FLT-11: two or more signs of a conversational query."""
    q = _re(F.coalesce(query, F.lit("")), r"^\s+|\s+$", "")
    signs = (
        F.length(q) < 10, q.rlike(r"(?i)^(what|how|why|who|when|where)\b"), q.endswith("?"), F.size(F.split(q, r"\s+")) > 12,
        q.rlike(r"(?i)^(can you|could you|please|tell me|explain|find me|show me|look up|search for)\b"),
    )
    return (q != "") & (sum((s.cast("int") for s in signs[1:]), signs[0].cast("int")) >= 2)


def is_multi_part(query: Column) -> Column:
    """FLT-12: a comparison, a list or a compound question."""
    q = F.lower(F.trim(F.coalesce(query, F.lit(""))))
    return (q != "") & (q.rlike(r"\b(vs|versus|compared to|difference between)\b") | q.rlike(r"\b(and also|or also|plus)\b") | q.contains(":") | (F.regexp_count(q, F.lit(r"\b(and|or)\b")) >= 2))


def ttl_hours(url: Column, category: Column | None = None) -> Column:
    """SCA-34: six hours for news and news-like paths, else seven days."""
    hit = F.lower(F.coalesce(url, F.lit(""))).rlike(r"/20\d{2}/\d{2}/\d{2}/|/(article|news|blog|story|post|updates)/")
    return F.when((category == "news") | hit if category is not None else hit, 6).otherwise(168)


def recency(url: Column) -> Column:
    """SCA-28: the first year from 1900 to 2099 in the url, or ''."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"\b((19|20)\d{2})\b", 1)


def reliability(url: Column) -> Column:
    """SCA-28: high, low or medium by host."""
    host = F.lower(F.split_part(_re(F.coalesce(url, F.lit("")), r"(?i)^https?://", ""), F.lit("/"), F.lit(1)))
    high = host.rlike(r"(\.gov|\.edu|\.mil)$") | host.rlike(r"arxiv\.|acm\.org|ieee\.|nature\.com|science\.org")
    return F.when(high, "high").when(host.rlike(r"wikipedia|medium|wordpress|blogspot|reddit|quora|stackoverflow|github|substack|forum"), "low").otherwise("medium")


def estimate_tokens(text: Column) -> Column:
    """SCA-49: a token for every four characters begun."""
    return F.ceil(F.length(F.coalesce(text, F.lit(""))) / 4).cast("long")


def estimate_tokens_mixed(text: Column) -> Column:
    """SCA-49: four characters a token, two and a half where brackets, semicolons and colons are more than a twentieth."""
    n = F.length(F.coalesce(text, F.lit("")))
    dense = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[{}\[\];:]")) / F.greatest(n, F.lit(1)) > 0.05
    return F.ceil(n / F.when(dense, 2.5).otherwise(4.0)).cast("long")


def fences(text: Column) -> Column:
    """WIN-12: lines, fence lines and lines within fences, by a fold over the lines of one text."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    start = F.struct(F.lit(0).alias("fences"), F.lit(0).alias("fenced"))

    def step(a: Column, line: Column) -> Column:
        fence = line.rlike(r"^\s*```")
        inside = (a["fences"] % 2 == 1) & ~fence
        return F.struct((a["fences"] + fence.cast("int")).alias("fences"), (a["fenced"] + inside.cast("int")).alias("fenced"))

    return F.aggregate(lines, start, step, lambda a: F.struct(F.size(lines).alias("lines"), a["fences"].alias("fences"), a["fenced"].alias("fenced")))


def code_heaviness(text: Column) -> Column:
    """SCA-21: code_heavy, fence_blocks, fenced_ratio and the densities per thousand characters."""
    t = F.coalesce(text, F.lit(""))
    n, f = F.greatest(F.length(t), F.lit(1)), fences(text)
    blocks, ratio = F.floor(f["fences"] / 2).cast("int"), f["fenced"] / F.greatest(f["lines"], F.lit(1))
    kw, sym = F.regexp_count(t, F.lit(KEYWORDS)) * 1000 / n, F.regexp_count(t, F.lit(SYMBOLS)) * 1000 / n
    long = F.length(t) >= 400
    heavy = (blocks >= 2) | ((ratio >= 0.3) & (f["fenced"] >= 5)) | (long & (kw >= 4) & (sym >= 20)) | (long & (sym >= 45))
    return F.struct(heavy.alias("code_heavy"), blocks.alias("fence_blocks"), ratio.alias("fenced_ratio"), kw.alias("keyword_density"), sym.alias("symbol_density"))


def numbers(claim: Column) -> Column:
    """TAB-13: positive numbers in a claim; their units are not read."""
    found = F.regexp_extract_all(F.coalesce(claim, F.lit("")), F.lit(r"\b\d+(?:\.\d+)?"), 0)
    return F.filter(F.transform(found, lambda x: x.cast("double")), lambda x: x > 0)
