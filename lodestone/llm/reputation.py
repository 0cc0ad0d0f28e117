"""URL filtering by host reputation: fixed rules first, then an empirical-Bayes bound on a host's bad rate.

Labelled page outcomes (bad or not) are counted by host. Beta-binomial priors shrink them from the top down: all pages
give the prior of a public suffix, a suffix's posterior mean the prior of a registered domain, a domain's the prior of a
host. Each level's strength is the method-of-moments estimate of how much its units differ beyond binomial noise. A host
is blocked where the lower posterior bound of its bad rate (normal approximation of the beta posterior, `Z` standard
deviations below its mean) is above `LIMIT`; a host that nobody labelled has its domain's, suffix's or overall prior.

Defined results: a null url or one without `://` has an empty host and path, fits no rule and gets the verdict of the
overall prior; an unlabelled table allows what no rule blocks; pages that share a url are each judged and each outcome
counts; other columns are never read; empty tables give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import cut

#: Verdict, host and path of each rule.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Suffixes of two labels under which names are registered; elsewhere the last label is the suffix.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "gov.uk", "net.au", "org.au", "org.uk")
Z, LIMIT, LEAST, MOST = 1.2816, 0.25, 2.0, 1000.0


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    return F.when(F.substring_index(host, ".", -2).isin(*TWO_LABEL_SUFFIXES), F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def by_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, like `net/`, and its verdict; null where none does."""
    rule = verdict = F.lit(None).cast("string")
    for said, own, start in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        rule, verdict = F.when(fits, own + start).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


@dataclass
class Strength:
    mean: float
    suffix: float
    domain: float
    host: float


def _kappa(n: float, square: float, spread: float, units: int, mean: float) -> float:
    """The strength of a beta prior: n labels over units, the sum of n squared, and the weighted spread of the units' rates."""
    noise = mean * (1 - mean)
    between = (spread - (units - 1) * noise) / (n - square / n) if n and n - square / n > 0 else 0.0
    return MOST if between <= 0 or noise <= 0 else min(MOST, max(LEAST, noise / between - 1))


def strengths(outcomes: DataFrame) -> Strength:
    """The overall bad rate and the strength of each level's prior, from `outcomes(host, n, bad)`: a few sums."""
    total = outcomes.agg(F.sum("n"), F.sum("bad")).first()
    n, mean = total[0] or 0, (total[1] or 0) / total[0] if total[0] else 0.0
    levels = {"suffix": suffix_of(F.col("host")), "domain": domain_of(F.col("host")), "host": F.col("host")}
    found = {}
    for level, unit in levels.items():
        per = outcomes.groupBy(unit.alias("unit")).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
        s = per.agg(F.sum(F.col("n") * F.col("n")), F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - mean, 2)), F.count("*")).first()
        found[level] = _kappa(n, s[0] or 0, s[1] or 0.0, s[2], mean)
    return Strength(mean, **found)


def _shrunk(n: Column, bad: Column, prior: Column, kappa: float) -> Column:
    return (bad + prior * kappa) / (n + F.lit(kappa))


def _bound(n: Column, bad: Column, prior: Column, kappa: float) -> Column:
    m = _shrunk(n, bad, prior, kappa)
    return m - Z * F.sqrt(m * (1 - m) / (n + F.lit(kappa + 1)))


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, limit: float = LIMIT) -> DataFrame:
    """page_id, host, path, rule, verdict, labelled and bad (the host's labels) and bound of every row of `pages(page_id, url)`.

    outcomes: (host, bad 0/1), a row for each labelled page.
    """
    counts = cut(outcomes.where("bad is not null").groupBy("host").agg(F.count("*").alias("n"), F.sum("bad").alias("bad")))
    s = strengths(counts)
    sums = (F.sum("n"), F.sum("bad"))
    suffix = counts.groupBy(suffix_of(F.col("host")).alias("suffix")).agg(sums[0].alias("sn"), sums[1].alias("sb"))
    domain = counts.groupBy(domain_of(F.col("host")).alias("domain")).agg(sums[0].alias("dn"), sums[1].alias("db"))
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    hosts = parsed.select("host").distinct().select("host", suffix_of(F.col("host")).alias("suffix"), domain_of(F.col("host")).alias("domain"))
    known = hosts.join(suffix, "suffix", "left").join(domain, "domain", "left").join(counts, "host", "left").fillna(0, ["sn", "sb", "dn", "db", "n", "bad"])
    # a level's prior is of what lies beside the unit, so no label counts twice
    of_suffix = _shrunk(F.col("sn") - F.col("dn"), F.col("sb") - F.col("db"), F.lit(s.mean), s.suffix)
    of_domain = _shrunk(F.col("dn") - F.col("n"), F.col("db") - F.col("bad"), of_suffix, s.domain)
    judged = known.select(F.col("host").alias("h"), "n", F.col("bad").alias("b"), _bound(F.col("n"), F.col("bad"), of_domain, s.host).alias("bound"))
    rule, verdict = by_rule(F.col("host"), F.col("path"), rules)
    return parsed.join(judged, F.col("host") == F.col("h")).select(
        "page_id", "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("bound") > limit, "block").otherwise("allow")).alias("verdict"),
        F.col("n").cast("long").alias("labelled"), F.col("b").cast("long").alias("bad"), F.round("bound", 6).alias("bound"),
    )


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, bad): pages whose url's first number names a labelled document; bad where that document is toxic."""
    number = F.regexp_extract(path_of(F.col("url")), r"/([0-9]{1,18})(?![0-9])", 1)
    numbered = pages.select(host_of(F.col("url")).alias("host"), F.when(number != "", number.cast("long")).alias("doc")).where("doc is not null")
    toxic = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("bad"))
    return numbered.join(toxic, F.col("doc") == F.col("doc_id")).select("host", "bad")


def _level(unit: str) -> str:
    """SQL for the prior strength of a level whose unit is the given expression, as `_kappa`."""
    noise = "mu * (1 - mu)"
    return f"""(SELECT CASE WHEN coalesce((spread - (units - 1) * {noise}) / nullif(n - square / n, 0), 0) <= 0 OR {noise} <= 0 THEN {MOST}
      ELSE least({MOST}, greatest({LEAST}, {noise} / ((spread - (units - 1) * {noise}) / (n - square / n)) - 1)) END
    FROM (SELECT sum(n)::DOUBLE AS n, sum(n * n)::DOUBLE AS square, sum(n * pow(bad / n - mu, 2)) AS spread, count(*) AS units, any_value(mu) AS mu
      FROM (SELECT {unit} AS unit, sum(n)::DOUBLE AS n, sum(bad)::DOUBLE AS bad, any_value(mu) AS mu FROM c, g GROUP BY 1)))"""


def _sql() -> str:
    two, one = "array_to_string(string_split(host, '.')[-2:], '.')", "array_to_string(string_split(host, '.')[-1:], '.')"
    known = ", ".join(f"'{x}'" for x in TWO_LABEL_SUFFIXES)
    suffix = f"(CASE WHEN {two} IN ({known}) THEN {two} ELSE {one} END)"
    domain = f"(CASE WHEN {two} IN ({known}) THEN array_to_string(string_split(host, '.')[-3:], '.') ELSE {two} END)"
    by = sorted(RULES, key=lambda r: -len(r[1]) - len(r[2]))
    case = lambda said: "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{x}') THEN '{said(v, h + x)}'" for v, h, x in by) + " END"
    letters = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    return f"""
WITH p AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)://([^/?#]*)', 1), {letters}), '') AS host, coalesce(regexp_extract(url, '(?s)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
), c AS (
  SELECT host, count(*) AS n, sum(bad)::BIGINT AS bad
  FROM (SELECT host, try_cast(nullif(regexp_extract(path, '/([0-9]{{1,18}})([^0-9]|$)', 1), '') AS BIGINT) AS doc FROM p)
  JOIN (SELECT doc_id, max(toxic) AS bad FROM labels WHERE doc_id IS NOT NULL AND toxic IS NOT NULL GROUP BY doc_id) ON doc = doc_id GROUP BY host
), g AS (
  SELECT coalesce(sum(bad)::DOUBLE / nullif(sum(n), 0), 0) AS mu FROM c
), k AS (
  SELECT (SELECT mu FROM g) AS mu, {_level(suffix)} AS ks, {_level(domain)} AS kd, {_level("host")} AS kh
), s AS (
  SELECT {suffix} AS suffix, sum(n) AS sn, sum(bad) AS sb FROM c GROUP BY 1
), d AS (
  SELECT {domain} AS domain, sum(n) AS dn, sum(bad) AS db FROM c GROUP BY 1
), t AS (
  SELECT u.host, coalesce(c.n, 0) AS n, coalesce(c.bad, 0) AS bad, coalesce(dn, 0) AS dn, coalesce(db, 0) AS db, coalesce(sn, 0) AS sn, coalesce(sb, 0) AS sb, mu, ks, kd, kh
  FROM (SELECT DISTINCT host, {suffix} AS suffix, {domain} AS domain FROM p) u CROSS JOIN k LEFT JOIN s USING (suffix) LEFT JOIN d USING (domain) LEFT JOIN c ON c.host = u.host
), h AS (
  SELECT host, n, bad, kh, (db - bad + kd * (sb - db + mu * ks) / (sn - dn + ks)) / (dn - n + kd) AS prior FROM t
), m AS (
  SELECT host, n, bad, kh, (bad + prior * kh) / (n + kh) AS mean FROM h
)
SELECT page_id, host, path, {case(lambda v, r: r)} AS rule,
  coalesce({case(lambda v, r: v)}, CASE WHEN mean - {Z} * sqrt(mean * (1 - mean) / (n + kh + 1)) > {LIMIT} THEN 'block' ELSE 'allow' END) AS verdict,
  CAST(n AS BIGINT) AS labelled, CAST(bad AS BIGINT) AS bad, round(mean - {Z} * sqrt(mean * (1 - mean) / (n + kh + 1)), 6) AS bound
FROM p JOIN m USING (host)
"""


SQL = _sql()
