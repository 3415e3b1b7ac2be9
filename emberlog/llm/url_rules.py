"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a pattern over host and path: `||` anchors at the host or a subdomain, `|` at an end,
`*` is anything, `^` a separator or the end; `@@` in front makes an exception. Tokens are runs of
a-z and 0-9. Those that a pattern bounds on both sides must stand in every URL that it matches,
so the rule is filed under one of them: the one that fewest URLs hold (counted over all URLs; only
tokens of rules are counted). A URL's tokens fetch the rules filed under them, and only these run
their regular expression. Rules without such a token are run always.

Site rules (action, host, path) are patterns too; the longest that fits decides. If none fits,
the filter's patterns do: an exception allows, else a match blocks, else the URL is allowed.

Edge cases: a null URL, or one without ://, has empty host and path, fits no site rule and is
judged by the patterns on the empty string. Repeated rows stay; extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import map_rows

SITES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
PATTERNS = (
    "||spam-farm.*^",
    "||cheap-pills.*^",
    "||casino.*^",
    "||free-money.*^",
    "||adserver.*^",
    "/ads/banner^",
    "/affiliate/*/click^",
    "/porn/",
    "@@||spam-farm.example.edu^",
)
MAX_RULES = 1_000_000
_TOKEN = re.compile(r"[a-z0-9]+")
_URL = re.compile(r"://([^/?#]*)([^?#]*)", re.S)
_UPPER = {i: i + 32 for i in range(65, 91)}


@dataclass(frozen=True)
class Rule:
    name: str
    action: str
    pattern: str
    tokens: tuple[str, ...]
    site: bool


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): A-Z of the host lower-cased; both empty without a ://."""
    found = _URL.search(url or "")
    return (found[1].translate(_UPPER), found[2]) if found else ("", "")


def site_rule(action: str, host: str, path: str) -> Rule:
    """Fits the host and its subdomains, where the path begins with the rule's."""
    tokens = tuple(_TOKEN.findall(host)) + tuple(m[0] for m in _TOKEN.finditer(path) if m.end() < len(path) and _bare(path[m.start() - 1 : m.start()]) and _bare(path[m.end()]))
    return Rule(host + path, action, rf"(?s)\A(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}", tokens, True)


def _bare(c: str) -> bool:
    return not c or not re.match("[a-z0-9A-Z]", c)


def pattern_rule(text: str) -> Rule:
    action, body = ("allow", text[2:]) if text.startswith("@@") else ("block", text)
    head, body = (2, body[2:]) if body.startswith("||") else (1, body[1:]) if body.startswith("|") else (0, body)
    tail, body = (True, body[:-1]) if body.endswith("|") else (False, body)
    parts = {"*": ".*", "^": r"(?:[^A-Za-z0-9_.%-]|\Z)"}
    start = (r"", r"\A", r"\A(?:[^/]*\.)?")[head]
    made = start + "".join(parts.get(c, re.escape(c)) for c in body) + (r"\Z" if tail else "")
    tokens = []
    for m in _TOKEN.finditer(body):
        left = m.start() > 0 and body[m.start() - 1] != "*" and _bare(body[m.start() - 1]) or m.start() == 0 and head
        right = m.end() < len(body) and body[m.end()] != "*" and _bare(body[m.end()]) or m.end() == len(body) and tail
        if left and right:
            tokens.append(m[0])
    return Rule(text, action, f"(?s){made}", tuple(tokens), False)


class Index:
    """Rules filed under their rarest token, with their expressions compiled once per worker."""

    def __init__(self, rules: list[Rule], counts: dict[str, int]):
        self.rules = rules
        self.filed: dict[str, list[int]] = {}
        self.always: list[int] = []
        for k, rule in enumerate(rules):
            if rule.tokens:
                self.filed.setdefault(min(rule.tokens, key=lambda t: (counts.get(t, 0), t)), []).append(k)
            else:
                self.always.append(k)
        self.compiled: dict[int, re.Pattern] = {}

    def __getstate__(self):
        return self.__dict__ | {"compiled": {}}

    def candidates(self, text: str) -> list[int]:
        found = [k for t in set(_TOKEN.findall(text.translate(_UPPER))) for k in self.filed.get(t, ())]
        return found + self.always

    def fits(self, k: int, text: str) -> bool:
        if (expression := self.compiled.get(k)) is None:
            expression = self.compiled[k] = re.compile(self.rules[k].pattern)
        return expression.search(text) is not None

    def judge(self, host: str, path: str) -> tuple[str | None, str, int]:
        """(site rule or None, verdict, how many expressions were run)."""
        text = host + path
        tried = self.candidates(text)
        fit = [self.rules[k] for k in tried if self.fits(k, text)]
        if sites := [r for r in fit if r.site and host]:
            best = max(sites, key=lambda r: (len(r.name), r.name))
            return best.name, best.action, len(tried)
        actions = {r.action for r in fit if not r.site}
        return None, "block" if actions == {"block"} else "allow", len(tried)


def token_counts(pages: DataFrame, tokens: set[str], url_col: str = "url") -> dict[str, int]:
    """How many URLs hold each token of the rules: at most one row for each of them."""
    held = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.col(f"`{url_col}`"), F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)))
    wanted = F.array_intersect(held, F.lit(sorted(tokens)) if tokens else F.array().cast("array<string>"))
    rows = pages.select(F.explode(wanted).alias("t")).groupBy("t").count().collect()
    return {r["t"]: r["count"] for r in rows}


def judge_urls(pages: DataFrame, sites=SITES, patterns=PATTERNS, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row: page_id, host, path, rule, verdict and n_tried (expressions that were run)."""
    rules = [site_rule(*s) for s in sites] + [pattern_rule(p) for p in patterns]
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; the index is shipped to every executor and holds {MAX_RULES} at most")
    counts = token_counts(pages, {t for r in rules for t in r.tokens}, url_col)
    shipped = pages.sparkSession.sparkContext.broadcast(Index(rules, counts))

    def rows(batches):
        index = shipped.value
        for batch in batches:
            parts = [split_url(u) for u in batch.column(1).to_pylist()]
            told = [index.judge(*p) for p in parts]
            columns = [[p[0] for p in parts], [p[1] for p in parts], [t[0] for t in told], [t[1] for t in told]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string()) for c in columns), pa.array([t[2] for t in told], pa.int64())], ["page_id", "host", "path", "rule", "verdict", "n_tried"])

    kind = pages.schema[id_col].dataType.simpleString()
    source = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"))
    return map_rows(source, rows, f"page_id {kind}, host string, path string, rule string, verdict string, n_tried long")


def report(pages: DataFrame) -> DataFrame:
    return judge_urls(pages).select("page_id", "host", "path", "rule", "verdict")


ORACLE_SQL = r"""
WITH cut AS (
  SELECT page_id, 

         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
site AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM cut)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN regexp_matches(host || path, '(?s)^([^/]*\.)?spam-farm\.example\.edu([^A-Za-z0-9_.%-]|$)') THEN 'allow'
    WHEN regexp_matches(host || path, '(?s)^([^/]*\.)?(spam-farm|cheap-pills|casino|free-money|adserver)\..*([^A-Za-z0-9_.%-]|$)')
      OR regexp_matches(host || path, '(?s)/ads/banner([^A-Za-z0-9_.%-]|$)|/affiliate/.*/click([^A-Za-z0-9_.%-]|$)|/porn/') THEN 'block'
    ELSE 'allow' END AS verdict
FROM site
"""
