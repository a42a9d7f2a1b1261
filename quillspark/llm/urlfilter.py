"""URL filters, in DataFrame functions only: host and path rules, then pattern rules found by their rarest literal token.

A pattern rule is written as in public filter lists: `||` stands for the start of a host or of one of its labels, a
leading or trailing `|` for the start or end of the URL, `*` for anything, `^` for a separator or the end; `@@` before
it makes it an exception, which beats any block. The literal tokens of a pattern ([a-z0-9] runs with a boundary on both
sides) must stand in every URL that it fits. Each rule is filed under the one of its tokens that is rarest in the
corpus; a URL's tokens fetch candidates, and only their regular expressions run. A rule without tokens always runs.
The index is a hash table in the plan, of the size of the rule set, so that a token costs the same at any number of rules.
"""

import json
import re
import zlib
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import row_of

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class HostRule(NamedTuple):
    host: str
    path: str
    verdict: str


#: Host and path rules of the registered query.
HOST_RULES = [
    HostRule("com", "/en/", "block"),
    HostRule("example.com", "/en/7", "allow"),
    HostRule("net", "/de/", "allow"),
    HostRule("example.net", "/de/8", "block"),
    HostRule("org", "/es/", "block"),
]
#: Pattern rules of the registered query.
PATTERN_RULES = [
    "||ads-track.",
    "||adult-",
    "||casino-",
    "||cheap-pills.",
    "||free-bets.",
    "||spam-farm.",
    "/wp-login.php",
    "^sessionid=",
    "/phishing/*.exe|",
    "@@||ads-track.*/privacy^",
]


def regex_of(pattern: str) -> str:
    """The regular expression, for Java and for RE2, that a lower-cased URL is searched with."""
    body = pattern.removeprefix("@@").lower()
    head = tail = ""
    if body.startswith("||"):
        head, body = r"^[a-z][a-z0-9+.\-]*://([^/?#]*\.)?", body[2:]
    elif body.startswith("|"):
        head, body = "^", body[1:]
    if body.endswith("|"):
        tail, body = r"\z", body[:-1]
    special = {"*": "(?s:.*)", "^": r"([^a-z0-9_.%\-]|\z)"}
    return head + "".join(special.get(c) or (c if c.isalnum() or ord(c) > 127 else f"[{c}]" if c not in "\\^]" else f"\\{c}") for c in body) + tail


def tokens_of(pattern: str) -> list[str]:
    """Tokens that any URL fitting the pattern holds whole."""
    body = pattern.removeprefix("@@").lower()
    at_start, at_end = body.startswith("|"), body.endswith("|")
    body = body.strip("|")
    found = []
    for m in re.finditer("[a-z0-9]+", body):
        before = at_start if m.start() == 0 else body[m.start() - 1] != "*"
        after = at_end if m.end() == len(body) else body[m.end()] != "*"
        if before and after:
            found.append(m[0])
    return sorted(set(found))


def lowered(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(lowered(host), F.lit("")), F.coalesce(path, F.lit(""))


def filed_under(entries: dict[str, list[dict]], shape: str) -> Callable[[Column], Column]:
    """A function from a key column to the array<struct<shape>> filed under the key; keys are spread over slots by CRC-32."""
    slots = 1 << max(0, len(entries) - 1).bit_length()
    table: list[list] = [[] for _ in range(slots)]
    for key, found in entries.items():
        table[zlib.crc32(key.encode()) % slots].append({"key": key, "found": found})
    index = F.from_json(F.lit(json.dumps(table)), f"array<array<struct<key:string,found:array<struct<{shape}>>>>>")

    def fetch(key: Column) -> Column:
        slot = F.get(index, (F.crc32(key.cast("binary")) % slots).cast("int"))
        return F.flatten(F.transform(F.filter(slot, lambda e: e["key"] == key), lambda e: e["found"]))

    return fetch


def host_rule(host: Column, path: Column, rules: list[HostRule]) -> Column:
    """The longest rule that fits the host or a domain above it and the start of the path, as struct(size, rule, verdict); null for none."""
    filed: dict[str, list] = {}
    for r in rules:
        filed.setdefault(r.host, []).append({"path": r.path, "rule": r.host + r.path, "size": len(r.host + r.path), "verdict": r.verdict})
    fetch = filed_under(filed, "path:string,rule:string,size:int,verdict:string")
    labels = F.size(F.split(host, r"\."))
    suffixes = F.transform(F.sequence(F.lit(1), labels), lambda i: F.call_function("substring_index", host, F.lit("."), -i))
    fits = F.filter(F.flatten(F.transform(suffixes, fetch)), lambda r: F.startswith(path, r["path"]))
    return F.array_max(F.transform(fits, lambda r: F.struct(r["size"].alias("size"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))


def url_tokens(url: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(lowered(F.coalesce(url, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1)))


def rarest_tokens(url_tokens_of: DataFrame, patterns: list[str]) -> dict[str, str]:
    """For each pattern with tokens, the one that the fewest rows of url_tokens_of(tokens) hold (ties: the longest, then the first)."""
    literal = sorted({t for p in patterns for t in tokens_of(p)})
    seen = url_tokens_of.select(F.explode("tokens").alias("token")).where(F.col("token").isin(literal))
    count = {r["token"]: r["n"] for r in seen.groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()} if literal else {}  # at most the rules' tokens
    return {p: min(ts, key=lambda t: (count.get(t, 0), -len(t), t)) for p in patterns if (ts := tokens_of(p))}


def pattern_rule(url: Column, tokens: Column, patterns: list[str], rarest: dict[str, str]) -> Column:
    """struct(blocks, pattern) of the rule that decides, null where none fits: the first exception, else the first block in order of text."""
    entry = lambda p: {"blocks": not p.startswith("@@"), "pattern": p, "regex": regex_of(p)}
    shape = "blocks:boolean,pattern:string,regex:string"
    filed: dict[str, list] = {}
    for p, t in rarest.items():
        filed.setdefault(t, []).append(entry(p))
    always = F.from_json(F.lit(json.dumps([entry(p) for p in patterns if p not in rarest])), f"array<struct<{shape}>>")
    fetched = F.flatten(F.transform(tokens, filed_under(filed, shape)))
    fits = F.filter(F.concat(always, fetched), lambda r: F.rlike(url, r["regex"]))
    return F.array_min(F.transform(fits, lambda r: F.struct(r["blocks"].alias("blocks"), r["pattern"].alias("pattern"))))


JUDGED = ("host", "path", "rule", "verdict", "pattern")


def judge_urls(pages: DataFrame, host_rules: list[HostRule] = HOST_RULES, patterns: list[str] = PATTERN_RULES, url_col: str = "url") -> DataFrame:
    """Adds host, path, rule, verdict and pattern, in place of columns of these names; all other columns stay, whatever they are called.

    A host rule decides before any pattern; where neither fits the verdict is allow. Null URLs and URLs without
    `://` have an empty host and path; patterns still run on the latter, empty URLs included. Repeated rows, and rows
    with null ids, are judged each; an empty table gives an empty one. Works alike at any number of rules.
    """
    patterns = sorted(set(patterns))
    url = F.col(f"`{url_col}`").cast("string")
    host, path = split_url(url)
    held = pages.select(row_of(pages, but=JUDGED).alias("row"), host.alias("host"), path.alias("path"), lowered(F.coalesce(url, F.lit(""))).alias("low"), url_tokens(url).alias("tokens"))
    rarest = rarest_tokens(held, patterns)
    by_host = held.withColumn("hit", host_rule(F.col("host"), F.col("path"), host_rules))
    both = by_host.withColumn("met", pattern_rule(F.col("low"), F.col("tokens"), patterns, rarest))
    by_pattern = F.when(F.coalesce(F.col("met.blocks"), F.lit(False)), F.lit("block")).otherwise(F.lit("allow"))
    others = [c for c in pages.columns if c.lower() not in JUDGED]
    judged = {"host": F.col("host"), "path": F.col("path"), "rule": F.col("hit.rule"), "verdict": F.coalesce(F.col("hit.verdict"), by_pattern), "pattern": F.col("met.pattern")}
    return both.select(*[F.col(f"row.`{c}`") for c in others], *[v.alias(n) for n, v in judged.items()])


def oracle(host_rules: list[HostRule] = HOST_RULES, patterns: list[str] = PATTERN_RULES) -> str:
    """The same judgement in SQL, every rule against every URL."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    ordered = sorted(host_rules, key=lambda r: (-len(r.host + r.path), r.host + r.path))
    fits = [f"(host = {quoted(r.host)} OR ends_with(host, {quoted('.' + r.host)})) AND starts_with(path, {quoted(r.path)})" for r in ordered]
    rule = "CASE " + " ".join(f"WHEN {f} THEN {quoted(r.host + r.path)}" for f, r in zip(fits, ordered, strict=True)) + " END"
    verdict = "CASE " + " ".join(f"WHEN {f} THEN {quoted(r.verdict)}" for f, r in zip(fits, ordered, strict=True)) + " END"
    found = sorted(patterns, key=lambda p: (not p.startswith("@@"), p))
    pattern = "CASE " + " ".join(f"WHEN regexp_matches(low, {quoted(regex_of(p))}) THEN {quoted(p)}" for p in found) + " END"
    return f"""
    WITH cut AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest,
                        translate(coalesce(url, ''), '{UPPER}', '{LOWER}') AS low FROM pages),
    parts AS (SELECT page_id, low, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
                     regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
    judged AS (SELECT page_id, host, path, {rule} AS rule, {verdict} AS by_host, {pattern} AS pattern FROM parts)
    SELECT page_id, host, path, rule,
           coalesce(by_host, CASE WHEN pattern IS NOT NULL AND NOT starts_with(pattern, '@@') THEN 'block' ELSE 'allow' END) AS verdict, pattern
    FROM judged"""
