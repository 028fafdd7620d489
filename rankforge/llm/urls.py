"""URL filter rules, indexed by their rarest literal token.

A rule is a host and path prefix (``example.net/en/``: that host and its subdomains) or a pattern with ``*`` over
host and path. Its literal tokens are the alphanumeric runs that it holds whole; the index keeps each rule under the
one that the fewest URLs have, counted over the whole table. A URL's tokens fetch candidate rules, and only those run
their regular expressions; rules without a whole token are few and always run. The longest host rule decides, else
any blocking pattern. Null urls and those without ``://`` have an empty host and path and are allowed. Repeated rows
and those without an id are judged each; very long urls are matched whole; an empty table gives an empty result;
further columns are not read, whatever their names.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

TOKEN = re.compile(r"[0-9a-z]+")


@dataclass(frozen=True)
class Rule:
    text: str
    verdict: str
    host: bool = True

    def regex(self) -> str:
        """Over the lower-cased host and the path."""
        if self.host:
            return r"^([^/]*\.)?" + re.escape(self.text)
        return ".*".join(map(re.escape, self.text.split("*")))

    def tokens(self) -> list[str]:
        """Runs that stand whole in any URL that the rule fits."""
        ends = self.text.lower()
        out = []
        for m in TOKEN.finditer(ends):
            left = ends[m.start() - 1] if m.start() else "." if self.host else "*"
            right = ends[m.end()] if m.end() < len(ends) else "*"
            if left != "*" and right != "*":
                out.append(m[0])
        return out


RULES = (Rule("net/", "block"), Rule("example.net/en/", "allow"), Rule("example.com/de/", "block"), Rule("org/fr/", "allow"))
PATTERNS = (Rule("/spam-farm.", "block", False), Rule("spam-farm.", "block"), Rule("/casino/", "block", False), Rule("/login*redirect", "block", False), Rule("click-bait.example.org/", "block"))


def split(url: str):
    """Host and path of a url column; both empty where it is null or has no '://'."""
    u = F.col(url)
    rest = F.when(F.instr(u, "://") > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    host = F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rules_of(table: DataFrame, most_rules: int = 1_000_000) -> tuple[tuple[Rule, ...], tuple[Rule, ...]]:
    """Host rules and patterns from a table (text, verdict, host boolean), counted before they are fetched."""
    rows = table.where("text is not null and verdict in ('allow', 'block')").select("text", "verdict", F.coalesce("host", F.lit(True)).alias("host")).distinct()
    if rows.count() > most_rules:
        raise ValueError("more rules than a worker should hold: judge them in parts")
    every = [Rule(*r) for r in rows.orderBy("text", "verdict", "host").collect()]
    return tuple(r for r in every if r.host), tuple(r for r in every if not r.host)


def token_counts(parsed: DataFrame, wanted: list[str]) -> dict[str, int]:
    """How many URLs hold each of the rules' tokens: a join with the tokens, and one row a token that comes back."""
    spark = parsed.sparkSession
    mine = spark.createDataFrame([(t,) for t in wanted], "token string")
    tokens = F.array_distinct(F.regexp_extract_all(F.lower(F.concat("host", "path")), F.lit("([0-9a-z]+)")))
    rows = parsed.select(F.explode(tokens).alias("token"))
    rows = rows.join(F.broadcast(mine) if len(wanted) <= 100_000 else mine, "token", "left_semi")
    return {r["token"]: r["n"] for r in rows.groupBy("token").agg(F.count("*").alias("n")).collect()}


def index(rules: tuple[Rule, ...], counts: dict[str, int]) -> tuple[dict[str, list[int]], list[int]]:
    by_token, always = defaultdict(list), []
    for i, rule in enumerate(rules):
        if tokens := rule.tokens():
            by_token[min(tokens, key=lambda t: (counts.get(t, 0), t))].append(i)
        else:
            always.append(i)
    return dict(by_token), always


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, patterns: tuple[Rule, ...] = PATTERNS, *, page_id: str = "page_id", url: str = "url", most_rules: int = 1_000_000) -> DataFrame:
    """page_id, host, path, rule, verdict, and how many candidate rules ran."""
    every = (*rules, *patterns)
    if len(every) > most_rules:
        raise ValueError("more rules than a worker should hold: judge them in parts")
    host, path = split(url)
    parsed = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    wanted = sorted({t for r in every for t in r.tokens()})
    by_token, always = index(every, token_counts(parsed, wanted) if wanted else {})
    decisive = len(rules)
    shared = pages.sparkSession.sparkContext.broadcast((every, by_token, always))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, by_token, always = shared.value
        compiled: dict[int, re.Pattern] = {}

        def fits(i: int, where: str) -> bool:
            if i not in compiled:
                compiled[i] = re.compile(every[i].regex(), re.S)
            return compiled[i].search(where) is not None

        for b in batches:
            rules, verdicts, candidates = [], [], []
            for h, p in zip(b.column("host").to_pylist(), b.column("path").to_pylist(), strict=True):
                where = h + p
                near = {i for t in set(TOKEN.findall(where.lower())) for i in by_token.get(t, ())}.union(always)
                good = [i for i in near if fits(i, where)]
                best = max((i for i in good if i < decisive), key=lambda i: (len(every[i].text), every[i].verdict, -i), default=None)
                rules.append(every[best].text if best is not None else None)
                verdicts.append(every[best].verdict if best is not None else "block" if any(every[i].verdict == "block" for i in good) else "allow")
                candidates.append(len(near))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("host"), b.column("path"), pa.array(rules, pa.string()), pa.array(verdicts, pa.string()), pa.array(candidates, pa.int32())], ["page_id", "host", "path", "rule", "verdict", "candidates"])

    return parsed.mapInArrow(work, f"page_id {dict(parsed.dtypes)['page_id']}, host string, path string, rule string, verdict string, candidates int")


#: The four rules of the contract and the patterns, each written out; no index and no code of the operator's.
SQL = r"""
WITH a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
c AS (SELECT page_id, host, path, CASE
        WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
        WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
        WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
        WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM b)
SELECT page_id, host, path, rule, CASE
        WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow'
        WHEN rule IN ('net/', 'example.com/de/') THEN 'block'
        WHEN contains(host || path, '/spam-farm.') OR contains(host || path, '/casino/') THEN 'block'
        WHEN starts_with(host, 'spam-farm.') OR contains(host, '.spam-farm.') THEN 'block'
        WHEN (host = 'click-bait.example.org' OR ends_with(host, '.click-bait.example.org')) AND path <> '' THEN 'block'
        WHEN strpos(host || path, '/login') > 0 AND contains(substr(host || path, strpos(host || path, '/login') + 6), 'redirect') THEN 'block'
        ELSE 'allow' END AS verdict FROM c"""
