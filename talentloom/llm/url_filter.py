"""URL rules by a sort-merge range join over reversed-host keys.

A rule's host, its labels reversed and closed by a dot (``org.example.``), is a prefix of the keys
of that host and all its subdomains, so it covers one interval of keys. Pages are sorted by key;
a sweep walks pages and rules side by side and keeps a stack of the rules whose intervals are
open, nested hosts above the hosts that hold them. Of the open rules whose path starts the page's
path, the longest wins.

Rules within ``most_rules`` go to each task whole; a longer list is swept in blocks of that size
and the longest match of all blocks wins. Pages are dealt by ranges of (host key, path, id), so a
hot host is spread over tasks.

A url that is null or has no ``://`` has empty host and path; no rule fits an empty host. Pages
that no rule fits get ``default``. Equal rules: the first listed wins. Repeated pages are repeated
rows. Urls are read whole, however long. An empty table gives an empty result. Extra columns are left out.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentloom.llm.common import field_sql


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def key(self) -> str:
        return ".".join(reversed(self.host.split("."))) + "."


#: The rules of the contract.
RULES = (Rule("allow", "org"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"))


def url_host(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


class Sweep:
    """Walks keys in ascending order; ``best`` gives the longest open rule that fits a path.

    One stack entry is one host: its key and its rules by path. A path is looked up once for each length
    that the host's rules have, longest first, however many rules there are.
    """

    def __init__(self, rules: list[Rule]):
        hosts: dict[str, dict[str, Rule]] = {}
        for r in rules:
            hosts.setdefault(r.key, {}).setdefault(r.path, r)
        self.keys = sorted(hosts)
        self.rules = [hosts[k] for k in self.keys]
        self.lengths = [sorted({len(p) for p in own}, reverse=True) for own in self.rules]
        self.stack: list[int] = []
        self.next = 0
        self.key: str | None = None

    def move(self, key: str) -> None:
        if self.key is None:
            # rules that begin before this task's first key and still cover it
            self.next = bisect_right(self.keys, key)
            at = {k: i for i, k in enumerate(self.keys)}
            self.stack = [at[key[: i + 1]] for i, c in enumerate(key) if c == "." and key[: i + 1] in at]
        else:
            while self.next < len(self.keys) and self.keys[self.next] <= key:
                new = self.keys[self.next]
                while self.stack and not new.startswith(self.keys[self.stack[-1]]):
                    self.stack.pop()
                self.stack.append(self.next)
                self.next += 1
            while self.stack and not key.startswith(self.keys[self.stack[-1]]):
                self.stack.pop()
        self.key = key

    def best(self, key: str, path: str) -> Rule | None:
        if key != self.key:
            self.move(key)
        found = None
        for i in reversed(self.stack):
            r = next((r for n in self.lengths[i] if n <= len(path) and (r := self.rules[i].get(path[:n]))), None)
            if r and (found is None or len(r.name) > len(found.name)):
                found = r
        return found


def judge_pages(pages: DataFrame, rules: tuple[Rule, ...] | list[Rule] = RULES, default: str = "allow", most_rules: int = 200_000) -> DataFrame:
    """page_id, host, path, rule, verdict."""
    url = F.col("url")
    host = url_host(url)
    keyed = pages.select("page_id", host.alias("host"), url_path(url).alias("path"))
    keyed = keyed.withColumn("key", F.when(F.col("host") == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split("host", r"\.")), "."), F.lit("."))))
    # utf8 order of keys is code point order, as in Python
    swept = keyed.repartitionByRange("key", "path", "page_id").sortWithinPartitions("key", "path", "page_id")
    for i in range(0, max(1, len(rules)), most_rules):
        swept = _sweep(swept, list(rules[i : i + most_rules]), first=i == 0)
    return swept.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def _sweep(keyed: DataFrame, rules: list[Rule], first: bool) -> DataFrame:
    """Adds the best of ``rules``, or puts it in place of a shorter one of an earlier block."""
    held = keyed.sparkSession.sparkContext.broadcast(rules)

    def run(batches):
        sweep = Sweep(held.value)
        for batch in batches:
            own = [sweep.best(k, p) for k, p in zip(batch.column("key").to_pylist(), batch.column("path").to_pylist(), strict=True)]
            rule, verdict = [r and r.name for r in own], [r and r.verdict for r in own]
            if not first:
                for i, (a, b) in enumerate(zip(batch.column("rule").to_pylist(), batch.column("verdict").to_pylist(), strict=True)):
                    if a is not None and (rule[i] is None or len(a) >= len(rule[i])):
                        rule[i], verdict[i] = a, b
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "host", "path", "key")), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], ["page_id", "host", "path", "key", "rule", "verdict"])

    return keyed.mapInArrow(run, f"{field_sql(keyed, 'page_id')}, host string, path string, key string, rule string, verdict string")


#: The same judgement in SQL.
SQL = """
WITH parts AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
rules(verdict, rhost, rpath) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
judged AS (
  SELECT page_id, host, path, rhost || rpath AS rule, verdict,
         row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rhost || rpath) DESC) AS place
  FROM parts LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM judged WHERE place = 1
"""
