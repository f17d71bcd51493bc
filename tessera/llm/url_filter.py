"""URL filter: a trie over reversed host labels and path segments, broadcast to the executors.

Every rule names a host and a path prefix. It fits its host and all its subdomains when the URL's
path starts with the rule's path. Of the rules that fit, the longest (host and path together) wins;
of two equally long ones a block entry wins over an allow entry.

A trie of at most ``TRIE_RULES`` rules is broadcast. Longer lists are cut into several tries; every URL
goes past each of them, one after the other, and keeps the best rule so far, so the result is the same.

Cost: a URL's segments are looked up while rules still follow, and within a segment only the lengths that
rules' last parts have there; so the work on a URL is linear in its length, whatever the segments' length.

Defined results: a null URL, or one without ``://``, has an empty host and path and fits no rule;
a URL that no rule fits gets the filter's default verdict. Rows that repeat are judged each. Of rules of
the same text and verdict one is kept; of equal texts with both verdicts the block entry wins.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import Scratch, table

ALLOW, BLOCK = "allow", "block"
#: Rules in one broadcast trie (about half a kilobyte each).
TRIE_RULES = 200_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def parse_rule(verdict: str, text: str) -> Rule:
    """``parse_rule("block", "example.org/es/")``: up to the first slash is the host."""
    host, _, path = text.partition("/")
    return Rule(verdict, host.translate(str.maketrans(_UPPER, _LOWER)), "/" + path)


class UrlTrie:
    """Host labels from the last to the first, then path segments; a rule hangs where its whole
    segments end, under the prefix of the next segment that it still asks for."""

    def __init__(self, rules: Iterable[Rule]):
        self.root: dict = {}
        for rule in rules:
            node = self.root
            for label in reversed(rule.host.split(".")):
                node = node.setdefault("hosts", {}).setdefault(label, {})
            *whole, prefix = rule.path.split("/")[1:]
            node = node.setdefault("paths", {})
            for segment in whole:
                node = node.setdefault("next", {}).setdefault(segment, {})
            ends = node.setdefault("ends", {})
            held = ends.get(prefix)
            sizes = node.setdefault("sizes", [])
            if len(prefix) not in sizes:
                bisect.insort(sizes, len(prefix))
            if held is None or rule.verdict == BLOCK:
                ends[prefix] = (rule.text, rule.verdict)

    @staticmethod
    def better(best, found):
        if best is None or (len(found[0]), found[1] == BLOCK) > (len(best[0]), best[1] == BLOCK):
            return found
        return best

    def find(self, host: str, path: str):
        """The winning (rule text, verdict), or None."""
        if not host or not path.startswith("/"):
            return None
        best, node, segments = None, self.root, path.split("/")[1:]
        for label in reversed(host.split(".")):
            node = node.get("hosts", {}).get(label)
            if node is None:
                break
            at = node.get("paths")
            for k, segment in enumerate(segments):
                if at is None:
                    break
                ends = at.get("ends")
                if ends:
                    for size in at["sizes"]:
                        if size > len(segment):
                            break
                        found = ends.get(segment[:size])
                        if found:
                            best = self.better(best, found)
                # a whole segment of a rule ends with a slash, so the URL needs one more part
                at = at.get("next", {}).get(segment) if k + 1 < len(segments) else None
        return best


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def filter_urls(
    df: DataFrame, rules: list[Rule], *, url: str = "url", keep: Iterable[str] = (), default: str = ALLOW
) -> DataFrame:
    """One row per row of ``df``: the kept columns, host, path, rule and verdict.

    Only the kept columns and the URL are read; other columns, whatever their names, stay unread.
    """
    keep = list(keep)
    rules, spark = list(rules), df.sparkSession
    out = df.select(
        *[df[c] for c in keep], host_of(df[url]).alias("host"), path_of(df[url]).alias("path"),
        F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"),
    )
    scratch = Scratch(spark, "urls") if len(rules) > TRIE_RULES else None
    for at in range(0, len(rules), TRIE_RULES):
        if at:  # what a trie before has found is written, so no more than one is held at a time
            out = scratch.write(out)
        out = _past(out, spark.sparkContext.broadcast(UrlTrie(rules[at : at + TRIE_RULES])), len(keep))
    return out


def _past(urls: DataFrame, trie, n: int) -> DataFrame:
    """The rows (n kept columns, host, path, rule, verdict) with the better of their rule and the trie's."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, better = trie.value.find, trie.value.better
        for batch in batches:
            rules, verdicts = [], []
            for host, path, rule, verdict in zip(*(batch.column(n + i).to_pylist() for i in range(4)), strict=True):
                found = find(host, path)
                if found and rule is not None:
                    found = better((rule, verdict), found)
                rules.append(found[0] if found else rule)
                verdicts.append(found[1] if found else verdict)
            more = [pa.array(rules, pa.string()), pa.array(verdicts, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: n + 2], *more], names=batch.schema.names)

    return urls.mapInArrow(judge, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in urls.schema.fields))


#: The entries the contract of this query names.
RULES = [
    parse_rule(ALLOW, "org/"),
    parse_rule(BLOCK, "example.org/es/"),
    parse_rule(BLOCK, "example.org/en/1"),
    parse_rule(ALLOW, "com/fr/"),
    parse_rule(BLOCK, "com/de/"),
]


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), RULES, keep=["page_id"])


OP5_SQL = f"""
WITH u AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
r(rule, host_part, path_part, verdict) AS (VALUES
  ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'),
  ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'),
  ('com/de/', 'com', '/de/', 'block')),
j AS (
  SELECT page_id, host, path,
         (SELECT max_by(struct_pack(rule := r.rule, verdict := r.verdict), length(r.rule)) FROM r
          WHERE (host = host_part OR ends_with(host, '.' || host_part)) AND starts_with(path, path_part)) AS best
  FROM u)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM j
"""
