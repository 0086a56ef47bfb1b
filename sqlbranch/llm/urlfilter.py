"""Allow and block lists over URLs: a trie of reversed host labels, then path segments; the longest entry that fits wins."""

from __future__ import annotations

import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import unused

#: Entries that may be broadcast, by their length in all; more need a narrower list.
MAX_RULE_BYTES = 64 << 20

_URL = re.compile(r"://([^/?#]*)([^?#]*)", re.S)
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: str | None) -> tuple[str, str]:
    """Host with A-Z lower-cased, and path; both empty without `://`."""
    found = _URL.search(url) if url else None
    return (found[1].translate(_LOWER), found[2]) if found else ("", "")


class RuleTrie:
    """Entries such as ("block", "example.net/en/"), of a host and the start of a path.

    A node holds its children by host label or, below the host, by path segment. Whatever follows an entry's last `/` need
    not be a whole segment: it is kept beside the node as the start of the next one. Of entries that fit,
    the longest host wins, then the longest path; of equal entries, allow wins.
    """

    def __init__(self, entries: Iterable[tuple[str, str]]):
        self.root: dict = {}
        for verdict, text in entries:
            host, slash, path = text.partition("/")
            node = self.root
            for label in reversed(host.translate(_LOWER).split(".")):
                node = node.setdefault(("host", label), {})
            *whole, rest = (slash + path).split("/")
            for segment in whole:
                node = node.setdefault(("path", segment), {})
            ends = node.setdefault("ends", {})
            if ends.get(rest, ("block",))[0] == "block":
                ends[rest] = (verdict, text)

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """(verdict, entry) of the longest entry that fits, or None."""
        best, node = None, self.root
        segments = path.split("/")
        for label in reversed(host.split(".")):
            node = node.get(("host", label))
            if node is None:
                break
            best = self._along(node, segments) or best
        return best

    @staticmethod
    def _along(node: dict | None, segments: list[str]) -> tuple[str, str] | None:
        best = None
        for segment in segments:
            ends = node.get("ends")
            if ends:
                fits = [k for k in ends if segment.startswith(k)]
                best = ends[max(fits, key=len)] if fits else best
            node = node.get(("path", segment))
            if node is None:
                break
        return best


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], default: str = "allow", url: str = "url") -> DataFrame:
    """pages with host, path, rule (null if none fits) and verdict.

    A null url, or one without `://`, has neither host nor path and gets `default`, as does an url that no rule fits.
    Of entries as long as each other, allow wins. Repeated rows are judged alike; an url of any length is judged as a whole; an empty table gives an empty table; existing columns of the new names are replaced, others stay as they are.
    """
    if sum(len(r) for _, r in rules) > MAX_RULE_BYTES:
        raise ValueError("the rule list is larger than what may be broadcast")
    pages = pages.drop("host", "path", "rule", "verdict")
    trie = RuleTrie(rules)  # goes out with the function, once to each executor
    schema = "host string, path string, rule string, verdict string"

    def judged(column):
        out = []
        for u in column.to_pylist():
            host, path = split_url(u)
            verdict, rule = trie.match(host, path) or (default, None)
            out.append({"host": host, "path": path, "rule": rule, "verdict": verdict})
        return pa.array(out, pa.struct([(k, pa.string()) for k in ("host", "path", "rule", "verdict")]))

    @F.arrow_udf(f"struct<{schema.replace(' string', ':string')}>")
    def judge(column: pa.Array) -> pa.Array:
        return judged(column)

    own = unused(pages, "judged")
    return pages.withColumn(own, judge(F.col(url).cast("string"))).select(*pages.columns, f"{own}.*")
