"""URL filters: a trie over reversed host labels and then path characters by segment, broadcast.

A rule is a host and a path prefix. It fits its host and all subdomains if the url's path starts with the
rule's. Of the rules that fit, the one with the most host labels and then the longest path decides; of
two equal ones, allow wins over block. A url that no rule fits gets the default verdict.

Defined cases: a null url, or one without `://`, has empty host and path; repeated rows and null ids
are judged row by row; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import narrow, prepare, texts_of

_URL = re.compile(r"://([^/?#]*)([^?#]*)", re.DOTALL)
_UPPER = {c: c + 32 for c in range(0x41, 0x5B)}


def split_url(url: str) -> tuple[str, str]:
    m = _URL.search(url)
    return (m[1].translate(_UPPER), m[2]) if m else ("", "")


class UrlTrie:
    """Nodes are dicts from a reversed host label; a node's paths are tries by segment.

    In a path trie a whole segment leads on to the next. A rule's last segment may be a prefix of the
    url's, so it is kept with the node as an open end.
    """

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.root: dict = {}
        for verdict, host, path in rules:
            if verdict not in ("allow", "block"):
                raise ValueError(f"unknown verdict {verdict}")
            node = self.root
            for label in reversed(host.translate(_UPPER).split(".")):
                node = node.setdefault("next", {}).setdefault(label, {})
            *whole, last = path.split("/")
            at = node.setdefault("paths", {})
            for segment in whole:
                at = at.setdefault("next", {}).setdefault(segment, {})
            ends = at.setdefault("ends", {})
            if ends.get(last, ("block",))[0] == "block":
                ends[last] = (verdict, host + path)

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """(verdict, rule) of the longest rule that fits."""
        best, node = None, self.root
        segments = path.split("/")
        for label in reversed(host.split(".")):
            node = node.get("next", {}).get(label)
            if node is None:
                break
            if "paths" in node:
                best = self._longest(node["paths"], segments) or best
        return best

    @staticmethod
    def _longest(at: dict | None, segments: list[str]) -> tuple[str, str] | None:
        best = None
        for segment in segments:
            ends = at.get("ends", {})
            fit = [e for e in ends if segment.startswith(e)]
            if fit:
                best = ends[max(fit, key=len)]
            at = at.get("next", {}).get(segment)
            if at is None:
                break
        return best


def judge_urls(
    pages: DataFrame,
    rules: list[tuple[str, str, str]],
    default: str = "allow",
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """page_id, host, path, rule and verdict of every url. rules: (verdict, host, path prefix), a bounded list."""
    spark = pages.sparkSession
    prepare(spark)
    source = narrow(pages, page_id=id_col, url=url_col)
    kind = source.schema["page_id"].dataType.simpleString()
    trie = spark.sparkContext.broadcast(UrlTrie(rules))  # the rules that the caller passes, nothing from the data
    names = ["page_id", "host", "path", "rule", "verdict"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [split_url(u) for u in texts_of(b.column(1))]
            hits = [trie.value.find(*r) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([r[0] for r in rows], pa.string()),
                    pa.array([r[1] for r in rows], pa.string()),
                    pa.array([h[1] if h else None for h in hits], pa.string()),
                    pa.array([h[0] if h else default for h in hits], pa.string()),
                ],
                names,
            )

    return source.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string")
