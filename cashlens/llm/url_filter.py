"""URL filter: a trie over reversed host labels and, below each host, over path segments.

Rules are (action, host, path). A rule fits its host and all subdomains of it, when the path of the url starts
with the rule's path. The longest fitting rule decides: most host labels first, then the longest path; of equal
rules ``block`` wins over ``allow``. The rule list is an argument of the job, not a table: its bound is
``max_rules`` and the trie is broadcast.

Defined cases: a null url, or one without ``://``, has an empty host and path, fits no rule and gets the default
verdict. Repeated rows are judged one by one. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rule = tuple[str, str, str]


def host_of(url: Column) -> Column:
    return F.translate(
        F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")),
        "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
        "abcdefghijklmnopqrstuvwxyz",
    )


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def build_trie(rules: list[Rule], max_rules: int = 100_000) -> dict:
    """Nodes are dictionaries; key None holds the path node of a host.

    A path node has its full segments as keys, and under "" the rules that end here: (rest of the last
    segment, action, rule text), where the rest is a prefix the next segment must start with.
    """
    if len(rules) > max_rules:
        raise ValueError(f"{len(rules)} rules; the trie is broadcast, raise max_rules knowingly")
    root: dict = {}
    for action, host, path in rules:
        node = root
        for label in reversed(host.lower().split(".")):
            node = node.setdefault(label, {})
        node = node.setdefault(None, {})
        *full, rest = path.split("/")
        for segment in full:
            node = node.setdefault(f"/{segment}", {})
        node.setdefault("", []).append((rest, action, host + path))
    return root


def longest_match(trie: dict, host: str, path: str) -> tuple[str, str] | None:
    """Rule text and action of the longest rule that fits."""
    hosts, node = [], trie
    for label in reversed(host.split(".")):
        node = node.get(label)
        if node is None:
            break
        if None in node:
            hosts.append(node[None])
    segments = path.split("/")
    for node in reversed(hosts):
        best = None
        for i, segment in enumerate(segments):
            for rest, action, text in node.get("", ()):
                if segment.startswith(rest) and (best is None or (len(text), action == "block") > best[0]):
                    best = (len(text), action == "block"), text, action
            node = node.get(f"/{segment}") if i + 1 < len(segments) else None
            if node is None:
                break
        if best:
            return best[1], best[2]
    return None


def judge_urls(pages: DataFrame, rules: list[Rule], default: str = "allow") -> DataFrame:
    """page_id, host, path, rule (null where none fits) and verdict of every row."""
    if default not in ("allow", "block"):
        raise ValueError(default)
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    shared = pages.sparkSession.sparkContext.broadcast(build_trie(rules))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                longest_match(shared.value, host, path)
                for host, path in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
            ]
            rule = pa.array([x and x[0] for x in found], pa.string())
            verdict = pa.array([x[1] if x else default for x in found], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, rule, verdict], names=[*batch.schema.names, "rule", "verdict"])

    schema = f"page_id {pages.schema['page_id'].dataType.simpleString()}, host string, path string, rule string, verdict string"
    return parts.mapInArrow(judge, schema)
