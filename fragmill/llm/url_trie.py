"""URL filters: a trie over reversed host labels and path segments, broadcast, where the longest match decides.

A rule (action, host, path) fits a url whose host is the rule's host or a subdomain of it and whose path starts with the
rule's path.  Among the rules that fit, the one with most characters in host and path wins, then the one with the longer
host, then block before allow.  A url that no rule fits gets the default verdict.

Edge cases: a null url or one without ``://`` has an empty host and path, so only rules with an empty host and path fit it;
host letters A-Z are lower-cased and nothing else is changed; repeated rows are judged alike; rules with null host or path
count as empty; an empty table gives an empty result.  Input columns named like an output column are replaced.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULE_SCHEMA = "action string, host string, path string"
#: What a rule takes in a worker's trie at most, beside its characters.
RULE_BYTES = 1000
OUTPUT = ("host", "path", "rule", "verdict")


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


class UrlTrie:
    """Nodes are [children, path node]; path nodes are [children, {beginning of the last segment: rule}, lengths of these], so
    that a url looks up one key for each length, however many rules end in a segment."""

    def __init__(self, rules: list[tuple[str, str, str]]):
        self.root: list = [{}, None]
        for action, host, path in rules:
            node = self.root
            for label in reversed(host.split(".")) if host else ():
                node = node[0].setdefault(label, [{}, None])
            if node[1] is None:
                node[1] = [{}, {}, []]
            node = node[1]
            *whole, rest = path.split("/")
            for segment in whole:
                node = node[0].setdefault(segment, [{}, {}, []])
            rule = ((len(host) + len(path), len(host), action == "block"), host + path, action)
            node[1][rest] = max(rule, node[1].get(rest, rule))
            if len(rest) not in node[2]:
                insort(node[2], len(rest))

    def match(self, host: str, path: str) -> tuple | None:
        """(order, rule, action) of the winning rule, or None."""
        segments, best, node = path.split("/"), None, self.root
        labels = host.split(".") if host else []
        while node is not None:
            at, depth = node[1], 0
            while at is not None:
                segment = segments[depth]
                for n in at[2]:
                    if n > len(segment):
                        break
                    rule = at[1].get(segment[:n])
                    if rule is not None and (best is None or rule[0] > best[0]):
                        best = rule
                # a child stands for a whole segment, so a slash must follow it
                at = at[0].get(segments[depth]) if depth + 1 < len(segments) else None
                depth += 1
            node = node[0].get(labels.pop()) if labels else None
        return best


def filter_urls(
    pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", max_broadcast_bytes: int = 200_000_000
) -> DataFrame:
    """Adds host, path, rule and verdict to pages.  The trie is broadcast if it is measured to stay under max_broadcast_bytes
    in a worker, at RULE_BYTES a rule beside its text; larger rule sets are joined on host suffix and path prefix instead."""
    rules = rules.select("action", *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("host", "path")))
    n_bytes = rules.agg(F.coalesce(F.sum(F.octet_length("host") + F.octet_length("path") + RULE_BYTES), F.lit(0))).first()[0]
    kept = [c for c in pages.columns if c not in OUTPUT]
    parts = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))}).select(*kept, "host", "path")
    if n_bytes > max_broadcast_bytes:
        return _joined(parts, rules, kept, default)
    trie = pages.sparkSession.sparkContext.broadcast(UrlTrie([tuple(r) for r in rules.collect()]))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = trie.value.match
        for batch in batches:
            found = [match(h, p) for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True)]
            columns = [*batch.columns, pa.array([x and x[1] for x in found], pa.string()), pa.array([x[2] if x else default for x in found], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "rule", "verdict"])

    schema = StructType([*parts.schema.fields, StructField("rule", StringType()), StructField("verdict", StringType())])
    return parts.mapInArrow(judge, schema)


def _joined(parts: DataFrame, rules: DataFrame, kept: list[str], default: str) -> DataFrame:
    """The same verdicts by an equi-join: every (host suffix, path prefix of a length that some rule has) is looked up.

    Only the lengths of the rules' paths are gathered on the driver; there are no more of them than a url has characters."""
    lengths = [r[0] for r in rules.select(F.length("path")).distinct().collect()]
    labels = F.split("host", r"\.")
    suffixes = F.concat(
        F.array(F.lit("")),
        F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(
            F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
        ),
    )
    prefixes = F.filter(F.array(*(F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths)), lambda x: x.isNotNull())
    keys = parts.select("host", "path").distinct()
    keys = keys.withColumn("rule_host", F.explode(suffixes)).withColumn("rule_path", F.explode(prefixes))
    named = rules.select(
        F.col("host").alias("rule_host"),
        F.col("path").alias("rule_path"),
        F.struct(
            (F.length("host") + F.length("path")).alias("n"), F.length("host").alias("h"), (F.col("action") == "block").alias("b"), F.concat("host", "path").alias("rule"), "action"
        ).alias("best"),
    )
    best = keys.join(named, ["rule_host", "rule_path"]).groupBy("host", "path").agg(F.max("best").alias("best"))
    return parts.join(best, ["host", "path"], "left").select(
        *kept, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict")
    )
