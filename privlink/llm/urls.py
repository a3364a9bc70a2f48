"""URL filter: a trie over reversed host labels and path segments with longest-match precedence.

Rules are ``(verdict, host, path)``; a rule fits its host and every subdomain when the url's path starts with the rule's
path.  Among the rules that fit, the one with the most host labels wins, then the longest path, then "block".  The trie
is a plain nested dict, built on the driver from a rule list whose size is checked (``MAX_RULES``), and shipped with the
function.  The url itself is parsed by built-in expressions, so only host and path cross to Python.

Defined results: a null url, or one without ``://``, has an empty host and path, no rule, and the default verdict.
Repeated rows are judged one by one; an empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, ship

#: Rules that the shipped trie may hold; beyond it, split the list and intersect the verdicts.
MAX_RULES = 500_000
HERE = "\0"  # key of a node's own entries; no label or segment holds a NUL


def build_trie(rules: list[tuple[str, str, str]]) -> dict:
    """Host labels from the right, then whole path segments; what a rule has after its last "/" is an open prefix."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} are broadcast")
    root: dict = {}
    for verdict, host, path in rules:
        if verdict not in ("allow", "block"):
            raise ValueError(f"verdict {verdict!r}")
        node = root
        for label in reversed(host.lower().split(".")):
            node = node.setdefault(label, {})
        *segments, tail = path.split("/")
        node = node.setdefault(HERE, {})
        for s in segments:
            node = node.setdefault("/" + s, {})
        entries = node.setdefault(HERE, {})
        if entries.get(tail, ("", ""))[0] != "block":
            entries[tail] = (verdict, host.lower() + path)
    return root


def match(trie: dict, host: str, path: str) -> tuple[str, str] | None:
    """(verdict, rule) of the deepest entry: all labels of the rule's host first, then the longest path prefix."""
    best, node = None, trie
    segments = path.split("/")
    for label in reversed(host.split(".")):
        node = node.get(label)
        if node is None or label == "":
            break
        at = node.get(HERE)
        found = None
        for depth in range(len(segments)):
            if at is None:
                break
            rest = "/".join(segments[depth:]) if at.get(HERE) else ""
            fits = [t for t in at.get(HERE, ()) if rest.startswith(t)]
            if fits:
                found = at[HERE][max(fits, key=len)]
            at = at.get("/" + segments[depth])
        best = found or best
    return best


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    rest = F.substring_index(_rest(url), "/", 1)
    return F.translate(F.substring_index(F.substring_index(rest, "?", 1), "#", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    head = F.substring_index(F.substring_index(_rest(url), "?", 1), "#", 1)
    return F.when(F.locate("/", head) > 0, head.substr(F.locate("/", head), F.length(head))).otherwise("")


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")


def judge(
    df: DataFrame,
    rules: list[tuple[str, str, str]],
    url_col: str = "url",
    keep: tuple[str, ...] = ("page_id",),
    default: str = "allow",
) -> DataFrame:
    """``keep`` with host, path, rule (null if none fits) and verdict (the rule's, else ``default``)."""
    ship(df.sparkSession)
    trie = df.sparkSession.sparkContext.broadcast(build_trie(rules))

    @F.pandas_udf("rule string, verdict string")
    def look(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        found = [match(trie.value, h, p) for h, p in zip(hosts, paths, strict=True)]
        return pd.DataFrame({"rule": [m and m[1] for m in found], "verdict": [m[0] if m else default for m in found]})

    parsed = df.select(*keep, F.coalesce(host_of(df[url_col]), F.lit("")).alias("host"), F.coalesce(path_of(df[url_col]), F.lit("")).alias("path"))
    got = parsed.withColumn("__m", look("host", "path"))
    return got.select(*keep, "host", "path", F.col("__m.rule").alias("rule"), F.col("__m.verdict").alias("verdict"))
