"""Allow and block lists of URLs by longest match in a trie.

The trie's first part runs over host labels from the top domain down, its second over path
segments.  It is built on the driver from the rule list and broadcast; ``MAX_RULES`` bounds it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from gleanframe.llm.rows import Sent, map_steps, picked

# rules that are broadcast; a longer list is refused, never cut
MAX_RULES = 2_000_000


@dataclass(frozen=True)
class UrlRule:
    """A host with all its subdomains, limited to paths that start with ``path``."""

    verdict: str
    host: str
    path: str = "/"


def split_url(url: str | None) -> tuple[str, str]:
    """(host with A-Z lower-cased, path); both empty without ``://``."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    for mark in "#?":
        rest = rest.split(mark, 1)[0]
    host, slash, path = rest.partition("/")
    return host.encode().lower().decode(), slash + path


def _lower(host: str) -> str:
    return host.encode().lower().decode()


class UrlTrie:
    """Host labels reversed, then path segments; the last segment of a rule may be a beginning."""

    def __init__(self, rules: Sequence[UrlRule]):
        if len(rules) > MAX_RULES:
            raise ValueError(f"{len(rules)} URL rules; at most {MAX_RULES} can be broadcast")
        self.root: dict = {}
        for rule in rules:
            if rule.verdict not in ("allow", "block"):
                raise ValueError(f"verdict {rule.verdict!r}")
            node = self.root
            for label in reversed(_lower(rule.host).split(".")):
                node = node.setdefault("hosts", {}).setdefault(label, {})
            *whole, last = rule.path.split("/")
            for segment in whole:
                node = node.setdefault("paths", {}).setdefault(segment, {})
            ends = node.setdefault("ends", {})
            # the same place listed twice: block wins
            if ends.get(last, ("allow",))[0] == "allow":
                ends[last] = (rule.verdict, _lower(rule.host) + rule.path)

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """(verdict, rule) of the longest rule that fits."""
        best: tuple[str, str] | None = None
        segments = path.split("/")
        node = self.root
        for label in reversed(host.split(".")):
            node = node.get("hosts", {}).get(label)
            if node is None:
                break
            below = node
            for i, segment in enumerate(segments):
                for start, found in below.get("ends", {}).items():
                    # what follows the last whole segment only has to begin alike
                    rest = "/".join(segments[i:]) if "/" in start else segment
                    if rest.startswith(start) and (best is None or len(found[1]) > len(best[1])):
                        best = found
                below = below.get("paths", {}).get(segment)
                if below is None:
                    break
        return best


def judge_urls(
    df: DataFrame, rules: Sequence[UrlRule], *, key: str = "page_id", url: str = "url", default: str = "allow",
) -> DataFrame:
    """(key, host, path, rule, verdict), one row per input row.

    The longest rule (host and path together) that fits wins; without any, the verdict is
    ``default`` and the rule null.  Null URLs and those without ``://`` have an empty host and
    path, which no rule fits.  Repeated rows are judged alike, an empty table gives an empty one.
    """
    trie = Sent(df.sparkSession, UrlTrie(rules))

    def judge(columns):
        hosts, paths, names, verdicts = [], [], [], []
        for text in columns[url].to_pylist():
            host, path = split_url(text)
            verdict, name = trie.value.match(host, path) or (default, None)
            hosts.append(host)
            paths.append(path)
            names.append(name)
            verdicts.append(verdict)
        return columns[key], hosts, paths, names, verdicts

    kind = df.schema[key].dataType.simpleString()
    return map_steps(
        picked(df, [key, url]), judge, f"`{key}` {kind}, host string, path string, rule string, verdict string",
    )
