"""URL rules indexed by their rarest literal token.

A rule is a regular expression over ``host + path`` or over the whole URL. Each is filed under one literal token that any
URL it fits must hold: the one that is rarest among the URLs at hand. The tokens of a URL fetch its candidate rules, and
only these run their expressions; a rule without a whole token is a candidate for every URL.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.common import Batches

_LOWER = {c: c + 32 for c in range(65, 91)}
_TOKEN = re.compile(r"[a-z0-9]+")
#: Bytes of all rules together; a larger list isn't sent to the workers.
MAX_RULE_BYTES = 64 << 20


@dataclass(frozen=True)
class HostRule:
    """Fits a host and its subdomains if the path begins with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def expression(self) -> str:
        return rf"(?:[^/]*\.)?{re.escape(self.host)}{re.escape(self.path)}"

    def tokens(self) -> list[str]:
        return _whole_tokens("." + self.name.translate(_LOWER), False)


@dataclass(frozen=True)
class PatternRule:
    """A pattern over the whole URL, ASCII case aside.

    ``*`` stands for anything, ``^`` for a character that isn't a letter, digit or one of ``_-.%``, or for the end; a
    leading ``||`` anchors at a label of the host, a leading ``|`` at the beginning and a trailing ``|`` at the end.
    """

    pattern: str
    verdict: str

    def expression(self) -> str:
        body, head, tail = self.pattern, ".*", ""
        if body.startswith("||"):
            body, head = body[2:], r"[^:/?#]*://(?:[^/?#]*\.)?"
        elif body.startswith("|"):
            body, head = body[1:], ""
        if body.endswith("|"):
            body, tail = body[:-1], r"\Z"
        parts = {"*": ".*", "^": r"(?:[^A-Za-z0-9_.%-]|\Z)"}
        return head + "".join(parts.get(c, re.escape(c)) for c in body) + tail

    def tokens(self) -> list[str]:
        # An anchor ends a token as any other character does; a wildcard doesn't.
        body = self.pattern.replace("||", "/", 1) if self.pattern.startswith("||") else self.pattern
        return _whole_tokens(body.translate(_LOWER), True)


def _whole_tokens(text: str, wild: bool) -> list[str]:
    """Tokens of a rule that are whole in each URL it fits: a character that is neither token nor wildcard at both sides."""
    out = []
    for m in _TOKEN.finditer(text):
        before, after = text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1]
        if before and after and not (wild and "*" in (before, after)):
            out.append(m[0])
    return out


def split_url(url: str | None) -> tuple[str, str]:
    """Host, A-Z lower-cased, and path; both empty without ``://``."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    rest = re.split("[?#]", rest, maxsplit=1)[0]
    host, slash, path = rest.partition("/")
    return host.translate(_LOWER), slash + path


def tokens_of(url: str | None) -> set[str]:
    return set(_TOKEN.findall((url or "").translate(_LOWER)))


class RuleIndex:
    def __init__(self, hosts: Sequence[HostRule], patterns: Sequence[PatternRule], frequency: dict[str, int]):
        self.by_token: dict[str, list[int]] = defaultdict(list)
        self.always: list[int] = []
        self.rules = [*hosts, *patterns]
        flags = [re.S] * len(hosts) + [re.S | re.I | re.A] * len(patterns)
        self.expressions = [re.compile(r.expression(), f) for r, f in zip(self.rules, flags, strict=True)]
        for i, rule in enumerate(self.rules):
            tokens = rule.tokens()
            if tokens:
                self.by_token[min(tokens, key=lambda t: (frequency.get(t, 0), -len(t), t))].append(i)
            else:
                self.always.append(i)

    def candidates(self, url: str | None) -> list[int]:
        return self.always + [i for t in tokens_of(url) for i in self.by_token.get(t, ())]

    def judge(self, url: str | None, default: str) -> tuple[str, str, str | None, str | None, str]:
        """Host, path, host rule, pattern and verdict: of the longest host rule, else of a pattern, else the default.

        Of patterns, one that allows comes before one that blocks; then the longest.
        """
        host, path = split_url(url)
        by_host, by_pattern = [], []
        for i in self.candidates(url):
            rule = self.rules[i]
            if isinstance(rule, HostRule):
                if self.expressions[i].match(host + path):
                    by_host.append(rule)
            elif url is not None and self.expressions[i].match(url):
                by_pattern.append(rule)
        if by_host:
            best = max(by_host, key=lambda r: (len(r.name), r.name, r.verdict))
            return host, path, best.name, None, best.verdict
        if by_pattern:
            best = max(by_pattern, key=lambda r: (r.verdict == "allow", len(r.pattern), r.pattern))
            return host, path, None, best.pattern, best.verdict
        return host, path, None, None, default


#: Kinds of addresses that hold no text worth keeping, and two that look like them and do.
DEFAULT_PATTERNS = (
    PatternRule("||ads.", "block"),
    PatternRule("||adserver.", "block"),
    PatternRule("||tracker.", "block"),
    PatternRule("/ads/", "block"),
    PatternRule("/banner/", "block"),
    PatternRule("/login^", "block"),
    PatternRule("/signin^", "block"),
    PatternRule("/checkout^", "block"),
    PatternRule("/cart^", "block"),
    PatternRule("/tag/*/page/", "block"),
    PatternRule("*.exe|", "block"),
    PatternRule("*.zip|", "block"),
    PatternRule("*.jpg|", "block"),
    PatternRule("*.png|", "block"),
    PatternRule("^casino^", "block"),
    PatternRule("^porn^", "block"),
    PatternRule("/wiki/*^casino^", "allow"),
    PatternRule("/blog/*/login^", "allow"),
)


def judge_urls(
    pages: DataFrame,
    hosts: Sequence[HostRule],
    patterns: Sequence[PatternRule] = DEFAULT_PATTERNS,
    default: str = "allow",
    url_col: str = "url",
    id_col: str = "page_id",
) -> DataFrame:
    """``id_col``, host, path, rule, verdict and pattern of every URL.

    ``rule`` is the longest host rule that fits, else null; ``pattern`` is the pattern that decided, else null. A null
    URL, and one without ``://``, has an empty host and path and fits no host rule; repeated rows each give a row; other
    columns are ignored; an empty table gives no rows. Nothing is shuffled but counts of the rules' tokens.
    """
    if sum(len(r.expression()) for r in (*hosts, *patterns)) > MAX_RULE_BYTES:
        raise ValueError("the rules are too many to be sent to every worker")
    wanted = {t for r in (*hosts, *patterns) for t in r.tokens()}
    urls = pages.select(pages[id_col].alias("id"), pages[url_col].alias("url"))

    def count(batches: Batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = Counter(t for u in batch.column("url").to_pylist() for t in tokens_of(u) & wanted)
            yield pa.RecordBatch.from_pydict(
                {"token": pa.array(own.keys(), pa.string()), "n": pa.array(own.values(), pa.int64())}
            )

    counted = urls.select("url").mapInArrow(count, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    frequency = {r.token: r.n for r in counted.collect()}  # one row for each token of a rule at most

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        index = RuleIndex(hosts, patterns, frequency)
        for batch in batches:
            judged = [index.judge(u, default) for u in batch.column("url").to_pylist()]
            columns = zip(*judged, strict=True) if judged else [()] * 5
            arrays = [batch.column("id"), *(pa.array(c, pa.string()) for c in columns)]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "host", "path", "rule", "pattern", "verdict"])

    kind = dict(pages.dtypes)[id_col]
    out = urls.mapInArrow(run, f"id {kind}, host string, path string, rule string, pattern string, verdict string")
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", "verdict", "pattern")
