"""URL rules over all pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickerloom.llm.common import table
from tickerloom.llm.registry import query
from tickerloom.llm.url_rules import DEFAULT_PATTERNS, HostRule, judge_urls

RULES = (
    HostRule("org", "/", "allow"),
    HostRule("example.org", "/es/", "block"),
    HostRule("example.org", "/en/1", "block"),
    HostRule("com", "/fr/", "allow"),
    HostRule("com", "/de/", "block"),
)


def _sql() -> str:
    """Each rule and pattern tried on each URL."""
    rules = ", ".join(f"('{r.host}', '{r.path}', '{r.verdict}')" for r in RULES)
    patterns = ", ".join(
        "('{}', '{}', '{}')".format(p.pattern, "(?s)^" + p.expression().replace(r"\Z", "$"), p.verdict) for p in DEFAULT_PATTERNS
    )
    return rf"""
    WITH r(h, p, verdict) AS (VALUES {rules}),
    q(pattern, expression, verdict) AS (VALUES {patterns}),
    cut AS (
        SELECT page_id, url, position('://' IN coalesce(url, '')) AS mark,
            regexp_extract(substr(url, position('://' IN url) + 3), '^[^?#]*') AS rest
        FROM pages
    ),
    split AS (
        SELECT row_number() OVER () AS n, page_id, url,
            CASE WHEN mark > 0 THEN translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
            CASE WHEN mark > 0 THEN regexp_replace(rest, '^[^/]*', '') ELSE '' END AS path
        FROM cut
    ),
    fits AS (
        SELECT n, arg_max(h || p, length(h || p)) AS rule, arg_max(r.verdict, length(h || p)) AS verdict
        FROM split JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
        GROUP BY n
    ),
    matched AS (
        SELECT n, arg_max(pattern, (q.verdict = 'allow')::int * 1000000 + length(pattern)) AS pattern,
            arg_max(q.verdict, (q.verdict = 'allow')::int * 1000000 + length(pattern)) AS verdict
        FROM split JOIN q ON regexp_matches(url, '(?i)' || expression)
        GROUP BY n
    )
    SELECT page_id, host, path, rule, coalesce(f.verdict, m.verdict, 'allow') AS verdict,
        CASE WHEN rule IS NULL THEN m.pattern END AS pattern
    FROM split LEFT JOIN fits f USING (n) LEFT JOIN matched m USING (n)
    """


@query("op6_url_rules", _sql())
def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL."""
    return judge_urls(table(spark, sf_dir, "pages"), RULES)
