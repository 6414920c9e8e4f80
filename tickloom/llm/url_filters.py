"""URL filters: rules indexed by their rarest literal token.

Every rule has literal tokens that a matching URL must hold. A rule is filed under the one of them that
the fewest URLs have; the tokens of a URL fetch the rules filed under them, and only those rules run
their regular expression on that URL.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Host and path are cut at the first of these, so "#" can join them without being part of either.
SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class Rule:
    """A verdict for the URLs whose ``host#path`` the pattern finds.

    ``tokens`` are words that each such URL holds whole, between characters that are no letter or digit:
    ``h:`` for the host, ``p:`` for the path. ``shown`` is the rule's text in reports, null for the
    method's own patterns; ``rank`` decides between rules that both match (the larger wins).
    """

    pattern: str
    verdict: str
    tokens: tuple[str, ...]
    shown: str | None = None
    rank: int = 0


def place_rule(verdict: str, text: str) -> Rule:
    """A rule like ``example.com/en/``: that host, its subdomains, and paths that start so."""
    host, slash, rest = text.partition("/")
    path = slash + rest
    words = [f"h:{w}" for w in re.findall("[a-z0-9]+", host)]
    # A word that ends the prefix may be the start of a longer one.
    words += [f"p:{w}" for w in re.findall("[A-Za-z0-9]+(?=[^A-Za-z0-9])", path)]
    pattern = rf"(?s)^(?:[^#]*\.)?{re.escape(host)}#{re.escape(path)}"
    return Rule(pattern, verdict, tuple(words), text, len(text))


def pattern_rule(verdict: str, pattern: str, *tokens: str) -> Rule:
    """A rule of the method's own; it holds where no place rule does."""
    return Rule(pattern, verdict, tokens)


#: The rules of the query.
RULES = (
    place_rule("allow", "com/"),
    place_rule("block", "example.com/en/"),
    place_rule("allow", "www.example.com/en/"),
    place_rule("block", "net/es/"),
    place_rule("block", "net/fr/"),
)

#: Host names of link farms, shops, bets and trackers; and raw downloads.
OWN_RULES = (
    *(
        pattern_rule("block", rf"^(?:[^#]*[.-])?{a}-{b}[.#-]", f"h:{a}", f"h:{b}")
        for a, b in (
            ("spam", "farm"), ("link", "farm"), ("casino", "win"), ("cheap", "pills"), ("free", "bets"), ("ads", "track"),
        )
    ),
    pattern_rule("block", r"#.*\.exe$", "p:exe"),
    pattern_rule("block", r"#.*\.apk$", "p:apk"),
)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty where the url is null or has no ``://``."""
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, SPLIT, 1), UPPER, LOWER), F.regexp_extract(url, SPLIT, 2)


def tokens() -> Column:
    """The distinct tokens of ``host`` and ``path``."""
    words = F.concat(
        F.transform(F.split("host", "[^a-z0-9]+"), lambda w: F.concat(F.lit("h:"), w)),
        F.transform(F.split("path", "[^A-Za-z0-9]+"), lambda w: F.concat(F.lit("p:"), w)),
    )
    return F.array_distinct(words)


def rule_index(places: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Each rule under its rarest token. ``places``: one row per host and path.

    The counts are kept only for tokens that rules have, so what reaches the driver is as long as the
    rules that came from it.
    """
    spark = places.sparkSession
    held = sorted({t for r in rules for t in r.tokens})
    some = places.select(F.explode(F.array_intersect(tokens(), F.array(*map(F.lit, held)))).alias("token"))
    counts = {r.token: r["count"] for r in some.groupBy("token").count().collect()}
    rows = [(min(r.tokens, key=lambda t: (counts.get(t, 0), t)), r.pattern, r.verdict, r.shown, r.rank) for r in rules]
    return spark.createDataFrame(rows, "token string, pattern string, verdict string, shown string, rank int")


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES + OWN_RULES, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages``.

    The longest place rule that fits wins; where none fits, a pattern of the method's own; else
    ``default``. Verdicts depend on host and path alone, so they are found once for each distinct pair,
    and pages of one busy host are split by their path. A null url, an empty one and one without ``://``
    have empty host and path and get the default. Repeated rows and null ids stay as they are; columns
    other than page_id and url are not read. Every rule must have a token.
    """
    host, path = split_url(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    places = rows.select("host", "path").distinct()
    index = F.broadcast(rule_index(places, rules))  # one short row for each rule of a list that the driver holds
    found = (
        places.select("host", "path", F.explode(tokens()).alias("token"))
        .join(index, "token")
        .where(F.regexp_like(F.concat("host", F.lit("#"), "path"), F.col("pattern")))
        .groupBy("host", "path")
        .agg(F.max(F.struct("rank", "shown", "verdict")).alias("best"))
    )
    return rows.join(found, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("best.shown").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )


SQL = r"""
WITH r(rule, verdict) AS (VALUES ('com/', 'allow'), ('example.com/en/', 'block'), ('www.example.com/en/', 'allow'),
                                 ('net/es/', 'block'), ('net/fr/', 'block')),
s AS (SELECT page_id,
        translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
d AS (SELECT DISTINCT host, path FROM s),
b AS (SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(r.verdict, length(rule)) AS verdict
      FROM d JOIN r ON (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1)))
                   AND starts_with(path, substr(rule, strpos(rule, '/'))) GROUP BY host, path)
SELECT page_id, host, path, rule,
  coalesce(verdict, CASE WHEN regexp_matches(host, '(^|[.-])(spam-farm|link-farm|casino-win|cheap-pills|free-bets|ads-track)([.-]|$)')
                           OR regexp_matches(path, '\.(exe|apk)$') THEN 'block' ELSE 'allow' END) AS verdict
FROM s LEFT JOIN b USING (host, path)
"""
