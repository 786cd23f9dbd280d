"""URL filters: host rules, then pattern rules found through their rarest literal token.

A pattern is plain text with ``*`` (anything) and ``^`` (a separator or an end). A literal token
is a run of ``[a-z0-9]`` in it with a fixed separator on both sides, so every URL that the
pattern fits has that token whole. Each pattern is filed under the one of its tokens that the
fewest URLs have. The tokens of a URL fetch its candidate patterns, and only those are run as
regular expressions. Patterns without such a token run on every URL.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import ascii_lower, small, stored

#: (host, path, verdict)
HOST_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"),
              ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Patterns of pages that are no prose. All block.
PATTERNS = (
    "^casino^", "^porn^", "^xxx^", "^viagra^", "^betting^", "^warez^", "^torrent^",
    "/ads/*.js^", "^adserver^", "^doubleclick.net/", "/banner/*.gif^", "^popunder^",
    "/login^", "/signin^", "/signup^", "/logout^", "/register^*email=", "/wp-admin/", "/wp-login.php",
    "/cart^", "/checkout/", "/search?*q=", "/tag/*/page/", "/feed/rss^", ".exe^", ".zip^", ".apk^",
    "^sessionid=", "^phpsessid=", "^print=1^", "^action=edit^", "^replytocom=",
)
#: Rows of the index up to which it is broadcast (under 10 MB).
BROADCAST_ROWS = 50_000


def tokens(pattern: str) -> list[str]:
    """The literal tokens of a pattern: with ends of the pattern or ``*`` beside them a URL's
    token could be longer, so only runs with another character on both sides count."""
    found = []
    for m in re.finditer("[a-z0-9]+", pattern):
        left, right = pattern[m.start() - 1:m.start()] if m.start() else "", pattern[m.end():m.end() + 1]
        if left not in ("", "*") and right not in ("", "*"):
            found.append(m.group())
    return sorted(set(found))


def to_regex(pattern: str) -> str:
    """The regular expression of a pattern, for Java and Python, on A-Z lowered URLs."""
    parts = []
    for i, c in enumerate(pattern):
        if c == "*":
            parts.append("(?s:.*)")
        elif c == "^":
            parts.append("(?:^|[^a-z0-9])" if i == 0 else r"(?:[^a-z0-9]|\z)")
        else:
            parts.append(re.escape(c))
    return "".join(parts)


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.substr(url, at + 3)
    known = url.isNotNull() & (at > 0)
    host = F.when(known, F.regexp_extract(rest, "^[^/?#]*", 0)).otherwise("")
    path = F.when(known, F.regexp_extract(F.substr(rest, F.length(F.regexp_extract(rest, "^[^/?#]*", 0)) + 1),
                                          "^[^?#]*", 0)).otherwise("")
    return ascii_lower(host), path


def host_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null where none does."""
    longest = sorted(rules, key=lambda r: (-len(r[0]) - len(r[1]), -len(r[0]), r))
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in reversed(longest):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def url_tokens(lowered: Column) -> Column:
    return F.array_distinct(F.split(lowered, "[^a-z0-9]+"))


def pattern_index(urls: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """(token, pattern, regex): each pattern that has a token under its rarest one, by the
    number of rows of ``urls`` (url) that have the token; ties go to the longer token, then to
    the lesser one. Counts cover all rows and are partial sums before the shuffle."""
    spark = urls.sparkSession
    pairs = [(t, p, to_regex(p)) for p in sorted(set(patterns)) for t in tokens(p)]
    filed = spark.createDataFrame(pairs, "token string, pattern string, regex string")
    wanted = filed.select("token").distinct()
    seen = urls.select(F.explode(url_tokens(ascii_lower(F.col("url")))).alias("token"))
    counts = seen.join(_sized(wanted), "token").groupBy("token").agg(F.count("*").alias("n"))
    best = filed.join(counts, "token", "left").groupBy("pattern", "regex").agg(F.min(F.struct(
        F.coalesce("n", F.lit(0)).alias("n"), (-F.length("token")).alias("l"), "token")).alias("b"))
    return best.select(F.col("b.token").alias("token"), "pattern", "regex")


def _sized(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if small(df, BROADCAST_ROWS) else df


def matched_patterns(pages: DataFrame, patterns: Sequence[str] = PATTERNS) -> DataFrame:
    """(url, pattern): for each distinct URL that a pattern fits, the least such pattern.

    URLs are made distinct first (partial aggregation: a URL of a third of the rows sends one
    row per task), their tokens meet the index in a join, and only the candidates so fetched
    run their regular expression."""
    urls = stored(pages.where(F.col("url").isNotNull()).select("url").distinct(), "urls")
    index = stored(pattern_index(urls, patterns), "url-index")
    lowered = ascii_lower(F.col("url"))
    fetched = urls.select("url", F.explode(url_tokens(lowered)).alias("token")).join(_sized(index), "token")
    hits = fetched.where("translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') rlike regex"
                         ).select("url", "pattern")
    for p in sorted({p for p in patterns if not tokens(p)}):
        hits = hits.unionByName(urls.where(lowered.rlike(to_regex(p))).select("url", F.lit(p).alias("pattern")))
    return hits.groupBy("url").agg(F.min("pattern").alias("pattern"))


def judge(pages: DataFrame, host_rules: Sequence[tuple[str, str, str]] = HOST_RULES,
          patterns: Sequence[str] = PATTERNS) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, pattern.

    The longest host rule that fits decides; where none does, a matching pattern blocks and all
    else is allowed. A null URL or one without ``://`` has empty host and path; null matches no
    pattern and is allowed. Repeated rows each keep their row; an empty table gives none; other
    columns are ignored."""
    host, path = host_and_path(F.col("url"))
    base = pages.select("page_id", "url").withColumn("host", host).withColumn("path", path)
    rule, verdict = host_rule(F.col("host"), F.col("path"), host_rules)
    base = base.withColumn("rule", rule).withColumn("by_rule", verdict)
    found = matched_patterns(pages, patterns)
    return base.join(found, "url", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("by_rule", F.when(F.col("pattern").isNotNull(), "block").otherwise("allow")).alias("verdict"),
        "pattern")


def any_pattern_sql(patterns: Sequence[str], url: str) -> str:
    """A SQL condition: some pattern fits ``url``, every pattern run on every row."""
    tests = [f"regexp_matches({url}, '{to_regex(p).replace(chr(39), chr(39) * 2)}')" for p in patterns]
    return reduce(lambda a, b: f"{a} OR {b}", tests, "FALSE")
