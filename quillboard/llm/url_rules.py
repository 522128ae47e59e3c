"""URL filter rules, indexed by their rarest literal token.

A rule is a host and a path prefix. Its literal tokens are the parts that any URL it fits must hold
whole: the labels of its host, and the path segments that a slash closes. Every rule is filed under
the one of its tokens that the fewest URLs hold. A URL's own tokens fetch candidate rules from that
index; only those run their regular expression; the longest rule that fits decides.

All of it runs in the JVM. Few rules are one narrow projection, without shuffle or join, each pattern a
literal; many rules are a table, joined by token with the distinct URLs (broadcast where it is measured
small). Rules without any whole token are candidates for every URL.

Edge cases: a null URL, or one without `://`, has an empty host and path and takes the default verdict
with a null rule; an empty rule list gives the default everywhere; repeated rows are judged alike; of
fitting rules of equal length the alphabetically last wins; of rules with the same host and path the last
of the list counts; extra columns are carried by `judge` after its own five, and replaced where they have
one of their names. URLs of any length are judged whole.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillboard.llm.common import cut, join_hot, maybe_broadcast


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    def tokens(self) -> list[str]:
        """Tokens that a fitting URL holds whole: `host:label` and `path:segment`."""
        closed = self.path.split("/")[1:-1]
        return [f"host:{x}" for x in self.host.lower().split(".") if x] + [f"path:{x}" for x in closed if x]

    def regex(self) -> str:
        """Matches host + path of the URLs that the rule fits."""
        return rf"^(?:[^/]*\.)?{_quoted(self.host.lower())}{_quoted(self.path)}" if self.path.startswith("/") or not self.path else r"^\b\B"


def _quoted(literal: str) -> str:
    return re.sub(r"([^A-Za-z0-9_])", lambda m: "\\" + m[1] if ord(m[1]) < 128 else m[1], literal)


def parse_rule(line: str) -> UrlRule:
    """`allow org/`, `block example.org/es/`: a verdict, then host and path."""
    verdict, _, rest = line.strip().partition(" ")
    host, slash, path = rest.partition("/")
    if verdict not in ("allow", "block") or not host:
        raise ValueError(f"not a rule: {line!r}")
    return UrlRule(verdict, host.lower(), slash + path)


def url_host(url: Column) -> Column:
    """After the first `://`, up to `/`, `?`, `#` or the end; A-Z lower-cased."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_tokens(host: Column, path: Column) -> Column:
    """The distinct tokens of a URL, in the form of `UrlRule.tokens`."""
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("host:"), x))
    parts = F.transform(F.split(path, "/"), lambda x: F.concat(F.lit("path:"), x))
    return F.array_distinct(F.concat(labels, parts))


def token_counts(urls: DataFrame, rules: Sequence[UrlRule]) -> dict[str, int]:
    """How many URLs (columns host, path) hold each of the rules' tokens: one pre-aggregated pass."""
    wanted = sorted({t for r in rules for t in r.tokens()})
    if not wanted:
        return {}
    known = F.array(*[F.lit(t) for t in wanted])
    found = urls.select(F.explode(F.array_intersect(url_tokens(F.col("host"), F.col("path")), known)).alias("token"))
    counts = {r["token"]: r["n"] for r in found.groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}  # tokens of rules only
    return {t: counts.get(t, 0) for t in wanted}


def file_rules(rules: Sequence[UrlRule], counts: dict[str, int]) -> list[str | None]:
    """The token that each rule is filed under: that which the fewest URLs hold; None for a rule without any."""
    return [min(r.tokens(), key=lambda t: (counts[t], t)) if r.tokens() else None for r in rules]


def judge(df: DataFrame, rules: Sequence[UrlRule], url_col: str = "url", default: str = "allow", inline_rules: int = 64) -> DataFrame:
    """host, path, rule, verdict, n_candidates for every row, before the columns of `df` not so named.

    Up to `inline_rules` rules are part of one narrow projection; more are a table that the tokens of the
    distinct URLs are joined with. Both give the same.
    """
    rules = list({r.text: r for r in rules}.values())
    url = F.col(f"`{url_col}`")
    own = ("host", "path", "rule", "verdict", "n_candidates")
    held = [F.col(f"`{c}`") for c in df.columns if c not in own]
    urls = df.select(url_host(url).alias("host"), url_path(url).alias("path"), *held)
    filed = file_rules(rules, token_counts(urls, rules))
    found = _inline(urls, rules, filed) if len(rules) <= inline_rules else _joined(urls, rules, filed)
    return found.select(
        "host",
        "path",
        F.col("__qb_best")["text"].alias("rule"),
        F.coalesce(F.col("__qb_best")["verdict"], F.lit(default)).alias("verdict"),
        F.col("__qb_candidates").cast("int").alias("n_candidates"),
        *held,
    )


def _inline(urls: DataFrame, rules: Sequence[UrlRule], filed: Sequence[str | None]) -> DataFrame:
    """`urls` with __qb_best and __qb_candidates; each pattern is a literal, compiled once."""
    urls = urls.withColumn("__qb_tokens", url_tokens(F.col("host"), F.col("path")))
    whole, none = F.concat("host", "path"), F.lit(None).cast("struct<length:int,text:string,verdict:string>")
    best, many = [none], F.lit(0)
    for rule, token in zip(rules, filed, strict=True):
        candidate = F.lit(True) if token is None else F.array_contains("__qb_tokens", F.lit(token))
        value = F.struct(F.lit(len(rule.text)).alias("length"), F.lit(rule.text).alias("text"), F.lit(rule.verdict).alias("verdict"))
        best.append(F.when(candidate & F.rlike(whole, F.lit(rule.regex())), value))
        many = many + candidate.cast("int")
    return urls.withColumns({"__qb_best": F.array_max(F.array(*best)), "__qb_candidates": many})


def _joined(urls: DataFrame, rules: Sequence[UrlRule], filed: Sequence[str | None]) -> DataFrame:
    """The same by a rule table: only distinct URLs are joined, and only those with candidates come back."""
    everywhere = "any"  # no URL token has this form
    rows = [(everywhere if t is None else t, r.regex(), len(r.text), r.text, r.verdict) for r, t in zip(rules, filed, strict=True)]
    table = urls.sparkSession.createDataFrame(rows, "token string, regex string, length int, text string, verdict string")
    known = urls.select("host", "path").distinct()
    tokens = known.select("host", "path", F.explode(F.concat(url_tokens(F.col("host"), F.col("path")), F.array(F.lit(everywhere)))).alias("token"))
    value = F.when(F.rlike(F.concat("host", "path"), F.col("regex")), F.struct("length", "text", "verdict"))
    judged = tokens.join(maybe_broadcast(table, len(rows)), "token").groupBy("host", "path").agg(F.max(value).alias("__qb_best"), F.count(F.lit(1)).alias("__qb_candidates"))
    judged = cut(judged.select(F.struct("host", "path").alias("__qb_url"), "__qb_best", "__qb_candidates"))
    keyed = urls.withColumn("__qb_url", F.struct("host", "path"))
    return join_hot(keyed, judged, "__qb_url", urls.columns, judged.count(), "left").fillna(0, ["__qb_candidates"])
