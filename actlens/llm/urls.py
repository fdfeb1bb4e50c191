"""URL filtering by pattern rules indexed by their rarest literal token.

A rule is a regular expression over ``host + path`` together with the literal
tokens that every match must contain whole. Each rule is stored under the one
of its tokens that the fewest URLs contain; the tokens of a URL fetch the rules
stored under them, and only those rules run their expression on that URL. A
rule without a literal token is stored under the empty token, which every URL
has. All of it is DataFrame code. Rules are a table (``site_rules`` and
``word_rules`` make one from a list of sites or words of any length); a short
list may also be given as a tuple of ``Rule``.

Defined cases: a null URL, or one without ``://``, has an empty host and path
and fits no rule; repeated URLs are judged once and joined back; an empty table
gives an empty result; extra columns are ignored. Of the rules, one without
name or expression fits nothing, null tokens are skipped, a null kind is
``pattern``, names and whole rules may repeat (of two actions under one site name
``block`` wins), and an empty table allows everything.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from actlens.llm.common import small_or_none

MAX_BROADCAST_RULES = 100_000


@dataclass(frozen=True)
class Rule:
    """``site`` rules are named after their host and path and win by length;
    ``pattern`` rules decide where no site rule fits (block before allow)."""

    name: str
    regex: str
    tokens: tuple[str, ...]
    action: str
    kind: str = "pattern"


def site_rule(host: str, path: str, action: str) -> Rule:
    """A rule for a host, its subdomains and a path prefix."""
    regex = rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}"
    tokens = [t for t in host.split(".") if re.fullmatch("[A-Za-z0-9]+", t)]
    # a path token counts only if the prefix also holds the separator after it
    tokens += re.findall(r"(?<![A-Za-z0-9])[A-Za-z0-9]+(?=[^A-Za-z0-9])", path)
    return Rule(host + path, regex, tuple(tokens), action, "site")


def word_rule(word: str, action: str = "block") -> Rule:
    """A rule for a word (or words joined by hyphens) of the host or path."""
    regex = rf"(?:^|[^A-Za-z0-9]){re.escape(word)}(?:[^A-Za-z0-9]|$)"
    return Rule(f"word:{word}", regex, tuple(re.findall("[A-Za-z0-9]+", word)), action)


#: fixed site rules of the contract
SITE_RULES = (site_rule("com", "/", "allow"), site_rule("example.com", "/en/", "block"),
              site_rule("www.example.com", "/en/", "allow"), site_rule("net", "/es/", "block"),
              site_rule("net", "/fr/", "block"))
#: words of unwanted sites
BLOCKED_WORDS = ("casino", "bets", "betting", "poker", "pills", "pharmacy", "viagra", "spam", "porn",
                 "xxx", "escort", "warez", "malware", "phishing", "payday", "free-bets", "spam-farm")
DEFAULT_RULES = SITE_RULES + tuple(word_rule(w) for w in BLOCKED_WORDS)


def url_host(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)", 2)


def rule_table(spark: SparkSession, rules: tuple[Rule, ...]) -> DataFrame:
    rows = [F.struct(F.lit(r.name).alias("rule"), F.lit(r.regex).alias("regex"),
                     F.array(*[F.lit(t) for t in r.tokens or ("",)]).alias("tokens"),
                     F.lit(r.action).alias("action"), F.lit(r.kind).alias("kind")) for r in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


def _escaped(literal: Column) -> Column:
    return F.regexp_replace(literal, r"([^A-Za-z0-9])", r"\\$1")


def site_rules(sites: DataFrame) -> DataFrame:
    """The rule table of (host, path, action) rows; the same rules as ``site_rule``."""
    host, path = F.col("host"), F.coalesce("path", F.lit("/"))
    tokens = F.concat(F.filter(F.split(host, r"\."), lambda t: t.rlike("^[A-Za-z0-9]+$")),
                      F.regexp_extract_all(path, F.lit("(?<![A-Za-z0-9])([A-Za-z0-9]+)(?=[^A-Za-z0-9])"), F.lit(1)))
    return sites.select(F.concat(host, path).alias("rule"),
                        F.concat(F.lit(r"^(?:[^/]*\.)?"), _escaped(host), _escaped(path)).alias("regex"),
                        tokens.alias("tokens"), "action", F.lit("site").alias("kind"))


def word_rules(words: DataFrame) -> DataFrame:
    """The rule table of (word, action) rows; the same rules as ``word_rule``."""
    word = F.col("word")
    return words.select(F.concat(F.lit("word:"), word).alias("rule"),
                        F.concat(F.lit("(?:^|[^A-Za-z0-9])"), _escaped(word), F.lit("(?:[^A-Za-z0-9]|$)")).alias("regex"),
                        F.regexp_extract_all(word, F.lit("([A-Za-z0-9]+)"), F.lit(1)).alias("tokens"),
                        "action", F.lit("pattern").alias("kind"))


def _usable(rules: DataFrame) -> DataFrame:
    """Distinct usable rules; a rule without a literal token has the empty one."""
    literal = F.array_sort(F.array_distinct(F.filter(F.coalesce("tokens", F.array().cast("array<string>")),
                                                     lambda t: t.isNotNull())))
    return (rules.filter("rule is not null and regex is not null")
            .select("rule", "regex", F.when(F.size(literal) > 0, literal).otherwise(F.array(F.lit(""))).alias("tokens"),
                    "action", F.coalesce("kind", F.lit("pattern")).alias("kind")).distinct())


def rarest_tokens(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Each rule with the token that the fewest URLs hold (ties: the smaller)."""
    listed = rules.select("rule", "regex", "tokens", F.explode("tokens").alias("token")).distinct()
    wanted = listed.select("token").distinct()
    seen = (urls.select(F.explode("tokens").alias("token"))
            .join(small_or_none(wanted, MAX_BROADCAST_RULES), "token")
            .groupBy("token").agg(F.count("*").alias("n")))
    best = Window.partitionBy("rule", "regex", "tokens").orderBy("n", "token")
    picked = (listed.join(seen, "token", "left").withColumn("n", F.coalesce("n", F.lit(0)))
              .withColumn("at", F.row_number().over(best)).filter("at = 1")
              .select("rule", "regex", "tokens", "token"))
    return rules.join(picked, ["rule", "regex", "tokens"]).drop("tokens")


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] | DataFrame = DEFAULT_RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, pattern (the pattern rule that decided, else null).

    ``rules``: a tuple, or a table (rule, regex, tokens, action, kind)."""
    rules = _usable(rules if isinstance(rules, DataFrame) else rule_table(pages.sparkSession, rules))
    text = F.concat("host", "path")
    urls = (pages.groupBy("url").agg(F.lit(1).alias("one"))
            .select("url", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
            .withColumn("tokens", F.array_distinct(F.concat(
                F.split(text, "[^A-Za-z0-9]+"), F.array(F.lit(""))))))
    index = rarest_tokens(urls, rules)
    fits = (urls.select("url", "host", "path", F.explode("tokens").alias("token"))
            .join(small_or_none(index, MAX_BROADCAST_RULES), "token")
            .filter(F.rlike(text, F.col("regex"))))
    site = F.when(F.col("kind") == "site", F.struct(
        F.length("rule").alias("len"), F.col("rule"), F.col("action")))
    word = F.when(F.col("kind") == "pattern", F.struct(
        (F.col("action") == "block").alias("block"), F.col("rule"), F.col("action")))
    found = fits.groupBy("url").agg(F.max(site).alias("site"), F.max(word).alias("word"))
    return (pages.select("page_id", "url").join(
                found.withColumnRenamed("url", "_url"), F.col("url") == F.col("_url"), "left")
            .select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"),
                    F.col("site.rule").alias("rule"),
                    F.coalesce("site.action", "word.action", F.lit("allow")).alias("verdict"),
                    F.when(F.col("site").isNull(), F.col("word.rule")).alias("pattern")))
