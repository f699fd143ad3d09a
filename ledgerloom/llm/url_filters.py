"""URL rules found through their rarest literal token (operator 6).

A rule names a host and the beginning of a path, and fits that host and its subdomains. Each rule is indexed by
the rarest of its literal tokens (host labels and whole path segments), by their count over all URLs. A URL's
tokens fetch candidate rules, and only those run their regular expression; the longest that fits decides.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import lower_ascii, table
from ledgerloom.session import durable

#: The rules of the contract (rule, verdict).
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
#: What a URL without a fitting rule gets.
DEFAULT = "allow"
#: Up to so many rules the index is a constant inside the plan; a larger one is joined.
SMALL = 64


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = lower_ascii(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_rows(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """rule, action, tokens, pattern. The pattern is for the host with the path behind it."""
    rows = []
    for rule, action in dict(rules).items():
        host, slash, path = rule.partition("/")
        # a last segment without a slash behind it may go on in the URL, so it is no whole token
        tokens = [*host.split("."), *path.split("/")[:-1]]
        end = "" if slash else r"(?=/|\z)"
        rows.append((rule, action, [t for t in dict.fromkeys(tokens) if t], rf"(?s)^(?:[^/]*\.)?{re.escape(rule)}{end}"))
    return spark.createDataFrame(rows, "rule string, action string, tokens array<string>, pattern string")


def judged(urls: DataFrame, rules: list[tuple[str, str]], default: str = DEFAULT) -> DataFrame:
    """urls (page_id, url) to page_id, host, path, rule, verdict. Null and repeated ids keep their rows.

    ``rules`` pairs a host and path prefix (``host/path``) with allow or block. Of equally long rules that fit, the
    first in alphabetical order decides. URLs are not shuffled unless there are more than ``SMALL`` rules.
    """
    host, path = url_parts(F.col("url"))
    parsed = urls.select("page_id", host.alias("host"), path.alias("path"))
    tokens = F.array_distinct(F.split(F.concat(F.translate("host", ".", "/"), "path"), "/"))
    given = rule_rows(urls.sparkSession, rules)
    literal = given.select(F.explode("tokens").alias("token")).distinct()
    seen = parsed.select(F.explode(tokens).alias("token")).join(literal, "token").groupBy("token").agg(F.count("*").alias("n"))
    spread = given.select("*", F.explode("tokens").alias("token")).join(seen, "token", "left")
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).getField("token").alias("token")
    index = durable(spread.groupBy("rule", "action", "pattern").agg(rarest), "index")
    entry = F.struct((-F.length("rule")).alias("order"), "rule", "action", "pattern")
    by_token = index.groupBy("token").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    if len(rules) <= SMALL:
        found = parsed.withColumn("found", constant_lookup(tokens, by_token.collect()))
    else:
        # only the few tokens that index a rule come back to their URL
        one = F.struct("page_id", "host", "path")
        urls_once = parsed.select(one.alias("row")).groupBy("row").agg(F.count("*").alias("copies")).select("row", "copies", "row.*")
        hits = urls_once.select("row", F.explode(tokens).alias("token")).join(by_token, "token").groupBy("row").agg(F.flatten(F.collect_list("entries")).alias("found"))
        found = urls_once.join(hits, "row", "left").select("page_id", "host", "path", "found", F.explode(F.sequence(F.lit(1), "copies")))
    text = F.concat("host", "path")
    fits = F.array_sort(F.filter("found", lambda e: F.regexp_like(text, e["pattern"])))
    return found.select("page_id", "host", "path", F.try_element_at(fits, F.lit(1)).alias("best")).select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict")
    )


def constant_lookup(tokens: Column, rows: list) -> Column:
    """Entries of all ``tokens`` that index a rule, from a constant map."""
    entries = {
        r["token"]: F.array(*[F.struct(F.lit(e["order"]).alias("order"), *[F.lit(e[c]).alias(c) for c in ("rule", "action", "pattern")]) for e in r["entries"]])
        for r in rows
    }
    index = F.create_map(*[x for token, found in entries.items() for x in (F.lit(token), found)])
    return F.flatten(F.transform(F.filter(tokens, lambda t: t.isin(list(entries))), lambda t: index[t]))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"), RULES)


ORACLE = """
WITH r AS (SELECT page_id, regexp_extract(url, '(?s)^.*?://(.*)$', 1) AS rest FROM pages),
p AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
        coalesce(regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1), '') AS path FROM r),
m AS (SELECT *, CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
                     WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
                     WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
                     WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM p)
SELECT *, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM m
"""
