"""URL filters: rules first, then naive Bayes over words segmented out of host names.

* `split` takes host and path from a url; `ruled` finds the longest fitting rule.
* Host names run words together.  `segmented` splits a label into words by a unigram Viterbi
  over a lexicon, all words of the pages' own text with their counts; a stretch outside the
  lexicon is charged by its length.  The lexicon is a table: each distinct label's substrings
  meet it in a join, and only those found go to the label's Viterbi.
* A multinomial naive Bayes model over host words and path tokens is fitted on the urls that
  a rule decides, with their verdicts, and judges all others.  The model is a table of all
  tokens.  The `TOKENS` most frequent, which may be hot, meet the urls' tokens in a broadcast
  join, all others in a join by token; a url's weights are summed.

Each distinct label is segmented once, and each distinct host and path judged once, wherever
most of the pages come from.

Defined results: a null url or one without "://" has empty host and path, fits no rule and,
without tokens, gets the likelier class; with no ruled urls everything is allowed; log-odds of
exactly 0 allow; repeated rows get equal results; of segmentations that tie the one with the
longest last word is taken; labels of more than `LONGEST_LABEL` letters, which no host name has,
stay whole; other columns are ignored; an empty table gives no rows; urls and pages of any
length are read whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import materialise, table

# The rules, in order: (verdict, host, path), fixed values.
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
#: Tokens of the class model that are broadcast.
TOKENS = 100_000
LONGEST_LABEL = 63


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule as text, and its verdict; both null if none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, what).otherwise(verdict)
    return name, verdict


def lexicon(pages: DataFrame) -> DataFrame:
    """(word, n) of all pages' text."""
    text = F.regexp_replace(F.coalesce("html", F.lit("")), r"(?s)<[^>]*>", " ")
    words = pages.select(F.explode(F.split(F.lower(text), r"[^\p{L}]+")).alias("word")).where("word <> ''")
    return materialise(words.groupBy("word").agg(F.count("*").alias("n")))


def segment(label: str, shares: dict[str, float], total: int) -> list[str]:
    """The words of a label, by unigram Viterbi over the log10 shares of its substrings in the lexicon; other stretches are charged by their length."""
    unknown = -math.log10(max(total, 1)) - 1.0
    best: list[tuple[float, int]] = [(0.0, 0)]
    for i in range(1, len(label) + 1):
        best.append(max((best[j][0] + shares.get(label[j:i], unknown - 0.8 * (i - j)), -j) for j in range(i)))
    words, i = [], len(label)
    while i:
        words.append(label[-best[i][1] : i])
        i = -best[i][1]
    return words[::-1]


def segmented(labels: DataFrame, words: DataFrame) -> DataFrame:
    """(label, words) for distinct labels."""
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    size = F.length("label")
    parts = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), size), lambda i: F.transform(F.sequence(F.lit(1), size - i + 1), lambda n: F.substring(F.col("label"), i, n)))))
    short = labels.where(size <= LONGEST_LABEL).select("label", F.explode(parts).alias("word"))
    found = short.join(words, "word").groupBy("label").agg(F.collect_list("word").alias("found"), F.collect_list("n").alias("n"))  # at most 63 * 64 / 2

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for label, found, n in zip(batch["label"], batch["found"], batch["n"]):
                shares = {w: math.log10(c / total) for w, c in zip(found, n)} if found is not None else {}
                out.append(segment(label, shares, total) if len(label) <= LONGEST_LABEL else [label])
            yield pd.DataFrame({"label": batch["label"], "words": out})

    return labels.join(found, "label", "left").mapInPandas(split, "label string, words array<string>")


def host_words(hosts: DataFrame, words: DataFrame) -> DataFrame:
    """host, words: each distinct host's labels, segmented; labels' order is kept, and numbers are one token."""
    parts = hosts.select("host").distinct().select("host", F.posexplode(F.regexp_extract_all("host", F.lit(r"\p{L}+|\p{N}+"), 0)).alias("pos", "label"))
    labels = materialise(segmented(parts.where(F.col("label").rlike(r"^\p{L}")).select("label").distinct(), words))
    each = parts.join(labels, "label", "left").withColumn("words", F.coalesce("words", F.array(F.lit("#"))))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "words")))
    return each.groupBy("host").agg(F.flatten(F.transform(ordered, lambda x: x["words"])).alias("words"))


def path_tokens(path: Column) -> Column:
    """Lower-case words of the path; numbers as one token."""
    parts = F.filter(F.split(F.lower(path), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    return F.transform(parts, lambda x: F.concat(F.lit("/"), F.when(x.rlike(r"^\d+$"), "#").otherwise(x)))


def class_model(seen: DataFrame) -> DataFrame:
    """(token, n, w) of all tokens of the decided urls: how often, and the log-odds of blocking."""
    each = seen.select("decided", F.explode("tokens").alias("token")).groupBy("token").agg(F.count_if(F.col("decided") == "block").alias("b"), F.count_if(F.col("decided") == "allow").alias("a"))
    each = materialise(each)
    totals = each.agg(F.coalesce(F.sum("b"), F.lit(0)).alias("b"), F.coalesce(F.sum("a"), F.lit(0)).alias("a"), F.count("*").alias("v")).first()
    odds = F.log((F.col("b") + 1) / (totals.b + totals.v + 1)) - F.log((F.col("a") + 1) / (totals.a + totals.v + 1))
    return each.select("token", (F.col("b") + F.col("a")).alias("n"), odds.alias("w"))


def judged(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """Every row: page_id, host, path, rule, verdict, block_log_odds, words."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, decided = ruled(F.col("host"), F.col("path"), rules)
    urls = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("rule", rule).withColumn("decided", decided)
    words = materialise(host_words(urls, lexicon(pages)))
    tokens = materialise(urls.join(words, "host", "left").withColumn("tokens", F.concat(F.coalesce("words", F.array().cast("array<string>")), path_tokens(F.col("path")))))
    seen = tokens.where("decided is not null")
    sizes = {r.decided: r["count"] for r in seen.groupBy("decided").count().collect()}
    block, allow = sizes.get("block", 0), sizes.get("allow", 0)
    prior = math.log((block + 1) / (allow + 1)) if block or allow else -1.0
    weights = class_model(seen)
    frequent = F.broadcast(weights.orderBy(F.desc("n"), "token").limit(TOKENS).select("token", "w"))
    asked = materialise(tokens.select("host", "path", "tokens").dropDuplicates(["host", "path"]).select("host", "path", F.explode("tokens").alias("token")))
    rest = asked.join(frequent.select("token"), "token", "left_anti").join(weights.select("token", "w"), "token")
    odds = asked.join(frequent, "token").unionByName(rest).groupBy("host", "path").agg(F.sum("w").alias("odds"))
    scored = tokens.join(odds, ["host", "path"], "left").withColumn("block_log_odds", F.lit(prior) + F.coalesce("odds", F.lit(0.0)))
    verdict = F.coalesce("decided", F.when(F.col("block_log_odds") > 0, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "block_log_odds", "words")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "block_log_odds")
