"""URL filters: fixed host and path rules first, mined association rules for the rest.

A URL is a set of tokens: scheme, all labels of its host, all segments of its path, the ending of the file name,
all names of query parameters. Pages that a fixed rule decides are the labelled rows; rules are single tokens and,
by FP-growth, token sets that go with a label. Of a URL of any length FP-growth sees all frequent tokens but those that
can't change a rule: tokens that are on the same labelled rows stand for each other, one that all rows have adds nothing
to a set, nor does any to one that is sure by itself. Rules are pruned by support, confidence, and by
simpler rules that are as sure. A rule is filed under its rarest token, so a URL meets only rules that hold one of
its own tokens; of those it holds entirely the surest decides. A URL that none fits is allowed.

Everything runs on DataFrame functions and Spark's own FP-growth.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill.llm._shared import BROADCAST_ROWS, joined, written

#: Verdict, host and path of the rules.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
MAX_LABELLED = 200_000  # labelled rows that are mined; more are drawn from by a hash of the id
SUPPORT = 0.005
CONFIDENCE = 0.9
DEFAULT = "allow"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both are empty if url is null or has no ://."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, url.substr(at + F.lit(3), F.length(url))), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (null if none does), and its verdict."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a URL, in order; numbers stand for each other."""
    plain = lambda x: F.regexp_replace(x, r"[0-9]+", "0")
    labels = F.split(host, r"\.")
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    ending = F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^?#]*\?([^#]*)", 1)
    names = F.transform(F.filter(F.split(query, "&"), lambda s: s != ""), lambda s: F.substring_index(s, "=", 1))
    every = F.concat(
        F.array(F.concat(F.lit("scheme:"), F.regexp_extract(F.coalesce(url, F.lit("")), r"^([A-Za-z]*)://", 1))),
        F.transform(labels, lambda s: F.concat(F.lit("host:"), plain(s))),
        F.transform(segments, lambda s: F.concat(F.lit("path:"), plain(s))),
        F.array(F.concat(F.lit("ending:"), F.lower(ending)), F.when(url.contains("#"), F.lit("fragment")).otherwise(F.lit("no fragment"))),
        F.transform(names, lambda s: F.concat(F.lit("query:"), plain(s))),
    )
    return F.array_sort(F.array_distinct(every))


def met(sets: DataFrame, rules: DataFrame, alike: DataFrame) -> DataFrame:
    """sets: key, tokens; rules: antecedent, token, the rarest of it, and more -> key and rule of all that a rule fits. alike: t and the token that stands for it."""
    used = rules.select(F.explode("antecedent").alias("token")).distinct()  # frequent tokens, which are at most a row's tokens over SUPPORT
    each = sets.select("key", F.explode("tokens").alias("t")).join(F.broadcast(alike), "t", "left").select("key", F.coalesce("standing", "t").alias("token"))
    held = each.join(F.broadcast(used), "token").groupBy("key").agg(F.collect_set("token").alias("held"))
    few = rules.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    fits = held.select("key", "held", F.explode("held").alias("token")).join(F.broadcast(rules) if few else rules, "token")
    return fits.where(F.size(F.array_except("antecedent", "held")) == 0).drop("held")


def with_rarest(rules: DataFrame, counts: DataFrame) -> DataFrame:
    """rules with token, the rarest of the antecedent by counts (t, freq)."""
    each = rules.select(*rules.columns, F.explode("antecedent").alias("t")).join(counts.select("t", "freq"), "t")
    return each.groupBy(*rules.columns).agg(F.min_by("t", F.struct("freq", "t")).alias("token"))


def mined(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> tuple[DataFrame, DataFrame]:
    """labelled: key, tokens, verdict -> rules: antecedent, verdict, confidence, support and token, the rarest of the antecedent; and alike: t, standing.

    Tokens on the same rows are alike: the first of them stands for all, in rules as in the sets that these are tried on.
    """
    n = labelled.count()
    least = max(1, math.ceil(support * n))
    sums = [F.sum(F.xxhash64("key", F.lit(k)).cast("decimal(38,0)")).alias(f"s{k}") for k in range(2)]  # tell sets of rows apart
    by = written(labelled.select("key", "verdict", F.explode("tokens").alias("t")).groupBy("t", "verdict").agg(F.count("*").alias("hits"), *sums))
    counts = by.groupBy("t").agg(F.sum("hits").alias("freq"), F.max("hits").alias("most"), F.sum("s0").alias("s0"), F.sum("s1").alias("s1")).where(F.col("freq") >= least)
    standing = F.min("t").over(Window.partitionBy("s0", "s1", "freq"))
    counts = written(counts.select("t", "freq", "most", standing.alias("standing")))
    own = counts.where("t = standing")
    sure = (F.col("hits") >= least) & (F.col("hits") / F.col("freq") >= confidence)
    fields = (F.col("verdict"), (F.col("hits") / F.col("freq")).alias("confidence"), (F.col("hits") / F.lit(n)).alias("support"))
    single = by.select("t", "verdict", "hits").join(own, "t").where(sure).select(F.array("t").alias("antecedent"), *fields)
    open_ = own.where((F.col("most") < F.col("freq")) & (F.col("freq") < n)).select("t", F.lit(True).alias("open"))
    numbered = labelled.select(F.monotonically_increasing_id().alias("row"), "verdict", "tokens")  # before rows are made of tokens
    each = numbered.select("row", "verdict", F.explode_outer("tokens").alias("t")).join(F.broadcast(open_), "t", "left")
    items = each.groupBy("row", "verdict").agg(F.collect_set(F.when(F.col("open"), F.col("t"))).alias("seen"))
    items = items.select(F.concat("seen", F.array(F.concat(F.lit("="), F.col("verdict")))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(items)
    rules = model.associationRules.where(F.col("consequent")[0].startswith("=") & ~F.exists("antecedent", lambda t: t.startswith("=")) & (F.size("antecedent") > 1))
    rules = rules.select(F.array_sort("antecedent").alias("antecedent"), F.substring(F.col("consequent")[0], 2, 9).alias("verdict"), "confidence", "support")
    rules = written(single.unionByName(rules))
    # A rule that a simpler one with the same verdict, as sure, makes needless: the simpler one lacks one token.
    shorter = rules.select(F.col("antecedent").alias("shorter"), "verdict", F.col("confidence").alias("sure"))
    without = rules.where(F.size("antecedent") > 1).select("antecedent", "verdict", "confidence", F.explode("antecedent").alias("t"))
    without = without.withColumn("shorter", F.array_except("antecedent", F.array("t")))
    needless = without.join(shorter, ["shorter", "verdict"]).where("sure >= confidence").select("antecedent", "verdict").distinct()
    rules = rules.join(needless, ["antecedent", "verdict"], "left_anti")
    return with_rarest(rules, counts), counts.where("t <> standing").select("t", "standing")


def decided(sets: DataFrame, rules: DataFrame, alike: DataFrame) -> DataFrame:
    """sets (key, tokens) -> key and verdict of those that a rule fits: the surest rule's, then the best supported, then the first by its tokens."""
    rank = F.struct("confidence", "support", F.size("antecedent"), F.array_join("antecedent", " "))
    return met(sets, rules, alike).groupBy("key").agg(F.max_by("verdict", rank).alias("mined"))


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of pages (page_id, url). Repeated rows and null ids stay."""
    url = F.col("url")
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"))
    host, path = host_and_path(url)
    rows = rows.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), tokens(url, F.col("host"), F.col("path")).alias("tokens"))
    rows = written(rows.withColumn("key", F.sha2(F.to_json("tokens"), 256)))
    labelled = rows.where("ruled is not null").select("page_id", "key", "tokens", F.col("ruled").alias("verdict"))
    n = labelled.count()
    if not n:
        return rows.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.lit(DEFAULT)).alias("verdict"))
    drawn = F.pmod(F.xxhash64("page_id", "tokens", F.lit("mine")), F.lit(1 << 30)) < int(min(1.0, MAX_LABELLED / n) * (1 << 30))
    found = written(decided(rows.where("ruled is null").select("key", "tokens").dropDuplicates(["key"]), *mined(labelled.where(drawn))))
    return joined(rows, found, "key", "left").select("page_id", "host", "path", "rule", F.coalesce("ruled", "mined", F.lit(DEFAULT)).alias("verdict"))


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of all pages.

    A null url, or one without ://, has empty host and path, and the verdict of its tokens. Repeated rows and null ids
    give a row each; columns beyond page_id and url, whatever their names, are ignored. Of mined rules that tie the first
    by its tokens decides. Urls of any length are read whole; an empty table gives no rows.
    """
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op10_urls": op10_urls}
ORACLES: dict[str, str] = {}
