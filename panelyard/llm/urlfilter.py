"""URL verdicts by rules and, without one, by boosted trees on lexical features; DataFrame operations only."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyard.llm.common import written

#: Labelled URLs that the trees are fitted on at most, taken by the hash of the URL.
MAX_LABELLED = 20_000
ROUNDS, DEPTH = 15, 4
#: Weight of the overall share in a suffix's share of blocked URLs.
PRIOR = 20.0
FEATURES = [
    "length", "host_length", "labels", "hyphens", "depth", "path_length", "longest_part", "digit_ratio", "entropy", "host_entropy", "parameters", "query_length",
    "has_fragment", "has_extension", "ends_in_slash", "is_plain", "suffix_share",
]


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """Host (A-Z lower-cased), path and the rest of a URL; all empty for null or without ``://``."""
    at = F.instr(url, "://")
    after = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    after = F.coalesce(after, F.lit(""))
    host = F.regexp_extract(after, "^[^/?#]*", 0)
    rest = F.substr(after, F.length(host) + 1)
    path = F.regexp_extract(rest, "^[^?#]*", 0)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path, F.substr(rest, F.length(path) + 1)


def matched_rule(rules: list[tuple[str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null without one.

    A rule (verdict, "host/path") fits its host and all subdomains when the
    path starts with the rule's. Of rules of one length the first given wins.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for word, text in reversed(sorted(rules, key=lambda r: -len(r[1]))):
        name, slash, tail = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + tail)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(word)).otherwise(verdict)
    return rule, verdict


def _entropy(text: Column) -> Column:
    """Bits per character."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.greatest(F.size(chars), F.lit(1))
    share = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / n)
    return F.aggregate(share, F.lit(0.0), lambda total, p: total - p * F.log2(p))


def _count(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def lexical(urls: DataFrame) -> DataFrame:
    """Adds the features that a URL's letters give; needs url, host, path and rest."""
    url, host, path, rest = F.coalesce("url", F.lit("")), F.col("host"), F.col("path"), F.col("rest")
    query = F.regexp_extract(rest, r"^\?([^#]*)", 1)
    digits = _count(url, "[0-9]")
    found = {
        "length": F.length(url), "host_length": F.length(host), "labels": F.size(F.split(host, r"\.")), "hyphens": _count(host, "-"), "depth": _count(path, "/"),
        "path_length": F.length(path), "longest_part": F.array_max(F.transform(F.split(path, "/"), F.length)), "digit_ratio": digits / F.greatest(F.length(url), F.lit(1)),
        "entropy": _entropy(url), "host_entropy": _entropy(host), "parameters": F.when(query == "", 0).otherwise(_count(query, "&") + 1), "query_length": F.length(query),
        "has_fragment": rest.contains("#"), "has_extension": path.rlike(r"\.[A-Za-z0-9]+$"), "ends_in_slash": path.endswith("/"), "is_plain": ~url.startswith("https"),
    }
    suffix = F.element_at(F.split(host, r"\."), -1)
    return urls.withColumns({k: v.cast("double") for k, v in found.items()} | {"suffix": suffix})


def labelled_urls(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Every row with its parts, lexical features, ``rule`` and ``ruled``, the rule's verdict."""
    host, path, rest = url_parts(F.col("url"))
    parts = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url")).withColumns({"host": host, "path": path, "rest": rest})
    rule, verdict = matched_rule(rules, F.col("host"), F.col("path"))
    return lexical(parts.withColumns({"rule": rule, "ruled": verdict}))


def fit_trees(labelled: DataFrame, max_labelled: int = MAX_LABELLED) -> Callable[[DataFrame], DataFrame]:
    """Trees fitted on labelled URLs of both kinds, as a function that adds ``chance`` to rows with features.

    A suffix whose labels are all of one kind would teach the trees its name
    only, so they are fitted on suffixes with both kinds, and on all where there
    is none. The blocked share per suffix is counted on a third of the hosts and
    the trees are fitted on the others; suffixes without such a count, or with one kind
    of label, have the overall share.
    """
    labelled = written(labelled.withColumn("counted", F.pmod(F.xxhash64("host"), F.lit(3)) == 0), "labelled")
    kinds = labelled.filter("not counted").groupBy("suffix").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    both = written(kinds.filter("low < high").select("suffix"), "both")
    rows = labelled.join(both, "suffix", "left_semi")
    one_kind = both.isEmpty()
    if one_kind:
        rows = labelled
    n, blocked = rows.agg(F.count(F.lit(1)), F.sum("label")).first()
    overall = blocked / n
    counted = rows.filter("counted").groupBy("suffix").agg(((F.sum("label") + PRIOR * overall) / (F.count(F.lit(1)) + PRIOR)).alias("suffix_share"))
    shares = written(counted.filter(F.lit(not one_kind)), "suffixes")

    def vectors(df: DataFrame) -> DataFrame:
        full = df.join(shares, "suffix", "left").withColumn("suffix_share", F.coalesce("suffix_share", F.lit(overall)))
        return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(full)

    fitted = rows if one_kind else rows.filter("not counted")
    sample = fitted.orderBy(F.xxhash64("url"), "page_id").limit(max_labelled)
    sample = written(vectors(sample).select("features", "label"), "sample")
    trees = GBTClassifier(maxIter=ROUNDS, maxDepth=DEPTH, stepSize=0.3, seed=7).fit(sample)
    return lambda df: trees.transform(vectors(df)).withColumn("chance", F.element_at(vector_to_array(F.col("probability")), 2))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """Every row with host, path, rule, verdict and, for rows without a rule, the trees' chance of ``block``.

    Rules are a short list; the URLs they cover are the labelled ones. The
    trees are fitted on ``max_labelled`` at most (see ``fit_trees``). When all
    labels agree their verdict is given, without any label ``allow``. Null URLs
    have an empty host and path and no rule. Every row gives one row; other
    columns are ignored.
    """
    rows = written(labelled_urls(pages, rules, id_col, url_col), "urls")
    labelled = rows.filter("rule is not null").withColumn("label", (F.col("ruled") == "block").cast("double"))
    # one row: how many labels there are of each kind
    n, blocked = labelled.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    out = [F.col("page_id").alias(id_col), "host", "path", "rule"]
    if not n or blocked in (0, n):
        only = "block" if n and blocked else "allow"
        return rows.select(*out, F.coalesce("ruled", F.lit(only)).alias("verdict"), F.when(F.col("rule").isNull(), F.lit(float(only == "block"))).alias("chance"))
    asked = fit_trees(labelled, max_labelled)(rows.filter("rule is null"))
    judged = asked.select(*out, F.when(F.col("prediction") == 1.0, "block").otherwise("allow").alias("verdict"), "chance")
    ruled = rows.filter("rule is not null").select(*out, F.col("ruled").alias("verdict"), F.lit(None).cast("double").alias("chance"))
    return ruled.unionByName(judged)
