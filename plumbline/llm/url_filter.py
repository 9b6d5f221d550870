"""URL filter: host and path rules, and boosted trees for what no rule covers.

Everything is DataFrame functions and Spark ML (JVM): no Python runs on the
executors. The rules label urls; gradient-boosted trees learn from lexical
features of a bounded sample of the labelled urls and judge the rest. The
features never read the rules: length, depth, digit ratio, entropy,
parameter counts and suffix statistics.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ascii_lower, materialize

#: (verdict, host and path prefix); the longest that fits decides.
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)

#: Most labelled urls that the trees are fitted on; the sample is by hash of the url.
MAX_TRAINING_URLS = 20_000

FEATURES = (
    "url_length", "host_length", "path_length", "query_length", "depth", "labels", "digit_ratio", "host_digit_ratio", "symbol_ratio",
    "entropy", "parameters", "has_fragment", "secure", "longest_segment", "suffix_share", "host_share",
)


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url; both empty for null or without ``://``.

    The host runs from the first ``://`` to the next ``/``, ``?``, ``#`` or
    the end, A-Z lower-cased; the path from there to ``?``, ``#`` or the end.
    """
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.coalesce(ascii_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls.

    A rule fits its host and all hosts below, if the path starts with its path.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: len(r[1])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(part / F.nullif(whole, F.lit(0)), F.lit(0.0)).cast("double")


def lexical(pages: DataFrame) -> DataFrame:
    """pages with url, host and path, and the features of FEATURES that the url alone gives."""
    url, host, path = F.coalesce("url", F.lit("")), F.col("host"), F.col("path")
    n = F.length(url)
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    marks = F.array_distinct(F.split(url, ""))
    count = lambda c: (n - F.length(F.replace(url, c, F.lit("")))).cast("double")
    entropy = F.aggregate(F.filter(marks, lambda c: c != ""), F.lit(0.0), lambda s, c: s - (count(c) / n) * F.log2(count(c) / n))
    return pages.select(
        "*",
        n.cast("double").alias("url_length"),
        F.length(host).cast("double").alias("host_length"),
        F.length(path).cast("double").alias("path_length"),
        F.length(query).cast("double").alias("query_length"),
        F.size(segments).cast("double").alias("depth"),
        F.size(F.split(host, r"\.")).cast("double").alias("labels"),
        _share(F.regexp_count(url, F.lit("[0-9]")), n).alias("digit_ratio"),
        _share(F.regexp_count(host, F.lit("[0-9]")), F.length(host)).alias("host_digit_ratio"),
        _share(F.regexp_count(url, F.lit("[^0-9A-Za-z]")), n).alias("symbol_ratio"),
        entropy.alias("entropy"),
        F.size(F.filter(F.split(query, "&"), lambda s: s != "")).cast("double").alias("parameters"),
        url.contains("#").cast("double").alias("has_fragment"),
        url.startswith("https").cast("double").alias("secure"),
        F.coalesce(F.array_max(F.transform(segments, lambda s: F.length(s))), F.lit(0)).cast("double").alias("longest_segment"),
        F.element_at(F.split(host, r"\."), -1).alias("suffix"),
    )


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, max_training: int = MAX_TRAINING_URLS) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for every row of pages.

    verdict is the rule's; without a rule it is block where the trees' score
    (the probability of block) is at least 0.5. Where the labelled urls hold
    fewer than two verdicts, as in an empty or tiny table, nothing can be
    learned: urls without a rule then get the only verdict there is, or allow.
    A null url has empty host and path, no rule, and is scored as empty text.
    Repeated rows are judged alike; other columns are not read.
    """
    url = F.col("url").cast("string")
    host, path = split_url(url)
    base = pages.select("page_id", url.alias("url"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    base = lexical(base.withColumn("rule", rule).withColumn("ruled", verdict))

    hosts = base.groupBy("suffix", "host").agg(F.count(F.lit(1)).alias("host_pages"))
    suffixes = hosts.groupBy("suffix").agg(F.sum("host_pages").alias("suffix_pages"), F.count(F.lit(1)).alias("suffix_hosts"))
    stats = hosts.join(suffixes, "suffix").select(
        "host",
        F.log1p("suffix_pages").alias("suffix_share"),
        (F.col("host_pages") / F.col("suffix_pages")).alias("host_share"),
    )
    known = materialize(base.join(stats, "host", "left"), "urls")

    labelled = known.where("ruled IS NOT NULL").withColumn("label", (F.col("ruled") == "block").cast("double"))
    sample = labelled.orderBy(F.xxhash64("url"), "url", "page_id").limit(max_training)
    sample = materialize(sample.select("label", *FEATURES), "url-sample")
    labels = sorted(row[0] for row in sample.groupBy("label").count().collect())
    if len(labels) == 2:
        gather = VectorAssembler(inputCols=list(FEATURES), outputCol="vector")
        trees = GBTClassifier(featuresCol="vector", labelCol="label", maxDepth=4, maxIter=10, stepSize=0.3, seed=7, cacheNodeIds=False)
        model = trees.fit(gather.transform(sample).repartition(1))
        scored = model.transform(gather.transform(known)).withColumn("score", vector_to_array("probability")[1])
    else:
        scored = known.withColumn("score", F.lit(labels[0] if labels else 0.0))
    said = F.coalesce("ruled", F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", said.alias("verdict"), "score")
