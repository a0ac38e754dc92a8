"""URL filter: host and path rules first, else gradient-boosted trees on lexical features.

Features: lengths of url, host and path, depth, digit ratio, character entropy, number of parameters, labels of the host,
and the block rate of the host's last label and last two labels among the training urls. The trees are Spark ML's, fitted
on at most `TRAIN_ROWS` labelled urls, the smallest by a hash of the url; all urls are judged, in Spark expressions.

Nulls and urls without `://` have an empty host and path, and features of an empty text. Repeated urls are judged alike,
row by row. With labels of one kind only, or none, there are no trees and urls without a rule are allowed. An empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codewarden.llm.common import bind, stored

TRAIN_ROWS, TREES, DEPTH, PRIOR = 20_000, 15, 4, 5
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
FEATURES = ("url_chars", "host_chars", "path_chars", "labels", "depth", "digits", "entropy", "params", "rate1", "rate2")


def parts(pages: DataFrame) -> DataFrame:
    """page_id, url, host and path: the text after the first `://`."""
    rest = F.when(F.contains("url", F.lit("://")), F.regexp_extract("url", r"(?s)^.*?://(.*)$", 1)).otherwise("")
    host = F.translate(F.regexp_extract("rest", r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract("rest", r"^[^/?#]*([^?#]*)", 1)
    return (pages.select("page_id", "url", F.coalesce(rest, F.lit("")).alias("rest"))
            .select("page_id", "url", host.alias("host"), path.alias("path")))


def ruled(urls: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """With `rule` and its `verdict`: the longest rule that fits, or null."""
    rule = verdict = F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        host, _, path = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith("/" + path)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return urls.withColumns({"rule": rule, "verdict": verdict})


def _entropy(text: Column) -> Column:
    """Bits per character, from the lengths of the runs of the sorted characters."""
    def bits(chars: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(chars) - 1),
                         lambda i: F.coalesce(F.get(chars, i - 1) != F.get(chars, i), F.lit(True)))
        return bind(first, lambda f: F.aggregate(F.transform(f, lambda at, k: (
            F.coalesce(F.get(f, k + 1), F.size(chars)) - at) / F.size(chars)), F.lit(0.0), lambda a, p: a - p * F.log2(p)))

    return F.when(F.length(text) > 0, bind(F.sort_array(F.split(text, "")), bits)).otherwise(0.0)


def features(urls: DataFrame) -> DataFrame:
    url = F.coalesce("url", F.lit(""))
    digits = F.length(url) - F.length(F.translate(url, "0123456789", ""))
    label = F.split("host", r"\.")
    return urls.withColumns({
        "url_chars": F.length(url), "host_chars": F.length("host"), "path_chars": F.length("path"), "labels": F.size(label),
        "depth": F.regexp_count("path", F.lit("/[^/]")), "digits": digits / F.greatest(F.length(url), F.lit(1)),
        "entropy": _entropy(url), "params": F.regexp_count(url, F.lit("[?&][^=&#]*=")),
        "suffix1": F.element_at(label, -1), "suffix2": F.array_join(F.slice(label, F.greatest(F.size(label) - 1, F.lit(1)), 2), ".")})


def rates(train: DataFrame, suffix: str, to: str, mean: float) -> DataFrame:
    """Block rate per suffix, drawn to the mean of all by `PRIOR` urls; at most as many rows as training urls."""
    return train.groupBy(suffix).agg(((F.sum("label") + PRIOR * mean) / (F.count("*") + PRIOR)).alias(to))


def judge(pages: DataFrame, labelled: DataFrame | None = None, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and the trees' block probability.

    `labelled` (url, label 1 for block) trains the trees; without it the urls that a rule decides do, under its verdict.
    """
    urls = stored(features(ruled(parts(pages), rules)), "urls")
    if labelled is None:
        train = urls.where("rule is not null").withColumn("label", (F.col("verdict") == "block").cast("double"))
    else:
        train = features(parts(labelled.select(F.col("label").cast("double").alias("page_id"), "url"))
                         .withColumnRenamed("page_id", "label")).where("label is not null")
    train = stored(train.orderBy(F.xxhash64("url"), "url").limit(TRAIN_ROWS), "train")
    mean, kinds = train.agg(F.avg("label"), F.count_distinct("label")).first()
    if kinds < 2:
        return urls.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"),
                           F.lit(None).cast("double").alias("block_probability"))
    one, two = rates(train, "suffix1", "rate1", mean), rates(train, "suffix2", "rate2", mean)
    one, two = stored(one, "suffix"), stored(two, "suffix")

    def full(rows: DataFrame) -> DataFrame:
        rows = rows.join(F.broadcast(one), "suffix1", "left").join(F.broadcast(two), "suffix2", "left").fillna(mean, ["rate1", "rate2"])
        return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)

    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=17, featuresCol="features", labelCol="label").fit(full(train))
    scored = model.transform(full(urls)).withColumn("block_probability", vector_to_array("probability")[1])
    learned = F.when(F.col("block_probability") >= 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("verdict", learned).alias("verdict"), "block_probability")
