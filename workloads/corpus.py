"""Files, commands and replies derived from the given tables.

Every row of ``documents`` and ``pages`` becomes one file: a planted fragment
with the whole document around it, or the whole page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codewarden.functions.text import quoted
from workloads.snippets import COMMANDS, GUIDANCE_REPLIES, SCORE_REPLIES, SNIPPETS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values, key: str) -> Column:
    """The value whose position is ``key`` modulo the number of values."""
    items = ", ".join("CAST(NULL AS STRING)" if v is None else quoted(v) for v in values)
    return F.expr(f"element_at(array({items}), CAST({key} % {len(values)} AS INT) + 1)")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("doc_id")
    folder = (F.when(doc % 29 == 0, "node_modules/pkg/").when(doc % 31 == 0, ".hidden/")
              .when(doc % 37 == 0, ".github/workflows/").otherwise("src/"))
    body = pick([s[1] for s in SNIPPETS], "doc_id")
    planted = F.when(doc % 2 == 0, F.concat(body, F.lit("\n"), F.col("text"))).otherwise(
        F.concat(F.col("text"), F.lit("\n"), body))
    docs = table(spark, sf_dir, "documents").select(
        F.concat(folder, F.col("source"), F.lit("/doc_"), doc.cast("string"),
                 pick([s[0] for s in SNIPPETS], "doc_id")).alias("file_path"),
        planted.alias("code"))
    pages = table(spark, sf_dir, "pages").select(
        F.concat(F.lit("web/page_"), F.col("page_id").cast("string"), F.lit(".html")).alias("file_path"),
        F.col("html").alias("code"))
    return docs.unionByName(pages).withColumn("size_bytes", F.octet_length("code").cast("long"))


def saves(events: DataFrame) -> DataFrame:
    """A file per event, saved at the event's time in the user's folder; streams and tables alike."""
    return events.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("folder"), F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("/e"), F.col("event_id").cast("string"),
                 pick([s[0] for s in SNIPPETS], "event_id")).alias("file_path"),
        F.concat(pick([s[1] for s in SNIPPETS], "event_id"), F.lit("\n// "), F.col("event_type")).alias("code"))


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A command per document, with the whole text as its last argument."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("cmd_id"),
        F.concat(pick(COMMANDS, "doc_id"), F.lit(" # "), F.col("text")).alias("command"))


def _with_number(reply: Column) -> Column:
    number = F.concat(F.lit("0."), (F.col("size_bytes") % 90 + 10).cast("string"))
    return F.replace(reply, F.lit("%s"), number)


def score_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of up to three providers for each file."""
    base = files(spark, sf_dir).select("file_path", "size_bytes")
    out = None
    for i, provider in enumerate(("openai", "ollama", "anthropic")):
        part = base.filter((F.col("size_bytes") + i) % 3 != 0).select(
            "file_path", F.lit(provider).alias("provider"),
            _with_number(pick(SCORE_REPLIES, f"(size_bytes + {i})")).alias("reply"))
        out = part if out is None else out.unionByName(part)
    return out


def guidance_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("cmd_id"), pick(GUIDANCE_REPLIES, "n_chars").alias("reply"))


def false_positives(spark: SparkSession, sf_dir: str, findings: DataFrame) -> DataFrame:
    """Findings in documents that are labelled as toxic were marked by someone."""
    marked = table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id").distinct()
    doc = F.regexp_extract("file_path", r"doc_(\d+)", 1)
    return (findings.select("finding_id", doc.alias("doc")).filter("doc <> ''")
            .join(marked, F.col("doc") == F.col("doc_id").cast("string"), "left_semi").select("finding_id"))


def path_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths that try to leave a folder, from page addresses and document ids."""
    url = F.regexp_replace("url", r"^https?://", "")
    pages = table(spark, sf_dir, "pages").select(
        F.concat(pick(("../", "a/../../", "", "/etc/", "/workspace/project/", "./x/..//", "/workspace/project-evil/",
                        "..", "b/../", "../project/"), "page_id"), url).alias("target"))
    docs = table(spark, sf_dir, "documents").select(
        F.concat(pick(("src/", "../../", "/workspace/project/../", "..hidden/", "/"), "doc_id"),
                 "source", F.lit("/../"), F.col("doc_id").cast("string")).alias("target"))
    return docs.unionByName(pages)
