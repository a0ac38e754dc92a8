"""Requests to and replies from a language model, as tables.

No call is made here.  Requests are built as rows, so that inference can run
wherever it is available; replies come back as rows and are read here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codewarden.config import ScanConfig
from codewarden.functions.paths import last_dot_part
from codewarden.functions.text import clamp01, java

# Cuts, token limits, reply formats and the order of providers.
SCORE_CHUNK_CHARS = 1800
SCORE_MAX_TOKENS = 80
SHELL_MAX_TOKENS = 200
FIX_MAX_TOKENS = 1024
FIRST_OBJECT = r"\{[\s\S]*?\}"
WIDEST_OBJECT = r"\{[\s\S]*\}"
BARE_SCORE = r"\b(0\.\d+|1\.0|0|1)\b"
PROVIDER_ORDER = ("ollama", "lmstudio", "anthropic", "gemini", "openai")

_LEADING_NUMBER = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"


def request_settings(asked_tokens: int, config: ScanConfig) -> tuple[Column, Column]:
    """Token limit and temperature of a request; the settings cap both."""
    tokens = F.least(F.lit(asked_tokens), F.lit(config.max_tokens)) if config.max_tokens > 0 else F.lit(asked_tokens)
    return tokens, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(float(config.temperature))))


def score_requests(files: DataFrame, config: ScanConfig = ScanConfig()) -> DataFrame:
    """The requests of each file: one per consecutive part of its text, numbered from 1.

    ``chars`` is the length of the part, by which ``combine_scores`` weighs the answers.
    """
    ext = last_dot_part(F.col("file_path"))
    # cut once, from left to right; an empty text is one empty part
    parts = F.regexp_extract_all("code", F.lit(f"(?s).{{1,{SCORE_CHUNK_CHARS}}}"), F.lit(0))
    parts = F.when(F.col("code") == "", F.array(F.lit(""))).otherwise(parts)
    files = (files.filter(F.col("code").isNotNull()).select("file_path", F.posexplode(parts).alias("at", "part"))
             .select("file_path", (F.col("at") + 1).alias("chunk"), "part"))
    part = F.col("part")
    tokens, temperature = request_settings(SCORE_MAX_TOKENS, config)
    return files.select(
        "file_path", "chunk", F.length(part).alias("chars"),
        F.concat(
            F.lit("How likely was this "), ext,
            F.lit(" file written by a language model? Weigh depth of domain knowledge, generic wording and "
                  'edge cases. Answer with JSON only: {"score": <0.0 to 1.0>, "reason": "<one sentence>"}\n```'),
            ext, F.lit("\n"), part, F.lit("\n```")).alias("prompt"),
        tokens.alias("max_tokens"), temperature.alias("temperature"),
    )


def _first(text: Column, pattern: str, group: int = 0) -> Column:
    """The first match, or null."""
    found = F.regexp_extract(text, java(pattern), group)
    return F.when(found != "", found)


def parse_scores(replies: DataFrame) -> DataFrame:
    """Read ``reply_score`` (0 to 1) and ``reply_reason`` out of ``reply``.

    The first object of the reply counts.  When it is not valid JSON the first
    bare number between 0 and 1 counts.  Anything else gives nulls.
    """
    obj = _first(F.col("reply"), FIRST_OBJECT)
    strict = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false", "columnNameOfCorruptRecord": "bad"}
    # of a repeated name the last value counts
    parsed = replies.withColumn("_object", obj).withColumn(
        "_json", F.from_json("_object", "score string, reason string, bad string", strict))
    valid = F.col("_json").isNotNull() & F.col("_json.bad").isNull()
    text = F.col("_json.score")
    # a list reads as its first number
    number = _first(F.when(text.startswith("["), F.regexp_replace(text, r'^[\[\s"]+', "")).otherwise(text), _LEADING_NUMBER, 1)
    value = number.try_cast("double")
    finite = F.when(F.abs(value) < float("inf"), clamp01(value))
    fallback = _first(F.col("reply"), BARE_SCORE, 1).cast("double")
    score = F.when(valid, finite).when(F.col("_object").isNotNull(), fallback)
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json("_object"), "$.reason", "variant"))
    told = F.coalesce(kind == "STRING", F.col("_json.reason").isNotNull())
    reason = F.when(valid & finite.isNotNull() & told, F.col("_json.reason"))
    return (parsed.withColumn("reply_score", score).withColumn("reply_reason", reason)
            .drop("_object", "_json"))


def combine_scores(parsed: DataFrame) -> DataFrame:
    """One score per file from ``parsed(file_path, chars, reply_score)``: the mean of its parts, by length.

    Parts without a readable score do not count; a file without any has a null.
    """
    read = F.col("reply_score").isNotNull()
    weight = F.greatest(F.col("chars"), F.lit(1))
    total = F.sum(F.when(read, weight))
    return parsed.groupBy("file_path").agg(
        (F.sum(F.when(read, weight * F.col("reply_score"))) / total).alias("reply_score"),
        F.count(F.lit(1)).alias("parts"), F.count("reply_score").alias("parts_read"))


def pick_provider(replies: DataFrame, preferred: str = "auto") -> DataFrame:
    """One reply per file: the preferred provider's, else by the fixed order.

    A provider without a row for the file was not available.
    """
    order = [p for p in (preferred, *PROVIDER_ORDER) if p != "auto"]
    rank = F.lit(len(order))
    for i, name in reversed(list(enumerate(order))):
        rank = F.when(F.col("provider") == name, F.lit(i)).otherwise(rank)
    return (replies.filter(F.col("provider").isin(*order))
            .groupBy("file_path")
            .agg(F.min_by(F.struct("provider", "reply"), rank).alias("pick"))
            .select("file_path", "pick.provider", "pick.reply"))
