"""Quality rules whose limits come from mergeable quantile sketches per language and source (DataFrame functions only).

Each metric is a whole number (thousandths, or tenths of a character). The sketch of a group is its count per value:
sketches merge by adding counts, rows meet only as counts, and a quantile is exact to one unit of the metric. A text is
dropped if a metric lies beyond `q75 + spread * (q75 - q25) + slack` of its group, or below the mirrored limit for
metrics with two sides. A group under `least_rows` texts uses the merged sketch of all groups.

Nulls: a null text has no words; a null language or source is a group of its own. Empty texts fail the base rule.
Repeated rows and ids are judged row by row; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codewarden.llm.common import SPACE_RUN, SPACES, bind, stored

#: metric -> (slack, whether values far below the group count as well)
METRICS = {"symbols": (20, False), "dup_lines": (400, False), "repeats": (300, False), "word_length": (15, True),
           "marks": (60, False)}
SPREAD, LEAST_ROWS, TOP = 3, 30, 1000
SYMBOLS = "#*$%&|<>"


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE_RUN), "")


def repeated_words(w: Column, width: int = 5) -> Column:
    """Words that lie in a window of `width` words found twice or more."""
    hashes = lambda h: F.when(F.size(h) >= width, F.transform(
        F.sequence(F.lit(0), F.size(h) - width), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(width)])))
    windows = bind(F.transform(w, lambda x: F.xxhash64(x)), hashes)

    def covered(pos: Column) -> Column:
        steps = F.transform(pos, lambda p, j: F.least(F.lit(width), F.coalesce(F.get(pos, j + 1) - p, F.lit(width))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    def positions(s: Column) -> Column:
        return F.sort_array(F.transform(F.filter(s, lambda x, j: F.coalesce(
            F.when(j > 0, F.get(s, j - 1)["h"] == x["h"]), F.lit(False))
            | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False))), lambda x: x["i"]))

    def count(g: Column) -> Column:
        by_hash = F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return (F.when(F.size(F.array_distinct(g)) == F.size(g), 0)
                .otherwise(bind(bind(by_hash, positions), covered)))

    return F.coalesce(bind(windows, count), F.lit(0)).cast("long")


def _marks(text: Column, marks: str) -> Column:
    """How many characters of `text` are in `marks`; texts without any are only searched."""
    some = F.lit(False)
    for c in marks:
        some = some | F.contains(text, F.lit(c))
    return F.when(some, F.length(text) - F.length(F.translate(text, marks, ""))).otherwise(0).cast("long")


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the base counts and the metrics, from one read of the texts."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, SPACES, "") != "")
    of_words = lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"))
    of_lines = lambda x: F.struct(
        F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))
    counted = docs.select("doc_id", "lang", "source", bind(words(text), of_words).alias("w"),
                          bind(lines, of_lines).alias("l"), _marks(text, SYMBOLS).alias("n_symbols"),
                          _marks(text, "!?").alias("n_marks"))
    rate = lambda part, whole, by=TOP: F.floor(by * part / F.greatest(whole, F.lit(1)))
    return counted.select(
        "doc_id", "lang", "source", "w.n_words", "w.word_chars", "n_symbols", F.col("l.dup").alias("n_dup_lines"),
        "w.n_repeat_words", rate(F.col("n_symbols"), F.col("w.word_chars")).alias("symbols"),
        rate(F.col("l.dup"), F.col("l.n")).alias("dup_lines"),
        rate(F.col("w.n_repeat_words"), F.col("w.n_words")).alias("repeats"),
        F.least(rate(F.col("w.word_chars"), F.col("w.n_words"), 10), F.lit(TOP)).alias("word_length"),
        rate(F.col("n_marks"), F.col("w.word_chars")).alias("marks"),
        ((F.col("w.n_words") < 10) | (100 * F.col("w.n_repeat_words") > 20 * F.col("w.n_words"))).alias("base_failed"))


def sketches(measured: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, metric, value, n): counts per value of the texts that pass the base rule."""
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("long").alias("value")) for m in METRICS])
    return (measured.where("not base_failed").select(*keys, F.explode(cells).alias("c"))
            .groupBy(*keys, "c.metric", "c.value").agg(F.count("*").alias("n")))


def limits(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rows, <metric>_low, <metric>_high) from sketches, one row per group."""
    group = Window.partitionBy(*keys, "metric")
    ranked = (sketch.withColumn("below", F.sum("n").over(group.orderBy("value")
                                                         .rowsBetween(Window.unboundedPreceding, 0)))
              .withColumn("rows", F.sum("n").over(group)))
    quartile = lambda k: F.min(F.when(4 * F.col("below") >= k * F.col("rows"), F.col("value")))
    q = ranked.groupBy(*keys, "metric").agg(F.max("rows").alias("rows"), quartile(1).alias("q1"), quartile(3).alias("q3"))
    reach = SPREAD * (F.col("q3") - F.col("q1"))
    slack = F.create_map(*[F.lit(x) for m, (s, _) in METRICS.items() for x in (m, s)])[F.col("metric")]
    q = q.withColumns({"high": F.col("q3") + reach + slack, "low": F.col("q1") - reach - slack})
    pick = lambda m, c: F.max(F.when(F.col("metric") == m, F.col(c)))
    return q.groupBy(*keys).agg(F.max("rows").alias("rows"),
                                *[pick(m, c).alias(f"{m}_{c}") for m in METRICS for c in ("low", "high")])


def judge(docs: DataFrame) -> DataFrame:
    """The measures of every text with `kept`."""
    measured = stored(measures(docs), "measures")
    sketch = stored(sketches(measured, ["lang", "source"]), "sketch")
    own = limits(sketch, ["lang", "source"]).where(F.col("rows") >= LEAST_ROWS)
    whole = limits(sketch.groupBy("metric", "value").agg(F.sum("n").alias("n")).withColumn("one", F.lit(1)), ["one"])
    names = [f"{m}_{c}" for m in METRICS for c in ("low", "high")]
    own = own.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"),
                     *[F.col(n).alias(f"own_{n}") for n in names])
    joined = measured.join(own, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")),
                           "left")
    merged = whole.select(*names).first()  # one row: the merged sketch of all groups
    limit = lambda n: F.coalesce(f"own_{n}", F.lit(merged[n] if merged else None).cast("long"))
    bad = F.lit(False)
    for m, (_, two_sided) in METRICS.items():
        bad = bad | (F.col(m) > limit(f"{m}_high"))
        if two_sided:
            bad = bad | (F.col(m) < limit(f"{m}_low"))
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(bad, F.lit(False)))
