"""Quality rules with thresholds that adapt to language and source.

Each text is measured with built-in functions.  A quantile sketch per (lang, source)
and metric is a histogram over logarithmic buckets (values below 128 exact, above
within 1/128), so two sketches merge by adding counts and neither order nor
partitioning changes them.  From a group's median and quartiles come its fences; they
are weighted against the fences of all documents' merged sketch, which stand for
``PRIOR_ROWS`` documents.  Documents outside a fence are rejected.

The metrics are integers: symbols, repeated lines and repeated words in thousandths
of characters, lines and words, and the mean word length in hundredths.

A null text has no words and fails the base rules; null languages and sources form
groups of their own.  Repeated rows count each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oremill.llm.text import WORD, let, whole, words
from oremill.plans.staging import stage

WINDOW = 8  # words that make a repeated passage
MIN_WORDS = 20
MAX_REPEATED = 30  # percent of the words
#: A metric's fences lie this many quartile ranges beyond the quartiles ...
SPREADS = 6
#: ... and this far at least, in units of the metric.
SLACK = {"symbols": 60, "dup_lines": 400, "repeated": 250, "word_length": 250}
TWO_SIDED = {"word_length"}
PRIOR_ROWS = 50
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def _repeated(found: Column) -> Column:
    """Words within windows that occur twice or more."""

    def covered(hashes: Column) -> Column:
        rolled = F.transform(hashes, lambda h, i: F.xxhash64(h, *[F.get(hashes, i + k) for k in range(1, WINDOW)]))
        windows = F.slice(rolled, F.lit(1), F.size(hashes) - (WINDOW - 1))
        return let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(_union(w)))

    def _union(windows: Column) -> Column:
        placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(placed, lambda s: let(F.sort_array(F.transform(F.filter(s, _twin(s)), lambda x: x["i"])), _lengths))

    def _twin(s: Column):
        return lambda x, k: (F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False))) | (
            F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))
        )

    def _lengths(starts: Column) -> Column:
        steps = F.transform(starts, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, k + 1) - p, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda total, step: total + step)

    # The window hashes are taken from the words' hashes, eight at a time.
    hashed = F.transform(found, lambda w: F.xxhash64(w))
    return F.when(F.size(found) < WINDOW, F.lit(0)).otherwise(let(hashed, covered))


def _measured(text: Column) -> Column:
    """Struct of the counts of one text."""
    lines = F.filter(F.split(text, "\n"), lambda line: F.rlike(line, F.lit(WORD)))
    return F.struct(
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).alias("all"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))).alias("lines"),
        let(
            words(text),
            lambda w: F.struct(F.size(w).alias("n"), F.length(F.array_join(w, "")).alias("chars"), _repeated(w).alias("rep")),
        ).alias("words"),
    )


def measures(docs: DataFrame, keys: tuple[str, ...] = ("doc_id", "lang", "source"), text: str = "text") -> DataFrame:
    """The keys and the counts of every text, and whether the base rules fail it."""
    measured = docs.select(*keys, _measured(whole(F.col(text))).alias("m"))
    counted = measured.select(
        *keys,
        F.col("m.words.n").cast("bigint").alias("n_words"),
        F.col("m.words.chars").cast("bigint").alias("word_chars"),
        "m.n_symbols",
        F.col("m.lines.dup").cast("bigint").alias("n_dup_lines"),
        F.col("m.words.rep").cast("bigint").alias("n_repeat_words"),
        F.col("m.lines.all").cast("bigint").alias("n_lines"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def metrics() -> dict[str, Column]:
    """Metrics by name, over the columns of ``measures``."""

    def per(part: str, total: str, unit: int) -> Column:
        return F.expr(f"{unit} * {part} div greatest({total}, 1)")

    return {
        "symbols": per("n_symbols", "word_chars", 1000),
        "dup_lines": per("n_dup_lines", "n_lines", 1000),
        "repeated": per("n_repeat_words", "n_words", 1000),
        "word_length": per("word_chars", "n_words", 100),
    }


def bucket(value: Column) -> Column:
    """The lower end of a value's bucket: its seven leading bits."""
    return let(value, lambda v: v - v % let(F.greatest(F.length(F.bin(v)) - 7, F.lit(0)), lambda s: F.pow(F.lit(2), s).cast("bigint")))


def sketches(measured: DataFrame, by: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """``(*by, metric, bucket, rows)``; sketches of larger groups are sums of these."""
    rows = measured.select(
        *by, F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), v.alias("value")) for n, v in metrics().items()])).alias("m")
    )
    return rows.groupBy(*by, F.col("m.metric").alias("metric"), bucket(F.col("m.value")).alias("bucket")).agg(
        F.count(F.lit(1)).alias("rows")
    )


def fences(sketch: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """``(*by, metric, n, low, high)`` from quartiles of the sketches."""
    group = Window.partitionBy(*by, "metric")
    summed = sketch.groupBy(*by, "metric", "bucket").agg(F.sum("rows").alias("rows"))
    run = summed.select(
        *by, "metric", "bucket", F.sum("rows").over(group.orderBy("bucket")).alias("upto"), F.sum("rows").over(group).alias("n")
    )
    quartiles = run.groupBy(*by, "metric").agg(
        F.max("n").alias("n"),
        *[F.min(F.when(4 * F.col("upto") >= k * F.col("n"), F.col("bucket"))).alias(f"q{k}") for k in (1, 2, 3)],
    )
    slack = F.create_map(*[F.lit(x) for kv in SLACK.items() for x in kv])[F.col("metric")]
    reach = F.greatest(SPREADS * (F.col("q3") - F.col("q1")), slack)
    return quartiles.select(*by, "metric", "n", (F.col("q1") - reach).alias("low"), (F.col("q3") + reach).alias("high"))


def thresholds(measured: DataFrame, by: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """One row per group: ``low_<metric>`` and ``high_<metric>``."""
    sketch = stage(sketches(measured, by), "sketches")
    own = fences(sketch, by)
    common = fences(sketch, ()).select("metric", F.col("low").alias("all_low"), F.col("high").alias("all_high"))
    weighted = own.join(F.broadcast(common), "metric").select(  # one row per metric
        *by,
        "metric",
        *[
            ((F.col("n") * F.col(side) + PRIOR_ROWS * F.col(f"all_{side}")).cast("double") / (F.col("n") + PRIOR_ROWS)).alias(side)
            for side in ("low", "high")
        ],
    )
    return weighted.groupBy(*by).agg(
        *[
            F.max(F.when(F.col("metric") == name, F.col(side))).alias(f"{side}_{name}")
            for name in metrics()
            for side in ("low", "high")
        ]
    )


def judged(docs: DataFrame, by: tuple[str, ...] = ("lang", "source"), key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, counts, ``base_failed`` and ``kept`` of every document."""
    measured = stage(measures(docs, (key, *by), text), "measures")
    limits = stage(thresholds(measured, by), "thresholds").alias("t")
    same = F.lit(True)
    for column in by:
        same = same & F.col(f"m.`{column}`").eqNullSafe(F.col(f"t.`{column}`"))
    inside = ~F.col("base_failed")
    for name, value in metrics().items():
        inside = inside & (value <= F.col(f"t.high_{name}"))
        if name in TWO_SIDED:
            inside = inside & (value >= F.col(f"t.low_{name}"))
    return measured.alias("m").join(limits, same, "left").select(
        F.col(f"m.`{key}`").alias(key), *[F.col(f"m.{c}") for c in COUNTS], "base_failed", F.coalesce(inside, F.lit(False)).alias("kept")
    )
