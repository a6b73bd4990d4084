"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every text.  Expectation
maximisation over the counts of vote patterns (3 to the number of labellers at most,
whatever the corpus) estimates how often each labeller votes what on good and on bad
texts, and with that the probability that a text of a given pattern is good.  These
posterior labels train a hashed linear scorer by logistic regression, on the
``TRAIN_ROWS`` distinct rows of smallest hash of id and text: measures in coarse steps
weigh as they stand, words by their share of the text.  The scorer judges all texts; those with a
score below ``KEEP_FROM`` are rejected.

A null text or one without words has score 0 and is rejected.  An empty table gives an
empty result, without training.  Repeated rows are judged one by one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from operator import eq
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oremill.llm.text import WORD, sliced, tidy, whole

BUCKETS = 1 << 18
TRAIN_ROWS = 5_000
KEEP_FROM = 0.3
STEPS = 400  # of gradient descent
DECAY = 1e-4

#: Frequent function words of the languages the labeller knows (fixed values).
FUNCTION_WORDS = frozenset(
    w.encode()
    for w in """the of and to in that is was for with as on by it be are this from or an at not
    de la le les des et en un une du que qui dans est pour par sur au avec pas
    der die das und den von zu mit sich auf ist ein eine dem nicht im
    el los las una y del por con para se no es lo al como""".split()
)
SYMBOLS = b"#*$%&|<>{}[]\\^~_="
NOT_LETTERS = bytes(b for b in range(128) if not chr(b).isalnum())
PLAIN_ENDS = frozenset(b for b in range(256) if b >= 128 or chr(b).isalnum() or chr(b) in ".,;:!?'\")-")


class Measures(NamedTuple):
    """Thousandths, but for the number of words and tenths of the word length."""

    words: int
    symbols: int
    repeats: int  # words equal to the one before
    distinct: int
    lines: int  # repeated lines
    function: int
    length: int
    ends: int  # words that end a sentence
    letters: int  # and digits, of the characters
    plain: int  # words that end in a letter, digit or common punctuation


#: Per measure: vote bad outside [bad_low, bad_high], good within [good_low, good_high];
#: the number of words from which the labeller votes at all.
LABELLERS = {
    "symbols": (0, 60, 0, 10, 5),
    "repeats": (0, 250, 0, 60, 10),
    "distinct": (180, 1000, 350, 1000, 60),
    "lines": (0, 500, 0, 150, 20),
    "function": (8, 600, 60, 500, 30),
    "length": (22, 110, 30, 85, 10),
    "ends": (2, 500, 8, 350, 60),
    "letters": (900, 1000, 940, 1000, 5),
    "plain": (750, 1000, 930, 1000, 5),
}


def measured(text: str | None) -> tuple[Measures, list[bytes]]:
    data = (text or "").encode()
    words = data.split()
    n = len(words)
    if not n:
        return Measures(*[0] * len(Measures._fields)), words
    lines = [line for line in data.split(b"\n") if line.strip()]
    chars = sum(map(len, words))
    return (
        Measures(
            n,
            1000 * (len(data) - len(data.translate(None, SYMBOLS))) // chars,
            1000 * sum(map(eq, words, words[1:])) // n,
            1000 * len(set(words)) // n,
            1000 * (len(lines) - len(set(lines))) // len(lines),
            1000 * sum(map(FUNCTION_WORDS.__contains__, words)) // n,
            10 * chars // n,
            1000 * sum(data.count(end) for end in (b".", b"!", b"?", "。".encode())) // n,
            1000 * len(data.translate(None, NOT_LETTERS)) // chars,
            1000 * sum(w[-1] in PLAIN_ENDS for w in words) // n,
        ),
        words,
    )


def votes(m: Measures) -> list[int]:
    """1 good, -1 bad, 0 neither, by labeller."""
    given = []
    for name, (bad_low, bad_high, low, high, least) in LABELLERS.items():
        x = getattr(m, name)
        given.append(0 if m.words < least else -1 if not bad_low <= x <= bad_high else int(low <= x <= high))
    return given


def features(m: Measures, words: list[bytes]) -> list[int]:
    """Buckets of the measures' steps, then one of every word."""
    steps = [int(m.words).bit_length(), m.symbols // 40, m.repeats // 50, m.distinct // 100, m.lines // 100, m.function // 40, m.length // 10, m.ends // 25, m.letters // 20, m.plain // 50]
    own = [zlib.crc32(f"{name} {step}".encode()) % BUCKETS for name, step in zip(Measures._fields, steps)]
    return own + [zlib.crc32(w) % BUCKETS for w in words]


def vote_pattern(text: Column) -> Column:
    """The votes of all labellers as a string of ``+``, ``-`` and ``.``; empty for a text without words."""

    @F.arrow_udf("string")
    @tidy
    def pattern(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = (measured(t.as_py())[0] for t in batch)
            yield pa.array(("".join(".+-"[v] for v in votes(m)) if m.words else "" for m in found), pa.string(), size=len(batch))

    return pattern(text.cast("string"))


def posteriors(counts: dict[str, int], rounds: int = 200) -> dict[str, float]:
    """Probability of being good by vote pattern, by expectation maximisation.

    Texts are bad in unlike ways, and most labellers see one of them only; so the start
    lets two bad votes outweigh any number of good ones.  Votes are smoothed by one of
    each kind.
    """
    patterns = sorted(p for p in counts if p)
    if not patterns:
        return {}
    weight = np.array([counts[p] for p in patterns], float)
    vote = np.array([["-.+".index(c) for c in p] for p in patterns])
    shown = (vote[:, :, None] == np.arange(3)).astype(float)
    good = np.array([0.95, 0.5, 0.05])[np.minimum((vote == 0).sum(axis=1), 2)]
    for _ in range(rounds):
        prior = np.clip((good * weight).sum() / weight.sum(), 1e-6, 1 - 1e-6)
        logs = []
        for share, p in ((1 - prior, 1 - good), (prior, good)):
            table = np.einsum("p,plv->lv", p * weight, shown) + 1
            table /= table.sum(axis=1, keepdims=True)
            given = np.einsum("plv,lv->pl", shown, _log_given(table))
            logs.append(np.log(share) + given.sum(axis=1))
        now = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))
        if np.abs(now - good).max() < 1e-9:
            break
        good = now
    return dict(zip(patterns, good.tolist()))


def _log_given(table: np.ndarray) -> np.ndarray:
    """Log chances of a vote where one is given: an abstention says how long a text is, not how good."""
    said = table[:, [0, 2]] / table[:, [0, 2]].sum(axis=1, keepdims=True)
    return np.stack([np.log(said[:, 0]), np.zeros(len(table)), np.log(said[:, 1])], axis=1)


def train(index: np.ndarray, lengths: np.ndarray, good: np.ndarray, steps: int = STEPS, rate: float = 0.5) -> np.ndarray:
    """Weights of a logistic regression on soft labels; the last one is the intercept.

    ``index`` holds the features of all rows in a row, ``lengths`` how many each has.
    """
    own = len(Measures._fields)
    rows = range(len(lengths))
    of = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    measure = np.arange(len(index)) - np.repeat(np.cumsum(lengths) - lengths, lengths) < own
    value = np.where(measure, 1.0, (1.0 / np.maximum(lengths - own, 1))[of])
    weights, squares, intercept = np.zeros(BUCKETS), np.full(BUCKETS, 1e-8), 0.0
    for _ in range(steps):
        score = 1 / (1 + np.exp(-np.bincount(of, value * weights[index], len(rows)) - intercept))
        wrong = (score - good) / len(rows)
        slope = np.bincount(index, value * wrong[of], BUCKETS) + DECAY * weights / len(rows)
        squares += slope * slope
        weights -= rate * slope / np.sqrt(squares)
        intercept -= rate * wrong.sum()
    return np.append(weights, intercept)


def fit(docs: DataFrame, text: str = "text", key: str = "doc_id", train_rows: int = TRAIN_ROWS) -> np.ndarray | None:
    """The scorer's weights; None if no text has a word.  Pattern counts and the sample's features reach the driver."""
    pattern = vote_pattern(F.col(text))
    counts = {r["p"]: r["n"] for r in docs.select(pattern.alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect()}
    good = posteriors(counts)
    if not good:
        return None
    worded = docs.where(whole(F.col(text)).rlike(WORD))
    placed = worded.select(F.xxhash64(F.lit("train"), F.col(key), F.col(text)).alias("place"), F.col(text).alias("text"))
    # Equal rows have one place and count once; the places alone say where the sample ends.
    last = placed.select("place").distinct().orderBy("place").limit(train_rows).agg(F.max("place")).first()[0]
    sample = placed.where(F.col("place") <= last).groupBy("place").agg(F.min("text").alias("text"))
    sample = sample.select("place", vote_pattern(F.col("text")).alias("p"), _features(F.col("text")).alias("f"))
    rows = sample.toArrow().sort_by("place")
    found = rows["f"].combine_chunks()
    lengths = np.diff(found.offsets.to_numpy())
    return train(found.flatten().to_numpy(), lengths, np.array([good[p] for p in rows["p"].to_pylist()]))


def _features(text: Column) -> Column:
    @F.arrow_udf("array<int>")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array((features(*measured(t.as_py())) for t in batch), pa.list_(pa.int32()), size=len(batch))

    return found(text.cast("string"))


def scored(text: Column, weights: np.ndarray | None) -> Column:
    """The scorer's probability that a text is good."""
    own = len(Measures._fields)

    @F.arrow_udf("double")
    @tidy
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for part in sliced(batch):
                for t in part:
                    m, words = measured(t)
                    if weights is None or not m.words:
                        out.append(0.0)
                        continue
                    found = weights[np.array(features(m, words))]
                    out.append(float(1 / (1 + np.exp(-found[:own].sum() - found[own:].mean() - weights[-1]))))
            yield pa.array(out, pa.float64())

    return score(text.cast("string"))


def judged(docs: DataFrame, text: str = "text", key: str = "doc_id", keep_from: float = KEEP_FROM) -> DataFrame:
    """``docs`` with ``score`` and ``kept``, which replace columns of these names."""
    marked = docs.withColumn("score", scored(F.col(text), fit(docs, text, key)))
    return marked.withColumn("kept", F.col("score") >= keep_from)
