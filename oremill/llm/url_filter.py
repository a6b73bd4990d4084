"""URL filter: host and path rules, else a naive Bayes score of segmented names.

Names in hosts are words run together.  A unigram model (the most frequent words of a
text column, counted over all its rows) splits each name by Viterbi search.  The words
of host and path, hashed into ``BUCKETS`` features, are scored by multinomial naive
Bayes with additive smoothing.  It learns from the urls that rules decide and from a
small seed list of words, and judges the urls that no rule fits.

Rules for whole domains and paths say nothing beyond them: a url is learned from without
its top-level domain and its path names down to the depth that rules for its host look
at.  Nor does the share of a top-level domain that they block: within each, allowed and
blocked urls weigh the same in sum, and one where rules give a single verdict tells
nothing.  A host where both verdicts fall is told apart by its paths, so its words count
as far as one prevails.

A url that is null or has no ``://`` has an empty host and path; without any word the
prior decides and the url is allowed.  Repeated rows are judged one by one.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oremill.llm.text import ascii_lower, whole
from oremill.plans.staging import stage

BUCKETS = 1 << 16
#: Words of the unigram model at most, the most frequent ones: its size on driver and workers.
DICTIONARY = 50_000
LONGEST_WORD = 24
#: Urls that the seed words of a class stand for; the words share them evenly, in host and path.
SEED_URLS = 400
SMOOTHING = 1.0  # added to the count of every feature in either class
BLOCK_PRIOR = 0.1
SEEDS = {
    "allow": "news docs wiki school library university museum science health weather journal archive help support".split(),
    "block": "spam casino poker porn adult bet betting viagra pills loan loans hack crack warez torrent malware phish phishing escort lottery xxx".split(),
}


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a url."""
    at = F.instr(whole(url), "://")
    rest = F.when(at > 0, F.substring(whole(url), at + 3, F.length(whole(url)))).otherwise("")
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def decided(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Struct of the longest fitting rule's name and verdict; null if none fits."""
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = _under(host, rule.host) & F.startswith(path, F.lit(rule.path))
        chosen = F.when(fits, F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def _under(host: Column, ending: str) -> Column:
    return (host == ending) | F.endswith(host, F.lit("." + ending))


def beyond(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The host without its top-level domain, and the path below all that the rules for this host look at."""
    rest, depth = F.regexp_replace(host, r"\.?[^.]*$", ""), F.lit(0)
    for rule in rules:
        names = rule.path.count("/") - rule.path.endswith("/")
        depth = F.greatest(depth, F.when(_under(host, rule.host), names).otherwise(0))
    return rest, F.regexp_replace(path, F.concat(F.lit("^(?:/[^/]*){0,"), depth, F.lit("}")), F.lit(""))


def dictionary(texts: DataFrame, text: str, words: int = DICTIONARY) -> dict[str, int]:
    """Counts of the most frequent words of a column of texts or markup, and of all words (key ``""``)."""
    visible = F.regexp_replace(whole(F.col(text)), "<[^>]*>", " ")
    found = texts.select(F.explode(F.regexp_extract_all(F.lower(visible), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    counted = found.where(F.length("word") <= LONGEST_WORD).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    counts = stage(counted.withColumn("step", F.floor(16 * F.log2("n")).cast("int")), "words")
    # The most frequent words by a threshold, from at most a thousand steps of frequency.
    left, least, total = words, None, 0
    for row in counts.groupBy("step").agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("n")).orderBy(F.desc("step")).collect():
        total += row["n"]
        if left is not None and row["words"] <= left:
            left, least = left - row["words"], row["step"]
        else:
            left = None
    chosen = counts.where(F.col("step") >= least).collect() if least is not None else []
    return {"": total} | {r["word"]: r["n"] for r in chosen}


class Segmenter:
    """Splits names into the likeliest words; unknown ones cost more the longer they are."""

    def __init__(self, counts: dict[str, int]):
        total = max(counts.get("", 0), 1)
        self.cost = {w: math.log(total / n) for w, n in counts.items() if w}
        self.unknown = math.log(total + 10)
        self.split = lru_cache(maxsize=100_000)(self._split)

    def _split(self, name: str) -> tuple[str, ...]:
        best, cut = [0.0], [0]
        for end in range(1, len(name) + 1):
            choices = (
                (best[start] + self.cost.get(name[start:end], self.unknown + 2.5 * (end - start)), start)
                for start in range(max(0, end - LONGEST_WORD), end)
            )
            cost, start = min(choices)
            best.append(cost)
            cut.append(start)
        words, end = [], len(name)
        while end:
            words.append(name[cut[end] : end])
            end = cut[end]
        return tuple(reversed(words))

    def words(self, host: str, path: str) -> list[str]:
        """Segmented words of host and path, marked by where they stand; numbers by their length.

        Path names of one or two letters are left out: they name a language or a page kind,
        and would carry what a rule says of one site's language to all others.
        """
        return [
            kind + word
            for kind, text in (("h ", host), ("p ", path.lower()))
            for name in re.findall(r"[^\W\d_]+|\d+", text)
            if kind == "h " or len(name) > 2
            for word in ((f"0{len(name)}",) if name[0].isdecimal() else self.split(name))
        ]


def feature(word: str) -> int:
    return zlib.crc32(word.encode()) % BUCKETS


@lru_cache(maxsize=1)
def _segmenter(counts: tuple[tuple[str, int], ...]) -> Segmenter:
    return Segmenter(dict(counts))


def features(host: Column, path: Column, counts: dict[str, int]) -> Column:
    """Array of the hashed features of a url."""
    fixed = tuple(sorted(counts.items()))

    @F.arrow_udf("array<int>")
    def hashed(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        segmenter = _segmenter(fixed)
        for hosts, paths in batches:
            yield pa.array(
                [[feature(w) for w in segmenter.words(h.as_py(), p.as_py())] for h, p in zip(hosts, paths)], pa.list_(pa.int32())
            )

    return hashed(host, path)


def fit(labelled: DataFrame) -> np.ndarray:
    """Log odds of ``block`` by feature, from rows of ``(host, verdict, of_host, of_path)``; at most two counts a feature reach the driver."""
    counts = np.full((2, BUCKETS), SMOOTHING)
    for side, verdict in enumerate(("allow", "block")):
        for word in SEEDS[verdict]:
            for kind in ("h ", "p "):
                counts[side, feature(kind + word)] += SEED_URLS / len(SEEDS[verdict])
    allow, block = F.col("allow"), F.col("block")
    hosts = labelled.groupBy("host").agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in ("allow", "block")])
    hosts = hosts.withColumn("top", F.substring_index("host", ".", -1))
    tops = hosts.groupBy("top").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block")).where((allow > 0) & (block > 0))
    tops = tops.select("top", ((allow + block) / (2 * allow)).alias("if_allow"), ((allow + block) / (2 * block)).alias("if_block"))
    allow, block = allow * F.col("if_allow"), block * F.col("if_block")
    hosts = hosts.join(tops, "top").select("host", "if_allow", "if_block", (F.abs(block - allow) / (block + allow)).alias("prevails"))
    of = labelled.select("host", "verdict", F.explode("of_host").alias("f"), F.lit(True).alias("named")).unionByName(
        labelled.select("host", "verdict", F.explode("of_path").alias("f"), F.lit(False).alias("named"))
    )
    seen = of.groupBy("host", "verdict", "f", "named").agg(F.count(F.lit(1)).alias("n"))
    weight = F.when(F.col("verdict") == "block", F.col("if_block")).otherwise(F.col("if_allow"))
    weight = weight * F.when(F.col("named"), F.col("prevails")).otherwise(1.0)
    rows = seen.join(hosts, "host").groupBy("verdict", "f").agg(F.sum(F.col("n") * weight).alias("n"))
    for row in rows.collect():
        counts[int(row["verdict"] == "block"), row["f"]] += row["n"]
    share = counts / counts.sum(axis=1, keepdims=True)
    return np.log(share[1] / share[0])


def block_odds(found: Column, weights: np.ndarray) -> Column:
    """Log odds that a url's features call for blocking."""
    prior = math.log(BLOCK_PRIOR / (1 - BLOCK_PRIOR))

    @F.arrow_udf("double")
    def odds(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            of = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            yield pa.array(prior + np.bincount(of, weights=weights[lists.flatten().to_numpy()], minlength=len(lists)), pa.float64())

    return odds(found)


def judged(pages: DataFrame, rules: list[Rule], key: str = "page_id", url: str = "url", text: str = "html") -> DataFrame:
    """``(key, host, path, rule, verdict, block_odds)`` of every row."""
    host, path = parts(F.col(url))
    split = pages.select(F.col(key).alias("key"), host.alias("host"), path.alias("path"))
    split = split.withColumn("ruled", decided(F.col("host"), F.col("path"), rules))
    counts = dictionary(pages, text)
    found = split.withColumn("features", features(F.col("host"), F.col("path"), counts))
    of_host, of_path = beyond(F.col("host"), F.col("path"), rules)
    ruled = split.where(F.col("ruled").isNotNull()).select(
        "host",
        F.col("ruled.verdict").alias("verdict"),
        features(of_host, F.lit(""), counts).alias("of_host"),
        features(F.lit(""), of_path, counts).alias("of_path"),
    )
    scored = found.withColumn("odds", block_odds(F.col("features"), fit(ruled)))
    return scored.select(
        F.col("key").alias(key),
        "host",
        "path",
        F.col("ruled.rule").alias("rule"),
        F.coalesce("ruled.verdict", F.when(F.col("odds") > 0, "block").otherwise("allow")).alias("verdict"),
        F.col("odds").alias("block_odds"),
    )
