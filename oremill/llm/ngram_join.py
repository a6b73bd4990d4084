"""Jaccard join of texts on word n-grams by MinHash banding.

Texts with equal n-gram sets form a class and go on as one.  Every class has
``bands`` keys of ``rows`` minimum hashes each; classes that share a key meet in a
bucket and are verified there on their full n-gram sets.  The counts of bands and rows
follow from the recall wanted at the least similarity (``banding``).

Buckets with the same members are kept once, and a pair is looked at only in the first
of its bands, so every link is counted once.  A bucket is dealt to blocks of bounded
rows and n-grams, and each pair of blocks is one group of rows: however large a group
of near copies is, tasks stay small, and what they give back is one row for each member
(its links there, and the root of its connected part), never the pairs.

A text of fewer words than ``n`` has one n-gram, all its words; a null text or one
without words has none: it links to nothing and is a class of its own.  Of an id that
occurs several times every row is a document; equal rows are copies of each other.
Null ids are the last choice for naming a class.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oremill.llm.text import WORD, tidy, whole, words
from oremill.operators.communities import connected_components
from oremill.plans.staging import stage

N = 5
SIMILARITY = 0.8
RECALL = 0.9999
#: Similarity of texts that only share passages; they should meet in a bucket at even odds at most.
APART = 0.3
BLOCK_ROWS = 1024
BLOCK_GRAMS = 1 << 20
SEED = 44


def banding(similarity: float = SIMILARITY, recall: float = RECALL, apart: float = APART) -> tuple[int, int]:
    """Bands and rows: the fewest rows for which pairs at ``apart`` seldom meet, and bands for the recall."""
    if similarity <= apart:
        apart = similarity / 2
    for rows in range(1, 17):
        bands = max(1, math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows)))
        if 1 - (1 - apart**rows) ** bands <= 0.5:
            break
    return bands, rows


def gram_set(hashes: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-grams of a list of word hashes."""
    with np.errstate(over="ignore"):
        w = hashes.astype(np.uint64)
        size = min(n, len(w))
        if not size:
            return w
        mixed = np.full(len(w) - size + 1, 0x9E3779B97F4A7C15 + size, np.uint64)
        for k in range(size):
            mixed = (mixed ^ w[k : len(w) - size + 1 + k]) * np.uint64(0xBF58476D1CE4E5B9)
            mixed ^= mixed >> np.uint64(29)
        return np.unique(mixed * np.uint64(0x94D049BB133111EB))


def _permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    drawn = np.random.default_rng(SEED).integers(0, 1 << 63, (2, count), np.int64).astype(np.uint64)
    return (drawn[0] * np.uint64(2) + np.uint64(1))[:, None], drawn[1][:, None]


def band_keys(grams: np.ndarray, bands: int, rows: int, permutations) -> np.ndarray:
    """One key a band of a non-empty set."""
    times, plus = permutations
    with np.errstate(over="ignore"):
        least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(grams), 1024):  # blocks that stay in the cache
            x = grams[None, at : at + 1024]
            hashed = (x ^ (x >> np.uint64(31))) * times + plus
            least = np.minimum(least, (hashed ^ (hashed >> np.uint64(32))).min(axis=1))
        keys = np.zeros(bands, np.uint64)
        for k in range(rows):
            keys = (keys ^ least.reshape(bands, rows)[:, k]) * np.uint64(0xBF58476D1CE4E5B9)
            keys ^= keys >> np.uint64(32)
    return keys.view(np.int64)


def sketched(text: Column, n: int, bands: int, rows: int, with_set: bool = False) -> Column:
    """Struct of a text's class ``key`` (null without words), number of ``grams``, ``bands``, and on demand the set."""
    fields = "key:binary,grams:int,bands:array<bigint>" + ",set:binary" * with_set

    @F.arrow_udf(f"struct<{fields}>")
    @tidy
    def sketch(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        permutations = _permutations(bands * rows)
        for batch in batches:
            starts, flat = batch.offsets.to_numpy(), batch.values.to_numpy(zero_copy_only=False)
            keys, sizes, sets = [], [], []
            found = np.zeros((len(batch), bands), np.int64)
            for i in range(len(batch)):
                grams = gram_set(flat[starts[i] : starts[i + 1]], n)
                keys.append(hashlib.blake2b(grams, digest_size=16).digest() if len(grams) else None)
                sizes.append(len(grams))
                if with_set:
                    sets.append(grams.tobytes())
                if len(grams):
                    found[i] = band_keys(grams, bands, rows, permutations)
            columns = [
                pa.array(keys, pa.binary()),
                pa.array(sizes, pa.int32()),
                pa.ListArray.from_arrays(np.arange(len(batch) + 1, dtype=np.int32) * bands, pa.array(found.ravel())),
            ]
            names = ["key", "grams", "bands"]
            if with_set:
                columns.append(pa.array(sets, pa.binary()))
                names.append("set")
            yield pa.StructArray.from_arrays(columns, names)

    if with_set:
        # Else a filter on the result would draw the function, and its sets, below the join before it.
        sketch = sketch.asNondeterministic()
    return sketch(F.transform(words(text), lambda w: F.xxhash64(w)))


def _linked(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, similarity: float) -> np.ndarray:
    """Whether each of the sets ``left`` and each of ``right`` are similar."""
    sizes = np.array([len(s) for s in sets])
    grams, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(counts > 1) - 1  # of the n-grams that can be shared
    owner = np.repeat(np.arange(len(sets)), sizes)
    shared = counts[column] > 1
    owner, column = owner[shared], number[column[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((len(left), len(right)), np.float32)
    width = 1024  # 8 MB for two blocks of 1,024 sets, and as much for their halves
    total = int(column[-1]) + 1 if len(column) else 0
    for at in range(0, total, width):
        lo, hi = np.searchsorted(column, (at, at + width))
        held = np.zeros((len(sets), min(width, total - at)), np.float32)
        held[owner[lo:hi], column[lo:hi] - at] = 1
        both += held[left] @ held[right].T
    union = sizes[left][:, None] + sizes[right][None, :] - both
    return both >= similarity * union - 1e-6


def _verified(group: pa.Table, similarity: float) -> pa.Table | None:
    """Links within one block of a bucket, or between two."""
    band, low, high = (group[c][0].as_py() for c in ("band", "low", "high"))
    block = group["block"].to_numpy()
    sets = [np.frombuffer(s, np.uint64) for s in group["set"].to_pylist()]
    bands = np.array(group["bands"].to_pylist())
    left, right = np.nonzero(block == low)[0], np.nonzero(block == high)[0]
    if not len(left) or not len(right):
        return None
    new = np.ones((len(left), len(right)), bool)
    for earlier in range(band):
        new &= bands[left, earlier][:, None] != bands[right, earlier][None, :]
    if low == high:
        np.fill_diagonal(new, False)
    if not new.any():
        return None
    new &= _linked(sets, left, right, similarity)
    weight = group["members"].to_numpy()
    links = np.zeros(len(sets), np.int64)
    links[left] += new @ weight[right]
    if low != high:
        links[right] += weight[left] @ new
    root = np.arange(len(sets))
    a, b = np.nonzero(new)
    a, b = left[a], right[b]
    while len(a):  # the least member of every connected part
        least = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, least)
        np.minimum.at(root, b, least)
        root = root[root]
        if (root == before).all():
            break
    kept = np.nonzero(links)[0]
    keys = group["key"]
    return pa.table(
        {"key": keys.take(pa.array(kept)), "root": keys.take(pa.array(root[kept])), "links": pa.array(links[kept], pa.int64())}
    )


def _verify(similarity: float):
    """Takes rows sorted by ``(bucket, low, high)`` and verifies group after group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = pa.table({"key": pa.array([], pa.binary()), "root": pa.array([], pa.binary()), "links": pa.array([], pa.int64())})
        held: list[pa.RecordBatch] = []
        held_key = None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.stack([batch.column(c).to_numpy() for c in ("bucket", "low", "high")])
            cuts = [0, *(np.nonzero((ids[:, 1:] != ids[:, :-1]).any(axis=0))[0] + 1).tolist(), batch.num_rows]
            out = []
            for start, end in zip(cuts, cuts[1:]):
                key = tuple(ids[:, start].tolist())
                if held and key != held_key:
                    out.append(_verified(pa.Table.from_batches(held).combine_chunks(), similarity))
                    held = []
                held_key = key
                held.append(batch.slice(start, end - start))
            found = pa.concat_tables([empty, *(t for t in out if t is not None)])
            yield from found.combine_chunks().to_batches()
        if held:
            last = _verified(pa.Table.from_batches(held).combine_chunks(), similarity)
            yield from (last if last is not None else empty).to_batches()

    return run


def _classified(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    n: int = N,
    similarity: float = SIMILARITY,
    recall: float = RECALL,
    **kept: Column,
) -> DataFrame:
    """``(id, class, class_id, n_links)`` and the columns ``kept`` of every row.

    ``class`` is one set hash for all rows that links connect; null without words.
    """
    bands, rows = banding(similarity, recall)
    # Rows are found again by id and text, so that null or repeated ids meet nothing but their own text.
    mark = F.xxhash64(whole(F.col(text))).alias("mark")
    texts = docs.select(F.col(key).alias("id"), mark, F.col(text).alias("text"))
    members = docs.select(F.col(key).alias("id"), mark, sketched(F.col(text), n, bands, rows).alias("s"), *[c.alias(name) for name, c in kept.items()])
    members = stage(members.select("id", "mark", *kept, "s.key", "s.grams", "s.bands"), "sketches")
    some = members.where(F.col("key").isNotNull())
    least = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "mark")).alias("f")
    classes = some.groupBy("key").agg(least, F.count(F.lit(1)).alias("members"), F.max("grams").alias("grams"), F.any_value("bands").alias("bands"))
    classes = stage(classes.select("key", F.col("f.id").alias("first"), F.col("f.mark").alias("first_mark"), "members", "grams", "bands"), "classes")
    keyed = classes.select("key", "grams", F.posexplode("bands").alias("band", "value")).select(
        "key", "grams", "band", F.xxhash64("band", "value").alias("bucket")
    )
    buckets = (
        keyed.groupBy("bucket")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("band").alias("band"),
            F.sum("grams").alias("grams"),
            F.bit_xor(F.xxhash64(F.lit(1), "key")).alias("x"),
            F.bit_xor(F.xxhash64(F.lit(2), "key")).alias("y"),
        )
        .where(F.col("n") > 1)
        .groupBy("n", "x", "y")
        .agg(F.min(F.struct("band", "bucket", "grams")).alias("b"))
        .select(
            "b.bucket",
            "b.band",
            F.greatest(F.ceil(F.col("n") / BLOCK_ROWS), F.ceil(F.col("b.grams") / BLOCK_GRAMS)).cast("int").alias("blocks"),
        )
    )
    met = stage(keyed.select("key", "bucket").join(stage(buckets, "buckets"), "bucket"), "met")
    wanted = classes.join(met.select("key").distinct(), "key", "left_semi").select("key", "first", "first_mark", "members")
    again = texts.join(wanted, F.col("id").eqNullSafe(F.col("first")) & (F.col("mark") == F.col("first_mark"))).select(
        F.col("key").alias("wanted"), "members", sketched(F.col("text"), n, bands, rows, with_set=True).alias("s")
    )
    sets = again.where(F.col("wanted") == F.col("s.key")).select("s.key", "members", "s.bands", "s.set").dropDuplicates(["key"])
    dealt = met.withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")).join(sets, "key")
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "bucket",
        F.least("block", "other").alias("low"),
        F.greatest("block", "other").alias("high"),
        "band",
        "block",
        "key",
        "members",
        "bands",
        "set",
    )
    grouped = pairs.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high")
    found = stage(grouped.mapInArrow(tidy(_verify(similarity)), "key binary, root binary, links bigint"), "links")
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    edges = found.where(F.col("key") != F.col("root")).select(F.col("key").alias("src"), F.col("root").alias("dst"))
    parts = stage(connected_components(edges).withColumnRenamed("id", "key"), "parts")
    named = parts.join(classes.select("key", "first"), "key").groupBy("component").agg(F.min("first").alias("class_id"))
    linked = parts.join(stage(named, "named"), "component").select("key", "component", "class_id").join(links, "key")
    verdict = stage(
        classes.select("key", "first", "members")
        .join(linked, "key", "left")
        .select(
            "key",
            F.coalesce("component", "key").alias("class"),
            F.coalesce("class_id", "first").alias("class_id"),
            (F.col("members") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        ),
        "verdict",
    )
    of_some = some.select("id", *kept, "key").join(verdict, "key").select("id", *kept, "class", "class_id", "n_links")
    of_none = members.where(F.col("key").isNull()).select(
        "id", *kept, F.col("key").alias("class"), F.col("id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links")
    )
    return of_some.unionByName(of_none)


def joined(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``(key, class_id, n_links)`` of every row: the smallest id that links reach, and the rows it links to."""
    return _classified(docs, key, text, **how).select(F.col("id").alias(key), "class_id", "n_links")


def without_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One document of every class, that of the smallest id (null last), then text hash; all rows without words.

    Ids need not be unique: rows that share one, or have none, stand for themselves.
    """
    hashed = F.sha2(F.col(text).cast("string"), 256)
    rows = _classified(docs, key, text, **how, hashed=hashed).where(F.col("class").isNotNull())
    first = rows.groupBy("class").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "hashed")).alias("least"))
    first = first.select(F.col("least.id").alias("_first_id"), F.col("least.hashed").alias("_first_hash"))
    worded = whole(F.col(text)).rlike(WORD)
    chosen = docs.where(worded).withColumn("_hash", hashed)
    chosen = chosen.join(first, F.col(key).eqNullSafe(F.col("_first_id")) & (F.col("_hash") == F.col("_first_hash")), "left_semi")
    return chosen.dropDuplicates([key, "_hash"]).drop("_hash").unionByName(docs.where(~worded))
