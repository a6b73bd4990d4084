"""Co-occurrence graphs, label propagation, components, modularity.

Edges are ``(src, dst)`` in both directions.  The co-occurrence graph is stored as lists of
larger neighbours; label propagation and modularity read neighbour lists, in which a hub has
as many rows as its neighbours take.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oremill.operators import packing as pk
from oremill.operators.baskets import ROW_ITEMS, basket_sets, basket_sizes, longer_than
from oremill.operators.numbering import row_numbers
from oremill.plans.staging import stage, stage_counted, stage_observed, unstage

POPULAR = 1_000  # basket count above which an item counts as popular
HUB = 10_000  # neighbours per salt
INTEGERS = {"tinyint", "smallint", "int", "bigint"}


def symmetric(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, without loops and duplicates."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return both.where(F.col("src") != F.col("dst")).distinct()


def mirrored(pairs: DataFrame) -> DataFrame:
    """Both directions of pairs that are already distinct and have ``src < dst``."""
    back = F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return pairs.select(F.inline(F.array(F.struct("src", "dst"), back)))


def mirrored_lists(lists: DataFrame) -> DataFrame:
    """Both directions of the pairs of ``(src, others)``, each of which is there once."""
    return mirrored(lists.select("src", F.explode("others").alias("dst")))


def stored_edges(lists: DataFrame) -> DataFrame:
    """``mirrored_lists`` of stored lists, which counts as stored itself."""
    edges = mirrored_lists(lists)
    edges._oremill_path = lists._oremill_path
    return edges


def neighbour_lists(edges: DataFrame) -> DataFrame:
    """``(src, others)``: the ends of each vertex's edges in a few rows, of bounded length.

    One shuffle of the edges, sorted by vertex and packed as they come.
    """
    src, dst = (edges.schema[c].dataType.simpleString() for c in ("src", "dst"))
    near = edges.select("src", "dst").repartition("src").sortWithinPartitions("src")
    return near.mapInArrow(pk.neighbour_rows, f"src {src}, others array<{dst}>")


def both_lists(lists: DataFrame) -> DataFrame:
    """``neighbour_lists`` from the ``(src, others)`` of pairs each of which is there once.

    The pairs travel packed, in both directions, to where a vertex's neighbours are put together.
    """
    kinds = [lists.schema["src"].dataType.simpleString(), lists.schema["others"].dataType.elementType.simpleString()]
    if not set(kinds) <= INTEGERS:
        return neighbour_lists(mirrored_lists(lists))
    pairs = lists.agg(F.sum(F.size("others"))).first()[0] or 0
    wide = lists.select(F.col("src").cast("bigint"), F.col("others").cast("array<bigint>"))
    parts, tasks = _parts(lists, 2 * pairs)
    met = wide.mapInArrow(pk.both_ways(parts), pk.MESSAGES).repartition(tasks, "part")
    near = met.groupBy("part").applyInArrow(pk.neighbours, "src bigint, others array<bigint>")
    return near.select(F.col("src").cast(kinds[0]), F.col("others").cast(f"array<{kinds[1]}>"))


def _parts(df: DataFrame, pairs: int) -> tuple[int, int]:
    """Parts in which a worker holds its share of the pairs, and the tasks that take them."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return tasks * max(1, -(-pairs // (tasks * pk.HELD_PAIRS))), tasks


def spanning_edges(lists: DataFrame) -> DataFrame:
    """Some edges that link the same vertices as ``(src, others)``: in each task fewer than it has vertices."""
    src, others = (lists.schema[c].dataType.simpleString() for c in ("src", "others"))
    return lists.select("src", "others").mapInArrow(pk.forest, f"src {src}, dst {others[6:-1]}")


def vertices(edges: DataFrame) -> DataFrame:
    """Vertices with at least one edge (``edges`` in both directions)."""
    return edges.select(F.col("src").alias("id")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.count("*").alias("degree")).withColumnRenamed("src", "id")


def adjacency(edges: DataFrame, hub: int = HUB) -> DataFrame:
    """``(src, salt, dst, dst_salts)`` from edges in both directions.

    A vertex with more than ``hub`` neighbours has ``ceil(degree / hub)`` salts
    and its edges are spread over them by a hash of the neighbour.  Each edge
    also carries the number of salts of its far end, so whatever arrives there
    knows how many copies to make for the next step without a lookup.
    """
    salts, n_hubs = stage_counted(
        degrees(edges)
        .where(F.col("degree") > hub)
        .select("id", F.ceil(F.col("degree") / F.lit(hub)).cast("int").alias("salts")),
        "hubs",
    )
    if not n_hubs:  # nothing to look up, so no edge is shuffled or sorted for it
        return edges.select("src", F.lit(0).alias("salt"), "dst", F.lit(1).alias("dst_salts"))
    of_src = salts.select(F.col("id").alias("src"), F.col("salts").alias("src_salts"))
    of_dst = salts.select(F.col("id").alias("dst"), F.col("salts").alias("dst_salts"))
    joined = edges.join(of_src, "src", "left").join(of_dst, "dst", "left")
    return joined.select(
        "src",
        F.pmod(F.xxhash64("dst"), F.coalesce("src_salts", F.lit(1))).cast("int").alias("salt"),
        "dst",
        F.coalesce("dst_salts", F.lit(1)).alias("dst_salts"),
    )


def cooccurrence_graph(rows: DataFrame, threshold: int, popular: int = POPULAR, hub: int = HUB) -> DataFrame:
    """Symmetric edges between keys whose baskets share at least ``threshold`` items.

    The edges are stored once, in lists (see ``cooccurrence_lists``), and spelled out where they are read.
    """
    return stored_edges(cooccurrence_lists(rows, threshold, popular, hub))


def cooccurrence_lists(rows: DataFrame, threshold: int, popular: int = POPULAR, hub: int = HUB) -> DataFrame:
    """``(src, others)``, stored: keys with the larger ones whose baskets share at least ``threshold`` items with theirs.

    Baskets of fewer than ``threshold`` items take no part (length filter).  Items in at
    most ``popular`` baskets are paired from the list of these, which gives at most
    ``rows * popular`` pairs, counted basket by basket.  Popular items never meet in
    a full self-join; their share of an overlap is computed only where it can decide:

    * of the pairs that share ordinary items, only those are kept that are edges already,
      or whose popular items could make up the rest;
    * a pair that none of this keeps needs ``threshold`` popular items.  Such
      pairs must agree on one of the ``popular_items - threshold + 1`` rarest
      popular items of either side, so each basket's most popular
      ``threshold - 1`` items are left out of the search for pairs (prefix filter).
    """
    if threshold < 1:
        raise ValueError("threshold must be at least 1: any two baskets share zero items")
    rows = stage(rows, "baskets")
    if threshold > 1:
        rows = stage(longer_than(rows, threshold - 1), "baskets")
    counts = rows.groupBy("item").agg(F.count("*").alias("baskets")).where(F.col("baskets") > 1)
    counts, popularity = stage_observed(counts, "items", popular=F.count_if(F.col("baskets") > popular))
    if not popularity["popular"]:
        used: list[DataFrame] = []
        edges = stage(_pair_lists(rows, hub, threshold, used).select("src", "others"), "edges")
        unstage(*used)
        return edges

    ordinary = stage(rows.join(counts.where(F.col("baskets") <= popular), "item").select("key", "item"), "ordinary")
    popular_rows = stage(
        rows.join(counts.where(F.col("baskets") > popular), "item").select("key", "item", "baskets"), "popular"
    )
    sizes = stage(popular_rows.groupBy("key").agg(F.count("*").alias("held")), "held")
    held_src = sizes.select(F.col("key").alias("src"), F.col("held").alias("src_held"))
    held_dst = sizes.select(F.col("key").alias("dst"), F.col("held").alias("dst_held"))
    reach = F.col("shared") + F.least(F.coalesce("src_held", F.lit(0)), F.coalesce("dst_held", F.lit(0)))
    shared = _pair_counts(ordinary, hub).join(held_src, "src", "left").join(held_dst, "dst", "left").where(reach >= threshold)
    # A pair that was dropped here holds too few popular items on one side to be found below.
    rich = popular_rows.join(sizes.where(F.col("held") >= threshold), "key")
    by_popular = _pairs(_rarest(rich, threshold)).distinct().select("src", "dst", F.lit(0).cast("bigint").alias("shared"))
    met = shared.select("src", "dst", "shared").unionByName(by_popular).groupBy("src", "dst").agg(F.max("shared").alias("shared"))
    pairs = stage(met, "pairs")
    # Expand each open pair from its smaller side.
    sided = (
        pairs.where(F.col("shared") < threshold)
        .join(held_src, "src")
        .join(held_dst, "dst")
        .select(
            "src",
            "dst",
            "shared",
            F.when(F.col("src_held") <= F.col("dst_held"), F.col("src")).otherwise(F.col("dst")).alias("small"),
            F.when(F.col("src_held") <= F.col("dst_held"), F.col("dst")).otherwise(F.col("src")).alias("large"),
        )
    )
    small = popular_rows.select(F.col("key").alias("small"), "item")
    large = popular_rows.select(F.col("key").alias("large"), "item")
    confirmed = (
        sided.join(small, "small")
        .join(large, ["large", "item"])
        .groupBy("src", "dst", "shared")
        .agg(F.count("*").alias("more"))
        .where(F.col("shared") + F.col("more") >= threshold)
    )
    enough = pairs.where(F.col("shared") >= threshold)
    return stage(neighbour_lists(enough.select("src", "dst").unionByName(confirmed.select("src", "dst"))), "edges")


def _pairs(rows: DataFrame) -> DataFrame:
    left = rows.select("item", F.col("key").alias("src"))
    right = rows.select("item", F.col("key").alias("dst"))
    return left.join(right, "item").where(F.col("src") < F.col("dst")).select("src", "dst")


def _pair_counts(rows: DataFrame, hub: int = HUB) -> DataFrame:
    """``(src, dst, shared)`` for the pairs of baskets that share an item; an item's baskets fit in a row."""
    met = F.explode(F.arrays_zip("others", "shared")).alias("met")
    return _pair_lists(rows, hub).select("src", met).select("src", F.col("met.others").alias("dst"), "met.shared")


def _pair_lists(rows: DataFrame, hub: int = HUB, least: int = 1, used: list[DataFrame] | None = None) -> DataFrame:
    """``(src, others, shared)``: baskets with those of larger keys that share ``least`` items or more, and how many.

    What a basket meets in an item's list travels packed, with that of other baskets, to the part
    where that basket's pairs are counted.  The pairs of a basket of more than ``hub`` items
    are counted in several places, dealt by a hash of the other basket.  ``used`` gets the stored
    lists, which are of no use once the pairs are stored.
    """
    kind = rows.schema["key"].dataType.simpleString()
    if kind not in INTEGERS:
        return _by_number(rows, hub, least)
    sizes = basket_sizes(rows).where(F.col("size") > hub)
    large, n_large = stage_counted(sizes.select("key", F.expr(f"cast(ceil(size / {hub}) as bigint)").alias("salts")), "large")
    rows = rows.select("item", F.col("key").cast("bigint").alias("key"))
    if n_large:
        salted = rows.join(large.select(F.col("key").cast("bigint").alias("key"), "salts"), "key", "left")
        held = F.sort_array(F.collect_list(F.struct("key", F.coalesce("salts", F.lit(1)).alias("salts"))))
        lists = salted.groupBy("item").agg(held.alias("held")).select(F.col("held.key").alias("keys"), F.col("held.salts").alias("salts"))
    else:
        lists = rows.groupBy("item").agg(F.sort_array(F.collect_list("key")).alias("keys")).select("keys")
    lists, seen = stage_observed(
        lists.where(F.size("keys") > 1), "lists", pairs=F.sum(F.expr("size(keys) * (size(keys) - 1L) div 2"))
    )
    if used is not None:
        used.append(lists)
    parts, tasks = _parts(rows, seen["pairs"] or 0)
    met = lists.mapInArrow(pk.messages(parts), pk.MESSAGES).repartition(tasks, "part")
    counts = met.groupBy("part").applyInArrow(pk.counted(least), pk.COUNTED)
    return counts.select(F.col("src").cast(kind), F.col("others").cast(f"array<{kind}>"), "shared")


def _by_number(rows: DataFrame, hub: int, least: int) -> DataFrame:
    """``_pair_lists`` of keys that are no integers, by their numbers in order."""
    keys = stage(row_numbers(rows.select("key").distinct(), "key"), "keys")
    numbered = rows.join(keys, "key").select(F.col("n").alias("key"), "item")
    near = _pair_counts(numbered, hub).where(F.col("shared") >= least)
    named = near.join(keys.select(F.col("n").alias("src"), F.col("key").alias("a")), "src")
    named = named.join(keys.select(F.col("n").alias("dst"), F.col("key").alias("b")), "dst")
    return named.select(F.col("a").alias("src"), F.array("b").alias("others"), F.array("shared").alias("shared"))


def _rarest(rows: DataFrame, threshold: int) -> DataFrame:
    """Drop each basket's ``threshold - 1`` most popular items, by the order (baskets, item).

    The dropped items are a top-k per key, which Spark limits before the
    shuffle, so a basket with very many items is never gathered in one task.
    """
    if threshold == 1:
        return rows.select("key", "item")
    order = Window.partitionBy("key").orderBy(F.col("baskets").desc(), F.col("item").desc())
    dropped = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") < threshold)
    return rows.select("key", "item").join(dropped.select("key", "item"), ["key", "item"], "left_anti")


def label_propagation(
    edges: DataFrame,
    rounds: int = 5,
    cut_every: int = 5,
    hub: int = HUB,
    both_ways: bool = False,
    lists: DataFrame | None = None,
) -> DataFrame:
    """``(id, label)`` after ``rounds`` synchronous rounds.

    Every vertex takes the most frequent label of its neighbours, the smallest
    among equals.  Being synchronous, the two ends of an isolated edge swap
    labels each round.  ``both_ways`` says that ``edges`` already holds each edge once in
    either direction; ``lists`` are their ``neighbour_lists``, where they are stored.

    A label meets the neighbours of its vertex as lists, which are made once; a hub has as many
    rows of them as its neighbours take, so ``hub`` is not needed.  All labels differ before the
    first round, so that each has one vote and the smallest neighbour wins: that round
    needs one minimum a vertex, not a vote a neighbour.
    """
    if lists is None:
        lists = stage(neighbour_lists(edges if both_ways else symmetric(edges)), "lists")
    if rounds < 1:
        return lists.select(F.col("src").alias("id"), F.col("src").alias("label")).distinct()
    first = lists.groupBy(F.col("src").alias("id")).agg(F.min(F.array_min("others")).alias("label"))
    labels = stage(first, "labels")
    for done in range(2, rounds + 1):
        votes = _votes(labels, lists).groupBy("dst", "label").agg(F.count("*").alias("votes"))
        winner = votes.groupBy("dst").agg(F.min(F.struct(-F.col("votes"), F.col("label"))).alias("best"))
        labels = winner.select(F.col("dst").alias("id"), F.col("best.label").alias("label"))
        if done % cut_every == 0 and done < rounds:
            labels = stage(labels, "labels")
    return labels.select("id", "label")


def _votes(labels: DataFrame, lists: DataFrame) -> DataFrame:
    """``(dst, label)`` for every neighbour of a vertex with that label."""
    return lists.join(labels.select(F.col("id").alias("src"), "label"), "src").select("label", F.explode("others").alias("dst"))


def connected_components(edges: DataFrame, all_vertices: DataFrame | None = None) -> DataFrame:
    """``(id, component)``, a component being named by its smallest vertex.

    Alternates the large-star and small-star steps of Kiveris et al. (2014),
    which reach a forest of stars in O(log^2 V) rounds whatever the diameter.
    ``all_vertices`` (column ``id``) adds vertices without edges.
    """
    stars = edges.select(
        F.greatest("src", "dst").alias("high"), F.least("src", "dst").alias("low")
    ).where(F.col("high") != F.col("low")).distinct()
    # Stored, because the first step reads it four times.
    current = stars = stage(stars, "stars")
    seen = None
    while True:
        used: list[DataFrame] = []
        linked = stage(_large_star(stars, used), "linked")
        following, now = stage_observed(
            _small_star(linked, used),
            "stars",
            rows=F.count(F.lit(1)),
            mark=F.bit_xor(F.xxhash64("high", "low")),
        )
        unstage(current, linked, *used)
        current = stars = following
        if now == seen or not now["rows"]:
            break
        seen = now
    members = stars.select(F.col("high").alias("id"), F.col("low").alias("component"))
    roots = stars.select(F.col("low").alias("id")).distinct().withColumn("component", F.col("id"))
    labelled = members.unionByName(roots)
    if all_vertices is None:
        return labelled
    alone = all_vertices.select("id").distinct().join(labelled, "id", "left_anti")
    return labelled.unionByName(alone.withColumn("component", F.col("id")))


def _large_star(stars: DataFrame, used: list[DataFrame]) -> DataFrame:
    """Link every larger neighbour of a vertex to the smallest of its neighbourhood.

    Repeated links are left for the small-star step to merge.
    """
    near = stars.select(F.col("high").alias("at"), F.col("low").alias("to")).unionByName(
        stars.select(F.col("low").alias("at"), F.col("high").alias("to"))
    )
    # Stored, so that the join is between two plain shuffles, which can be split where a root
    # with most vertices makes one partition long.
    least = stage(near.groupBy("at").agg(F.least(F.min("to"), F.col("at")).alias("least")), "least")
    used.append(least)
    return (
        near.join(least, "at")
        .where(F.col("to") > F.col("at"))
        .select(F.col("to").alias("high"), F.col("least").alias("low"))
    )


def _small_star(stars: DataFrame, used: list[DataFrame]) -> DataFrame:
    """Link a vertex and its smaller neighbours to the smallest of them."""
    least = stage(stars.groupBy("high").agg(F.min("low").alias("least")), "least")
    used.append(least)
    hooked = (
        stars.join(least, "high")
        .where(F.col("low") > F.col("least"))
        .select(F.col("low").alias("high"), F.col("least").alias("low"))
    )
    return hooked.unionByName(least.select("high", F.col("least").alias("low"))).distinct()


def modularity(edges: DataFrame, labels: DataFrame, lists: DataFrame | None = None) -> DataFrame:
    """One row ``(edges, communities, modularity)`` for a labelling ``(id, label)``.

    ``edges`` holds both directions; ``lists`` are their ``neighbour_lists``, where they are stored.
    Per community, the share of edge ends inside it minus the square of its share of all edge ends.
    """
    if lists is None:
        lists = edges.select("src", F.array("dst").alias("others"))
    met = _votes(labels, lists).groupBy("dst", F.col("label").alias("src_label")).agg(F.count("*").alias("ends"))
    of_dst = labels.select(F.col("id").alias("dst"), F.col("label").alias("dst_label"))
    per_label = (
        met.join(of_dst, "dst")
        .groupBy("src_label")
        .agg(
            F.sum("ends").alias("ends"),
            F.sum(F.when(F.col("src_label") == F.col("dst_label"), F.col("ends")).otherwise(0)).alias("inside"),
        )
    )
    # sum(inside)/2m - sum(ends^2)/(2m)^2 needs no second pass for 2m.
    sums = per_label.agg(
        F.count("*").alias("communities"),
        F.sum("ends").alias("total"),
        F.sum("inside").alias("inside"),
        F.sum(F.pow(F.col("ends").cast("double"), F.lit(2))).alias("squares"),
    )
    total = F.col("total").cast("double")
    return sums.where(F.col("total") > 0).select(
        (F.col("total") / 2).cast("bigint").alias("edges"),
        "communities",
        (F.col("inside") / total - F.col("squares") / (total * total)).alias("modularity"),
    )


def community_listing(labels: DataFrame, length: int = ROW_ITEMS) -> DataFrame:
    """``(label, part, members, size)``: sorted members, with the community's full size.

    As in ``basket_sets``, a row holds at most ``length`` members, in ranges of their order.
    """
    rows = labels.select(F.col("label").alias("key"), F.col("id").alias("item"))
    return basket_sets(rows, length).select(F.col("key").alias("label"), "part", F.col("items").alias("members"), "size")
