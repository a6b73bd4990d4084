"""The registered queries: each operator applied to the whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oremill.functions import vectors as vec
from oremill.functions.hashing import compact_family, hash_values, utf8_int_mod
from oremill.operators import baskets as bk
from oremill.operators import clustering as cl
from oremill.operators import communities as cm
from oremill.operators import divisive as dv
from oremill.operators import itemsets as it
from oremill.operators import paths as ph
from oremill.operators import sampling as sm
from oremill.operators import sketches as sk
from oremill.operators.numbering import row_numbers
from oremill.plans.staging import stage, staging_path, unstage
from oremill.session import apply_settings
from oremill.sources import readers, reports
from oremill.streaming import closing as cs
from oremill.streaming import summaries as st

Query = Callable[[SparkSession, str], DataFrame]

SEED = 553
BATCH = 100
RESERVOIR = 100
SON_PARTS = 4
CLUSTERS = 10
FIRST_PASS = 40  # clusters that show the outliers among a fifth of 500 points or more
ALPHA = 1.1
CHUNKS = 5
MERGE_ALPHA = 0.4  # so that some of the small clusters of the merge queries are close and some are not
CHANCE_Z = 2.5
LPA_ROUNDS = 5


def _order_brands(spark: SparkSession, sf: str) -> DataFrame:
    """Baskets: the brands of each order."""
    lineitem = readers.read_table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    part = readers.read_table(spark, sf, "part").select("p_partkey", "p_brand")
    return bk.basket_rows(lineitem.join(part, lineitem.l_partkey == part.p_partkey), "l_orderkey", "p_brand")


def _share_support(rows: DataFrame) -> int:
    """0.4 % of the baskets, rounded up."""
    baskets = rows.select("key").distinct().count()
    return max(1, -(-baskets * 4 // 1000))


def _supplier_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Baskets: the parts of each supplier."""
    return bk.basket_rows(readers.read_table(spark, sf, "lineitem"), "l_suppkey", "l_partkey")


def chance_threshold(keys: int, items: int, rows: int, z: float = CHANCE_Z) -> int:
    """An overlap ``z`` standard deviations above that of two random baskets of average size."""
    size = rows / keys
    expected = size * size / items
    spread = expected**0.5 * (1 - size / items)
    return max(1, -int(-(expected + z * spread) // 1))


def _overlap_threshold(rows: DataFrame) -> int:
    keys = rows.groupBy("key").agg(F.count("*").alias("size")).agg(F.count("*"), F.sum("size")).first()
    items = rows.select("item").distinct().count()
    return chance_threshold(max(keys[0], 1), max(items, 1), keys[1] or 0)


def _graph_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers that share more parts than chance explains: each with the larger ones, stored."""
    rows = stage(_supplier_parts(spark, sf), "baskets")
    lists = cm.cooccurrence_lists(rows, _overlap_threshold(rows))
    unstage(rows)
    return lists


def _graph(spark: SparkSession, sf: str) -> DataFrame:
    """The edges of that graph, in both directions."""
    rows = stage(_supplier_parts(spark, sf), "baskets")
    edges = cm.cooccurrence_graph(rows, _overlap_threshold(rows))
    unstage(rows)
    return edges


def _orders_stream(spark: SparkSession, sf: str) -> DataFrame:
    return sk.numbered(readers.read_table(spark, sf, "orders"), "o_orderkey", "o_custkey")


def _points(spark: SparkSession, sf: str) -> DataFrame:
    return cl.as_points(readers.read_table(spark, sf, "embeddings"), "vec_id", "embedding")


def _labelled_points(spark: SparkSession, sf: str) -> DataFrame:
    table = readers.read_table(spark, sf, "embeddings")
    return table.select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features"), F.col("label").alias("cluster")
    )


# Baskets and itemsets


def baskets_order_brand(spark: SparkSession, sf: str) -> DataFrame:
    sets = bk.basket_sets(_order_brands(spark, sf))
    return sets.select("key", "part", F.array_join("items", ",").alias("items"), "size")


def baskets_min_size(spark: SparkSession, sf: str) -> DataFrame:
    sets = bk.basket_sets(bk.longer_than(stage(_order_brands(spark, sf), "baskets"), 3))
    return sets.select("key", "part", F.array_join("items", ",").alias("items"), "size")


def item_support(spark: SparkSession, sf: str) -> DataFrame:
    rows = stage(_order_brands(spark, sf), "baskets")
    return bk.item_support(rows, _share_support(rows))


def _printed(itemsets: DataFrame) -> DataFrame:
    return itemsets.withColumn("itemset", F.array_join("itemset", ","))


def frequent_itemsets(spark: SparkSession, sf: str) -> DataFrame:
    rows = stage(_order_brands(spark, sf), "baskets")
    return _printed(it.frequent_itemsets(rows, _share_support(rows)))


def frequent_itemsets_inverted(spark: SparkSession, sf: str) -> DataFrame:
    rows = stage(_supplier_parts(spark, sf), "baskets")
    support = _overlap_threshold(rows)
    inverted = bk.basket_rows(rows, "item", "key")
    return _printed(it.frequent_itemsets(inverted, support))


def _son_part():
    return F.pmod(F.col("key"), F.lit(SON_PARTS))


def local_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    rows = stage(_order_brands(spark, sf), "baskets")
    return it.local_thresholds(rows.withColumn("part", _son_part()), _share_support(rows))


def son_candidates(spark: SparkSession, sf: str) -> DataFrame:
    rows = stage(_order_brands(spark, sf), "baskets")
    return _printed(it.son_candidates(rows, _share_support(rows), _son_part()))


def son_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Second pass: the exact support of every candidate."""
    rows = stage(_order_brands(spark, sf), "baskets")
    candidates = it.son_candidates(rows, _share_support(rows), _son_part())
    return _printed(it.count_itemsets(rows, candidates))


def itemset_report(spark: SparkSession, sf: str) -> DataFrame:
    rows = stage(_order_brands(spark, sf), "baskets")
    return reports.itemset_lines(*it.son_itemsets(rows, _share_support(rows), _son_part()))


# Graphs


def cooccurrence_edges(spark: SparkSession, sf: str) -> DataFrame:
    return _graph(spark, sf)


def vertex_degrees(spark: SparkSession, sf: str) -> DataFrame:
    return cm.degrees(_graph(spark, sf))


def lpa_labels(spark: SparkSession, sf: str) -> DataFrame:
    pairs = _graph_lists(spark, sf)
    lists = stage(cm.both_lists(pairs), "lists")
    return cm.label_propagation(cm.mirrored_lists(pairs), LPA_ROUNDS, both_ways=True, lists=lists)


def _listing_text(listing: DataFrame) -> DataFrame:
    return listing.select("label", "part", F.array_join("members", ",").alias("members"), "size")


def lpa_communities(spark: SparkSession, sf: str) -> DataFrame:
    return _listing_text(cm.community_listing(stage(lpa_labels(spark, sf), "labels")))


def community_lines(spark: SparkSession, sf: str) -> DataFrame:
    return reports.community_lines(cm.community_listing(stage(lpa_labels(spark, sf), "labels")))


def shortest_path_dag(spark: SparkSession, sf: str) -> DataFrame:
    pairs = _graph_lists(spark, sf)
    components = cm.connected_components(cm.spanning_edges(pairs))
    return ph.shortest_paths(cm.stored_edges(pairs), both_ways=True, components=components)


def _betweenness(pairs: DataFrame) -> DataFrame:
    components = cm.connected_components(cm.spanning_edges(pairs))
    return ph.edge_betweenness(cm.stored_edges(pairs), both_ways=True, components=components)


def edge_betweenness(spark: SparkSession, sf: str) -> DataFrame:
    values = _betweenness(_graph_lists(spark, sf))
    return values.withColumn("betweenness", F.round("betweenness", 6))


def top_edges(spark: SparkSession, sf: str) -> DataFrame:
    values = stage(_betweenness(_graph_lists(spark, sf)), "scores")
    return ph.top_edges(values).withColumn("betweenness", F.round("betweenness", 6))


def betweenness_lines(spark: SparkSession, sf: str) -> DataFrame:
    return reports.betweenness_lines(_betweenness(_graph_lists(spark, sf)))


def connected_components(spark: SparkSession, sf: str) -> DataFrame:
    """Every supplier; those without an edge are components of their own."""
    everyone = readers.read_table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"))
    return cm.connected_components(cm.spanning_edges(_graph_lists(spark, sf)), everyone)


def modularity(spark: SparkSession, sf: str) -> DataFrame:
    pairs = _graph_lists(spark, sf)
    edges, lists = cm.mirrored_lists(pairs), stage(cm.both_lists(pairs), "lists")
    labels = stage(cm.label_propagation(edges, LPA_ROUNDS, both_ways=True, lists=lists), "labels")
    score = cm.modularity(edges, labels, lists)
    return score.withColumn("modularity", F.round("modularity", 6))


def first_cut(spark: SparkSession, sf: str) -> DataFrame:
    """One divisive step: components after removing the top edges."""
    pairs = _graph_lists(spark, sf)
    edges = cm.mirrored_lists(pairs)
    cut = ph.top_edges(stage(_betweenness(pairs), "scores"))
    return cm.connected_components(stage(ph.without_edges(edges, cut), "edges"), cm.vertices(edges))


def girvan_newman_history(spark: SparkSession, sf: str) -> DataFrame:
    return dv.girvan_newman(_graph(spark, sf))[0].withColumn("modularity", F.round("modularity", 6))


def girvan_newman(spark: SparkSession, sf: str) -> DataFrame:
    return _listing_text(cm.community_listing(dv.girvan_newman(_graph(spark, sf))[1]))


def girvan_newman_summary(spark: SparkSession, sf: str) -> DataFrame:
    """First round, last round and totals of the whole run."""
    rounds = dv.girvan_newman(_graph(spark, sf))[0]
    return rounds.groupBy().agg(
        F.sum("removed").alias("removed"),
        F.min_by("removed", "cut").alias("first_removed"),
        F.min_by("communities", "cut").alias("first_communities"),
        F.round(F.min_by("modularity", "cut"), 6).alias("first_modularity"),
        F.max_by("communities", "cut").alias("last_communities"),
        F.round(F.max_by("modularity", "cut"), 6).alias("last_modularity"),
    )


# Clustering


def kmeans_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return cl.kmeans_labels(_points(spark, sf), CLUSTERS, SEED).select("id", "cluster")


def kmeans_step(spark: SparkSession, sf: str) -> DataFrame:
    """One step of K-Means from fixed seeds: assignment, then sums per cluster."""
    return _long_summary(cl.cluster_summary(cl.seeded_labels(_points(spark, sf), CLUSTERS)), "cluster")


def bfr_peel(spark: SparkSession, sf: str) -> DataFrame:
    """Points of the first chunk, and whether a first clustering leaves them alone."""
    first = cl.with_chunk(_points(spark, sf), 5, SEED).where("chunk = 0").drop("chunk")
    groups, alone = cl.split_singletons(stage(cl.seeded_labels(first, FIRST_PASS), "peel"))
    return groups.select("id", "cluster", F.lit(False).alias("outlier")).unionByName(
        alone.select("id", "cluster", F.lit(True).alias("outlier"))
    )


def bfr_first_round(spark: SparkSession, sf: str) -> DataFrame:
    """Discard, compression and retained set after the first chunk, with clusters from fixed seeds."""
    rounds = cl.bfr(
        _points(spark, sf), CLUSTERS, alpha=ALPHA, seed=SEED, first_pass_clusters=FIRST_PASS, clusterer=cl.seeded_labels
    )[0]
    return rounds.where(F.col("round") == 1)


def chunk_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return cl.with_chunk(_points(spark, sf), 5, SEED).groupBy("chunk").agg(F.count("*").alias("points"))


def _long_summary(summary: DataFrame, *by: str) -> DataFrame:
    zipped = summary.select(*by, "n", F.posexplode(F.arrays_zip("sum", "sumsq")).alias("dim", "v"))
    return zipped.select(
        *by, "dim", "n", F.round("v.sum", 6).alias("sum"), F.round("v.sumsq", 6).alias("sumsq")
    )


def bfr_ds_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Count, sum and sum of squares per dimension of every cluster in every chunk."""
    chunked = cl.with_chunk(_labelled_points(spark, sf), 5, SEED)
    return _long_summary(cl.cluster_summary(chunked, "chunk", "cluster"), "chunk", "cluster")


def bfr_assign(spark: SparkSession, sf: str) -> DataFrame:
    labelled = _labelled_points(spark, sf)
    clusters = cl.Summaries.collect(cl.cluster_summary(labelled))
    assigned = cl.assign(labelled.drop("cluster"), clusters, ALPHA)
    return assigned.select("id", "cluster", F.round("distance", 6).alias("distance"))


def bfr_own_distance(spark: SparkSession, sf: str) -> DataFrame:
    """Distance of every point to its own cluster, in column expressions only."""
    labelled = _labelled_points(spark, sf)
    total, squares, n = F.col("sum"), F.col("sumsq"), F.col("n")
    distance = vec.mahalanobis(F.col("features"), vec.centroid(total, n), vec.variance(total, squares, n))
    joined = labelled.join(cl.cluster_summary(labelled), "cluster")
    return joined.select("id", "cluster", F.round(distance, 6).alias("distance"))


def bfr_merge_pairs(spark: SparkSession, sf: str) -> DataFrame:
    pairs = cl.merge_pairs(cl.cluster_summary(_labelled_points(spark, sf)), ALPHA)
    return pairs.withColumns({c: F.round(c, 6) for c in ("a_to_b", "b_to_a")})


def bfr_rounds(spark: SparkSession, sf: str) -> DataFrame:
    return cl.bfr(_points(spark, sf), CLUSTERS, alpha=ALPHA, seed=SEED, first_pass_clusters=FIRST_PASS)[0]


def bfr_labels(spark: SparkSession, sf: str) -> DataFrame:
    return cl.bfr(_points(spark, sf), CLUSTERS, alpha=ALPHA, seed=SEED, first_pass_clusters=FIRST_PASS)[1]


def _small_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Summaries of the points of each label in each chunk, chunk by chunk."""
    chunked = cl.with_chunk(_labelled_points(spark, sf), CHUNKS, SEED)
    numbered = chunked.withColumn("cluster", (F.col("chunk") * CLUSTERS + F.col("cluster")).cast("int"))
    return stage(cl.cluster_summary(numbered), "summary")


def bfr_cs_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Where each of many small clusters goes when close ones merge first-fit."""
    return cl.merge_targets(_small_clusters(spark, sf), MERGE_ALPHA)


def bfr_cs_merged(spark: SparkSession, sf: str) -> DataFrame:
    """The summaries after that merge."""
    summary = _small_clusters(spark, sf)
    return _long_summary(cl.moved(summary, cl.merge_targets(summary, MERGE_ALPHA)), "cluster")


def bfr_ds_merge(spark: SparkSession, sf: str) -> DataFrame:
    """The clusters of later chunks that join one of the first chunk's."""
    summary = _small_clusters(spark, sf)
    first = F.col("cluster") < CLUSTERS
    return cl.discard_targets(summary.where(~first), summary.where(first), MERGE_ALPHA)


def chunk_file_order(spark: SparkSession, sf: str) -> DataFrame:
    """Row numbers by id, and chunks of a fifth of the rows each in that order."""
    points = _points(spark, sf).select("id")
    return cl.with_file_chunk(points, CHUNKS)


def _fixed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """All rounds over chunks in file order, with clusters from fixed seeds."""
    return cl.bfr(
        _points(spark, sf), CLUSTERS, CHUNKS, ALPHA, first_pass_clusters=FIRST_PASS,
        clusterer=cl.seeded_labels, chunker=lambda points: cl.with_file_chunk(points, CHUNKS),
    )


def bfr_rounds_fixed(spark: SparkSession, sf: str) -> DataFrame:
    return _fixed(spark, sf)[0]


def bfr_labels_fixed(spark: SparkSession, sf: str) -> DataFrame:
    return _fixed(spark, sf)[1]


def labels_by_id(spark: SparkSession, sf: str) -> DataFrame:
    """Final labels numbered in the order of point ids."""
    return row_numbers(_fixed(spark, sf)[1], "id")


def clustering_file(spark: SparkSession, sf: str) -> DataFrame:
    """The clustering report as an ordered file, read back with line numbers."""
    path = staging_path(spark, "report")
    reports.write_clustering_report(*_fixed(spark, sf), path)
    return readers.numbered_lines(spark, path)


def clustering_report(spark: SparkSession, sf: str) -> DataFrame:
    rounds, labels = cl.bfr(_points(spark, sf), CLUSTERS, alpha=ALPHA, seed=SEED, first_pass_clusters=FIRST_PASS)
    results = labels.select(
        F.lit("clustering").alias("section"),
        F.col("id").alias("place"),
        F.concat_ws(",", F.col("id").cast("string"), F.col("cluster").cast("string")).alias("line"),
    )
    return reports.round_lines(rounds).select(
        F.lit("intermediate").alias("section"), F.col("round").cast("bigint").alias("place"), "line"
    ).unionByName(results)


# Streams


def bootstrap_batches(spark: SparkSession, sf: str) -> DataFrame:
    """As many draws with replacement as there are orders, in batches of 100."""
    orders = readers.read_table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    batches = -(-orders.count() // BATCH)
    return sm.bootstrap_batches(orders, "o_orderkey", BATCH, batches, SEED)


def hash_family(spark: SparkSession, sf: str) -> DataFrame:
    family = compact_family()
    users = _orders_stream(spark, sf).select("user").distinct()
    hashed = users.withColumn("x", utf8_int_mod(F.col("user"), family.prime))
    values = [h.alias(f"h{i}") for i, h in enumerate(hash_values(F.col("x"), family))]
    return hashed.select("user", "x", *values)


def bloom_fpr(spark: SparkSession, sf: str) -> DataFrame:
    rates = sk.bloom_fpr(_orders_stream(spark, sf), BATCH, compact_family())
    return rates.withColumn("fpr", F.round("fpr", 6))


def fm_estimate(spark: SparkSession, sf: str) -> DataFrame:
    return sk.fm_estimate(_orders_stream(spark, sf), BATCH, compact_family())


def fm_csv(spark: SparkSession, sf: str) -> DataFrame:
    """The estimates written as CSV and read back."""
    report = fm_estimate(spark, sf).select(
        F.col("batch").alias("Time"), F.col("truth").alias("Ground Truth"), F.col("estimate").alias("Estimation")
    )
    path = staging_path(spark, "csv")
    reports.write_csv(report, path, "Time")
    back = spark.read.schema("time bigint, ground_truth bigint, estimation bigint")
    return back.csv(path, header=True)


def _written(spark: SparkSession, lines: DataFrame, *order) -> DataFrame:
    """A report written as an ordered file and read back with line numbers."""
    path = staging_path(spark, "report")
    reports.write_lines(lines, path, *order)
    return readers.numbered_lines(spark, path)


def itemset_report_file(spark: SparkSession, sf: str) -> DataFrame:
    path = staging_path(spark, "report")
    reports.write_itemset_report(stage(itemset_report(spark, sf), "itemsets"), path)
    return readers.numbered_lines(spark, path)


def betweenness_file(spark: SparkSession, sf: str) -> DataFrame:
    return _written(spark, betweenness_lines(spark, sf), F.desc("betweenness"), "src", "dst")


def community_file(spark: SparkSession, sf: str) -> DataFrame:
    path = staging_path(spark, "report")
    reports.write_community_report(stage(community_lines(spark, sf), "lines"), path)
    return readers.numbered_lines(spark, path)


def fpr_csv(spark: SparkSession, sf: str) -> DataFrame:
    """The false-positive rates written as CSV and read back."""
    path = staging_path(spark, "csv")
    reports.write_csv(bloom_fpr(spark, sf).select(F.col("batch").alias("Time"), F.col("fpr").alias("FPR")), path, "Time")
    return spark.read.schema("time bigint, fpr double").csv(path, header=True)


def reservoir_csv(spark: SparkSession, sf: str) -> DataFrame:
    """The snapshots written as CSV and read back."""
    path = staging_path(spark, "csv")
    shots = reservoir_snapshots(spark, sf).drop("batch")
    reports.write_csv(shots, path, "seqnum")
    return spark.read.schema(shots.schema).csv(path, header=True)


def reservoir_sample(spark: SparkSession, sf: str) -> DataFrame:
    return sm.reservoir(_orders_stream(spark, sf), RESERVOIR, SEED)


def reservoir_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    return sm.reservoir_snapshots(_orders_stream(spark, sf), RESERVOIR, BATCH, SEED)


def _events_stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = readers.read_table(spark, sf, "events").schema
    # A glob, because a streaming source wants a folder or a pattern.
    return sk.numbered(st.read_stream(spark, f"{sf}/events.parque[t]", schema), "event_id", "user_id")


def stream_fm(spark: SparkSession, sf: str) -> DataFrame:
    return st.stream_fm(_events_stream(spark, sf), BATCH, compact_family(), staging_path(spark, "stream"))


def stream_reservoir(spark: SparkSession, sf: str) -> DataFrame:
    return st.stream_reservoir(_events_stream(spark, sf), RESERVOIR, SEED, staging_path(spark, "stream"))


SLICES = 3  # the events arrive in as many files, one after the other


def _arriving(spark: SparkSession, sf: str) -> tuple[str, Callable[[int], None], Callable[[], DataFrame]]:
    """A folder for a stream's tables, a function that lets a slice of the events arrive, and the stream of what arrives."""
    folder, store = staging_path(spark, "stream"), staging_path(spark, "slices")
    feed = f"{folder}/feed"
    cs.in_slices(_events_stream(spark, sf), store, SLICES)
    spark.createDataFrame([], "n bigint, user string").write.parquet(feed)

    def stream() -> DataFrame:
        return st.read_stream(spark, feed, spark.read.parquet(feed).schema, files_per_trigger=1)

    return folder, lambda number: cs.arrive(spark, store, number, feed), stream


def _all_arrived(spark: SparkSession, sf: str) -> tuple[str, DataFrame]:
    """The same with all slices there, and the row that closes the last batch."""
    folder, arrive, stream = _arriving(spark, sf)
    for number in range(SLICES):
        arrive(number)
    end = spark.range(1).select(F.lit(cs.CLOSING).alias("n"), F.lit(None).cast("string").alias("user"))
    end.write.mode("append").parquet(f"{folder}/feed")
    return folder, stream()


def stream_bloom(spark: SparkSession, sf: str) -> DataFrame:
    """False-positive rates judged micro-batch by micro-batch, with a stop after the first."""
    folder, arrive, stream = _arriving(spark, sf)
    family = compact_family()
    for number in range(SLICES):
        arrive(number)
        if number in (0, SLICES - 1):
            cs.stream_bloom(stream(), BATCH, family, folder)
    return cs.bloom_rates(spark, BATCH, family, folder).withColumn("fpr", F.round("fpr", 6))


def stream_fm_batches(spark: SparkSession, sf: str) -> DataFrame:
    folder, stream = _all_arrived(spark, sf)
    return cs.stream_fm_batches(stream, BATCH, compact_family(), folder, late=2 * BATCH)


def stream_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    folder, stream = _all_arrived(spark, sf)
    return cs.stream_snapshots(stream, RESERVOIR, BATCH, SEED, folder, late=2 * BATCH)


def stream_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    """The draws of ``bootstrap_batches`` as a stream that meets the table of orders."""
    orders = readers.read_table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    rows = orders.count()
    folder = staging_path(spark, "stream")
    draws = spark.range(-(-rows // BATCH) * BATCH).select(F.col("id").alias("draw"))
    draws.repartitionByRange(SLICES, "draw").write.parquet(f"{folder}/feed")
    stream = st.read_stream(spark, f"{folder}/feed", draws.schema, files_per_trigger=1)
    return cs.stream_bootstrap(stream, orders, "o_orderkey", rows, BATCH, SEED, folder)


# Text sources


def basket_csv(spark: SparkSession, sf: str) -> DataFrame:
    """Order/part pairs written with a header line, read back by name and by the lettered-line rule."""
    pairs = readers.read_table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("user_id"), F.col("l_partkey").alias("business_id")
    )
    path = staging_path(spark, "csv")
    reports.write_csv(pairs, path)
    by_name = readers.read_basket_csv(spark, path)
    by_rule = readers.read_unlettered_csv(spark, path)
    named = bk.basket_rows(by_name, "user_id", "business_id")
    ruled = bk.basket_rows(by_rule, "user_id", "business_id")
    counted = [
        df.groupBy("key").agg(F.count("*").alias("items"), F.min("item").alias("first_item")).withColumn("reader", F.lit(name))
        for name, df in (("header", named), ("lettered", ruled))
    ]
    return counted[0].unionByName(counted[1])


RETAIL_NAMES = ("date", "customer", "c2", "c3", "c4", "product")


def _retail_text(spark: SparkSession, sf: str, broken: bool) -> str:
    """Order lines as a quoted retail file; with ``broken``, some lines without number, customer or last column."""
    orders = readers.read_table(spark, sf, "orders").select(
        "o_orderkey", F.date_format("o_orderdate", "MM/dd/yyyy").alias("date"), F.col("o_custkey").cast("string").alias("customer")
    )
    lineitem = readers.read_table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    joined = lineitem.join(orders, lineitem.l_orderkey == orders.o_orderkey)
    product = F.lpad(F.col("l_partkey").cast("string"), 12, "0")
    customer, key = F.col("customer"), F.col("l_orderkey")
    if broken:
        product = F.when(key % 97 == 0, F.concat(F.lit("P"), product)).otherwise(product)
        customer = F.when(key % 89 == 0, F.lit("")).otherwise(customer)
    fields = ["date", customer, F.lit("-"), F.col("l_linenumber").cast("string"), F.lit("")]
    line = F.concat_ws(",", *[F.concat(F.lit('"'), f, F.lit('"')) for f in fields])
    whole = F.concat(line, F.lit(',"'), product, F.lit('"'))
    text = joined.select((F.when(key % 83 == 0, line).otherwise(whole) if broken else whole).alias(",".join(RETAIL_NAMES)))
    path = staging_path(spark, "csv")
    # The writer gives every file its header.  The lines are quoted already: its own signs never occur in them.
    # A null would be a blank line, which the reader passes over.
    text.dropna().write.csv(path, header=True, sep="\x01", quote="\x02", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return path


def retail_csv(spark: SparkSession, sf: str) -> DataFrame:
    """Quoted retail lines with zero-padded products, read into distinct basket rows."""
    path = _retail_text(spark, sf, broken=False)
    return bk.basket_rows(readers.read_retail_csv(spark, path), "key", "item")


def retail_broken_csv(spark: SparkSession, sf: str) -> DataFrame:
    """The same from a file with broken lines: basket rows of the others."""
    path = _retail_text(spark, sf, broken=True)
    return bk.basket_rows(readers.read_retail_csv(spark, path), "key", "item")


def retail_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """The broken lines with their reasons."""
    return readers.retail_rejects(spark, _retail_text(spark, sf, broken=True))


def points_csv(spark: SparkSession, sf: str) -> DataFrame:
    """Points written as comma-separated text and parsed; the second field is skipped."""
    lines = readers.read_table(spark, sf, "embeddings").select(
        F.concat_ws(
            ",",
            F.col("vec_id").cast("string"),
            F.col("label").cast("string"),
            F.array_join(F.transform("embedding", lambda x: x.cast("double").cast("string")), ","),
        ).alias("value")
    )
    path = staging_path(spark, "points")
    lines.write.text(path)
    points = readers.read_points_csv(spark, path)
    return points.select(
        "id",
        F.size("features").alias("dims"),
        F.round(F.aggregate("features", F.lit(0.0), lambda acc, x: acc + x * x), 6).alias("norm2"),
    )


def _registered() -> dict[str, Query]:
    functions = (
        baskets_order_brand, baskets_min_size, item_support, frequent_itemsets, frequent_itemsets_inverted,
        local_thresholds, son_candidates, son_counts, itemset_report,
        cooccurrence_edges, vertex_degrees, lpa_labels, lpa_communities, community_lines, shortest_path_dag,
        edge_betweenness, top_edges, betweenness_lines, connected_components, modularity, first_cut,
        girvan_newman_history, girvan_newman, girvan_newman_summary,
        kmeans_clusters, kmeans_step, bfr_peel, bfr_first_round, chunk_sizes, bfr_ds_summary, bfr_assign, bfr_own_distance, bfr_merge_pairs, bfr_rounds, bfr_labels,
        bfr_cs_merge, bfr_cs_merged, bfr_ds_merge, chunk_file_order, bfr_rounds_fixed, bfr_labels_fixed, labels_by_id, clustering_file,
        clustering_report,
        itemset_report_file, betweenness_file, community_file, fpr_csv, reservoir_csv,
        bootstrap_batches, hash_family, bloom_fpr, fm_estimate, fm_csv, reservoir_sample, reservoir_snapshots,
        stream_fm, stream_reservoir, stream_bloom, stream_fm_batches, stream_snapshots, stream_bootstrap,
        basket_csv, retail_csv, retail_broken_csv, retail_rejects, points_csv,
    )
    return {f.__name__: _tuned(f) for f in functions}


def _tuned(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(apply_settings(spark), sf_dir)

    run.__name__, run.__doc__ = query.__name__, query.__doc__
    return run


QUERIES = _registered()
