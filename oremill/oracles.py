"""Plain SQL for each query with an exact SQL form, over the same tables."""

from __future__ import annotations

from oremill.functions.hashing import COMPACT_BITS, COMPACT_PRIME, SLOPES
from oremill.operators.baskets import ROW_ITEMS
from oremill.operators.sampling import SNAPSHOT_SLOTS
from oremill.queries import (
    ALPHA, BATCH, CHANCE_Z, CHUNKS, CLUSTERS, FIRST_PASS, LPA_ROUNDS, MERGE_ALPHA, RESERVOIR, SEED, SON_PARTS,
)

# The joins below are unrolled to this many items per itemset; it has to exceed
# the largest itemset that reaches the support.
MOST = 8

# Baskets of brands per order, and the support of 0.4 % of the baskets.
BASKETS = """
baskets AS (
  SELECT DISTINCT l_orderkey AS key, p_brand AS item
  FROM lineitem JOIN part ON l_partkey = p_partkey
  WHERE l_orderkey IS NOT NULL AND p_brand IS NOT NULL
),
sizes AS (SELECT key, count(*) AS size FROM baskets GROUP BY key),
support AS (SELECT greatest(1, (count(*) * 4 + 999) // 1000) AS s FROM sizes)
"""

SUPPLIER_BASKETS = f"""
baskets AS (
  SELECT DISTINCT l_suppkey AS key, l_partkey AS item FROM lineitem
  WHERE l_suppkey IS NOT NULL AND l_partkey IS NOT NULL
),
shape AS (
  SELECT count(*)::DOUBLE / count(DISTINCT key) AS size, count(DISTINCT item) AS items FROM baskets
),
support AS (
  SELECT greatest(1, ceil(size * size / items + {CHANCE_Z} * (sqrt(size * size / items) * (1 - size / items))))::BIGINT
    AS s
  FROM shape
)
"""

GRAPH = f"""
{SUPPLIER_BASKETS},
edges AS (
  SELECT a.key AS src, b.key AS dst
  FROM baskets a JOIN baskets b ON a.item = b.item AND a.key <> b.key
  GROUP BY a.key, b.key HAVING count(*) >= (SELECT s FROM support)
),
vertices AS (SELECT DISTINCT src AS id FROM edges)
"""

LABELS = "".join(
    f""",
l{i} AS (
  SELECT id, label FROM (
    SELECT e.src AS id, l.label,
           row_number() OVER (PARTITION BY e.src ORDER BY count(*) DESC, l.label) AS place
    FROM edges e JOIN {'(SELECT id, id AS label FROM vertices)' if i == 1 else f'l{i - 1}'} l ON l.id = e.dst
    GROUP BY e.src, l.label
  ) WHERE place = 1
)"""
    for i in range(1, LPA_ROUNDS + 1)
) + f", labels AS (SELECT * FROM l{LPA_ROUNDS})"

PATHS = """,
walk(root, node, dist) AS (
  SELECT id, id, 0 FROM vertices
  UNION
  SELECT w.root, e.dst, w.dist + 1 FROM walk w JOIN edges e ON e.src = w.node
  WHERE w.dist < (SELECT count(*) FROM vertices)
),
nearest AS (SELECT root, node, min(dist) AS dist FROM walk GROUP BY root, node),
paths(root, node, dist, sigma) AS (
  SELECT id, id, 0, 1.0::DOUBLE FROM vertices
  UNION ALL
  SELECT p.root, e.dst, p.dist + 1, sum(p.sigma)
  FROM paths p JOIN edges e ON e.src = p.node
  JOIN nearest n ON n.root = p.root AND n.node = e.dst AND n.dist = p.dist + 1
  GROUP BY p.root, e.dst, p.dist
)"""

# Each edge (u, v) carries sigma(s,u) * sigma(v,t) / sigma(s,t) of every pair it lies between.
BETWEENNESS = (
    PATHS
    + """,
betweenness AS (
  SELECT least(e.src, e.dst) AS src, greatest(e.src, e.dst) AS dst,
         sum(su.sigma * vt.sigma / st.sigma) / 2 AS betweenness
  FROM edges e
  JOIN paths su ON su.node = e.src
  JOIN paths vt ON vt.root = e.dst
  JOIN paths st ON st.root = su.root AND st.node = vt.node AND st.dist = su.dist + 1 + vt.dist
  GROUP BY 1, 2
),
highest AS (
  SELECT * FROM betweenness WHERE betweenness >= (SELECT max(betweenness) FROM betweenness) * (1 - 1e-9)
)"""
)


def _ranked(rows: str, group: str, item: str) -> str:
    """The rows with the size of their group, and the part that their rank falls in."""
    return f"""(
          SELECT *, ((row_number() OVER (PARTITION BY {group} ORDER BY {item}) - 1) // {ROW_ITEMS})::INT AS part,
                 count(*) OVER (PARTITION BY {group}) AS size
          FROM {rows}
        )"""


def _reach(edges: str, ids: str) -> str:
    return f"""
reach(id, other) AS (
  SELECT id, id FROM {ids}
  UNION
  SELECT r.id, e.dst FROM reach r JOIN {edges} e ON e.src = r.other
)"""


def _levels(group: str, join: str, most: int) -> str:
    """Counts of 2- to ``most``-item combinations per group, by unrolled self-joins."""
    out = ""
    for k in range(2, most + 1):
        tables = " ".join(
            ["FROM kept b1"]
            + [f"JOIN kept b{j} ON b{j}.key = b1.key AND b{j}.item > b{j - 1}.item" for j in range(2, k + 1)]
        )
        items = " || ',' || ".join(f"b{j}.item" for j in range(1, k + 1))
        out += f""",
n{k} AS (
  SELECT {group.replace('b.', 'b1.')} AS part, {items} AS itemset, {k} AS size, count(*) AS support
  {tables} {join} GROUP BY 1, 2
)"""
    return out


def _itemsets(baskets: str, part: str, most: int = MOST) -> str:
    """``found(part, itemset, size, support)``: locally frequent itemsets up to ``most`` items.

    ``need(part, need)`` must exist.  Level ``most`` has to come out empty for the result to be whole.
    """
    unions = " UNION ALL ".join(
        f"SELECT n.* FROM n{k} n JOIN need ON need.part = n.part WHERE n.support >= need.need"
        for k in range(1, most + 1)
    )
    return f"""
rows AS (SELECT {part} AS part, key, item FROM {baskets}),
n1 AS (SELECT part, item::VARCHAR AS itemset, 1 AS size, count(*) AS support FROM rows GROUP BY part, item),
kept AS (
  SELECT r.part, r.key, r.item::VARCHAR AS item
  FROM rows r JOIN n1 ON n1.part = r.part AND n1.itemset = r.item::VARCHAR
  JOIN need ON need.part = r.part WHERE n1.support >= need.need
){_levels('b.part', '', most)},
found AS ({unions})
"""


GLOBAL = f"""
WITH {BASKETS}, need AS (SELECT 0 AS part, s AS need FROM support), {_itemsets('baskets', '0')}
"""

SON = f"""
WITH {BASKETS},
part_sizes AS (SELECT key % {SON_PARTS} AS part, count(*) AS n FROM sizes GROUP BY 1),
need AS (
  SELECT part, (n * (SELECT s FROM support) + (SELECT count(*) FROM sizes) - 1) // (SELECT count(*) FROM sizes)
    AS need
  FROM part_sizes
), {_itemsets('baskets', f'key % {SON_PARTS}')},
candidates AS (SELECT itemset, size, count(*) AS parts FROM found GROUP BY itemset, size)
"""

# Second-pass totals need every occurrence, also where an item is locally rare.
SON_COUNTS = f"""
WITH {BASKETS},
part_sizes AS (SELECT key % {SON_PARTS} AS part, count(*) AS n FROM sizes GROUP BY 1),
need AS (
  SELECT part, (n * (SELECT s FROM support) + (SELECT count(*) FROM sizes) - 1) // (SELECT count(*) FROM sizes)
    AS need
  FROM part_sizes
), {_itemsets('baskets', f'key % {SON_PARTS}')},
candidates AS (SELECT DISTINCT itemset, size FROM found),
asked AS (SELECT itemset, size, unnest(string_split(itemset, ',')) AS item FROM candidates),
hits AS (
  SELECT a.itemset, a.size, b.key FROM asked a JOIN baskets b ON b.item = a.item
  GROUP BY a.itemset, a.size, b.key HAVING count(*) = a.size
),
counted AS (SELECT itemset, size, count(*) AS support FROM hits GROUP BY itemset, size)
"""

PRINTED = "'(''' || replace(itemset, ',', ''', ''') || ''')'"


# Streams


def _stream(table: str, sequence: str, user: str) -> str:
    return f"""
stream AS (
  SELECT {sequence} + 1 AS n, {user}::VARCHAR AS user_name, {sequence} // {BATCH} AS batch FROM {table}
),
powers(place, weight) AS (
  SELECT 0, 1 UNION ALL SELECT place + 1, weight * 256 % {COMPACT_PRIME} FROM powers WHERE place < 40
),
names AS (SELECT DISTINCT user_name FROM stream),
residues AS (
  SELECT user_name, (sum(ascii(substr(user_name, spot::INT, 1)) * weight) % {COMPACT_PRIME})::BIGINT AS x
  FROM (SELECT user_name, unnest(range(1, length(user_name) + 1)) AS spot FROM names)
  JOIN powers ON place = length(user_name) - spot
  GROUP BY user_name
),
slopes AS (
  SELECT * FROM (VALUES {', '.join(f'({i}, {a})' for i, a in enumerate(SLOPES))}) AS t(i, a)
),
hashes AS (
  SELECT user_name, i, ((a * x + a) % {COMPACT_PRIME}) % {COMPACT_BITS} AS h FROM residues CROSS JOIN slopes
)"""


ORDERS = _stream("orders", "o_orderkey", "o_custkey")
EVENTS = _stream("events", "event_id", "user_id")

BLOOM = """
, first AS (SELECT user_name, min(n) AS first, min(batch) AS batch FROM stream GROUP BY user_name),
bits AS (SELECT h, min(first) AS set_at FROM hashes JOIN first USING (user_name) GROUP BY h),
outcomes AS (
  SELECT f.user_name, f.batch, bool_and(b.set_at < f.first) AS positive
  FROM first f JOIN hashes USING (user_name) JOIN bits b USING (h) GROUP BY f.user_name, f.batch
),
rates AS (
  SELECT batch, count(*) FILTER (WHERE positive) AS fp, count(*) FILTER (WHERE NOT positive) AS tn
  FROM outcomes GROUP BY batch
)
SELECT b.batch, coalesce(fp, 0) AS fp, coalesce(tn, 0) AS tn,
       round(coalesce(fp::DOUBLE / nullif(fp + tn, 0), 0.0), 6) AS fpr
FROM (SELECT DISTINCT batch FROM stream) b LEFT JOIN rates r ON r.batch = b.batch
"""

FM = """
, registers AS (
  SELECT batch, i, max(length(bin(h)) - length(rtrim(bin(h), '0'))) AS r
  FROM (SELECT DISTINCT batch, user_name FROM stream) JOIN hashes USING (user_name) GROUP BY batch, i
),
estimates AS (SELECT batch, round_even(avg(pow(2.0, r)), 0)::BIGINT AS estimate FROM registers GROUP BY batch),
truths AS (SELECT batch, count(DISTINCT user_name) AS truth FROM stream GROUP BY batch)
"""


def _draw(number: str, stream: int) -> str:
    return f"('0x' || substr(md5('{SEED}:' || {number}), {8 * stream + 1}, 8))::BIGINT"


ENTERED = f"""
, entered AS (
  SELECT n, user_name,
         CASE WHEN n <= {RESERVOIR} THEN n - 1 ELSE {_draw('n', 2)} % {RESERVOIR} END AS slot
  FROM stream WHERE n <= {RESERVOIR} OR ('0x' || substr(md5('{SEED}:' || n), 1, 12))::BIGINT < {RESERVOIR * 2**48} // n
)
"""

SAMPLE = 'SELECT slot, max_by(user_name, n) AS "user", max(n) AS n FROM entered GROUP BY slot'

POINTS = f"""
points AS (
  SELECT vec_id AS id, label AS cluster, embedding, len(embedding) AS d, {_draw('vec_id', 0)} % 5 AS chunk
  FROM embeddings
),
flat AS (
  SELECT id, cluster, d, chunk, unnest(range(0, d)) AS dim, unnest(embedding)::DOUBLE AS x FROM points
)"""


def _seeded(name: str, points: str, k: int) -> str:
    """``name(id, cluster)``: the nearest of the ``k`` points of smallest id."""
    return f"""
{name}_seeds AS (SELECT row_number() OVER (ORDER BY id) - 1 AS cluster, embedding AS centre FROM {points} ORDER BY id LIMIT {k}),
{name} AS (
  SELECT id, min_by(cluster, away) AS cluster FROM (
    SELECT p.id, s.cluster, list_sum(list_transform(list_zip(p.embedding, s.centre), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))) AS away
    FROM {points} p, {name}_seeds s
  ) GROUP BY id
)"""


SUMMARY = """
figures AS (
  SELECT cluster, dim, count(*) AS n, sum(x) / count(*) AS centre,
         sum(x * x) / count(*) - (sum(x) / count(*)) * (sum(x) / count(*)) AS spread
  FROM flat GROUP BY cluster, dim
)"""

SMALL_CLUSTERS = f"""
{POINTS},
small AS (SELECT id, chunk * {CLUSTERS} + cluster AS cluster FROM points)"""


def _figures(name: str, members: str) -> str:
    """``name(cluster, d, dim, n, centre, spread)`` of the clusters of ``members(id, cluster)``."""
    return f"""
{name} AS MATERIALIZED (
  SELECT m.cluster, any_value(d) AS d, dim, count(*) AS n, sum(x) / count(*) AS centre,
         sum(x * x) / count(*) - (sum(x) / count(*)) * (sum(x) / count(*)) AS spread
  FROM {members} m JOIN flat f ON f.id = m.id GROUP BY m.cluster, dim
)"""


def _close(name: str, left: str, right: str, where: str, alpha: float) -> str:
    """``name(a, b)``: clusters of which one is close in the metric of the other."""
    away = "CASE WHEN min({0}.spread) <= 0 THEN 'Infinity'::DOUBLE ELSE sqrt(sum((p.centre - q.centre) * (p.centre - q.centre) / {0}.spread)) END"
    return f"""
{name} AS MATERIALIZED (
  SELECT p.cluster AS a, q.cluster AS b FROM {left} p JOIN {right} q ON p.dim = q.dim AND {where}
  GROUP BY 1, 2 HAVING least({away.format('p')}, {away.format('q')}) < {alpha} * sqrt(any_value(p.d))
)"""


def _first_fit(name: str, pairs: str) -> str:
    """``name(a, b)``: the pairs taken by a walk in order of (a, b) that takes a pair if both ends are free."""
    free = "NOT list_contains(w.used, p.a) AND NOT list_contains(w.used, p.b)"
    return f"""
{name}_pairs AS MATERIALIZED (SELECT a, b, row_number() OVER (ORDER BY a, b) AS i FROM {pairs}),
{name}_walk(i, used) AS (
  SELECT 0::BIGINT, []::BIGINT[]
  UNION ALL
  SELECT p.i, CASE WHEN {free} THEN list_concat(w.used, [p.a::BIGINT, p.b::BIGINT]) ELSE w.used END
  FROM {name}_walk w JOIN {name}_pairs p ON p.i = w.i + 1
),
{name} AS MATERIALIZED (SELECT p.a, p.b FROM {name}_walk w JOIN {name}_pairs p ON p.i = w.i + 1 WHERE {free})"""


def _reclustered(round: int, retained: str, k: int, first_id: int) -> str:
    """``fresh_r(id, cluster)`` and ``rs_r(id)``: groups and leftovers of the retained points in ``k`` seeded clusters."""
    return f"""
held_{round} AS MATERIALIZED (SELECT * FROM points WHERE id IN ({retained})), {_seeded(f'again_{round}', f'held_{round}', k)},
split_{round} AS MATERIALIZED (
  SELECT id, cluster + {first_id} AS cluster, count(*) OVER (PARTITION BY cluster) AS c, (SELECT count(*) FROM held_{round}) > {k} AS enough
  FROM again_{round}
),
fresh_{round} AS (SELECT id, cluster FROM split_{round} WHERE enough AND c > 1),
rs_{round} AS (SELECT id FROM split_{round} WHERE NOT enough OR c = 1)"""


def _all_rounds() -> str:
    """``ds_r``, ``cs_r`` and ``rs_r`` (id, cluster) after each round, chunks in order of id, clusters from fixed seeds."""
    out = f"""
{POINTS},
placed AS (SELECT id, (row_number() OVER (ORDER BY id) - 1) // ((SELECT count(*) + {CHUNKS - 1} FROM points) // {CHUNKS}) AS place FROM points),
body AS MATERIALIZED (SELECT * FROM points WHERE id IN (SELECT id FROM placed WHERE place = 0)), {_seeded('peel', 'body', FIRST_PASS)},
alone AS (SELECT id FROM (SELECT id, count(*) OVER (PARTITION BY cluster) AS c FROM peel) WHERE c = 1),
inner_body AS MATERIALIZED (SELECT * FROM body WHERE id NOT IN (SELECT id FROM alone)), {_seeded('ds_1', 'inner_body', CLUSTERS)},
{_reclustered(1, 'SELECT id FROM alone', CLUSTERS, 0)},
cs_1 AS (SELECT id, cluster FROM fresh_1)"""
    for r in range(2, CHUNKS + 1):
        b = r - 1
        merged = f"into_{r}" if r == CHUNKS else f"ds_{r}"
        out += f""", {_figures(f'ds_figures_{r}', f'ds_{b}')},
far_{r} AS MATERIALIZED (
  SELECT f.id, g.cluster, any_value(f.d) AS d,
         CASE WHEN min(spread) <= 0 THEN 'Infinity'::DOUBLE ELSE sqrt(sum((x - centre) * (x - centre) / spread)) END AS away
  FROM flat f JOIN placed ON placed.id = f.id AND place = {b} JOIN ds_figures_{r} g ON g.dim = f.dim GROUP BY f.id, g.cluster
),
nearest_{r} AS MATERIALIZED (
  SELECT id, CASE WHEN away < {ALPHA} * sqrt(d) THEN cluster END AS cluster
  FROM far_{r} QUALIFY row_number() OVER (PARTITION BY id ORDER BY away, cluster) = 1
),
{merged} AS (SELECT id, cluster FROM ds_{b} UNION ALL SELECT id, cluster FROM nearest_{r} WHERE cluster IS NOT NULL),
{_reclustered(r, f'SELECT id FROM rs_{b} UNION ALL SELECT id FROM nearest_{r} WHERE cluster IS NULL', 3 * CLUSTERS, 1000 * b)},
grown_{r} AS MATERIALIZED (SELECT id, cluster FROM cs_{b} UNION ALL SELECT id, cluster FROM fresh_{r}),
{_figures(f'cs_figures_{r}', f'grown_{r}')},
{_close(f'close_{r}', f'cs_figures_{r}', f'cs_figures_{r}', 'p.cluster < q.cluster', ALPHA)},
{_first_fit(f'fit_{r}', f'close_{r}')},
cs_{r if r < CHUNKS else 'merged'} AS MATERIALIZED (SELECT g.id, coalesce(f.a, g.cluster) AS cluster FROM grown_{r} g LEFT JOIN fit_{r} f ON f.b = g.cluster)"""
    last = CHUNKS
    return out + f""", {_figures('last_ds', f'into_{last}')}, {_figures('last_cs', 'cs_merged')},
{_close('close_last', 'last_cs', 'last_ds', 'true', ALPHA)},
joins AS (SELECT a, min(b) AS b FROM close_last GROUP BY a),
ds_{last} AS (SELECT id, cluster FROM into_{last} UNION ALL SELECT c.id, j.b FROM cs_merged c JOIN joins j ON j.a = c.cluster),
cs_{last} AS (SELECT id, cluster FROM cs_merged WHERE cluster NOT IN (SELECT a FROM joins)),
rounds AS (
  {' UNION ALL '.join(f"SELECT {r} AS round, (SELECT count(*) FROM ds_{r}) AS ds_points, (SELECT count(DISTINCT cluster) FROM cs_{r}) AS cs_clusters, (SELECT count(*) FROM cs_{r}) AS cs_points, (SELECT count(*) FROM rs_{r}) AS rs_points" for r in range(1, last + 1))}
),
final AS (
  SELECT id, cluster::INT AS cluster FROM ds_{last} UNION ALL SELECT id, -1 FROM cs_{last} UNION ALL SELECT id, -1 FROM rs_{last}
)"""


RETAIL = """
sold AS (
  SELECT l_orderkey AS o, l_linenumber AS n, strftime(o_orderdate, '%m/%d/%Y') AS date,
         CASE WHEN l_orderkey % 89 = 0 THEN '' ELSE o_custkey::VARCHAR END AS customer,
         CASE WHEN l_orderkey % 97 = 0 THEN 'P' ELSE '' END || lpad(l_partkey::VARCHAR, 12, '0') AS product
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
)"""

ORACLES = {
    "baskets_order_brand": f"""
        WITH {BASKETS}
        SELECT key, part, string_agg(item, ',' ORDER BY item) AS items, any_value(size) AS size
        FROM {_ranked('baskets', 'key', 'item')} GROUP BY key, part""",
    "baskets_min_size": f"""
        WITH {BASKETS}
        SELECT key, part, string_agg(item, ',' ORDER BY item) AS items, any_value(size) AS size
        FROM {_ranked('baskets', 'key', 'item')} WHERE size > 3 GROUP BY key, part""",
    "item_support": f"""
        WITH {BASKETS}
        SELECT item, count(*) AS support FROM baskets GROUP BY item
        HAVING count(*) >= (SELECT s FROM support)""",
    "frequent_itemsets": f"{GLOBAL} SELECT itemset, size, support FROM found",
    "frequent_itemsets_inverted": f"""
        WITH {SUPPLIER_BASKETS},
        kept AS (
          SELECT item AS key, key AS item FROM baskets
          WHERE key IN (SELECT key FROM baskets GROUP BY key HAVING count(*) >= (SELECT s FROM support))
        ),
        pairs AS (
          SELECT a.item AS i, b.item AS j, count(*) AS support
          FROM kept a JOIN kept b ON a.key = b.key AND a.item < b.item GROUP BY 1, 2
          HAVING count(*) >= (SELECT s FROM support)
        ),
        triples AS (
          SELECT p.i, p.j, c.item AS k, count(*) AS support
          FROM pairs p JOIN kept a ON a.item = p.i JOIN kept b ON b.key = a.key AND b.item = p.j
          JOIN kept c ON c.key = a.key AND c.item > p.j
          WHERE EXISTS (SELECT 1 FROM pairs q WHERE q.i = p.i AND q.j = c.item)
          GROUP BY 1, 2, 3 HAVING count(*) >= (SELECT s FROM support)
        )
        SELECT item::VARCHAR AS itemset, 1 AS size, count(*) AS support FROM kept GROUP BY item
        UNION ALL SELECT i || ',' || j, 2, support FROM pairs
        UNION ALL SELECT i || ',' || j || ',' || k, 3, support FROM triples""",
    "local_thresholds": f"{SON} SELECT part, need FROM need",
    "son_candidates": f"{SON} SELECT itemset, size, parts FROM candidates",
    "son_counts": f"{SON_COUNTS} SELECT itemset, size, support FROM counted",
    "itemset_report": f"""
        {SON_COUNTS}
        SELECT 'Candidates' AS kind, size, {PRINTED} AS line FROM counted
        UNION ALL SELECT 'Frequent Itemsets', size, {PRINTED} FROM counted
        WHERE support >= (SELECT s FROM support)""",
    "cooccurrence_edges": f"WITH {GRAPH} SELECT src, dst FROM edges",
    "vertex_degrees": f"WITH {GRAPH} SELECT src AS id, count(*) AS degree FROM edges GROUP BY src",
    "lpa_labels": f"WITH {GRAPH} {LABELS} SELECT id, label FROM labels",
    "lpa_communities": f"""
        WITH {GRAPH} {LABELS}
        SELECT label, part, string_agg(id::VARCHAR, ',' ORDER BY id) AS members, any_value(size) AS size
        FROM {_ranked('labels', 'label', 'id')} GROUP BY label, part""",
    "community_lines": f"""
        WITH {GRAPH} {LABELS}
        SELECT any_value(size) AS size, label, part,
               string_agg('''' || id || '''', ', ' ORDER BY id) AS line
        FROM {_ranked('labels', 'label', 'id')} GROUP BY label, part""",
    "shortest_path_dag": f"WITH RECURSIVE {GRAPH} {PATHS} SELECT root, node, dist, sigma FROM paths",
    "edge_betweenness": f"""
        WITH RECURSIVE {GRAPH} {BETWEENNESS}
        SELECT src, dst, round(betweenness, 6) AS betweenness FROM betweenness""",
    "top_edges": f"""
        WITH RECURSIVE {GRAPH} {BETWEENNESS}
        SELECT src, dst, round(betweenness, 6) AS betweenness FROM highest""",
    "betweenness_lines": f"""
        WITH RECURSIVE {GRAPH} {BETWEENNESS}
        SELECT round(betweenness, 6) AS betweenness, src, dst,
               '(''' || src || ''', ''' || dst || '''), ' || printf('%.6f', round(betweenness, 6)) AS line
        FROM betweenness""",
    "connected_components": f"""
        WITH RECURSIVE {GRAPH}, everyone AS (SELECT s_suppkey AS id FROM supplier), {_reach('edges', 'everyone')}
        SELECT id, min(other) AS component FROM reach GROUP BY id""",
    "modularity": f"""
        WITH {GRAPH} {LABELS},
        per_label AS (
          SELECT a.label, count(*) AS ends, count(*) FILTER (WHERE a.label = b.label) AS inside
          FROM edges e JOIN labels a ON a.id = e.src JOIN labels b ON b.id = e.dst GROUP BY a.label
        ),
        total AS (SELECT count(*)::DOUBLE AS ends FROM edges)
        SELECT (SELECT count(*) // 2 FROM edges) AS edges, count(*) AS communities,
               round(sum(inside / t.ends - (p.ends / t.ends) * (p.ends / t.ends)), 6) AS modularity
        FROM per_label p, total t""",
    "first_cut": f"""
        WITH RECURSIVE {GRAPH} {BETWEENNESS},
        remaining AS (
          SELECT e.src, e.dst FROM edges e
          WHERE NOT EXISTS (
            SELECT 1 FROM highest h WHERE h.src = least(e.src, e.dst) AND h.dst = greatest(e.src, e.dst)
          )
        ), {_reach('remaining', 'vertices')}
        SELECT id, min(other) AS component FROM reach GROUP BY id""",
    "girvan_newman_summary": f"""
        WITH RECURSIVE {GRAPH} {BETWEENNESS},
        remaining AS (
          SELECT e.src, e.dst FROM edges e
          WHERE NOT EXISTS (
            SELECT 1 FROM highest h WHERE h.src = least(e.src, e.dst) AND h.dst = greatest(e.src, e.dst)
          )
        ), {_reach('remaining', 'vertices')},
        labels AS (SELECT id, min(other) AS label FROM reach GROUP BY id),
        per_label AS (
          SELECT a.label, count(*) AS ends, count(*) FILTER (WHERE a.label = b.label) AS inside
          FROM edges e JOIN labels a ON a.id = e.src JOIN labels b ON b.id = e.dst GROUP BY a.label
        ),
        total AS (SELECT count(*)::DOUBLE AS ends FROM edges),
        alone AS (SELECT src, count(*)::DOUBLE AS degree FROM edges GROUP BY src)
        SELECT (SELECT count(*) // 2 FROM edges) AS removed,
               (SELECT count(*) FROM highest) AS first_removed,
               (SELECT count(DISTINCT label) FROM labels) AS first_communities,
               (SELECT round(sum(inside / t.ends - (p.ends / t.ends) * (p.ends / t.ends)), 6) FROM per_label p, total t) AS first_modularity,
               (SELECT count(*) FROM alone) AS last_communities,
               (SELECT round(-sum((degree / t.ends) * (degree / t.ends)), 6) FROM alone, total t) AS last_modularity""",
    "kmeans_step": f"""
        WITH {POINTS}, {_seeded('step', 'points', CLUSTERS)}
        SELECT s.cluster, f.dim, count(*) AS n, round(sum(f.x), 6) AS sum, round(sum(f.x * f.x), 6) AS sumsq
        FROM step s JOIN flat f USING (id) GROUP BY s.cluster, f.dim""",
    "bfr_peel": f"""
        WITH {POINTS}, body AS (SELECT * FROM points WHERE chunk = 0), {_seeded('peel', 'body', FIRST_PASS)}
        SELECT id, cluster, count(*) OVER (PARTITION BY cluster) = 1 AS outlier FROM peel""",
    "bfr_first_round": f"""
        WITH {POINTS}, body AS (SELECT * FROM points WHERE chunk = 0), {_seeded('peel', 'body', FIRST_PASS)},
        alone AS (SELECT id FROM (SELECT id, count(*) OVER (PARTITION BY cluster) AS c FROM peel) WHERE c = 1),
        outliers AS (SELECT * FROM points WHERE id IN (SELECT id FROM alone)), {_seeded('again', 'outliers', CLUSTERS)},
        parts AS (SELECT cluster, count(*) AS n FROM again GROUP BY cluster),
        enough AS (SELECT count(*) > {CLUSTERS} AS yes, count(*) AS n FROM outliers)
        SELECT 1 AS round, (SELECT count(*) FROM body) - (SELECT n FROM enough) AS ds_points,
               CASE WHEN (SELECT yes FROM enough) THEN (SELECT count(*) FROM parts WHERE n > 1) ELSE 0 END AS cs_clusters,
               CASE WHEN (SELECT yes FROM enough) THEN (SELECT coalesce(sum(n), 0) FROM parts WHERE n > 1) ELSE 0 END AS cs_points,
               CASE WHEN (SELECT yes FROM enough) THEN (SELECT count(*) FROM parts WHERE n = 1) ELSE (SELECT n FROM enough) END AS rs_points""",
    "chunk_sizes": f"WITH {POINTS} SELECT chunk, count(*) AS points FROM points GROUP BY chunk",
    "bfr_ds_summary": f"""
        WITH {POINTS}
        SELECT chunk, cluster, dim, count(*) AS n, round(sum(x), 6) AS sum, round(sum(x * x), 6) AS sumsq
        FROM flat GROUP BY chunk, cluster, dim""",
    "bfr_assign": f"""
        WITH {POINTS}, {SUMMARY},
        distances AS (
          SELECT f.id, g.cluster, f.d,
                 CASE WHEN min(spread) <= 0 THEN 'Infinity'::DOUBLE
                      ELSE sqrt(sum((x - centre) * (x - centre) / spread)) END AS distance
          FROM flat f JOIN figures g ON g.dim = f.dim GROUP BY f.id, g.cluster, f.d
        ),
        best AS (
          SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, cluster) AS place FROM distances
        )
        SELECT id, CASE WHEN distance < {ALPHA} * sqrt(d) THEN cluster END AS cluster,
               round(distance, 6) AS distance
        FROM best WHERE place = 1""",
    "bfr_own_distance": f"""
        WITH {POINTS}, {SUMMARY}
        SELECT f.id, f.cluster,
               round(CASE WHEN min(spread) <= 0 THEN 'Infinity'::DOUBLE
                          ELSE sqrt(sum((x - centre) * (x - centre) / spread)) END, 6) AS distance
        FROM flat f JOIN figures g ON g.cluster = f.cluster AND g.dim = f.dim GROUP BY f.id, f.cluster""",
    "bfr_merge_pairs": f"""
        WITH {POINTS}, {SUMMARY},
        directed AS (
          SELECT a.cluster AS origin, b.cluster AS target, count(*) AS d,
                 CASE WHEN min(b.spread) <= 0 THEN 'Infinity'::DOUBLE
                      ELSE sqrt(sum((a.centre - b.centre) * (a.centre - b.centre) / b.spread)) END AS distance
          FROM figures a JOIN figures b ON a.dim = b.dim GROUP BY 1, 2
        )
        SELECT p.origin AS a, p.target AS b, round(p.distance, 6) AS a_to_b, round(q.distance, 6) AS b_to_a,
               least(p.distance, q.distance) < {ALPHA} * sqrt(p.d) AS mergeable
        FROM directed p JOIN directed q ON q.origin = p.target AND q.target = p.origin
        WHERE p.origin < p.target""",
    "bfr_cs_merge": f"""
        WITH RECURSIVE {SMALL_CLUSTERS}, {_figures('f', 'small')},
        {_close('pairs', 'f', 'f', 'p.cluster < q.cluster', MERGE_ALPHA)}, {_first_fit('fit', 'pairs')}
        SELECT c.cluster, coalesce(fit.a, c.cluster) AS "into"
        FROM (SELECT DISTINCT cluster FROM small) c LEFT JOIN fit ON fit.b = c.cluster""",
    "bfr_cs_merged": f"""
        WITH RECURSIVE {SMALL_CLUSTERS}, {_figures('f', 'small')},
        {_close('pairs', 'f', 'f', 'p.cluster < q.cluster', MERGE_ALPHA)}, {_first_fit('fit', 'pairs')}
        SELECT coalesce(fit.a, s.cluster) AS cluster, x.dim, count(*) AS n, round(sum(x), 6) AS sum, round(sum(x * x), 6) AS sumsq
        FROM small s JOIN flat x ON x.id = s.id LEFT JOIN fit ON fit.b = s.cluster GROUP BY 1, 2""",
    "bfr_ds_merge": f"""
        WITH {SMALL_CLUSTERS}, {_figures('f', 'small')},
        {_close('pairs', 'f', 'f', f'p.cluster >= {CLUSTERS} AND q.cluster < {CLUSTERS}', MERGE_ALPHA)}
        SELECT a AS cluster, min(b) AS "into" FROM pairs GROUP BY a""",
    "chunk_file_order": f"""
        SELECT vec_id AS id, row_number() OVER (ORDER BY vec_id) AS row_number,
               ((row_number() OVER (ORDER BY vec_id) - 1) // ((SELECT count(*) + {CHUNKS - 1} FROM embeddings) // {CHUNKS}))::INT AS chunk
        FROM embeddings""",
    "bfr_rounds_fixed": f"WITH RECURSIVE {_all_rounds()} SELECT * FROM rounds",
    "bfr_labels_fixed": f"WITH RECURSIVE {_all_rounds()} SELECT id, cluster FROM final",
    "labels_by_id": f"WITH RECURSIVE {_all_rounds()} SELECT id, cluster, row_number() OVER (ORDER BY id) AS n FROM final",
    "clustering_file": f"""
        WITH RECURSIVE {_all_rounds()},
        lines AS (
          SELECT 0 AS section, 0 AS place, 'The intermediate results:' AS line
          UNION ALL SELECT 1, round, 'Round ' || round || ': ' || ds_points || ',' || cs_clusters || ',' || cs_points || ',' || rs_points FROM rounds
          UNION ALL SELECT 2, 0, '' UNION ALL SELECT 2, 1, 'The clustering results:'
          UNION ALL SELECT 3, id, id || ',' || cluster FROM final
        )
        SELECT row_number() OVER (ORDER BY section, place) AS n, line FROM lines""",
    "bootstrap_batches": f"""
        WITH total AS (SELECT count(*) AS rows FROM orders),
        draws AS (
          SELECT id AS draw, id // {BATCH} AS batch,
                 ({_draw('id', 0)} * 65536 + {_draw('id', 1)} // 65536) % rows AS row_number
          FROM total, unnest(range(0, (rows + {BATCH - 1}) // {BATCH} * {BATCH})) AS t(id)
        )
        SELECT draw, batch, o_orderkey, o_custkey FROM draws JOIN orders ON o_orderkey = row_number""",
    "stream_bootstrap": f"""
        WITH total AS (SELECT count(*) AS rows FROM orders),
        draws AS (
          SELECT id AS draw, id // {BATCH} AS batch,
                 ({_draw('id', 0)} * 65536 + {_draw('id', 1)} // 65536) % rows AS row_number
          FROM total, unnest(range(0, (rows + {BATCH - 1}) // {BATCH} * {BATCH})) AS t(id)
        )
        SELECT draw, batch, o_orderkey, o_custkey FROM draws JOIN orders ON o_orderkey = row_number""",
    "hash_family": f"""
        WITH RECURSIVE {ORDERS}
        SELECT user_name AS "user", x,
               {', '.join(f'max(h) FILTER (WHERE i = {i}) AS h{i}' for i in range(len(SLOPES)))}
        FROM residues JOIN hashes USING (user_name) GROUP BY user_name, x""",
    "bloom_fpr": f"WITH RECURSIVE {ORDERS} {BLOOM}",
    "fm_estimate": f"""
        WITH RECURSIVE {ORDERS} {FM} SELECT batch, truth, estimate FROM truths JOIN estimates USING (batch)""",
    "itemset_report_file": f"""
        {SON_COUNTS},
        printed AS (
          SELECT 0 AS section, size, 0 AS rank, {PRINTED} AS line FROM counted
          UNION ALL SELECT 1, size, 0, {PRINTED} FROM counted WHERE support >= (SELECT s FROM support)
        ),
        whole AS (
          SELECT * FROM printed
          UNION ALL SELECT DISTINCT section, size, 1, '' FROM printed
          UNION ALL SELECT 0, 0, 0, 'Candidates:' UNION ALL SELECT 1, 0, 0, 'Frequent Itemsets:'
        )
        SELECT row_number() OVER (ORDER BY section, size, rank, line) AS n, line FROM whole""",
    "betweenness_file": f"""
        WITH RECURSIVE {GRAPH} {BETWEENNESS}
        SELECT row_number() OVER (ORDER BY round(betweenness, 6) DESC, src, dst) AS n,
               '(''' || src || ''', ''' || dst || '''), ' || printf('%.6f', round(betweenness, 6)) AS line
        FROM betweenness""",
    "community_file": f"""
        WITH {GRAPH} {LABELS},
        printed AS (
          SELECT any_value(size) AS size, label, part, string_agg('''' || id || '''', ', ' ORDER BY id) AS line
          FROM {_ranked('labels', 'label', 'id')} GROUP BY label, part
        )
        SELECT row_number() OVER (ORDER BY p.size, h.line, p.label, p.part) AS n, p.line
        FROM printed p JOIN printed h ON h.label = p.label AND h.part = 0""",
    "fpr_csv": f"WITH RECURSIVE {ORDERS} {BLOOM.replace('SELECT b.batch, coalesce(fp, 0) AS fp, coalesce(tn, 0) AS tn,', 'SELECT b.batch AS time,')}",
    "reservoir_csv": f"""
        WITH RECURSIVE {ORDERS} {ENTERED},
        ends AS (SELECT batch, max(n) AS seqnum FROM stream GROUP BY batch)
        SELECT b.seqnum,
               {', '.join(f'max_by(e.user_name, e.n) FILTER (WHERE e.slot = {s}) AS "{s}_id"' for s in SNAPSHOT_SLOTS)}
        FROM ends b JOIN entered e ON e.n <= b.seqnum GROUP BY b.batch, b.seqnum""",
    "fm_csv": f"""
        WITH RECURSIVE {ORDERS} {FM}
        SELECT batch AS time, truth AS ground_truth, estimate AS estimation
        FROM truths JOIN estimates USING (batch)""",
    "reservoir_sample": f"WITH RECURSIVE {ORDERS} {ENTERED} {SAMPLE}",
    "reservoir_snapshots": f"""
        WITH RECURSIVE {ORDERS} {ENTERED},
        ends AS (SELECT batch, max(n) AS seqnum FROM stream GROUP BY batch)
        SELECT b.batch, b.seqnum,
               {', '.join(f'max_by(e.user_name, e.n) FILTER (WHERE e.slot = {s}) AS "{s}_id"' for s in SNAPSHOT_SLOTS)}
        FROM ends b JOIN entered e ON e.n <= b.seqnum GROUP BY b.batch, b.seqnum""",
    "stream_fm": f"""
        WITH RECURSIVE {EVENTS} {FM} SELECT batch, truth, estimate FROM truths JOIN estimates USING (batch)""",
    "stream_reservoir": f"WITH RECURSIVE {EVENTS} {ENTERED} {SAMPLE}",
    "stream_bloom": f"WITH RECURSIVE {EVENTS} {BLOOM}",
    "stream_fm_batches": f"""
        WITH RECURSIVE {EVENTS} {FM} SELECT batch, truth, estimate FROM truths JOIN estimates USING (batch)""",
    "stream_snapshots": f"""
        WITH RECURSIVE {EVENTS} {ENTERED},
        ends AS (SELECT batch, max(n) AS seqnum FROM stream GROUP BY batch)
        SELECT b.batch, b.seqnum,
               {', '.join(f'max_by(e.user_name, e.n) FILTER (WHERE e.slot = {s}) AS "{s}_id"' for s in SNAPSHOT_SLOTS)}
        FROM ends b JOIN entered e ON e.n <= b.seqnum GROUP BY b.batch, b.seqnum""",
    "basket_csv": """
        WITH baskets AS (SELECT DISTINCT l_orderkey::VARCHAR AS key, l_partkey::VARCHAR AS item FROM lineitem),
        counted AS (SELECT key, count(*) AS items, min(item) AS first_item FROM baskets GROUP BY key)
        SELECT c.*, r.reader FROM counted c, (VALUES ('header'), ('lettered')) AS r(reader)""",
    "retail_csv": """
        SELECT DISTINCT strftime(o_orderdate, '%m/%d/%Y') || '-' || o_custkey AS key, l_partkey::VARCHAR AS item
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "retail_broken_csv": f"""
        WITH {RETAIL}
        SELECT DISTINCT date || '-' || customer AS key, product::BIGINT::VARCHAR AS item
        FROM sold WHERE o % 83 <> 0 AND o % 89 <> 0 AND o % 97 <> 0""",
    "retail_rejects": f"""
        WITH {RETAIL}
        SELECT CASE WHEN o % 83 = 0 THEN 'columns' WHEN o % 89 = 0 THEN 'key' ELSE 'product' END AS reason,
               date, nullif(customer, '') AS customer, CASE WHEN o % 83 <> 0 THEN product END AS product,
               CASE WHEN o % 83 = 0 THEN concat_ws(',', '"' || date || '"', '"' || customer || '"', '"-"', '"' || n || '"', '""') END AS line
        FROM sold WHERE o % 83 = 0 OR o % 89 = 0 OR o % 97 = 0""",
    "points_csv": """
        SELECT vec_id AS id, len(embedding) AS dims,
               round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 6) AS norm2
        FROM embeddings""",
}
