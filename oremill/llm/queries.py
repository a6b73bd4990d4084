"""Registered queries of the operators for training text, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oremill.llm import hard_negatives, infill, language_id, licenses, line_dedup, mixing, neighbours, ngram_join, quality_model, quality_rules, repeats, tokens, url_filter
from oremill.llm.text import table, tuned
from oremill.plans.staging import stage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = tuned(function)
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def tokenizer_model(name: str = "piece_bpe_32k.model") -> str:
    """Path of an installed public tokenizer."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


@query("op1_language_id")
def op1_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    apart = language_id.held_out(F.col("doc_id"))
    model = language_id.learn(docs.where(~apart))
    guess = docs.select("doc_id", apart.alias("held_out"), language_id.predicted(F.col("text"), model).alias("p"))
    return guess.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


@query("op2_nearest_neighbours")
def op2_nearest_neighbours(spark, sf_dir):
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), asks=F.col("id") % 50 == 0)


#: Rules of the url filter (fixed values of the contract).
URL_RULES = [
    url_filter.Rule("allow", "org", "/"),
    url_filter.Rule("block", "example.org", "/es/"),
    url_filter.Rule("block", "example.org", "/en/1"),
    url_filter.Rule("allow", "com", "/fr/"),
    url_filter.Rule("block", "com", "/de/"),
]


@query("op3_url_filter")
def op3_url_filter(spark, sf_dir):
    return url_filter.judged(table(spark, sf_dir, "pages"), URL_RULES)


@query("op4_ngram_join")
def op4_ngram_join(spark, sf_dir):
    return ngram_join.joined(table(spark, sf_dir, "documents"))


@query(
    "op5_quality_rules",
    """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, lang, source, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w FROM d),
places AS (
  SELECT r, unnest(range(1, len(w) - 6)) AS i, unnest(list_transform(range(1, len(w) - 6), lambda k: array_to_string(w[k:k + 7], ' '))) AS g
  FROM w WHERE len(w) >= 8
),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM places) WHERE c >= 2),
covered AS (SELECT r, sum(least(8, coalesce(nxt - i, 8))) AS n
  FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM twice) GROUP BY r),
lines AS (SELECT r, count(*) AS n, count(*) - count(DISTINCT l) AS dup
  FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY r),
m AS (
  SELECT w.r, doc_id, lang, source, len(w)::BIGINT AS n_words,
    length(array_to_string(w, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    coalesce(lines.dup, 0)::BIGINT AS n_dup_lines,
    coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
    coalesce(lines.n, 0)::BIGINT AS n_lines
  FROM w LEFT JOIN covered USING (r) LEFT JOIN lines USING (r)
),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
v AS (
  SELECT r, lang, source, 'symbols' AS metric, 1000 * n_symbols // greatest(word_chars, 1) AS x FROM judged
  UNION ALL SELECT r, lang, source, 'dup_lines', 1000 * n_dup_lines // greatest(n_lines, 1) FROM judged
  UNION ALL SELECT r, lang, source, 'repeated', 1000 * n_repeat_words // greatest(n_words, 1) FROM judged
  UNION ALL SELECT r, lang, source, 'word_length', 100 * word_chars // greatest(n_words, 1) FROM judged
),
b AS (SELECT *, x - x % (1::BIGINT << greatest(length(bin(x)) - 7, 0)) AS b FROM v),
slack(metric, s) AS (VALUES ('symbols', 60), ('dup_lines', 400), ('repeated', 250), ('word_length', 250)),
own_run AS (SELECT lang, source, metric, b, row_number() OVER (PARTITION BY lang, source, metric ORDER BY b) AS k,
  count(*) OVER (PARTITION BY lang, source, metric) AS n FROM b),
own AS (SELECT lang, source, metric, max(n) AS n, min(b) FILTER (4 * k >= n) AS q1, min(b) FILTER (4 * k >= 3 * n) AS q3
  FROM own_run GROUP BY lang, source, metric),
all_run AS (SELECT metric, b, row_number() OVER (PARTITION BY metric ORDER BY b) AS k, count(*) OVER (PARTITION BY metric) AS n FROM b),
every AS (SELECT metric, min(b) FILTER (4 * k >= n) AS q1, min(b) FILTER (4 * k >= 3 * n) AS q3 FROM all_run GROUP BY metric),
fence AS (
  SELECT own.lang, own.source, own.metric,
    (own.n * (own.q1 - greatest(6 * (own.q3 - own.q1), s)) + 50 * (every.q1 - greatest(6 * (every.q3 - every.q1), s)))::DOUBLE / (own.n + 50) AS low,
    (own.n * (own.q3 + greatest(6 * (own.q3 - own.q1), s)) + 50 * (every.q3 + greatest(6 * (every.q3 - every.q1), s)))::DOUBLE / (own.n + 50) AS high
  FROM own JOIN every USING (metric) JOIN slack USING (metric)
),
inside AS (
  SELECT v.r, bool_and(v.x <= f.high AND (v.metric <> 'word_length' OR v.x >= f.low)) AS ok
  FROM v JOIN fence f ON v.metric = f.metric AND v.lang IS NOT DISTINCT FROM f.lang AND v.source IS NOT DISTINCT FROM f.source
  GROUP BY v.r
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed,
  NOT base_failed AND ok AS kept
FROM judged JOIN inside USING (r)
""",
)
def op5_quality_rules(spark, sf_dir):
    return quality_rules.judged(table(spark, sf_dir, "documents"))


@query("op6_mixing")
def op6_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    sizes = stage(docs.select("doc_id", "source", mixing.n_words(F.col("text")).alias("size")), "sizes")
    return mixing.mixed(sizes, weights=(5, 2, 1)).select("doc_id", "size", "source_size", "target", "taken")


@query("op7_license_scan")
def op7_license_scan(spark, sf_dir):
    scan = table(spark, sf_dir, "documents").select("doc_id", licenses.scanned(F.col("text")).alias("s"))
    base = F.sort_array(F.array_distinct(F.transform("s.base", lambda p: p["label"])))
    found = F.transform("s.detections", lambda p: p["label"])
    return scan.select(
        "doc_id",
        "s.n_words",
        F.size("s.base").cast("bigint").alias("n_base"),
        F.array_min(F.transform("s.base", lambda p: p["first"])).cast("bigint").alias("first_word"),
        F.array_max(F.transform("s.base", lambda p: p["first"])).cast("bigint").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union(base, found)), ",").alias("labels"),
        "s.score",
    )


@query("op8_quality_classifier")
def op8_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_model.judged(docs).select("doc_id", "score", "kept")


@query("op9_line_dedup")
def op9_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    decided = line_dedup.kept_lines(docs)
    return decided.select(
        F.col("id").alias("doc_id"),
        "n_lines",
        (F.col("n_lines") - F.size("kept")).alias("n_removed"),
        F.concat_ws(",", F.col("kept").cast("array<string>")).alias("kept_lines"),
    )


@query("op10_sentencepiece")
def op10_sentencepiece(spark, sf_dir):
    model = tokenizer_model()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = tokens.round_trip(docs, model)
    return both.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query(
    "op11_substring_dedup",
    """
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, unnest(range(1, len(w) - 18)) AS i, unnest(list_transform(range(1, len(w) - 18), lambda k: md5(array_to_string(w[k:k + 19], ' ')))) AS g
  FROM t WHERE len(w) >= 20
),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS place FROM windows) WHERE place > 1),
lost AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM later),
each AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM t),
kept AS (
  SELECT e.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY e.i) AS words
  FROM each e LEFT JOIN lost l ON l.doc_id = e.doc_id AND l.i = e.i WHERE l.i IS NULL GROUP BY e.doc_id
)
SELECT t.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(words, '')) AS kept_sha256
FROM t LEFT JOIN kept ON kept.doc_id = t.doc_id""",
)
def op11_substring_dedup(spark, sf_dir):
    kept = repeats.without_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query(
    "op12_fill_in_middle",
    """
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || doc_id) AS h FROM documents),
u AS (
  SELECT doc_id, t, h, regexp_extract_all(t, '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS u FROM t
),
d AS (
  SELECT doc_id, t, u, len(u)::BIGINT AS n,
    ('0x' || substr(h, 1, 8))::BIGINT % (len(u) + 1) AS a, ('0x' || substr(h, 9, 8))::BIGINT % (len(u) + 1) AS b,
    ('0x' || substr(h, 17, 8))::BIGINT % 100 AS c, ('0x' || substr(h, 25, 8))::BIGINT % 100 AS e
  FROM u
),
p AS (
  SELECT doc_id, t, n,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c >= 50 THEN 'plain' WHEN e < 80 THEN 'spm' ELSE 'psm' END AS form,
    array_to_string(u[:least(a, b)], '') AS x, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS y, array_to_string(u[greatest(a, b) + 1:], '') AS z
  FROM d
)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN length(x) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(y) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p""",
)
def op12_fill_in_middle(spark, sf_dir):
    out = infill.transformed(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(infill.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


@query(
    "op13_hard_negatives",
    """
WITH rows AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scores AS (
  SELECT a.id AS anchor_id, r.id, a.label = r.label AS same,
    list_sum(list_transform(list_zip(a.v, r.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM rows a, rows r WHERE a.id % 100 = 0 AND r.id <> a.id
),
positives AS (
  SELECT anchor_id, id, score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
),
ranked AS (
  SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id)::INT AS rank
  FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND NOT s.same
  WHERE 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 10""",
)
def op13_hard_negatives(spark, sf_dir):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mined(table(spark, sf_dir, "embeddings"), anchors=F.col("id") % 100 == 0, label=label)
