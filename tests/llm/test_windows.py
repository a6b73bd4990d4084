"""Substring dedup, fill-in-the-middle and hard negatives against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from oremill.llm import hard_negatives, infill, repeats

WORD = re.compile("[^\x20\x09-\x0d]+")
UNIT = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


# Substring dedup


def _trimmed(rows, window):
    """``(n_words, n_removed, kept)`` of distinct rows, by all windows; null ids are the last."""
    order = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    seen, out = set(), {}
    for row in order:
        words = WORD.findall(row[1] or "")
        gone = set()
        for i in range(len(words) - window + 1):
            piece = tuple(words[i : i + window])
            if piece in seen:
                gone.update(range(i, i + window))
            seen.add(piece)
        out[row] = (len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone))
    return [(row[0], *out[row]) for row in rows]


def _quoting(rng, docs, passage):
    """Texts that quote parts of one passage between words of their own, and copies of some."""
    texts = []
    for _ in range(docs):
        own = [str(rng.randint(0, 3000)) for _ in range(rng.randint(0, 60))]
        a = rng.randrange(len(passage))
        cut = rng.randrange(len(own) + 1)
        text = " ".join(own[:cut]) + rng.choice(["  ", "\n", "\t"]) + " ".join(passage[a : a + rng.randint(5, 70)]) + "\r\n " + " ".join(own[cut:])
        texts.append(text if rng.random() < 0.8 or not texts else rng.choice(texts))
    return texts


@pytest.mark.parametrize("bucket_strings", [repeats.BUCKET_STRINGS, 2])
@pytest.mark.parametrize("window", [20, 3])
def test_windows_that_start_earlier_go(spark, window, bucket_strings):
    rng = random.Random(window)
    passage = [str(rng.randint(0, 3000)) for _ in range(60)] + ["la"] * 45
    rows = list(enumerate(_quoting(rng, 150, passage)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    found = [tuple(r) for r in repeats.without_repeats(docs, window=window, bucket_strings=bucket_strings).collect()]
    assert sorted(found) == sorted(_trimmed(rows, window))


def test_repeats_of_odd_rows(odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    found = [tuple(r) for r in repeats.without_repeats(odd).collect()]
    assert sorted(found, key=repr) == sorted(_trimmed(rows, 20), key=repr)
    assert repeats.without_repeats(none).collect() == []


def test_a_third_of_the_ids_null(spark):
    rng = random.Random(8)
    texts = [" ".join(str(rng.randint(0, 9000)) for _ in range(40)) for _ in range(300)]
    rows = [(None if i % 3 == 0 else i, t) for i, t in enumerate(texts)] + [(1000, texts[0]), (None, texts[1])]
    found = {(r["doc_id"], r["n_removed"]) for r in repeats.without_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert (1000, 0) in found and sum(n for _, n in found if n) == 40  # both copies with null ids come after the others


def test_slices_of_the_words_change_no_minimiser():
    rng = random.Random(7)
    texts = pa.array([t + " " for t in _quoting(rng, 40, [str(i) for i in range(90)])])
    words = repeats.Words(texts)

    def each(slice_words):
        return {(a + k, x) for at, n, least, _ in repeats.runs_of(words, 20, slice_words) for a, c, x in zip(at.tolist(), n.tolist(), least.tolist()) for k in range(c)}

    assert each(50) == each(10**6) and len(each(50)) == sum(max(0, len(WORD.findall(t)) - 19) for t in texts.to_pylist())


def test_collisions_of_cells_change_nothing(spark):
    rng = random.Random(2)
    rows = list(enumerate(_quoting(rng, 60, [str(i) for i in range(90)])))
    found = repeats.without_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"), cell_bits=17)
    assert sorted(tuple(r) for r in found.collect()) == sorted(_trimmed(rows, 20))


# Fill-in-the-middle


def _moved(key, text, seed=42, rate=50, suffix_first=80):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    x, y, z = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return key, n, "plain", None, None, text
    if h[3] % 100 < suffix_first:
        return key, n, "spm", len(x), len(y), f"<S>{z}<P>{x}<M>{y}"
    return key, n, "psm", len(x), len(y), f"<P>{x}<S>{z}<M>{y}"


def _strange(rng):
    alphabet = " \t\n\x0b\x0c\r\x1c\x1f\x85\xa0　aé日😀<PSM>!)\x00\x08\x0e\x21\x7f\x7e"
    return "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))


@pytest.mark.parametrize("rate, suffix_first", [(50, 80), (100, 50), (0, 0)])
def test_texts_are_cut_at_unit_ends_and_come_back(spark, rate, suffix_first):
    rng = random.Random(rate)
    rows = [(i, _strange(rng)) for i in range(600)] + [(700, "<P> a b"), (701, " <S"), (702, "x<"), (703, "> y z <")]
    out = infill.transformed(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2), rate=rate, suffix_first=suffix_first)
    found = out.withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    assert sorted(tuple(r)[:-1] for r in found) == sorted(_moved(k, t, 42, rate, suffix_first) for k, t in rows)
    texts = dict(rows)
    assert all(r["back"] == texts[r["doc_id"]] for r in found)


def test_infill_of_odd_rows(odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    found = [tuple(r) for r in infill.transformed(odd, rate=100).collect()]
    assert sorted(found, key=repr) == sorted((_moved(k, t, rate=100) for k, t in rows), key=repr)
    assert infill.transformed(none).collect() == []


def test_rank_and_select_at_every_byte():
    rng = random.Random(3)
    texts = [_strange(rng) for _ in range(200)] + ["", " ", "a", "a" * 8, " " * 9]
    units = [UNIT.findall(t) for t in texts]
    sliced = pa.array(["skipped", *texts])[1:]
    for k in range(45):
        n, prefix, middle = infill.cut_points(sliced, np.full(len(texts), k), np.full(len(texts), 2 * k + 1))
        assert n.tolist() == [len(u) for u in units]
        cuts = [sorted((k % (len(u) + 1), (2 * k + 1) % (len(u) + 1))) for u in units]
        assert prefix.tolist() == [len("".join(u[:a])) for u, (a, _) in zip(units, cuts)]
        assert middle.tolist() == [len("".join(u[a:b])) for u, (a, b) in zip(units, cuts)]


# Hard negatives


def _mined(rows, is_anchor):
    """All pairs, in plain Python."""
    usable = {}
    for key, v, label in rows:
        if key is None or label is None or v is None or any(x is None or x != x or abs(x) == float("inf") for x in v):
            continue
        row = (label, [int(np.floor(256 * np.float64(x))) for x in v])
        usable.setdefault(key, []).append(row)
    lengths = Counter(len(v) for rows_of in usable.values() for _, v in rows_of)
    common = min(lengths, key=lambda n: (-lengths[n], n), default=0)
    one = {k: min(r for r in rows_of if len(r[1]) == common) for k, rows_of in usable.items() if any(len(r[1]) == common for r in rows_of)}
    out = []
    for a in filter(is_anchor, one):
        score = {k: sum(x * y for x, y in zip(one[a][1], v)) for k, (_, v) in one.items() if k != a}
        best = sorted(score, key=lambda k: (-score[k], k))
        for p in [k for k in best if one[k][0] == one[a][0]][:5]:
            fits = [k for k in best if one[k][0] != one[a][0] and 30 * score[p] <= 100 * score[k] <= 90 * score[p]][:10]
            out += [(a, p, i + 1, k, score[p], score[k]) for i, k in enumerate(fits)]
    return sorted(out)


def _vectors(rng, n, dims=8, ties=False):
    draw = (lambda: rng.choice([-0.5, 0.0, 0.25, 0.5])) if ties else (lambda: rng.gauss(0, 0.4))
    return [(i, [draw() for _ in range(dims)], rng.randrange(4)) for i in range(n)]


VECTORS = "vec_id bigint, embedding array<float>, label int"


@pytest.mark.parametrize("ties", [False, True])
@pytest.mark.parametrize("block", [16, 8192])
def test_negatives_equal_all_pairs(spark, ties, block):
    rows = _vectors(random.Random(4), 300, ties=ties)
    rows = [(k, [float(np.float32(x)) for x in v], label) for k, v, label in rows]
    table = spark.createDataFrame(rows, VECTORS).repartition(3)
    found = hard_negatives.mined(table, F.col("id") % 10 == 0, row_parts=3, part_anchors=7, block=block)
    assert sorted(tuple(r) for r in found.collect()) == _mined(rows, lambda k: k % 10 == 0)


def test_vectors_that_take_no_part(spark):
    rng = random.Random(6)
    rows = _vectors(rng, 60, dims=4, ties=True)
    rows += [(60, None, 1), (61, [0.5, None, 0.0, 0.0], 1), (62, [float("nan"), 0.0, 0.0, 0.5], 1), (63, [float("inf"), 0.0, 0.0, 0.5], 1)]
    rows += [(64, [0.5, 0.5, 0.5, 0.5], None), (None, [0.5, 0.5, 0.5, 0.5], 1), (65, [0.5, 0.5], 1), (66, [], 1), (70, [0.0] * 4, 1), (80, [0.0] * 4, 2)]
    rows += [(1, [9.0, 9.0, 9.0, 9.0], 3), (2, [9.0, 9.0, 9.0, 9.0], -1), rows[3], rows[3]]
    wide = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], f"{VECTORS}, id string, v string, part int")
    found = hard_negatives.mined(wide, F.col("id") % 10 == 0)
    assert sorted(tuple(r) for r in found.collect()) == _mined(rows, lambda k: k % 10 == 0)
    assert hard_negatives.mined(wide.limit(0), F.col("id") % 10 == 0).collect() == []


def test_the_search_stops_before_the_end():
    rng = np.random.default_rng(1)
    vectors = rng.integers(-100, 100, (4000, 2))
    block = hard_negatives.Block(np.arange(4000), np.zeros(4000, np.int64), vectors)
    tops, met = hard_negatives.Tops(5, np.array([-hard_negatives.EDGE]), np.array([hard_negatives.EDGE])), []
    anchor = np.array([90, -40])

    def take(new, scores):
        met.extend(new.tolist())
        tops.add(new, scores)

    block.search(anchor, tops.closed, take)
    scores = vectors @ anchor
    assert tops.best[0][0].tolist() == sorted(range(4000), key=lambda i: (-scores[i], i))[:5]
    assert len(met) < 2000 and len(set(met)) == len(met)


# Registered queries


@pytest.mark.parametrize("name", ["op11_substring_dedup", "op12_fill_in_middle", "op13_hard_negatives"])
def test_registered_queries_equal_their_sql(spark, name):
    from tests.compare_sql import compare, connect

    folder = "/root/testdata/sf0.001"
    same, said = compare(spark, connect(folder), folder, name)
    assert same, said
    assert name in contract.oracle_sql()
