"""Joins, searches, mixing and tokens against brute force."""

import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from oremill.llm import line_dedup, mixing, neighbours, ngram_join, tokens
from oremill.llm.text import own_bytes, tidy

MODEL = str(public_tokenizers.path("piece_bpe_32k.model"))


def _words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def _grams(text):
    w = _words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def _similar(a, b):
    return bool(a and b) and len(a & b) >= 0.8 * len(a | b) - 1e-9


def _near_copies(rng, groups, size, words=60):
    made = []
    for _ in range(groups):
        base = [str(rng.randint(0, 500)) for _ in range(words)]
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(words)] = str(rng.randint(0, 500))
            made.append(" ".join(copy))
    return made


def _classes(rows):
    """Class and links by row number, over all pairs."""
    sets = [_grams(t) for _, t in rows]
    parent, links = list(range(len(rows))), Counter()
    find = lambda i: i if parent[i] == i else find(parent[i])
    for i in range(len(rows)):
        for j in range(i):
            if _similar(sets[i], sets[j]):
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    ids = {}
    for i, (key, _) in enumerate(rows):
        ids.setdefault(find(i), []).append(key)
    name = {root: min((k for k in keys if k is not None), default=None) for root, keys in ids.items()}
    return sorted(((key, name[find(i)], links[i]) for i, (key, _) in enumerate(rows)), key=repr)


@pytest.mark.parametrize("block", [1024, 7])
def test_ngram_join(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", block)
    rng = random.Random(block)
    texts = _near_copies(rng, 6, 14) + _near_copies(rng, 1, 60) + ["a b", "a b", "a", "", None, "a b c d e f"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (3, texts[3]), (7, texts[40])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert sorted(map(tuple, ngram_join.joined(docs).collect()), key=repr) == _classes(rows)


def test_ngram_join_of_odd_rows(odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert sorted(map(tuple, ngram_join.joined(odd).collect()), key=repr) == _classes(rows)
    assert ngram_join.joined(none).collect() == []
    alone = ngram_join.without_copies(odd)
    assert alone.columns == odd.columns and sorted(r["doc_id"] for r in alone.collect()) == [0, 1, 2, 3, 4, 5, 6, 7, 101]


def test_without_copies_keeps_one_of_every_class(spark):
    rng = random.Random(12)
    one, two, three, four, five = (" ".join(str(rng.randint(0, 500)) for _ in range(60)) for _ in range(5))
    near = " ".join([*three.split()[:-1], "end"])
    rows = [(None, one), (None, two), (None, one), (1, three), (1, four), (2, near), (2, five), (3, five), (None, None), (None, ""), (4, " ")]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id bigint, text string, at int").repartition(3)
    got = ngram_join.without_copies(docs)
    assert got.columns == docs.columns
    kept = sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr)
    assert kept == sorted([(None, one), (None, two), (1, three), (1, four), (2, five), (None, None), (None, ""), (4, " ")], key=repr)


def test_banding_keeps_its_recall():
    for similarity in (0.5, 0.8, 0.95):
        bands, rows = ngram_join.banding(similarity, 0.999)
        assert 1 - (1 - similarity**rows) ** bands >= 0.999


def _kept_lines(rows):
    seen, kept = [], {}
    order = lambda r: (r[0] is not None, r[0] or 0)
    for key, text in sorted(dict.fromkeys(rows), key=order):
        for number, line in enumerate((text or "").split("\n")):
            words = set(_words(line))
            if words:
                kept.setdefault(key, [])
                if not any(_similar(words, other) for other in seen):
                    kept[key].append(number)
                seen.append(words)
    return kept


@pytest.mark.parametrize("block,listed", [(1024, 4096), (5, 3)])
def test_line_dedup(spark, monkeypatch, block, listed):
    monkeypatch.setattr(line_dedup, "BLOCK_ROWS", block)
    monkeypatch.setattr(line_dedup, "LIST_ROWS", listed)
    rng = random.Random(block)
    lines = _near_copies(rng, 8, 8, words=12) + _near_copies(rng, 5, 6, words=40) + ["the of", "of the the", "x", "", " "] * 2
    rng.shuffle(lines)
    rows = [(i, "\n".join(lines[at : at + 4])) for i, at in enumerate(range(0, len(lines), 4))] + [(90, None), (91, ""), (None, lines[0])]
    docs = spark.createDataFrame(rows + rows[:2], "doc_id bigint, text string").repartition(3)
    got = {r["id"]: r["kept"] for r in line_dedup.kept_lines(docs).collect()}
    assert got == _kept_lines(rows)


def test_line_dedup_of_odd_rows(odd, none):
    got = {r["id"]: r["kept"] for r in line_dedup.kept_lines(odd).collect()}
    assert got == _kept_lines([(r["doc_id"], r["text"]) for r in odd.collect()])
    left = line_dedup.deduplicated(odd)
    assert left.columns == odd.columns
    assert {r["doc_id"] for r in left.collect()} == {0, 1, 2, 101, *(k for k, v in got.items() if v)}
    assert line_dedup.deduplicated(none).collect() == []


def test_line_dedup_cuts_texts(spark):
    docs = spark.createDataFrame([(1, "a b\n\nc d\nc d"), (2, "c d\nnew"), (3, "a b")], "doc_id int, text string")
    assert sorted(map(tuple, line_dedup.deduplicated(docs).collect())) == [(1, "a b\n\nc d"), (2, "new")]


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((20, 16))
    vectors = (centres[rng.integers(0, 20, 1500)] + 0.4 * rng.standard_normal((1500, 16))).astype(np.float32)
    vectors[100:140] = vectors[100]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    odd_rows = [(5000, None), (5050, [0.0] * 16), (5100, [float("nan")] * 16), (5150, [1.0] * 3), (5200, [None] * 16), (None, rows[3][1]), rows[50], rows[50]]
    table = spark.createDataFrame(rows + odd_rows, "vec_id bigint, embedding array<float>").withColumn("id", F.lit("x")).withColumn("v", F.lit(1))
    got = neighbours.nearest(table, F.col("id") % 50 == 0, leaf=64, recall=0.98).collect()
    unit = vectors.astype(float)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    hits, found = 0, {}
    for r in got:
        found.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert set(found) == set(range(0, 1500, 50))
    for q, best in found.items():
        scores = unit @ unit[q]
        wanted = [i for i in np.lexsort((np.arange(1500), -scores.round(12))) if i != q][:5]
        assert sorted(best) == [1, 2, 3, 4, 5]
        ranked = [best[k] for k in sorted(best)]
        assert ranked == sorted(ranked, key=lambda x: (-x[1], x[0])) and all(abs(s - scores[v]) < 1e-12 for v, s in ranked)
        hits += len({v for v, _ in ranked} & set(wanted))
    assert hits >= 0.9 * 5 * len(found)
    assert [v for v, _ in (found[100][k] for k in range(1, 6))] == [101, 102, 103, 104, 105]
    assert neighbours.nearest(table.limit(0), F.col("id") % 50 == 0).collect() == []
    few = neighbours.nearest(table.where("vec_id in (0, 7)"), F.col("id") % 50 == 0).collect()
    assert [(r["query_id"], r["vec_id"]) for r in few] == [(0, 7)]


def test_neighbours_compare_bounded_groups(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((400, 8)))]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    everyone = F.col("id") >= 0
    wanted = sorted(map(tuple, neighbours.nearest(table, everyone, leaf=1000).collect()))
    compare = neighbours._compare

    def bounded(k):
        inner = compare(k)

        def best(group):
            asked = np.array(group["asks"])
            assert max(asked.sum(), (~asked).sum()) < 60  # 400 rows in parts of about 20
            return inner(group)

        return best

    monkeypatch.setattr(neighbours, "PART", 20)
    monkeypatch.setattr(neighbours, "_compare", bounded)
    assert sorted(map(tuple, neighbours.nearest(table, everyone, leaf=1000).collect())) == wanted


def test_targets_share_everything():
    rng = random.Random(6)
    for _ in range(50):
        sizes, weights = [rng.randint(0, 99) for _ in range(8)], [rng.choice((5, 2, 1)) for _ in range(8)]
        got = mixing.targets(sizes, weights)
        assert abs(sum(got) - sum(sizes)) < 1e-6 and all(g <= 3 * s + 1e-9 for g, s in zip(got, sizes))
        free = [g / w for g, w, s in zip(got, weights, sizes) if g < 3 * s - 1e-6]
        assert not free or max(free) - min(free) < 1e-6


def test_sainte_lague_by_quotients():
    rng = random.Random(7)
    for _ in range(100):
        votes, seats = [rng.randint(0, 1000) for _ in range(rng.randint(1, 9))], rng.randint(0, 60)
        most = [rng.randint(5, 40) if v else 0 for v in votes]
        quotients = sorted(((-v / (2 * k + 1), i, k) for i, (v, m) in enumerate(zip(votes, most)) for k in range(m) if v))
        dealt = Counter(i for _, i, _ in quotients[: min(seats, sum(most))])
        assert mixing.sainte_lague(votes, seats, most) == [dealt[i] for i in range(len(votes))]


@pytest.mark.parametrize("shard_words", [1 << 20, 500])
def test_mix(spark, monkeypatch, shard_words):
    monkeypatch.setattr(mixing, "SHARD_WORDS", shard_words)
    rng = random.Random(8)
    rows = [(i, rng.choice(["a", "a", "a", "b", "c", None]), rng.randint(0, 300)) for i in range(400)] + [(1, "a", 9), (1, "a", 9)]
    mix = mixing.mixed(spark.createDataFrame(rows, "doc_id bigint, source string, size bigint").repartition(3).withColumn("target", F.lit("x")), (5, 2, 1))
    got = mix.collect()
    again = mixing.mixed(spark.createDataFrame(rows[::-1], "doc_id bigint, source string, size bigint"), (5, 2, 1)).collect()
    taken = lambda found: sorted((r["doc_id"], r["size"], r["taken"]) for r in found)
    assert taken(got) == taken(again) and len(got) == len(rows)
    for source in ("a", "b", "c", None):
        mine = [r for r in got if r["source"] == source]
        aim = mine[0]["target"]
        assert mine[0]["source_size"] == sum(r["size"] for r in mine)
        assert abs(sum(r["taken"] for r in mine) - aim) <= max(0.05 * aim, 64)
        assert all(r["taken"] <= 3 * r["size"] and r["run_first"] + r["run_words"] <= r["size"] for r in mine)


def test_mix_of_odd_rows(odd, none):
    sized = odd.withColumn("size", mixing.n_words(F.col("text")))
    mix = mixing.mixed(sized, (5, 2, 1))
    assert {r["taken"] for r in mix.where("size = 0").collect()} == {0} and mix.count() == odd.count()
    texts = mixing.taken_documents(mix)
    words = texts.select(F.sum(mixing.n_words(F.col("text")))).first()[0]
    assert words == mix.select(F.sum("taken")).first()[0]
    assert mixing.mixed(none.withColumn("size", mixing.n_words(F.col("text"))), (1,)).collect() == []


def test_tokens_equal_the_library(odd, none):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = tokens.decode_documents(tokens.encode_documents(odd, MODEL), MODEL)
    assert set(got.columns) == set(odd.columns)
    for r in got.collect():
        ids = library.encode(r["text"] or "")
        assert r["ids"] == ids and r["decoded"] == (library.decode(ids) if ids else "")
    assert sorted(map(repr, tokens.round_trip(odd, MODEL).select(got.columns).collect())) == sorted(map(repr, got.collect()))
    assert tokens.encode_documents(none, MODEL).collect() == tokens.round_trip(none, MODEL).collect() == []


def test_chunks_equal_the_library(monkeypatch):
    monkeypatch.setattr(tokens, "TABLE_ROWS", 50)
    rng, table = random.Random(9), tokens.ChunkTable(MODEL)
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for _ in range(20):
        texts = ["".join(rng.choice(" ▁\nabcé日<s>🎉0123\t\x00") for _ in range(rng.randint(0, 90))) for _ in range(40)] + [None, "x" * 500]
        assert table.ids(texts).to_pylist() == [library.encode(t or "") for t in texts]


def test_pipeline(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    before = docs.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "line dedup", "n-gram Jaccard join", "mixing sources to target weights", "SentencePiece encoding and decoding",
    ]
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        assert docs.columns == columns
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert len(rows) < before and all(cls == key for key, cls, _ in _classes(rows))
    last = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert last.count() > 0 and last.where("not round_trip or n_tokens = 0").count() == 0


def test_join_with_a_third_of_the_ids_null_stays_linear(spark):
    rng = random.Random(12)
    texts = _near_copies(rng, 400, 2, words=100)
    rows = [(None if i % 3 == 0 else i // 5, t) for i, t in enumerate(texts)]  # null ids, and ids that several rows share
    found = ngram_join.joined(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4))
    assert Counter(tuple(r) for r in found.collect()) == Counter(_classes(rows))


def test_line_dedup_tries_further_candidates(spark, monkeypatch):
    """Long lines that nearly match many others, and match one of them: the likeliest candidate alone does not decide."""
    monkeypatch.setattr(line_dedup, "BLOCK_ROWS", 4)
    monkeypatch.setattr(line_dedup, "HUB_ROWS", 2)
    monkeypatch.setattr(line_dedup, "PIECE_ROWS", 8)
    asked = []
    whole_way = line_dedup._to_blocks
    monkeypatch.setattr(line_dedup, "_to_blocks", lambda *a: asked.append(1) or whole_way(*a))
    rng = random.Random(7)
    base = [f"w{i}" for i in range(400)]
    lines = []
    for _ in range(30):  # 400 words of which 15 to 30 are new: similar at about 0.74 to 0.86
        words = list(base)
        for at in rng.sample(range(400), rng.randrange(15, 31)):
            words[at] = f"v{rng.randrange(10**6)}"
        lines.append(" ".join(words))
    rows = [(None if i % 5 == 0 else i // 2, line) for i, line in enumerate(lines)]
    rows = [(k, "\n".join(t for j, t in rows if j == k)) for k in dict.fromkeys(k for k, _ in rows)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    expected = _kept_lines(rows)
    assert 0 < sum(len(v) for v in expected.values()) < 30
    assert {r["id"]: r["kept"] for r in line_dedup.kept_lines(docs).collect()} == expected
    assert asked


def test_line_dedup_hands_small_batches_to_python(spark, monkeypatch):
    name, seen, counted = "spark.sql.execution.arrow.maxBytesPerBatch", [], line_dedup.counted
    monkeypatch.setattr(line_dedup, "counted", lambda *args: seen.append(spark.conf.get(name)) or counted(*args))
    before = spark.conf.get(name)
    docs = spark.createDataFrame([(1, "a b c\nd e f"), (2, "a b c\ng h i")], "doc_id long, text string")
    kept = {r.id: r.kept for r in line_dedup.kept_lines(docs).collect()}
    assert kept == {1: [0, 1], 2: [1]}
    assert seen == ["2m"] and spark.conf.get(name) == before


def test_line_dedup_deals_lists_only_where_one_is_long(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"one two three four five word{i % 3} six seven eight nine") for i in range(40)], "doc_id bigint, text string")
    seen, listed = [], line_dedup._listed
    monkeypatch.setattr(line_dedup, "_listed", lambda *args, **more: seen.append(listed(*args, **more)) or seen[-1])
    kept = [r.id for r in line_dedup.kept_lines(docs).collect() if r.kept]
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert kept == [0] and len(seen) == 1 and "blocks" not in plan and "Generate" not in plan


def test_line_dedup_lists_in_rounds_of_packed_buckets(spark):
    """A round shuffles its own buckets only, a few rows of bytes, and the rounds list every prefix word of every line once."""
    rng = random.Random(3)
    lines = [(2**33 + i if i % 2 else i, 8, i, -i, [rng.randrange(1, 60) for _ in range(4)]) for i in range(500)]
    lines = spark.createDataFrame(lines, "n bigint, size int, signature bigint, second bigint, prefix array<int>")
    listed = line_dedup._listed(lines.withColumn("often", F.array().cast("array<int>")), None, 0.8)
    rounds = [line_dedup._share(listed, turn) for turn in range(line_dedup.ROUNDS)]
    got, buckets = Counter(), []
    for part in rounds:
        plan = part._jdf.queryExecution().optimizedPlan().toString()
        assert 0 <= plan.index("Repartition") < plan.index("Filter") < plan.index("MapInArrow")
        batches = part.toArrow().to_batches()
        buckets.append({b for batch in batches for b in batch.column("bucket").to_pylist()})
        for rows in line_dedup._pieces(iter(batches)):
            columns = [rows[c].tolist() for c in ("group", "n", "signature", "second", "size", "place", "before")]
            assert list(zip(*columns[:2])) == sorted(zip(*columns[:2]))
            got.update(zip(*columns))
    expected = Counter(
        (w, r.n, r.signature, r.second, r.size, at, r.prefix[at - 1] if at else 0) for r in lines.collect() for at, w in enumerate(r.prefix)
    )
    assert got == expected and not buckets[0] & buckets[1] and listed.count() < 100


def test_line_dedup_deals_long_lists_to_pairs_of_blocks():
    """Any two rows of a word meet in some group, those of a short list in the word's own; no piece grows with the list."""
    rows = {"group": np.array([7] * 40 + [9] * 5, np.uint32), "n": np.arange(45)}
    pieces = list(line_dedup._dealt(rows, (np.array([7], np.int32), np.array([10]))))
    group, n = (np.concatenate([p[c] for p in pieces]) for c in ("group", "n"))
    members = {g: set(n[group == g].tolist()) for g in set(group.tolist())}
    assert len(n) == 40 * 10 + 5 and members[9] == set(range(40, 45))
    assert all(any({a, b} <= m for m in members.values()) for a in range(40) for b in range(a))
    assert max(len(m) for g, m in members.items() if g != 9) < 40


def test_workers_give_freed_memory_back():
    def held(batches):
        for n in batches:
            pieces = [np.ones(8_000) for _ in range(n)]  # 64 KB each, too small for maps of their own
            tail.append(pieces[-1])  # holds the heap up behind what is freed
            yield own_bytes()

    tail = []
    before = own_bytes()
    (most,) = tidy(held)(iter([6_000]))
    assert most > before + 300_000_000 and own_bytes() < before + 150_000_000


def test_pipeline_hands_small_batches_to_python(spark):
    docs = spark.createDataFrame([(1, "web", "a b c")], "doc_id bigint, source string, text string")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    corpus_pipeline.STAGES[3][1](spark, docs, "")
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "2m"
