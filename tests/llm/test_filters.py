"""Language, url, license and quality operators."""

import random
import re
import time

import numpy as np
from pyspark.sql import functions as F

from oremill.llm import language_id, licenses, quality_model, quality_rules, url_filter


def _phrases(text: str, reference: str) -> int:
    """Longest matches from left to right, one by one."""
    count = at = 0
    while at < len(text):
        length = 1
        while at + length < len(text) and text[at : at + length + 1] in reference:
            length += 1
        count, at = count + 1, at + length
    return count


def test_phrases_equal_brute_force():
    rng = random.Random(1)
    draw = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    model = (("a", draw("abc ", 300)), ("b", draw("abcde", 400)))
    parser = language_id.Parser(model)
    texts = [draw("abcdef ", n) for n in (1, 2, 17, 200, 900)] + [""]
    symbols, owner = parser.fold(texts)
    found = parser.phrases(symbols, owner, len(texts))
    squeeze = lambda t: re.sub(r"[^a-z]+", " ", t).lstrip()
    for row, (_, reference) in zip(found, model):
        assert row.tolist() == [_phrases(squeeze(t), squeeze(reference)) for t in texts]


def test_phrases_of_long_texts_restart_by_segment():
    parser = language_id.Parser((("a", "abcabc"),))
    symbols, owner = parser.fold(["abc" * 2000])
    lengths = [language_id.SEGMENT] * 2 + [6000 - 2 * language_id.SEGMENT]
    text, at, wanted = "abc" * 2000, 0, 0
    for n in lengths:
        wanted += _phrases(text[at : at + n], "abcabc")
        at += n
    assert parser.phrases(symbols, owner, 1)[0, 0] == wanted


def test_language_of_odd_rows(odd, none):
    model = language_id.learn(odd)
    assert [name for name, _ in model] == ["en"]
    got = {r["doc_id"]: r["p"] for r in odd.select("doc_id", language_id.predicted(F.col("text"), model).alias("p")).collect()}
    assert got[0]["lang"] == got[1]["lang"] == got[2]["lang"] == "und" and got[0]["score"] == 0
    assert got[4]["lang"] == got[6]["lang"] == "en" and 0 < got[4]["score"] <= 1
    assert language_id.learn(none) == ()
    assert {r["p"]["lang"] for r in odd.select(language_id.predicted(F.col("text"), ()).alias("p")).collect()} == {"und"}


def test_held_out_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    apart = language_id.held_out(F.col("doc_id"))
    model = language_id.learn(docs.where(~apart))
    guess = docs.where(apart).select("lang", language_id.predicted(F.col("text"), model)["lang"].alias("p"))
    right, total = guess.select(F.count_if(F.col("lang") == F.col("p")), F.count("*")).first()
    assert right >= 0.98 * total


def test_url_parts_and_rules(spark):
    rules = [url_filter.Rule("allow", "org", "/"), url_filter.Rule("block", "a.org", "/x"), url_filter.Rule("block", "com", "/de/")]
    cases = {
        "http://A.org/x1?q#f": ("a.org", "/x1", "a.org/x", "block"),
        "https://b.A.ORG/y": ("b.a.org", "/y", "org/", "allow"),
        "x://aa.org": ("aa.org", "", None, "allow"),
        "ftp://corg/x": ("corg", "/x", None, "allow"),
        "http://casino-poker.net/b#/x": ("casino-poker.net", "/b", None, "block"),
        "p://q.com?x/de/": ("q.com", "", None, "allow"),
        "no scheme/de/": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "a://b://c/d": ("b:", "//c/d", None, "allow"),
        "http://long.com/de/" + "z" * 100_000: ("long.com", "/de/" + "z" * 100_000, "com/de/", "block"),
    }
    pages = spark.createDataFrame([(i, u, None if i == 2 else "<p>casino poker river</p>", "h", "p") for i, u in enumerate(cases)], "page_id bigint, url string, html string, host string, path string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judged(pages, rules).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())
    assert url_filter.judged(pages.limit(0), rules).collect() == []


def test_url_score_learns_beyond_seeds_and_rules(spark):
    rules = [
        url_filter.Rule("allow", "org", "/"), url_filter.Rule("allow", "com", "/fr/"), url_filter.Rule("block", "com", "/de/"),
        url_filter.Rule("block", "zorgo-spree.com", "/"), url_filter.Rule("block", "mall-zorgo.com", "/"),
    ]
    urls = [f"http://site{chr(97 + i % 26)}{chr(97 + i // 26)}x.{top}" for i in range(300) for top in ("org/en/1", "com/de/1", "com/fr/1")]
    urls += [f"http://{host}/en/{i}" for i in range(15) for host in ("zorgo-spree.com", "mall-zorgo.com")]
    # A host of which a third is blocked by its path, as much as is allowed.
    urls += [f"http://blog.hotone.com/{lang}/{i}" for i in range(200) for lang in ("de", "fr")]
    asked = ["http://zorgo-mart.net/a", "http://blog.hotone.com/en/7", "http://plain.net/", "http://cheap-track.net/"]
    pages = spark.createDataFrame([(i, u, "zorgo spree mall mart blog hotone plain") for i, u in enumerate(asked + urls)], "page_id int, url string, html string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judged(pages, rules).where(F.col("page_id") < len(asked)).collect()}
    assert [got[i] for i in range(len(asked))] == ["block", "allow", "allow", "allow"]


def test_url_classes_are_distributions(spark):
    rows = [("a.com", "block", [5, 6], [9])] * 3 + [("b.com", "allow", [7], [])] * 6 + [("c.org", "allow", [8], [])] * 50
    weights = url_filter.fit(spark.createDataFrame(rows, "host string, verdict string, of_host array<int>, of_path array<int>"))
    seen = weights[[5, 6, 9, 7, 8]] - weights[1]  # 3 and 6 urls of one domain weigh 4.5 either way; .org tells nothing
    assert np.allclose(np.exp(seen), [5.5, 5.5, 5.5, 1 / 5.5, 1])


def test_segmentation_is_the_likeliest():
    counts = {"": 1000, "the": 300, "rest": 50, "there": 90, "st": 2, "a": 100, "at": 60}
    split = url_filter.Segmenter(counts)
    assert split.split("therest") == ("the", "rest") and split.split("thereat") == ("there", "at")
    assert split.words("the-rest.x1", "/en/there/12?") == ["h the", "h rest", "h x", "h 01", "p there"]


def _license_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def test_license_scan(odd, none, spark):
    notice = "Licensed under CC BY-NC 4.0. All rights; reserved ALL RIGHTS RESERVED"
    n, base, found = licenses.scan_text(notice)
    words = _license_words(notice)
    assert n == len(words) and [(d.label, d.first, d.last) for d in base] == [("cc-by", 2, 3), ("reserved", 7, 9), ("reserved", 10, 12)]
    assert [(d.label, d.first) for d in found] == [("cc-by-nc", 0), ("reserved", 7), ("reserved", 10)]
    lesser = licenses.scan_text("the GNU Lesser General Public License, version 3")
    assert [d.label for d in lesser[1]] == ["gpl"] and [d.label for d in lesser[2]] == ["lgpl"]
    assert licenses.scan_text("we met a mit here; Straße ÄÖ")[1:] == ([], []) and len(licenses.rules()) > 200
    got = odd.select("text", licenses.scanned(F.col("text")).alias("s")).collect()
    assert all(r["s"]["n_words"] == len(_license_words(r["text"])) and r["s"]["score"] == 0 for r in got)
    assert none.select(licenses.scanned(F.col("text"))).collect() == []


def _drawn(rng, parsed):
    """A random match of a parsed pattern."""
    out = ""
    for op, value in parsed:
        op = str(op)
        if op == "LITERAL":
            out += chr(value)
        elif op == "IN":
            kind, what = rng.choice(value)
            out += chr(what if str(kind) == "LITERAL" else rng.randint(*what))
        elif op == "SUBPATTERN":
            out += _drawn(rng, value[-1])
        elif op == "BRANCH":
            out += _drawn(rng, rng.choice(value[1]))
        elif op == "MAX_REPEAT":
            out += "".join(_drawn(rng, value[2]) for _ in range(rng.randint(value[0], min(value[1], value[0] + 12))))
        elif op == "NOT_LITERAL":
            out += rng.choice("abx")
        else:
            assert op == "ASSERT", op
    return out


def test_license_gate_loses_no_match():
    labels = lambda t: {d.label for d in licenses.scan_text(t)[2]}
    assert labels("Licence: MIT") == {"mit"} and labels("FreeBSD licence") == {"bsd-2-clause"}
    rng = random.Random(8)
    for rule in licenses.rules():
        for _ in range(12):
            text = _drawn(rng, re._parser.parse(rule.pattern.pattern.decode()))
            line = f" {text} ".encode()
            every = [licenses.Detection(r.label, *span, r.priority, r.confidence) for r in licenses.rules() for span in licenses._spans(line, r.pattern)]
            assert every and licenses.scan_text(text)[2] == sorted(licenses.unsuppressed(every), key=lambda d: (d.first, d.last)), text


def test_license_suppression_against_all_pairs():
    rng = random.Random(3)
    within = lambda d, t: t.first <= d.first and d.last <= t.last
    for most in (0, 1, 6, 20, 60, 200):
        found = [licenses.Detection(rng.choice("ab"), f, f + rng.randint(0, 6), rng.randint(0, 3), 0.5) for f in (rng.randint(0, most) for _ in range(most))]
        kept = licenses.unsuppressed(found)
        rank = {d: i for i, d in enumerate(sorted(set(found), key=lambda d: (-d.priority, d.first - d.last, d.first, d.label)))}
        assert set(kept) == {d for d in rank if not any(rank[t] < rank[d] and within(d, t) for t in rank)}


def test_license_bodies_and_many_mentions():
    labels = lambda t: {d.label for d in licenses.scan_text(t)[2]}
    assert labels("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software") == {"bsd-3-clause"}
    assert labels("Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.") == {"zlib"}
    assert labels("Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS,") == {"apache-2.0"}
    start = time.monotonic()
    n, _, found = licenses.scan_text("gpl text " * 200_000)
    assert n == 400_000 and [d.first for d in found] == list(range(0, 400_000, 2)) and time.monotonic() - start < 30


def _measures(text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)}
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return (len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


def test_quality_measures(spark, odd, none):
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab# \n") for _ in range(n)) for n in (5, 40, 300)] + ["a b c d e f g h i " * 3, "x\n\nx \nx", "😀 é\x0b\x0c|", None, ""]
    rows = spark.createDataFrame([(i, t, None, None) for i, t in enumerate(texts)], "doc_id int, text string, lang string, source string")
    got = {r["doc_id"]: tuple(r[c] for c in quality_rules.COUNTS[:5]) for r in quality_rules.measures(rows).collect()}
    assert [got[i] for i in range(len(texts))] == [_measures(t) for t in texts]
    judged = quality_rules.judged(odd).collect()
    assert len(judged) == odd.count() and all(not r["kept"] for r in judged if r["base_failed"])
    assert quality_rules.judged(none).collect() == []


def test_quality_sketches_merge(odd):
    whole = quality_rules.sketches(quality_rules.measures(odd), ())
    parts = quality_rules.sketches(quality_rules.measures(odd)).groupBy("metric", "bucket").agg(F.sum("rows").alias("rows"))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.collect()))
    steps = odd.sparkSession.range(0, 100_000, 37).select("id", quality_rules.bucket(F.col("id")).alias("b"))
    assert steps.where((F.col("b") > F.col("id")) | (F.col("id") > F.col("b") * 65 / 64)).count() == 0


def test_weak_labels_find_the_bad():
    rng = np.random.default_rng(0)
    truth = rng.random(5000) < 0.8
    right = np.array([0.95, 0.9, 0.85, 0.9, 0.6])
    votes = np.where(rng.random((5000, 5)) < right, truth[:, None], ~truth[:, None])
    counts = {}
    patterns = ["".join("-+"[v] for v in row) for row in votes.astype(int)]
    for p in patterns:
        counts[p] = counts.get(p, 0) + 1
    good = quality_model.posteriors(counts)
    assert np.mean([(good[p] > 0.5) == t for p, t in zip(patterns, truth)]) > 0.95
    assert quality_model.posteriors({}) == quality_model.posteriors({"": 3}) == {}


def test_quality_classifier(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    judged = quality_model.judged(docs).join(labels, "doc_id")
    rates = {r["quality"]: r["kept"] for r in judged.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert rates[1] > 0.97 and rates[0] < 0.2
    got = quality_model.judged(odd)
    assert got.columns == odd.columns and got.where("text is null and (kept or score > 0)").count() == 0 and got.count() == odd.count()
    assert quality_model.judged(none).collect() == []


def test_training_sample_is_bounded_and_never_empty(spark, monkeypatch):
    taken = []
    train = quality_model.train
    monkeypatch.setattr(quality_model, "train", lambda index, lengths, good: taken.append(len(lengths)) or train(index, lengths, good, steps=2))
    unlike = [(None, f"river stone number {i} walks under the bridge") for i in range(300)]
    same = [(None, "one and the same text")] * 300
    for rows, wanted in ((unlike, 20), (same, 1), (unlike + same + [(1, None), (2, " ")], 20), (same[:1], 1)):
        quality_model.fit(spark.createDataFrame(rows, "doc_id bigint, text string"), train_rows=20)
        assert taken.pop() == wanted
