import os
import random
from pathlib import Path

import pytest

os.environ["PYTHONPATH"] = f"{Path(__file__).resolve().parents[2]}:{os.environ.get('PYTHONPATH', '')}"

COLUMNS = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, key string, score string, "
    "kept string, class_id string, n_links string, ids string, decoded string, target string, taken string, size string, words string, line string"
)
CLASH = ("x",) * 13


def prose(rng: random.Random, words: int) -> str:
    return " ".join(rng.choice("the of river stone walks under bright green hill and cloud moves slowly past old towers".split()) for _ in range(words))


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and long texts, ties, repeated rows and clashing column names."""
    rng = random.Random(5)
    texts = [None, "", " \n\t ", "one", prose(rng, 60), prose(rng, 60), prose(rng, 20_000), "été ▁ naïve 日本語 " * 9]
    rows = [(i, t, "en" if i % 2 else None, "a" if i % 3 else None, 1, *CLASH) for i, t in enumerate(texts)]
    rows += [rows[4], rows[4], (100, texts[4], "en", "b", None, *CLASH), (None, texts[5], None, None, None, *CLASH), (101, None, None, None, None, *CLASH)]
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
