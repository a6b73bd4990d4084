"""Language identification by cross-parsing.

A bounded sample of labelled text per language becomes a suffix automaton.  A text is
parsed against each of them: every phrase is the longest match from where the last one
ended (a letter that the reference never has is a phrase of its own).  A phrase costs a
pointer into the reference, so the phrases are normalised by ``log2`` of the
reference's length and by the text's length; the language that needs fewest wins, the
smaller label among equals.

Before parsing, letters are lower-cased and runs of anything else become one
separator.  Texts are parsed whole, in segments of ``SEGMENT`` symbols that each begin
a phrase, so that the many segments of a batch advance together in numpy, one symbol
at a time; a very long text is just more segments.

Automaton and restart rule are folded into one transition table a language: a missing
transition leads where the symbol leads from the root and is marked as a phrase start.
The tables hold about 15 MB a language, whatever the corpus.

A text that is null or has no letter gets ``und`` with score 0, and so does every text
if nothing was learned.  Repeated rows are predicted one by one.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oremill.llm.text import sliced, whole
from oremill.plans.staging import stage

ROWS_PER_LANGUAGE = 256  # documents of the sample, those of smallest hash
PIECE_CHARS = 128  # characters taken from each, at a hashed place
OWN_SYMBOLS = 180  # most frequent letters, with symbols of their own
SHARED_SYMBOLS = 16  # the other letters share these
SEGMENT = 2048

#: Sorted pairs of a language and its reference text.
Model = tuple[tuple[str, str], ...]


def learn(
    labelled: DataFrame,
    text: str = "text",
    lang: str = "lang",
    key: str = "doc_id",
    rows_per_language: int = ROWS_PER_LANGUAGE,
    piece_chars: int = PIECE_CHARS,
) -> Model:
    """Reference texts of at most ``rows_per_language * piece_chars`` characters a language.

    The driver receives these pieces only.  Rows without label or text teach nothing.
    """
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).alias("lang"), F.col(key).alias("key"), F.xxhash64(F.lit("sample"), F.col(key)).alias("at"), F.col(text).alias("text")
    )
    smallest = Window.partitionBy("lang").orderBy("at", "key")
    ids = rows.select("lang", "key", "at").withColumn("rank", F.row_number().over(smallest))
    chosen = stage(ids.where(F.col("rank") <= rows_per_language), "sample")
    where = 1 + F.pmod("at", F.greatest(F.length("text") - piece_chars, F.lit(1)))
    piece = F.substring(F.col("text"), where.cast("int"), F.lit(piece_chars))
    pieces = (
        rows.select("lang", "key", piece.alias("piece"))
        .alias("r")
        .join(chosen.select("lang", "key", "rank").alias("c"), F.expr("r.lang = c.lang AND r.key <=> c.key"))
        .groupBy("c.lang", "c.rank")
        .agg(F.min("r.piece").alias("piece"))
        .collect()
    )
    texts: dict[str, list] = {}
    for row in sorted(pieces):
        texts.setdefault(row["lang"], []).append(row["piece"])
    model = ((name, " ".join(parts)) for name, parts in sorted(texts.items()))
    return tuple((name, reference) for name, reference in model if any(c.isalpha() for c in reference))


class Parser:
    """Transition tables of all languages over one alphabet."""

    def __init__(self, model: Model):
        self.languages = [name for name, _ in model]
        letters = Counter(self._fold(c) for _, reference in model for c in reference if c.isalpha())
        own = {c: 1 + i for i, (c, _) in enumerate(sorted(letters.items(), key=lambda kv: (-kv[1], kv[0]))[:OWN_SYMBOLS])}
        self.symbols = 1 + len(own) + SHARED_SYMBOLS
        self.code = np.zeros(0x110000, np.uint8)
        for point in range(0x110000):
            c = chr(point)
            if c.isalpha():
                folded = self._fold(c)
                self.code[point] = own.get(folded) or 1 + len(own) + ord(folded) % SHARED_SYMBOLS
        tables, self.start, self.pointer = [], [], []
        states = 0
        for _, reference in model:
            symbols, _ = self.fold([reference])
            table = self._table(symbols.tolist())
            table = np.where(table >= 0, table + states, table - states)  # ~(n + states) is ~n - states
            self.start.append(states)
            self.pointer.append(np.log2(len(symbols) + 1))
            states += len(table)
            tables.append(table)
        self.table = np.concatenate(tables).astype(np.int32).ravel() if tables else np.zeros(0, np.int32)

    @staticmethod
    def _fold(c: str) -> str:
        return c.lower()[0]

    def fold(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all texts in a row, separators merged, and the number of each text."""
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        symbols, owner = self.code[points], np.repeat(np.arange(len(texts)), lengths)
        kept = symbols != 0
        kept[1:] |= (symbols[:-1] != 0) & (owner[1:] == owner[:-1])
        return symbols[kept], owner[kept]

    def _table(self, symbols: list[int]) -> np.ndarray:
        """Next states of the suffix automaton; ``~next`` where a phrase starts."""
        links, lengths, steps, last = [-1], [0], [{}], 0
        for c in symbols:
            new = len(steps)
            steps.append({})
            lengths.append(lengths[last] + 1)
            links.append(0)
            p = last
            while p >= 0 and c not in steps[p]:
                steps[p][c] = new
                p = links[p]
            if p >= 0:
                q = steps[p][c]
                if lengths[q] == lengths[p] + 1:
                    links[new] = q
                else:
                    twin = len(steps)
                    steps.append(dict(steps[q]))
                    lengths.append(lengths[p] + 1)
                    links.append(links[q])
                    while p >= 0 and steps[p].get(c) == q:
                        steps[p][c] = twin
                        p = links[p]
                    links[q] = links[new] = twin
            last = new
        restart = np.zeros(self.symbols, np.int64)
        for c, to in steps[0].items():
            restart[c] = to
        table = np.tile(~restart, (len(steps), 1))
        for state, out in enumerate(steps[1:], 1):
            table[state, list(out.keys())] = list(out.values())
        return table

    def phrases(self, symbols: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
        """Phrases by language and text."""
        counts = np.bincount(owner, minlength=texts)
        first = np.cumsum(counts) - counts
        pieces = -(-counts // SEGMENT)
        of = np.repeat(np.arange(texts), pieces)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin, length = first[of] + nth * SEGMENT, np.minimum(SEGMENT, counts[of] - nth * SEGMENT)
        order = np.argsort(-length, kind="stable")
        of, begin, length = of[order], begin[order], length[order]
        active = np.searchsorted(-length, -np.arange(SEGMENT), side="left")  # segments longer than each step
        state = np.repeat(np.array(self.start, np.int32)[:, None], len(of), axis=1)
        found = np.zeros(state.shape, np.int32)
        for step in range(int(length[0]) if len(length) else 0):
            n = active[step]
            to = self.table[state[:, :n] * self.symbols + symbols[begin[:n] + step]]
            fresh = to >> 31
            found[:, :n] -= fresh
            state[:, :n] = to ^ fresh
        return np.array([np.bincount(of, weights=row, minlength=texts) for row in found])

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        symbols, owner = self.fold(texts)
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        size = np.bincount(owner, minlength=len(texts))
        letters = np.bincount(owner[symbols != 0], minlength=len(texts))
        rate = self.phrases(symbols, owner, len(texts)) * np.array(self.pointer)[:, None] / np.maximum(size, 1)
        best = rate.argmin(axis=0)
        with np.errstate(divide="ignore", invalid="ignore"):
            share = (1 / rate.min(axis=0)) / (1 / rate).sum(axis=0)
        return (
            [self.languages[b] if n else "und" for b, n in zip(best, letters)],
            np.where(letters > 0, share, 0.0),
        )


@lru_cache(maxsize=1)
def _parser(model: Model) -> Parser:
    return Parser(model)


def predicted(text: Column, model: Model) -> Column:
    """Struct of ``lang`` and ``score``, the winner's share of the inverse costs."""

    @F.arrow_udf("struct<lang:string,score:double>")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        parser = _parser(model)
        for batch in batches:
            parts = [parser.predict([t or "" for t in part]) for part in sliced(batch)]
            yield pa.StructArray.from_arrays(
                [
                    pa.array([name for names, _ in parts for name in names], pa.string()),
                    pa.array(np.concatenate([scores for _, scores in parts]), pa.float64()),
                ],
                ["lang", "score"],
            )

    return predict(whole(text))


def held_out(key: Column) -> Column:
    """Whether a document is kept from learning; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % 5 == 0
