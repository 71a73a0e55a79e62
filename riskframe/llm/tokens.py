"""Token counts by a count-only Viterbi over Aho-Corasick matches (operator 1)."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm.common import table, words_in
from riskframe.llm.pieces import MODEL, Chunks, Vocabulary, load

# Fixed value: what an unknown character scores below the worst piece.
UNKNOWN_PENALTY = 10.0
# Chunks a task keeps the count of.
KNOWN_CHUNKS = 400_000


class Counter(dict):
    """Chunk to the number of pieces of its best unigram segmentation, filled when first asked.

    The automaton lists every piece that ends at a position. The dynamic programme keeps, for each
    position, the best score and the number of pieces of one best path: no lattice, no path. Ties
    go as in the tokenizer, which tries starts from left to right and replaces a path only by a
    better one: the earliest start, that is the longest piece, wins. A character that is no piece
    by itself may be unknown, at the lowest score less 10, and counts its UTF-8 bytes.
    """

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.automaton = ahocorasick.Automaton()
        for piece, i in vocabulary.normal.items():
            self.automaton.add_word(piece, (len(piece), vocabulary.scores[i]))
        self.automaton.make_automaton()
        lowest = min((vocabulary.scores[i] for i in vocabulary.normal.values()), default=0.0)
        self.unknown = lowest - UNKNOWN_PENALTY

    def __missing__(self, chunk: str) -> int:
        if len(self) >= KNOWN_CHUNKS:
            self.clear()
        n = len(chunk)
        ending: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for last, match in self.automaton.iter(chunk):
            ending[last + 1].append(match)
        best, count = [0.0] * (n + 1), [0] * (n + 1)
        for end in range(1, n + 1):
            top, pieces, single = None, 0, False
            for length, score in sorted(ending[end], reverse=True):
                candidate = best[end - length] + score
                if top is None or candidate > top:
                    top, pieces = candidate, count[end - length] + 1
                single |= length == 1
            if not single:
                candidate = best[end - 1] + self.unknown
                if top is None or candidate > top:
                    top, pieces = candidate, count[end - 1] + len(chunk[end - 1].encode("utf-8", "surrogatepass"))
            best[end], count[end] = top, pieces
        self[chunk] = found = count[n]
        return found


def count_tokens(text: Column, vocabulary: Vocabulary) -> Column:
    """Pieces of a whole text under `vocabulary` read as a unigram model; 0 for null and empty."""

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        chunks, counts = Chunks(vocabulary), Counter(vocabulary)
        for batch in batches:
            yield pd.Series([sum(map(counts.__getitem__, chunks(t))) for t in batch], dtype="int64")

    return of(text)


def op1_token_counts(spark: SparkSession, sf_dir: str, model: str = MODEL) -> DataFrame:
    """(doc_id, n_words, n_tokens) of every document."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", words_in(F.col("text")).alias("n_words"), count_tokens(F.col("text"), load(model)).alias("n_tokens"))
