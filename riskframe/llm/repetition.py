"""Quality rules by suffix-array repetition (operator 9)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm.common import table

# Fixed values of the rules.
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"

# Words indexed together by one suffix array.
INDEX_WORDS = 400_000

MEASURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "word_bytes long, covered_bytes long, longest_repeat long"
)


def suffix_array(
    ids: np.ndarray, doc: np.ndarray, depth: int | None = None
) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes that share their first words with another one of their document, in order, and
    the ranks of all substrings of 1, 2, 4, ... words.

    `ids` numbers the words of all documents one after another, `doc` (ascending) the documents;
    suffixes of different documents never compare equal. Ranks double in length until no two
    suffixes tie; each round sorts only those that still tie, so text without repeats costs one
    full sort. With `depth` the order, and the ranks, end at substrings of that many words.
    """
    n = len(ids)
    inverse = np.unique(doc * (int(ids.max(initial=0)) + 1) + ids, return_inverse=True)[1]
    starts = np.concatenate([[0], np.cumsum(np.bincount(inverse))])
    rank = np.append(starts[inverse], -1)
    levels = [rank]
    sizes = np.diff(starts)[inverse]
    tied = np.flatnonzero(sizes > 1)
    length = 1
    while len(tied) and (depth is None or length < depth):
        after = np.minimum(tied + length, n)
        after = np.where(doc[np.minimum(after, n - 1)] == doc[tied], rank[after], -1)
        key = rank[tied] * (n + 1) + after + 1
        order = np.argsort(key, kind="stable")
        tied, key = tied[order], key[order]
        new = np.append(True, key[1:] != key[:-1])
        group = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        old = rank[tied]
        block = np.append(True, old[1:] != old[:-1])
        block_at = np.flatnonzero(block)[np.cumsum(block) - 1]
        rank = rank.copy()
        rank[tied] = old + first[group] - block_at
        levels.append(rank)
        length *= 2
        many = np.diff(np.append(first, len(tied)))[group] > 1
        if length == 2:
            sharing = tied[many]
        tied = tied[many]
    if len(levels) == 1:
        return np.empty(0, dtype=np.int64), levels
    return sharing[np.argsort(rank[sharing], kind="stable")], levels


def repeated_spans(ids: np.ndarray, doc: np.ndarray, least: int) -> np.ndarray:
    """For every position the length of the longest substring that starts there and occurs again
    in its document, 0 below `least` words.

    That is the deepest interval of longest common prefixes the suffix lies in: the larger of its
    common prefixes with its two neighbours in the suffix array.
    """
    n = len(ids)
    spans = np.zeros(n, dtype=np.int64)
    if n == 0:
        return spans
    order, levels = suffix_array(ids, doc)
    if len(order) < 2:
        return spans
    one, two = order[:-1], order[1:]
    lcp = np.zeros(len(one), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        same = levels[k][np.minimum(one + lcp, n)] == levels[k][np.minimum(two + lcp, n)]
        lcp += np.where(same, 1 << k, 0)
    best = np.zeros(len(order), dtype=np.int64)
    best[:-1] = lcp
    best[1:] = np.maximum(best[1:], lcp)
    spans[order] = np.where(best >= least, best, 0)
    return spans


def covered(spans: np.ndarray) -> np.ndarray:
    """Whether each position lies in a span [i, i + spans[i])."""
    ends = np.maximum.accumulate(np.arange(len(spans)) + spans) if len(spans) else spans
    return ends > np.arange(len(spans))


def measure(texts: list[str | None], long_repeat: int) -> pd.DataFrame:
    """The measures of `MEASURES` for every text."""
    out = np.zeros((len(texts), 8), dtype=np.int64)
    first, words, counts = 0, [], []

    def flush(last: int) -> None:
        nonlocal first, words, counts
        if words:
            ids = pd.factorize(np.array(words, dtype=object))[0].astype(np.int64)
            doc = np.repeat(np.arange(len(counts)), counts)
            spans = repeated_spans(ids, doc, WINDOW)
            long_spans = np.where(spans >= long_repeat, spans, 0)
            out[first:last, 4] = np.bincount(doc[covered(spans)], minlength=len(counts))
            lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
            inside = covered(long_spans)
            out[first:last, 5] = np.bincount(doc, weights=lengths, minlength=len(counts))
            out[first:last, 6] = np.bincount(doc[inside], weights=lengths[inside], minlength=len(counts))
            longest = np.zeros(len(counts), dtype=np.int64)
            np.maximum.at(longest, doc[spans > 0], spans[spans > 0])
            out[first:last, 7] = longest
        first, words, counts = last, [], []

    for i, text in enumerate(texts):
        if text:
            own = text.encode("utf-8", "surrogatepass").split()
            lines = [line for line in text.split("\n") if line.strip(SPACES)]
            out[i, 0] = len(own)
            out[i, 1] = len(text) - sum(map(text.count, SPACES))
            out[i, 2] = sum(map(text.count, SYMBOLS))
            out[i, 3] = len(lines) - len(set(lines))
            words += own
            counts.append(len(own))
        else:
            counts.append(0)
        if len(words) >= INDEX_WORDS:
            flush(i + 1)
    flush(len(texts))
    return pd.DataFrame(out, columns=[c.split()[0] for c in MEASURES.split(", ")])


def judge(
    docs: DataFrame,
    text: str = "text",
    long_repeat: int = 10,
    max_covered: float = 0.2,
    max_longest: int = 100,
    prefix: str = "",
) -> DataFrame:
    """`docs` with the measures of each whole text, `base_failed` and `kept`.

    Base rule: fewer than 10 words, or over 20% of them in 5-word windows found twice or more.
    Method: repeats of `long_repeat` words or more cover over `max_covered` of the bytes in words,
    or one repeat is longer than `max_longest` words. Null and empty texts have no words and fail. Texts
    are indexed some at a time; a text is always whole. Columns of `docs` that have the name of a
    new one are replaced; `prefix` avoids that.
    """

    @F.pandas_udf(MEASURES)
    def measures(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield measure(batch.tolist(), long_repeat)

    names = [c.split()[0] for c in MEASURES.split(", ")]
    held = docs.withColumn("__measures", measures(F.col(text)))
    m = {name: F.col("__measures")[name] for name in names}
    base = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])
    long_ = (m["covered_bytes"] > max_covered * m["word_bytes"]) | (m["longest_repeat"] > max_longest)
    return held.withColumns(
        {prefix + name: column for name, column in m.items()}
        | {prefix + "base_failed": base, prefix + "kept": ~base & ~long_}
    ).drop("__measures")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs).drop("text")


# The contract's counts by plain SQL; `kept` and the long repeats are the method's own.
