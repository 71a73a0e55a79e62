"""Quality classifier from supervised subword embeddings (operator 4)."""

from __future__ import annotations

import operator
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm.common import held_out, table

# Parameters of the model.
BUCKETS = 1 << 17
DIMENSIONS = 10
NGRAMS = (3, 4)
EPOCHS = 6
RATE = 4.0
# Labelled rows the model is fitted on at most: those of the smallest seeded hashes.
FIT_ROWS = 4000
SEED = 7
# Score from which a text is predicted to be good.
KEPT_FROM = 0.3
# Words a task keeps the score of.
KNOWN_WORDS = 300_000

# Words that stand for what is seen of a text's order: a word that equals the one before it, and
# three words that stood together earlier. No text holds them, as they contain a space.
SAME, AGAIN = b"same word", b"same three"


def split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def repeats(words: list[bytes]) -> tuple[int, int]:
    """How often a word equals the one before it, and how many triples stood earlier."""
    triples = max(0, len(words) - 2)
    return sum(map(operator.eq, words, words[1:])), triples - len(set(zip(words, words[1:], words[2:], strict=False)))


def buckets(word: bytes) -> list[int]:
    """Buckets of a word: itself and its character n-grams between word marks."""
    marked = f"<{word.decode('utf-8', 'replace')}>"
    grams = [marked[i : i + n].encode("utf-8", "surrogatepass") for n in NGRAMS for i in range(len(marked) - n + 1)]
    return [zlib.crc32(word, 1) % BUCKETS, *(zlib.crc32(g) % BUCKETS for g in grams)]


def bag(text: str | None) -> tuple[list[int], list[int]]:
    """(bucket, count) of a whole text."""
    words = split(text)
    counts = Counter(words)
    counts[SAME], counts[AGAIN] = repeats(words)
    total: Counter[int] = Counter()
    for word, n in counts.items():
        for b in buckets(word) if n else ():
            total[b] += n
    return list(total.keys()), list(total.values())


def fit(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> tuple[np.ndarray, float]:
    """Stochastic gradient descent on the softmax of the averaged vectors.

    Returns what scoring needs: for every bucket the part its vector adds to the log odds of
    label 1, and the bias. Without rows every text scores 0.5.
    """
    rng = np.random.default_rng(SEED)
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    output, bias = np.zeros((2, DIMENSIONS)), np.zeros(2)
    steps, done = max(1, EPOCHS * len(bags)), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(bags)):
            rate = RATE * (1 - done / steps)
            done += 1
            at, n = bags[i]
            share = (n / max(1, n.sum())).astype(np.float32)
            hidden = share @ vectors[at] if len(at) else np.zeros(DIMENSIONS)
            logits = output @ hidden + bias
            p = np.exp(logits - logits.max())
            error = p / p.sum()
            error[labels[i]] -= 1
            back = error @ output
            output -= rate * np.outer(error, hidden)
            bias -= 0.1 * rate * error
            if len(at):
                # a feature's step is scaled by the root of its share, so that long texts teach too
                vectors[at] -= (rate * np.sqrt(share)[:, None] * back).astype(np.float32)
    return vectors @ (output[1] - output[0]).astype(np.float32), float(bias[1] - bias[0])


class WordScores(dict):
    """Word to (sum of its buckets' parts) + 1j * (number of buckets), filled when first asked."""

    def __init__(self, parts: list[float]) -> None:
        self.parts = parts

    def __missing__(self, word: bytes) -> complex:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        own = buckets(word)
        self[word] = value = complex(sum(map(self.parts.__getitem__, own)), len(own))
        return value


def labelled(docs: DataFrame, labels: DataFrame, label: str, rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, text, label) of at most `rows` labelled documents outside the held-out fifth.

    Documents whose labels disagree or are null teach nothing; of repeated ids the smallest text
    is taken. The sample is that of the smallest hashes of (seed, doc_id): it reads only labels,
    and its bound makes the broadcast safe.
    """
    agreed = (
        labels.where(F.col(label).isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min(label).cast("int").alias("label"), F.max(label).alias("most"))
        .where("label = most")
    )
    picked = agreed.orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(rows).select("doc_id", "label")
    return docs.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality") -> tuple[np.ndarray, float]:
    """The model of `fit` from a bounded sample; its texts become bags on the executors."""

    def bags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            packed = [[np.array(x, dtype="<i4").tobytes() for x in bag(t)] for t in batch["text"]]
            at, n = zip(*packed, strict=True) if packed else ((), ())
            yield pd.DataFrame({"doc_id": batch["doc_id"], "label": batch["label"], "at": at, "n": n})

    sample = labelled(docs.select("doc_id", "text"), labels, label)
    rows = sample.mapInPandas(bags, "doc_id long, label int, at binary, n binary").toPandas()
    rows = rows.sort_values("doc_id", ignore_index=True)
    pairs = [
        (np.frombuffer(a, dtype="<i4"), np.frombuffer(n, dtype="<i4")) for a, n in zip(rows["at"], rows["n"], strict=True)
    ]
    return fit(pairs, rows["label"].to_numpy())


def score(text: Column, model: tuple[np.ndarray, float]) -> Column:
    """Probability of label 1 for a whole text; null and empty texts get that of the bias alone."""
    parts, bias = model

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = WordScores(parts.tolist())
        for batch in batches:
            logits = []
            for one in batch:
                words = split(one)
                same, again = repeats(words)
                total = sum(map(known.__getitem__, words), same * known[SAME] + again * known[AGAIN])
                logits.append(bias + (total.real / total.imag if total.imag else 0.0))
            yield pd.Series(1 / (1 + np.exp(-np.clip(np.array(logits, dtype=np.float64), -60, 60))))

    return of(text)


def classify(docs: DataFrame, model: tuple[np.ndarray, float], threshold: float = KEPT_FROM) -> DataFrame:
    """`docs` with score (label 1 likelier the higher) and predicted."""
    return docs.withColumn("score", score(F.col("text"), model)).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int")
    )


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return classify(docs.withColumn("held_out", held_out(F.col("doc_id"))), model).drop("text")
