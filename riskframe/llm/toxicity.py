"""Toxicity by a weighted finite-state pattern grammar (operator 6)."""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm.common import held_out, table
from riskframe.llm.quality import labelled, split

# The words the grammar starts from. Insults get their weights from labels where
# labelled texts hold them.
INSULTS = "idiot moron stupid pathetic scum trash worthless loser clown disgusting fool dumb ugly imbecile vermin".split()
THREATS = "kill hurt destroy burn shoot beat stab hang strangle crush".split()
TARGETS = "you your yours he she him her they them their people everyone du ihr euch tu vous toi usted ustedes".split()
NEGATIONS = "not never no isn't aren't wasn't don't nicht kein nie pas jamais nunca".split()
REPORTS = "said says called calls told wrote writes quoted claimed sagte nannte dit dijo".split()
CLAUSE_ENDS = ".!?;:"
EDGES = ".,!?;:|*$%&#\"'()[]{}<>"

# Symbols of the first transducer; ENDS is added to the last word of a clause.
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, ENDS = 0, 1, 2, 3, 4, 5, 8
# How a matched clause can read, and what its weight counts before labels are seen.
READINGS = ("plain", "targeted", "threat", "negated", "reported")
PRIOR = np.array([1.0, 1.3, 1.0, 0.2, 0.5])
BASE_WEIGHT, THREAT_WEIGHT, MOST = 3.0, 3.0, 12.0

# Learned stems: shortest, fewest labelled toxic texts, most clean ones for each toxic one, number.
STEM, LEAST, CLEAN_SHARE, PATTERNS = 4, 5, 0.05, 500
KNOWN_WORDS = 400_000


def bare(word: bytes) -> str:
    return word.decode("utf-8", "replace").strip(EDGES).lower()


class Lexicon(dict):
    """The first transducer: a raw word to its symbol. `weights` has those of the insults, whole
    words or, with a trailing star, stems; the longest stem that fits decides."""

    def __init__(self, weights: dict[str, float]) -> None:
        self.weights = weights
        fixed = ((THREATS, THREAT), (TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTS, REPORT))
        self.fixed = {w: symbol for words, symbol in fixed for w in words}
        self.longest = max((len(k) - 1 for k in weights if k.endswith("*")), default=0)

    def weight(self, word: str) -> float:
        if word in self.weights:
            return self.weights[word]
        for n in range(min(self.longest, len(word)), STEM - 1, -1):
            if (found := self.weights.get(word[:n] + "*")) is not None:
                return found
        return 0.0

    def __missing__(self, raw: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        word = bare(raw)
        symbol = INSULT if self.weight(word) > 0 else self.fixed.get(word, OTHER)
        self[raw] = symbol = symbol + ENDS * (raw[-1:].decode("latin-1") in CLAUSE_ENDS)
        return symbol


def grammar() -> dict[tuple[int, int], tuple[int, int | None]]:
    """The composed machine over a clause: (state, symbol) to (state, reading or None).

    A state is the set of what the clause has shown: 1 a target, 2 a negation, 4 a report. Reported
    speech and negation outrank a target; a threat counts only against a target.
    """
    moves = {}
    for state in range(8):
        target, negated, reported = state & 1, state & 2, state & 4
        moves[state, OTHER] = (state, None)
        moves[state, TARGET] = (state | 1, None)
        moves[state, NEGATION] = (state | 2, None)
        moves[state, REPORT] = (state | 4, None)
        toned = 4 if reported else 3 if negated else None
        moves[state, INSULT] = (state, toned if toned is not None else 1 if target else 0)
        moves[state, THREAT] = (state, (toned if toned is not None else 2) if target else None)
    return moves


MOVES = grammar()


def matched(words: list[bytes], lexicon: Lexicon) -> np.ndarray:
    """Weight of the clauses matched in each reading, over the whole text."""
    symbols = bytes(map(lexicon.__getitem__, words))
    found = np.zeros(len(READINGS))
    at = 0
    hits = bytes([INSULT, THREAT, INSULT + ENDS, THREAT + ENDS])
    places = [i for i, s in enumerate(symbols) if s in hits] if any(h in symbols for h in hits) else ()
    for hit in places:
        if hit < at:
            continue
        begin = hit
        while begin > 0 and symbols[begin - 1] < ENDS:
            begin -= 1
        at = hit + 1
        while at < len(symbols) and symbols[at - 1] < ENDS:
            at += 1
        clause = symbols[begin:at]
        # a target may follow its insult: the clause starts as targeted if one stands anywhere in it
        state = int(TARGET in clause or TARGET + ENDS in clause)
        for word, symbol in zip(words[begin:at], clause, strict=True):
            symbol &= ENDS - 1
            state, reading = MOVES[state, symbol]
            if reading is not None:
                found[reading] += lexicon.weight(bare(word)) if symbol == INSULT else THREAT_WEIGHT
    return found


def mine(texts: Iterable[tuple[set[str], int]]) -> dict[str, float]:
    """Weights of insults: the fixed ones and words and stems that labelled texts betray.

    Counts in how many toxic and clean texts each word and stem occurs, keeps those that hardly
    any clean text holds, and takes, one after the other, what covers most toxic texts not covered
    yet. A weight is the smoothed log odds.
    """
    texts = list(texts)
    toxic = [i for i, (_, y) in enumerate(texts) if y == 1]
    clean = len(texts) - len(toxic)

    def patterns(word: str) -> Iterator[str]:
        if len(word) >= 3:
            yield word
        for n in range(STEM, min(len(word), 9)):
            yield word[:n] + "*"

    fixed = set(INSULTS)
    often: Counter[str] = Counter()
    for i in toxic:
        often.update({p for word in texts[i][0] for p in patterns(word)})
    often = {p for p, n in often.items() if n >= LEAST or p in fixed}
    where: dict[str, set[int]] = defaultdict(set)
    for i in toxic:
        for p in {p for word in texts[i][0] for p in patterns(word)} & often:
            where[p].add(i)
    seen: Counter[str] = Counter()
    for words, y in texts:
        if y != 1:
            seen.update({p for w in words for p in patterns(w) if p in where})
    weights = dict.fromkeys(INSULTS, BASE_WEIGHT)

    def odds(p: str) -> float:
        return math.log((len(where[p]) + 0.5) / (len(toxic) + 1)) - math.log((seen[p] + 0.5) / (clean + 1))

    for p in fixed & where.keys():
        weights[p] = max(0.0, odds(p))
    good = {p: s for p, s in where.items() if seen[p] <= CLEAN_SHARE * len(s) and p not in fixed}
    covered = set().union(*(where[p] for p in fixed & where.keys())) if fixed & where.keys() else set()
    ranked = sorted(good, key=lambda p: (-len(good[p]), len(p), p))
    for need in (LEAST, 2):
        for p in ranked:
            if len(weights) >= PATTERNS:
                break
            if p not in weights and len(good[p] - covered) >= need and odds(p) > 2:
                weights[p] = odds(p)
                covered |= good[p]
    return weights


def fit(features: np.ndarray, labels: np.ndarray, steps: int = 400) -> tuple[np.ndarray, float]:
    """What each reading counts and the bias: logistic regression drawn towards `PRIOR`."""
    factors, bias = PRIOR.copy(), -2.0
    x = np.minimum(features, MOST)
    for step in range(steps if len(x) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ factors + bias, -60, 60)))
        rate = 0.5 / (1 + step / 100)
        factors -= rate * (x.T @ (p - labels) / len(x) + 0.01 * (factors - PRIOR))
        bias -= rate * float(np.mean(p - labels))
        factors = np.maximum(factors, 0.0)
    return factors, bias


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> tuple[dict[str, float], np.ndarray, float]:
    """Lexicon weights, factors of the readings and bias, from a bounded labelled sample."""
    sample = labelled(docs.select("doc_id", "text"), labels, label).toPandas().sort_values("doc_id", ignore_index=True)
    y = sample["label"].to_numpy()
    # one string for each word, however many texts hold it
    shared: dict[str, str] = {}
    seen = [({shared.setdefault(w, w) for w in map(bare, set(split(t)))}, int(one)) for t, one in zip(sample["text"], y, strict=True)]
    weights = mine(seen)
    del seen, shared
    lexicon = Lexicon(weights)
    features = np.array([matched(split(t), lexicon) for t in sample["text"]]).reshape(len(y), len(READINGS))
    factors, bias = fit(features, y)
    return weights, factors, bias


def score(text: Column, model: tuple[dict[str, float], np.ndarray, float]) -> Column:
    """Probability that a whole text is toxic; null and empty texts get that of the bias alone."""
    weights, factors, bias = model

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lexicon = Lexicon(weights)
        for batch in batches:
            found = np.array([matched(split(t), lexicon) for t in batch]).reshape(len(batch), len(READINGS))
            logits = np.minimum(found, MOST) @ factors + bias
            yield pd.Series(1 / (1 + np.exp(-np.clip(logits, -60, 60))))

    return of(text)


def classify(docs: DataFrame, model: tuple, threshold: float = 0.5) -> DataFrame:
    """`docs` with score (toxic likelier the higher) and predicted."""
    return docs.withColumn("score", score(F.col("text"), model)).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int")
    )


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return classify(docs.withColumn("held_out", held_out(F.col("doc_id"))), model).drop("text")
