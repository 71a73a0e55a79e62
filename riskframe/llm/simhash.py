"""SimHash near-duplicates through Golay-code fuzzy keys (operator 5)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm.common import attach, components, cut, table
from riskframe.llm.golay import fuzzy_keys

# Fixed values of the fingerprint: words in a shingle, and the seed of the hash.
SHINGLE = 3
SEED = 42

# (first bit, bits) of the segments of a 64-bit fingerprint; each fits a Golay word.
SEGMENTS = ((0, 22), (22, 21), (43, 21))

# Fingerprints of one key that a task compares in memory; a larger bucket is dealt out anew.
BUCKET = 20_000
# Hashes whose bits are counted at once.
COUNTED = 100_000


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 of the lower-cased text's shingles, repeats included; none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    grams = zip(*(words[i:] for i in range(size)), strict=False) if len(words) >= size else [words]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(b" ".join(g), SEED) for g in grams), dtype=np.uint64)


def majority(hashes: list[np.ndarray]) -> np.ndarray:
    """The fingerprint of each array: bits that are set in over half of its hashes."""
    out = np.zeros(len(hashes), dtype=np.uint64)
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for i, own in enumerate(hashes):
        ones = np.zeros(64, dtype=np.int64)
        for at in range(0, len(own), COUNTED):
            part = np.ascontiguousarray(own[at : at + COUNTED], dtype="<u8").view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[i] = weights[2 * ones > len(own)].sum(dtype=np.uint64)
    return out


def fingerprint(text: Column, shingle: int = SHINGLE) -> Column:
    """64-bit SimHash of a whole text as a long; zero for null and for texts without words."""

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(majority([shingle_hashes(t, shingle) for t in batch]).view(np.int64))

    return of(text)


def segment_keys(fingerprints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(position, key) of every fingerprint; any two within two bits share a key.

    Two errors leave at least one of three segments exact, and the next one has at most two: the
    exact value and a fuzzy index of the next segment make the key.
    """
    for i, (start, bits) in enumerate(SEGMENTS):
        exact = (fingerprints >> np.uint64(start) & np.uint64((1 << bits) - 1)).astype(np.int64)
        start, bits = SEGMENTS[(i + 1) % len(SEGMENTS)]
        fuzzy = (fingerprints >> np.uint64(start) & np.uint64((1 << bits) - 1)).astype(np.int64)
        rows, index = fuzzy_keys(fuzzy, bits)
        yield rows, (i << 40) | (exact[rows] << 12) | index


def _keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        values = batch["fp"].to_numpy().view(np.uint64)
        for rows, keys in segment_keys(values):
            yield pd.DataFrame({"key": keys, "fp": batch["fp"].to_numpy()[rows], "node": batch["node"].to_numpy()[rows]})


def _between(fp: np.ndarray, key: np.ndarray) -> np.ndarray:
    """(n, m) fingerprints at no or one bit from each, off the segment that the key holds exactly."""
    out = np.repeat(fp[:, None], 44, axis=1)
    for i, (start, bits) in enumerate(SEGMENTS):
        own = np.flatnonzero(key >> 40 == i)
        free = [b for b in range(64) if not start <= b < start + bits]
        flips = np.zeros(44, dtype=np.uint64)
        flips[1 : len(free) + 1] = np.uint64(1) << np.array(free, dtype=np.uint64)
        out[own] ^= flips[None, :]
    return out


def _stars(part: pd.DataFrame) -> pd.DataFrame:
    """Links of the rows of whole buckets: every set of fingerprints one bit from a common one is
    a star about its smallest node."""
    _, at, counts = np.unique(part["key"].to_numpy(), return_inverse=True, return_counts=True)
    part = part[counts[at] > 1]
    fp, node, key = part["fp"].to_numpy().view(np.uint64), part["node"].to_numpy(), part["key"].to_numpy()
    if not len(part):
        return pd.DataFrame({"kind": [], "a": [], "b": []}).astype("int64")
    near = _between(fp, key)
    rows = np.repeat(np.arange(len(fp)), near.shape[1])
    order = np.lexsort([node[rows], near.ravel(), key[rows]])
    rows, near = rows[order], near.ravel()[order]
    head = np.append(True, (near[1:] != near[:-1]) | (key[rows[1:]] != key[rows[:-1]]))
    one, two = rows, rows[np.flatnonzero(head)[np.cumsum(head) - 1]]
    linked = (node[one] != node[two]) & (np.bitwise_count(fp[one] ^ fp[two]) <= 2)
    links = pd.DataFrame({"a": node[one[linked]], "b": node[two[linked]]}).drop_duplicates()
    return links.assign(kind=0)[["kind", "a", "b"]]


def _bucket_links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """From rows sorted by key: links (0, a, b), and for the rows of a bucket too large for memory
    (1, fingerprint between, node), streamed."""

    def dealt(rows: pd.DataFrame) -> pd.DataFrame:
        near = _between(rows["fp"].to_numpy().view(np.uint64), rows["key"].to_numpy())
        return pd.DataFrame({"kind": 1, "a": near.ravel().view(np.int64), "b": np.repeat(rows["node"].to_numpy(), near.shape[1])})

    held, large = None, None
    for batch in batches:
        if large is not None:
            more = batch["key"] == large
            if more.any():
                yield dealt(batch[more])
            batch = batch[~more]
            if not len(batch):
                continue
            large = None
        rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
        last = rows["key"].iloc[-1]
        tail = rows["key"] == last
        yield _stars(rows[~tail])
        held = rows[tail]
        if len(held) > BUCKET:
            yield dealt(held)
            held, large = None, last
    if held is not None:
        yield _stars(held)


def classes(prints: DataFrame) -> DataFrame:
    """(fp, component_id, n) for every fingerprint of `prints` (doc_id, fp).

    Distinct fingerprints, not documents, are compared. Their keys are sorted by Spark; a bucket
    holds fingerprints with one exact segment and a common fuzzy index of the next.
    """
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("node"), F.count("*").alias("n")))
    keyed = nodes.where("node is not null").select("fp", "node").mapInPandas(_keyed, "key long, fp long, node long")
    found = cut(
        keyed.repartition("key").sortWithinPartitions("key").mapInPandas(_bucket_links, "kind int, a long, b long")
    )
    dealt = found.where("kind = 1").select(F.col("a").alias("near"), F.col("b").alias("node"))
    least = dealt.groupBy("near").agg(F.min("node").alias("first"), F.count("*").alias("c")).where("c > 1")
    more = dealt.join(least, "near").select(F.col("node").alias("a"), F.col("first").alias("b"))
    roots = components(found.where("kind = 0").select("a", "b").unionByName(more))
    return nodes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"), "n")


def near_duplicates(
    docs: DataFrame, shingle: int = SHINGLE, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """(doc_id, fp, component_id) of every row of `docs`: fingerprints within two bits are linked,
    and a component is named by the smallest doc_id reachable.

    Null texts, empty texts and texts without words have fingerprint zero and link like any other.
    Repeated rows stay. Rows without doc_id link nothing; their component is that of others with
    the same fingerprint, or null.
    """
    prints = cut(docs.select(F.col(doc_id).cast("long").alias("doc_id"), fingerprint(F.col(text), shingle).alias("fp")))
    return attach(prints, cut(classes(prints)), "fp", "n").select("doc_id", "fp", "component_id")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    shown = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return found.select("doc_id", shown.alias("fingerprint"), "component_id")
