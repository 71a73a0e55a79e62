"""Near-duplicate documents: prints by Golay keys, prefix filtering of the rest, exact Jaccard check.

The pipeline's form of operator 5. Its 64-bit prints within two bits find texts that are almost
equal; texts link from a Jaccard similarity of 0.8 of their five-word shingles on, and prefix
filtering finds the pairs whose prints are further apart: every such pair ends in one component.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm import simhash
from riskframe.llm.common import attach, components, cut, runs
from riskframe.llm.simhash import majority, shingle_hashes

# Smallest hashes of a text by which it first meets others (min-wise sampling).
STARS = 8
# Rows of one side of a meeting, about, and nodes whose shared tokens are counted at once.
BLOCK, TILE = 40_000, 512
# Tokens times nodes that are told at once, about, and texts whose shingles are held at once: both
# bound a task's memory.
CELLS, HELD = 2_000_000, 500
# Texts, about, that show which shingles are common, how many of them must hold one, and the most
# shingles told apart. They set the order of shingles only, not which pairs are found.
SAMPLE_TEXTS, COMMON, COMMON_SHINGLES = 4_000, 3, 20_000


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Distinct hashes of a text's shingles, ascending; texts without words share one."""
    own = np.unique(shingle_hashes(text, shingle))
    return own if len(own) else np.zeros(1, dtype=np.uint64)


def least_overlap(one: np.ndarray, two: np.ndarray, similarity: float) -> np.ndarray:
    """Common shingles of sets of these sizes that are similar, at least."""
    return np.ceil(similarity / (1 + similarity) * (one + two) - 1e-9).astype(np.int64)


def prefix_length(size: np.ndarray, similarity: float) -> np.ndarray:
    """First shingles of a set, in an order common to all, of which similar sets share one."""
    return size - np.ceil(similarity * size - 1e-9).astype(np.int64) + 1


def ranks(own: np.ndarray, common: np.ndarray, times: np.ndarray) -> np.ndarray:
    """`times` of the shingles that are in `common` (ascending), 0 of the others."""
    if not len(common):
        return np.zeros(len(own), dtype=np.int64)
    at = np.minimum(np.searchsorted(common, own), len(common) - 1)
    return np.where(common[at] == own, times[at], 0)


def prefix(own: np.ndarray, rank: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of a set: rare ones by hash, then common ones by `rank`."""
    return own[np.lexsort([own, rank])][: prefix_length(np.array(len(own)), similarity)]


def shared_pairs(rows: pd.DataFrame, similarity: float) -> Iterator[pd.DataFrame]:
    """(a, b, n, least) for the nodes of one meeting: how many of its tokens two prefixes share.

    Rows are (token, node, root, size, tokens, side) of a meeting; nodes of one side meet those of the
    other, or each other if there is one side. Left out are pairs of one root, of sizes too far apart,
    and those that could not share enough if all `tokens` which one of them has elsewhere were shared.

    Of two similar sets, common shingles up to the smaller of the two last prefix shingles lie in
    both prefixes, and further ones in the rest of one of the sets: `least` is how many tokens the
    prefixes must share therefore, over all meetings.
    """
    nodes, first, at = np.unique(rows["node"].to_numpy(), return_index=True, return_inverse=True)
    _, token = np.unique(rows["token"].to_numpy(), return_inverse=True)
    root, size, side, tokens = (rows[c].to_numpy()[first] for c in ("root", "size", "side", "tokens"))
    if (root == root[0]).all():
        return
    order = np.argsort(at, kind="stable")
    starts = np.searchsorted(at[order], np.arange(len(nodes) + 1))
    elsewhere = tokens - np.diff(starts)

    def held(part: np.ndarray) -> np.ndarray:
        out = np.zeros((len(part), token.max() + 1), dtype=np.float32)
        for i, k in enumerate(part):
            out[i, token[order[starts[k] : starts[k + 1]]]] = 1
        return out

    both = side.min() != side.max()
    tile = max(1, min(TILE, CELLS // (int(token.max()) + 1)))
    left = np.flatnonzero(side == side.min()) if both else np.arange(len(nodes))
    right = np.flatnonzero(side == side.max()) if both else left
    for x in range(0, len(left), tile):
        some = left[x : x + tile]
        mine = held(some)
        for y in range(0 if both else x, len(right), tile):
            other = right[y : y + tile]
            found = mine @ (mine if not both and x == y else held(other)).T
            i, j = np.nonzero(found)
            one, two = some[i], other[j]
            fits = np.minimum(size[one], size[two]) >= similarity * np.maximum(size[one], size[two]) - 1e-9
            kept = (root[one] != root[two]) & fits & ((one < two) if not both else (one != two))
            one, two, n = one[kept], two[kept], found[i, j][kept]
            if len(one):
                rest = np.maximum(*(size[k] - prefix_length(size[k], similarity) for k in (one, two)))
                ends = {"a": np.maximum(nodes[one], nodes[two]), "b": np.minimum(nodes[one], nodes[two])}
                least = least_overlap(size[one], size[two], similarity) - rest
                enough = n + np.minimum(elsewhere[one], elsewhere[two]) >= least
                yield pd.DataFrame({**ends, "n": n.astype(np.int64), "least": least})[enough]


def jaccard(one: str | None, two: str | None, shingle: int) -> float:
    a, b = (set(shingle_hashes(t, shingle).tolist()) for t in (one, two))
    return len(a & b) / len(a | b) if a or b else 1.0


def common_shingles(texts: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, texts with them) of shingles that many of some `SAMPLE_TEXTS` texts hold."""

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for text in batch["text"]:
                yield pd.DataFrame({"token": shingle_set(text, shingle).view(np.int64)})

    step = ceil(max(1, texts.count()) / SAMPLE_TEXTS)
    some = texts.where(F.pmod("node", F.lit(step)) == 0).select("text").mapInPandas(listed, "token long")
    seen = cut(some.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON))
    least, total = COMMON, 0
    for n, shingles in sorted(map(tuple, seen.groupBy("n").count().collect()), reverse=True):
        total += shingles
        if total > COMMON_SHINGLES:
            least = n + 1
            break
    found = np.array(seen.where(F.col("n") >= least).collect(), dtype=np.int64).reshape(-1, 2)
    hashes = found[:, 0].copy().view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], found[order, 1]


def print_pairs(prints: DataFrame) -> DataFrame:
    """(a, b) for `prints` (node, fp): each text with the first of its class in operator 5, whose
    prints are linked by Golay keys from two differing bits down."""
    found = simhash.classes(prints.select(F.col("node").alias("doc_id"), "fp"))
    met = attach(prints, cut(found), "fp", "n")
    return met.select(F.col("node").alias("a"), F.col("component_id").alias("b")).where("a <> b")


def near_texts(
    docs: DataFrame, shingle: int = 5, similarity: float = 0.8, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """(doc_id, component_id, digest, first): texts whose shingle sets have a Jaccard similarity of
    `similarity` or more are linked, and equal texts always. A component has the smallest doc_id;
    `digest` tells the row's text and `first` the text that the component keeps with that id.

    Distinct texts only are compared; a null text equals the empty one. First every text is
    compared with the first one of its class of prints (operator 5, here of `shingle` words), and
    with one text for each of its smallest hashes, which joins large groups by few pairs.
    Then texts of different components that share enough tokens of their prefixes are compared:
    no pair at `similarity` is missed. Tokens whose texts have the same smallest root are counted
    together, so a pair comes out about once and not for each token it shares; where many texts meet,
    they are dealt into blocks, and pairs of blocks are the unit of work. Only texts of candidates
    are shuffled, to be compared whole.
    Rows without doc_id form no class of their own.
    """
    digest = F.md5(F.coalesce(text, F.lit("")))
    texts = docs.where(F.col(doc_id).isNotNull()).select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.coalesce(text, F.lit("")).alias("text"),
        digest.alias("key"),
        F.xxhash64(digest).alias("node"),
    )
    common, times = common_shingles(texts, shingle)

    @F.pandas_udf("size long, rare double, fp long, low array<long>, prefix array<long>")
    def listed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), HELD):
                hashes = [shingle_hashes(t, shingle) for t in batch.iloc[start : start + HELD]]
                own = [np.unique(x) if len(x) else np.zeros(1, dtype=np.uint64) for x in hashes]
                rank = [ranks(x, common, times) for x in own]
                yield pd.DataFrame(
                    {
                        "size": [len(x) for x in own],
                        "rare": [(x == 0).mean() for x in rank],
                        "fp": majority(hashes).view(np.int64),
                        "low": [x[:STARS].view(np.int64) for x in own],
                        "prefix": [prefix(x, r, similarity).view(np.int64) for x, r in zip(own, rank, strict=True)],
                    }
                )

    nodes = cut(
        texts.select("doc_id", "key", "node", listed("text").alias("own"))
        .groupBy("key", "node")
        .agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"), F.first("own").alias("own"))
    )

    @F.pandas_udf("double")
    def measured(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for one, two in batches:
            yield pd.Series([jaccard(x, y, shingle) for x, y in zip(one, two, strict=True)], dtype="float64")

    def checked(found: DataFrame) -> DataFrame:
        wanted = found.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        # equal texts have several rows: the one of smallest doc_id stands for them
        first = nodes.select("key", "node", "doc_id").join(wanted, "node")
        keys = ["key", "node", "doc_id"]
        # grouped as they are joined: texts are not shuffled again
        used = cut(texts.join(first, keys).groupBy(*keys).agg(F.min("text").alias("text")).select("node", "text"))
        return cut(
            found.join(used.select(F.col("node").alias("a"), F.col("text").alias("one")), "a")
            .join(used.select(F.col("node").alias("b"), F.col("text").alias("two")), "b")
            .where(measured("one", "two") >= similarity)
            .select("a", "b")
        )

    root = F.coalesce("root", "node").alias("root")
    low = cut(nodes.select(F.explode("own.low").alias("token"), "node", "own.rare"))
    # among edited copies of a text, the one with the smallest share of rare shingles is nearest to all
    midst = F.min(F.struct("rare", "node"))["node"].alias("b")
    centers = cut(low.groupBy("token").agg(midst, F.count("*").alias("n")).where("n > 1"))
    stars = attach(low.drop("rare"), centers, "token", "n").where("node <> b")
    alike = print_pairs(nodes.select("node", "own.fp"))
    links = checked(cut(stars.select(F.col("node").alias("a"), "b").unionByName(alike).distinct()))
    joined = components(links)

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            times = batch["prefix"].map(len).to_numpy()
            tokens = np.concatenate([*batch["prefix"], np.empty(0, dtype=np.int64)])
            yield pd.DataFrame({"token": tokens, **{c: np.repeat(batch[c].to_numpy(), times) for c in ("node", "root")}})

    def paired(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in runs(batches, "meeting"):
            at = rows["meeting"].to_numpy()
            for part in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(at)) + 1):
                yield from shared_pairs(rows.iloc[part], similarity)

    rooted = nodes.join(joined, "node", "left").select("node", root, "own.size", "own.prefix")
    tokens = rooted.drop("size").mapInPandas(keyed, "token long, node long, root long")
    # tokens of a group of texts have its root for the smallest one: they meet in one place
    ends = F.count("*").alias("n"), F.min("root").alias("route"), F.max("root").alias("last")
    held = cut(tokens.groupBy("token").agg(*ends).where("route < last").drop("last"))
    routes = held.groupBy("route").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"))
    held = cut(held.join(routes, "route"))
    side = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = cut(attach(tokens.drop("root"), held, "token", "n").select("token", "node", "route", "blocks"))
    about = rows.groupBy("node").agg(F.count("*").alias("tokens")).join(rooted.drop("prefix"), "node")
    met = rows.join(about, "node").withColumn("side", side).withColumn("other", other)
    met = met.select(
        F.xxhash64("route", F.least("side", "other"), F.greatest("side", "other")).alias("meeting"),
        "token", "node", "root", "size", "tokens", "side",
    )
    pairs = met.repartition("meeting").sortWithinPartitions("meeting").mapInPandas(paired, "a long, b long, n long, least long")
    shared = pairs.groupBy("a", "b").agg(F.sum("n").alias("n"), F.first("least").alias("least"))
    more = checked(cut(shared.where("n >= least").select("a", "b")))

    named = cut(nodes.drop("own").join(components(links.unionByName(more)), "node", "left").select("key", root, "doc_id", "n"))
    firsts = named.groupBy("root").agg(F.min(F.struct("doc_id", "key")).alias("first"), F.count("*").alias("texts"))
    classes = attach(named, cut(firsts), "root", "texts")
    classes = classes.select("key", F.col("first.doc_id").alias("component_id"), F.col("first.key").alias("first"), "n")
    return attach(texts.select("doc_id", "key"), cut(classes), "key", "n").select(
        "doc_id", "component_id", F.col("key").alias("digest"), "first"
    )


def one_of_each(
    docs: DataFrame, classes: DataFrame, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """`docs` with one row for each component: that of its smallest doc_id, with the text that
    `classes` names first; of rows that repeat both one stays. Rows without doc_id stay."""
    named = ["__kept", "__digest"]
    kept = classes.where("doc_id = component_id and digest = first")
    kept = kept.select(F.col("doc_id").alias("__kept"), F.col("digest").alias("__digest")).distinct()
    digest = F.md5(F.coalesce(text, F.lit("")))
    chosen = docs.join(kept, (F.col(doc_id) == F.col("__kept")) & (digest == F.col("__digest")))
    return chosen.dropDuplicates(named).drop(*named).unionByName(docs.where(F.col(doc_id).isNull()))
