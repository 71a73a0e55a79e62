"""Main text of web pages through suffix arrays of their hosts (operator 7)."""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm.common import cut, table
from riskframe.llm.markup import ARTICLE, MAIN, OPEN, blocks
from riskframe.llm.repetition import covered, suffix_array
from riskframe.plans.sizing import bounded

# Words of a run that counts as repeated: a power of two, so a rank of the suffix array names it.
RUN = 8
# A run is boilerplate on this share of a host's pages, and on this many at least: outside
# declared containers, and inside an article.
OPEN_SHARE, OPEN_PAGES = 0.3, 3
ARTICLE_SHARE, ARTICLE_PAGES = 0.9, 10
# Bytes of HTML that one task indexes, and pages of a part of a large host at least.
TASK_BYTES, PART_PAGES = 4_000_000, 8
# Rows of named runs that go to all tasks at once (8 MB); more are dealt to the parts.
SHARED_ROWS = 200_000


def intervals(ids: np.ndarray, hosts: np.ndarray) -> np.ndarray:
    """For every suffix the interval of common prefixes of `RUN` words or more it lies in, named by
    its first suffix; one that shares so much with no other is an interval of its own."""
    order, levels = suffix_array(ids, hosts, RUN)
    out = np.arange(len(ids))
    if len(order) < 2:
        return out
    n, one, two = len(ids), order[:-1], order[1:]
    lcp = np.zeros(len(one), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        same = levels[k][np.minimum(one + lcp, n)] == levels[k][np.minimum(two + lcp, n)]
        lcp += np.where(same, 1 << k, 0)
    starts = np.concatenate([[True], lcp < RUN])
    out[order] = order[np.flatnonzero(starts)[np.cumsum(starts) - 1]]
    return out


def run_table(hosts: np.ndarray, pages: list[list[tuple[int, list[str]]]]) -> tuple[pd.DataFrame, list]:
    """(at, words, page, host, outside, run, hash) of every run of every page, and the blocks' spans
    (page, zone, first, last) in the token stream.

    The token streams of all pages are laid one after another, blocks apart by separators that
    occur once, and indexed by one suffix array; suffixes of different hosts never tie. Neighbours in
    its order whose common prefix has `RUN` words or more lie in one interval: a repeated substring of
    that length, and every longer one is a sequence of them, so their union is that of the maximal
    repeats. Suffixes outside all intervals start nothing that repeats here. Whole blocks of fewer
    words outside declared containers are runs as well. `hash` names a run alike in all parts of a host.
    """
    words: list[str] = []
    spans: list[tuple[int, int, int, int]] = []
    for p, page in enumerate(pages):
        for zone, own in page:
            spans.append((p, zone, len(words), len(words) + len(own)))
            words += [*own, ""]
    columns = ["at", "words", "page", "host", "outside", "run", "hash"]
    if not words:
        return pd.DataFrame({c: np.empty(0, dtype=np.int64) for c in columns}), spans
    page, zone, first, last = np.array(spans, dtype=np.int64).T
    ids, distinct = pd.factorize(np.array(words, dtype=object))
    of_word = pd.util.hash_array(np.asarray(distinct, dtype=object), categorize=False)[ids]
    ids = ids.astype(np.int64)
    ids[last] = ids.max() + 1 + np.arange(len(last))
    block = np.repeat(np.arange(len(first)), last - first + 1)
    host_of = np.asarray(hosts)[page[block]]
    interval = intervals(ids, host_of)
    at = np.flatnonzero(np.arange(len(ids)) + RUN <= last[block])
    mixed = np.zeros(len(at), dtype=np.uint64)
    for k in range(RUN):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + of_word[at + k]
    short = np.flatnonzero((last - first < RUN) & (zone < MAIN))
    whole = np.array([" ".join(words[first[i] : last[i]]) for i in short], dtype=object)
    named = pd.util.hash_array(whole, hash_key="short blocks 016") if len(short) else np.empty(0, dtype=np.uint64)
    code = pd.factorize(pd.MultiIndex.from_arrays([np.asarray(hosts)[page[short]], whole]))[0] if len(short) else short
    frame = pd.DataFrame(
        {
            "at": np.concatenate([at, first[short]]),
            "words": np.concatenate([np.full(len(at), RUN), (last - first)[short]]),
            "page": np.concatenate([page[block[at]], page[short]]),
            "host": np.concatenate([host_of[at], np.asarray(hosts)[page[short]]]),
            "outside": np.concatenate([zone[block[at]] < MAIN, np.ones(len(short), dtype=bool)]),
            "run": np.concatenate([interval[at], len(ids) + code]),
            "hash": np.concatenate([mixed, named]).view(np.int64),
        }
    )
    return frame, spans


def counted(runs: pd.DataFrame) -> pd.DataFrame:
    """(run, n, n_out): distinct pages with each run, and those with it outside containers."""
    n = runs[["run", "page"]].drop_duplicates().groupby("run").size()
    out = runs.loc[runs["outside"], ["run", "page"]].drop_duplicates().groupby("run").size()
    return pd.DataFrame({"n": n, "n_out": out.reindex(n.index, fill_value=0)}).rename_axis("run").reset_index()


def boilerplate(
    hosts: np.ndarray, pages: list[list[tuple[int, list[str]]]], known: pd.DataFrame | None = None
) -> list[list[tuple[np.ndarray, np.ndarray]]]:
    """For every block of every page (zone, words): which words repeat as boilerplate of the host,
    and which of them do so outside articles too.

    The distinct pages with a run say how common it is, and overlapping runs are united. For a part
    of a host `known` (hash, n, n_out, pages) has the counts of the whole host.
    """
    runs, spans = run_table(hosts, pages)
    if known is None:
        runs = runs.merge(counted(runs), on="run", how="left")
        runs["pages"] = np.bincount(np.asarray(hosts, dtype=np.int64))[runs["host"]] if len(runs) else 0
    else:
        runs = runs.merge(known[["hash", "n", "n_out", "pages"]], on="hash", how="inner")
    often = lambda n, share, least: (runs[n] >= least) & (runs[n] >= share * runs["pages"])
    article = often("n", ARTICLE_SHARE, ARTICLE_PAGES)
    length = max((s[3] for s in spans), default=0) + 1
    marked = {}
    for kind, common in (
        ("open", often("n", OPEN_SHARE, OPEN_PAGES)),
        ("article", article),
        ("both", article & often("n_out", OPEN_SHARE, OPEN_PAGES)),
    ):
        own = np.zeros(length, dtype=np.int64)
        chosen = runs[common]
        own[chosen["at"]] = chosen["words"]
        marked[kind] = covered(own)
    out: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in pages]
    for p, zone, a, b in spans:
        kinds = ("article", "both") if zone >= MAIN else ("open", "open")
        out[p].append(tuple(marked[kind][a:b] for kind in kinds))
    return out


def main_text(found: list[tuple[int, list[str]]], common: list[tuple[np.ndarray, np.ndarray]]) -> str:
    """Unique runs of the blocks that can be main text, one line for each block.

    With an article, or else a main element, only its blocks can; without, all but furniture. An
    article that would lose most of its words is a copy, or nearly one, of its neighbours: only what
    stands outside articles too is cut then. A page of which nothing would be left keeps its blocks.
    """
    zones = {zone for zone, _ in found}
    wanted = ARTICLE if ARTICLE in zones else MAIN if MAIN in zones else OPEN
    chosen = [(own, *c) for (zone, own), c in zip(found, common, strict=True) if zone == wanted]
    lost = 2 * sum(int(c.sum()) for _, c, _ in chosen) > sum(len(own) for own, _, _ in chosen)
    shown = [(own, both if lost else c) for own, c, both in chosen]
    lines = [" ".join(w for w, repeated in zip(own, c, strict=True) if not repeated) if c.any() else " ".join(own) for own, c in shown]
    lines = [line for line in lines if line]
    return "\n".join(lines or [" ".join(own) for own, _ in shown])


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row of `pages`; a null page has no text.

    A page is parsed once, and its blocks travel compressed. Pages meet by host: hosts are hashed to
    buckets of about 4 MB of HTML. Only a host that alone has more is divided, by page, into parts of
    eight pages at least. What is common on it is counted over all its parts: a run on a share of a
    host's pages is on that share of some part's, so each part names its frequent runs, every part
    counts the runs named by any, and the sums decide. The parts are laid out once for all of this.

    Passages that an article shares with other pages are its text and stay: inside a declared
    article only runs on nine of ten pages of the host are cut.
    """
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[a-zA-Z][\w+.-]*://([^/?#]*)", 1)), F.lit(""))
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), host.alias("host"))
    size = F.coalesce(F.octet_length("html"), F.lit(0)).cast("long")
    parts = F.least(F.ceil(F.sum(size) / TASK_BYTES), F.ceil(F.count("*") / PART_PAGES)).cast("int")
    hosts = cut(rows.groupBy("host").agg(parts.alias("parts"), F.count("*").alias("pages"), F.sum(size).alias("size")))
    divided = F.col("parts") > 1
    total, divided_bytes, n_large = hosts.agg(F.sum("size"), F.sum(F.when(divided, F.col("size"))), F.count_if(divided)).first()
    buckets = 1 << max(0, math.ceil((total or 0) / TASK_BYTES) - 1).bit_length()
    large = bounded(hosts.where(divided).drop("size"), n_large)

    @F.pandas_udf("binary")
    def packed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        squeezed = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            yield pd.Series([squeezed.compress(pickle.dumps(blocks(page), 5)) for page in batch], dtype=object)

    def parsed(frame: pd.DataFrame) -> list[list[tuple[int, list[str]]]]:
        opened = zstandard.ZstdDecompressor()
        found = (pickle.loads(opened.decompress(bytes(x))) for x in frame["blocks"])
        return [[(zone, text.split()) for zone, text in own] for own in found]

    def counts(frame: pd.DataFrame) -> pd.DataFrame:
        runs = run_table(np.zeros(len(frame), dtype=np.int64), parsed(frame))[0]
        # by hash, so that a run has one row
        found = counted(runs.assign(run=runs["hash"])).rename(columns={"run": "hash"})
        return found.assign(site=frame["site"].iloc[0])

    def frequent(frame: pd.DataFrame) -> pd.DataFrame:
        found = counts(frame)
        return found.loc[found["n"] >= OPEN_SHARE * len(frame), ["site", "hash"]]

    def recounted(frame: pd.DataFrame, named: pd.DataFrame) -> pd.DataFrame:
        if not len(frame):
            return pd.DataFrame({c: np.empty(0, dtype=np.int64) for c in ("site", "hash", "n", "n_out")})
        found = counts(frame)
        return found.loc[found["hash"].isin(named["hash"]), ["site", "hash", "n", "n_out"]]

    def texts(frame: pd.DataFrame, hosts: np.ndarray, known: pd.DataFrame | None) -> pd.DataFrame:
        found = parsed(frame)
        out = [main_text(f, c) for f, c in zip(found, boilerplate(hosts, found, known), strict=True)]
        return pd.DataFrame({"page_id": frame["page_id"], "url": frame["url"].astype(object), "text": pd.Series(out, index=frame.index, dtype=object), "n_chars": [len(t) for t in out]})

    def indexed(frame: pd.DataFrame) -> pd.DataFrame:
        return texts(frame, pd.factorize(frame["host"])[0], None)

    def indexed_part(frame: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        return texts(frame, np.zeros(len(frame), dtype=np.int64), known)

    kinds = dict(rows.dtypes)
    result = f"page_id {kinds['page_id']}, url string, text string, n_chars long"
    whole = rows.join(large.select("host"), "host", "left_anti")
    whole = whole.select("page_id", "url", packed("html").alias("blocks"), "host", F.pmod(F.xxhash64("host"), F.lit(buckets)).alias("bucket"))
    out = whole.groupBy("bucket").applyInPandas(indexed, result)
    if not divided_bytes:
        return out
    # hosts by number: their names stay out of the tables of runs
    site = F.xxhash64("host").alias("site")
    part = F.pmod(F.xxhash64("page_id", "url"), F.col("parts")).alias("part")
    dealt = rows.join(large, "host").select("page_id", "url", packed("html").alias("blocks"), site, part)
    dealt = cut(dealt.repartition(max(1, math.ceil(divided_bytes / TASK_BYTES)), "site", "part"))
    of_site = large.select(site, F.col("parts"), "pages")

    def to_parts(found: DataFrame) -> DataFrame:
        """Rows of a site for each of its parts."""
        parted = found.join(of_site.select("site", "parts"), "site")
        return parted.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)))

    def by_part(work):
        """A partition of `dealt` holds whole parts: each is worked on where it lies."""

        def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held = [batch for batch in batches if len(batch)]
            if held:
                for _, one in pd.concat(held, ignore_index=True).groupby(["site", "part"], sort=False):
                    yield work(one.reset_index(drop=True))

        return of

    def beside(found: DataFrame, work, schema: str) -> DataFrame:
        """`work(part, rows of its site)` for every part: a table of checked size goes to the parts, a
        larger one is dealt to them."""
        found = cut(found)
        if found.count() > SHARED_ROWS:
            dealt_out = to_parts(found).select(*found.columns, "part").groupBy("site", "part")
            return dealt.groupBy("site", "part").cogroup(dealt_out).applyInPandas(work, schema)
        rows_of = dict(list(found.toPandas().groupby("site")))
        shared = pages.sparkSession.sparkContext.broadcast((rows_of, pd.DataFrame({c: np.empty(0, dtype=np.int64) for c in found.columns})))

        def alone(one: pd.DataFrame) -> pd.DataFrame:
            by_site, none = shared.value
            return work(one, by_site.get(one["site"].iloc[0], none))

        return dealt.mapInPandas(by_part(alone), schema)

    named = dealt.mapInPandas(by_part(frequent), "site long, hash long").distinct()
    sums = (
        beside(named, recounted, "site long, hash long, n long, n_out long")
        .groupBy("site", "hash")
        .agg(F.sum("n").alias("n"), F.sum("n_out").alias("n_out"))
        .join(of_site.drop("parts"), "site")
    )
    known = sums.where((F.col("n") >= OPEN_PAGES) & (F.col("n") >= OPEN_SHARE * F.col("pages")))
    parts = beside(known, indexed_part, result)
    return out.unionByName(parts)


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
