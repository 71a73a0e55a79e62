"""SentencePiece encoding and decoding by suffix-array matching (operator 10)."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm.common import table
from riskframe.llm.pieces import BYTE, MARK, MODEL, Chunks, Vocabulary, load

# Characters indexed at once, chunks a task keeps the encoding of, and the longest chunk that is
# relaxed in step with others.
INDEX_CHARS = 400_000
KNOWN_CHUNKS = 400_000
LONG_CHUNK = 96
# Ids decoded at once.
DECODED_IDS = 65_536

# No pair, and the bits of a position below the order of a pair.
NONE = np.iinfo(np.int64).max
PLACE = 32


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of all runs, one run after the other."""
    return np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def _packed(codes: np.ndarray, count: int, bits: int) -> np.ndarray:
    """`count` neighbouring codes of the last axis as one integer, first highest; zeros follow the end."""
    size = codes.shape[-1]
    padded = np.concatenate([codes, np.zeros((*codes.shape[:-1], count), dtype=np.int64)], axis=-1)
    out = np.zeros(codes.shape, dtype=np.int64)
    for k in range(count):
        out = out << bits | padded[..., k : k + size]
    return out


class Matcher:
    """Edges of a text: every occurrence of every piece, from one suffix array of the text."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.longest = vocabulary.longest
        # a text as the model sees it has no spaces, which stand for marks here
        names = [p for p in vocabulary.normal if " " not in p]
        self.ids = np.array([vocabulary.normal[p] for p in names], dtype=np.int64)
        self.lengths = np.array([len(p) for p in names], dtype=np.int64)
        chars = sorted(set("".join(names)))
        # characters of no piece are 0
        self.code = np.zeros(0x110000, dtype=np.int32)
        self.code[list(map(ord, chars))] = np.arange(1, len(chars) + 1)
        self.code[ord(" ")] = self.code[ord(MARK)]
        self.text = np.zeros((len(names), self.longest), dtype=np.int32)
        for i, p in enumerate(names):
            self.text[i, : len(p)] = self.code[list(map(ord, p))]

    def edges(self, codes: np.ndarray) -> np.ndarray:
        """ids[position, length]: the piece + 1 that lies there, 0 if none.

        Suffixes are sorted by words of as many characters as fit an integer, then by pairs of
        ranks, until the longest piece is covered. Binary search finds, for all pieces at once, the
        first suffix not below the piece and the first above all that start with it; the suffixes
        between are its occurrences. Edges are laid out by position and length, which sorts them.
        """
        n = len(codes)
        dense = self.code[codes]
        seen = np.bincount(dense, minlength=int(self.code.max()) + 1) > 0
        seen[0] = True
        # few characters are in one text, so that a word holds many
        narrow = np.cumsum(seen) - 1
        bits = max(1, int(narrow[-1]).bit_length())
        count = min(62 // bits, self.longest)
        there = np.flatnonzero(seen[self.text].all(axis=1))
        length, pieces = self.lengths[there], narrow[self.text[there]]
        suffix, depth = _packed(narrow[dense], count, bits), count
        levels = []
        while depth < self.longest:
            words, rank = np.unique(suffix, return_inverse=True)
            levels.append(words)
            suffix = rank * (n + 2)
            suffix[:-depth] += rank[depth:] + 1
            depth *= 2
            del rank
        order = np.argsort(suffix)
        levels.append(suffix[order])

        def bounds(level: int, part: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Where the words of a level that start with the first `size` codes of a part lie."""
            if not level:
                low = _packed(part[:, :count], count, bits)[:, 0]
                high = low + (np.int64(1) << bits * (count - size))
            else:
                half = count << level - 1
                first, last = bounds(level - 1, part[:, :half], np.minimum(size, half))
                low, high = first * (n + 2), last * (n + 2)
                more = np.flatnonzero(size > half)
                if more.size:
                    one, none = bounds(level - 1, part[more, half:], size[more] - half)
                    begun = last[more] > first[more]
                    high[more] = low[more] + np.where(begun, none + 1, 0)
                    low[more] += np.where(begun, one + 1, 0)
            return np.searchsorted(levels[level], low), np.searchsorted(levels[level], high)

        first, last = bounds(len(levels) - 1, pieces, length)
        table_ = np.zeros((n + 1, self.longest + 1), dtype=np.int32)
        # one length at a time: less is held at once
        for k in range(1, self.longest + 1):
            own = np.flatnonzero((length == k) & (last > first))
            found = last[own] - first[own]
            table_[order[_spread(first[own], found)], k] = np.repeat(self.ids[there[own]] + 1, found)
        return table_


@dataclass(frozen=True)
class Ids:
    """Ids of some texts, one after the other; the i-th text has those from bounds[i] to bounds[i + 1]."""

    flat: np.ndarray
    bounds: np.ndarray

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def __getitem__(self, i: int) -> np.ndarray:
        return self.flat[self.bounds[i] : self.bounds[i + 1]]

    def arrow(self) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(self.bounds, pa.int32()), pa.array(self.flat, pa.int32()))


class Encoder(dict):
    """Chunk to its number, by which the ids of its pieces lie in `flat`; unseen chunks are encoded
    together.

    The model merges the adjacent pair whose piece has the best score, leftmost first, until no
    pair is a piece. Relaxation over the edges does the same: symbols are edges, a pair may merge
    if the edge over both exists, and every chunk takes its best pair in each round.
    """

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.matcher = Matcher(vocabulary)
        self.byte_ids = np.array(vocabulary.byte_ids, dtype=np.int32)
        scores = np.array(vocabulary.scores)
        self.order = np.append(0, np.unique(-scores, return_inverse=True)[1]).astype(np.int64)
        self.fresh: list[str] = []
        self.flat, self.sizes, self.uses = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __missing__(self, chunk: str) -> int:
        number = self[chunk] = len(self)
        self.fresh.append(chunk)
        return number

    def encode(self, texts: Iterable[list[str]]) -> Ids:
        """Ids of the texts that these chunks make up."""
        if len(self) > KNOWN_CHUNKS:
            self._forget()
        numbers = [np.fromiter(map(self.__getitem__, own), np.int32, len(own)) for own in texts]
        self._learn()
        lengths = [len(x) for x in numbers]
        number = np.concatenate([np.zeros(0, np.int32), *numbers])
        self.uses += np.bincount(number, minlength=len(self))
        starts, sizes = (np.cumsum(self.sizes) - self.sizes)[number], self.sizes[number]
        bounds = np.append(0, np.cumsum(sizes))[np.append(0, np.cumsum(lengths, dtype=np.int64))]
        return Ids(self.flat[_spread(starts, sizes)], bounds)

    def _forget(self) -> None:
        """Half of the chunks that may be known stay: those met most often, as most are met once."""
        kept = np.sort(np.argpartition(-self.uses, KNOWN_CHUNKS // 2)[: KNOWN_CHUNKS // 2])
        stays = np.zeros(len(self), dtype=bool)
        stays[kept] = True
        chunks = [c for c, stay in zip(self, stays.tolist(), strict=True) if stay]
        self.clear()
        self.update(zip(chunks, range(len(chunks)), strict=True))
        self.flat = self.flat[np.repeat(stays, self.sizes)]
        self.sizes, self.uses = self.sizes[kept], self.uses[kept] // 2

    def _learn(self) -> None:
        found, part, size = [], [], 0
        for chunk in self.fresh:
            part.append(chunk)
            size += len(chunk) + 1
            if size >= INDEX_CHARS:
                found.append(self._relax(part))
                part, size = [], 0
        if part:
            found.append(self._relax(part))
        self.fresh = []
        if found:
            self.flat = np.concatenate([self.flat, *(ids for ids, _ in found)])
            self.sizes = np.concatenate([self.sizes, *(sizes for _, sizes in found)])
            self.uses = np.append(self.uses, np.zeros(len(self) - len(self.uses), dtype=np.int64))

    def _relax(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks, one after the other, and how many each has.

        A pair is held where its first symbol starts, as its order and place; a merge changes two.
        """
        # a zero between chunks is in no piece
        codes = np.frombuffer(("\0".join(chunks) + "\0").encode("utf-32-le", "surrogatepass"), dtype="<u4")
        # a text's own NUL must not end a chunk
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        starts = np.cumsum(sizes + 1) - sizes - 1
        edges = self.matcher.edges(codes)
        n, width = len(codes), edges.shape[1]
        end, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        symbol = np.ones(n, dtype=bool)
        symbol[starts + sizes] = False

        def pairs(at: np.ndarray) -> np.ndarray:
            span = end[end[at]] - at
            piece = edges[at, np.where(span < width, span, 0)]
            return np.where(piece > 0, self.order[piece] << PLACE | at, NONE)

        pair = pairs(np.arange(n))
        long = np.flatnonzero(sizes > LONG_CHUNK)
        for c in long:
            first, size = int(starts[c]), int(sizes[c])
            kept, ends = self._relax_long(first, size, edges)
            pair[first : first + size], symbol[first : first + size] = NONE, False
            symbol[kept], end[kept] = True, ends
        start, size, head = starts, sizes + 1, starts
        while len(start):
            best = np.minimum.reduceat(pair, head)
            going = best < NONE
            if not going.all():
                pair = pair[np.repeat(going, size)]
                start, size, best = start[going], size[going], best[going]
                head = np.cumsum(size) - size
            at = best & (1 << PLACE) - 1
            gone = end[at]
            after = end[gone]
            end[at], before[after], symbol[gone] = after, at, False
            # where a place of the text lies among the pairs that are left
            moved = head - start
            pair[gone + moved] = NONE
            pair[at + moved] = pairs(at)
            left = before[at]
            own = left >= start
            pair[(left + moved)[own]] = pairs(left[own])
        at = np.flatnonzero(symbol)
        found = edges[at, end[at] - at]
        # characters that are no piece become bytes
        unknown = found == 0
        chars = codes[at[unknown]]
        chars = np.where(chars == ord(" "), ord(MARK), chars).astype("<u4")
        octets = chars.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
        many = np.ones(len(at), dtype=np.int64)
        many[unknown] += sum((chars >= least).astype(np.int64) for least in (0x80, 0x800, 0x10000))
        ids = np.repeat(found - 1, many)
        ids[np.repeat(unknown, many)] = self.byte_ids[np.frombuffer(octets, dtype=np.uint8)]
        total = np.append(0, np.cumsum(many))
        return ids, np.diff(total[np.searchsorted(at, np.append(starts, n))])

    def _relax_long(self, start: int, size: int, edges: np.ndarray) -> tuple[list[int], list[int]]:
        """One long chunk, by a heap of pairs, in time that grows little faster than its length."""
        stop, width = start + size, edges.shape[1]
        end, before = list(range(start + 1, stop + 1)), list(range(start - 1, stop - 1))
        alive = [True] * size

        def pair(a: int) -> tuple[int, int, int] | None:
            b = end[a - start]
            if b >= stop or end[b - start] - a >= width:
                return None
            piece = int(edges[a, end[b - start] - a])
            return (int(self.order[piece]), a, end[b - start]) if piece else None

        heap = [x for x in map(pair, range(start, stop)) if x]
        heapq.heapify(heap)
        while heap:
            _, a, e = heapq.heappop(heap)
            if not alive[a - start] or (now := pair(a)) is None or now[2] != e:
                continue
            b = end[a - start]
            alive[b - start], end[a - start] = False, e
            if e < stop:
                before[e - start] = a
            for x in (a, before[a - start]):
                if x >= start and (found := pair(x)):
                    heapq.heappush(heap, found)
        kept = [a for a in range(start, stop) if alive[a - start]]
        return kept, [end[a - start] for a in kept]


class Decoder:
    def __init__(self, vocabulary: Vocabulary) -> None:
        self.table = [
            bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(MARK, " ").encode()
            for p, k in zip(vocabulary.pieces, vocabulary.kinds, strict=True)
        ]
        self.sizes = np.array([len(b) for b in self.table], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.octets = np.frombuffer(b"".join(self.table), dtype=np.uint8)

    def __call__(self, ids: list[int]) -> str:
        text = b"".join(map(self.table.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text

    def texts(self, ids: Ids) -> pa.Array:
        """The texts of many lists of ids, as by a call of each."""
        parts = [ids.flat[i : i + DECODED_IDS] for i in range(0, len(ids.flat), DECODED_IDS)]
        octets = [self.octets[_spread(self.starts[p], self.sizes[p])] for p in parts]
        octets = np.concatenate([np.zeros(0, np.uint8), *octets])
        bounds = np.append(0, np.cumsum(self.sizes[ids.flat]))[ids.bounds]
        some = bounds[:-1][np.diff(bounds) > 0]
        try:
            octets.tobytes().decode()
            whole = not ((octets[some] & 0xC0) == 0x80).any()
        except UnicodeDecodeError:
            whole = False
        if not whole:
            return pa.array([self(ids[i].tolist()) for i in range(len(ids))], pa.string())
        # one space is put before a text when it is encoded
        extra = some[octets[some] == ord(" ")]
        bounds -= np.searchsorted(extra, bounds)
        octets = np.delete(octets, extra)
        return pa.StringArray.from_buffers(len(ids), pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(octets))


def encode(text: Column, vocabulary: Vocabulary) -> Column:
    """Ids of a whole text; none for null and empty texts."""

    @F.arrow_udf("array<int>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for ids in _encoded((batch.to_pylist() for batch in batches), vocabulary):
            yield ids.arrow()

    return of(text)


def _encoded(batches: Iterator[Iterable[str | None]], vocabulary: Vocabulary) -> Iterator[Ids]:
    """Ids of the texts in order, of some texts at a time: their chunks are indexed together, and
    no more than they need is held."""
    chunks, encoder = Chunks(vocabulary, " "), Encoder(vocabulary)
    for batch in batches:
        cut, size = [], 0
        for text in batch:
            cut.append(text)
            size += len(text or "")
            if size >= 6 * INDEX_CHARS:
                yield encoder.encode(map(chunks, cut))
                cut, size = [], 0
        if cut:
            yield encoder.encode(map(chunks, cut))


def decode(ids: Column, vocabulary: Vocabulary) -> Column:
    """Text of a list of ids; null for null. Bytes that are no UTF-8 become replacement marks."""

    @F.pandas_udf("string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        decoder = Decoder(vocabulary)
        for batch in batches:
            yield pd.Series([None if one is None else decoder(one.tolist()) for one in batch])

    return of(ids)


def round_trip(docs: DataFrame, vocabulary: Vocabulary, text: str = "text") -> DataFrame:
    """`docs` with ids, n_pieces, decoded_crc32 and round_trip (whether decoding gives the text
    back; null for a null text, which is encoded like an empty one).

    A text that holds the mark U+2581 itself comes back with spaces, as from the tokenizer.
    """

    @F.arrow_udf("ids array<int>, decoded string")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        decoder = Decoder(vocabulary)
        for ids in _encoded((batch.to_pylist() for batch in batches), vocabulary):
            yield pa.StructArray.from_arrays([ids.arrow(), decoder.texts(ids)], names=["ids", "decoded"])

    held = docs.withColumn("__both", both(F.col(text)))
    decoded = F.col("__both.decoded")
    return held.withColumns(
        {
            "ids": F.col("__both.ids"),
            "n_pieces": F.size("__both.ids").cast("long"),
            "decoded_crc32": F.crc32(decoded),
            "round_trip": decoded == F.col(text),
        }
    ).drop("__both")


def op10_sentencepiece(spark: SparkSession, sf_dir: str, model: str = MODEL) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return round_trip(docs, load(model)).drop("text")
