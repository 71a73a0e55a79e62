import math
import random
import re

import numpy as np
import pandas as pd
import pytest
import xxhash

from riskframe.llm import golay, near_text, simhash
from tests.conftest import SMALL
from tests.llm.data import documents, frame

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute_print(text, size=3):
    words = WORD.findall((text or "").encode().lower())
    grams = [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(nodes, linked):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {n: root(n) for n in nodes}


def check(rows, got):
    print_of = {r[0]: brute_print(r[1]) for r in rows}
    expected = roots(sorted(print_of), lambda a, b: (print_of[a] ^ print_of[b]).bit_count() <= 2)
    assert len(got) == len(rows)
    for r in got:
        assert r["fp"] & (1 << 64) - 1 == print_of[r["doc_id"]]
        assert r["component_id"] == expected[r["doc_id"]]


def test_golay_code_is_perfect():
    assert len({int(e) for e in golay.ERRORS}) == 1 << 11
    words = np.array([random.Random(4).randrange(1 << 23) for _ in range(500)])
    rows, keys = golay.fuzzy_keys(words, 23)
    own = [set(keys[rows == i].tolist()) for i in range(500)]
    assert max(map(len, own)) == 6
    for a, b in ((0, 1), (3, 22), (11, 12)):
        rows, keys = golay.fuzzy_keys(words ^ (1 << a) ^ (1 << b), 23)
        assert all(own[i] & set(keys[rows == i].tolist()) for i in range(500))


def test_fingerprints_and_components_equal_brute_force(spark):
    rows = [r for r in documents() if len(r[1] or "") < 5000]
    check(rows, simhash.near_duplicates(frame(spark, rows)).collect())


@pytest.mark.parametrize("bucket", [20_000, 2])
def test_links_of_near_fingerprints(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = random.Random(9)
    prints = [rng.randrange(1 << 64) for _ in range(60)]
    for _ in range(120):
        x = rng.choice(prints)
        for b in rng.sample(range(64), rng.randrange(1, 4)):
            x ^= 1 << b
        prints.append(x)
    prints = list(dict.fromkeys(prints))
    nodes = np.array(rng.sample(range(1000), len(prints)))
    import pandas as pd

    keyed = pd.concat(simhash._keyed([pd.DataFrame({"fp": np.array(prints, dtype=np.uint64).view(np.int64), "node": nodes})]))
    keyed = keyed.sort_values("key", ignore_index=True)
    found = pd.concat(simhash._bucket_links([keyed.iloc[i : i + 17] for i in range(0, len(keyed), 17)]))
    of = dict(zip(nodes.tolist(), prints, strict=True))
    pairs = set(map(tuple, found[found.kind == 0][["a", "b"]].to_numpy().tolist()))
    assert all((of[a] ^ of[b]).bit_count() <= 2 for a, b in pairs)
    for _, group in found[found.kind == 1].groupby("a"):
        pairs |= {(n, group.b.min()) for n in group.b}
    expected = roots(sorted(of), lambda a, b: (of[a] ^ of[b]).bit_count() <= 2)
    assert roots(sorted(of), lambda a, b: (a, b) in pairs or (b, a) in pairs) == expected


def test_query_equals_brute_force_on_the_smallest_tables(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    check(rows, simhash.near_duplicates(spark.read.parquet(f"{SMALL}/documents.parquet")).collect())
    shown = simhash.op5_simhash(spark, SMALL).first()
    assert re.fullmatch("[0-9a-f]{16}", shown["fingerprint"])


def test_empty_table(spark):
    assert simhash.near_duplicates(frame(spark, [])).collect() == []
    assert near_text.near_texts(frame(spark, [])).collect() == []


def test_near_texts_link_from_the_similarity_on(spark):
    rng = random.Random(3)
    base = [["w%d" % rng.randrange(5000) for _ in range(300)] for _ in range(12)]
    rows, texts = [], {}
    for i, words in enumerate(base):
        for change in (0, 0, 2, 4, 30):
            own = list(words)
            for at in rng.sample(range(300), change):
                own[at] = "new%d" % rng.randrange(10**6)
            texts[len(rows)] = " ".join(own)
            rows.append((len(rows), texts[len(rows)], None, None, 0, "", 0, "", ""))
    rows += [(900, None, None, None, 0, "", 0, "", ""), (901, "", None, None, 0, "", 0, "", "")]
    texts |= {900: None, 901: ""}
    got = {r["doc_id"]: r["component_id"] for r in near_text.near_texts(frame(spark, rows)).collect()}
    expected = roots(sorted(texts), lambda a, b: near_text.jaccard(texts[a], texts[b], 5) >= 0.8)
    assert got == expected
    kept = near_text.one_of_each(frame(spark, [*rows, rows[0]]), near_text.near_texts(frame(spark, rows)))
    assert kept.columns == frame(spark).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(expected.values()))


def words_of(rng, n):
    return ["w%d" % rng.randrange(10**6) for _ in range(n)]


def near_components(spark, texts):
    rows = [(i, t, None, None, 0, "", 0, "", "") for i, t in enumerate(texts)]
    got = {r["doc_id"]: r["component_id"] for r in near_text.near_texts(frame(spark, rows)).collect()}
    sets = [set(near_text.shingle_hashes(t, 5).tolist()) for t in texts]
    assert got == roots(range(len(texts)), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    return got


def test_pairs_behind_earlier_relatives_link(spark):
    """Earlier texts share a passage at J below 0.8; later pairs of such texts are at J about 0.86."""
    rng = random.Random(11)
    texts, pairs = [], []
    for _ in range(6):
        passage = words_of(rng, 176)
        texts += [" ".join(passage + words_of(rng, 24)) for _ in range(30)]
        own = words_of(rng, 24)
        pairs.append((len(texts), len(texts) + 1))
        texts += [" ".join(passage + own), " ".join(passage + own[:10] + words_of(rng, 14))]
    got = near_components(spark, texts)
    assert all(got[a] == got[b] == a for a, b in pairs)


def test_groups_hung_on_a_distant_relative_link(spark):
    """The smallest doc_id of every group is a J 0.6-0.79 relative of the others."""
    rng = random.Random(12)
    texts = []
    for _ in range(60):
        shared = words_of(rng, 172)
        own = words_of(rng, 28)
        texts += [" ".join(shared + words_of(rng, 28)), " ".join(shared + own), " ".join(shared + own[:10] + words_of(rng, 18))]
    got = near_components(spark, texts)
    assert all(got[i] == i and got[i + 2] == got[i + 1] == i + 1 for i in range(0, 180, 3))


def test_appended_cut_and_replaced_blocks_link(spark):
    """Contiguous edits at a similarity of 0.80 to 0.85, where prints differ most."""
    rng = random.Random(13)
    texts = []
    for n in (40, 200, 1000):
        for _ in range(20):
            base = words_of(rng, n)
            m = n - 4
            appended = base + words_of(rng, int(m * rng.uniform(0.18, 0.25)))
            cut = base[: n - int(m * rng.uniform(0.15, 0.2))]
            block = max(1, int(m * rng.uniform(0.085, 0.11)) - 4)
            at = rng.randrange(n - block)
            replaced = [*base[:at], *words_of(rng, block), *base[at + block :]]
            kind = [appended, cut, replaced][len(texts) // 2 % 3]
            texts += [" ".join(base), " ".join(kind)]
    got = near_components(spark, texts)
    linked = sum(got[a] == got[a + 1] for a in range(0, len(texts), 2))
    assert linked >= 0.8 * len(texts) / 2


def test_rows_that_repeat_an_id_with_other_texts_stay(spark):
    rng = random.Random(14)
    one, two = (" ".join(words_of(rng, 30)) for _ in range(2))
    rows = [(i, t, None, None, 0, "", 0, "", "") for i, t in [(1, one), (1, two), (1, one), (2, two), (None, one)]]
    kept = near_text.one_of_each(frame(spark, rows), near_text.near_texts(frame(spark, rows)))
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == sorted([(1, one), (1, two), (0, one)])


@pytest.mark.parametrize("block, tile", [(40_000, 512), (60, 7), (25, 3)])
def test_shared_tokens_are_counted_once_for_each_pair(spark, monkeypatch, block, tile):
    """A hot group just below the similarity, whose texts meet in one place or in many blocks."""
    monkeypatch.setattr(near_text, "BLOCK", block)
    monkeypatch.setattr(near_text, "TILE", tile)
    rng = random.Random(15)
    base = words_of(rng, 120)
    texts = []
    for _ in range(70):
        own = list(base)
        for at in rng.sample(range(120), rng.randrange(2, 8)):
            own[at] = words_of(rng, 1)[0]
        texts.append(" ".join(own))
    texts += [" ".join(words_of(rng, 120)) for _ in range(20)]
    near_components(spark, texts)


def test_near_texts_go_through_the_prints(spark, monkeypatch):
    """Pairs that only the prints within two bits give, without minima and with rare prefixes left out."""
    rng = random.Random(17)
    base = [words_of(rng, 1500) for _ in range(8)]
    texts = [" ".join(w) for words in base for w in (words, [*words[:700], "other", *words[701:]])]
    prints = simhash.majority([near_text.shingle_hashes(t, 5) for t in texts])
    near = {i for i in range(0, 16, 2) if int(prints[i] ^ prints[i + 1]).bit_count() <= 2}
    assert near
    pairs = near_text.print_pairs(spark.createDataFrame([(i, int(x)) for i, x in enumerate(prints.view(np.int64))], "node long, fp long"))
    assert {(r["a"], r["b"]) for r in pairs.collect()} == {(i + 1, i) for i in near}
    monkeypatch.setattr(near_text, "STARS", 0)
    monkeypatch.setattr(near_text, "shared_pairs", lambda rows, similarity: iter(()))
    rows = [(i, t, None, None, 0, "", 0, "", "") for i, t in enumerate(texts)]
    got = {r["doc_id"]: r["component_id"] for r in near_text.near_texts(frame(spark, rows)).collect()}
    assert {i for i in range(0, 16, 2) if got[i + 1] == i} == near and sum(got[i] == i for i in got) == 16 - len(near)


@pytest.mark.parametrize("cells", [2_000_000, 30])
def test_small_tiles_give_the_same_pairs(monkeypatch, cells):
    monkeypatch.setattr(near_text, "CELLS", cells)
    test_meetings_equal_all_pairs(monkeypatch, 512)


@pytest.mark.parametrize("tile", [512, 4])
def test_meetings_equal_all_pairs(monkeypatch, tile):
    monkeypatch.setattr(near_text, "TILE", tile)
    rng = np.random.default_rng(16)
    for sides in (1, 2):
        nodes = rng.choice(10**6, 25, replace=False)
        tokens = {int(n): set(rng.integers(0, 30, 6).tolist()) for n in nodes}
        about = {int(n): (int(n) % 4, int(rng.integers(8, 12)), int(n) % sides) for n in nodes}
        rows = pd.DataFrame(
            [(t, n, *about[n], len(tokens[n]) + n % 3) for n in tokens for t in tokens[n]],
            columns=["token", "node", "root", "size", "side", "tokens"],
        )
        found = {(r.a, r.b): r.n for f in near_text.shared_pairs(rows.sample(frac=1, random_state=1), 0.8) for r in f.itertuples()}
        wanted = {}
        for x in tokens:
            for y in tokens:
                (rx, sx, ax), (ry, sy, ay) = about[x], about[y]
                n = len(tokens[x] & tokens[y])
                if x > y and n and rx != ry and min(sx, sy) >= 0.8 * max(sx, sy) and (sides == 1 or ax != ay):
                    prefix = [s - math.ceil(0.8 * s) + 1 for s in (sx, sy)]
                    least = math.ceil(0.8 / 1.8 * (sx + sy) - 1e-9) - max(sx - prefix[0], sy - prefix[1])
                    if n + min(x % 3, y % 3) >= least:
                        wanted[x, y] = n
        assert found == wanted and wanted
