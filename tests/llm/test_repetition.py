import random
import re

import numpy as np

from riskframe.llm import repetition
from tests.llm.data import documents, frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_spans(words, least):
    out = []
    for i in range(len(words)):
        best = 0
        for j in range(len(words)):
            k = 0
            while i != j and max(i, j) + k < len(words) and words[i + k] == words[j + k]:
                k += 1
            best = max(best, k)
        out.append(best if best >= least else 0)
    return out


def brute(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    inside = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            inside |= set(range(i, i + 5))
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text or ""),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(inside),
    }


def test_spans_equal_brute_force_over_several_documents():
    rng = random.Random(1)
    for _ in range(150):
        docs = [[rng.randrange(3) for _ in range(rng.randrange(30))] for _ in range(rng.randrange(1, 5))]
        ids = np.array([w for d in docs for w in d], dtype=np.int64)
        doc = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        assert repetition.repeated_spans(ids, doc, 2).tolist() == [x for d in docs for x in brute_spans(d, 2)]


def test_measures_and_verdict_equal_brute_force(spark, monkeypatch):
    rows = [r for r in documents() if len(r[1] or "") < 5000]
    got = repetition.judge(frame(spark, rows).select("doc_id", "text", "kept"), max_longest=12).collect()
    text = {r[0]: r[1] for r in rows}
    assert len(got) == len(rows)
    for r in got:
        expected = brute(text[r["doc_id"]])
        assert {k: r[k] for k in expected} == expected
        words = [w.encode() for w in WORD.findall(text[r["doc_id"]] or "")]
        spans = brute_spans(words, 5)
        inside = {j for i, s in enumerate(spans) if s >= 10 for j in range(i, i + s)}
        failed = len(words) < 10 or 100 * expected["n_repeat_words"] > 20 * len(words)
        bad = sum(len(words[i]) for i in inside) > 0.2 * sum(map(len, words)) or max(spans, default=0) > 12
        assert (r["base_failed"], r["kept"]) == (failed, not failed and not bad)
    assert {r["base_failed"] for r in got} == {True, False}


def test_chunks_do_not_change_measures(monkeypatch):
    texts = [r[1] for r in documents()]
    whole = repetition.measure(texts, 10)
    monkeypatch.setattr(repetition, "INDEX_WORDS", 7)
    assert repetition.measure(texts, 10).equals(whole)


def test_very_long_repeats_and_empty_table(spark):
    m = repetition.measure(["word " * 70_000, "a b c d e f " * 9000], 10)
    assert m["longest_repeat"].tolist() == [69_999, 54_000 - 6]
    assert repetition.judge(frame(spark, [])).collect() == []
