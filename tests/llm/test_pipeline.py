from collections import Counter

import pytest
import sentencepiece

import corpus_pipeline
from riskframe.llm import mixing, near_text, pieces, quality, repetition
from tests.conftest import SMALL
from tests.llm.data import documents, frame
from tests.llm.test_repetition import WORD, brute
from tests.llm.test_simhash import roots

COLUMNS = list(corpus_pipeline.COLUMNS)


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    """What each stage returns on what the one before it kept, read back."""
    folder = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out[-1], SMALL).write.parquet(str(folder / name))
        out.append(spark.read.parquet(str(folder / name)))
    return out


def test_stage_names_and_columns(kept):
    assert len(corpus_pipeline.STAGES) == 5
    assert all(sorted(df.columns) == sorted(COLUMNS) for df in kept[:-1])


def test_rules(kept):
    for r in kept[0].collect():
        b = brute(r["text"])
        failed = b["n_words"] < 10 or 100 * b["n_repeat_words"] > 20 * b["n_words"]
        if failed:
            assert not kept[1].where(f"doc_id = {r['doc_id']}").count() if r["doc_id"] % 7 == 0 else True
    assert kept[1].count() == repetition.judge(kept[0]).where("kept").count()


def test_classifier(spark, kept):
    model = quality.train(kept[0].select("doc_id", "text"), spark.read.parquet(f"{SMALL}/labels.parquet"))
    expected = quality.classify(kept[1], model).where("predicted = 1")
    assert sorted(r["doc_id"] for r in kept[2].collect()) == sorted(r["doc_id"] for r in expected.collect())


def test_one_document_of_each_group_stays(kept):
    text = {r["doc_id"]: r["text"] for r in kept[2].collect()}
    sets = {i: set(near_text.shingle_hashes(t, 5).tolist()) for i, t in text.items()}
    group = roots(sorted(text), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    assert sorted(r["doc_id"] for r in kept[3].collect()) == sorted(set(group.values()))


def test_mix(kept):
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(kept[3]).collect()}
    assert Counter(r["doc_id"] for r in kept[4].collect()) == Counter({i: c for i, c in copies.items() if c})


def test_encode(kept):
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    text = {r["doc_id"]: r["text"] for r in kept[4].collect()}
    rows = kept[5].collect()
    assert len(rows) == kept[4].count()
    assert all(r["ids"] == model.encode(text[r["doc_id"]]) and r["round_trip"] for r in rows)


def test_stages_stand_odd_rows_and_empty_tables(spark):
    docs = frame(spark)
    for rows in (documents(), []):
        docs = frame(spark, rows)
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SMALL)
            assert out.count() <= 3 * max(1, len(rows))
            docs = out if "text" in out.columns else docs


def by_brute_force(text):
    """Whether the rules of the first stage keep a text."""
    words = [w.encode() for w in WORD.findall(text or "")]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    # only positions whose first five words occur again can repeat
    again = [i for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1]
    if len(words) < 10 or 100 * len({j for i in again for j in range(i, i + 5)}) > 20 * len(words):
        return False
    spans = [0] * len(words)
    for i in again:
        for j in again:
            k = 0
            while i != j and max(i, j) + k < len(words) and words[i + k] == words[j + k]:
                k += 1
            spans[i] = max(spans[i], k)
    inside = {j for i, s in enumerate(spans) if s >= 10 for j in range(i, i + s)}
    return sum(len(words[i]) for i in inside) <= 0.2 * sum(map(len, words)) and max(spans) <= 100


def test_rules_keep_and_reject_every_row_like_brute_force(kept):
    rows = kept[0].collect()
    expected = Counter((r["doc_id"], r["text"]) for r in rows if by_brute_force(r["text"]))
    got = Counter((r["doc_id"], r["text"]) for r in kept[1].collect())
    assert got == expected and len(rows) > len(got) > 0
