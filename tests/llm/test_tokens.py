import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models

from riskframe.llm import encoding, pieces, tokens
from tests.conftest import SMALL
from tests.llm.data import documents, frame

VOCABULARY = pieces.load()
MODEL = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


def texts():
    rng = random.Random(1)
    out = [r[1] for r in documents()]
    out += ["  x  y ", "a\n\nb\t\r\nc", "\0 a\0b", "x" * 3000, "  " * 300 + "ab" * 400, "é①ﬁ😀漢字 テスト " * 40, " ▁a▁ b", "abc" * 200 + " " + "the" * 100]
    out += ["".join(rng.choice("ab the in er\n ▁é漢\0") for _ in range(rng.randrange(150))) for _ in range(300)]
    return out


def test_ids_equal_the_library(spark):
    rows = [(i, t, None, None, 0, "", 0, "", "") for i, t in enumerate(texts())]
    got = {r["doc_id"]: r for r in encoding.round_trip(frame(spark, rows), VOCABULARY).collect()}
    for i, t, *_ in rows:
        assert got[i]["ids"] == MODEL.encode(t or "")
        assert got[i]["n_pieces"] == len(got[i]["ids"])
        assert got[i]["round_trip"] == (None if t is None else "▁" not in t)


def test_forgetting_chunks_and_small_indexes_change_nothing(monkeypatch):
    own = [t for t in texts() if t]
    monkeypatch.setattr(encoding, "KNOWN_CHUNKS", 50)
    monkeypatch.setattr(encoding, "INDEX_CHARS", 40)
    monkeypatch.setattr(encoding, "LONG_CHUNK", 6)
    import pandas as pd

    small = [t for t in own if len(t) < 400][:80]
    for t in small:
        ids = next(encoding._encoded(iter([pd.Series([t])]), VOCABULARY))
        assert ids[0].tolist() == MODEL.encode(t)


def test_chunks_met_often_are_encoded_once(monkeypatch):
    monkeypatch.setattr(encoding, "KNOWN_CHUNKS", 50)
    monkeypatch.setattr(encoding, "INDEX_CHARS", 40)
    relaxed, relax = Counter(), encoding.Encoder._relax

    def counted(self, chunks):
        relaxed.update(c.strip(" ▁") for c in chunks)
        return relax(self, chunks)

    monkeypatch.setattr(encoding.Encoder, "_relax", counted)
    own = [f"the word{i} of the name{i} and the" for i in range(400)]
    import pandas as pd

    got = [ids[k].tolist() for ids in encoding._encoded(iter([pd.Series(own)]), VOCABULARY) for k in range(len(ids))]
    assert got == [MODEL.encode(t) for t in own]
    assert relaxed["the"] == relaxed["of"] == relaxed["and"] == 1


def test_edges_are_all_occurrences():
    rng, matcher = random.Random(3), encoding.Matcher(VOCABULARY)
    every = sorted(set("".join(VOCABULARY.normal)) - {"▁"}) + list("\0\n😀①\ud800")
    few, names = "ab the in er", list(VOCABULARY.normal)
    for chars, size in ((few, 300), (every, 4000), (every, 9000), ("\0", 3), ("a", 1), (few, 20)):
        text = "".join(rng.choice(chars) for _ in range(size))
        text += "".join(rng.choice(names) for _ in range(size // 9)).replace("▁", " ")
        got = matcher.edges(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4"))
        shown, width = text.replace(" ", "▁"), got.shape[1]
        want = np.zeros_like(got)
        for at in range(len(text)):
            for n in range(1, min(width, len(text) - at + 1)):
                want[at, n] = VOCABULARY.normal.get(shown[at : at + n], -1) + 1
        assert (got == want).all()


def test_ids_of_many_alphabets():
    rng = random.Random(4)
    every = sorted(set("".join(VOCABULARY.normal))) + list("\0\n😀①")
    own = ["".join(rng.choice(every) for _ in range(rng.randrange(1, 200))) for _ in range(200)]
    own += ["".join(rng.choice(list(VOCABULARY.normal)) for _ in range(60)).replace("▁", " ") for _ in range(200)]
    got = [ids[k].tolist() for ids in encoding._encoded(iter([own]), VOCABULARY) for k in range(len(ids))]
    assert got == [MODEL.encode(t) for t in own]


def test_texts_decode_together_as_one_by_one(monkeypatch):
    monkeypatch.setattr(encoding, "DECODED_IDS", 7)
    rng, decoder = random.Random(6), encoding.Decoder(VOCABULARY)
    valid = [MODEL.encode(t) for t in ("A text\n of é漢①", "", " two  spaces", "①", "")]
    octets = [VOCABULARY.byte_ids[b] for b in "é①".encode()]
    torn = [*valid, [rng.randrange(len(VOCABULARY.pieces)) for _ in range(30)], octets[:4], octets[1:2]]
    split = [octets[:1], octets[1:2]]
    for lists in (valid, torn, split, []):
        flat = np.array([i for one in lists for i in one], dtype=np.int32)
        bounds = np.cumsum([0, *map(len, lists)])
        assert decoder.texts(encoding.Ids(flat, bounds)).to_pylist() == [decoder(one) for one in lists]


def test_decode(spark):
    ids = spark.createDataFrame([(MODEL.encode("A text\n of é漢①"),), ([],), (None,)], "ids array<int>")
    got = [r[0] for r in ids.select(encoding.decode(ids["ids"], VOCABULARY)).collect()]
    assert got == ["A text\n of é漢①", "", None]


@pytest.fixture(scope="module")
def unigram():
    lowest = min(VOCABULARY.scores[i] for i in VOCABULARY.normal.values())
    pairs = [(p, s if k == pieces.NORMAL else lowest) for p, s, k in zip(VOCABULARY.pieces, VOCABULARY.scores, VOCABULARY.kinds, strict=True)]
    return Tokenizer(models.Unigram(pairs, unk_id=0, byte_fallback=True))


def test_counts_equal_the_library(spark, unigram):
    cut = pieces.Chunks(VOCABULARY)
    rows = [(i, t, None, None, 0, "", 0, "", "") for i, t in enumerate(texts()) if not t or "\0" not in t and len(t) < 5000]
    counted = frame(spark, rows).select("doc_id", tokens.count_tokens(F.col("text"), VOCABULARY).alias("n"))
    got = {r["doc_id"]: r["n"] for r in counted.collect()}
    for i, t, *_ in rows:
        assert got[i] == sum(len(unigram.encode(c, add_special_tokens=False).ids) for c in cut(t))


def test_ties_take_the_longest_piece():
    v = pieces.Vocabulary(
        pieces=("a", "b", "ab", "c"), scores=(-1.0, -1.0, -2.0, -1.0), kinds=(1, 1, 1, 1), normal={"a": 0, "b": 1, "ab": 2, "c": 3}
    )
    count = tokens.Counter(v)
    assert count["ab"] == 1 and count["abc"] == 2 and count["aé"] == 3


def test_queries_and_empty_table(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").count()
    assert tokens.op1_token_counts(spark, SMALL).count() == rows
    assert encoding.op10_sentencepiece(spark, SMALL).where("round_trip").count() == rows
    assert encoding.round_trip(frame(spark, []), VOCABULARY).collect() == []


def test_models_that_change_texts_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(pieces.MODEL, "rb") as f:
        model.ParseFromString(f.read())
    model.normalizer_spec.remove_extra_whitespaces = True
    path = tmp_path / "m.model"
    path.write_bytes(model.SerializeToString())
    with pytest.raises(ValueError):
        pieces.load(str(path))
