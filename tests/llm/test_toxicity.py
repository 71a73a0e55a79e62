import numpy as np

from riskframe.llm import toxicity
from tests.llm.data import documents, frame

SF = "/root/testdata/sf0.01"


def reading(text):
    lexicon = toxicity.Lexicon({"idiot": 3.0, "blork*": 2.0, "blorkfine": 0.0})
    found = toxicity.matched(toxicity.split(text), lexicon)
    return {k: v for k, v in zip(toxicity.READINGS, found.tolist(), strict=True) if v}


def test_clauses_are_read_by_the_grammar():
    assert reading("what an idiot.") == {"plain": 3.0}
    assert reading("You are an idiot.") == {"targeted": 3.0}
    assert reading("idiot, they all") == {"targeted": 3.0}
    assert reading("You are no idiot.") == {"negated": 3.0}
    assert reading("He said you are an idiot.") == {"reported": 3.0}
    assert reading("I will kill them!") == {"threat": toxicity.THREAT_WEIGHT}
    assert reading("kill the process.") == {}
    assert reading("Not now. An Idiot!!") == {"plain": 3.0}
    assert reading("blorked (blorking) blorkfine blor") == {"plain": 4.0}
    assert reading("") == {} and reading(None) == {}


def test_mined_patterns_are_words_and_stems_that_clean_texts_lack():
    rng = np.random.default_rng(3)
    texts = [({f"word{rng.integers(300)}" for _ in range(20)}, 0) for _ in range(300)]
    texts += [({f"zorg{chr(97 + i % 20)}en", "word1", "idiot"}, 1) for i in range(20)]
    texts += [({f"zorg{chr(97 + i % 20)}al", "word2"}, 1) for i in range(20)]
    weights = toxicity.mine(texts)
    assert weights["idiot"] > 3 and any(p.startswith("zorg") for p in weights)
    assert not any(p.startswith("word") for p in weights)


def test_held_out_toxic_documents_are_found(spark):
    got = toxicity.op6_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").toPandas()
    assert (got[got["toxic"] == 0]["predicted"] == 0).mean() > 0.99
    english = spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en'").select("doc_id").toPandas()["doc_id"]
    held = got[got["held_out"] & (got["toxic"] == 1) & got["doc_id"].isin(english)]
    assert len(held) and (held["predicted"] == 1).mean() >= 0.8


def test_odd_rows(spark):
    labels = spark.createDataFrame([(1, 0), (4, 1), (None, 1)], "doc_id long, toxic int")
    got = toxicity.classify(frame(spark), toxicity.train(frame(spark), labels)).collect()
    assert len(got) == len(documents()) and all(0 <= r["score"] <= 1 for r in got)
    model = toxicity.train(frame(spark, []), labels.limit(0))
    assert toxicity.classify(frame(spark, []), model).collect() == []
