"""Small corpora with the cases every operator must stand: nulls, empty and very long texts, ties,
repeated rows, and columns with names that operators use themselves."""

from __future__ import annotations

import random

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, key string, size int, shard string, kept string"


def sentence(rng: random.Random, words: int) -> str:
    return " ".join("".join(rng.choice("aeionrst") for _ in range(rng.randrange(1, 9))) for _ in range(words))


def documents(seed: int = 5, rows: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    texts = [sentence(rng, rng.randrange(0, 90)) for _ in range(rows)]
    texts += [None, "", " \t\n", "one", "two words", "one", texts[3], texts[3], texts[3], sentence(rng, 30_000)]
    texts += [texts[5] + " tail", (texts[6] + " ") * 4, "Zeile eins\nZeile zwei ## $$\n\nZeile eins ▁x \U0001f600"]
    out = [
        (i, t, "en", rng.choice(["a", "a", "b", "é", "", None]), len(t or ""), "k", 1, "s", "no")
        for i, t in enumerate(texts)
    ]
    return [*out, out[2], out[2], (len(out), "text", None, None, None, None, None, None, None)]


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, DOCUMENTS)
