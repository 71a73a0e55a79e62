import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from riskframe.llm import personal
from tests.conftest import SMALL
from tests.llm.data import documents, frame

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else 2 * d - 9 * (2 * d > 9)
    return total % 10 == 0


def plain(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(p) < 256 for p in m.group().split(".")),
                "card": 13 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }
            if good[kind]:
                out.append((kind, *m.span()))
    return out


def hidden(text):
    return [(k, text[a:b]) for k, a, b, base in personal.find(text) if not base]


@pytest.mark.parametrize("letters", ["a@.b-", "1.25 ", "0123456789 -", "+0123456789() .-", "a1@. -+(", "aé１＠.1 "])
def test_base_spans_equal_the_plain_patterns(letters):
    rng = random.Random(letters)
    for n in range(2500):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(0, 12 if n % 2 else 60)))
        assert [s[:3] for s in personal.find(text) if s[3]] == plain(text), text


def test_valid_cards_in_digits():
    rng = random.Random(1)
    for _ in range(300):
        text = " x ".join("".join(rng.choice("0123456789") for _ in range(rng.randrange(12, 21))) for _ in range(20))
        assert [s[:3] for s in personal.find(text) if s[3]] == plain(text)


DISGUISED = [
    ("mail jane.doe [at] mail7 (dot) example [dot] com now", "email", "jane.doe [at] mail7 (dot) example [dot] com"),
    ("mail jane at example dot com now", "email", "jane at example dot com"),
    ("correo jane arroba example punto com", "email", "jane arroba example punto com"),
    ("jane.doe＠example．com!", "email", "jane.doe＠example．com"),
    ("jаne@exаmple.com", "email", "jаne@exаmple.com"),  # Cyrillic a
    ("ja​ne&#64;example&#46;com", "email", "ja​ne&#64;example&#46;com"),
    ("jane @ example.com", "email", "jane @ example.com"),
    ("host 192 dot 168 dot 0 dot 17 up", "ip", "192 dot 168 dot 0 dot 17"),
    ("host １９２.１６８.0.17 up", "ip", "１９２.１６８.0.17"),
    ("one nine two dot one six eight dot zero dot one seven", "ip", "one nine two dot one six eight dot zero dot one seven"),
    ("call plus four nine one seven one two three four five six seven please", "phone", "plus four nine one seven one two three four five six seven"),
    ("ruf plus vier neun eins sieben eins zwei drei vier fünf", "phone", "plus vier neun eins sieben eins zwei drei vier fünf"),
    ("call +1 (2O2) 555 O143 now", "phone", "+1 (2O2) 555 O143"),
    ("card 4111 1111‑1111 1111.", "card", "4111 1111‑1111 1111"),
    ("card four double one one double one double one one one one one one one one one one one.", "card", None),
]


@pytest.mark.parametrize("text, kind, source", DISGUISED)
def test_disguised_identifiers_map_to_their_source(text, kind, source):
    found = hidden(text)
    if source is None:
        assert all(k == kind for k, _ in found)
    else:
        assert (kind, source) in found


@pytest.mark.parametrize(
    "text",
    [
        "Meet me at example.com or at noon.", "un deux fois, un jour, plus tard un autre", "look at the dot on the map",
        "one two three four five six seven eight nine times", "Version 1.2.3 at 10 dot", "Привет, это обычный текст. 12 13 14",
        "a (at) b", "1 000 000 l of oil, 100 lO", "plus ça change; un, deux, trois, quatre!", "x & y &amp; z 5%",
    ],
)
def test_clean_texts_stay_clean(text):
    assert personal.find(text) == []


def test_every_normalised_character_maps_into_the_source():
    rng = random.Random(2)
    parts = ["one", "zwei", "dot", "(at)", "at", "a", "Ａ", "а", "1", "O1l2", "​", "@", ".", " ", "ﬁ", "½", "plus", "double", "é", "\n", "[dot]"]
    for _ in range(1500):
        text = "".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randrange(1, 25)))
        tape = personal.deobfuscate(text) or personal.Tape(text)
        assert len(tape.text) == len(tape.first) == len(tape.last)
        assert all(0 <= a < b <= len(text) for a, b in zip(tape.first, tape.last))
        assert all(x <= y for x, y in zip(tape.first, tape.first[1:]))
        kept = [(c, a) for c, a, b in zip(tape.text, tape.first, tape.last) if b - a == 1 and c.isspace()]
        assert all(text[a].isspace() for _, a in kept)
        found = personal.find(text)
        assert [s[:3] for s in found if s[3]] == plain(text)
        assert found == sorted(found, key=lambda s: (personal.KINDS.index(s[0]), s[1], s[2]))


def test_masks_cover_all_spans():
    text = "a jane (at) example dot com b +1 (132) 555-1352 c 1.2.3.4 d"
    assert personal.masked(text, personal.find(text)) == "a [EMAIL] b [PHONE] c [IP] d"


@pytest.mark.parametrize("unit", ["a", "1", "1.", "@", "a@", "+1 ", " ", "1 ", "one ", "O", "é", "а", "(", " at ", "dot "])
def test_long_runs_take_linear_time(unit):
    text = unit * (300_000 // len(unit))
    began = time.time()
    personal.find(text)
    assert time.time() - began < 6


def test_operator_on_odd_rows(spark):
    rows = documents() + [(900, "a@b.cd und a＠b.cd", "en", "a", 1, "k", 1, "s", "n")]
    df = frame(spark, rows)
    got = personal.summarise(df).collect()
    assert len(got) == len(rows)
    by_text = {}
    for r, (i, text, *_) in zip(sorted(got, key=lambda r: r["doc_id"]), sorted(rows, key=lambda r: r[0]), strict=True):
        assert r["doc_id"] == i
        base = plain(text)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in personal.KINDS] == [sum(s[0] == k for s in base) for k in personal.KINDS]
        by_text[i] = r
    assert by_text[900]["spans"] == "email:0:6,email:11:17" and by_text[900]["n_added"] == 1
    masked = df.select("doc_id", "text", personal.mask(F.col("text")).alias("m")).collect()
    assert all((r["m"] is None) == (r["text"] is None) for r in masked)
    assert personal.summarise(df.limit(0)).collect() == []


def test_query_equals_brute_force(spark):
    texts = dict(map(tuple, spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()))
    got = personal.op13_personal_data(spark, SMALL).collect()
    assert len(got) == len(texts) and sum(r["n_email"] for r in got) > 0
    for r in got:
        base = plain(texts[r["doc_id"]])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert r["spans"] == joined and r["n_added"] == 0
