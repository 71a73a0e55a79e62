"""Personal data by offset-preserving deobfuscation (operator 13)."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm.common import table

KINDS = ("email", "ip", "card", "phone")
SPANS = "array<struct<kind:string,start:long,end:long,base:boolean>>"

# The patterns of the base spans. Quantifiers that cannot give back are possessive, so
# that long runs of one character class take linear time.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
ADDRESS = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Letters of other scripts that look like Latin ones.
CONFUSABLE = dict(
    zip(
        "АВЕКМНОРСТУХаеорсухіјѕһԁԛԝАΑΒΕΖΗΙΚΜΝΟΡΤΥΧοαινρυ",
        "ABEKMHOPCTYXaeopcyxijshdqwAABEZHIKMNOPTYXoaivpu",
        strict=True,
    )
) | {"·": ".", "‧": ".", "∙": ".", "•": ".", "。": ".", "؍": "/", "⁄": "/", "−": "-", "⁃": "-"}

# Spelled digits in the four languages of the corpus.
DIGIT_WORDS = {
    word: str(digit)
    for digit, words in enumerate(
        (
            "zero null zéro cero",
            "one eins un une uno",
            "two zwei zwo deux dos",
            "three drei trois tres",
            "four vier quatre cuatro",
            "five fünf cinq cinco",
            "six sechs seis",
            "seven sieben sept siete",
            "eight acht huit ocho",
            "nine neun neuf nueve",
        )
    )
    for word in words.split()
}
TIMES = {"double": 2, "triple": 3}
AT, DOT = ("at", "arroba"), ("dot", "punkt", "punto", "point")
# Last labels that make words for at and dot an address rather than prose.
ENDINGS = "com org net edu gov info biz dev app io int mil de fr es uk eu nl ch pl ru cn jp br mx ar ca au se dk fi pt ie test invalid".split()
CONNECTORS = dict.fromkeys(DOT, ".") | {"plus": "+"}
# Spelled digits that a run needs: fewer are prose.
LEAST_WORDS = 4

Edit = tuple[int, int, list[tuple[str, int, int]]]


class Tape:
    """A text whose every character knows the source characters it stands for."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.first = np.arange(len(text), dtype=np.int64)
        self.last = self.first + 1

    def rewrite(self, edits: Iterable[Edit]) -> Tape:
        """Put (character, from, to) for each [a, b), in order; positions are those of this tape."""
        text, first, last, at = [], [], [], 0
        for a, b, out in edits:
            text += [self.text[at:a], "".join(c for c, _, _ in out)]
            first += [self.first[at:a], self.first[[x for _, x, _ in out]] if out else self.first[:0]]
            last += [self.last[at:a], self.last[[y - 1 for _, _, y in out]] if out else self.last[:0]]
            at = b
        if not text:
            return self
        done = Tape("")
        done.text = "".join([*text, self.text[at:]])
        done.first, done.last = np.concatenate([*first, self.first[at:]]), np.concatenate([*last, self.last[at:]])
        return done

    def source(self, start: int, end: int) -> tuple[int, int]:
        return int(self.first[start]), int(self.last[end - 1])


Transducer = Callable[[Tape], Tape]


def compose(*steps: Transducer) -> Transducer:
    """The transducer that reads what the step before it wrote."""

    def composed(tape: Tape) -> Tape:
        for step in steps:
            tape = step(tape)
        return tape

    return composed


def _same(tape: Tape, m: re.Match, out: str) -> Edit:
    return m.start(), m.end(), [(c, m.start(), m.end()) for c in out]


# Anything but ASCII and Latin letters may stand for an ASCII character.
FOREIGN = re.compile("[^\x00-\x7fÀ-ɏḀ-ỿ]+")
ENTITY = re.compile(r"&(?:#64|#46|#x40|#x2e|commat|period);|%40", re.IGNORECASE)


@lru_cache(maxsize=65_536)
def _plain(c: str) -> str:
    """The ASCII characters that `c` looks like; `c` itself if there are none."""
    if (known := CONFUSABLE.get(c)) is not None:
        return known
    kind = unicodedata.category(c)
    if kind == "Cf" or "︀" <= c <= "️":
        return ""
    if kind == "Nd":
        return str(unicodedata.decimal(c))
    if kind in ("Zs", "Pd"):
        return " " if kind == "Zs" else "-"
    folded = unicodedata.normalize("NFKC", c)
    folded = "".join(CONFUSABLE.get(x, x) for x in folded)
    return folded if folded.isascii() else c


def homoglyphs(tape: Tape) -> Tape:
    """Letters, digits and signs that look like ASCII ones; invisible characters go."""

    def edits() -> Iterator[Edit]:
        for m in FOREIGN.finditer(tape.text):
            plain = [_plain(c) for c in m.group()]
            if "".join(plain) != m.group():
                out = [(c, k, k + 1) for k, some in enumerate(plain, m.start()) for c in some]
                yield m.start(), m.end(), out

    return tape.rewrite(edits())


def entities(tape: Tape) -> Tape:
    """Character references and escapes of the at sign and the dot."""
    dots = ("&#46;", "&#x2e;", "&period;")
    return tape.rewrite(_same(tape, m, "." if m.group().lower() in dots else "@") for m in ENTITY.finditer(tape.text))


MIXED = re.compile(r"(?<![0-9OolI])[0-9OolI]{3,}+")


def lookalikes(tape: Tape) -> Tape:
    """O, o, l and I inside numbers, where at least two of three characters are digits."""

    def edits() -> Iterator[Edit]:
        for m in MIXED.finditer(tape.text):
            a, b = m.span()
            letters = sum(not c.isdigit() for c in m.group())
            alone = not (a and tape.text[a - 1].isalpha()) and not tape.text[b : b + 1].isalpha()
            if letters and alone and 3 * letters <= b - a:
                yield a, b, [("0" if c in "Oo" else "1" if c in "lI" else c, a + k, a + k + 1) for k, c in enumerate(m.group())]

    return tape.rewrite(edits())


TOKEN = re.compile(r"[^\W\d_]++|[0-9]++")
GAP = re.compile(r"[ ,\-\n]{0,3}")


def spelled_digits(tape: Tape) -> Tape:
    """Runs of spelled digits, with digits, repeats, dots and a plus between them, become digits.

    The machine is outside a run, or inside with the edit that the run would be; at a word that
    does not continue it, a run of four spelled digits or more is written, another is not.
    """

    def edits() -> Iterator[Edit]:
        out: list[tuple[str, int, int]] = []
        start, end, words, sign, times = 0, 0, 0, None, None
        for m in TOKEN.finditer(tape.text):
            word, a, b = m.group().lower(), m.start(), m.end()
            digits = DIGIT_WORDS.get(word) or (word if word[0].isascii() and word.isdigit() else None)
            apart = bool(out or sign or times) and not GAP.fullmatch(tape.text, end, a)
            if apart or digits is None and word not in CONNECTORS and word not in TIMES:
                if words >= LEAST_WORDS:
                    yield start, out[-1][2], out
                out, words, sign, times = [], 0, None, None
            if digits is None:
                if word in TIMES:
                    times = (TIMES[word], a)
                elif word in CONNECTORS and (out or word == "plus") and sign is None:
                    sign = (CONNECTORS[word], a, b)
                end = b
                continue
            if not out:
                start = sign[1] if sign else times[1] if times else a
            if sign:
                out.append(sign)
            if word in DIGIT_WORDS:
                count, x = times or (1, a)
                out += [(digits, x, b)] * count
                words += count
            else:
                out += [(c, a + k, a + k + 1) for k, c in enumerate(digits)]
            end, sign, times = b, None, None
        if words >= LEAST_WORDS:
            yield start, out[-1][2], out

    return tape.rewrite(edits())


LABEL = r"[A-Za-z0-9-]{1,63}"
BRACKETED = re.compile(
    rf"\x20{{0,2}}[\[({{<]\x20{{0,2}}(?:(?P<at>{'|'.join(AT)}|@)|{'|'.join(DOT)}|\.)\x20{{0,2}}[\])}}>]\x20{{0,2}}", re.IGNORECASE
)
SPOKEN_DOT = re.compile(rf"(?<=[A-Za-z0-9])\x20{{1,2}}(?:{'|'.join(DOT)})\x20{{1,2}}(?=[A-Za-z0-9])", re.IGNORECASE)
SPACED_AT = re.compile(rf"(?<=[A-Za-z0-9._%+-])(?:\x20{{1,2}}@\x20{{0,2}}|@\x20{{1,2}})(?={LABEL}\.[A-Za-z0-9])")
SPOKEN_AT = re.compile(
    rf"(?<=[A-Za-z0-9._%+-])\x20{{1,2}}(?:{'|'.join(AT)})\x20{{1,2}}(?=(?P<domain>{LABEL}(?:\.{LABEL})*?\.(?:{'|'.join(ENDINGS)}))(?![A-Za-z0-9-]))",
    re.IGNORECASE,
)


def bracketed(tape: Tape) -> Tape:
    """`[at]`, `(dot)` and their like."""
    return tape.rewrite(_same(tape, m, "@" if m["at"] else ".") for m in BRACKETED.finditer(tape.text))


def spoken_dots(tape: Tape) -> Tape:
    """A word for the dot between two names or numbers."""
    return tape.rewrite(_same(tape, m, ".") for m in SPOKEN_DOT.finditer(tape.text))


def spoken_at(tape: Tape) -> Tape:
    """At signs set apart, and words for them before a domain whose dot is disguised too.

    The second condition leaves `meet me at example.com` alone.
    """
    tape = tape.rewrite(_same(tape, m, "@") for m in SPACED_AT.finditer(tape.text))

    def edits() -> Iterator[Edit]:
        for m in SPOKEN_AT.finditer(tape.text):
            a, b = m.span("domain")
            dots = [k for k in range(a, b) if tape.text[k] == "."]
            if any(tape.last[k] - tape.first[k] > 1 for k in dots):
                yield _same(tape, m, "@")

    return tape.rewrite(edits())


# Words and signs without which the steps on at signs and dots write nothing.
HINTS = (*DOT, "arroba", "(", "[", "{", "<", " @", "@ ")
signs = compose(bracketed, spoken_dots, spoken_at)


def deobfuscate(text: str) -> Tape | None:
    """The tape on which disguised identifiers are plain; None if it would read like the text.

    A step is left out where nothing in the text can make it write.
    """
    tape = Tape(text) if FOREIGN.search(text) or "%40" in text or "&" in text else None
    tape = compose(homoglyphs, entities)(tape) if tape else None
    now = tape.text if tape else text
    low = now.lower()
    if sum(w in DIGIT_WORDS for w in TOKEN.findall(low)) >= 2:
        tape = spelled_digits(tape or Tape(text))
    if re.search("[0-9]", now):
        tape = lookalikes(tape or Tape(text))
    if any(hint in low for hint in HINTS):
        tape = signs(tape or Tape(text))
    return tape if tape and tape.text != text else None


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _small(part: str) -> bool:
    return len(part := part.lstrip("0")) < 4 and int(part or "0") < 256


def identifiers(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of every kind by the base patterns: leftmost, and none within a kind overlap."""

    def digits(m: re.Match) -> str:
        return re.sub("[^0-9]", "", m.group())

    found = {kind: [] for kind in KINDS}
    if "@" in text:
        found["email"] = list(_emails(text))
    if re.search("[0-9]", text):
        found["ip"] = [m.span() for m in ADDRESS.finditer(text) if all(map(_small, m.group().split(".")))]
        found["card"] = [m.span() for m in CARD.finditer(text) if 13 <= len(d := digits(m)) <= 19 and luhn(d)]
        if "+" in text:
            found["phone"] = [m.span() for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]
    return found


def find(text: str | None) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, base) by kind, then start: base spans, and those of disguised identifiers.

    An identifier of the tape is mapped back to the source characters it stands for, and added
    unless a base span of its kind covers it.
    """
    if not text:
        return []
    base = identifiers(text)
    tape = deobfuscate(text)
    hidden = identifiers(tape.text) if tape else {kind: [] for kind in KINDS}
    out = []
    for kind in KINDS:
        spans = {span: True for span in base[kind]}
        for span in {tape.source(*s) for s in hidden[kind]}:
            before = bisect_right(base[kind], span[0], key=lambda s: s[0])
            if not before or base[kind][before - 1][1] < span[1]:
                spans[span] = False
        out += [(kind, *span, spans[span]) for span in sorted(spans)]
    return out


def masked(text: str | None, spans: list[tuple[str, int, int, bool]]) -> str | None:
    """`text` with every span, and what spans share, replaced by the name of its kind."""
    if not spans:
        return text
    out, at = [], 0
    for kind, start, end, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if end > at:
            out += [text[at:start], f"[{kind.upper()}]"] if start >= at else []
            at = end
    return "".join([*out, text[at:]])


def personal_data(text: Column) -> Column:
    """Spans of a whole text, as `find` gives them; none for null and empty texts.

    Positions count code points of the source, the end is exclusive.
    """

    @F.pandas_udf(SPANS)
    def of(batch: pd.Series) -> pd.Series:
        names = ("kind", "start", "end", "base")
        return pd.Series([[dict(zip(names, s, strict=True)) for s in find(t)] for t in batch], dtype=object)

    return of(text)


def mask(text: Column) -> Column:
    """A whole text with its personal data replaced by `[EMAIL]`, `[IP]`, `[CARD]` and `[PHONE]`; null stays null."""

    @F.pandas_udf("string")
    def of(batch: pd.Series) -> pd.Series:
        return pd.Series([masked(t, find(t)) for t in batch], dtype=object)

    return of(text)


def _joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def summarise(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) for every row of `docs`.

    The counts and the digest are of base spans alone, `spans` lists all, `n_added` counts those of
    disguised identifiers. Repeated rows and null ids are kept as they are; other columns are not read.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), personal_data(F.col(text)).alias("found"))
    base = F.filter("found", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [(F.size(base) - F.size(F.array_remove(kinds, kind))).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return rows.select(
        "doc_id",
        *counts,
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("found")).alias("spans"),
        (F.size("found") - F.size(base)).cast("long").alias("n_added"),
    )


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summarise(table(spark, sf_dir, "documents"))
