"""A SentencePiece vocabulary and the chunks of text that its pieces never cross."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

MARK = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"

# Kinds of pieces in the model file.
NORMAL, BYTE = 1, 6


@dataclass(frozen=True)
class Vocabulary:
    """Pieces by id with scores; `normal` are those that text can match."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: tuple[int, ...]
    normal: dict[str, int] = field(default_factory=dict)
    byte_ids: tuple[int, ...] = ()
    breaks: str = ""

    @property
    def longest(self) -> int:
        return max(map(len, self.normal), default=1)


def load(path: str = MODEL) -> Vocabulary:
    """Read on the driver; what tasks need travels with them, so executors need no file.

    Only models that leave text as it is are taken: spaces become marks, one mark is put before the
    text, unknown characters become bytes, and no piece has a mark after another character.
    """
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    spec = model.normalizer_spec
    if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not (spec.add_dummy_prefix and spec.escape_whitespaces):
        raise ValueError(f"{path}: its normalization changes texts, which is not supported")
    if not model.trainer_spec.byte_fallback:
        raise ValueError(f"{path}: bytes for unknown characters are needed")
    normal = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
    if any(MARK in p.lstrip(MARK) for p in normal):
        raise ValueError(f"{path}: a piece crosses words")
    inside = set("".join(normal))
    return Vocabulary(
        pieces=tuple(p.piece for p in model.pieces),
        scores=tuple(p.score for p in model.pieces),
        kinds=tuple(p.type for p in model.pieces),
        normal=normal,
        byte_ids=tuple(i for i, p in enumerate(model.pieces) if p.type == BYTE),
        breaks="".join(c for c in "\n\t\r" if c not in inside),
    )


class Chunks:
    """Cuts a text, as the model sees it, where no piece can lie across: before a run of marks,
    and about characters that are in no piece. Chunks show a mark as `mark`, a space if short
    strings matter."""

    def __init__(self, vocabulary: Vocabulary, mark: str = MARK) -> None:
        self.mark, self.other = mark, " " if mark == MARK else MARK
        stop = re.escape(vocabulary.breaks)
        self._cut = re.compile(f"{mark}*+[^{mark}{stop}]++|{mark}++" + (f"|[{stop}]" if stop else ""))

    def __call__(self, text: str | None) -> list[str]:
        return self._cut.findall(self.mark + text.replace(self.other, self.mark)) if text else []
