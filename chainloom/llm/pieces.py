"""Reading a public SentencePiece vocabulary, and cutting texts where no piece can cross."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from pathlib import Path

import sentencepiece

#: The mark that SentencePiece writes for a space.
SPACE = "▁"
_CUT = "\x00"
_SEGMENT = re.compile(f"{SPACE}+[^{SPACE}\n]*|\n|[^{SPACE}\n]+")
#: Bytes of segments and their values that a worker keeps; it starts anew beyond this, so memory is bounded.
CACHE_BYTES = 80 << 20
#: What an entry takes besides its text and value.
ENTRY_BYTES = 200


@dataclass(frozen=True)
class Pieces:
    """Pieces with ids and scores; byte_ids[b] is the piece of byte b."""

    normal: dict[str, tuple[int, float]]
    byte_ids: tuple[int, ...]
    unk_id: int
    size: int
    cuttable: bool


def load_pieces(path: str) -> Pieces:
    sp = sentencepiece.SentencePieceProcessor(model_proto=Path(path).read_bytes())
    normal, byte_ids = {}, {}
    for i in range(sp.vocab_size()):
        if sp.is_byte(i):
            byte_ids[int(sp.id_to_piece(i)[3:5], 16)] = i
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            normal[sp.id_to_piece(i)] = (i, sp.get_score(i))
    if len(byte_ids) != 256:
        raise ValueError("a vocabulary with byte fallback is needed")
    cuttable = not any(SPACE in p.lstrip(SPACE) or ("\n" in p and len(p) > 1) for p in normal)
    return Pieces(normal, tuple(byte_ids[b] for b in range(256)), sp.unk_id(), sp.vocab_size(), cuttable)


def segments(text: str, cuttable: bool = True) -> list[str]:
    """The normalised text (a mark in front, spaces as marks) cut before runs of marks and around line ends.

    No piece goes over such a cut, so each segment is encoded by itself. Empty texts have none.
    """
    if not text:
        return []
    if not cuttable:
        return [SPACE + text.replace(" ", SPACE)]
    if "  " in text or SPACE in text or _CUT in text or text[0] in " \n" or "\n " in text:
        return _SEGMENT.findall(SPACE + text.replace(" ", SPACE))
    marked = SPACE + text.replace(" ", _CUT + SPACE)
    if "\n" in marked:
        marked = marked.replace("\n", f"{_CUT}\n{_CUT}")
        return [s for s in marked.split(_CUT) if s]
    return marked.split(_CUT)


class Cache(dict):
    """Segment -> what `make` (a list of new segments -> their values) gives, with bounded size.

    When it is full it becomes the older half, and what is wanted again comes back from there; the older half before it goes. So frequent segments
    stay. What one call wants is held in any case: that is a slice of texts, or one text where it is longer.
    """

    def __init__(self, make, most: int = CACHE_BYTES):
        self.make, self.most, self.held, self.older = make, most, 0, {}

    def fill(self, wanted: Iterable[str]) -> None:
        wanted = set(wanted)
        again = {s: self.older[s] for s in wanted if s not in self and s in self.older}
        new = [s for s in wanted if s not in self and s not in again]
        if not new and not again:
            return
        size = lambda some: sum(ENTRY_BYTES + 2 * len(s) + memoryview(v).nbytes for s, v in some)
        again.update(zip(new, self.make(new) if new else [], strict=True))
        added = size(again.items())
        if self.held + added > self.most // 2:
            kept = {s: self[s] for s in wanted if s in self}
            self.older = dict(self)
            self.clear()
            self.update(kept)
            self.held = size(kept.items())
        self.update(again)
        self.held += added

    def drop(self) -> None:
        """Forget everything: at the end of a task, since a worker waits for other tasks with what it holds."""
        self.clear()
        self.older, self.held = {}, 0
