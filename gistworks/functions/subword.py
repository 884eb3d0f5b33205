"""Subword pieces with scores: the best segmentation of a word, ids and exact decoding.

A model is a list of pieces with log-probabilities (Kudo 2018). A text is cut
into words, each with the blank before it; a word's segmentation is the path of
highest score through the lattice of pieces, found by dynamic programming. Words
are segmented once per task, as long as the memory kept for them lasts. Models
are read from a file that the caller names, never trained here.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

#: How the file spells the blank before a word.
MARK = "▁"
#: What an unknown character costs beyond the worst piece.
UNKNOWN_COST = 10.0
#: Bytes of words and ids that a task keeps; a longer word is segmented each time.
MEMO_BYTES, LONGEST = 16 << 20, 256
_WORD = re.compile(" [^ ]*")


@dataclass
class UnigramModel:
    """Pieces (a leading blank for the mark) with ids and scores, ids of the 256 bytes if known, and the id of the unknown."""

    pieces: dict[str, tuple[int, float]]
    bytes_: list[int] | None = None
    unknown: int = 0
    _memo: dict = field(default_factory=dict, repr=False)
    _held: int = field(default=0, repr=False)

    def __post_init__(self) -> None:
        self.longest = max(map(len, self.pieces), default=0)
        self.unknown_score = min((s for _, s in self.pieces.values()), default=0.0) - UNKNOWN_COST
        self.spelled = {i: p.encode() for p, (i, _) in self.pieces.items()}
        for value, i in enumerate(self.bytes_ or ()):
            self.spelled[i] = bytes([value])

    @staticmethod
    def read(path: str) -> "UnigramModel":
        """From a model file; pieces of control and unknown kind are left out, byte pieces kept apart."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, bytes_ = {}, [-1] * 256
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                bytes_[int(piece[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                pieces[piece.replace(MARK, " ")] = (i, model.get_score(i))
        return UnigramModel(pieces, None if -1 in bytes_ else bytes_, max(model.unk_id(), 0))

    def segment(self, word: str) -> list[tuple[int, int]]:
        """(end, id) of the best path's pieces; of equal paths the one whose last piece is longer.

        A character that no piece spells alone may be passed as unknown: as its
        bytes, if the model has them, which all end with the character but the
        last start with it, or as the unknown id.
        """
        known = self._memo.get(word)
        if known is not None:
            return known
        n = len(word)
        best = [0.0] + [float("-inf")] * n
        back: list[tuple[int, int]] = [(0, -1)] * (n + 1)
        for end in range(1, n + 1):
            for start in range(max(0, end - self.longest), end):
                found = self.pieces.get(word[start:end])
                if found is None:
                    if end - start > 1:
                        continue
                    found = (-1, self.unknown_score)
                if best[start] + found[1] > best[end]:
                    best[end], back[end] = best[start] + found[1], (start, found[0])
        out, at = [], n
        while at:
            start, piece = back[at]
            if piece >= 0:
                out.append((at, piece))
            elif self.bytes_ is None:
                out.append((at, self.unknown))
            else:
                raw = word[start:at].encode("utf-8", "surrogatepass")
                out += [(at if k == len(raw) - 1 else start, self.bytes_[raw[k]]) for k in range(len(raw) - 1, -1, -1)]
            at = start
        out.reverse()
        if n <= LONGEST:
            # A pair of numbers, and the word, its list and its place in the table.
            self._held += 128 * len(out) + 256 + 4 * n
            if self._held > MEMO_BYTES:
                self._memo.clear()
                self._held = 0
            self._memo[word] = out
        return out

    def spans(self, text: str, most: int | None = None) -> list[tuple[int, int, int]]:
        """(start, end, id) in characters of the text, for the first ``most`` pieces."""
        out: list[tuple[int, int, int]] = []
        if not text:
            return out
        for word in _WORD.finditer(" " + text):
            base, start = word.start() - 1, max(word.start() - 1, 0)
            for end, piece in self.segment(word[0]):
                out.append((start, max(base + end, 0), piece))
                start = max(base + end, 0)
            if most is not None and len(out) >= most:
                return out[:most]
        return out

    def encode(self, text: str, most: int | None = None) -> list[int]:
        """Ids of the first ``most`` pieces of a text."""
        out: list[int] = []
        if not text:
            return out
        for word in _WORD.findall(" " + text):
            out += [piece for _, piece in self.segment(word)]
            if most is not None and len(out) >= most:
                return out[:most]
        return out

    def decode(self, ids: list[int]) -> str:
        """The text again, if its ids are whole; ids without a spelling are passed over."""
        raw = b"".join(self.spelled.get(i, b"") for i in ids)
        text = raw.decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text
