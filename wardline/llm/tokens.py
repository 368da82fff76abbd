"""Token ids of whole texts, with each distinct word encoded once in a worker.

The vocabularies are byte-pair encodings that never merge across the start of a run of
white space. So a text's ids are those of its pieces in a row, and a piece's ids come
from a dictionary. Bytes that are not UTF-8 count as replacement characters. Encoding itself is always the tokenizers library's.
"""

from __future__ import annotations

import functools
import os
import re

import numpy as np

#: White space as the byte-level pattern has it.
_SPACE = r"\t-\r \x85\xa0  -     　"
_PIECE = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
_AFTER_SPACE = re.compile(f"[{_SPACE}]+[^{_SPACE}]")
#: Distinct pieces that a worker remembers; further ones are encoded again in each batch.
REMEMBERED = 700_000
#: Longer pieces are rare and large; they are not remembered.
LONGEST = 64
#: New pieces that are encoded as one text, and signs of which the first with an id of its own goes between them.
TOGETHER, MARKS = 64, "\u00a7\u00b6\u00a4\u00b1\u00ac\u00a6~^`|"


class Encoder:
    """``spaced``: white space belongs to the word after it (byte-level), else it is dropped."""

    def __init__(self, path: str, spaced: bool, dtype: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.spaced, self.dtype = spaced, np.dtype(dtype).newbyteorder("<")
        if self.tokenizer.get_vocab_size() > np.iinfo(self.dtype).max + 1:
            raise ValueError(f"the ids do not fit {dtype}")
        self.known: dict = {}
        #: A sign that is one id, with that id; it parts pieces that are encoded together, with ``between``.
        before = " " if spaced else ""
        ids = {c: self.tokenizer.encode(before + c, add_special_tokens=False).ids for c in MARKS}
        self.mark = next(((c, i[0]) for c, i in ids.items() if len(i) == 1), None)
        self.between = self.mark and (f" {self.mark[0]}" if spaced else f" {self.mark[0]} ")

    def _pieces(self, text: bytes) -> list:
        return _PIECE.findall(text.decode("utf-8", "replace")) if self.spaced else text.split()

    def _encoded(self, strings: list[str]) -> list[bytes]:
        """The ids of each piece; pieces that white space may part are encoded many at a time.

        Where white space belongs to pieces, it is that before them; those without it, or of nothing else, go alone.
        """
        found = [b""] * len(strings)
        apart = [i for i, s in enumerate(strings) if not self.spaced or _AFTER_SPACE.match(s)] if self.mark else []
        some = [apart[i : i + TOGETHER] for i in range(0, len(apart), TOGETHER)]
        again = list(set(range(len(strings))).difference(apart))
        joined = [self.between.join([strings[i] for i in group]) for group in some]
        for group, e in zip(some, self.tokenizer.encode_batch_fast(joined, add_special_tokens=False), strict=True):
            ids = np.array(e.ids, dtype=self.dtype)
            at = np.flatnonzero(ids == self.mark[1]).tolist()
            if len(at) != len(group) - 1:  # a piece holds the mark itself
                again += group
                continue
            flat, size = ids.tobytes(), self.dtype.itemsize
            for i, a, b in zip(group, [0, *(k + 1 for k in at)], [*at, len(ids)], strict=True):
                found[i] = flat[size * a : size * b]
        for i, e in zip(again, self.tokenizer.encode_batch_fast([strings[i] for i in again], add_special_tokens=False), strict=True):
            found[i] = np.array(e.ids, dtype=self.dtype).tobytes()
        return found

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text as little-endian integers."""
        pieces = [self._pieces(t) for t in texts]
        new = list(set().union(*pieces).difference(self.known))
        strings = new if self.spaced else [p.decode("utf-8", "replace") for p in new]
        for start in range(0, len(new), 4096):
            self.known.update(zip(new[start : start + 4096], self._encoded(strings[start : start + 4096]), strict=True))
        # All pieces of the batch are in one dictionary while it is looked up; what it has no room for leaves again.
        joined = [b"".join(map(self.known.__getitem__, p)) for p in pieces]
        room = REMEMBERED - (len(self.known) - len(new))
        for piece in new:
            if room > 0 and len(piece) <= LONGEST:
                room -= 1
            else:
                del self.known[piece]
        return joined


@functools.lru_cache(maxsize=2)
def encoder(path: str, spaced: bool, dtype: str) -> Encoder:
    return Encoder(path, spaced, dtype)
