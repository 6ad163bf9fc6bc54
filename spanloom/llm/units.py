"""Texts cut into units that tokenizers treat one by one, each distinct unit numbered once per worker.

A unit ends before a single space that stands between two characters that are no white
space: no pre-token of a byte-level vocabulary and no piece of a sentence-piece vocabulary
runs on from there, so ids, and counts of ids, of a text are those of its units one after
another. Runs of white space stay inside a unit.
"""

from __future__ import annotations

import array

import numpy as np
import regex

#: Characters after which a text is cut at the next place between units.
STRETCH = 1 << 20
_CUT = regex.compile(r"[^\s\x1c-\x1f] (?=[^\s\x1c-\x1f])")


def stretches(text: str, size: int = STRETCH) -> list[str]:
    """The text in runs of about `size` characters, each but the first beginning with the space between two units."""
    out, start = [], 0
    while len(text) - start > size and (found := _CUT.search(text, start + size)):
        out.append(text[start: found.end() - 1])
        start = found.end() - 1
    return [*out, text[start:] if start else text]


class Units(dict):
    """Numbers units in order of appearance; `fresh` holds those not yet worked on.

    A key is what stands between two single spaces; a key that begins with a space
    is any other unit, that space left off.
    """

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []
        self.begins, self.ends = array.array("b"), array.array("b")
        self.uses = np.zeros(0, np.int64)

    def keep_used(self, most: int) -> np.ndarray:
        """Forgets all but the units used most often (used twice at least, `most` of them at most), numbers
        these anew in their order, and returns their numbers of before."""
        often = np.sort(self.uses)[::-1]
        limit = max(2, int(often[most]) + 1 if len(often) > most else 2)
        kept = np.flatnonzero(self.uses >= limit)
        place = np.full(len(self), -1)
        place[kept] = np.arange(len(kept))
        known = {key: number for key, number in zip(self, place.tolist()) if number >= 0}
        self.clear()
        self.update(known)
        self.begins, self.ends = (array.array("b", np.frombuffer(a, np.int8)[kept].tobytes()) for a in (self.begins, self.ends))
        self.uses = np.ones(len(kept), np.int64)
        return kept

    def _used(self, numbers: np.ndarray) -> None:
        more = np.bincount(numbers, minlength=len(self))
        more[: len(self.uses)] += self.uses
        self.uses = more

    def __missing__(self, key: str) -> int:
        number = self[key] = len(self)
        own = key[1:] if key[:1] == " " else key
        self.fresh.append(own if key[:1] == " " else " " + key)
        self.begins.append(own != "" and not own[0].isspace())
        self.ends.append(own != "" and not own[-1].isspace())
        return number

    def batch(self, texts: list[str], spaced: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the units of all texts in a row, and how many each text has. spaced: as if a space stood before each text."""
        pieces: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            own = text.split(" ")
            if not spaced:
                own[0] = " " + own[0]
            pieces += own
            counts[i] = len(own)
        numbers = np.fromiter(map(self.__getitem__, pieces), np.int64, len(pieces))
        begins, ends = (np.frombuffer(a, np.int8)[numbers] for a in (self.begins, self.ends))
        first = np.zeros(len(numbers) + 1, bool)
        first[np.cumsum(counts) - counts] = True
        head = first[:-1] | (begins & np.concatenate(([0], ends[:-1]))).astype(bool)
        if not head.all():
            numbers, counts = self._glued(pieces, numbers, counts, head)
        self._used(numbers)
        return numbers, counts

    def _glued(self, pieces, numbers, counts, head) -> tuple[np.ndarray, np.ndarray]:
        """Pieces that are no heads go to the unit before them."""
        starts = np.flatnonzero(head)
        sizes = np.diff(np.append(starts, len(pieces)))
        out = numbers[starts]
        for k in np.flatnonzero(sizes > 1).tolist():
            at = int(starts[k])
            joined = " ".join(pieces[at: at + int(sizes[k])])
            # the first piece is a key: with a space in front it stands for itself
            out[k] = self[joined if pieces[at][:1] == " " else "  " + joined]
        text_of = np.repeat(np.arange(len(counts)), counts)
        return out, np.bincount(text_of[starts], minlength=len(counts))


def gathered(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices starts[i], ..., starts[i] + sizes[i] - 1 for all i in a row."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))
