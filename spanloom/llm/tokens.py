"""Token ids of whole texts by the tokenizers library, a distinct word encoded once per worker.

The vocabulary's pre-tokenizer never joins text across white space, so a text's
ids are those of its words one after another. A word of plain letters followed
by plain punctuation is looked up in two parts; any other word goes to the
library as it is.
"""

from __future__ import annotations

import array
import itertools
import sys
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from spanloom.llm.common import worker_state

END_ID = 2
#: Words whose ids a worker keeps.
WORDS_KEPT = 700_000
#: No word holds white space, so this key is free for the end of a document.
END = b" "
PUNCTUATION = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
_PUNCTUATION = PUNCTUATION.encode()


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def split_words(texts: list[bytes | None]) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of all texts in a row, as numbers of distinct ones, and how many each text has.

    Arrow cuts at the six characters of `bytes.split()`, but leaves empty words where white space begins or ends a text.
    """
    lists = pc.ascii_split_whitespace(pa.array(texts, pa.large_binary()).fill_null(b"").view(pa.large_string()))
    words, ends = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    held = pc.not_equal(pc.binary_length(words), 0)
    before = np.concatenate(([0], np.cumsum(held.to_numpy(zero_copy_only=False))))
    return words.filter(held).dictionary_encode(), np.diff(before[ends - ends[0]])


class WordTokenizer:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.letters = byte_letters()
        self.forget()

    def forget(self) -> None:
        # words are numbered as they are met, so the last keys are the ones not yet encoded
        self.words: dict[bytes, int] = defaultdict(itertools.count().__next__)
        self.cores: dict[bytes | str, list[int]] = {}
        self.ids = array.array("I")
        self.ends = array.array("q", [0])
        self._add([END], [[END_ID]])

    def _add(self, words: list[bytes], ids: list[list[int]]) -> None:
        """Numbers the words that have none, and appends their ids."""
        for word in words:
            self.words[word]
        self.ids.extend(array.array("I", itertools.chain.from_iterable(ids)))
        sizes = itertools.accumulate(map(len, ids), initial=self.ends[-1])
        self.ends.extend(itertools.islice(sizes, 1, None))

    def encode(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def _core(self, core: str) -> list[int]:
        found = self.cores.get(core)
        if found is None:
            spelled = "".join([self.letters[b] for b in core.encode()])
            found = self.cores[core] = [t.id for t in self.library.model.tokenize(spelled)]
        return found

    def _tail(self, tail: str) -> list[int]:
        found = self.cores.get(tail)
        if found is None:
            found = self.cores[tail] = self.encode(tail)
        return found

    def _word(self, word: bytes) -> list[int]:
        text = word.decode()
        core = text.rstrip(PUNCTUATION)
        if core.isalpha() and max(core) < "ɐ":
            lower = core.lower()
            if lower.isalpha():
                return self._core(lower) + self._tail(text[len(core):]) if len(core) < len(text) else self._core(lower)
        return self.encode(text)

    def _words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word. ASCII letters stand for themselves in the vocabulary, so they need no spelling."""
        cores, tokenize, every = self.cores, self.library.model.tokenize, []
        for word in words:
            core = word.rstrip(_PUNCTUATION)
            if core.isalpha():
                lower = core.lower()
                ids = cores.get(lower)
                if ids is None:
                    ids = cores[lower] = [t.id for t in tokenize(lower.decode())]
                every.append(ids + self._tail(word[len(core):].decode()) if len(core) < len(word) else ids)
            else:
                every.append(self._word(word))
        return every

    def batch(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, each ended by END_ID, and how many each text has."""
        if len(self.words) > WORDS_KEPT:
            self.forget()
        words, counts = split_words(texts)
        distinct = words.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
        known = len(self.ends) - 1
        numbers = np.fromiter(map(self.words.__getitem__, distinct), np.int64, len(distinct))
        fresh = list(itertools.islice(reversed(self.words), len(self.words) - known))[::-1]
        self._add(fresh, self._words(fresh))
        counts = np.cumsum(counts + 1)
        in_word = np.ones(len(words) + len(texts), bool)
        in_word[counts - 1] = False
        every = np.full(len(in_word), self.words[END])
        every[in_word] = numbers[words.indices.to_numpy()]
        numbers = every
        ends = np.frombuffer(self.ends, np.int64)
        starts = ends[numbers]
        own = ends[numbers + 1] - starts
        before = np.concatenate(([0], np.cumsum(own)))
        # places are in the ids of distinct words, so 32 bits do unless a text has billions of tokens
        kind = np.int32 if max(int(before[-1]), len(self.ids)) < 1 << 31 else np.int64
        place = np.repeat((starts - before[:-1]).astype(kind), own)
        place += np.arange(before[-1], dtype=kind)
        ids = np.frombuffer(self.ids, np.uint32)[place]
        del ends
        return ids, np.diff(np.concatenate(([0], before[counts])))


def tokenizer(path: str) -> WordTokenizer:
    """The worker's own tokenizer."""
    return worker_state(sys.intern(path), lambda: WordTokenizer(path))


def crc(ids: np.ndarray) -> int:
    """Unsigned CRC-32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").data)
