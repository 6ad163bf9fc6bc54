"""Exact token counts of every prefix of every text, by dynamic programming over prefixes.

In byte-pair encoding a prefix of a word has exactly one last token t such that t and
the last token of what lies before t encode to just these two; its count is one more
than the count before t. So one pass over a word gives the count of each of its
prefixes (`WordPrefixes.byte_counts`). A text's counts are those of its units, one after
another (`units`), with three rules where the end of a prefix changes how the
vocabulary's pattern cuts it: a run of white space that ends the prefix is one word,
the letters of a half contraction ('r of 're) are a word of their own, and a special
token counts as one only when it is whole.

The table of `prefix_counts` holds, for each stretch of a text, the differences from
prefix to prefix and their lowest count. From it `token_counts`, `tokens_at` and
`longest_prefixes` answer without encoding again. Counts may fall from one prefix to
the next, so the longest prefix within a budget is looked up, not bisected.

Defined cases: a null text counts as empty and has one stretch without prefixes; rows
that repeat have stretches each, told apart by `row`; an empty table gives no rows.
"""

from __future__ import annotations

import array
import sys

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import slices, table, worker_state, written
from spanloom.llm.tokens import PUNCTUATION, byte_letters, vocabulary_path
from spanloom.llm.units import Units, gathered, stretches

#: White space as the vocabulary's pattern has it: what Python counts besides is in \x1c-\x1f.
WHITE = frozenset(c for c in map(chr, range(0x3001)) if c.isspace()) - set("\x1c\x1d\x1e\x1f")
#: Distinct units, words and pairs of tokens that a worker keeps. Words cost most to work out.
UNITS_KEPT, WORDS_KEPT, PAIRS_KEPT = 400_000, 1_000_000, 600_000
LIMIT = 1024
PREFIXES = "row long, doc_id long, part int, last boolean, start_char long, n_chars long, start_byte long, n_bytes long, start_tokens long, n_tokens long, least long, width int, steps binary"


class WordPrefixes:
    """Counts of the prefixes of words, by a byte-level vocabulary."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        if self.library.normalizer or not isinstance(self.library.pre_tokenizer, pre_tokenizers.ByteLevel):
            raise ValueError(f"{path} is no byte-level vocabulary")
        self.split = self.library.pre_tokenizer.pre_tokenize_str
        self.model = self.library.model
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.tokens = list(self.library.get_vocab(with_added_tokens=False))
        self.found = ahocorasick.Automaton()
        for number, token in enumerate(self.tokens):
            self.found.add_word(token, (len(token), number))
        self.found.make_automaton()
        self.letters = byte_letters()
        self.units = Units()
        self.words: dict[str, bytes | tuple[int, ...]] = {}
        self.pairs: dict[int, bool] = {}
        self.values, self.bounds = array.array("i"), array.array("q", [0])

    def forget(self) -> None:
        """Makes room: units used often stay."""
        kept = self.units.keep_used(UNITS_KEPT // 2)
        bounds = np.frombuffer(self.bounds, np.int64)
        sizes = bounds[kept + 1] - bounds[kept]
        self.values = array.array("i", np.frombuffer(self.values, np.int32)[gathered(bounds[kept], sizes)].tobytes())
        del bounds
        self.bounds = array.array("q", np.concatenate(([0], np.cumsum(sizes))).tobytes())
        if len(self.words) > WORDS_KEPT:
            self.words = {}
        if len(self.pairs) > PAIRS_KEPT:
            self.pairs = {}

    def spelled(self, word: str) -> str:
        return "".join([self.letters[b] for b in word.encode()])

    def _follows(self, before: int, token: int) -> bool:
        """Whether the two, side by side, are their own encoding; before is -1 at the start of a word."""
        own = [self.tokens[n] for n in (before, token) if n >= 0]
        found = self.pairs[(before << 32) + token] = [t.value for t in self.model.tokenize("".join(own))] == own
        return found

    def byte_counts(self, spelled: list[str]) -> list[list[int]]:
        """Tokens of the first 0, 1, 2, ... bytes of each word."""
        out = []
        # no token holds the character between the words, so no match passes it
        matches, pairs, at, settled = self.found.iter("\n".join(spelled)), self.pairs, 0, -1
        counts, last, here = [0], [-1], 0
        bounds = [*np.cumsum([len(s) + 1 for s in spelled]).tolist()]
        for end, (size, token) in matches:
            while end >= bounds[at]:  # the word before is done
                out.append(counts)
                here, at = bounds[at], at + 1
                counts, last = [0], [-1]
            if end == settled:
                continue
            start = end + 1 - size - here
            good = pairs.get((last[start] << 32) + token)
            if good or (good is None and self._follows(last[start], token)):
                counts.append(counts[start] + 1)
                last.append(token)
                settled = end
        out.append(counts)
        return out + [[0] for _ in range(len(spelled) - len(out))]

    def learn(self, words: list[str]) -> None:
        """Tokens of the first 1, 2, ... characters of words (pre-tokens)."""
        for word, by_byte in zip(words, self.byte_counts([self.spelled(w) for w in words])):
            if word in ("'re", "'ve", "'ll"):
                by_byte[2] = 2
            if word.isascii():
                del by_byte[0]
            else:  # where characters end: before a byte that does not go on with one
                octets = word.encode()
                by_byte = [n for n, octet in zip(by_byte[1:], octets[1:]) if octet & 0xC0 != 0x80] + by_byte[-1:]
            self.words[word] = bytes(by_byte) if max(by_byte) < 256 else tuple(by_byte)

    def counts(self, word: str) -> bytes | tuple[int, ...]:
        if word not in self.words:
            self.learn([word])
        return self.words[word]

    def learn_plain(self, units: list[str]) -> None:
        """What units of letters and punctuation need, all at once."""
        wanted = set()
        for unit in units:
            lead = unit[:1] == " "
            core = unit[lead:].rstrip(PUNCTUATION)
            if core.isalpha():
                wanted.add(unit[: lead + len(core)])
        self.learn([w for w in wanted if w not in self.words])

    def unit_counts(self, unit: str) -> list[int]:
        """Tokens of the first 1, 2, ... characters of a unit."""
        lead = unit[:1] == " "
        core = unit[lead:].rstrip(PUNCTUATION)
        if core.isalpha():  # a word of letters, and punctuation
            out = list(self.counts(unit[: lead + len(core)]))
            if len(out) < len(unit):
                base = out[-1]
                out += [base + n for n in self.counts(unit[len(out):])]
            return out
        out, base, settled = [], 0, 0
        for _, (start, end) in self.split(unit):
            if unit[start] in WHITE and start >= settled:
                # the whole run, as it counts when the prefix ends in it
                run = start + 1
                while run < len(unit) and unit[run] in WHITE:
                    run += 1
                if run > start + 1:
                    out += [base + n for n in self.counts(unit[start:run])]
                    settled = run
            own = self.counts(unit[start:end])
            out += [base + n for n in own[max(0, len(out) - start):]]
            base += own[-1]
            settled = max(settled, end)
        if out:
            out[-1] = base
        return out

    def batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all prefixes of all texts in a row, without regard to special tokens; characters of each text."""
        if len(self.units) > UNITS_KEPT or len(self.words) > WORDS_KEPT or len(self.pairs) > PAIRS_KEPT:
            self.forget()
        numbers, n_units = self.units.batch(texts)
        self.learn_plain(self.units.fresh)
        for unit in self.units.fresh:
            self.values.extend(self.unit_counts(unit))
            self.bounds.append(len(self.values))
        self.units.fresh = []
        bounds, values = np.frombuffer(self.bounds, np.int64), np.frombuffer(self.values, np.int32)
        starts = bounds[numbers]
        sizes = bounds[numbers + 1] - starts
        whole = np.where(sizes > 0, values[np.maximum(starts + sizes - 1, 0)] if len(values) else 0, 0)
        before = np.cumsum(whole) - whole
        first = np.cumsum(n_units) - n_units
        before -= np.repeat(before[first], n_units)
        out = values[gathered(starts, sizes)] + np.repeat(before, sizes)
        return out, np.array([len(t) for t in texts], np.int64)

    def segments(self, text: str) -> list[tuple[str, int]]:
        """The text cut after its special tokens, then into stretches; with the length of the special token at its end."""
        out = []
        while self.specials:
            found = min(((at, -len(s), s) for s in self.specials if (at := text.find(s)) >= 0), default=None)
            if found is None:
                break
            end = found[0] + len(found[2])
            *some, tail = stretches(text[:end])
            out += [*((s, 0) for s in some), (tail, len(found[2]))]
            text = text[end:]
        return out + [(s, 0) for s in stretches(text)] if text or not out else out


def word_prefixes(path: str) -> WordPrefixes:
    """The worker's own."""
    return worker_state(sys.intern(path), lambda: WordPrefixes(path))


def packed(counts: np.ndarray) -> tuple[int, bytes]:
    """Width in bytes and the steps from count to count, the first from zero."""
    steps = np.diff(counts, prepend=0)
    width = 1 if not len(steps) or np.abs(steps).max() < 128 else 4
    return width, steps.astype(f"<i{width}").tobytes()


def unpacked(width: int, steps: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(steps, f"<i{width}"), dtype=np.int64)


def prefix_counts(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Stretches of docs(doc_id, text) with the token count of every prefix, as a written table.

    `steps` are the differences between the counts of the prefixes that end in the
    stretch, in `width` bytes each; `least` is the lowest of these counts. Positions are in characters (code points).
    """
    path = vocabulary or vocabulary_path("byte_bpe_50k.json")

    def count(batches):
        words, row = word_prefixes(path), TaskContext.get().partitionId() << 33
        for batch in batches:
            for some in slices(batch, "text"):
                texts = some.column("text").to_pylist()
                parts = [words.segments(t or "") for t in texts]
                counted, sizes = words.batch([s for own in parts for s, _ in own])
                out = {name: [] for name in ("row", "doc_id", "part", "last", "start_char", "n_chars", "start_byte", "n_bytes", "start_tokens", "n_tokens", "least", "width", "steps")}
                ends, nth = np.cumsum(sizes), 0
                for doc_id, own in zip(some.column("doc_id").to_pylist(), parts):
                    chars = octets = tokens = 0
                    for part, (text, special) in enumerate(own):
                        here = counted[ends[nth] - sizes[nth]: ends[nth]]
                        nth += 1
                        if special:
                            here[-1] = 1 + (int(here[-1 - special]) if len(here) > special else 0)
                        width, steps = packed(here)
                        size, total = len(text.encode()), int(here[-1]) if len(here) else 0
                        values = (row, doc_id, part, part == len(own) - 1, chars, len(text), octets, size, tokens, total, tokens + int(here.min()) if len(here) else tokens, width, steps)
                        for column, value in zip(out.values(), values):
                            column.append(value)
                        chars, octets, tokens = chars + len(text), octets + size, tokens + total
                    row += 1
                kinds = {"part": pa.int32(), "width": pa.int32(), "last": pa.bool_(), "steps": pa.binary()}
                yield pa.RecordBatch.from_pydict({name: pa.array(values, kinds.get(name, pa.int64())) for name, values in out.items()})

    return written(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(count, PREFIXES), "prefixes")


def token_counts(prefixes: DataFrame) -> DataFrame:
    """row, doc_id, n_chars, n_bytes, n_tokens of whole texts."""
    ends = {n: (F.col(s) + F.col(n)).alias(n) for n, s in (("n_chars", "start_char"), ("n_bytes", "start_byte"), ("n_tokens", "start_tokens"))}
    return prefixes.where("last").select("row", "doc_id", *ends.values())


def longest_prefixes(prefixes: DataFrame, limit: int) -> DataFrame:
    """row, doc_id, keep_chars: the longest prefix of each text that has at most `limit` tokens (0: the empty one)."""

    def look(batches):
        for batch in batches:
            kept = []
            for start, before, least, width, steps in zip(*(batch.column(c).to_pylist() for c in ("start_char", "start_tokens", "least", "width", "steps"))):
                fits = np.flatnonzero(unpacked(width, steps) + before <= limit) if least <= limit else ()
                kept.append(start + int(fits[-1]) + 1 if len(fits) else 0)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(kept, pa.int64())], names=["row", "doc_id", "keep_chars"])

    return prefixes.mapInArrow(look, "row long, doc_id long, keep_chars long").groupBy("row", "doc_id").agg(F.max("keep_chars").alias("keep_chars"))


def tokens_at(prefixes: DataFrame, places: DataFrame) -> DataFrame:
    """places(row, at) with the tokens of the first `at` characters of that row's text; places beyond its end get null."""
    asked = places.select("row", F.col("at").cast("long").alias("at"))
    inside = (F.col("at") > F.col("start_char")) & (F.col("at") <= F.col("start_char") + F.col("n_chars"))
    found = prefixes.join(asked, "row").where(inside | ((F.col("at") == 0) & (F.col("part") == 0)))

    def look(batches):
        for batch in batches:
            counts = []
            for at, start, before, width, steps in zip(*(batch.column(c).to_pylist() for c in ("at", "start_char", "start_tokens", "width", "steps"))):
                counts.append(before + int(np.frombuffer(steps, f"<i{width}")[: at - start].sum(dtype=np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("at"), pa.array(counts, pa.int64())], names=["row", "at", "n_tokens"])

    columns = ("row", "at", "start_char", "start_tokens", "width", "steps")
    known = found.select(*columns).mapInArrow(look, "row long, at long, n_tokens long").distinct()
    return asked.join(known, ["row", "at"], "left")


def op13_prefix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = token_counts(prefix_counts(table(spark, sf_dir, "documents", "doc_id", "text")))
    return totals.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
