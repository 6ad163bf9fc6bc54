"""Language by cross-parsing entropy over suffix automata.

Learning. Labelled texts give the words of each language; a word counts for the
languages in which it is at least OWN_SHARE as frequent as where it is most
frequent, so passages in another language do no harm. The most frequent words of a
language, LETTERS letters of all languages together, are strung together with
spaces, and a suffix automaton of that string recognises every piece of them. The
sample of labelled texts is bounded: per language about SAMPLE_CHARS characters, picked by
a hash of doc_id; an automaton is bounded by LETTERS.

Predicting. A word with a space on either side is parsed greedily into the longest
pieces that the automaton knows (an unknown character is a phrase of its own). A
text's phrases are the sum over its words, per letter they are its cross-parsing
entropy, and the language with the fewest wins (ties: the first by code point). As
parsing starts afresh at each word, a worker parses a distinct word once. The score
is 1 - fewest / mean of all languages.

Defined cases: a text that is null or has no letter is `und` with score 0, as is any
text if no language was learned; one learned language always wins with score 0; null
labels aren't learned from; repeated rows are judged each; an empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import WORDS_KEPT, Interned, as_bytes, checked_broadcast, slices, split_batch, sums_by, worker_state, written

SAMPLE_CHARS = 1_500_000
LETTERS = 400_000
OWN_SHARE = 0.3
NOT_LETTERS = re.compile(r"[\W\d_]+")
UNKNOWN = "und"
SHIFT = 21  # bits of a code point


def letters_only(word: bytes) -> list[str]:
    return [w for w in NOT_LETTERS.split(word.decode().lower()) if w]


class Automaton:
    """Suffix automaton of one string: one dictionary from (state, character) to state, for exact longest matches."""

    def __init__(self, text: str):
        link, length, arcs = [-1], [0], [{}]
        last = 0
        for c in text:
            new = len(arcs)
            arcs.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p != -1 and c not in arcs[p]:
                arcs[p][c] = new
                p = link[p]
            if p != -1:
                q = arcs[p][c]
                if length[p] + 1 == length[q]:
                    link[new] = q
                else:
                    clone = len(arcs)
                    arcs.append(dict(arcs[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p != -1 and arcs[p].get(c) == q:
                        arcs[p][c] = clone
                        p = link[p]
                    link[q] = link[new] = clone
            last = new
        self.keys = np.array([s << SHIFT | ord(c) for s, own in enumerate(arcs) for c in own], np.int64)
        self.to = np.array([t for own in arcs for t in own.values()], np.int64)

    def table(self) -> dict[int, int]:
        return dict(zip(self.keys.tolist(), self.to.tolist()))


def phrases(word: str, arcs: dict[int, int]) -> int:
    """Pieces of the greedy parse of a word between spaces."""
    state, count = 0, 1
    for c in map(ord, f" {word} "):
        to = arcs.get(state << SHIFT | c)
        if to is None:
            count += state != 0
            to = arcs.get(c)
            if to is None:
                count += 1
                to = 0
        state = to
    return count - (state == 0)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def learn(labelled: DataFrame, sample_chars: int = SAMPLE_CHARS, letters: int = LETTERS) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """Per language of labelled(doc_id, text, lang): its automaton."""
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = written(rows.groupBy("lang").agg(F.sum(F.length("text")).alias("chars")), "languages")
    # the hash decides, so that each language brings about sample_chars characters
    rate = F.least(F.lit(1.0), F.lit(float(sample_chars)) / F.greatest("chars", F.lit(1)))
    chosen = sizes.select(F.col("lang").alias("__lang"), rate.alias("__rate"))
    chance = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 20)) / float(1 << 20)
    sample = rows.join(checked_broadcast(chosen), F.col("lang") == F.col("__lang")).where(chance < F.col("__rate")).select("lang", "text")

    def count(batches):
        counts: dict[tuple[str, str], int] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), as_bytes(batch.column("text"))):
                for chunk in text.split():
                    for word in letters_only(chunk):
                        counts[lang, word] = counts.get((lang, word), 0) + 1
        yield pa.RecordBatch.from_pydict({"lang": pa.array([k[0] for k in counts], pa.string()), "word": pa.array([k[1] for k in counts], pa.string()), "n": pa.array(list(counts.values()), pa.int64())})

    words = written(sample.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    rates = words.join(checked_broadcast(totals), "lang").withColumn("rate", F.col("n") / F.col("total"))
    best = rates.groupBy("word").agg(F.max("rate").alias("best"))
    own = rates.join(best, "word").where(F.col("rate") >= OWN_SHARE * F.col("best")).select("lang", "word", "n")
    collected = own.toArrow().to_pylist()  # words of the bounded sample
    by_lang: dict[str, list] = {}
    for row in collected:
        by_lang.setdefault(row["lang"], []).append((-row["n"], row["word"]))
    out = []
    for lang in sorted(by_lang):
        kept, room = [], letters // len(by_lang)
        for _, word in sorted(by_lang[lang]):
            room -= len(word) + 1
            if room < 0:
                break
            kept.append(word)
        automaton = Automaton(f" {' '.join(kept)} ")
        out.append((lang, automaton.keys, automaton.to))
    return out


class Parser:
    """A worker's automata and the phrases and letters of the words it has met."""

    def __init__(self, model: list):
        self.tables = [dict(zip(keys.tolist(), to.tolist())) for _, keys, to in model]
        self.forget()

    def forget(self) -> None:
        self.words = Interned()
        self.seen: dict[str, list[int]] = {}
        self.values = np.zeros((0, len(self.tables) + 1), np.int64)  # phrases per language, letters

    def numbers(self, words: list[bytes]) -> np.ndarray:
        if len(self.words) > WORDS_KEPT:
            self.forget()
        numbers = self.words.numbers(words)
        if fresh := self.words.fresh:
            self.words.fresh = []
            rows = []
            for word in fresh:
                row = [0] * (len(self.tables) + 1)
                for part in letters_only(word):
                    own = self.seen.get(part)
                    if own is None:
                        own = self.seen[part] = [*(phrases(part, t) for t in self.tables), len(part)]
                    row = [a + b for a, b in zip(row, own)]
                rows.append(row)
            self.values = np.concatenate((self.values, np.array(rows, np.int64)))
        return numbers


def predict(docs: DataFrame, model: list) -> DataFrame:
    """docs(doc_id, text) as doc_id, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = np.array([m[0] for m in model] or [UNKNOWN], object)

    def run(batches):
        parser = worker_state(shared.value, lambda: Parser(shared.value))
        for batch in batches:
            for part in slices(batch, "text"):
                words, counts = split_batch(as_bytes(part.column("text")))
                values = parser.values[numbers] if len(numbers := parser.numbers(words)) else np.zeros((0, len(model) + 1), np.int64)
                sums = np.stack([sums_by(values[:, i], counts) for i in range(values.shape[1])], 1)
                known = (sums[:, -1] > 0) & (len(model) > 0)
                costs = sums[:, :-1] if len(model) else np.ones((len(counts), 1), np.int64)
                best = costs.argmin(1)
                mean = costs.mean(1)
                score = np.where(known, 1 - costs.min(1) / np.maximum(mean, 1e-9), 0.0)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.where(known, names[best], UNKNOWN), pa.string()), pa.array(np.clip(score, 0, 1))], names=["doc_id", "lang_pred", "score"])

    return docs.mapInArrow(run, "doc_id long, lang_pred string, score double")


def op8_language_cross_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long"), "text", "lang")
    model = learn(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
