"""Quality rules: counted base rules, and perplexity under an n-gram model with a band per language.

The model is a modified Kneser-Ney model over the characters of words. Word
n-grams would need a table as large as the corpus; the characters of a word after
up to four before it (four starts in front of a word, one end behind it) need one
that grows slowly, serve every language alike and give a word the same score
wherever it stands, so a worker scores a distinct word once.

* Counting. All texts that pass the base rules and are not rich in symbols count. A task interns its words, counts them, and sends the 5-grams of its
  distinct words with their counts; Spark adds them up. An n-gram is one long:
  12 bits per character (code points from 4,096 on folded into the upper half).
* Estimating. Lower orders count distinct left neighbours (n-grams at a word's start
  keep their raw counts), each order has its three discounts from the numbers of
  n-grams seen one to four times, and probabilities are interpolated: a join with
  the context's totals and one with the next lower order, for each order.
* Scoring. The tables go to the workers as sorted arrays of keys beside arrays of
  log probabilities and log back-off weights, 12 bytes an entry. The order is the same
  for every input, so scores do not hang on its size; the tables grow with the 5-grams
  of distinct words (README), far slower than the texts.
* Bands. Log perplexity (nats a character) of the documents that pass the base
  rules: per language the median and the spreads to the 16th and 84th percentile.
  A document is rejected above median + BAND spreads or below median - BAND spreads,
  a spread of its own added for short texts, as means of few characters vary more.
  Languages with under BAND_DOCS such documents share one band of all documents.

Defined cases: a null text has no words; a text without words has no perplexity and
fails the base rules; a null language is a language of its own; repeated rows are
judged each; an empty table gives no rows. Input columns pass through unchanged.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import WORDS_KEPT, Interned, as_bytes, checked_broadcast, drop_worker_state, free_name, slices, split_batch, sums_by, worker_state, written

ORDER = 5
SYMBOL_BITS = 12
START, END = 1, 2
BAND = 6.0
BAND_FLOOR = 0.02
BAND_DOCS = 100
SHORT_SPREAD = 1.0
WINDOW = 8
#: Words worked on at once.
BLOCK = 50_000
SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
#: Texts with a larger share of SYMBOLS are scored but not learnt from.
MODEL_SYMBOL_PERCENT = 1

MEASURES = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "log_p": "double", "n_scored": "long"}


class Model(NamedTuple):
    """Per order (1 first): sorted keys and log probabilities; sorted contexts and log weights of the next lower order."""

    keys: list[np.ndarray]
    log_p: list[np.ndarray]
    contexts: list[np.ndarray]
    weights: list[np.ndarray]
    unseen: float


def word_grams(words: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of the given order at every character and the end of each word, and how many each word has."""
    texts = [w.decode() for w in words]
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    half = 1 << (SYMBOL_BITS - 1)
    points = np.where(points < 2 * half, np.maximum(points, END + 1), half + points % half)
    # each word as order - 1 starts, its characters, an end
    pad = order - 1
    span = lengths + pad + 1
    ends = np.cumsum(span)
    symbols = np.full(int(span.sum()), START, np.int64)
    symbols[ends - 1] = END
    places = np.arange(len(points)) + np.repeat((ends - span + pad) - (np.cumsum(lengths) - lengths), lengths)
    symbols[places] = points
    grams = np.zeros(len(symbols), np.int64)
    for back in range(order):
        grams[back:] |= symbols[: len(symbols) - back] << (SYMBOL_BITS * back)
    real = np.ones(len(symbols), bool)
    for i in range(pad):
        real[ends - span + i] = False
    return grams[real], lengths + 1


def chars_and_symbols(word: bytes) -> tuple[int, int]:
    return len(word.decode()), len(word) - len(word.translate(None, SYMBOLS))


def gram_counts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """gram, n over all texts that pass the base rules and hold few symbols."""

    def count(batches):
        def added():
            """The n-grams so far, a block of words at a time."""
            known = list(words)
            keys, sums = found
            for start in range(0, len(known), BLOCK):
                grams, own = word_grams(known[start: start + BLOCK], order)
                weights = np.repeat(totals[start: start + BLOCK][: len(own)], own)
                grams, weights = np.concatenate((keys, grams[weights > 0])), np.concatenate((sums, weights[weights > 0]))
                keys, place = np.unique(grams, return_inverse=True)
                sums = np.bincount(place, weights=weights, minlength=len(keys)).astype(np.int64)
            return keys, sums

        drop_worker_state()
        found = np.zeros(0, np.int64), np.zeros(0, np.int64)
        words, totals, marks = Interned(), np.zeros(0, np.int64), np.zeros((0, 2), np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                split, counts = split_batch(as_bytes(part.column("text")))
                numbers = words.numbers(split)
                marks = np.concatenate((marks, [chars_and_symbols(w) for w in words.fresh])) if words.fresh else marks
                words.fresh = []
                chars, symbols = (sums_by(marks[numbers, i], counts) for i in (0, 1))
                good = (counts >= MIN_WORDS) & (100 * repeated_words(numbers, counts) <= MAX_REPEAT_PERCENT * counts) & (100 * symbols <= MODEL_SYMBOL_PERCENT * chars)
                numbers = numbers[np.repeat(good, counts)]
                more = np.bincount(numbers, minlength=max(len(totals), len(words)))
                more[: len(totals)] += totals
                totals = more
                if len(words) > WORDS_KEPT:
                    found = added()
                    words, totals, marks = Interned(), np.zeros(0, np.int64), np.zeros((0, 2), np.int64)
        keys, sums = added()
        for start in range(0, len(keys), BLOCK):
            yield pa.RecordBatch.from_arrays([pa.array(keys[start: start + BLOCK]), pa.array(sums[start: start + BLOCK])], names=["gram", "n"])

    return docs.select("text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _discounts(table: DataFrame) -> list[float]:
    """Of n-grams counted once, twice, and more often."""
    seen = {int(r.c): r.n for r in table.where("c <= 4").groupBy("c").agg(F.count("*").alias("n")).collect()}
    n1, n2, n3, n4 = (seen.get(i, 0) for i in (1, 2, 3, 4))
    if not (n1 and n2 and n3 and n4):
        return [0.5, 0.75, 0.9]  # too few n-grams to estimate from
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return [min(max(d, 0.05), i + 0.95) for i, d in enumerate(raw)]


def estimate(docs: DataFrame, order: int = ORDER) -> Model:
    """The model of all texts of docs(text), of this order whatever their number."""
    mask = lambda n: (1 << (SYMBOL_BITS * n)) - 1
    top = gram_counts(docs, order).withColumnRenamed("n", "raw")
    tables = {order: written(top.withColumn("c", F.col("raw")), "kn")}
    for n in range(order - 1, 0, -1):
        gram = F.col("gram").bitwiseAND(F.lit(mask(n)))
        starts = F.shiftright("gram", SYMBOL_BITS * (n - 1)) == START
        below = tables[n + 1].groupBy(gram.alias("gram")).agg(F.sum("raw").alias("raw"), F.count("*").alias("c"))
        tables[n] = written(below.withColumn("c", F.when(starts, F.col("raw")).otherwise(F.col("c"))), "kn")
    keys, logs, contexts, weights = [], [], [], []
    lower, unseen = None, 0.0
    for n in range(1, order + 1):
        d1, d2, d3 = _discounts(tables[n])
        context = F.shiftright("gram", SYMBOL_BITS)
        once, twice = F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)
        more = F.count_if(F.col("c") > 2)
        per_context = tables[n].groupBy(context.alias("context")).agg(F.sum("c").alias("total"), (once * d1 + twice * d2 + more * d3).alias("held"))
        per_context = per_context.select("context", "total", (F.col("held") / F.col("total")).alias("weight"))
        kept = F.col("c") - F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        joined = tables[n].withColumn("context", context).join(per_context, "context")
        if lower is None:
            symbols = tables[n].count() + 1
            held = per_context.first()
            unseen = (held.weight if held else 1.0) / symbols
            lower = joined.select("gram", (kept / F.col("total") + F.col("weight") / symbols).alias("p"))
        else:
            suffix = F.col("gram").bitwiseAND(F.lit(mask(n - 1)))
            below = lower.select(F.col("gram").alias("suffix"), F.col("p").alias("below"))
            lower = joined.withColumn("suffix", suffix).join(below, "suffix").select("gram", (kept / F.col("total") + F.col("weight") * F.col("below")).alias("p"))
        lower = written(lower, "kn")
        for frame, at, values, column in ((lower, keys, logs, "p"), (per_context.withColumnRenamed("context", "gram"), contexts, weights, "weight")):
            rows = frame.select("gram", F.log(column).cast("float").alias("x")).toArrow()  # of distinct n-grams, not of texts
            key = rows.column("gram").to_numpy()
            rank = np.argsort(key)
            at.append(key[rank])
            values.append(rows.column("x").to_numpy()[rank])
    return Model(keys, logs, contexts, weights, float(np.log(unseen)))


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return at, keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)


def score(words: list[bytes], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Log probability of each word (its characters and its end) and how many factors that has."""
    order = len(model.keys)
    grams, own = word_grams(words, max(order, 1))
    grams, place = np.unique(grams, return_inverse=True)
    log_p = np.zeros(len(grams))
    todo = np.arange(len(grams))
    for n in range(order, 0, -1):
        wanted = grams[todo] & ((1 << (SYMBOL_BITS * n)) - 1)
        at, hit = _found(model.keys[n - 1], wanted)
        log_p[todo[hit]] += model.log_p[n - 1][at[hit]]
        todo, wanted = todo[~hit], wanted[~hit]
        if n > 1:
            at, hit = _found(model.contexts[n - 1], wanted >> SYMBOL_BITS)
            log_p[todo[hit]] += model.weights[n - 1][at[hit]]
    log_p[todo] += model.unseen
    return sums_by(log_p[place], own), own


class Scorer:
    """A worker's words with their scores, lengths and symbols."""

    def __init__(self, parts: tuple):
        self.model = Model(*parts)
        self.forget()

    def forget(self) -> None:
        self.words = Interned()
        self.log_p, self.scored, self.chars, self.symbols = np.zeros(0), *(np.zeros(0, np.int64) for _ in range(3))

    def numbers(self, words: list[bytes]) -> np.ndarray:
        if len(self.words) > WORDS_KEPT:
            self.forget()
        numbers = self.words.numbers(words)
        if fresh := self.words.fresh:
            self.words.fresh = []
            parts = [score(fresh[i: i + BLOCK], self.model) for i in range(0, len(fresh), BLOCK)]
            log_p, scored = (np.concatenate(x) for x in zip(*parts))
            chars, symbols = np.array([chars_and_symbols(w) for w in fresh], np.int64).T
            for name, values in (("log_p", log_p), ("scored", scored), ("chars", chars), ("symbols", symbols)):
                setattr(self, name, np.concatenate((getattr(self, name), values)))
        return numbers


def repeated_words(numbers: np.ndarray, counts: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Per text: words inside windows that occur twice or more in it."""
    n = len(numbers)
    if n < window:
        return np.zeros(len(counts), np.int64)
    with np.errstate(over="ignore"):
        mixed = (numbers.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
        hashed = np.zeros(n - window + 1, np.uint64)
        for i in range(window):
            hashed = hashed * np.uint64(0xD6E8FEB86659FD93) + mixed[i: n - window + 1 + i]
        text = np.repeat(np.arange(len(counts), dtype=np.uint64), counts)[: n - window + 1]
        hashed ^= text * np.uint64(0x94D049BB133111EB)
    left = np.repeat(np.cumsum(counts), counts)[: n - window + 1] - np.arange(n - window + 1)
    starts = np.flatnonzero(left >= window)
    hashed = hashed[starts]
    ordered = np.sort(hashed)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    inside = np.zeros(n + 1, np.int64)
    if len(twice):
        again = starts[_found(twice, hashed)[1]]
        inside[again] += 1
        inside[again + window] -= 1
    return sums_by((np.cumsum(inside)[:n] > 0).astype(np.int64), counts)


def duplicate_lines(text: bytes | None) -> int:
    if not text or b"\n" not in text:
        return 0
    lines = [line for line in text.split(b"\n") if line and not line.isspace()]
    return len(lines) - len(set(lines))


def measured(docs: DataFrame, model: Model) -> tuple[DataFrame, dict[str, str]]:
    """docs with the measures of `text` added, and the measures' column names (free ones)."""
    names = {m: free_name(docs, m) for m in MEASURES}
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), *(f"`{names[m]}` {t}" for m, t in MEASURES.items())])
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))

    def measure(batches):
        scorer = worker_state(shared.value, lambda: Scorer(shared.value))
        for batch in batches:
            for part in slices(batch, "text"):
                texts = as_bytes(part.column("text"))
                words, counts = split_batch(texts)
                numbers = scorer.numbers(words)
                values = [counts, sums_by(scorer.chars[numbers], counts), sums_by(scorer.symbols[numbers], counts),
                          np.fromiter(map(duplicate_lines, texts), np.int64, len(texts)), repeated_words(numbers, counts),
                          sums_by(scorer.log_p[numbers], counts), sums_by(scorer.scored[numbers], counts)]
                yield pa.RecordBatch.from_arrays([*part.columns, *map(pa.array, values)], names=[*part.schema.names, *names.values()])

    return docs.mapInArrow(measure, schema), names


def failed(names: dict[str, str]):
    """The base rules: too few words, or too many in repeated windows."""
    return (F.col(names["n_words"]) < MIN_WORDS) | (100 * F.col(names["n_repeat_words"]) > MAX_REPEAT_PERCENT * F.col(names["n_words"]))


def perplexity(names: dict[str, str]):
    """Natural logarithm of the perplexity per character."""
    return F.when(F.col(names["n_scored"]) > 0, -F.col(names["log_p"]) / F.col(names["n_scored"]))


def bands(measures: DataFrame, names: dict[str, str], lang: str = "lang") -> DataFrame:
    """language (null: all), low, high from all documents that pass the base rules."""
    rows = measures.where(~failed(names)).select(F.coalesce(lang, F.lit("")).alias("language"), perplexity(names).alias("x"))
    spread = lambda df: df.agg(F.percentile_approx("x", [0.16, 0.5, 0.84], 1000).alias("q"), F.count("*").alias("n"))
    own = spread(rows.groupBy("language")).where(F.col("n") >= BAND_DOCS)
    every = spread(rows.groupBy()).withColumn("language", F.lit(None).cast("string")).select("language", "q", "n")
    step = lambda a, b: F.greatest(F.col("q")[b] - F.col("q")[a], F.lit(BAND_FLOOR))
    return own.unionByName(every).where("q IS NOT NULL").select(
        "language", (F.col("q")[1] - BAND * step(0, 1)).alias("low"), (F.col("q")[1] + BAND * step(1, 2)).alias("high"))


def judged(measures: DataFrame, names: dict[str, str], band: DataFrame, base_failed: str, kept: str, lang: str = "lang") -> DataFrame:
    """Adds the two verdicts."""
    band = written(band, "bands")
    own = checked_broadcast(band.where("language IS NOT NULL").select(F.col("language").alias("__language"), F.struct("low", "high").alias("__own")))
    every = band.where("language IS NULL").select("low", "high").head()
    low, high = (every.low, every.high) if every else (None, None)
    joined = measures.join(own, F.coalesce(measures[lang], F.lit("")) == F.col("__language"), "left")
    slack = SHORT_SPREAD / F.sqrt(F.greatest(names["n_scored"], F.lit(1)))
    x = perplexity(names)
    inside = x.between(F.coalesce("__own.low", F.lit(low).cast("double")) - slack, F.coalesce("__own.high", F.lit(high).cast("double")) + slack)
    return joined.withColumn(base_failed, failed(names)).withColumn(kept, ~failed(names) & F.coalesce(inside, F.lit(False))).drop("__own", "__language")


def quality(docs: DataFrame, store: bool = False) -> tuple[DataFrame, dict[str, str], str, str]:
    """docs(text, lang, ...) with measures and verdicts; names of the measures and the verdicts.

    With `store` the measured rows are written once and read twice (rows without their text);
    else texts are measured a second time rather than written.
    """
    model = estimate(docs)
    rows, names = measured(docs, model)
    if store:
        rows = written(rows.drop("text"), "measures")
        narrow = rows
    else:
        narrow, _ = measured(docs.select("text", "lang"), model)
        narrow = written(narrow.drop("text"), "measures")
    own = dict(names) if store else {m: m for m in MEASURES}
    base_failed, kept = free_name(rows, "base_failed"), free_name(rows, "kept")
    return judged(rows, names, bands(narrow, own), base_failed, kept), names, base_failed, kept


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that pass, their columns unchanged."""
    rows, _, _, kept = quality(docs)
    return rows.where(kept).select(*docs.columns)


def op3_quality_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long"), "text", "lang")
    rows, names, base_failed, kept = quality(docs, store=True)
    measures = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return rows.select("doc_id", *(F.col(names[m]).alias(m) for m in measures), F.col(base_failed).alias("base_failed"), F.col(kept).alias("kept"),
                       perplexity(names).alias("log_perplexity"))
