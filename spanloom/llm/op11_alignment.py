"""Alignment of two tokenizers over whole texts by products of sparse incidence matrices.

For a run of text A has a row per token of the first vocabulary and a column per byte, B the
same for the second. Both are held in compressed rows (`Csr`, built by hand from the
tokens' ends), and Gustavson's row products of A and the transpose of B leave an entry for
each pair of tokens that overlap: the overlap links, with the bytes they share. Bytes
where tokens of both end cut the tokens into groups; the product of the two token-group
matrices has an entry for each pair of tokens of one group: the shared-group links.

Texts are a space and the text, cut into units (`units`) at which both vocabularies begin
anew, so matrices are made for the distinct units of a worker, all new ones of a run of
texts in one product, and a text adds up those of its units.

Two passes. The first keeps for each text its counts, the hash of its groups and its
distinct links with their times as a table. Then Spark counts in how many
documents each pair of ids is linked, and the second pass adds the counts up. Up to
LOOKUP pairs the counts go to every worker as sorted arrays, beyond it links and counts are joined by shuffle; the results are the same.

Defined cases: texts that are null, empty, or whose tokens' bytes are not the text's have
no tokens: zeros, and an empty hash; they count in no pair. Rows that repeat are documents
each. An empty table gives no rows.
"""

from __future__ import annotations

import array
import hashlib
import os
import sys
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.llm.common import slices, table, worker_state, written
from spanloom.llm.tokens import byte_letters, vocabulary_path
from spanloom.llm.units import Units, gathered, stretches

#: Distinct units a worker keeps; beyond it only those used often, half as many at most.
KEPT = 500_000
#: Characters of text worked on at once.
RUN = 4 << 20
#: Pairs whose counts may go to every worker: 17 bytes each.
LOOKUP = 4_000_000
#: Pairs a counting task holds before it hands them on.
HELD = 2_000_000
COUNTS = ("n_a", "n_b", "n_groups", "n_links", "n_shared")
ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_shared long, groups_sha256 string, links binary, times binary"


class Csr(NamedTuple):
    """A matrix of zeros and ones in compressed rows."""

    starts: np.ndarray  # of each row in columns, and the end
    columns: np.ndarray
    width: int

    @staticmethod
    def of_ends(ends: np.ndarray) -> Csr:
        """Rows of consecutive columns, up to these ends."""
        width = int(ends[-1]) if len(ends) else 0
        return Csr(np.concatenate(([0], ends)), np.arange(width), width)

    @staticmethod
    def of_single(columns: np.ndarray, width: int) -> Csr:
        """One entry a row."""
        return Csr(np.arange(len(columns) + 1), columns, width)

    def rows(self) -> np.ndarray:
        """The row of each entry."""
        return np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))

    def transposed(self) -> Csr:
        order = np.argsort(self.columns, kind="stable")
        sizes = np.bincount(self.columns, minlength=self.width)
        return Csr(np.concatenate(([0], np.cumsum(sizes))), self.rows()[order], len(self.starts) - 1)

    def times(self, other: Csr) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Gustavson: each entry of a row brings in the other's row of that column, sums per row. Row, column and value of all entries."""
        first = other.starts[self.columns]
        sizes = other.starts[self.columns + 1] - first
        columns = other.columns[gathered(first, sizes)]
        places, values = np.unique(np.repeat(self.rows(), sizes) * max(other.width, 1) + columns, return_counts=True)
        return places // max(other.width, 1), places % max(other.width, 1), values


class Aligned(NamedTuple):
    """Tokens of units side by side: ends in bytes, units of tokens, and the links between rows of both."""

    group_a: np.ndarray
    group_b: np.ndarray
    overlap: tuple[np.ndarray, np.ndarray, np.ndarray]
    shared: tuple[np.ndarray, np.ndarray, np.ndarray]


def align(sizes_a: np.ndarray, sizes_b: np.ndarray) -> Aligned:
    """Links between two cuts of the same bytes, from the sizes of the tokens."""
    ends_a, ends_b = np.cumsum(sizes_a), np.cumsum(sizes_b)
    overlap = Csr.of_ends(ends_a).times(Csr.of_ends(ends_b).transposed())
    common = np.intersect1d(ends_a, ends_b)
    group_a, group_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
    shared = Csr.of_single(group_a, len(common)).times(Csr.of_single(group_b, len(common)).transposed())
    return Aligned(group_a, group_b, overlap, shared)


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        byte_of = {letter: byte for byte, letter in enumerate(byte_letters())}
        known = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(known.values()) + 1)
        for token, i in self.a.get_vocab(with_added_tokens=False).items():
            self.bytes_a[i] = bytes(byte_of[c] for c in token)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.n_b = len(pieces)
        self.sizes_a, self.sizes_b = (np.array(list(map(len, spelling)), np.int64) for spelling in (self.bytes_a, self.bytes_b))
        self.units = Units()
        self.texts: list[str] = []
        self.sound = array.array("b")
        self.counts = {name: array.array("i") for name in COUNTS}
        self.links, self.bounds = array.array("I"), array.array("q", [0])

    def forget(self) -> None:
        """Makes room: units used often stay."""
        kept = self.units.keep_used(KEPT // 2)
        self.texts = [self.texts[i] for i in kept.tolist()]
        self.sound = array.array("b", np.frombuffer(self.sound, np.int8)[kept].tobytes())
        self.counts = {name: array.array("i", np.frombuffer(values, np.int32)[kept].tobytes()) for name, values in self.counts.items()}
        bounds = np.frombuffer(self.bounds, np.int64)
        sizes = bounds[kept + 1] - bounds[kept]
        self.links = array.array("I", np.frombuffer(self.links, np.uint32)[gathered(bounds[kept], sizes)].tobytes())
        del bounds
        self.bounds = array.array("q", np.concatenate(([0], np.cumsum(sizes))).tobytes())

    def _learn(self, units: list[str]) -> None:
        """Matrices of units that are new, in one product."""
        ids_a = [e.ids for e in self.a.encode_batch_fast(units, add_special_tokens=False)]
        ids_b = self.b.encode([u[1:] for u in units], num_threads=1)  # it adds the space
        octets = [u.encode() for u in units]
        sound = self._sound(octets, ids_a, ids_b)
        self.sound.extend(sound)
        if not all(sound):
            ids_a, ids_b = ([own if good else [] for own, good in zip(ids, sound)] for ids in (ids_a, ids_b))
        n_a, n_b = (np.fromiter(map(len, ids), np.int64, len(ids)) for ids in (ids_a, ids_b))
        flat_a, flat_b = (list(chain.from_iterable(ids)) for ids in (ids_a, ids_b))
        found = align(self.sizes_a[np.array(flat_a, np.int64)], self.sizes_b[np.array(flat_b, np.int64)])
        unit_of = np.repeat(np.arange(len(units)), n_a)
        per_unit = [n_a, n_b, np.zeros(len(units), np.int64), *(np.bincount(unit_of[product[0]], minlength=len(units)) for product in (found.overlap, found.shared))]
        np.maximum.at(per_unit[2], unit_of, found.group_a + 1)
        last = np.maximum.accumulate(per_unit[2]) if len(units) else per_unit[2]
        per_unit[2] = np.diff(last, prepend=0)
        for name, values in zip(COUNTS, per_unit):
            self.counts[name].frombytes(values.astype(np.int32).tobytes())
        row, column, _ = found.overlap
        keys = np.array(flat_a, np.int64)[row] * self.n_b + np.array(flat_b, np.int64)[column]
        self.links.frombytes(keys.astype(np.uint32).tobytes())
        self.bounds.extend((self.bounds[-1] + np.cumsum(per_unit[3])).tolist())
        self.texts += self._spelled(flat_a, flat_b, found, per_unit[2])

    def _sound(self, octets: list[bytes], ids_a: list[list[int]], ids_b: list[list[int]]) -> list[bool]:
        """Which units the tokens of both sides spell: all at once, or else one by one."""
        whole = b"".join(octets)
        ends = np.cumsum(np.fromiter(map(len, octets), np.int64, len(octets)))
        for ids, spelling, sizes in ((ids_a, self.bytes_a, self.sizes_a), (ids_b, self.bytes_b, self.sizes_b)):
            flat = list(chain.from_iterable(ids))
            at = np.concatenate(([0], np.cumsum(sizes[np.array(flat, np.int64)])))[np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))]
            if (at != ends).any() or b"".join(map(spelling.__getitem__, flat)) != whole:
                break
        else:
            return [True] * len(octets)
        return [b"".join([self.bytes_a[t] for t in a]) == octet == b"".join([self.bytes_b[t] for t in b]) for octet, a, b in zip(octets, ids_a, ids_b)]

    @staticmethod
    def _spelled(flat_a, flat_b, found: Aligned, n_groups: np.ndarray) -> list[str]:
        """The groups of each unit as text: ids of both sides, `a,a|b;a|b,b`."""
        a, b = list(map(str, flat_a)), list(map(str, flat_b))
        total = int(n_groups.sum())
        cuts_a, cuts_b = (np.searchsorted(g, np.arange(total + 1)).tolist() for g in (found.group_a, found.group_b))
        groups = [
            f"{a[i]}|{b[k]}" if j - i == 1 == m - k else f"{','.join(a[i:j])}|{','.join(b[k:m])}"
            for i, j, k, m in zip(cuts_a, cuts_a[1:], cuts_b, cuts_b[1:])
        ]
        ends = np.cumsum(n_groups).tolist()
        return [";".join(groups[i:j]) for i, j in zip([0, *ends], ends)]

    def batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the units of a space and each text, and how many each has."""
        if len(self.units) > KEPT:
            self.forget()
        numbers, counts = self.units.batch(texts, spaced=True)
        if self.units.fresh:
            self._learn(self.units.fresh)
            self.units.fresh = []
        return numbers, counts


def aligner(path_a: str, path_b: str) -> Aligner:
    """The worker's own."""
    return worker_state(sys.intern(f"{path_a} {path_b}"), lambda: Aligner(path_a, path_b))


def _runs(texts: list[str | None], size: int = RUN):
    """(texts' numbers, stretches) of `size` characters at most, or one stretch; null and empty texts have none."""
    of, some, held = [], [], 0
    for i, text in enumerate(texts):
        for k, stretch in enumerate(stretches(text) if text else ()):
            if held and held + len(stretch) > size:
                yield of, some
                of, some, held = [], [], 0
            of.append(i)
            some.append(stretch[1:] if k else stretch)
            held += len(stretch)
    if of:
        yield of, some


def _aligned(found: Aligner, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[str], list[bytes], list[bytes]]:
    """Counts per text, hashes, links and their times."""
    totals = np.zeros((len(COUNTS), len(texts)), np.int64)
    sound = np.array([bool(t) for t in texts])
    hashes = [None] * len(texts)
    places, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for of, some in _runs(texts):
        numbers, counts = found.batch(some)
        ends = np.cumsum(counts)
        text_of = np.repeat(np.array(of), counts)
        for k, name in enumerate(COUNTS):
            totals[k] += np.bincount(text_of, weights=np.frombuffer(found.counts[name], np.int32)[numbers], minlength=len(texts)).astype(np.int64)
        np.logical_and.at(sound, text_of, np.frombuffer(found.sound, np.int8)[numbers].astype(bool))
        listed = numbers.tolist()
        for i, start, end in zip(of, [0, *ends.tolist()], ends.tolist()):
            spelled = ";".join(map(found.texts.__getitem__, listed[start:end])).encode()
            if hashes[i] is None:
                hashes[i] = hashlib.sha256(spelled)
            else:
                hashes[i].update(b";" + spelled)
        bounds = np.frombuffer(found.bounds, np.int64)
        sizes = bounds[numbers + 1] - bounds[numbers]
        keys = np.frombuffer(found.links, np.uint32)[gathered(bounds[numbers], sizes)].astype(np.int64)
        # text and pair in one number: pairs take 32 bits at most, see `align_documents`
        own, n = np.unique((np.repeat(text_of, sizes) << 32) + keys, return_counts=True)
        places, at = np.unique(np.concatenate((places, own)), return_inverse=True)
        times = np.bincount(at, weights=np.concatenate((times, n)), minlength=len(places)).astype(np.int64)
        del bounds
    keep = sound[places >> 32]
    places, times = places[keep], times[keep]
    cuts = np.searchsorted(places, np.arange(len(texts) + 1) << 32).tolist()
    keys, times = (places & 0xFFFFFFFF).astype("<u4"), times.astype("<u4")
    totals[:, ~sound] = 0
    return (totals, sound, [h.hexdigest() if h and s else "" for h, s in zip(hashes, sound)],
            [keys[i:j].tobytes() for i, j in zip(cuts, cuts[1:])], [times[i:j].tobytes() for i, j in zip(cuts, cuts[1:])])


def align_documents(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """Per row of docs(doc_id, text): counts, hash of the groups, distinct links (id of A x size of B's vocabulary + id of B, 4 bytes each, ascending) and their times, as a written table."""
    path_a, path_b = path_a or vocabulary_path("byte_bpe_50k.json"), path_b or vocabulary_path("piece_bpe_32k.model")
    one = Aligner(path_a, path_b)
    if len(one.bytes_a) * one.n_b > 1 << 32:
        raise ValueError("pairs of these vocabularies do not fit in 32 bits")

    def add(batches):
        found, row = aligner(path_a, path_b), TaskContext.get().partitionId() << 33
        for batch in batches:
            for some in slices(batch, "text"):
                totals, _, hashes, links, times = _aligned(found, some.column("text").to_pylist())
                rows = np.arange(row, row + len(some))
                row += len(some)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows), some.column("doc_id"), *map(pa.array, totals), pa.array(hashes, pa.string()), pa.array(links, pa.binary()), pa.array(times, pa.binary())],
                    names=["row", "doc_id", *COUNTS, "groups_sha256", "links", "times"])

    return written(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(add, ALIGNED), "aligned")


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a column of 4-byte lists in a row, and how many each list has."""
    lists = column.to_pylist()
    return np.frombuffer(b"".join(lists), "<u4").astype(np.int64), np.array([len(x) // 4 for x in lists], np.int64)


def pair_counts(aligned: DataFrame, n_b: int) -> DataFrame:
    """pair, n (documents that hold it linked), best (no pair of its A id has more), as a written table."""

    def count(batches):
        keys, n = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def rows():
            for start in range(0, len(keys), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(keys[start: start + (1 << 16)]), pa.array(n[start: start + (1 << 16)])], names=["pair", "n"])

        for batch in batches:
            more = _flat(batch.column("links"))[0]
            keys, at = np.unique(np.concatenate((keys, more)), return_inverse=True)
            n = np.bincount(at, weights=np.concatenate((n, np.ones(len(more)))), minlength=len(keys)).astype(np.int64)
            if len(keys) > HELD:
                yield from rows()
                keys, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        yield from rows()

    total = aligned.select("links").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    own = Window.partitionBy(F.expr(f"pair div {n_b}"))  # at most a row for each id of B
    return written(total.select("pair", "n", (F.max("n").over(own) == F.col("n")).alias("best")), "pair-counts")


def _scored_by_lookup(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    rows = counts.toArrow()
    order = np.argsort(rows.column("pair").to_numpy())
    held = aligned.sparkSession.sparkContext.broadcast(tuple(rows.column(c).to_numpy()[order] for c in ("pair", "n", "best")))
    columns = [c for c in aligned.columns if c not in ("links", "times")]

    def add(batches):
        pair, n, best = held.value
        for batch in batches:
            links, sizes = _flat(batch.column("links"))
            times, _ = _flat(batch.column("times"))
            at = np.searchsorted(pair, links)
            of = np.repeat(np.arange(len(sizes)), sizes)
            sums = []
            for values in (n[at] * times, best[at] * times):
                total = np.zeros(len(sizes), np.int64)
                np.add.at(total, of, values)
                sums.append(pa.array(total))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *sums], names=[*columns, "count_sum", "n_best"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in aligned.schema if f.name in columns)
    return aligned.mapInArrow(add, f"{schema}, count_sum long, n_best long")


def _scored_by_join(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    def links(batches):
        for batch in batches:
            keys, sizes = _flat(batch.column("links"))
            times, _ = _flat(batch.column("times"))
            rows = np.repeat(batch.column("row").to_numpy(), sizes)
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(keys), pa.array(times)], names=["row", "pair", "n_times"])

    each = aligned.select("row", "links", "times").mapInArrow(links, "row long, pair long, n_times long").join(counts, "pair")
    sums = each.groupBy("row").agg(F.sum(F.col("n") * F.col("n_times")).alias("count_sum"), F.sum(F.when(F.col("best"), F.col("n_times")).otherwise(0)).alias("n_best"))
    return aligned.drop("links", "times").join(sums, "row", "left").fillna(0, ["count_sum", "n_best"])


def alignment(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, lookup: int = LOOKUP) -> DataFrame:
    """row, doc_id, the counts, n_best, count_sum and groups_sha256 for every row of docs(doc_id, text)."""
    import sentencepiece

    aligned = align_documents(docs, path_a, path_b)
    model = sentencepiece.SentencePieceProcessor(model_file=path_b or vocabulary_path("piece_bpe_32k.model"))
    counts = pair_counts(aligned, model.get_piece_size())
    return (_scored_by_lookup if counts.count() <= lookup else _scored_by_join)(aligned, counts)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = alignment(table(spark, sf_dir, "documents", "doc_id", "text"))
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", F.col("n_shared").alias("n_group_links"))
