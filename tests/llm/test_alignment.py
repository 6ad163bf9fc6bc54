"""Links between two tokenizers' tokens against whole texts, byte by byte."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from rows import SMALL
from test_llm import as_rows, docs_of, named, rows_of
from test_prefix_counts import texts

from spanloom.llm import op11_alignment as op
from spanloom.llm.tokens import byte_letters, vocabulary_path

COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_group_links")


@pytest.fixture(scope="module")
def both():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=vocabulary_path("piece_bpe_32k.model"))


def tokens_of(both, text):
    """(id, start, end) of both sides, by the libraries on the whole text; nothing when the bytes are not the text's."""
    a, b = both
    byte_of = {c: i for i, c in enumerate(byte_letters())}
    octets = (" " + text).encode()
    sides = []
    for ids, bytes_of in (
        (a.encode(" " + text, add_special_tokens=False).ids, lambda i: bytes(byte_of[c] for c in a.id_to_token(i))),
        (b.encode(text), lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()),
    ):
        at, out, joined = 0, [], b""
        for i in ids:
            out.append((i, at, at + len(bytes_of(i))))
            joined += bytes_of(i)
            at = out[-1][2]
        if joined != octets:
            return [], []
        sides.append(out)
    return sides


def plain(both, docs):
    found = [tokens_of(both, t) if t else ([], []) for _, t in docs]
    links = []
    for left, right in found:
        own, k = [], 0
        for a, s, e in left:
            while k < len(right) and right[k][2] <= s:
                k += 1
            m = k
            while m < len(right) and right[m][1] < e:
                own.append((a, right[m][0]))
                m += 1
        links.append(own)
    count = Counter(pair for own in links for pair in set(own))
    highest = {}
    for (a, _), n in count.items():
        highest[a] = max(n, highest.get(a, 0))
    out = []
    for (doc_id, _), (left, right), own in zip(docs, found, links):
        ends = sorted({e for *_, e in left} & {e for *_, e in right})
        groups = [([a for a, s, e in left if lo <= s and e <= hi], [b for b, s, e in right if lo <= s and e <= hi]) for lo, hi in zip([0, *ends], ends)]
        spelled = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((doc_id, len(left), len(right), len(groups), len(own), sum(count[p] == highest[p[0]] for p in own), sum(count[p] for p in own),
                    hashlib.sha256(spelled.encode()).hexdigest() if left else "", sum(len(x) * len(y) for x, y in groups)))
    return Counter(out)


@pytest.mark.parametrize("where", ["odd", SMALL])
def test_documents(spark, odd_dir, both, where):
    folder = odd_dir if where == "odd" else where
    docs = [(d, t if t and len(t) < 20000 else t and t[:20000]) for d, t, _, _ in docs_of(folder)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    rows = [r.asDict() | {"n_group_links": r.n_shared} for r in op.alignment(frame).collect()]
    assert as_rows(rows, *COLUMNS) == plain(both, docs)


def test_query_is_the_operator(spark, odd_dir):
    rows = rows_of(named(11)(spark, odd_dir))
    assert len(rows) == len(docs_of(odd_dir)) and all(set(r) == set(COLUMNS) for r in rows)
    assert [r["groups_sha256"] for r in rows if r["doc_id"] == 4] == [""]


@pytest.mark.parametrize("way", ["lookup", "join"])
def test_odd_texts_both_ways(spark, both, way):
    docs = list(enumerate(texts(7, 150, 12) + ["▁", "a▁b", "  ", "x" * 3000, " \n "]))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    rows = [r.asDict() | {"n_group_links": r.n_shared} for r in op.alignment(frame, lookup=op.LOOKUP if way == "lookup" else 0).collect()]
    assert as_rows(rows, *COLUMNS) == plain(both, docs)


def test_products_of_matrices():
    chance = np.random.default_rng(5)
    for _ in range(50):
        left, right = (chance.random((int(chance.integers(1, 9)), 7)) < 0.4 for _ in range(2))
        made = [op.Csr(np.concatenate(([0], np.cumsum(m.sum(axis=1)))), np.nonzero(m)[1], 7) for m in (left, right)]
        dense = np.zeros((len(left), len(right)), int)
        row, column, value = made[0].times(made[1].transposed())
        dense[row, column] = value
        assert (dense == left.astype(int) @ right.astype(int).T).all()


def test_long_texts_in_runs(both, monkeypatch):
    """Stretches and runs of a long text add up to the same."""
    found = op.Aligner(vocabulary_path("byte_bpe_50k.json"), vocabulary_path("piece_bpe_32k.model"))
    rows = [" ".join(texts(9, 300, 6)), None, "short one", ""]
    whole = op._aligned(found, rows)
    monkeypatch.setattr(op, "_runs", lambda t, runs=op._runs: runs(t, 40))
    monkeypatch.setattr(op, "stretches", lambda t, cut=op.stretches: cut(t, 30))
    parts = op._aligned(found, rows)
    assert (whole[0] == parts[0]).all() and whole[2:] == parts[2:]
