"""Counts of prefixes against the library, prefix by prefix."""

import random

import pytest
from rows import SMALL
from test_llm import as_rows, docs_of, named, rows_of

from spanloom.llm import op13_prefix_counts as op
from spanloom.llm.tokens import vocabulary_path
from spanloom.llm.units import Units, stretches

BITS = [" ", "  ", "\n", "\n\n", "\t", "'re", "'ll", "'s", "don", "word", "Été", "日本", "é", "12", "…", "!!", "<|endoftext|>", "<|endo", "\x1c", "\xa0", "\r\n", "'", "𝒳", "\x00", "x", "\x85", " '", "and or"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))


def n_tokens(library, text):
    return len(library.encode(text, add_special_tokens=False).ids)


def texts(seed, number, most):
    chance = random.Random(seed)
    return ["".join(chance.choice(BITS) for _ in range(chance.randint(0, most))) for _ in range(number)]


def frame(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")


def test_every_prefix(spark, library):
    rows = texts(1, 400, 9)
    prefixes = op.prefix_counts(frame(spark, rows)).collect()
    assert len(prefixes) > len(rows)  # special tokens end a stretch
    counts = {}
    for p in sorted(prefixes, key=lambda p: (p.doc_id, p.part)):
        own = counts.setdefault(p.doc_id, [])
        assert p.start_char == len(own) and p.start_tokens == (own[-1] if own else 0)
        own += [p.start_tokens + int(n) for n in op.unpacked(p.width, p.steps)]
        assert p.least == min(own[p.start_char:], default=p.start_tokens)
    for i, text in enumerate(rows):
        assert counts[i] == [n_tokens(library, text[:end]) for end in range(1, len(text) + 1)], repr(text)


@pytest.mark.parametrize("where", ["odd", SMALL])
def test_whole_texts(spark, odd_dir, library, where):
    folder = odd_dir if where == "odd" else where
    rows = rows_of(named(13)(spark, folder))
    wanted = [{"doc_id": d, "n_bytes": len((t or "").encode()), "n_tokens": n_tokens(library, t or "")} for d, t, _, _ in docs_of(folder)]
    columns = ("doc_id", "n_bytes", "n_tokens")
    assert as_rows(rows, *columns) == as_rows(wanted, *columns)
    assert all(r["over_limit"] == (r["n_tokens"] > 1024) for r in rows)


def test_budgets_and_places(spark, library):
    rows = texts(2, 60, 30)
    prefixes = op.prefix_counts(frame(spark, rows))
    for limit in (0, 3, 11):
        for r in op.longest_prefixes(prefixes, limit).collect():
            text = rows[r.doc_id]
            assert r.keep_chars == max(end for end in range(len(text) + 1) if n_tokens(library, text[:end]) <= limit)
    ids = {r.row: r.doc_id for r in prefixes.select("row", "doc_id").distinct().collect()}
    places = spark.createDataFrame([(row, at) for row, i in ids.items() for at in (0, 1, 7, len(rows[i]), len(rows[i]) + 1)], "row long, at long")
    found = op.tokens_at(prefixes, places).collect()
    assert len(found) == 5 * len(rows)
    for r in found:
        text = rows[ids[r.row]]
        assert r.n_tokens == (n_tokens(library, text[: r.at]) if r.at <= len(text) else None)


def test_long_texts_in_stretches(spark, library, monkeypatch):
    text = " ".join(texts(3, 400, 6))
    parts = stretches(text, 50)
    assert "".join(parts) == text and len(parts) > 5
    words = op.WordPrefixes(vocabulary_path("byte_bpe_50k.json"))
    plain = text.replace("<|endoftext|>", "")
    parts = stretches(plain, 50)
    counts, sizes = words.batch(parts)
    assert sizes.sum() == len(plain)
    ends = sizes.cumsum() - 1
    assert int(counts[ends].sum()) == n_tokens(library, plain)


def test_units_are_the_text():
    units = Units()
    rows = texts(4, 300, 12)
    for spaced in (False, True):
        numbers, counts = units.batch(rows, spaced)
        names = {number: key[1:] if key[:1] == " " else " " + key for key, number in units.items()}
        at = 0
        for text, n in zip(rows, counts.tolist()):
            assert "".join(names[i] for i in numbers[at: at + n].tolist()) == " " * spaced + text
            at += n


def test_steps_wider_than_a_byte():
    import numpy as np

    counts = np.array([1, 500, 3, 3])
    width, steps = op.packed(counts)
    assert width == 4 and op.unpacked(width, steps).tolist() == counts.tolist()
