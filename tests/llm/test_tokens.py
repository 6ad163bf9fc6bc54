"""Words are cut by Arrow and looked up once in a run of texts; ids are those of the library."""

from collections import defaultdict

import pytest

ODD = [None, b"", b" ", b"a", b" a  b\t\n\x0b\x0c\rc ", "é x y z\x1cq\x85".encode(), b"a\x00b \x1fa", "Fußball, Élan! İx Ünï. don't it's U.S. 3.14 <|endoftext|>".encode()]


@pytest.fixture(scope="module")
def path():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def test_a_word_is_looked_up_once_in_a_run(path):
    from spanloom.llm.tokens import WordTokenizer

    words, asked = WordTokenizer(path), []
    held = words.words

    class Asked(defaultdict):
        def __getitem__(self, word):
            asked.append(word)
            return super().__getitem__(word)

    words.words = Asked(held.default_factory, held) if isinstance(held, defaultdict) else held
    if not isinstance(held, defaultdict):
        numbers = held.numbers
        held.numbers = lambda every: asked.extend(every) or numbers(every)
    ids, counts = words.batch([b"one two one"] * 100)
    assert counts.tolist() == [len(words.encode("one two one")) + 1] * 100
    assert asked.count(b"one") <= 2


def test_words_of_odd_texts():
    from spanloom.llm.tokens import split_words

    words, counts = split_words(ODD)
    assert words.to_pylist() == [word.decode() for text in ODD if text for word in text.split()]
    assert counts.tolist() == [len((text or b"").split()) for text in ODD]
    assert split_words([])[1].tolist() == []


def test_ids_of_odd_texts(path):
    from spanloom.llm.tokens import END_ID, WordTokenizer

    words = WordTokenizer(path)
    for texts in (ODD, ODD[::-1], ODD):  # new words, and words that are known
        ids, counts = words.batch(texts)
        expected = [words.encode((text or b"").decode()) + [END_ID] for text in texts]
        assert ids.tolist() == [i for own in expected for i in own]
        assert counts.tolist() == [len(own) for own in expected]
    assert words.batch([])[0].tolist() == []
