import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.llm import packs, tokens

from .conftest import words as plain


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB1 é.\n—", max_size=30)), max_size=8))
def test_words_are_those_of_the_expression(texts):
    w = tokens.words(pa.array(texts, pa.string()))
    seen = {}
    for d, text in enumerate(texts):
        own = plain(text)
        assert w.first[d + 1] - w.first[d] == len(own)
        for k, word in enumerate(own):
            i = w.first[d] + k
            assert (text or "").encode()[w.start[i] : w.end[i]].decode().translate({c: c + 32 for c in range(65, 91)}) == word
            assert seen.setdefault(word, w.hash[i]) == w.hash[i]
    assert len(set(seen.values())) == len(seen)


def test_ngrams_stay_inside_texts():
    w = tokens.words(pa.array(["a b c", "b c", None, "a b"]))
    grams, owner = tokens.ngrams(w, 2)
    assert owner.tolist() == [0, 0, 1, 3] and grams[1] == grams[2] and grams[0] == grams[3] != grams[1]


def test_slices_of_arrays_and_long_texts():
    texts = pa.array(["x" * 10, "y" * (3 * tokens.CHUNK), "", "z"]).slice(1)
    parts = list(tokens.slices(texts))
    assert parts[0] == (0, 1) and parts[-1][1] == 3
    assert len(tokens.words(texts).hash) == 2


@pytest.mark.parametrize("n", [0, 1, 1000])
def test_packs_round_trip(n):
    rnd = np.random.default_rng(n)
    a = np.sort(rnd.integers(0, 1 << 63, n).astype(np.uint64))
    b, c = rnd.integers(0, 255, n).astype(np.uint8), rnd.integers(0, 1 << 31, n).astype(np.uint32)
    for x, y in zip((a, b, c), packs.unpack(packs.pack(a, b, c), 3), strict=True):
        assert x.dtype == y.dtype and (x == y).all()


def test_batches_hold_all_words_of_all_documents():
    table = pa.table({"doc_id": pa.array([1, None, 3]), "text": ["a b", "c", "d " * 50]})
    got = [(int(i), bool(v), int(n)) for b in packs.word_batches(table.to_batches(), most=3) for i, v, n in zip(b.ids, b.valid, np.diff(b.first), strict=True)]
    assert got == [(1, True, 2), (0, False, 1), (3, True, 50)]
