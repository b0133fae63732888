import random

import numpy as np
import pyarrow as pa
import pytest

from stratalith.llm import textkernel as K
from tests.llm import tables


@pytest.mark.parametrize("k", [1, 2, 3, 7])
def test_windows_of_documents_with_and_without_words(k):
    r = random.Random(k)
    texts = [" ".join(tables.soup(i, r.choice([0, 0, 1, 2, 3, 9]), 6)) for i in range(200)]
    words = K.split(pa.array(texts), letters_only=False)
    hashes, inside = words.window_hashes(k)
    doc = words.doc_of_word()[: len(hashes)]
    found = {}
    for h, d, ok in zip(hashes.tolist(), doc.tolist(), inside.tolist(), strict=True):
        if ok:
            found.setdefault(d, []).append(h)
    names = {}
    for d, text in enumerate(texts):
        w = text.split()
        assert len(found.get(d, [])) == max(0, len(w) - k + 1)
        for at, h in enumerate(found.get(d, [])):
            assert names.setdefault(tuple(w[at : at + k]), h) == h
    assert len(set(names.values())) == len(names)


def test_words_as_splitting_gives_them():
    text = "Ab  cé\n42x--y"
    words = K.split(pa.array([text, "", text]), letters_only=True)
    raw = text.lower().encode()
    assert [raw[a:b].decode() for a, b in zip(words.starts[:4], words.ends[:4], strict=True)] == ["ab", "cé", "42x", "y"]
    assert np.array_equal(words.hashes[:4], words.hashes[4:])


def test_sliding_min():
    x = np.random.default_rng(0).integers(0, 99, 50)
    for width in (1, 2, 3, 5, 8, 50):
        assert K.sliding_min(x, width).tolist() == [min(x[i : i + width]) for i in range(51 - width)]


def _thue_morse(n, a, b):
    return [b if bin(i).count("1") % 2 else a for i in range(n)]


def test_thue_morse_words_and_sequences_differ():
    """Polynomials modulo 2**64 take these for equal, whatever their base."""
    text = ["".join(_thue_morse(4096, "a", "b")), "".join(_thue_morse(4096, "b", "a")), " ".join(_thue_morse(4096, "a", "b")), " ".join(_thue_morse(4096, "b", "a"))]
    words = K.split(pa.array(text), letters_only=True)
    assert words.hashes[0] != words.hashes[1]
    found = words.sequences(np.arange(4))
    assert len(set(found.tolist())) == 4
    again = K.split(pa.array(["x", *text[::-1]]), letters_only=True).sequences(np.arange(5))
    assert again[1:][::-1].tolist() == found.tolist()
