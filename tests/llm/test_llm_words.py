import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from listprep.llm import words

PIECES = st.lists(st.sampled_from(["a", "B", "é", "Ñ", " ", "\n", "\t", "\r\n", "\x0b", ".", ". ", "x", "漢", "\xa0", "word"]), max_size=25)


def plain(text):
    return [w.lower() if w.isascii() else re.sub(rb"[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(rb"[^\x20\x09-\x0d]+", text.encode())]


@settings(max_examples=150, deadline=None)
@given(st.lists(PIECES.map("".join), max_size=6))
def test_words_and_shingles_of_each_text(texts):
    found = words.words_of(pa.array(texts, pa.string()))
    runs, first = words.shingles(found, 3)
    for k, text in enumerate(texts):
        own = plain(text)
        a, b = found.first[k], found.first[k + 1]
        assert [bytes(words.lowered(found.data[x:y])) for x, y in zip(found.start[a:b], found.end[a:b])] == own
        assert first[k + 1] - first[k] == (len(own) - 2 if len(own) >= 3 else min(len(own), 1))
        alone = words.shingles(words.words_of(pa.array([text])), 3)[0]
        assert (runs[first[k] : first[k + 1]] == alone).all()


def test_equal_words_have_equal_hashes_and_others_do_not():
    found = words.words_of(pa.array(["one two ONE", None, "", "two"]))
    a, b, c, d = found.hashes
    assert a == c and b == d and a != b
    assert found.first.tolist() == [0, 3, 3, 3, 4]


def test_segments_end_with_lines_and_sentences():
    texts = pa.array(["One two. Three v2.0 four\nfive", "", "six! seven"])
    found = words.words_of(texts)
    assert words.segments(found).tolist() == [0, 2, 5, 6, 7]
    assert words.segments(words.words_of(pa.array([""]))).tolist() == []


def test_slices_hold_all_texts_and_a_long_one_alone():
    texts = pa.array(["a" * 10, "b" * 50, "", "c" * 5]).slice(1)
    assert list(words.slices(texts, 20)) == [(0, 1), (1, 3)]
    assert list(words.slices(pa.array([], pa.string()))) == []


def test_minhash_agrees_as_often_as_the_sets_do():
    a, b = np.arange(0, 900, dtype=np.uint64), np.arange(100, 1000, dtype=np.uint64)
    runs = words.mix(np.concatenate([a, b]) + np.uint64(1))
    signature = words.minhash(runs, np.array([0, 900, 1800]), 400)
    assert abs((signature[0] == signature[1]).mean() - 0.8) < 0.07
