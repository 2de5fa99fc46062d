import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from kernelspark.llm import _text as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=" \n\tabAé \x1c", max_size=30)), max_size=8))
def test_words_equal_the_pattern(texts):
    got = []
    for _, _, data, offsets in T.blocks(pa.array(texts, pa.string())):
        w = T.Words(data, offsets)
        for a, b in zip(w.first[:-1], w.first[1:], strict=True):
            got.append([bytes(data[s:e]).decode() for s, e in zip(w.start[a:b], w.end[a:b], strict=True)])
    assert got == [WORD.findall(t or "") for t in texts]


def test_equal_spans_have_equal_values_and_others_do_not():
    texts = ["one two three", "two", "three one", "ONE two"]
    _, _, data, offsets = next(T.blocks(pa.array(texts)))
    w = T.Words(data, offsets, lower=True)
    words = [bytes(data[s:e]).decode().lower() for s, e in zip(w.start, w.end, strict=True)]
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            assert (a == b) == (w.value[i] == w.value[j])


def test_shingle_sets_match_strings():
    texts = ["a b c d e f", "a b c d e a b c d e", "a b", "", "b a", "a"]
    sets = T.shingle_sets(T.Words(*next(T.blocks(pa.array(texts)))[2:]), 5)
    assert [len(x) for x in sets] == [2, 5, 1, 0, 1, 1]
    assert sets[0][0] in sets[1] or sets[0][1] in sets[1]
    assert len({int(sets[k][0]) for k in (2, 4, 5)}) == 3


def test_long_texts_are_one_block():
    column = pa.array(["x " * (T.BLOCK_BYTES), "y", None])
    parts = list(T.blocks(column))
    assert parts[0][:2] == (0, 1) and parts[-1][1] == 3
    assert len(T.Words(*parts[0][2:]).start) == T.BLOCK_BYTES
    assert np.all(np.diff(parts[1][3]) >= 0)
