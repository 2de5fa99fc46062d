import functools
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from kernelspark.llm import treebpe
from kernelspark.llm.queries import tokenizer_path
from tests.llm.helpers import docs, odd_rows, with_extra

PATH = tokenizer_path("word_bpe_49k.json")


@functools.cache
def _library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def library():
    t = _library()
    return lambda text: t.encode(text or "", add_special_tokens=False).ids, lambda ids: t.decode(ids, skip_special_tokens=False)


@pytest.fixture(scope="module")
def own():
    return treebpe.Bpe(PATH)


ODD = ["a", "b", "th", "the", "in", "ing", "'s", "'", "1", "23", " ", "  ", "\t", "\n", "\x85", " ", "　", "é", "é", "́", "İ", "ß", "ﬁ", "각", "中文", "🙂", "👩‍👩‍👧", "...", "!?", "<|endoftext|>", "<|startoftext|>", "<|", "</w>", "\x00", "A", "Å"]


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=60), st.lists(st.sampled_from(ODD), max_size=40).map("".join)))
def test_any_text_equals_the_library(text):
    own, lib = treebpe.bpe(PATH), _library()
    ids = lib.encode(text, add_special_tokens=False).ids
    assert next(own.column(pa.array([text], pa.large_string()))).tolist() == ids
    assert own.stretch(text) == ids
    assert own.texts(pa.array([ids], pa.list_(pa.int32())))[0].as_py() == lib.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("letters", ["a", "ab", "in", "the", "thein", "hahaha", "abcdefghijklmnopqrstuvwxyz", "-", "=-", "é中"])
def test_halves_join_exactly(own, library, monkeypatch, letters):
    monkeypatch.setattr(treebpe, "LEAF", 3)
    r = random.Random(letters)
    for n in (1, 2, 3, 5, 8, 40, 211):
        for text in (letters * n, "".join(r.choice(letters) for _ in range(n))):
            pre = [w for w, _ in own.pretokens(text)]
            parts = [treebpe.halves(w, 3) for w in pre]
            made = [i for p in parts for i in own.tree([own.piece(x, k + 1 == len(p)) for k, x in enumerate(p)])]
            assert made == library[0](text)


def test_windows_are_smaller_than_the_sides(own, monkeypatch):
    text = "".join(random.Random(3).choice(["the", "in", "ation", "q", "zz", "er"]) for _ in range(9000))
    seen = []
    kept = treebpe.Bpe.piece
    monkeypatch.setattr(treebpe.Bpe, "piece", lambda self, letters, last: (seen.append(len(letters)), kept(self, letters, last))[1])
    parts = [kept(own, p, False) for p in treebpe.halves(text, 1000)]
    own.tree(parts, last=False)
    assert max(seen) < 500 and sum(seen) < len(text)


def digests(library, rows):
    out = []
    for doc, text in rows:
        ids = library[0](text)
        out.append((doc, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library[1](ids).encode()).hexdigest()))
    return sorted(out, key=str)


def long_rows():
    r = random.Random(5)
    unsplit = "".join(r.choice(["the", "ing", "q", "x", "é", "tion"]) for _ in range(3000))
    mixed = "".join(r.choice(["Abc", "12", ".", "'s", " ", "<|endoftext|>", "ü", "--"]) for _ in range(4000))
    spaced = " ".join(r.choice(["The", "cat's", "42", "naïve"]) for _ in range(3000))
    return [(20, unsplit), (21, mixed), (22, spaced), (23, " " * 5000), (24, "a" * 7001), (None, unsplit + " " + unsplit), (25, unsplit + "\n"), (25, unsplit + "\n"), (26, "9" * 3000 + "x" * 3000)]


@pytest.mark.parametrize("spread", [300, 1 << 16])
def test_segments_of_long_texts(spark, library, monkeypatch, spread):
    monkeypatch.setattr(treebpe, "SPREAD", spread)
    rows = [(r[0], r[1]) for r in odd_rows()] + long_rows()
    # the workers fork with the patched module only where segments are cut in this process
    for _, text in rows:
        out, leaves, own = [], [], treebpe.bpe(PATH)
        for kind, _, piece in own.segments(text or ""):
            ids = own.segment(kind, piece).tolist()
            if kind in (treebpe._INNER, treebpe._LAST):
                leaves.append(ids)
                if kind == treebpe._LAST:
                    out += own.tree(leaves)
                    leaves = []
            else:
                out += ids
        assert out == library[0](text)
    found = treebpe.digests(with_extra(docs(spark, rows)), PATH)
    assert sorted(map(tuple, found.collect()), key=str) == digests(library, rows)


def test_own_interface(spark, library):
    rows = [(1, "Hello there, it's 1999"), (2, None), (3, "")]
    ids = treebpe.encode(docs(spark, rows), PATH)
    assert {r.doc_id: r.ids for r in ids.collect()} == {d: library[0](t) for d, t in rows}
    assert {r.doc_id: r.decoded for r in treebpe.decode(ids, PATH).collect()} == {d: library[1](library[0](t)) for d, t in rows}
    assert treebpe.digests(docs(spark, []), PATH).count() == 0


def test_other_files_go_whole_to_the_library(spark):
    path = tokenizer_path()
    t = Tokenizer.from_file(path)
    text = "Some  text, with 'marks'\n and <|endoftext|> ü"
    row = treebpe.decode(treebpe.encode(docs(spark, [(1, text)]), path), path).first()
    assert row.ids == t.encode(text, add_special_tokens=False).ids and row.decoded == text
