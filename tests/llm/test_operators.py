"""Operators against brute force on small tables, and on odd rows."""

import json
import os
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from kernelspark.llm import _packed, _util, ann, langid, mixing, ngram_join, packing, passages, quality, tokenbin, warc, wrapper
from kernelspark.llm._util import components
from tests.llm.helpers import docs, odd_rows, rng_words, with_extra

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def shingles(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    sets = [(d, shingles(t)) for d, t in rows]
    parent = {d: d for d, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    return {d: (len(s), root(d)) for d, s in sets}


def near(words, k, seed):
    out = list(words)
    for i in range(k):
        out[(seed * 37 + i * 101) % len(out)] = f"z{seed}_{i}"
    return out


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, k) for k in range(101, 160)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(31)} == {0} and {got[k] for k in range(100, 160)} == {100} and got[201] == 200
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_ngram_join_equals_brute_force(spark):
    base = rng_words(5, 300)
    rows = [(i, " ".join(near(base, i % 7, i))) for i in range(60)]  # a group of near copies
    rows += [(100 + i, " ".join(rng_words(100 + i, 40))) for i in range(40)]
    chain = rng_words(9, 400, 5000)
    rows += [(300 + i, " ".join(chain[i * 12 : i * 12 + 200])) for i in range(12)]  # linked only through one another
    rows += [(400, "A b c"), (401, "a B c"), (402, "a b"), (403, ""), (404, "x y z x y"), (405, "x y z x y")]
    rows += [(500 + i, " ".join(rng_words(7, 60) + rng_words(500 + i, 10))) for i in range(30)]  # one common passage
    want = brute_components(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(docs(spark, rows).repartition(3)).collect()}
    assert got == want


def test_ngram_join_of_groups_that_pair_in_full(spark, monkeypatch):
    """Without the two links a row only the full pairing is left; it must find the same."""
    monkeypatch.setattr(ngram_join, "FETCHED", -1)
    base = rng_words(6, 120)
    rows = [(i, " ".join(near(base, 3, i))) for i in range(12)] + [(50 + i, " ".join(near(base, 9, 60 + i))) for i in range(12)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(docs(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_runs_give_the_same_whatever_the_batches(spark):
    """The sorted stream's state over batch borders."""
    rows = [(v, v, n, 10 + n % 3, n % 2, 1) for v in range(20) for n in range(v % 5)] + [(1000 + n, 99, n, 10, 0, 3) for n in range(2)]
    df = spark.createDataFrame(rows, "key long, value long, node long, size int, place int, parts int")
    found = []
    for batch in ("1", "3", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        found.append(sorted(map(tuple, ngram_join._runs(df, 80).collect())))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found[0] == found[1] == found[2]
    # a row alone in its run goes, unless the run is a part of one
    assert Counter(r[0] for r in found[0]) == {v: v % 5 for v in range(20) if v % 5 > 1} | {99: 2}


def group_rows():
    base = rng_words(6, 150)
    rows = [(i, " ".join(near(base, 4 + i % 9, i))) for i in range(40)]
    rows += [(100 + i, " ".join(rng_words(7, 60) + rng_words(500 + i, 12))) for i in range(40)]
    return rows + [(200 + i, " ".join(rng_words(200 + i // 2, 50))) for i in range(20)]


def test_candidates_do_not_depend_on_the_number_of_tasks(spark):
    found = []
    for tasks in (4, 100):
        rows = docs(spark, group_rows()).select("doc_id", "text").repartition(tasks)
        frequency = ngram_join._frequencies(ngram_join._scan(rows, 5))
        assert frequency.sum() == sum(len(shingles(t)) for _, t in group_rows())
        posts = ngram_join._runs(ngram_join._prefixes(rows, 5, 80, frequency), 80)
        found.append({tuple(r) for r in ngram_join._paired(posts).distinct().collect()})
    assert found[0] == found[1] and found[0]


@pytest.mark.parametrize("split, full", [(3, 4000), (200_000, 3), (2, 2)])
def test_split_runs_and_blocks_lose_nothing(spark, monkeypatch, split, full):
    monkeypatch.setattr(ngram_join, "SPLIT", split)
    monkeypatch.setattr(ngram_join, "FULL_SPLIT", full)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(docs(spark, group_rows())).collect()}
    assert got == brute_components(group_rows())


def test_range_counts_bound_the_overlap():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 2**64, n, dtype=np.uint64)) for n in (5, 300, 2_000, 30_000, 200_000)]
    sets += [np.unique(np.concatenate((x[: len(x) * 3 // 4], sets[1][:100]))) for x in sets]
    raw = np.frombuffer(b"".join(ngram_join._mark(x) for x in sets), np.uint8).reshape(-1, 129)
    assert len(set(raw[:, 0])) == 3
    for i, x in enumerate(sets):
        bound = ngram_join._shared(raw, np.full(len(sets), i), np.arange(len(sets)))
        assert bound[i] == len(x) and all(b >= len(np.intersect1d(x, y)) for b, y in zip(bound, sets, strict=True))


@pytest.mark.parametrize("size", [45_000, 9_000_000])
def test_full_pairs_of_very_long_texts_are_kept(spark, size):
    x = np.random.default_rng(5).integers(0, 2**63, size, dtype=np.uint64) * np.uint64(2)
    mark = ngram_join._mark(x)
    posts = spark.createDataFrame([(1, n, size, 0) for n in (10, 11)], "value long, node long, size int, place int")
    marks = spark.createDataFrame([(n, bytearray(mark)) for n in (10, 11)], "node long, mark binary")
    labels = spark.createDataFrame([], "node long, label long")
    assert [tuple(r) for r in ngram_join._crossed(posts, labels, marks, 80).collect()] == [(10, 11)]


def test_suffix_filter_never_drops_a_similar_pair():
    rng = np.random.default_rng(1)
    for n in (3, 20, 300, 5000):
        x = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
        y = np.unique(np.concatenate((x[: int(n * 0.95)], rng.integers(0, 2**63, n // 20 + 1, dtype=np.uint64))))
        if ngram_join.similar(x, y, 80):
            assert ngram_join.may_be_similar(len(x), ngram_join.sketch(x), len(y), ngram_join.sketch(y), 80)
        other = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        assert not ngram_join.similar(x, other, 80)


def test_passages_are_found_and_clean_texts_left_alone(spark):
    common = rng_words(50, 80, 10_000)
    fuzzy = list(common)
    for k in (20, 50):
        fuzzy[k] = f"q{k}"
    fuzzy[35:35] = ["in", "serted"]
    rows = [(i, " ".join(rng_words(i, 200, 10_000))) for i in range(30)]
    rows.append((40, " ".join(rng_words(40, 50, 10_000) + common + rng_words(41, 30, 10_000))))
    rows.append((41, " ".join(rng_words(42, 10, 10_000) + common)))
    rows.append((42, " ".join(fuzzy + rng_words(43, 90, 10_000))))
    rows.append((43, " ".join(rng_words(44, 90, 10_000) + common[:40])))  # too short a repeat
    got = passages.passages(docs(spark, rows)).toPandas()
    assert set(got.doc_id) == {41, 42} and set(got.ref_doc_id) <= {40, 41}
    one = got[(got.doc_id == 41) & (got.ref_doc_id == 40)].iloc[0]
    assert (one.start_word, one.end_word, one.ref_start_word, one.ref_end_word, one.n_equal) == (10, 90, 50, 130, 80)
    two = got[(got.doc_id == 42) & (got.ref_doc_id == 40)].iloc[0]
    assert (two.start_word, two.end_word, two.n_equal) == (0, 82, 78)
    left = {r.doc_id: r.text for r in passages.without_repeats(docs(spark, rows)).collect()}
    assert left[40] == rows[30][1] and left[43] == rows[33][1]
    assert left[41].split() == rows[31][1].split()[:10]
    assert left[42].split() == rows[32][1].split()[82:]


def test_exact_paragraphs_between_rewritten_sentences_are_found(spark):
    five = [[f"p{i}_{k}" for k in range(55)] for i in range(5)]

    def text(name, sizes):
        return " ".join(w for i, p in enumerate(five) for w in (*p, *(f"{name}{i}_{k}" for k in range(sizes[i]))))

    df = docs(spark, [(1, text("a", (20, 20, 20, 20, 0))), (2, text("b", (20, 20, 20, 20, 0))), (3, text("c", (0, 38, 0, 38, 0)))])
    got = passages.passages(df).collect()
    assert all(100 * r.n_equal >= 80 * max(r.n_words, r.ref_end_word - r.ref_start_word) and r.n_words >= 50 for r in got)
    left = {r.doc_id: r.text.split() for r in passages.without_repeats(df).collect()}
    assert len(left[1]) == 355 and not any(w.startswith("p") for d in (2, 3) for w in left.get(d, []))


def test_a_passage_held_twice_is_cut_twice(spark):
    shared, own = [f"p{k}" for k in range(60)], lambda n, k: [f"{n}{i}" for i in range(k)]
    rows = [(1, " ".join(own("a", 30) + shared)), (2, " ".join(own("b", 20) + shared + own("c", 50) + shared + own("d", 20)))]
    rows.append((3, " ".join(shared[40:] + own("e", 50) + shared[20:40] + own("f", 50) + shared)))  # its sentences stand earlier as well
    left = {r.doc_id: r.text.split() for r in passages.without_repeats(docs(spark, rows)).collect()}
    assert left[2] == own("b", 20) + own("c", 50) + own("d", 20)
    assert left[3] == shared[40:] + own("e", 50) + shared[20:40] + own("f", 50)
    rows = [(1, " ".join(shared[40:] + own("e", 50) + shared[20:40] + own("f", 50) + shared)), (2, " ".join(own("b", 20) + shared))]
    assert {r.doc_id: r.text.split() for r in passages.without_repeats(docs(spark, rows)).collect()}[2] == own("b", 20)


def test_passages_with_every_fifth_word_changed_are_found(spark):
    rows = []
    for i in range(60):
        p = [f"p{i}_{k}" for k in range(100)]
        rows += [(i, " ".join(p)), (100 + i, " ".join(f"z{i}_{k}" if k % 5 == 4 else w for k, w in enumerate(p)))]
    got = passages.passages(docs(spark, rows)).collect()
    assert len({r.doc_id for r in got}) >= 58 and all(r.ref_doc_id == r.doc_id - 100 and r.n_words >= 50 and 100 * r.n_equal >= 80 * r.n_words for r in got)


def test_passages_of_widespread_sentences_are_found(spark):
    three = [[f"s{i}_{k}" for k in range(17)] for i in range(3)]
    rows = [(3 * n + i, " ".join([f"a{n}_{i}_{k}" for k in range(40)] + three[i] + [f"b{n}_{i}_{k}" for k in range(40)])) for n in range(20) for i in range(3)]
    rows += [(d, " ".join([f"c{d}_{k}" for k in range(40)] + sum(three, []) + [f"d{d}_{k}" for k in range(40)])) for d in (25_000, 50_000)]
    rows += [(30_000 + 3 * n + i, rows[3 * n + i][1].replace("a", "e").replace("b", "f")) for n in range(20) for i in range(3)]
    got = {(r.doc_id, r.ref_doc_id, r.start_word, r.end_word) for r in passages.passages(docs(spark, rows)).collect()}
    assert got == {(50_000, 25_000, 40, 91)}


@pytest.mark.parametrize("n", [6, 40])
def test_passages_meet_whatever_documents_have_their_seeds(spark, n):
    """All stretches of 45 words of the passage stand in documents before, and of 12 in documents between; only 900 and 2000 have it whole."""
    shared, rows = [f"s{k}" for k in range(60)], []
    for i in range(n):
        rows += [(16 * i + k // 3, " ".join([f"a{i}_{k}_{j}" for j in range(30)] + shared[k : k + 45] + [f"b{i}_{k}_{j}" for j in range(30)])) for k in range(0, 16, 3)]
        rows += [(1000 + 16 * i + k // 6, " ".join([f"c{i}_{k}_{j}" for j in range(30)] + shared[k : k + 12] + [f"d{i}_{k}_{j}" for j in range(30)])) for k in range(0, 60, 6)]
    rows += [(d, " ".join([f"e{d}_{j}" for j in range(30)] + shared + [f"f{d}_{j}" for j in range(30)])) for d in (900, 2000)]
    got = {(r.doc_id, r.ref_doc_id, r.start_word, r.end_word) for r in passages.passages(docs(spark, rows)).collect()}
    assert got == {(2000, 900, 30, 90)}


def test_recall_of_passages_with_words_changed_at_random(spark):
    """60-word passages in other texts, 10 % of their words substituted: all that are still 80 % equal, but 3 in 100, are found."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(150):
        p = rng_words(1000 + i, 60, 10_000)
        q = [f"y{i}_{k}" if rng.random() < 0.1 else w for k, w in enumerate(p)]
        for d, x in ((i, p), (1000 + i, q)):
            rows.append((d, " ".join(rng_words(5000 + d, 70, 10_000) + x + rng_words(9000 + d, 70, 10_000))))
    got = {(r.doc_id, r.ref_doc_id) for r in passages.passages(docs(spark, rows)).collect()}
    assert all(a == b + 1000 for a, b in got) and len(got) >= 0.97 * 150


def test_rows_of_one_id_are_cut_only_where_their_text_was_aligned(spark):
    shared = [f"p{k}" for k in range(60)]
    first, second, other = " ".join(shared + ["x"] * 9), " ".join([f"b{k}" for k in range(9)] + shared), " ".join(f"c{k}" for k in range(80))
    left = sorted(r.text for r in passages.without_repeats(docs(spark, [(1, first), (2, second), (2, other)])).collect())
    assert first in left and other in left and len(left) == 3


def test_seeds_meet_the_same_whatever_the_batches(spark):
    rows = [(i % 23, " ".join(rng_words(i % 5, 70, 12) + rng_words(i, 20, 12))) for i in range(60)]
    got = []
    for n in (7, 10_000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
        got.append(set(map(tuple, passages._matches(docs(spark, rows), passages.Rule()).distinct().collect())))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got[0] == got[1] and got[0] and all(r[1] < r[0] for r in got[0])


def test_parts_are_the_words_of_all_runs_that_pass():
    rule, rng = passages.Rule(min_words=8), np.random.default_rng(3)
    for _ in range(60):
        n = int(rng.integers(1, 40))
        i, j = (np.cumsum(1 + rng.binomial(2, 0.12, n) * rng.integers(1, 4, n)) for _ in "ab")
        want = {w for p in range(n) for q in range(p, n) if min(i[q] - i[p], j[q] - j[p]) >= 7 and 100 * (q - p + 1) >= 80 * (max(i[q] - i[p], j[q] - j[p]) + 1) for w in range(p, q + 1)}
        got = passages.parts(i, j, rule)
        assert {w for p, q in got for w in range(p, q + 1)} == want
        assert all(100 * (q - p + 1) >= 80 * (max(i[q] - i[p], j[q] - j[p]) + 1) for p, q in got)


def test_chains_match_the_quadratic_recurrence():
    rng = np.random.default_rng(4)
    rule = passages.Rule(gap=0.3, most_gap=10**9)
    for _ in range(30):
        n = int(rng.integers(2, 25))
        pts = np.unique(rng.integers(0, 30, (n, 2)), axis=0)
        y, x = pts[:, 0], pts[:, 1]
        score = np.zeros(len(x))
        for i in range(len(x)):
            best = max((score[j] - rule.gap * (x[i] - x[j] + y[i] - y[j]) for j in range(len(x)) if x[j] < x[i] and y[j] < y[i]), default=0)
            score[i] = rule.k + max(0, best)
        first = passages.chains(x, y, rule)[0]
        value = rule.k * len(first) - rule.gap * (x[first[-1]] - x[first[0]] + y[first[-1]] - y[first[0]])
        if not (np.all(np.diff(x) > 0) and np.all(np.diff(y) > 0)):
            assert value == pytest.approx(score.max())
        assert np.all(np.diff(x[first]) > 0) and np.all(np.diff(y[first]) > 0)
        tight = passages.Rule(gap=0.3, most_gap=6)
        wide = [c.tolist() for c in passages.chains(x, y, tight) if min(x[c[-1]] - x[c[0]], y[c[-1]] - y[c[0]]) + tight.k >= 9]
        assert [c.tolist() for c in passages.chains(x, y, tight, 9)] == wide
    assert passages.common(np.array([1, 2, 3, 4]), np.array([2, 9, 4, 3])) == 2


@pytest.mark.parametrize("few", [200_000, -1])
def test_quality_equals_sql_and_spares_the_first_document(spark, few):
    line = "this very common line stands in many documents of one host"
    rows = [(i, line + "\n" + " ".join(rng_words(i, 60 if i % 2 else 8, 3000)) + "\nend of it\n\nend of it", "a" if i % 3 else None) for i in range(90)]
    rows += [(200, "x y z x y z x y z " * 8, "a"), (201, "Short", "b"), (202, None, None), (203, "#*$ |<>", "b")]
    df = docs(spark, rows)
    got = sorted(map(tuple, quality.verdicts(with_extra(df), quality.Limits(broadcast=few)).collect()), key=str)
    frame = df.toArrow()  # noqa: F841  read by name below
    want = sorted((tuple(r) for r in duckdb.sql(quality.ORACLE.replace("{docs}", "frame")).fetchall()), key=str)
    names = [c[0] for c in duckdb.sql(quality.ORACLE.replace("{docs}", "frame")).description]
    order = [names.index(c) for c in ("doc_id", *quality.COLUMNS, "base_failed", "kept", "removed_words")]
    assert got == sorted((tuple(r[k] for k in order) for r in want), key=str)
    kept = {r.doc_id: r for r in quality.clean(df, quality.Limits(broadcast=few)).collect()}
    assert set(kept) == {r[0] for r in got if r[7]} and line in kept[1].text and line not in kept[5].text
    assert kept[5].n_chars == len(kept[5].text)


def test_token_files_round_trip(spark, path, tmp_path):
    rows = [(i, " ".join(rng_words(i, i % 50))) for i in range(40)] + [(100, "a  b \n c\t  d  <|endoftext|>"), (101, None), (102, ""), (103, "日本語 text… ﬁne")]
    df = docs(spark, rows).repartition(3)
    shards = tokenbin.write(df, path, f"file://{tmp_path}/t")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    ids = {d: [*t.encode(x or "", add_special_tokens=False).ids, 0] for d, x in rows}
    at = 0
    for r in sorted(map(tuple, tokenbin.read(shards).collect())):
        assert r == (r[0], at, len(ids[r[0]]), zlib.crc32(np.array(ids[r[0]], "<u4").tobytes()))
        at += len(ids[r[0]])
    flat = np.concatenate([np.asarray(s.ids) for s in tokenbin.open_corpus(shards)])
    assert flat.dtype == np.uint16 and flat.tolist() == [x for d in sorted(ids) for x in ids[d]]
    assert any(isinstance(s.ids, np.memmap) for s in tokenbin.open_corpus(shards))


def test_encoder_equals_the_library_on_odd_white_space(path):
    import random

    r, parts = random.Random(2), ["a", "B", "'s", "'", " ", "  ", "\n", "\t", "\x1c", "\xa0", " ", "é", "1", "!!", "日本", "<|endoftext|>", "\r\n", " \n"]
    texts = ["".join(r.choices(parts, k=r.randint(0, 12))) for _ in range(3000)]
    texts += ["", None, " ", "x" * 300 + " " + "y" * 300, "a\x00b", "<|endoftext|>", "long " * 400_000 + "<|endoftext|> end"]
    from tokenizers import Tokenizer

    e, own = tokenbin.Encoder(path, None), Tokenizer.from_file(path)
    assert e.by_piece
    for _ in range(2):  # the second time from the table
        assert [x.tolist() for x in e(texts)] == [x.ids for x in own.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_other_tokenizer_files_go_whole_to_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    other = public_tokenizers.path("word_bpe_49k.json")
    e, own, texts = tokenbin.Encoder(other, None), Tokenizer.from_file(other), ["Some Words here", "", " x  y\n", "Größe"]
    assert [x.tolist() for x in e(texts)] == [own.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("weights", [None, {"a": 1, "b": 2, None: 3}])
def test_packing_is_gapless_and_keeps_the_mixture(spark, path, weights):
    rows = [(i, " ".join(rng_words(i, 30 + i % 90)), ["a", "b", None][i % 3] if i % 4 else "a") for i in range(300)]
    got = packing.pack(docs(spark, rows).repartition(4), path, weights=weights, window=2048, sequence=256).toPandas()
    pos = (got.sequence_id * 256 + got.offset).to_numpy()
    order = np.argsort(pos)
    assert (pos[order] == np.cumsum(got.length.to_numpy()[order]) - got.length.to_numpy()[order]).all()
    assert (got.offset + got.length <= 256).all()
    enc = tokenbin.Encoder(path)
    ids = dict(zip([r[0] for r in rows], enc([r[1] for r in rows]), strict=True))
    for d, g in got.sort_values("start").groupby("doc_id"):
        assert g.length.sum() == len(ids[d]) == g.doc_tokens.iloc[0]
        assert np.concatenate([np.frombuffer(x, "<u2") for x in g.ids]).tolist() == ids[d].tolist()
        assert [tokenbin.crc(ids[d][s : s + n]) for s, n in zip(g.start, g.length, strict=True)] == g.ids_crc32.tolist()
    total = got.groupby(got.source.fillna("-")).length.sum()
    share = {("-" if k is None else k): v for k, v in weights.items()} if weights else total.to_dict()
    part = got[pos < 2048].groupby(got.source.fillna("-")).length.sum()
    for s, w in share.items():
        assert abs(part[s] - 2048 * w / sum(share.values())) <= 1


def test_staged_steps_take_batches_of_bounded_bytes(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "size"])

    df = spark.range(9_000).selectExpr("id", "repeat('x', 3000) text").coalesce(1)
    before = spark.conf.get(_util.BATCH_BYTES)
    got = _util.staged(df.mapInArrow(sizes, "n long, size long"), "sizes").collect()
    assert sum(r.n for r in got) == 9_000 and max(r.size for r in got) < 5 << 20
    assert spark.conf.get(_util.BATCH_BYTES) == before


def test_cutting_holds_no_encoder_and_gives_bounded_batches(path):
    size = 3 * packing.IDS
    layout, x = packing.Layout(packing.plan({"sa": 2 * size})), np.arange(size, dtype="<u2").tobytes()
    rows = pa.RecordBatch.from_pylist([{"doc_id": d, "queue": "sa", "tokens": size, "ids": x, "begin": d * size} for d in range(2)])
    tokenbin.encoder(path)
    got = list(packing.cutter(layout, "<u2")(iter([rows])))
    assert not tokenbin._encoders
    assert max(sum(b.column("length").to_pylist()) for b in got) <= packing.IDS + packing.SEQUENCE
    for d in range(2):
        assert b"".join(i for b in got for o, i in zip(b.column("doc_id").to_pylist(), b.column("ids").to_pylist(), strict=True) if o == d) == x


@pytest.mark.parametrize("small, large", [("a", "b"), ("b", "a")])
def test_plan_of_very_unequal_queues_is_short(small, large):
    totals = {small: 1, large: 10**9}
    phases = packing.plan(totals)
    assert len(phases) <= 4
    layout = packing.Layout(phases)
    assert len(list(layout.pieces(small, 0, 1))) == 1
    assert sum(n for _, n, _, _ in layout.pieces(large, 500_000_000, 100_000)) == 100_000


def test_every_window_is_within_a_token_of_its_target():
    totals, weights = {"a": 40_000, "b": 90_001, "c": 777, "d": 3}, {"a": 3, "b": 7, "c": 2, "d": 1}
    phases, taken = packing.plan(totals, weights, 101), Counter()
    ideal = {s: 0.0 for s in totals}
    for p in phases:
        for k in range(1, p.count + 1):
            if set(p.upto) == set(totals) and p.count > 1:
                for s in totals:
                    ideal[s] += p.width * weights[s] / sum(weights.values())
                    assert abs(taken[s] + p.served(s, k) - ideal[s]) <= 1
        for s in p.upto:
            taken[s] += p.served(s, p.count)
            assert all(p.served(s, k) <= p.served(s, k + 1) for k in range(min(p.count, 50)))
    assert taken == totals


def test_plan_carries_deficits_to_the_end():
    totals = {"a": 10_007, "b": 3_001, "c": 50}
    phases = packing.plan(totals, {"a": 3, "b": 3, "c": 1}, 512)
    assert sum(p.count * p.width for p in phases) == sum(totals.values())
    assert all(p.width == 512 for p in phases[:-1])
    given = Counter()
    for p in phases:
        for s in p.upto:
            assert given[s] == p.taken[s]
            given[s] += p.served(s, p.count)
    assert given == totals and packing.plan({}) == [] and packing.plan({"a": 0}) == []


def test_mixing_equals_sql_and_meets_targets(spark):
    rows = [(i, " ".join(rng_words(i, 5 + i % 40)), ["big", "big", "big", "big", "big", "b", "c", None][i % 8]) for i in range(400)] + [(900, None, "empty"), (901, "", "empty"), (902, "tiny one", "z")]
    df = docs(spark, rows)
    got = sorted(map(tuple, mixing.mixture(with_extra(df)).collect()))
    frame = df.toArrow()  # noqa: F841  read by name below
    want = duckdb.sql(mixing.ORACLE.replace("{docs}", "frame")).fetchall()
    assert [r[:3] + r[4:] for r in got] == [r[:3] + r[4:] for r in sorted(want)]
    assert [r[3] for r in got] == pytest.approx([r[3] for r in sorted(want)])
    source = {r[0]: r[2] for r in rows}
    taken, target = defaultdict(int), {}
    for d, size, _, goal, n in got:
        taken[source[d]] += n
        target[source[d]] = goal
        assert n <= 3 * size
    assert all(abs(taken[s] - target[s]) <= 45 for s in taken) and sum(target.values()) == pytest.approx(sum(r[1] for r in got))
    times = Counter(r.doc_id for r in mixing.mix(df).collect())
    assert all(times[d] * size == n for d, size, _, _, n in got if size)


def test_warc_round_trip_seek_table_and_revisits(spark, tmp_path):
    rows = [(i, f"http://h/{i}", "<p>" + " ".join(rng_words(i % 30, 3000)) + "</p>") for i in range(60)] + [(100, None, None), (101, "u \n v", ""), (102, "x", "é" * 10), (None, "y", "é" * 10)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    bundles = warc.write(pages, f"file://{tmp_path}/w")
    got = {r.page_id: r for r in warc.read(bundles).collect()}
    frame = pages.toArrow()  # noqa: F841
    want = duckdb.sql(warc.ORACLE.replace("{pages}", "frame")).fetchall()
    assert {k: tuple(v) for k, v in got.items() if k is not None} == {r[0]: r for r in want if r[0] is not None}
    assert got[None].record_type == "revisit" and got[None].refers_to == 102 and got[101].refers_to == 100
    html = {r[0]: (r[2] or "").encode() for r in rows}
    for r in bundles.collect():
        b = warc.Bundle(r["at"], r["name"])
        raw = open(f"{r['at'].removeprefix('file://')}/{r['name']}.warc.zst", "rb").read()
        every = list(b.records())
        assert len(every) == r["records"] and warc.decompress_all(raw) == b"".join(b.frame(k) for k in range(len(b.frames)))
        for head, _ in every[:3]:
            page = head["WARC-Record-ID"][10:-1]
            if page:
                found, body = next(b.find(int(page)))
                assert found == head and (head["WARC-Type"] == "revisit" or body == html[int(page)])
    assert {r.record_type for r in warc.archive(pages, least=100).where("page_id = 101").collect()} == {"response"}


PAGE = """<!DOCTYPE html><html><head><title>T{i}</title><style>p{{x}}</style><script>var a="</p>";</script></head><body><header>Site</header>
<nav><ul><li><a href=/a>A</a></li><li><a href="/b">B{i}</a></li></ul></nav><div class="ad">Buy {i}</div>
{open}<h1>Head &amp; line {i}</h1><p>First &copy; <b>bold</b> text {i}<br>
next<p>Open paragraph&nbsp;two{extra}</p><div class="share-bar">Share {i}</div><form>in<input></form><div>We use something here</div>{close}
<section id="comments"><p>Nice {i}</p></section><aside>Side {i}</aside><footer>&copy; end</footer></body></html>"""


@pytest.mark.parametrize(("opened", "closed"), [("<article>", "</article>"), ('<div class="post-content">', "</div>")])
@pytest.mark.parametrize("few", [32 << 20, -1])
def test_wrappers_find_the_article(spark, monkeypatch, opened, closed, few):
    monkeypatch.setattr(wrapper, "BROADCAST", few)
    rows = [(i, f"http://host{i % 2}.org/{i}", PAGE.format(i=i, open=opened, close=closed, extra=" more" * (i % 3 * 20 + 20))) for i in range(30)]
    rows += [(100, None, None), (101, "http://host0.org/x", ""), (102, "http://one.org", "<p>only <i>this</i>   page</p><script>x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r for r in wrapper.extract(pages).collect()}
    # the notice is the same on all pages: it goes whatever the region's tag is
    for i in range(30):
        assert got[i].text == f"Head & line {i}\nFirst © bold text {i}\nnext\nOpen paragraph two" + " more" * (i % 3 * 20 + 20)
        assert got[i].n_chars == len(got[i].text)
    assert (got[100].text, got[101].text, got[102].text) == ("", "", "only this page")


@pytest.mark.parametrize("n", [1, 14])
@pytest.mark.parametrize(("opened", "closed"), [("<body class='home has-sidebar'><article>", "</article>"), ("<body><main class='overflow-hidden'>", "</main>"), ("<article class='post tags-x'>", "</article>"), ("<div class='page no-sidebar'><article>", "</article></div>"), ("<div class='comments-open'><div class='content'>", "</div></div>")])
def test_a_part_of_a_class_does_not_drop_the_article(n, opened, closed):
    pages = [wrapper.parse(f"{opened}<p>Text {i} of the article" + f" more{i}" * 30 + f"</p><div class='share-bar'>Share {i}</div>{closed}<div id='comments'>Nice {i}</div>") for i in range(n)]
    w = wrapper.expression(pages[0])
    for p in pages[1:]:
        w = wrapper.align(w, wrapper.expression(p))
    rule = wrapper.rules(w, n)
    assert [wrapper.text_of(p, rule) for p in pages] == [f"Text {i} of the article" + f" more{i}" * 30 for i in range(n)]


def test_long_notices_and_marks_are_judged_whole():
    notice, far = "This text may be used under the terms of the licence " * 4, " ".join(f"utility-class-{c * 6}" for c in "abcdefgh")
    pages = [wrapper.parse(f"<article><p>Text {i}" + f" more{i}" * 30 + f"</p><div>{notice}</div><div class='{far} comments'>Nice {i}</div></article>") for i in range(14)]
    w = wrapper.expression(pages[0])
    for p in pages[1:]:
        w = wrapper.align(w, wrapper.expression(p))
    rule = wrapper.rules(json.loads(json.dumps(w)), 14)
    assert [wrapper.text_of(p, rule) for p in pages] == [f"Text {i}" + f" more{i}" * 30 for i in range(14)]
    assert not wrapper.Tag("div", wrapper._mark(["x" * 76, "tagsoup"])).dropped


def wrapper_of(pages):
    w = wrapper.expression(pages[0])
    for p in pages[1:]:
        w = wrapper.align(w, wrapper.expression(p))
    return wrapper.rules(json.loads(json.dumps(w)), len(pages))


def test_the_wrapper_decides_and_pages_alone_do_not_do():
    """No tag or class tells anything: only the pages together show what is the article."""
    legal, story = "These are the terms that hold for all of this site and its users " * 12, [f"Story {i} is told" + f" word{i}" * 30 for i in range(14)]
    html = "<div class='a'><div class='q'><a href='/'>Home</a></div><div class='z'><p>{legal}</p></div><div class='k'><h2>Title {i}</h2><p>{story}</p><div>Written for you with care by the people here</div><ul><li><a href='/x'>See {i}</a><li><a>And {i}</a></ul></div></div>"
    pages = [wrapper.parse(html.format(i=i, legal=legal, story=story[i])) for i in range(14)]
    rule = wrapper_of(pages)
    want = [f"Title {i}\n{story[i]}" for i in range(14)]
    assert [wrapper.text_of(p, rule) for p in pages] == want
    assert not any(wrapper.text_of(p, None) == t for p, t in zip(pages, want, strict=True))  # without inference


def test_names_do_not_outweigh_the_text():
    """A main tag with a teaser only, a form around the page, classes of the body."""
    story = [f"Story {i} is told" + f" word{i}" * 60 for i in range(14)]
    for html in ("<main><p>Teaser {i}</p></main><div class='u'><p>{s}</p></div>", "<form id='aspnet'><div class='u'><p>{s}</p></div><footer>End {i}</footer></form>", "<body class='single post comments-open'><article class='x related'><p>{s}</p></article><div class='comments'><p>Nice {i}</p></div></body>"):
        pages = [wrapper.parse(html.format(i=i, s=s)) for i, s in enumerate(story)]
        rule = wrapper_of(pages)
        assert [wrapper.text_of(p, rule) for p in pages] == story == [wrapper.text_of(p, None) for p in pages]


def test_odd_markup():
    text = lambda html: wrapper.text_of(wrapper.parse(html), None)
    assert text("<article><p>foo <img src=x> bar <math><mi>x</mi></math></p></article>") == "foo bar x"
    assert text(f"<article><p data-x='{'a>' * 2100}leak'>ok</p></article>") == "ok"
    assert text("<article><p>one</p><select><option>x<p>two</article>") == "one"  # what an open select holds is a form
    assert text("<article><object><p>kept</p></object></article>") == "kept"
    assert text("<article>" + "<div>" * 3000 + "deep</article>") == "deep" and text("<article><p 'x>y</article>") in ("", "y")
    assert len(text("<article>" + "<p>word</p>" * 50_000 + "</article>").split("\n")) == 50_000


def test_longest_common_subsequences():
    rng = np.random.default_rng(4)
    for _ in range(60):
        a, b = (rng.integers(0, 5, rng.integers(0, 30)) for _ in range(2))
        got = wrapper._common(a, b)
        assert len(got) == passages.common(a, b) and all(a[i] == b[j] for i, j in got)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:]))


def test_expressions_repeat_and_become_optional():
    e = wrapper.expression(wrapper.parse("<ul><li>a<li>b<li>c</ul><dl><dt>x<dd>y<dt>z<dd>w</dl>"))
    assert [(i[0], i[1]) for i in e] == [("ul", "1"), ("dl", "1")] and [(i[0], i[1]) for i in e[0][4]] == [("li", "+")]
    assert e[0][4][0][4][0][3] is None and e[1][4][0][0] == "(dt dd)" and e[1][4][0][1] == "+"
    two = wrapper.align(wrapper.expression(wrapper.parse("<h1>t</h1><p>a</p><hr><div>d</div>")), wrapper.expression(wrapper.parse("<h1>t</h1><div>e</div>")))
    assert [(i[0], i[1]) for i in two] == [("h1", "1"), ("p", "?"), ("div", "1")]
    assert two[0][4][0][3] == "t" and two[2][4][0][3] is None
    assert json.loads(json.dumps(two)) == two


def test_nearest_neighbours_recall_and_exact_scores(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((3000, 32)).astype("float32")
    x[500:1500] = x[500]  # a third of all rows are one vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9000, None), (9100, [0.0] * 32), (9200, [float("nan")] * 32), (9300, [1.0, None] * 16), (None, x[0].tolist())]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).toPandas()
    assert set(got.query_id) == set(range(0, 3000, 100)) and (got.groupby("query_id")["rank"].max() == 10).all()
    hit = 0
    for q, g in got.groupby("query_id"):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        d[q] = np.inf
        order = np.lexsort((np.arange(3000), d))[:10]
        hit += len(set(order) & set(g.vec_id))
        g = g.sort_values("rank")
        assert np.array_equal(g.score.to_numpy(), np.sqrt(((x[g.vec_id].astype(float) - x[q].astype(float)) ** 2).sum(1))) or np.allclose(g.score, d[g.vec_id], rtol=0, atol=1e-12)
        if 500 <= q < 1500:
            assert g.vec_id.tolist() == [i for i in range(500, 511) if i != q][:10]
    assert hit >= 0.9 * 10 * got.query_id.nunique()
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    small = ann.search(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<float>")).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in small] == [(0, 1, 1)]


def test_language_gradients_are_right():
    net = langid.Network.new(["a", "b", "c"], 3, 1)
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 256, (5, 4)).astype(np.uint8), rng.integers(0, 3, 4)
    _, grads = net.loss(x, y)
    for w, g in zip(net.weights, grads, strict=True):
        for _ in range(5):
            at = tuple(rng.integers(0, s) for s in w.shape)
            if w.shape[1] == 256:
                at = (at[0], x[rng.integers(5), rng.integers(4)])
            old = w[at]
            w[at] = old + 1e-5
            up = net.loss(x, y)[0]
            w[at] = old - 1e-5
            down = net.loss(x, y)[0]
            w[at] = old
            assert (up - down) / 2e-5 == pytest.approx(g[at], abs=1e-7)


def test_language_fast_path_equals_training_path():
    net = langid.Network.new(["a", "b"], 4, 2)
    x = np.random.default_rng(1).integers(0, 256, (6, 3)).astype(np.uint8)
    fwd, bwd = net.ahead.forward(x)[0], net.behind.forward(x[::-1])[0][::-1]
    logits = np.einsum("ch,thb->tcb", net.w, np.concatenate((fwd, bwd), axis=1)) + net.b
    p = np.exp(logits) / np.exp(logits).sum(1, keepdims=True)
    assert np.allclose(net.probabilities(x, np.array([6, 6, 6])), p.sum(0), atol=1e-4)
    short = net.probabilities(x, np.array([6, 3, 1]))
    assert np.allclose(short.sum(0), [6, 3, 1], atol=1e-4) and np.allclose(short[:, 1:2], net.probabilities(x[:3, 1:2], np.array([3])), atol=1e-4)


def test_language_is_learnt_and_held_out_rows_are_not(spark):
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = docs(spark, [(9001, None), (9002, ""), (9003, "123 !!"), (None, "the of and")]).select(*df.columns)
    got = langid.identify(df.unionByName(odd)).join(df.select("doc_id", "lang"), "doc_id", "left").toPandas()
    new = got[got.held_out & got.lang.notna()]
    assert (new.lang == new.lang_pred).mean() > 0.95
    assert set(got[got.doc_id.isin([9001, 9002, 9003])].lang_pred) == {"und"} and got.score.between(0, 1).all()
    none = langid.identify(df.withColumn("lang", df["lang"].substr(9, 1)).where("1 = 0").unionByName(odd))
    assert none.count() == 4


def test_odd_rows_do_not_break_an_operator(spark, path):
    df = with_extra(docs(spark, odd_rows()))
    n = len(odd_rows())
    j = {(r.doc_id, r.n_shingles): r.component_id for r in ngram_join.join(df).collect()}
    assert j[1, 0] == 1 and j[2, 0] == 2 and j[3, 0] == 3 and j[6, 1] == 5 and [v for (d, _), v in j.items() if d == 8] == [7]
    assert quality.verdicts(df).count() == n and quality.clean(df).columns == df.columns
    once = ngram_join.one_of_each(df)
    assert sorted(r.doc_id or 0 for r in once.collect()) == [0, 1, 2, 3, 5, 7, 9] and once.columns == df.columns
    p = passages.passages(df).toPandas()
    assert p.doc_id.tolist() == [8] and p.n_words.tolist() == [30_000]
    assert passages.without_repeats(df).count() == n - 1
    assert tokenbin.token_files(df, path).count() == n
    packed = packing.pack(df, path).toPandas()
    assert packed.length.sum() == packed.groupby(packed.doc_id.fillna(-1)).length.sum().sum()
    assert mixing.mixture(df).count() == n and set(mixing.mix(df).columns) == set(df.columns)
    assert langid.identify(df).count() == n
    empty = df.where("1 = 0")
    for f in (ngram_join.join, quality.verdicts, quality.clean, passages.passages, passages.without_repeats, mixing.mixture, mixing.mix, langid.identify, lambda d: tokenbin.token_files(d, path), lambda d: packing.pack(d, path)):
        assert f(empty).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string, host string, text string")
    assert warc.archive(pages).count() == 0 and wrapper.extract(pages).count() == 0


def test_stage_columns_and_decisions(spark):
    import corpus_pipeline as c

    assert [n for n, _ in c.STAGES] == ["quality rules", "near duplicates", "repeated passages", "mixed sources", "packed sequences"]
    base = [(i, " ".join(rng_words(i, 150, 5000)), "ab"[i % 2]) for i in range(20)]
    rows = [*base, (50, base[0][1], "a"), (51, " ".join(near(base[1][1].split(), 1, 3)), "b"), (52, "too short", "a"), (53, None, "a")]
    df = docs(spark, rows)
    kept = df
    for name, stage in c.STAGES[:-1]:
        kept = stage(spark, kept, "").cache()
        assert kept.columns == df.columns, name
        ids = {r.doc_id for r in kept.collect()}
        assert not ids & {52, 53}
        if name != "quality rules":
            assert not ids & {50, 51}
        if name != "mixed sources":
            assert set(range(20)) <= ids
    got = c.STAGES[-1][1](spark, kept, "").toPandas()
    assert set(got.doc_id) == {r.doc_id for r in kept.collect()}


def test_arrow_of_odd_columns():
    assert langid.predict(langid.Network.new(["a"], 2, 0), pa.array([None, "", "x"], pa.string()))[0] == ["und", "und", "a"]


def test_runs_of_one_word_meet_one_document_each(spark):
    """Documents with runs of one word, of which all have 4 words in common: each run of 50 is found, and pairs of documents don't grow with their square."""
    from pyspark.sql import functions as F

    rows = [(d, " ".join(["of"] * (45 + d) + [f"w{d}_{j}" for j in range(60)])) for d in range(60)]
    df, rule = docs(spark, rows).withColumn("key", F.xxhash64("text")), passages.Rule()
    chained = passages._chained(passages._met(df, rule), rule)
    found = passages._aligned(df, chained.where("doc <> ref"), rule).where("false")  # as if nothing were found before
    pairs = passages._pairs(chained.where("doc = ref"), found, rule)
    equal = passages._equal(df, pairs, rule).collect()
    assert {r.ref for r in equal} == {5} and {r.doc for r in equal} == set(range(6, 60)) and len(equal) <= 4 * 60
    met = passages._promising(df, passages._left(pairs, passages._aligned(df, passages._equal(df, pairs, rule), rule), rule), rule)
    assert met.count() <= 15  # 1 to 5, whose runs are shorter than a passage, at most
    got = {(r.doc_id, r.start_word, r.end_word) for r in passages.passages(docs(spark, rows)).collect()}
    for d in range(6, 60):
        assert {w for k, s, e in got if k == d for w in range(s, e)} >= set(range(45 + d))


def test_seeds_and_matches_are_shuffled_in_blocks(spark):
    """A row of the shuffle holds many matches, and all of them come out again."""
    from pyspark.sql import functions as F

    rows = [(d, " ".join(rng_words(d % 4, 300, 5_000) + rng_words(50 + d, 300, 5_000))) for d in range(40)]
    df = docs(spark, rows).withColumn("key", F.xxhash64("text"))
    matches = passages._matches(df, passages.Rule())
    assert {(r.doc % 4, r.ref % 4) for r in matches.collect()} == {(i, i) for i in range(4)}
    assert matches.count() > 4 * passages._met(df, passages.Rule()).count()


def test_blocks_give_their_rows_back():
    rng = np.random.default_rng(5)
    cols = [rng.integers(-(2**63), 2**63 - 1, 5_000), rng.integers(0, 9, 5_000), rng.integers(0, 500, 5_000).astype(np.int32)]
    bucket = rng.integers(0, 70_000, 5_000).astype(np.int32) // 1_000
    found = defaultdict(list)
    for a in (0, 3_000):
        for b, block in _packed.blocks([c[a : a + 3_000] for c in cols], bucket[a : a + 3_000]):
            found[b].append(block)
    for b in set(bucket.tolist()):
        assert all(np.array_equal(x, c[bucket == b]) for x, c in zip(_packed.opened(found[b], passages.SEED), cols, strict=True))
    assert not list(_packed.blocks([c[:0] for c in cols], bucket[:0])) and [len(c) for c in _packed.opened([], passages.SEED)] == [0, 0, 0]


@pytest.mark.parametrize("size", [100_000, 50, 1])
def test_hot_seeds_come_in_order_with_the_rest_of_their_bucket(monkeypatch, size):
    """Rows of hot seeds are rows of the shuffle, and are never in memory together."""
    rng, most = np.random.default_rng(6), [0]
    cols = [rng.choice([-7, 3, 5, 2**60, 11], 3_000), rng.integers(-4, 90, 3_000) * 10**12, rng.integers(0, 6, 3_000).astype(np.int32)]
    bucket, hot = (cols[0] == 11).astype(np.int32), (np.abs(cols[0]) < 6) & (rng.random(3_000) < 0.9)
    rows = [(b, 0, 0, 0, block) for b, block in _packed.blocks([c[~hot] for c in cols], bucket[~hot])]
    k = np.flatnonzero(hot)[np.lexsort((cols[1][hot], cols[0][hot]))]
    rows += [(0, 1, int(cols[0][i]), int(cols[1][i]), cols[2][i : i + 1].tobytes()) for i in k]
    rows = sorted(rows, key=lambda r: r[:4])
    types = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
    batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[a : a + 7], strict=True), types, strict=True)], names=["bucket", "kind", "seed", "doc", "block"]) for a in range(0, len(rows), 7)]
    monkeypatch.setattr(passages, "ROWS", size)
    got = list(passages._of_seeds(iter(batches)))
    if size < 3_000:
        assert max(len(c[0]) for c in got) < 2_000
    seed, doc, place = (np.concatenate(c) for c in zip(*got, strict=True))
    for b in (0, 1):
        mine, theirs = np.isin(seed, cols[0][bucket == b]), bucket == b
        order = np.lexsort([c[theirs] for c in cols[::-1]])
        assert all(np.array_equal(x[mine], c[theirs][order]) for x, c in zip((seed, doc, place), cols, strict=True))


def test_matches_of_a_large_bucket_are_ordered_by_parts(monkeypatch):
    rng = np.random.default_rng(7)
    cols = [rng.integers(20, 60, 4_000), rng.integers(0, 20, 4_000), rng.integers(0, 900, 4_000).astype(np.int32), rng.integers(0, 900, 4_000).astype(np.int32), np.zeros(4_000, np.int64)]
    found, got = [block for a in range(0, 4_000, 500) for _, block in _packed.blocks([c[a : a + 500] for c in cols], np.zeros(500, np.int32))], []
    for most in (1 << 20, 300):
        monkeypatch.setattr(passages, "MATCHES", most)
        parts = list(passages._of_pairs(found, passages.Rule()))
        assert (len(parts) > 1) == (most < 4_000)
        assert all(np.array_equal(np.lexsort(p[::-1]), np.arange(len(p[0]))) for p in parts)
        pairs = [set(zip(*(c.tolist() for c in p[:2]), strict=True)) for p in parts]
        assert sum(map(len, pairs)) == len(set().union(*pairs))
        got.append(sorted(zip(*(np.concatenate(c).tolist() for c in zip(*parts, strict=True)), strict=True)))
    assert got[0] == got[1] and len(got[0]) > 3_000


def test_matches_of_pairs_of_seeds_come_whole_whatever_the_batches():
    place = pa.list_(pa.struct([("y", pa.int32()), ("wide", pa.int32())]))
    p = lambda *v: [{"y": y, "wide": w} for y, w in v]
    rows = [(9, 1, p((5, 41), (60, 43)), p((7, 40))), (9, 1, p((5, 41)), p((7, 40), (80, 42))), (9, 2, p((5, 41)), p((1, 38)))]
    want = [(9, 1, 5, 7), (9, 1, 5, 80), (9, 1, 25, 27), (9, 1, 25, 101), (9, 1, 60, 7), (9, 1, 81, 27), (9, 2, 5, 1), (9, 2, 25, 20)]
    for n in (1, 2, 3):
        batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[a : a + n], strict=True), (pa.int64(), pa.int64(), place, place), strict=True)], names=["doc", "ref", "y", "x"]) for a in range(0, 3, n)]
        got = [r for c in passages._unpacked(iter(batches)) for r in zip(*(v.tolist() for v in c[:4]), strict=True)]
        assert sorted(set(got)) == want and got == sorted(got)


def test_documents_of_a_hot_pair_meet_the_same_in_tiles(spark, monkeypatch):
    """The documents of one pair of seeds meet in many tasks, and each with all earlier ones."""
    from pyspark.sql import functions as F

    rows = [(d, " ".join([f"v{d}_{j}" for j in range(60)] + ["of"] * (41 + d % 8) + [f"w{d}_{j}" for j in range(60)])) for d in range(40)]
    df, rule, got = docs(spark, rows).withColumn("key", F.xxhash64("text")), passages.Rule(), []
    chained = passages._chained(passages._met(df, rule), rule)
    found = passages._aligned(df, chained.where("doc <> ref"), rule).where("false")  # as if nothing were found before
    pairs = passages._pairs(chained.where("doc = ref"), found, rule)
    pairs = pairs.where(F.col("key") == pairs.groupBy("key").count().orderBy(F.desc("count"), "key").first().key)
    for side in (4_096, 7):
        monkeypatch.setattr(passages, "SIDE", side)
        got.append(sorted((r.doc, r.ref) for r in passages._promising(df, pairs, rule).collect()))
    assert got[0] == got[1] == [(d, r) for d in range(40) for r in range(d)]
