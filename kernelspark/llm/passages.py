"""Fuzzy substring duplicates by collinear chaining (operator 2).

1.  Seeds: of every WINDOW consecutive K-word seeds the one with the smallest
    value, so two texts that share K + WINDOW - 1 words in a row share a seed,
    and one in SHARE of all by value, so that texts with few equal words in a
    row share seeds too.  Stretches of LONG words are seeds as well, at the
    smallest of every SPARSE places: where short seeds stand in many documents
    and meet others, these still join the documents that hold them in this
    order.  Every occurrence counts.
2.  Seeds are dealt out by value, in blocks, and sorted by document where they
    arrive; of a hot seed each document is a row that Spark sorts.  Each occurrence of a
    seed that FEW documents have is matched with all earlier ones of them; of
    a seed that more have, with the first document that has it and, for short
    seeds, with the one before.  In a document the seed's first and last place
    and the place of the same rank are matched.
3.  Matches of a pair of documents, dealt out in blocks as well, are chained: best-scoring sequences that
    advance in both texts, each seed worth K, each word of gap costing GAP,
    with a Fenwick tree of prefix maxima over the places in the other text.
4.  Chains are aligned word by word: along the seeds, through the gaps by
    longest common subsequence, and beyond both ends while that pays.  An
    alignment of at least MIN_WORDS words with at least the wanted identity is
    a repeated passage of the later document.  Where that falls short of the identity, its longest parts that have both are the passages.

5.  What is left where seeds stand that more than FEW documents have: of any
    MIN_WORDS words the smallest of the first WINDOW seeds and of the last are a
    pair, dealt out by both values.  Around pairs that lie in no passage found so
    far, and that an earlier document has, every MIN_WORDS words in a row meet
    the first document with the same words, one row each however many have them.
    Texts with MIN_WORDS equal words in a row share a pair there, and elsewhere
    all their seeds meet, so that no exact repeat is lost.
6.  A pair that has words in no passage then meets all earlier documents with
    the same pair, as far as enough of the words near it stand near theirs, and
    of theirs near it, for a passage; 3 and 4 follow.  Pairs inside passages
    need no other reference: copies aren't set against each other.

The words of both texts meet the chains in sorted streams, parts of a hub that
very many chains refer to being handled by several tasks.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kernelspark.llm import _packed as packed
from kernelspark.llm import _text as T
from kernelspark.llm._util import lean, staged

#: Documents whose words are fetched through a broadcast of their ids (8 bytes each) at most; beyond that they are joined.
FETCHED = 1_000_000
#: Passages to cut (16 bytes each) that are broadcast at most.
CUTS = 1_000_000
#: Rows of a hot seed that are put in order, seeds that are matched, and documents whose pairs of seeds are made, or that a pair is held against, at a time.
ROWS, RUNS, DOCS = 100_000, 1 << 14, 500
#: Values that words are told apart by before documents meet; words that share one only let more meet.
BUCKETS = 2048
#: Chains that refer to one document and are aligned in one task, on average.
SALT = 2_000
#: Rows of a seed, of those that a task deals out at once, from which on each of its documents is a row of the shuffle: no bucket holds a hot seed in memory.
HOT = 256
#: Matches that a task puts in order at once.
MATCHES = 1 << 20
#: Places of a pair of seeds whose documents meet in one task, of those that look for others and of those that are looked at.
SIDE = 4_096


@dataclass(frozen=True)
class Rule:
    k: int = 4
    window: int = 14
    #: One in so many seeds is chosen by its value alone, wherever it stands, besides the smallest of each window.
    share: int = 3
    #: Words of a long seed, and the places of which one begins such a seed; two texts that share long + sparse - 1 words in a row share one.
    long: int = 24
    sparse: int = 20
    gap: float = 0.08
    #: Documents of a seed that all meet at it; those of seeds that more have meet at pairs of seeds.
    few: int = 32
    #: A chain breaks where it would jump over more words than this in either text.
    most_gap: int = 40
    min_words: int = 50
    #: Percent of the words of the longer side that must be aligned with equal words.
    identity: int = 80
    #: Words that the seeds of a chain must span in both texts to be aligned; a phrase that many texts share spans less.
    span: int = 16
    #: Words beyond the outer seeds that an alignment may take in; they include the seeds that the window left out.
    reach: int = 64


def _smallest(h: np.ndarray, n: int) -> np.ndarray:
    """For every n values in a row the place of the smallest, the first of equal ones."""
    at, width = np.arange(len(h)), 1
    while width < n:
        step = min(width, n - width)
        a, b = at[: len(at) - step], at[step:]
        at = np.where(h[b] < h[a], b, a)
        width += step
    return at


def seeds(value: np.ndarray, first: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, seed) of the chosen seeds of a block; the last bit of a seed tells a long one."""
    h = T.windows(value, rule.k)
    row_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    inside = row_of[: len(h)] == row_of[rule.k - 1 :]

    def smallest(n: int) -> np.ndarray:
        at = _smallest(h, n) if len(h) >= n else np.zeros(0, np.int64)
        span = rule.k + n - 1
        chosen = np.zeros(len(h), dtype=bool)
        chosen[at[row_of[: len(at)] == row_of[span - 1 : span - 1 + len(at)]]] = True
        return np.flatnonzero(chosen)

    mark = inside & (h < np.uint64(2**64 // rule.share))
    mark[smallest(rule.window)] = True
    begin = smallest(rule.sparse)
    begin = begin[begin + rule.long <= len(value)]
    begin = begin[row_of[begin] == row_of[begin + rule.long - 1]]
    stretch = np.zeros(len(begin), np.uint64)
    for k in range(rule.long):
        stretch += T.mix(value[begin + k] + np.uint64(k))
    short = np.flatnonzero(mark)
    at = np.concatenate((short, begin))
    seed = np.concatenate((h[short] & ~np.uint64(1), T.mix(stretch) | np.uint64(1)))
    row = row_of[at]
    return row, at - first[row], seed


def chains(x: np.ndarray, y: np.ndarray, rule: Rule, span: int = 0) -> list[np.ndarray]:
    """Indices of the matches of each chain that spans so many words in both texts. x: places in the other text; y: in this one, ascending.

    f(i) = k + max(0, max over j with x_j < x_i, y_j < y_i of f(j) - gap * (x_i - x_j + y_i - y_j));
    the inner maximum is a prefix maximum of f(j) + gap * (x_j + y_j) over x, which the tree holds.
    """
    n = len(x)
    if n > 1 and np.all(np.diff(x) > 0) and np.all(np.diff(y) > 0):
        order = [np.arange(n)]  # adding a match between two others costs no gap: all belong together
    else:
        rank = (np.unique(x, return_inverse=True)[1] + 1).tolist()
        size = max(rank)
        best_of, from_of = [-1.0] * (size + 1), [-1] * (size + 1)
        score, back = [0.0] * n, [-1] * n
        along, place = (rule.gap * (x.astype(np.int64) + y)).tolist(), y.tolist()
        entered, k = 0, float(rule.k)
        for i in range(n):
            while place[entered] < place[i]:  # those with a smaller y enter together
                v, r = score[entered] + along[entered], rank[entered]
                while r <= size:
                    if best_of[r] < v:
                        best_of[r], from_of[r] = v, entered
                    r += r & -r
                entered += 1
            best, r = along[i], rank[i] - 1
            at = 0
            while r:
                if best < best_of[r]:
                    best, at = best_of[r], r
                r &= r - 1
            if at:
                score[i], back[i] = k + (best - along[i]), from_of[at]
            else:
                score[i] = k
        used, order = [False] * n, []
        across = x.tolist()
        for i in np.argsort(-np.array(score), kind="stable").tolist():
            if span > rule.k and (used[i] or back[i] < 0 or used[back[i]]):
                used[i] = True  # alone it spans too little
                continue
            chain = []
            while i >= 0 and not used[i]:
                used[i] = True
                chain.append(i)
                i = back[i]
            if chain and min(across[chain[0]] - across[chain[-1]], place[chain[0]] - place[chain[-1]]) + rule.k >= span:
                order.append(np.array(chain[::-1]))
    out = []
    for c in order:
        wide = np.flatnonzero((np.diff(x[c]) > rule.most_gap) | (np.diff(y[c]) > rule.most_gap)) + 1
        for part in np.split(c, wide) if len(wide) else [c]:
            if min(x[part[-1]] - x[part[0]], y[part[-1]] - y[part[0]]) + rule.k >= span:
                out.append(part)
    return out


def common(a: np.ndarray | list[int], b: np.ndarray | list[int]) -> int:
    """Length of the longest common subsequence of two short word sequences: bit j of ``flat`` tells that b's word j adds none."""
    at: dict[int, int] = {}
    bit = 1
    for v in b:
        at[v] = at.get(v, 0) | bit
        bit <<= 1
    flat = every = bit - 1
    for v in a:
        if v in at:
            here = flat & at[v]
            flat = (flat + here | flat - here) & every
    return len(b) - flat.bit_count()


def common_at(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a and in b of the words of a longest common subsequence."""
    best = np.zeros((len(a) + 1, len(b) + 1), np.int64)
    for i, v in enumerate(a):
        best[i + 1, 1:] = np.maximum.accumulate(np.where(b == v, best[i, :-1] + 1, best[i, 1:]))
    i, j, at = len(a), len(b), []
    while best[i, j]:
        if best[i - 1, j] == best[i, j]:
            i -= 1
        elif best[i, j - 1] == best[i, j]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            at.append((i, j))
    p = np.array(at[::-1], np.int64).reshape(-1, 2)
    return p[:, 0], p[:, 1]


def equal_words(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, k: int, ends: tuple[int, int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Places in a and in b of the equal words of an alignment along the seeds; ends: where align() says it starts and ends in a and b."""
    i, j = int(x[0]), int(y[0])
    n, m = i - ends[0], j - ends[2]
    at = [np.flatnonzero(a[i - n : i] == b[j - m : j])]
    to = [at[0] + j - m]
    at[0] = at[0] + i - n
    for p, q in zip(x.tolist(), y.tolist(), strict=True):
        if p + k <= i or q + k <= j:
            continue
        skip = max(i - p, j - q, 0)
        p, q = p + skip, q + skip
        if p > i and q > j:
            u, v = common_at(a[i:p], b[j:q])
            at.append(u + i)
            to.append(v + j)
        at.append(np.arange(p, p + k - skip))
        to.append(np.arange(q, q + k - skip))
        i, j = p + k - skip, q + k - skip
    more = np.flatnonzero(a[i : ends[1]] == b[j : ends[3]])
    return np.concatenate((*at, more + i)), np.concatenate((*to, more + j))


def within_reach(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, k: int, reach: int) -> tuple[int, int, int, int]:
    """(start in a, end, start in b, end) of all that the ends of an alignment may take in."""
    n = min(int(x[0]), int(y[0]), reach)
    i, j = int(x[-1]) + k, int(y[-1]) + k
    m = min(len(a) - i, len(b) - j, reach)
    return int(x[0]) - n, i + m, int(y[0]) - n, j + m


def _beside(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, k: int, ends: tuple[int, int, int, int]) -> int:
    """Equal words of an alignment before its first seed and after its last; ends as in equal_words()."""
    before = np.count_nonzero(a[ends[0] : int(x[0])] == b[ends[2] : int(y[0])])
    return int(before + np.count_nonzero(a[int(x[-1]) + k : ends[1]] == b[int(y[-1]) + k : ends[3]]))


def parts(i: np.ndarray, j: np.ndarray, rule: Rule) -> list[tuple[int, int]]:
    """(first, last) of runs of the equal words at i and j that are passages, none inside another, as few as cover all words that lie in any."""
    n = np.arange(len(i))
    out: list[tuple[int, int]] = []
    after = [100 * (n + 1) - rule.identity * (c + 1) for c in (i, j)]
    until = [100 * n - rule.identity * c for c in (i, j)]
    if 100 * len(i) < rule.identity * rule.min_words:
        return out
    most = [np.maximum.accumulate(c[::-1])[::-1] for c in after]
    last = -1
    for p in n.tolist():
        q = max(last + 1, p + int(np.searchsorted(i[p:], i[p] + rule.min_words - 1)), p + int(np.searchsorted(j[p:], j[p] + rule.min_words - 1)))
        if q >= len(n):
            break
        if most[0][q] < until[0][p] or most[1][q] < until[1][p]:
            continue
        good = np.flatnonzero((after[0][q:] >= until[0][p]) & (after[1][q:] >= until[1][p]))
        if len(good):
            last = q + int(good[-1])
            while len(out) > 1 and p <= out[-2][1]:
                out.pop()
            out.append((p, last))
    return out


def _beyond(equal: np.ndarray) -> tuple[int, int]:
    """(words, equal ones) by which an end goes on: the best sum of +1 for equal and -2 for unequal words."""
    if not len(equal):
        return 0, 0
    total = np.cumsum(np.where(equal, 1, -2))
    n = int(np.argmax(total)) + 1
    return (n, int(equal[:n].sum())) if total[n - 1] > 0 else (0, 0)


def align(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, k: int, reach: int) -> tuple[int, int, int, int, int]:
    """Align word sequences a and b along the seeds at x in a and y in b: (start in a, end, start in b, end, equal words)."""
    equal, i, j = 0, int(x[0]), int(y[0])
    begin_a, begin_b = i, j
    # seeds that touch, with the same words between both texts, are one stretch of equal words
    first = np.flatnonzero(np.concatenate(([True], (np.diff(x) != np.diff(y)) | (np.diff(x) > k) | (np.diff(x) < 0))))
    size = x[np.append(first[1:], len(x)) - 1] + k - x[first]
    v, w = (a.tolist(), b.tolist()) if len(first) > 1 else ([], [])
    for p, q, k in zip(x[first].tolist(), y[first].tolist(), size.tolist(), strict=True):
        if p + k <= i or q + k <= j:
            continue  # inside what is aligned already
        skip = max(i - p, j - q, 0)  # a seed that overlaps the one before
        p, q = p + skip, q + skip
        if p > i or q > j:
            equal += common(v[i:p], w[j:q]) if p > i and q > j else 0
        n = k - skip
        equal += n
        i, j = p + n, q + n
    n = min(begin_a, begin_b, reach)
    more, same = _beyond((a[begin_a - n : begin_a] == b[begin_b - n : begin_b])[::-1])
    begin_a, begin_b, equal = begin_a - more, begin_b - more, equal + same
    n = min(len(a) - i, len(b) - j, reach)
    more, same = _beyond(a[i : i + n] == b[j : j + n])
    return begin_a, i + more, begin_b, j + more, equal + same


def _matches(rows: DataFrame, rule: Rule) -> DataFrame:
    """Rows (doc, ref, y, x): a seed of doc at y and of an earlier document ref at x."""

    def unpack(batches):
        for found in packed.by_bucket(batches):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in packed.opened(found, MATCH)], names=["doc", "ref", "y", "x", "seed"])

    return _met(rows, rule).mapInArrow(lean(unpack), "doc long, ref long, y int, x int, seed long").where("ref < doc").select("doc", "ref", "y", "x")


#: Columns of the blocks of seeds (seed, doc, place) and of matches (doc, ref, y, x, seed).
SEED = (np.int64, np.int64, np.int32)
MATCH = (np.int64, np.int64, np.int32, np.int32, np.int64)


def _in_order(seed: np.ndarray, doc: np.ndarray, place: np.ndarray, alone: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows by seed, document and place; those of a seed that has one row only if alone."""
    if not len(seed):
        return seed, doc, place
    order = np.argsort(seed)
    s = seed[order]
    new = np.concatenate(([True], s[1:] != s[:-1], [True]))
    if not alone:
        keep = ~(new[:-1] & new[1:])
        order, new = order[keep], new[:-1][keep]
    else:
        new = new[:-1]
    s, d, p = seed[order], doc[order], place[order]
    if not len(s):
        return s, d, p
    # by one number where it has the bits for all three
    run, least = np.cumsum(new), int(d.min())
    bits = [int(n).bit_length() for n in (run[-1], int(d.max()) - least, p.max())]
    k = np.argsort(((run << bits[1]) + (d - least) << bits[2]) + p) if sum(bits) < 63 else np.lexsort((p, d, s))
    return s[k], d[k], p[k]


def _of_seeds(batches):
    """(seed, doc, place) of the rows of _met()'s shuffle, those of a seed one after the other by document and place."""
    bucket, found, rest, hot, size = None, [], None, [], 0

    def next_of(end):
        """What is in order: all of the bucket at its end, else what comes before the document that is open."""
        nonlocal rest, hot, size
        if rest is None:
            return _in_order(*packed.opened(found, SEED), alone=False)
        cols = [np.concatenate(c) for c in zip(*hot, strict=True)] if hot else rest
        if end:
            cols, rest, hot, size = _in_order(*(np.concatenate(c) for c in zip(rest, cols, strict=True)), alone=True) if hot else rest, None, [], 0
            return cols
        seed, doc = cols[0][-1], cols[1][-1]
        before = lambda c: (c[0] < seed) | ((c[0] == seed) & (c[1] < doc))
        mine, theirs = before(rest), before(cols)
        out = _in_order(*(np.concatenate((a[mine], b[theirs])) for a, b in zip(rest, cols, strict=True)), alone=True)
        rest, hot = [c[~mine] for c in rest], [tuple(c[~theirs] for c in cols)]
        size = 0  # of the open document; it goes on until as many rows have come again
        return out

    for batch in batches:
        for b, kind, seed, doc, block in zip(*(batch.column(c).to_pylist() for c in ("bucket", "kind", "seed", "doc", "block")), strict=True):
            if b != bucket:
                if bucket is not None:
                    yield next_of(True)
                bucket, found, rest = b, [], None
            if not kind:
                found.append(block)
                continue
            if rest is None:
                rest = _in_order(*packed.opened(found, SEED), alone=True)
                found = []
            place = np.frombuffer(block, np.int32)
            hot.append((np.full(len(place), seed), np.full(len(place), doc), place))
            size += len(place)
            if size >= ROWS:
                yield next_of(False)
    if bucket is not None:
        yield next_of(True)


def _met(rows: DataFrame, rule: Rule) -> DataFrame:
    """Blocks of the rows of _matches(), and of (doc, doc, y, -1, seed) for short seeds that several documents have; the last bit tells that more than a few do."""
    buckets = packed.buckets(rows.sparkSession)

    def chosen_of(batches):
        for batch in batches:
            doc = batch.column("doc_id").to_numpy()
            for a, _, data, offsets in T.blocks(batch.column("text")):
                w = T.Words(data, offsets, lower=True)
                row, place, seed = seeds(w.value, w.first, rule)
                yield seed.view(np.int64), doc[a + row], place.astype(np.int32)

    def choose(batches):
        for seed, doc, place in packed.collected(chosen_of(batches)):
            bucket = ((seed.view(np.uint64) >> np.uint64(8)) % np.uint64(buckets)).astype(np.int32)
            order = np.sort(seed)
            edge = np.flatnonzero(np.concatenate(([True], order[1:] != order[:-1], [True])))
            hot = order[edge[:-1][np.diff(edge) >= HOT]]
            at = np.zeros(len(seed), dtype=bool)
            if len(hot):
                at = hot[np.minimum(np.searchsorted(hot, seed), len(hot) - 1)] == seed
            got = [(b, 0, 0, 0, block) for b, block in packed.blocks([c[~at] for c in (seed, doc, place)], bucket[~at])]
            k = np.flatnonzero(at)
            k = k[np.lexsort((place[k], doc[k], seed[k]))]
            edge = np.flatnonzero(np.concatenate(([True], (seed[k][1:] != seed[k][:-1]) | (doc[k][1:] != doc[k][:-1]), [True]))) if len(k) else np.zeros(0, np.int64)
            own = place[k]
            head = k[edge[:-1]]
            got += [(*key, own[s:e].tobytes()) for key, s, e in zip(zip(bucket[head].tolist(), [1] * len(head), seed[head].tolist(), doc[head].tolist(), strict=True), edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
            step = packed.BLOCKS if not len(head) else 4 * packed.BLOCKS
            for a in range(0, len(got), step):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got[a : a + step], strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["bucket", "kind", "seed", "doc", "block"])

    def matched(batches):
        first = last = None  # (seed, doc, places) of the open run's first document and of the document before
        held = None  # rows of the run that is open, or of its last document, which may go on
        ends = np.array([0, rule.long - rule.k])

        def pairs(seed, doc, place):
            nonlocal first, last
            begin = np.flatnonzero(np.concatenate(([True], (seed[1:] != seed[:-1]) | (doc[1:] != doc[:-1]))))
            count = np.diff(np.concatenate((begin, [len(seed)])))
            own, of = (seed[begin], doc[begin]), np.repeat(np.arange(len(begin)), count)
            # the documents of the runs that were open go in front
            front = [g for g in (first, last) if g is not None]
            lead = [len(g[2]) for g in front]
            d_seed, d_doc = (np.concatenate((np.array([g[k] for g in front], np.int64), c)) for k, c in enumerate(own))
            at = np.concatenate([g[2] for g in front] + [place]).astype(np.int64)
            d_count = np.concatenate((lead, count)).astype(np.int64)
            d_begin = np.cumsum(d_count) - d_count
            new = np.concatenate(([True], d_seed[1:] != d_seed[:-1]))
            if len(front) == 2:
                new[1] = False
            head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            n = len(new)
            first = (d_seed[-1], d_doc[-1], at[d_begin[-1] :]) if new[-1] else (d_seed[head[-1]], d_doc[head[-1]], at[d_begin[head[-1]] : d_begin[head[-1]] + d_count[head[-1]]])
            last = None if new[-1] else (d_seed[-1], d_doc[-1], at[d_begin[-1] :])
            mine = of + len(front)
            rank = np.arange(len(seed)) - begin[of]
            run = np.cumsum(new) - 1
            size = np.bincount(run)
            if len(front) < n and not new[len(front)]:
                size[0] = rule.few + 1  # runs are parted only when they have more
            many = (size > rule.few)[run[mine]]
            nth = (np.arange(n) - head)[mine]  # earlier documents of the run, in it
            got = []

            def match(k, ref):
                most = d_count[ref] - 1
                same = np.minimum(rank[k], most)
                for step, also in ((np.zeros_like(same), None), (same, same > 0), (most, most > same)):
                    j, r, t = (k, ref, step) if also is None else (k[also], ref[also], step[also])
                    got.append((doc[j], d_doc[r], place[j], at[d_begin[r] + t], np.zeros(len(j), np.int64)))
                    end = ends[seed[j] & 1]  # a long seed is a match of its first words and one of its last
                    j, r, t, end = j[end > 0], r[end > 0], t[end > 0], end[end > 0]
                    got.append((doc[j], d_doc[r], place[j] + end, at[d_begin[r] + t] + end, np.zeros(len(j), np.int64)))

            k = np.flatnonzero(many & (nth > 0))
            match(k, head[mine[k]])
            k = k[(nth[k] > 1) & (seed[k] & 1 == 0)]
            match(k, mine[k] - 1)
            k, lag = np.flatnonzero(~many & (nth > 0)), 1
            while len(k):
                match(k, mine[k] - lag)
                lag += 1
                k = k[nth[k] >= lag]
            k = np.flatnonzero((size[run[mine]] > 1) & (seed & 1 == 0))
            got.append((doc[k], doc[k], place[k], np.full(len(k), -1), seed[k] | many[k]))
            cols = [np.concatenate(c).astype(t, copy=False) for c, t in zip(zip(*got, strict=True), MATCH, strict=True)]
            yield _pair_bucket(cols[0], cols[1], buckets), *cols

        for cols in (tuple(c[a : a + RUNS] for c in of) for of in _of_seeds(batches) for a in range(0, len(of[0]), RUNS)):
            if held is not None:
                cols = [np.concatenate(c) for c in zip(held, cols, strict=True)]
            if not len(cols[0]):
                continue
            edge = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]))
            start = int(np.append(-1, np.flatnonzero(cols[0][1:] != cols[0][:-1]))[-1]) + 1
            if (last is None or last[0] != cols[0][-1]) and np.count_nonzero(edge >= start) <= rule.few + 1:
                edge = start  # a run of few documents stays whole
            else:
                edge = int(edge[-1]) + 1 if len(edge) else 0
            held = [c[edge:] for c in cols]
            if edge:
                yield from pairs(*(c[:edge] for c in cols))
        if held is not None and len(held[0]):
            yield from pairs(*held)

    def meet(batches):
        yield from packed.dealt(matched(batches))

    chosen = rows.where("doc_id is not null").mapInArrow(lean(choose), "bucket int, kind int, seed long, doc long, block binary")
    return packed.gathered(chosen, "kind", "seed", "doc").mapInArrow(lean(meet), packed.SCHEMA)


def _pair_bucket(doc: np.ndarray, ref: np.ndarray, n: int) -> np.ndarray:
    """The bucket of a pair of documents."""
    return ((T.mix(T.mix(doc.view(np.uint64)) + ref.view(np.uint64)) >> np.uint64(8)) % np.uint64(n)).astype(np.int32)


def _of_pairs(found: list[bytes], rule: Rule):
    """The columns of a bucket's matches, by document and reference, without the pairs of documents that can't have a chain that is wide enough."""
    rows = sum(map(len, found)) // sum(np.dtype(t).itemsize for t in MATCH)
    parts = -(-rows // MATCHES)
    for part in range(parts):
        if parts == 1:
            cols = packed.opened(found, MATCH)
        else:
            held = []
            for block in found:
                cols = packed.opened([block], MATCH)
                k = _pair_bucket(cols[1], cols[0], parts) == part
                held.append([c[k] for c in cols])
            cols = [np.concatenate(c) for c in zip(*held, strict=True)]
        doc, ref, y, x, seed = cols
        value = T.mix(T.mix(doc.view(np.uint64)) + ref.view(np.uint64))
        order = np.argsort(value)
        value, y, x = value[order], y[order], x[order]
        edge = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1], [True])))
        if len(edge) < 2:
            continue
        at = edge[:-1]
        wide = lambda v: np.maximum.reduceat(v, at) - np.minimum.reduceat(v, at) + rule.k >= rule.span
        own = (doc == ref)[order]
        often = np.logical_or.reduceat(own & (seed[order] & 1 == 1), at)
        keep = order[np.repeat((wide(y) & wide(x)) | often, np.diff(edge))]
        cols = [c[keep] for c in cols]
        order = np.lexsort(cols[::-1])
        yield [c[order] for c in cols]


def _nearby(place: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Words from a place to the nearest of the ascending places ``of``."""
    k = np.searchsorted(of, place)
    return np.minimum(of[np.minimum(k, len(of) - 1)] - place + (k == len(of)) * (1 << 40), place - of[np.maximum(k - 1, 0)] + (k == 0) * (1 << 40))


def _pairs(frequent: DataFrame, found: DataFrame, rule: Rule) -> DataFrame:
    """Rows (key, doc, y, wide) of pairs of seeds, for pairs that lie outside of the found passages in a document which isn't the first that has them.

    frequent: (doc, x, y), the values and places of a document's seeds as in _met().  wide: twice the words from the first
    seed to the second, and 1 where the pair lies outside.
    """
    apart, none = rule.min_words - rule.k + 1 - rule.window, np.uint64(2**64 - 1)

    def couple(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, DOCS):
                part = batch.slice(begin, DOCS)
                seeds = [np.frombuffer(v.as_buffer(), "<i8") for v in part.column("x")]
                places = [np.frombuffer(v.as_buffer(), "<i4") for v in part.column("y")]
                until = []  # where the found passage that begins last before a place ends
                for y, spans in zip(places, part.column("spans").to_pylist(), strict=True):
                    if spans:
                        ends = np.array([0] + [s["end_word"] for s in spans])
                        until.append(ends[np.searchsorted([s["start_word"] for s in spans], y, "right")])
                    else:
                        until.append(np.zeros(len(y), np.int64))
                n = np.array([len(y) for y in places])
                doc = np.repeat(part.column("doc").to_numpy(), n)
                seed, y, until, of = np.concatenate(seeds), np.concatenate(places).astype(np.int64), np.concatenate(until), np.repeat(np.arange(len(n)), n)
                # one line of places for all documents, with a gap between them
                width = np.array([int(v.max()) + 1 + rule.min_words if len(v) else 0 for v in places])
                line = y + (np.cumsum(width) - width)[of]
                h, row = np.full(int(width.sum()), none), np.full(int(width.sum()), -1)
                h[line], row[line] = seed.view(np.uint64) >> np.uint64(1), np.arange(len(y))
                if len(h) < rule.min_words:
                    continue
                at = row[_smallest(h, rule.window)]
                i, j = at[: len(at) - apart], at[apart:]
                k = (i >= 0) & (j >= 0)
                k[1:] &= (i[1:] != i[:-1]) | (j[1:] != j[:-1])
                i, j = i[k], j[k]
                k = of[i] == of[j]
                i, j = i[k], j[k]
                key = T.mix(T.mix(seed[i].view(np.uint64)) + seed[j].view(np.uint64)).view(np.int64)
                wanted = y[j] + rule.k > until[i]
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(doc[i]), pa.array(y[i].astype(np.int32)), pa.array((2 * (y[j] - y[i]) + wanted).astype(np.int32))], names=["key", "doc", "y", "wide"])

    coupled = frequent.select("doc", "x", "y").join(_spans(found), "doc", "left").mapInArrow(lean(couple), "key long, doc long, y int, wide int")
    return _open(staged(coupled, "passage-coupled"))


def _open(pairs: DataFrame) -> DataFrame:
    """Those of staged pairs that lie outside of found passages in a document which isn't the first that has them, with all their documents."""
    keys = staged(pairs.groupBy("key").agg(F.min("doc").alias("first"), F.max(F.when(F.col("wide") % 2 == 1, F.col("doc"))).alias("last")).where("first < last").select("key"), "passage-keys")
    few = keys.count() <= FETCHED  # the pairs stay where they are, however many have one key
    return staged(pairs.join(F.broadcast(keys) if few else keys, "key", "left_semi"), "passage-pairs")


def _left(pairs: DataFrame, found: DataFrame, rule: Rule) -> DataFrame:
    """The pairs that have words in no passage, as _pairs() gives them."""
    before = Window.partitionBy("doc_id").orderBy("start_word", "end_word")
    new = F.col("start_word") > F.coalesce(F.max("end_word").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    joined = found.select("doc_id", "start_word", "end_word", new.cast("int").alias("new")).select("doc_id", "start_word", "end_word", F.sum("new").over(before).alias("n"))
    joined = joined.groupBy("doc_id", "n").agg(F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word"))
    inside = F.expr(f"coalesce(exists(spans, s -> s.start_word <= y and s.end_word >= y + shiftright(wide, 1) + {rule.k}), false)")
    return _open(pairs.join(_spans(joined), "doc", "left").select("key", "doc", "y", F.when(inside, F.col("wide") - F.col("wide") % 2).otherwise(F.col("wide")).alias("wide")))


def _spans(found: DataFrame) -> DataFrame:
    """(doc, spans), the found passages of each document in order."""
    return found.groupBy(F.col("doc_id").alias("doc")).agg(F.sort_array(F.collect_list(F.struct("start_word", "end_word"))).alias("spans"))


def _stretches(words: np.ndarray, n: int) -> np.ndarray:
    """A value for each n words in a row."""
    h = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for a in range(0, n, 32):
        h = T.mix(h + T.windows(words, min(32, n - a))[a : a + len(h)])
    return h


def _equal(rows: DataFrame, pairs: DataFrame, rule: Rule) -> DataFrame:
    """Staged chains, as _chained() gives them: MIN_WORDS words in a row around pairs of seeds outside of found passages, and the first document that has the same words.

    Every such stretch of words meets one document, however many have it.
    """
    apart, n = rule.min_words - rule.k + 1 - rule.window, rule.min_words

    def stretches(batches):
        for batch in batches:
            got = []
            for doc, w, ys, wides in zip(*(batch.column(c) for c in ("doc", "words", "y", "wide")), strict=True):
                v = np.frombuffer(w.as_buffer(), "<u4").astype(np.uint64)
                i, wide = ys.values.to_numpy().astype(np.int64), wides.values.to_numpy().astype(np.int64)
                if len(v) < n:
                    continue
                # where a stretch begins whose first seeds have the pair's first as the smallest, and whose last the second
                j = i + (wide >> 1)
                begin, end = np.maximum(np.maximum(i - rule.window + 1, j + rule.k - n), 0), np.minimum(np.minimum(i, j - apart), len(v) - n) + 1
                begin = np.minimum(begin, end.clip(0))
                edge = np.zeros((2, len(v) + 1), np.int64)
                for m, k in ((0, end > begin), (1, (end > begin) & (wide & 1 == 1))):
                    np.add.at(edge[m], begin[k], 1)
                    np.add.at(edge[m], end[k], -1)
                there, wanted = np.cumsum(edge, axis=1)[:, : len(v) - n + 1] > 0
                at = np.flatnonzero(there)
                h, wanted = _stretches(v, n)[at], wanted[at]
                # one word again and again: stretches that touch and the last one have all its places
                new = np.concatenate(([True], (h[1:] != h[:-1]) | (wanted[1:] != wanted[:-1]) | (at[1:] != at[:-1] + 1)))[: len(at)]
                nth = np.arange(len(at)) - np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
                keep = (nth % n == 0) | np.concatenate((new[1:], [True]))[: len(at)]
                got.append((h[keep].view(np.int64), np.full(int(keep.sum()), doc.as_py()), at[keep].astype(np.int32), wanted[keep]))
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*got, strict=True)], names=["value", "doc", "y", "wanted"])

    def meet(batches):
        first = None  # (value, doc, place) of the first row of the run that is open
        for batch in batches:
            value, doc, y = (batch.column(c).to_numpy() for c in ("value", "doc", "y"))
            if not len(value):
                continue
            wanted = batch.column("wanted").to_numpy(zero_copy_only=False)
            if first is not None:
                value, doc, y, wanted = (np.concatenate(([a], b)) for a, b in zip((*first, False), (value, doc, y, wanted), strict=True))
            run = np.concatenate(([True], value[1:] != value[:-1]))
            head = np.maximum.accumulate(np.where(run, np.arange(len(run)), 0))
            first = (value[head[-1]], doc[head[-1]], y[head[-1]])
            k = np.flatnonzero(wanted & (doc != doc[head]))
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(t)) for c, t in ((doc[k], np.int64), (doc[head[k]], np.int64), (y[k], np.int32), (y[head[k]], np.int32))], names=["doc", "ref", "y", "x"])

    def line_up(batches):
        doc = ref = shift = begin = until = spare = None  # the open run of equal words; the last stretch that adds to it and isn't of it
        got = []

        def close():
            if doc is not None:
                y = np.append(np.arange(begin, until - rule.k, rule.k), until - rule.k).astype("<i4")
                got.append((doc, ref, (y - shift).astype("<i4").tobytes(), y.tobytes()))

        for batch in batches:
            for d, r, y, x in zip(*(batch.column(c).to_pylist() for c in ("doc", "ref", "y", "x")), strict=True):
                if spare is not None and (d != doc or y > until):
                    close()
                    ref, begin, shift = spare
                    until, spare = begin + n, None
                if d == doc and r == ref and y - x == shift and y <= until:
                    until, spare = y + n, None
                elif d == doc and y <= until:
                    spare = (r, y, y - x)
                else:
                    close()
                    doc, ref, begin, shift, until = d, r, y, y - x, y + n
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["doc", "ref", "x", "y"])
                got.clear()
        if spare is not None:
            close()
            ref, begin, shift = spare
            until = begin + n
        close()
        if got:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["doc", "ref", "x", "y"])

    of = pairs.groupBy("doc").agg(F.collect_list(F.struct("y", "wide")).alias("p")).select("doc", "p.y", "p.wide")
    words = _words_of(rows, of.select("doc")).join(of, "doc")
    every = words.select("doc", "words", "y", "wide").mapInArrow(lean(stretches), "value long, doc long, y int, wanted boolean")
    met = every.repartition("value").sortWithinPartitions("value", "doc", "y").mapInArrow(lean(meet), "doc long, ref long, y int, x int")
    return staged(met.repartition("doc").sortWithinPartitions("doc", "y", "ref").mapInArrow(lean(line_up), "doc long, ref long, x binary, y binary"), "passage-stretches")


def _promising(rows: DataFrame, pairs: DataFrame, rule: Rule) -> DataFrame:
    """Staged (doc, ref): the earlier documents that have a pair of seeds outside of found passages, and enough words near it that stand near doc's pair.

    An alignment that is a passage has MIN_WORDS to twice as many words in a row that are equal as far as the identity asks, so
    that as many of them are words of the other text.  Where that can't be, the documents needn't meet.
    """
    near, far = 2 * rule.min_words, 2 * rule.min_words + rule.reach
    longest = rule.min_words + 2 * near  # words near the place of a pair

    def outline(batches):
        for batch in batches:
            got = []
            for doc, w, p in zip(*(batch.column(c) for c in ("doc", "words", "p")), strict=True):
                v = (np.frombuffer(w.as_buffer(), "<u4") % BUCKETS).astype("<u2")
                key, y, wide = (p.values.field(c).to_numpy() for c in ("key", "y", "wide"))
                order = np.lexsort((wide, y, key))
                key, y, wide = key[order], y[order].astype(np.int64), wide[order]
                until = y + (wide >> 1) + rule.k

                def of(*places):
                    there = np.zeros(BUCKETS, dtype=bool)
                    for k in places:
                        there[v[max(0, y[k].min() - far) : until[k].max() + far]] = True  # noqa: B023
                    return np.packbits(there, bitorder="little").tobytes()

                edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
                for s, e in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                    ends = np.full((2, longest), BUCKETS, "<u2")
                    for n, k in enumerate((s, e - 1)):
                        words = v[max(0, y[k] - near) : until[k] + near][:longest]
                        ends[n, : len(words)] = words
                    got.append((key[s], doc.as_py(), 0, of(slice(s, s + 1), slice(e - 1, e)), ends.tobytes()))
                    k = s + np.flatnonzero(wide[s:e] & 1)
                    while len(k):  # places that are close by together
                        n = int(np.searchsorted(y[k], y[k[0]] + rule.reach, "right"))
                        got.append((key[s], doc.as_py(), 1, of(k[:n]), v[max(0, y[k[0]] - near) : int(until[k[:n]].max()) + near].tobytes()))
                        k = k[n:]
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["key", "doc", "open", "there", "words"])

    def enough(equal):
        """Whether so many words in a row, of each row, are equal."""
        out = np.zeros(len(equal), dtype=bool)
        k = np.flatnonzero(100 * equal.sum(axis=1, dtype=np.int64) >= rule.identity * rule.min_words) if equal.shape[1] >= rule.min_words else []
        if len(k):
            total = np.zeros((len(k), equal.shape[1] + 1), np.int32)
            np.cumsum(np.where(equal[k], 100 - rule.identity, -rule.identity), axis=1, out=total[:, 1:])
            out[k] = (total[:, rule.min_words :] >= np.minimum.accumulate(total, axis=1)[:, : -rule.min_words]).any(axis=1)
        return out

    def alike(there, ends, mine, words):
        at = np.frombuffer(words, "<u2").astype(np.int64)
        k = np.flatnonzero(enough((there[:, at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))
        own = np.append(np.unpackbits(np.frombuffer(mine, np.uint8), bitorder="little").astype(bool), False)
        return k[enough(own[ends[k, 0]]) | enough(own[ends[k, 1]])]

    def meet(batches):
        key, n = None, 0  # (key, tile), and documents of it so far
        refs, there, ends = np.zeros(64, np.int64), np.zeros((64, BUCKETS // 8), np.uint8), np.zeros((64, 2, longest), np.uint16)
        for batch in batches:
            docs, ref = [], []
            for k, tile, doc, late, bits, words in zip(*(batch.column(c).to_pylist() for c in ("key", "tile", "doc", "open", "there", "words")), strict=True):
                if (k, tile) != key:
                    key, n = (k, tile), 0
                if not late:
                    if n == len(refs):
                        refs, there, ends = (np.concatenate((c, np.zeros_like(c))) for c in (refs, there, ends))
                    refs[n], there[n], ends[n] = doc, np.frombuffer(bits, np.uint8), np.frombuffer(words, "<u2").reshape(2, longest)
                    n += 1
                else:
                    most = n - int(n > 0 and refs[n - 1] == doc)  # its own row is the last where it is in the tile
                    for a in range(0, most, DOCS):
                        b = min(a + DOCS, most)
                        found = refs[a + alike(there[a:b], ends[a:b], bits, words)]
                        docs.append(np.full(len(found), doc))
                        ref.append(found)
            if docs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (docs, ref)], names=["doc", "ref"])

    of = pairs.groupBy("doc").agg(F.collect_list(F.struct("key", "y", "wide")).alias("p"))
    words = _words_of(rows, of.select("doc")).join(of, "doc")
    every = words.select("doc", "words", "p").mapInArrow(lean(outline), "key long, doc long, open int, there binary, words binary")
    # documents of a pair that very many have meet in tiles: a part of those that look and a part of those that are looked at
    hot = pairs.groupBy("key").agg(F.ceil(F.count("*") / F.lit(SIDE)).alias("along"), F.ceil(F.sum(F.col("wide") % 2) / F.lit(SIDE)).alias("across")).where("along > 1")
    side = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(1)), F.lit(1)).cast("int")
    dealt = every.join(F.broadcast(hot), "key", "left").withColumns({"along": side("along"), "across": side("across")})
    group = lambda n: F.pmod(F.xxhash64("doc"), F.col(n).cast("long")).cast("int")
    to = F.when(F.col("open") == 0, F.transform(F.sequence(F.lit(0), F.col("across") - 1), lambda i: i * F.col("along") + group("along")))
    to = to.otherwise(F.transform(F.sequence(F.lit(0), F.col("along") - 1), lambda j: group("across") * F.col("along") + j))
    dealt = dealt.select("key", F.explode(to).alias("tile"), "doc", "open", "there", "words")
    dealt = dealt.repartition(packed.partitions(rows.sparkSession), "key", "tile").sortWithinPartitions("key", "tile", "doc", "open")
    return staged(dealt.mapInArrow(lean(meet), "doc long, ref long").distinct(), "passage-promising")


def _rest(pairs: DataFrame, promising: DataFrame) -> DataFrame:
    """Rows (doc, ref, y, x): places of a pair of seeds outside of found passages (``place``, ``wide`` as in _pairs()), and its first and last place in a promising earlier document."""
    place = F.struct("y", "wide")
    theirs = pairs.groupBy("key", F.col("doc").alias("ref")).agg(F.array_distinct(F.array(F.min(place), F.max(place))).alias("x"))
    mine = pairs.where("wide % 2 = 1").groupBy("key", "doc").agg(F.collect_list(place).alias("y"))
    return mine.join(promising, "doc").join(theirs, ["key", "ref"]).select("doc", "ref", "y", "x")


def _unpacked(batches):
    """The columns (doc, ref, y, x, seed) of the matches of the rows of _rest(), in order: both seeds of each pair; whole pairs of documents."""
    held = None  # the matches of the pair of documents that may go on
    for batch in batches:
        if not batch.num_rows:
            continue
        doc, ref = (batch.column(c).to_numpy() for c in ("doc", "ref"))
        mine, theirs = batch.column("y"), batch.column("x")
        (y, w), (x, v) = (tuple(c.flatten().field(f).to_numpy().astype(np.int64) for f in ("y", "wide")) for c in (mine, theirs))
        n, m = (np.diff(c.offsets.to_numpy()) for c in (mine, theirs))
        of, first = np.repeat(np.arange(len(n)), n), np.cumsum(m) - m
        got = [] if held is None else [held]
        for t in range(int(m.max(initial=0))):
            k = np.flatnonzero(m[of] > t)
            r = first[of[k]] + t
            for p, q in ((y[k], x[r]), (y[k] + (w[k] >> 1), x[r] + (v[r] >> 1))):
                got.append((doc[of[k]], ref[of[k]], p.astype(np.int32), q.astype(np.int32)))
        cols = [np.concatenate(c) for c in zip(*got, strict=True)]
        order = np.lexsort(cols[::-1])
        cols = [c[order] for c in cols]
        last = (cols[0] == doc[-1]) & (cols[1] == ref[-1])
        held = [c[last] for c in cols]
        yield [*(c[~last] for c in cols), np.zeros(np.count_nonzero(~last), np.int64)]
    if held is not None:
        yield [*held, np.zeros(len(held[0]), np.int64)]


def _chained(matches: DataFrame, rule: Rule, rest: bool = False) -> DataFrame:
    """Staged chains that are wide enough: (doc, ref, x, y), the places of their seeds as 32-bit integers.

    matches: as _met() gives them; rest: the rows of _rest().  Where ref is doc, x has the document's seeds as 64-bit integers and y their places, as far as they lie near one that more than a few documents have.
    """

    def chain(batches):
        for cols in _unpacked(batches) if rest else (cols for found in packed.by_bucket(batches) for cols in _of_pairs(found, rule)):
            new = np.concatenate(([True], np.any([c[1:] != c[:-1] for c in cols], axis=0)))[: len(cols[0])]
            cols = [c[new] for c in cols]
            if len(cols[0]):
                yield from out(cols, np.flatnonzero(np.concatenate(([True], (np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0), [True]))).tolist())

    def out(cols, edges):
        got = []
        doc, ref, y, x, seed = cols
        single = doc == ref
        for s, e in zip(edges[:-1], edges[1:], strict=True):
            if single[s]:
                often = y[s:e][seed[s:e] & 1 == 1]
                if len(often):
                    near = np.flatnonzero(_nearby(y[s:e].astype(np.int64), often.astype(np.int64)) < rule.min_words)
                    got.append((doc[s], doc[s], seed[s:e][near].astype("<i8").tobytes(), y[s:e][near].astype("<i4").tobytes()))
        # a chain lies in one run of matches without a gap in y that is too wide; runs that can't hold a wide enough one go
        edges = np.union1d(edges, np.flatnonzero(np.diff(y) > rule.most_gap) + 1)
        at, last = edges[:-1], edges[1:] - 1
        n = last - at + 1
        far = (y[last] - y[at] + rule.k >= rule.span) & (np.maximum.reduceat(x, at) - np.minimum.reduceat(x, at) + rule.k >= rule.span)
        step = np.zeros(len(at), dtype=bool)  # two matches that can follow each other in a chain, looked for in runs of up to three
        for i, j in ((0, 1), (1, 2), (0, 2)):
            k = np.flatnonzero(far & (n > j) & (n < 4))
            step[k] |= (x[at[k] + j] > x[at[k] + i]) & (x[at[k] + j] - x[at[k] + i] <= rule.most_gap) & (y[at[k] + j] > y[at[k] + i])
        far &= (step | (n > 3)) & ~single[at]
        for s, e in zip(at[far].tolist(), (last[far] + 1).tolist(), strict=True):
            for c in chains(x[s:e], y[s:e], rule, rule.span):
                got.append((doc[s], ref[s], x[s:e][c].astype("<i4").tobytes(), y[s:e][c].astype("<i4").tobytes()))
        if got:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["doc", "ref", "x", "y"])

    # dealt to a number of partitions that doesn't shrink with the bytes: the work is in the rows
    rows = matches.repartition(packed.partitions(matches.sparkSession), "doc", "ref").sortWithinPartitions("doc", "ref") if rest else packed.gathered(matches)
    return staged(rows.mapInArrow(lean(chain), "doc long, ref long, x binary, y binary"), "passage-chains")


def _words_of(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Staged (doc, words, key): 32-bit word values, little-endian, of the documents in ids (doc), and the text's key."""
    spark = rows.sparkSession
    few = ids.count() <= FETCHED
    known = spark.sparkContext.broadcast(np.sort(ids.toArrow()["doc"].to_numpy())) if few else None
    rows = rows if few else rows.join(ids.withColumnRenamed("doc", "doc_id"), "doc_id", "left_semi")

    def take(batches):
        for batch in batches:
            batch = batch.filter(batch.column("doc_id").is_valid())
            if known is not None:
                doc = batch.column("doc_id").to_numpy()
                at = np.minimum(np.searchsorted(known.value, doc), max(len(known.value) - 1, 0))
                batch = batch.filter(pa.array(known.value[at] == doc if len(known.value) else np.zeros(len(doc), dtype=bool)))
            for a, b, data, offsets in T.blocks(batch.column("text")):
                w = T.Words(data, offsets, lower=True)
                v = w.value.astype("<u4")
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array([v[s:e].tobytes() for s, e in zip(w.first[:-1], w.first[1:], strict=True)], pa.binary()), batch.column("key").slice(a, b - a)], names=["doc", "words", "key"])

    # rows that share an id: one of their texts is aligned, and its key tells which
    one = rows.mapInArrow(lean(take), "doc long, words binary, key long").groupBy("doc").agg(F.max_by(F.struct("words", "key"), "key").alias("one"))
    return staged(one.select("doc", "one.words", "one.key"), "passage-words")


def passages(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """A row for each repeated passage: doc_id, start_word, end_word, ref_doc_id, ref_start_word, ref_end_word, n_words, n_equal, text_key.

    Spans are in words ``[^\\x20\\x09-\\x0D]+`` of the text (A-Z compared in
    lower case), the end excluded.  The reference is an earlier document (by
    doc_id) with the same seeds; the first
    document that holds a passage has no row for it, and repeats within one
    document are not looked for.  Of the spans of a document none lies inside
    another; of equal ones that with the smallest reference stays.  Rows
    without id or text and texts of fewer words than a passage have no rows.
    Rows with one id are one document; where their texts differ, one of them is
    aligned, the one with text_key as xxhash64 of its text.  An empty table
    gives no rows.  Other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("key", F.xxhash64("text"))
    chained = _chained(_met(rows, rule), rule)
    found = staged(_aligned(rows, chained.where("doc <> ref"), rule), "passages-first")
    frequent = chained.where("doc = ref")
    if frequent.isEmpty():
        return found
    pairs = _pairs(frequent, found, rule)
    if pairs.isEmpty():
        return found
    equal = _equal(rows, pairs, rule)
    if not equal.isEmpty():
        found = staged(_outermost(found.unionAll(_aligned(rows, equal, rule))), "passages-equal")
    pairs = _left(pairs, found, rule)
    rest = _chained(_rest(pairs, _promising(rows, pairs, rule)), replace(rule, most_gap=rule.min_words), rest=True)  # the seeds of a pair are a chain
    if rest.isEmpty():
        return found
    return _outermost(found.unionAll(_aligned(rows, rest, rule)))


def _outermost(found: DataFrame) -> DataFrame:
    """Of the spans of a document those that lie in no other; of equal ones that with the smallest reference."""
    before = Window.partitionBy("doc_id").orderBy("start_word", F.desc("end_word"), "ref_doc_id").rowsBetween(Window.unboundedPreceding, -1)
    return found.withColumn("__until", F.max("end_word").over(before)).where("__until is null or end_word > __until").drop("__until")


def _aligned(rows: DataFrame, chained: DataFrame, rule: Rule) -> DataFrame:
    """The passages of staged chains, as passages() gives them."""
    ids = chained.select("doc").unionAll(chained.select(F.col("ref").alias("doc"))).distinct()
    words = _words_of(rows, ids)
    own = rule.reach

    def cut(batches):
        """Give each chain the words of its document around it."""
        held = None
        for batch in batches:
            out = []
            for doc, ref, x, y, w, key in zip(*(batch.column(c).to_pylist() for c in ("doc", "ref", "x", "y", "words", "key")), strict=True):
                if ref is None:
                    held = (doc, np.frombuffer(w, "<u4"), key)
                elif held is not None and held[0] == doc:
                    p = np.frombuffer(y, "<i4")
                    a, b = max(0, int(p[0]) - own), min(len(held[1]), int(p[-1]) + rule.k + own)
                    if int(p[-1]) + rule.k <= len(held[1]):
                        out.append((doc, ref, x, y, a, held[1][a:b].tobytes(), held[2]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.int64()), strict=True)], names=["doc", "ref", "x", "y", "at", "words", "key"])

    none = F.lit(None).cast("binary")
    mine = chained.select("doc", "ref", "x", "y", none.alias("words"), F.lit(0).cast("long").alias("key")).unionAll(words.select("doc", F.lit(None).cast("long").alias("ref"), none.alias("x"), none.alias("y"), "words", "key"))
    mine = mine.repartition("doc").sortWithinPartitions(F.col("doc"), F.col("ref").asc_nulls_first(), F.col("y"))
    mine = mine.mapInArrow(lean(cut), "doc long, ref long, x binary, y binary, at int, words binary, key long")
    hubs = chained.groupBy("ref").agg(F.ceil(F.count("*") / F.lit(SALT)).cast("int").alias("parts"))
    theirs = hubs.join(words.withColumnRenamed("doc", "ref"), "ref").select("ref", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("doc"), none.alias("x"), none.alias("y"), F.lit(0).alias("at"), "words", "key")
    mine = mine.join(hubs, "ref").select("ref", F.pmod(F.xxhash64("doc"), F.col("parts").cast("long")).cast("int").alias("part"), "doc", "x", "y", "at", "words", "key")
    names = ["doc_id", "start_word", "end_word", "ref_doc_id", "ref_start_word", "ref_end_word", "n_words", "n_equal", "text_key"]

    def line_up(batches):
        held = None
        for batch in batches:
            out = []
            for ref, doc, x, y, shift, w, key in zip(*(batch.column(c).to_pylist() for c in ("ref", "doc", "x", "y", "at", "words", "key")), strict=True):
                v = np.frombuffer(w, "<u4")
                if doc is None:
                    held = (ref, v)
                    continue
                if held is None or held[0] != ref:
                    continue
                p, q = np.frombuffer(x, "<i4").astype(np.int64), np.frombuffer(y, "<i4").astype(np.int64)
                if p[-1] + rule.k > len(held[1]):
                    continue
                # seeds of another text of the same id don't fit
                fit = np.all(held[1][p[:, None] + np.arange(rule.k)] == v[(q - shift)[:, None] + np.arange(rule.k)], axis=1)
                if not fit.any():
                    continue
                p, q = p[fit], q[fit]
                a, b = max(0, int(p[0]) - own), min(len(held[1]), int(p[-1]) + rule.k + own)
                s, e, t, u, equal = align(held[1][a:b], v, p - a, q - shift, rule.k, own)
                if min(e - s, u - t) >= rule.min_words and 100 * equal >= rule.identity * max(e - s, u - t):
                    out.append((doc, t + shift, u + shift, ref, s + a, e + a, u - t, equal, key))
                else:
                    ends = within_reach(held[1][a:b], v, p - a, q - shift, rule.k, own)
                    if 100 * (equal + _beside(held[1][a:b], v, p - a, q - shift, rule.k, ends)) < rule.identity * rule.min_words:
                        continue  # too few equal words for any part
                    i, j = equal_words(held[1][a:b], v, p - a, q - shift, rule.k, ends)
                    out += [(doc, int(j[f]) + shift, int(j[g]) + 1 + shift, ref, int(i[f]) + a, int(i[g]) + 1 + a, int(j[g] - j[f]) + 1, g - f + 1, key) for f, g in parts(i, j, rule)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)

    both = theirs.unionAll(mine).repartition(packed.partitions(rows.sparkSession), "ref", "part").sortWithinPartitions(F.col("ref"), F.col("part"), F.col("doc").asc_nulls_first(), F.col("y"))
    return _outermost(both.mapInArrow(lean(line_up), ", ".join(f"{c} long" for c in names)))


def without_repeats(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """docs with all columns, the repeated passages cut from the text of the later documents; n_chars follows where there is one.

    Documents that had no other words are left out.  Where rows of one id have
    different texts, only those with the text that was aligned are cut.
    """
    found = staged(passages(docs, rule), "passages").groupBy(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).agg(F.sort_array(F.collect_list(F.struct("start_word", "end_word"))).alias("__cut"))
    found = staged(found, "passage-cuts")
    found = F.broadcast(found) if (found.agg(F.sum(F.size("__cut"))).first()[0] or 0) <= CUTS else found  # few: the texts stay where they are
    every = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("__doc"), docs["doc_id"].cast("long").alias("__doc_id"), F.xxhash64(docs["text"].cast("string")).alias("__text_key"))
    rows = every.join(found, (F.col("__doc_id") == F.col("__id")) & (F.col("__text_key") == F.col("__key")), "left")
    clean = rows.where("__cut is null").select("__doc.*")
    schema, names = docs.schema, docs.columns

    def cut(batches):
        for batch in batches:
            keep, text = [], []
            own = dict(zip(names, batch.column("__doc").flatten(), strict=True))
            for k, (t, spans) in enumerate(zip(own["text"].to_pylist(), batch.column("__cut").to_pylist(), strict=True)):
                raw = (t or "").encode()
                w = T.Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)], np.int64), hashed=False)
                gone = np.zeros(len(w.start), dtype=bool)
                for s in spans:
                    gone[s["start_word"] : s["end_word"]] = True
                if len(gone) and gone.all():
                    continue
                edge = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))
                at, parts = 0, []
                for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                    parts.append(raw[at : w.start[s]])
                    at = int(w.start[e]) if e < len(w.start) else len(raw)
                keep.append(k)
                text.append((b"".join(parts) + raw[at:]).decode())
            cols = {c: v.take(pa.array(keep, pa.int64())) for c, v in own.items()}
            cols["text"] = pa.array(text, pa.string())
            if "n_chars" in cols:
                cols["n_chars"] = pa.array([len(t) for t in text], pa.int64()).cast(cols["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=names)

    return clean.unionAll(rows.where("__cut is not null").select("__doc", "__cut").mapInArrow(lean(cut), schema))
