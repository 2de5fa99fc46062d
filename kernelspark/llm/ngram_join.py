"""N-gram Jaccard self-join by rare-first prefix filtering (operator 3).

A document is the set of its distinct n-word shingles (64-bit values).  Texts
with equal sets are one class, found by a value of the set, and only classes
are joined.

1.  Scan: set size and class of every document; with it a count sketch: every
    shingle of every document adds one to one of 2^BITS counters, which are
    summed over all tasks.  The sketch has a fixed size and is the same however
    the rows are dealt out.  It only decides the order, so it can't change a
    result.
2.  Prefixes: shingles in order (rarest by the sketch first, then by value); two
    sets of similarity s share one of the first n - ceil(s n) + 1 of them.
    Prefix shingles are dealt out by value and sorted by place in the prefix.
    A shingle in very many sets is dealt out in parts by set as well, and the
    parts' first sets are paired in a run of their own.
3.  In a run of equal shingles a text that others are edited from has few rarer
    shingles of its own and comes first.  Every class is paired with the run's
    first and with the one before it, under the length and positional filters:
    two links a row, however large the run.  Distinct pairs are verified once,
    under a suffix filter, and linked classes become components.
4.  What is left are pairs of one run in different components.  Runs are split
    by size (sets whose sizes differ too much never meet) and, where many sets
    of like size share a shingle, in blocks.  Pairs that the filters let through
    (range counts of the sets go along for that) are verified, and the
    components are taken again.  A large group of near copies is one component
    by then and makes no more pairs.

No link between different components is lost, so components are exact, but for
sets that share a 64-bit value: of n different sets n^2 / 2^65 pairs do.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kernelspark.llm import _text as T
from kernelspark.llm._util import components, lean, remove_dir, staged

#: The sketch has 2^BITS counters (16 MB with their ranks), moved in blocks of 2^BLOCK_BITS.
BITS, BLOCK_BITS = 22, 14
#: Sets that share a shingle and are met in one task: in a run on average, and in full pairing.
SPLIT, FULL_SPLIT = 200_000, 4_000
#: Classes whose sets are fetched through a broadcast of their ids (8 bytes each) at most; beyond that they are joined.
FETCHED = 1_000_000
#: Members of a pair's first class that one task verifies.
SALT = 2_000
def _class_of(x: np.ndarray) -> int:
    """A value of a sorted set."""
    return int(T.mix(np.array([np.sum(T.mix(x ^ np.uint64(0xA5A5)), dtype=np.uint64) + np.uint64(len(x))], np.uint64)).view(np.int64)[0])


#: Range counts of a set by kind: (ranges, bits a count). All take 128 bytes; finer ranges bound the overlap better.
_KINDS = ((256, 4), (128, 8), (64, 16))


def _mark(x: np.ndarray) -> bytes:
    """How many values of a set lie in each of equal ranges: a byte for the kind, then the counts; a kind beyond the last where none can hold them."""
    for kind, (ranges, bits) in enumerate(_KINDS):
        count = np.bincount((x >> np.uint64(64 - int(math.log2(ranges)))).astype(np.int64), minlength=ranges)
        if count.max(initial=0) < 1 << bits:
            packed = (count[::2] | count[1::2] << 4).astype(np.uint8) if bits == 4 else count.astype(f"<u{bits // 8}")
            return bytes([kind]) + packed.tobytes()
    return bytes([len(_KINDS)]) + bytes(128)


def _counts(raw: np.ndarray, kind: int, to: int) -> np.ndarray:
    """The counts of marks of one kind, added up to the ranges of a coarser kind."""
    if _KINDS[kind][1] == 4:
        out = np.stack((raw[:, 1:] & 15, raw[:, 1:] >> 4), axis=2).reshape(len(raw), -1).astype(np.uint16)
    else:
        out = np.ascontiguousarray(raw[:, 1:]).view(f"<u{_KINDS[kind][1] // 8}").astype(np.uint16)
    return out.reshape(len(raw), _KINDS[to][0], -1).sum(2, dtype=np.int32)


def _shared(raw: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The most values that sets i and j can have in common by their marks (rows of raw); -1 where nothing is known."""
    out = np.full(len(i), -1, np.int64)
    kind = raw[:, 0]
    coarse = np.maximum(kind[i], kind[j])
    for to in range(len(_KINDS)):
        at = np.flatnonzero(coarse == to)
        for s in range(0, len(at), 10_000):
            k = at[s : s + 10_000]
            least = None
            for side in (i[k], j[k]):
                count = np.empty((len(k), _KINDS[to][0]), np.int32)
                for own in range(to + 1):
                    mine = kind[side] == own
                    if mine.any():
                        count[mine] = _counts(raw[side[mine]], own, to)
                least = count if least is None else np.minimum(least, count)
            if least is not None:
                out[k] = least.sum(1)
    return out


class _Sketch:
    """Counts of a task's shingles by their first BITS bits."""

    def __init__(self):
        self.count, self.new, self.waiting = np.zeros(1 << BITS, np.uint32), [], 0

    def add(self, sets: list[np.ndarray]) -> None:
        self.new += [x for x in sets if len(x)]
        self.waiting += sum(map(len, sets))
        if self.waiting > 1 << 20:
            self.merge()

    def merge(self) -> None:
        if self.new:
            every = np.concatenate(self.new) >> np.uint64(64 - BITS)
            self.count += np.bincount(every.astype(np.int64), minlength=1 << BITS).astype(np.uint32)
            self.new, self.waiting = [], 0

    def blocks(self) -> Iterator[tuple[int, bytes]]:
        self.merge()
        for k, block in enumerate(self.count.reshape(-1, 1 << BLOCK_BITS)):
            if block.any():
                yield k, _packed(block)


def _packed(counts: np.ndarray) -> bytes:
    """Counters as 64-bit integers, byte planes one after another, compressed."""
    return zlib.compress(np.ascontiguousarray(counts.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _unpacked(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(raw), np.uint8).reshape(8, -1).T).view("<u8").ravel()


def _scan(rows: DataFrame, n: int) -> DataFrame:
    """Staged rows: (doc_id, size, class, mark) of each document, and (block, part, counts) of the tasks' sketches."""
    names = ["doc_id", "size", "class", "mark", "block", "part", "counts"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary()]

    def out(n: int, columns: dict[str, pa.Array]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(n, k) for c, k in zip(names, kinds, strict=True)], names=names)

    def scan(batches):
        from pyspark import TaskContext

        sketch = _Sketch()
        for batch in batches:
            for a, b, data, offsets in T.blocks(batch.column("text")):
                sets = T.shingle_sets(T.Words(data, offsets, lower=True), n)
                sketch.add(sets)
                yield out(b - a, {"doc_id": batch.column("doc_id").slice(a, b - a), "size": pa.array([len(x) for x in sets], pa.int64()), "class": pa.array([_class_of(x) if len(x) else None for x in sets], pa.int64()), "mark": pa.array([_mark(x) for x in sets], pa.binary())})
        part = TaskContext.get().partitionId() % 64
        block, counts = zip(*sketch.blocks(), strict=True) if sketch.count.any() or sketch.new else ((), ())
        yield out(len(block), {"block": pa.array(block, pa.int32()), "part": pa.array([part] * len(block), pa.int32()), "counts": pa.array(counts, pa.binary())})

    return staged(rows.mapInArrow(lean(scan), "doc_id long, size long, class long, mark binary, block int, part int, counts binary"), "ngram-scan")


def _frequencies(scan: DataFrame) -> np.ndarray:
    """The summed sketch of all tasks: 2^BITS counters."""

    def add(batches):
        key, total = None, None
        for batch in batches:
            for block, part, raw in zip(*(batch.column(c).to_pylist() for c in ("block", "part", "counts")), strict=True):
                if key != (block, part):
                    if key is not None:
                        yield given(key, total)
                    key, total = (block, part), np.zeros(1 << BLOCK_BITS, np.uint64)
                total += _unpacked(raw)
        if key is not None:
            yield given(key, total)

    def given(key, total):
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([_packed(total)], pa.binary())], names=["block", "part", "counts"])

    rows = scan.where("block is not null").select("block", "part", "counts")
    for whole in (False, True):  # tasks' sketches meet in parts before they meet at all
        rows = rows.withColumn("part", F.lit(0)) if whole else rows
        rows = rows.repartition("block", "part").sortWithinPartitions("block", "part").mapInArrow(lean(add), "block int, part int, counts binary")
    out = np.zeros((1 << BITS - BLOCK_BITS, 1 << BLOCK_BITS), np.uint64)
    for r in rows.collect():
        out[r.block] = _unpacked(r.counts)
    return out.ravel()


def prefix_length(size: int, similarity: int) -> int:
    """Shingles of a set of which one is in any similar set's prefix; similarity in percent."""
    return size - -(-size * similarity // 100) + 1


def _prefixes(rows: DataFrame, n: int, similarity: int, frequency: np.ndarray) -> DataFrame:
    """(key, value, node, size, place, parts) of every class's prefix; equal classes of a task once. key: the value, or the value and one of its parts."""
    rank = np.unique(frequency, return_inverse=True)[1].astype(np.uint32)
    # what a shingle's counter holds beyond the usual tells how many parts it needs
    parts = np.ceil(np.maximum(frequency - np.median(frequency), 0) / SPLIT).astype(np.int64)
    hot = np.flatnonzero(parts > 1)
    shared = rows.sparkSession.sparkContext.broadcast((rank, hot, parts[hot]))

    def scan(batches):
        rank, hot, parts = shared.value
        seen: set[int] = set()
        for batch in batches:
            has = batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            for a, _, data, offsets in T.blocks(batch.column("text")):
                out = []
                if len(seen) > 200_000:
                    seen.clear()
                for k, x in enumerate(T.shingle_sets(T.Words(data, offsets, lower=True), n)):
                    if not len(x) or not has[a + k] or (node := _class_of(x)) in seen:
                        continue
                    seen.add(node)
                    often = rank[(x >> np.uint64(64 - BITS)).astype(np.int64)]
                    out.append((x[np.argsort(often, kind="stable")[: prefix_length(len(x), similarity)]], node, len(x)))
                if out:
                    sizes = [len(v) for v, _, _ in out]
                    value, node = np.concatenate([v for v, _, _ in out]), np.repeat(np.array([o[1] for o in out], np.int64), sizes)
                    many = np.ones(len(value), np.int64)
                    key = value.copy()
                    if len(hot):
                        counter = (value >> np.uint64(64 - BITS)).astype(np.int64)
                        at = np.minimum(np.searchsorted(hot, counter), len(hot) - 1)
                        many = np.where(hot[at] == counter, parts[at], 1)
                        key = np.where(many > 1, T.mix(value + T.mix(node.view(np.uint64)) % many.astype(np.uint64)), value)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key.view(np.int64)), pa.array(value.view(np.int64)), pa.array(node), pa.array(np.repeat(np.array([o[2] for o in out], np.int32), sizes)), pa.array(np.concatenate([np.arange(s, dtype=np.int32) for s in sizes])), pa.array(many.astype(np.int32))],
                        names=["key", "value", "node", "size", "place", "parts"],
                    )

    return rows.mapInArrow(lean(scan), "key long, value long, node long, size int, place int, parts int")


def _can(size1, place1, size2, place2, similarity: int):
    """Length and positional filter of two sets that share the shingles at these places; works on arrays as well."""
    size1, size2 = np.asarray(size1, np.int64), np.asarray(size2, np.int64)
    low, high = np.minimum(size1, size2), np.maximum(size1, size2)
    most = np.minimum(place1, place2) + np.minimum(size1 - place1, size2 - place2)
    return (100 * low >= similarity * high) & (most * (100 + similarity) >= similarity * (size1 + size2))


def _runs(prefixes: DataFrame, similarity: int) -> DataFrame:
    """Rows (value, node, size, place, parts, first, before): shingles of two classes of a key at least, and all those of a part, each with the partners it may be similar to."""
    names = ["key", "value", "node", "size", "place", "parts"]
    kinds = (np.int64, np.int64, np.int32, np.int32, np.int32, np.int64, np.int64)

    def scan(batches):
        # rows come sorted by (key, place, size, node). lead, last: the open run's first row and the row before;
        # held: the open run's only row so far, which is given out if another follows
        lead = last = held = None
        for batch in batches:
            cols = [batch.column(c).to_numpy() for c in names]
            if not len(cols[0]):
                continue
            start = int(last is not None)
            if start:
                cols = [np.concatenate((np.array([x], c.dtype), c)) for x, c in zip(last, cols, strict=True)]
            key, node = cols[0], cols[2]
            keep = np.concatenate(([True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])))
            key, value, node, size, place, parts = cols = [c[keep] for c in cols]
            n = len(key)
            new = np.concatenate(([not start], key[1:] != key[:-1]))
            head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            h_node, h_size, h_place = node[head], size[head], place[head]
            if start:
                open_ = np.cumsum(new) == 0
                h_node, h_size, h_place = (np.where(open_, x, c) for x, c in zip(lead, (h_node, h_size, h_place), strict=True))
            before = np.maximum(np.arange(n) - 1, 0)
            pair_first = ~new & _can(size, place, h_size, h_place, similarity)
            pair_before = ~new & _can(size, place, size[before], place[before], similarity) & (node[before] != h_node)
            out = ~new | np.concatenate((~new[1:], [False])) | (parts > 1)
            out[:start] = False
            rows = [c[out] for c in (value, node, size, place, parts)] + [np.where(pair_first, h_node, node)[out], np.where(pair_before, node[before], node)[out]]
            if held is not None and n > 1 and not new[1]:
                rows = [np.concatenate(([x], c)) for x, c in zip((*held[1:], held[2], held[2]), rows, strict=True)]
            if n > start:
                held = tuple(c[-1] for c in cols) if new[-1] and parts[-1] == 1 else None
            lead, last = (h_node[-1], h_size[-1], h_place[-1]), [c[-1] for c in cols]
            if len(rows[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(t)) for c, t in zip(rows, kinds, strict=True)], names=[*names[1:], "first", "before"])

    rows = prefixes.repartition("key").sortWithinPartitions("key", "place", "size", "node")
    return rows.mapInArrow(lean(scan), "value long, node long, size int, place int, parts int, first long, before long")


def _paired(posts: DataFrame) -> DataFrame:
    """Pairs (a, b) of rows with their partners."""
    pair = lambda c: posts.where(f"{c} <> node").select(F.least(c, "node").alias("a"), F.greatest(c, "node").alias("b"))
    return pair("first").unionAll(pair("before"))


def _crossed(posts: DataFrame, labels: DataFrame, marks: DataFrame, similarity: int) -> DataFrame:
    """Distinct pairs (a, b) of one run whose components differ, under all filters that need no set. labels: (node, label); marks: (node, mark)."""
    names = ("value", "sizes", "x", "y", "node", "size", "place", "label", "own", "part", "mark")

    def pairs(cols: list[np.ndarray], edges: np.ndarray) -> Iterator[pa.RecordBatch]:
        """The pairs of the blocks between edges: all rows d apart of one block at once, for d = 1, 2, ..."""
        _, sizes, x, y, node, size, place, label, own, part, mark = cols
        end = np.repeat(edges[1:], np.diff(edges))
        raw = np.frombuffer(b"".join(mark[: edges[-1]]), np.uint8).reshape(-1, 129)
        i, d, found, n = np.arange(edges[-1]), 0, [], 0
        while len(i):
            d += 1
            i = i[i + d < end[i]]
            for s in range(0, len(i), 200_000):
                a = i[s : s + 200_000]
                a = a[label[a] != label[a + d]]
                a = a[_can(size[a], place[a], size[a + d], place[a + d], similarity)]
                b = a + d
                # two rows meet in the later one's class of sizes, and in the block of their two parts
                here = (np.maximum(own[a], own[b]) == sizes[a]) & (np.minimum(part[a], part[b]) == x[a]) & (np.maximum(part[a], part[b]) == y[a])
                a, b = a[here], b[here]
                shared = _shared(raw, a, b)
                ok = (shared < 0) | (shared * (100 + similarity) >= similarity * (size[a].astype(np.int64) + size[b]))
                if ok.any():
                    found.append(np.stack((node[a[ok]], node[b[ok]])))
                    n += int(ok.sum())
            if found and (n > 200_000 or not len(i)):
                p = np.unique(np.sort(np.concatenate(found, axis=1), axis=0), axis=1)
                found, n = [], 0
                yield pa.RecordBatch.from_arrays([pa.array(p[0]), pa.array(p[1])], names=["a", "b"])

    def scan(batches):
        held: list[np.ndarray] | None = None
        for batch in batches:
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            edges = np.concatenate(([0], np.flatnonzero(np.any([np.diff(c) != 0 for c in cols[:4]], axis=0)) + 1))
            if len(edges) > 1:
                yield from pairs(cols, edges)  # all blocks but the last, which may go on
            held = [c[edges[-1] :] for c in cols]
        if held is not None:
            yield from pairs(held, np.array([0, len(held[0])]))

    known = lambda df: df.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    runs = staged(known(posts.select("value", "node")).groupBy("value").agg(F.count("*").alias("n"), (F.min("label") < F.max("label")).alias("mixed")).where("mixed").select("value", "n"), "ngram-mixed")
    zero = F.lit(0)
    # rows of runs of one component go before anything is looked up for a row; label and mark come in one join
    at = posts.select("value", "node", "size", "place").join(runs, "value")
    rows = at.where(F.col("n") <= FULL_SPLIT).join(known(marks), "node").select("value", zero.alias("sizes"), zero.alias("x"), zero.alias("y"), "node", "size", "place", "label", zero.alias("own"), zero.alias("part"), "mark")
    if runs.where(F.col("n") > FULL_SPLIT).limit(1).count():
        # similar sets fall into one class of sizes or two that follow each other
        own = F.floor(F.log(F.col("size").cast("double")) / F.lit(math.log(100 / similarity) + 1e-6)).cast("int") if similarity < 100 else F.col("size")
        far = known(at.where(F.col("n") > FULL_SPLIT)).withColumn("own", own).withColumn("sizes", F.explode(F.array("own", F.col("own") + 1)))
        many = far.groupBy("value", "sizes").agg(F.ceil(F.count("*") / F.lit(FULL_SPLIT)).cast("int").alias("parts"), (F.min("label") < F.max("label")).alias("mixed")).where("mixed").drop("mixed")
        far = far.join(many, ["value", "sizes"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts").cast("long")).cast("int"))
        far = far.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("x", F.least("part", "with")).withColumn("y", F.greatest("part", "with"))
        rows = rows.unionAll(far.join(marks, "node").select(rows.columns))
    rows = rows.repartition("value", "sizes", "x", "y").sortWithinPartitions("value", "sizes", "x", "y", "size", "node")
    return rows.select(*names).mapInArrow(lean(scan), "a long, b long").distinct()


def sketch(x: np.ndarray) -> bytes:
    """How many values of a sorted set lie in each of 2^k equal ranges, about four a range; empty if a count does not fit a byte."""
    bits = max(4, math.ceil(math.log2(max(len(x), 1) / 4)) if len(x) > 4 else 4)
    count = np.bincount((x >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return count.astype(np.uint8).tobytes() if count.max(initial=0) < 256 else b""


def may_be_similar(size1: int, counts1: bytes, size2: int, counts2: bytes, similarity: int) -> bool:
    """The suffix filter on sketches: no more values can be shared than the smaller count of each range."""
    if 100 * min(size1, size2) < similarity * max(size1, size2):
        return False
    if not counts1 or not counts2:
        return True
    x, y = (np.frombuffer(c, np.uint8).astype(np.int64) for c in (counts1, counts2))
    n = min(len(x), len(y))
    x, y = x.reshape(n, -1).sum(1), y.reshape(n, -1).sum(1)
    return int(np.minimum(x, y).sum()) * (100 + similarity) >= similarity * (size1 + size2)


def _sets(rows: DataFrame, needed: DataFrame, n: int, make) -> DataFrame:
    """Staged (node, size, set) of the classes in needed (node, doc_id), from the texts of those documents; set is ``make`` of the sorted values."""
    spark = rows.sparkSession
    few = needed.count() <= FETCHED
    ids = spark.sparkContext.broadcast(np.sort(needed.toArrow()["doc_id"].to_numpy())) if few else None
    rows = rows if few else rows.join(needed.select("doc_id").distinct(), "doc_id", "left_semi")

    def scan(batches):
        for batch in batches:
            if ids is not None:
                doc = batch.column("doc_id").fill_null(0).to_numpy()
                at = np.minimum(np.searchsorted(ids.value, doc), max(len(ids.value) - 1, 0))
                has = (ids.value[at] == doc) & batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False) if len(ids.value) else np.zeros(len(doc), dtype=bool)
                batch = batch.filter(pa.array(has))
            for _, _, data, offsets in T.blocks(batch.column("text")):
                sets = [x for x in T.shingle_sets(T.Words(data, offsets, lower=True), n) if len(x)]
                if sets:
                    yield pa.RecordBatch.from_arrays([pa.array([_class_of(x) for x in sets], pa.int64()), pa.array([len(x) for x in sets], pa.int64()), pa.array([make(x) for x in sets], pa.binary())], names=["node", "size", "set"])

    found = rows.mapInArrow(lean(scan), "node long, size long, set binary")
    # a document with several texts gives several sets; each class once
    return staged(found.join(needed.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"]), "ngram-sets")


def similar(x: np.ndarray, y: np.ndarray, similarity: int) -> bool:
    """Whether two sorted sets are similar."""
    if 100 * min(len(x), len(y)) < similarity * max(len(x), len(y)):
        return False
    both = np.concatenate((x, y))
    both.sort(kind="stable")
    return int(np.count_nonzero(both[1:] == both[:-1])) * (100 + similarity) >= similarity * (len(x) + len(y))


def _possible(pairs: DataFrame, sketches: DataFrame, similarity: int) -> DataFrame:
    """Staged pairs that pass the suffix filter."""

    def scan(batches):
        for batch in batches:
            keep = [may_be_similar(*r, similarity) for r in zip(*(batch.column(c).to_pylist() for c in ("size_a", "set_a", "size_b", "set_b")), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs
    for c in ("a", "b"):
        both = both.join(sketches.select(F.col("node").alias(c), F.col("size").alias(f"size_{c}"), F.col("set").alias(f"set_{c}")), c)
    return staged(both.select("a", "b", "size_a", "set_a", "size_b", "set_b").mapInArrow(lean(scan), "a long, b long"), "ngram-possible")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Staged pairs (a, b) that are similar. The sets of b go to the parts of a; a part holds SALT of them at most, on average."""
    hub = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(SALT)).cast("int").alias("parts"))
    b = pairs.join(sets.select(F.col("node").alias("b"), "set"), "b")
    b = b.join(hub, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts").cast("long")).cast("int").alias("part"), "set")
    a = hub.join(sets.select(F.col("node").alias("a"), "set"), "a").select("a", F.lit(None).cast("long").alias("b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "set")

    def scan(batches):
        own, key = None, None
        for batch in batches:
            keep_a, keep_b = [], []
            a, b, part, sets_ = (batch.column(c) for c in ("a", "b", "part", "set"))
            for x, y, p, s in zip(a.to_pylist(), b.to_pylist(), part.to_pylist(), sets_, strict=True):
                v = np.frombuffer(s.as_buffer(), np.uint64)
                if y is None:
                    own, key = v.copy(), (x, p)
                elif key == (x, p) and similar(own, v, similarity):
                    keep_a.append(x)
                    keep_b.append(y)
            if keep_a:
                yield pa.RecordBatch.from_arrays([pa.array(keep_a, pa.int64()), pa.array(keep_b, pa.int64())], names=["a", "b"])

    rows = a.unionAll(b).repartition("a", "part").sortWithinPartitions(F.col("a"), F.col("part"), F.col("b").asc_nulls_first())
    return staged(rows.mapInArrow(lean(scan), "a long, b long"), "ngram-links")


def join(docs: DataFrame, n: int = 5, similarity: int = 80) -> DataFrame:
    """A row for each document: doc_id, n_shingles, component_id, n_spanning_links (verified links of its class to others that were needed to join its component).

    Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z in lower case.  Fewer
    than n words are one shingle.  Null, empty and wordless texts have no
    shingle, no link, and their own id as component.  A row without id is
    linked with nothing and has no component.  Repeated rows fall into one
    class; rows with one id and different texts each follow their text.  An
    empty table gives no rows.  Other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scan = _scan(rows, n)
    frequency = _frequencies(scan)
    posts = staged(_runs(_prefixes(rows, n, similarity, frequency), similarity), "ngram-posts")
    # the first sets of a shingle's parts
    leads = posts.where("parts > 1 and first = node and before = node").select(F.col("value").alias("key"), "value", "node", "size", "place", F.lit(1).alias("parts"))

    every = scan.where("block is null").select("doc_id", "size", "class")
    named = scan.where("doc_id is not null and class is not null")
    classes = staged(named.groupBy("class").agg(F.min("doc_id").alias("least"), F.max("mark").alias("mark")), "ngram-classes")
    ids = classes.select(F.col("class").alias("node"), F.col("least").alias("doc_id"))

    def linked(pairs: DataFrame) -> DataFrame:
        def named(p: DataFrame) -> DataFrame:
            nodes = p.select(F.col("a").alias("node")).unionAll(p.select(F.col("b").alias("node"))).distinct()
            return ids.join(nodes, "node", "left_semi")

        sketches = _sets(rows, named(pairs), n, sketch)
        pairs = _possible(pairs, sketches, similarity)
        sets = _sets(rows, named(pairs), n, np.ndarray.tobytes)
        found = _verified(pairs, sets, similarity)
        for used in (sketches, sets):
            remove_dir(used.sparkSession, used._staged_at)
        return found

    pairs = _paired(posts)
    if (frequency > SPLIT).any():
        pairs = pairs.unionAll(_paired(_runs(leads, similarity)))
    pairs = staged(pairs.distinct(), "ngram-pairs")
    links = linked(pairs)
    labels = components(links)
    marks = classes.select(F.col("class").alias("node"), "mark")
    rest = staged(_crossed(posts, labels.withColumnRenamed("component", "label"), marks, similarity).join(pairs, ["a", "b"], "left_anti"), "ngram-rest")
    remove_dir(posts.sparkSession, posts._staged_at)
    if rest.limit(1).count():
        more = linked(rest)
        if more.limit(1).count():
            links = links.unionAll(more)
            labels = components(links)
    degree = links.select(F.col("a").alias("class")).unionAll(links.select(F.col("b").alias("class"))).groupBy("class").agg(F.count("*").alias("n_spanning_links"))
    named = classes.select("class", "least").join(labels.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    least = staged(named.groupBy("component").agg(F.min("least").alias("component_id")), "ngram-least")  # a large component's join can be split then
    named = named.join(least, "component").join(degree, "class", "left").select("class", "component_id", F.coalesce("n_spanning_links", F.lit(0)).alias("n_spanning_links"))
    out = every.join(named, "class", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("size").alias("n_shingles"), own.alias("component_id"), F.when(F.col("doc_id").isNull(), 0).otherwise(F.coalesce("n_spanning_links", F.lit(0))).alias("n_spanning_links"))


def one_of_each(docs: DataFrame, n: int = 5, similarity: int = 80) -> DataFrame:
    """The documents that are the smallest of their component, with all their columns, a repeated id once; documents without an id stay."""
    drop = staged(join(docs, n, similarity).where("component_id <> doc_id").select(F.col("doc_id").alias("__drop")).distinct(), "ngram-drop")
    drop = F.broadcast(drop) if drop.count() <= FETCHED else drop  # few: the texts stay where they are
    kept = docs.join(drop, docs["doc_id"] == F.col("__drop"), "left_anti")
    again = staged(docs.where("doc_id is not null").groupBy(F.col("doc_id").alias("__again")).agg(F.count("*").alias("__n")).where("__n > 1").select("__again"), "ngram-again")
    if not again.limit(1).count():
        return kept
    same = kept["doc_id"] == F.col("__again")
    return kept.join(again, same, "left_anti").unionAll(kept.join(again, same, "left_semi").dropDuplicates(["doc_id"]))


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM {docs}),
p AS (SELECT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE NULL END AS whole, w, unnest(CASE WHEN len(w) < 5 THEN [1] ELSE range(1, len(w) - 3) END) AS i FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, coalesce(whole, array_to_string(w[i:i+4], ' ')) AS g FROM p),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id),
c AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id FROM d LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)
"""
