"""Mixture-controlled packing by deficit round-robin over source queues (operator 7).

Each source is a queue of its documents' token ids.  The output is a row of
windows of WINDOW tokens, each window a whole number of sequences (a training
batch).  In every window each active queue is served its quantum, weight times
window, in turn; what a quantum leaves over as a fraction of a token is the
queue's deficit, carried to the next window, so that after any number of
windows each queue is within one token of its target.  When a queue runs dry
its share of that window, and from then on its weight, goes to the others.

Because the served amounts follow from the queues' totals alone, the whole
schedule is a few phases per source, computed on the driver, and a document's
pieces follow from its place in its queue.  That place is a prefix sum: within
the task that tokenised it, and over the (task, source) totals.  So partitions
carry on from one another without any token being shuffled.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kernelspark.llm._util import lean, staged
from kernelspark.llm.tokenbin import crc, encoder, forget

#: Rows of a batch that are taken at a time, and ids after which what is made of them goes out: a task holds little beside its batch.
ROWS, IDS = 1_000, 1 << 18
SEQUENCE, SEQUENCES = 1024, 256
WINDOW = SEQUENCE * SEQUENCES


#: Deficits are kept in this part of a token.
UNIT = 1 << 32


@dataclass(frozen=True)
class Phase:
    """Windows first .. first + count - 1, in which the same queues are served by the same shares.

    taken[s]: tokens of queue s served before; below[s] and upto[s]: where the
    turn of s begins and ends in a window, as (share of ``whole``, deficits of
    the queues so far that the phase starts with).
    """

    first: int
    count: int
    width: int
    whole: int
    taken: dict[str, int]
    below: dict[str, tuple[int, int]]
    upto: dict[str, tuple[int, int]]

    def edge(self, at: tuple[int, int], k: int) -> int:
        """Tokens that all queues up to here are served in k windows of the phase; whole tokens, the rest is deficit."""
        return (k * self.width * at[0] * UNIT + at[1] * self.whole) // (self.whole * UNIT)

    def served(self, s: str, k: int) -> int:
        return self.edge(self.upto[s], k) - self.edge(self.below[s], k)


def plan(totals: dict[str, int], weights: dict[str, int] | None = None, window: int = WINDOW) -> list[Phase]:
    """The schedule that serves every queue to its end: two phases for each queue that runs dry before the others, at most.

    weights: positive integers, the target token proportions; without them each
    queue weighs as many as it has tokens, and all end together.  A last,
    shorter window takes what is left.
    """
    left = {s: n for s, n in sorted(totals.items()) if n > 0}
    taken = dict.fromkeys(left, 0)
    weights = weights or dict(left)
    if any(weights.get(s, 0) <= 0 for s in left):
        raise ValueError("every source with tokens needs a positive weight")
    debt = dict.fromkeys(left, 0)  # what a queue was served too little so far, in UNITs
    phases: list[Phase] = []
    at = 0

    def made(width: int, shares: dict[str, int], owed: bool) -> Phase:
        below, upto, c, d, most = {}, {}, 0, 0, 0
        for s, w in shares.items():
            below[s], c, d = (c, most), c + w, d + debt[s] * owed
            most = max(most, min(d, UNIT - 1))  # edges stay in order and within a token
            upto[s] = (c, most)
        return Phase(at, 0, width, c, dict(taken), below, upto)

    def take(p: Phase, count: int) -> None:
        nonlocal at
        phases.append(replace(p, count=count))
        at += count
        whole = sum(weights[s] for s in left)
        for s in list(left):
            n = p.served(s, count) if s in p.upto else 0
            debt[s] += count * p.width * weights[s] * UNIT // whole - n * UNIT
            taken[s] += n
            left[s] -= n
        for s in [s for s, n in left.items() if not n]:
            del left[s]
        for s in left:  # what a queue gets beyond its weight because others have run dry is no debt
            debt[s] = max(-UNIT, min(debt[s], UNIT))

    while left:
        p = made(window, {s: weights[s] for s in left}, True)
        # windows that every queue can fill: what it is served grows with them
        most = sum(left.values()) // window
        for s in left:
            most = bisect_right(range(1, most + 1), left[s], key=lambda k, s=s: p.served(s, k))
        if most:
            take(p, most)
            continue
        # a window in which some queue runs dry: what it lacks goes to the others by weight
        width, given, active = min(window, sum(left.values())), dict.fromkeys(left, 0), dict(left)
        while (rest := width - sum(given.values())) and active:
            whole, c, share = sum(weights[s] for s in active), 0, {}
            for s in active:
                share[s] = rest * (c + weights[s]) // whole - rest * c // whole
                c += weights[s]
            for s, n in share.items():
                n = min(n, active[s])
                given[s] += n
                active[s] -= n
            active = {s: n for s, n in active.items() if n}
        take(made(width, {s: n for s, n in given.items() if n}, False), 1)
    return phases


class Layout:
    """Where the tokens of each queue go."""

    def __init__(self, phases: list[Phase], window: int = WINDOW, sequence: int = SEQUENCE):
        self.window, self.sequence = window, sequence
        self.of: dict[str, tuple[list[int], list[Phase]]] = {}
        for p in phases:
            for s in p.upto:
                starts, own = self.of.setdefault(s, ([], []))
                starts.append(p.taken[s])
                own.append(p)

    def pieces(self, source: str, begin: int, length: int) -> Iterator[tuple[int, int, int, int]]:
        """(start in the document, length, sequence, offset in it) of the tokens begin .. begin + length - 1 of a queue."""
        starts, own = self.of[source]
        at, end = begin, begin + length
        while at < end:
            p = own[bisect_right(starts, at) - 1]
            into = at - p.taken[source]
            # the window of the phase that holds token `into`: guess by its share, then look further and further around it
            k, step = min(p.count - 1, into * p.whole // (p.width * (p.upto[source][0] - p.below[source][0]))), 1
            low, high = k, k + 1
            while low > 0 and p.served(source, low) > into:
                low, step = max(0, low - step), 2 * step
            while p.served(source, high) <= into:
                high, step = min(p.count, high + step), 2 * step
            k = low + bisect_right(range(low + 1, high), into, key=lambda w: p.served(source, w))
            a, b = p.served(source, k), p.served(source, k + 1)
            place = p.edge(p.below[source], k + 1) - p.edge(p.below[source], k) + into - a
            n = min(b - into, end - at, self.sequence - place % self.sequence)
            yield at - begin, n, (p.first + k) * (self.window // self.sequence) + place // self.sequence, place % self.sequence
            at += n


def _key(source: str | None) -> str:
    """Queues are named by source; null is a queue of its own."""
    return "\0" if source is None else "s" + source


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def tokenised(docs: DataFrame, path: str, end_id: int = 0) -> DataFrame:
    """Staged rows (doc_id, queue, tokens, ids, part, start): start counts the queue's ids before it in the same task."""

    def encode(batches):
        from pyspark import TaskContext

        part, before, enc = TaskContext.get().partitionId(), {}, encoder(path, end_id)
        names = ["doc_id", "queue", "tokens", "ids", "part", "start"]
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
        for batch in _slices(batches):
            out, size = [], 0
            for d, s, x in zip(batch.column("doc_id").to_pylist(), batch.column("source").to_pylist(), enc.column(batch.column("text")), strict=True):
                q = _key(s)
                out.append((d, q, len(x), x.tobytes(), part, before.get(q, 0)))
                before[q] = before.get(q, 0) + len(x)
                size += len(x)
                if size > IDS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    return staged(rows.mapInArrow(lean(encode), "doc_id long, queue string, tokens long, ids binary, part long, start long"), "packing-tokens")


def cutter(layout: Layout, width: str, ids: bool = True):
    """The step from documents' ids and places in their queues (doc_id, queue, tokens, ids, begin) to pieces."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"] + ["ids"] * ids
    kinds = [pa.int64()] * 7 + [pa.string()] + [pa.binary()] * ids

    def cut(batches):
        forget()  # the workers are those that encoded
        for batch in _slices(batches):
            out, size = [], 0
            for d, q, n, raw, begin in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "queue", "tokens", "ids", "begin")), strict=True):
                x = np.frombuffer(raw, width)
                for start, length, seq, offset in layout.pieces(q, begin, n):
                    part = x[start : start + length]
                    out.append((d, start, length, crc(part), n, seq, offset, None if q == "\0" else q[1:], *((part.tobytes(),) * ids)))
                    size += length
                    if size > IDS:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                        out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return cut


def pack(docs: DataFrame, path: str, end_id: int = 0, weights: dict[str | None, int] | None = None, window: int = WINDOW, sequence: int = SEQUENCE, ids: bool = True) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source, ids); without ids if they are not wanted.

    Every id of every row is in exactly one piece, sequences are filled without
    gaps and only the last can be short.  Null and empty texts are the end id
    alone; a null source is a queue of its own; repeated rows are packed as
    often as they occur.  An empty table gives no rows.  weights: target
    proportions by source as positive integers, in place of the sources' own.
    """
    if window % sequence:
        raise ValueError("a window holds whole sequences")
    rows = tokenised(docs, path, end_id)
    width = encoder(path, end_id).dtype.str
    sums = staged(rows.groupBy("part", "queue").agg(F.sum("tokens").alias("n")), "packing-sums")
    totals = {r.queue: int(r.n) for r in sums.groupBy("queue").agg(F.sum("n").alias("n")).collect()}
    layout = Layout(plan(totals, weights and {_key(s): int(w) for s, w in weights.items()}, window), window, sequence)
    base = sums.select("part", "queue", (F.sum("n").over(Window.partitionBy("queue").orderBy("part")) - F.col("n")).alias("base"))
    placed = rows.join(base, ["part", "queue"]).select("doc_id", "queue", "tokens", "ids", (F.col("start") + F.col("base")).alias("begin"))
    return placed.mapInArrow(lean(cutter(layout, width, ids)), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string" + ", ids binary" * ids)
