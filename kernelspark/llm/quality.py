"""Quality rules with cross-document line frequency (operator 8).

Per document: word and symbol counts, duplicate lines, words in repeated
three-word windows.  Across documents: every distinct normalised line (words in
lower case A-Z, one space between) is counted once a document within its host;
a line in more documents than the limit is boilerplate and is removed, except
from the document with the smallest id, so that no content vanishes altogether.
A document that keeps less than half of its words is rejected as depleted.

Lines travel as 64-bit values.  Counting is one aggregation on (host, line)
with map-side combination.  The lines above the limits come back by broadcast
if they are few (checked), and otherwise by a join on (host, line).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kernelspark.llm import _text as T
from kernelspark.llm._util import lean, staged

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1
COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Limits:
    """A line is removed where more than both min_docs documents and ``share`` percent of its host's documents have it."""

    min_docs: int = 20
    share: int = 5
    #: Percent of its words that a document must keep.
    left: int = 50
    min_words: int = 50
    most_repeated: int = 50
    #: Lines above the limits that are broadcast at most (24 bytes each).
    broadcast: int = 200_000


def _apart(values: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Values that are equal only within a row."""
    return T.mix(values ^ T.mix(row.astype(np.uint64) + np.uint64(1)))


def _per_row(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[first[1:]] - total[first[:-1]]


class Lines:
    """The lines of a block that hold a word: row, byte span, words, normalised value."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        low = T.Words(data, offsets, lower=True)
        ends = np.unique(np.concatenate((np.flatnonzero(data == 10), offsets[1:])))
        of = np.searchsorted(ends, low.start, "right")  # the words' lines
        change = np.flatnonzero(np.diff(of)) + 1
        first = np.concatenate(([0], change)) if len(of) else np.zeros(0, np.int64)
        last = np.concatenate((change, [len(of)])) if len(of) else np.zeros(0, np.int64)
        line = of[first] if len(of) else np.zeros(0, np.int64)
        self.row = np.searchsorted(offsets, low.start[first], "right") - 1 if len(of) else np.zeros(0, np.int64)
        self.end = ends[line]
        before = np.where(line > 0, ends[np.maximum(line - 1, 0)], -1)
        at_break = (before >= 0) & (data[np.clip(before, 0, max(len(data) - 1, 0))] == 10) if len(data) else np.zeros(0, bool)
        self.start = np.maximum(np.where(before >= 0, before + at_break, 0), offsets[self.row])
        self.words = last - first
        power, inverse = T._grown(len(low.value) + 1)
        h = np.zeros(len(low.value) + 1, np.uint64)
        np.cumsum(low.value * power[: len(low.value)], out=h[1:])
        self.value = T.mix((h[last] - h[first]) * inverse[first] + self.words.astype(np.uint64))


def base(data: np.ndarray, offsets: np.ndarray, lines: Lines) -> dict[str, np.ndarray]:
    """The per-document counts of a block."""
    w = T.Words(data, offsets)
    n = len(offsets) - 1
    chars = np.concatenate(([0], np.cumsum(w.inside & ((data & 0xC0) != 0x80), dtype=np.int64)))
    symbols = np.concatenate(([0], np.cumsum(_SYMBOL[data], dtype=np.int64)))
    exact = _apart(T.spans(data, lines.start, lines.end, prefix=w.prefix), lines.row)
    new = np.zeros(len(exact), dtype=bool)
    new[np.unique(exact, return_index=True)[1]] = True
    count = np.diff(w.first)
    three = T.windows(w.value, 3)
    row = np.repeat(np.arange(n), count)
    covered = np.zeros(len(w.value), dtype=bool)
    if len(three):
        at = np.flatnonzero(row[:-2] == row[2:])
        _, where, times = np.unique(_apart(three[at], row[at]), return_inverse=True, return_counts=True)
        again = at[times[where] > 1]
        for k in range(3):
            covered[again + k] = True
    return {
        "n_words": count,
        "word_chars": chars[offsets[1:]] - chars[offsets[:-1]],
        "n_symbols": symbols[offsets[1:]] - symbols[offsets[:-1]],
        "n_dup_lines": np.bincount(lines.row[~new], minlength=n).astype(np.int64),
        "n_repeat_words": _per_row(covered, w.first),
    }


def line_counts(docs: DataFrame, host: str = "source") -> DataFrame:
    """(host, line, docs, first): in how many documents (rows) of the host the line is, and the smallest doc_id among them."""

    def scan(batches):
        for batch in batches:
            doc, own = batch.column("doc_id"), batch.column("host")
            for a, b, data, offsets in T.blocks(batch.column("text")):
                x = Lines(data, offsets)
                _, at = np.unique(_apart(x.value, x.row), return_index=True)
                take = pa.array(x.row[at] + a)
                yield pa.RecordBatch.from_arrays([own.take(take), pa.array(x.value[at].view(np.int64)), doc.take(take)], names=["host", "line", "doc_id"])

    rows = docs.select(F.col(host).cast("string").alias("host"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lean(scan), "host string, line long, doc_id long").groupBy("host", "line").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first"))


def frequent_lines(docs: DataFrame, limits: Limits = Limits(), host: str = "source") -> DataFrame:
    """Staged (host, line, first) of the lines above the limits."""
    size = docs.groupBy(F.col(host).cast("string").alias("h")).agg(F.count("*").alias("n"))
    many = line_counts(docs, host).where(F.col("docs") > limits.min_docs)
    many = many.join(size, F.col("host").eqNullSafe(F.col("h"))).where(F.col("docs") * 100 > F.col("n") * limits.share)
    return staged(many.select("host", "line", "first"), "quality-lines")


class _Known:
    """Frequent lines as sorted arrays, found by host and value."""

    def __init__(self, hosts: list[str | None], lines: np.ndarray, first: list[int | None]):
        key = T.mix(lines.view(np.uint64) ^ self.hosts(hosts))
        order = np.argsort(key)
        self.key, self.first = key[order], np.array([first[i] for i in order], dtype=object)

    @staticmethod
    def hosts(hosts: list[str | None]) -> np.ndarray:
        import xxhash

        seen = {h: xxhash.xxh64_intdigest("\0" if h is None else "s" + h) for h in set(hosts)}
        return np.array([seen[h] for h in hosts], np.uint64)

    def has(self, hosts: np.ndarray, lines: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Which (host, line) are frequent, and not in the first document that has them."""
        if not len(self.key) or not len(lines):
            return np.zeros(len(lines), dtype=bool)
        key = T.mix(lines ^ hosts)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return (self.key[at] == key) & (self.first[at] != doc)


def _judge(x: dict[str, np.ndarray], removed: np.ndarray, limits: Limits) -> tuple[np.ndarray, np.ndarray]:
    failed = (x["n_words"] < limits.min_words) | (100 * x["n_repeat_words"] > limits.most_repeated * x["n_words"])
    return failed, ~failed & (100 * (x["n_words"] - removed) >= limits.left * x["n_words"])


def _with_lines(docs: DataFrame, limits: Limits, host: str) -> tuple[DataFrame, _Known | None]:
    """docs as one struct with (host, doc_id, text, bad); bad lists the lines to remove where they don't fit a broadcast, which is returned otherwise."""
    frequent = frequent_lines(docs, limits, host)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[host].cast("string").alias("host"), docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    if frequent.count() <= limits.broadcast:
        got = frequent.toArrow()
        return rows.withColumn("bad", F.lit(None).cast("array<long>")), _Known(got["host"].to_pylist(), got["line"].to_numpy(), got["first"].to_pylist())

    def scan(batches):
        for batch in batches:
            for a, b, data, offsets in T.blocks(batch.column("text")):
                x = Lines(data, offsets)
                _, at = np.unique(_apart(x.value, x.row), return_index=True)
                take = pa.array(x.row[at] + a)
                yield pa.RecordBatch.from_arrays([batch.column("host").take(take), batch.column("doc_id").take(take), batch.column("key").take(take), pa.array(x.value[at].view(np.int64))], names=["host", "doc_id", "key", "line"])

    rows = rows.withColumn("key", F.xxhash64("text"))
    lines = rows.select("host", "doc_id", "key", "text").mapInArrow(lean(scan), "host string, doc_id long, key long, line long")
    f = frequent.select(F.col("host").alias("h"), F.col("line").alias("l"), "first")
    bad = lines.join(f, F.col("host").eqNullSafe(F.col("h")) & (F.col("line") == F.col("l"))).where(~F.col("doc_id").eqNullSafe(F.col("first")))
    bad = bad.groupBy(F.col("host").alias("h"), F.col("doc_id").alias("d"), F.col("key").alias("k")).agg(F.collect_set("line").alias("bad"))
    same = F.col("host").eqNullSafe(F.col("h")) & F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k"))
    return rows.join(bad, same, "left").select("row", "host", "doc_id", "text", "bad"), None


def _removed(batch: pa.RecordBatch, known: _Known | None, a: int, b: int, x: Lines) -> np.ndarray:
    """Which lines of rows a .. b - 1 go."""
    if known is not None:
        own = known.hosts(batch.column("host").slice(a, b - a).to_pylist())
        doc = np.array(batch.column("doc_id").slice(a, b - a).to_pylist(), dtype=object)
        return known.has(own[x.row], x.value, doc[x.row])
    bad = [set(v or ()) for v in batch.column("bad").slice(a, b - a).to_pylist()]
    return np.array([v in bad[r] for r, v in zip(x.row.tolist(), x.value.view(np.int64).tolist(), strict=True)], dtype=bool)


def verdicts(docs: DataFrame, limits: Limits = Limits(), host: str = "source") -> DataFrame:
    """A row for each document: doc_id, the five counts, base_failed, kept, removed_words.

    Null and empty texts have no words and fail the base rules.  A null host is
    a host of its own.  A repeated row counts as another document.  An empty
    table gives no rows.
    """
    rows, known = _with_lines(docs, limits, host)

    def scan(batches):
        for batch in batches:
            for a, b, data, offsets in T.blocks(batch.column("text")):
                lines = Lines(data, offsets)
                x = base(data, offsets, lines)
                gone = _removed(batch, known, a, b, lines)
                removed = np.bincount(lines.row[gone], weights=lines.words[gone], minlength=b - a).astype(np.int64)
                failed, kept = _judge(x, removed, limits)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), *(pa.array(x[c]) for c in COLUMNS), pa.array(failed), pa.array(kept), pa.array(removed)], names=["doc_id", *COLUMNS, "base_failed", "kept", "removed_words"])

    kinds = "".join(f"{c} long, " for c in COLUMNS)
    return rows.select("host", "doc_id", "text", "bad").mapInArrow(lean(scan), f"doc_id long, {kinds}base_failed boolean, kept boolean, removed_words long")


def clean(docs: DataFrame, limits: Limits = Limits(), host: str = "source") -> DataFrame:
    """The kept documents with all their columns; their text, and n_chars where there is such a column, without the removed lines."""
    rows, known = _with_lines(docs, limits, host)
    schema, names = docs.schema, docs.columns

    def scan(batches):
        for batch in batches:
            whole = batch.column("row").flatten()[names.index("text")].cast(pa.string())
            for a, b, data, offsets in T.blocks(whole):
                lines = Lines(data, offsets)
                x = base(data, offsets, lines)
                gone = _removed(batch, known, a, b, lines)
                removed = np.bincount(lines.row[gone], weights=lines.words[gone], minlength=b - a).astype(np.int64)
                keep = np.flatnonzero(_judge(x, removed, limits)[1])
                text = whole.slice(a, b - a).take(pa.array(keep)).to_pylist()
                place = {int(r): k for k, r in enumerate(keep)}
                cut: dict[int, list[tuple[int, int]]] = {}
                for r, s, e in zip(lines.row[gone].tolist(), lines.start[gone].tolist(), lines.end[gone].tolist(), strict=True):
                    if r in place:
                        cut.setdefault(r, []).append((s - int(offsets[r]), e - int(offsets[r])))
                for r, parts in cut.items():
                    raw, out, at = text[place[r]].encode(), [], 0
                    for s, e in parts:
                        out.append(raw[at:s])
                        at = e + 1  # with its line break
                    text[place[r]] = (b"".join(out) + raw[at:]).decode()
                own = batch.column("row").slice(a, b - a).take(pa.array(keep))
                got = dict(zip(names, own.flatten(), strict=True))
                got["text"] = pa.array(text, pa.string())
                if "n_chars" in got:
                    got["n_chars"] = pa.array([len(t) for t in text], pa.int64()).cast(got["n_chars"].type)
                yield pa.RecordBatch.from_arrays(list(got.values()), names=names)

    return rows.select("row", "host", "doc_id", "bad").mapInArrow(lean(scan), schema)  # the text once, in its row


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM {docs}),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM d),
b AS (SELECT rid, doc_id, source, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines FROM w),
p AS (SELECT rid, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
g AS (SELECT rid, i, word || ' ' || lead(word, 1) OVER (PARTITION BY rid ORDER BY i) || ' ' || lead(word, 2) OVER (PARTITION BY rid ORDER BY i) AS g FROM p),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM g WHERE g IS NOT NULL) WHERE n > 1),
c AS (SELECT rid, count(DISTINCT j) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM r) GROUP BY rid),
l AS (SELECT rid, doc_id, source, translate(array_to_string(regexp_extract_all(l, '[^\x20\x09-\x0D]+'), ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line,
        len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS n FROM (SELECT rid, doc_id, source, unnest(lines) AS l FROM w)),
h AS (SELECT source, count(*) AS n FROM d GROUP BY source),
f AS (SELECT l.source, line, min(doc_id) AS first FROM l JOIN h ON l.source IS NOT DISTINCT FROM h.source GROUP BY l.source, line, h.n
      HAVING count(DISTINCT rid) > 20 AND count(DISTINCT rid) * 100 > h.n * 5),
x AS (SELECT rid, sum(l.n) AS removed FROM l JOIN f ON l.line = f.line AND l.source IS NOT DISTINCT FROM f.source AND l.doc_id IS DISTINCT FROM f.first GROUP BY rid),
v AS (SELECT b.*, coalesce(c.n_repeat_words, 0) AS n_repeat_words, coalesce(x.removed, 0) AS removed FROM b LEFT JOIN c USING (rid) LEFT JOIN x USING (rid))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  (NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * (n_words - removed) >= 50 * n_words) AS kept, removed::BIGINT AS removed_words
FROM v
"""
