"""Token ids as flat binary files with document offsets (operator 6).

A corpus is written as shards in ascending order of doc_id.  A shard is two
files: ``*.bin``, all ids one after another as little-endian unsigned integers
(16 bits where the vocabulary allows, else 32), and ``*.idx``:

    magic 8 bytes | width u32 | reserved u32 | documents u64 | offsets u64[documents + 1] | doc_id i64[documents] | null u8[documents]

Both can be memory-mapped.  Files carry the number of the task attempt in their
name and the table of written shards names those of the attempts that
succeeded, so a retried or speculative task cannot mix in.  The first id of
every shard in the whole corpus is a prefix sum over that small table.

The encoder gives exactly what the tokenizers library gives for whole texts,
by asking the library's model for each distinct pre-token once: a block of texts
is cut before spaces, where byte-level pre-tokenisation always cuts as well, all
pieces get a 64-bit value at once, and only pieces with a new value are cut
further by the pre-tokenisation pattern and given to the model.  Texts where the
first cut is not certain (a space between white space) are cut by the
white-space part of that pattern; texts that hold an added token such as the
end-of-text mark, and tokenizer files with any other normaliser or
pre-tokeniser, go whole to the library.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kernelspark.llm import _text as T
from kernelspark.llm._util import lean, new_dir, trim

MAGIC = b"KSTOKENS"
_WHITE = "\t-\r \x85\xa0  -     　"
_UNSURE = re.compile(f"[{_WHITE}] (?:[{_WHITE}]|$)")
_PIECES = re.compile(f" ?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")
#: Distinct pieces, and pre-tokens, that a worker keeps; then it starts anew. A piece longer than KEEP_BYTES is not kept.
CACHE, WORDS, KEEP_BYTES, TABLE = 600_000, 150_000, 64, 1 << 20
#: The byte-level pre-tokenisation pattern of the tokenizer files used here (a fixed value).
_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[int, str]:
    """Byte-level tokenizers write each byte as a letter: printable Latin-1 ones as themselves, the others in turn from U+0100."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return {b: chr(b if b in plain else next(other)) for b in range(256)}


class Encoder:
    """Whole texts to id arrays with one byte-level tokenizer file of the tokenizers library."""

    def __init__(self, path: str, end_id: int | None = 0):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2") if max(self.size, (end_id or 0) + 1) <= 1 << 16 else np.dtype("<u4")
        self.end = np.zeros(0, self.dtype) if end_id is None else np.array([end_id], self.dtype)
        made = json.loads(self.tokenizer.to_str())
        cut, model = made["pre_tokenizer"] or {}, made["model"]
        plain = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "byte_fallback": False, "ignore_merges": False}
        #: Whether pieces may be encoded one by one; else every text goes whole to the library.
        self.by_piece = made["normalizer"] is None and not made["truncation"] and not made["padding"] and cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True) and all((model.get(k) or None) == (v or None) for k, v in plain.items())
        #: Texts that hold one of these go whole to the library as well.
        self.added = [t["content"].encode() for t in made["added_tokens"]]
        self.letters = _byte_letters()
        self.words = regex.compile(_PATTERN).findall
        self.known: dict[str, bytes] = {}
        self._forget()

    def _forget(self) -> None:
        """The pieces known: where the ids of each lie, and a table from values to pieces; what finds its place in the table taken goes to ``more``."""
        self.key, self.piece = np.zeros(TABLE, np.uint64), np.zeros(TABLE, np.int32)
        self.more: dict[int, int] = {}
        self.at, self.n, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, self.dtype)

    def _word(self, word: str) -> bytes:
        """The ids of one pre-token."""
        got = self.known.get(word)
        if got is None:
            if word.isascii() and word[1:].isalpha() and (word[0] == " " or word[0].isalpha()):
                letters = self.letters[32] + word[1:] if word[0] == " " else word
            else:
                letters = word.encode().decode("latin-1").translate(self.letters)
            tokens = self.tokenizer.model.tokenize(letters)
            got = array(self.dtype.char, [t.id for t in tokens]).tobytes()
            if len(word) <= KEEP_BYTES:
                if len(self.known) > WORDS:
                    self.known.clear()
                self.known[word] = got
        return got

    def _piece(self, piece: str) -> bytes:
        if (piece[1:] if piece[0] == " " else piece).isalpha():
            return self._word(piece)
        return b"".join(map(self._word, self.words(piece)))

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype)

    def _odd(self, data: np.ndarray, offsets: np.ndarray) -> dict[int, np.ndarray]:
        """The ids of the rows of a block that pieces before spaces don't give."""
        raw, odd = data.tobytes(), {}
        text = lambda k: raw[offsets[k] : offsets[k + 1]].decode()
        rows = set()
        for token in self.added:
            at = raw.find(token)
            while at >= 0:
                rows.add(int(np.searchsorted(offsets, at, "right")) - 1)
                at = raw.find(token, at + 1)
        for k in rows:
            odd[k] = self._whole(text(k))
        # a space between bytes that white space may have, the end of a text included
        may = (data >= 128) | ((data >= 9) & (data <= 13)) | (data == 32)
        after = np.concatenate((may[1:], [True]))
        after[offsets[1:][offsets[1:] > 0] - 1] = True
        before = np.concatenate(([False], may[:-1]))
        for k in np.unique(np.searchsorted(offsets, np.flatnonzero((data == 32) & before & after), "right") - 1).tolist():
            if k not in odd and _UNSURE.search(t := text(k)):
                odd[k] = np.frombuffer(b"".join(map(self._piece, _PIECES.findall(t))), self.dtype)
        return odd

    def _block(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
        odd = self._odd(data, offsets)
        cut = data == 32
        cut[offsets[:-1][np.diff(offsets) > 0]] = True
        start = np.flatnonzero(cut)
        end = np.concatenate((start[1:], [len(data)]))
        of = np.searchsorted(start, offsets)
        if len(self.at) > CACHE:
            self._forget()
        value = T.spans(data, start, end)
        slot = (value % np.uint64(TABLE)).astype(np.int64)
        which = self.piece[slot].astype(np.int64)
        miss = np.flatnonzero(self.key[slot] != value)
        kept = (len(self.at), len(self.flat))
        if len(miss):
            new, first, back = np.unique(value[miss], return_index=True, return_inverse=True)
            found = np.array([self.more.get(v, -1) for v in new.tolist()], np.int64)
            unknown = np.flatnonzero(found < 0)
            begin, until = start[miss[first[unknown]]], end[miss[first[unknown]]]
            order = np.argsort(until - begin > KEEP_BYTES, kind="stable")  # those that are not kept come last
            unknown, begin, until = unknown[order], begin[order], until[order]
            raw = data.tobytes()
            made = [self._piece(raw[a:b].decode()) for a, b in zip(begin.tolist(), until.tolist(), strict=True)]
            size = np.fromiter(map(len, made), np.int64, len(made)) // self.dtype.itemsize
            found[unknown] = len(self.at) + np.arange(len(made))
            self.at = np.concatenate((self.at, len(self.flat) + np.cumsum(size) - size))
            self.n, self.flat = np.concatenate((self.n, size)), np.concatenate((self.flat, np.frombuffer(b"".join(made), self.dtype)))
            keep = int(np.count_nonzero(until - begin <= KEEP_BYTES))
            kept = (kept[0] + keep, kept[1] + int(size[:keep].sum()))
            own = new[unknown[:keep]]
            place = (own % np.uint64(TABLE)).astype(np.int64)
            one = np.zeros(keep, dtype=bool)
            one[np.unique(place, return_index=True)[1]] = True
            free = one & (self.key[place] == 0) & (own != 0)
            self.key[place[free]], self.piece[place[free]] = own[free], found[unknown[:keep]][free]
            self.more.update(zip(own[~free].tolist(), found[unknown[:keep]][~free].tolist(), strict=True))
            which[miss] = found[back]
        count = self.n[which]
        until = np.concatenate(([0], np.cumsum(count)))
        ids = self.flat[np.repeat(self.at[which] - until[:-1], count) + np.arange(until[-1])]
        self.at, self.n, self.flat = self.at[: kept[0]], self.n[: kept[0]], self.flat[: kept[1]]
        for k, (a, b) in enumerate(zip(until[of[:-1]].tolist(), until[of[1:]].tolist(), strict=True)):
            yield np.concatenate((odd[k] if k in odd else ids[a:b], self.end))

    def column(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text with the end id; null counts as empty. Works on blocks of about a megabyte, a longer text being one of its own."""
        for a, b, data, offsets in T.blocks(texts):
            if self.by_piece:
                yield from self._block(data, offsets)
            else:
                raw = data.tobytes()
                for k in range(b - a):
                    yield np.concatenate((self._whole(raw[offsets[k] : offsets[k + 1]].decode()), self.end))

    def __call__(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        return self.column(pa.array(texts, pa.large_string()))


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, end_id: int | None = 0) -> Encoder:
    """One encoder for each worker process and file."""
    if (path, end_id) not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[path, end_id] = Encoder(path, end_id)
        trim()  # what reading the file took
    return _encoders[path, end_id]


def forget() -> None:
    """Drop this worker's encoders and the pieces they know, for steps that follow the encoding."""
    if _encoders:
        _encoders.clear()
        trim()


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def filesystem(at: str):
    """(pyarrow file system, path in it) of a folder URI that executors share."""
    import pyarrow.fs as fs

    return fs.FileSystem.from_uri(at if "://" in at or not at.startswith("file:") else "file://" + at[5:])


def write_shard(at: str, name: str, rows: Iterator[tuple[int | None, np.ndarray]], dtype: np.dtype) -> tuple[int, int]:
    """Write one shard; (documents, ids)."""
    fs, base = filesystem(at)
    fs.create_dir(base, recursive=True)
    ids, lengths, total = [], [], 0
    with fs.open_output_stream(f"{base}/{name}.bin") as out:
        for doc, x in rows:
            out.write(x.astype(dtype, copy=False).tobytes())
            ids.append(doc)
            lengths.append(len(x))
            total += len(x)
    with fs.open_output_stream(f"{base}/{name}.idx") as out:
        out.write(MAGIC + np.array([dtype.itemsize, 0], "<u4").tobytes() + np.array([len(ids)], "<u8").tobytes())
        out.write(np.concatenate(([0], np.cumsum(lengths, dtype=np.int64))).astype("<u8").tobytes())
        out.write(np.array([i or 0 for i in ids], "<i8").tobytes() + np.array([i is None for i in ids], "u1").tobytes())
    return len(ids), total


class Shard:
    """A written shard: ``offsets``, ``doc_ids`` (None: null) and ``self[k]``, the ids of its k-th document, read on demand."""

    def __init__(self, at: str, name: str):
        fs, base = filesystem(at)
        with fs.open_input_file(f"{base}/{name}.idx") as f:
            raw = f.read()
        if raw[:8] != MAGIC:
            raise ValueError(f"{name}.idx is no index of token ids")
        width, n = int.from_bytes(raw[8:12], "little"), int.from_bytes(raw[16:24], "little")
        self.dtype = np.dtype(f"<u{width}")
        self.offsets = np.frombuffer(raw, "<u8", n + 1, 24).astype(np.int64)
        ids = np.frombuffer(raw, "<i8", n, 24 + 8 * (n + 1))
        null = np.frombuffer(raw, "u1", n, 24 + 8 * (n + 1) + 8 * n)
        self.doc_ids = [None if z else int(i) for i, z in zip(ids, null, strict=True)]
        if self.offsets[-1] == 0:
            self.ids = np.zeros(0, self.dtype)
        elif fs.type_name == "local":
            self.ids = np.memmap(f"{base}/{name}.bin", self.dtype, "r")
        else:
            self.ids, self._file = None, fs.open_input_file(f"{base}/{name}.bin")

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def __getitem__(self, k: int) -> np.ndarray:
        a, b = self.offsets[k], self.offsets[k + 1]
        if self.ids is not None:
            return np.asarray(self.ids[a:b])
        w = self.dtype.itemsize
        return np.frombuffer(self._file.read_at(int(b - a) * w, int(a) * w), self.dtype)


def write(docs: DataFrame, path: str, at: str, end_id: int | None = 0) -> DataFrame:
    """Write the corpus of docs (doc_id, text) to the folder ``at``; the table of shards (at, shard, name, documents, ids, base).

    Rows are dealt out by ranges of doc_id (null first) and sorted within each;
    equal ids keep together in any order.
    """

    def shard(batches):
        from pyspark import TaskContext

        context = TaskContext.get()
        name = f"shard-{context.partitionId():06d}-{context.taskAttemptId()}"
        encode = encoder(path, end_id)

        def rows():
            for batch in batches:
                yield from zip(batch.column("doc_id").to_pylist(), encode.column(batch.column("text")), strict=True)

        first = rows()
        head = next(first, None)
        if head is None:
            return
        import itertools

        n, total = write_shard(at, name, itertools.chain([head], first), encode.dtype)
        yield pa.RecordBatch.from_pydict({"shard": pa.array([context.partitionId()], pa.int64()), "name": [name], "documents": pa.array([n], pa.int64()), "ids": pa.array([total], pa.int64())})

    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).repartitionByRange(F.col("doc_id")).sortWithinPartitions("doc_id")
    table = f"{at}/shards"
    rows.mapInArrow(lean(shard), "shard long, name string, documents long, ids long").write.parquet(table)
    shards = spark.read.schema("shard long, name string, documents long, ids long").parquet(table)
    # one row a shard: the prefix sum is over that, not over documents
    listed = sorted(shards.collect())
    base, out = 0, []
    for r in listed:
        out.append((at, r.shard, r.name, r.documents, r.ids, base))
        base += r.ids
    return spark.createDataFrame(out, "at string, shard long, name string, documents long, ids long, base long")


def read(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in shards, from the files."""

    def scan(batches):
        for batch in batches:
            for r in batch.to_pylist():
                s = Shard(r["at"], r["name"])
                for a in range(0, len(s), 5000):
                    k = range(a, min(a + 5000, len(s)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([s.doc_ids[i] for i in k], pa.int64()), pa.array(r["base"] + s.offsets[k.start : k.stop]), pa.array(np.diff(s.offsets[k.start : k.stop + 1])), pa.array([crc(s[i]) for i in k], pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    n = max(1, min(shards.count(), 4 * shards.sparkSession.sparkContext.defaultParallelism))
    return shards.repartition(n).mapInArrow(lean(scan), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, path: str, end_id: int | None = 0) -> DataFrame:
    """Write docs to a new shared folder and read the files back, a row for each document.

    Null and empty texts are the end id alone.  Null ids come first, repeated
    ids stand side by side.  An empty table gives no files and no rows.  Other
    columns are not read.
    """
    return read(write(docs, path, new_dir(docs.sparkSession, "tokens"), end_id))


def open_corpus(shards: DataFrame) -> list[Shard]:
    """The shards in order, for a training job's random access."""
    return [Shard(r.at, r.name) for r in sorted(shards.collect(), key=lambda r: r.shard)]


