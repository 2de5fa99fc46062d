"""BPE encoding and decoding by tree concatenation (operator 11).

Texts are cut in halves down to segments, segments are encoded in parallel, and
halves are put together again.  At white space that is plain concatenation: no
pre-token holds white space.  A stretch without white space is normalised and
cut into pre-tokens as the library does; a pre-token too long for one segment
is itself cut in halves, leaves are encoded apart (all but the last without the
end-of-word mark), and at each join a window of tokens from both sides is
encoded again.  The window doubles until it agrees with both sides: its first
token is the left side's and its last token the right side's at that place, or
it reaches their ends.

That is exact.  Merges are made in order of rank, then place.  A run of tokens
of a right encoding is the right encoding of its own text, for no merge crossed
its borders.  Conversely a sequence whose neighbours are each rightly encoded as
a pair is right as a whole: take the first merge in the whole text that crosses
a border between two of its tokens; until then the merges within those two were
the same as in the text of the pair, so the pair would have made it as well.
With the agreed tokens at its edges every pair of the joined sequence lies in
the left side, the window or the right side.

Texts of up to SPREAD bytes are one segment of a map task.  Longer ones become
rows of segments that all executors encode, and only their joins, which cost no
more than their windows, are made together in the task of their text.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kernelspark.llm import _text as T
from kernelspark.llm._util import lean, staged

#: Bytes of text beyond which segments are dealt out; letters beyond which a pre-token is cut in halves; tokens a side of the first window.
SPREAD, LEAF, WINDOW = 1 << 16, 1 << 11, 4
#: Distinct words that a worker keeps; then it starts anew. Longer ones (in bytes) are not kept.
CACHE, KEEP_BYTES = 400_000, 64
#: The normaliser and pre-tokeniser of the tokenizer files that are cut (fixed values of that format).
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
#: Places that no pre-token of that pattern crosses: after a digit, and from a letter to a mark other than the apostrophe.
_SURE = re.compile(r"(?<=[0-9])|(?<=[a-z])(?=[!-&(-/:-@\[-`{-~])")
_SPACE = re.compile(r"[ \t-\r]+")
_DONE, _TEXT, _WORDS, _INNER, _LAST = range(5)


def halves(letters: str, leaf: int = LEAF) -> list[str]:
    """A pre-token cut in halves down to pieces of at most leaf letters."""
    parts = [letters]
    while len(parts[0]) > leaf:
        parts = [h for p in parts for h in ((p[: len(p) // 2], p[len(p) // 2 :]) if len(p) > 1 else (p,))]
    return parts


class Bpe:
    """One tokenizer file of the tokenizers library, with its padding and truncation off."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        made = json.loads(self.tokenizer.to_str())
        model, self.added = made["model"], [t["content"] for t in made["added_tokens"]]
        cut = made["pre_tokenizer"] or {}
        plain = all(not model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        own = all(not any(t[k] for k in ("single_word", "lstrip", "rstrip", "normalized")) and not _SPACE.search(t["content"]) for t in made["added_tokens"])
        apart = not any(a != b and b.startswith(a) for a in self.added for b in self.added)
        #: Whether texts may be cut; other files encode every text whole by the library.
        self.cuts = model["type"] == "BPE" and plain and own and apart and made["normalizer"] == _NORMALIZER and cut.get("type") == "Sequence" and cut.get("pretokenizers") == [_SPLIT, _BYTES]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.known: dict[int, bytes] = {}
        self._inner = self._names = None

    @property
    def inner(self):
        """The same merges without the end-of-word mark, for pieces that do not end a pre-token."""
        if self._inner is None:
            from tokenizers.models import BPE

            model = json.loads(self.tokenizer.to_str())["model"]
            self._inner = BPE(vocab=model["vocab"], merges=[tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]])
        return self._inner

    def piece(self, letters: str, last: bool) -> list[int]:
        return [t.id for t in (self.tokenizer.model if last else self.inner).tokenize(letters)]

    def _letters(self, ids: list[int]) -> str:
        return "".join(map(self.tokenizer.model.id_to_token, ids))

    def join(self, left: list[int], right: list[int], last: bool) -> list[int]:
        """The encoding of both sides' letters; last: whether the right side ends its pre-token."""
        k = WINDOW
        while left and right:
            a, b = left[-k:], right[:k]
            ends = last and len(b) == len(right)
            letters = self._letters(a) + self._letters(b)
            window = self.piece(letters.removesuffix(self.suffix) if ends else letters, ends)
            if (len(a) == len(left) or window[0] == a[0]) and (len(b) == len(right) or window[-1] == b[-1]):
                return left[: len(left) - len(a)] + window + right[len(b) :]
            k *= 2
        return left + right

    def tree(self, parts: list[list[int]], last: bool = True) -> list[int]:
        """Put encoded neighbours together pair by pair, level by level."""
        while len(parts) > 1:
            parts = [self.join(*parts[i : i + 2], last and i + 2 >= len(parts)) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0] if parts else []

    def word(self, letters: str) -> list[int]:
        """One pre-token in byte letters."""
        parts = halves(letters)
        return self.tree([self.piece(p, i + 1 == len(parts)) for i, p in enumerate(parts)])

    def pretokens(self, text: str) -> Iterator[tuple[str, bool]]:
        """(pre-token in byte letters, False) or (added token, True) of a text, in blocks that end where no pre-token goes on."""
        pattern = "|".join(map(re.escape, self.added))
        for k, part in enumerate(re.split(f"({pattern})", text) if self.added else [text]):
            if k % 2:
                yield part, True
                continue
            normal, at = self.tokenizer.normalizer.normalize_str(part), 0
            while at < len(normal):
                sure = _SURE.search(normal, at + SPREAD)
                end = sure.start() if sure else len(normal)
                for letters, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal[at:end]):
                    yield letters, False
                at = end

    def stretch(self, text: str) -> list[int]:
        """A stretch of text with long pre-tokens, white space or none."""
        out = []
        for letters, added in self.pretokens(text):
            out += [self.tokenizer.token_to_id(letters)] if added else self.word(letters)
        return out

    def segments(self, text: str) -> Iterator[tuple[int, int, str]]:
        """(kind, run, text) of a long text: halves at the white space nearest their middle; without any, pre-tokens, and halves of long ones (one run each)."""
        todo, run = [text], 0
        while todo:
            part = todo.pop()
            if len(part) <= SPREAD:
                yield _TEXT, -1, part
                continue
            mid = len(part) // 2
            after = _SPACE.search(part, mid)
            back = next((m for w in (1 << 8, 1 << 12, mid) for m in [None, *_SPACE.finditer(part, max(0, mid - w), mid)][-1:] if m), None)
            near = min((m for m in (after, back) if m and 0 < m.start() and m.end() < len(part)), key=lambda m: abs(m.start() - mid), default=None)
            if near:
                todo += [part[near.end() :], part[: near.start()]]
                continue
            short, size = [], 0
            for letters, added in self.pretokens(part.strip(" \t\n\v\f\r")):
                if added or len(letters) > SPREAD or size > SPREAD:
                    if short:
                        yield _WORDS, -1, " ".join(short)
                    short, size = [], 0
                if added:
                    yield _TEXT, -1, letters
                elif len(letters) > SPREAD:
                    run, leaves = run + 1, halves(letters, SPREAD // 2)
                    for i, leaf in enumerate(leaves, 1):
                        yield _LAST if i == len(leaves) else _INNER, run, leaf
                else:
                    short.append(letters)
                    size += len(letters) + 1
            if short:
                yield _WORDS, -1, " ".join(short)

    def segment(self, kind: int, text: str) -> np.ndarray:
        if kind == _TEXT:
            return next(self.column(pa.array([text], pa.large_string())))
        if kind == _WORDS:
            return np.array([i for w in text.split(" ") for i in self.word(w)], "<u4")
        parts = halves(text)
        return np.array(self.tree([self.piece(p, kind == _LAST and i + 1 == len(parts)) for i, p in enumerate(parts)], kind == _LAST), "<u4")

    def _block(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
        words = T.Words(data, offsets)
        value, at, back = np.unique(words.value, return_index=True, return_inverse=True)
        if len(self.known) > CACHE:
            self.known.clear()
        got = [self.known.get(v) for v in value.tolist()]
        new = [i for i, g in enumerate(got) if g is None]
        if new:
            raw, span = data.tobytes(), [(int(words.start[at[i]]), int(words.end[at[i]])) for i in new]
            short = [k for k, (s, e) in enumerate(span) if e - s <= LEAF]
            made = self.tokenizer.encode_batch_fast([raw[slice(*span[k])].decode() for k in short], add_special_tokens=False)
            ids = dict(zip(short, (m.ids for m in made), strict=True))
            for k, i in enumerate(new):
                s, e = span[k]
                got[i] = np.array(ids[k] if k in ids else self.stretch(raw[s:e].decode()), "<u4").tobytes()
                if e - s <= KEEP_BYTES:
                    self.known[int(value[i])] = got[i]
        size = np.fromiter(map(len, got), np.int64, len(got)) // 4
        flat, begin = np.frombuffer(b"".join(got), "<u4"), np.cumsum(size) - size
        count = size[back]
        until = np.concatenate(([0], np.cumsum(count)))
        ids = flat[np.repeat(begin[back] - until[:-1], count) + np.arange(until[-1])]
        for a, b in zip(until[words.first[:-1]].tolist(), until[words.first[1:]].tolist(), strict=True):
            yield ids[a:b]

    def column(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text; null counts as empty."""
        for a, b, data, offsets in T.blocks(texts):
            if self.cuts:
                yield from self._block(data, offsets)
            else:
                raw = data.tobytes()
                for k in range(b - a):
                    yield np.array(self.tokenizer.encode(raw[offsets[k] : offsets[k + 1]].decode(), add_special_tokens=False).ids, "<u4")

    def texts(self, ids: pa.ListArray) -> pa.Array:
        """What the library's decode gives for each list of ids, special tokens included; ids that the file lacks are passed over."""
        if self.tokenizer.decoder is not None:
            return pa.array([self.tokenizer.decode(x or [], skip_special_tokens=False) for x in ids.to_pylist()], pa.large_string())
        if self._names is None:
            size = max(self.tokenizer.get_vocab(with_added_tokens=True).values(), default=-1) + 1
            self._names = pa.array([self.tokenizer.id_to_token(i) for i in range(size)], pa.large_string())
        flat = ids.flatten().to_numpy()
        counts = np.diff(ids.offsets.to_numpy())
        known = (flat >= 0) & (flat < len(self._names))
        names = self._names.take(pa.array(np.where(known, flat, 0)))
        known &= names.is_valid().to_numpy(zero_copy_only=False)
        if not known.all():
            row = np.repeat(np.arange(len(counts)), counts)[known]
            names, counts = names.filter(pa.array(known)), np.bincount(row, minlength=len(counts))
        offsets = np.concatenate(([0], np.cumsum(counts)))
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), names), pa.scalar(" ", pa.large_string()))


_loaded: dict[str, Bpe] = {}


def bpe(path: str) -> Bpe:
    """One for each worker process and file."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _loaded[path] = Bpe(path)
    return _loaded[path]


def _short(path: str):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = bpe(path)
        for batch in batches:
            ids = batch.column("doc_id")
            at, held = 0, []
            for x in own.column(batch.column("text")):
                held.append(x.tobytes())
                if len(held) == 512:
                    yield pa.RecordBatch.from_arrays([ids.slice(at, len(held)), pa.array(held, pa.binary())], names=["doc_id", "ids"])
                    at, held = at + len(held), []
            if held:
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(held)), pa.array(held, pa.binary())], names=["doc_id", "ids"])

    return lean(each)


_SEGMENT = "doc_id long, key long, part int, kind int, run int, text string"


def _long(docs: DataFrame, path: str) -> DataFrame:
    """Long texts: segments are rows, written, dealt to all executors, encoded there, and joined by text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, key = bpe(path), TaskContext.get().partitionId() << 36
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                for part, (kind, run, piece) in enumerate(own.segments(text.as_py()) if own.cuts else [(_TEXT, -1, text.as_py())]):
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array([doc], pa.int64()), "key": [key], "part": pa.array([part], pa.int32()), "kind": pa.array([kind], pa.int32()), "run": pa.array([run], pa.int32()), "text": [piece]})
                key += 1

    def encode_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = bpe(path)
        for batch in batches:
            made = [own.segment(k, t.as_py()).tobytes() for k, t in zip(batch.column("kind").to_pylist(), batch.column("text"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "key", "part", "kind", "run")] + [pa.array(made, pa.binary())], names=["doc_id", "key", "part", "kind", "run", "ids"])

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        own, out, leaves = bpe(path), [], []
        for kind, ids in rows.sort_values("part")[["kind", "ids"]].itertuples(index=False):
            x = np.frombuffer(ids, "<u4")
            if kind in (_INNER, _LAST):
                leaves.append(x.tolist())
                if kind == _LAST:
                    out.append(np.array(own.tree(leaves), "<u4"))
                    leaves = []
            else:
                out.append(x)
        whole = np.concatenate(out).tobytes() if out else b""
        return pd.DataFrame({"doc_id": rows["doc_id"].iloc[:1].astype("Int64"), "ids": [whole]})

    parts = staged(docs.mapInArrow(lean(cut), _SEGMENT), "segments")
    encoded = parts.repartition("key", "part").mapInArrow(lean(encode_parts), "doc_id long, key long, part int, kind int, run int, ids binary")
    return encoded.groupBy("key").applyInPandas(join, "doc_id long, ids binary")


def encode(docs: DataFrame, path: str, column: str = "text", packed: bool = False) -> DataFrame:
    """(doc_id, ids) of every row: the ids of its whole text without special tokens added, as array<int>, or packed as little-endian unsigned 32-bit integers.

    Equal to the library's encode for every text.  Null and empty texts and
    white space alone give no ids.  Null and repeated doc_id are kept as they
    are, a row each.  An empty table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(column).cast("string"), F.lit("")).alias("text"))
    size = F.octet_length("text")
    out = rows.where(size <= SPREAD).mapInArrow(_short(path), "doc_id long, ids binary").unionByName(_long(rows.where(size > SPREAD), path))
    return out if packed else unpack(out)


def unpack(df: DataFrame) -> DataFrame:
    """ids from packed to array<int>."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_lists(b.column("ids"))) if n == "ids" else b.column(n) for n in b.schema.names], names=b.schema.names)

    at = df.schema.names.index("ids")
    schema = ", ".join(f"`{f.name}` {'array<int>' if i == at else f.dataType.simpleString()}" for i, f in enumerate(df.schema.fields))
    return df.mapInArrow(each, schema)


def _lists(ids: pa.Array) -> pa.ListArray:
    """Packed or listed ids as lists; null as empty."""
    if pa.types.is_list(ids.type) or pa.types.is_large_list(ids.type):
        ids = ids.cast(pa.list_(pa.int32()))
        return pc.if_else(ids.is_valid(), ids, pa.scalar([], pa.list_(pa.int32()))) if ids.null_count else ids
    data, offsets = _bytes(ids)
    return pa.ListArray.from_arrays(pa.array((offsets // 4).astype(np.int32)), pa.array(data.view("<u4").astype(np.int32)))


def _bytes(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    values = [x.as_buffer() if x.is_valid else b"" for x in ids]
    offsets = np.concatenate(([0], np.cumsum([len(v) for v in values], dtype=np.int64)))
    return np.frombuffer(b"".join(values), np.uint8), offsets


def decode(df: DataFrame, path: str) -> DataFrame:
    """df with the column decoded: the text of its ids (array<int> or packed) as the library's decode gives it with special tokens kept; null ids give an empty text."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = bpe(path)
        for b in batches:
            for s in range(0, b.num_rows, 512):
                part = b.slice(s, 512)
                yield pa.RecordBatch.from_arrays([*part.columns, own.texts(_lists(part.column("ids"))).cast(pa.string())], names=[*part.schema.names, "decoded"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(lean(each), schema + ", decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row, from encode and decode."""
    both = decode(encode(docs, path, packed=True), path)
    return both.select("doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
