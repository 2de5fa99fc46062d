"""MAT files (level 5): a Spark data source that reads their vectors as columns, and a sink that writes a file a task.

    register(spark)
    spark.read.format("mat").option("columns", "lon,lat").load("/data/folder or file.mat")

Every real numeric vector of a file is a column, matrices of several columns are
arrays; all that are read must have the same number of rows.  Only the wanted
variables are read, and rows are read by ranges: an uncompressed variable is
sought to, so a large file is many tasks; a compressed one is unpacked by each
of its tasks.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

#: Rows of a partition by default.
ROWS = 1_000_000
#: Element types of the format (fixed values): number -> numpy type.
_KINDS = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
_MATRIX, _COMPRESSED = 14, 15
#: Array classes that hold numbers, and the flag of complex arrays (fixed values).
_NUMERIC, _COMPLEX = range(6, 16), 0x800


@dataclass
class Variable:
    name: str
    shape: tuple[int, ...]
    kind: np.dtype
    at: int  # where the numbers begin: in the file, or in the unpacked element
    packed: tuple[int, int] | None  # (offset, length) of the compressed element


def _tag(raw: bytes, at: int, order: str) -> tuple[int, int, int, int]:
    """(type, length, where its data begin, where the next element begins) of an element."""
    (first,) = struct.unpack_from(order + "I", raw, at)
    if first >> 16:  # small elements hold their data in the tag
        return first & 0xFFFF, first >> 16, at + 4, at + 8
    (length,) = struct.unpack_from(order + "I", raw, at + 4)
    return first, length, at + 8, at + 8 + length + (-length % 8)


def _matrix(raw: bytes, at: int, order: str) -> tuple[str, tuple[int, ...], np.dtype, int] | None:
    """(name, shape, type, offset of the numbers) of the array whose parts begin at ``at``; None where it is not real and numeric."""
    _, _, data, at = _tag(raw, at, order)
    (flags,) = struct.unpack_from(order + "I", raw, data)
    _, length, data, at = _tag(raw, at, order)
    shape = struct.unpack_from(f"{order}{length // 4}i", raw, data)
    _, length, data, at = _tag(raw, at, order)
    name = raw[data : data + length].decode("latin-1")
    if flags & 0xFF not in _NUMERIC or flags & _COMPLEX:
        return None
    kind, _, data, _ = _tag(raw, at, order)
    return name, tuple(shape), np.dtype(order + _KINDS[kind]), data


def _open(path: str):
    import pyarrow.fs as fs

    system, at = fs.FileSystem.from_uri(path if "://" in path or not path.startswith("file:") else "file://" + path[5:])
    return system, at


def files(path: str) -> list[str]:
    """The file, or the .mat files of a folder, in order of their names."""
    import pyarrow.fs as fs

    system, at = _open(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.Directory:
        head = path.rstrip("/")
        return [f"{head}/{f.base_name}" for f in sorted(system.get_file_info(fs.FileSelector(at)), key=lambda f: f.base_name) if f.base_name.endswith(".mat")]
    return [path]


def variables(path: str) -> list[Variable]:
    """What a file holds, from the heads of its elements; numbers are not read, but compressed elements are unpacked as far as their heads."""
    system, at = _open(path)
    out = []
    with system.open_input_file(at) as f:
        size, head = f.size(), f.read_at(128, 0)
        if len(head) < 128 or head[126:128] not in (b"IM", b"MI"):
            raise ValueError(f"{path} is no MAT file of level 5")
        order = "<" if head[126:128] == b"IM" else ">"
        pos = 128
        while pos + 8 <= size:
            kind, length, data, after = _tag(f.read_at(8, pos), 0, order)
            if kind == _MATRIX:
                got = _matrix(f.read_at(min(length, 4096), pos + data), 0, order)
                if got:
                    out.append(Variable(got[0], got[1], got[2], pos + data + got[3], None))
                pos += after
            elif kind == _COMPRESSED:
                raw = zlib.decompressobj().decompress(f.read_at(min(length, 1 << 16), pos + data), 4096)
                if _tag(raw, 0, order)[0] == _MATRIX and (got := _matrix(raw, 8, order)):
                    out.append(Variable(got[0], got[1], got[2], got[3], (pos + data, length)))
                pos += data + length
            else:
                pos += after
    return out


def _shape(v: Variable) -> tuple[int, int]:
    """(rows, columns); a row vector counts as a column."""
    rows, width = v.shape[0], int(np.prod(v.shape[1:]))
    return (width, 1) if rows == 1 and width > 1 else (rows, width)


def read_rows(path: str, v: Variable, start: int, end: int) -> np.ndarray:
    """Rows start .. end of a variable, (rows, columns), as doubles."""
    rows, width = _shape(v)
    system, at = _open(path)
    with system.open_input_file(at) as f:
        raw = zlib.decompress(f.read_at(v.packed[1], v.packed[0])) if v.packed else None
        step = v.kind.itemsize
        parts = []
        for k in range(width):
            first, n = v.at + (k * rows + start) * step, (end - start) * step
            parts.append(np.frombuffer(raw[first : first + n] if raw is not None else f.read_at(n, first), v.kind))
    return np.stack(parts, 1).astype(float) if parts else np.zeros((0, width))


@dataclass
class Part(InputPartition):
    path: str
    start: int
    end: int


class MatReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.path, self.rows = schema, options["path"], int(options.get("rows", ROWS))
        self.names = [f.name for f in schema.fields if f.name not in ("path", "row")]

    def partitions(self) -> list[Part]:
        out = []
        for path in files(self.path):
            sizes = {_shape(v)[0] for v in variables(path) if v.name in self.names}
            if len(sizes) > 1:
                raise ValueError(f"variables of {path} have different lengths: name those wanted in the option columns")
            n = sizes.pop() if sizes else 0
            out += [Part(path, s, min(s + self.rows, n)) for s in range(0, n, self.rows)]
        return out

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        known = {v.name: v for v in variables(part.path)}
        for s in range(part.start, part.end, 1 << 16):
            end = min(s + (1 << 16), part.end)
            cols = {"path": pa.array([part.path] * (end - s)), "row": pa.array(np.arange(s, end))}
            for f in self.schema.fields:
                if f.name in cols:
                    continue
                if f.name not in known:
                    cols[f.name] = pa.nulls(end - s, pa.list_(pa.float64()) if isinstance(f.dataType, ArrayType) else pa.float64())
                    continue
                x = read_rows(part.path, known[f.name], s, end)
                cols[f.name] = pa.array(list(x), pa.list_(pa.float64())) if isinstance(f.dataType, ArrayType) else pa.array(x[:, 0])
            yield pa.RecordBatch.from_arrays([cols[f.name] for f in self.schema.fields], names=[f.name for f in self.schema.fields])


class MatSource(DataSource):
    """Options: columns (names, comma-separated; all by default), rows (of a partition)."""

    @classmethod
    def name(cls) -> str:
        return "mat"

    def schema(self) -> StructType:
        found = files(self.options["path"])
        seen = {v.name: _shape(v)[1] for p in found[:1] for v in variables(p)}
        names = [c.strip() for c in self.options["columns"].split(",")] if "columns" in self.options else list(seen)
        missing = [n for n in names if n not in seen]
        if missing and found:
            raise ValueError(f"no such variables: {', '.join(missing)}")
        kind = lambda n: ArrayType(DoubleType()) if seen.get(n, 1) > 1 else DoubleType()
        return StructType([StructField("path", StringType()), StructField("row", LongType()), *[StructField(n, kind(n)) for n in names]])

    def reader(self, schema: StructType) -> MatReader:
        return MatReader(schema, self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MatSource)


def encoded(arrays: dict[str, np.ndarray], compress: bool = False) -> bytes:
    """A file's bytes: real arrays of doubles."""

    def element(kind: int, data: bytes) -> bytes:
        return struct.pack("<II", kind, len(data)) + data + b"\0" * (-len(data) % 8)

    out = b"MATLAB 5.0 MAT-file".ljust(124) + struct.pack("<H", 0x0100) + b"IM"
    for name, a in arrays.items():
        a = np.atleast_2d(np.asarray(a, "<f8").T).T if np.ndim(a) == 1 else np.asarray(a, "<f8")
        parts = element(6, struct.pack("<II", 6, 0)) + element(5, struct.pack(f"<{a.ndim}i", *a.shape)) + element(1, name.encode("latin-1")) + element(9, a.tobytes(order="F"))
        whole = element(_MATRIX, parts)
        if compress:
            packed = zlib.compress(whole)
            whole = struct.pack("<II", _COMPRESSED, len(packed)) + packed
        out += whole
    return out


def write_mat(df: DataFrame, path: str, compress: bool = False) -> DataFrame:
    """Write the numeric columns of df below the folder path, a file a task; the files that count, as (path, rows).

    A file carries its task attempt in its name, and the table returned is written (below path/_written) and names those of the attempts
    that succeeded: remove others before reading the folder as a whole.  Nulls become NaN.
    """
    names = df.columns

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context, held = TaskContext.get(), []
        for b in batches:
            held.append(np.stack([c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in b.columns], 1))
        x = np.concatenate(held) if held else np.zeros((0, len(names)))
        if not len(x):
            return
        target = f"{path.rstrip('/')}/part-{context.partitionId():05d}-{context.taskAttemptId()}.mat"
        system, at = _open(target)
        system.create_dir(at.rpartition("/")[0], recursive=True)
        with system.open_output_stream(at) as f:
            f.write(encoded({n: x[:, k] for k, n in enumerate(names)}, compress))
        yield pa.RecordBatch.from_pydict({"path": [target], "rows": pa.array([len(x)], pa.int64())})

    df.mapInArrow(each, "path string, rows long").write.parquet(f"{path.rstrip('/')}/_written")
    return df.sparkSession.read.schema("path string, rows long").parquet(f"{path.rstrip('/')}/_written")
