"""MATLAB 5 containers as a Python data source: ``spark.read.format("mat5")`` and ``df.write.format("mat5")``.

A file is a header and tagged elements; a matrix element holds flags, dimensions, a name and the stored parts, and may be
deflated as a whole. Reading walks the tags of each file on the driver (headers only), then gives each task a stretch of
samples: of plain elements by byte offset, so that one large array is read by many tasks; a deflated element has no offsets, so its file
is one task, which inflates each stored part in a stream of its own and never holds more than a batch.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

HEADER = 128
MATRIX, DEFLATED = 14, 15
#: Stored kinds of numbers, by their number in a tag (fixed values of the format).
KINDS = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
#: Array classes of numbers, as in the flags (fixed values of the format).
NUMERIC = range(6, 16)
COMPLEX = 0x0800
#: Samples of a task, samples of a batch, bytes inflated at a time.
STRETCH, BATCH, CHUNK = 1 << 20, 1 << 16, 1 << 20


def _open(path: str) -> pa.NativeFile:
    fs, at = pa.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pa.fs.LocalFileSystem(), path)
    return fs.open_input_file(at)


class Plain:
    """Bytes of a file from an offset on."""

    def __init__(self, path: str, at: int) -> None:
        self.file = _open(path)
        self.file.seek(at)

    def take(self, n: int) -> bytes:
        got = self.file.read(n)
        if len(got) < n:
            raise ValueError("the container ends early")
        return got

    def skip(self, n: int) -> None:
        self.file.seek(n, 1)


class Inflated:
    """Bytes of a deflated element, in a stream; skipping inflates and forgets."""

    def __init__(self, path: str, at: int, size: int) -> None:
        self.file, self.left = _open(path), size
        self.file.seek(at)
        self.stream, self.held = zlib.decompressobj(), bytearray()

    def _more(self) -> None:
        if self.stream.unconsumed_tail:
            raw = self.stream.unconsumed_tail
        else:
            raw = self.file.read(min(CHUNK, self.left))
            self.left -= len(raw)
        got = self.stream.decompress(raw, CHUNK)
        if not raw and not got:
            raise ValueError("the container ends early")
        self.held += got

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            self._more()
        out = bytes(self.held[:n])
        del self.held[:n]
        return out

    def skip(self, n: int) -> None:
        while n > len(self.held):
            n -= len(self.held)
            self.held.clear()
            self._more()
        del self.held[:n]


@dataclass(frozen=True)
class Part:
    """A stored array of numbers: its place in its element's bytes, and its kind."""

    at: int
    kind: str
    count: int


@dataclass(frozen=True)
class Variable:
    """A numeric vector of a file. ``size`` is that of its deflated bytes from ``at`` on, 0 if it is plain."""

    name: str
    path: str
    at: int
    size: int
    count: int
    real: Part | None
    imag: Part | None

    def source(self, part: Part, first: int) -> Plain | Inflated:
        place = part.at + first * np.dtype(part.kind).itemsize
        if not self.size:
            return Plain(self.path, self.at + place)
        got = Inflated(self.path, self.at, self.size)
        got.skip(place)
        return got

    def values(self, part: Part | None, first: int, count: int) -> Iterator[np.ndarray]:
        """Batches of a stored part as doubles; zeros where there is none."""
        source = self.source(part, first) if part else None
        for k in range(0, count, BATCH):
            n = min(BATCH, count - k)
            yield np.frombuffer(source.take(n * np.dtype(part.kind).itemsize), part.kind).astype(np.float64) if part else np.zeros(n)


class _Walk:
    """Reads tags of an element's bytes one after another."""

    def __init__(self, source: Plain | Inflated, order: str) -> None:
        self.source, self.order, self.at = source, order, 0

    def tag(self) -> tuple[int, int, int]:
        """(kind, bytes, padding); a small element has its data in the tag."""
        raw = self.source.take(4)
        word = struct.unpack(self.order + "I", raw)[0]
        if word >> 16:
            self.at += 4
            size = word >> 16
            return word & 0xFFFF, size, 4 - size
        size = struct.unpack(self.order + "I", self.source.take(4))[0]
        self.at += 8
        return word, size, -size % 8

    def data(self) -> tuple[int, bytes]:
        kind, size, pad = self.tag()
        out = self.source.take(size)
        self.source.skip(pad)
        self.at += size + pad
        return kind, out

    def part(self) -> Part:
        kind, size, pad = self.tag()
        if kind not in KINDS:
            raise ValueError(f"stored kind {kind} is not numeric")
        made = Part(self.at, self.order + KINDS[kind], size // np.dtype(KINDS[kind]).itemsize)
        self.source.skip(size + pad)
        self.at += size + pad
        return made


def _matrix(path: str, at: int, size: int, order: str, wanted: set[str], whole: bool) -> Variable | None:
    """The variable of the element at ``at``, None if it isn't wanted; of a deflated one the parts are looked for only if ``whole``."""
    walk = _Walk(Inflated(path, at, size) if size else Plain(path, at), order)
    if size and walk.tag()[0] != MATRIX:
        return None
    flags = struct.unpack(order + "I", walk.data()[1][:4])[0]
    dims = np.frombuffer(walk.data()[1], order + "i4")
    name = walk.data()[1].decode("latin-1")
    if name not in wanted:
        return None
    if flags & 0xFF not in NUMERIC:
        raise ValueError(f"{name} is not numeric")
    count = int(np.prod(dims))
    if size and not whole:
        return Variable(name, path, at, size, count, None, None)
    real = walk.part()
    imag = walk.part() if flags & COMPLEX else None
    if real.count != count or (imag and imag.count != count):
        raise ValueError(f"{name} does not have the samples that its dimensions say")
    return Variable(name, path, at, size, count, real, imag)


def variables(path: str, wanted: list[str], whole: bool = False) -> dict[str, Variable]:
    """The wanted vectors of a file, all of one length. Inflating up to a deflated vector's parts is left to tasks, with ``whole``."""
    file = _open(path)
    head = file.read(HEADER)
    if len(head) < HEADER or head[126:128] not in (b"IM", b"MI"):
        raise ValueError(f"{path} is not a MATLAB 5 container")
    order = "<" if head[126:128] == b"IM" else ">"
    size, at, out = file.size(), HEADER, {}
    while at + 8 <= size:
        file.seek(at)
        kind, length = struct.unpack(order + "II", file.read(8))
        if kind in (MATRIX, DEFLATED):
            found = _matrix(path, at + 8, length if kind == DEFLATED else 0, order, set(wanted), whole)
            if found:
                out[found.name] = found
        at += 8 + length + (0 if kind == DEFLATED else -length % 8)
    missing = [name for name in wanted if name not in out]
    if missing:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    if len({v.count for v in out.values()}) != 1:
        raise ValueError(f"{path}: {', '.join(wanted)} must have one length")
    return out


def _files(path: str) -> list[str]:
    """A container, or those of a folder by name."""
    fs, at = pa.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pa.fs.LocalFileSystem(), path)
    info = fs.get_file_info(at)
    if info.type == pa.fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.is_file:
        return [path]
    found = sorted(f.path for f in fs.get_file_info(pa.fs.FileSelector(at)) if f.is_file and f.path.endswith(".mat"))
    return [path.rstrip("/") + "/" + f.rsplit("/", 1)[-1] for f in found]


@dataclass
class Stretch(InputPartition):
    variables: tuple[Variable, ...]
    first: int
    count: int
    n: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, names: list[str], stretch: int) -> None:
        self.path, self.names, self.stretch = path, names, stretch

    def partitions(self) -> list[InputPartition]:
        out, n = [], 0
        for file in _files(self.path):
            found = variables(file, self.names)
            held = tuple(found[name] for name in self.names)
            step = max(1, held[0].count) if any(v.size for v in held) else self.stretch
            out += [Stretch(held, k, min(step, held[0].count - k), n + k) for k in range(0, held[0].count, step)]
            n += held[0].count
        return out or [Stretch((), 0, 0, 0)]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        held = partition.variables
        if any(v.size for v in held):
            held = tuple(variables(held[0].path, self.names, whole=True).values())
            held = tuple(sorted(held, key=lambda v: self.names.index(v.name)))
        streams = [v.values(p, partition.first, partition.count) for v in held for p in (v.real, v.imag)]
        names = [f"{v.name}_{c}" for v in held for c in ("re", "im")]
        n = partition.n
        for columns in zip(*streams, strict=True):
            size = len(columns[0])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, n + size)), *map(pa.array, columns)], names=["n", *names])
            n += size


def encode(arrays: dict[str, np.ndarray], deflate: bool = False, order: str = "<") -> bytes:
    """A container of complex column vectors."""

    def element(kind: int, data: bytes) -> bytes:
        return struct.pack(order + "II", kind, len(data)) + data + b"\0" * (-len(data) % 8)

    out = [b"numeric vectors".ljust(116) + b"\0" * 8 + struct.pack(order + "H", 0x0100) + (b"IM" if order == "<" else b"MI")]
    for name, value in arrays.items():
        flags = struct.pack(order + "II", COMPLEX | 6, 0)
        dims = struct.pack(order + "ii", len(value), 1)
        parts = [element(9, part.astype(order + "f8").tobytes()) for part in (value.real, value.imag)]
        body = element(MATRIX, element(6, flags) + element(5, dims) + element(1, name.encode("latin-1")) + b"".join(parts))
        packed = zlib.compress(body)
        out.append(struct.pack(order + "II", DEFLATED, len(packed)) + packed if deflate else body)
    return b"".join(out)


@dataclass
class Written(WriterCommitMessage):
    name: str | None


class _Writer(DataSourceArrowWriter):
    """Each task writes its rows, in their order, as one container; the driver moves those of tasks that ended well into place."""

    def __init__(self, path: str, names: list[str], deflate: bool) -> None:
        self.path, self.names, self.deflate, self.trial = path, names, deflate, f"_trial-{uuid.uuid4().hex}"

    def _fs(self) -> tuple[pa.fs.FileSystem, str]:
        return pa.fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (pa.fs.LocalFileSystem(), self.path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        batches = list(iterator)
        if not sum(b.num_rows for b in batches):
            return Written(None)
        rows = pa.Table.from_batches(batches)
        arrays = {v: rows[f"{v}_re"].to_numpy() + 1j * rows[f"{v}_im"].to_numpy() for v in self.names}
        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}.mat"
        fs, at = self._fs()
        fs.create_dir(f"{at}/{self.trial}")
        with fs.open_output_stream(f"{at}/{self.trial}/{name}") as out:
            out.write(encode(arrays, self.deflate))
        return Written(name)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, at = self._fs()
        for m in messages:
            if m is not None and m.name:
                fs.move(f"{at}/{self.trial}/{m.name}", f"{at}/{m.name}")
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, at = self._fs()
        if fs.get_file_info(f"{at}/{self.trial}").type != pa.fs.FileType.NotFound:
            fs.delete_dir(f"{at}/{self.trial}")


class Mat5(DataSource):
    """Options: ``variables``, comma-separated, and ``stretch``, samples a task reads, or ``deflate`` to write.

    Rows are (n, and for each variable its re and im); n goes on over the files of a folder, by name. A variable that is not complex
    has im 0. Missing variables, other lengths, kinds that are not numeric, and files cut short are errors.
    """

    @classmethod
    def name(cls) -> str:
        return "mat5"

    def _names(self) -> list[str]:
        return [x.strip() for x in self.options.get("variables", "x,y").split(",")]

    def schema(self) -> str:
        return "n long, " + ", ".join(f"{v}_{c} double" for v in self._names() for c in ("re", "im"))

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], self._names(), int(self.options.get("stretch", STRETCH)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], self._names(), self.options.get("deflate", "false").lower() == "true")
