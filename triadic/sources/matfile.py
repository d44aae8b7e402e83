"""MAT files of version 5 (and, where h5py is installed, 7.3), and a Spark data source for them and for .npy files, read in slabs."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Fixed values of the format: element types and array classes.
ELEMENT = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
MATRIX, COMPRESSED = 14, 15
NUMERIC = {6: "f8", 7: "f4", 8: "i1", 9: "u1", 10: "i2", 11: "u2", 12: "i4", 13: "u4", 14: "i8", 15: "u8"}


def _elements(data: bytes, order: str):
    """(type, bytes) of the data elements of a buffer, each padded to 8 bytes but for compressed ones."""
    at = 0
    while at + 8 <= len(data):
        kind, size = struct.unpack_from(order + "II", data, at)
        if kind >> 16:  # a small element: its size and data share the tag
            yield kind & 0xFFFF, data[at + 4 : at + 4 + (kind >> 16)]
            at += 8
            continue
        yield kind, data[at + 8 : at + 8 + size]
        at += 8 + size + (-size % 8 if kind != COMPRESSED else 0)


def _matrix(data: bytes, order: str):
    parts = list(_elements(data, order))
    flags = struct.unpack(order + "II", parts[0][1][:8])[0]
    dims = np.frombuffer(parts[1][1], order + "i4")
    name = parts[2][1].decode("latin-1")
    kind = flags & 0xFF
    if kind not in NUMERIC:
        return name, None
    number = lambda p: np.frombuffer(p[1], order + ELEMENT[p[0]]).astype(NUMERIC[kind])
    value = number(parts[3])
    if flags & 0x800:
        value = value + 1j * number(parts[4])
    return name, value.reshape(dims, order="F")


def _read_v5(data: bytes) -> dict[str, np.ndarray]:
    order = "<" if data[126:128] == b"IM" else ">"
    out = {}
    for kind, body in _elements(data[128:], order):
        if kind == COMPRESSED:
            kind, body = next(_elements(zlib.decompress(body), order))
        if kind == MATRIX:
            name, value = _matrix(body, order)
            if value is not None and not name.startswith(("__", "#")):
                out[name] = value
    return out


def _read_v73(path: str) -> dict[str, np.ndarray]:
    """HDF5 keeps arrays with their axes turned round and complex numbers as pairs."""
    import h5py

    out = {}
    with opened(path) as raw, h5py.File(raw, "r") as f:
        for name, item in f.items():
            if name.startswith(("__", "#")) or not isinstance(item, h5py.Dataset):
                continue
            a = item[()]
            if getattr(a.dtype, "names", None) and set(a.dtype.names) == {"real", "imag"}:
                a = a["real"] + 1j * a["imag"]
            out[name] = np.transpose(a)
    return out


def opened(path: str):
    """A file to read, by its path or its URI: file: as a local one, other schemes through Arrow's file systems."""
    where = urlparse(path)
    if where.scheme == "file":
        return open(where.path, "rb")
    if "://" in path:
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(path)
        return system.open_input_file(inner)
    return open(path, "rb")


def read_mat(path: str) -> dict[str, np.ndarray]:
    with opened(path) as f:
        data = f.read()
    if data[:4] == b"\x89HDF" or data[512:516] == b"\x89HDF":
        try:
            return _read_v73(path)
        except ImportError as e:
            raise ImportError("MAT files of version 7.3 need h5py") from e
    return _read_v5(data)


def write_mat(path: str, arrays: dict[str, np.ndarray], compress: bool = False) -> None:
    """Double arrays, real or complex, as version 5."""

    def element(kind: int, body: bytes) -> bytes:
        return struct.pack("<II", kind, len(body)) + body + b"\0" * (-len(body) % 8)

    with open(path, "wb") as f:
        f.write(b"MATLAB 5.0 MAT-file".ljust(124) + struct.pack("<H", 0x0100) + b"IM")
        for name, a in arrays.items():
            a = np.asarray(a)
            flags = 6 | (0x800 if np.iscomplexobj(a) else 0)
            body = element(6, struct.pack("<II", flags, 0)) + element(5, np.array(np.atleast_2d(a).shape, "<i4").tobytes()) + element(1, name.encode())
            for part in (a.real, a.imag) if np.iscomplexobj(a) else (a,):
                body += element(9, np.asarray(part, "<f8").tobytes(order="F"))
            whole = element(MATRIX, body)
            if compress:
                packed = zlib.compress(whole)
                whole = struct.pack("<II", COMPRESSED, len(packed)) + packed
            f.write(whole)


# ---- arrays in files, read in slabs by offset ------------------------------------------------------------------------


@dataclass
class Place:
    """Where an array lies: numbers of `kind` from `offset` on, first axis fastest if `fortran`; with `packed`, offset is that of a zlib stream and `inner` counts its bytes before the numbers."""

    offset: int
    kind: str
    shape: tuple[int, ...]
    fortran: bool
    packed: int = 0
    inner: int = 0
    complex: bool = False


def _tag(head: bytes, order: str) -> tuple[int, int, int]:
    """(type, bytes of data, bytes of the tag with its data, padded) of an element that begins with head."""
    kind, size = struct.unpack_from(order + "II", head)
    if kind >> 16:
        return kind & 0xFFFF, kind >> 16, 8
    return kind, size, 8 + size + (-size % 8 if kind != COMPRESSED else 0)


def _header(read, order: str) -> tuple[str, Place | None]:
    """Name and place of a matrix whose elements read(n) gives; the place's offset counts from the matrix's first element."""
    at = 0
    parts = []
    for _ in range(3):
        head = read(8)
        kind, size, whole = _tag(head, order)
        body = head[4 : 4 + size] if whole == 8 and size <= 4 else read(whole - 8)[:size]
        parts.append(body)
        at += whole
    flags = struct.unpack(order + "II", parts[0][:8])[0]
    if flags & 0xFF not in NUMERIC:
        return parts[2].decode("latin-1"), None
    head = read(8)
    kind, size, whole = _tag(head, order)
    dims = tuple(np.frombuffer(parts[1], order + "i4").tolist())
    return parts[2].decode("latin-1"), Place(at + (4 if whole == 8 and size <= 4 else 8), order + ELEMENT[kind], dims, True, complex=bool(flags & 0x800))


class _Unpacked:
    """Reads a zlib stream of a file bit by bit."""

    def __init__(self, f, size: int):
        self.f, self.left, self.stream, self.held = f, size, zlib.decompressobj(), b""

    def read(self, n: int) -> bytes:
        while len(self.held) < n and (self.left or self.stream.unconsumed_tail):
            raw = self.stream.unconsumed_tail or self.f.read(min(self.left, 1 << 20))
            if not self.stream.unconsumed_tail:
                self.left -= len(raw)
            self.held += self.stream.decompress(raw, 1 << 20)
        out, self.held = self.held[:n], self.held[n:]
        return out

    def skip(self, n: int) -> None:
        while n:
            n -= len(self.read(min(n, 1 << 20)))


def places(path: str) -> dict[str, Place]:
    """The numeric arrays of a .npy file (named "") or of a .mat file of version 5, from their headers alone."""
    out = {}
    with opened(path) as f:
        if path.endswith(".npy"):
            version = np.lib.format.read_magic(f)
            shape, fortran, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
            return {"": Place(f.tell(), kind.str, shape, fortran, complex=kind.kind == "c")}
        top = f.read(128)
        if top[:4] == b"\x89HDF":
            raise ValueError("MAT files of version 7.3 are read whole, by read_mat")
        order = "<" if top[126:128] == b"IM" else ">"
        while len(head := f.read(8)) == 8:
            kind, size, whole = _tag(head, order)
            here = f.tell()
            if kind == MATRIX:
                name, place = _header(f.read, order)
                if place:
                    place.offset += here
            elif kind == COMPRESSED:
                unpacked = _Unpacked(f, size)
                if _tag(unpacked.read(8), order)[0] != MATRIX:
                    f.seek(here + size)
                    continue
                name, place = _header(unpacked.read, order)
                if place:
                    place.inner, place.offset, place.packed = place.offset + 8, here, size
            else:
                name, place = "", None
            if place and not name.startswith(("__", "#")):
                out[name] = place
            f.seek(here + whole - 8)
    return out


def numbers(path: str, place: Place, first: int, count: int) -> np.ndarray:
    """count numbers of an array from the first-th on, in the order they lie in the file."""
    width = np.dtype(place.kind).itemsize
    with opened(path) as f:
        f.seek(place.offset)
        if place.packed:
            stream = _Unpacked(f, place.packed)
            stream.skip(place.inner + first * width)
            return np.frombuffer(stream.read(count * width), place.kind)
        f.seek(first * width, 1)
        return np.frombuffer(f.read(count * width), place.kind)


class _Slab(InputPartition):
    def __init__(self, lo: int, hi: int):
        self.lo, self.hi = lo, hi


#: Numbers that a task gives away at a time.
STEP = 1 << 18


class _ArrayReader(DataSourceReader):
    """A partition is a stretch of the array as it lies in the file: of times where they are the slowest axis, else of the other axes."""

    def __init__(self, options: dict):
        self.path, self.name, self.parts = options["path"], options.get("variable"), int(options.get("partitions", 4))

    def _place(self) -> Place:
        found = places(self.path)
        if not self.name and len(found) > 1:
            found = {k: p for k, p in found.items() if len(p.shape) >= 2 and max(p.shape) > 1}
        if self.name is not None and self.name not in found or not self.name and len(found) != 1:
            raise ValueError(f"one array is expected, found: {', '.join(sorted(found)) or 'none'}")
        place = found[self.name] if self.name else next(iter(found.values()))
        if place.complex:
            raise TypeError("the field must be real-valued")
        return place

    def partitions(self):
        place = self._place()
        rows = place.shape[-1] if place.fortran else place.shape[0]  # of the slowest axis
        edges = np.linspace(0, rows, min(self.parts, rows) + 1).astype(int).tolist()
        return [_Slab(a, b) for a, b in zip(edges[:-1], edges[1:])]

    def read(self, partition):
        import pyarrow as pa

        place = self._place()
        size = int(np.prod(place.shape))
        each = size // (place.shape[-1] if place.fortran else place.shape[0])
        for lo in range(partition.lo * each, partition.hi * each, STEP):
            n = min(STEP, partition.hi * each - lo)
            at = np.unravel_index(np.arange(lo, lo + n), place.shape, order="F" if place.fortran else "C")
            i = np.ravel_multi_index(at[1:], place.shape[1:]) if len(place.shape) > 1 else np.zeros(n, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at[0].astype(np.int64)), pa.array(i.astype(np.int64)), pa.array(numbers(self.path, place, lo, n).astype(float))], ["t", "i", "value"])


class MatSource(DataSource):
    """spark.read.format("matfield").load(path): rows (t, i, value) of a .npy file or a .mat file of version 5, i the row-major number within a sample (point and variable). The path, or file: URI, must be one that all tasks can open; headers are read first and numbers in slabs by their offset."""

    @classmethod
    def name(cls):
        return "matfield"

    def schema(self):
        return "t long, i long, value double"

    def reader(self, schema):
        return _ArrayReader(self.options)


def register(spark) -> None:
    spark.dataSource.register(MatSource)
