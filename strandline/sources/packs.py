"""Random access to packs: indexes by mapped files, objects by offset, delta bases by seeking.

A pack's objects are read in ranges of its offset order, so a large pack is
many tasks; none holds more than a bounded cache of delta bases.
"""

from __future__ import annotations

import mmap
import os
import struct
import zlib
from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np

from ..functions.binary import offset_varint
from ..functions.diff import apply_copy_delta
from . import formats as X

#: Objects of a pack that one task reads.
RANGE = 4096
#: Bytes of bodies that a task keeps as possible delta bases.
CACHE_BYTES = 64 << 20


def _mapped(path: str):
    with open(path, "rb") as f:
        return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) if os.path.getsize(path) else b""


class PackIndex:
    """An index of version 1 or 2: ids in order behind a fan-out of their first bytes."""

    def __init__(self, path: str, size: int = 20):
        self.data, self.size = _mapped(path), size
        self.two = self.data[:4] == b"\xfftOc"
        self.fan = 8 if self.two else 0
        self.ids = self.fan + 1024
        self.count = int.from_bytes(self.data[self.ids - 4 : self.ids], "big")
        self.step, self.skip = (size, 0) if self.two else (size + 4, 4)

    def id_at(self, i: int) -> bytes:
        at = self.ids + self.step * i + self.skip
        return self.data[at : at + self.size]

    def offset_at(self, i: int) -> int:
        if not self.two:
            at = self.ids + self.step * i
            return int.from_bytes(self.data[at : at + 4], "big")
        at = self.ids + self.count * (self.size + 4) + 4 * i
        off = int.from_bytes(self.data[at : at + 4], "big")
        if off & 0x80000000:
            at = self.ids + self.count * (self.size + 8) + 8 * (off & 0x7FFFFFFF)
            off = int.from_bytes(self.data[at : at + 8], "big")
        return off

    def span(self, head: bytes) -> tuple[int, int]:
        """Positions of the ids that begin with the given bytes, by the fan-out and bisection."""
        first = head[0]
        low = int.from_bytes(self.data[self.fan + 4 * first - 4 : self.fan + 4 * first], "big") if first else 0
        high = int.from_bytes(self.data[self.fan + 4 * first : self.fan + 4 * first + 4], "big")

        def bisect(target: bytes, low: int, high: int) -> int:
            while low < high:
                mid = (low + high) // 2
                low, high = (mid + 1, high) if self.id_at(mid) < target else (low, mid)
            return low

        return bisect(head, low, high), bisect(head + b"\xff" * (self.size - len(head) + 1), low, high)

    def find(self, id_: bytes) -> int | None:
        """Offset of an object."""
        a, b = self.span(id_)
        return self.offset_at(a) if a < b and self.id_at(a) == id_ else None

    def every_id(self) -> np.ndarray:
        """Ids in order, as fixed strings of bytes."""
        if self.two:
            return np.frombuffer(self.data, f"S{self.size}", self.count, self.ids)
        rows = np.frombuffer(self.data, np.uint8, self.count * self.step, self.ids).reshape(-1, self.step)
        return np.ascontiguousarray(rows[:, self.skip :]).view(f"S{self.size}").ravel()

    def holds(self, ids: np.ndarray) -> np.ndarray:
        """Which of many ids, as fixed strings of bytes, the index has."""
        own = self.every_id()
        if not len(own):
            return np.zeros(len(ids), bool)
        return own[np.minimum(np.searchsorted(own, ids), len(own) - 1)] == ids

    def offsets(self) -> np.ndarray:
        """Offsets in the order of the ids."""
        if not self.two:
            rows = np.frombuffer(self.data, np.uint8, self.count * self.step, self.ids).reshape(-1, self.step)
            return np.ascontiguousarray(rows[:, :4]).view(">u4").ravel().astype(np.int64)
        out = np.frombuffer(self.data, ">u4", self.count, self.ids + self.count * (self.size + 4)).astype(np.int64)
        large = np.flatnonzero(out & 0x80000000)
        if len(large):
            place = self.ids + self.count * (self.size + 8)
            far = np.frombuffer(self.data, ">u8", int((out[large] & 0x7FFFFFFF).max()) + 1, place)
            out[large] = far[out[large] & 0x7FFFFFFF].astype(np.int64)
        return out

    def checksums(self) -> np.ndarray | None:
        """Checksums of the entries in the order of the ids; an index of version 1 has none."""
        return np.frombuffer(self.data, ">u4", self.count, self.ids + self.count * self.size).astype(np.int64) if self.two else None

    def by_offset(self) -> np.ndarray:
        """Positions in the id order, by rising offset."""
        return np.argsort(self.offsets(), kind="stable")


class Pack:
    """Objects of one pack by offset; ``outside(id)`` finds (type, body) of bases that lie elsewhere."""

    def __init__(self, path: str, algorithm: str = "sha1", outside: Callable[[bytes], tuple[str, bytes] | None] | None = None):
        self.data, self.size = _mapped(path), X.id_bytes(algorithm)
        if self.data[:4] != b"PACK" or int.from_bytes(self.data[4:8], "big") not in (2, 3):
            raise ValueError("not a pack")
        index = path.removesuffix(".pack") + ".idx"
        self.index = PackIndex(index, self.size) if os.path.exists(index) else None
        self.outside = outside
        self.cache: OrderedDict[int, tuple[str, bytes]] = OrderedDict()
        self.held = 0

    def frame(self, at: int) -> tuple[int, int, int | bytes | None, int]:
        """(kind number, length, offset or id of the base, place of the deflated data)."""
        start, first = at, self.data[at]
        kind, length, shift = first >> 4 & 7, first & 15, 4
        while self.data[at] & 128:
            at += 1
            length |= (self.data[at] & 127) << shift
            shift += 7
        at += 1
        if kind == X.OFFSET_DELTA:
            head = self.data[at : at + 10]
            back, used = offset_varint(head, 0)
            return kind, length, start - back, at + used
        if kind == X.ID_DELTA:
            return kind, length, bytes(self.data[at : at + self.size]), at + self.size
        return kind, length, None, at

    def inflate(self, at: int, length: int) -> bytes:
        z, out = zlib.decompressobj(), []
        while not z.eof:
            part = self.data[at : at + max(4096, min(length + 64, 1 << 20))]
            if not part:
                raise ValueError("a pack entry that does not end")
            out.append(z.decompress(part))
            at += len(part)
        body = b"".join(out)
        if len(body) != length:
            raise ValueError("a pack entry of another size")
        return body

    def type_of(self, at: int) -> str:
        """Type of an object without its body: that of the base its deltas begin with."""
        while True:
            kind, _, base, _ = self.frame(at)
            if kind in X.PACK_TYPES:
                return X.PACK_TYPES[kind]
            found = base if isinstance(base, int) else self.index.find(base) if self.index else None
            if found is None:
                return self._elsewhere(base)[0]
            at = found

    def _elsewhere(self, id_: bytes) -> tuple[str, bytes]:
        got = self.outside(id_) if self.outside else None
        if got is None:
            raise ValueError(f"the delta base {id_.hex()} is missing")
        return got

    def object_at(self, at: int) -> tuple[str, bytes, int]:
        """(type, body, number of deltas applied)."""
        chain: list[tuple[int, bytes]] = []
        while True:
            if at in self.cache:
                self.cache.move_to_end(at)
                kind, body = self.cache[at]
                break
            number, length, base, place = self.frame(at)
            data = self.inflate(place, length)
            if number in X.PACK_TYPES:
                kind, body = X.PACK_TYPES[number], data
                self._keep(at, kind, body)
                break
            chain.append((at, data))
            found = base if isinstance(base, int) else self.index.find(base) if self.index else None
            if found is None:
                kind, body = self._elsewhere(base)
                break
            at = found
        for place, delta in reversed(chain):
            body = apply_copy_delta(body, delta)
            self._keep(place, kind, body)
        return kind, body, len(chain)

    def _keep(self, at: int, kind: str, body: bytes) -> None:
        self.cache[at] = kind, body
        self.held += len(body)
        while self.held > CACHE_BYTES and len(self.cache) > 1:
            _, (_, old) = self.cache.popitem(last=False)
            self.held -= len(old)

    def objects(self, first: int = 0, count: int | None = None, wanted: Callable[[bytes, int], bool] | None = None) -> Iterator[tuple[str, str, bytes]]:
        """(id, type, body) of a range of the offset order; ``wanted(id, position in the offset order)`` leaves others out."""
        order = self.index.by_offset()
        for place, i in enumerate(order[first : None if count is None else first + count].tolist(), first):
            id_ = self.index.id_at(i)
            if wanted is None or wanted(id_, place):
                kind, body, _ = self.object_at(self.index.offset_at(i))
                yield id_.hex(), kind, body


class Store:
    """All places of a repository's objects, in the order in which they are asked: loose objects, packs, then those of alternates."""

    def __init__(self, root: str, algorithm: str = "sha1"):
        self.algorithm, self.size = algorithm, X.id_bytes(algorithm)
        self.folders = object_folders(root)
        self.packs = [p for f in self.folders for p in pack_files(f)]
        self._open: dict[str, Pack] = {}

    def pack(self, path: str) -> Pack:
        if path not in self._open:
            self._open[path] = Pack(path, self.algorithm, lambda id_: self.read(id_, but=path))
        return self._open[path]

    def loose_path(self, folder: str, id_: bytes) -> str:
        name = id_.hex()
        return os.path.join(folder, name[:2], name[2:])

    def sources(self) -> Iterator[tuple[str, str]]:
        """('loose', folder) and ('pack', file), in order."""
        for f in self.folders:
            yield "loose", f
            yield from (("pack", p) for p in pack_files(f))

    def earlier(self, source: str) -> list[tuple[str, str]]:
        """The sources before one, which are asked first."""
        every = list(self.sources())
        return every[: [s for _, s in every].index(source)]

    def has(self, where: tuple[str, str], id_: bytes) -> bool:
        kind, source = where
        if kind == "loose":
            return os.path.exists(self.loose_path(source, id_))
        pack = self.pack(source)
        return pack.index is not None and pack.index.find(id_) is not None

    def first_here(self, where: list[tuple[str, str]], ids: np.ndarray) -> np.ndarray:
        """Which of many ids, as fixed strings of bytes, none of the sources has."""
        out = np.ones(len(ids), bool)
        for kind, source in where:
            if kind == "pack":
                index = self.pack(source).index
                if index is not None:
                    out &= ~index.holds(ids)
        open_ = [w for w in where if w[0] == "loose"]
        for i in np.flatnonzero(out) if open_ else ():
            id_ = ids[i].ljust(self.size, b"\0")  # such strings lose zeros at their end
            out[i] = not any(self.has(w, id_) for w in open_)
        return out

    def read(self, id_: bytes, but: str | None = None) -> tuple[str, bytes] | None:
        """(type, body) of an object: a file's name or an index's fan-out leads to it."""
        for kind, source in self.sources():
            if source == but:
                continue
            if kind == "loose":
                path = self.loose_path(source, id_)
                if os.path.exists(path):
                    with open(path, "rb") as f:
                        found, _, body = X.loose_object(f.read())
                    return found, body
            else:
                pack = self.pack(source)
                at = pack.index.find(id_) if pack.index else None
                if at is not None:
                    return pack.object_at(at)[:2]
        return None


def object_folders(root: str) -> list[str]:
    """The object folder of a repository and those of its alternates, each once."""
    out, open_ = [], [os.path.join(root, "objects")]
    while open_:
        own = open_.pop(0)
        if own in out or not os.path.isdir(own):
            continue
        out.append(own)
        more = os.path.join(own, "info", "alternates")
        if os.path.exists(more):
            with open(more) as f:
                open_ += [os.path.normpath(os.path.join(own, x.strip())) for x in f if x.strip() and x[0] != "#"]
    return out


def pack_files(folder: str) -> list[str]:
    packs = os.path.join(folder, "pack")
    return [os.path.join(packs, n) for n in sorted(os.listdir(packs)) if n.endswith(".pack")] if os.path.isdir(packs) else []


def bitmap_positions(path: str, kind: str, size: int = 20) -> set[int] | None:
    """Places in the offset order of a pack's objects of one type, by its bitmap file; None without one."""
    bitmap = path.removesuffix(".pack") + ".bitmap"
    if not os.path.exists(bitmap):
        return None
    with open(bitmap, "rb") as f:
        return set(X.pack_bitmap_types(f.read(), size)[kind])


# ---- writers -----------------------------------------------------------------------


def chunk_file(magic: bytes, head: bytes, chunks: list[tuple[bytes, bytes]], algorithm: str = "sha1") -> bytes:
    """A file of named chunks behind a table of their places."""
    import hashlib

    at, toc = len(magic) + len(head) + 12 * (len(chunks) + 1), b""
    for name, data in chunks:
        toc += name + struct.pack(">Q", at)
        at += len(data)
    out = magic + head + toc + b"\0\0\0\0" + struct.pack(">Q", at) + b"".join(c for _, c in chunks)
    return out + hashlib.new(algorithm, out).digest()


def fan_out(ids: list[str]) -> bytes:
    counts = np.bincount([int(x[:2], 16) for x in ids], minlength=256) if ids else np.zeros(256, np.int64)
    return struct.pack(">256I", *np.cumsum(counts).tolist())


def commit_graph_bytes(commits: list[dict], algorithm: str = "sha1") -> bytes:
    """(id, tree_id, parent_ids, generation, commit_time, corrected_time) rows as a commit graph."""
    none, extra = 0x70000000, 0x80000000
    rows = sorted(commits, key=lambda r: r["id"])
    place = {r["id"]: i for i, r in enumerate(rows)}
    data, edges, shifts = b"", [], []
    for r in rows:
        parents = [place[p] for p in r["parent_ids"]]
        second = none if len(parents) < 2 else parents[1] if len(parents) == 2 else extra | len(edges)
        if len(parents) > 2:
            edges += [*parents[1:-1], extra | parents[-1]]
        time = r["commit_time"]
        data += bytes.fromhex(r["tree_id"]) + struct.pack(">IIII", parents[0] if parents else none, second, r["generation"] << 2 | time >> 32 & 3, time & 0xFFFFFFFF)
        shifts.append(r["corrected_time"] - time)
    ids = [r["id"] for r in rows]
    chunks = [(b"OIDF", fan_out(ids)), (b"OIDL", b"".join(map(bytes.fromhex, ids))), (b"CDAT", data), (b"GDA2", struct.pack(f">{len(rows)}I", *shifts))]
    chunks += [(b"EDGE", struct.pack(f">{len(edges)}I", *edges))] if edges else []
    return chunk_file(b"CGPH", bytes([1, 1 if algorithm == "sha1" else 2, len(chunks), 0]), chunks, algorithm)


def multi_pack_bytes(packs: dict[str, PackIndex], algorithm: str = "sha1") -> bytes:
    """One index over several packs; an object of more than one is taken from the first by name."""
    names = sorted(packs)
    every = np.concatenate([packs[n].every_id() for n in names]) if names else np.zeros(0, f"S{X.id_bytes(algorithm)}")
    order = np.argsort(every, kind="stable")  # of equal ids the first by name comes first
    every = every[order]
    first = np.r_[True, every[1:] != every[:-1]] if len(every) else np.zeros(0, bool)
    ids, order = every[first], order[first]
    places = np.zeros((len(ids), 2), ">u4")
    if len(ids):
        places[:, 0] = np.repeat(np.arange(len(names)), [packs[n].count for n in names])[order]
        places[:, 1] = np.concatenate([packs[n].offsets() for n in names])[order]
    heads = np.frombuffer(ids.tobytes(), np.uint8).reshape(len(ids), -1)[:, 0] if len(ids) else np.zeros(0, np.uint8)
    fan = np.cumsum(np.bincount(heads, minlength=256)).astype(">u4").tobytes()
    text = b"".join(n.encode() + b"\0" for n in names)
    text += b"\0" * (-len(text) % 4)
    chunks = [(b"PNAM", text), (b"OIDF", fan), (b"OIDL", ids.tobytes()), (b"OOFF", places.tobytes())]
    return chunk_file(b"MIDX", bytes([1, 1 if algorithm == "sha1" else 2, len(chunks), 0]) + struct.pack(">I", len(names)), chunks, algorithm)


def bitmap_bytes(types: list[str], checksum: bytes) -> bytes:
    """The type bitmaps of a pack whose objects, in offset order, have the given types."""
    sets = {k: {i for i, t in enumerate(types) if t == k} for k in ("commit", "tree", "blob", "tag")}
    return b"BITM" + struct.pack(">HHI", 1, 1, 0) + checksum + b"".join(X.ewah_encode(sets[k], len(types)) for k in sets)


def copy_delta(base: bytes, target: bytes) -> bytes:
    """A delta that copies what both begin and end with, and inserts the rest."""
    most = min(len(base), len(target))
    differ = int.from_bytes(base[:most]) ^ int.from_bytes(target[:most])
    head = most - (differ.bit_length() + 7) // 8
    rest = most - head
    differ = int.from_bytes(base[len(base) - rest :], "little") ^ int.from_bytes(target[len(target) - rest :], "little")
    tail = rest - (differ.bit_length() + 7) // 8
    out = bytearray(_size(len(base)) + _size(len(target)) + _copies(0, head))
    middle = target[head : len(target) - tail]
    for i in range(0, len(middle), 127):
        part = middle[i : i + 127]
        out.append(len(part))
        out += part
    return bytes(out + _copies(len(base) - tail, tail))


def _size(n: int) -> bytes:
    out = []
    while True:
        out.append(n & 127 | (128 if n > 127 else 0))
        n >>= 7
        if not n:
            return bytes(out)


def _copies(at: int, n: int) -> bytes:
    out = b""
    while n:
        part = min(n, 0xFFFF)
        places, sizes = at.to_bytes(4, "little"), part.to_bytes(3, "little")
        flags = 128 | sum(1 << i for i, b in enumerate(places) if b) | sum(16 << i for i, b in enumerate(sizes) if b)
        out += bytes([flags, *[b for b in places if b], *[b for b in sizes if b]])
        at, n = at + part, n - part
    return out


def write_pack(folder: str, objects: list[tuple[str, bytes]], algorithm: str = "sha1", deltas: bool = True) -> str:
    """Write a pack with its index, reverse index and type bitmaps; returns the pack's path.

    With ``deltas`` an object is a delta to the one of its type before it where that is shorter.
    """
    import hashlib

    kinds = {v: k for k, v in X.PACK_TYPES.items()}
    out = bytearray(b"PACK" + struct.pack(">II", 2, len(objects)))
    rows, last = [], {}
    for kind, body in objects:
        at, number, data, base = len(out), kinds[kind], body, b""
        if deltas and kind in last:
            place, other, depth = last[kind]
            delta = copy_delta(other, body)
            if len(delta) < len(body) // 2 and depth < 50:
                number, data, base = X.OFFSET_DELTA, delta, X._offset_varint_bytes(at - place)
        size, head = len(data) >> 4, [number << 4 | len(data) & 15]
        while size:
            head[-1] |= 128
            head.append(size & 127)
            size >>= 7
        out += bytes(head) + base + zlib.compress(data)
        last[kind] = at, body, last[kind][2] + 1 if base else 0
        rows.append({"id": X.hash_object(kind, body, algorithm), "offset": at, "crc32": zlib.crc32(out[at:]), "type": kind})
    checksum = hashlib.new(algorithm, bytes(out)).digest()
    path = os.path.join(folder, f"pack-{checksum.hex()}")
    for end, data in ((".pack", bytes(out) + checksum), (".idx", X.write_index(rows, checksum, algorithm)), (".rev", X.reverse_index(rows, checksum, algorithm)), (".bitmap", bitmap_bytes([r["type"] for r in rows], checksum))):
        with open(path + end, "wb") as f:
            f.write(data)
    return path + ".pack"
