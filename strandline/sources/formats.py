"""Decoders of repository file formats: bytes in, rows out.

Formats as published in the version-control system's technical documentation.
Each decoder takes one file's bytes, so a reader's task holds one file at a time.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np

from ..functions.binary import offset_varint, size_varint
from ..functions.diff import apply_copy_delta

#: Object type numbers of pack entries.
PACK_TYPES = {1: "commit", 2: "tree", 3: "blob", 4: "tag"}
OFFSET_DELTA, ID_DELTA = 6, 7


def id_bytes(algorithm: str) -> int:
    return 32 if algorithm == "sha256" else 20


def hash_object(kind: str, body: bytes, algorithm: str = "sha1") -> str:
    return hashlib.new(algorithm, f"{kind} {len(body)}\0".encode() + body).hexdigest()


# ---- objects ----


def loose_object(data: bytes, head_only: bool = False) -> tuple[str, int, bytes | None]:
    """(type, size, body); with ``head_only`` just the first bytes are inflated."""
    z = zlib.decompressobj()
    start = z.decompress(data, 64)
    head, nul, rest = start.partition(b"\0")
    if not nul:
        raise ValueError("not a loose object")
    kind, size = head.decode("ascii").split(" ")
    if head_only:
        return kind, int(size), None
    body = rest + z.decompress(z.unconsumed_tail) + z.flush()
    if len(body) != int(size):
        raise ValueError("a loose object of another size")
    return kind, int(size), body


def commit_row(body: bytes) -> dict:
    """Tree, parents, people, message and signed or merged parts of a commit."""
    head, _, message = body.partition(b"\n\n")
    fields: list[tuple[str, str]] = []
    for line in head.decode("utf-8", "replace").split("\n"):
        if line.startswith(" ") and fields:
            fields[-1] = (fields[-1][0], f"{fields[-1][1]}\n{line[1:]}")
        else:
            name, _, value = line.partition(" ")
            fields.append((name, value))
    one = lambda name: next((v for k, v in fields if k == name), None)
    parents = [v for k, v in fields if k == "parent"]
    text = message.decode("utf-8", "replace")
    merged = [dict(x.split(" ", 1) for x in v.split("\n\n")[0].split("\n") if " " in x) for k, v in fields if k == "mergetag"]
    return {
        "tree_id": one("tree"), "parent_ids": parents, "parent_count": len(parents), "author": signature(one("author")), "committer": signature(one("committer")),
        "message": text, "summary": summary(text), "is_signed": any(k.startswith("gpgsig") for k, _ in fields), "merge_tags": [next((m["tag"] for m in merged if m.get("object") == p), None) for p in parents],
    }


def signed_portion(body: bytes) -> bytes:
    """A commit without its signature headers, which is what was signed."""
    head, blank, message = body.partition(b"\n\n")
    out, inside = [], False
    for line in head.split(b"\n"):
        inside = line.startswith(b"gpgsig") or inside and line.startswith(b" ")
        if not inside:
            out.append(line)
    return b"\n".join(out) + blank + message


def tag_row(body: bytes) -> dict:
    head, _, message = body.partition(b"\n\n")
    fields = dict(x.split(" ", 1) for x in head.decode("utf-8", "replace").split("\n") if " " in x)
    text = message.decode("utf-8", "replace")
    at = re.search(r"^-----BEGIN (?:PGP|SSH) SIGNATURE-----", text, re.M)
    return {
        "object_id": fields.get("object"), "object_type": fields.get("type"), "name": fields.get("tag"), "tagger": signature(fields.get("tagger")),
        "message": text[: at.start()] if at else text, "summary": summary(text), "is_signed": bool(at),
    }


def tree_rows(body: bytes, size: int = 20) -> Iterator[tuple[int, int, str, str]]:
    """(ordinal, mode, name, object id)."""
    at = n = 0
    while at < len(body):
        space, nul = body.index(b" ", at), body.index(b"\0", at)
        yield n, int(body[at:space], 8), body[space + 1 : nul].decode("utf-8", "replace"), body[nul + 1 : nul + 1 + size].hex()
        at, n = nul + 1 + size, n + 1


_SIGNATURE = re.compile(r"(.*?) ?<([^>]*)> ?(-?\d+) ([+-])(\d\d)(\d\d)$")


def signature(text: str | None) -> dict | None:
    m = _SIGNATURE.match(text or "")
    if not m:
        return None
    minutes = int(m[5]) * 60 + int(m[6])
    return {"name": m[1], "email": m[2], "epoch": int(m[3]), "tz_offset_min": -minutes if m[4] == "-" else minutes}


def summary(message: str) -> str:
    out = []
    for line in message.replace("\r", "").split("\n")[:4]:
        if not line.strip():
            break
        out.append(line)
    return "\n".join(out)


# ---- packs ----


def pack_entries(data: bytes, size: int = 20) -> Iterator[dict]:
    """Frames of a pack in file order: offset, kind number, base, inflated data and the raw frame's CRC-32."""
    if data[:4] != b"PACK" or int.from_bytes(data[4:8], "big") not in (2, 3):
        raise ValueError("not a pack")
    at = 12
    for _ in range(int.from_bytes(data[8:12], "big")):
        start = at
        kind = data[at] >> 4 & 7
        length, shift = data[at] & 15, 4
        while data[at] & 128:
            at += 1
            length |= (data[at] & 127) << shift
            shift += 7
        at += 1
        base = None
        if kind == OFFSET_DELTA:
            back, at = offset_varint(data, at)
            base = start - back
        elif kind == ID_DELTA:
            base, at = data[at : at + size].hex(), at + size
        z, pieces = zlib.decompressobj(), []
        while not z.eof:
            part = data[at : at + 4096]
            if not part:
                raise ValueError("a pack entry that does not end")
            pieces.append(z.decompress(part))
            at += len(part) - len(z.unused_data)
        body = b"".join(pieces)
        if len(body) != length:
            raise ValueError("a pack entry of another size")
        yield {"offset": start, "kind": kind, "base": base, "data": body, "crc32": zlib.crc32(data[start:at])}


def pack_objects(data: bytes, algorithm: str = "sha1", outside=None) -> list[dict]:
    """id, type, body, offset, crc32 and delta depth of every object; ``outside(id)`` finds bases that are not in the pack."""
    size = id_bytes(algorithm)
    entries = list(pack_entries(data, size))
    done: dict[int, dict] = {}
    by_id: dict[str, dict] = {}
    waiting = entries
    while waiting:
        later = []
        for e in waiting:
            if e["kind"] in PACK_TYPES:
                kind, body, depth = PACK_TYPES[e["kind"]], e["data"], 0
            else:
                base = done.get(e["base"]) if e["kind"] == OFFSET_DELTA else by_id.get(e["base"]) or (outside(e["base"]) if outside else None)
                if base is None:
                    later.append(e)
                    continue
                kind, body, depth = base["type"], apply_copy_delta(base["body"], e["data"]), base.get("depth", 0) + 1
            row = {"id": hash_object(kind, body, algorithm), "type": kind, "body": body, "offset": e["offset"], "crc32": e["crc32"], "depth": depth}
            done[e["offset"]] = by_id[row["id"]] = row
        if len(later) == len(waiting):
            raise ValueError("delta bases are missing")
        waiting = later
    return [done[e["offset"]] for e in entries]


def write_index(objects: list[dict], pack_checksum: bytes, algorithm: str = "sha1") -> bytes:
    """Version 2 index of a pack's objects."""
    rows = sorted(objects, key=lambda r: r["id"])
    counts = [0] * 256
    for r in rows:
        counts[int(r["id"][:2], 16)] += 1
    fan, total = b"", 0
    for c in counts:
        total += c
        fan += struct.pack(">I", total)
    large, short = [], []
    for r in rows:
        short.append(0x80000000 | len(large) if r["offset"] >= 1 << 31 else r["offset"])
        if r["offset"] >= 1 << 31:
            large.append(r["offset"])
    out = b"\xfftOc" + struct.pack(">I", 2) + fan + b"".join(bytes.fromhex(r["id"]) for r in rows)
    out += b"".join(struct.pack(">I", r["crc32"]) for r in rows) + b"".join(struct.pack(">I", x) for x in short) + b"".join(struct.pack(">Q", x) for x in large) + pack_checksum
    return out + hashlib.new(algorithm, out).digest()


def index_rows(data: bytes, size: int = 20) -> Iterator[tuple[str, int, int | None]]:
    """(id, offset, crc32) of a pack index of version 1 or 2, by id; version 1 has no checksums."""
    if data[:4] != b"\xfftOc":
        n = int.from_bytes(data[1020:1024], "big")
        for i in range(n):
            at = 1024 + i * (4 + size)
            yield data[at + 4 : at + 4 + size].hex(), int.from_bytes(data[at : at + 4], "big"), None
        return
    n = int.from_bytes(data[8 + 1020 : 8 + 1024], "big")
    ids = 8 + 1024
    crcs, offsets = ids + n * size, ids + n * (size + 4)
    large = offsets + 4 * n
    for i in range(n):
        off = int.from_bytes(data[offsets + 4 * i : offsets + 4 * i + 4], "big")
        if off & 0x80000000:
            at = large + 8 * (off & 0x7FFFFFFF)
            off = int.from_bytes(data[at : at + 8], "big")
        yield data[ids + size * i : ids + size * (i + 1)].hex(), off, int.from_bytes(data[crcs + 4 * i : crcs + 4 * i + 4], "big")


def reverse_index(objects: list[dict], pack_checksum: bytes, algorithm: str = "sha1") -> bytes:
    """Pack order as positions in the id order."""
    place = {r["id"]: i for i, r in enumerate(sorted(objects, key=lambda r: r["id"]))}
    out = b"RIDX" + struct.pack(">II", 1, 1 if algorithm == "sha1" else 2)
    out += b"".join(struct.pack(">I", place[r["id"]]) for r in sorted(objects, key=lambda r: r["offset"])) + pack_checksum
    return out + hashlib.new(algorithm, out).digest()


def reverse_positions(data: bytes, count: int) -> list[int]:
    """Positions in the id order, by rising offset, of a reverse index."""
    if data[:4] != b"RIDX":
        raise ValueError("not a reverse index")
    return list(struct.unpack_from(f">{count}I", data, 12))


def chunks_of(data: bytes, magic: bytes, head: int) -> dict[bytes, bytes]:
    """Chunks of a chunk file by name; the table of contents starts at ``head``."""
    if data[:4] != magic:
        raise ValueError(f"not a {magic.decode()} file")
    n = data[6]
    toc = [(data[head + 12 * i : head + 12 * i + 4], int.from_bytes(data[head + 12 * i + 4 : head + 12 * i + 12], "big")) for i in range(n + 1)]
    return {name: data[at:to] for (name, at), (_, to) in zip(toc, toc[1:], strict=False)}


def multi_pack_rows(data: bytes) -> Iterator[tuple[str, str, int]]:
    """(id, pack name, offset) of a multi-pack index."""
    size = 20 if data[5] == 1 else 32
    c = chunks_of(data, b"MIDX", 12)
    names = [x.decode() for x in c[b"PNAM"].split(b"\0") if x]
    n = int.from_bytes(c[b"OIDF"][1020:1024], "big")
    for i in range(n):
        pack, off = struct.unpack_from(">II", c[b"OOFF"], 8 * i)
        if off & 0x80000000 and b"LOFF" in c:
            (off,) = struct.unpack_from(">Q", c[b"LOFF"], 8 * (off & 0x7FFFFFFF))
        yield c[b"OIDL"][size * i : size * (i + 1)].hex(), names[pack], off


def commit_graph_rows(data: bytes, below: list[str] = ()) -> Iterator[dict]:
    """id, parents, generation and times of a commit-graph layer; ``below`` are the ids of the layers under it."""
    size = 20 if data[5] == 1 else 32
    c = chunks_of(data, b"CGPH", 8)
    n = int.from_bytes(c[b"OIDF"][1020:1024], "big")
    ids = [*below, *(c[b"OIDL"][size * i : size * (i + 1)].hex() for i in range(n))]
    edges = [int.from_bytes(c[b"EDGE"][i : i + 4], "big") for i in range(0, len(c.get(b"EDGE", b"")), 4)]
    for i in range(n):
        at = (size + 16) * i
        first, second, high, low = struct.unpack_from(">IIII", c[b"CDAT"], at + size)
        parents = [] if first == 0x70000000 else [first]
        if second & 0x80000000:
            k = second & 0x7FFFFFFF
            while True:
                parents.append(edges[k] & 0x7FFFFFFF)
                if edges[k] & 0x80000000:
                    break
                k += 1
        elif second != 0x70000000:
            parents.append(second)
        time = (high & 3) << 32 | low
        corrected = None
        if b"GDA2" in c:
            (shift,) = struct.unpack_from(">I", c[b"GDA2"], 4 * i)
            if shift & 0x80000000 and b"GDO2" in c:
                (shift,) = struct.unpack_from(">Q", c[b"GDO2"], 8 * (shift & 0x7FFFFFFF))
            corrected = time + shift
        yield {"id": ids[len(below) + i], "tree_id": c[b"CDAT"][at : at + size].hex(), "parent_ids": [ids[p] for p in parents], "generation": high >> 2, "commit_time": time, "corrected_time": corrected}


def ewah_bits(data: bytes, at: int = 0) -> tuple[list[int], int, int]:
    """(set positions, number of bits, next place) of a run-length compressed bitmap."""
    bits, words = struct.unpack_from(">II", data, at)
    body = struct.unpack_from(f">{words}Q", data, at + 8)
    out, place, i = [], 0, 0
    while i < words:
        marker = body[i]
        run, literal = marker >> 1 & 0xFFFFFFFF, marker >> 33
        if marker & 1:
            out.extend(range(place, place + 64 * run))
        place += 64 * run
        set_ = np.unpackbits(np.array(body[i + 1 : i + 1 + literal], "<u8").view(np.uint8), bitorder="little")
        out.extend((place + np.flatnonzero(set_)).tolist())
        place += 64 * literal
        i += 1 + literal
    return [b for b in out if b < bits], bits, at + 12 + 8 * words


def ewah_encode(positions: set[int], bits: int) -> bytes:
    """The same bitmap as literal words after one marker."""
    set_ = np.zeros(-(-bits // 64) * 64, np.uint8)
    set_[[p for p in positions if 0 <= p < len(set_)]] = 1
    words = np.packbits(set_, bitorder="little").view("<u8")
    body = struct.pack(">Q", len(words) << 33) + words.astype(">u8").tobytes()
    return struct.pack(">II", bits, 1 + len(words)) + body + struct.pack(">I", 0)


# ---- references, logs, configuration ----


def packed_ref_rows(text: str) -> Iterator[tuple[str, str, str | None]]:
    """(name, id, peeled id)."""
    last = None
    for line in text.splitlines():
        if line.startswith("^") and last:
            yield last[0], last[1], line[1:].strip()
            last = None
            continue
        if last:
            yield *last, None
            last = None
        if line and not line.startswith("#"):
            id_, _, name = line.partition(" ")
            last = (name.strip(), id_)
    if last:
        yield *last, None


def reflog_rows(text: str) -> Iterator[tuple[int, str, str, dict | None, str]]:
    """(sequence number, old id, new id, signature, reason)."""
    for n, line in enumerate(x for x in text.split("\n") if x):
        head, _, reason = line.partition("\t")
        size = head.index(" ")
        yield n, head[:size], head[size + 1 : 2 * size + 1], signature(head[2 * size + 2 :]), reason


def config_rows(text: str) -> Iterator[tuple[str, str | None, str, str | None]]:
    """(group, subgroup, key, value); a key without ``=`` has no value."""
    group = subgroup = None
    for line in re.sub(r"\\\r?\n", "", text).splitlines():
        line = line.strip()
        m = re.match(r'\[\s*([A-Za-z0-9.-]+)(?:\s+"((?:[^"\\]|\\.)*)")?\s*\]\s*(.*)$', line)
        if m:
            group, subgroup, line = m[1].lower(), None if m[2] is None else re.sub(r"\\(.)", r"\1", m[2]), m[3]
        if not line or line[0] in "#;" or group is None:
            continue
        key, equals, value = line.partition("=")
        yield group, subgroup, key.strip().lower(), _config_value(value) if equals else None


_ESCAPES = {"n": "\n", "t": "\t", "b": "\b"}


def _config_value(raw: str) -> str:
    out, quoted, kept = [], False, 0
    it = iter(raw.strip())
    for c in it:
        if c == "\\":
            c = next(it, "")
            out.append(_ESCAPES.get(c, c))
            kept = len(out)
        elif c == '"':
            quoted = not quoted
            kept = len(out)
        elif c in "#;" and not quoted:
            break
        else:
            out.append(c)
            if quoted or not c.isspace():
                kept = len(out)
    return "".join(out[:kept])


def directory_rows(data: bytes, size: int = 20) -> Iterator[dict]:
    """Entries of a directory index of version 2, 3 or 4."""
    return iter(_directory(data, size)[0])


def directory_extensions(data: bytes, size: int = 20) -> list[tuple[str, bytes]]:
    """(name, body) of the extensions behind the entries.  Where the index tells the end of its entries, they are not read."""
    at = _end_of_entries(data, size) or _directory(data, size)[1]
    out = []
    while at + 8 <= len(data) - size:
        n = int.from_bytes(data[at + 4 : at + 8], "big")
        out.append((data[at : at + 4].decode("latin-1"), data[at + 8 : at + 8 + n]))
        at += 8 + n
    return out


def _end_of_entries(data: bytes, size: int) -> int | None:
    """The place that the last extension, EOIE, gives: its offset and a hash over the extensions' names and sizes."""
    at = len(data) - size - 4 - size - 8
    if at < 12 or data[at : at + 4] != b"EOIE":
        return None
    end = int.from_bytes(data[at + 8 : at + 12], "big")
    seen, place = b"", end
    while place < at:
        seen += data[place : place + 8]
        place += 8 + int.from_bytes(data[place + 4 : place + 8], "big")
    told = data[at + 12 : at + 12 + size]
    return end if place == at and hashlib.new("sha1" if size == 20 else "sha256", seen).digest() == told else None


def split_link(body: bytes, size: int = 20) -> tuple[str, list[int], list[int]]:
    """A split index's link: id of the shared index, places of its entries that are deleted and that are replaced."""
    if len(body) == size:
        return body[:size].hex(), [], []
    deleted, _, at = ewah_bits(body, size)
    replaced, _, _ = ewah_bits(body, at)
    return body[:size].hex(), deleted, replaced


def _directory(data: bytes, size: int) -> tuple[list[dict], int]:
    if data[:4] != b"DIRC":
        raise ValueError("not a directory index")
    version, n = struct.unpack_from(">II", data, 4)
    at, name, out = 12, b"", []
    for _ in range(n):
        start = at
        cs, cn, ms, mn, dev, ino, mode, uid, gid, length = struct.unpack_from(">10I", data, at)
        id_ = data[at + 40 : at + 40 + size].hex()
        (flags,) = struct.unpack_from(">H", data, at + 40 + size)
        at += 42 + size
        more = 0
        if flags & 0x4000:
            (more,) = struct.unpack_from(">H", data, at)
            at += 2
        if version == 4:
            strip, at = offset_varint(data, at)
            end = data.index(b"\0", at)
            name = name[: len(name) - strip] + data[at:end]
            at = end + 1
        else:
            end = data.index(b"\0", at)
            name = data[at:end]
            at = start + (end - start) // 8 * 8 + 8
        out.append({
            "name": name.decode("utf-8", "replace"), "mode": mode, "id": id_, "flags": flags | more << 16, "stage": (flags & 0x3000) >> 12, "ctime_ns": cs * 10**9 + cn, "mtime_ns": ms * 10**9 + mn,
            "dev": dev, "inode": ino, "uid": uid, "gid": gid, "truncated_size": length,
        })
    return out, at


def directory_bytes(entries: Iterable[dict], version: int = 2, algorithm: str = "sha1", extensions: list[tuple[str, bytes]] = (), count: int | None = None) -> bytes:
    """A directory index of the given entries (name, mode, id, flags, sizes and times); extensions are followed by EOIE.

    Entries that are no list are taken one by one; ``count`` tells how many there are.
    """
    size = id_bytes(algorithm)
    out, last = bytearray(b"DIRC" + struct.pack(">II", version, len(entries) if count is None else count)), b""
    for e in entries:
        raw = e["name"].encode()
        head = struct.pack(">10I", *divmod(e.get("ctime_ns", 0), 10**9), *divmod(e.get("mtime_ns", 0), 10**9), e.get("dev", 0), e.get("inode", 0), e["mode"], e.get("uid", 0), e.get("gid", 0), e.get("truncated_size", 0))
        head += bytes.fromhex(e["id"]) + struct.pack(">H", e.get("stage", 0) << 12 | min(len(raw), 0xFFF))
        assert len(e["id"]) == 2 * size
        if version == 4:
            most = min(len(raw), len(last))
            differ = int.from_bytes(raw[:most]) ^ int.from_bytes(last[:most])
            same = most - (differ.bit_length() + 7) // 8
            out += head + _offset_varint_bytes(len(last) - same) + raw[same:] + b"\0"
            last = raw
        else:
            out += head + raw + b"\0" * (8 - (len(head) + len(raw)) % 8)
    end, seen = len(out), b""
    for mark, body in extensions:
        out += mark.encode() + struct.pack(">I", len(body)) + body
        seen += mark.encode() + struct.pack(">I", len(body))
    if extensions:
        out += b"EOIE" + struct.pack(">II", 4 + size, end) + hashlib.new(algorithm, seen).digest()
    return bytes(out) + hashlib.new(algorithm, out).digest()


def _offset_varint_bytes(value: int) -> bytes:
    out = [value & 127]
    value >>= 7
    while value:
        value -= 1
        out.append(128 | value & 127)
        value >>= 7
    return bytes(reversed(out))


def merge_split_index(base: list[dict], deleted: set[int], replaced: dict[int, dict], own: list[dict]) -> list[dict]:
    """Entries of a split index: the shared ones without the deleted, with the replaced overlaid, and its own."""
    kept = [{**e, **{k: v for k, v in replaced[i].items() if v not in (None, "")}} if i in replaced else e for i, e in enumerate(base) if i not in deleted]
    return sorted(kept + own, key=lambda e: (e["name"].encode(), e["stage"]))


def bundle_rows(data: bytes) -> dict:
    """Version, capabilities, prerequisites, references and the pack of a bundle."""
    first, _, rest = data.partition(b"\n")
    m = re.match(rb"# v([23]) git bundle$", first)
    if not m:
        raise ValueError("not a bundle")
    out = {"version": int(m[1]), "capabilities": [], "prerequisites": [], "references": []}
    while True:
        line, _, rest = rest.partition(b"\n")
        if not line:
            return out | {"pack": rest}
        text = line.decode("utf-8", "replace")
        if text[0] == "@":
            key, _, value = text[1:].partition("=")
            out["capabilities"].append((key, value))
        elif text[0] == "-":
            id_, _, comment = text[1:].partition(" ")
            out["prerequisites"].append((id_, comment or None))
        else:
            id_, _, name = text.partition(" ")
            out["references"].append((id_, name))


def packet_lines(data: bytes) -> Iterator[bytes | None]:
    """Payloads of length-framed lines; null is a flush or delimiter."""
    at = 0
    while at < len(data):
        n = int(data[at : at + 4], 16)
        yield data[at + 4 : at + n] if n >= 4 else None
        at += max(n, 4)


def hash_dump(data: bytes) -> dict[str, bytes]:
    """A ``K n / V n / END`` dump."""
    out, at = {}, 0
    while not data.startswith(b"END", at):
        parts = []
        for mark in b"KV":
            end = data.index(b"\n", at)
            if data[at] != mark:
                raise ValueError("not a hash dump")
            n = int(data[at + 2 : end])
            parts.append(data[end + 1 : end + 1 + n])
            at = end + 2 + n
        out[parts[0].decode()] = parts[1]
    return out


def header_rows(text: str) -> dict[str, str]:
    """``key: value`` lines up to the first blank one."""
    out = {}
    for line in text.splitlines():
        if not line:
            break
        key, _, value = line.partition(": ")
        out[key] = value
    return out


def revision_file_rows(data: bytes, base=None) -> Iterator[tuple[str, bytes]]:
    """(kind, text) of the representations of a revision file: PLAIN as they are, DELTA applied to ``base(revision, offset, length)`` or to nothing."""
    from ..functions.diff import apply_window_delta

    at = 0
    while True:
        m = re.compile(rb"^(PLAIN|DELTA(?: (\d+) (\d+) (\d+))?)\n", re.M).search(data, at)
        if not m:
            return
        end = data.index(b"ENDREP\n", m.end())
        raw = data[m.end() : end]
        if m[1] == b"PLAIN":
            yield "PLAIN", raw
        else:
            source = base(*(int(x) for x in m.groups()[1:])) if m[2] and base else b""
            yield "DELTA", apply_window_delta(source, raw)
        at = end + 7


def representation_at(read, revision: int, offset: int) -> bytes:
    """The text that begins at an offset of a revision's file (``read(revision)``), its deltas undone through the revisions they name."""
    from ..functions.diff import apply_window_delta

    deltas = []
    while True:
        data = read(revision)
        m = re.compile(rb"(PLAIN|DELTA(?: (\d+) (\d+) (\d+))?)\n").match(data, offset)
        if not m:
            raise ValueError("no representation begins there")
        raw = data[m.end() : data.index(b"ENDREP\n", m.end())]
        if m[1] == b"PLAIN" or not m[2]:
            text = raw if m[1] == b"PLAIN" else apply_window_delta(b"", raw)
            break
        deltas.append(raw)
        revision, offset = int(m[2]), int(m[3])
    for raw in reversed(deltas):
        text = apply_window_delta(text, raw)
    return text


def http_response(data: bytes) -> dict:
    """Status, headers (names in lower case) and body of a response; chunked and compressed bodies are undone."""
    from ..functions.binary import http_dechunk_bytes, inflate_any

    head, _, body = data.partition(b"\r\n\r\n")
    first, *rest = head.decode("latin-1").split("\r\n")
    headers: dict[str, str] = {}
    for line in rest:
        name, _, value = line.partition(":")
        headers[name.strip().lower()] = value.strip()
    if headers.get("transfer-encoding", "").lower() == "chunked":
        body = http_dechunk_bytes(body)
    coding = headers.get("content-encoding", "").lower()
    if coding in ("gzip", "deflate"):
        try:
            body = inflate_any(body, "gzip" if coding == "gzip" else "zlib")
        except zlib.error:
            body = inflate_any(body, "deflate")
    elif coding not in ("", "identity"):
        raise ValueError(f"content coding {coding} is not supported")
    return {"status": int(first.split(" ")[1]), "headers": headers, "body": body}


def pack_bitmap_types(data: bytes, size: int = 20) -> dict[str, list[int]]:
    """Pack positions of commits, trees, blobs and tags in a bitmap file."""
    if data[:4] != b"BITM":
        raise ValueError("not a bitmap file")
    at, out = 12 + size, {}
    for kind in ("commit", "tree", "blob", "tag"):
        out[kind], _, at = ewah_bits(data, at)
    return out


def included(rows: list[tuple[str, str | None, str, str | None]], git_dir: str, home: str) -> Iterator[str]:
    """Paths that a configuration includes, always or for this repository's folder."""
    import fnmatch
    import os

    for group, subgroup, key, value in rows:
        if key != "path" or not value:
            continue
        if group == "includeif":
            kind, _, pattern = (subgroup or "").partition(":")
            if kind not in ("gitdir", "gitdir/i"):
                continue
            fold = str.lower if kind.endswith("/i") else str
            pattern = pattern.replace("~/", home.rstrip("/") + "/", 1) if pattern.startswith("~/") else pattern
            pattern = pattern if pattern.startswith("/") else "**/" + pattern
            pattern = pattern + "**" if pattern.endswith("/") else pattern
            if not fnmatch.fnmatch(fold(git_dir.rstrip("/") + "/"), fold(pattern)) and not fnmatch.fnmatch(fold(git_dir), fold(pattern)):
                continue
        elif group != "include":
            continue
        yield os.path.expanduser(value) if value.startswith("~/") else value
