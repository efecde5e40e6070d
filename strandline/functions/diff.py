"""Sequence differences, similarity and binary deltas.

``changes`` compares two token sequences by the greedy O(ND) search of Myers
(1986) over a furthest-reaching frontier, then slides every changed run down
as far as equal tokens allow, which gives runs a canonical place.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binary import each, plain_varint, size_varint

CHUNK = "array<struct<changed:boolean,orig_start:int,orig_end:int,mod_start:int,mod_end:int>>"


def _kept_pairs(a: list, b: list) -> list[tuple[int, int]]:
    """Matched positions of a longest common subsequence."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    n, m = len(a) - head - tail, len(b) - head - tail
    frontier, trace = {1: 0}, []
    for d in range(n + m + 1):
        trace.append(frontier)
        reach = {}
        for k in range(-d, d + 1, 2):
            down = k == -d or (k != d and frontier.get(k - 1, -1) < frontier.get(k + 1, -1))
            x = frontier[k + 1] if down else frontier[k - 1] + 1
            while x < n and x - k < m and a[head + x] == b[head + x - k]:
                x += 1
            reach[k] = x
            if x >= n and x - k >= m:
                break
        frontier = reach
        if reach.get(n - m, -1) >= n:
            break
    pairs = []
    x, y = n, m
    for d in range(len(trace) - 1, -1, -1):
        before, k = trace[d], x - y
        down = k == -d or (k != d and before.get(k - 1, -1) < before.get(k + 1, -1))
        px = before[k + 1] if down else before[k - 1]
        py = px - (k + 1 if down else k - 1)
        start = (px, py + 1) if down else (px + 1, py)
        while x > max(start[0], 0) and y > max(start[1], 0) and (d == 0 or (x, y) != start):
            x, y = x - 1, y - 1
            pairs.append((head + x, head + y))
        if d == 0:
            break
        x, y = px, py
    pairs.reverse()
    return [(i, i) for i in range(head)] + pairs + [(len(a) - tail + i, len(b) - tail + i) for i in range(tail)]


def _latest(tokens: list, changed: list[bool]) -> list[bool]:
    """The same changes with each run of them at its latest place.

    A run may move by one where the token it leaves equals the one it takes.
    Runs are placed from the end on; one that reaches the next is one with it
    and may move further.
    """
    placed: list[tuple[int, int]] = []  # from the end of the sequence backwards
    end = len(tokens)
    while end:
        start = end
        while start and changed[start - 1]:
            start -= 1
        if start == end:
            end -= 1
            continue
        first, last = start, end
        while True:
            room = placed[-1][0] if placed else len(tokens)
            while last < room and tokens[first] == tokens[last]:
                first, last = first + 1, last + 1
            if not placed or last < room:
                break
            last = placed.pop()[1]
        placed.append((first, last))
        end = start
    out = [False] * len(tokens)
    for first, last in placed:
        out[first:last] = [True] * (last - first)
    return out


def chunks(a: list, b: list) -> list[tuple[bool, int, int, int, int]]:
    """(changed, a from, a to, b from, b to) in order, covering both sequences; ends are exclusive."""
    gone, new = [True] * len(a), [True] * len(b)
    for i, j in _kept_pairs(a, b):
        gone[i] = new[j] = False
    gone, new = _latest(a, gone), _latest(b, new)
    out, i, j = [], 0, 0
    while i < len(a) or j < len(b):
        p, q = i, j
        while i < len(a) and j < len(b) and not gone[i] and not new[j]:
            i, j = i + 1, j + 1
        if i > p:
            out.append((False, p, i, q, j))
        p, q = i, j
        while i < len(a) and gone[i]:
            i += 1
        while j < len(b) and new[j]:
            j += 1
        if i > p or j > q:
            out.append((True, p, i, q, j))
    return out


def similarity_of(found: list[tuple[bool, int, int, int, int]]) -> float:
    """Kept tokens as a share of kept ones and of the longer side of each change."""
    same = sum(b - a for changed, a, b, _, _ in found if not changed)
    other = sum(max(b - a, d - c) for changed, a, b, c, d in found if changed)
    return same / (same + other) if other else 1.0


def three_way(original: list, modified: list, latest: list) -> list[tuple[bool, tuple[int, int], tuple[int, int], tuple[int, int]]]:
    """Common head, one changed middle and common tail of three sequences."""
    n = min(map(len, (original, modified, latest)))
    head = 0
    while head < n and original[head] == modified[head] == latest[head]:
        head += 1
    tail = 0
    while tail < n - head and original[-1 - tail] == modified[-1 - tail] == latest[-1 - tail]:
        tail += 1
    sizes = [len(s) for s in (original, modified, latest)]
    out = []
    if head:
        out.append((False, (0, head), (0, head), (0, head)))
    if any(s > head + tail for s in sizes):
        out.append((True, *[(head, s - tail) for s in sizes]))
    if tail:
        out.append((False, *[(s - tail, s) for s in sizes]))
    return out


def diff_chunks(a: Column, b: Column) -> Column:
    """Chunks of two arrays of tokens."""
    names = ("changed", "orig_start", "orig_end", "mod_start", "mod_end")
    return each(lambda x, y: [dict(zip(names, c, strict=True)) for c in chunks(list(x), list(y))], CHUNK, a, b)


def has_changes(found: Column) -> Column:
    return F.exists(found, lambda c: c["changed"])


def similarity(found: Column) -> Column:
    same = F.aggregate(found, F.lit(0), lambda acc, c: acc + F.when(c["changed"], 0).otherwise(c["orig_end"] - c["orig_start"]))
    other = F.aggregate(found, F.lit(0), lambda acc, c: acc + F.when(c["changed"], F.greatest(c["orig_end"] - c["orig_start"], c["mod_end"] - c["mod_start"])).otherwise(0))
    return F.when(other == 0, F.lit(1.0)).otherwise(same / (same + other)).cast("float")


# ---- deltas ----


def apply_copy_delta(base: bytes, delta: bytes) -> bytes:
    """A delta of copies from the base and literals, after two sizes; a copy of size 0 is one of 64 KiB."""
    source, at = size_varint(delta)
    target, at = size_varint(delta, at)
    if source != len(base):
        raise ValueError("the delta is for another base")
    out = bytearray()
    while at < len(delta):
        op = delta[at]
        at += 1
        if op & 128:
            place = size = 0
            for i in range(7):
                if op >> i & 1:
                    if i < 4:
                        place |= delta[at] << 8 * i
                    else:
                        size |= delta[at] << 8 * (i - 4)
                    at += 1
            out += base[place : place + (size or 0x10000)]
        elif op:
            out += delta[at : at + op]
            at += op
        else:
            raise ValueError("reserved delta instruction")
    if len(out) != target:
        raise ValueError("the delta gives another size")
    return bytes(out)


def lz4_block(data: bytes, size: int) -> bytes:
    """Decode one LZ4 block."""
    out, at = bytearray(), 0
    while at < len(data):
        token = data[at]
        at += 1
        n = token >> 4
        if n == 15:
            while True:
                n += data[at]
                at += 1
                if data[at - 1] != 255:
                    break
        out += data[at : at + n]
        at += n
        if at >= len(data):
            break
        back = data[at] | data[at + 1] << 8
        at += 2
        n = (token & 15) + 4
        if n == 19:
            while True:
                n += data[at]
                at += 1
                if data[at - 1] != 255:
                    break
        for _ in range(n):
            out.append(out[-back])
    if len(out) != size:
        raise ValueError("the block gives another size")
    return bytes(out)


def _section(data: bytes, version: int) -> bytes:
    if not version:
        return data
    size, at = plain_varint(data)
    rest = data[at:]
    if len(rest) == size:
        return rest
    return zlib.decompress(rest) if version == 1 else lz4_block(rest, size)


def apply_window_delta(base: bytes, delta: bytes) -> bytes:
    """Windows of instructions that copy from the base, from the target so far, or from new data (versions 0, 1 and 2)."""
    if delta[:3] != b"SVN" or delta[3] > 2:
        raise ValueError("not a window delta")
    version, at, out = delta[3], 4, bytearray()
    while at < len(delta):
        fields = []
        for _ in range(5):
            value, at = plain_varint(delta, at)
            fields.append(value)
        place, length, target, code_size, data_size = fields
        code = _section(delta[at : at + code_size], version)
        fresh = _section(delta[at + code_size : at + code_size + data_size], version)
        at += code_size + data_size
        source, done, i, used = base[place : place + length], bytearray(), 0, 0
        while i < len(code):
            kind, n = code[i] >> 6, code[i] & 63
            i += 1
            if not n:
                n, i = plain_varint(code, i)
            if kind == 2:
                done += fresh[used : used + n]
                used += n
                continue
            start, i = plain_varint(code, i)
            if kind == 0:
                done += source[start : start + n]
            else:
                for k in range(n):  # may overlap what it writes
                    done.append(done[start + k])
        if len(done) != target:
            raise ValueError("a window gives another size")
        out += done
    return bytes(out)


def make_window_delta(base: bytes, target: bytes, version: int = 0) -> bytes:
    """One window that copies what both begin with from the base and the rest from new data; version 1 deflates its sections."""
    same = 0
    while same < min(len(base), len(target)) and base[same] == target[same]:
        same += 1
    fresh = target[same:]
    code = (_instruction(0, same) + _plain(0) if same else b"") + (_instruction(2, len(fresh)) if fresh else b"")

    def section(data: bytes) -> bytes:
        if not version:
            return data
        small = zlib.compress(data)
        return _plain(len(data)) + (small if len(small) < len(data) else data)

    code, fresh = section(code), section(fresh)
    head = b"".join(_plain(x) for x in (0, len(base), len(target), len(code), len(fresh)))
    return b"SVN" + bytes([version]) + head + code + fresh


def _plain(n: int) -> bytes:
    out = [n & 127]
    while n := n >> 7:
        out.append(128 | n & 127)
    return bytes(reversed(out))


def _instruction(kind: int, n: int) -> bytes:
    return bytes([kind << 6 | n]) if n < 64 else bytes([kind << 6]) + _plain(n)


def apply_delta(base: Column, delta: Column, windows: bool = False) -> Column:
    return each(apply_window_delta if windows else apply_copy_delta, "binary", base, delta)
